"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Patterns find candidate strings; each value is then counted over the whole corpus by the distinct repositories and owners that hold
it. A value that many owners share, or that stands in many repositories for each of its few owners, is an example that was copied
around; one in few places of few owners that looks random is taken for a live credential. Besides the fixed patterns the scan proposes long strings of mixed character classes; those are
reported only where ownership says that they are live.

Positions come from splitting a text at a pattern: the lengths of the pieces and of the matches, summed up in a window over
the (small) table of matches, so a text with very many matches costs no more than its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import written

#: Kinds in the order of the report: name, Java pattern, group of the value, least length of the value.
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("mixed", r"[A-Za-z0-9+/_-]{24,}", 0, 24),
)
#: A pattern that matches no less of those values, and is quicker where short matches abound.
QUICK = {"hex": r"[0-9a-f]{24,}", "access": r"AKIA[A-Z0-9]{16,}"}
BASE = ("assign", "access", "hex")
#: More owners, or more repositories for each owner, make an example.
MAX_OWNERS = 4
MAX_REPOSITORIES = 32
LEAST_CHARACTERS = 6
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]?|xxxx|0000000|1234567"


def _found(kind: str, pattern: str, group: int, least: int, text: Column) -> Column:
    """array<struct<kind, gap, size, value, ok>> of one pattern's matches; gap: code points since the match before."""
    match = QUICK.get(kind, pattern)
    rank = [p[0] for p in PATTERNS].index(kind)
    whole = F.regexp_extract_all(text, F.lit(match), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(match), F.lit(group)) if group else whole
    zipped = F.arrays_zip(F.split(text, match, -1).alias("piece"), whole.alias("whole"), value.alias("value"))

    def row(x: Column) -> Column:
        v = x["value"]
        ok = F.length(v) >= least
        if kind == "mixed":
            ok = ok & v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
        return F.struct(F.lit(rank).alias("kind"), F.length(x["piece"]).alias("gap"), F.length(x["whole"]).alias("size"), v.alias("value"), ok.alias("ok"))

    none = F.array().cast("array<struct<kind:int,gap:int,size:int,value:string,ok:boolean>>")
    return F.when(text.rlike(match), F.filter(F.transform(zipped, row), lambda x: x["value"].isNotNull())).otherwise(none)


def _looks_live(value: Column) -> Column:
    return (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_CHARACTERS) & ~value.rlike(PLACEHOLDER)


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None, keep_rows: bool = False) -> DataFrame:
    """(row, id, owner, repository, found) for each row of df, as a written table; found: the matches of all patterns.

    keep_rows: doc has the row of df as a struct. Its text then need not be matched or fetched again.
    """
    doc = [F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc")] if keep_rows else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = df.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repository_col or id_col).cast("string"), F.lit("")).alias("repository"), *doc)
    return written(named.select(F.monotonically_increasing_id().alias("row"), "id", "owner", "repository", F.concat(*(_found(*p, F.col("text")) for p in PATTERNS)).alias("found"), *(["doc"] if doc else [])))


def ownership(spans: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(hash, n_owners, n_repositories, verdict) for each value: live, example (many owners, or many repositories of few) or weak (does not look random)."""
    # Counts of distinct pairs go before the shuffle, so a value copied into most documents is a few rows of each task.
    owners = spans.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    repositories = spans.select("hash", "owner", "repository").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_repositories"))
    looks = spans.groupBy("hash").agg(F.max("looks").alias("looks"))
    copied = (F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories * F.col("n_owners"))
    verdict = F.when(copied, "example").when(F.col("looks"), "live").otherwise("weak")
    return owners.join(repositories, "hash").join(looks, "hash").select("hash", "n_owners", "n_repositories", verdict.alias("verdict"))


def _judged(drawn: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """The spans of candidates with the verdicts on their values; of the proposed kind only those that are live."""
    each = drawn.where(F.size("found") > 0).select("row", "id", "owner", "repository", F.posexplode("found").alias("at", "x"))
    run = W.partitionBy("row", "x.kind").orderBy("at")
    names = F.array(*(F.lit(p[0]) for p in PATTERNS))
    spans = (
        each.withColumn("end", F.sum(F.col("x.gap") + F.col("x.size")).over(run))
        .where("x.ok")
        .select("row", "id", "owner", "repository", "x.kind", names[F.col("x.kind")].alias("name"), (F.col("end") - F.col("x.size")).alias("start"), "end", "x.value", F.sha2("x.value", 256).alias("hash"))
        .withColumn("looks", _looks_live(F.col("value")))
    )
    spans = written(spans)
    judged = spans.join(ownership(spans, max_owners, max_repositories), "hash").drop("owner", "repository", "looks")
    return judged.where(F.col("name").isin(*BASE) | (F.col("verdict") == "live"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> tuple[DataFrame, DataFrame]:
    """(rows, spans) of df.

    rows: (row, id), one for each row of df. spans: (row, id, kind, name, start, end, value, hash, n_owners, n_repositories,
    verdict), places in code points, end exclusive; kind is the place of name in PATTERNS. A repository is one of its owner's; without
    a repository column each id is one. Null texts count as empty, null owners as one owner; rows with repeated ids are scanned each;
    other columns are not read; an empty table gives empty tables.
    """
    drawn = candidates(df, id_col, text_col, owner_col, repository_col)
    return drawn.select("row", "id"), _judged(drawn, max_owners, max_repositories)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mark: str = "[secret]", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """df with every live value replaced in the texts of the rows that hold it; all rows and columns stay, whatever their names.

    Texts are matched once; only those with a match of some pattern are shuffled, to meet their values. A null text stays null, an empty
    table empty; rows with null or repeated ids are treated each. An n_chars column is counted anew where a text has changed.
    """
    drawn = candidates(df, id_col, text_col, owner_col, keep_rows=True)
    spans = _judged(drawn, max_owners, max_repositories)
    live = spans.where("verdict = 'live'").groupBy("row").agg(F.array_sort(F.collect_set("value"), lambda a, b: F.length(b) - F.length(a)).alias("values"))
    some = F.exists("found", lambda x: x["ok"])
    hit = drawn.where(some).select("row", "doc").join(live, "row", "left")
    clean = F.aggregate(F.coalesce("values", F.array().cast("array<string>")), F.col("doc")[text_col], lambda t, v: F.replace(t, v, F.lit(mark)))
    hit = hit.withColumn("clean", clean)
    fresh = {text_col: F.col("clean")}
    if "n_chars" in df.columns:
        fresh["n_chars"] = F.when(F.col("values").isNotNull(), F.length("clean").cast(df.schema["n_chars"].dataType)).otherwise(F.col("doc")["n_chars"])
    own = {c: F.col("doc")[c] for c in df.columns}
    return drawn.where(~some).select(*(x.alias(c) for c, x in own.items())).union(hit.select(*(x.alias(c) for c, x in (own | fresh).items())))
