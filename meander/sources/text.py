"""Text sources: edge lists, lists of ids, numbers by line, block logs and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import row_numbers


def _is_comment(line: Column) -> Column:
    return line.rlike("^[#%]") | (F.trim(line) == "")


def numbered_lines(spark: SparkSession, path: str, keep_all: bool = False) -> DataFrame:
    """(line, value): the lines of a text that are no comments (keep_all: all), numbered from 0 in their order, files by path.

    A split of a file is read in order by one task, so file, start of the split and the running id of the scan give the order;
    places are numbered by ranges of it, so a file may have any size.
    """
    split = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    return row_numbers(split if keep_all else split.where(~_is_comment(F.col("value"))), "line", F.col("_f"), F.col("_b"), F.col("_m")).select("line", "value")


def read_edges(spark: SparkSession, path: str, strict: bool = True, numbered: bool = False) -> DataFrame:
    """(src, dst) of an edge list: two integers by tab, comma or blanks, further fields left out, # and % open comments.

    strict: a line without two integers ends the job; else it is dropped. numbered: also line, the place in the file, by which ids can
    be given in the order of first appearance.
    """
    parts = F.split(F.trim("value"), "[\t, ]+")
    lines = numbered_lines(spark, path) if numbered else spark.read.text(path).where(~_is_comment(F.col("value")))
    own = ["line"] if numbered else []
    edges = lines.select(*own, F.get(parts, F.lit(0)).try_cast("bigint").alias("src"), F.get(parts, F.lit(1)).try_cast("bigint").alias("dst"), "value")
    if strict:
        ok = F.col("src").isNotNull() & F.col("dst").isNotNull()
        return edges.select(*own, F.when(ok, F.col("src")).otherwise(F.raise_error(F.concat(F.lit("not an edge: "), "value"))).cast("bigint").alias("src"), "dst")
    return edges.where("src is not null and dst is not null").select(*own, "src", "dst")


def read_starts(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(position, source): the first n ids of a file with one id a line, in the order of the lines; repeated ids stay."""
    lines = read_numbers(spark, path, "bigint").select(F.col("line").alias("position"), F.col("value").alias("source"))
    return lines if n is None else lines.where(F.col("position") < n)


def read_numbers(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """(line, value) of a file with one number a line: thresholds by block, block starts, or the block of each vertex."""
    return numbered_lines(spark, path).select("line", F.trim("value").cast(kind).alias("value"))


def read_block_starts(spark: SparkSession, path: str) -> DataFrame:
    """(block_id, start_v, end_v) of a file of block starts whose last line is the end of the last block."""
    line = read_numbers(spark, path, "bigint")
    end = line.select((F.col("line") - 1).alias("line"), F.col("value").alias("end_v"))
    return line.join(end, "line").select(F.col("line").cast("int").alias("block_id"), F.col("value").alias("start_v"), "end_v")


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """(vertex, block_id) of a file that has the block of each vertex in its line."""
    return read_numbers(spark, path, "int").select(F.col("line").alias("vertex"), F.col("value").alias("block_id"))


def read_pair_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(block_id, other_block, ths) of a file of thresholds by pairs: for each block from 1 on a number for each smaller one, in any number of lines."""
    each = numbered_lines(spark, path).select("line", F.posexplode(F.split(F.trim("value"), "[\\t, ]+")).alias("i", "text"))
    numbered = row_numbers(each, "n", F.col("line"), F.col("i"))
    block = numbered.withColumn("b", F.floor((1 + F.sqrt(1 + 8 * F.col("n"))) / 2).cast("bigint"))
    return block.select(F.col("b").cast("int").alias("block_id"), F.expr("cast(n - b * (b - 1) div 2 as int)").alias("other_block"), F.col("text").cast("double").alias("ths"))


#: Columns of block logs by the names that the threshold training knows, and their types. Fixed names: those of the log files.
BLOCK_LOG = {
    "dynamic-block-id": ("block_id", "int"),
    "static-block-id": ("other_block", "int"),
    "nverts": ("nverts", "bigint"),
    "nedges": ("nedges", "bigint"),
    "nwalks": ("nwalks", "bigint"),
    "load-block-time": ("load_time", "double"),
    "exec-block-time": ("exec_time", "double"),
    "exec-bucket-time": ("exec_time", "double"),
}


def read_block_log(spark: SparkSession, path: str) -> DataFrame:
    """A block log with its header, whatever the order of its columns: (block_id, other_block, nverts, nedges, nwalks, load_time, exec_time), those that it has.

    A log of static blocks has no dynamic ones: its block_id is the static block.
    """
    log = spark.read.csv(path, header=True)
    names = BLOCK_LOG if "dynamic-block-id" in log.columns else BLOCK_LOG | {"static-block-id": BLOCK_LOG["dynamic-block-id"]}
    return log.select(*(F.col(f"`{c}`").cast(kind).alias(name) for c, (name, kind) in names.items() if c in log.columns))


def read_settings(text: str, local: str | None = None, **over: str) -> dict[str, str]:
    """key = value lines; # and % open comments. A local text stands in for the main one; keywords win over both."""
    out = {}
    for line in (text if local is None else local).splitlines():
        line = line.strip()
        if line and line[0] not in "#%":
            key, found, value = line.partition("=")
            if not found:
                raise ValueError(f"not a setting: {line}")
            out[key.strip()] = value.strip()
    return out | {k: str(v) for k, v in over.items()}
