"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records of several layouts (message lists, from/value lists, instruction and output, prompt and response, question and answer)
share one wide struct whose unused fields are null. The paths of the fields that a record does fill, sorted and hashed, are its
fingerprint; a table of declared layouts maps each known fingerprint to expressions for canonical turns. A record of no known
layout gets no turns and is reported as unknown.

The template marks each turn: ``<|im_start|>`` role, line break, text, ``<|im_end|>``, line break. Inside roles and texts, each
``<``, any backslashes and ``|`` in a row get one backslash more, so ``<|`` stands in marks only; taking one away reads the text
back. The loss mask is run lengths in code points of the formatted text, two for each turn: (skip, take).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
BREAK = "<|nl|>"
TURNS = "array<struct<role:string,text:string>>"

RECORD = "struct<messages:array<struct<role:string,content:string>>,conversations:array<struct<`from`:string,value:string>>,system:string,instruction:string,input:string,output:string,prompt:string,response:string,completion:string,question:string,answer:string>"


@dataclass(frozen=True)
class Layout:
    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    turns: Callable[[Column], Column]

    def path_lists(self) -> list[str]:
        extra = chain.from_iterable(combinations(self.may, n) for n in range(len(self.may) + 1))
        return ["\n".join(sorted((*self.needs, *x))) for x in extra]


def _turn(role: str | Column, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).cast("string").alias("role"), text.cast("string").alias("text"))


def _spoken(*turns: tuple[str, Column]) -> Column:
    """The turns that have a text."""
    return F.filter(F.array(*(_turn(r, t) for r, t in turns)), lambda x: x["text"].isNotNull())


def _known_role(role: Column) -> Column:
    return F.when(role == "human", "user").when(role == "gpt", "assistant").otherwise(role)


LAYOUTS = (
    Layout("messages", ("messages[]",), ("messages[].role", "messages[].content"), lambda r: F.transform(r["messages"], lambda m: _turn(m["role"], m["content"]))),
    Layout("from_value", ("conversations[]",), ("conversations[].from", "conversations[].value", "system"), lambda r: F.concat(_spoken(("system", r["system"])), F.transform(r["conversations"], lambda m: _turn(_known_role(m["from"]), m["value"])))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), lambda r: _spoken(("system", r["system"]), ("user", F.concat_ws("\n\n", r["instruction"], F.when(r["input"] != "", r["input"]))), ("assistant", r["output"]))),
    Layout("prompt_response", ("prompt", "response"), ("system",), lambda r: _spoken(("system", r["system"]), ("user", r["prompt"]), ("assistant", r["response"]))),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), lambda r: _spoken(("system", r["system"]), ("user", r["prompt"]), ("assistant", r["completion"]))),
    Layout("question_answer", ("question", "answer"), ("system",), lambda r: _spoken(("system", r["system"]), ("user", r["question"]), ("assistant", r["answer"]))),
)


def field_paths(record: Column, kind: T.StructType) -> Column:
    """Sorted array of the paths that are filled; ``a[]`` is a list that is there, ``a[].b`` one whose elements fill b."""
    found = []
    for f in kind.fields:
        here = record[f.name]
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            found.append(F.when(here.isNotNull(), f"{f.name}[]"))
            for g in f.dataType.elementType.fields:
                found.append(F.when(_any_filled(here, g.name), f"{f.name}[].{g.name}"))
        else:
            found.append(F.when(here.isNotNull(), f.name))
    return F.array_sort(F.array_compact(F.array(*found)))


def _any_filled(items: Column, name: str) -> Column:
    return F.exists(items, lambda x: x[name].isNotNull())


def fingerprint(record: Column, kind: T.StructType) -> Column:
    return F.xxhash64(F.array_join(field_paths(record, kind), "\n"))


def canonical(df: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """df with fingerprint, layout (null: unknown) and turns (array of role and text; null: unknown). A null text is empty.

    A null record or one without fields is unknown; equal records give equal turns. Columns of df with these three names are
    replaced, all others stay; an empty table gives an empty result.
    """
    df = df.withColumn("fingerprint", fingerprint(F.col(record_col), df.schema[record_col].dataType))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    names = df.schema[record_col].dataType.names
    for x in reversed([x for x in layouts if all(p.split("[")[0] in names for p in (*x.needs, *x.may))]):
        own = F.col("fingerprint").isin([])
        for paths in x.path_lists():
            own = own | (F.col("fingerprint") == F.xxhash64(F.lit(paths)))
        layout, turns = F.when(own, x.name).otherwise(layout), F.when(own, x.turns(F.col(record_col)).cast(TURNS)).otherwise(turns)
    filled = F.transform(turns, lambda t: _turn(F.coalesce(t["role"], F.lit("")), F.coalesce(t["text"], F.lit(""))))
    return df.withColumn("layout", layout).withColumn("turns", filled)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _header(role: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))


def format_turns(df: DataFrame, turns_col: str = "turns", learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """df with formatted (string) and loss_runs (array of skip and take, two for each turn); null turns give nulls.

    No turns give an empty text and mask; repeated turns stay. Columns of df with these two names are replaced, all others stay; an
    empty table gives an empty result.
    """
    end = len(END)

    def runs(t: Column) -> Column:
        size, mine = F.length(escape(t["text"])), t["role"].isin(*learned)
        take = F.when(mine, size).otherwise(0)
        return F.array(F.struct(F.length(_header(t["role"])).alias("skip"), take.alias("take")), F.struct((size - take + end).alias("skip"), F.lit(0).alias("take")))

    text = F.array_join(F.transform(F.col(turns_col), lambda t: F.concat(_header(t["role"]), escape(t["text"]), F.lit(END))), "")
    return df.withColumn("formatted", text).withColumn("loss_runs", F.flatten(F.transform(F.col(turns_col), runs)))


def parse_turns(formatted: Column, loss_runs: Column) -> Column:
    """Array of (role, text, loss) read back from a formatted text and its mask; loss: the unescaped text under the mask, or null."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def read(piece: Column, i: Column) -> Column:
        line = F.instr(piece, F.lit("\n"))
        run = F.get(loss_runs, i * 2)
        role = unescape(F.replace(F.substring(piece, F.lit(len(START) + 1), line - len(START) - 1), F.lit(BREAK), F.lit("\n")))
        loss = F.when(run["take"] > 0, unescape(F.substring(piece, run["skip"] + 1, run["take"])))
        return F.struct(role.alias("role"), unescape(F.substring(piece, line + 1, F.length(piece))).alias("text"), loss.alias("loss"))

    return F.transform(pieces, read)


def from_rows(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, record) from a table with a row for each turn, in the layout of message lists.

    Turns are in the order of turn, role and text, nulls first; repeated rows stay. Rows with a null conversation id are one
    conversation. Other columns are not read.
    """
    row = F.struct(F.col(turn_col).alias("t"), F.col(role_col).alias("role"), F.col(text_col).alias("content"))
    listed = df.groupBy(F.col(conv_col).alias("conv")).agg(F.sort_array(F.collect_list(row)).alias("m"))
    message = F.transform("m", lambda x: F.struct(x["role"].cast("string").alias("role"), x["content"].cast("string").alias("content")))
    return listed.select("conv", F.struct(message.alias("messages")).alias("record"))


def by_shape(df: DataFrame) -> DataFrame:
    """Message lists (conv, record) as records of the wide struct, each in the layout that holds its turns and no more.

    One question and its answer: question and answer if the question ends with a question mark, else prompt and response; with a system
    text before them: instruction and output, or prompt and completion if the answer has several lines; longer talks of
    user and assistant, and of those with a system text before: from/value lists; any other list stays as it is.
    """
    m = F.col("record")["messages"]
    roles, text = F.transform(m, lambda x: F.coalesce(x["role"], F.lit(""))), lambda i: F.coalesce(F.get(m, F.lit(i))["content"], F.lit(""))
    system = F.get(roles, F.lit(0)) == "system"
    talk = F.slice(m, 1 + system.cast("int"), F.greatest(F.size(m), F.lit(1)))
    spoken = (F.size(talk) > 0) & F.forall(talk, lambda x: F.coalesce(x["role"].isin("user", "assistant"), F.lit(False)))
    pair = F.array_join(F.transform(talk, lambda x: F.coalesce(x["role"], F.lit(""))), ",") == "user,assistant"
    layout = (
        F.when(pair & ~system & text(0).endswith("?"), "question_answer").when(pair & ~system, "prompt_response")
        .when(pair & F.contains(text(2), F.lit("\n")), "prompt_completion").when(pair, "instruction")
        .when(spoken, "from_value").otherwise("messages")
    )
    x = df.select("conv", "record", layout.alias("layout"), F.when(system, text(0)).alias("system"), F.when(system, text(1)).otherwise(text(0)).alias("asked"), F.when(system, text(2)).otherwise(text(1)).alias("said"), talk.alias("talk"))

    def only(name: str, value: Column | str) -> Column:
        return F.when(F.col("layout") == name, value)

    said_as = F.transform("talk", lambda t: F.struct(F.when(t["role"] == "user", "human").otherwise("gpt").alias("from"), F.coalesce(t["content"], F.lit("")).alias("value")))
    fields = {
        "messages": only("messages", F.col("record")["messages"]), "conversations": only("from_value", said_as), "system": F.when(F.col("layout") != "messages", F.col("system")),
        "instruction": only("instruction", F.col("asked")), "input": F.lit(None).cast("string"), "output": only("instruction", F.col("said")),
        "prompt": F.coalesce(only("prompt_response", F.col("asked")), only("prompt_completion", F.col("asked"))), "response": only("prompt_response", F.col("said")), "completion": only("prompt_completion", F.col("said")),
        "question": only("question_answer", F.col("asked")), "answer": only("question_answer", F.col("said")),
    }
    return x.select("conv", F.struct(*(v.alias(k) for k, v in fields.items())).cast(RECORD).alias("record"))


def chats(df: DataFrame, shape: Callable[[DataFrame], DataFrame] | None = None, **columns: str) -> DataFrame:
    """(conv, layout, turns, formatted, loss_runs) of a table with a row for each turn; shape may turn the records (conv, record) into other layouts.

    An empty table gives an empty result.
    """
    listed = from_rows(df, **columns)
    return format_turns(canonical(shape(listed) if shape else listed)).select("conv", "layout", "turns", "formatted", "loss_runs")


def records(df: DataFrame, json_col: str) -> DataFrame:
    """df with record: the JSON text of each row read as the wide struct. Text that is no JSON object, or null, has no field: unknown.

    Other columns stay; one named record is replaced. Equal rows give equal records; an empty table gives an empty result.
    """
    return df.withColumn("record", F.from_json(F.col(json_col), RECORD))
