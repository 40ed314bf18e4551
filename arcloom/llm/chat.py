"""Chat formatting through schema fingerprints, in DataFrame functions alone.

A record's layout is told by its nested field paths. Their sorted list is hashed, and the hash selects a declarative
mapping: which path holds the list of turns, or which paths become the turns of which roles. Records of any known
layout become the same canonical turns, array<struct<role, text>>. A typed column has its paths in the schema; a column
of JSON strings is looked at row by row, so that one column may mix layouts.

The template writes each turn as  <|turn:ROLE|>TEXT<|end|>  and a line break. Inside texts and roles a backslash gets a
backslash before it, and so does each "<|", so no text can spell a control string, and reading back undoes it. The loss
mask lists the spans of the assistant's texts in code points of the output.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime


@dataclass(frozen=True)
class Layout:
    """turns: the path of a list with its role and text fields, or () where `fields` gives (path, role) pairs."""

    name: str
    turns: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        if self.turns:
            return [self.turns[0], *(f"{self.turns[0]}[].{x}" for x in self.turns[1:])]
        return [p for p, _ in self.fields]


LAYOUTS = (
    Layout("messages", ("messages", "role", "content")),
    Layout("messages_text", ("messages", "role", "text")),
    Layout("sharegpt", ("conversations", "from", "value")),
    Layout("alpaca", fields=(("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Layout("instruction", fields=(("instruction", "user"), ("output", "assistant"))),
    Layout("instruction_response", fields=(("instruction", "user"), ("response", "assistant"))),
    Layout("prompt_completion", fields=(("prompt", "user"), ("completion", "assistant"))),
    Layout("prompt_response", fields=(("prompt", "user"), ("response", "assistant"))),
    Layout("system_prompt_response", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Layout("question_answer", fields=(("question", "user"), ("answer", "assistant"))),
)
#: Names of speakers in list layouts whose own vocabulary differs.
ALIASES = {"sharegpt": {"human": "user", "gpt": "assistant"}}
KNOWN = sorted({p for x in LAYOUTS for p in x.paths()})


def schema_fingerprint(paths: list[str]) -> str:
    """The hash of the sorted nested field paths that some layout knows; others don't count."""
    return hashlib.sha256("\n".join(sorted({*paths} & {*KNOWN})).encode()).hexdigest()[:16]


BY_FINGERPRINT = {schema_fingerprint(x.paths()): x for x in LAYOUTS}


def field_paths(schema: T.DataType, top: str = "") -> list[str]:
    """a, a.b and a[].b of a type."""
    if isinstance(schema, T.StructType):
        named = [(f"{top}.{f.name}" if top else f.name, f.dataType) for f in schema.fields]
        return [p for at, kind in named for p in (at, *field_paths(kind, at))]
    if isinstance(schema, T.ArrayType):
        return [p for p in field_paths(schema.elementType, f"{top}[]")]
    return []


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _mapped(layout: Layout, record: Column) -> Column:
    if layout.turns:
        path, who, what = layout.turns
        names = ALIASES.get(layout.name, {})
        alias = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None
        role = (lambda m: F.coalesce(F.try_element_at(alias, F.lower(m[who])), m[who])) if names else (lambda m: m[who])
        return F.coalesce(F.transform(record[path], lambda m: _turn(role(m), m[what])), F.array().cast("array<struct<role:string,text:string>>"))
    users = [record[p] for p, r in layout.fields if r == "user"]
    turns = [_turn(F.lit(r), record[p]) for p, r in layout.fields if r == "system"]
    turns += [_turn(F.lit("user"), F.concat_ws("\n\n", *[F.when(u != "", u) for u in users]))]
    turns += [_turn(F.lit(r), record[p]) for p, r in layout.fields if r == "assistant"]
    return F.array(*turns)


def _inside(path: str) -> Column:
    """The paths of the first element of a list in a JSON record."""
    keys = F.json_object_keys(F.get_json_object("record", f"$.{path}[0]"))
    return F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.concat(F.lit(f"{path}[]."), k))


def canonical_turns(df: DataFrame, id_col: str = "id", record: str = "record") -> DataFrame:
    """id, layout and turns array<struct<role, text>> of each record, in a struct column or a column of JSON strings.

    Null texts and roles become empty. A record of no known layout, null or malformed has layout null and no turns.
    Fields that no layout knows are passed over. Repeated records pass through, a row each.
    """
    df = runtime.pick(df, id_col, record).toDF("id", "record")
    none = F.array().cast("array<struct<role:string,text:string>>")
    if isinstance(df.schema["record"].dataType, T.StructType):
        layout = BY_FINGERPRINT.get(schema_fingerprint(field_paths(df.schema["record"].dataType)))
        if layout is None:
            return df.select("id", F.lit(None).cast("string").alias("layout"), none.alias("turns"))
        there = F.col("record").isNotNull()
        return df.select("id", F.when(there, F.lit(layout.name)).alias("layout"), F.when(there, _mapped(layout, F.col("record"))).otherwise(none).alias("turns"))
    lists = sorted({x.turns[0] for x in LAYOUTS if x.turns})
    paths = F.concat(
        F.coalesce(F.json_object_keys("record"), F.array().cast("array<string>")),
        *[_inside(x) for x in lists],
    )
    known = F.array_sort(F.array_distinct(F.array_intersect(paths, F.array(*[F.lit(p) for p in KNOWN]))))
    rows = df.select("id", "record", F.substring(F.sha2(F.array_join(known, "\n"), 256), 1, 16).alias("print"))
    name, turns = F.lit(None).cast("string"), none
    for key, layout in BY_FINGERPRINT.items():
        if layout.turns:
            path, who, what = layout.turns
            shape = f"struct<`{path}`: array<struct<`{who}`: string, `{what}`: string>>>"
        else:
            shape = "struct<" + ", ".join(f"`{p}`: string" for p, _ in layout.fields) + ">"
        name = F.when(F.col("print") == key, F.lit(layout.name)).otherwise(name)
        turns = F.when(F.col("print") == key, _mapped(layout, F.from_json("record", shape))).otherwise(turns)
    return rows.select("id", name.alias("layout"), turns.alias("turns"))


def gathered(rows: DataFrame, id_col: str, order: str, role: str, text: str) -> DataFrame:
    """A table with a row a turn as records of the messages layout, by `order`; ties go by role, then text."""
    rows = runtime.pick(rows, id_col, order, role, text).toDF("id", "turn", "role", "content")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    return rows.groupBy("id").agg(F.struct(F.transform(turns, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")).alias("record"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("\\<|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|"), F.lit("\\|"))


def formatted(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """id, formatted string and loss_mask array<struct<start, length>> in code points, of canonical turns.

    A conversation without turns is an empty string with no span.
    """
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit("<|turn:"), _role(t["role"]), F.lit("|>")).alias("a"), escape(t["text"]).alias("b"), (t["role"] == learned).alias("on")))
    rows = turns.select("id", parts.alias("p"))
    tail = "<|end|>\n"
    size = lambda t: F.char_length(t["a"]) + F.char_length(t["b"]) + len(tail)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda s, t: F.struct(
        (s["at"] + size(t)).alias("at"),
        F.when(t["on"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.char_length(t["a"])).alias("start"), F.char_length(t["b"]).alias("length"))))).otherwise(s["spans"]).alias("spans"),
    )
    return rows.select(
        "id",
        F.array_join(F.transform("p", lambda t: F.concat(t["a"], t["b"], F.lit(tail))), "").alias("formatted"),
        F.aggregate("p", start, step, lambda s: s["spans"]).alias("loss_mask"),
    )


_INSIDE = r"(?:[^\\<]++|\\.|<(?!\|))*+"


def parsed(text: Column) -> Column:
    """The turns that an output says, array<struct<role, text>>."""
    whole = rf"(?s)<\|turn:((?:[^\\|]++|\\.)*+)\|>({_INSIDE})<\|end\|>\n"
    return F.transform(
        F.arrays_zip(F.regexp_extract_all(text, F.lit(whole), F.lit(1)).alias("r"), F.regexp_extract_all(text, F.lit(whole), F.lit(2)).alias("t")),
        lambda x: F.struct(unescape(x["r"]).alias("role"), unescape(x["t"]).alias("text")),
    )


def read_back(out: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, both read from the output alone."""
    turns = parsed(F.col("formatted"))
    under = F.array_join(F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    rows = out.select("id", F.char_length("formatted").cast("long").alias("formatted_chars"), turns.alias("turns"), under.alias("under"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("under").cast("long").alias("loss_chars"),
        F.sha2(F.encode("under", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
        "turns",
    )
