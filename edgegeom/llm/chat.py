"""Chat formatting: layouts recognised by the hash of their nested field paths.

A layout is declared once as a :class:`Layout`: its field paths and where role and text lie. The
fingerprint of a table (or of one JSON record) is the hash of its sorted field paths; it selects the
layout, whose declaration is compiled to DataFrame expressions giving canonical turns
``array<struct<turn, role, text>>``. Only DataFrame functions are used.

Defined results: a null text or role is the empty string; turns are ordered by (turn, role, text),
nulls first, so repeated rows are repeated turns; very long
texts stay whole; an empty table gives no rows; a conversation without turns formats to the empty
string; columns that a layout does not name are ignored, whatever they are called; a table of an
unknown layout is refused, a JSON record of one keeps ``layout`` null and has no turns.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Strings with a meaning in this template or in other common ones; escaped wherever a text has them.
CONTROL = (START, SEPARATOR, END[:-1], "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``kind`` is ``rows`` (a turn per row), ``list`` (an array of turns) or ``fields`` (a column per turn).

    ``parts`` holds, for ``rows``, the columns of turn, role and text; for ``list``, the array's
    column and its role and text fields; for ``fields``, ``role=column`` in order of the turns.
    """

    name: str
    kind: str
    parts: tuple[str, ...]

    def paths(self) -> list[str]:
        if self.kind == "rows":
            return sorted(self.parts)
        if self.kind == "list":
            return sorted([self.parts[0], f"{self.parts[0]}[].{self.parts[1]}", f"{self.parts[0]}[].{self.parts[2]}"])
        return sorted(p.split("=")[1] for p in self.parts)


LAYOUTS = (
    Layout("turn rows", "rows", ("turn", "role", "text")),
    Layout("messages", "list", ("messages", "role", "content")),
    Layout("conversations", "list", ("conversations", "from", "value")),
    Layout("prompt and completion", "fields", ("user=prompt", "assistant=completion")),
    Layout("prompt and response", "fields", ("user=prompt", "assistant=response")),
    Layout("instruction", "fields", ("user=instruction", "assistant=output")),
    Layout("instruction with input", "fields", ("user=instruction", "user=input", "assistant=output")),
    Layout("question and answer", "fields", ("user=question", "assistant=answer")),
    Layout("system, question and answer", "fields", ("system=system", "user=question", "assistant=answer")),
)
#: Names that list layouts use for the same roles; rows keep their roles as they are.
ROLES = {"human": "user", "gpt": "assistant"}


def field_paths(kind: DataType, prefix: str = "") -> list[str]:
    """Paths of all nested fields; ``[]`` marks the elements of an array."""
    if isinstance(kind, ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    if not isinstance(kind, StructType):
        return []
    at = f"{prefix}." if prefix else ""
    return [p for f in kind.fields for p in [at + f.name, *field_paths(f.dataType, at + f.name)]]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def choose_layout(schema: StructType, id_column: str, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout:
    """The layout whose fingerprint the table has; else, with extra columns, the one with most paths."""
    known = {fingerprint(x.paths()): x for x in layouts}
    have = [p for p in field_paths(schema) if p != id_column]
    exact = known.get(fingerprint(have))
    if exact:
        return exact
    within = [x for x in layouts if set(x.paths()) <= set(have)]
    if not within:
        raise ValueError(f"no layout has the fields {sorted(have)}")
    return max(within, key=lambda x: len(x.paths()))


def _turn(turn: Column, role: Column, text: Column) -> Column:
    role = F.coalesce(role.cast("string"), F.lit(""))
    return F.struct(turn.cast("bigint").alias("turn"), role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _listed(turns: Column, role: str, text: str) -> Column:
    def named(given: Column) -> Column:
        for old, new in ROLES.items():
            given = F.when(given == old, new).otherwise(given)
        return given

    made = F.transform(turns, lambda x, i: _turn(i, named(x[role]), x[text]))
    return F.coalesce(made, F.array().cast(TURNS))


def canonical_turns(df: DataFrame, id_column: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``(id_column, turns)`` of a table, by the layout that its fingerprint selects."""
    layout = choose_layout(df.schema, id_column, layouts)
    key = F.col(f"`{id_column}`").alias(id_column)
    if layout.kind == "rows":
        turn, role, text = (F.col(c) for c in layout.parts)
        return df.groupBy(key).agg(F.sort_array(F.collect_list(_turn(turn, role, text))).alias("turns"))
    if layout.kind == "list":
        return df.select(key, _listed(F.col(layout.parts[0]), *layout.parts[1:]).alias("turns"))
    made = [_turn(F.lit(i), F.lit(r), F.col(c)) for i, (r, c) in enumerate(p.split("=") for p in layout.parts)]
    return df.select(key, F.array(*made).alias("turns"))


def record_fingerprint(record: Column) -> Column:
    """Hash of the field paths of one JSON record: its inferred schema without the scalar types."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    return F.xxhash64(F.regexp_replace(schema, r"(?<=: |ARRAY<)(?!OBJECT|ARRAY)[A-Z]+(\([0-9,]+\))?", "_"))


def _record_schema(layout: Layout) -> tuple[str, str]:
    """The inferred schema's form that :func:`record_fingerprint` hashes, and the schema to read by."""
    if layout.kind == "list":
        name, *fields = layout.parts
        inner = ", ".join(f"{f}: _" for f in sorted(fields))
        return f"OBJECT<{name}: ARRAY<OBJECT<{inner}>>>", f"`{name}` array<struct<{','.join(f'`{f}`:string' for f in fields)}>>"
    names = [p.split("=")[1] for p in layout.parts]
    return f"OBJECT<{', '.join(f'{n}: _' for n in sorted(names))}>", ", ".join(f"`{n}` string" for n in names)


def record_turns(df: DataFrame, id_column: str, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``(id_column, layout, turns)`` of a column of JSON records, each by its own fingerprint."""
    own = record_fingerprint(F.col(record))
    name, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for layout in reversed([x for x in layouts if x.kind != "rows"]):
        form, schema = _record_schema(layout)
        row = F.from_json(F.col(record), schema)
        if layout.kind == "list":
            made = _listed(row[layout.parts[0]], *layout.parts[1:])
        else:
            made = F.array(*[_turn(F.lit(i), F.lit(r), row[c]) for i, (r, c) in enumerate(p.split("=") for p in layout.parts)])
        same = F.coalesce(own == F.xxhash64(F.lit(form)), F.lit(False))
        name, turns = F.when(same, layout.name).otherwise(name), F.when(same, made).otherwise(turns)
    return df.select(F.col(id_column), name.alias("layout"), turns.alias("turns"))


def escape(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    """Doubles every backslash, then puts one into each control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in control:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(df: DataFrame, trained: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``, the code-point ranges of the texts of role ``trained``."""
    made = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), escape(t["role"]), F.lit(SEPARATOR)).alias("head"),
        escape(t["text"]).alias("body"),
        (t["role"] == trained).alias("loss"),
    ))
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start, length = acc["at"] + F.length(p["head"]), F.length(p["body"]).cast("bigint")
        span = F.array(F.struct(start.alias("start"), length.alias("length")))
        return F.struct(
            (start + length + len(END)).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    joined = F.array_join(F.transform("pieces_of_turns", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return (
        df.withColumn("pieces_of_turns", made)
        .withColumn("formatted", joined)
        .withColumn("loss_spans", F.aggregate("pieces_of_turns", empty, step, lambda acc: acc["spans"]))
        .drop("pieces_of_turns")
    )


def read_turns(formatted: Column) -> Column:
    """The turns ``array<struct<role, text>>`` that a formatted string holds."""
    cut = re.sub(r"([|])", r"\\\1", END)
    segments = F.filter(F.split(formatted, cut), lambda s: s != "")
    return F.transform(segments, lambda s: F.struct(
        unescape(F.substring_index(F.substr(s, F.lit(len(START) + 1)), SEPARATOR, 1)).alias("role"),
        unescape(F.substring_index(s, SEPARATOR, -1)).alias("text"),
    ))


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    one = F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(one, "")
