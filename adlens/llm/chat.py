"""Chat formatting by schema fingerprints, DataFrame functions only.

Records of any layout come as JSON texts. The fingerprint of a record is the hash of its nested
field paths, types left out; it selects one of the declared ``LAYOUTS``, and the layout says where
the turns are. A table is read without JSON: the same hash over the nested paths of its schema selects
the layout, once for all rows.
The canonical turns are rows, and a template turns them into one text per conversation with the
spans that count for the loss.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The marks of the template, and strings that other chat formats treat as control.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = (TURN, BODY, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
           "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_REST = "|".join(re.escape(c[1:]) for c in CONTROL)


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    ``items`` names an array of turn objects with ``role`` and ``text`` fields; without it, each of
    ``parts`` (role, fields joined by a blank line) is one turn; with ``row`` the record itself is
    one turn, numbered by the field ``order``. Fields in ``optional`` may be missing.
    """

    name: str
    items: str | None = None
    role: str = "role"
    text: str = "content"
    row: bool = False
    order: str | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def shapes(self) -> list[str]:
        """The normalised shapes of this layout's records, one per set of optional fields."""
        if self.items:
            inner = ", ".join(sorted((self.role, self.text)))
            fixed = {self.items: f"{self.items}: ARRAY<OBJECT<{inner}>>"}
        elif self.row:
            fixed = {f: f for f in (self.role, self.text, self.order) if f}
        else:
            fixed = {f: f for _, fields in self.parts for f in fields if f not in self.optional}
        extra = [set(c) for n in range(len(self.optional) + 1) for c in combinations(self.optional, n)]
        return [
            "OBJECT<" + ", ".join(v for _, v in sorted({**fixed, **{f: f for f in more}}.items())) + ">"
            for more in extra
        ]


#: Declared layouts; callers may pass others.
LAYOUTS = (
    Layout("turn_rows", row=True, text="text", order="turn"),
    Layout("messages", items="messages"),
    Layout("from_value", items="conversations", role="from", text="value",
           roles={"human": "user", "gpt": "assistant"}),
    Layout("prompt_completion", parts=(("system", ("system",)), ("user", ("prompt",)),
           ("assistant", ("completion",))), optional=("system",)),
    Layout("prompt_response", parts=(("system", ("system",)), ("user", ("prompt",)),
           ("assistant", ("response",))), optional=("system",)),
    Layout("instruction", parts=(("system", ("system",)), ("user", ("instruction", "input")),
           ("assistant", ("output",))), optional=("system", "input")),
    Layout("question_answer", parts=(("user", ("question",)), ("assistant", ("answer",)))),
)

_TURNS = "array<struct<role:string,text:string>>"


def as_records(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    """(key, record): the named columns of each row, of any type, as one JSON text."""
    packed = F.struct(*(F.col(f"`{f}`") for f in fields))
    return rows.select(F.col(f"`{key}`").alias("key"),
                       F.to_json(packed, {"ignoreNullFields": "false"}).alias("record"))


def _parsed(record: Column) -> Column:
    """A JSON text as a variant, null if it is broken; strings in it may have any length."""
    return F.from_json(record, "variant", {"maxStringLen": str(2**31 - 1)})


def shape(record: Column) -> Column:
    """Nested field paths of a JSON text without scalar types, in order of names."""
    described = F.schema_of_variant(_parsed(record))
    return F.regexp_replace(described, r": (?!OBJECT<|ARRAY<)[A-Z]+(\([0-9, ]+\))?", "")


def shape_of_type(kind: T.DataType) -> str:
    """The shape of a column type, written as ``shape`` writes it; a scalar has none."""
    if isinstance(kind, T.StructType):
        inner = ((f.name, shape_of_type(f.dataType)) for f in kind.fields)
        return "OBJECT<" + ", ".join(sorted(f"{name}: {below}" if below else name for name, below in inner)) + ">"
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{shape_of_type(kind.elementType) or kind.elementType.simpleString()}>"
    return ""


def hashed(shapes: Column) -> Column:
    return F.xxhash64(shapes)


def fingerprint(record: Column) -> Column:
    return hashed(shape(record))


def _value(record: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(_parsed(record), f"$['{name}']", kind)


def _turns(layout: Layout, value) -> Column:
    """The turns of one record; ``value(name, type)`` reads one of its fields."""
    if layout.items:
        kind = f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>"
        turns = F.transform(value(layout.items, kind), lambda t: F.struct(
            t[layout.role].cast("string").alias("role"), t[layout.text].cast("string").alias("text")))
    elif layout.row:
        turns = F.array(F.struct(value(layout.role, "string").alias("role"), value(layout.text, "string").alias("text")))
    else:
        made = [
            F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *(value(f, "string") for f in fields)).alias("text"))
            for role, fields in layout.parts
        ]
        absent = [all(f in layout.optional for f in fields) for _, fields in layout.parts]
        shown = [
            F.when(F.coalesce(*(value(f, "string") for f in fields)).isNotNull(), turn) if gone else turn
            for turn, gone, (_, fields) in zip(made, absent, layout.parts)
        ]
        turns = F.filter(F.array(*shown), lambda t: t.isNotNull())
    return F.transform(turns, lambda t: F.struct(_renamed(layout, t["role"]).alias("role"), t["text"].alias("text"))).cast(_TURNS)


def _renamed(layout: Layout, role: Column) -> Column:
    renamed = role
    for old, new in layout.roles.items():
        renamed = F.when(role == old, F.lit(new)).otherwise(renamed)
    return renamed


def _chosen(layouts, found: Column, pick) -> Column:
    """What ``pick`` makes of the layout whose shapes have the hash ``found``; null for none."""
    chosen = None
    for layout in layouts:
        known = found.isin([hashed(F.lit(s)) for s in layout.shapes()])
        chosen = F.when(known, pick(layout)) if chosen is None else chosen.when(known, pick(layout))
    return chosen


def layout_of(rows: DataFrame, *fields: str, layouts=LAYOUTS) -> Layout:
    """The declared layout whose fingerprint is that of the columns ``fields``; none fails."""
    kind = rows.select(*(F.col(f"`{f}`") for f in fields)).schema
    declared = [(layout, s) for layout in layouts for s in layout.shapes()]
    marks = [hashed(F.lit(s)).alias(f"_{i}") for i, s in enumerate([shape_of_type(kind), *(s for _, s in declared)])]
    own, *known = rows.sparkSession.sql("SELECT 1").select(*marks).first()
    found = next((layout for (layout, _), mark in zip(declared, known) if mark == own), None)
    if found is None:
        raise ValueError(f"no declared layout has the columns {shape_of_type(kind)}")
    return found


def table_turns(rows: DataFrame, key: str, *fields: str, layouts=LAYOUTS) -> DataFrame:
    """(key, turn, at, role, text, layout) of a table whose columns ``fields`` hold the turns.

    The fingerprint of the nested paths of these columns selects a declared layout of any kind (a
    turn in each row, an array of turns, one column per part); without one the call fails. Texts are
    taken as they are, of any length, not through JSON. Null roles and texts are empty; a null array
    has no turns, a null turn in it is empty.
    """
    layout = layout_of(rows, *fields, layouts=layouts)
    column = lambda name: F.col(f"`{name}`")
    named = rows.select(
        column(key).alias("key"),
        (column(layout.order).try_cast("bigint") if layout.order else F.lit(0).cast("bigint")).alias("turn"),
        F.lit(layout.name).alias("layout"),
        *([F.lit(0).alias("at"), _renamed(layout, column(layout.role).cast("string")).alias("role"),
           column(layout.text).cast("string").alias("text")] if layout.row else
          [F.posexplode(_turns(layout, lambda name, kind: (
              F.lit(None).cast(kind) if name not in fields else column(name) if layout.items else column(name).cast(kind)
          ))).alias("at", "_t")]),
    )
    role, text = (F.col("role"), F.col("text")) if layout.row else (F.col("_t.role"), F.col("_t.text"))
    return named.select("key", "turn", "at", F.coalesce(role, F.lit("")).alias("role"),
                        F.coalesce(text, F.lit("")).alias("text"), "layout")


def canonical_turns(records: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """(key, turn, at, role, text, layout) of (key, record) rows, one row per turn.

    ``turn`` is the number a row-per-turn record carries, else 0; ``at`` counts turns within the
    record. Null roles and texts are empty. Records of no known layout (broken JSON too) give no
    turns; ``unmapped`` lists them. A record may hold what a variant holds, 128 MiB; a larger one
    fails the query or counts as broken. ``table_turns`` has no such limit.
    """
    record = F.col("record")
    mapped = records.withColumn("_found", fingerprint(record)).select(
        "key",
        _chosen(layouts, F.col("_found"), lambda x: F.lit(x.name)).alias("layout"),
        _chosen(layouts, F.col("_found"), lambda x: _value(record, x.order, "bigint") if x.order else F.lit(0).cast("bigint")).alias("turn"),
        _chosen(layouts, F.col("_found"), lambda x: _turns(x, lambda name, kind: _value(record, name, kind))).alias("_turns"),
    )
    return mapped.select("key", "layout", "turn", F.posexplode("_turns").alias("at", "_t")).select(
        "key", "turn", "at", F.coalesce("_t.role", F.lit("")).alias("role"),
        F.coalesce("_t.text", F.lit("")).alias("text"), "layout",
    )


def unmapped(records: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """(key, record, shape) of the records whose fingerprint selects no layout."""
    known = _chosen(layouts, fingerprint(F.col("record")), lambda x: F.lit(True))
    return records.where(known.isNull()).withColumn("shape", shape(F.col("record")))


def escape(text: Column) -> Column:
    """A backslash goes behind the first character of each control string; ones there are kept."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({_REST})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_REST})", "$1$2$3")


def format_turns(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(key, formatted, loss_spans): one text per key and the trained spans, in code points.

    Turns are ordered by (turn, at), ties by role and text, so repeated rows stay and the result
    does not depend on the order of the input. Offsets are running sums in the window that shares
    the partitioning of the grouping: the turns move once.
    """
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    made = turns.select("key", "turn", "at", "role", "text", head.alias("_head"), escape(F.col("text")).alias("_text"))
    made = made.withColumn("_part", F.concat("_head", "_text", F.lit(END)))
    before = Window.partitionBy("key").orderBy("turn", "at", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = made.select(
        "key", F.row_number().over(Window.partitionBy("key").orderBy("turn", "at", "role", "text")).alias("_n"), "_part",
        (F.coalesce(F.sum(F.length("_part")).over(before), F.lit(0)) + F.length("_head")).alias("start"),
        F.length("_text").cast("bigint").alias("length"), F.col("role").isin(*trained).alias("_trained"),
    )
    grouped = placed.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("_n", "_part", "start", "length", "_trained"))).alias("_all")
    )
    spans = F.transform(F.filter("_all", lambda t: t["_trained"]), lambda t: F.struct(
        t["start"].alias("start"), t["length"].alias("length")))
    return grouped.select("key", F.array_join(F.transform("_all", lambda t: t["_part"]), "").alias("formatted"),
                          spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(key, turns, loss_text, formatted): turns and trained text recovered from the output alone."""
    pieces = F.split("formatted", re.escape(END), -1)
    turns = F.transform(
        F.filter(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: p.isNotNull()),
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(TURN) + 1)), BODY, 1)).alias("role"),
            unescape(F.substring_index(p, BODY, -1)).alias("text"),
        ),
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("key", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted")
