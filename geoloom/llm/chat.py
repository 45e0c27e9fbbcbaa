"""Chat formatting by schema fingerprints, in DataFrame functions only.

A layout is a declarative mapping from field paths to canonical turns (key, turn, role, text). Of the nested field
paths of a table (or of each JSON record), those that a layout names are sorted and hashed; where that hash is the
layout's own, its mapping applies, and the mapping with most paths wins. Extra fields, also with names that another
layout uses, do not disturb. Turns are then rendered with marks, control strings inside texts being escaped
reversibly, together with the spans that count for the loss.

Defined cases: a null text, role or key renders as empty text, empty role, or the one conversation whose key is null;
turns with equal numbers are ordered by role, then text, and repeated rows are repeated turns; null turn numbers come
first. A conversation without turns gives no row, and empty tables give no rows. Columns that no layout names are
ignored, whatever they are called. All turns of one conversation become one string, which Spark bounds at 2 GB; only
its rendered turns are gathered, ordered by a window over the same partitioning, so turns shuffle once.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

START, END = "<|im_start|>", "<|im_end|>\n"
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """One way to keep a conversation. ``paths`` identify it; exactly one of the mappings below is set.

    ``rows``: one row per turn, as (key, turn, role, text) columns. ``messages``: (array, role field, text field).
    ``fields``: (role, fields) in order of turns; texts of several fields are joined by a blank line, and a turn whose
    fields are all null or absent is left out.
    """

    name: str
    paths: tuple[str, ...]
    rows: tuple[str, str, str, str] | None = None
    messages: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())


LAYOUTS = [
    Layout("turn rows", ("conv_id", "role", "text", "turn"), rows=("conv_id", "turn", "role", "text")),
    Layout("messages", ("messages[].content", "messages[].role"), messages=("messages", "role", "content")),
    Layout("from and value", ("conversations[].from", "conversations[].value"),
           messages=("conversations", "from", "value")),
    Layout("prompt", ("completion", "prompt"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", ("prompt", "response"),
           fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("instruction", "output"),
           fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction with input", ("input", "instruction", "output"),
           fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction with system", ("input", "instruction", "output", "system"),
           fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question", ("answer", "question"), fields=(("user", ("question",)), ("assistant", ("answer",)))),
]


def _digest(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _by_size(layouts: list[Layout]) -> list[Layout]:
    """Most paths first."""
    return sorted(layouts, key=lambda x: -len(x.paths))


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Paths of all leaves, array elements marked ``[]``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(schema: T.StructType, layout: Layout) -> str:
    """Hash of those field paths of a schema that the layout names."""
    return _digest(set(field_paths(schema)) & set(layout.paths))


def _turn_array(layout: Layout, get) -> Column:
    """The turns of one record; ``get(path, type)`` reads a field."""
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    if layout.messages:
        array, role, text = layout.messages
        return F.transform(
            get(array, f"array<struct<`{role}`:string,`{text}`:string>>"),
            lambda m, i: F.struct(i.cast("long").alias("turn"), F.coalesce(names[m[role]], m[role]).alias("role"),
                                  m[text].alias("text")))
    turns = []
    for i, (role, fields) in enumerate(layout.fields):
        parts = [get(f, "string") for f in fields]
        text = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n\n")
        turns.append(F.when(F.coalesce(*parts).isNotNull(), F.struct(
            F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text"))))
    return F.filter(F.array(*turns), lambda t: t.isNotNull())


def to_turns(df: DataFrame, key: str | None = None, layouts: list[Layout] | None = None) -> DataFrame:
    """Canonical turns (key, turn, role, text) of a table in any known layout. ``key`` names the record's column where
    the layout itself has none. A table in no known layout raises an error that lists its paths."""
    layout = next((x for x in _by_size(layouts or LAYOUTS) if fingerprint(df.schema, x) == _digest(x.paths)), None)
    if layout is None:
        raise ValueError(f"No layout for the fields {field_paths(df.schema)}.")
    if layout.rows:
        return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(layout.rows, ("key", "turn", "role", "text"))])
    if key is None:
        raise ValueError("Name the column that identifies a record.")
    turns = _turn_array(layout, lambda path, kind: F.col(path) if kind != "string" else F.col(path).cast("string"))
    return df.select(F.col(f"`{key}`").alias("key"), F.inline(turns))


def record_turns(df: DataFrame, key: str, json: str, layouts: list[Layout] | None = None) -> DataFrame:
    """Canonical turns of JSON records that may each have another layout: every record gets its own fingerprint from
    the known paths it holds. Adds ``layout``; a record of no known layout, or broken JSON, gives one row whose layout,
    turn, role and text are null, so nothing is lost unseen."""
    layouts = _by_size([x for x in layouts or LAYOUTS if not x.rows])
    record = df.select(F.col(f"`{key}`").alias("key"), F.try_parse_json(F.col(f"`{json}`")).alias("v"))

    def print_of(layout: Layout) -> Column:
        held = [F.when(F.try_variant_get("v", "$." + p.replace("[]", "[0]"), "variant").isNotNull(), F.lit(p))
                for p in sorted(layout.paths)]
        return F.sha2(F.array_join(F.array(*held), "\n"), 256)  # joining leaves out nulls

    names, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<turn:bigint,role:string,text:string>>")
    for layout in reversed(layouts):
        hit = print_of(layout) == _digest(layout.paths)
        get = lambda path, kind: F.try_variant_get("v", f"$.{path}", kind)
        names = F.when(hit, F.lit(layout.name)).otherwise(names)
        turns = F.when(hit, _turn_array(layout, get)).otherwise(turns)
    return record.select("key", names.alias("layout"), F.inline_outer(turns))


def escape(text: Column) -> Column:
    r"""``<|`` becomes ``<\|`` and ``<\|`` becomes ``<\\|``, so no escaped text holds the start of a mark."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    """A role also ends at the first line break, so its own are written as ``%0A``."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chat(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: key, n_turns, formatted, and loss_spans in code points of ``formatted``.

    A span has its turn (from 1), where that turn's block starts (after its mark), where the span starts, and its
    length, so it can be cut out of the whole string or out of its block alone.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    pieces = turns.select(
        "key", "turn", role.alias("role"), text.alias("text"), escape_role(role).alias("shown_role"),
        escape(text).alias("shown"))
    pieces = pieces.select(
        "key", "turn", "role", "text", F.length("shown_role").alias("role_chars"), F.length("shown").alias("chars"),
        F.concat(F.lit(START), "shown_role", F.lit("\n"), "shown", F.lit(END)).alias("piece"))
    order = Window.partitionBy("key").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    block = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + len(START)
    placed = pieces.select("key", F.row_number().over(order).alias("n"), "piece", F.when(
        F.col("role").isin(*loss_roles), F.struct(
            F.row_number().over(order).alias("turn"), block.alias("block"),
            (block + F.col("role_chars") + 1).alias("start"), F.col("chars").cast("long").alias("chars"))).alias("span"))
    whole = placed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "piece", "span"))).alias("turns"))
    return whole.select(
        "key", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """What ``format_chat`` wrote, read back: key, turns (role and text), the texts under the loss mask, and the
    string's length."""
    blocks = F.split("formatted", r"<\|im_start\|>")
    cut = formatted.select("key", "loss_spans", F.length("formatted").cast("long").alias("formatted_chars"),
                           blocks.alias("blocks"))

    def turn(block: Column) -> Column:
        line = F.locate("\n", block)
        body = F.substr(block, line + 1, F.length(block) - line - len(END))
        return F.struct(unescape_role(F.substring_index(block, "\n", 1)).alias("role"), unescape(body).alias("text"))

    return cut.select(
        "key", F.transform(F.slice("blocks", 2, F.size("blocks")), turn).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substr(
            F.element_at(F.col("blocks"), s["turn"] + 1), (s["start"] - s["block"] + 1).cast("int"),
            s["chars"].cast("int")))).alias("loss_texts"),
        "formatted_chars")
