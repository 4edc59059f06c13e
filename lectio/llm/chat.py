"""Chat formatting by schema fingerprints, in DataFrame operations only.

Records are JSON objects of several layouts.  A record's fingerprint is the hash of the
nested field paths it has, among all paths that some layout names; it selects a layout from one
table of fingerprints, and the layout says declaratively where turns, roles and texts lie.  Records made from a
table's rows are structs: the paths of their schema are hashed, and no text passes through
JSON, whose parser takes texts up to 20,000,000 characters.  All layouts give the
same canonical turns ``array<struct<role, text>>``, which a template turns into one string:

    <|role|>text<|end|>

with ``\\`` written as ``\\b`` and ``<`` as ``\\l`` inside roles and texts (and ``|`` as
``\\p`` in roles).  No text can then hold a control string, and undoing ``\\l`` and then
``\\b`` gives the text back.  The
loss mask has, for each turn, the characters to skip from the turn's start and those to take.

Rules for odd rows: a null text or role is empty; a null or unparsable record and a record of
no known layout have layout null and no turns; records with no turn are formatted as ''.
A JSON record longer than that limit that does not parse is an error, as it may be valid.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

END = "<|end|>"
JSON_TEXT = 20_000_000                                    # characters of one text that the JSON parser takes
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``each``: path of an array with a role and a text field in each item, or
    ``fields``: (role, paths whose texts are joined by a blank line) for each turn."""
    name: str
    each: str | None = None
    role: str = "role"
    text: str = "text"
    order: str | None = None                              # a field of the items to sort by
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)   # other names of roles

    def paths(self) -> list[str]:
        if self.each:
            return [f"{self.each}[].{x}" for x in (self.role, self.text, self.order) if x]
        return [p for _, ps in self.fields for p in ps]


OTHER_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = [
    Layout("turn rows", each="turns", order="turn"),
    Layout("messages", each="messages", text="content", roles=OTHER_NAMES),
    Layout("conversations", each="conversations", role="from", text="value", roles=OTHER_NAMES),
    Layout("prompt and response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("system, prompt and response", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction with input", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question and answer", fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("nested question and answer", fields=(("user", ("data.question",)), ("assistant", ("data.answer",)))),
]


def _hash_of(paths: list[str]) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def fingerprint(record: Column, layouts=tuple(LAYOUTS)) -> Column:
    """Hash of the nested field paths (of those that a layout names) that a variant has."""
    known = sorted({p for x in layouts for p in x.paths()})
    has = [F.when(F.try_variant_get(record, "$." + p.replace("[]", "[0]"), "variant").isNotNull(), F.lit(p)) for p in known]
    return F.xxhash64(F.array_join(F.array_compact(F.array(*has)), "\n"))


def _schema_paths(kind: DataType, at: str = "") -> list[str]:
    """The nested field paths of a struct, written as the layouts write them."""
    if isinstance(kind, ArrayType):
        return _schema_paths(kind.elementType, at + "[]")
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in _schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return [at]


def _turns(record: Column, x: Layout, get=F.try_variant_get) -> Column:
    blank = F.lit("")
    if x.each:
        kind = "array<struct<" + ",".join([f"`{x.order}`:bigint"] * bool(x.order) + [f"`{x.role}`:string", f"`{x.text}`:string"]) + ">>"
        items = get(record, f"$.{x.each}", kind)

        def turn(i):
            role = F.coalesce(i[x.role], blank)
            for other, name in x.roles.items():
                role = F.when(i[x.role] == other, F.lit(name)).otherwise(role)
            return F.struct(role.alias("role"), F.coalesce(i[x.text], blank).alias("text"))
        if x.order:
            items = F.sort_array(F.transform(items, lambda i: F.struct(i[x.order], F.coalesce(i[x.role], blank).alias(x.role),
                                                                        F.coalesce(i[x.text], blank).alias(x.text))))
        return F.transform(items, turn).cast(TURNS)
    return F.array(*[F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *[get(record, f"$.{p}", "string") for p in ps]).alias("text"))
                     for role, ps in x.fields]).cast(TURNS)


def canonical(records: DataFrame, record_col: str = "record", layouts=tuple(LAYOUTS)) -> DataFrame:
    """Adds ``layout`` (its name, null if none) and ``turns``.  Records are JSON or structs."""
    kind = records.schema[record_col].dataType
    if isinstance(kind, StructType):
        known = {p for x in layouts for p in x.paths()}
        own = sorted(known.intersection(_schema_paths(kind)))
        record = F.col(record_col)
        df = records.withColumn("_fp", F.when(record.isNotNull(), _hash_of(own)))

        def turns_of(x: Layout) -> Column:
            def field_of(c: Column, path: str, as_type: str) -> Column:
                for name in path[2:].split("."):
                    c = c.getField(name)
                if as_type == "string":
                    return c.cast(as_type)
                named = [(x.order, "bigint")] * bool(x.order) + [(x.role, "string"), (x.text, "string")]
                return F.transform(c, lambda i: F.struct(*[i[n].cast(t).alias(n) for n, t in named]))
            return _turns(record, x, field_of)
        return _mapped(df, [x for x in layouts if set(x.paths()) <= set(own)], turns_of)
    parsed = F.try_parse_json(record_col)
    v = F.when(parsed.isNull() & (F.length(record_col) > JSON_TEXT), F.raise_error(
        F.lit(f"a record of over {JSON_TEXT} characters does not parse; it is broken or beyond the limits of the JSON parser")).cast("variant")).otherwise(parsed)
    df = records.withColumn("_v", v).withColumn("_fp", fingerprint(F.col("_v"), layouts))
    return _mapped(df, layouts, lambda x: _turns(F.col("_v"), x)).drop("_v")


def _mapped(df: DataFrame, layouts, turns_of) -> DataFrame:
    """``layout`` and ``turns`` of the layout whose paths have the row's fingerprint ``_fp``."""
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in reversed(layouts):
        here = F.col("_fp") == _hash_of(x.paths())
        name, turns = F.when(here, F.lit(x.name)).otherwise(name), F.when(here, turns_of(x)).otherwise(turns)
    return df.withColumn("layout", name).withColumn("turns", turns).drop("_fp")


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("|"), F.lit("\\p"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\p"), F.lit("|")))


def format_turns(df: DataFrame, turns_col: str = "turns") -> DataFrame:
    """Adds ``formatted`` and ``loss`` (per turn: characters to skip, characters to take)."""
    head = lambda t: F.concat(F.lit("<|"), escape_role(t["role"]), F.lit("|>"))
    text = F.array_join(F.transform(turns_col, lambda t: F.concat(head(t), escape(t["text"]), F.lit(END))), "")
    loss = F.transform(turns_col, lambda t: F.struct(
        F.length(head(t)).alias("skip"), F.when(t["role"] == "assistant", F.length(escape(t["text"]))).otherwise(0).alias("take")))
    return df.withColumn("formatted", text).withColumn("loss", loss)


def read_back(df: DataFrame) -> DataFrame:
    """Adds ``read``, the turns parsed from ``formatted``, and ``loss_text``, the text under the mask."""
    parts = F.filter(F.split("formatted", r"<\|end\|>"), lambda p: p != "")
    read = F.transform(parts, lambda p: F.struct(unescape_role(F.substring_index(F.substr(p, F.lit(3)), "|>", 1)).alias("role"),
                                                 unescape(F.substr(p, F.instr(p, "|>") + 2)).alias("text")))
    taken = F.transform(F.arrays_zip(parts.alias("part"), F.col("loss").alias("mask")),
                        lambda z: unescape(F.substr(z["part"], z["mask"]["skip"] + 1, z["mask"]["take"])))
    return df.withColumn("read", read).withColumn("loss_text", F.array_join(taken, ""))


def turn_records(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Rows by turn (``turn, role, text``) as one record, a struct, for each conversation."""
    item = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.groupBy(F.col(id_col).alias(id_col)).agg(F.struct(F.collect_list(item).alias("turns")).alias("record"))
