"""Chat formatting by schema fingerprints, with DataFrame operations only.

The nested field paths that a payload has are hashed; the hash selects a declarative mapping that turns its
layout of prompts, instructions or messages into canonical turns (role, text). Payloads are JSON texts, read as
variants, or nested columns, whose paths are those of the columns that are there in a row. A template then
marks the turns, and control strings inside roles and texts are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
# Each escape is a tilde and a digit; a plain tilde is escaped as well, so that every tilde has its digit.
ESCAPES = [("~", "~0"), ("<", "~1"), ("[", "~2"), (">", "~3"), ("]", "~4")]
TURNS = "array<struct<role:string,text:string>>"
SPAN = "struct<start:bigint,stop:bigint>"
BLOCK = 256
PARSED = 20_000_000  # a longer string may be refused by the JSON parser though it is JSON


def escape(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


@dataclass(frozen=True)
class Mapping:
    """What a layout is called, the field paths it has, and where its turns are.

    paths: nested field paths, [] for the elements of a list. either parts: for each turn its role and the
    paths of its text, joined by empty lines; or turn: the fields of role and text in the elements of the one
    list that paths has, with order, a field by which they are sorted, and renamed, other names of roles.
    """

    name: str
    paths: tuple[str, ...]
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    turn: tuple[str, str] = ("", "")
    order: str | None = None
    renamed: tuple[tuple[str, str], ...] = ()

    def turns(self, get: Callable[[str, str], Column]) -> Column:
        """Canonical turns; get(path, type) gives a part of the payload. Null roles and texts are empty."""
        text = lambda path: F.coalesce(get(path, "string"), F.lit(""))
        if self.parts:
            joined = lambda paths: text(paths[0]) if len(paths) == 1 else F.concat_ws("\n\n", *(F.when(text(p) != "", text(p)) for p in paths))
            return F.array(*(F.struct(F.lit(role).alias("role"), joined(paths).alias("text")) for role, paths in self.parts))
        role, said = self.turn
        kind = f"array<struct<{role}:string,{said}:string{f',{self.order}:bigint' if self.order else ''}>>"
        found = get(self.paths[0].partition("[]")[0], kind)
        plain = lambda m: [F.coalesce(m[role].cast("string"), F.lit("")).alias("role"), F.coalesce(m[said].cast("string"), F.lit("")).alias("text")]
        if self.order:
            sorted_turns = F.sort_array(F.transform(found, lambda m: F.struct(m[self.order].cast("long").alias("at"), *plain(m))))
            return F.transform(sorted_turns, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))

        def canonical(m: Column) -> Column:
            r, t = plain(m)
            for other, name in self.renamed:
                r = F.when(r == other, name).otherwise(r)
            return F.struct(r.alias("role"), t)

        return F.transform(found, canonical)


#: Layouts that are known from the start; callers may pass others.
MAPPINGS = (
    Mapping("rows", ("rows[].turn", "rows[].role", "rows[].text"), turn=("role", "text"), order="turn"),
    Mapping("messages", ("messages[].role", "messages[].content"), turn=("role", "content")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), turn=("from", "value"), renamed=(("human", "user"), ("gpt", "assistant"))),
    Mapping("prompt", ("prompt", "response"), (("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("completion", ("prompt", "completion"), (("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("instruction", ("instruction", "output"), (("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input", ("instruction", "input", "output"), (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("question", ("question", "answer"), (("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("system_prompt", ("system", "prompt", "response"), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
)


def shape_of(v: Column) -> Column:
    """Field paths of a variant, by its inferred schema with all leaf types dropped: STRUCT-like text such as messages[].role.

    Spark prints the schema of an object with its keys in order, so equal sets of paths print alike.
    """
    kinds = F.schema_of_variant(v)
    return F.regexp_replace(F.regexp_replace(kinds, r": (?!OBJECT|ARRAY)[A-Z]+(\([0-9,]*\))?", ""), "`", "")


def printed(paths: tuple[str, ...]) -> str:
    """What shape_of gives for a payload with these paths; lists of objects and plain fields only."""
    fields: dict[str, set[str]] = {}
    for p in paths:
        head, _, tail = p.partition("[].")
        fields.setdefault(head, set()).update({tail} if tail else set())
    inner = lambda names: "OBJECT<" + ", ".join(sorted(names)) + ">"
    return "OBJECT<" + ", ".join(f"{k}: ARRAY<{inner(v)}>" if v else k for k, v in sorted(fields.items())) + ">"


def selected(fingerprint: Column, prints: list[str], mappings: tuple[Mapping, ...], get: Callable[[str, str], Column]) -> tuple[Column, Column]:
    """The layout's name and the turns of the mapping that has the fingerprint."""
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for p, m in zip(prints, mappings, strict=True):
        layout = F.when(fingerprint == p, m.name).otherwise(layout)
        turns = F.when(fingerprint == p, F.coalesce(m.turns(get), F.array().cast(TURNS))).otherwise(turns)
    return layout, turns


def digest(shape: str) -> str:
    return hashlib.sha256(shape.encode()).hexdigest()


def untaken(df: DataFrame, *names: str) -> None:
    taken = {x.lower() for x in df.columns} & set(names)
    if taken:
        raise ValueError(f"columns are taken: {sorted(taken)}")


def canonical_turns(df: DataFrame, payload: str, *, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Add schema_fingerprint, layout, turns and error for a JSON text column.

    A payload that is null, no JSON or of a layout without a mapping has layout null and no turns;
    nothing is dropped. A null role or text in a turn is empty. A turn list that is empty has no paths
    of its own and so no layout. error says of a payload that isn't null why it has no fingerprint: it doesn't
    parse, which may be for the parser's limits where it has over PARSED characters. Repeated rows give a row each
    and an empty table none. Other columns stay; one that has the name of an added column is an error.
    """
    untaken(df, "schema_fingerprint", "layout", "turns", "error")
    v, shape = (f"{x}_{uuid.uuid4().hex}" for x in ("v", "shape"))
    out = df.withColumn(v, F.try_parse_json(F.col(payload))).withColumn(shape, shape_of(F.col(v)))
    out = out.withColumn("schema_fingerprint", F.sha2(F.col(shape), 256))
    layout, turns = selected(F.col("schema_fingerprint"), [digest(printed(m.paths)) for m in mappings], mappings, lambda path, kind: F.variant_get(v, f"$.{path}", kind))
    why = F.concat(F.lit("not parsed: "), F.when(F.length(payload) > PARSED, "too long or ").otherwise(""), F.lit("no JSON, characters: "), F.length(payload))
    refused = F.when(F.col(v).isNull() & F.col(payload).isNotNull(), why)
    return out.withColumn("layout", layout).withColumn("turns", turns).withColumn("error", refused).drop(v, shape)


def field_paths(kind: DataType, at: str) -> list[str]:
    """The nested field paths of a column, [] for the elements of a list."""
    if isinstance(kind, ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    if isinstance(kind, StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{at}.{f.name}")]
    return [at]


def canonical_columns(df: DataFrame, payload: list[str], *, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Add schema_fingerprint, layout and turns for payloads in nested columns of any size, which never go through JSON.

    A row's paths are those of the payload columns that are not null in it; their hash selects the mapping. A row of
    another layout, or with no payload, has layout null and no turns; nothing is dropped. A null role or text in a
    list is empty. Repeated rows give a row each, an empty table none. Other columns stay; one that has the name of
    an added column is an error.
    """
    untaken(df, "schema_fingerprint", "layout", "turns")
    here = {c: sorted(field_paths(df.schema[c].dataType, c)) for c in payload}
    # Columns in the order of their paths, so that equal sets of paths are one text.
    shape = F.concat_ws(",", *(F.when(F.col(f"`{c}`").isNotNull(), ",".join(paths)) for c, paths in sorted(here.items(), key=lambda x: x[1])))
    out = df.withColumn("schema_fingerprint", F.sha2(shape, 256))
    known = [m for m in mappings if {p.partition("[]")[0] for p in m.paths} <= set(payload) and set(m.paths) <= {p for x in here.values() for p in x}]
    layout, turns = selected(F.col("schema_fingerprint"), [digest(",".join(sorted(m.paths))) for m in known], tuple(known), lambda path, _: F.col(path))
    return out.withColumn("layout", layout).withColumn("turns", turns)


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c evaluated once, also where use has it within a lambda."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def scanned(items: Column, first: Column, advance: Callable[[Column, Column], Column], give: Callable[[Column, Column], Column], kind: str) -> Column:
    """give(state, item) of each item, as an array of kind; the state is first and then what advance makes of state and item.

    Spark copies an array when it grows, so arrays grow within blocks of BLOCK items and over blocks only.
    """
    none = F.slice(F.array(first), 1, 0)

    def blocks(all_items: Column) -> Column:
        n = F.ceil(F.size(all_items) / F.lit(BLOCK)).cast("int")
        return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda b: F.slice(all_items, b * BLOCK + 1, F.lit(BLOCK)))

    def over(cut: Column) -> Column:
        return F.aggregate(cut, F.struct(first.alias("now"), none.alias("all")), lambda s, block: F.struct(F.aggregate(block, s["now"], advance).alias("now"), F.concat(s["all"], F.array(s["now"])).alias("all")))["all"]

    def within(block: Column, start: Column) -> Column:
        grow = lambda s, x: F.struct(advance(s["now"], x).alias("now"), F.concat(s["all"], F.array(give(s["now"], x).cast(kind))).alias("all"))
        return F.aggregate(block, F.struct(start.alias("now"), F.array().cast(f"array<{kind}>").alias("all")), grow)["all"]

    return F.when(items.isNotNull(), once(items, lambda x: once(blocks(x), lambda cut: F.flatten(F.zip_with(cut, over(cut), within)))))


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Add formatted (one string) and loss_mask: the [start, stop) code points of assistant texts in it.

    An array of no turns is formatted as an empty string with no mask, null turns as null. Roles and texts
    must not be null; canonical_turns and gather_rows make null ones empty. An empty table gives no rows.
    """
    mark = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY), escape(t["text"]), F.lit(END))
    sizes = F.transform(turns, lambda t: F.struct((t["role"] == "assistant").alias("loss"), F.length(escape(t["text"])).cast("long").alias("n"), F.length(escape(t["role"])).cast("long").alias("r")))
    fixed = len(TURN) + len(BODY) + len(END)

    def span(at: Column, s: Column) -> Column:
        start = at + len(TURN) + s["r"] + len(BODY)
        return F.when(s["loss"], F.struct(start.alias("start"), (start + s["n"]).alias("stop")))

    spans = scanned(sizes, F.lit(0).cast("long"), lambda at, s: at + s["r"] + s["n"] + fixed, span, SPAN)
    return df.withColumn("formatted", F.array_join(F.transform(turns, mark), "")).withColumn("loss_mask", F.filter(spans, lambda s: s.isNotNull()))


def masked_texts(formatted: Column, mask: Column) -> Column:
    """The texts under a loss mask of formatted, unescaped: for each span one, in order. A span lies within a turn.

    Spans are cut from their turns, as Spark counts code points from a string's start.
    """
    parts = F.split(formatted, F.lit("<\\|end\\|>"))

    def texts(spans: Column) -> Column:
        here = lambda s, p: F.coalesce(F.get(spans, s["k"])["start"] < s["at"] + F.length(p) + len(END), F.lit(False))
        advance = lambda s, p: F.struct((s["at"] + F.length(p) + len(END)).alias("at"), (s["k"] + here(s, p).cast("int")).alias("k"))

        def cut(s: Column, p: Column) -> Column:
            span = F.get(spans, s["k"])
            return F.when(here(s, p), unescape(F.substring(p, (span["start"] - s["at"] + 1).cast("int"), (span["stop"] - span["start"]).cast("int"))))

        return scanned(parts, F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("k")), advance, cut, "string")

    return F.filter(once(mask, texts), lambda t: t.isNotNull())


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: the inverse of the template."""
    parts = F.split(formatted, F.lit("<\\|end\\|>"))
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(unescape(F.substring_index(F.substring(p, len(TURN) + 1, 1 << 30), BODY, 1)).alias("role"), unescape(F.substring_index(p, BODY, -1)).alias("text")))


def gather_rows(rows: DataFrame) -> DataFrame:
    """conv_id and rows, the list of turns (turn, role, text) of each conversation in a table of turns, in no order.

    Repeated rows are turns of their own. A conversation is one output row, so it is gathered in one place
    whatever its size.
    """
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.groupBy("conv_id").agg(F.collect_list(one).alias("rows"))


PAYLOAD = ["rows", "messages", "conversations", "prompt", "response"]


def in_layouts(gathered: DataFrame) -> DataFrame:
    """conv_id and the columns of PAYLOAD, each conversation in the first layout that can say all of it.

    A question and its answer are a prompt and a response. Others are dealt by their id: lists of messages, lists
    with other names for roles where none of those names is used, and plain rows. Null ids stay rows.
    """
    turns = F.sort_array(F.transform("rows", lambda m: F.struct(m["turn"].alias("turn"), F.coalesce(m["role"], F.lit("")).alias("role"), F.coalesce(m["text"], F.lit("")).alias("text"))))
    dealt = F.pmod(F.col("conv_id").cast("long"), F.lit(3))
    names = {"user": "human", "assistant": "gpt"}
    plain = ~F.exists("turns", lambda t: t["role"].isin(list(names.values())))
    two = F.transform("turns", lambda t: t["role"]) == F.array(F.lit("user"), F.lit("assistant"))
    pick = F.when(two, "prompt").when(dealt == 0, "messages").when((dealt == 1) & plain, "conversations").otherwise("rows")

    def said(t: Column) -> Column:
        role = t["role"]
        for name, other in names.items():
            role = F.when(t["role"] == name, other).otherwise(role)
        return F.struct(role.alias("from"), t["text"].alias("value"))

    out = gathered.withColumn("turns", turns).withColumn("pick", pick)
    return out.select(
        "conv_id",
        F.when(F.col("pick") == "rows", F.col("rows")).alias("rows"),
        F.when(F.col("pick") == "messages", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))).alias("messages"),
        F.when(F.col("pick") == "conversations", F.transform("turns", said)).alias("conversations"),
        *(F.when(F.col("pick") == "prompt", F.get("turns", F.lit(k))["text"]).alias(name) for k, name in enumerate(("prompt", "response"))),
    )


def probe_rows(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are control strings of common templates."""
    return spark.sql("select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, schema_fingerprint and layout.

    Conversations come in several layouts in one table; what their fingerprints select is formatted, and all
    figures are read back from the formatted string, those of the loss by its mask. A conversation of no rows doesn't exist; null ids are one.
    """
    made = format_turns(canonical_columns(in_layouts(gather_rows(rows)), PAYLOAD)).withColumn("back", read_turns(F.col("formatted")))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(masked_texts(F.col("formatted"), F.col("loss_mask")), "")
    return made.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "schema_fingerprint", "layout")
