"""Raw JSON answers of a model, read leniently and judged as expressions over variants.

The same table of fields and kinds as in plans/checks.py, which reads single answers; here whole columns of JSON
texts are parsed, coerced and judged inside Spark. A kind takes a variant and gives a typed value and whether it
is one; other fields of an answer are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions import vocabulary as V
from loomlake.functions.scalars import lookup, stripped
from loomlake.functions.trace import box_area, truth, unique_ids, unknown_ends

Kind = Callable[[Column], tuple[Column, Column]]
YES, NO = ["1", "on", "t", "true", "y", "yes"], ["0", "off", "f", "false", "n", "no"]
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"
FULL_FRAME = 0.98


def kind_of(x: Column) -> Column:
    """STRING, BOOLEAN, BIGINT, DOUBLE, DECIMAL, ARRAY, OBJECT or VOID; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0)


def as_type(x: Column, kind: str) -> Column:
    return F.try_variant_get(x, "$", kind)


def any_text(x: Column) -> tuple[Column, Column]:
    return as_type(x, "string"), truth(kind_of(x) == "STRING")


def text(x: Column) -> tuple[Column, Column]:
    value, fine = any_text(x)
    return value, truth(fine & (F.length(value) >= 1))


def number(x: Column) -> tuple[Column, Column]:
    said = as_type(x, "string")
    spelt = F.when(F.rlike(F.lower(said), F.lit(NUMBER)), stripped(said).try_cast("double"))
    value = F.when(kind_of(x) == "STRING", spelt).when(kind_of(x) == "BOOLEAN", as_type(x, "boolean").cast("double")).when(kind_of(x).isin("BIGINT", "DOUBLE", "DECIMAL"), as_type(x, "double"))
    return value, value.isNotNull()


def whole(x: Column) -> tuple[Column, Column]:
    value, fine = number(x)
    return value.try_cast("bigint"), truth(fine & (value == F.floor(value)) & (F.abs(value) < 1e18))


def share(x: Column) -> tuple[Column, Column]:
    value, _ = number(x)
    return value, truth(value.between(0.0, 1.0))


def flag(x: Column) -> tuple[Column, Column]:
    count = as_type(x, "double")
    said = F.when(kind_of(x) == "BOOLEAN", as_type(x, "boolean").cast("int").cast("string")).when(kind_of(x) == "STRING", F.lower(stripped(as_type(x, "string"))))
    said = said.when(kind_of(x).isin("BIGINT", "DOUBLE", "DECIMAL") & (count == F.floor(count)), count.try_cast("bigint").cast("string"))
    return said.isin(YES), truth(said.isin(YES + NO))


def word(allowed: list[str], synonyms: dict[str, str] | None = None) -> Kind:
    def kind(x: Column) -> tuple[Column, Column]:
        value, fine = any_text(x)
        if synonyms is not None:
            low = F.lower(stripped(value))
            value = F.coalesce(lookup(synonyms, low), low) if synonyms else low
        return value, truth(fine & value.isin(allowed))

    return kind


def colour(x: Column) -> tuple[Column, Column]:
    value, fine = any_text(x)
    return value, truth(fine & F.rlike(value, F.lit(r"\A#[0-9a-fA-F]{6}\z")))


def several(item: Kind, least: int = 1, exactly: int | None = None) -> Kind:
    def kind(x: Column) -> tuple[Column, Column]:
        items = as_type(x, "array<variant>")
        n = F.size(items)
        sized = n == exactly if exactly is not None else n >= least
        return F.transform(items, lambda i: item(i)[0]), truth((kind_of(x) == "ARRAY") & sized & F.forall(items, lambda i: item(i)[1]))

    return kind


def surfaces(x: Column) -> tuple[Column, Column]:
    entries = F.map_entries(as_type(x, "map<string,variant>"))
    value = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], as_type(e["value"], "string"))))
    said = F.forall(entries, lambda e: any_text(e["value"])[1] & (stripped(e["key"]) != "") & (stripped(as_type(e["value"], "string")) != ""))
    return value, truth((kind_of(x) == "OBJECT") & (F.size(entries) >= 1) & said)


#: Of each field its kind and, where it may be missing, its default; the rule gives names of what else is wrong.
Spec = dict[str, tuple]
Rule = Callable[[dict[str, Column]], list[tuple[str, Column]]]


def read_fields(x: Column, spec: Spec, rule: Rule) -> tuple[dict[str, Column], list[tuple[str, Column]]]:
    """The fields of an object, and by name of the error whether it is broken, in the order in which they are judged."""
    values, broken = {}, []
    for name, (kind, *default) in spec.items():
        one = F.try_variant_get(x, f"$.{name}", "variant")
        value, fine = kind(one)
        if default:
            given = F.array(*(F.lit(x) for x in default[0])).cast("array<bigint>") if isinstance(default[0], list) else F.lit(default[0]).cast("bigint")
            value, fine = F.when(one.isNull(), given).otherwise(value), one.isNull() | fine
        else:
            broken.append((f"{name} is missing", one.isNull()))
        broken.append((f"{name} is wrong", one.isNotNull() & ~fine))
        values[name] = value
    return values, broken + rule(values)


def fields(spec: Spec, rule: Rule = lambda _: []) -> Kind:
    def kind(x: Column) -> tuple[Column, Column]:
        values, broken = read_fields(x, spec, rule)
        wrong = reduce(lambda a, b: a | b, (truth(c) for _, c in broken))
        return F.struct(*(v.alias(n) for n, v in values.items())), truth(kind_of(x) == "OBJECT") & ~wrong

    return kind


def entity_rule(e: dict[str, Column]) -> list[tuple[str, Column]]:
    b = [F.get(e["bbox"], F.lit(i)) for i in range(4)]
    return [("box", (b[2] <= b[0]) | (b[3] <= b[1])), ("frame", (box_area(e["bbox"]) >= FULL_FRAME) & (e["kind"] != "background"))]


def layout_rule(found: dict[str, Column]) -> list[tuple[str, Column]]:
    ids = F.transform(found["entities"], lambda e: e["id"])
    ends = F.concat(F.transform(found["relations"], lambda r: r["subject"]), F.transform(found["relations"], lambda r: r["object"]))
    return [("entity ids repeat", ~unique_ids(ids)), ("no such entities", F.size(unknown_ends(ends, ids)) > 0)]


ENTITY = fields({"id": (text,), "kind": (word(V.ENTITY_KINDS),), "bbox": (several(share, exactly=4),), "z": (whole, 0)}, entity_rule)
RELATION = fields({"subject": (text,), "predicate": (word(V.PREDICATES, V.PREDICATE_SYNONYMS),), "object": (text,)})
STAGES: dict[str, tuple[Spec, Rule]] = {
    "semantic_plan": ({"subject": (text,), "environment": (text,), "camera": (text,), "mood": (text,), "dominant_elements": (several(any_text),)}, lambda _: []),
    "layout": ({"canvas": (several(whole, exactly=2), [1024, 1024]), "entities": (several(ENTITY),), "relations": (several(RELATION),)}, layout_rule),
    "composition": ({"lens": (text,), "rule_of_thirds": (flag,), "subject_scale": (share,), "leading_lines": (flag,), "symmetry": (flag,)}, lambda _: []),
    "lighting": ({"key_light": (text,), "fill_light": (word(V.LEVELS),), "rim_light": (flag,), "contrast": (word(V.LEVELS),)}, lambda _: []),
    "materials": ({"materials": (surfaces,)}, lambda _: []),
    "color_script": ({"primary_palette": (several(colour),), "temperature": (word(V.TEMPERATURES, V.TEMPERATURE_SYNONYMS),), "saturation": (word(V.LEVELS, V.SATURATION_SYNONYMS),)}, lambda _: []),
}


def read_answers(df: DataFrame, answer: str, stage: str) -> DataFrame:
    """Add read (a struct of the stage's fields, null unless all is well) and errors, a list, for a column of JSON texts.

    Numbers and flags may be texts, whole numbers may have a point, and words of the vocabulary any case and their
    synonyms. A text that is null or no JSON has the error 'no JSON', another kind of value 'no object'. Repeated rows
    give a row each and an empty table none. Other columns stay; columns named read or errors are an error.
    """
    if {"read", "errors"} & {c.lower() for c in df.columns}:
        raise ValueError("columns read and errors are taken")
    spec, rule = STAGES[stage]
    v = F.try_parse_json(F.col(answer))
    values, broken = read_fields(v, spec, rule)
    found = F.array_compact(F.array(*(F.when(truth(c), F.lit(name)) for name, c in broken)))
    errors = F.when(v.isNull(), F.array(F.lit("no JSON"))).when(kind_of(v) != "OBJECT", F.array(F.lit("no object"))).otherwise(found)
    return df.withColumn("errors", errors).withColumn("read", F.when(F.size("errors") == 0, F.struct(*(x.alias(n) for n, x in values.items()))))
