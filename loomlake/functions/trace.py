"""The nested record of a decision trace: schema, normalisation, validation and the texts made from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions import vocabulary as V
from loomlake.functions.scalars import box_cell, lens_label, lookup, short_number, slug, stripped

TELEMETRY = "struct<compute_s:double,rate_usd_per_s:double,projected_cost_usd:double,projected_gpu:string,input_tokens:bigint,output_tokens:bigint,tokens_per_s:double,retries:int,last_error:string>"
PER_IMAGE = "struct<idx:int,clip_score:double,aesthetic:double,image_reward:double,faithfulness:double,detection_coverage:double,nsfw:double,phash:bigint>"
STAGE_TYPES = {
    "semantic_plan": "struct<subject:string,environment:string,camera:string,mood:string,dominant_elements:array<string>>",
    "layout": "struct<canvas:array<int>,entities:array<struct<id:string,kind:string,bbox:array<double>,z:int>>,relations:array<struct<subject:string,predicate:string,object:string>>>",
    "composition": "struct<lens:string,rule_of_thirds:boolean,subject_scale:double,leading_lines:boolean,symmetry:boolean>",
    "lighting": "struct<key_light:string,fill_light:string,rim_light:boolean,contrast:string>",
    "materials": "struct<materials:map<string,string>>",
    "color_script": "struct<primary_palette:array<string>,temperature:string,saturation:string>",
}
SCHEMA = (
    "id string, prompt string, "
    + ", ".join(f"{k} {v}" for k, v in STAGE_TYPES.items())
    + ", visual_tokens array<string>, enriched_prompt string, final_image string, final_images array<string>"
    + ", images array<struct<path:string,sha256:string,idx:int,width:int,height:int,seed:bigint>>"
    + f", render {TELEMETRY}, telemetry map<string,{TELEMETRY}>"
    + ", dataset struct<license:string,code_version:string,stratum:string,split:string"
    + ",safety:struct<nsfw:double,nsfw_label:string,release_blocked:boolean,needs_review:boolean,checks_applied:array<string>,checks_pending:array<string>,is_duplicate:boolean>"
    + f",quality:struct<clip_score:double,aesthetic:double,image_reward:double,faithfulness:double,detection_coverage:double,per_image:array<{PER_IMAGE}>,passed_gate:boolean,gate_reasons:array<string>>>"
    + ", meta struct<planner:string,base_url:string,projected_gpu:string,created_at:string,model_load_s:double,execution:string,seed:bigint,n_variations:int>"
)


def synonym(c: Column, table: dict[str, str]) -> Column:
    key = F.lower(stripped(c))
    return F.coalesce(lookup(table, key), key)


def normal_predicate(c: Column) -> Column:
    return synonym(c, V.PREDICATE_SYNONYMS)


def normal_temperature(c: Column) -> Column:
    return synonym(c, V.TEMPERATURE_SYNONYMS)


def normal_saturation(c: Column) -> Column:
    return synonym(c, V.SATURATION_SYNONYMS)


def normalised(df: DataFrame) -> DataFrame:
    """Predicates, temperature and saturation in the controlled vocabulary."""
    relations = F.transform("layout.relations", lambda r: r.withField("predicate", normal_predicate(r["predicate"])))
    return df.withColumn("layout", F.col("layout").withField("relations", relations)).withColumn(
        "color_script", F.col("color_script").withField("temperature", normal_temperature(F.col("color_script.temperature"))).withField("saturation", normal_saturation(F.col("color_script.saturation")))
    )


def box_valid(box: Column) -> Column:
    """Four coordinates in [0, 1] and a positive extent both ways."""
    inside = (F.size(box) == 4) & F.forall(box, lambda c: F.coalesce(c.between(0.0, 1.0), F.lit(False)))
    return F.coalesce(inside & (F.get(box, F.lit(2)) > F.get(box, F.lit(0))) & (F.get(box, F.lit(3)) > F.get(box, F.lit(1))), F.lit(False))


def box_area(box: Column) -> Column:
    return (F.get(box, F.lit(2)) - F.get(box, F.lit(0))) * (F.get(box, F.lit(3)) - F.get(box, F.lit(1)))


def unique_ids(ids: Column) -> Column:
    return F.size(F.array_distinct(ids)) == F.size(ids)


def unknown_ends(ends: Column, ids: Column) -> Column:
    """Relation ends that are neither entities nor implicit anchors."""
    return F.array_except(ends, F.array_union(ids, F.array(*[F.lit(a) for a in V.IMPLICIT_ANCHORS])))


def hex_colour(c: Column) -> Column:
    return F.rlike(c, F.lit("^#[0-9a-fA-F]{6}$"))


def text_ok(c: Column) -> Column:
    return F.coalesce(F.length(c) >= 1, F.lit(False))


def one_of(c: Column, allowed: list[str]) -> Column:
    return F.coalesce(c.isin(allowed), F.lit(False))


def truth(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def rules() -> dict[str, Column]:
    """What a valid record fulfils, by the name of the error that breaking it gives."""
    entities, relations = F.col("layout.entities"), F.col("layout.relations")
    plan, comp, light, colour = (F.col(s) for s in ("semantic_plan", "composition", "lighting", "color_script"))
    ids = F.transform(entities, lambda e: e["id"])
    ends = F.concat(F.transform(relations, lambda r: r["subject"]), F.transform(relations, lambda r: r["object"]))
    materials = F.map_entries("materials.materials")
    return {
        "id": text_ok(F.col("id")),
        "prompt": text_ok(F.col("prompt")),
        "plan_fields": reduce(lambda a, b: a & b, (text_ok(plan[f]) for f in ("subject", "environment", "camera", "mood"))),
        "plan_elements": truth(F.size(plan["dominant_elements"]) >= 1),
        "layout_canvas": F.coalesce(F.size("layout.canvas") == 2, F.lit(True)),
        "layout_entities": truth(F.size(entities) >= 1),
        "layout_relations": truth(F.size(relations) >= 1),
        "entity_kind": truth(F.forall(entities, lambda e: one_of(e["kind"], V.ENTITY_KINDS) & text_ok(e["id"]))),
        "entity_box": truth(F.forall(entities, lambda e: box_valid(e["bbox"]))),
        "entity_full_frame": truth(F.forall(entities, lambda e: (e["kind"] == "background") | ~box_valid(e["bbox"]) | (box_area(e["bbox"]) < 0.98))),
        "entity_ids": truth(unique_ids(ids)),
        "relation_predicate": truth(F.forall(relations, lambda r: one_of(normal_predicate(r["predicate"]), V.PREDICATES))),
        "relation_ends": truth(F.size(unknown_ends(ends, ids)) == 0),
        "composition": text_ok(comp["lens"]) & truth(comp["subject_scale"].between(0.0, 1.0)) & comp["rule_of_thirds"].isNotNull() & comp["leading_lines"].isNotNull() & comp["symmetry"].isNotNull(),
        "lighting": text_ok(light["key_light"]) & one_of(light["fill_light"], V.LEVELS) & one_of(light["contrast"], V.LEVELS) & light["rim_light"].isNotNull(),
        "materials": truth(F.size(materials) >= 1) & truth(F.forall(materials, lambda e: (stripped(e["key"]) != "") & (stripped(e["value"]) != ""))),
        "palette": truth(F.size(colour["primary_palette"]) >= 1) & truth(F.forall(colour["primary_palette"], hex_colour)),
        "temperature": one_of(normal_temperature(colour["temperature"]), V.TEMPERATURES),
        "saturation": one_of(normal_saturation(colour["saturation"]), V.LEVELS),
        "images": F.coalesce(F.forall("images", lambda i: truth(i["idx"] >= 0) & truth(i["width"] > 0) & truth(i["height"] > 0)), F.lit(True)),
        "split": F.col("dataset.split").isNull() | one_of(F.col("dataset.split"), V.SPLITS),
        "telemetry_stages": F.coalesce(F.size(F.array_except(F.map_keys("telemetry"), F.array(*[F.lit(s) for s in V.STAGES]))) == 0, F.lit(True)),
    }


def validate(df: DataFrame) -> DataFrame:
    """Add errors, the names of the rules that a record breaks, in the order of rules(); empty if it is valid."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules().items()])))


def when_true(c: Column, text: str) -> Column:
    return F.when(c, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))


def visual_tokens() -> Column:
    """The record as a token sequence, stage by stage."""
    # The tags of the tokens.
    plan, comp, light, colour = (F.col(s) for s in ("semantic_plan", "composition", "lighting", "color_script"))
    tag = lambda name, c: F.concat(F.lit(f"{name}:"), slug(c))
    return F.concat(
        F.array(tag("PLAN_SUBJ", plan["subject"]), tag("ENV", plan["environment"]), tag("CAM", plan["camera"]), tag("MOOD", plan["mood"])),
        F.transform(plan["dominant_elements"], lambda e: tag("ELEM", e)),
        F.transform("layout.entities", lambda e: F.concat_ws(":", F.lit("AT"), slug(e["id"]), e["kind"], box_cell(e["bbox"]))),
        F.transform("layout.relations", lambda r: F.concat_ws(":", F.lit("REL"), slug(r["subject"]), r["predicate"], slug(r["object"]))),
        F.array(lens_label(comp["lens"])),
        when_true(comp["rule_of_thirds"], "THIRDS"),
        F.array(F.concat(F.lit("SCALE:"), short_number(comp["subject_scale"]))),
        when_true(comp["leading_lines"], "LEADING"),
        when_true(comp["symmetry"], "SYMMETRY"),
        F.array(tag("LIGHT_KEY", light["key_light"]), F.concat(F.lit("FILL_"), F.upper(light["fill_light"]))),
        when_true(light["rim_light"], "RIM"),
        F.array(F.concat(F.lit("CONTRAST_"), F.upper(light["contrast"]))),
        F.transform(F.map_entries("materials.materials"), lambda m: F.concat_ws(":", F.lit("MAT"), slug(m["key"]), slug(m["value"]))),
        F.array(F.concat(F.lit("COLOR_"), F.upper(colour["temperature"])), F.concat(F.lit("SAT_"), F.upper(colour["saturation"]))),
        F.transform(colour["primary_palette"], lambda c: F.concat(F.lit("PAL:"), F.lower(c))),
        F.array(F.lit("RENDER")),
    )


def relation_phrase(r: Column) -> Column:
    words = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    return F.concat_ws(" ", words(r["subject"]), F.coalesce(lookup(V.PREDICATE_PHRASES, r["predicate"]), r["predicate"]), words(r["object"]))


def render_prompt() -> Column:
    """The record as a prompt for a renderer: sentences joined by '. ', those without content left out."""
    # The words around what the record says.
    plan, comp, light, colour = (F.col(s) for s in ("semantic_plan", "composition", "lighting", "color_script"))
    some = lambda items, text: F.when(F.size(items) > 0, text)
    traits = F.concat(
        F.array(F.concat(comp["lens"], F.lit(" lens")), F.concat(F.lit("subject scale "), short_number(comp["subject_scale"]))),
        when_true(comp["rule_of_thirds"], "rule of thirds"), when_true(comp["leading_lines"], "leading lines"), when_true(comp["symmetry"], "symmetrical composition"),
    )
    lights = F.concat(F.array(F.concat(light["key_light"], F.lit(" key light")), F.concat(light["fill_light"], F.lit(" fill"))), when_true(light["rim_light"], "rim light"), F.array(F.concat(light["contrast"], F.lit(" contrast"))))
    materials = F.map_entries("materials.materials")
    parts = [
        F.concat(plan["subject"], F.lit(" in "), plan["environment"]),
        F.concat(plan["camera"], F.lit(" shot")),
        F.concat(plan["mood"], F.lit(" mood")),
        F.concat(F.lit("composition: "), F.array_join(traits, ", ")),
        F.concat(F.lit("lighting: "), F.array_join(lights, ", ")),
        some(materials, F.concat(F.lit("materials: "), F.array_join(F.transform(materials, lambda m: F.concat_ws(" ", m["key"], m["value"])), ", "))),
        F.concat(F.lit("color script: "), colour["temperature"], F.lit(" palette ("), F.array_join(colour["primary_palette"], ", "), F.lit("), "), colour["saturation"], F.lit(" saturation")),
        some(F.col("layout.relations"), F.concat(F.lit("spatial relations: "), F.array_join(F.transform("layout.relations", relation_phrase), "; "))),
        some(plan["dominant_elements"], F.concat(F.lit("featuring "), F.array_join(plan["dominant_elements"], ", "))),
        F.lit("highly detailed, cinematic"),
    ]
    return F.array_join(F.array_compact(F.array(*parts)), ". ")


def compact_prior(stage: str) -> Column:
    """A stage's decisions in one line, without boxes; as JSON where one is missing."""
    # The names before the decisions.
    c = F.col(stage)
    joined = lambda items: F.array_join(F.coalesce(items, F.array().cast("array<string>")), ", ")
    yes = lambda b: F.when(b, "True").otherwise("False")
    lines = {
        "semantic_plan": lambda: F.concat(F.lit("subject="), c["subject"], F.lit("; environment="), c["environment"], F.lit("; camera="), c["camera"], F.lit("; mood="), c["mood"], F.lit("; elements="), joined(c["dominant_elements"])),
        "layout": lambda: F.concat(F.lit("entities=["), joined(F.transform(c["entities"], lambda e: F.concat(e["id"], F.lit("("), e["kind"], F.lit(")")))), F.lit("]; relations=["), joined(F.transform(c["relations"], lambda r: F.concat_ws(" ", r["subject"], r["predicate"], r["object"]))), F.lit("]")),
        "composition": lambda: F.concat(F.lit("lens="), c["lens"], F.lit("; subject_scale="), c["subject_scale"].cast("string"), F.lit("; rule_of_thirds="), yes(c["rule_of_thirds"]), F.lit("; leading_lines="), yes(c["leading_lines"]), F.lit("; symmetry="), yes(c["symmetry"])),
        "lighting": lambda: F.concat(F.lit("key_light="), c["key_light"], F.lit("; fill="), c["fill_light"], F.lit("; rim="), yes(c["rim_light"]), F.lit("; contrast="), c["contrast"]),
        "materials": lambda: F.array_join(F.transform(F.map_entries(c["materials"]), lambda m: F.concat_ws("=", m["key"], m["value"])), "; "),
        "color_script": lambda: F.concat(F.lit("palette="), joined(c["primary_palette"]), F.lit("; temperature="), c["temperature"], F.lit("; saturation="), c["saturation"]),
    }
    return F.coalesce(lines[stage](), F.to_json(c, {"ignoreNullFields": "false"}))


def stage_prompt(stage: str, instruction: str, schema: str) -> Column:
    """The user prompt for a stage: the original prompt, the decisions before it, the instruction and the schema."""
    before = V.STAGES[: V.STAGES.index(stage)]
    prior = F.array_compact(F.array(*[F.when(F.col(s).isNotNull(), F.concat(F.lit(f"- {V.STAGE_LABELS[s]} {s}: "), compact_prior(s))) for s in before])) if before else F.array().cast("array<string>")
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Prompt:\n"), F.col("prompt")),
        F.when(F.size(prior) > 0, F.concat(F.lit("Decided so far:\n"), F.array_join(prior, "\n"))),
        F.lit(instruction),
        F.lit(f"Answer with one JSON object that fits this JSON Schema:\n{schema}"),
    )


def repair_prompt(error: Column) -> Column:
    return F.concat(F.lit("The last answer does not fit the schema. Error:\n"), error, F.lit("\nReturn the corrected JSON object and nothing else."))


def chat_example(system: str) -> Column:
    """System, user and assistant messages; the assistant says the reasoning, the tokens and the prompt as JSON."""
    body = F.struct(
        F.struct(*[F.col(s) for s in V.STAGES]).alias("reasoning"),
        F.col("visual_tokens"),
        F.coalesce(F.nullif(F.col("enriched_prompt"), F.lit("")), render_prompt()).alias("render_prompt"),
    )
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(said("system", F.lit(system)), said("user", F.col("prompt")), said("assistant", F.to_json(body, {"ignoreNullFields": "false"})))


def token_target() -> Column:
    return F.struct(F.col("prompt"), F.array_join("visual_tokens", " ").alias("completion"))


def telemetry_sum(field: str) -> Column:
    """The sum of a telemetry field over all stages that are there; 0 without any."""
    return F.coalesce(F.aggregate(F.map_values("telemetry"), F.lit(0.0), lambda t, x: t + F.coalesce(x[field].cast("double"), F.lit(0.0))), F.lit(0.0))


def totals() -> dict[str, Column]:
    compute, cost = telemetry_sum("compute_s"), telemetry_sum("projected_cost_usd")
    extra = lambda f: F.coalesce(F.col(f"render.{f}"), F.lit(0.0))
    return {
        "total_compute_s": F.round(compute, 6),
        "total_projected_cost_usd": F.round(cost, 8),
        "e2e_compute_s": F.round(compute + extra("compute_s"), 6),
        "e2e_cost_usd": F.round(cost + extra("projected_cost_usd"), 8),
    }


def render_telemetry(telemetry: Column, *, keep_missing: bool) -> Column:
    """A renderer's own telemetry in the record's form; a missing one stays null or becomes zeros."""
    text = lambda f, d: F.coalesce(telemetry[f], F.lit(d))
    made = F.struct(
        text("compute_s", 0.0).alias("compute_s"), text("rate_usd_per_s", 0.0).alias("rate_usd_per_s"),
        F.coalesce(telemetry["cost_usd"], telemetry["projected_cost_usd"], F.lit(0.0)).alias("projected_cost_usd"), text("gpu", "unknown").alias("projected_gpu"),
    )
    return F.when(telemetry.isNotNull(), made) if keep_missing else made
