"""Names and rates that records must agree on."""

from __future__ import annotations

# Stage names and labels, controlled vocabularies and synonyms of the record format.
STAGES = ["semantic_plan", "layout", "composition", "lighting", "materials", "color_script"]
STAGE_LABELS = {"semantic_plan": "N1", "layout": "N2", "composition": "N3", "lighting": "N4", "materials": "N5", "color_script": "N6"}
LEVELS = ["low", "medium", "high"]
TEMPERATURES = ["cold", "neutral", "warm"]
ENTITY_KINDS = ["object", "character", "light", "atmosphere", "shadow", "background"]
DETECTABLE_KINDS = ["object", "character"]
SPLITS = ["train", "val", "test"]
PREDICATES = [
    "inside", "on", "behind", "in_front_of", "above", "below",
    "left_of", "right_of", "near",
    "casts_shadow_on", "illuminated_by", "passes_through", "reflects", "part_of",
]
PREDICATE_SYNONYMS = {
    "in": "inside",
    "appear_on": "on",
    "appear_above": "above",
    "appear_below": "below",
    "appear_behind": "behind",
    "appear_in_front_of": "in_front_of",
    "appear_in_front": "in_front_of",
    "in_front": "in_front_of",
    "in_frontof": "in_front_of",
    "on_top_of": "on",
    "onto": "on",
    "inside_of": "inside",
    "partof": "part_of",
}
PREDICATE_PHRASES = {
    "inside": "inside", "on": "on", "behind": "behind",
    "in_front_of": "in front of", "above": "above", "below": "below",
    "left_of": "to the left of", "right_of": "to the right of", "near": "near",
    "casts_shadow_on": "casting a shadow on", "illuminated_by": "illuminated by",
    "passes_through": "passing through", "reflects": "reflecting", "part_of": "part of",
}
IMPLICIT_ANCHORS = ["floor", "ground", "ceiling", "wall", "walls", "sky", "horizon", "water", "background", "foreground", "offscreen"]
TEMPERATURE_SYNONYMS = {"cool": "cold", "chilly": "cold", "icy": "cold", "hot": "warm"}
SATURATION_SYNONYMS = {
    "muted": "low", "desaturated": "low", "dull": "low",
    "moderate": "medium", "mid": "medium",
    "vivid": "high", "vibrant": "high", "saturated": "high",
}

# List prices in dollars a second, and what stands for what.
GPU_RATES = {
    "B200": 0.001736,
    "H200": 0.001261,
    "H100": 0.001097,
    "RTX-PRO-6000": 0.000842,
    "A100-80GB": 0.000694,
    "A100-40GB": 0.000583,
    "L40S": 0.000542,
    "A10": 0.000306,
    "L4": 0.000222,
    "T4": 0.000164,
}
GPU_ALIASES = {"A100": "A100-80GB", "A100-40": "A100-40GB", "A100-80": "A100-80GB", "RTX6000": "RTX-PRO-6000", "RTXPRO6000": "RTX-PRO-6000"}
CPU_RATE = 0.0000131
MEMORY_RATE = 0.00000222
LEAST_CORES = 0.125

# Gate limits and safety levels.
GATE = {"clip_min": 0.22, "aesthetic_min": 4.5, "faithfulness_min": 0.3, "nsfw_max": 0.5}
NSFW_BLOCKED, NSFW_REVIEW = 0.85, 0.5
METRICS = ["clip_score", "aesthetic", "image_reward", "faithfulness", "detection_coverage"]
