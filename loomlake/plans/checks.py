"""Checks of a model's answer to one stage: a table of fields and kinds, read leniently.

Kinds take what means a value: numbers and flags as text, whole numbers with a point, words of the
vocabulary in any case and by their synonyms. Other fields of an answer are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from loomlake.functions import vocabulary as V

Kind = Callable[[object], object]
YES, NO = {"1", "on", "t", "true", "y", "yes"}, {"0", "off", "f", "false", "n", "no"}
FULL_FRAME = 0.98


def wrong(wanted: str, v: object) -> ValueError:
    return ValueError(f"{wanted} is wanted, not {v!r}")


def any_text(v: object) -> str:
    if not isinstance(v, str):
        raise wrong("a text", v)
    return v


def text(v: object) -> str:
    if not isinstance(v, str) or not v:
        raise wrong("a text that is not empty", v)
    return v


def flag(v: object) -> bool:
    word = str(int(v)) if isinstance(v, (bool, int)) or (isinstance(v, float) and v.is_integer()) else str(v).strip().lower()
    if word not in YES | NO:
        raise wrong("true or false", v)
    return word in YES


def number(v: object) -> float:
    if not isinstance(v, (bool, int, float, str)):
        raise wrong("a number", v)
    try:
        return float(v)
    except ValueError:
        raise wrong("a number", v) from None


def whole(v: object) -> int:
    found = number(v)
    if not found.is_integer():
        raise wrong("a whole number", v)
    return int(found)


def share(v: object) -> float:
    found = number(v)
    if not 0 <= found <= 1:
        raise wrong("a number from 0 to 1", v)
    return found


def word(allowed: list[str], synonyms: dict[str, str] | None = None) -> Kind:
    """One of the allowed words; with synonyms, even an empty table, also in other case and with outer white space."""

    def kind(v: object) -> str:
        found = any_text(v)
        if synonyms is not None:
            low = found.strip().lower()
            found = synonyms.get(low, low)
        if found not in allowed:
            raise wrong(f"one of {', '.join(allowed)}", v)
        return found

    return kind


def several(item: Kind, least: int = 1, exactly: int | None = None) -> Kind:
    def kind(v: object) -> list:
        if not isinstance(v, (list, tuple)) or len(v) < least or (exactly is not None and len(v) != exactly):
            raise wrong(f"a list of {exactly if exactly is not None else f'{least} or more'}", v)
        return [item(x) for x in v]

    return kind


def fields(spec: dict[str, tuple[Kind, ...]], rule: Callable[[dict], str | None] = lambda found: None) -> Kind:
    """An object: for each field its kind and, where it may be missing, its default; rule tells what else is wrong."""

    def kind(v: object) -> dict:
        if not isinstance(v, dict):
            raise wrong("an object", v)
        out = {}
        for name, (one, *default) in spec.items():
            if name not in v and default:
                out[name] = default[0]
                continue
            if name not in v:
                raise ValueError(f"{name} is missing")
            try:
                out[name] = one(v[name])
            except ValueError as e:
                raise ValueError(f"{name}: {e}") from None
        problem = rule(out)
        if problem:
            raise ValueError(problem)
        return out

    return kind


def colour(v: object) -> str:
    if not isinstance(v, str) or not re.fullmatch(r"#[0-9a-fA-F]{6}", v):
        raise wrong("a colour #RRGGBB", v)
    return v


def surfaces(v: object) -> dict[str, str]:
    if not isinstance(v, dict) or not v:
        raise wrong("an object of surfaces", v)
    if not all(isinstance(x, str) and k.strip() and x.strip() for k, x in v.items()):
        raise wrong("texts that are not blank", v)
    return dict(v)


def entity_rule(e: dict) -> str | None:
    x0, y0, x1, y1 = e["bbox"]
    if x1 <= x0 or y1 <= y0:
        return f"{e['id']}: its box has no extent"
    if (x1 - x0) * (y1 - y0) >= FULL_FRAME and e["kind"] != "background":
        return f"{e['id']}: only a background may fill the frame"
    return None


def layout_rule(found: dict) -> str | None:
    ids = [e["id"] for e in found["entities"]]
    if len(set(ids)) < len(ids):
        return f"entity ids repeat: {ids}"
    lost = [x for r in found["relations"] for x in (r["subject"], r["object"]) if x not in {*ids, *V.IMPLICIT_ANCHORS}]
    return f"no such entities: {lost}" if lost else None


ENTITY = fields({"id": (text,), "kind": (word(V.ENTITY_KINDS),), "bbox": (several(share, exactly=4),), "z": (whole, 0)}, entity_rule)
RELATION = fields({"subject": (text,), "predicate": (word(V.PREDICATES, V.PREDICATE_SYNONYMS),), "object": (text,)})

#: What each stage's answer must be.
STAGES: dict[str, Kind] = {
    "semantic_plan": fields({"subject": (text,), "environment": (text,), "camera": (text,), "mood": (text,), "dominant_elements": (several(any_text),)}),
    "layout": fields({"canvas": (several(whole, exactly=2), [1024, 1024]), "entities": (several(ENTITY),), "relations": (several(RELATION),)}, layout_rule),
    "composition": fields({"lens": (text,), "rule_of_thirds": (flag,), "subject_scale": (share,), "leading_lines": (flag,), "symmetry": (flag,)}),
    "lighting": fields({"key_light": (text,), "fill_light": (word(V.LEVELS),), "rim_light": (flag,), "contrast": (word(V.LEVELS),)}),
    "materials": fields({"materials": (surfaces,)}),
    "color_script": fields({"primary_palette": (several(colour),), "temperature": (word(V.TEMPERATURES, V.TEMPERATURE_SYNONYMS),), "saturation": (word(V.LEVELS, V.SATURATION_SYNONYMS),)}),
}
