"""JSON schemas of what models must answer, built from field lists, and their reduction to what guided decoding understands."""

from __future__ import annotations

from typing import Any

from ..operators.graph import CONFIDENCE
from ..operators.units import BEAT_TYPES, CERTAINTIES

Schema = dict[str, Any]
#: fixed values: enumerations of scene entities, abstraction objects, their links, and facts asked about
ENTITY_KINDS = ("person", "organization", "place", "object", "program", "vehicle", "concept", "event", "faction", "other")
OBJECT_TYPES = ("hypothesis", "mental_state", "theory_of_mind", "relationship", "entity_trait", "concept", "process", "authorial_intent", "consequence")
LINK_TYPES = ("supports", "contradicts", "causes", "caused_by", "enables", "instance_of", "generalizes", "precedes", "follows", "concerns", "shares_theme_with")
FACT_TYPES = ("who_did_what", "sequence", "quantity_or_name", "cause", "location", "state_change")
#: fixed values: keywords that guided decoding refuses
UNSUPPORTED = frozenset(("propertyNames", "patternProperties", "if", "then", "else", "not", "allOf", "oneOf", "dependentSchemas", "unevaluatedProperties"))


def text(least: int = 0) -> Schema:
    return {"type": "string", **({"minLength": least} if least else {})}


def one_of(values) -> Schema:
    return {"type": "string", "enum": list(values)}


def maybe(of: Schema) -> Schema:
    return {"anyOf": [of, {"type": "null"}]}


def whole(least: int = 0) -> Schema:
    return {"type": "integer", "minimum": least}


def many(of: Schema, least: int = 0) -> Schema:
    return {"type": "array", "items": of, **({"minItems": least} if least else {})}


def record(**fields: Schema) -> Schema:
    """An object of exactly these fields; one whose schema is ``maybe`` must be there too, as null."""
    return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}


def grammar_safe(schema: Any) -> Any:
    """The schema without keywords that guided decoding refuses, at every depth; names of properties are never taken for keywords."""
    if isinstance(schema, list):
        return [grammar_safe(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {}
    for key, value in schema.items():
        if key == "properties":
            out[key] = {name: grammar_safe(x) for name, x in value.items()}
        elif key not in UNSUPPORTED:
            out[key] = grammar_safe(value)
    return out


def extraction(scene_ids: list[str]) -> Schema:
    names = many(text())
    change = record(entity=text(), field=text(), **{"from": maybe(text()), "to": text()})
    facts = record(quantities=names, dates=names, proper_nouns=names, locations=names)
    beat = record(order=whole(1), type=one_of(BEAT_TYPES), actor=text(), addressee=maybe(text()), content=text(10), facts=facts, state_changes=many(change), causes=many(whole(1)), certainty=one_of(CERTAINTIES))
    entity = record(name=text(), entity_id=text(), type=one_of(ENTITY_KINDS), aliases=names, relationships=many(record(predicate=text(), target=text(), target_id=maybe(text()))))
    unit = record(scene_id=one_of(scene_ids), context_before=text(20), context_after=text(20), style=text(20), present=names, referenced=names, beats=many(beat, 1), entities=many(entity))
    return record(knowledge_units=many(unit, len(scene_ids)))


def canary() -> Schema:
    """What a window without a target may answer: any list of units, of which there should be none."""
    return record(knowledge_units=many({"type": "object"}))


def seam(entity_ids: list[str], scene_ids: list[str]) -> Schema:
    return record(
        alias_merges=many(record(keep=one_of(entity_ids), merge=many(one_of(entity_ids), 1), why=text())),
        context_fixes=many(record(scene_id=one_of(scene_ids), field=one_of(("context_before", "context_after")), replacement=text(20))),
        duplicate_scene_ids=many(one_of(scene_ids)),
        continuity_notes=many(text()),
    )


def _object(refs: list[str], entity_ids: list[str], scene_ids: list[str]) -> Schema:
    return record(
        ao_id=text(), type=one_of(OBJECT_TYPES), scene_id=one_of(scene_ids), statement=text(20), subject=one_of(entity_ids) if entity_ids else text(), about=maybe(text()), grounded_in=many(one_of(refs), 1), reasoning=text(20), confidence=one_of(CONFIDENCE), assumptions=many(text()), falsifier=text(10),
    )


def draft(refs: list[str], entity_ids: list[str], scene_ids: list[str], patch: bool = False) -> Schema:
    fields = {"abstraction_objects": many(_object(refs, entity_ids, scene_ids), 1)}
    if patch:
        change = {"beat_ref": one_of(refs), "entity": text(), "field": text()}
        fields["perception_patch"] = record(
            missing_state_changes=many(record(**change, **{"from": maybe(text()), "to": text()}, stated_where=text())),
            missing_beats=many(record(scene_id=one_of(scene_ids), after_order=whole(), type=one_of(BEAT_TYPES), actor=text(), addressee=maybe(text()), content=text(10), stated_where=text())),
            wrong_state_changes=many(record(**change, problem=text(), correction=text())),
        )
    return record(**fields)


def research(refs: list[str], entity_ids: list[str], ao_ids: list[str], scene_ids: list[str]) -> Schema:
    known = one_of(ao_ids)
    return record(
        evidence=many(record(ao_id=known, beat_ref=one_of(refs), stance=one_of(("supports", "contradicts")), why=text())),
        links=many(record(from_ao=known, to_ao=known, link=one_of(LINK_TYPES), why=text())),
        confidence_updates=many(record(ao_id=known, new_confidence=one_of(CONFIDENCE), why=text())),
        new_objects=many(_object(refs, entity_ids, scene_ids)),
    )


def merge(ao_ids: list[str]) -> Schema:
    known = one_of(ao_ids)
    return record(
        cross_links=many(record(from_ao=known, to_ao=known, link=one_of(LINK_TYPES), why=text())),
        duplicates=many(record(keep=known, drop=known, why=text())),
        arcs=many(record(name=text(), subject=text(), stages=many(known, 2), summary=text())),
    )


def editor(names: list[str]) -> Schema:
    return record(canonical_map=many(record(canonical=text(), variants=many(one_of(names)))))


def questions(count: int) -> Schema:
    item = record(question=text(15), options={**many(text(1), 4), "maxItems": 4}, correct_index={**whole(), "maximum": 3}, fact_type=one_of(FACT_TYPES))
    return record(questions=many(item, count))


def restatement() -> Schema:
    return record(restated=text(10))


def faults(value: Any, schema: Schema, at: str = "$") -> list[str]:
    """Where a value departs from a schema of the forms above; empty if nowhere."""
    if "anyOf" in schema:
        found = [faults(value, s, at) for s in schema["anyOf"]]
        return min(found, key=len)
    kind = schema["type"]
    fits = {"string": isinstance(value, str), "integer": isinstance(value, int) and not isinstance(value, bool), "array": isinstance(value, list), "object": isinstance(value, dict), "null": value is None}[kind]
    if not fits:
        return [f"{at}: no {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: {value!r} is not allowed")
    if kind == "string" and len(value.strip()) < schema.get("minLength", 0):
        out.append(f"{at}: too short")
    if kind == "integer" and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        out.append(f"{at}: out of range")
    if kind == "array":
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            out.append(f"{at}: {len(value)} items")
        out += [f for i, x in enumerate(value) for f in faults(x, schema["items"], f"{at}[{i}]")]
    if kind == "object" and "properties" in schema:
        out += [f"{at}.{k}: missing" for k in schema["required"] if k not in value]
        out += [f"{at}.{k}: unknown" for k in value if k not in schema["properties"]]
        out += [f for k, x in value.items() if k in schema["properties"] for f in faults(x, schema["properties"][k], f"{at}.{k}")]
    return out
