"""Whole scene units for tests, from the fields that matter."""

from corpusloom.operators import units


def beat(order, content, actor="ana", **more):
    base = {"order": order, "type": "action", "actor": actor, "addressee": None, "content": content, "facts": None, "state_changes": [], "causes": [], "certainty": "stated"}
    return base | more


def entity(entity_id, name=None, type="person", **more):
    return {"name": name or entity_id.title(), "entity_id": entity_id, "type": type, "aliases": [], "attributes": {}, "relationships": []} | more


def unit(scene="sc-1", index=0, **changes):
    beats = [beat(i, f"something happens {i}", causes=[i - 1] if i > 1 else []) for i in (1, 2, 3)]
    base = {"scene_id": scene, "scene_index": index, "heading": None, "context_before": "before that nothing of note", "context_after": "after that nothing of note", "style": "short and plain sentences", "present": ["ana"], "referenced": ["boris"], "beats": beats, "entities": [entity("ana", aliases=["A."]), entity("boris")], "extraction_warnings": None}
    return base | changes


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), units.UNIT)
