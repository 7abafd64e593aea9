"""Prompts as expressions over rows: what a model is asked for documents, scenes, seams, abstraction objects and questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

SYSTEM = "You turn texts into structured records and return only valid JSON."
CUT_ABOVE = 170


def sections(task: str, **parts: Column) -> Column:
    """A task, then each part under its name in capitals; a null part is left out."""
    shown = [F.when(c.isNotNull(), F.concat(F.lit(f"\n\n{name.replace('_', ' ').upper()}:\n"), c.cast("string"))) for name, c in parts.items()]
    return F.concat(F.lit(task), *(F.coalesce(s, F.lit("")) for s in shown))


def filled(c: Column) -> Column:
    """A part's text; null where it is empty, so that its section falls out."""
    return F.nullif(X.text_of(c), F.lit(""))


# ---------------------------------------------------------------- documents
def unit(text: Column, before: Column, after: Column, title: Column, abstract: Column) -> Column:
    """A chunk with the words around it."""
    return sections("List the entities of the target text only, with types, aliases, attributes and relationships, as one JSON object with context_summary and entities. Keep facts, not wording.", title=filled(title), abstract=filled(abstract), before=filled(before), after=filled(after), target=text)


def next_unit(text: Column, earlier: Column, title: Column, abstract: Column) -> Column:
    """A chunk with the JSON of the units before it, whose names it should use again."""
    return sections("List the entities of the target text as one JSON object with context_summary and entities. Where an entity was named before, use that name.", title=filled(title), abstract=filled(abstract), earlier_units=filled(earlier), target=text)


def aliases(names: Column, candidates: Column, title: Column, abstract: Column) -> Column:
    """All names of a document by chunk, and pairs that look alike."""
    return sections('Group spellings of one and the same entity of this document; leave out whatever is uncertain, and never join a person with what is named after them, a method with its object, or a class with its member. Answer {"alias_groups": {"full name": ["spelling", ...]}}.', title=filled(title), abstract=filled(abstract), names=names, pairs_to_look_at=candidates)


def audit(source: Column, unit_json: Column) -> Column:
    return sections('Compare the record with its source. Answer JSON with "scores" from 0 to 5 for factual_fidelity, coverage, relation_quality, naming_consistency, style_independence and schema_validity, and with "unsupported_claims", "omissions" and "summary".', source=source, record=unit_json)


def correction(source: Column, unit_json: Column, faults: Column) -> Column:
    return sections("Return the record as corrected JSON of the same form: remove what the source doesn't support, add what is missing, keep all else.", source=source, record=unit_json, faults=filled(faults))


def questions(text: Column, count: int) -> Column:
    return sections(f"Write {count} hard but fair multiple-choice questions about the text, each with four options and the letter of the one that is right.", text=text)


def answer(question: Column, context: Column, fields: bool = False) -> Column:
    """A plain question, or the form that asks for the letter between semicolons and keeps plain signs only."""
    plain = sections("Answer with one letter.", context=filled(context), question=question)
    return X.sanitized(sections("Answer with the letter between semicolons, as in ;A;", context=filled(context), question=question)) if fields else plain


# ---------------------------------------------------------------- scenes
def scenes(target: Column, before: Column, after: Column, listing: Column, speakers: Column | None = None) -> Column:
    """A window: each listed scene once, from the target alone."""
    parts = {"scenes": listing, "context_before": filled(before), "context_after": filled(after)}
    if speakers is not None:
        parts["speakers_to_account_for"] = filled(speakers)
    return sections('Write one knowledge unit for each listed scene, from the target text alone; the context is for understanding only. Keep numbers, dates and names exactly, and no wording. Answer {"knowledge_units": [...]}; an empty target has none.', **parts, target=target)


def seam(left: Column, right: Column) -> Column:
    """The last units of one window and the first of the next, never their source."""
    return sections("The two lists continue one story. Name ids of one entity, contexts that contradict the neighbour, and scenes that both lists hold.", left=left, right=right)


def scene_questions(text: Column, heading: Column, count: int) -> Column:
    return sections(f'Write {count} questions of four options whose answers this scene alone settles, in words that the text doesn\'t use. Answer {{"questions": [...]}}.', heading=filled(heading), scene=text)


def restate(text: Column, run: Column) -> Column:
    """A repair: the field's own text and the length of the run that it shares, never the source."""
    return sections('Restate the text so that no more than four ordinary words in a row stay; keep each number, name and reference as it is, and every claim. Answer {"restated": "..."}.', shared_words=run, text=text)


# ---------------------------------------------------------------- abstraction objects
def drafts(source: Column, units: Column, refs: Column) -> Column:
    return sections("State what lies behind these scenes: intentions, beliefs, causes, patterns. Ground each object in listed beats, say how sure it is, and what would refute it.", beats=refs, units=units, scenes=source)


def research(source: Column, units: Column, objects: Column, round_: int) -> Column:
    return sections(f"Round {round_}: search for beats that support or contradict each object, links between them, and objects that are missing. Lower a confidence as readily as you raise it.", objects=objects, units=units, scenes=source)


def objects_digest(objects: Column, detail: bool) -> Column:
    """Lines of (ao_id, type, subject, statement): whole at the first level of the merge tree, cut after CUT_ABOVE characters above."""
    said = lambda o: o.statement if detail else F.substring(o.statement, 1, CUT_ABOVE)
    return F.array_join(F.transform(objects, lambda o: F.concat_ws(" | ", o.ao_id, o.type, X.text_of(o.subject), said(o))), "\n")


def merges(left: Column, right: Column) -> Column:
    return sections("Two neighbouring stretches of one story. Name links across them, objects that say the same, and arcs that run through both.", left=left, right=right)


def editor(names: Column, established: Column) -> Column:
    return sections("Give spellings of one name one canonical form. Forms that are established already stay.", names=names, established=filled(established))
