"""Help from Python for the few values that expressions cannot deal with: JSON that the strict parser refuses, and pages
with very many titles to look for.  Rows that need no help are NULL and cost nothing but their place in a batch.
"""
from __future__ import annotations

import json
import math
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _number(text: str) -> float | None:
    value = float(text)
    return value if math.isfinite(value) else None


def strict_again(block: str | None) -> str | None:
    """A JSON text in strict form: of repeated keys the last counts, ``NaN`` and infinite numbers are null; NULL if it cannot be read."""
    if block is None:
        return None
    try:
        return json.dumps(json.loads(block, parse_constant=lambda _: None, parse_float=_number))
    except (ValueError, RecursionError):
        return None


def reread_texts(batch: pa.Array) -> pa.Array:
    return pa.array([None if b is None else [strict_again(t) for t in b] for b in batch.to_pylist()], pa.list_(pa.string()))


def reread(blocks: Column) -> Column:
    """``strict_again`` for each text of an array; NULL for a NULL array."""
    return F.arrow_udf(reread_texts, "array<string>").asNondeterministic()(blocks)


def first_holding(titles: list[str | None], links: list[tuple[str, str]]) -> list[str | None]:
    """For each title the address of the first link (address, text) that holds it, whatever the case.

    One automaton of all titles runs over the texts, so the time is that of reading both.
    """
    import ahocorasick

    automaton, found = ahocorasick.Automaton(), {}
    lower = [None if t is None else t.lower() for t in titles]
    for title in set(lower) - {None, ""}:
        automaton.add_word(title, title)
    wanted = len(automaton)
    if wanted:
        automaton.make_automaton()
        for href, text in links:
            for _, title in automaton.iter(text.lower()):
                found.setdefault(title, href)
            if len(found) == wanted:
                break
    if links:
        found[""] = links[0][0]
    return [found.get(t) for t in lower]
