"""Sections of a decision, found by marker phrases; overlaps are settled in the order of the markers."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Section types in order of priority, with their marker patterns.
MARKERS = {
    "FACTS": ("встановив[а-яіїє]*", "встановлено", "фактичні обставини"),
    "CLAIMS": ("позивач просить", "вимагає", "позовні вимоги"),
    "LAW_REFERENCES": (r"згідно зі ст\.", "відповідно до", "на підставі", r"ст\.\s*\d+"),
    "COURT_REASONING": ("суд вважає", "суд встановлює", "суд приходить до висновку", "обґрунтування"),
    "DECISION": ("ухвалив", "постановив", "рішення", "резолютивна частина"),
    "AMOUNTS": (r"сума\s+\d+", r"штраф\s+\d+", r"компенсація\s+\d+", r"\d+\s+гривень"),
}
LEAST, MOST, SURE = 100, 5000, 0.5
SCHEMA = "array<struct<type:string,text:string,start:int,end:int,confidence:double>>"


def sections_of(text: str | None, markers: dict[str, tuple[str, ...]] = MARKERS) -> list[dict]:
    """A section runs from a marker to the next marker or blank line beyond 100 characters, 5000 at most.

    Markers are taken kind by kind and pattern by pattern; one whose section begins or ends in a section that was
    taken before is passed over. Weak sections take their place too and are dropped at the end.
    """
    if not text:
        return []
    patterns = {kind: [re.compile(p, re.IGNORECASE) for p in own] for kind, own in markers.items()}
    found = {p: [m.start() for m in p.finditer(text)] for own in patterns.values() for p in own}
    stops = sorted({*(x for at in found.values() for x in at), *(m.start() for m in re.finditer(r"\n\n", text))})
    taken = bytearray(len(text))
    out = []
    for kind, own in patterns.items():
        for start in (x for p in own for x in found[p]):
            k = bisect_left(stops, start + LEAST)
            end = min([start + MOST, len(text), *stops[k : k + 1]])
            if end <= start or taken[start] or taken[end - 1]:
                continue
            taken[start:end] = b"\1" * (end - start)
            body = text[start:end]
            sure = 0.7 + 0.1 * sum(bool(p.search(body)) for p in own) - 0.2 * (len(body) < 50) - 0.1 * (len(body) > 10_000)
            out.append({"type": kind, "text": body, "start": start, "end": end, "confidence": round(min(1.0, max(0.0, sure)), 3)})
    return sorted((s for s in out if s["confidence"] >= SURE), key=lambda s: s["start"])


def sections(text: Column, markers: dict[str, tuple[str, ...]] = MARKERS) -> Column:
    """Which section wins depends on those chosen before it, so this is an Arrow-batched function."""

    @F.pandas_udf(SCHEMA)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: sections_of(t, markers))

    return find(text)
