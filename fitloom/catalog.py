"""All registered queries of the evidence-matching operators and their SQL."""

from __future__ import annotations

from fitloom.queries import documents, judgement, pages, scoring, structure

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (scoring, documents, pages, structure, judgement):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
