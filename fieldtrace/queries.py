"""All registered queries of the match-tracking operators, and their DuckDB SQL."""

from __future__ import annotations

from .plans import balls, cameras, compare, cues, evidence, kitting, matches, motion, records, replay, reports, rules, standing, tracks

PLANS = (reports, tracks, matches, evidence, cues, replay, motion, rules, compare, balls, cameras, kitting, records, standing)
QUERIES: dict = {name: f for plan in PLANS for name, f in plan.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: q for plan in PLANS for name, q in plan.ORACLE_SQL.items()}
