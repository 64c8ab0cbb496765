"""All queries of the engine but those of the optional training-data subpackage."""

from __future__ import annotations

from lorewell.operators import calibration, campaigns, commands, comparison, duplicates, events, evidence, facts, health, integrity, link_updates, links, notes_overview, pairing, patterns, reports, review, schedule, search, sessions, star, surfaces, taxonomy
from lorewell.plans import admission, metadata, mutations, triage

MODULES = (search, links, link_updates, notes_overview, duplicates, sessions, facts, commands, evidence, pairing, patterns, calibration, comparison, events, star, surfaces, reports, integrity, mutations, metadata, schedule, taxonomy, admission, campaigns, triage, review, health)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
