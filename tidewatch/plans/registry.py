"""Name to query and name to SQL, over all query modules."""

from __future__ import annotations

from tidewatch.plans import crowd, daily, desk, detect, influence, judging, models, people, research, stores, streams, texts

MODULES = [daily, detect, crowd, judging, people, influence, streams, models, texts, stores, desk, research]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
