"""All named queries, with their SQL where DuckDB can express them."""

from __future__ import annotations

from tellurion.plans import evidence, focus, objects, pixels, records, regions, scenes

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (pixels, objects, focus, scenes, evidence, regions, records):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
FLAGSHIP = "cell_score_rank"
