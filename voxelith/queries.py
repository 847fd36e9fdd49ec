"""The library's queries by survey row, and their DuckDB oracles where SQL can express them."""

from __future__ import annotations

from voxelith.plans import composite, oracles, queries_geometry, queries_histogram, queries_more, queries_rest, queries_sources, queries_stencil, queries_voxels

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in (queries_voxels, queries_geometry, queries_histogram, queries_more, queries_stencil, queries_more, queries_sources, queries_rest, composite):
    QUERIES |= module.REGISTRY.queries
    ORACLES |= module.REGISTRY.oracles
ORACLES |= oracles.ORACLES
