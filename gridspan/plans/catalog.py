"""Every query of the engine with its DuckDB equivalent."""

from __future__ import annotations

from gridspan.plans import q_clouds, q_codec, q_composites, q_files, q_grid, q_relational, q_scalar, q_sources, q_streaming, q_view  # noqa: F401
from gridspan.plans.registry import ORACLES, QUERIES  # noqa: F401
