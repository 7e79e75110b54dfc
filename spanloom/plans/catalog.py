"""The engine's own queries over the driver's tables, each with SQL that states the same result."""

from __future__ import annotations

from . import crossings, graphs, grids, logs, records, sequences, stores, summaries, surfaces, tolerance, volumes  # noqa: F401
from .registry import COVERS, ORACLES, QUERIES  # noqa: F401
