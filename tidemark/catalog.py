"""All queries of the engine: importing this module registers them."""

from tidemark.operators import attribution, baselines, causes, confidence, decisions, drivers, evidence, inference, ingestion, kpi, retrieval, scenarios, series, shifts  # noqa: F401
from tidemark.registry import ORACLES, QUERIES  # noqa: F401
from tidemark.sources import pathologies, simulator  # noqa: F401
from tidemark.streaming import arrivals, freshness, watermarks  # noqa: F401
