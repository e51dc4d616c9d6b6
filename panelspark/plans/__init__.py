"""All registered queries; importing this package fills the registry."""

from panelspark.plans import (  # noqa: F401
    aggregates,
    calibration,
    factors,
    flagship,
    forecast,
    indicators,
    joins,
    labels,
    models,
    overfit,
    portfolio,
    quality,
    scans,
    selection,
    splits,
    statistics,
    streams,
    trading,
)
from panelspark.plans.registry import IDS, ORACLES, QUERIES

__all__ = ["IDS", "ORACLES", "QUERIES"]
