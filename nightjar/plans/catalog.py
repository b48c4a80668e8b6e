"""All registered queries, imported for their registration side effect."""
from __future__ import annotations

from . import q_features, q_labels, q_models, q_nights, q_scoring, q_sensors, q_sources  # noqa: F401
from .registry import REGISTRY, Entry

__all__ = ["REGISTRY", "Entry"]
