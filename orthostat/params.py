"""Parameters of a run, with the defaults of the operators."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    """Thresholds and limits; S9: environment variables ``ORTHOSTAT_<NAME>`` override them."""

    max_radius_km: float = 10.0
    near_km: float = 30.0
    period_tolerance: int = 100
    majority: float = 0.6
    min_shared: int = 1
    similarity_score: float = 0.7
    label_cosine: float = 0.85
    max_path_km: float = 200.0
    min_stops: int = 3
    max_stops: int = 10
    known_confidence: float = 0.70
    cluster_overlap: float = 0.8
    path_overlap: float = 0.7
    mode: str = "comprehensive"

    @classmethod
    def load(cls, **overrides) -> Params:
        """Defaults, then the environment, then the arguments."""
        out = cls()
        for f in fields(cls):
            if (text := os.environ.get(f"ORTHOSTAT_{f.name.upper()}")) is not None:
                out = replace(out, **{f.name: type(getattr(out, f.name))(text)})
        return replace(out, **overrides)
