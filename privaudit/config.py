"""Audit settings and their fingerprint."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class AuditConfig:
    """Everything that decides what a stage table holds."""

    seed: int = 42
    ratio: float = 0.8
    train_shadows: int = 4  # K
    holdout_shadows: int = 2  # Q
    family: str = "diffusion"
    levels: tuple[int, ...] = (5, 10, 20, 30, 40, 50, 100)
    draws: int = 50
    temperatures: tuple[float, ...] = (0.0, 0.5, 1.0, 1.5, 2.0)
    latent_dim: int = 16
    rank: int = 0  # directions of a latent shadow's spectrum; 0: all of them
    floor: float = 1e-6
    scale: bool = True
    label_mode: str = "none"  # none, real or knn
    neighbours: int = 5
    summary: bool = True
    classifier: str = "rf"
    rf: dict = field(default_factory=lambda: {"numTrees": 500, "maxDepth": 8, "featureSubsetStrategy": "sqrt", "minInstancesPerNode": 20, "subsamplingRate": 0.7})
    hidden: int = 32
    rounds: int = 5
    target_fpr: float = 0.10

    def fingerprint(self, *fields: str) -> str:
        """A short hash of the named settings (all if none)."""
        chosen = {k: v for k, v in asdict(self).items() if not fields or k in fields}
        return hashlib.md5(json.dumps(chosen, sort_keys=True).encode()).hexdigest()[:16]

    @property
    def splits(self) -> list[int]:
        return list(range(1, self.train_shadows + self.holdout_shadows + 1))
