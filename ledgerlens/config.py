"""Settings: frozen dataclasses, each field overridable by an environment variable."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path


def _from_env(cls, prefix: str):
    got = {}
    for f in fields(cls):
        raw = os.environ.get(f"{prefix}{f.name.upper()}")
        if raw is None:
            continue
        base = getattr(cls, f.name, None) if not callable(getattr(f, "default_factory", None)) else None
        if isinstance(base, bool):
            got[f.name] = raw.lower() in ("1", "true", "yes")
        elif isinstance(base, int):
            got[f.name] = int(raw)
        elif isinstance(base, float):
            got[f.name] = float(raw)
        elif f.name == "time_windows_days":
            got[f.name] = tuple(int(x) for x in raw.strip("[]").split(","))
        else:
            got[f.name] = raw
    return cls(**got)


@dataclass(frozen=True)
class Simulation:
    total_accounts: int = 50_000
    simulation_days: int = 180
    total_transactions: int = 2_000_000
    fraud_ratio: float = 0.015
    seed: int = 42

    def __post_init__(self):
        if not 0 < self.fraud_ratio < 1 or self.total_accounts < 1 or self.simulation_days < 1:
            raise ValueError("simulation settings out of range")


@dataclass(frozen=True)
class Fraud:
    funnel_share: float = 0.25
    circular_share: float = 0.20
    layering_share: float = 0.25
    dormant_share: float = 0.15
    device_share: float = 0.15
    layering_min: int = 3
    layering_max: int = 7
    cycle_min: int = 3
    cycle_max: int = 8
    dormant_days: int = 60
    funnel_min_inbound: int = 10
    burst_hours: int = 24
    retention_hours: int = 4

    def __post_init__(self):
        if self.layering_max < self.layering_min or self.cycle_max < self.cycle_min:
            raise ValueError("a maximum lies below its minimum")


@dataclass(frozen=True)
class Graph:
    time_windows_days: tuple[int, ...] = (7, 30, 90)
    include_lifetime: bool = True


@dataclass(frozen=True)
class Scoring:
    behavioral_weight: float = 0.35
    structural_weight: float = 0.35
    propagation_weight: float = 0.30
    alert_threshold: float = 75.0
    high_risk_threshold: float = 90.0
    use_meta_model: bool = True
    use_calibration: bool = True


@dataclass(frozen=True)
class Propagation:
    decay: float = 0.5
    max_hops: int = 5
    iterations: int = 20
    tolerance: float = 1e-5


@dataclass(frozen=True)
class Embedding:
    dim: int = 64
    walk_length: int = 40
    num_walks: int = 10
    window: int = 5


@dataclass(frozen=True)
class Sequence:
    max_len: int = 200
    dim: int = 8


@dataclass(frozen=True)
class Jdbc:
    host: str = "localhost"
    port: int = 5432
    database: str = "ledger"
    user: str = "ledger"
    password: str = ""

    @property
    def url(self) -> str:
        return f"jdbc:postgresql://{self.host}:{self.port}/{self.database}"

    @property
    def dsn(self) -> str:
        return f"postgresql://{self.user}:{self.password}@{self.host}:{self.port}/{self.database}"


@dataclass(frozen=True)
class Cache:
    host: str = "localhost"
    port: int = 6379
    db: int = 0
    score_ttl: int = 3600
    feature_ttl: int = 1800

    @property
    def url(self) -> str:
        return f"redis://{self.host}:{self.port}/{self.db}"


@dataclass(frozen=True)
class Settings:
    data_dir: str = "data"
    output_dir: str = "output"
    models_dir: str = "models"
    simulation: Simulation = field(default_factory=Simulation)
    fraud: Fraud = field(default_factory=Fraud)
    graph: Graph = field(default_factory=Graph)
    scoring: Scoring = field(default_factory=Scoring)
    propagation: Propagation = field(default_factory=Propagation)
    embedding: Embedding = field(default_factory=Embedding)
    sequence: Sequence = field(default_factory=Sequence)
    jdbc: Jdbc = field(default_factory=Jdbc)
    cache: Cache = field(default_factory=Cache)

    @classmethod
    def load(cls) -> Settings:
        groups = (("simulation", Simulation, "SIM"), ("fraud", Fraud, "FRAUD"), ("graph", Graph, "GRAPH"), ("scoring", Scoring, "SCORING"), ("propagation", Propagation, "PROP"), ("embedding", Embedding, "GL"), ("sequence", Sequence, "SEQ"), ("jdbc", Jdbc, "PG"), ("cache", Cache, "REDIS"))
        dirs = {k: v for k in ("data_dir", "output_dir", "models_dir") if (v := os.environ.get(f"LEDGERLENS_{k.upper()}"))}
        return cls(**dirs, **{name: _from_env(kind, f"LEDGERLENS_{p}_") for name, kind, p in groups})

    def ensure_dirs(self) -> None:
        for d in (self.data_dir, self.output_dir, self.models_dir):
            Path(d).mkdir(parents=True, exist_ok=True)
