"""Parameters of a job, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class JobConfig:
    bootstrap: str = "localhost:9092"
    topics: dict[str, str] = field(default_factory=lambda: {"traces": "otlp-traces", "logs": "otlp-logs", "metrics": "otlp-metrics"})
    #: ``earliest`` or ``latest``
    starting_offsets: str = "earliest"
    #: ``count``, ``skip`` or ``fail``
    malformed: str = "count"
    trigger: str = "10 seconds"
    usd_per_gb: float = 0.50
    #: Upper bounds of the latency buckets, in seconds.
    latency_bounds: tuple[float, ...] = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
    max_series: int = 2_000
    max_templates: int = 20_000
    max_services: int = 50_000
