"""Settings from a mapping, over defaults, under environment variables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

PREFIX = "HERONLAKE_"


@dataclass(frozen=True)
class Config:
    """Defaults are limits of the service; times are in seconds."""

    fetch_rate: float = 2.0
    fetch_burst: int = 4
    workers: int = 10
    max_peers: int = 100
    scrape_batch: int = 74
    scrape_every: int = 30
    dead_after_days: int = 90
    prune_after_days: int = 90
    discovery_buffer: int = 10_000
    rotation_seconds: int = 1800
    peer_hashes: int = 10_000
    peers_per_hash: int = 200
    peer_ttl_seconds: int = 1800
    sample_interval: int = 300
    min_size: int = 50 << 20
    max_size: int = 150 << 30
    extension_filter: bool = False
    exclude_adult: bool = True
    node_id: str = ""
    external_ip_file: str = ""


def load(given: Mapping[str, object] | None = None, environ: Mapping[str, str] | None = None) -> Config:
    """A fixed node id and a file that gives the address (and so the id) exclude each other."""
    environ, values = os.environ if environ is None else environ, dict(given or {})
    for f in fields(Config):
        if (raw := environ.get(PREFIX + f.name.upper())) is not None:
            kind = type(f.default)
            values[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
    if unknown := set(values) - {f.name for f in fields(Config)}:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    out = Config(**values)
    if out.node_id and out.external_ip_file:
        raise ValueError("give a node id or a file with the address, not both")
    return out
