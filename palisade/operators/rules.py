"""Detection rules: plain settings on the driver that compile to columns."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

#: Settings that a summary template may name besides what was observed.
OBSERVED = ("key", "count", "seconds", "ports", "rule_id", "rule_name")


@dataclass(frozen=True, kw_only=True)
class Rule:
    """Shared settings; ``match`` has accepted values by field, all fields must accept."""

    id: str
    name: str = ""
    severity: str = "medium"
    enabled: bool = True
    match: dict[str, tuple] = field(default_factory=dict)
    allowlist: tuple[str, ...] = ()
    cooldown_seconds: int = 300
    group_by: str = "src_ip"
    summary: str = "{key}: {count} events in {seconds} s"
    author: str = ""

    @property
    def window(self) -> int:
        return 0


@dataclass(frozen=True, kw_only=True)
class Keyword(Rule):
    group_by: str = "host"
    keywords: tuple[str, ...] = ()
    regex: str | None = None
    require: tuple[tuple[str, ...], ...] = ()
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True, kw_only=True)
class Threshold(Rule):
    threshold: int
    window_seconds: int

    @property
    def window(self) -> int:
        return self.window_seconds


@dataclass(frozen=True, kw_only=True)
class Step:
    match: dict[str, tuple]
    count: int = 1


@dataclass(frozen=True, kw_only=True)
class Sequence(Rule):
    steps: tuple[Step, ...]
    within_seconds: int

    @property
    def window(self) -> int:
        return self.within_seconds


@dataclass(frozen=True, kw_only=True)
class PortScan(Rule):
    min_ports: int
    window_seconds: int

    @property
    def window(self) -> int:
        return self.window_seconds


@dataclass(frozen=True, kw_only=True)
class RarePort(Rule):
    mode: str = "watchlist"
    ports: tuple[int, ...] = ()


def fingerprint(rules: list[Rule]) -> str:
    """A digest that changes whenever any rule changes."""
    said = sorted((type(r).__name__, json.dumps(asdict(r), sort_keys=True, default=list)) for r in rules)
    return hashlib.sha256(json.dumps(said).encode()).hexdigest()
