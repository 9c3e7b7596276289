"""Settings of a run: defaults, laid over by environment variables, laid over by arguments. Clocks are read once, by the caller."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from datetime import datetime, timezone

TRUE = {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class Settings:
    data_dir: str = "data"
    cache_ttl: float = 604_800.0
    backoff_factor: float = 2.0
    max_backoff: float = 16.0
    max_sport_pages: int = 40
    reconcile_max_loss: float = 0.5
    save_photos: bool = False

    def over(self, **given) -> Settings:
        """With the arguments that were given, None meaning not."""
        return replace(self, **{k: v for k, v in given.items() if v is not None})


def from_environment(prefix: str = "ROSTERLAKE_", environment: Mapping[str, str] | None = None) -> Settings:
    """Each field from PREFIX + its upper-case name; a number that can't be read is as if it weren't there."""
    env, got = os.environ if environment is None else environment, {}
    for f in fields(Settings):
        raw, kind = env.get(prefix + f.name.upper()), type(f.default)
        if raw is None:
            continue
        try:
            got[f.name] = raw.strip().lower() in TRUE if kind is bool else int(float(raw)) if kind is int else kind(raw)
        except ValueError:
            continue
    return Settings(**got)


def run_id(now: datetime) -> str:
    """A folder name that sorts by time."""
    return now.astimezone(timezone.utc).strftime("%Y%m%d-%H%M%S")


def stamp(now: datetime) -> str:
    return now.astimezone(timezone.utc).replace(microsecond=0).isoformat().replace("+00:00", "Z")
