"""Settings, read from a mapping such as the environment; what can't be read falls back to the default."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from ..operators.mask import failure_mode, policy
from ..sources.mappings import DEFAULT_TTL


def positive_int(value: str | None, default: int) -> int:
    try:
        n = int(str(value).strip())
    except ValueError:
        return default
    return n if n > 0 else default


def positive_float(value: str | None, default: float) -> float:
    try:
        x = float(str(value).strip())
    except ValueError:
        return default
    return x if 0 < x < float("inf") else default


def flag(value: str | None, default: bool = True) -> bool:
    return default if value is None else value.strip().lower() not in ("0", "false", "no", "off")


@dataclass(frozen=True)
class Settings:
    mode: str = "mask"
    on_failure: str = "fail_open"
    mapping_ttl_seconds: int = DEFAULT_TTL
    score_threshold: float = 0.35
    detect_bare_inn: bool = True
    files_per_batch: int = 16

    @classmethod
    def read(cls, env: Mapping[str, str], prefix: str = "VEIL_") -> Settings:
        get = lambda name: env.get(prefix + name)
        return cls(policy(get("MODE")), failure_mode(get("ON_FAILURE")), positive_int(get("MAPPING_TTL_SECONDS"), DEFAULT_TTL), positive_float(get("SCORE_THRESHOLD"), 0.35), flag(get("DETECT_BARE_INN")), positive_int(get("FILES_PER_BATCH"), 16))

    def detection(self) -> dict:
        """What detect() takes of the settings."""
        return {"score_threshold": self.score_threshold, "detect_bare_inn": self.detect_bare_inn}
