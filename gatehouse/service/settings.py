"""Settings from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from ..errors import InvalidRequestError


@dataclass(frozen=True)
class Settings:
    root: str = "data"
    groups_file: str | None = None
    acl_ttl_seconds: float = 60.0
    dimension: int = 1024

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        e = os.environ if env is None else env
        try:
            ttl, dimension = float(e.get("GATEHOUSE_ACL_TTL_SECONDS", "60")), int(e.get("GATEHOUSE_DIMENSION", "1024"))
        except ValueError:
            raise InvalidRequestError("a numeric setting isn't a number") from None
        if ttl < 0:
            raise InvalidRequestError("the ttl must not be negative")
        if dimension <= 0 or dimension % 8:
            raise InvalidRequestError("the dimension must be a positive multiple of 8")
        return cls(e.get("GATEHOUSE_ROOT") or "data", e.get("GATEHOUSE_GROUPS_FILE") or None, ttl, dimension)
