"""Settings of a store, read from and written to TOML."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from .functions.text import memory_bytes

POLICIES = ("none", "lru", "lfu", "random", "volatile_lru")


@dataclass(frozen=True)
class StoreConfig:
    """A limit of 0 is no limit; ``shards`` is the number of log folders; ``evict_percent`` of the memory limit is freed at a time."""

    shards: int = 16
    max_keys: int = 0
    max_memory: str = "0"
    eviction: str = "none"
    evict_percent: int = 5
    snapshot_seconds: int = 300

    def validate(self) -> "StoreConfig":
        if self.shards < 1 or self.shards & (self.shards - 1):
            raise ValueError("shards must be a power of two")
        if self.eviction not in POLICIES:
            raise ValueError(f"eviction must be one of {', '.join(POLICIES)}")
        if not 0 <= self.evict_percent <= 100 or self.max_keys < 0 or self.snapshot_seconds < 0:
            raise ValueError("a setting is out of range")
        memory_bytes(self.max_memory)
        return self

    @property
    def max_bytes(self) -> int:
        return memory_bytes(self.max_memory)

    @classmethod
    def loads(cls, text: str) -> "StoreConfig":
        got = tomllib.loads(text)
        unknown = set(got) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**got).validate()

    @classmethod
    def load(cls, path: str) -> "StoreConfig":
        return cls.loads(Path(path).read_text())

    def dumps(self) -> str:
        return "".join(f"{k} = {v}\n" if isinstance(v, int) else f'{k} = "{v}"\n' for k, v in asdict(self).items())
