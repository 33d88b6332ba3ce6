"""Sessions with the settings that the library is designed for."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """from_env reads QUARRYLIGHT_APP_NAME, QUARRYLIGHT_MASTER, QUARRYLIGHT_CHECKPOINT_DIR and QUARRYLIGHT_SHUFFLE_PARTITIONS."""

    app_name: str = "quarrylight"
    master: str | None = None
    checkpoint_dir: str | None = None
    shuffle_partitions: int | None = None
    extra: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        get = lambda name: env.get(f"QUARRYLIGHT_{name}") or None
        parts = get("SHUFFLE_PARTITIONS")
        return cls(get("APP_NAME") or cls.app_name, get("MASTER"), get("CHECKPOINT_DIR"), int(parts) if parts else None)

    def conf(self) -> dict[str, str]:
        """Adaptive execution splits skewed joins and sizes partitions; sessions are in UTC so that results don't move."""
        out = {
            "spark.app.name": self.app_name,
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.adaptive.coalescePartitions.enabled": "true",
            "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        }
        if self.master:
            out["spark.master"] = self.master
        if self.checkpoint_dir:
            out["spark.checkpoint.dir"] = self.checkpoint_dir
        if self.shuffle_partitions:
            out["spark.sql.shuffle.partitions"] = str(self.shuffle_partitions)
        return out | self.extra


def build_session(settings: Settings | None = None) -> SparkSession:
    return SparkSession.builder.config(map=(settings or Settings.from_env()).conf()).getOrCreate()
