"""Application skeleton: configuration, hooks, and a registry of functions."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import SparkSession

_registered: dict[str, dict[str, Callable]] = {}


class App:
    """with App("name") as spark: ... - exit hooks run in order, before the session stops, even after an error."""

    def __init__(self, name: str, master: str | None = None):
        self.name, self.master = name, master
        self.config: list[Callable[[dict], dict]] = []
        self.hooks: list[Callable[[], None]] = []
        self.spark: SparkSession | None = None

    def add_config(self, change: Callable[[dict], dict] | dict) -> App:
        """Settings, or a function from settings to settings; applied in order."""
        self.config.append((lambda old: old | change) if isinstance(change, dict) else change)
        return self

    def add_exit_hook(self, hook: Callable[[], None]) -> App:
        self.hooks.append(hook)
        return self

    def settings(self) -> dict[str, str]:
        out = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.serializer": "org.apache.spark.serializer.KryoSerializer", "spark.kryoserializer.buffer": "16m"}
        for change in self.config:
            out = change(out)
        return out

    def __enter__(self) -> SparkSession:
        settings = self.settings()
        master = settings.pop("spark.master", None) or self.master or os.environ.get("SPARK_MASTER") or "local[*]"
        self.spark = SparkSession.builder.master(master).appName(self.name).config(map=settings).getOrCreate()
        return self.spark

    def __exit__(self, *error) -> None:
        try:
            for hook in self.hooks:
                hook()
        finally:
            self.spark.stop()


def register_function(spark: SparkSession, name: str, f: Callable, returns) -> bool:
    """Register a function for SQL; the first registration of a name wins. True if it was this one."""
    known = _registered.setdefault(spark.sparkContext.applicationId, {})
    if name in known:
        return False
    known[name] = spark.udf.register(name, f, returns)
    return True


def is_registered(spark: SparkSession, name: str) -> bool:
    return name in _registered.get(spark.sparkContext.applicationId, {})
