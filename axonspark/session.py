"""Session defaults and settings."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "axonspark", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and UTF-8 binary ordering; ``conf`` overrides (double underscores stand for dots)."""
    b = SparkSession.builder.appName(name)
    for k, v in {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.cbo.enabled": "true", **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def load_env(path: str | None = ".env") -> dict[str, str]:
    """Reads KEY=VALUE lines into the environment without overriding what is set; comments and blank lines are skipped, quotes stripped. A missing file is empty."""
    found: dict[str, str] = {}
    if not path or not os.path.isfile(path):
        return found
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, eq, value = line.strip().partition("=")
            if not eq or key.startswith("#"):
                continue
            found[key.strip()] = value.strip().strip("'\"")
            os.environ.setdefault(key.strip(), found[key.strip()])
    return found


def setting(*names: str, required: bool = False) -> str:
    """The first of the variables that is set and not empty."""
    value = next((os.environ[n] for n in names if os.environ.get(n)), "")
    if required and not value:
        raise KeyError(f"set one of: {', '.join(names)}")
    return value
