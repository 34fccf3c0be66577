"""Copies of published CSV trees into a data directory."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import SparkSession

from axonspark.sources.catalog import write_manifest


def copy_tree(source: str, target: str, skip: frozenset[str] = frozenset(), deep: bool = True) -> int:
    """Copies the CSV files below (or, not ``deep``, in) ``source``; a missing source is empty, and paths through a part in ``skip`` are left out."""
    n = 0
    for folder, _, names in os.walk(source):
        rel = os.path.relpath(folder, source)
        if not deep and rel != ".":
            continue
        for name in sorted(names):
            if name.endswith(".csv") and not skip & set(os.path.normpath(os.path.join(rel, name)).split(os.sep)):
                os.makedirs(os.path.join(target, rel), exist_ok=True)
                shutil.copy2(os.path.join(folder, name), os.path.join(target, rel, name))
                n += 1
    return n


def build(spark: SparkSession, source: str, target: str, trees: list[tuple[str, str]], skip: frozenset[str] = frozenset()) -> int:
    """Empties ``target``, copies each (subtree of source, place in target) and writes the manifest; returns the files copied."""
    if not os.path.isdir(source):
        raise FileNotFoundError(source)
    shutil.rmtree(target, ignore_errors=True)
    os.makedirs(target)
    n = sum(copy_tree(os.path.join(source, a), os.path.join(target, b), skip) for a, b in trees)
    write_manifest(spark, target)
    return n
