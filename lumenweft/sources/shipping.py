"""Python workers import this package; where it is not installed on them, Spark carries it there."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's source to the session's Python files, once for an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="lumenweft-")) / "lumenweft-src.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def shipped(f: Callable) -> Callable:
    """A query or stage that ships the package before it runs; the session is its first argument."""

    @functools.wraps(f)
    def run(spark, *args, **named):
        ship(spark)
        return f(spark, *args, **named)

    return run
