"""Session defaults for local use; on a cluster the caller's session is taken as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "rosterlake", cores: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers of this application, once."""
    import tempfile
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_rosterlake_shipped", False):
        return spark
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="ship-")) / "rosterlake.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"rosterlake/{p.relative_to(top)}")
    sc.addPyFile(str(target))
    sc._rosterlake_shipped = True
    return spark
