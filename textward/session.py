"""A local session for tests, benchmarks and trials."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from .sources.tables import TASKS


def local_session(cores: int | None = None, name: str = "textward") -> SparkSession:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:  # Python workers import the package wherever they start
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config(TASKS, str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
