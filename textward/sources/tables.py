"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Session setting: tasks over which texts are dealt before costly work.  Unset, a scan's own splits are the tasks, as
#: they should be on a cluster; a table of fewer row groups than cores (as in tests) needs it, at the price of a shuffle.
TASKS = "textward.text.tasks"


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over as many tasks as the session asks for, or as they are if it does not."""
    tasks = df.sparkSession.conf.get(TASKS, None)
    return df.repartition(int(tasks)) if tasks else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_integers(df: DataFrame) -> DataFrame:
    """Widen int columns to bigint, the type SQL aggregates give."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("bigint").alias(f.name) if f.dataType.simpleString() == "int"
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
