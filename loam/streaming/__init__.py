"""Structured Streaming forms of the stateful rules; batch results are their oracle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def gone_streaks(events: DataFrame, key: str, hit: str, limit: int) -> DataFrame:
    """key, at, n: a row whenever a run of hits reaches the limit. events: key, seq (long), hit (boolean).

    State by key: the length of the present run. Rows of a micro-batch are taken by seq; late ones count as they come."""
    kind = dict(events.dtypes)[key]

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        out = []
        for row in pd.concat(list(parts)).sort_values("seq").itertuples():
            n = n + 1 if getattr(row, hit) else 0
            if n == limit:
                out.append((k[0], row.seq, n))
        state.update((n,))
        yield pd.DataFrame(out, columns=[key, "at", "n"])

    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, at long, n long", "n long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, kind: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"))


def first_copies(events: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Each key once, within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def append_new(path: str, key: str):
    """A foreachBatch function: appends to a parquet table the rows whose key it does not hold yet."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        new = batch.dropDuplicates([key])
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
        new.write.mode("append").parquet(path)

    return write


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    return events.groupBy(key).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
