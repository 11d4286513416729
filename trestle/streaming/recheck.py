"""Rules over a stream: every micro-batch is judged, or windows of it are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.predicates import two_valued
from ..schema import to_violations


def recheck(stream: DataFrame, judge: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """Run a rule over each micro-batch and add its findings to a table.

    A batch that is run again after a failure replaces its own part, so every
    finding is written once.
    """

    def one(batch: DataFrame, number: int) -> None:
        judge(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def window_limit(stream: DataFrame, time: str, key: str, most: float, window: str = "1 hour", late: str = "10 minutes", measure: Column | None = None) -> DataFrame:
    """Findings for keys that exceed a limit in a tumbling window; works on a stream (with a watermark) and on a table."""
    value = F.sum(measure) if measure is not None else F.count("*")
    counted = stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(value.cast("double").alias("measured"))
    over = counted.where(two_valued(F.col("measured") > most))
    name = F.col(key).cast("string")
    return to_violations(over, name, F.concat(name, F.lit(f" exceeds {most:g} in {window} from "), F.date_format("window.start", "yyyy-MM-dd HH:mm")), measured=F.col("measured"), identity=F.concat_ws("::", name, F.date_format("window.start", "yyyy-MM-dd HH:mm")))
