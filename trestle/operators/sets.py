"""Correspondence of two sides by key, and pairs across layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import two_valued
from ..schema import to_violations


def by_name(name: str = "name") -> Column:
    return F.col(name)


def by_arg(index: int, args: str = "args") -> Column:
    """The text of an argument of a call."""
    return F.get(F.col(args), index)["text"]


def by_property_names(items: str = "properties") -> Column:
    """All names of an element: one key each."""
    return F.transform(F.col(items), lambda p: p["name"])


def keys(df: DataFrame, key: Column) -> DataFrame:
    """Distinct keys of a side; an array gives many, null none."""
    found = df.select(key.alias("key"))
    if found.schema["key"].dataType.typeName() == "array":
        found = found.select(F.explode("key").alias("key"))
    return found.where("key IS NOT NULL").distinct()


def correspondence(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """``key`` and ``side``: ``missing`` where only the left has it, ``orphan`` where only the right has; one shuffle a side."""
    a, b = keys(left, left_key).withColumn("_l", F.lit(1)), keys(right, right_key).withColumn("_r", F.lit(1))
    both = a.join(b, "key", "full_outer").where("_l IS NULL OR _r IS NULL")
    return both.select("key", F.when(F.col("_r").isNull(), "missing").otherwise("orphan").alias("side"))


def duplicates(side: DataFrame, key: Column) -> DataFrame:
    """Keys that several subjects of one side share, with their number."""
    return side.select(key.alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def correspondence_findings(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    rows = correspondence(left, right, left_key, right_key)
    text = F.when(F.col("side") == "missing", F.lit(f" is in {names[0]} and missing in {names[1]}")).otherwise(F.lit(f" is in {names[1]} and has no origin in {names[0]}"))
    return to_violations(rows, "key", F.concat(F.col("key").cast("string"), text), identity=F.concat_ws("::", F.col("side"), F.col("key").cast("string")))


def within(functions: DataFrame, callbacks: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions that are callbacks of the selected calls; ``callbacks(call_id, fn_id)``."""
    chosen = callbacks.join(calls.select("call_id"), "call_id", "left_semi").select("fn_id")
    return functions.join(chosen, "fn_id", "left_semi")


def matching_counterpart(left: DataFrame, right: DataFrame, on: Column, key: str = "file") -> DataFrame:
    """Findings: files of the left layer that the mapping pairs with none of the right. An equality in ``on`` makes it an equi-join."""
    missing = left.join(right, on, "left_anti")
    return to_violations(missing, key, F.concat(F.col(key).cast("string"), F.lit(" has no counterpart")))


def consistent_exports(pairs: DataFrame, left_symbols: str = "left_symbols", right_symbols: str = "right_symbols") -> DataFrame:
    """Findings: symbols of the left of a pair that the right lacks."""
    rows = pairs.withColumn("_symbol", F.explode(F.array_except(left_symbols, right_symbols)))
    return to_violations(rows, "left_file", F.concat(F.col("right_file"), F.lit(" lacks "), F.col("_symbol")), file="right_file", identity=F.concat_ws("::", "left_file", "right_file", "_symbol"))


def satisfy_pair(pairs: DataFrame, condition: Column, message: Column) -> DataFrame:
    """Findings: pairs that fail a condition."""
    return to_violations(pairs.where(~two_valued(condition)), "left_file", message, file="left_file")
