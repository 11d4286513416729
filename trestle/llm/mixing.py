"""Mixing sources to target weights by temperature.

Source token shares are raised to an exponent, which is bisected to meet a target
entropy or a limit on repetition; every source then gets a budget of tokens, spent
on whole passes over its documents and one partial pass in the order of a hash:
blocks of the permutation are summed first, and only the block in which a budget
ends is looked at document by document. Texts are read once for their lengths and
once to be repeated; none is shuffled.

Defined results: a null source is a source of its own; a document without text
costs nothing; a source without tokens passes once; rows with the same id stand at
the same place of the permutation and share their fate; an empty table stays empty;
other columns are left alone, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, fresh, materialise

#: passes over the most repeated source for each pass over the least repeated
MAX_REPEATS = 1.5
SEED = "mix-1"
#: sources whose table is broadcast; with more of them the joins shuffle
BROADCAST_SOURCES = 100_000
_HEX = 4


def _per_source(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_SOURCES else df


def token_estimate(text_col: str) -> Column:
    """A token for every four bytes, rounded up."""
    return F.coalesce(F.expr(f"(octet_length(`{text_col}`) + 3) div 4"), F.lit(0)).cast("long")


def _bisect(met, rising: bool) -> float:
    """Where ``met`` turns in [0, 1], to six places, on the side on which it holds; it holds from there up if ``rising``."""
    if met(0.0 if rising else 1.0):
        return 0.0 if rising else 1.0
    low, high = 0.0, 1.0
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (low, middle) if met(middle) == rising else (middle, high)
    return math.ceil(high * 1e6) / 1e6 if rising else math.floor(low * 1e6) / 1e6


def solve_exponent(tokens: list[int], max_repeats: float | None = None, target_entropy: float | None = None) -> float:
    """The exponent in [0, 1] for a mix of sources with so many tokens.

    With ``max_repeats`` alone it is the smallest, the flattest mix, that stays in
    the limit; with ``target_entropy`` (a share of the largest possible) the largest
    that reaches it, but never below what the limit asks. With neither it is 1.
    """
    sizes = [t for t in tokens if t > 0]
    if len(sizes) < 2 or max_repeats is None and target_entropy is None:
        return 1.0
    ratio = max(sizes) / min(sizes)

    def entropy(a: float) -> float:
        weights = [(t / max(sizes)) ** a for t in sizes]
        total = sum(weights)
        return -sum(w / total * math.log(w / total) for w in weights)

    least = _bisect(lambda a: ratio ** (1 - a) <= max_repeats, True) if max_repeats is not None else 0.0
    if target_entropy is None:
        return least
    return max(least, _bisect(lambda a: entropy(a) >= target_entropy * math.log(len(sizes)), False))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None, seed: str = SEED, copy_col: str | None = "_copy") -> DataFrame:
    """``docs`` with every row as often as its source's weight asks, and the number of the copy as ``copy_col`` (None for none).

    Without ``budget`` (in tokens) it is the least at which no document is left out.
    One row for each source reaches the driver.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))
    place = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    if copy_col in docs.columns:
        raise ValueError(f"the documents have a column {copy_col} already")
    narrow = materialise(docs.select(key.alias("key"), place.alias("place"), token_estimate(text_col).alias("tokens")))
    blocks = narrow.groupBy("key", F.substring("place", 1, _HEX).alias("block")).agg(F.sum("tokens").alias("tokens"))
    sums = {r["key"]: r["tokens"] for r in blocks.groupBy("key").agg(F.sum("tokens").alias("tokens")).collect()}
    full, rest = _passes(sums, max_repeats, target_entropy, budget)
    partial = {k: v for k, v in rest.items() if v > 0}
    cut: dict[str, str] = {}
    if partial:
        spark = docs.sparkSession
        budgets = _per_source(spark, list(partial.items()), "key string, rest long")
        order = Window.partitionBy("key").orderBy("block")
        ahead = blocks.join(budgets, "key").withColumn("until", F.sum("tokens").over(order)).where("until > rest")
        ends = ahead.groupBy("key").agg(F.min(F.struct("block", (F.col("until") - F.col("tokens")).alias("before"), "rest")).alias("x")).select("key", "x.*").collect()
        if ends:
            last = _per_source(spark, ends, "key string, block string, before long, rest long")
            inside = narrow.withColumn("block", F.substring("place", 1, _HEX)).join(last, ["key", "block"])
            running = F.col("before") + F.sum("tokens").over(Window.partitionBy("key").orderBy("place").rangeBetween(Window.unboundedPreceding, 0))
            fit = inside.withColumn("until", running).where("until <= rest").groupBy("key").agg(F.max("place").alias("place")).collect()
            cut = {r["key"]: r["block"] for r in ends} | {r["key"]: r["place"] for r in fit}
    discard(narrow)
    own, whole, until, nth = (fresh(docs, n) for n in ("mix_key", "mix_full", "mix_until", "mix_copy"))
    table = _per_source(docs.sparkSession, [(k, full[k], cut.get(k, "g" if k in partial else "")) for k in sums], f"{own} string, {whole} int, {until} string")
    out = docs.join(table, key == F.col(own))
    times = F.col(whole) + (place <= F.col(until)).cast("int")
    out = out.withColumn(nth, F.explode(_copies(times)))
    return out.select(*docs.columns, *([F.col(nth).alias(copy_col)] if copy_col else []))


def _copies(times: Column) -> Column:
    """0 to times - 1, and nothing at 0."""
    return F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))


def _passes(sums: dict[str, int], max_repeats: float | None, target_entropy: float | None, budget: int | None) -> tuple[dict[str, int], dict[str, int]]:
    """Whole passes over each source, and the tokens of the partial pass after them."""
    a = solve_exponent(list(sums.values()), max_repeats, target_entropy)
    most = max(sums.values(), default=0)
    passes = {k: (t / most) ** (a - 1) if t else 1.0 for k, t in sums.items()}
    if budget is not None:
        scale = budget / sum(passes[k] * t for k, t in sums.items()) if any(sums.values()) else 1.0
        passes = {k: v * scale if sums[k] else 1.0 for k, v in passes.items()}
    spend = {k: math.floor(passes[k] * t) for k, t in sums.items()}
    full = {k: spend[k] // t if t else 1 for k, t in sums.items()}
    return full, {k: spend[k] - full[k] * t for k, t in sums.items()}


def oracle(max_repeats: float = MAX_REPEATS, seed: str = SEED) -> str:
    """DuckDB SQL for the ids, sources and copies of :func:`mix` over ``documents``."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS k, md5('{seed}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place, CAST((coalesce(strlen(text), 0) + 3) // 4 AS BIGINT) AS tokens
  FROM documents),
s AS (SELECT k, CAST(sum(tokens) AS DOUBLE) AS t FROM d GROUP BY k),
r AS (SELECT max(t) AS most, max(t) / min(t) AS ratio FROM s WHERE t > 0),
b AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
  UNION ALL
  SELECT i + 1, CASE WHEN pow(ratio, 1 - (low + high) / 2) <= {max_repeats} THEN low ELSE (low + high) / 2 END,
         CASE WHEN pow(ratio, 1 - (low + high) / 2) <= {max_repeats} THEN (low + high) / 2 ELSE high END
  FROM b, r WHERE i < 40),
a AS (SELECT CASE WHEN ratio <= {max_repeats} THEN 0.0::DOUBLE ELSE ceil(high * 1e6) / 1e6 END AS a FROM b, r WHERE i = 40),
p AS (
  SELECT k, t, CAST(floor(CASE WHEN t > 0 THEN pow(t / most, a - 1) * t ELSE 0 END) AS BIGINT) AS spend,
         CASE WHEN t > 0 THEN CAST(floor(CASE WHEN t > 0 THEN pow(t / most, a - 1) * t ELSE 0 END) AS BIGINT) // CAST(t AS BIGINT) ELSE 1 END AS n
  FROM s, r, a),
c AS (SELECT d.*, n, spend - n * CAST(t AS BIGINT) AS rest, sum(tokens) OVER (PARTITION BY d.k ORDER BY place) AS until FROM d JOIN p ON d.k = p.k)
SELECT doc_id, source, CAST(unnest(range(n + CASE WHEN rest > 0 AND until <= rest THEN 1 ELSE 0 END)) AS INTEGER) AS copy FROM c
"""
