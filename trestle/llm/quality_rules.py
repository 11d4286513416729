"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are estimated on a bounded sample; the rules
are then ordered by rejections per second, and a document that one rule rejects
is not shown to the rules after it. The order changes the time, never the result.

Defined results: a null, empty or blank text is rejected; texts of any length are
read whole; repeated rows are judged each; other columns are left alone.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_rows


@dataclass(frozen=True)
class QualityRule:
    """``passes`` is a Spark SQL condition on the text ``{t}``; ``duckdb`` says the same to DuckDB where the two differ."""

    name: str
    passes: str
    duckdb: str = ""


def _share(characters: str, most: float) -> str:
    return f"length({{t}}) - length(translate({{t}}, '{characters}', '')) <= {most} * length({{t}})"


#: shares are of all characters
RULES = [
    QualityRule("blank", "length(translate({t}, ' \t\r\n', '')) > 0"),
    QualityRule("symbols", _share("#$%&*<>=~^@+", 0.1)),
    QualityRule("bars", _share("|", 0.04)),
    QualityRule("exclamations", _share("!", 0.05)),
    QualityRule("capitals", _share("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÈÉÊÎÔÛÑÁÍÓÚ", 0.4)),
    QualityRule("digits", _share("0123456789", 0.5)),
    QualityRule("word_length", "length({t}) <= 60 * (1 + length({t}) - length(translate({t}, ' \t\r\n', '')))"),
    QualityRule(
        "stutter",
        "transform(array(split({t}, ' ')), w -> size(filter(w, (x, i) -> i > 0 AND x = get(w, i - 1))) <= 0.3 * size(w))[0]",
        "list_transform([string_split({t}, ' ')], lambda w: len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) <= 0.3 * len(w))[1]",
    ),
]

#: documents on which costs and rejection rates are estimated; they decide the order alone
SAMPLE_ROWS = 1000


def _condition(rule: QualityRule, text_col: str) -> Column:
    return F.coalesce(F.expr(rule.passes.replace("{t}", f"`{text_col}`")), F.lit(False))


def order_rules(docs: DataFrame, text_col: str = "text", rules: list[QualityRule] = RULES, sample: int = SAMPLE_ROWS) -> list[QualityRule]:
    """Rules by rejections per second on a sample, the most first; an empty sample keeps the order."""
    rows = [(r[0],) for r in sample_rows(docs, sample).select(text_col).collect()]
    if not rows:
        return list(rules)
    local = docs.sparkSession.createDataFrame(rows, "t string").coalesce(1)
    counts = local.agg(*[F.sum((~_condition(r, "t")).cast("long")).alias(r.name) for r in rules]).first()

    def seconds(condition: Column) -> float:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            local.agg(F.sum(condition.cast("long"))).collect()
            best = min(best, time.perf_counter() - began)
        return best

    idle = seconds(F.col("t").isNotNull())
    cost = {r.name: max(seconds(_condition(r, "t")) - idle, 1e-4) for r in rules}
    return sorted(rules, key=lambda r: -counts[r.name] / cost[r.name])


def passes(text_col: str, rules: list[QualityRule]) -> Column:
    """Whether a text passes all rules; evaluation stops at the first that rejects it. Without rules every text passes."""
    if not rules:
        return F.lit(True)
    case = F.when(~_condition(rules[0], text_col), False)
    for rule in rules[1:]:
        case = case.when(~_condition(rule, text_col), False)
    return case.otherwise(True)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[QualityRule] = RULES) -> DataFrame:
    """The id of every document and whether it is kept."""
    return docs.select(F.col(id_col), passes(text_col, order_rules(docs, text_col, rules)).alias("keep"))


def oracle(rules: list[QualityRule] = RULES) -> str:
    """DuckDB SQL for the rows of :func:`judge` over ``documents``."""
    every = " AND ".join(f"coalesce({(r.duckdb or r.passes).replace('{t}', 'text')}, false)" for r in rules)
    return f"SELECT doc_id, {every} AS keep FROM documents"
