"""Type matchers (on a type's text) and expression matchers (on rows of syntax nodes)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .predicates import chain_text, col, equals_or_matches, two_valued

_NULLS = r"(\s*\|\s*(null|undefined))+$"


def _core(t: Column) -> Column:
    return F.regexp_replace(F.trim(t), _NULLS, "")


def is_string(t: Column) -> Column:
    return two_valued(_core(t) == "string")


def is_number(t: Column) -> Column:
    return two_valued(_core(t) == "number")


def is_boolean(t: Column) -> Column:
    return two_valued(_core(t) == "boolean")


_LITERAL = r"""("[^"]*"|'[^']*'|-?\d+(\.\d+)?)"""


def is_union_of_literals(t: Column) -> Column:
    """Two or more string or number literals."""
    return two_valued(_core(t).rlike(rf"^\|?\s*{_LITERAL}(\s*\|\s*{_LITERAL})+$"))


def is_string_literal(value: str | None = None):
    if value is None:
        return lambda t: two_valued(t.rlike(r"""^("[^"]*"|'[^']*')$"""))
    return lambda t: two_valued(t.isin(f'"{value}"', f"'{value}'"))


def array_of(matcher):
    """``X[]`` or ``Array<X>`` whose element satisfies ``matcher``."""

    def test(t: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^(readonly\s+)?", ""), r"^(?:Readonly)?Array<(.*)>$", "$1[]"), r"\[\]$", "")
        return two_valued(t.rlike(r"(\[\]|^(Readonly)?Array<.*>)$") & matcher(F.regexp_replace(inner, r"^\((.*)\)$", "$1")))

    return test


def matching(regex: str):
    return lambda t: two_valued(t.rlike(regex))


def exactly(text: str):
    return lambda t: two_valued(t == text)


def not_type(matcher):
    return lambda t: ~two_valued(matcher(t))


# expression matchers: conditions on the rows of ast_nodes(kind, text, ...)
def call(text: str | None = None, regex: str | None = None) -> Column:
    callee = chain_text(F.regexp_extract(F.col("text"), r"^([^(]*)\(", 1))
    return two_valued(F.col("kind") == "call") & equals_or_matches(callee, text, regex)


def access(text: str | None = None, regex: str | None = None) -> Column:
    return two_valued(F.col("kind") == "access") & equals_or_matches(chain_text("text"), text, regex)


def new_expr(text: str | None = None, regex: str | None = None) -> Column:
    name = F.regexp_extract(F.col("text"), r"^new\s+([\w$.]+)", 1)
    return two_valued(F.col("kind") == "new") & equals_or_matches(name, text, regex)


def property_(name: str, value: str | None = None, regex: str | None = None) -> Column:
    own = F.regexp_extract(F.col("text"), r"""^["']?([\w$]+)["']?\s*:""", 1) == name
    rest = F.regexp_extract(F.col("text"), r":\s*(.*)$", 1)
    fits = F.lit(True) if value is None and regex is None else equals_or_matches(F.regexp_replace(rest, r"""^["'](.*)["']$""", "$1"), value, regex)
    return two_valued((F.col("kind") == "property") & own & fits)


def comment(text: str | None = None, regex: str | None = None) -> Column:
    hit = F.contains(F.col("text"), F.lit(text)) if regex is None else F.col("text").rlike(regex)
    return two_valued((F.col("kind") == "comment") & hit)


def jsx_element(text: str | None = None, regex: str | None = None) -> Column:
    return two_valued(F.col("kind") == "jsx_element") & equals_or_matches(F.regexp_extract(F.col("text"), r"^<\s*([\w.$-]+)", 1), text, regex)


def jsx_text(regex: str = r"\S") -> Column:
    return two_valued((F.col("kind") == "jsx_text") & F.col("text").rlike(r"\S") & F.col("text").rlike(regex))


def type_assertion(allow_const: bool = True) -> Column:
    hit = F.col("kind") == "type_assertion"
    return two_valued(hit & ~F.col("text").rlike(r"\bas\s+const$") if allow_const else hit)


def non_null_assertion() -> Column:
    return two_valued(F.col("kind") == "non_null")


def expression(nodes: DataFrame, text: str | None = None, regex: str | None = None) -> DataFrame:
    """Nodes of any kind whose text contains or matches; only the innermost stay.

    ``nodes`` has ``file``, ``start``, ``end``. A node that holds another match, or
    has the same span as another, goes. In order of start (longest first) a node
    holds another match exactly if the next one starts inside it.
    """
    hit = F.contains(F.col("text"), F.lit(text)) if regex is None else F.col("text").rlike(regex)
    found = nodes.where(two_valued(hit))
    order = Window.partitionBy("file").orderBy("start", F.desc("end"), F.desc("node_id"))
    after, before = F.lead(F.struct("start", "end")).over(order), F.lag(F.struct("start", "end")).over(order)
    holds = two_valued((after["start"] >= F.col("start")) & (after["end"] <= F.col("end")))
    twin = two_valued((before["start"] == F.col("start")) & (before["end"] == F.col("end")))
    return found.withColumn("_drop", holds | twin).where("NOT _drop").drop("_drop")


def identify_matches(matches: DataFrame, *by: str) -> DataFrame:
    """Stable ordinal of each match among those of the same element and matcher."""
    return matches.withColumn("ordinal", F.row_number().over(Window.partitionBy("file", *by).orderBy("start", "node_id")))


def cyclomatic_complexity(nodes: DataFrame, owner: str = "owner_id") -> DataFrame:
    """One more than the decisions and logical operators in each owner's body."""
    decisions = ["if", "for", "for_in", "for_of", "while", "do", "case", "catch", "conditional", "logical_and", "logical_or", "nullish"]
    return nodes.groupBy(owner).agg((F.lit(1) + F.count(F.when(F.col("kind").isin(*decisions), 1))).cast("int").alias("cc"))


def normalise_root(text: Column | str, root: str) -> Column:
    """Text with the absolute root replaced by a token."""
    return F.regexp_replace(col(text), re.escape(root.rstrip("/")), "<root>")
