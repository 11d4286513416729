"""What happens to findings: identity, suppression, baseline, changed files, severity.

The order is fixed: disambiguate, enrich, exclusions, directives, deduplicate,
baseline, changed files. Findings about the configuration pass all of it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import or_, two_valued
from ..schema import VIOLATION

KEEP = two_valued


def subject() -> Column:
    """The identity, or the element with its message; never the line."""
    return F.coalesce("identity", F.concat_ws("::", F.coalesce("element", F.lit("")), F.coalesce("message", F.lit(""))))


def bypass() -> Column:
    return two_valued(F.col("bypass_filters"))


def disambiguate(findings: DataFrame) -> DataFrame:
    """The second and later findings with the same rule and subject get ``#n``, skipping numbers that are taken; one pass over the findings."""
    keyed = findings.withColumn("_subject", subject()).withColumn("_rule", F.coalesce("rule", F.lit(""))).withColumn("_base", F.regexp_replace("_subject", r"(#\d{1,9})+$", ""))
    group = Window.partitionBy("_rule", "_base")
    order = Window.partitionBy("_rule", "_base", "_subject").orderBy(F.col("file").asc_nulls_first(), F.col("line").asc_nulls_first(), F.col("message").asc_nulls_first())
    numbered = keyed.withColumn("_ends", F.collect_set(F.when(F.col("_subject").rlike(r"#\d{1,9}$"), F.col("_subject"))).over(group)).withColumn("_nth", F.row_number().over(order) - 1)
    own = F.concat(F.col("_subject"), F.lit("#"))
    suffixes = F.transform(F.filter("_ends", lambda s: s.startswith(own)), lambda s: F.substring(s, F.length(own) + 1, F.length(s)))
    taken = F.array_sort(F.array_compact(F.transform(suffixes, lambda s: F.when(s.rlike(r"^\d{1,9}$"), s.cast("int")))))
    free = F.aggregate(taken, F.col("_nth"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    identity = F.when(F.col("_nth") > 0, F.concat(own, free.cast("string"))).otherwise(F.col("identity"))
    return numbered.withColumn("identity", identity).select(*VIOLATION.names)


def enrich(findings: DataFrame, rule_id: str | None = None, because: str | None = None, suggestion: str | None = None, docs: str | None = None, severity: str | None = None) -> DataFrame:
    """Stamp a rule's texts on findings that have none; one on the configuration is always an error."""
    for name, value in (("rule_id", rule_id), ("because", because), ("suggestion", suggestion), ("docs", docs), ("severity", severity)):
        if value is not None:
            findings = findings.withColumn(name, F.coalesce(name, F.lit(value)))
    return findings.withColumn("severity", F.when(bypass(), "error").otherwise(F.coalesce("severity", F.lit("error"))))


def exclude(findings: DataFrame, exact: list[str] | None = None, patterns: list[str] | None = None) -> DataFrame:
    """Without those whose element, file or message equals one of ``exact`` or contains a match of ``patterns``."""
    hits = [F.col(c).isin(*exact) for c in ("element", "file", "message") if exact] + [F.col(c).rlike(p) for c in ("element", "file", "message") for p in patterns or []]
    return findings.where(bypass() | ~or_(*hits))


def unused_exclusions(findings: DataFrame, exact: list[str]) -> DataFrame:
    """Exclusions that excluded nothing."""
    wanted = findings.sparkSession.createDataFrame([(x,) for x in exact], "exclusion string")
    seen = findings.select(F.explode(F.array("element", "file", "message")).alias("exclusion"))
    return wanted.join(seen, "exclusion", "left_anti")


def suppress(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Without those that a directive of their rule and file covers: the next line, or a closed block."""
    d = directives.select(F.col("rule_id").alias("_id"), F.col("file").alias("_file"), F.col("line").alias("_line"), "is_block", "end_line")
    covers = F.when(F.col("is_block"), F.col("line").between(F.col("_line"), F.col("end_line"))).otherwise(F.col("line") == F.col("_line") + 1)
    return findings.join(d, (F.col("rule_id") == F.col("_id")) & (F.col("file") == F.col("_file")) & two_valued(covers) & ~bypass(), "left_anti")


def orphan_directives(directives: DataFrame, rule_ids: list[str]) -> DataFrame:
    """Directives whose rule nobody declares."""
    return directives.where(~F.col("rule_id").isin(*rule_ids)) if rule_ids else directives


def dedupe_configuration(findings: DataFrame) -> DataFrame:
    """Findings about the configuration once for each file, rule and element, with their number."""
    own = [n for n in VIOLATION.names if n not in ("file", "rule", "element")]
    first = findings.where(bypass()).groupBy("file", "rule", "element").agg(F.min(F.struct("message", *[n for n in own if n != "message"])).alias("_v"), F.count("*").alias("_n"))
    rows = first.select("file", "rule", "element", "_n", "_v.*")
    text = F.when(F.col("_n") > 1, F.concat(F.col("message"), F.lit(" ("), F.col("_n").cast("string"), F.lit(" rules come from this one option)"))).otherwise(F.col("message"))
    return findings.where(~bypass()).select(*VIOLATION.names).unionByName(rows.withColumn("message", text).select(*VIOLATION.names))


def finding_hash(root: str = "") -> Column:
    """First 16 hex digits of the hash of rule and subject, with the root taken out."""
    text = F.concat(F.coalesce("rule", F.lit("")), F.lit("::"), subject())
    if root:
        text = F.regexp_replace(text, re.escape(root), "<root>")
    return F.substring(F.sha2(text, 256), 1, 16)


def subject_hash() -> Column:
    return F.substring(F.sha2(subject(), 256), 1, 16)


def baseline_of(findings: DataFrame, root: str = "") -> DataFrame:
    """Accepted findings, one row a hash, with the largest measured value."""
    rows = findings.where(~bypass()).withColumn("hash", finding_hash(root)).withColumn("subject", subject())
    return rows.groupBy("hash").agg(F.min("rule").alias("rule"), F.min("file").alias("file"), F.min("line").alias("line"), F.max("measured").alias("measured"), F.min("subject").alias("subject"))


def new_since(findings: DataFrame, baseline: DataFrame, root: str = "") -> DataFrame:
    """Findings that the baseline doesn't know, or that measure worse than what it accepted."""
    known = baseline.groupBy(F.col("hash").alias("_hash")).agg(F.max("measured").alias("_accepted"), F.lit(True).alias("_known"))
    rows = findings.withColumn("_hash", finding_hash(root)).join(known, "_hash", "left")
    worse = two_valued(F.col("measured") > F.col("_accepted"))
    return rows.where(bypass() | F.col("_known").isNull() | worse).select(*VIOLATION.names)


def baseline_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Hashes that were ``added`` to or ``removed`` from a baseline."""
    a, b = old.select("hash", F.lit(1).alias("_a")), new.select("hash", F.lit(1).alias("_b"))
    both = a.join(b, "hash", "full_outer").where("_a IS NULL OR _b IS NULL")
    return both.select("hash", F.when(F.col("_a").isNull(), "added").otherwise("removed").alias("change"))


def in_changed(findings: DataFrame, changed: DataFrame | None) -> DataFrame:
    """Findings in changed files (``file``); all of them where the changes aren't known."""
    if changed is None:
        return findings
    own = findings.where(~bypass()).join(changed.select("file").distinct(), "file", "left_semi").select(*VIOLATION.names)
    return own.unionByName(findings.where(bypass()))


def edge_coverage(population: DataFrame, edges: DataFrame) -> DataFrame:
    """Subjects of an allow-list rule and the edges that it tested."""
    tested = edges.join(population.select("file").distinct(), "file", "left_semi")
    return population.agg(F.count("*").alias("subjects")).crossJoin(tested.agg(F.count("*").alias("edges")))


def untested_rules(coverage: DataFrame) -> DataFrame:
    """Rules (``rule``, ``subjects``, ``edges``) that had subjects and tested no edge."""
    return coverage.where("subjects > 0 AND edges = 0")


def silent(exclusions: DataFrame) -> DataFrame:
    """Exclusions (``rule``, ``exclusion``) marked as meant to match nothing: they are left out of :func:`unused_exclusions`."""
    return exclusions.withColumn("silent", F.lit(True))


def loud_unused(exclusions: DataFrame, findings: DataFrame) -> DataFrame:
    """Exclusions of a table (``exclusion``, ``silent``) that excluded nothing and aren't silent."""
    seen = findings.select(F.explode(F.array("element", "file", "message")).alias("exclusion")).distinct()
    return exclusions.where(~two_valued(F.col("silent"))).join(seen, "exclusion", "left_anti")


def suppressed_by_comment(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """What :func:`suppress` takes away, counted by rule and file."""
    return findings.exceptAll(suppress(findings, directives).select(*findings.columns)).groupBy("rule_id", "file").agg(F.count("*").alias("n"))


def suppression_notice(hidden: DataFrame) -> DataFrame:
    """A line for people about each rule's hidden findings (``rule_id``, ``file``, ``n``)."""
    by_rule = hidden.groupBy("rule_id").agg(F.sum("n").alias("n"), F.count("*").alias("files"))
    return by_rule.select("rule_id", F.concat(F.col("n").cast("string"), F.lit(" findings are suppressed by comments in "), F.col("files").cast("string"), F.lit(" files")).alias("notice"))


def enclosing_scope(inner: DataFrame, scopes: DataFrame) -> DataFrame:
    """Each row of ``inner`` (``file``, ``line``) with the name of the innermost scope (``file``, ``name``, ``line``, ``end_line``) around it."""
    key = F.struct(*inner.columns)
    around = scopes.select(F.col("file").alias("_f"), F.col("name").alias("_n"), F.col("line").alias("_a"), F.col("end_line").alias("_b"))
    hit = inner.join(around, (F.col("file") == F.col("_f")) & F.col("line").between(F.col("_a"), F.col("_b")), "left")
    return hit.groupBy(key.alias("_k")).agg(F.max_by("_n", F.struct(F.col("_a"), -F.col("_b"))).alias("scope")).select("_k.*", "scope")
