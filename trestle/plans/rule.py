"""The fluent rule: population, predicates, conditions, and what becomes of the findings.

A rule is immutable and lazy: each method gives a new one, ``violations`` a plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import not_, two_valued
from ..operators import findings as f
from ..operators.conditions import Condition
from ..schema import VIOLATION, to_violations


class RuleError(AssertionError):
    """A checked rule has findings."""

    def __init__(self, rows: list, total: int | None = None):
        self.findings, self.total = rows, len(rows) if total is None else total
        super().__init__("\n".join(f"{r['element']}: {r['message']}" for r in rows[:20]) + (f"\nand {self.total - 20} more" if self.total > 20 else ""))


@dataclass(frozen=True)
class Rule:
    population: DataFrame
    name: str = "rule"
    predicates: tuple[Column, ...] = ()
    conditions: tuple[Condition, ...] = ()
    asserting: bool = False
    late_predicate: bool = False
    empty_expected: bool = False
    stamps: dict = field(default_factory=dict)
    exact: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    directives: DataFrame | None = None

    def that(self, *predicates: Column) -> Rule:
        """Narrow the population; a predicate after :meth:`should` is a mistake that becomes a finding."""
        return replace(self, predicates=self.predicates + predicates, late_predicate=self.late_predicate or self.asserting)

    def that_not(self, predicate: Column) -> Rule:
        return self.that(not_(predicate))

    def should(self, *conditions: Condition) -> Rule:
        return replace(self, conditions=self.conditions + conditions, asserting=True)

    and_should = should

    def expect_empty(self) -> Rule:
        return replace(self, empty_expected=True)

    def named(self, name: str) -> Rule:
        return replace(self, name=name)

    def stamped(self, **texts: str) -> Rule:
        """``rule_id``, ``because``, ``suggestion``, ``docs``, ``severity``."""
        return replace(self, stamps=self.stamps | texts)

    def because(self, text: str) -> Rule:
        return self.stamped(because=text)

    def excluding(self, *exact: str, matching: tuple[str, ...] = ()) -> Rule:
        return replace(self, exact=self.exact + exact, patterns=self.patterns + tuple(matching))

    def suppressed_by(self, directives: DataFrame) -> Rule:
        return replace(self, directives=directives)

    def selected(self) -> DataFrame:
        return reduce(lambda df, p: df.where(two_valued(p)), self.predicates, self.population)

    def _configuration(self, rows: DataFrame, message: str) -> DataFrame:
        return to_violations(rows, F.lit(self.name), F.lit(message)).withColumn("bypass_filters", F.lit(True))

    def guard(self, selected: DataFrame) -> DataFrame | None:
        """Findings about the rule itself: nothing asserted, a late predicate, or a population that is (or isn't) empty."""
        one = self.population.sparkSession.range(1)
        if not self.conditions:
            return self._configuration(one, "the rule asserts nothing")
        if self.late_predicate:
            return self._configuration(one, "a predicate stands after should")
        empty = selected.limit(1).agg(F.count("*").alias("n"))
        if self.empty_expected:
            return self._configuration(empty.where("n > 0"), "expected to select nothing, and selects something")
        if all(c.cardinality for c in self.conditions):
            return None
        return self._configuration(empty.where("n = 0"), "selects nothing")

    def raw(self) -> DataFrame:
        """Findings of all conditions over the same population."""
        selected = self.selected()
        guard = self.guard(selected)
        parts = [] if guard is None else [guard]
        if self.conditions and not self.late_predicate:
            parts += [c.evaluate(selected) for c in self.conditions]
        return reduce(DataFrame.unionByName, parts).withColumn("rule", F.coalesce("rule", F.lit(self.name))).select(*VIOLATION.names)

    def violations(self, baseline: DataFrame | None = None, changed: DataFrame | None = None) -> DataFrame:
        """The plan that yields what is left of the findings."""
        rows = f.enrich(f.disambiguate(self.raw()), **self.stamps)
        rows = f.exclude(rows, list(self.exact), list(self.patterns))
        if self.directives is not None:
            rows = f.suppress(rows, self.directives)
        if baseline is not None:
            rows = f.new_since(rows, baseline)
        return f.in_changed(rows, changed)

    def check(self, baseline: DataFrame | None = None, changed: DataFrame | None = None, most: int = 1000) -> None:
        """Raise where anything is left: the error has ``most`` findings at most and the number of all, which are counted where they are more."""
        _raise(self.violations(baseline, changed), most)

    def warn(self, baseline: DataFrame | None = None, changed: DataFrame | None = None) -> DataFrame:
        """Findings as warnings; those about the configuration still raise."""
        found = self.violations(baseline, changed)
        _raise(found.where(f.bypass()), 1000)
        return found.withColumn("severity", F.lit("warn"))


def _raise(found: DataFrame, most: int) -> None:
    rows = found.limit(most).collect()
    if rows:
        raise RuleError(rows, len(rows) if len(rows) < most else found.count())


def rule(population: DataFrame, name: str = "rule") -> Rule:
    return Rule(population, name)


def collect_violations(rules: list[Rule]) -> DataFrame:
    return reduce(DataFrame.unionByName, [r.violations() for r in rules])


def check_all(rules: list[Rule], baseline: DataFrame | None = None, changed: DataFrame | None = None) -> DataFrame:
    """Findings of all rules as one plan: united, configuration findings once, then baseline and changed files."""
    rows = f.dedupe_configuration(collect_violations(rules))
    if baseline is not None:
        rows = f.new_since(rows, baseline)
    return f.in_changed(rows, changed)


def diagnose(rules: list[Rule]) -> list[tuple[str, str]]:
    """Static audit: (rule, what is wrong) without running anything."""
    out, seen = [], set()
    for r in rules:
        if not r.conditions:
            out.append((r.name, "asserts nothing"))
        if r.late_predicate:
            out.append((r.name, "predicate after should"))
        if not r.stamps.get("rule_id"):
            out.append((r.name, "has no id"))
        elif r.stamps["rule_id"] in seen:
            out.append((r.name, "shares its id"))
        seen.add(r.stamps.get("rule_id"))
        if not r.stamps.get("because"):
            out.append((r.name, "gives no reason"))
    return out
