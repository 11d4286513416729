"""Command line: ``python -m trestle.cli check|baseline|explain|doctor|init RULES...``.

A rules file is Python with a function ``rules(spark)`` that returns rules. A file
that can't be loaded is a finding, not a crash.
"""

from __future__ import annotations

import argparse
import importlib.util
import json
import os
import sys
import traceback

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import findings as f
from .plans.rule import Rule, check_all, diagnose
from .schema import to_violations
from .sources import facts, report

TEMPLATE = '''"""Rules for this project."""

from trestle.functions import predicates as p
from trestle.operators import conditions as c
from trestle.plans.rule import rule


def rules(spark):
    modules = spark.read.parquet("facts/modules.parquet")
    return [rule(modules, "names are lower case").should(c.element_condition("be lower case", p.have_name_matching("^[a-z.-]+$"))).stamped(rule_id="names")]
'''


def load(spark: SparkSession, paths: list[str]) -> tuple[list[Rule], DataFrame | None]:
    """Rules of all files, and findings about files that don't load."""
    found, broken = [], []
    for path in paths:
        try:
            spec = importlib.util.spec_from_file_location(f"rules_{len(found)}", path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            found += module.rules(spark)
        except Exception:  # a rules file may fail in any way; what it said becomes the finding
            broken.append((path, traceback.format_exc(limit=-1).strip().splitlines()[-1]))
    if not broken:
        return found, None
    rows = spark.createDataFrame(broken, "file string, why string")
    return found, to_violations(rows, "file", F.concat(F.lit("can't be loaded: "), F.col("why")), file="file").withColumns({"rule": F.lit("configuration"), "severity": F.lit("error"), "bypass_filters": F.lit(True)})


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trestle", description=__doc__)
    parser.add_argument("command", choices=["check", "baseline", "explain", "doctor", "init"])
    parser.add_argument("rules", nargs="*")
    parser.add_argument("--baseline")
    parser.add_argument("--changed", help="file with one changed path a line")
    parser.add_argument("--format", choices=["terminal", "plain", "json", "annotations"])
    o = parser.parse_args(args)
    if o.command == "init":
        path = o.rules[0] if o.rules else "trestle_rules.py"
        if os.path.exists(path):
            print(f"{path} exists", file=sys.stderr)
            return 1
        with open(path, "w") as out:
            out.write(TEMPLATE)
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    rules, broken = load(spark, o.rules)
    if o.command == "explain":
        print(json.dumps([{"rule": r.name, **r.stamps, "conditions": [c.description for c in r.conditions]} for r in rules], indent=1))
        return 0
    if o.command == "doctor":
        told = diagnose(rules)
        print("\n".join(f"{name}: {what}" for name, what in told) or "nothing to report")
        return int(bool(told))
    if not rules and broken is None:
        print("no rules", file=sys.stderr)
        return 1
    changed = spark.read.text(o.changed).withColumnRenamed("value", "file") if o.changed else None
    known = facts.read_baseline(spark, o.baseline) if o.baseline and o.command == "check" else None
    left = check_all(rules, known, changed) if rules else broken
    left = left.unionByName(broken) if rules and broken is not None else left
    if o.command == "baseline":
        n = facts.write_baseline(f.baseline_of(left), o.baseline or "trestle-baseline.json")
        print(f"{n} findings accepted")
        return 0
    text, errors = report.render(left, o.format)
    print(text)
    return int(errors > 0)


if __name__ == "__main__":
    sys.exit(main())
