"""Projects: source files as populations of facts, each the start of a rule.

A project is lazy; what a rule doesn't ask for is never parsed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import facts, syntax
from .rule import Rule, rule


@dataclass(frozen=True)
class Project:
    """``files`` has ``file``, ``text`` and the ``root`` each file belongs to."""

    files: DataFrame

    def modules(self, name: str = "rule") -> Rule:
        """A rule over source files: ``file``, ``name`` (without folders) and ``folder``."""
        return rule(self.files.withColumns({"name": F.regexp_extract("file", r"([^/]*)$", 1), "folder": F.regexp_replace("file", r"/?[^/]*$", ""), "line": F.lit(1)}), name)

    def functions(self, name: str = "rule", methods: bool = True, object_literals: bool = False) -> Rule:
        return rule(syntax.functions(self.files, methods, object_literals), name)

    def calls(self, name: str = "rule") -> Rule:
        return rule(syntax.calls(self.files), name)

    def classes(self, name: str = "rule") -> Rule:
        return rule(syntax.classes(self.files), name)

    def types(self, name: str = "rule") -> Rule:
        return rule(syntax.types(self.files), name)

    def edges(self) -> DataFrame:
        """``module_edges`` facts, relative specifiers resolved among the project's files."""
        return facts.resolve_relative(facts.import_edges(self.files), self.files)

    def within(self, calls: DataFrame, name: str = "rule") -> Rule:
        """A rule over the functions given to the selected calls."""
        chosen = calls.select("file", F.col("start").alias("call_start"))
        return rule(syntax.callbacks(self.files).join(chosen, ["file", "call_start"], "left_semi"), name)


_KNOWN: dict[tuple[str, str], Project] = {}


def project(spark: SparkSession, folder: str) -> Project:
    """The project of a folder, the same object for the same folder; a folder that doesn't exist is an error."""
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _KNOWN:
        _KNOWN[key] = Project(facts.text_files(spark, folder).withColumn("root", F.lit(key[1])))
    return _KNOWN[key]


def workspace(spark: SparkSession, *folders: str) -> Project:
    """Several projects as one, whatever their order; a file that two of them hold belongs to the first root by name."""
    parts = [project(spark, folder).files for folder in sorted({folder.rstrip("/") for folder in folders})]
    if len(parts) == 1:
        return Project(parts[0])
    every = reduce(DataFrame.unionByName, parts)
    return Project(every.groupBy("file").agg(F.min_by("text", "root").alias("text"), F.min("root").alias("root")))


def reset_project_cache() -> None:
    """Forget all projects, so that folders are listed again."""
    _KNOWN.clear()
