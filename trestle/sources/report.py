"""Sinks for findings: terminal text, JSON, continuous-integration annotations, and tables."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows(findings: DataFrame, most: int = 10_000) -> list[dict]:
    """Findings for people, in order, ``most`` at the most; :func:`write_table` keeps all."""
    return [r.asDict() for r in findings.orderBy("file", "line", "rule", "element", "message").limit(most).collect()]


def totals(findings: DataFrame) -> tuple[int, int]:
    """Number of all findings and of errors among them, counted by Spark."""
    row = findings.agg(F.count("*").alias("n"), F.count(F.when(F.coalesce("severity", F.lit("error")) == "error", 1)).alias("e")).first()
    return row["n"], row["e"]


def _counts(found: list[dict], counted: tuple[int, int] | None) -> tuple[int, int]:
    return counted or (len(found), sum((v["severity"] or "error") == "error" for v in found))


def remedy_repeats(message: Column, remedy: Column) -> Column:
    """Whether a remedy says no more than the message."""
    return F.coalesce(F.contains(F.lower(message), F.lower(F.trim(remedy))), F.lit(False))


def plain(found: list[dict], counted: tuple[int, int] | None = None) -> str:
    """Findings as text; ``counted`` is how many there are in all where only the first are shown."""
    lines = []
    for v in found:
        where = f"{v['file']}:{v['line']}" if v["line"] is not None else v["file"] or "-"
        lines.append(f"{v['severity'] or 'error'}  {where}  {v['element']}: {v['message']}")
        lines += [f"    {label}: {v[name]}" for name, label in (("because", "why"), ("suggestion", "fix"), ("docs", "docs")) if v[name] and v[name] != v["message"]]
    total, errors = _counts(found, counted)
    shown = f", the first {len(found)} shown" if total > len(found) else ""
    return "\n".join([*lines, f"{total} findings, {errors} errors{shown}"])


def terminal(found: list[dict], counted: tuple[int, int] | None = None) -> str:
    text = plain(found, counted)
    return text.replace("error  ", "\x1b[31merror\x1b[0m  ").replace("warn  ", "\x1b[33mwarn\x1b[0m  ")


def as_json(found: list[dict], counted: tuple[int, int] | None = None, reason: str | None = None) -> str:
    total, errors = _counts(found, counted)
    return json.dumps({"summary": {"total": total, "errors": errors, "warnings": total - errors, "reason": reason}, "violations": found}, sort_keys=True)


def escape(text: str, attribute: bool = False) -> str:
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *((( ":", "%3A"), (",", "%2C")) if attribute else ())):
        text = text.replace(a, b)
    return text


def annotations(found: list[dict], counted: tuple[int, int] | None = None) -> str:
    """Workflow commands, one a finding."""
    out = []
    for v in found:
        kind = "error" if (v["severity"] or "error") == "error" else "warning"
        place = [f"file={escape(v['file'], True)}"] if v["file"] else []
        place += [f"line={v['line']}"] if v["line"] is not None else []
        out.append(f"::{kind} {','.join([*place, f'title={escape(v['rule'] or '', True)}'])}::{escape(v['message'] or '')}")
    return "\n".join(out)


def detect_format() -> str:
    return "annotations" if os.environ.get("GITHUB_ACTIONS") == "true" else "terminal"


def report(findings: DataFrame, fmt: str | None = None) -> str:
    return render(findings, fmt)[0]


def render(findings: DataFrame, fmt: str | None = None) -> tuple[str, int]:
    """The report and the number of errors; totals are of all findings, of which the first are shown."""
    kept = findings.persist()
    try:
        counted = totals(kept)
        return {"terminal": terminal, "plain": plain, "json": as_json, "annotations": annotations}[fmt or detect_format()](rows(kept), counted), counted[1]
    finally:
        kept.unpersist()


def write_table(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").parquet(path)


def code_frame(text: Column, line: Column, around: int = 2) -> Column:
    """The lines around a line, numbered, with a mark on it."""
    lines = F.split(text, "\n")
    first = F.greatest(line - around, F.lit(1))
    numbers = F.sequence(first, F.least(line + around, F.size(lines)))
    return F.when((line >= 1) & (line <= F.size(lines)), F.array_join(F.transform(numbers, lambda n: F.concat(F.when(n == line, "> ").otherwise("  "), n.cast("string"), F.lit(" | "), F.get(lines, n - 1))), "\n"))
