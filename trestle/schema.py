"""The table of findings, and the names of the fact tables' columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VIOLATION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("rule", "rule_id", "element", "file")]
    + [T.StructField("line", T.IntegerType()), T.StructField("message", T.StringType()), T.StructField("identity", T.StringType()), T.StructField("measured", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("because", "code_frame", "suggestion", "docs", "severity")]
    + [T.StructField("bypass_filters", T.BooleanType())]
)


def to_violations(df: DataFrame, element: Column | str, message: Column, *, file: Column | str | None = None, line: Column | str | None = None, identity: Column | None = None, measured: Column | None = None) -> DataFrame:
    """Project rows that break a rule onto the schema of findings.

    Columns without a value stay null until a rule stamps them; ``identity`` defaults
    to ``element::message`` later, so that a line that moves changes nothing.
    """
    given = {
        "element": F.col(element) if isinstance(element, str) else element,
        "file": F.col(file) if isinstance(file, str) else file,
        "line": F.col(line) if isinstance(line, str) else line,
        "message": message,
        "identity": identity,
        "measured": measured,
        "bypass_filters": F.lit(False),
    }
    cols = []
    for field in VIOLATION.fields:
        value = given.get(field.name)
        cols.append((F.lit(None) if value is None else value).cast(field.dataType).alias(field.name))
    return df.select(*cols)
