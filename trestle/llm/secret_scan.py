"""Secret scans: one combined deterministic automaton over all rules.

The rules' expressions become one automaton (subset construction, then
minimisation into transition arrays) that reads every byte of every text once.
Only texts in which it accepts are searched for the exact spans.

Defined results: a null or empty text has no secrets; a text of any length is
read whole; repeated rows are reported each; spans of one rule are leftmost,
longest and don't overlap; a private key is its whole block, and without an END
line the base64 pieces after the header (and one short piece behind them). Other
columns of the input are left alone.
"""

from __future__ import annotations

import hashlib
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import SpanFinder, compile_patterns, scan
from .common import ship, text_bytes

Rule = tuple[str, str, str]

_TOKEN = "[0-9A-Za-z_/+.-]"

#: the rules as the SQL has them; they miss tokens behind any of ``_/+.-``, schemes with ``+``, ``.`` or ``-``, and passwords without a user
SQL_RULES: list[Rule] = [
    ("aws_access_key", "(?:AKIA|ASIA)[0-9A-Z]{16}", _TOKEN),
    ("github_token", "gh[pousr]_[0-9A-Za-z]{36}", _TOKEN),
    ("slack_token", "xox[abeprs]-[0-9A-Za-z-]{10,}", _TOKEN),
    ("google_api_key", "AIza[0-9A-Za-z_-]{35}", _TOKEN),
    ("stripe_key", "[rs]k_(?:live|test)_[0-9A-Za-z]{16,}", _TOKEN),
    ("json_web_token", r"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}", _TOKEN),
    ("private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "[-]"),
    ("url_password", r"[a-z][a-z0-9]*://[0-9A-Za-z._-]+:[^ \t\n\r:/@]+@", _TOKEN),
    (
        "assigned_secret",
        "(?:[aA][pP][iI][_-]?[kK][eE][yY]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[pP][aA][sS][sS][wW][oO][rR][dD])"
        "[\"']?[ \\t]*[:=][ \\t]*[\"']?[0-9A-Za-z_/+.-]{8,}",
        "[0-9A-Za-z]",
    ),
]

_WIDER = {"url_password": r"[a-z][a-z0-9+.-]*://[0-9A-Za-z._-]*:[^ \t\n\r:/@]+@"}
#: name, expression, and the class of bytes that may not stand before a match
RULES: list[Rule] = [(n, _WIDER.get(n, p), "[0-9A-Za-z]" if g == _TOKEN else g) for n, p, g in SQL_RULES]

_BREAK = r"(?:[ \t\r\n]|\\[nr])*"
#: what a match goes on with, where its rule's expression is only the beginning; optional, so that a text matches or not by the rule alone
TAILS = {
    "private_key": "(?:(?:-{0,4}[^-])*-----END (?:[A-Z]+ )*PRIVATE KEY-----"
    + f"|(?:{_BREAK}(?:Proc-Type|DEK-Info): [^\r\n]*)*(?:{_BREAK}[0-9A-Za-z+/=]{{16,}})+{_BREAK}[0-9A-Za-z+/]*={{0,2}})?",
}

#: what the automaton looks for instead of a whole match, where counting from every possible start would need too many states; the spans are searched for with the whole expression
STARTS = {
    "aws_access_key": "(?:AKIA|ASIA)[0-9A-Z]{4}",
    "github_token": "gh[pousr]_[0-9A-Za-z]{4}",
    "slack_token": "xox[abeprs]-",
    "google_api_key": "AIza",
    "stripe_key": "[rs]k_(?:live|test)_",
    "json_web_token": r"eyJ[0-9A-Za-z_-]{5}",
}


@cache
def _compiled(rules: tuple[Rule, ...]):
    return compile_patterns([STARTS.get(n, p) for n, p, _ in rules], guards=[g for _, _, g in rules]), [SpanFinder(p + TAILS.get(n, ""), g) for n, p, g in rules]


def _engine(spark: SparkSession, rules: list[Rule]):
    """The compiled rules, shipped; their size depends on the rules alone."""
    return ship(spark, _compiled(tuple(rules)))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """One row for each document and rule that occurs in it.

    Columns: the id, ``rule``, ``n_matches`` and ``first_sha256``, the hash of
    the first match (the secret itself isn't repeated).
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = [n for n, _, _ in rules]
    id_type = narrow.schema["id"].dataType
    engine = _engine(docs.sparkSession, rules)

    def run(batches):
        automaton, finders = engine()
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            buf, starts, ends = text_bytes(text)
            masks = scan(automaton, buf, starts, ends)
            rows, rule, count, digest = [], [], [], []
            for i in masks.nonzero()[0].tolist():
                raw = buf[starts[i] : ends[i]].tobytes()
                for k, name in enumerate(names):
                    if masks[i] >> k & 1:
                        spans = finders[k].spans(raw)
                        if not spans:
                            continue
                        rows.append(i)
                        rule.append(name)
                        count.append(len(spans))
                        digest.append(hashlib.sha256(raw[slice(*spans[0])]).hexdigest())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(rule, pa.string()), pa.array(count, pa.int64()), pa.array(digest, pa.string())], names=["id", "rule", "n_matches", "first_sha256"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("rule", T.StringType()), T.StructField("n_matches", T.LongType()), T.StructField("first_sha256", T.StringType())])
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def merged_spans(raw: bytes, mask: int, finders: list[SpanFinder], names: list[str]) -> list[tuple[int, int, str]]:
    """Union of the spans of all rules in ``mask``; an overlap bears the name of the rule that starts first."""
    spans = sorted((s, e, k) for k, f in enumerate(finders) if mask >> k & 1 for s, e in f.spans(raw))
    out: list[tuple[int, int, str]] = []
    for s, e, k in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]), out[-1][2])
        else:
            out.append((s, e, names[k]))
    return out


def redacted(spark: SparkSession, text: Column, rules: list[Rule] = RULES) -> Column:
    """``text`` with every secret replaced by ``[secret:RULE]``; null stays null."""
    names = [n for n, _, _ in rules]

    engine = _engine(spark, rules)

    @F.arrow_udf(T.StringType())
    def run(column: pa.Array) -> pa.Array:
        automaton, finders = engine()
        buf, starts, ends = text_bytes(column)
        masks = scan(automaton, buf, starts, ends)
        hit = masks.nonzero()[0]
        if not len(hit):
            return column
        out = column.to_pylist()
        for i in hit.tolist():
            raw = buf[starts[i] : ends[i]].tobytes()
            parts, at = [], 0
            for s, e, name in merged_spans(raw, int(masks[i]), finders, names):
                parts += [raw[at:s], f"[secret:{name}]".encode()]
                at = e
            out[i] = b"".join([*parts, raw[at:]]).decode()
        return pa.array(out, pa.string())

    return run(text)


def oracle(rules: list[Rule] = SQL_RULES) -> str:
    """DuckDB SQL for the rows of :func:`find_secrets` over ``documents``; narrower than they are where :data:`SQL_RULES` says so, and for a private key it hashes the header line alone."""
    each = []
    for name, pattern, guard in rules:
        p = f"(?:^|[^{guard[1:-1]}])({pattern})".replace("'", "''")
        each.append(f"SELECT doc_id, '{name}' AS rule, CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS n_matches, sha256(regexp_extract(text, '{p}', 1)) AS first_sha256 FROM documents WHERE regexp_matches(text, '{p}')")
    return "\nUNION ALL\n".join(each)
