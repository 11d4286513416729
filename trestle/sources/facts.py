"""Producers of facts: markup elements, import edges and directives from text, and the baseline's JSON."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import col

_TAG = r"<([a-zA-Z][\w.-]*)((?:\s+[\w:-]+(?:=(?:\"[^\"]*\"|'[^']*'|\{[^}]*\}))?)*)\s*(/?)>"
_ATTRIBUTE = r"([\w:-]+)(?:=(?:\"([^\"]*)\"|'([^']*)'|\{([^}]*)\}))?"
BASELINE = T.StructType([T.StructField(n, T.StringType()) for n in ("rule", "file")] + [T.StructField("line", T.IntegerType()), T.StructField("hash", T.StringType()), T.StructField("measured", T.DoubleType()), T.StructField("subject", T.StringType())])


def _attributes(text: Column) -> Column:
    """Map of attributes; one without a value is a key with null, the first of a name counts."""
    each = F.regexp_extract_all(text, F.lit(_ATTRIBUTE), F.lit(0))
    pairs = F.transform(each, lambda x: F.struct(F.regexp_extract(x, r"^([\w:-]+)", 1).alias("k"), F.when(x.contains("="), F.regexp_replace(F.regexp_extract(x, r"(?s)=(.*)$", 1), r"^[\"'{]|[\"'}]$", "")).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.get(F.filter(pairs, lambda p: p["k"] == n), 0)["v"]))


def markup_elements(pages: DataFrame, file_col: str = "url", html_col: str = "html") -> DataFrame:
    """``jsx_elements`` facts of pages: opening and self-closing tags with their attributes."""
    tags = pages.select(F.col(file_col).alias("file"), F.posexplode(F.regexp_extract_all(html_col, F.lit(_TAG), F.lit(0))).alias("el_id", "_tag"))
    tag = F.regexp_extract("_tag", r"^<([\w.-]+)", 1)
    inside = F.regexp_extract("_tag", r"(?s)^<[\w.-]+(.*?)/?>$", 1)
    return tags.select("file", F.col("el_id").cast("long").alias("el_id"), tag.alias("tag"), (F.lower(tag) == tag).alias("is_html"), _attributes(inside).alias("attributes"), (~F.col("_tag").endswith("/>")).alias("has_children"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``text`` of every file below a folder."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


#: strings, comments, and what is between them
_TOKEN = r"(?s)\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/|[^\"'`/]+|."
_EDGES = [
    ("re-export", r"(?m)^[ \t]*export\s+(?:type\s+)?(?:\*(?:\s+as\s+\w+)?|\{[^}]*\})\s+from\s+[\"'][^\"']+[\"']"),
    ("import", r"(?m)^[ \t]*import\s+(?:[^\"';]+?\s+from\s+)?[\"'][^\"']+[\"']"),
    ("dynamic", r"\bimport\(\s*[\"'`][^\"'`$]+[\"'`]\s*\)"),
    ("require", r"\brequire\(\s*[\"'][^\"']+[\"']\s*\)"),
]


def _tokens(text: Column, keep) -> Column:
    """Text in which the tokens that ``keep`` is false for are blank; lines stay where they are."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda x: F.when(keep(x), x).otherwise(F.regexp_replace(x, r"[^\n]", " "))), "")


def _is_comment(x: Column) -> Column:
    return x.startswith("//") | (x.startswith("/*") & (F.length(x) > 3))


def code_only(text: Column | str) -> Column:
    """Text without comments, and without strings that no module could be named by (with spaces or brackets)."""
    return _tokens(col(text), lambda x: ~_is_comment(x) & ~(x.rlike(r"^[\"'`]") & x.rlike(r"(?s)^.(?=.*[\s()$]).*.$")))


def comments_only(text: Column | str) -> Column:
    """Text with its comments alone."""
    return _tokens(col(text), _is_comment)


def _newlines(x: Column) -> Column:
    return F.length(x) - F.length(F.regexp_replace(x, "\n", ""))


def import_edges(files: DataFrame) -> DataFrame:
    """``module_edges`` facts by the lexer: what is imported, how, in which line, and whether only types are; paths stay unresolved."""
    code = files.select("file", code_only("text").alias("_code"))

    def sites(kind: str, regex: str) -> Column:
        found = F.regexp_extract_all("_code", F.lit(regex), F.lit(0))
        before = F.zip_with(F.split("_code", regex, -1), F.concat(F.array(F.lit("")), found), lambda gap, match: _newlines(F.concat(F.coalesce(match, F.lit("")), F.coalesce(gap, F.lit("")))))
        line = lambda i: F.aggregate(F.slice(before, 1, i + 1), F.lit(1), lambda a, x: a + x)
        return F.transform(found, lambda text, i: F.struct(F.lit(kind).alias("kind"), text.alias("text"), line(i).alias("line")))

    rows = code.select("file", F.explode(F.concat(*[sites(kind, regex) for kind, regex in _EDGES])).alias("e")).select("file", "e.kind", F.col("e.text").alias("_text"), "e.line")
    names = F.filter(F.transform(F.split(F.regexp_extract("_text", r"(?s)\{([^}]*)\}", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    all_types = (F.size(names) > 0) & F.forall(names, lambda n: n.startswith("type "))
    whole = F.col("_text").rlike(r"^\s*(import|export)\s+type\b")
    return rows.select("file", "kind", F.regexp_extract("_text", r"[\"'`]([^\"'`]+)[\"'`]", 1).alias("specifier"), F.lit(None).cast("string").alias("resolved_path"), "line", (whole | all_types).alias("type_only"), whole.alias("erases_request"), names.alias("names"))


def normal_path(path: Column) -> Column:
    """A path with ``.`` and ``..`` folded, however many; null where it climbs above its start."""
    folded = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == ".", done).when((x == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
    )
    return F.when(~F.array_contains(folded, ".."), F.array_join(folded, "/"))


def resolve_relative(edges: DataFrame, modules: DataFrame, extensions: tuple[str, ...] = ("", ".ts", ".tsx", ".js", "/index.ts")) -> DataFrame:
    """Fill ``resolved_path`` of relative specifiers where a module of that path is known; the first of ``extensions`` that fits counts."""
    folder = F.regexp_replace("file", r"/?[^/]*$", "")
    asked = edges.where(F.col("specifier").startswith(".")).select(folder.alias("_folder"), F.col("specifier").alias("_specifier")).distinct()
    flat = normal_path(F.concat(F.col("_folder"), F.lit("/"), F.regexp_replace("_specifier", r"\.js$", "")))
    tries = asked.select("_folder", "_specifier", F.posexplode(F.array(*[F.concat(flat, F.lit(x)) for x in extensions])).alias("_nth", "_path"))
    known = modules.select(F.col("file").alias("_path")).distinct()
    best = tries.join(known, "_path").groupBy("_folder", "_specifier").agg(F.min_by("_path", "_nth").alias("_found"))
    both = edges.join(best, (folder == F.col("_folder")) & (F.col("specifier") == F.col("_specifier")), "left")
    return both.withColumn("resolved_path", F.coalesce("_found", "resolved_path")).select(*edges.columns)


def directives(files: DataFrame, marker: str = "rule-exclude") -> DataFrame:
    """Suppression comments: ``// MARKER id: reason`` for the next line, ``MARKER-start id`` to ``MARKER-end``; a block that isn't closed has no end.

    A directive is a comment: the same words in a string are none.
    """
    lines = files.select("file", F.posexplode(F.split(comments_only("text"), "\n")).alias("line", "_t")).withColumn("line", F.col("line") + 1)
    kind = F.regexp_extract("_t", rf"//\s*{marker}(-start|-end|)(?=\s|$)", 1)
    hits = lines.where(F.col("_t").rlike(rf"//\s*{marker}(-start|-end|)(\s|$)")).withColumn("_kind", kind)
    fields = hits.withColumn("rule_id", F.regexp_extract("_t", rf"{marker}(?:-start)?\s+([\w./-]+)", 1)).withColumn("reason", F.trim(F.regexp_extract("_t", r"[\w./-]+:\s*(.*)$", 1)))
    ends = hits.where("_kind = '-end'").select(F.col("file").alias("_f"), F.col("line").alias("_end"))
    starts = fields.where("_kind <> '-end'")
    closed = starts.join(ends, (starts["file"] == ends["_f"]) & (ends["_end"] > starts["line"]) & (starts["_kind"] == "-start"), "left")
    return closed.groupBy("rule_id", "reason", "file", "line", (F.col("_kind") == "-start").alias("is_block")).agg(F.min("_end").alias("end_line"))


def discover(files: DataFrame, marker: str, path: str = "file") -> DataFrame:
    """Folders that hold a file of a given name: boundaries found rather than listed."""
    return files.where(F.col(path).endswith("/" + marker)).select(F.regexp_replace(F.col(path), r"/[^/]*$", "").alias("folder")).distinct()


def path_universe(files: DataFrame, path: str = "file") -> DataFrame:
    """All paths that a glob could mean: files and the folders above them."""
    parts = F.split(col(path), "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.select(F.explode(folders).alias("path")).where("path <> ''").distinct()


def schema_elements(files: DataFrame, text: str = "text") -> DataFrame:
    """``schema_elements`` facts from schema definition text: a row for each type, and one for each of its fields."""
    bare = F.regexp_replace(F.regexp_replace(col(text), r'(?s)"""(.*?)"""', ""), r"#[^\n]*", "")
    types = files.select(F.explode(F.regexp_extract_all(bare, F.lit(r"(?s)\b(?:type|input|interface)\s+\w+[^{]*\{[^}]*\}"), F.lit(0))).alias("_t"))
    body = F.regexp_extract("_t", r"(?s)\{(.*)\}", 1)
    fields = F.regexp_extract_all(body, F.lit(r"\w+\s*(?:\([^)]*\))?\s*:\s*[\[\]\w!]+"), F.lit(0))
    rows = types.select(F.regexp_extract("_t", r"^\w+\s+(\w+)", 1).alias("type_name"), fields.alias("_fields"))
    rows = rows.withColumn("type_fields", F.transform("_fields", lambda x: F.regexp_extract(x, r"^(\w+)", 1)))
    args = F.regexp_extract_all(F.regexp_extract("_f", r"\(([^)]*)\)", 1), F.lit(r"(\w+)\s*:"), F.lit(1))
    each = rows.select("type_name", F.explode("_fields").alias("_f"), "type_fields").select("type_name", F.regexp_extract("_f", r"^(\w+)", 1).alias("field_name"), F.regexp_extract("_f", r":\s*([\[\]\w!]+)$", 1).alias("field_type"), args.alias("args"), "type_fields")
    none = F.lit(None).cast("string")
    return rows.select("type_name", none.alias("field_name"), none.alias("field_type"), F.array().cast("array<string>").alias("args"), "type_fields").unionByName(each)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Accepted findings from the JSON that :func:`write_baseline` writes; a file that is absent or of another shape is empty."""
    try:
        text = spark.read.text(path, wholetext=True).first()
        rows = json.loads(text[0])["violations"]
        return spark.createDataFrame([tuple(r.get(n) for n in BASELINE.names) for r in rows], BASELINE)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and not isinstance(e, (ValueError, KeyError, TypeError, AttributeError)):
            raise
        return spark.createDataFrame([], BASELINE)


def write_baseline(baseline: DataFrame, path: str) -> int:
    """Write a baseline as one JSON document on the driver (it is read by people); returns its size."""
    rows = sorted((r.asDict() for r in baseline.select(*BASELINE.names).collect()), key=lambda r: r["hash"])
    with open(path, "w") as out:
        json.dump({"hashVersion": 1, "generatedAt": datetime.datetime.now(datetime.timezone.utc).isoformat(), "count": len(rows), "violations": rows}, out, indent=1)
    return len(rows)
