"""Queries of facts from source text: each row of a table is written as a source file, whose facts are then read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..operators import conditions as c
from ..sources import facts, syntax
from .catalogue import dealt, query, table
from .project import Project


def _sources(spark, d) -> DataFrame:
    """A file for each part: an import, a function with a branch for the larger ones, an arrow function, a class, a literal with a handler, an interface, and calls.

    Parts are a few bytes each and their texts take long to parse, so the rows are dealt out
    before they are written: their file alone would make a single task of a million texts.
    """
    part = dealt(table(spark, d, "part").select("p_partkey", "p_size"))
    key = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("import { a } from './"), key, F.lit("'\n// call(nothing)\nexport function make"), key, F.lit("(id: string, n = 1) {\n"),
        F.when(F.col("p_size") > 25, "  if (n && id) { return store.items.find(id) }\n").otherwise(""),
        F.lit("  return load('"), key, F.lit("')\n}\nconst twice = async (x: number) => x * 2\nexport class Box"), key,
        F.lit(" extends Base {\n  private open(a: string): void { app.get('/x', (req, res) => { res.send(a) }) }\n}\n"),
        F.lit("const routes = { '/p': { GET: () => 1 } }\nexport interface Row { readonly id: string; size: number }\n"),
    )
    return part.select(F.concat(F.lit("src/"), key, F.lit(".ts")).alias("file"), text.alias("text"))


_BIG = "CASE WHEN p_size > 25 THEN 1 ELSE 0 END"
_FILE = "'src/' || p_partkey || '.ts' AS file"


@query("collect_functions", f"""
SELECT {_FILE}, 'make' || p_partkey AS name, 'declaration' AS origin, true AS exported, false AS is_async, 2 AS n_params, 1 + 2 * {_BIG} AS cc, 3 AS line, 5 + {_BIG} AS end_line FROM part
UNION ALL SELECT {_FILE}, 'twice', 'arrow', false, true, 1, 1, 6 + {_BIG}, 6 + {_BIG} FROM part
UNION ALL SELECT {_FILE}, 'Box' || p_partkey || '.open', 'method', true, false, 1, 1, 8 + {_BIG}, 8 + {_BIG} FROM part
UNION ALL SELECT {_FILE}, 'routes["/p"].GET', 'object_literal', false, false, 0, 1, 10 + {_BIG}, 10 + {_BIG} FROM part""")
def collect_functions(spark, d):
    """Functions of all four origins, with parameters, complexity and lines."""
    return syntax.functions(_sources(spark, d), object_literals=True).select("file", "name", "origin", "exported", "is_async", F.size("params").alias("n_params"), "cc", "line", "end_line")


@query("collect_calls", f"""
SELECT {_FILE}, 'store.items' AS object, 'find' AS method, 1 AS n_args, 'store.items.find' AS name, 4 AS line FROM part WHERE p_size > 25
UNION ALL SELECT {_FILE}, NULL, 'load', 1, 'load(''' || p_partkey || ''')', 4 + {_BIG} FROM part
UNION ALL SELECT {_FILE}, 'app', 'get', 2, 'app.get(''/x'')', 8 + {_BIG} FROM part
UNION ALL SELECT {_FILE}, 'res', 'send', 1, 'res.send', 8 + {_BIG} FROM part""")
def collect_calls(spark, d):
    """Calls split into object and method, named with their first argument where it is a string."""
    return syntax.calls(_sources(spark, d)).select("file", "object", "method", F.size("args").alias("n_args"), syntax.with_argument(0).alias("name"), "line")


@query("extract_callbacks", f"SELECT {_FILE}, 1 AS arg_index, 2 AS n_params, '{{ res.send(a) }}' AS body FROM part")
def extract_callbacks(spark, d):
    """Functions within the calls of ``app.get``."""
    project = Project(_sources(spark, d))
    chosen = project.calls().that(p.on_object("app"), p.with_method("get")).selected()
    return project.within(chosen).selected().select("file", "arg_index", F.size("params").alias("n_params"), "body")


@query("functions_without_find", f"SELECT {_FILE}, 'make' || p_partkey AS element, 3 AS line FROM part WHERE p_size > 25")
def functions_without_find(spark, d):
    """From text to findings: exported functions may not branch."""
    simple = c.element_condition("not branch", F.col("cc") < 2, measured=F.col("cc"))
    found = Project(_sources(spark, d)).functions("no branches").that(p.are_exported()).should(simple).violations()
    return found.where("NOT bypass_filters").select("file", "element", "line")


@query("collect_classes", f"SELECT {_FILE}, 'Box' || p_partkey AS name, 'Base' AS extends_text, 'open' AS member, 'private' AS scope, 7 + {_BIG} AS line, 9 + {_BIG} AS end_line FROM part")
def collect_classes(spark, d):
    """Classes with heritage and members."""
    rows = Project(_sources(spark, d)).classes().that(p.extend("Base")).selected()
    return rows.select("file", "name", "extends_text", F.explode("members").alias("m"), "line", "end_line").select("file", "name", "extends_text", F.col("m.name").alias("member"), "m.scope", "line", "end_line")


@query("collect_types", f"SELECT {_FILE}, 'Row' AS name, 'interface' AS kind, unnest(['id', 'size']) AS property, unnest(['string', 'number']) AS type_text, unnest([true, false]) AS readonly FROM part")
def collect_types(spark, d):
    """Interfaces and their properties."""
    rows = Project(_sources(spark, d)).types().that(p.are_interfaces()).selected()
    return rows.select("file", "name", "kind", F.explode("properties").alias("x")).select("file", "name", "kind", F.col("x.name").alias("property"), "x.type_text", "x.readonly")


@query("import_sites", f"SELECT {_FILE}, './' || p_partkey AS specifier, 'src/' || p_partkey || '.ts' AS resolved_path, 1 AS line FROM part")
def import_sites(spark, d):
    """Import edges with their line, resolved among the files."""
    return Project(_sources(spark, d)).edges().select("file", "specifier", "resolved_path", "line")


@query("path_universe", f"SELECT 'src' AS path UNION ALL SELECT {_FILE.replace(' AS file', '')} FROM part")
def path_universe(spark, d):
    """Files and the folders above them."""
    return facts.path_universe(_sources(spark, d).select("file"))
