"""Queries that show each family of predicates, conditions, metrics and packaged rules over whole tables, with SQL of their own.

The tables stand for facts: line items are functions (their line number is the
number of parameters), parts are classes and types, events are calls, orders own the
syntax nodes that their line items are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs
from ..functions import matchers as m
from ..functions import predicates as p
from ..operators import conditions as c
from ..operators import detectors, edges, findings, sets
from ..sources import report
from . import presets
from .catalogue import query, table

E = c.Elements("name", "file", "line")


def _flags(name: str, facts: Callable[[SparkSession, str], DataFrame], keys: list[str], source: str, tests: dict[str, tuple[Callable[[], Column], str]]) -> None:
    """A query with a column for each test: its name, the Column, and the same in SQL over ``source``."""
    sql = f"SELECT {', '.join(keys)}, {', '.join(f'{text} AS {n}' for n, (_, text) in tests.items())} FROM {source}"
    query(name, sql)(lambda spark, d: facts(spark, d).select(*keys, *[make().alias(n) for n, (make, _) in tests.items()]))


def _findings(name: str, facts: Callable[[SparkSession, str], DataFrame], source: str, tests: dict[str, tuple[Callable[[SparkSession, str], c.Condition], str]]) -> None:
    """A query with the number of findings of each condition and element; the SQL of a test is the number for one row of ``source``."""
    each = " UNION ALL ".join(f"SELECT '{n}' AS cond, name AS element, CAST({text} AS BIGINT) AS n FROM {source}" for n, (_, text) in tests.items())

    def run(spark: SparkSession, d: str) -> DataFrame:
        population = facts(spark, d)
        out = None
        for n, (make, _) in tests.items():
            found = make(spark, d).evaluate(population).select(F.lit(n).alias("cond"), "element")
            out = found if out is None else out.unionAll(found)
        return out.groupBy("cond", "element").agg(F.count("*").alias("n"))

    query(name, f"SELECT cond, element, CAST(sum(n) AS BIGINT) AS n FROM ({each}) GROUP BY cond, element HAVING sum(n) > 0")(run)


# ---- line items as functions
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _functions(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    param = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat(F.lit("p"), i.cast("string")).alias("name"), F.when(i % 2 == 0, "string").otherwise("number[]").alias("type_text"), ((i == n) & (F.col("l_quantity") > 40)).alias("is_rest"), (i == 3).alias("is_optional"), (i == 5).alias("has_default")))
    scope = F.when(F.col("l_returnflag") == "R", "private").when(F.col("l_returnflag") == "N", "protected").otherwise("public")
    return table(spark, d, "lineitem").select(
        "*",
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(12,2)")).alias("name"),
        F.concat(F.lit("src/s"), F.col("l_suppkey").cast("string"), F.lit("/f"), F.col("l_partkey").cast("string"), F.lit(".ts")).alias("file"),
        F.concat(F.lit("src/s"), F.col("l_suppkey").cast("string")).alias("folder"),
        (F.col("l_returnflag") == "A").alias("exported"),
        (F.col("l_linestatus") == "O").alias("is_async"),
        scope.alias("scope"),
        param.alias("params"),
        F.concat(F.lit("Promise<"), "l_returnflag", F.lit(">")).alias("return_type"),
        n.alias("line"),
        (n + F.col("l_quantity").cast("int")).alias("end_line"),
        F.col("l_quantity").cast("int").alias("cc"),
        F.when(F.col("l_tax") > 0.05, F.lit(0)).otherwise(n).alias("n_statements"),
        F.when(F.col("l_linestatus") == "O", "expression").otherwise("block").alias("body_kind"),
    )


_FN = "(SELECT *, concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(12,2))) AS name FROM lineitem)"

_flags(
    "function_predicates",
    _functions,
    _LINE,
    "lineitem",
    {
        "exported": (p.are_exported, "l_returnflag = 'A'"),
        "not_exported": (p.are_not_exported, "l_returnflag <> 'A'"),
        "async": (p.are_async, "l_linestatus = 'O'"),
        "not_async": (p.are_not_async, "l_linestatus <> 'O'"),
        "public": (p.are_public, "l_returnflag NOT IN ('R', 'N')"),
        "protected": (p.are_protected, "l_returnflag = 'N'"),
        "private": (p.are_private, "l_returnflag = 'R'"),
        "params_3": (lambda: p.have_parameter_count(3), "l_linenumber = 3"),
        "params_over_3": (lambda: p.have_parameter_count_greater_than(3), "l_linenumber > 3"),
        "params_under_3": (lambda: p.have_parameter_count_less_than(3), "l_linenumber < 3"),
        "param_named": (lambda: p.have_parameter_named("p4"), "l_linenumber >= 4"),
        "param_like": (lambda: p.have_parameter_name_matching("^p[67]$"), "l_linenumber >= 6"),
        "rest": (p.have_rest_parameter, "l_quantity > 40"),
        "optional": (p.have_optional_parameter, "l_linenumber >= 3"),
        "param_of_type": (lambda: p.have_parameter_of_type(1, m.is_string), "l_linenumber >= 2"),
        "returns": (lambda: p.have_return_type("Promise<A>"), "l_returnflag = 'A'"),
        "returns_like": (lambda: p.have_return_type(regex="<[AN]>$"), "l_returnflag IN ('A', 'N')"),
        "is_complex": (lambda: p.have_complexity(20), "CAST(trunc(l_quantity) AS INTEGER) > 20"),
        "is_long": (lambda: p.have_more_lines_than(30), "CAST(trunc(l_quantity) AS INTEGER) + 1 > 30"),
        "lines": (p.lines_of_code, "CAST(trunc(l_quantity) AS INTEGER) + 1"),
        "in_file": (lambda: p.reside_in_file("**/s1*/f*.ts"), "CAST(l_suppkey AS VARCHAR) LIKE '1%'"),
        "path_like": (lambda: p.have_path_matching("src/**/f?.ts", rel_path="file"), "l_partkey BETWEEN 0 AND 9"),
        "in_folder": (lambda: p.reside_in_folder("**/s2"), "l_suppkey = 2"),
        "at_path": (lambda: p.at_path("src/s3/", "file"), "l_suppkey = 3"),
    },
)

_findings(
    "function_conditions",
    _functions,
    _FN,
    {
        "accept_parameter": (lambda s, d: c.accept_parameter_of_type(m.is_string, e=E), "l_linenumber < 2"),
        "not_accept_parameter": (lambda s, d: c.not_accept_parameter_of_type(m.array_of(m.is_number), e=E), "(l_linenumber + 1) // 2"),
        "return_type": (lambda s, d: c.have_return_type_matching(m.matching("<[AR]>"), e=E), "l_returnflag = 'N'"),
        "name": (lambda s, d: c.element_condition("be named", p.have_name_matching("^[0-9]*7/"), E), "l_orderkey % 10 <> 7"),
        "exported": (lambda s, d: c.element_condition("be exported", p.are_exported(), E), "l_returnflag <> 'A'"),
        "async": (lambda s, d: c.element_condition("be async", p.are_async(), E), "l_linestatus <> 'O'"),
        "in_file": (lambda s, d: c.reside_in_file("**/s1*/*.ts", E), "CAST(l_suppkey AS VARCHAR) NOT LIKE '1%'"),
        "in_folder": (lambda s, d: c.reside_in_folder("**/s[12]", e=E), "l_suppkey NOT IN (1, 2)"),
        "not_empty_body": (lambda s, d: presets.no_empty_bodies(e=E), "l_tax > 0.05 AND l_linestatus <> 'O'"),
        "max_complexity": (lambda s, d: presets.max_function_complexity(40, E), "trunc(l_quantity) > 40"),
        "max_lines": (lambda s, d: presets.max_function_lines(45, E), "trunc(l_quantity) + 1 > 45"),
        "max_parameters": (lambda s, d: presets.max_function_parameters(5, E), "l_linenumber > 5"),
        "must_match_name": (lambda s, d: presets.must_match_name("^1", E), "CAST(l_orderkey AS VARCHAR) NOT LIKE '1%'"),
        "must_not_end_with": (lambda s, d: presets.must_not_end_with("0", E), "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) LIKE '%0'"),
    },
)


# ---- parts as classes and types
def _classes(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("p_name", " ")
    size = F.col("p_size")
    scope = F.when(size % 3 == 0, "private").when(size % 3 == 1, "public")
    member = F.transform(words, lambda w: F.struct(F.lit("method").alias("kind"), w.alias("name"), scope.alias("scope"), size.alias("cc"), (size * 2).alias("loc"), (size % 7).alias("n_params"), (size % 2 == 0).alias("has_doc")))
    prop = F.transform(words, lambda w: F.struct(w.alias("name"), F.when(size % 4 == 0, "any").when(size % 2 == 0, "string").otherwise("number | null").alias("type_text"), scope.alias("scope"), (size % 5 == 0).alias("is_static"), (size % 10 == 0).alias("is_readonly")))
    return table(spark, d, "part").select(
        "p_partkey",
        F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("name"),
        F.concat(F.lit("src/"), "p_type", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("file"),
        F.lit(1).alias("line"),
        size.alias("end_line"),
        F.col("p_brand").alias("extends_text"),
        F.array("p_type", F.lit("Named")).alias("implements"),
        words.alias("decorators"),
        (size > 25).alias("is_abstract"),
        F.when(size < 20, "interface").otherwise("alias").alias("kind"),
        F.array("p_brand").alias("extends"),
        F.col("p_name").alias("text"),
        member.alias("members"),
        prop.alias("properties"),
        (size > 40).alias("has_default_export"),
        F.when(size % 2 == 0, F.concat(F.lit("Promise<"), "p_type", F.lit(">"))).otherwise(F.col("p_type")).alias("return_type"),
    )


_CLASS = "(SELECT *, 'C' || CAST(p_partkey AS VARCHAR) AS name, string_split(p_name, ' ') AS w FROM part)"

_flags(
    "class_and_type_predicates",
    _classes,
    ["p_partkey"],
    _CLASS,
    {
        "extends": (lambda: p.extend("Brand#2"), "p_brand = 'Brand#2'"),
        "implements": (lambda: p.implement("PROMO"), "p_type = 'PROMO'"),
        "decorated": (lambda: p.have_decorator("red"), "list_contains(w, 'red')"),
        "decorated_like": (lambda: p.have_decorator_matching("^(s|b)"), "len(list_filter(w, lambda x: x[1] IN ('s', 'b'))) > 0"),
        "abstract": (p.are_abstract, "p_size > 25"),
        "method": (lambda: p.have_method_named("ring"), "list_contains(w, 'ring')"),
        "method_like": (lambda: p.have_method_matching("t$"), "len(list_filter(w, lambda x: x LIKE '%t')) > 0"),
        "many_methods": (lambda: p.have_more_methods_than(1), "len(w) > 1"),
        "is_complex": (lambda: p.have_cyclomatic_complexity(30), "p_size > 30"),
        "prop": (lambda: p.have_property("bolt"), "list_contains(w, 'bolt')"),
        "prop_of_type": (lambda: p.have_property_of_type("bolt", m.is_number), "list_contains(w, 'bolt') AND p_size % 2 = 1"),
        "interface": (p.are_interfaces, "p_size < 20"),
        "alias_": (p.are_type_aliases, "p_size >= 20"),
        "extends_type": (lambda: p.extend_type("widget"), "p_size >= 20 AND list_contains(w, 'widget')"),
        "exports": (lambda: p.flag("has_default_export"), "p_size > 40"),
    },
)

_findings(
    "class_and_type_conditions",
    _classes,
    _CLASS,
    {
        "extend": (lambda s, d: c.element_condition("extend", p.extend("Brand#2"), E), "p_brand <> 'Brand#2'"),
        "implement": (lambda s, d: c.element_condition("implement", p.implement("PROMO"), E), "p_type <> 'PROMO'"),
        "method": (lambda s, d: c.element_condition("have a method", p.have_method_named("ring"), E), "NOT list_contains(w, 'ring')"),
        "no_method": (lambda s, d: c.element_condition("have no such method", p.not_(p.have_method_matching("^r")), E), "len(list_filter(w, lambda x: x[1] = 'r')) > 0"),
        "no_property": (lambda s, d: c.not_have_property_named("red", "gear", e=E), "CAST(list_contains(w, 'red') AS INT) + CAST(list_contains(w, 'gear') AS INT)"),
        "property_like": (lambda s, d: c.have_property_matching("^b", e=E), "len(list_filter(w, lambda x: x[1] = 'b')) = 0"),
        "readonly": (lambda s, d: c.have_only_readonly_properties(e=E), "CASE WHEN p_size % 10 = 0 THEN 0 ELSE len(w) END"),
        "property_type": (lambda s, d: c.have_property_type("bolt", m.is_string, e=E), "list_contains(w, 'bolt') AND (p_size % 4 = 0 OR p_size % 2 = 1)"),
        "max_properties": (lambda s, d: c.at_most("properties", F.size("properties"), 1, E), "len(w) > 1"),
        "not_empty": (lambda s, d: presets.class_not_empty(e=E), "len(w) = 0"),
        "documented": (lambda s, d: presets.require_docs_on_public_methods(E), "CASE WHEN p_size % 3 <> 0 AND p_size % 2 = 1 THEN len(w) ELSE 0 END"),
        "no_public_fields": (lambda s, d: presets.no_public_fields(E), "CASE WHEN p_size % 3 <> 0 AND p_size % 10 <> 0 THEN len(w) ELSE 0 END"),
        "no_any": (lambda s, d: presets.no_any_properties(E), "CASE WHEN p_size % 4 = 0 THEN len(w) ELSE 0 END"),
        "max_class_lines": (lambda s, d: presets.max_class_lines(30, E), "p_size > 30"),
        "max_methods": (lambda s, d: presets.max_methods(1, E), "len(w) > 1"),
    },
)


@query(
    "member_metrics",
    "WITH x AS (SELECT *, unnest(string_split(p_name, ' ')) AS m FROM part) "
    + " UNION ALL ".join(f"SELECT '{n}' AS cond, 'C' || CAST(p_partkey AS VARCHAR) || '.' || m AS element, CAST({v} AS DOUBLE) AS measured FROM x WHERE {v} > {k}" for n, v, k in (("branches", "p_size", 40), ("lines", "p_size * 2", 90), ("parameters", "p_size % 7", 5))),
)
def member_metrics(spark, d):
    rows = _classes(spark, d)
    tests = {"branches": presets.max_cyclomatic_complexity(40), "lines": presets.max_method_lines(90), "parameters": presets.max_parameters(5)}
    parts = [x.evaluate(rows).select(F.lit(n).alias("cond"), "element", "measured") for n, x in tests.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("default_exports", "SELECT 'has' AS cond, 'src/' || p_type || '/' || CAST(p_partkey AS VARCHAR) || '.ts' AS element FROM part WHERE p_size <= 40 UNION ALL SELECT 'hasnt', 'src/' || p_type || '/' || CAST(p_partkey AS VARCHAR) || '.ts' FROM part WHERE p_size > 40")
def default_exports(spark, d):
    rows = _classes(spark, d)
    return edges.default_export(True).evaluate(rows).select(F.lit("has").alias("cond"), "element").unionAll(edges.default_export(False).evaluate(rows).select(F.lit("hasnt").alias("cond"), "element"))


@query("export_symbol_named", "SELECT DISTINCT p_type AS file FROM part WHERE p_name = 'red ring'")
def export_symbol_named(spark, d):
    exports = table(spark, d, "part").select(F.col("p_type").alias("file"), F.col("p_name").alias("name"))
    return p.export_symbol_named(exports, "red ring")(exports.select("file").distinct())


@query("follow_pattern", "SELECT 'C' || CAST(p_partkey AS VARCHAR) AS element, 'C' || CAST(p_partkey AS VARCHAR) || ' should follow the pattern: ' || CASE WHEN p_type = 'PROMO' THEN 'wrong type of id' WHEN p_type = 'SMALL' THEN 'missing id, missing at' ELSE 'missing id, wrong type of at' END AS message FROM part WHERE p_type <> 'LARGE'")
def follow_pattern(spark, d):
    shape = {"LARGE": [("id", "string"), ("at", "Date")], "PROMO": [("id", "number"), ("at", "Date")], "SMALL": []}
    names = ["LARGE", "PROMO", "SMALL", "ECONOMY", "MEDIUM", "STANDARD"]
    types = spark.createDataFrame([(n, shape.get(n, [("at", "string")])) for n in names], "name string, properties array<struct<name:string,type_text:string>>")
    return c.follow_pattern({"id": "string", "at": "Date"}, types, e=E).evaluate(_classes(spark, d)).select("element", "message")


# ---- type texts and expressions, from a list of cases that rows go through in turn
_TYPES = ["string", "number | null", "boolean | undefined", "'a' | 'b'", '"x"', "string[]", "Array<number>", "readonly string[]", "Foo"]
_MATCHERS: dict[str, tuple[Callable[[Column], Column], set[int]]] = {
    "is_string": (m.is_string, {0}),
    "is_number": (m.is_number, {1}),
    "is_boolean": (m.is_boolean, {2}),
    "is_union": (m.is_union_of_literals, {3}),
    "is_literal": (m.is_string_literal(), {4}),
    "is_x": (m.is_string_literal("x"), {4}),
    "strings": (m.array_of(m.is_string), {5, 7}),
    "numbers": (m.array_of(m.is_number), {6}),
    "foo": (m.exactly("Foo"), {8}),
    "not_foo": (m.not_type(m.exactly("Foo")), set(range(8))),
}
_flags("type_texts", lambda s, d: table(s, d, "part").withColumn("t", F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("p_partkey") % 9 + 1).cast("int"))), ["p_partkey"], "part", {n: (lambda f=f: f(F.col("t")), f"p_partkey % 9 IN ({', '.join(map(str, sorted(yes)))})") for n, (f, yes) in _MATCHERS.items()})

#: kind and text of a node
_NODES = [
    ("call", "console?.log(x)"),
    ("call", "eval('1')"),
    ("call", "JSON.parse(t)"),
    ("call", "console.warn(x)"),
    ("access", "process.env.HOME"),
    ("new", "new Function('a')"),
    ("new", "new Error('no')"),
    ("new", "new TypeError('no')"),
    ("type_assertion", "x as Foo"),
    ("type_assertion", "x as const"),
    ("non_null", "x!"),
    ("comment", "// TODO later"),
    ("number", "42"),
    ("number", "100"),
    ("catch", "catch (e) { }"),
    ("catch", "catch (e) { log(e) }"),
    ("property", 'color: "red"'),
    ("jsx_element", "<Card x={1}>"),
    ("jsx_text", " hello "),
]


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    cases = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("text")) for k, t in _NODES])
    case = F.element_at(cases, (F.col("l_partkey") % len(_NODES) + 1).cast("int"))
    return table(spark, d, "lineitem").select(*_LINE, F.col("l_orderkey").alias("owner_id"), F.col("l_linenumber").alias("line"), case["kind"].alias("kind"), case["text"].alias("text"))


def _owners(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(key.alias("fn_id"), key.alias("class_id"), key.alias("module_id"), key.cast("string").alias("name"), F.lit("f").alias("file"), F.lit(1).alias("line"))


def _cases(*yes: int) -> str:
    return f"l_partkey % {len(_NODES)} IN ({', '.join(map(str, yes))})"


_flags(
    "expression_matchers",
    _nodes,
    _LINE,
    "lineitem",
    {
        "is_call": (lambda: m.call("console.log"), _cases(0)),
        "call_like": (lambda: m.call(regex=r"^console\."), _cases(0, 3)),
        "is_access": (lambda: m.access(regex=r"^process\.env"), _cases(4)),
        "is_new": (lambda: m.new_expr("Error"), _cases(6)),
        "is_property": (lambda: m.property_("color", "red"), _cases(16)),
        "is_comment": (lambda: m.comment(regex="(?i)todo"), _cases(11)),
        "is_element": (lambda: m.jsx_element("Card"), _cases(17)),
        "is_text": (lambda: m.jsx_text("hello"), _cases(18)),
        "is_assertion": (m.type_assertion, _cases(8)),
        "is_non_null": (m.non_null_assertion, _cases(10)),
    },
)

_BODY = {"no_eval": (1,), "no_function_constructor": (5,), "no_process_env": (4,), "no_console_log": (0,), "no_console": (0, 3), "no_json_parse": (2,), "no_generic_errors": (6,), "no_type_errors": (7,), "no_type_assertions": (8,), "no_non_null_assertions": (10,), "no_stub_comments": (11,), "no_magic_numbers": (12,), "no_silent_catch": (14,)}


def _body_rules(owner: str) -> None:
    key = {"function": "fn_id", "class": "class_id", "module": "module_id"}[owner]

    def run(spark: SparkSession, d: str) -> DataFrame:
        nodes, owners = _nodes(spark, d), _owners(spark, d)
        rules = {n: presets.BODY_RULES[owner, n](nodes) for n in _BODY if (owner, n) in presets.BODY_RULES}
        rules |= {"no_stub_comments": presets.no_stub_comments(nodes, key=key), "no_magic_numbers": presets.no_magic_numbers(nodes, key=key), "no_silent_catch": presets.no_silent_catch(nodes, key)}
        out = None
        for n, r in rules.items():
            found = r.evaluate(owners).select(F.lit(n).alias("cond"), "element")
            out = found if out is None else out.unionAll(found)
        return out.groupBy("cond", "element").agg(F.count("*").alias("n"))

    cases = ", ".join(f"('{n}', {k})" for n, ks in _BODY.items() for k in ks)
    query(f"body_rules_of_{owner}", f"SELECT cond, CAST(o_orderkey AS VARCHAR) AS element, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN (VALUES {cases}) v(cond, k) ON k = l_partkey % {len(_NODES)} GROUP BY ALL")(run)


for _owner in ("function", "class", "module"):
    _body_rules(_owner)


def _without(*yes: int) -> str:
    return f"SELECT CAST(o_orderkey AS VARCHAR) AS element FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {_cases(*yes)})"


@query("must_call", f"SELECT 'function' AS cond, element FROM ({_without(0, 3)}) UNION ALL SELECT 'class', element FROM ({_without(2)})")
def must_call(spark, d):
    nodes, owners = _nodes(spark, d), _owners(spark, d)
    a = presets.must_call(nodes, r"^console\.").evaluate(owners).select(F.lit("function").alias("cond"), "element")
    return a.unionAll(presets.class_must_call(nodes, "^JSON").evaluate(owners).select(F.lit("class").alias("cond"), "element"))


@query("use_instead_of", f"SELECT element, count(*) AS n FROM ({_without(7)} UNION ALL SELECT CAST(o_orderkey AS VARCHAR) AS element FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE {_cases(6)}) GROUP BY element")
def use_instead_of(spark, d):
    rule = c.use_instead_of(_nodes(spark, d), m.new_expr("Error"), m.new_expr("TypeError"))
    return rule.evaluate(_owners(spark, d)).groupBy("element").agg(F.count("*").alias("n"))


@query("silent_catches", f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE {_cases(14)}")
def silent_catches(spark, d):
    return detectors.silent_catches(_nodes(spark, d)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("cyclomatic_complexity", "SELECT l_orderkey AS owner_id, CAST(1 + count(*) FILTER (WHERE l_returnflag <> 'N') AS INTEGER) AS cc FROM lineitem GROUP BY 1")
def cyclomatic_complexity(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "if").when(F.col("l_returnflag") == "R", "logical_or").otherwise("block")
    return m.cyclomatic_complexity(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner_id"), kind.alias("kind")))


@query("identify_matches", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS INTEGER) AS ordinal FROM events")
def identify_matches(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("file"), "event_type", F.lit(0).alias("start"), F.col("event_id").alias("node_id"))
    return m.identify_matches(rows, "event_type").select("event_id", "ordinal")


# ---- events as calls
def _calls(spark: SparkSession, d: str) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1)
    arg = lambda i, kind, text, literal, names: F.struct(F.lit(i).alias("idx"), kind.alias("kind"), text.alias("text"), literal.alias("literal"), names.alias("prop_names"))
    first = arg(0, F.lit("string"), F.col("props"), F.concat(F.lit("route/"), F.col("user_id").cast("string")), F.array().cast("array<string>"))
    second = arg(1, F.when(F.col("event_type") == "error", "arrow").otherwise("object"), F.concat(F.lit("k"), k), F.lit(None).cast("string"), F.array(F.col("event_type"), F.concat(F.lit("k"), k)))
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("event_id").cast("string").alias("name"), F.col("event_id").cast("string").alias("call"), F.lit("f").alias("file"), F.lit(1).alias("line"), F.when(F.col("event_type") == "click", "db?.users").otherwise("api").alias("object"), F.col("event_type").alias("method"), F.array(first, second).alias("args"))


_CALL = "(SELECT *, CAST(event_id AS VARCHAR) AS name, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"
_C = c.Elements("call", "file", "line")

_flags(
    "call_predicates",
    _calls,
    ["event_id"],
    _CALL,
    {
        "on_object": (lambda: p.on_object("db.users"), "event_type = 'click'"),
        "with_method": (lambda: p.with_method("error"), "event_type = 'error'"),
        "with_method_like": (lambda: p.with_method(regex="^(c|v)"), "event_type[1] IN ('c', 'v')"),
        "with_arg": (lambda: p.with_arg_matching(0, '"k": 1'), "CAST(k AS VARCHAR) LIKE '1%'"),
        "with_string": (lambda: p.with_string_arg(0, "route/1*"), "CAST(user_id AS VARCHAR) LIKE '1%'"),
        "no_third": (lambda: p.with_arg_matching(2, "."), "false"),
    },
)

_findings(
    "call_conditions",
    _calls,
    _CALL,
    {
        "argument_property": (lambda s, d: c.have_argument_with_property("click", "k7", e=_C), "NOT (event_type = 'click' AND k = 7)"),
        "no_argument_property": (lambda s, d: c.not_have_argument_with_property("error", "k9", e=_C), "event_type = 'error' OR k = 9"),
        "callback": (lambda s, d: c.have_callback_containing("^k1", _C), "NOT (event_type = 'error' AND CAST(k AS VARCHAR) LIKE '1%')"),
        "no_callback": (lambda s, d: c.not_have_callback_containing("^k2", _C), "event_type = 'error' AND CAST(k AS VARCHAR) LIKE '2%'"),
        "argument": (lambda s, d: c.have_argument_containing("^k[0-4]", _C), "CAST(k AS VARCHAR)[1] NOT IN ('0', '1', '2', '3', '4')"),
        "no_argument": (lambda s, d: c.not_have_argument_containing("3", _C), "2 * CAST(CAST(k AS VARCHAR) LIKE '%3%' AS INTEGER)"),
    },
)


# ---- customers as elements of markup
def _elements(spark: SparkSession, d: str) -> DataFrame:
    balance = F.col("c_acctbal")
    tag = F.when(F.col("c_nationkey") < 10, "Card").otherwise(F.lower("c_mktsegment"))
    attributes = F.when(balance < 0, F.create_map(F.lit("id"), "c_name")).when(balance < 5000, F.create_map(F.lit("id"), "c_name", F.lit("open"), F.lit(None).cast("string"))).otherwise(F.create_map(F.lit("href"), "c_name"))
    return table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("name"), F.lit("f").alias("file"), F.lit(1).alias("line"), tag.alias("tag"), (F.lower(tag) == tag).alias("is_html"), attributes.alias("attributes"))


_ELEMENT = "(SELECT *, CAST(c_custkey AS VARCHAR) AS name FROM customer)"

_flags(
    "markup_predicates",
    _elements,
    ["c_custkey"],
    _ELEMENT,
    {
        "html": (lambda: p.are_html_elements("building", "machinery"), "c_nationkey >= 10 AND c_mktsegment IN ('BUILDING', 'MACHINERY')"),
        "components": (p.are_components, "c_nationkey < 10"),
        "cards": (lambda: p.are_components("Card"), "c_nationkey < 10"),
        "has_open": (lambda: p.with_attribute("open"), "c_acctbal >= 0 AND c_acctbal < 5000"),
        "open_like": (lambda: p.with_attribute_matching("open", regex="."), "false"),
        "id_like": (lambda: p.with_attribute_matching("id", regex="7$"), "c_acctbal < 5000 AND c_name LIKE '%7'"),
    },
)

_findings(
    "markup_conditions",
    _elements,
    _ELEMENT,
    {
        "has_id": (lambda s, d: c.have_attribute("id", E), "c_acctbal >= 5000"),
        "no_open": (lambda s, d: c.not_have_attribute("open", E), "c_acctbal >= 0 AND c_acctbal < 5000"),
        "open_like": (lambda s, d: c.have_attribute_matching("open", ".", E), "1"),
        "id_like": (lambda s, d: c.have_attribute_matching("id", "7$", E), "c_acctbal >= 5000 OR c_name NOT LIKE '%7'"),
        "no_id_like": (lambda s, d: c.not_have_attribute_matching("id", "7$", E), "c_acctbal < 5000 AND c_name LIKE '%7'"),
    },
)


# ---- orders as fields of a schema
def _fields(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "P", "Query").when(F.col("o_orderstatus") == "F", "Mutation").otherwise("Order")
    field = F.when(key % 3 > 0, F.concat(F.lit("f"), key.cast("string")))
    return table(spark, d, "orders").select("o_orderkey", key.cast("string").alias("name"), F.lit("f").alias("file"), F.lit(1).alias("line"), kind.alias("type_name"), field.alias("field_name"), F.when(key % 2 == 0, "[Order!]!").otherwise("Order").alias("field_type"), F.col("o_orderpriority").alias("return_type"), F.array(F.col("o_orderpriority"), F.lit("first")).alias("args"), F.array(F.col("o_orderstatus"), F.lit("id")).alias("type_fields"))


_FIELD = "(SELECT *, CAST(o_orderkey AS VARCHAR) AS name FROM orders)"

_flags(
    "schema_predicates",
    _fields,
    ["o_orderkey"],
    _FIELD,
    {
        "is_query": (p.queries, "o_orderstatus = 'P'"),
        "is_mutation": (p.mutations, "o_orderstatus = 'F'"),
        "is_named": (lambda: p.types_named("Order"), "o_orderkey % 3 = 0 AND o_orderstatus = 'O'"),
        "named_like": (lambda: p.types_named(regex="^(Q|M)"), "o_orderkey % 3 = 0 AND o_orderstatus IN ('P', 'F')"),
        "is_list": (lambda: p.return_list_of("Order"), "o_orderkey % 2 = 0"),
        "resolves": (lambda: p.resolve_field_returning("URGENT"), "o_orderpriority LIKE '%URGENT%'"),
    },
)

_findings(
    "schema_conditions",
    _fields,
    _FIELD,
    {
        "fields": (lambda s, d: c.have_fields("id", "F", e=E), "o_orderstatus <> 'F'"),
        "args": (lambda s, d: c.accept_args("first", "5-LOW", e=E), "o_orderpriority <> '5-LOW'"),
    },
)


@query("have_matching_resolver", "SELECT 'f' || CAST(o_orderkey AS VARCHAR) AS element FROM orders WHERE o_orderkey % 3 > 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30)")
def have_matching_resolver(spark, d):
    resolvers = table(spark, d, "lineitem").where("l_quantity > 30").select(F.concat(F.lit("return db.f"), F.col("l_orderkey").cast("string"), F.lit("(args)")).alias("text"))
    return c.have_matching_resolver(resolvers).evaluate(_fields(spark, d).where("field_name IS NOT NULL")).select("element")


@query("option_is", "SELECT CAST(c_custkey AS VARCHAR) AS element FROM customer WHERE NOT (c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY' AND c_acctbal > 0)")
def option_is(spark, d):
    strict = F.when(F.col("c_mktsegment") == "BUILDING", F.create_map(F.lit("strict"), F.lit("true"))).when(F.col("c_mktsegment") == "MACHINERY", F.create_map(F.lit("strictNullChecks"), F.when(F.col("c_acctbal") > 0, "true").otherwise("false"), F.lit("strict"), F.lit("true"))).otherwise(F.create_map(F.lit("target"), F.lit("es2022")))
    return c.option_is(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("root"), strict.alias("options")), "strictNullChecks", "true").select("element")


# ---- keys, pairs, dependencies and findings
@query("keys_of_a_side", "SELECT DISTINCT 'name' AS by, p_name AS key FROM part UNION ALL SELECT DISTINCT 'arg', props FROM events UNION ALL SELECT DISTINCT 'property', unnest(string_split(p_name, ' ')) FROM part")
def keys_of_a_side(spark, d):
    tag = lambda n, df: df.select(F.lit(n).alias("by"), "key")
    names = sets.keys(table(spark, d, "part").select(F.col("p_name").alias("name")), sets.by_name())
    return tag("name", names).unionAll(tag("arg", sets.keys(_calls(spark, d), sets.by_arg(0)))).unionAll(tag("property", sets.keys(_classes(spark, d), sets.by_property_names())))


@query("correspondence_findings", "WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 49), b AS (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 0) SELECT CAST(k AS VARCHAR) AS element, 'missing::' || CAST(k AS VARCHAR) AS identity FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT CAST(k AS VARCHAR), 'orphan::' || CAST(k AS VARCHAR) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)")
def correspondence_findings(spark, d):
    a, b = table(spark, d, "lineitem").where("l_quantity > 49"), table(spark, d, "supplier").where("s_acctbal > 0")
    return sets.correspondence_findings(a, b, F.col("l_suppkey"), F.col("s_suppkey")).select("element", "identity")


@query("satisfy_pair", "SELECT c_name AS element FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE NOT (c_acctbal > 100 * n_regionkey)")
def satisfy_pair(spark, d):
    pairs = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("left_file", F.col("c_name"))
    return sets.satisfy_pair(pairs, F.col("c_acctbal") > 100 * F.col("n_regionkey"), F.lit("x")).select("element")


@query("aliased_imports", "SELECT 's' || CAST(l_suppkey AS VARCHAR) AS file, l_linenumber AS line, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL")
def aliased_imports(spark, d):
    file = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    names = table(spark, d, "lineitem").select(file.alias("file"), F.col("l_linenumber").alias("line"), F.col("l_partkey").cast("string").alias("name"), F.when(F.col("l_returnflag") == "R", "x").alias("alias"))
    return edges.not_have_aliased_imports(names).evaluate(names.select("file").distinct()).groupBy("file", "line").agg(F.count("*").alias("n"))


def _packages(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    path = lambda c_, n: F.concat(F.lit(f"src/{n}/"), F.col(c_).cast("string"))
    return line.select(path("l_suppkey", "s").alias("file"), F.lit("import").alias("kind"), path("l_partkey", "p").alias("specifier"), path("l_partkey", "p").alias("resolved_path"), F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "R").alias("type_only"))


_PACK = "SELECT 'src/s/' || CAST(l_suppkey AS VARCHAR) AS file, l_linenumber AS line, count(*) AS n FROM lineitem WHERE {w} GROUP BY ALL"


@query("packaged_dependencies", " UNION ALL ".join(f"SELECT '{n}' AS cond, * FROM ({_PACK.format(w=w)})" for n, w in (("only", "l_partkey < 10"), ("not", "CAST(l_partkey AS VARCHAR) LIKE '7%'"), ("types", "l_partkey BETWEEN 10 AND 99 AND l_returnflag <> 'R'"))))
def packaged_dependencies(spark, d):
    found, files = _packages(spark, d), table(spark, d, "supplier").select(F.concat(F.lit("src/s/"), F.col("s_suppkey").cast("string")).alias("file"))
    tests = {"only": presets.only_depend_on(found, ["src/p/??*"]), "not": presets.must_not_depend_on(found, ["src/p/7*"]), "types": presets.type_only_from(found, ["src/p/??"])}
    parts = [x.evaluate(files).groupBy("file", "line").agg(F.count("*").alias("n")).select(F.lit(n).alias("cond"), "file", "line", "n") for n, x in tests.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("dead_modules", "SELECT 'src/p/' || CAST(p_partkey AS VARCHAR) AS file FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey < 10)")
def dead_modules(spark, d):
    found = _packages(spark, d).where(F.col("file").rlike(r"^src/s/\d$"))
    return presets.no_dead_modules(found).evaluate(table(spark, d, "part").select(F.concat(F.lit("src/p/"), F.col("p_partkey").cast("string")).alias("file"))).select("file")


@query("edge_coverage", "SELECT (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS subjects, (SELECT count(*) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 0) AS edges")
def edge_coverage(spark, d):
    files = table(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("src/s/"), F.col("s_suppkey").cast("string")).alias("file"))
    return findings.edge_coverage(files, _packages(spark, d))


@query("slice_sites", "SELECT 's' || CAST(l_suppkey % 7 AS VARCHAR) AS src, 's' || CAST(l_partkey % 7 AS VARCHAR) AS dst, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 7 <> l_partkey % 7 AND l_returnflag <> 'R' GROUP BY ALL")
def slice_sites(spark, d):
    slice_of = lambda t, k, n: table(spark, d, t).select(F.concat(F.lit(f"src/{n}/"), F.col(k).cast("string")).alias("file"), F.concat(F.lit("s"), (F.col(k) % 7).cast("string")).alias("slice"))
    slices = slice_of("supplier", "s_suppkey", "s").unionAll(slice_of("part", "p_partkey", "p"))
    return edges.slice_sites(_packages(spark, d), slices, skip="type_only").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("portable_paths", "SELECT page_id, CASE WHEN url LIKE 'https://%' THEN substr(url, 8) END AS below, url LIKE '%.example.com/%' AS known, CASE WHEN page_id % 2 = 0 THEN 'c:/' ELSE 'src/' END || CAST(page_id AS VARCHAR) AS portable FROM pages")
def portable_paths(spark, d):
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("C:\\"), F.col("page_id").cast("string"), F.lit("\\"))).otherwise(F.concat(F.lit("src//"), F.col("page_id").cast("string"), F.lit("/")))
    return table(spark, d, "pages").select("page_id", p.relative_to_root("url", "https:/").alias("below"), p.flag(F.col("url").contains(".example.com/")).alias("known"), p.to_portable_path(raw).alias("portable"))


@query("subject_hashes", "SELECT c_custkey, substr(sha256(c_name || '::' || c_mktsegment), 1, 16) AS hash FROM customer")
def subject_hashes(spark, d):
    rows = table(spark, d, "customer").withColumns({"element": F.col("c_name"), "message": F.col("c_mktsegment"), "identity": F.lit(None).cast("string")})
    return rows.select("c_custkey", findings.subject_hash().alias("hash"))


@query("unused_exclusions", "SELECT 'Customer#000000000' || 'x' AS exclusion UNION ALL SELECT 'nobody'")
def unused_exclusions(spark, d):
    rows = c.to_violations(table(spark, d, "customer"), "c_name", F.lit("m"), file="c_mktsegment")
    return findings.unused_exclusions(rows, ["Customer#000000000x", "nobody", "Customer#000000001", "BUILDING"])


@query("hidden_by_comments", "SELECT l_returnflag AS rule_id, count(*) AS n FROM lineitem WHERE l_quantity > 45 AND l_linenumber = 3 GROUP BY ALL")
def hidden_by_comments(spark, d):
    items = table(spark, d, "lineitem").where("l_quantity > 45").withColumn("file", F.concat_ws("/", *_LINE))
    found = c.to_violations(items, "file", F.lit("too many"), file="file", line="l_linenumber").withColumn("rule_id", F.lit("q"))
    marks = items.select(F.lit("q").alias("rule_id"), "file", F.lit(2).alias("line"), F.lit(False).alias("is_block"), F.lit(None).cast("int").alias("end_line"))
    hidden = findings.suppressed_by_comment(found, marks)
    flags = items.select("file", "l_returnflag").distinct()
    return hidden.join(flags, "file").groupBy(F.col("l_returnflag").alias("rule_id")).agg(F.sum("n").alias("n"))


@query("code_frames", "SELECT conv_id, turn, '> 1 | ' || string_split(text, chr(10))[1] || CASE WHEN len(string_split(text, chr(10))) > 1 THEN chr(10) || '  2 | ' || string_split(text, chr(10))[2] ELSE '' END AS frame FROM conversations")
def code_frames(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", report.code_frame(F.col("text"), F.lit(1), 1).alias("frame"))


@query("any_case", "SELECT p_partkey FROM part WHERE lower(p_type) = 'promo'")
def any_case(spark, d):
    return table(spark, d, "part").where(p.have_name_matching(f"^{globs.any_case('Promo')}$", "p_type")).select("p_partkey")
