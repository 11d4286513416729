"""The rule engine: cases stated as small tables."""

import json

import pytest
from pyspark.sql import functions as F

from trestle.functions import globs, matchers
from trestle.functions import predicates as p
from trestle.operators import conditions as c
from trestle.operators import detectors, edges, findings, sets
from trestle.plans import queries
from trestle.plans.rule import RuleError, check_all, diagnose, rule
from trestle.schema import VIOLATION, to_violations
from trestle.sources import facts, report
from trestle.streaming.recheck import recheck, window_limit

KEY = c.Elements("name", None, None)


def names(df, column="name"):
    return sorted(r[column] for r in df.collect())


@pytest.mark.parametrize(
    "glob, path, hit",
    [
        ("**/src/*.ts", "/a/src/x.ts", True), ("**/src/*.ts", "/a/src/b/x.ts", False), ("src/**", "src/a/b.ts", True), ("src/**/x.ts", "src/x.ts", True),
        ("**/*.{ts,js}", "a/b.js", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("[ab].ts", "b.ts", True), ("[!ab].ts", "b.ts", False), ("**/*.ts", "a/.hidden/x.ts", False),
        ("*.ts", ".x.ts", False), ("@(a|b).ts", "a.ts", True), ("x/*", "x/", False), ("a.b", "axb", False),
    ],
)
def test_globs(glob, path, hit):
    import re

    assert bool(re.search(globs.glob_regex(glob), path)) == hit


def test_dead_selectors():
    paths = ["src/a.ts", "src/b/c.ts"]
    leaf = globs.glob_leaf("lib/**")
    assert globs.is_dead(leaf, paths) and not globs.is_dead(globs.negate(leaf), paths)
    assert not globs.is_dead(globs.any_of("lib/**", "src/**"), paths) and globs.is_dead(globs.combine("all", leaf, globs.glob_leaf("src/**")), paths)
    assert globs.diagnose_glob("b/c.ts", paths, ["src", "src/b"]) == "unanchored" and globs.diagnose_glob("src/b", paths, ["src", "src/b"]) == "folder-not-file"
    assert globs.diagnose_glob("zzz", paths, []) == "no-match" and globs.diagnose_glob("src/*.ts", paths, []) is None


def test_predicates_are_two_valued(spark):
    df = spark.createDataFrame([("a",), (None,)], "name string")
    assert df.where(p.not_(p.have_name_matching("b"))).count() == 2
    assert df.where(p.have_name_matching("a")).count() == 1 and df.where(p.and_()).count() == 2 and df.where(p.or_()).count() == 0


def test_function_and_class_predicates(spark):
    param = "struct<name:string,type_text:string,is_rest:boolean,is_optional:boolean,has_default:boolean>"
    df = spark.createDataFrame([("f", [("x", "string", False, False, False), ("rest", "number[]", True, False, None)]), ("g", [("y", "string | undefined", False, True, False)]), ("h", []), ("n", None)], f"name string, params array<{param}>")
    hit = lambda q: names(df.where(q))
    assert hit(p.have_parameter_count(2)) == ["f"] and hit(p.have_parameter_count_less_than(1)) == ["h", "n"] and hit(p.have_parameter_count_greater_than(1)) == ["f"]
    assert hit(p.have_rest_parameter()) == ["f"] and hit(p.have_optional_parameter()) == ["g"] and hit(p.have_parameter_named("y")) == ["g"]
    assert hit(p.have_parameter_of_type(0, matchers.is_string)) == ["f", "g"] and hit(p.have_parameter_of_type(1, matchers.array_of(matchers.is_number))) == ["f"]
    assert hit(p.not_(p.have_rest_parameter())) == ["g", "h", "n"]
    assert names(c.not_accept_parameter_of_type(matchers.is_string, e=KEY).evaluate(df), "element") == ["f", "g"]


def test_type_matchers(spark):
    texts = ["string", "number | null", "'a' | 'b'", '"x"', "Array<string>", "boolean", "(string | null)[]"]
    df = spark.createDataFrame([(t,) for t in texts], "name string")
    hit = lambda m: names(df.where(m(F.col("name"))))
    assert hit(matchers.is_string) == ["string"] and hit(matchers.is_number) == ["number | null"] and hit(matchers.is_boolean) == ["boolean"]
    assert hit(matchers.is_union_of_literals) == ["'a' | 'b'"] and hit(matchers.is_string_literal("x")) == ['"x"']
    assert hit(matchers.array_of(matchers.is_string)) == sorted(["Array<string>", "(string | null)[]"]) and len(hit(matchers.not_type(matchers.is_string))) == 6


def module_edges(spark, rows):
    return spark.createDataFrame(rows, "file string, resolved_path string, kind string, type_only boolean, line int").withColumn("specifier", F.coalesce("resolved_path", F.lit("react"))).withColumn("erases_request", F.col("type_only"))


@pytest.fixture(scope="module")
def graph(spark):
    a, b, o, s, e, bad = "src/feature-a/index.ts", "src/feature-b/helper.ts", "src/controllers/o.ts", "src/services/o.ts", "src/domain/entity.ts", "src/bad/leaky.ts"
    return module_edges(spark, [(a, b, "import", False, 1), (b, a, "import", False, 2), (o, s, "import", False, 1), (s, e, "import", True, 1), (bad, o, "import", False, 3), (e, None, "import", False, 9)])


def test_cycles_and_layers(spark, graph):
    files = graph.select("file").union(graph.select("resolved_path")).where("file IS NOT NULL").distinct()
    feature = edges.slices_by_prefix(files, "src/feature-")
    assert names(feature, "slice") == ["a", "b"]
    found = edges.be_free_of_cycles(edges.slice_sites(graph, feature, skip="erases_request"))
    assert names(found, "element") == ["a", "b"]
    layers = {n: f"src/{n}/**" for n in ("controllers", "services", "domain", "bad")}
    sites = edges.slice_sites(graph, edges.slices_by_definition(files, layers))
    assert edges.be_free_of_cycles(sites).count() == 0
    assert edges.respect_layer_order(sites, ["controllers", "services", "domain"]).count() == 0
    assert names(edges.respect_layer_order(sites, ["controllers", "services", "domain", "bad"]), "element") == ["bad"]
    assert names(edges.not_depend_on(sites, "domain"), "element") == ["services"]


@pytest.mark.parametrize("pairs, want", [("01 12", []), ("01 10", ["01"]), ("01 12 20", ["012"]), ("01 10 23 32", ["01", "23"]), ("00", []), ("01 10 12 23 32 21", ["0123"]), ("01 10 12 23 32 34 45 53", ["01", "2345"])])
def test_components_both_ways(spark, pairs, want):
    df = spark.createDataFrame([(x[0], x[1]) for x in pairs.split()], "src string, dst string")
    for most in (100, 0):
        got: dict = {}
        for r in edges.strongly_connected(df, most).collect():
            got.setdefault(r["component"], []).append(r["node"])
        assert sorted("".join(sorted(v)) for v in got.values()) == want


def test_edge_conditions(spark, graph):
    modules = graph.select("file").distinct()
    assert edges.not_import_from(graph, ["src/domain/**"]).evaluate(modules).count() == 1
    assert edges.not_import_from(graph, ["src/domain/**"], ignore_types=True).evaluate(modules).count() == 0
    assert edges.only_import_from(graph, ["src/**"]).evaluate(modules).count() == 1  # the unresolved one
    assert edges.only_import_from(graph, ["src/**", "react"]).evaluate(modules).count() == 0
    assert edges.depend_on(graph, ["src/domain/**"]).evaluate(modules).count() == 5
    assert edges.depend_on(graph, ["src/domain/**"], ignore_type_imports=True).evaluate(modules).count() == 6
    assert names(edges.be_imported(graph).evaluate(modules), "file") == ["src/bad/leaky.ts"]
    via = edges.only_be_imported_via(graph, ["src/feature-a/**"]).evaluate(modules)
    assert names(via, "element") == sorted(["src/feature-a/index.ts", "src/controllers/o.ts", "src/services/o.ts", "src/domain/entity.ts"])
    spec = spark.createDataFrame([("m", 1, "Entity", "DomainEntity"), ("m", 2, "x", None)], "file string, line int, name string, alias string")
    assert names(edges.not_have_aliased_imports(spec).evaluate(spec), "message") == ['"Entity" as "DomainEntity"']


@pytest.mark.parametrize("a, b, missing, orphans", [("abc", "ac", "b", ""), ("a", "axy", "", "xy"), ("ab", "ba", "", ""), ("", "a", "", "a"), ("aab", "a", "b", ""), ("abc", "abd", "c", "d"), ("zyx", "", "xyz", "")])
def test_correspondence(spark, a, b, missing, orphans):
    side = lambda s: spark.createDataFrame([(x,) for x in s] + [(None,)], "name string")
    got = sets.correspondence(side(a), side(b), F.col("name"), F.col("name")).collect()
    assert "".join(sorted(r["key"] for r in got if r["side"] == "missing")) == missing
    assert "".join(sorted(r["key"] for r in got if r["side"] == "orphan")) == orphans


def test_similarity_and_candidates(spark):
    import itertools
    import random

    assert detectors.similarity([], []) == 1 and detectors.similarity([1], []) == 0 and detectors.similarity([1, 2, 3], [1, 2, 3]) == 1 and detectors.lcs_length([1, 3, 2, 4], [1, 2, 3, 4]) == 3
    rng = random.Random(1)
    base = [[rng.randrange(5) for _ in range(rng.randrange(1, 25))] for _ in range(25)]
    items = base + [[x for x in b if rng.random() > 0.1] for b in base]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(items)] + [(99, None)], "fn_id int, kinds array<int>")
    want = {(i, j) for i, j in itertools.combinations(range(50), 2) if items[i] and items[j] and detectors.similarity(items[i], items[j]) >= 0.8}
    assert {(r["a"], r["b"]) for r in detectors.similar_bodies(df, 0.8, words=None).collect()} == want and want


def test_majority_outlier(spark):
    files = spark.createDataFrame([("r", f"{i}.ts", "this.extractCount()") for i in range(4)] + [("r", "legacy.ts", "x"), ("q", "a.ts", "this.extractCount()"), ("q", "b.ts", None), ("q", "c.ts", "x")], "folder string, file string, text string")
    assert names(detectors.inconsistent_siblings(files, F.col("text").contains("extractCount")), "element") == ["legacy.ts"]


def finding(spark, rows):
    df = spark.createDataFrame(rows, "rule string, element string, identity string, measured double, file string, line int")
    return to_violations(df, "element", F.lit("m"), file="file", line="line", identity=F.col("identity"), measured=F.col("measured")).withColumn("rule", F.lit("r"))


def test_identities_stay_apart(spark):
    got = findings.disambiguate(finding(spark, [("r", "e", "X", None, "a", 1), ("r", "e", "X", None, "b", 1), ("r", "e", "X", None, "c", 1), ("r", "e", "X#1", None, "d", 1)])).collect()
    assert sorted(r["identity"] for r in got) == ["X", "X#1", "X#2", "X#3"]


def test_ratchet_exclusions_directives_and_diff(spark):
    old = finding(spark, [("r", "e", "X", 10.0, "a", 1)])
    accepted = findings.baseline_of(old)
    for value, left in ((10.0, 0), (12.0, 1), (8.0, 0)):
        assert findings.new_since(finding(spark, [("r", "e", "X", value, "a", 7)]), accepted).count() == left
    assert findings.exclude(old, ["e"]).count() == 0 and findings.exclude(old, patterns=["^z"]).count() == 1
    marks = spark.createDataFrame([("id", "", "a", 4, False, None), ("id", "", "a", 8, True, 10), ("id", "", "a", 20, True, None)], "rule_id string, reason string, file string, line int, is_block boolean, end_line int")
    rows = finding(spark, [("r", str(n), str(n), None, "a", n) for n in (4, 5, 6, 8, 10, 11, 21)]).withColumn("rule_id", F.lit("id"))
    assert names(findings.suppress(rows, marks), "line") == [4, 6, 11, 21]
    changed = spark.createDataFrame([("b",)], "file string")
    assert findings.in_changed(rows, changed).count() == 0 and findings.in_changed(rows, None).count() == 7
    broken = rows.withColumn("bypass_filters", F.lit(True))
    assert findings.in_changed(broken, changed).count() == 7 and findings.new_since(broken, accepted).count() == 7 and findings.exclude(broken, ["4"]).count() == 7
    same = finding(spark, [("r", "o", None, None, "f", None)] * 3).withColumn("bypass_filters", F.lit(True))
    assert "3 rules" in findings.dedupe_configuration(same).first()["message"]


def test_rules_guard_and_raise(spark):
    people = spark.createDataFrame([("ann", 3), ("bob", 9)], "name string, cc int")
    few = c.at_most("branches", F.col("cc"), 5, KEY)
    r = rule(people, "calm").should(few).stamped(rule_id="x", because="y")
    assert [v["measured"] for v in r.violations().collect()] == [9.0] and r.violations().schema.names == VIOLATION.names
    with pytest.raises(RuleError):
        r.check()
    rule(people).that(p.have_name_matching("ann")).should(few).check()
    empty = rule(people).that(p.have_name_matching("zoe"))
    assert empty.should(few).violations().first()["bypass_filters"] and empty.should(c.not_exist(KEY)).violations().count() == 0
    assert empty.should(few).expect_empty().violations().count() == 0 and rule(people).should(few).expect_empty().violations().count() == 2
    assert "asserts nothing" in rule(people).violations().first()["message"]
    assert "after should" in rule(people).should(few).that(p.have_name_matching("a")).violations().first()["message"]
    assert r.warn().first()["severity"] == "warn"
    assert check_all([r, rule(people, "b")]).count() == 2 and ("b", "asserts nothing") in diagnose([rule(people, "b")])


def test_markup_and_attributes(spark):
    pages = spark.createDataFrame([("u", '<div className="a"><img src="x.png" alt/><Button label="go">t</Button></div>')], "url string, html string")
    got = {r["tag"]: r for r in facts.markup_elements(pages).collect()}
    assert got["div"]["attributes"] == {"className": "a"} and got["img"]["attributes"] == {"src": "x.png", "alt": None} and not got["img"]["has_children"] and not got["Button"]["is_html"]
    tags = facts.markup_elements(pages).withColumn("line", F.lit(1))
    assert names(c.have_attribute_matching("alt", "x").evaluate(tags.where(p.are_html_elements("img", "div"))), "message") == ["div: alt is missing", "img: alt has no value"]
    assert names(tags.where(p.are_components()), "tag") == ["Button"] and names(tags.where(p.with_attribute("alt")), "tag") == ["img"]
    with pytest.raises(ValueError):
        p.are_html_elements()


def test_lexers(spark):
    text = "import { type X, y } from './a'\nimport type { Z } from \"z\"\nexport * from './b'\nconst q = import('./c')\nconst r = require('d')\nimport './e'\n// rule-exclude my/id: known\nbad()\n// rule-exclude-start k: why\n// rule-exclude-end\n"
    files = spark.createDataFrame([("src/m.ts", text), ("src/a.ts", "")], "file string, text string")
    got = {r["specifier"]: (r["kind"], r["type_only"]) for r in facts.import_edges(files).collect()}
    assert got == {"./a": ("import", False), "z": ("import", True), "./b": ("re-export", False), "./c": ("dynamic", False), "d": ("require", False), "./e": ("import", False)}
    resolved = {r["specifier"]: r["resolved_path"] for r in facts.resolve_relative(facts.import_edges(files), files).collect()}
    assert resolved["./a"] == "src/a.ts" and resolved["z"] is None
    marks = sorted((r["rule_id"], r["line"], r["is_block"], r["end_line"]) for r in facts.directives(files).collect())
    assert marks == [("k", 9, True, 10), ("my/id", 7, False, None)]


def test_schema_facts(spark):
    sdl = 'type Query { users(skip: Int, limit: Int): [User!]! }\n"""doc"""\ntype User { id: ID! }\n'
    rows = facts.schema_elements(spark.createDataFrame([(sdl,)], "text string"))
    assert names(rows.where(p.return_list_of("User")), "field_name") == ["users"] and names(rows.where(p.queries()), "type_name") == ["Query", "Query"]
    types = rows.where(p.types_named("User"))
    assert names(c.have_fields("id", "total").evaluate(types), "identity") == ["User::have field::total"]
    users = rows.where("field_name = 'users'")
    assert c.accept_args("skip", "limit").evaluate(users).count() == 0 and c.have_matching_resolver(spark.createDataFrame([("const users = 1",)], "text string")).evaluate(users).count() == 0


def test_innermost_expression_and_complexity(spark):
    nodes = spark.createDataFrame([("f", 1, 1, "block", "a eval b", 0, 20), ("f", 2, 1, "call", "eval()", 5, 11), ("f", 3, 1, "if", "if", 12, 14), ("f", 4, 1, "twin", "eval", 15, 19), ("f", 5, 1, "twin", "eval", 15, 19)], "file string, node_id long, owner_id long, kind string, text string, start int, end int")
    assert names(matchers.expression(nodes, "eval"), "node_id") == [2]
    assert matchers.cyclomatic_complexity(nodes).first()["cc"] == 2 and nodes.where(matchers.call("eval")).count() == 1


def test_baseline_file_and_reports(spark, tmp_path):
    found = findings.enrich(finding(spark, [("r", "e", "X", 2.0, "a,b", 3)]), severity="warn")
    path = str(tmp_path / "b.json")
    assert facts.write_baseline(findings.baseline_of(found), path) == 1
    assert findings.new_since(found, facts.read_baseline(spark, path)).count() == 0
    assert facts.read_baseline(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "c.json").write_text("[1]")
    assert facts.read_baseline(spark, str(tmp_path / "c.json")).count() == 0
    assert json.loads(report.report(found, "json"))["summary"] == {"total": 1, "errors": 0, "warnings": 1, "reason": None}
    assert report.report(found, "annotations") == "::warning file=a%2Cb,line=3,title=r::m" and "1 findings" in report.report(found, "plain")
    frame = spark.createDataFrame([("a\nb\nc",)], "t string").select(report.code_frame(F.col("t"), F.lit(2), 1)).first()[0]
    assert frame == "  1 | a\n> 2 | b\n  3 | c"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3) for i in range(30)], "n int, k int").withColumn("ts", F.timestamp_seconds(F.col("n") * 300))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    judge = lambda df: to_violations(df.where("n > 20"), F.col("n").cast("string"), F.lit("big"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = recheck(stream, judge, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert names(spark.read.parquet(f"{tmp_path}/out"), "element") == names(judge(rows), "element")
    whole = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")  # in one batch nothing is late
    limits = window_limit(whole, "ts", "k", 3, "1 hour")
    q = limits.writeStream.format("memory").queryName("limits").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert window_limit(rows, "ts", "k", 3, "1 hour").count() == spark.table("limits").select("identity").distinct().count() > 0


def test_every_query_has_matching_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_text_to_edges_to_findings(spark):
    text = "/*\nimport q from 'z'\n*/\n// import c from 'comment'\nimport {\n  a,\n  type B\n} from '../../infra/db'\nconst s = \"import('no such')\"\nexport type { T } from './t'\nconst x = await import('./late'); require('old')\n"
    up = "/".join([".."] * 9)
    files = spark.createDataFrame([("src/domain/deep/m.ts", text), ("a/b/c/d/e/f/g/h/i/n.ts", f"import z from '{up}/a/t'\n"), ("a/t.ts", "")], "file string, text string")
    found = facts.import_edges(files)
    got = sorted((r["file"], r["line"], r["kind"], r["specifier"], r["type_only"]) for r in found.collect())
    assert got == [("a/b/c/d/e/f/g/h/i/n.ts", 1, "import", f"{up}/a/t", False), ("src/domain/deep/m.ts", 5, "import", "../../infra/db", False), ("src/domain/deep/m.ts", 10, "re-export", "./t", True), ("src/domain/deep/m.ts", 11, "dynamic", "./late", False), ("src/domain/deep/m.ts", 11, "require", "old", False)]
    modules = spark.createDataFrame([("src/infra/db.ts",), ("src/domain/deep/t/index.ts",), ("a/t.ts",), ("src/domain/deep/m.ts",)], "file string")
    resolved = facts.resolve_relative(found, modules)
    assert {r["specifier"]: r["resolved_path"] for r in resolved.collect()} == {f"{up}/a/t": "a/t.ts", "../../infra/db": "src/infra/db.ts", "./t": "src/domain/deep/t/index.ts", "./late": None, "old": None}
    rows = rule(modules, "pure").should(edges.not_import_from(resolved, ["src/infra/**"])).violations().collect()
    assert [(r["file"], r["line"]) for r in rows] == [("src/domain/deep/m.ts", 5)]


def test_directive_must_be_a_comment(spark):
    files = spark.createDataFrame([("a.ts", "const s = '// rule-exclude x: no'\n// rule-exclude y: yes\n/* // rule-exclude z: also */\n`\n// rule-exclude w: no\n`")], "file string, text string")
    assert sorted((r["rule_id"], r["line"]) for r in facts.directives(files).collect()) == [("y", 2), ("z", 3)]


def test_many_equal_subjects_are_numbered_quickly(spark):
    import time

    rows = spark.range(20_000).select(F.lit("s").alias("e"), F.col("id").cast("string").alias("f")).union(spark.createDataFrame([("s#2", "a"), ("s#2", "b"), ("s#2#1", "c")], "e string, f string"))
    found = to_violations(rows, "e", F.lit("m"), file="f", identity=F.col("e")).withColumn("rule", F.lit("r"))
    began = time.perf_counter()
    got = [r["identity"] for r in findings.disambiguate(found).collect()]
    assert len(set(got)) == len(got) == 20_003 and "s#1" in got and "s#20000" in got and "s#2#2" in got and time.perf_counter() - began < 20


def test_what_was_hidden_is_told(spark):
    found = to_violations(spark.createDataFrame([("a", "f", 2), ("a", "f", 3), ("a", "g", 9)], "e string, file string, line int"), "e", F.lit("m"), file="file", line="line").withColumn("rule_id", F.lit("r"))
    marks = spark.createDataFrame([("r", "", "f", 1, False, None), ("r", "", "f", 2, False, None)], "rule_id string, reason string, file string, line int, is_block boolean, end_line int")
    hidden = findings.suppressed_by_comment(found, marks)
    assert [tuple(r) for r in hidden.collect()] == [("r", "f", 2)]
    assert findings.suppression_notice(hidden).first()["notice"] == "2 findings are suppressed by comments in 1 files"
    coverage = spark.createDataFrame([("x", 3, 0), ("y", 3, 1), ("z", 0, 0)], "rule string, subjects long, edges long")
    assert [r["rule"] for r in findings.untested_rules(coverage).collect()] == ["x"]
    exclusions = spark.createDataFrame([("a", False), ("b", False), ("c", True)], "exclusion string, silent boolean")
    assert [r["exclusion"] for r in findings.loud_unused(exclusions, found).collect()] == ["b"]
    scopes = spark.createDataFrame([("f", "outer", 1, 9), ("f", "inner", 2, 2)], "file string, name string, line int, end_line int")
    scoped = findings.enclosing_scope(found.select("file", "line"), scopes)
    assert sorted((r["file"], r["line"], r["scope"] or "") for r in scoped.collect()) == [("f", 2, "inner"), ("f", 3, "outer"), ("g", 9, "")]


def test_errors_and_reports_count_all(spark):

    many = to_violations(spark.range(50).select(F.col("id").cast("string").alias("e")), "e", F.lit("m"))
    with pytest.raises(RuleError) as caught:
        rule(spark.range(50).select(F.col("id").cast("string").alias("name")), "none").should(c.not_exist(c.Elements("name", None, None))).check(most=10)
    assert len(caught.value.findings) == 10 and caught.value.total == 50 and "and 30 more" in str(caught.value)
    text, errors = report.render(many, "plain")
    assert errors == 50 and report.totals(many) == (50, 50) and "50 findings, 50 errors" in text
    assert "the first 10 shown" in report.plain(report.rows(many, 10), (50, 50))


def test_exclusions_of_an_element_of_one_digit(spark, tmp_path):
    """The pattern asked for a digit before the 7, which the SQL does not."""
    spark.createDataFrame([(k, "1-URGENT") for k in (7, 17, 71, 100)], "o_orderkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(k,) for k in (7, 17, 71, 100) for _ in range(6)], "l_orderkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert names(queries.exclusions(spark, str(tmp_path)), "element") == ["71"]


def test_duplicate_bodies_write_each_text_once(spark, tmp_path):
    """Copies hang on their representative (they were expanded into all pairs), and no link between different texts is lost."""
    import itertools
    import random

    rng = random.Random(2)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 60))] for _ in range(20)]
    texts = base + [[w for w in b if rng.random() > 0.08] for b in base] + [base[3]] * 30 + [[]]
    spark.createDataFrame([(i, "  ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["a"], r["b"]): r["similarity"] for r in queries.duplicate_bodies(spark, str(tmp_path)).collect()}
    first = {i: texts.index(t) for i, t in enumerate(texts) if t}
    alike = {(i, j): s for i, j in itertools.combinations(sorted(set(first.values())), 2) if (s := detectors.similarity(texts[i], texts[j])) >= 0.85}
    assert got == alike | {(r, i): 1.0 for i, r in first.items() if r != i} and len(alike) > 5
    assert got[3, 69] == 1.0 and (40, 41) not in got


def test_false_candidates_are_few(spark):
    """One rare word in common made a candidate, whose bodies were then shuffled."""
    rows = [(i, [1_000 + i // 2] + [(i * 7 + j * j) % 997 for j in range(80)]) for i in range(40)]
    df = spark.createDataFrame(rows, "fn_id int, kinds array<int>")
    assert detectors.candidate_pairs(df, 0.85).count() == 0 == detectors.similar_bodies(df, 0.85, words=None).count()
