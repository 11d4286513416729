"""Facts from source text, and projects of folders."""

from pyspark.sql import functions as F

from trestle.functions import predicates as p
from trestle.operators import edges
from trestle.plans import source_queries
from trestle.plans.project import project, reset_project_cache, workspace
from trestle.plans.rule import rule
from trestle.sources import syntax
from trestle.sources.syntax import Source

TEXT = """import a from "b"
export async function load<T>(id: string, n = 3, ...rest: T[]): Promise<T> {
  if (n && id) { return fetch(`x${n}`, { a: 1, b }) }
  return db.users.find(id)
}
const add = (x: number, y?: number) => x + y, twice = z => add(z, z)
export const go = async (): Promise<void> => {
  app.get("/p", (req, res) => { res.send(1) })
  server.route({ handler: async (r) => r, options: { pre() { return f()() } } })
}
@Injectable()
export abstract class Foo<T> extends Bar<T> implements A, B {
  private x = 3
  constructor(private readonly z: Z) { super(z) }
  get size(): number { return 1 }
  protected async run(a: string): Promise<void> { await this.go(a); new Thing(1); new Thing(2).start() }
  abstract stop(): void
}
const routes = { "/x": { GET: () => 1, POST(req) { return req ? a() : b } } }
export interface P { readonly id: string; name?: number
  tags: string[] }
// call(x)
const re = /a(b)/g
"""


def test_functions_of_every_origin():
    found = {f["name"]: f for f in Source(TEXT).functions()}
    assert {n: f["origin"] for n, f in found.items()} == {
        "load": "declaration", "add": "arrow", "twice": "arrow", "go": "arrow", "Foo.run": "method", "Foo.stop": "method",
        "handler": "object_literal", "options.pre": "object_literal", 'routes["/x"].GET': "object_literal", 'routes["/x"].POST': "object_literal",
    }
    load = found["load"]
    assert (load["exported"], load["is_async"], load["return_type"], load["cc"], load["n_statements"], load["line"], load["end_line"]) == (True, True, "Promise<T>", 3, 2, 2, 5)
    assert [(x["name"], x["type_text"], x["is_rest"], x["is_optional"], x["has_default"]) for x in load["params"]] == [("id", "string", False, False, False), ("n", None, False, True, True), ("rest", "T[]", True, False, False)]
    assert found["Foo.run"]["scope"] == "protected" and found["Foo.stop"]["body"] is None


def test_calls_leave_out_comments_constructions_and_heads():
    calls = [c["name"] for c in Source(TEXT).calls()]
    assert calls == ["fetch", "db.users.find", "add", "app.get", "res.send", "server.route", "f", "f()", "Injectable", "super", "this.go", "new Thing(2).start", "a"]


def test_callbacks_keep_the_keys_of_literals():
    assert [(c["name"], c["arg_index"]) for c in Source(TEXT).callbacks()] == [(None, 1), ("handler", 0), ("options.pre", 0)]


def test_classes_and_types():
    cls = next(Source(TEXT).classes())
    assert (cls["name"], cls["is_abstract"], cls["extends_text"], cls["implements"], cls["decorators"]) == ("Foo", True, "Bar<T>", ["A", "B"], ["Injectable"])
    assert [(m["kind"], m["name"]) for m in cls["members"]] == [("property", "x"), ("constructor", "constructor"), ("getter", "size"), ("method", "run"), ("method", "stop")]
    assert [(x["name"], x["type_text"], x["readonly"]) for x in next(Source(TEXT).types())["properties"]] == [("id", "string", True), ("name", "number", False), ("tags", "string[]", False)]


def test_null_empty_and_broken_texts(spark):
    files = spark.createDataFrame([("a", None), ("b", ""), ("c", "function f( {"), ("d", "}}))`${"), ("e", "x" * 100_000 + "(1)")], "file string, text string")
    assert syntax.functions(files, object_literals=True).count() >= 0
    assert [r["file"] for r in syntax.calls(files).collect()] == ["e"]
    assert syntax.classes(files).count() + syntax.types(files).count() + syntax.callbacks(files).count() == 0
    assert syntax.calls(files.limit(0)).count() == 0


def test_project_from_text_to_findings(spark, tmp_path):
    for root, name, text in (("one", "a.ts", "import { b } from './b'\nexport function f() { return g(1) }\n"), ("one", "b.ts", "export const b = () => 1\n"), ("two", "c.ts", "class C { m() {} }\n")):
        (tmp_path / root).mkdir(exist_ok=True)
        (tmp_path / root / name).write_text(text)
    one, both = project(spark, str(tmp_path / "one")), workspace(spark, str(tmp_path / "two"), str(tmp_path / "one"))
    assert project(spark, str(tmp_path / "one") + "/") is one
    assert sorted(r["name"] for r in both.functions().selected().collect()) == ["C.m", "b", "f"]
    assert [r["name"] for r in both.calls().that(p.with_method("g")).selected().collect()] == ["g"]
    found = rule(one.modules().selected(), "apart").should(edges.not_import_from(one.edges(), ["**/b.ts"])).violations().collect()
    assert [(r["file"].rsplit("/", 1)[1], r["line"]) for r in found] == [("a.ts", 1)]
    reset_project_cache()
    assert project(spark, str(tmp_path / "one")) is not one


def test_sources_are_dealt_out_before_they_are_parsed(spark, tmp_path):
    """A table of few bytes is one split: a single task parsed all texts."""
    parts = spark.range(500).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    sources = source_queries._sources(spark, str(tmp_path))
    sizes = [r["count"] for r in sources.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 4 * spark.sparkContext.defaultParallelism and max(sizes) < 100 and sum(sizes) == 500


def test_skipped_text_and_its_end():
    assert Source("").tok == Source(" // a\n /* b */ /* c").tok == []
    assert Source("a /* x */ // y\n / b / `c ${d}` /re/g").tok == ["a", "/", "b", "/", "`c ${d}`", "/", "re", "/", "g"]
    assert Source("x = /a(b)/g /* end").tok == ["x", "=", "/a(b)/g"]
