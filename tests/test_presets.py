import pytest
from pyspark.sql import functions as F

from trestle.plans import presets


@pytest.fixture(scope="module")
def code(spark):
    functions = spark.createDataFrame([(1, "f.ts", "f", 1, 9, 4, 2, "block"), (2, "f.ts", "g", 10, 12, 1, 0, "block"), (3, "f.ts", "h", 13, 13, 1, 0, "expression")], "fn_id long, file string, name string, line int, end_line int, cc int, n_statements int, body_kind string")
    nodes = spark.createDataFrame(
        [(1, "call", "eval(x)", 2), (1, "new", "new Error('x')", 3), (1, "catch", "catch (e) { log() }", 4), (3, "catch", "catch (e) { log(e) }", 13), (1, "comment", "// TODO later", 5), (2, "call", "console?.log(1)", 11), (1, "number", "42", 6), (1, "number", "10", 6)],
        "owner_id long, kind string, text string, line int",
    )
    return functions, nodes


def elements(rules):
    return {r.name: sorted(v["element"] for v in r.violations().collect()) for r in rules}


def test_recommended_and_overrides(code):
    functions, nodes = code
    got = elements(presets.recommended(functions, nodes))
    assert got == {"recommended/no-eval": ["f"], "recommended/no-function-constructor": [], "recommended/no-silent-catch": ["f"], "recommended/no-empty-bodies": ["g"]}
    kept = presets.recommended(functions, nodes, {"recommended/no-eval": "off", "recommended/no-empty-bodies": "warn"})
    assert len(kept) == 3 and kept[-1].violations().first()["severity"] == "warn"
    with pytest.raises(ValueError):
        presets.recommended(functions, nodes, {"nonsense": "off"})


def test_body_rules_and_guardrails(code):
    functions, nodes = code
    assert elements(presets.agent_guardrails(functions, nodes, ["^eval$"])) == {"guardrails/no-^eval$": ["f"], "guardrails/no-generic-errors": ["f"], "guardrails/no-stubs": ["f"], "guardrails/no-empty-bodies": ["g"]}
    run = lambda condition: sorted((v["element"], v["line"]) for v in condition.evaluate(functions).collect())
    assert run(presets.BODY_RULES["function", "no_console_log"](nodes)) == [("g", 10)]
    assert run(presets.no_magic_numbers(nodes, key="fn_id")) == [("f", 1)] and run(presets.must_call(nodes, "^eval$")) == [("g", 10), ("h", 13)]
    assert run(presets.max_function_complexity(3)) == [("f", 1)] and run(presets.max_function_lines(3)) == [("f", 1)]
    modules = functions.withColumnRenamed("fn_id", "module_id")
    assert sorted(v["line"] for v in presets.BODY_RULES["module", "no_eval"](nodes).evaluate(modules).collect()) == [2]


def test_layers_and_boundaries(spark):
    rows = [("src/ui/a.ts", "src/core/b.ts"), ("src/core/b.ts", "src/ui/a.ts"), ("src/shared/s.ts", "src/core/b.ts"), ("src/ui/a.ts", "src/shared/s.ts")]
    e = spark.createDataFrame(rows, "file string, resolved_path string").withColumns({"kind": F.lit("import"), "specifier": F.col("resolved_path"), "line": F.lit(1), "type_only": F.lit(False), "erases_request": F.lit(False)})
    modules = e.select("file").distinct()
    got = elements(presets.layered_architecture(modules, e, {"ui": "src/ui/**", "core": "src/core/**"}))
    assert got == {"layers/order": ["core"], "layers/no-cycles": ["core", "ui"], "layers/innermost-isolation": ["core"]}
    got = elements(presets.strict_boundaries(modules, e, "src/", ("shared",)))
    assert got == {"boundaries/no-cycles": ["core", "shared", "ui", "ui"], "boundaries/no-crossing": ["core", "ui"], "boundaries/shared-isolation": ["shared"]}
