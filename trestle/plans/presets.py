"""Packaged rules: conditions and rule sets under names of their own.

Body rules take the syntax nodes (``ast_nodes``) and, by ``key``, say whose bodies
are meant: ``fn_id`` for functions, ``class_id`` for classes, ``module_id`` for
modules, whose findings point at the match.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matchers as m
from ..functions import predicates as p
from ..functions.predicates import two_valued
from ..operators import conditions as c
from ..operators import detectors, edges
from ..operators.conditions import Condition, Elements
from ..schema import to_violations
from .rule import Rule, rule

Body = Callable[..., Condition]


def _forbid(matcher: Callable[[], Column], what: str, key: str) -> Body:
    def build(nodes: DataFrame, e: Elements = Elements()) -> Condition:
        return c.not_contain(nodes, matcher(), f"not use {what}", key, e, at_match=key == "module_id")

    return build


_BANNED: dict[str, tuple[Callable[[], Column], str]] = {
    "no_eval": (lambda: m.call("eval"), "eval"),
    "no_function_constructor": (lambda: m.new_expr("Function"), "the Function constructor"),
    "no_process_env": (lambda: m.access(regex=r"^process\.env\b"), "process.env"),
    "no_console_log": (lambda: m.call("console.log"), "console.log"),
    "no_console": (lambda: m.call(regex=r"^console\."), "console"),
    "no_json_parse": (lambda: m.call("JSON.parse"), "JSON.parse"),
    "no_generic_errors": (lambda: m.new_expr("Error"), "generic errors"),
    "no_type_errors": (lambda: m.new_expr("TypeError"), "TypeError"),
    "no_type_assertions": (lambda: m.type_assertion(), "type assertions"),
    "no_non_null_assertions": (lambda: m.non_null_assertion(), "non-null assertions"),
}
_OWNERS = {"class": "class_id", "function": "fn_id", "module": "module_id"}
#: every banned expression for every kind of owner, such as ``BODY_RULES["function", "no_eval"]``
BODY_RULES: dict[tuple[str, str], Body] = {(owner, name): _forbid(matcher, what, key) for owner, key in _OWNERS.items() for name, (matcher, what) in _BANNED.items()}


def must_call(nodes: DataFrame, regex: str, key: str = "fn_id") -> Condition:
    return c.contain(nodes, m.call(regex=regex), f"call {regex}", key)


class_must_call = partial(must_call, key="class_id")


def no_stub_comments(nodes: DataFrame, regex: str = r"(?i)\b(todo|fixme|stub|placeholder|not implemented)\b", key: str = "fn_id") -> Condition:
    return c.not_contain(nodes, m.comment(regex=regex), "not hold stub comments", key)


def no_magic_numbers(nodes: DataFrame, allowed: tuple[float, ...] = (0, 1, -1, 2, 10, 100), key: str = "class_id") -> Condition:
    literal = (F.col("kind") == "number") & ~two_valued(F.expr("try_cast(text AS double)").isin(*map(float, allowed)))
    return c.not_contain(nodes, literal, "not use magic numbers", key)


def no_silent_catch(nodes: DataFrame, key: str = "fn_id", e: Elements = Elements()) -> Condition:
    return c.not_contain(detectors.silent_catches(nodes), F.lit(True), "not swallow errors", key, e, at_match=key == "module_id")


no_empty_bodies = c.not_have_empty_body


def class_not_empty(members: str = "members", e: Elements = Elements()) -> Condition:
    return c.element_condition("have a member", F.size(members) > 0, e)


def require_docs_on_public_methods(e: Elements = Elements()) -> Condition:
    return c.each_item("document public methods", F.transform(F.filter("members", lambda x: (x["kind"] == "method") & two_valued(F.coalesce(x["scope"], F.lit("public")) == "public") & ~two_valued(x["has_doc"])), lambda x: x["name"]), e)


def no_public_fields(e: Elements = Elements()) -> Condition:
    """No public field but one that is static and readonly."""
    return c.each_item("not have public fields", F.transform(F.filter("properties", lambda x: two_valued(F.coalesce(x["scope"], F.lit("public")) == "public") & ~(two_valued(x["is_static"]) & two_valued(x["is_readonly"]))), lambda x: x["name"]), e)


def no_any_properties(e: Elements = Elements()) -> Condition:
    return c.each_item("not have properties of type any", F.transform(F.filter("properties", lambda x: two_valued(x["type_text"] == "any")), lambda x: x["name"]), e)


def must_match_name(regex: str, e: Elements = Elements()) -> Condition:
    return c.element_condition(f"be named like {regex}", F.coalesce(F.col(e.name), F.lit("<anonymous>")).rlike(regex), e)


def must_not_end_with(suffix: str, e: Elements = Elements()) -> Condition:
    return c.element_condition(f"not be named ...{suffix}", ~two_valued(F.col(e.name).endswith(suffix)), e)


# measures
def _members_over(what: str, measure: Callable[[Column], Column], n: int) -> Callable[..., Condition]:
    """A finding for each member above ``n``, with the measure."""

    def run(population: DataFrame) -> DataFrame:
        rows = population.withColumn("_m", F.explode("members")).where(two_valued(measure(F.col("_m")) > n))
        name = F.concat_ws(".", F.col("name"), F.col("_m.name"))
        return to_violations(rows, name, F.concat(name, F.lit(f" has more than {n} {what}")), file="file", line="line", identity=F.concat_ws("::", name, F.lit(what)), measured=measure(F.col("_m")))

    return Condition(f"have members of at most {n} {what}", run)


def max_cyclomatic_complexity(n: int) -> Condition:
    return _members_over("branches", lambda x: x["cc"], n)


def max_method_lines(n: int) -> Condition:
    return _members_over("lines", lambda x: x["loc"], n)


def max_parameters(n: int) -> Condition:
    return _members_over("parameters", lambda x: x["n_params"], n)


def max_class_lines(n: int, e: Elements = Elements()) -> Condition:
    return c.at_most("lines", p.lines_of_code(), n, e)


def max_methods(n: int, e: Elements = Elements()) -> Condition:
    return c.at_most("methods", p.method_count(), n, e)


def max_function_complexity(n: int, e: Elements = Elements()) -> Condition:
    return c.at_most("branches", F.col("cc"), n, e)


max_function_lines = max_class_lines


def max_function_parameters(n: int, e: Elements = Elements()) -> Condition:
    return c.at_most("parameters", p.parameter_count(), n, e)


# dependencies under other names
only_depend_on, must_not_depend_on, type_only_from = edges.only_import_from, edges.not_import_from, edges.only_type_imports_from
no_dead_modules, no_unused_exports = edges.be_imported, edges.no_unused_exports


# rule sets: lists of rules, which overrides switch off or make warnings
def apply_overrides(rules: list[Rule], overrides: dict[str, str] | None = None) -> list[Rule]:
    """Rules with their ids' severities replaced; ``off`` takes one out, an unknown id is an error."""
    overrides = overrides or {}
    ids = {r.stamps.get("rule_id") for r in rules}
    if unknown := sorted(set(overrides) - ids):
        raise ValueError(f"no rule has the id {', '.join(unknown)}")
    kept = [r for r in rules if overrides.get(r.stamps.get("rule_id", "")) != "off"]
    if rules and not kept:
        raise ValueError("the overrides switch off every rule of the set")
    return [r.stamped(severity=overrides[r.stamps["rule_id"]]) if r.stamps.get("rule_id") in overrides else r for r in kept]


def _named(population: DataFrame, rule_id: str, *conditions: Condition) -> Rule:
    return rule(population, rule_id).should(*conditions).stamped(rule_id=rule_id)


def _graph_rule(population: DataFrame, rule_id: str, found: DataFrame) -> Rule:
    return _named(population, rule_id, Condition(rule_id, lambda _: found))


def recommended(functions: DataFrame, nodes: DataFrame, overrides: dict[str, str] | None = None) -> list[Rule]:
    """Four rules that fit any code."""
    own = [("no-eval", BODY_RULES["function", "no_eval"](nodes)), ("no-function-constructor", BODY_RULES["function", "no_function_constructor"](nodes)), ("no-silent-catch", no_silent_catch(nodes)), ("no-empty-bodies", no_empty_bodies())]
    return apply_overrides([_named(functions, f"recommended/{n}", x) for n, x in own], overrides)


def agent_guardrails(functions: DataFrame, nodes: DataFrame, inline: list[str], fingerprint: DataFrame | None = None, overrides: dict[str, str] | None = None) -> list[Rule]:
    """Forbidden calls, generic errors, stubs, empty bodies and copies."""
    rules = [_named(functions, f"guardrails/no-{name}", c.not_contain(nodes, m.call(regex=name), f"not call {name}")) for name in inline]
    rules += [_named(functions, "guardrails/no-generic-errors", BODY_RULES["function", "no_generic_errors"](nodes)), _named(functions, "guardrails/no-stubs", no_stub_comments(nodes)), _named(functions, "guardrails/no-empty-bodies", no_empty_bodies())]
    if fingerprint is not None:
        rules.append(_graph_rule(functions, "guardrails/no-copies", detectors.duplicate_bodies(functions, fingerprint, 0.9)))
    return apply_overrides(rules, overrides)


def layered_architecture(modules: DataFrame, module_edges: DataFrame, layers: dict[str, str], overrides: dict[str, str] | None = None) -> list[Rule]:
    """Layers in order from the outermost: no edge upwards, no cycles, and the innermost imports none of the others."""
    slices = edges.slices_by_definition(modules, layers)
    sites = edges.slice_sites(module_edges, slices)
    names = list(layers)
    rules = [
        _graph_rule(modules, "layers/order", edges.respect_layer_order(sites, names)),
        _graph_rule(modules, "layers/no-cycles", edges.be_free_of_cycles(edges.slice_sites(module_edges, slices, skip="erases_request"))),
        _graph_rule(modules, "layers/innermost-isolation", edges.not_depend_on(sites.where(F.col("src") == names[-1]), *names[:-1])),
    ]
    return apply_overrides(rules, overrides)


def strict_boundaries(modules: DataFrame, module_edges: DataFrame, prefix: str, shared: tuple[str, ...] = (), overrides: dict[str, str] | None = None) -> list[Rule]:
    """Folders below ``prefix`` stand alone: no cycles, no edge from one to another but to the shared, which use none."""
    slices = edges.slices_by_prefix(modules, prefix)
    sites = edges.slice_sites(module_edges, slices)
    is_shared = lambda side: F.col(side).isin(*shared) if shared else F.lit(False)
    crossing = sites.where(~is_shared("dst") & ~is_shared("src"))
    message = F.concat(F.col("src"), F.lit(" reaches into "), F.col("dst"))
    found = lambda rows: to_violations(rows, "src", message, file="file", line="line", identity=F.concat_ws("->", "src", "dst", "file"))
    rules = [
        _graph_rule(modules, "boundaries/no-cycles", edges.be_free_of_cycles(edges.slice_sites(module_edges, slices, skip="erases_request"))),
        _graph_rule(modules, "boundaries/no-crossing", found(crossing)),
        _graph_rule(modules, "boundaries/shared-isolation", found(sites.where(is_shared("src") & ~is_shared("dst")))),
    ]
    return apply_overrides(rules, overrides)


def data_layer_isolation(classes: DataFrame, nodes: DataFrame, base: str, overrides: dict[str, str] | None = None) -> list[Rule]:
    """Repositories extend a base class and throw errors of their own."""
    rules = [_named(classes, "data/extend-base", c.element_condition(f"extend {base}", p.extend(base))), _named(classes, "data/typed-errors", BODY_RULES["class", "no_generic_errors"](nodes))]
    return apply_overrides(rules, overrides)
