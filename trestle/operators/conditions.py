"""Conditions: each takes the selected population and returns its findings.

A condition is a function from a DataFrame to a DataFrame of findings; those of a
rule all see the same population, and their findings are put together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import glob_regex
from ..functions.predicates import col, two_valued
from ..schema import to_violations

Build = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Condition:
    """``cardinality`` marks a condition that an empty population meets by design."""

    description: str
    evaluate: Build
    cardinality: bool = False


@dataclass(frozen=True)
class Elements:
    """The columns by which a population names its elements."""

    name: str = "name"
    file: str | None = "file"
    line: str | None = "line"


def define_condition(description: str, evaluate: Build, cardinality: bool = False) -> Condition:
    return Condition(description, evaluate, cardinality)


def element_condition(description: str, passes: Column, e: Elements = Elements(), measured: Column | None = None) -> Condition:
    """A finding for each element that fails a predicate; a null counts as failing."""

    def run(population: DataFrame) -> DataFrame:
        failing = population.where(~two_valued(passes))
        message = F.concat(F.coalesce(F.col(e.name).cast("string"), F.lit("<anonymous>")), F.lit(f" should {description}"))
        identity = F.concat_ws("::", F.coalesce(F.col(e.name).cast("string"), F.lit("")), F.lit(description)) if measured is not None else None
        return to_violations(failing, e.name, message, file=e.file, line=e.line, identity=identity, measured=measured)

    return Condition(description, run)


def not_exist(e: Elements = Elements()) -> Condition:
    """Every element of the population is a finding."""

    def run(population: DataFrame) -> DataFrame:
        return to_violations(population, e.name, F.concat(F.coalesce(F.col(e.name).cast("string"), F.lit("<anonymous>")), F.lit(" should not exist")), file=e.file, line=e.line)

    return Condition("not exist", run, cardinality=True)


def at_most(what: str, measure: Column, n: float, e: Elements = Elements()) -> Condition:
    """Measured threshold: a finding carries the value, so that a baseline can ratchet."""
    return element_condition(f"have at most {n:g} {what}", measure <= n, e, measure)


def reside_in_file(glob: str, e: Elements = Elements()) -> Condition:
    return element_condition(f"reside in file {glob}", F.col(e.file).rlike(glob_regex(glob)), e)


def reside_in_folder(glob: str, folder: str = "folder", e: Elements = Elements()) -> Condition:
    return element_condition(f"reside in folder {glob}", F.col(folder).rlike(glob_regex(glob)), e)


# one finding for each item of an element
def each_item(description: str, items: Column, e: Elements, message: Callable[[Column], Column] | None = None) -> Condition:
    """A finding for each item of an array computed from the element; null items count."""

    def run(population: DataFrame) -> DataFrame:
        rows = population.withColumn("_item", F.explode(items))
        text = (message or (lambda x: F.concat(F.coalesce(F.col(e.name).cast("string"), F.lit("<anonymous>")), F.lit(f" should {description}: "), F.coalesce(x.cast("string"), F.lit("?")))))(F.col("_item"))
        identity = F.concat_ws("::", F.coalesce(F.col(e.name).cast("string"), F.lit("")), F.lit(description), F.coalesce(F.col("_item").cast("string"), F.lit("")))
        return to_violations(rows, e.name, text, file=e.file, line=e.line, identity=identity)

    return Condition(description, run)


def _names(items: Column | str) -> Column:
    return F.coalesce(F.transform(col(items), lambda p: p["name"]), F.array().cast("array<string>"))


def have_all(names: list[str], own: Column, e: Elements = Elements(), what: str = "property") -> Condition:
    """A finding for each name that ``own``, an array of names, lacks."""
    return each_item(f"have {what}", F.array_except(F.array(*[F.lit(n) for n in names]), own), e)


def have_none(names: list[str], own: Column, e: Elements = Elements(), what: str = "property") -> Condition:
    return each_item(f"not have {what}", F.array_intersect(F.array(*[F.lit(n) for n in names]), own), e)


def have_property_named(*names: str, items: str = "properties", e: Elements = Elements()) -> Condition:
    return have_all(list(names), _names(items), e)


def not_have_property_named(*names: str, items: str = "properties", e: Elements = Elements()) -> Condition:
    return have_none(list(names), _names(items), e)


def have_property_matching(regex: str, items: str = "properties", e: Elements = Elements()) -> Condition:
    return element_condition(f"have a property matching {regex}", F.exists(_names(items), lambda n: n.rlike(regex)), e)


def not_have_property_matching(regex: str, items: str = "properties", e: Elements = Elements()) -> Condition:
    return each_item(f"not have a property matching {regex}", F.filter(_names(items), lambda n: n.rlike(regex)), e)


def have_only_readonly_properties(items: str = "properties", e: Elements = Elements()) -> Condition:
    return each_item("have only readonly properties", F.transform(F.filter(F.col(items), lambda p: ~two_valued(p["is_readonly"])), lambda p: p["name"]), e)


def have_property_type(name: str, matcher, items: str = "properties", e: Elements = Elements()) -> Condition:
    wrong = F.exists(F.col(items), lambda p: (p["name"] == name) & ~two_valued(matcher(p["type_text"])))
    return element_condition(f"have {name} of the given type, if at all", ~two_valued(wrong), e)


def accept_parameter_of_type(matcher, params: str = "params", e: Elements = Elements()) -> Condition:
    return element_condition("accept a parameter of the type", F.exists(F.col(params), lambda p: two_valued(matcher(p["type_text"]))), e)


def not_accept_parameter_of_type(matcher, params: str = "params", e: Elements = Elements()) -> Condition:
    return each_item("not accept a parameter of the type", F.transform(F.filter(F.col(params), lambda p: two_valued(matcher(p["type_text"]))), lambda p: p["name"]), e)


def have_return_type_matching(matcher, c: str = "return_type", e: Elements = Elements()) -> Condition:
    return element_condition("return the type", matcher(F.col(c)), e)


def follow_pattern(shape: dict[str, str], types: DataFrame, c: str = "return_type", e: Elements = Elements()) -> Condition:
    """The returned type (a promise taken off once) has all properties with these type texts; one finding lists what is wrong."""

    def run(population: DataFrame) -> DataFrame:
        inner = F.regexp_replace(F.col(c), r"^Promise<(.*)>$", "$1")
        known = types.select(F.col("name").alias("_type"), F.map_from_arrays(F.transform("properties", lambda p: p["name"]), F.transform("properties", lambda p: p["type_text"])).alias("_props"))
        rows = population.withColumn("_type", inner).join(known, "_type", "left")
        wrong = [F.when(~two_valued(F.map_contains_key("_props", k)), f"missing {k}").when(~two_valued(F.try_element_at("_props", F.lit(k)) == t), f"wrong type of {k}") for k, t in shape.items()]
        problems = F.array_compact(F.array(*wrong))
        bad = rows.withColumn("_bad", problems).where(F.size("_bad") > 0)
        return to_violations(bad, e.name, F.concat(F.col(e.name), F.lit(" should follow the pattern: "), F.array_join("_bad", ", ")), file=e.file, line=e.line)

    return Condition("follow the pattern", run)


# bodies: owners joined with the syntax nodes inside them
def contain(nodes: DataFrame, matcher: Column, description: str = "contain the expression", key: str = "fn_id", e: Elements = Elements()) -> Condition:
    """Every owner holds a node that matches (semi join)."""

    def run(population: DataFrame) -> DataFrame:
        found = nodes.where(two_valued(matcher)).select(F.col("owner_id").alias("_owner"))
        missing = population.join(found, F.col(key) == F.col("_owner"), "left_anti")
        return to_violations(missing, e.name, F.concat(F.coalesce(F.col(e.name), F.lit("<anonymous>")), F.lit(f" should {description}")), file=e.file, line=e.line)

    return Condition(description, run)


def not_contain(nodes: DataFrame, matcher: Column, description: str = "not contain the expression", key: str = "fn_id", e: Elements = Elements(), at_match: bool = False) -> Condition:
    """A finding for each match; it points at the owner's line, or with ``at_match`` (modules) at the match's."""

    def run(population: DataFrame) -> DataFrame:
        found = nodes.where(two_valued(matcher)).select(F.col("owner_id").alias("_owner"), F.col("line").alias("_line"), F.col("text").alias("_text"))
        rows = population.join(found, F.col(key) == F.col("_owner"))
        message = F.concat(F.coalesce(F.col(e.name), F.lit("<anonymous>")), F.lit(f" should {description}, line "), F.col("_line").cast("string"))
        identity = F.concat_ws("::", F.coalesce(F.col(e.name), F.lit("")), F.lit(description), F.col("_text"))
        return to_violations(rows, e.name, message, file=e.file, line="_line" if at_match else e.line, identity=identity)

    return Condition(description, run)


def use_instead_of(nodes: DataFrame, bad: Column, good: Column, key: str = "fn_id", e: Elements = Elements()) -> Condition:
    """No bad match, and at least one good one."""
    parts = [not_contain(nodes, bad, "not use the forbidden expression", key, e), contain(nodes, good, "use the preferred expression", key, e)]
    return Condition("use one instead of the other", lambda p: parts[0].evaluate(p).unionByName(parts[1].evaluate(p)))


def not_have_empty_body(statements: str = "n_statements", kind: str | None = "body_kind", e: Elements = Elements()) -> Condition:
    """A block has a statement; expression bodies are left out."""
    ok = F.col(statements) > 0
    return element_condition("not have an empty body", ok | ~two_valued(F.col(kind) == "block") if kind else ok, e)


# call arguments
def have_argument_with_property(*names: str, e: Elements = Elements("method")) -> Condition:
    """One object argument holds all names."""
    holds = F.exists(F.col("args"), lambda a: F.size(F.array_except(F.array(*[F.lit(n) for n in names]), F.coalesce(a["prop_names"], F.array().cast("array<string>")))) == 0)
    return element_condition(f"have an argument with {', '.join(names)}", holds, e)


def not_have_argument_with_property(*names: str, e: Elements = Elements("method")) -> Condition:
    holds = F.exists(F.col("args"), lambda a: F.arrays_overlap(F.coalesce(a["prop_names"], F.array().cast("array<string>")), F.array(*[F.lit(n) for n in names])))
    return element_condition(f"not have an argument with {', '.join(names)}", ~two_valued(holds), e)


def have_callback_containing(regex: str, e: Elements = Elements("method")) -> Condition:
    """Some argument that is a function contains the expression."""
    return element_condition(f"have a callback with {regex}", F.exists(F.col("args"), lambda a: two_valued(a["kind"].isin("arrow", "function") & a["text"].rlike(regex))), e)


def not_have_callback_containing(regex: str, e: Elements = Elements("method")) -> Condition:
    return each_item(f"not have a callback with {regex}", F.transform(F.filter(F.col("args"), lambda a: two_valued(a["kind"].isin("arrow", "function") & a["text"].rlike(regex))), lambda a: a["idx"]), e)


def have_argument_containing(regex: str, e: Elements = Elements("method")) -> Condition:
    return element_condition(f"have an argument with {regex}", F.exists(F.col("args"), lambda a: two_valued(a["text"].rlike(regex))), e)


def not_have_argument_containing(regex: str, e: Elements = Elements("method")) -> Condition:
    return each_item(f"not have an argument with {regex}", F.transform(F.filter(F.col("args"), lambda a: two_valued(a["text"].rlike(regex))), lambda a: a["idx"]), e)


# markup
def have_attribute(name: str, e: Elements = Elements("tag")) -> Condition:
    return element_condition(f"have attribute {name}", F.map_contains_key("attributes", name), e)


def not_have_attribute(name: str, e: Elements = Elements("tag")) -> Condition:
    return element_condition(f"not have attribute {name}", ~F.map_contains_key("attributes", name), e)


def have_attribute_matching(name: str, regex: str, e: Elements = Elements("tag")) -> Condition:
    """Missing, without a value and not matching are told apart."""

    def run(population: DataFrame) -> DataFrame:
        value = F.try_element_at("attributes", F.lit(name))
        why = F.when(~two_valued(F.map_contains_key("attributes", name)), "is missing").when(value.isNull(), "has no value").when(~value.rlike(regex), "does not match")
        bad = population.withColumn("_why", why).where("_why IS NOT NULL")
        return to_violations(bad, e.name, F.concat(F.col(e.name), F.lit(f": {name} "), F.col("_why")), file=e.file, line=e.line)

    return Condition(f"have {name} matching {regex}", run)


def not_have_attribute_matching(name: str, regex: str, e: Elements = Elements("tag")) -> Condition:
    return element_condition(f"not have {name} matching {regex}", ~two_valued(F.try_element_at("attributes", F.lit(name)).rlike(regex)), e)


# schemas
def have_fields(*names: str, e: Elements = Elements("type_name", None, None)) -> Condition:
    return have_all(list(names), F.coalesce(F.col("type_fields"), F.array().cast("array<string>")), e, "field")


def accept_args(*names: str, e: Elements = Elements("field_name", None, None)) -> Condition:
    return have_all(list(names), F.coalesce(F.col("args"), F.array().cast("array<string>")), e, "argument")


def have_matching_resolver(resolvers: DataFrame, text: str = "text", e: Elements = Elements("field_name", None, None)) -> Condition:
    """The field's name occurs as a word in some resolver; words are compared by an equi-join."""

    def run(population: DataFrame) -> DataFrame:
        words = resolvers.select(F.explode(F.split(text, r"\W+")).alias("_word")).distinct()
        missing = population.join(words, F.col(e.name) == F.col("_word"), "left_anti")
        return to_violations(missing, e.name, F.concat(F.col(e.name), F.lit(" should have a resolver")), file=e.file, line=e.line)

    return Condition("have a matching resolver", run)


def option_is(options: DataFrame, name: str, wanted: str, umbrella: str | None = "strict") -> DataFrame:
    """Findings for roots whose compiler option isn't ``wanted``; an option of the strict family defaults to the umbrella's value."""
    value = F.try_element_at("options", F.lit(name))
    value = F.coalesce(value, F.try_element_at("options", F.lit(umbrella))) if umbrella else value
    bad = options.where(~two_valued(value == wanted))
    return to_violations(bad, "root", F.concat(F.lit(f"{name} should be {wanted}, is "), F.coalesce(value, F.lit("unset"))), file="root")
