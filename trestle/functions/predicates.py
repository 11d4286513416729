"""Two-valued predicates: Columns that are true or false, never null.

A missing name fails a name predicate, and its negation then holds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .globs import glob_regex, is_project_relative


def two_valued(condition: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(condition, F.lit(False))


define_predicate = two_valued


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_(p: Column) -> Column:
    return ~two_valued(p)


def and_(*ps: Column) -> Column:
    return reduce(lambda a, b: a & b, map(two_valued, ps), F.lit(True))


def or_(*ps: Column) -> Column:
    return reduce(lambda a, b: a | b, map(two_valued, ps), F.lit(False))


def equals_or_matches(c: Column | str, text: str | None = None, regex: str | None = None) -> Column:
    """Equal to ``text``, or containing a match of ``regex``."""
    return two_valued(col(c) == text if regex is None else col(c).rlike(regex))


# paths
def to_portable_path(path: Column | str) -> Column:
    """Forward slashes, no drive letter in capitals, no doubled or trailing slash."""
    text = F.regexp_replace(F.regexp_replace(col(path), r"\\", "/"), r"(?<!:)//+", "/")
    drive = F.regexp_extract(text, r"^([A-Za-z]):", 1)
    text = F.when(drive != "", F.concat(F.lower(drive), F.substring(text, F.lit(2), F.length(text)))).otherwise(text)
    return F.regexp_replace(text, r"(?<=.)/$", "")


def relative_to_root(path: Column | str, root: str) -> Column:
    """The path below ``root``; null for one that isn't below it, ``.`` for the root itself."""
    base = root.rstrip("/")
    p = col(path)
    return F.when(p == base, ".").when(p.startswith(base + "/"), F.substring(p, F.lit(len(base) + 2), F.length(p)))


# names and places
def have_name_matching(regex: str, name: Column | str = "name") -> Column:
    return two_valued(col(name).rlike(regex))


def have_name_starting_with(prefix: str, name: Column | str = "name") -> Column:
    return two_valued(col(name).startswith(prefix))


def have_name_ending_with(suffix: str, name: Column | str = "name") -> Column:
    return two_valued(col(name).endswith(suffix))


def path_matches(glob: str, path: Column | str = "file", rel_path: Column | str | None = "rel_path") -> Column:
    """Glob on the absolute path, or on the root-relative path where the glob is relative and there is one."""
    if is_project_relative(glob) and rel_path is not None:
        return two_valued(col(rel_path).rlike(glob_regex(glob)))
    return two_valued(col(path).rlike(glob_regex(glob)))


reside_in_file = have_path_matching = path_matches


def reside_in_folder(glob: str, folder: Column | str = "folder", rel_folder: Column | str | None = None) -> Column:
    return path_matches(glob, folder, rel_folder)


def at_path(path: str, file: Column | str = "rel_path") -> Column:
    """The file itself, or anything below the folder."""
    clean = path.rstrip("/")
    return two_valued((col(file) == clean) | col(file).startswith(clean + "/"))


# flags
def flag(c: Column | str, wanted: bool = True) -> Column:
    return two_valued(col(c).cast("boolean") == wanted) if wanted else not_(col(c).cast("boolean"))


def are_exported(c: Column | str = "exported") -> Column:
    return flag(c)


def are_not_exported(c: Column | str = "exported") -> Column:
    return flag(c, False)


def are_async(c: Column | str = "is_async") -> Column:
    return flag(c)


def are_not_async(c: Column | str = "is_async") -> Column:
    return flag(c, False)


def are_abstract(c: Column | str = "is_abstract") -> Column:
    return flag(c)


def of_scope(scope: str, c: Column | str = "scope") -> Column:
    """``public``, ``protected`` or ``private``."""
    return two_valued(col(c) == scope)


def are_public(c: Column | str = "scope") -> Column:
    return of_scope("public", c)


def are_protected(c: Column | str = "scope") -> Column:
    return of_scope("protected", c)


def are_private(c: Column | str = "scope") -> Column:
    return of_scope("private", c)


def of_kind(kind: str, c: Column | str = "kind") -> Column:
    return two_valued(col(c) == kind)


def are_interfaces(c: Column | str = "kind") -> Column:
    return of_kind("interface", c)


def are_type_aliases(c: Column | str = "kind") -> Column:
    return of_kind("alias", c)


def export_symbol_named(exports: DataFrame, name: str) -> Callable[[DataFrame], DataFrame]:
    """Modules (``file``) that export a symbol of that name: a function of the population, by a semi join with ``exports(file, name)``."""
    found = exports.where(F.col("name") == name).select("file")
    return lambda modules: modules.join(found, "file", "left_semi")


# members of arrays of structs
def some(items: Column | str, test) -> Column:
    """Any item of an array passes; ``test`` takes the item."""
    return two_valued(F.exists(col(items), lambda x: two_valued(test(x))))


def every(items: Column | str, test) -> Column:
    return two_valued(F.forall(col(items), lambda x: two_valued(test(x))))


def extend(base: str, c: Column | str = "extends_text") -> Column:
    return two_valued(col(c) == base)


def implement(name: str, c: Column | str = "implements") -> Column:
    return some(c, lambda x: x == name)


def have_decorator(name: str, c: Column | str = "decorators") -> Column:
    return some(c, lambda x: x == name)


def have_decorator_matching(regex: str, c: Column | str = "decorators") -> Column:
    return some(c, lambda x: x.rlike(regex))


def have_method_named(name: str, c: Column | str = "members") -> Column:
    return some(c, lambda m: (m["kind"] == "method") & (m["name"] == name))


def have_method_matching(regex: str, c: Column | str = "members") -> Column:
    return some(c, lambda m: (m["kind"] == "method") & m["name"].rlike(regex))


def have_property_named(name: str, c: Column | str = "properties") -> Column:
    return some(c, lambda p: p["name"] == name)


have_property = have_property_named


def have_property_of_type(name: str, matcher, c: Column | str = "properties") -> Column:
    return some(c, lambda p: (p["name"] == name) & matcher(p["type_text"]))


def parameter_count(c: Column | str = "params") -> Column:
    return F.coalesce(F.size(col(c)), F.lit(0))


def have_parameter_count(n: int, c: Column | str = "params") -> Column:
    return parameter_count(c) == n


def have_parameter_count_greater_than(n: int, c: Column | str = "params") -> Column:
    return parameter_count(c) > n


def have_parameter_count_less_than(n: int, c: Column | str = "params") -> Column:
    return parameter_count(c) < n


def have_parameter_named(name: str, c: Column | str = "params") -> Column:
    return some(c, lambda p: p["name"] == name)


def have_parameter_name_matching(regex: str, c: Column | str = "params") -> Column:
    return some(c, lambda p: p["name"].rlike(regex))


def have_rest_parameter(c: Column | str = "params") -> Column:
    return some(c, lambda p: p["is_rest"])


def have_optional_parameter(c: Column | str = "params") -> Column:
    return some(c, lambda p: two_valued(p["is_optional"]) | two_valued(p["has_default"]))


def have_parameter_of_type(index: int, matcher, c: Column | str = "params") -> Column:
    """False where there is no such parameter."""
    return two_valued(matcher(F.get(col(c), index)["type_text"]))


def have_return_type(text: str | None = None, regex: str | None = None, c: Column | str = "return_type") -> Column:
    return equals_or_matches(c, text, regex)


def extend_type(name: str, kind: Column | str = "kind", extends: Column | str = "extends", text: Column | str = "text") -> Column:
    """An interface that extends ``name``, or an alias whose text has the word."""
    return or_((col(kind) == "interface") & some(extends, lambda x: x == name), (col(kind) == "alias") & col(text).rlike(rf"\b{name}\b"))


# calls
def chain_text(c: Column | str) -> Column:
    """Callee text with optional chaining made plain."""
    return F.regexp_replace(col(c), r"\?\.", ".")


def on_object(name: str, c: Column | str = "object") -> Column:
    return two_valued(chain_text(c) == name)


def with_method(text: str | None = None, regex: str | None = None, c: Column | str = "method") -> Column:
    return equals_or_matches(c, text, regex)


def with_arg_matching(index: int, regex: str, c: Column | str = "args") -> Column:
    return two_valued(F.get(col(c), index)["text"].rlike(regex))


def with_string_arg(index: int, glob: str, c: Column | str = "args") -> Column:
    arg = F.get(col(c), index)
    return two_valued((arg["kind"] == "string") & arg["literal"].rlike(glob_regex(glob)))


# elements of markup
def are_html_elements(*tags: str, c: Column | str = "tag") -> Column:
    if not tags:
        raise ValueError("name at least one tag")
    return two_valued((F.lower(col(c)) == col(c)) & col(c).isin(*tags))


def are_components(*names: str, c: Column | str = "tag", html: Column | str = "is_html") -> Column:
    component = not_(col(html))
    return component & two_valued(col(c).isin(*names)) if names else component


def with_attribute(name: str, c: Column | str = "attributes") -> Column:
    """Present, with or without a value."""
    return two_valued(F.map_contains_key(col(c), name))


def with_attribute_matching(name: str, text: str | None = None, regex: str | None = None, c: Column | str = "attributes") -> Column:
    """An attribute without a value never matches."""
    return equals_or_matches(F.try_element_at(col(c), F.lit(name)), text, regex)


# measures
def more_than(c: Column | str, n: float) -> Column:
    return two_valued(col(c) > n)


def lines_of_code(line: Column | str = "line", end_line: Column | str = "end_line") -> Column:
    return col(end_line) - col(line) + 1


def have_complexity(n: int, c: Column | str = "cc") -> Column:
    return more_than(c, n)


def have_cyclomatic_complexity(n: int, c: Column | str = "members") -> Column:
    """A class with any member above ``n``."""
    return some(c, lambda m: m["cc"] > n)


def have_more_lines_than(n: int, line: Column | str = "line", end_line: Column | str = "end_line") -> Column:
    return more_than(lines_of_code(line, end_line), n)


def method_count(c: Column | str = "members") -> Column:
    return F.coalesce(F.size(F.filter(col(c), lambda m: m["kind"] == "method")), F.lit(0))


def have_more_methods_than(n: int, c: Column | str = "members") -> Column:
    return method_count(c) > n


# schemas
def queries(c: Column | str = "type_name") -> Column:
    return two_valued(col(c) == "Query")


def mutations(c: Column | str = "type_name") -> Column:
    return two_valued(col(c) == "Mutation")


def types_named(text: str | None = None, regex: str | None = None, c: Column | str = "type_name", field: Column | str = "field_name") -> Column:
    return col(field).isNull() & equals_or_matches(c, text, regex)


def return_list_of(name: str, c: Column | str = "field_type") -> Column:
    return two_valued(col(c).rlike(rf"^\[\s*{name}!?\s*\]!?$"))


def resolve_field_returning(text: str | None = None, regex: str | None = None, c: Column | str = "return_type") -> Column:
    return two_valued(F.contains(col(c), F.lit(text)) if regex is None else col(c).rlike(regex))
