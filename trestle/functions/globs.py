"""Path globs as Java regular expressions, and the analysis of globs that can match nothing."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache


@cache
def glob_regex(glob: str) -> str:
    """Anchored regular expression for ``** * ? [..] {a,b} !(..) ?(..) *(..) +(..) @(..)``.

    A wildcard at the start of a segment doesn't match a leading dot.
    """
    out, i, depth = [], 0, []
    start = True  # at the start of a path segment
    while i < len(glob):
        c = glob[i]
        if c in "?*+@!" and i + 1 < len(glob) and glob[i + 1] == "(":
            depth.append(c)
            out.append("(?:" if c != "!" else "(?!(?:")
            i += 2
            continue
        if c == ")" and depth:
            kind = depth.pop()
            out.append({"?": ")?", "*": ")*", "+": ")+", "@": ")", "!": ")(?:/|$))[^/]*"}[kind])
        elif c == "|" and depth:
            out.append("|")
        elif c == "*":
            if glob.startswith("**", i):
                end = i + 2
                if start and (end == len(glob) or glob[end] == "/"):
                    if end == len(glob):
                        out.append(r"(?:(?!\.)[^/]*(?:/(?!\.)[^/]*)*)")
                    else:
                        out.append(r"(?:(?!\.)[^/]*/)*")
                        end += 1
                    i, start = end, True
                    continue
                out.append("[^/]*")
                i, start = end, False
                continue
            out.append((r"(?!\.)" if start else "") + ("[^/]+" if start and (i + 1 == len(glob) or glob[i + 1] == "/") else "[^/]*"))
        elif c == "?":
            out.append((r"(?!\.)" if start else "") + "[^/]")
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                out.append(r"\[")
            else:
                body = glob[i + 1 : end]
                negated = body[:1] in "!^"
                out.append("[" + ("^/" if negated else "") + re.sub(r"([\\\[&])", r"\\\1", body[1:] if negated else body) + "]")
                i = end
        elif c == "{" and "}" in glob[i:]:
            depth.append("{")
            out.append("(?:")
        elif c == "," and depth and depth[-1] == "{":
            out.append("|")
        elif c == "}" and depth and depth[-1] == "{":
            depth.pop()
            out.append(")")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c) if c != "/" else "/")
        start = c == "/" or (c in ",{" and start)
        i += 1
    return "^" + "".join(out) + "$"


def is_anchored(glob: str) -> bool:
    """Whether a glob speaks of absolute paths: ``**/``, ``/`` or a drive."""
    return glob.startswith(("**/", "/")) or glob == "**" or bool(re.match(r"[A-Za-z]:[/\\]", glob))


def is_project_relative(glob: str) -> bool:
    return not is_anchored(glob)


def any_case(text: str) -> str:
    """Case-insensitive regular expression for a literal text."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else re.escape(c) for c in text)


@dataclass(frozen=True)
class GlobTree:
    """A selector's globs as a boolean tree: ``leaf``, ``any``, ``all`` or ``not``."""

    kind: str
    glob: str = ""
    parts: tuple[GlobTree, ...] = field(default=())
    origin: str = ""


def glob_leaf(glob: str, origin: str = "") -> GlobTree:
    return GlobTree("leaf", glob, origin=origin)


def any_of(*globs: str) -> GlobTree:
    return GlobTree("any", parts=tuple(glob_leaf(g) for g in globs))


def combine(kind: str, *trees: GlobTree) -> GlobTree:
    return GlobTree(kind, parts=trees)


def negate(tree: GlobTree) -> GlobTree:
    return GlobTree("not", parts=(tree,))


def stamp(tree: GlobTree, origin: str) -> GlobTree:
    """The tree with an origin on every leaf."""
    return GlobTree(tree.kind, tree.glob, tuple(stamp(p, origin) for p in tree.parts), origin)


def is_dead(tree: GlobTree, paths: list[str]) -> bool:
    """Whether the selector can match none of ``paths``; a negation is never dead."""
    if tree.kind == "leaf":
        rx = re.compile(glob_regex(tree.glob))
        return not any(rx.search(p) for p in paths)
    if tree.kind == "not" or not tree.parts:
        return False
    return (all if tree.kind == "any" else any)(is_dead(p, paths) for p in tree.parts)


def diagnose_glob(glob: str, files: list[str], folders: list[str]) -> str | None:
    """Why a glob matches no file: ``dot-segment``, ``unanchored``, ``folder-not-file`` or ``no-match``; None if it matches."""
    hit = lambda g, names: any(re.search(glob_regex(g), n) for n in names)
    if hit(glob, files):
        return None
    if any(part.startswith(".") and part not in (".", "..") for f in files for part in f.split("/")) and re.search(r"(^|/)\.\w", glob) is None and hit(glob.replace("**", "**/.*/**"), files):
        return "dot-segment"
    if not is_anchored(glob) and hit("**/" + glob, files):
        return "unanchored"
    return "folder-not-file" if hit(glob, folders) else "no-match"


def root_of(paths: list[str]) -> str:
    """The deepest folder that holds all paths; empty without one."""
    parts = [p.split("/")[:-1] for p in paths]
    if not parts:
        return ""
    same = []
    for names in zip(*parts):
        if len(set(names)) > 1:
            break
        same.append(names[0])
    return "/".join(same)


def by_codepoint(text: str) -> bytes:
    """Sort key of a text, the same in every locale."""
    return text.encode("utf-32-be", "surrogatepass")
