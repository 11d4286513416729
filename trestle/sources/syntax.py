"""Facts of functions, calls, callbacks, classes and types from source text, by its syntax alone.

Texts are tokenised and their brackets paired; nothing is resolved. Each producer is
one Arrow pass over the files without a shuffle, and a text is parsed whole. Workers
import this module, so a cluster needs the package (``--py-files``).

Defined results: a null or empty text has no facts; brackets that aren't closed end
with the text; what stands inside a template literal is text, not code.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: nested object literals are followed so deep
DEPTH = 3
#: what is skipped and the token behind it, which only the end of the text lacks
_LEX = re.compile(r"""(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))*(?:(?P<str>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<tpl>`)|(?P<num>\d[\w.]*)|(?P<id>[\w$\#][\w$]*)|(?P<op>=>|\.\.\.|\?\.(?!\d)|\?\?|&&|\|\||[=!]==?|.))?""", re.S | re.X)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_OPEN = {"(": ")", "[": "]", "{": "}"}
_BRACKETS = {*_OPEN, *_OPEN.values()}
_NOT_CALLED = set("if for while switch catch function return typeof await void delete in of else do case throw new yield with instanceof constructor".split())
_MODIFIERS = set("public private protected static async readonly abstract override declare accessor".split())
_DECISIONS = set("if for while case catch && || ??".split())
_ENDS_VALUE = re.compile(r"[\w$\"'`)\]}]$")
_CONTINUES = set(". ?. ( [ + - * / % & | ^ ? : = => == === != !== < > && || ?? , instanceof in as satisfies".split())

_PARAM = "struct<name:string,type_text:string,is_rest:boolean,is_optional:boolean,has_default:boolean>"
FUNCTIONS = f"file string, name string, origin string, exported boolean, is_async boolean, params array<{_PARAM}>, return_type string, scope string, body string, body_kind string, n_statements int, cc int, line int, end_line int, start int"
CALLS = "file string, name string, object string, method string, args array<struct<idx:int,kind:string,text:string,literal:string,prop_names:array<string>>>, line int, end_line int, start int"
CALLBACKS = f"{FUNCTIONS}, call_start int, arg_index int"
CLASSES = "file string, name string, exported boolean, is_abstract boolean, extends_text string, implements array<string>, decorators array<string>, members array<struct<kind:string,name:string,scope:string,cc:int,loc:int,n_params:int>>, line int, end_line int, start int"
TYPES = "file string, kind string, name string, exported boolean, properties array<struct<name:string,type_text:string,readonly:boolean>>, line int, end_line int, start int"


def qualified(path: list[str]) -> str:
    """``routes["/x"].GET``: keys that aren't identifiers stand in brackets."""
    return "".join((key if not n else f".{key}") if re.fullmatch(r"[\w$<>]+", key) else f'["{key}"]' for n, key in enumerate(path))


class Source:
    """Tokens of one text: kinds, texts, places, and the partner of each bracket."""

    def __init__(self, text: str):
        self.text = text
        self.kind: list[str] = []
        self.tok: list[str] = []
        self.at: list[int] = []
        self._lines = [m.start() for m in re.finditer("\n", text)]
        self._lex()
        self.n = len(self.tok)
        self.close = {}
        self.parent = [-1] * self.n
        stack: list[int] = []
        inside = -1
        for i, t in enumerate(self.tok):
            if t in _BRACKETS and self.kind[i] == "op":
                if stack and _OPEN[self.tok[inside]] == t:
                    self.close[stack.pop()] = i
                    inside = stack[-1] if stack else -1
                self.parent[i] = inside
                if t in _OPEN:
                    stack.append(i)
                    inside = i
            else:
                self.parent[i] = inside
        for i in stack:
            self.close[i] = self.n
        self.bodies = {b for _, b in self._class_heads(("class", "interface", "enum"))}

    def _lex(self) -> None:
        text, i, match = self.text, 0, _LEX.match
        kinds, toks, at = self.kind, self.tok, self.at
        while True:
            m = match(text, i)
            kind = m.lastgroup
            if kind is None:
                return
            i, end = m.span(kind)
            tok = m[kind]
            if kind == "tpl":
                end = self._template(i)
                kind, tok = "str", text[i:end]
            elif tok == "/" and not (toks and (kinds[-1] in ("num", "str") or (kinds[-1] == "id" and toks[-1] not in _NOT_CALLED) or toks[-1] in ")]}")):
                found = _REGEX.match(text, i)
                if found:
                    kind, end = "regex", found.end()
                    tok = text[i:end]
            kinds.append(kind)
            toks.append(tok)
            at.append(i)
            i = end

    def _template(self, i: int) -> int:
        """End of the template literal that starts at ``i``; literals inside its expressions are part of it."""
        text, open_ = self.text, ["`"]
        i += 1
        while i < len(text) and open_:
            c = text[i]
            if c == "\\":
                i += 1
            elif open_[-1] == "`":
                if c == "`":
                    open_.pop()
                elif text.startswith("${", i):
                    open_.append("{")
                    i += 1
            elif c == "`" or c == "{":
                open_.append(c)
            elif c == "}":
                open_.pop()
            i += 1
        return min(i, len(text))

    def line(self, i: int) -> int:
        return bisect_right(self._lines, (self.at[i] if i < self.n else len(self.text)) - 1) + 1

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < self.n and self.tok[i] in texts and self.kind[i] in ("op", "id")

    def span(self, a: int, b: int) -> str:
        """Text of the tokens from ``a`` to before ``b``."""
        a, b = max(a, 0), min(b, self.n)
        return self.text[self.at[a] : self.at[b - 1] + len(self.tok[b - 1])] if a < b else ""

    def split(self, a: int, b: int, at: str = ",") -> list[tuple[int, int]]:
        """Ranges between the separators of the outermost level."""
        out, i, first = [], a, a
        while i < b:
            if self.is_(i, at):
                out.append((first, i))
                first = i + 1
            i = self.close[i] + 1 if i in self.close else i + 1
        return [(x, y) for x, y in [*out, (first, b)] if x < y]

    def _class_heads(self, words: tuple[str, ...]) -> Iterator[tuple[int, int]]:
        for i, t in enumerate(self.tok):
            if t in words and self.is_(i, *words) and not self.is_(i - 1, ".", "?."):
                j = i + 1
                while j < self.n and not self.is_(j, "{", ";"):
                    j = self.close[j] + 1 if j in self.close else j + 1
                if self.is_(j, "{"):
                    yield i, j

    def modifiers(self, i: int) -> tuple[set[str], int]:
        """Words before a declaration (``export default async``), and where they start."""
        words = set()
        while self.is_(i - 1, "export", "default", "async", "abstract", "declare"):
            i -= 1
            words.add(self.tok[i])
        return words, i

    def value(self, i: int) -> dict | None:
        """The arrow function or function expression at ``i``."""
        start, is_async = i, self.is_(i, "async") and not self.is_(i + 1, "=>")
        i += is_async
        if self.is_(i, "function"):
            i += 1 + self.is_(i + 1, "*")
            name = None
            if i < self.n and self.kind[i] == "id":
                name, i = self.tok[i], i + 1
            i = self._generic(i)
            return self.rest(start, i, is_async) | {"name": name, "shape": "function"} if self.is_(i, "(") else None
        i = self._generic(i)
        if self.is_(i, "("):
            k = self.close[i] + 1
            returns = None
            if self.is_(k, ":"):
                j = self.type_end(k + 1, "=>")
                returns, k = self.span(k + 1, j), j
            if not self.is_(k, "=>"):
                return None
            params = self.params(i)
        elif i < self.n and self.kind[i] == "id" and self.is_(i + 1, "=>"):
            params, returns, k = [dict(name=self.tok[i], type_text=None, is_rest=False, is_optional=False, has_default=False)], None, i + 1
        else:
            return None
        block = self.is_(k + 1, "{")
        end = min(self.close[k + 1] + 1, self.n) if block else self.expression_end(k + 1)
        return self._fn(start, k + 1, end, block, params, returns, is_async) | {"name": None, "shape": "arrow"}

    def rest(self, start: int, paren: int, is_async: bool) -> dict:
        """A function from its parameters on; one without a body ends where they do."""
        params, k, returns = self.params(paren), self.close[paren] + 1, None
        if self.is_(k, ":"):
            j = self.type_end(k + 1, "{", ";")
            returns, k = self.span(k + 1, j), j
        if self.is_(k, "{"):
            return self._fn(start, k, min(self.close[k] + 1, self.n), True, params, returns, is_async)
        return self._fn(start, k, k, None, params, returns, is_async)

    def _fn(self, start, body, end, block, params, returns, is_async) -> dict:
        inner = [i for i in range(body, min(end, self.n)) if self.tok[i] in _DECISIONS or self.tok[i] == "?"]
        cc = 1 + sum(self.is_(i, *_DECISIONS) or (self.is_(i, "?") and not self.is_(i + 1, ":", ")", ",")) for i in inner)
        return dict(
            params=params, return_type=returns, is_async=is_async, body=self.span(body, end) if body < end else None, cc=cc,
            body_kind=None if block is None else "block" if block else "expression", n_statements=self._statements(body, end) if block else None if block is None else 1,
            line=self.line(start), end_line=self.line(end - 1), start=self.at[start], _body=body, _end=end,
        )

    def _statements(self, body: int, end: int) -> int:
        n, i, fresh = 0, body + 1, True
        last = min(end - 1, self.close.get(body, end))
        while i < last:
            if self.is_(i, ";"):
                fresh = True
                i += 1
                continue
            newline = i > body + 1 and self.line(i) > self.line(i - 1) and not self.is_(i, "else", "catch", "finally", *_CONTINUES) and bool(_ENDS_VALUE.search(self.tok[i - 1]))
            n += fresh or newline
            fresh = False
            i = self.close[i] + 1 if i in self.close else i + 1
        return n

    def _generic(self, i: int) -> int:
        """Behind ``<...>``, if it stands at ``i``."""
        if not self.is_(i, "<"):
            return i
        depth, j = 0, i
        while j < self.n and not self.is_(j, ";", "{", "("):
            depth += self.is_(j, "<") - self.is_(j, ">")
            j += 1
            if not depth:
                return j
        return i

    def type_end(self, i: int, *stops: str) -> int:
        """Where a type ends; a brace that starts it belongs to it."""
        first = i
        while i < self.n and not (self.is_(i, *stops) and i > first) and not self.is_(i, ")", "]", "}", ";", ","):
            i = self.close[i] + 1 if i in self.close else i + 1
            if i < self.n and self.line(i) > self.line(i - 1) and not self.is_(i, "|", "&", *stops):
                break
        return min(i, self.n)

    def expression_end(self, i: int) -> int:
        first = i
        while i < self.n and not self.is_(i, ",", ";", ")", "]", "}"):
            if i > first and self.line(i) > self.line(i - 1) and self.tok[i] not in _CONTINUES and _ENDS_VALUE.search(self.tok[i - 1]):
                break
            i = self.close[i] + 1 if i in self.close else i + 1
        return min(i, self.n)

    def params(self, paren: int) -> list[dict]:
        out = []
        for a, b in self.split(paren + 1, self.close[paren]):
            while self.is_(a, "@") or self.is_(a, *_MODIFIERS) and a + 1 < b and not self.is_(a + 1, ":", "=", "?"):
                a += 2 if self.is_(a, "@") else 1
                a = self.close[a] + 1 if self.is_(a, "(") else a
            spread = self.is_(a, "...")
            a += spread
            name_end = self.close[a] + 1 if a in self.close else a + 1
            k, optional = name_end, self.is_(name_end, "?")
            k += optional
            type_text, equals = None, next((i for i in range(k, b) if self.is_(i, "=") and self.parent[i] == paren), None)
            if self.is_(k, ":"):
                type_text = self.span(k + 1, b if equals is None else equals)
            out.append(dict(name=self.span(a, name_end), type_text=type_text, is_rest=spread, is_optional=optional or equals is not None, has_default=equals is not None))
        return out

    def key(self, i: int) -> tuple[str, int]:
        """A property's name and the token behind it."""
        if self.is_(i, "["):
            return "<computed>", self.close[i] + 1
        return (self.tok[i][1:-1] if self.kind[i] == "str" else self.tok[i]), i + 1

    def object_functions(self, brace: int, path: list[str], depth: int = 0) -> Iterator[tuple[list[str], dict]]:
        """Functions that are values of an object literal, with the keys that lead there; those in function bodies aren't."""
        if depth >= DEPTH:
            return
        for a, b in self.split(brace + 1, self.close[brace]):
            words, i = set(), a
            while self.is_(i, "async", "get", "set", "*") and i + 1 < b and not self.is_(i + 1, "(", ":", ","):
                words.add(self.tok[i])
                i += 1
            if self.is_(i, "..."):
                continue
            name, k = self.key(i)
            k = self._generic(k)
            if self.is_(k, "("):
                if not words & {"get", "set"}:
                    yield [*path, name], self.rest(a, k, "async" in words)
            elif self.is_(k, ":"):
                found = self.value(k + 1)
                if found:
                    yield [*path, name], found
                elif self.is_(k + 1, "{") and self.close[k + 1] + 1 == b:
                    yield from self.object_functions(k + 1, [*path, name], depth + 1)

    def literals(self) -> Iterator[tuple[int, str | None]]:
        """Object literals that no other contains, with the binding they are assigned to."""
        behind = -1
        for i in range(self.n):
            if self.tok[i] != "{" or i < behind or not self.is_(i, "{") or i in self.bodies or not (self.is_(i - 1, "=", "(", ",", "[", "?", ":", "return", "??", "||", "&&") or (self.is_(i - 1, "default") and self.is_(i - 2, "export"))):
                continue
            if self.is_(i - 1, "(", ",") and self.is_(self.close[i] + 1, ":") or self.is_(i - 1, "case", "default") or self.is_(i - 1, ":") and not self.is_(self.parent[i], "{", "(", "["):
                continue
            owner = None
            if self.is_(i - 1, "="):
                j = i - 2
                while j > 0 and not self.is_(j, "const", "let", "var", ";", "{", "}", "=") and self.line(j) == self.line(i):
                    j -= 1
                owner = self.tok[j + 1] if self.is_(j, "const", "let", "var") else self.tok[i - 2] if self.kind[i - 2] == "id" and self.parent[i] in self.bodies else None
            behind = self.close[i]
            yield i, owner

    def functions(self) -> Iterator[dict]:
        """Declared functions, arrow functions of variables, methods, and functions of object literals, of the file's outermost level (the last of any)."""
        for i in range(self.n):
            if self.parent[i] != -1 or self.is_(i - 1, ".", "?."):
                continue
            if self.is_(i, "function"):
                words, first = self.modifiers(i)
                found = self.value(i - ("async" in words))
                before = first - 1
                if found and (before < 0 or self.line(before) < self.line(first) and not self.is_(before, "=", "(", ",", "=>") or self.is_(before, ";", "}")):
                    if found["body"] is not None:
                        yield found | {"origin": "declaration", "exported": "export" in words, "scope": "public", "line": self.line(first), "start": self.at[first]}
            elif self.is_(i, "const", "let", "var"):
                words, _ = self.modifiers(i)
                for name, at, eq in self._declarators(i + 1):
                    found = self.value(eq + 1)
                    if found and found["shape"] == "arrow":
                        yield found | {"name": name, "origin": "arrow", "exported": "export" in words, "scope": "public", "line": self.line(at), "start": self.at[at]}
        for cls in self.classes():
            if self.parent[cls["_brace"]] == -1:
                for m in cls["_methods"]:
                    yield m | {"name": f"{cls['name'] or '<anonymous>'}.{m['name']}", "origin": "method", "exported": cls["exported"]}
        for brace, owner in self.literals():
            for path, found in self.object_functions(brace, [owner] if owner else []):
                yield found | {"name": qualified(path), "origin": "object_literal", "exported": False, "scope": "public"}

    def _declarators(self, i: int) -> Iterator[tuple[str, int, int]]:
        while i < self.n and self.kind[i] == "id":
            name, at, k = self.tok[i], i, i + 1
            if self.is_(k, ":"):
                while k < self.n and not self.is_(k, "=", ";", ","):
                    k = self.close[k] + 1 if k in self.close else k + 1
            if not self.is_(k, "="):
                return
            yield name, at, k
            found = self.value(k + 1)
            end = found["_end"] if found else self.expression_end(k + 1)
            if not self.is_(end, ","):
                return
            i = end + 1

    def classes(self) -> Iterator[dict]:
        for i, brace in self._class_heads(("class",)):
            words, first = self.modifiers(i)
            named = self.kind[i + 1] == "id" and not self.is_(i + 1, "extends", "implements")
            decorators = []
            j = first - 1
            while j > 0:
                k = next((o for o, c in self.close.items() if c == j), j) - (self.is_(j, ")") and 1 or 0)
                while self.is_(k - 1, "."):
                    k -= 2
                if not self.is_(k - 1, "@"):
                    break
                decorators.append(re.sub(r"\(.*", "", self.span(k, j + 1), flags=re.S))
                j = k - 2
            extends = next((k for k in range(i + 1, brace) if self.is_(k, "extends") and self.parent[k] == self.parent[i]), None)
            implements = next((k for k in range(i + 1, brace) if self.is_(k, "implements") and self.parent[k] == self.parent[i]), None)
            members, methods = [], []
            for m in self._members(brace):
                members.append({k: m[k] for k in ("kind", "name", "scope", "cc", "loc", "n_params")})
                if m["kind"] == "method":
                    methods.append(m["fn"] | {"name": m["name"], "scope": m["scope"]})
            yield dict(
                name=self.tok[i + 1] if named else None, exported="export" in words, is_abstract="abstract" in words, extends_text=self.span(extends + 1, implements or brace) if extends else None,
                implements=[self.span(a, b) for a, b in self.split(implements + 1, brace)] if implements else [], decorators=decorators[::-1], members=members,
                line=self.line(first), end_line=self.line(self.close[brace]), start=self.at[first], _brace=brace, _methods=methods,
            )

    def _members(self, brace: int) -> Iterator[dict]:
        i, last = brace + 1, self.close[brace]
        while i < last:
            first, words = i, set()
            while i < last and (self.is_(i, *_MODIFIERS, "get", "set", "*") and not self.is_(i + 1, "(", "=", ":", ";", "?") or self.is_(i, "@", ";")):
                words.add(self.tok[i])
                if self.is_(i, "@"):
                    i += 2
                    while self.is_(i, "."):
                        i += 2
                    i = self.close[i] + 1 if self.is_(i, "(") else i
                else:
                    i += 1
                if self.is_(i - 1, ";"):
                    first, words = i, set()
            if i >= last:
                return
            scope = next((s for s in ("private", "protected") if s in words), "public")
            name, k = self.key(i)
            k = self._generic(k + self.is_(k, "?", "!"))
            if self.is_(k, "("):
                fn = self.rest(first, k, "async" in words)
                kind = "constructor" if name == "constructor" else "getter" if "get" in words else "setter" if "set" in words else "method"
                i = max(fn["_end"], k + 1)
                if fn["body"] is not None or "abstract" in words:
                    yield dict(kind=kind, name=name, scope=scope, cc=fn["cc"], loc=fn["end_line"] - fn["line"] + 1, n_params=len(fn["params"]), fn=fn)
            elif self.is_(i, "{"):
                i = self.close[i] + 1
            else:
                end = k
                while end < last and not self.is_(end, ";") and not (end > k and self.line(end) > self.line(end - 1) and self.tok[end] not in _CONTINUES and not self.is_(end - 1, "=", ":", "=>")):
                    end = self.close[end] + 1 if end in self.close else end + 1
                yield dict(kind="property", name=name, scope=scope, cc=None, loc=self.line(max(end - 1, first)) - self.line(first) + 1, n_params=None)
                i = max(end, i + 1)

    def types(self) -> Iterator[dict]:
        for i in range(self.n):
            if self.parent[i] != -1 or not self.is_(i, "interface", "type") or i + 1 >= self.n or self.kind[i + 1] != "id" or self.is_(i - 1, ".", "import", "{", ","):
                continue
            words, first = self.modifiers(i)
            alias = self.is_(i, "type")
            k = i + 2
            while k < self.n and not self.is_(k, "{", ";", "=" if alias else "{"):
                k = self.close[k] + 1 if k in self.close else k + 1
            if alias and not self.is_(k, "=") or not alias and not self.is_(k, "{"):
                continue
            k += alias
            end = min(self.close[k] + 1, self.n) if self.is_(k, "{") else self.type_end(k)
            props = [self._property(a, b) for a, b in self._type_members(k)] if self.is_(k, "{") else []
            yield dict(kind="type_alias" if alias else "interface", name=self.tok[i + 1], exported="export" in words, properties=[p for p in props if p], line=self.line(first), end_line=self.line(end - 1), start=self.at[first])

    def _type_members(self, brace: int) -> Iterator[tuple[int, int]]:
        i, last = brace + 1, min(self.close[brace], self.n)
        first = i
        while i < last:
            i = self.close[i] + 1 if i in self.close else i + 1
            if i >= last or self.is_(i, ";", ",") or self.line(i) > self.line(i - 1) and not self.is_(i, "|", "&") and not self.is_(i - 1, ":", "|", "&"):
                if first < min(i, last):
                    yield first, min(i, last)
                i += self.is_(i, ";", ",")
                first = i

    def _property(self, a: int, b: int) -> dict | None:
        readonly = self.is_(a, "readonly") and a + 1 < b and not self.is_(a + 1, ":", "?")
        a += readonly
        if self.is_(a, "["):
            return None
        name, k = self.key(a)
        k += self.is_(k, "?")
        return dict(name=name, type_text=self.span(k + 1, b), readonly=readonly) if self.is_(k, ":") and k < b else None

    def _callee(self, paren: int) -> int | None:
        """Where the expression that is called at ``paren`` starts; None where nothing is."""
        opened = {c: o for o, c in self.close.items()} if not hasattr(self, "_opened") else self._opened
        self._opened = opened
        i = paren - 1
        if self.is_(i, ">"):
            j = i
            while j > 0 and not self.is_(j, "<"):
                if self.is_(j, ";", "{", "}", "&&", "||"):
                    return None
                j -= 1
            i = j - 1
        i -= self.is_(i, "?.")
        while True:
            if i < 0:
                return None
            if self.is_(i, ")", "]"):
                o = opened.get(i)
                if o is None:
                    return None
                bare = self.is_(i, ")") and (o == 0 or not (self.kind[o - 1] in ("id", "str") and self.tok[o - 1] not in _NOT_CALLED or self.is_(o - 1, ")", "]", "?.")))
                i = o if bare else o - 1 - self.is_(o - 1, "?.")
                if not bare:
                    continue
            elif self.kind[i] == "op" or self.kind[i] == "num" or (self.kind[i] == "id" and self.tok[i] in _NOT_CALLED and not self.is_(i - 1, ".", "?.")):
                return None
            if self.is_(i - 1, ".", "?."):
                i -= 2
                continue
            return i

    def calls(self) -> Iterator[dict]:
        """Every call, nested ones too; ``new`` and the heads of methods are none."""
        for paren in range(1, self.n):
            if self.tok[paren] != "(" or not self.is_(paren, "("):
                continue
            first = self._callee(paren)
            if first is None or self.is_(first - 1, "function") or self.is_(first - 1, "*") and self.is_(first - 2, "function"):
                continue
            close = self.close[paren]
            if self.is_(first, "async") and self.value(first):
                continue
            if self.parent[paren] in self.bodies and (first == paren - 1 or self.is_(paren - 1, ">")) and not self.is_(first - 1, "=", ":", "@", "+", "(", ","):
                continue
            if self.is_(close + 1, "{") and self.line(close) == self.line(close + 1) or self.is_(close + 1, "=>"):
                continue
            if self.is_(first - 1, "new"):
                if not any(self.is_(k, "(") for k in range(first, paren)):
                    continue
                first -= 1
            end = paren - 1
            if self.is_(end, ">"):
                while not self.is_(end, "<"):
                    end -= 1
                end -= 1
            end -= self.is_(end, "?.")
            dotted = self.kind[end] == "id" and end > first and self.is_(end - 1, ".", "?.")
            method = self.tok[end] if dotted else self.span(first, end + 1)
            obj = self.span(first, end - 1) if dotted else None
            args = [self._argument(n, a, b) for n, (a, b) in enumerate(self.split(paren + 1, close))]
            yield dict(name=f"{obj}.{method}" if dotted else method, object=obj, method=method, args=args, line=self.line(first), end_line=self.line(close), start=self.at[first], _paren=paren)

    def _argument(self, n: int, a: int, b: int) -> dict:
        fn = self.value(a)
        literal, props = None, None
        if fn and fn["_end"] >= b:
            kind = fn["shape"]
        elif self.is_(a, "{") and self.close[a] + 1 == b:
            kind, props = "object", [self.key(x + self.is_(x, "async"))[0] for x, _ in self.split(a + 1, self.close[a]) if not self.is_(x, "...")]
        elif b == a + 1:
            kind = {"str": "template" if self.tok[a][0] == "`" and "${" in self.tok[a] else "string", "num": "number", "id": "identifier"}.get(self.kind[a], "other")
            literal = self.tok[a][1:-1] if kind == "string" else None
        else:
            kind = "other"
        return dict(idx=n, kind=kind, text=self.span(a, b), literal=literal, prop_names=props)

    def callbacks(self) -> Iterator[dict]:
        """Functions that are arguments of calls, or values in an object literal that is one."""
        for call in self.calls():
            paren = call["_paren"]
            for n, (a, b) in enumerate(self.split(paren + 1, self.close[paren])):
                fn, found = self.value(a), []
                if fn and fn["_end"] >= b:
                    found = [(fn["name"] if fn["shape"] == "function" else None, fn)]
                elif self.is_(a, "{") and self.close[a] + 1 == b:
                    found = [(qualified(path), f) for path, f in self.object_functions(a, [])]
                for name, f in found:
                    yield f | {"name": name, "origin": "callback", "exported": False, "scope": "public", "call_start": call["start"], "arg_index": n}


def _facts(files: DataFrame, schema: str, rows: Callable[[Source], Iterator[dict]]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        for batch in batches:
            out = []
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    out += [{"file": file, **{n: row.get(n) for n in arrow.names if n != "file"}} for row in rows(Source(text))]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return files.select("file", "text").mapInArrow(run, struct)


def functions(files: DataFrame, methods: bool = True, object_literals: bool = False) -> DataFrame:
    """``functions`` facts of ``files(file, text)``: declarations, arrow functions of variables, methods, and functions in object literals where asked for."""
    origins = ["declaration", "arrow", *["method"] * methods, *["object_literal"] * object_literals]
    return _facts(files, FUNCTIONS, Source.functions).where(F.col("origin").isin(origins)).withColumn("fn_id", F.xxhash64("file", "start"))


def calls(files: DataFrame) -> DataFrame:
    """``calls`` facts: the callee split into object and method, its arguments, and its place."""
    return _facts(files, CALLS, Source.calls).withColumn("call_id", F.xxhash64("file", "start", "end_line", "name"))


def callbacks(files: DataFrame) -> DataFrame:
    """Functions given to calls: ``functions`` facts, the call's start and the argument's number from 0."""
    return _facts(files, CALLBACKS, Source.callbacks).withColumn("fn_id", F.xxhash64("file", "start"))


def classes(files: DataFrame) -> DataFrame:
    """``classes`` facts with members, heritage and decorators."""
    return _facts(files, CLASSES, Source.classes)


def types(files: DataFrame) -> DataFrame:
    """``types`` facts: interfaces and type aliases with the properties they list."""
    return _facts(files, TYPES, Source.types)


def with_argument(index: int, elide: bool = False, name: str = "name", args: str = "args"):
    """A call's name with one of its arguments in brackets, where that is a plain string; long ones keep 38 characters at each end if ``elide``."""
    arg = F.get(F.filter(args, lambda a: (a["idx"] == index) & (a["kind"] == "string")), 0)["text"]
    short = F.when(F.length(arg) > 80, F.concat(F.substring(arg, 1, 38), F.lit("…"), F.right(arg, F.lit(38)))).otherwise(arg) if elide else arg
    return F.coalesce(F.concat(F.col(name), F.lit("("), short, F.lit(")")), F.col(name))
