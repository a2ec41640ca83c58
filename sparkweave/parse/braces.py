"""Rust, C, C#, TypeScript and JavaScript source to symbols and references, by hand-written readers of their declarations.

No grammar files are needed. A file is cut into tokens (comments and preprocessor conditions dropped, strings kept as one token), brackets are
matched, and declarations are read from the outside in; everything else is an expression, in which names are uses. Code that
does not balance is read as far as it goes and reported as a syntax error.
"""

from __future__ import annotations

import re
from types import SimpleNamespace

from sparkweave.parse import Parsed, decode

_COMMON = r"(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))"
_STRING = r"\"(?:\\.|[^\"\\\n])*\"?"
_CHAR = r"'(?:\\.[^'\n]*|[^'\\\n])'"
_TAIL = r"|(?P<num>\d[\w.]*)|(?P<id>[A-Za-z_$\u0080-\U0010ffff][\w$]*)|(?P<op>=>|->|::|\?\.|\+\+|--|[-+*/%&|^<>=!]=|===|!==|&&|\|\||\.\.\.?|.)"
_LEX = {
    "c": re.compile(_COMMON + r"|(?P<pp>\#(?:\\\r?\n|[^\n])*)|(?P<str>[LuU8]*" + _STRING + r"|[LuU]?'(?:\\.|[^'\\\n])+')" + _TAIL, re.S),
    "rust": re.compile(_COMMON + r"|(?P<str>b?r(?P<h>\#*)\".*?\"(?P=h)|b?" + _STRING.replace(r"\n", "") + "|b?" + _CHAR + r"|'[a-z_]\w*\b(?!'))" + _TAIL, re.S),
    "csharp": re.compile(_COMMON + r"|(?P<pp>^[ \t]*\#[^\n]*)|(?P<str>\"\"\".*?\"\"\"|\$?@\$?\"(?:\"\"|[^\"])*\"|\$?" + _STRING + "|" + _CHAR + r")|(?P<vid>@(?=[A-Za-z_]))" + _TAIL, re.S | re.M),
    "typescript": re.compile(_COMMON + r"|(?P<str>`(?:\\.|[^`\\])*`?|" + _STRING + r"|'(?:\\.|[^'\\\n])*'?)|(?P<priv>\#(?=[A-Za-z_]))" + _TAIL, re.S),
}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="}
_JOIN = {".", "::", "->", "?."}
_WORDS = {
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool NULL",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while union i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 bool str char",
    "csharp": "abstract as async await base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach get goto if implicit in int interface internal is lock long namespace new null object operator out override params partial private protected public readonly record ref required return sbyte sealed set init short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using value var virtual void volatile when where while with yield",
    "typescript": "abstract any as async await boolean break case catch class const continue debugger declare default delete do else enum export extends false finally for from function get if implements import in infer instanceof interface is keyof let module namespace never new null number object of private protected public readonly require return set static string super switch symbol this throw true try type typeof undefined unknown var void while with yield",
}
KEYWORDS = {k: frozenset(v.split()) for k, v in _WORDS.items()}


class Reader:
    """Tokens of a file with matched brackets, and what all languages share."""

    lang = ""

    def __init__(self, path: str, text: str, module: str) -> None:
        self.out = Parsed(module=module)
        self.path_name, self.words = path, KEYWORDS[self.lang]
        self.k: list[str] = []  # kinds
        self.s: list[str] = []  # texts
        self.line: list[int] = []
        self.col: list[int] = []
        self.pre: list[tuple[str, int]] = []
        line, start = 1, 0
        for m in _LEX[self.lang].finditer(text):
            kind, s = m.lastgroup, m.group()
            kind = "str" if m.groupdict().get("h") is not None else kind
            if kind == "pp":
                self.pre.append((s.strip(), line))
            elif kind not in ("space", "vid", "priv"):
                self.k.append(kind)
                self.s.append(s)
                self.line.append(line)
                self.col.append(m.start() - start)
            n = s.count("\n")
            if n:
                line += n
                start = m.start() + s.rindex("\n") + 1
        self.n = len(self.s)
        self.match = [0] * self.n
        stack: list[int] = []
        bad = 0
        for i, s in enumerate(self.s):
            if self.k[i] != "op":
                continue
            if s in _OPEN:
                stack.append(i)
                self.match[i] = self.n - 1
            elif s in _CLOSE:
                if stack and self.s[stack[-1]] == _CLOSE[s]:
                    j = stack.pop()
                    self.match[i], self.match[j] = j, i
                else:
                    bad = bad or self.line[i]
                    self.match[i] = i
        if stack or bad:
            self.out.warn("syntax_error", "error", "Syntax error: brackets don't match", bad or self.line[stack[-1]])

    def at(self, i: int) -> str:
        return self.s[i] if 0 <= i < self.n else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < self.n and self.k[i] == "id" and self.s[i] not in self.words

    def skip(self, i: int) -> int:
        """The place after the token or, at an opening bracket, after the closing one."""
        return (self.match[i] if self.at(i) in _OPEN and self.k[i] == "op" else i) + 1

    def angle(self, i: int, end: int) -> int:
        """The place after a list of type arguments that starts at ``<``; ``i`` if it isn't one."""
        depth, j = 0, i
        while j < end:
            s = self.s[j]
            if s == "<":
                depth += 1
            elif s == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif s in (";", "{", "}", "&&", "||") or self.k[j] == "str":
                return i
            j = self.skip(j)
        return i

    def until(self, i: int, end: int, stops: set[str]) -> int:
        """The first of the stops outside brackets."""
        while i < end and self.s[i] not in stops:
            i = self.skip(i)
        return min(i, end)

    def node(self, kind: str, i: int, qname: str, end: int, parent: int = 0, **more) -> int:
        end = max(i, min(end, self.n) - 1)
        return self.out.node(kind, self.s[i], qname, self.line[i], self.line[end] if self.n else 0, self.col[i], parent, **more)

    def ref(self, source: str, target: str, kind: str, i: int) -> None:
        self.out.ref(source, target, kind, self.line[min(i, self.n - 1)])

    def types(self, a: int, b: int, source: str) -> None:
        """Names in a type are read."""
        for i in range(a, b):
            if self.is_name(i) and self.at(i - 1) not in (".",):
                self.out.uses.add(self.s[i])
                self.ref(source, self.s[i], "read", i)

    joiner = "."

    def expression(self, a: int, b: int, source: str, parent: int = 0) -> None:
        """Uses of names between two places."""
        i = a
        while i < b:
            if self.k[i] != "id":
                j = self.special(i, b, source)
                i = j if j > i else i + 1
                continue
            s = self.s[i]
            j = self.special(i, b, source)
            if j > i:
                i = j
                continue
            if s in self.words and s not in ("self", "this", "Self", "base", "super", "crate"):
                i += 1
                continue
            names, j = [s], i + 1
            while j + 1 < b and self.s[j] in _JOIN:
                if self.s[j] == "::" and self.at(j + 1) == "<":
                    k = self.angle(j + 1, b)
                    if k == j + 1:
                        break
                    j = k
                    continue
                if self.k[j + 1] != "id":
                    break
                names.append(self.s[j + 1])
                j += 2
            own = names[0] in ("self", "this", "Self", "base", "super", "crate")
            told = names[1:] if own else names
            self.out.uses.update(names)
            follow = self.at(j)
            if follow == "<" and self.lang in ("csharp", "typescript"):
                k = self.angle(j, b)
                if k > j and self.at(k) == "(":
                    self.types(j + 1, k - 1, source)
                    follow, j = "(", k
            member = self.at(i - 1) in _JOIN
            if self.lang == "rust" and follow == "!" and self.at(j + 1) in _OPEN:
                self.ref(source, told[-1] if told else s, "call", i)
                i = j + 1
                continue
            if told:
                full = self.joiner.join(told)
                if follow == "(":
                    self.ref(source, full, "call", i)
                    self.out.mark("call", ".".join(names) if not own else full, self.line[i])
                    if len(told) > 1:
                        self.ref(source, told[0], "read", i)
                elif follow in _ASSIGN and not member:
                    self.ref(source, told[-1], "write", i)
                    if follow != "=":
                        self.ref(source, told[-1], "read", i)
                    if len(told) > 1:
                        self.ref(source, told[0], "read", i)
                elif follow in ("++", "--") or self.at(i - 1) in ("++", "--"):
                    self.ref(source, told[-1], "write", i)
                    self.ref(source, told[-1], "read", i)
                elif not (follow == ":" and self.label(i)):
                    for t in dict.fromkeys((told[0], told[-1])):
                        self.ref(source, t, "read", i)
                    if len(told) > 1 and self.joiner == "::":
                        self.ref(source, full, "read", i)
            i = max(j, i + 1)

    def label(self, i: int) -> bool:
        """Whether a name before a colon is a key and no use."""
        return self.at(i - 1) in ("{", ",")

    def special(self, i: int, b: int, source: str) -> int:
        """Hook for what a language has besides; the place after it, or ``i``."""
        return i

    def parse(self) -> Parsed:
        self.items(0, self.n)
        return self.out

    def items(self, a: int, b: int) -> None:
        raise NotImplementedError


class C(Reader):
    lang = "c"

    def parse(self) -> Parsed:
        for s, line in self.pre:
            if m := re.match(r'#\s*include\s*"([^"]+)"', s):
                self.out.imports.append({"line": line, "module": m[1], "names": [m[1].rsplit("/", 1)[-1]], "type": "include"})
            elif m := re.match(r"#\s*define\s+(\w+)(?:\(.*?\))?(.*)", s, re.S):
                q = f"{self.out.module}.{m[1]}"
                self.out.node("macro", m[1], q, line, line + s.count("\n"))
                for x in re.findall(r"[A-Za-z_]\w*", re.sub(r"\"(?:\\.|[^\"\\])*\"", "", m[2])):
                    if x not in self.words and x != m[1]:
                        self.out.ref(q, x, "read", line)
            elif m := re.match(r"#\s*(?:if|ifdef|ifndef|elif)\b(.*)", s, re.S):
                for x in re.findall(r"[A-Za-z_]\w*", m[1]):
                    if x != "defined":
                        self.out.ref(self.out.module, x, "read", line)
        self.items(0, self.n)
        return self.out

    def items(self, a: int, b: int) -> None:
        i, m = a, self.out.module
        while i < b:
            if self.s[i] == ";":
                i += 1
                continue
            if self.s[i] == "extern" and self.at(i + 1).startswith('"') and self.at(i + 2) == "{":
                self.items(i + 3, self.match[i + 2])
                i = self.match[i + 2] + 1
                continue
            stop = i  # a declaration ends at ; or after a function's body
            body = -1
            while stop < b and self.s[stop] != ";":
                if self.s[stop] == "{" and self.at(stop - 1) == ")" and "=" not in self.s[i:stop]:
                    body = stop
                    break
                stop = self.skip(stop)
            self.declaration(i, min(stop, b), m, body)
            i = (self.match[body] if body >= 0 else stop) + 1

    def declaration(self, a: int, b: int, scope: str, body: int = -1, function: str = "", parent: int = 0) -> None:
        source = function or scope
        typedef = "typedef" in self.s[a:b][:2]
        shown = "static" if "static" in self.s[a : a + 3] else "extern" if "extern" in self.s[a : a + 3] else ""
        i, made, tag = a, 0, ""
        while i < b and (self.s[i] in self.words or self.k[i] == "id"):
            if self.s[i] in ("struct", "union", "enum"):
                kind, j = self.s[i], i + 1
                name = j if self.is_name(j) else -1
                j = j + 1 if name >= 0 else j
                if self.at(j) == "{":
                    end = self.match[j]
                    label = name if name >= 0 else (end + 1 if typedef and self.is_name(end + 1) else -1)
                    if label >= 0:
                        tag = f"{scope}.{self.s[label]}"
                        made = self.node("type" if name < 0 else kind, label, tag, end + 1, parent, visibility=shown)
                        self.members(j + 1, end, tag, made, kind)
                    i = end + 1
                    if name < 0 and typedef:
                        i += 1
                    break
                if name >= 0:
                    self.ref(source, self.s[name], "read", name)
                i = j
                continue
            if self.is_name(i) and not (self.is_name(i + 1) or self.at(i + 1) in ("*", "(")) or (self.at(i + 1) == "(" and body >= 0 and self.match[i + 1] + 1 == body):
                break
            if self.is_name(i) and self.at(i + 1) == "(" and self.at(i + 2) != "*":
                break
            if self.is_name(i):
                self.ref(source, self.s[i], "read", i)
            i += 1
        if body >= 0:
            f = next((x for x in range(i, body) if self.is_name(x) and self.at(x + 1) == "("), -1)
            if f < 0:
                return
            q = f"{scope}.{self.s[f]}"
            n = self.node("function", f, q, self.match[body] + 1, 0, visibility=shown)
            self.out.mark("def", self.s[f], self.line[f], n)
            for part in self.parts(f + 2, self.match[f + 1]):
                names = [x for x in range(*part) if self.is_name(x)]
                for x in names[:-1] if len(names) > 1 or self.s[part[0]] not in self.words else []:
                    self.ref(q, self.s[x], "read", x)
            self.block(body + 1, self.match[body], q, n)
            return
        for x, y in self.parts(i, b):
            eq = self.until(x, y, {"="})
            name = next((k for k in range(x, eq) if self.is_name(k)), -1)
            if name < 0:
                continue
            after = name + 1
            if self.at(after) == "(" and self.at(name - 1) != "*":
                continue  # a prototype
            if typedef:
                if f"{scope}.{self.s[name]}" != tag:
                    q = f"{scope}.{self.s[name]}"
                    self.node("type", name, q, b, 0)
                    self.types(a + 1, i, q)
                continue
            q = f"{source}.{self.s[name]}"
            n_parent = parent if function else 0
            if not (shown == "extern" and eq == y):
                self.node("variable", name, q, b, n_parent, visibility=shown)
                if function:
                    self.ref(source, self.s[name], "write", name) if eq < y else None
            if self.at(after) == "[":
                self.expression(after + 1, self.match[after], q)
            if eq < y:
                self.expression(eq + 1, y, q if not function else source)

    def parts(self, a: int, b: int) -> list[tuple[int, int]]:
        out, i = [], a
        while i < b:
            j = self.until(i, b, {","})
            if j > i:
                out.append((i, j))
            i = j + 1
        return out

    def members(self, a: int, b: int, tag: str, parent: int, kind: str) -> None:
        if kind == "enum":
            for x, y in self.parts(a, b):
                if self.is_name(x):
                    self.node("enum_member", x, f"{tag}.{self.s[x]}", y, parent)
                    self.expression(x + 1, y, f"{tag}.{self.s[x]}")
            return
        i = a
        while i < b:
            j = self.until(i, b, {";"})
            for n, (x, y) in enumerate(self.parts(i, j)):
                stop = self.until(x, y, {":", "[", "="})
                inner = next((k for k in range(x, stop) if self.s[k] == "{"), -1)
                if inner >= 0:
                    self.members(inner + 1, self.match[inner], tag, parent, "struct")
                names = [k for k in range(x if inner < 0 else self.match[inner] + 1, stop) if self.is_name(k)]
                pointed = [k for k in names if self.at(k - 1) == "*" and self.at(k - 2) == "("]
                if names:
                    last = (pointed or names)[-1] if not pointed else pointed[0]
                    self.node("field", last, f"{tag}.{self.s[last]}", y, parent)
                    for k in names:
                        if k != last:
                            self.ref(tag, self.s[k], "read", k)
            i = j + 1

    def block(self, a: int, b: int, function: str, n: int) -> None:
        """Statements of a function: local declarations, else expressions."""
        i = a
        while i < b:
            if self.s[i] in ("{", "}", ";"):
                i += 1
                continue
            if self.s[i] in ("for", "while", "if", "switch") and self.at(i + 1) == "(":
                self.block(i + 2, self.match[i + 1], function, n)
                i = self.match[i + 1] + 1
                continue
            j = self.until(i, b, {";", "{", "}"})
            if self.declares(i, j):
                if self.at(j) == "{" and "=" in self.s[i:j]:
                    j = self.until(i, b, {";"})
                self.declaration(i, j, self.out.module, -1, function, n)
            else:
                self.expression(i, j, function)
            i = max(j, i + 1)

    def declares(self, a: int, b: int) -> bool:
        i, typed = a, False
        while i < b and self.s[i] in self.words and self.s[i] not in ("return", "goto", "case", "default", "sizeof", "else", "do", "break", "continue", "NULL"):
            typed, i = True, i + 1
        if typed:
            return True
        k = a + 1
        while self.at(k) == "*":
            k += 1
        return self.is_name(a) and self.is_name(k) and self.at(k + 1) in ("=", ";", ",", "[") and k < b + 1


class Rust(Reader):
    lang, joiner = "rust", "::"

    def parse(self) -> Parsed:
        self.scope([], 0, 0, self.n, self.out.module)
        return self.out

    def scope(self, path: list[str], parent: int, a: int, b: int, owner: str, impl: str = "") -> None:
        """Items of a module, trait, implementation or block."""
        base = "::".join([self.out.module, *path])
        i, marks, public = a, [], False
        while i < b:
            s = self.s[i]
            if s == "#" and self.at(i + 1) in ("[", "!"):
                j = i + 1 + (self.at(i + 1) == "!")
                inner = self.s[j + 1 : self.match[j]]
                name = "".join(inner).split("(")[0]
                if name == "unsafe" and "(" in inner:
                    name = inner[2]
                marks.append(name)
                if name == "derive":
                    for k in range(j + 3, self.match[j]):
                        if self.is_name(k):
                            self.out.uses.add(self.s[k])
                if name == "test" or name.endswith("::test") or "".join(inner) == "cfg(test)":
                    self.out.mark("test", "", self.line[i])
                i = self.match[j] + 1
                continue
            if s == "pub":
                public = True
                i = self.match[i + 1] + 1 if self.at(i + 1) == "(" else i + 1
                continue
            if s in ("async", "unsafe", "default") or (s == "const" and self.at(i + 1) in ("fn", "unsafe")) or (s == "extern" and self.at(i + 1).startswith('"')):
                i += 2 if s == "extern" and self.at(i + 1).startswith('"') and self.at(i + 2) != "{" else 1
                if s == "extern" and self.at(i + 1) == "{":
                    i = self.match[i + 1] + 1
                continue
            j = self.item(i, b, base, path, parent, marks, public, impl, owner)
            if j > i:
                i, marks, public = j, [], False
            else:
                i += 1

    def item(self, i: int, b: int, base: str, path: list[str], parent: int, marks: list[str], public: bool, impl: str, owner: str) -> int:
        s, name = self.s[i], i + 1
        facts = {"decorators": marks, "visibility": None}
        q = f"{base}::{self.at(name)}"

        def done(n: int) -> None:
            for m in marks:
                self.out.mark("decorator", m, self.line[name], n)
            if public:
                self.out.mark("visible", self.at(name), self.line[name], n)

        if s == "fn" and self.is_name(name):
            p = self.until(name, b, {"(", "{", ";"})
            end = self.until(self.match[p] + 1 if self.at(p) == "(" else p, b, {"{", ";"})
            stop = self.match[end] + 1 if self.at(end) == "{" else end + 1
            n = self.node("method" if impl else "function", name, q, stop, parent, **facts)
            self.out.mark("def", self.s[name], self.line[name], n)
            done(n)
            self.types(name + 1, end, q)
            if self.at(end) == "{":
                self.body(end + 1, self.match[end], q, n, [*path, self.s[name]])
            return stop
        if s in ("struct", "union", "enum", "trait") and self.is_name(name):
            end = self.until(name, b, {"{", ";"})
            stop = self.match[end] + 1 if self.at(end) == "{" else end + 1
            n = self.node(s, name, q, stop, parent, **facts)
            done(n)
            if s == "trait":
                self.types(name + 1, end, q)
                self.scope([*path, self.s[name]], n, end + 1, stop - 1, q, q)
            elif self.at(end) == "{":
                self.fields(end + 1, stop - 1, q, n, s)
            else:
                self.types(name + 1, end, q)
            return stop
        if s == "impl":
            k = self.angle(i + 1, b) if self.at(i + 1) == "<" else i + 1
            end = self.until(k, b, {"{", ";"})
            words = [x for x in range(k, end) if self.s[x] == "for"]
            stop_types = self.until(k, end, {"where"})
            first = [x for x in range(k, words[0] if words else stop_types) if self.is_name(x)]
            second = [x for x in range(words[0] + 1, stop_types) if self.is_name(x)] if words else first
            if not second:
                return self.match[end] + 1 if self.at(end) == "{" else end + 1
            target = self.s[second[0]]
            own = next((n["local"] for n in self.out.nodes if n["qualified_name"] == f"{base}::{target}"), 0)
            source = f"{base}::{target}"
            if words and first:
                trait = "::".join(self.s[x] for x in range(k, words[0]) if self.is_name(x) and self.s[x - 1] != "<" and not any(self.s[y] == "<" for y in range(k, x))) or self.s[first[0]]
                self.ref(source, trait, "inherit", i)
                self.out.uses.update(self.s[x] for x in first)
                self.out.mark("trait_impl", trait, self.line[i], own)
            self.types(k, end, source)
            if self.at(end) == "{":
                self.scope([*path, target], own, end + 1, self.match[end], source, source)
                return self.match[end] + 1
            return end + 1
        if s in ("const", "static", "type") and (self.is_name(name) or self.at(name) == "mut"):
            name += self.at(name) == "mut"
            end = self.until(name, b, {";"})
            q = f"{base}::{self.at(name)}"
            n = self.node("type_alias" if s == "type" else "constant" if s == "const" else "variable", name, q, end, parent, **facts)
            done(n)
            eq = self.until(name, end, {"="})
            self.types(name + 1, eq, q)
            (self.types if s == "type" else self.expression)(eq + 1, end, q)
            return end + 1
        if s == "mod" and self.is_name(name):
            if self.at(name + 1) == "{":
                stop = self.match[name + 1]
                n = self.node("module", name, q, stop + 1, parent, **facts)
                done(n)
                self.scope([*path, self.s[name]], 0, name + 2, stop, q)
                return stop + 1
            return self.until(name, b, {";"}) + 1
        if s == "macro_rules" and self.at(name) == "!" and self.is_name(name + 1):
            end = self.skip(name + 2)
            n = self.node("macro", name + 1, f"{base}::{self.s[name + 1]}", end, parent, **facts)
            self.out.mark("macro", self.s[name + 1], self.line[i], n)
            return end
        if s == "use":
            end = self.until(i, b, {";"})
            self.use(i + 1, end, [], self.line[i], public)
            return end + 1
        if s == "extern" and self.at(name) == "crate":
            return self.until(i, b, {";"}) + 1
        if self.is_name(i) and self.at(i + 1) == "!":
            self.expression(i, self.skip(i + 2), owner)
            return self.skip(i + 2)
        return i

    def use(self, a: int, b: int, head: list[str], line: int, public: bool) -> None:
        for x, y in C.parts(self, a, b):
            names, i = list(head), x
            while i < y and self.s[i] != "{":
                if self.s[i] == "as":
                    break
                if self.k[i] == "id" or self.s[i] == "*":
                    names.append(self.s[i])
                i += 1
            if i < y and self.s[i] == "{":
                self.use(i + 1, self.match[i], names, line, public)
                continue
            alias = self.s[i + 1] if i + 1 < y and self.s[i] == "as" else names[-1] if names else ""
            alias = names[-2] if alias == "self" and len(names) > 1 else alias
            self.out.imports.append({"line": line, "module": "::".join(names), "names": [alias], "type": "absolute", "exported": public})

    def fields(self, a: int, b: int, q: str, n: int, kind: str) -> None:
        for x, y in C.parts(self, a, b):
            while x < y and (self.s[x] in ("#", "pub")):
                x = self.skip(x + 1) if self.s[x] == "#" or self.at(x + 1) == "(" else x + 1
            if self.is_name(x):
                self.node("enum_member" if kind == "enum" else "field", x, f"{q}::{self.s[x]}", y, n)
                self.types(x + 1, y, q)

    def body(self, a: int, b: int, q: str, n: int, path: list[str]) -> None:
        i, start = a, a
        while i < b:
            if self.s[i] in ("fn", "struct", "enum", "impl", "trait", "use", "macro_rules") or (self.s[i] in ("const", "static") and self.is_name(i + 1)):
                self.expression(start, i, q)
                j = self.item(i, b, q, path, n, [], False, "", q)
                i = start = max(j, i + 1)
            elif self.s[i] == "let":
                self.expression(start, i, q)
                end = self.until(i, b, {";"})
                eq = self.until(i, end, {"="})
                colon = self.until(i, eq, {":"})
                for k in range(i + 1, colon):
                    if self.is_name(k) and self.at(k + 1) not in ("(", "{", "::") and self.s[k][:1].islower():
                        self.node("variable", k, f"{q}::{self.s[k]}", end, n)
                        self.ref(q, self.s[k], "write", k)
                self.types(colon + 1, eq, q)
                i = start = min(eq + 1, end)
            else:
                i += 1
        self.expression(start, b, q)


class CSharp(Reader):
    lang = "csharp"
    _KINDS = {"class": "class", "struct": "struct", "interface": "interface", "record": "record", "enum": "enum"}
    _MODIFIERS = frozenset("public private protected internal static abstract sealed virtual override readonly async extern unsafe partial new const volatile required file ref fixed".split())

    def parse(self) -> Parsed:
        self.scope([], 0, 0, self.n, None, True)
        return self.out

    def scope(self, path: list[str], parent: int, a: int, b: int, owner: str | None, chain: bool) -> None:
        i, marks, mods, program = a, [], [], False
        while i < b:
            s = self.s[i]
            if s == "[" and owner != "enum":
                for x, y in C.parts(self, i + 1, self.match[i]):
                    x = x + 2 if self.at(x + 1) == ":" else x
                    names = self.s[x : self.until(x, y, {"("})]
                    marks.append("".join(names))
                    self.types(x, x + 1, ".".join(path))
                i = self.match[i] + 1
            elif s in self._MODIFIERS:
                mods.append(s)
                i += 1
            elif s in ("using", "global") and owner is None:
                end = self.until(i, b, {";"})
                j = i + 1 + (self.at(i + 1) in ("using", "static"))
                if self.at(j + 1) == "=":
                    self.out.imports.append({"line": self.line[i], "module": "".join(self.s[j + 2 : end]), "names": [self.s[j]], "type": "alias"})
                else:
                    self.out.imports.append({"line": self.line[i], "module": "".join(self.s[j:end]), "names": ["".join(self.s[j:end])], "type": "absolute", "is_used": True})
                i, mods, marks = end + 1, [], []
            elif s == "namespace":
                end = self.until(i, b, {"{", ";"})
                name = "".join(self.s[i + 1 : end]).split(".")
                if self.at(end) == "{":
                    self.scope([*path, *name], 0, end + 1, self.match[end], None, True)
                    i = self.match[end] + 1
                else:
                    path, i = [*path, *name], end + 1
            elif s in self._KINDS and self.k[i] == "id" and (self.is_name(i + 1) or self.at(i + 1) in ("struct", "class")):
                i = self.type(i, b, path, parent, marks, mods, chain)
                marks, mods = [], []
            elif s == "delegate":
                end = self.until(i, b, {";"})
                name = next((k for k in range(i + 1, end) if self.is_name(k) and self.at(k + 1) in ("(", "<")), -1)
                if name >= 0:
                    n = self.node("delegate", name, ".".join([*path, self.s[name]]), end, parent, decorators=marks, visibility=" ".join(mods))
                    self.types(i + 1, name, ".".join([*path, self.s[name]]))
                    self.shown(name, n, mods, chain)
                i, marks, mods = end + 1, [], []
            elif owner is not None:
                i = self.member(i, b, path, parent, marks, mods, owner, chain)
                marks, mods = [], []
            else:  # a statement of the program
                end = self.until(i, b, {";", "{"})
                stop = self.match[end] + 1 if self.at(end) == "{" else end + 1
                self.expression(i, stop, ".".join(path))
                if not program and self.at(i) not in (";", "}"):
                    self.out.mark("program", "", self.line[i])
                    program = True
                i = max(stop, i + 1)

    def shown(self, i: int, n: int, mods: list[str], chain: bool) -> bool:
        public = chain and "public" in mods
        if public:
            self.out.mark("visible", self.s[i], self.line[i], n)
        return public

    def type(self, i: int, b: int, path: list[str], parent: int, marks: list[str], mods: list[str], chain: bool) -> int:
        kind = self._KINDS[self.s[i]]
        name = i + 1 + (self.at(i + 1) in ("struct", "class"))
        end = self.until(name, b, {"{", ";"})
        stop = self.match[end] + 1 if self.at(end) == "{" else end + 1
        logical = ".".join([*path, self.s[name]])
        partial = "partial" in mods
        q = f"{logical}#partial:{self.path_name}" if partial else logical
        n = self.node(kind, name, q, stop, parent, decorators=marks, visibility=" ".join(mods), is_partial=partial, canonical_name=logical if partial else None)
        for m in marks:
            self.out.mark("decorator", m, self.line[name], n)
            self.ref(q, m, "decorate", name)
            if m in ("Fact", "Theory", "Test", "TestCase", "TestFixture", "TestClass", "TestMethod"):
                self.out.mark("test", "", self.line[name])
        self.out.mark("type", self.s[name], self.line[name], n)
        public = self.shown(name, n, mods, chain)
        colon = self.until(name, end, {":", "where"})
        if self.at(colon) == ":":
            for x, y in C.parts(self, colon + 1, self.until(colon, end, {"where"})):
                base = "".join(self.s[x : self.until(x, y, {"<", "("})])
                self.ref(q, base, "inherit", x)
                self.types(x, y, q)
        if kind == "enum":
            for x, y in C.parts(self, end + 1, stop - 1):
                if self.is_name(x):
                    self.node("enum_member", x, f"{logical}.{self.s[x]}", y, n)
            return stop
        self.types(name + 1, colon, q)
        if kind == "record" and self.at(name + 1) == "(":
            for _, y in C.parts(self, name + 2, self.match[name + 1]):
                if self.is_name(y - 1):
                    self.node("property", y - 1, f"{logical}.{self.s[y - 1]}", y, n)
        if self.at(end) == "{":
            self.scope([*path, self.s[name]], n, end + 1, stop - 1, kind, public)
        return stop

    def member(self, i: int, b: int, path: list[str], parent: int, marks: list[str], mods: list[str], owner: str, chain: bool) -> int:
        if self.s[i] in ("}", ";"):
            return i + 1
        event = self.s[i] == "event"
        end = self.until(i, b, {"{", ";", "=", "=>", "("})
        scope, s = ".".join(path), self.at(end)
        facts = {"decorators": marks, "visibility": " ".join(mods)}

        def marked(k: int, n: int) -> None:
            for m in marks:
                self.out.mark("decorator", m, self.line[k], n)
                if m in ("Fact", "Theory", "Test", "TestCase", "TestMethod"):
                    self.out.mark("test", "", self.line[k])
            self.shown(k, n, mods if owner != "interface" else ["public"], chain)

        if s == "(":
            name = end - 1
            if self.at(name) == ">":
                back, name = 1, name - 1
                while name > i and back:
                    back += (self.s[name] == ">") - (self.s[name] == "<")
                    name -= 1
            after = self.match[end] + 1
            stop = self.until(after, b, {"{", ";", "=>"})
            tail = self.match[stop] + 1 if self.at(stop) == "{" else self.until(stop, b, {";"}) + 1
            if "operator" in self.s[i:end]:
                q, kind, name = f"{scope}.operator", "operator", self.s.index("operator", i)
            elif self.at(name) == path[-1] if path else False:
                kind = "destructor" if self.at(name - 1) == "~" else "constructor"
                q = f"{scope}..ctor" if kind == "constructor" else f"{scope}.~{self.s[name]}"
            else:
                q, kind = f"{scope}.{self.s[name]}", "method"
            n = self.node(kind, name, q, tail, parent, is_async="async" in mods, **facts)
            if kind == "constructor":
                self.out.nodes[-1]["name"] = ".ctor"
            self.out.mark("def", self.s[name], self.line[name], n)
            marked(name, n)
            self.types(i, name, q)
            for x, y in C.parts(self, end + 1, self.match[end]):
                self.types(x, max(x, self.until(x, y, {"="}) - 1), q)
            if self.at(after) == ":" and self.at(after + 1) in ("base", "this"):
                self.expression(after + 3, self.match[after + 2], q)
                if self.at(after + 1) == "this":
                    self.ref(q, f"{scope}..ctor", "call", after)
            self.body(stop + 1, tail - 1, q, n)
            return max(tail, i + 1)
        if s == "" or end >= b:
            return max(end, i + 1)
        if self.at(i) == "this" or "this" in self.s[i:end]:
            name, kind = self.s.index("this", i), "indexer"
        else:
            name, kind = end - 1, "event" if event else "property" if s in ("{", "=>") else "field"
        if not self.is_name(name) and kind != "indexer":
            return max(self.skip(end), i + 1)
        stop = self.match[end] + 1 if s == "{" else self.until(end, b, {";"}) + 1
        if s == "{" and self.at(stop) == "=":
            stop = self.until(stop, b, {";"}) + 1
        names = [name]
        if kind in ("field", "event") and s in ("=", ";"):
            names += [x for x, _ in C.parts(self, end, stop - 1)[1:] if self.is_name(x)]
        for k in names:
            q = f"{scope}.{self.s[k]}"
            n = self.node(kind, k, q, stop, parent, **facts)
            marked(k, n)
        self.types(i + event, name, q)
        if s == "{":
            self.body(end + 1, self.match[end], q, n)
            self.expression(self.match[end] + 1, stop, q)
        else:
            self.expression(end + 1, stop, q)
        return max(stop, i + 1)

    def body(self, a: int, b: int, q: str, n: int) -> None:
        for i in range(a, b):
            if self.is_name(i) and self.at(i + 1) in ("=", ";", "in") and (self.at(i - 1) in ("var",) or (self.is_name(i - 1) or self.at(i - 1) in ("int", "string", "bool", "double", "long", "decimal", "object", "?", ">", "]", "float", "char", "byte")) and self.at(i - 2) in ("{", "}", ";", "(", ".", "<", "await", "using", "")):
                self.node("variable", i, f"{q}.{self.s[i]}", i + 1, n)
        self.expression(a, b, q)

    def special(self, i: int, b: int, source: str) -> int:
        if self.s[i] == "new" and self.is_name(i + 1):
            j = i + 1
            while self.at(j + 1) == "." and self.is_name(j + 2):
                j += 2
            name = self.s[j]
            self.out.uses.add(name)
            self.ref(source, f"{name}..ctor", "call", i)
            self.ref(source, name, "read", i)
            if self.at(j + 1) == "<":
                k = self.angle(j + 1, b)
                self.types(j + 2, k, source)
                return max(k, j + 1)
            return j + 1
        return i


class TypeScript(Reader):
    lang = "typescript"
    _SKIP = frozenset("export default declare abstract async public private protected static readonly override".split())

    def parse(self) -> Parsed:
        self.scope([], 0, 0, self.n)
        for n in self.out.nodes:
            if n["name"] in self.exported and not n["parent_local"]:
                self.out.mark("export", n["name"], n["line_start"], n["local"])
        return self.out

    def __init__(self, path: str, text: str, module: str) -> None:
        super().__init__(path, text, module)
        self.exported: set[str] = set()
        self.jsx = path.endswith(("x", ".js"))
        self.decorators: list[str] = []

    def scope(self, path: list[str], parent: int, a: int, b: int) -> None:
        i, exported = a, False
        q = ".".join(path)
        while i < b:
            s = self.s[i]
            if s == "@" and self.is_name(i + 1):
                j = i + 2
                while self.at(j) == ".":
                    j += 2
                self.decorators.append("".join(self.s[i + 1 : j]))
                if self.at(j) == "(":
                    self.expression(j + 1, self.match[j], q)
                    j = self.match[j] + 1
                i = j
                continue
            if s == "export" and self.at(i + 1) == "{":
                end = self.match[i + 1]
                source = self.at(end + 1) == "from"
                for x, y in C.parts(self, i + 2, end):
                    if not source:
                        self.exported.add(self.s[x])
                        self.out.uses.add(self.s[x])
                i = self.until(end, b, {";"}) if source and self.at(end + 3) == ";" else end + 1 + 2 * source
                continue
            if s == "export" and self.at(i + 1) in ("*", "="):
                i = self.until(i, min(b, i + 8), {";"}) + 1
                continue
            if s in self._SKIP and self.k[i] == "id":
                exported = exported or s == "export"
                if s == "default" and self.is_name(i + 1) and self.at(i + 2) in (";", ""):
                    self.exported.add(self.s[i + 1])
                i += 1
                continue
            if s == "import" and self.at(i + 1) not in ("(", "."):
                i = self.imported(i, b)
                continue
            j = self.item(i, b, path, parent, exported)
            if j > i:
                i = j
            else:
                end = self.until(i, b, {";", "{", "}"})
                while self.at(end) == "{" and self.at(end - 1) in ("=>", "(", ",", "=", ")", "else", "try", "finally", "do", "{") and end < b:
                    self.expression(i, end, q) if end > i else None
                    self.scope_block(end, q, path, parent)
                    i = self.match[end] + 1
                    end = self.until(i, b, {";", "{", "}"})
                self.expression(i, end, q)
                i = max(self.skip(end) if self.at(end) != "{" else end, i + 1)
                if self.at(end) == "{" and i == end:
                    self.expression(end + 1, self.match[end], q)
                    i = self.match[end] + 1
            exported = False
            self.decorators = []

    def scope_block(self, i: int, q: str, path: list[str], parent: int) -> None:
        self.block(i + 1, self.match[i], q, path, parent)

    def imported(self, i: int, b: int) -> int:
        end = i + 1
        while end < b and self.k[end] != "str":
            end += 1
        typed = self.at(i + 1) == "type" and self.at(i + 2) != "from"
        module, names, j = self.at(end).strip("'\"`"), [], i + 1 + typed
        while j < end:
            if self.s[j] == "{":
                for x, y in C.parts(self, j + 1, self.match[j]):
                    kind = self.s[x] == "type" and y - x > 1
                    if not kind:
                        names.append(self.s[y - 1])
                j = self.match[j]
            elif self.s[j] == "*":
                names.append(self.at(j + 2))
                j += 2
            elif self.is_name(j):
                names.append(self.s[j])
            j += 1
        for n in names or [""]:
            self.out.imports.append({"line": self.line[i], "module": module, "names": [n] if n else [], "type": "type" if typed else "absolute" if n else "side-effect"})
        return end + 1 + (self.at(end + 1) == ";")

    def item(self, i: int, b: int, path: list[str], parent: int, exported: bool) -> int:
        s, name = self.s[i], i + 1
        facts = {"decorators": list(self.decorators)}

        def done(kind: str, k: int, stop: int, p: int = parent) -> tuple[int, str]:
            q = ".".join([*path, self.s[k]])
            n = self.node(kind, k, q, stop, p, **facts)
            if exported:
                self.exported.add(self.s[k])
            for d in self.decorators:
                self.out.mark("decorator", d, self.line[k], n)
                self.ref(q, d, "decorate", k)
            return n, q

        if s == "function":
            name += self.at(name) == "*"
            if not self.is_name(name):
                return i
            p = self.until(name, b, {"("})
            end = self.until(self.match[p] + 1, b, {"{", ";"}) if self.at(p) == "(" else p
            stop = self.match[end] + 1 if self.at(end) == "{" else end + 1
            n, q = done("function", name, stop)
            self.out.mark("def", self.s[name], self.line[name], n)
            self.signature(p, end, q)
            if self.at(end) == "{":
                self.block(end + 1, self.match[end], q, [*path, self.s[name]], n)
            return stop
        if s in ("class", "interface") and self.is_name(name):
            end = self.until(name, b, {"{"})
            stop = self.match[end] + 1 if end < b else b
            n, q = done(s, name, stop)
            self.out.mark("type", self.s[name], self.line[name], n)
            head = self.until(name, end, {"extends", "implements"})
            for k in range(head, end):
                if self.is_name(k):
                    self.out.uses.add(self.s[k])
                    if self.at(k - 1) in ("extends", "implements", ",") and self.s[head:k].count("<") == self.s[head:k].count(">"):
                        self.ref(q, self.s[k], "inherit", k)
                    self.ref(q, self.s[k], "read", k)
            self.members(end + 1, stop - 1, [*path, self.s[name]], n, s)
            return stop
        if s == "enum" or (s == "const" and self.at(name) == "enum"):
            name += s == "const"
            end = self.until(name, b, {"{"})
            stop = self.match[end] + 1 if end < b else b
            n, q = done("enum", name, stop)
            for x, y in C.parts(self, end + 1, stop - 1):
                if self.is_name(x):
                    self.node("enum_member", x, f"{q}.{self.s[x]}", y, n)
            return stop
        if s == "type" and self.is_name(name) and self.at(name + 1) in ("=", "<"):
            end = self.until(name, b, {";"})
            nxt = self.line[name]
            k = name
            while k < end and (self.line[k] == nxt or self.s[k] in ("|", "&", "}", ")") or self.s[k - 1] in ("|", "&", "=", "{", "?", ":")):
                nxt = self.line[self.skip(k) - 1]
                k = self.skip(k)
            _, q = done("type_alias", name, k)
            self.types(name + 1, k, q)
            return k + (self.at(k) == ";")
        if s in ("namespace", "module") and self.is_name(name):
            end = self.until(name, b, {"{", ";"})
            if self.at(end) == "{":
                n, _ = done("namespace", name, self.match[end] + 1)
                self.scope([*path, self.s[name]], n, end + 1, self.match[end])
                return self.match[end] + 1
            return i
        if s in ("const", "let", "var"):
            return self.variables(name, b, path, parent, done)
        return i

    def statement_end(self, i: int, b: int) -> int:
        """The end of a statement that may do without its semicolon: before a line that starts a new one."""
        j = i
        while j < b and self.s[j] != ";":
            if j > i and self.line[j] > self.line[j - 1] and self.k[j] == "id" and self.s[j] in ("class", "const", "export", "function", "let", "var", "import", "interface", "type", "enum", "return", "if", "for", "while", "async", "abstract", "declare", "namespace", "switch", "throw", "try") and self.s[j - 1] not in ("=", "=>", "(", ",", "+", "&&", "||", "?", ":", ".", "|", "&", "export", "default", "async"):
                return j
            if j > i and self.line[j] > self.line[j - 1] and self.k[j] == "id" and (self.k[j - 1] in ("id", "num", "str") and self.s[j - 1] not in self.words or self.s[j - 1] in (")", "]", "}")):
                return j
            if self.s[j] in _CLOSE:
                return j
            j = self.skip(j)
        return min(j, b)

    def variables(self, i: int, b: int, path: list[str], parent: int, done) -> int:
        end = self.statement_end(i, b)
        for x, y in C.parts(self, i, end):
            eq = self.until(x, y, {"="})
            colon = self.until(x, eq, {":"})
            source = ".".join(path)
            value = eq + 1
            if self.at(x) in ("{", "["):
                for k in range(x + 1, self.match[x]):
                    if self.is_name(k) and self.at(k + 1) not in (":",):
                        done("variable", k, y)
                self.expression(value, y, source)
                continue
            if not self.is_name(x):
                self.expression(x, y, source)
                continue
            arrow = value < y and (self.at(value) == "function" or "=>" in self.s[value:y] and self.arrow(value, y) >= 0)
            n, q = done("function" if arrow else "variable", x, y)
            self.types(colon + 1, eq, q)
            if arrow:
                self.out.mark("def", self.s[x], self.line[x], n)
                k = self.arrow(value, y)
                k = k if k >= 0 else self.until(value, y, {"{"})
                self.signature(value, k, q)
                if self.at(k) == "=>":
                    k += 1
                if self.at(k) == "{":
                    self.block(k + 1, self.match[k], q, [*path, self.s[x]], n)
                else:
                    self.expression(k, y, q)
            else:
                if path:
                    self.ref(source, self.s[x], "write", x)
                self.expression(value, y, q)
        return end + (self.at(end) == ";")

    def arrow(self, a: int, b: int) -> int:
        """The arrow of a function that starts here, -1 if none does."""
        i = a + (self.at(a) == "async")
        i = self.angle(i, b) if self.at(i) == "<" else i
        if self.at(i) == "(":
            j = self.until(self.match[i] + 1, b, {"=>", ",", ";", "?", "&&", "||", "."})
            return j if self.at(j) == "=>" else -1
        return i + 1 if self.is_name(i) and self.at(i + 1) == "=>" else -1

    def signature(self, a: int, b: int, q: str) -> None:
        for k in range(a, b):
            if self.is_name(k) and self.at(k - 1) not in ("(", ",", "{", "...") and self.at(k + 1) not in (":", "?") or (self.is_name(k) and self.at(k - 1) in (":", "|", "&", "<", "=")):
                self.out.uses.add(self.s[k])
                self.ref(q, self.s[k], "read", k)

    def members(self, a: int, b: int, path: list[str], parent: int, kind: str) -> None:
        i, marks, shown, scope = a, [], "", ".".join(path)
        while i < b:
            s = self.s[i]
            if s in (";", ","):
                i += 1
            elif s == "@":
                j = i + 2
                while self.at(j) == ".":
                    j += 2
                marks.append("".join(self.s[i + 1 : j]))
                self.out.uses.add(self.at(i + 1))
                if self.at(j) == "(":
                    self.expression(j + 1, self.match[j], scope)
                    j = self.match[j] + 1
                i = j
            elif s in ("public", "private", "protected", "static", "readonly", "abstract", "async", "override", "declare", "get", "set", "*") and self.at(i + 1) not in ("(", "=", ":", ";", "?", "<"):
                shown = s if s in ("public", "private", "protected") else shown
                i += 1
            elif s == "static" and self.at(i + 1) == "{":
                self.expression(i + 2, self.match[i + 1], scope)
                i = self.match[i + 1] + 1
            elif self.k[i] in ("id", "str", "num") or s == "[":
                name, j = i, self.skip(i)
                j += self.at(j) in ("?", "!")
                j = self.angle(j, b) if self.at(j) == "<" else j
                q = f"{scope}.{self.s[name]}"
                facts = {"decorators": marks, "visibility": shown or None}
                if self.at(j) == "(":
                    end = self.match[j] + 1
                    while end < b and self.s[end] not in ("{", ";") and not (kind == "interface" and self.s[end] == ","):
                        if self.line[end] > self.line[end - 1] and self.s[end - 1] not in (":", "|", "&", "=>", "<", ","):
                            break
                        end = self.skip(end) if self.s[end] != "{" else end
                    stop = self.match[end] + 1 if self.at(end) == "{" else end
                    n = self.node("method", name, q, stop, parent, **facts)
                    self.out.mark("def", self.s[name], self.line[name], n)
                    self.signature(j, end, q)
                    if self.at(end) == "{":
                        self.block(end + 1, self.match[end], q, [*path, self.s[name]], n)
                else:
                    stop = self.statement_end(i, b) if kind == "class" else self.until(i, b, {";", ","})
                    if kind == "interface":
                        k = i
                        while k + 1 < stop and self.line[self.skip(k)] == self.line[i] if self.skip(k) < stop else False:
                            k = self.skip(k)
                        stop = min(stop, self.skip(k))
                    n = self.node("property", name, q, stop, parent, **facts)
                    eq = self.until(j, stop, {"="})
                    self.types(j, eq, q)
                    arrow = self.arrow(eq + 1, stop) if eq < stop else -1
                    if arrow >= 0 and self.at(arrow + 1) == "{":
                        self.block(arrow + 2, self.match[arrow + 1], q, [*path, self.s[name]], n)
                    else:
                        self.expression(eq + 1, stop, q)
                for m in marks:
                    self.out.mark("decorator", m, self.line[name], n)
                    self.ref(q, m, "decorate", name)
                i, marks, shown = max(stop, i + 1), [], ""
            else:
                i = self.skip(i)

    def block(self, a: int, b: int, q: str, path: list[str], n: int) -> None:
        """Statements inside a function: its own functions and variables, else uses."""
        self.decorators = []
        i = start = a
        while i < b:
            if self.s[i] in ("class", "const", "function", "let", "var") and self.at(i - 1) not in (".", "=>") and (self.s[i] != "function" or self.is_name(i + 1)):
                self.expression(start, i, q)
                j = self.item(i, b, path, n, False)
                i = start = max(j, i + 1)
            elif self.s[i] == "{" or self.s[i] not in _OPEN:
                i += 1
            else:
                i += 1
        self.expression(start, b, q)

    def special(self, i: int, b: int, source: str) -> int:
        s = self.s[i]
        if s == "new" and self.is_name(i + 1):
            j = i + 1
            while self.at(j + 1) == "." and self.is_name(j + 2):
                j += 2
            self.out.uses.add(self.s[i + 1])
            self.ref(source, f"{self.s[j]}.constructor", "call", i)
            self.ref(source, self.s[j], "read", i)
            self.out.mark("call", self.s[j], self.line[i])
            return j + 1
        if s == "<" and self.jsx and self.k[i + 1 : i + 2] == ["id"] and (self.at(i - 1) in ("(", "return", "=>", "?", ":", "&&", "||", ">", "}", "=", ",", "{", "") or (self.k[i - 1 : i] == ["id"] and self.at(i - 2) == ">")):
            name = self.s[i + 1]
            if name[:1].isupper():
                j = i + 2
                while self.at(j) == "." and j + 1 < b:
                    j += 2
                name = "".join(self.s[i + 1 : j])
                self.out.uses.add(self.s[i + 1])
                self.ref(source, name, "call", i)
                self.ref(source, name, "jsx_element", i)
                self.out.mark("jsx", name, self.line[i])
                return j
            return i + 2
        return i


def _finish(out: Parsed, lang: str) -> Parsed:
    """Unused imports, and the marks of test calls."""
    if lang in ("rust", "csharp", "typescript"):
        for x in out.imports:
            checked = x["names"] and x["type"] not in ("type", "side-effect") and not x.get("exported") and (lang != "csharp" or x["type"] == "alias")
            x["is_used"] = x.get("is_used") or not checked or any(n in out.uses or n in ("*", "_", "") for n in x["names"])
            if checked and not x["is_used"]:
                out.warn("unused_import", "warning", f"'{', '.join(x['names'])}' imported but not used", x["line"])
    if lang == "typescript" and any(k == "call" and n.split(".")[0] in ("describe", "it", "test", "suite") for k, n, _, _ in out.marks):
        out.mark("test", "", 0)
    return out


def _language(reader: type[Reader], extensions: str, excludes: str, public: str, special: str, module_of, prefix: tuple[str, ...] = ()):
    names = frozenset(special.split())

    def parse(path: str, data: bytes) -> Parsed:
        try:
            return _finish(reader(path, decode(data), module_of(path)).parse(), reader.lang)
        except (RecursionError, IndexError, ValueError) as e:
            out = Parsed(module=module_of(path))
            out.warn("syntax_error", "error", f"Syntax error: {type(e).__name__}")
            return out

    return SimpleNamespace(EXTENSIONS=tuple(extensions.split()), EXCLUDES=tuple(excludes.split()), PUBLIC=frozenset(public.split()), is_special=lambda n: n in names or n.startswith(prefix or ("\0",)), module_of=module_of, parse=parse)


def _rust_module(path: str) -> str:
    parts = path.removesuffix(".rs").replace("\\", "/").split("/")
    first = int(parts[0] in {"benches", "examples", "src", "tests"})
    last = len(parts) - (len(parts) > first and parts[-1] in {"lib", "main", "mod"})
    parts = parts[first:last]
    return "::".join(["crate", *parts])


def _plain_module(path: str) -> str:
    return ".".join(p for p in re.sub(r"\.\w+$", "", path.replace("\\", "/")).split("/") if p)


LANGUAGES = {
    "rust": _language(Rust, ".rs", "target .cargo", "main", "new default from into try_from try_into drop clone fmt eq ne cmp partial_cmp hash deref deref_mut index index_mut add sub mul div rem neg not next into_iter iter as_ref as_mut borrow borrow_mut to_string from_str main", _rust_module),
    "c": _language(C, ".c .h", "build cmake-build-debug", "main", "main Main WinMain wWinMain DllMain _tmain", _plain_module),
    "csharp": _language(CSharp, ".cs", "bin obj packages", "Main", ".ctor .cctor Main Dispose DisposeAsync ToString Equals GetHashCode CompareTo GetEnumerator MoveNext Reset Current Finalize Deconstruct Invoke", _plain_module, ("get_", "set_", "init_")),
    "typescript": _language(TypeScript, ".ts .tsx .mts .cts .js .jsx .mjs .cjs", "node_modules dist build .next coverage", "main", "constructor toString valueOf toJSON componentDidMount componentDidUpdate componentWillUnmount shouldComponentUpdate getSnapshotBeforeUpdate componentDidCatch render getDerivedStateFromProps getDerivedStateFromError ngOnInit ngOnDestroy ngOnChanges ngAfterViewInit", _plain_module),
}
