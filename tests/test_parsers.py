"""Parsers: snippets to nodes and references."""

import pytest

from sparkweave.parse import LANGUAGES


def parsed(lang, source, path=None):
    ext = {"python": "m.py", "rust": "src/m.rs", "c": "m.c", "csharp": "M.cs", "typescript": "m.tsx"}[lang]
    return LANGUAGES[lang].parse(path or ext, source.encode())


def nodes(p):
    return {(n["node_type"], n["qualified_name"]) for n in p.nodes}


def refs(p, kind):
    return {(s, t) for s, t, k, _ in p.refs if k == kind}


def test_python_rules():
    p = parsed("python", "import a.b as c\nfrom x import y, z\nLIMIT: int = y\nclass K(Base):\n    f = 1\n    def m(self, q: Kind = LIMIT):\n        self.g = q\n        for t in self.items: t.run()\n        v += 1\n        return c.call(self.h.i)\n    @staticmethod\n    async def n():\n        global LIMIT\n        LIMIT = 2\n")
    assert nodes(p) == {("variable", "m.LIMIT"), ("class", "m.K"), ("field", "m.K.f"), ("method", "m.K.m"), ("field", "m.K.g"), ("method", "m.K.n")}
    assert ("m.K", "Base") in refs(p, "inherit") and ("m.LIMIT", "y") in refs(p, "read")
    assert refs(p, "call") == {("m.K.m", "t.run"), ("m.K.m", "c.call")}
    assert {("m.K.m", "g"), ("m.K.m", "v"), ("m.K.n", "m.LIMIT"), ("m.K", "f")} == refs(p, "write")
    assert ("m.K.m", "h.i") not in refs(p, "read") and ("m.K.m", "i") in refs(p, "read")
    assert [w[2] for w in p.warnings] == ["'z' imported but not used"]


def test_python_types_of_loops():
    p = parsed("python", "class K:\n    items: list[Thing]\n    def m(self):\n        for t in self.items:\n            t.name\n")
    assert ("m.K.m", "Thing.name") in refs(p, "read")


def test_rust():
    p = parsed("rust", 'use std::fmt;\nuse a::{b, c as d};\npub struct Point { x: i32, kind: Kind }\nimpl fmt::Display for Point {\n    fn fmt(&self) -> u8 { helper(self.x); println!("{}", d) }\n}\nimpl Point { pub fn new() -> Self { let p = make(); p } }\nenum E { A, B(Kind) }\nconst N: usize = 3;\n#[test]\nfn check() { Point::new(); }\nmod inner { fn f<\'a>() { super::helper(\'x\', N) } }\nmacro_rules! m { () => {} }\ntrait T { fn go(&self); }\n')
    assert {("struct", "crate::m::Point"), ("field", "crate::m::Point::x"), ("method", "crate::m::Point::fmt"), ("method", "crate::m::Point::new"), ("variable", "crate::m::Point::new::p"), ("enum", "crate::m::E"), ("enum_member", "crate::m::E::B"), ("constant", "crate::m::N"), ("function", "crate::m::check"), ("module", "crate::m::inner"), ("function", "crate::m::inner::f"), ("macro", "crate::m::m"), ("trait", "crate::m::T"), ("method", "crate::m::T::go")} <= nodes(p)
    assert ("crate::m::Point", "fmt::Display") in refs(p, "inherit")
    assert {("crate::m::Point::fmt", "helper"), ("crate::m::Point::fmt", "println"), ("crate::m::check", "Point::new"), ("crate::m::Point::new", "make"), ("crate::m::inner::f", "helper")} <= refs(p, "call")
    assert [w[2] for w in p.warnings] == ["'b' imported but not used"]
    assert ("test", "", 10, 0) in p.marks


def test_c():
    p = parsed("c", '#include "util.h"\n#define MAX(a) LIMIT + a\n#ifdef DEBUG\nstatic int count = MAX(1), other;\n#endif\ntypedef struct { int value; char *name; } Item;\nenum Color { RED, GREEN };\nstruct Node { struct Node *next; Item item; int (*cb)(void); };\nint proto(void), bar;\ntypedef void (*callback_t)(void);\nint (*fp)(void);\nstatic int add(int a, Item *it) {\n    int local = helper(a);\n    it->value = RED;\n    local++;\n    return local + count;\n}\n')
    assert {("macro", "m.MAX"), ("variable", "m.count"), ("variable", "m.other"), ("type", "m.Item"), ("field", "m.Item.value"), ("enum", "m.Color"), ("enum_member", "m.Color.RED"), ("struct", "m.Node"), ("field", "m.Node.next"), ("field", "m.Node.cb"), ("variable", "m.bar"), ("type", "m.callback_t"), ("variable", "m.fp"), ("function", "m.add"), ("variable", "m.add.local")} <= nodes(p)
    assert not any(n["name"] in ("proto", "a", "it") for n in p.nodes)
    assert ("m.add", "helper") in refs(p, "call") and ("m.add", "RED") in refs(p, "read") and ("m.add", "Item") in refs(p, "read")
    assert ("m.add", "value") in refs(p, "write") and ("m.MAX", "LIMIT") in refs(p, "read") and ("m", "DEBUG") in refs(p, "read")
    assert {n["name"]: n["visibility"] for n in p.nodes if n["name"] in ("add", "bar")} == {"add": "static", "bar": ""}
    assert p.imports[0]["module"] == "util.h" and not any(("m.Color", x) in refs(p, "read") for x in ("RED", "GREEN"))


def test_csharp():
    p = parsed("csharp", 'using System;\nusing Old = Some.Thing;\nnamespace MyApp;\n[ApiController]\n[Route("x")]\npublic class User : Person, IThing\n{\n    public string Name { get; set; }\n    private int age = 3;\n    public User(int a) : base(a) { age = a; }\n    [HttpGet]\n    public async Task<Item> Add(Item it) { var q = new Order(1); Helper.Run(q); return it; }\n    public int Sum => age + 1;\n}\npublic partial class Part { void F() {} }\nenum Color { Red, Green }\ndelegate void Done(int x);\nrecord Pair(int A, int B);\ninterface IShape { double Area(); }\n')
    assert {("class", "MyApp.User"), ("property", "MyApp.User.Name"), ("field", "MyApp.User.age"), ("constructor", "MyApp.User..ctor"), ("method", "MyApp.User.Add"), ("property", "MyApp.User.Sum"), ("class", "MyApp.Part#partial:M.cs"), ("enum", "MyApp.Color"), ("enum_member", "MyApp.Color.Red"), ("delegate", "MyApp.Done"), ("record", "MyApp.Pair"), ("property", "MyApp.Pair.A"), ("interface", "MyApp.IShape"), ("method", "MyApp.IShape.Area")} <= nodes(p)
    assert refs(p, "inherit") == {("MyApp.User", "Person"), ("MyApp.User", "IThing")}
    assert {("MyApp.User.Add", "Order..ctor"), ("MyApp.User.Add", "Helper.Run")} <= refs(p, "call")
    assert ("MyApp.User..ctor", "age") in refs(p, "write") and ("MyApp.User.Sum", "age") in refs(p, "read")
    assert next(n for n in p.nodes if n["name"] == "User")["decorators"] == ["ApiController", "Route"]
    assert [w[2] for w in p.warnings] == ["'Old' imported but not used"]
    assert any(k == "program" for k, *_ in parsed("csharp", "Console.WriteLine(1);\n").marks)


def test_typescript():
    p = parsed("typescript", 'import express, { readFile as rf, type T } from "x";\nimport type { U } from "y";\nexport const add = (a: number, b: Num): number => helper(a) + b\nconst limit = 3;\nexport default class App extends Component<Props> implements Thing {\n  private count: Counter = new Counter();\n  @Input() name = "x";\n  constructor(x: Foo) { super(); this.count = limit; }\n  async run(q: Query): Promise<void> {\n    const v = `t${q}`;\n    express.listen(v);\n  }\n}\nexport function main() { return <Button label={limit}><div/></Button>; }\nenum Color { Red, Green }\ntype Alias = string | Other;\ninterface Shape { area(): number; side: Len }\nnamespace N { export function inner() {} }\nexport { limit };\n')
    assert {("function", "add"), ("variable", "limit"), ("class", "App"), ("property", "App.count"), ("property", "App.name"), ("method", "App.constructor"), ("method", "App.run"), ("variable", "App.run.v"), ("function", "main"), ("enum", "Color"), ("enum_member", "Color.Red"), ("type_alias", "Alias"), ("interface", "Shape"), ("method", "Shape.area"), ("namespace", "N"), ("function", "N.inner")} <= nodes(p)
    assert refs(p, "inherit") == {("App", "Component"), ("App", "Thing")}
    assert {("add", "helper"), ("App.count", "Counter.constructor"), ("App.run", "express.listen"), ("main", "Button")} <= refs(p, "call")
    assert ("main", "Button") in refs(p, "jsx_element") and ("main", "limit") in refs(p, "read")
    assert [w[2] for w in p.warnings] == ["'rf' imported but not used"]
    assert {n for k, n, _, _ in p.marks if k == "export"} >= {"add", "limit", "App", "main"}
    t = parsed("typescript", 'describe("x", () => { it("y", () => { run(); }); });\n', "a.test.ts")
    assert any(k == "test" for k, *_ in t.marks) and ("", "run") in refs(t, "call")


@pytest.mark.parametrize("lang", ["python", "rust", "c", "csharp", "typescript"])
@pytest.mark.parametrize("source", ["", "}}}}", "((((", "class", "fn", "\x00\x01", "'", '"', "/*", "import", "a" * 50_000, "{" * 3000, "const x = {a: [1, (2]}", "é = 1", "<<<<>>>>", "#", "@", "new", "enum E", "use a::", "struct S {"])
def test_no_source_breaks_a_parser(lang, source):
    p = parsed(lang, source)
    assert all(n["line_end"] >= n["line_start"] for n in p.nodes)
