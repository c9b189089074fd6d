"""The parser and what it tells about a file."""

import sys

import pytest

from codefacts.frontend.facts import File
from codefacts.frontend.lexer import token_at
from codefacts.frontend.parser import parse


def count(source: str) -> int:
    program, _, errors = parse(source)
    assert not errors, source
    nodes = lambda n: 1 + sum(map(nodes, n.children))
    return nodes(program) - 1


ACCEPTED = [
    "const f = async <T,>(x: T): Promise<T> => await x;",
    "a ? (b) : (c => d);",
    "x = y as unknown as string[];",
    "const r = /ab[/]c/g.test(s) ? `a${b + `c${d}`}e` : a / b / c;",
    "class A<T> extends B<T> implements C, D { static #x = 1; private readonly y?: number; constructor(private a: string, public b = 2) { super(); } get z() { return this.#x } async *gen(): AsyncGenerator<number> { yield* other(); } [k: string]: any; abstract foo(): void; static { a() } }",
    "type M<T> = { readonly [K in keyof T as `x${K & string}`]?: T[K] extends (infer U)[] ? U : never };",
    "export default function () {}",
    "let {a, b: {c = 1}, ...d} = e!;",
    "for (const [k, v] of Object.entries(x)) { if (k in v) continue; else break }",
    "for (let i = 0, n = 3; i < n; i++) for (const k in o) {}",
    "declare module 'x' { export function f(a: number): void; }",
    "f<string>(x); const g = a < b; new Map<string, Array<Set<number>>>();",
    "label: while (1) { do { x++ } while (y) }",
    "function check(val: any): asserts val is string {}",
    "export * as ns from './m'; export type { T } from './t'; import type { X } from 'x'; import d, * as n from \"q\";",
    "const o = { a, b() {}, get c() { return 1 }, async *d() {}, [e]: 1, 'f': 2, ...g };",
    "enum E { A = 1, B } const enum F { C }",
    "x = a?.b?.[c]?.(d) ?? e;",
    "function f(this: Window, ...rest: number[]) {}",
    "let v = <any>foo;",
    "const fn = function* named<T extends object>(x: T) { return x satisfies object };",
    "switch (a) { case 1: case 2: f(); break; default: g() }",
    "try { a() } catch { b() } finally { c() }",
    "let t: [a: string, b?: number, ...c: boolean[]] = x; type F = new (...args: any[]) => object; let u: unique symbol;",
    "if (a) /re/.test(b);",
    "@dec() export class Q { @inner() x = 1; declare y: string; async = 1; get = 2; static static() {} }",
    "namespace A.B { export const c = 1 } declare global { interface Window { x: 1 } }",
    "const p = async () => { for await (const x of y) yield_(x) }; async function* z() { await 1; yield }",
]


@pytest.mark.parametrize("source", ACCEPTED)
def test_accepted(source):
    assert parse(source)[2] == 0


def test_jsx():
    program, _, errors = parse("const x = <div className=\"a\" {...p} on={() => f(1)}>it's {y} <B.C /> <></></div>; foo(x);", "a.tsx")
    assert errors == 0 and len(program.children) == 2


def test_what_cannot_be_read_is_passed_over():
    program, _, errors = parse("const = ;\nfunction ok() { return 1 }\nclass { }\nexport const z = 2")
    assert errors >= 1
    assert [n.kind for n in program.children if n.kind in ("Function", "Export")] == ["Function", "Export"]


def test_node_counts():
    assert count("const a = (1 as any)") == 7
    assert count("const b = 2") == 4
    assert count("function f() { return a + 1 }") == 2 + 1 + 4


def test_tokens():
    assert token_at("a /b/ c", 1, False).text == "/"
    assert token_at("= /b/ c", 1, True).text == "/b/"
    body = File("function f(a) { return a + 'x' + `y${1}` + null; // end\n }").shapes[0]
    assert body["tokens"] == ["{", "return", "$ID", "+", "$LIT", "+", "$LIT", "$LIT", "$LIT", "+", "$LIT", ";", "}"]


def test_exports_and_imports():
    f = File("import d, { a as b } from './m';\nimport './s';\nimport * as n from './n';\nexport { b as c, d };\nexport { x as y } from './o';\nexport {} from './none';\nexport * from './p';\nexport * as q from './q';\nexport default class K {}\nexport const { no } = n, yes = 1;\nexport type T = 1; export interface I {} export enum E {}\n")
    assert [(e["name"], e["display"], e["line"]) for e in f.exports] == [("c", "c", 4), ("d", "d", 4), ("y", "y", 5), ("q", "q", 8), ("default", "K", 9), ("yes", "yes", 10), ("T", "T", 11), ("I", "I", 11), ("E", "E", 11)]
    assert [(i["specifier"], i["kind"], i["name"]) for i in f.imports] == [("./m", "default", None), ("./m", "named", "a"), ("./s", "none", None), ("./n", "namespace", None), ("./o", "named", "x"), ("./p", "star", None), ("./q", "namespace", None)]


def test_offsets_are_bytes():
    f = File("const é = '😀';\nfunction g() {}\ng();")
    assert f.functions[0]["span_start"] == len("const é = '😀';\nfunction ".encode())
    assert f.functions[0]["line"] == 2
    assert f.calls[0]["target"] == f.functions[0]["span_start"]


def test_functions_and_forwards():
    f = File("export default function outer() { const a = () => { inner(); }; return (a() as any); }\nfunction inner() { return x.y(1); }\nfunction no(): void;\nconst b = (x) => x();\n")
    rows = {r["span_start"]: (r["name"], r["exported"], r["forward"] and r["forward"]["return_only"]) for r in f.functions}
    assert list(rows.values()) == [("outer", True, None), ("default", True, False), ("inner", False, True), ("default", False, None)]
    assert [s["name"] for s in f.shapes] == ["outer", "a", "inner", "b"]


def targets(source: str) -> list:
    f = File(source)
    names = {r["span_start"]: r["name"] for r in f.functions}
    starts = {r["span_start"]: source.encode()[r["span_start"] :].decode()[:6] for r in f.functions}
    return [(names.get(c["target"]) if names.get(c["target"]) != "default" else starts[c["target"]]) if c["target"] is not None else (c["specifier"], c["name"], c["member"]) if c["specifier"] else None for c in f.calls]


def test_callees():
    assert targets("function a() {} a(); { function a2() {} a2(); } a2();") == ["a", "a2", None]
    assert targets("function a() {} function f(a) { a() } f();") == [None, "f"]
    assert targets("function o(x: string): void; function o(x: any) {} o(1);") == [None]
    assert targets("const f: Handler = () => 1; f(); const g = () => 2; g();") == [None, "() => "]
    assert targets("import { a as b, default as c } from './m'; import * as n from './n'; b(); c(); n.x(); b.y();") == [("./m", "a", None), ("./m", "default", None), ("./n", "x", None), ("./m", "a", "y")]
    assert targets("class C { m() { this.n() } n() {} static s() {} } new C().m(); const c = new C(); c.n(); C.s(); function f(x: C) { x.m() }") == ["() {} ", "() { t", "() {} ", "() {} ", "() { t"]
    assert targets("const o = { m() {}, f: () => 1 }; o.m(); o.f(); o.z();") == ["() {},", "() => ", None]
    assert targets("function a() { return { b() {} } } a().b();") == ["a", "a"]
    assert targets("(function named() { named() })();") == ["named", "named"]


def test_parameters():
    f = File("function f(a, { b }, ...c) { g(a, a); h(!a); k(a as any); const z = () => l(a) }")
    assert [(p["name"], p["n_refs"], len(p["forward_calls"])) for p in f.params if p["fn_start"] == 9] == [("a", 5, 4)]


def test_types():
    f = File("interface A { b?: (string | null)[]; readonly a: B<C.D, 1>; m(x: number, ...r: any[]): void; [k: string]: any; (): void; 0: 'q' }\ntype X = { a: -1; b: keyof Y; c: [p: number, q?: string, ...r: T[]]; d: typeof z.w; e: { y: 1; x?: 2 }; f: B | A | (A | C) }\ntype Y = X & { z: 1 }; type Z = string; interface W extends A {}")
    assert [(t["name"], t["has_extends"], len(t["fields"])) for t in f.types] == [("A", False, 4), ("X", False, 6), ("Y", True, 0), ("W", True, 0)]
    assert [(x["name"], x["optional"], x["readonly"], x["canonical_type"]) for x in f.types[0]["fields"]] == [("0", False, False, '"q"'), ("a", False, True, "B<C.D, 1>"), ("b", True, False, "null | string[]"), ("m", False, False, "(x: number) => void")]
    assert [x["canonical_type"] for x in f.types[1]["fields"]] == ["UnaryNegation", "unknown", "[p: number, q?: string, ...r: T[]]", "typeof z.w", "{ x?: 2; y: 1 }", "A | B | C"]


@pytest.mark.parametrize(
    "source",
    [
        "function f(){}\nfunction g(){" + "if(x){" * 5000 + "f()" + "}" * 5000 + "}",
        "function f(){}\nconst a = " + "(" * 5000 + "f()" + ")" * 5000,
        "function f(){}\nconst a = " + "[" * 5000 + "f()" + "]" * 5000,
        "function f(){}\nconst a = " + "()=>" * 500 + "f()",
        "function f(){}\nconst a = " + "x?1:" * 5000 + "f()",
        "function f(){}\nconst s = " + "+".join(['"a"'] * 5000) + ";\nf()",
        "function f(){}\ntype T = " + "A<" * 3000 + "B" + ">" * 3000 + ";\nf()",
    ],
)
def test_deep_nesting_loses_no_call(source):
    limit = sys.getrecursionlimit()
    file = File(source)
    assert not file.errors and [c["target"] for c in file.calls if c["target"] is not None] == [9]
    assert sys.getrecursionlimit() == limit


def test_long_chains_of_calls_names_and_classes():
    assert len(File("p" + ".then(f)" * 5000).calls) == 5000
    names = "function f(){}\nconst a0 = f;\n" + "".join(f"const a{i + 1} = a{i};\n" for i in range(60)) + "a60();"
    assert File(names).calls[0]["target"] == 9
    classes = "class C0 { hit() {} }\n" + "".join(f"class C{i + 1} extends C{i} {{}}\n" for i in range(60)) + "new C60().hit();"
    assert File(classes).calls[-1]["target"] is not None
    assert File("const a = b;\nconst b = a;\na();\nclass D extends E {}\nclass E extends D {}\nnew D().x();").calls[0]["target"] is None


def test_brackets_that_never_close_and_cases_that_fail_often():
    for source in ("(" * 300, "(a" * 200 + "=>", "f<" * 200, "x ? (y) : " * 100 + "1 +", "()=>" * 200 + "}"):
        File(source)


def test_members_of_names_without_a_known_value():
    file = File("let a: number = 1;\nlet b;\na.x(); b.y(); c.z();\nexport default b;\nclass D extends b {}\nnew D().w();\nexport { a };")
    assert [c["target"] for c in file.calls] == [None] * 4
