"""Whole programs from source text to report. All programs of this module are analysed in one run."""

import textwrap

import pytest

from codefacts.api import call_counts, many_facts
from codefacts.detectors import detect
from codefacts.plans.facts import Options, with_edges
from codefacts.report import render

BIG = """
  const total = input.reduce((sum, x) => sum + x, 0);
  const mean = total / input.length;
  let worst = 0;
  for (const x of input) {
    if (Math.abs(x - mean) > worst) {
      worst = Math.abs(x - mean);
    }
  }
  return { total: total, mean: mean, worst: worst + 1 };
"""

PROGRAMS = {
    "mix": {
        "tsconfig.json": '{ // comment\n "include": ["src/**/*", "tests"], "exclude": ["src/skip/**"], }',
        "package.json": '{"main": "./dist/entry.js", "bin": {"x": "lib/tool.mjs"}, "exports": {".": [{"import": "./build/deep/extra.js"}]}}',
        "src/index.ts": "import { run, barrelled } from './barrel';\nimport * as util from './util/helpers.js';\nexport function main(flag: string) { run(flag); util.used(); barrelled(); }\n",
        "src/barrel.ts": "export * from './work';\nexport { original as barrelled } from './work';\n",
        "src/work.ts": "export function run(data: string) { first(data); }\nfunction first(d: string) { second(d); }\nfunction second(d: string) { console.log(d); }\nexport function original() { return wrapped(); }\nfunction wrapped() { return 1 + 1; }\nexport default function () { wrapped(); }\n",
        "src/util/helpers.ts": "export const used = () => { helper(); };\nexport function unused() { helper(); }\nfunction helper() {}\n",
        "src/entry.ts": "export function start() { go(); go(); }\nfunction go() {}\nfunction dead() {}\n",
        "src/tool.mts": "boot();\nfunction boot() {}\n",
        "src/deep/extra.ts": "export {};\n",
        "src/skip/ignored.ts": "export function nope() {}\n",
        "src/orphan.ts": "import './orphan2';\nexport function lonely() {}\n",
        "src/orphan2.ts": "export const z = 1;\n",
        "src/types.d.ts": "declare const T: number;\n",
        "src/old.js": "export const js = 1;\n",
        "tests/work.test.ts": "import { original } from '../src/work';\nimport type { Never } from '../src/never';\ndescribe('x', () => { original(); });\n",
        "src/never.ts": "export interface Never { a: 1; b: 2; c: 3 }\nexport type Again = { c: 3; a: 1; b: 2 };\n",
    },
    "dup": {
        "tsconfig.json": '{"extends": "./base", "files": ["main.ts"]}',
        "base.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["lib/*"]}}, "include": ["lib"]}',
        "main.ts": f"import {{ alpha }} from '@lib/a';\nimport {{ other }} from 'lib/b';\nexport function one(input: number[]) {{{BIG}}}\nalpha([]); other();\n",
        "lib/a.ts": f"export const alpha = (input: number[]) => {{{BIG}}};\nexport function one(input: number[]) {{{BIG}}}\n",
        "lib/b.ts": f"export function other(): any {{ return alphaCopy; }}\nfunction alphaCopy(input: number[]) {{{BIG.replace('+ 1', '+ 2')}}}\nfunction differs(input: number[]) {{{BIG.replace('sum + x', 'sum * x').replace('> worst', '< worst').replace('total / ', 'total % ')}}}\n",
    },
    "stars": {
        "tsconfig.json": "{}",
        "index.ts": "import { deep } from './z';\nimport { A } from './cls';\ndeep();\nexport function go(a: A) { a.hit(); new A().miss(); helper(go); }\nfunction helper(f: any) { f(); }\n",
        "a.ts": "export * from './b';\n",
        "b.ts": "export * from './c';\n",
        "c.ts": "export function deep() { return deep2(); }\nexport function deep2() { return 1; }\nexport default 1;\n",
        "z.ts": "export * from './a';\n",
        "cls.ts": "class Base { hit() { this.own(); } own() {} }\nexport class A extends Base { miss() {} never() {} }\n",
    },
    "hops": {
        "tsconfig.json": "{}",
        "index.ts": "import { far } from './m0';\nimport { round } from './r0';\nfar(); round();\nexport function go() { far(); }\n",
        **{f"m{i}.ts": f"export {{ far }} from './m{i + 1}';\n" for i in range(45)},
        "m45.ts": "export function far() {}\n",
        "r0.ts": "export { round } from './r1';\n",
        "r1.ts": "export { round } from './r0';\n",
    },
    "empty": {"tsconfig.json": '{"include": []}', "x.ts": "export const a = 1;\n"},
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("programs")
    for program, files in PROGRAMS.items():
        for name, text in files.items():
            path = top / program / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
    return top


@pytest.fixture(scope="module")
def own_facts(spark, folder):
    return many_facts(spark, [str(folder / p) for p in PROGRAMS])


@pytest.fixture(scope="module")
def found(own_facts):
    return [r.asDict(recursive=True) for r in detect(own_facts, Options()).collect()]


def of(found, program, shape):
    return [(f["file"], f["subject"], [n["label"] for n in f["evidence"]]) for f in found if f["program"].endswith("/" + program) and f["shape"] == shape]


def test_unreachable(found):
    assert [(a, b) for a, b, _ in of(found, "mix", "Unreachable")] == [("src/entry.ts", "dead"), ("src/orphan.ts", "src/orphan.ts"), ("src/orphan2.ts", "src/orphan2.ts"), ("src/util/helpers.ts", "unused"), ("src/work.ts", "default")]


def test_single_use_chain_and_wrappers(found):
    assert of(found, "mix", "SingleUseChain") == [("src/work.ts", "first", ["run   (exported, not in chain)", "first", "second"])]
    # run only forwards to the first of the chain, and so is left out here.
    assert of(found, "mix", "EmptyWrapper") == [("src/util/helpers.ts", "default", ["default", "helper"]), ("src/util/helpers.ts", "unused", ["unused", "helper"]), ("src/work.ts", "original", ["original", "wrapped"]), ("src/work.ts", "default", ["default", "wrapped"]), ("tests/work.test.ts", "default", ["default", "original"])]


def test_false_sharing(found):
    rows = of(found, "mix", "FalseSharing")
    assert ("src/util/helpers.ts", "unused", ["src/index.ts", "unused"]) in rows
    assert ("src/barrel.ts", "run", ["src/index.ts", "run"]) in rows
    assert ("src/work.ts", "run", ["src/barrel.ts", "run"]) in rows
    # Imported from src and from tests.
    assert not [r for r in rows if r[:2] == ("src/work.ts", "original")]
    assert not [r for r in rows if r[1] == "default"]


def test_tramp_data(found):
    assert of(found, "mix", "TrampData") == [("src/index.ts", "flag", ["main", "run"]), ("src/work.ts", "data", ["run", "first"]), ("src/work.ts", "d", ["first", "second"])]


def test_type_clone_and_unreaching_test(found):
    assert of(found, "mix", "TypeClone") == [("src/never.ts", "Never", ["Never", "Again"])]
    assert [(f["line"], f["span_start"]) for f in found if f["shape"] == "UnreachingTest"] == [(2, 40)]
    assert of(found, "mix", "UnreachingTest") == [("tests/work.test.ts", "src/never.ts", ["tests/work.test.ts", "src/never.ts"])]


def test_near_duplicate(found):
    assert of(found, "dup", "NearDuplicate") == [("lib/a.ts", "alpha", ["alpha", "one"]), ("lib/a.ts", "alpha", ["alpha", "alphaCopy"]), ("lib/a.ts", "alpha", ["alpha", "one"]), ("lib/a.ts", "one", ["one", "alphaCopy"]), ("lib/b.ts", "alphaCopy", ["alphaCopy", "one"])]


def test_aliases_and_top_level_calls(own_facts):
    deps = {(r.src.rpartition("/dup/")[2], r.dst.rpartition("/dup/")[2]) for r in own_facts.file_deps.collect() if "/dup/" in r.src}
    assert deps == {("main.ts", "lib/a.ts"), ("main.ts", "lib/b.ts")}
    counts = {r.program.rpartition("/")[2]: (r.calls, r.resolved) for r in call_counts(own_facts).collect()}
    assert counts["dup"][1] == 2
    assert not [e for e in own_facts.edges.collect() if "main.ts" in e.src]


def test_stars_are_one_ordered_pass(own_facts):
    exports = {(r.file.rpartition("/")[2], r.name) for r in own_facts.exports.collect() if "/stars/" in r.file}
    # a.ts is read before b.ts and so sees nothing of c.ts.
    assert ("b.ts", "deep") in exports and ("a.ts", "deep") not in exports and ("b.ts", "default") not in exports
    edges = {(e.src.rpartition("/")[2].split(":")[0], e.dst.rpartition("/")[2].split(":")[0]) for e in own_facts.edges.collect() if "/stars/" in e.src}
    assert edges == {("index.ts", "cls.ts"), ("index.ts", "index.ts"), ("c.ts", "c.ts"), ("cls.ts", "cls.ts")}


def test_order_is_by_path_component(found):
    mine = [f["file"].split("/") for f in found if f["program"].endswith("/mix")]
    assert mine == sorted(mine)


def test_options(own_facts, spark):
    rows = [r.asDict(recursive=True) for r in detect(own_facts, Options(production=True, include_exported=True)).collect()]
    assert ("src/never.ts", "src/never.ts", ["src/never.ts"]) in of(rows, "mix", "Unreachable")
    assert ("src/work.ts", "run", ["main", "run", "first", "second"]) in of(rows, "mix", "SingleUseChain")


def test_report(found):
    mine = [f for f in found if f["program"].endswith("/mix") and f["file"] in ("src/entry.ts", "src/never.ts", "src/work.ts") and f["shape"] in ("Unreachable", "TypeClone", "TrampData")]
    assert render(mine) == textwrap.dedent("""\
        src/entry.ts

        UNREACHABLE
        subject: dead  (line 3)
        Function 'dead' is not reachable from any entry point.
        dead  ←── finding

        src/never.ts

        TYPE CLONE
        subject: Never  (line 1)
        Type 'Never' has identical fields and types to 'Again' without inheritance.
        Never  ←── finding
             │
             ▼
        Again

        src/work.ts

        TRAMP DATA
        subject: data  (line 1)
        Parameter 'data' in 'run' is forwarded to 'first' without local use.
        run  ←── finding
             │  passes data
             ▼
        first

        TRAMP DATA
        subject: d  (line 2)
        Parameter 'd' in 'first' is forwarded to 'second' without local use.
        first  ←── finding
             │  passes d
             ▼
        second

        UNREACHABLE
        subject: default  (line 6)
        Function 'default' is not reachable from any entry point.
        default  ←── finding
        """)
    assert render([]) == ""
    assert "\x1b[" in render(mine, True) and "\x1b[" not in render(mine)


def test_edges_from_elsewhere(own_facts, spark):
    rows = {r.name: r for r in own_facts.functions.where("display = 'src/entry.ts'").collect()}
    go, dead = rows["go"], rows["dead"]
    given = spark.createDataFrame([(go.program, go.file, go.span_start, dead.file, dead.span_start, 7), (go.program, go.file, 99999, dead.file, dead.span_start, 8)], "program string, src_file string, src_span int, dst_file string, dst_span int, call_start int")
    assert [tuple(r) for r in with_edges(own_facts, given).edges.collect()] == [(go.program, go.fn, dead.fn, 7)]


def test_names_are_followed_through_any_number_of_files(own_facts):
    calls = {r.program.rpartition("/")[2]: (r.calls, r.resolved) for r in call_counts(own_facts).collect()}
    assert calls["hops"] == (3, 2)
    assert [(e.src.rpartition("/")[2].split(":")[0], e.dst.rpartition("/")[2].split(":")[0]) for e in own_facts.edges.collect() if "/hops/" in e.src] == [("index.ts", "m45.ts")]
