"""What paths, configurations and package files say."""

import pytest

from codefacts.__main__ import main, should_color
from codefacts.sources import program as p
from codefacts.sources import resolve as r


def test_predicates():
    assert [p.is_program_file(x) for x in ("a.ts", "a.tsx", "a.mts", "a.cts", "a.d.ts", "a.d.tsx", "a.d.mts", "a.js", "ts")] == [True] * 4 + [False, False, True, False, False]
    tests = {"a.test.ts": True, "b.spec.cts": True, "test.ts": True, "spec.tsx": True, "test.mts": False, "tests/x.ts": True, "a/__tests__/b/c.ts": True, "atest.ts": False, "src/testing/a.ts": False}
    assert {k: p.is_test_file("/r", "/r/" + k) for k in tests} == tests
    assert not p.is_test_file("/tests/r", "/tests/r/a.ts")


def test_glob_prefix():
    assert p.glob_prefix("/r", "src/**/*.spec.ts") == "/r/src"
    assert p.glob_prefix("/r", "**/x") == "/r"
    assert p.glob_prefix("/r", "src/a?.ts") == "/r/src/a"


def test_load(tmp_path):
    with pytest.raises(p.NoTsConfig):
        p.load(str(tmp_path))
    (tmp_path / "tsconfig.json").write_text('{"include": ["src"], "exclude": ["src/x", "**/y"], "files": ["src/x/kept.ts", "gone.ts"]}')
    for name in ("src/a.ts", "src/a/b.ts", "src/x/left.ts", "src/x/kept.ts", "src/y/in.ts", "src/node_modules/m.ts", "src/z.js"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    found = p.load(str(tmp_path))
    assert [p.display_path(found.root, f) for f in found.files] == ["src/a/b.ts", "src/a.ts", "src/x/kept.ts", "src/y/in.ts"]
    (tmp_path / "tsconfig.json").write_text("{ nonsense")
    with pytest.raises(p.ProgramError):
        p.load(str(tmp_path))


def test_candidates():
    config = '{"base": null, "paths": {"@/*": ["/r/src/*"], "exact": ["/r/e"], "@/deep/*": ["/r/d/*", "/r/d2/*"]}}'
    assert r.candidates("/r/a/b.ts", "../c.js", config) == ["/r/c.ts", "/r/c.tsx", "/r/c.js", "/r/c.jsx"]
    assert r.candidates("/r/a/b.ts", "./c", config)[:3] == ["/r/a/c", "/r/a/c.ts", "/r/a/c.tsx"]
    assert "/r/a/index.ts" in r.candidates("/r/a/b.ts", ".", config)
    assert r.candidates("/r/a.ts", "@/m", config)[0] == "/r/src/m"
    assert r.candidates("/r/a.ts", "@/deep/m", config)[0] == "/r/d/m" and "/r/d2/m" in r.candidates("/r/a.ts", "@/deep/m", config)
    assert r.candidates("/r/a.ts", "exact", config)[0] == "/r/e"
    assert r.candidates("/r/a.ts", "react", config) == []


def test_entry_points(tmp_path):
    names = ["index.ts", "src/main.ts", "src/cli.tsx", "src/deep/index.ts", "src/pkg.ts", "src/bin.mts", "other/x.cts", "src/main.test.ts", "root.ts"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("")
    (tmp_path / "tsconfig.json").write_text("{}")
    entries = lambda: {p.display_path(own.root, f) for f in r.entry_points(own)}
    own = p.load(str(tmp_path))
    assert entries() == {"index.ts", "src/main.ts", "src/cli.tsx"}
    (tmp_path / "package.json").write_text('{"main": "./dist/pkg.js", "bin": {"a": "build/bin.mjs", "b": 1}, "exports": {"x": ["./other/x.cjs", {"y": "out/root.js"}], "z": "../outside.js"}}')
    assert entries() == {"index.ts", "src/main.ts", "src/cli.tsx", "src/pkg.ts", "src/bin.mts", "other/x.cts", "root.ts"}
    (tmp_path / "package.json").write_text("not json")
    assert entries() == {"index.ts", "src/main.ts", "src/cli.tsx"}


def test_command_line(tmp_path, capsys, monkeypatch):
    assert main([str(tmp_path)]) == 1
    assert "tsconfig.json" in capsys.readouterr().err
    with pytest.raises(SystemExit) as e:
        main(["--nonsense"])
    assert e.value.code == 2
    assert should_color("always") and not should_color("never") and not should_color("auto")


def test_packages_resolve_by_links_names_and_conditions(tmp_path):
    import json

    from codefacts.sources.program import load
    from codefacts.sources.resolve import candidates

    def put(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text if isinstance(text, str) else json.dumps(text))

    put("tsconfig.json", "{}")
    put("package.json", {"name": "top", "imports": {"#util/*.js": "./util/*.ts", "#one": {"node": "./no.ts", "default": ["./util/one.ts"]}, "#out": "@w/lib/deep"}, "exports": {".": "./main.ts", "./sub": None}})
    put("main.ts", "import '@w/lib';")
    put("util/one.ts", "")
    put("packages/lib/package.json", {"name": "@w/lib", "exports": {".": {"browser": "./b.js", "import": "./src/index.js"}, "./deep": "./src/deep.ts", "./x/*": ["./src/x/*.ts", "./src/y/*.ts"], "./x/private/*": None}})
    for name in ("index", "deep", "x/a", "y/b"):
        put(f"packages/lib/src/{name}.ts", "")
    put("packages/old/package.json", {"main": "lib/start"})
    put("packages/old/lib/start.ts", "")
    put("packages/old/more.ts", "")
    put("node_modules/real/index.ts", "")
    (tmp_path / "node_modules/@w").mkdir()
    (tmp_path / "node_modules/@w/lib").symlink_to(tmp_path / "packages/lib")
    (tmp_path / "node_modules/old").symlink_to(tmp_path / "packages/old")
    program = load(str(tmp_path))
    root = program.root

    def first(specifier, file="main.ts"):
        found = next((c for c in candidates(f"{root}/{file}", specifier, program.config) if c in program.known), None)
        return found and found[len(root) + 1 :]

    assert first("@w/lib") == "packages/lib/src/index.ts"
    assert first("@w/lib/deep", "util/one.ts") == "packages/lib/src/deep.ts"
    assert first("@w/lib/x/a") == "packages/lib/src/x/a.ts" and first("@w/lib/x/b") == "packages/lib/src/y/b.ts"
    assert first("@w/lib/x/private/a") is None and first("@w/lib/src/deep") is None
    assert first("old") == "packages/old/lib/start.ts" and first("old/more") == "packages/old/more.ts"
    assert first("#util/one.js") == "util/one.ts" and first("#one") == "util/one.ts" and first("#out") == "packages/lib/src/deep.ts" and first("#none") is None
    assert first("top") == "main.ts" and first("top/sub") is None
    # A package has its own scope: other names, and not those of the one around it.
    assert first("#one", "packages/lib/src/index.ts") is None
    assert first("@w/lib/deep", "packages/lib/src/index.ts") == "packages/lib/src/deep.ts"
    assert first("real") is None
