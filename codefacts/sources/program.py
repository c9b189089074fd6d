"""A program on disk: its configuration, its files, and what a path says about a file.

Only names and configuration are read here, on the driver; file contents are read by Spark.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

#: What extensions and names mean.
PROGRAM_EXTENSIONS = (".ts", ".tsx", ".mts", ".cts")
TEST_NAME = re.compile(r"\.(?:test|spec)\.[mc]?ts$|\.(?:test|spec)\.tsx$|^(?:test|spec)\.tsx?$")
TEST_FOLDERS = frozenset(("__tests__", "tests", "test"))
PRUNED = frozenset(("node_modules", ".git"))


class ProgramError(Exception):
    """A program that can't be loaded."""


class NoTsConfig(ProgramError):
    def __init__(self, path: str) -> None:
        super().__init__(f"no tsconfig.json found at {path}")


@dataclass
class Program:
    root: str
    tsconfig_path: str
    files: list[str]
    base_url: str | None = None
    paths: dict[str, list[str]] = field(default_factory=dict)
    #: All files below the root, of whatever kind: what a specifier may resolve to.
    known: list[str] = field(default_factory=list)
    #: Folders with a package.json: at, package (the fields by which specifiers resolve).
    packages: list[dict] = field(default_factory=list)
    #: Packages that node_modules folders link to: at (the folder around node_modules), name, real, package.
    links: list[dict] = field(default_factory=list)

    @property
    def config(self) -> str:
        return json.dumps({"base": self.base_url, "paths": self.paths, "packages": self.packages, "links": self.links})


def components(path: str) -> list[str]:
    return path.split("/")


def is_program_file(path: str) -> bool:
    name = path.rpartition("/")[2]
    return name.endswith(PROGRAM_EXTENSIONS) and not name.endswith((".d.ts", ".d.tsx")) and name not in PROGRAM_EXTENSIONS


def is_js_file(path: str) -> bool:
    return path.endswith((".js", ".jsx", ".mjs", ".cjs"))


def display_path(root: str, path: str) -> str:
    return path[len(root.rstrip("/")) + 1 :] if path.startswith(root.rstrip("/") + "/") else path


def is_test_file(root: str, path: str) -> bool:
    *folders, name = components(display_path(root, path))
    return bool(TEST_NAME.search(name)) or not TEST_FOLDERS.isdisjoint(folders)


def locate_tsconfig(path: str) -> str:
    found = path if os.path.isfile(path) else os.path.join(path, "tsconfig.json")
    if not os.path.isfile(found):
        raise NoTsConfig(path)
    return os.path.realpath(found)


def read_json(path: str) -> dict:
    """JSON with comments and trailing commas."""
    with open(path, encoding="utf-8-sig") as file:
        text = file.read()
    strings = r'"(?:[^"\\]|\\.)*"'
    text = re.sub(rf"({strings})|//[^\n]*|/\*.*?\*/", lambda m: m[1] or "", text, flags=re.S)
    text = re.sub(rf"({strings})|,(?=\s*[}}\]])", lambda m: m[1] or "", text)
    return json.loads(text or "{}")


def read_tsconfig(path: str, seen: tuple[str, ...] = ()) -> dict:
    """The configuration with what it extends; relative paths stay with the file that has them."""
    try:
        own = read_json(path)
    except (OSError, ValueError) as e:
        raise ProgramError(f"failed to read {path}: {e}") from e
    folder = os.path.dirname(path)
    out: dict = {}
    above = own.get("extends") or []
    for name in [above] if isinstance(above, str) else above:
        base = os.path.normpath(os.path.join(folder, name))
        base = next((b for b in (base, base + ".json", os.path.join(base, "tsconfig.json")) if os.path.isfile(b)), None)
        if name.startswith((".", "/")) and base is None:
            raise ProgramError(f"failed to resolve {name} from {path}")
        if base is not None and base not in seen:
            out |= read_tsconfig(base, (*seen, path))
    for key in ("include", "exclude", "files"):
        if key in own:
            out[key] = own[key]
            out[key + "_at"] = folder
    options = own.get("compilerOptions") or {}
    if "baseUrl" in options:
        out["base"] = os.path.normpath(os.path.join(folder, options["baseUrl"]))
    if "paths" in options:
        out["paths"], out["paths_at"] = options["paths"], folder
    return out


def glob_prefix(root: str, pattern: str) -> str:
    """The folder or file that a pattern's literal beginning names."""
    prefix = re.split(r"[*?\[]", pattern, maxsplit=1)[0].rstrip("/")
    return os.path.normpath(os.path.join(root, prefix)) if prefix else root


def below(path: str, prefix: str) -> bool:
    return path == prefix or path.startswith(prefix.rstrip("/") + "/")


def walk(folder: str) -> list[str]:
    if os.path.isfile(folder):
        return [folder]
    out = []
    for top, folders, names in os.walk(folder):
        folders[:] = [f for f in folders if f not in PRUNED]
        out += [os.path.join(top, n) for n in names]
    return out


def read_package(folder: str) -> dict:
    """The fields of a folder's package.json that name files; a file that is missing or can't be read names nothing."""
    try:
        with open(os.path.join(folder, "package.json"), encoding="utf-8-sig") as file:
            package = json.load(file)
    except (OSError, ValueError):
        return {}
    return {k: package[k] for k in ("name", "main", "bin", "exports", "imports") if k in package} if isinstance(package, dict) else {}


def linked_packages(folder: str) -> list[dict]:
    """The packages that the node_modules of a folder link to elsewhere, as workspaces do."""
    top, out = os.path.join(folder, "node_modules"), []
    names = sorted(os.listdir(top)) if os.path.isdir(top) else []
    names = [n for n in names if not n.startswith("@")] + [f"{n}/{m}" for n in names if n.startswith("@") and os.path.isdir(os.path.join(top, n)) for m in sorted(os.listdir(os.path.join(top, n)))]
    for name in names:
        if os.path.islink(os.path.join(top, name)) and os.path.isdir(real := os.path.realpath(os.path.join(top, name))):
            out.append({"at": folder, "name": name, "real": real, "package": read_package(real)})
    return out


def load(path: str) -> Program:
    """The program that a tsconfig file, or the folder with one, includes."""
    tsconfig = locate_tsconfig(path)
    root, config = os.path.dirname(tsconfig), read_tsconfig(tsconfig)
    files = [os.path.realpath(os.path.join(root, f)) for f in config.get("files") or []]
    files = [f for f in files if os.path.isfile(f) and is_program_file(f)]
    includes = config.get("include") or ([] if "files" in config or "include" in config else ["**/*"])
    excludes = [p for p in (glob_prefix(root, e) for e in config.get("exclude") or []) if p != root]
    known = [os.path.realpath(f) for f in walk(root)]
    for include in includes:
        prefix = glob_prefix(root, include)
        found = known if prefix == root else [os.path.realpath(f) for f in walk(prefix)] if os.path.exists(prefix) else []
        files += [f for f in found if is_program_file(f) and not any(below(f, e) for e in excludes) and (prefix == root or below(f, prefix))]
    base = config.get("base")
    files = sorted(set(files), key=components)
    folders = {os.path.dirname(f) for f in known if f.endswith("/package.json")}
    around = {up for f in files for up in _up(os.path.dirname(f))}
    packages = [{"at": f, "package": read_package(f)} for f in sorted(folders | {f for f in around if os.path.isfile(os.path.join(f, "package.json"))})]
    links = [x for f in sorted(around) for x in linked_packages(f)]
    paths = {k: [os.path.normpath(os.path.join(base or config["paths_at"], t)) for t in v] for k, v in (config.get("paths") or {}).items()}
    return Program(root, tsconfig, files, base, paths, sorted({*known, *files}), packages, links)


def _up(folder: str) -> list[str]:
    return [folder] if os.path.dirname(folder) == folder else [folder, *_up(os.path.dirname(folder))]
