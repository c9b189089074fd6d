"""Facts of one source file: one parse, all tables' rows of that file.

Offsets are UTF-8 bytes. What a call's callee is bound to is decided here as far as the file goes: a
function of the file, a member of a class or object of the file, or a name of another module.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

from codefacts.frontend.lexer import normalised
from codefacts.frontend.parser import Node, deep, parse
from codefacts.frontend.types import type_rows

FUNCTIONS = ("Function", "Arrow")


@dataclass
class Scope:
    """Names of a block or function; ``function`` is where var declarations go."""

    up: Scope | None
    function: bool = False
    names: dict[str, tuple] = field(default_factory=dict)

    def find(self, name: str) -> tuple | None:
        scope = self
        while scope is not None:
            if name in scope.names:
                return scope.names[name]
            scope = scope.up
        return None


class File:
    """Everything that one source file tells."""

    def __init__(self, source: str, file: str = "a.ts") -> None:
        self.source = source.removeprefix("﻿")
        self.program, self.tokens, self.errors = parse(self.source, file)
        self.wide = None if self.source.isascii() else [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in self.source)]
        self.newlines = [i for i, c in enumerate(self.source) if c == "\n"]
        self.token_starts = [t.start for t in self.tokens]
        self.exports: list[dict] = []
        self.imports: list[dict] = []
        self.functions: list[dict] = []
        self.calls: list[dict] = []
        self.params: list[dict] = []
        self.shapes: list[dict] = []
        self.decls: dict[str, dict] = {}
        self.innermost: dict[int, Node] = {}
        for statement in self.program.children:
            self.module_statement(statement)
        self.top = Scope(None, True)
        with deep(self.source):
            self.declare(self.program.children, self.top)
            self.walk(self.program, self.top, Context())
            self.types = type_rows(self)
            self.declared()

    def at(self, offset: int) -> int:
        return offset if self.wide is None else self.wide[min(offset, len(self.source))]

    def line(self, offset: int) -> int:
        return 1 + bisect_right(self.newlines, offset - 1)

    # Imports and exports

    def export(self, name: str, display: str, offset: int, local: str | None = None, source: str | None = None, taken: str | None = None) -> None:
        self.exports.append({"name": name, "display": display, "line": self.line(offset), "span_start": self.at(offset), "ord": len(self.exports), "local": local, "from_specifier": source, "from_name": taken})

    def take(self, statement: Node, names: list[tuple[str, str | None]]) -> None:
        """A statement's imports: (kind, name); a statement without names is a row of kind 'none'."""
        order = self.imports[-1]["stmt_ord"] + 1 if self.imports else 0
        for i, (kind, name) in enumerate(names or [("none", None)]):
            self.imports.append({"specifier": statement.source, "kind": kind, "name": name, "line": self.line(statement.start), "span_start": self.at(statement.start), "stmt_ord": order, "name_ord": i})

    def module_statement(self, s: Node) -> None:
        if s.kind == "Import":
            kinds = {"ImportDefault": "default", "ImportNamespace": "namespace", "ImportName": "named"}
            self.take(s, [(kinds[x.kind], x.name if x.kind == "ImportName" else None) for x in s.specifiers])
        elif s.kind == "ExportFrom":
            for x in s.specifiers:
                self.export(x.alias.name, x.alias.name, x.alias.start, None, s.source, x.name)
            if s.specifiers:
                self.take(s, [("named", x.name) for x in s.specifiers])
        elif s.kind == "ExportAll":
            if s.alias:
                self.export(s.alias.name, s.alias.name, s.alias.start, None, s.source, "*")
            self.take(s, [("namespace" if s.alias else "star", None)])
        elif s.kind == "ExportNames":
            for x in s.specifiers:
                self.export(x.alias.name, x.alias.name, x.alias.start, x.name)
        elif s.kind == "ExportDefault":
            v = s.value
            named = v.kind in ("Function", "Class", "Interface") and v.style != "FunctionExpression" and v.id
            local = v.id.name if named else v.name if v.kind == "Ref" else "default"
            self.export("default", v.id.name if named else "default", v.id.start if named else s.start, local)
        elif s.kind == "Export":
            v = s.value
            if v.kind in ("Function", "Class", "TypeAlias", "Interface", "Enum") and v.id:
                self.export(v.id.name, v.id.name, v.id.start, v.id.name)
            elif v.kind == "Variables":
                for d in v.children:
                    if d.target is not None and d.target.kind == "Binding":
                        self.export(d.target.name, d.target.name, d.target.start, d.target.name)

    # Scopes: a name is bound to ('fn', node), ('class', node), ('object', node), ('new', expression),
    # ('import', specifier, name) or ('other',)

    def declare(self, statements: list[Node], scope: Scope) -> None:
        for s in statements:
            if s.kind in ("Export", "ExportDefault") and s.value is not None:
                s = s.value
            if s.kind == "Import":
                for x in s.specifiers:
                    name = {"ImportDefault": "default", "ImportNamespace": "*"}.get(x.kind, x.name)
                    scope.names[x.local or x.alias.name] = ("import", s.source, name)
            elif s.kind == "Function" and s.id and s.style == "FunctionDeclaration":
                # An overload or ambient declaration is what a call resolves to, and it has no body.
                bodiless = s.body is None or scope.names.get(s.id.name, ("",))[0] == "other"
                scope.names[s.id.name] = ("other",) if bodiless else ("fn", s)
            elif s.kind == "Class" and s.id:
                scope.names[s.id.name] = ("class", s)
            elif s.kind == "Variables":
                self.declare_variables(s, scope)
            elif s.kind in ("Enum", "Namespace", "ImportEquals") and s.children and s.children[0].kind == "Binding":
                scope.names.setdefault(s.children[0].name, ("other",))
            if scope.function and s.kind in ("If", "For", "ForOf", "ForIn", "While", "DoWhile", "Try", "Switch", "Labeled", "Catch", "Case", "Block"):
                self.declare_vars(s, scope)

    def declare_variables(self, s: Node, scope: Scope) -> None:
        for d in s.children:
            if d.kind == "Declarator":
                self.bind(d.target, ("other",), scope)
                if d.target.kind == "Binding":
                    scope.names[d.target.name] = self.value_of(d)

    def declare_vars(self, s: Node, scope: Scope) -> None:
        """var declarations below a statement; what else is below has its own scope."""
        for c in s.children:
            if c.kind == "Variables" and self.source.startswith("var", c.start):
                self.declare_variables(c, scope)
            elif c.kind not in FUNCTIONS and c.kind != "Class":
                self.declare_vars(c, scope)

    def bind(self, target: Node, value: tuple, scope: Scope) -> None:
        if target.kind == "Binding":
            scope.names[target.name] = value
        for c in target.children:
            if c.kind in ("Binding", "ObjectPattern", "ArrayPattern", "BindingProperty", "RestElement", "DefaultPattern"):
                self.bind(c, value, scope)

    def value_of(self, d: Node) -> tuple:
        """What a variable or property is bound to by its declared type or initial value."""
        if d.annotation is not None:
            t = d.annotation.type
            return ("typed", t.of.name) if t.kind == "TypeReference" and t.of.kind == "Ref" else ("other",)
        v = bare(d.init) if d.init is not None else None
        if v is None:
            return ("other",)
        if v.kind in FUNCTIONS:
            return ("fn", v) if v.body is not None else ("other",)
        if v.kind == "Class":
            return ("class", v)
        if v.kind == "Object":
            return ("object", v)
        if v.kind == "New":
            return ("new", v)
        if v.kind == "Ref":
            return ("same", v.name)
        return ("other",)

    # Callees

    def callee(self, e: Node, scope: Scope, this: Node | None) -> tuple | None:
        """('fn', node) or ('import', specifier, name, member, made), if the callee is bound to either."""
        e = bare(e)
        if e.kind in FUNCTIONS:
            return ("fn", e) if e.body is not None else None
        if e.kind == "Instantiation":
            return self.callee(e.value, scope, this)
        if e.kind == "Ref":
            return self.called(self.resolved(scope.find(e.name), scope))
        if e.kind != "Member":
            return None
        owner = bare(e.object)
        if owner.kind in ("This", "Super"):
            if this is None:
                return None
            if this.kind == "Object":
                return self.member(("object", this), e.name, False, scope)
            return self.member(("class", this), e.name, owner.kind == "Super", scope, base=owner.kind == "Super")
        if owner.kind == "New":
            return self.member(("new", owner), e.name, True, scope)
        if owner.kind == "Object":
            return self.member(("object", owner), e.name, False, scope)
        if owner.kind == "Ref":
            return self.member(self.resolved(scope.find(owner.name), scope), e.name, False, scope)
        if owner.kind == "Member" and bare(owner.object).kind == "This" and this is not None and this.kind == "Class":
            # A property of this class that is made or typed as a class.
            for m in this.members:
                if m.kind == "PropertyDefinition" and m.key.name == owner.name:
                    return self.member(self.resolved(self.value_of(m), scope), e.name, True, scope)
        return None

    def resolved(self, value: tuple | None, scope: Scope) -> tuple | None:
        """What a name stands for, through any number of names; one that stands for itself stays a name."""
        seen = set()
        while value is not None and value[0] == "same" and value[1] not in seen:
            seen.add(value[1])
            value = scope.find(value[1])
        return value

    def called(self, value: tuple | None) -> tuple | None:
        if value is None:
            return None
        if value[0] == "fn":
            return value
        if value[0] == "import":
            return ("import", value[1], value[2], None, False)
        return None

    def member(self, value: tuple | None, name: str, instance: bool, scope: Scope, base: bool = False, seen: set | None = None) -> tuple | None:
        seen = set() if seen is None else seen
        if value is None or value[0] == "other" or (key := (value[0], value[1] if isinstance(value[1], str) else id(value[1]), base)) in seen:
            return None
        seen.add(key)
        if value[0] == "new":
            c = bare(value[1].callee)
            found = self.resolved(scope.find(c.name), scope) if c.kind == "Ref" else None
            return self.member(found, name, True, scope, seen=seen) if found and found[0] in ("class", "import") else None
        if value[0] == "typed":
            found = scope.find(value[1])
            return self.member(found, name, True, scope, seen=seen) if found and found[0] in ("class", "import") else None
        if value[0] == "import":
            if value[2] == "*" and not instance:
                return ("import", value[1], name, None, False)
            return ("import", value[1], value[2], name, instance)
        if value[0] == "object":
            for m in value[1].members or []:
                if m.kind == "Property" and m.key.name == name:
                    v = bare(m.value)
                    if v.kind in FUNCTIONS:
                        return ("fn", v)
                    return self.called(self.resolved(scope.find(v.name), scope)) if v.kind == "Ref" else None
            return None
        if value[0] == "class":
            if not base:
                found = [m for m in value[1].members if m.kind in ("MethodDefinition", "PropertyDefinition") and m.key.name == name and m.role not in ("get", "set")]
                for m in found[:1]:
                    v = m.value if m.kind == "MethodDefinition" else bare(m.init) if m.init is not None and m.annotation is None else None
                    return ("fn", v) if v is not None and v.kind in FUNCTIONS and v.body is not None else None
            parent = value[1].base
            if parent is not None and bare(parent).kind == "Ref":
                return self.member(self.resolved(scope.find(bare(parent).name), scope), name, True, scope, seen=seen)
        return None

    # Functions, calls, parameters, shapes

    def fn_start(self, node: Node) -> int:
        return node.id.start if node.kind == "Function" and node.id is not None else node.start

    def walk(self, node: Node, scope: Scope, context: Context) -> None:
        if node.kind in FUNCTIONS:
            scope, context = self.function(node, scope, context)
        elif node.kind == "Call":
            self.call(node, scope, context)
        elif node.kind == "ExportDefault":
            context = context.but(default=True)
        elif node.kind == "Class":
            scope, context = Scope(scope), context.but(this=node)
            if node.id is not None:
                scope.names.setdefault(node.id.name, ("class", node))
        elif node.kind == "Object":
            context = context.but(object=node)
        elif node.kind == "Declarator":
            context = context.but(declarator=node.target.name if node.target.kind == "Binding" else context.declarator)
        elif node.kind in ("Block", "For", "ForOf", "ForIn", "Case", "Catch", "StaticBlock") and node is not self.program:
            scope = Scope(scope)
            self.declare(node.children, scope)
            for c in node.children:
                if c.kind == "CatchParameter":
                    self.bind(c.children[0], ("other",), scope)
        for c in node.children:
            self.walk(c, scope, context)

    def function(self, node: Node, scope: Scope, context: Context) -> tuple[Scope, Context]:
        inner = Scope(scope, True)
        if node.id is not None and node.style == "FunctionExpression":
            inner.names[node.id.name] = ("fn", node)
        for p in node.params or []:
            if p.target is not None:
                self.bind(p.target, ("other",), inner)
                if p.target.kind == "Binding" and p.annotation is not None:
                    inner.names[p.target.name] = self.value_of(Node("", 0, 0, [], {"annotation": p.annotation}))
        if node.body is None:
            return inner, context
        body = node.body
        if body.kind == "Body":
            self.declare(body.children, inner)
        start = self.fn_start(node)
        name = node.id.name if node.kind == "Function" and node.id is not None else "default"
        forward = forward_of(body)
        span = self.at(start)
        self.functions.append({"name": name, "line": self.line(start), "span_start": span, "exported": context.default, "ord": len(self.functions), "forward": None if forward is None else {"call_start": self.at(forward[0].start), "return_only": forward[1]}})
        shape_name = name if name != "default" or node.id is not None else context.declarator or "default"
        self.shapes.append({"name": shape_name, "line": self.line(start), "span_start": span, "ast_kinds": kinds_of(body), "tokens": self.tokens_of(body)})
        for p in node.params or []:
            if p.kind == "Parameter" and p.target.kind == "Binding":
                refs, forwards = uses(body, p.target.name)
                self.params.append({"fn_start": span, "name": p.target.name, "span_start": self.at(p.target.start), "line": self.line(p.target.start), "n_refs": refs, "forward_calls": [self.at(f) for f in forwards]})
        this = context.this
        if node.kind == "Function":
            this = context.object if node.style == "ObjectMethod" else context.this if node.style == "Method" else None
        return inner, context.but(enclosing=span, this=this, object=None)

    def call(self, node: Node, scope: Scope, context: Context) -> None:
        # The call that begins where this one does, and lies innermost, is the one whose callee counts.
        chain = [node]
        while id(chain[-1]) not in self.innermost and (lead := leading_call(chain[-1])) is not None:
            chain.append(lead)
        inner = self.innermost.get(id(chain[-1]), chain[-1])
        self.innermost.update((id(c), inner) for c in chain)
        found = self.callee(inner.callee, scope, context.this)
        row = {"call_start": self.at(node.start), "enclosing": context.enclosing, "target": None, "specifier": None, "name": None, "member": None, "ord": len(self.calls)}
        if found is not None:
            row |= {"target": self.at(self.fn_start(found[1]))} if found[0] == "fn" else {"specifier": found[1], "name": found[2], "member": found[3]}
        self.calls.append(row)

    def tokens_of(self, body: Node) -> list[str]:
        first = bisect_right(self.token_starts, body.start - 1)
        out = []
        for t in self.tokens[first:]:
            if t.start >= body.end:
                break
            if t.end <= body.end:
                out.append(normalised(t))
        return out

    def declared(self) -> None:
        """What the file's top-level names are to other files: a function, or an owner of members."""
        scope = self.top
        for s in self.program.children:
            if s.kind == "ExportDefault" and s.value.kind in (*FUNCTIONS, "Class", "Object"):
                v = s.value
                named = v.id is not None and v.style != "FunctionExpression"
                scope.names.setdefault(v.id.name if named else "default", ("fn", v) if v.kind in FUNCTIONS else (v.kind.lower(), v))
        for name, value in scope.names.items():
            value = self.resolved(value, scope)
            if value is None:
                continue
            row = {"name": name, "target": None, "from_specifier": None, "from_name": None, "members": []}
            if value[0] == "fn" and value[1].body is not None:
                row["target"] = self.at(self.fn_start(value[1]))
            elif value[0] == "import":
                row |= {"from_specifier": value[1], "from_name": value[2]}
            elif value[0] in ("class", "object", "new", "typed"):
                for member in self.member_names(value, scope):
                    found = self.member(value, member, True, scope)
                    if found is not None and found[0] == "fn":
                        row["members"].append({"name": member, "target": self.at(self.fn_start(found[1]))})
            self.decls[name] = row

    def member_names(self, value: tuple | None, scope: Scope, seen: set | None = None) -> list[str]:
        seen = set() if seen is None else seen
        if value is None or value[0] == "other" or (key := (value[0], value[1] if isinstance(value[1], str) else id(value[1]))) in seen:
            return []
        seen.add(key)
        if value[0] == "new":
            c = bare(value[1].callee)
            return self.member_names(self.resolved(scope.find(c.name), scope), scope, seen) if c.kind == "Ref" else []
        if value[0] == "typed":
            return self.member_names(scope.find(value[1]), scope, seen)
        if value[0] not in ("class", "object"):
            return []
        own = [m.key.name for m in value[1].members or [] if m.key is not None and m.key.name]
        parent = value[1].base
        more = self.member_names(self.resolved(scope.find(bare(parent).name), scope), scope, seen) if parent is not None and bare(parent).kind == "Ref" else []
        return list(dict.fromkeys([*own, *more]))


@dataclass(frozen=True)
class Context:
    """What surrounds a node: the enclosing function's start, whether a default export, class and object, declared name."""

    enclosing: int | None = None
    default: bool = False
    this: Node | None = None
    object: Node | None = None
    declarator: str | None = None

    def but(self, **changes) -> Context:
        return Context(**{**self.__dict__, **changes})


def bare(e: Node) -> Node:
    """An expression without what only its type sees."""
    while e.kind in ("Paren", "As", "Satisfies", "NonNull", "TypeAssertion"):
        e = e.value
    return e


def leading_call(call: Node) -> Node | None:
    """The outermost call, other than itself, that begins where this call does."""
    e = call.callee
    while e is not None:
        if e.kind == "Call":
            return e
        e = {"Member": e.object, "Element": e.object, "NonNull": e.value, "Instantiation": e.value}.get(e.kind)
        if e is None or e.start != call.start:
            return None
    return None


def forward_of(body: Node) -> tuple[Node, bool] | None:
    """(call, whether returned) where a block is one call alone."""
    if body.kind != "Body" or len(body.children) != 1:
        return None
    only = body.children[0]
    if only.kind == "Return":
        e, returned = only.value, True
    elif only.kind == "ExpressionStatement":
        e, returned = only.children[0], False
    else:
        return None
    while e is not None and e.kind in ("As", "TypeAssertion", "Paren"):
        e = e.value
    return (e, returned) if e is not None and e.kind == "Call" else None


def kinds_of(body: Node) -> list[str]:
    """Node kinds of a body in pre-order; a nested function counts as one node."""
    out: list[str] = []

    def visit(n: Node) -> None:
        out.append(n.kind)
        if n.kind not in FUNCTIONS:
            for c in n.children:
                visit(c)

    for n in body.children if body.kind == "Body" else [body]:
        if not n.directive:
            visit(n)
    return out


def uses(body: Node, name: str) -> tuple[int, list[int]]:
    """How often a body refers to a name, and the starts of the calls that it is an argument of."""
    refs, forwards = 0, []

    def visit(n: Node) -> None:
        nonlocal refs
        if n.kind == "Ref" and n.name == name:
            refs += 1
        if n.kind == "Call":
            for a in n.arguments:
                while a.kind in ("Paren", "As", "TypeAssertion", "NonNull", "Instantiation", "Satisfies"):
                    a = a.value
                if a.kind == "Ref" and a.name == name:
                    forwards.append(n.start)
        for c in n.children:
            visit(c)

    visit(body)
    return refs, forwards
