"""Object types of a file as sorted fields with types in one canonical spelling.

What the spelling does not tell apart is part of its definition: forms it has no rule for are all
`unknown`, parentheses go, members of unions and intersections are sorted and counted once.
"""

from __future__ import annotations

from codefacts.frontend.parser import Node

#: The spelling of a minus sign before a literal.
NEGATIVE = "UnaryNegation"


def type_rows(file) -> list[dict]:
    """Rows of the interfaces and of the aliases of object and intersection types, in source order."""
    out: list[dict] = []

    def visit(n: Node) -> None:
        if n.kind == "Interface":
            out.append(row(n, bool(n.heritage), n.members))
        elif n.kind == "TypeAlias" and n.value.kind == "ObjectType":
            out.append(row(n, False, n.value.members))
        elif n.kind == "TypeAlias" and n.value.kind == "IntersectionType":
            out.append(row(n, True, []))
        for c in n.children:
            visit(c)

    def row(n: Node, extends: bool, members: list[Node]) -> dict:
        names = ("name", "optional", "readonly", "canonical_type")
        fields = [dict(zip(names, f)) for f in fields_of(members)]
        return {"name": n.id.name, "line": file.line(n.id.start), "span_start": file.at(n.id.start), "has_extends": extends, "fields": fields}

    visit(file.program)
    return out


def fields_of(members: list[Node]) -> list[tuple[str, bool, bool, str]]:
    """(name, optional, readonly, type) of the properties and methods, sorted."""
    out = []
    for m in members:
        if m.kind not in ("PropertySignature", "MethodSignature") or m.key.kind == "Computed":
            continue
        if m.kind == "PropertySignature":
            out.append((m.key.name, bool(m.optional), bool(m.readonly), annotated(m.annotation)))
        else:
            out.append((m.key.name, bool(m.optional), False, arrow(m.params, annotated(m.returns))))
    return sorted(out, key=lambda f: (f[0].encode(), f[1], f[2], f[3].encode()))


def annotated(annotation: Node | None) -> str:
    return "any" if annotation is None else spelled(annotation.type)


def arrow(params: list[Node], returns: str) -> str:
    own = []
    for p in params:
        if p.kind == "RestParameter" or p.target.kind == "This":
            continue
        name = p.target.name if p.target.kind == "Binding" else "_"
        own.append(f"{name}{'?' * p.optional}: {annotated(p.annotation)}")
    return f"({', '.join(own)}) => {returns}"


def flat(t: Node, kind: str) -> set[str]:
    if t.kind == "ParenType":
        return flat(t.value, kind)
    return set().union(*(flat(c, kind) for c in t.children)) if t.kind == kind else {spelled(t)}


def entity(n: Node) -> str:
    if n.kind == "Qualified":
        return f"{entity(n.left)}.{n.name}"
    return f'import("{n.of.children[0].value}")' if n.kind == "ImportType" else n.name


def literal(n: Node) -> str:
    if n.kind == "String":
        return f'"{n.value}"'
    if n.kind == "Template":
        return n.children[0].name
    return NEGATIVE if n.kind == "Unary" else n.name


def element(n: Node) -> str:
    if n.kind == "OptionalType":
        return spelled(n.type) + "?"
    if n.kind == "RestType":
        return "..." + element(n.type)
    if n.kind == "NamedMember":
        return f"{n.label}{'?' * n.optional}: {element(n.type)}"
    return spelled(n)


def spelled(t: Node) -> str:
    """The canonical spelling of a type."""
    match t.kind:
        case "KeywordType":
            return t.name if t.name != "intrinsic" else "unknown"
        case "TypeReference":
            args = f"<{', '.join(map(spelled, t.arguments.children))}>" if t.arguments is not None else ""
            return entity(t.of) + args
        case "ArrayType":
            return spelled(t.element) + "[]"
        case "UnionType":
            return " | ".join(sorted(flat(t, "UnionType"), key=str.encode))
        case "IntersectionType":
            return " & ".join(sorted(flat(t, "IntersectionType"), key=str.encode))
        case "ParenType":
            return spelled(t.value)
        case "LiteralType":
            return literal(t.children[0])
        case "ObjectType":
            return "{ " + "; ".join(f"{'readonly ' * f[2]}{f[0]}{'?' * f[1]}: {f[3]}" for f in fields_of(t.members)) + " }"
        case "FunctionType":
            return arrow(t.params, spelled(t.returns))
        case "TupleType":
            return f"[{', '.join(map(element, t.elements))}]"
        case "TypeQuery":
            return f"typeof {entity(t.of)}"
    return "unknown"
