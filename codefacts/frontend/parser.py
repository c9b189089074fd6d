"""A recursive-descent parser for TypeScript, made for facts about programs.

It accepts all of the syntax that programs use, checks little, and goes on behind what it cannot
read. Nodes are kept in source order; a node's kind tells apart binding, reference and property names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

from codefacts.frontend.lexer import RESERVED, Token, template_at, token_at


class SyntaxTrouble(Exception):
    pass


class Node:
    __slots__ = ("kind", "start", "end", "children", "attrs")

    def __init__(self, kind: str, start: int, end: int, children: list, attrs: dict) -> None:
        self.kind, self.start, self.end, self.children, self.attrs = kind, start, end, children, attrs

    def __getattr__(self, name: str):
        return self.attrs.get(name)

    def __repr__(self) -> str:
        return f"{self.kind}({self.attrs.get('name', '')}{self.children})"


#: Binding strength of the binary operators.
BINARY = {"??": 1, "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "===": 6, "!==": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "in": 7, "as": 7, "satisfies": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "**": 11}
ASSIGNMENT = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
MODIFIERS = frozenset("public private protected static abstract override readonly declare async accessor const in out".split())
KEYWORD_TYPES = frozenset("any bigint boolean never null number object string symbol undefined unknown void intrinsic".split())


class Parser:
    def __init__(self, source: str, jsx: bool = False) -> None:
        self.source, self.jsx = source, jsx
        self.tokens: list[Token] = []
        self.errors = 0
        self.no_in = False
        self.failed: set[tuple] = set()
        self.before_arrow: dict[int, bool] = {}
        self.token = token_at(source, 1 + source.find("\n") if source.startswith("#!") else 0, True)

    # Tokens

    def operand_next(self, t: Token) -> bool:
        if t.kind == "punct":
            return t.text not in (")", "]", "}", "++", "--", "!") or t.text == "}"
        if t.kind == "keyword":
            return t.text not in ("this", "super", "null", "true", "false")
        return t.kind == "template" and t.text.endswith("${")

    def advance(self) -> Token:
        t = self.token
        self.tokens.append(t)
        self.token = token_at(self.source, t.end, self.operand_next(t))
        return t

    def state(self):
        return self.token, len(self.tokens), self.errors

    def back(self, state) -> None:
        self.token, n, self.errors = state
        del self.tokens[n:]

    def at(self, *texts: str) -> bool:
        return self.token.text in texts and self.token.kind in ("punct", "keyword", "word")

    def eat(self, *texts: str) -> Token | None:
        return self.advance() if self.at(*texts) else None

    def need(self, text: str) -> Token:
        if not self.at(text):
            raise SyntaxTrouble(f"{text!r} at {self.token.start}, not {self.token.text!r}")
        return self.advance()

    def peek(self) -> Token:
        return token_at(self.source, self.token.end, self.operand_next(self.token))

    def last_end(self) -> int:
        return self.tokens[-1].end if self.tokens else 0

    def close_angle(self) -> None:
        """A closing angle bracket, also the first of a shift or comparison."""
        if self.token.kind == "punct" and self.token.text.startswith(">"):
            t = self.token
            self.tokens.append(Token("punct", ">", t.start, t.start + 1, t.newline))
            self.token = token_at(self.source, t.start + 1, False)
        else:
            raise SyntaxTrouble(f"'>' at {self.token.start}")

    def node(self, kind: str, start: int, children: list | None = None, **attrs) -> Node:
        return Node(kind, start, self.last_end(), [c for c in children or [] if c is not None], attrs)

    def leaf(self, kind: str, **attrs) -> Node:
        t = self.advance()
        return Node(kind, t.start, t.end, [], {"name": t.text, **attrs})

    def attempt(self, parse):
        """What parse returns, or None, everything being as before, where it fails; what failed at a place fails there again."""
        key = (self.token.start, parse.__name__, self.no_in, self.no_conditional)
        if key in self.failed:
            return None
        state = self.state()
        try:
            return parse()
        except (SyntaxTrouble, RecursionError):
            self.back(state)
            self.failed.add(key)
            return None

    def semicolon(self) -> None:
        if self.eat(";") or self.at("}") or self.token.kind == "eof" or self.token.newline:
            return
        raise SyntaxTrouble(f"';' at {self.token.start}")

    def is_word(self) -> bool:
        return self.token.kind == "word"

    # Statements

    def program(self) -> Node:
        return Node("Program", 0, len(self.source), self.statements(""), {})

    def statements(self, close: str) -> list[Node]:
        out = []
        while self.token.kind != "eof" and not (close and self.at(close)):
            before = self.token.start
            state = self.state()
            try:
                out.append(self.statement())
            except (SyntaxTrouble, RecursionError, IndexError):
                self.back(state)
                self.errors += 1
                self.skip()
            if self.token.start == before and self.token.kind != "eof":
                self.advance()
        return out

    def skip(self) -> None:
        """Go behind a statement that can't be read: to a semicolon or a line's end outside brackets."""
        depth = 0
        while self.token.kind != "eof":
            if self.at("{", "(", "["):
                depth += 1
            elif self.at("}", ")", "]"):
                if not depth:
                    return
                depth -= 1
            t = self.advance()
            if not depth and (t.text == ";" or self.token.newline):
                return

    def block(self) -> Node:
        start = self.need("{").start
        body = self.statements("}")
        self.need("}")
        return self.node("Block", start, body)

    def statement(self) -> Node:
        t, text = self.token, self.token.text
        if t.kind == "punct":
            if text == "{":
                return self.block()
            if text == ";":
                self.advance()
                return self.node("Empty", t.start)
            if text == "@":
                found = self.decorators()
                if self.at("export"):
                    out = self.export()
                else:
                    out = self.declaration() or self.class_(True)
                out.children[:0] = found
                return out
        if t.kind == "keyword":
            if text == "import" and self.peek().text not in ("(", "."):
                return self.import_()
            if text == "export":
                return self.export()
            if method := getattr(self, f"s_{text}", None):
                return method()
        if found := self.declaration():
            return found
        if t.kind == "word" and self.peek().text == ":" and self.peek().kind == "punct":
            label = self.leaf("Label")
            self.advance()
            return self.node("Labeled", t.start, [label, self.statement()])
        e = self.expression()
        self.semicolon()
        directive = e.kind == "String" and e.start == t.start
        return self.node("ExpressionStatement", t.start, [e], directive=directive)

    def declaration(self) -> Node | None:
        """A declaration, if one begins here."""
        t, text = self.token, self.token.text
        if t.kind == "keyword":
            if text in ("var", "const"):
                if text == "const" and self.peek().text == "enum":
                    self.advance()
                    return self.enum(t.start)
                return self.variables(True)
            if text == "function":
                return self.function("FunctionDeclaration")
            if text == "class":
                return self.class_(True)
            if text == "enum":
                return self.enum(t.start)
            return None
        if t.kind != "word":
            return None
        n = self.peek()
        same_line_name = not n.newline and (n.kind in ("word", "string") or n.kind == "keyword" and n.text not in ("in", "instanceof"))
        if text in ("let", "using") and (n.kind == "word" or text == "let" and n.text in ("{", "[")) and n.text not in ("in", "of", "instanceof"):
            return self.variables(True)
        if text == "async" and n.text == "function" and not n.newline:
            return self.function("FunctionDeclaration")
        if text == "type" and n.kind == "word" and not n.newline:
            return self.alias()
        if text == "interface" and n.kind == "word" and not n.newline:
            return self.interface()
        if text in ("namespace", "module") and same_line_name and n.kind in ("word", "string"):
            return self.namespace()
        if text == "global" and n.text == "{":
            return self.namespace()
        if text in ("declare", "abstract") and same_line_name:
            start = self.advance().start
            out = self.declaration()
            if out is None:
                raise SyntaxTrouble(f"a declaration at {start}")
            if text == "declare":
                out.attrs["declare"] = True
            return out
        return None

    def variables(self, ends: bool) -> Node:
        start = self.advance().start
        parts = []
        while True:
            s = self.token.start
            target = self.binding()
            self.eat("!")
            annotation = self.annotation()
            init = self.assignment() if self.eat("=") else None
            parts.append(self.node("Declarator", s, [target, annotation, init], target=target, annotation=annotation, init=init))
            if not self.eat(","):
                break
        if ends:
            self.semicolon()
        return self.node("Variables", start, parts)

    def s_if(self) -> Node:
        start = self.advance().start
        self.need("(")
        parts = [self.expression()]
        self.need(")")
        parts.append(self.statement())
        if self.eat("else"):
            parts.append(self.statement())
        return self.node("If", start, parts)

    def s_for(self) -> Node:
        start = self.advance().start
        self.eat("await")
        self.need("(")
        init = None
        self.no_in, before = True, self.no_in
        if not self.at(";"):
            n = self.peek()
            declares = self.at("var", "const") or self.at("let", "using") and (n.kind == "word" and n.text not in ("of", "in") or n.text in ("{", "["))
            init = self.variables(False) if declares else self.expression()
        self.no_in = before
        if self.eat("of"):
            parts, kind = [init, self.assignment()], "ForOf"
        elif self.eat("in"):
            parts, kind = [init, self.expression()], "ForIn"
        else:
            kind, parts = "For", [init]
            self.need(";")
            parts.append(None if self.at(";") else self.expression())
            self.need(";")
            parts.append(None if self.at(")") else self.expression())
        self.need(")")
        return self.node(kind, start, [*parts, self.statement()])

    def s_while(self) -> Node:
        start = self.advance().start
        self.need("(")
        test = self.expression()
        self.need(")")
        return self.node("While", start, [test, self.statement()])

    def s_do(self) -> Node:
        start = self.advance().start
        body = self.statement()
        self.need("while")
        self.need("(")
        test = self.expression()
        self.need(")")
        self.eat(";")
        return self.node("DoWhile", start, [body, test])

    def s_return(self) -> Node:
        start = self.advance().start
        value = None if self.at(";", "}") or self.token.kind == "eof" or self.token.newline else self.expression()
        self.semicolon()
        return self.node("Return", start, [value], value=value)

    def s_throw(self) -> Node:
        start = self.advance().start
        value = self.expression()
        self.semicolon()
        return self.node("Throw", start, [value])

    def s_break(self) -> Node:
        kind = self.token.text.capitalize()
        start = self.advance().start
        label = self.leaf("Label") if self.is_word() and not self.token.newline else None
        self.semicolon()
        return self.node(kind, start, [label])

    s_continue = s_break

    def s_debugger(self) -> Node:
        start = self.advance().start
        self.semicolon()
        return self.node("Debugger", start)

    def s_switch(self) -> Node:
        start = self.advance().start
        self.need("(")
        parts = [self.expression()]
        self.need(")")
        self.need("{")
        while not self.at("}"):
            s = self.token.start
            own = []
            if self.eat("case"):
                own.append(self.expression())
            else:
                self.need("default")
            self.need(":")
            while not self.at("case", "default", "}"):
                own.append(self.statement())
            parts.append(self.node("Case", s, own))
        self.need("}")
        return self.node("Switch", start, parts)

    def s_try(self) -> Node:
        start = self.advance().start
        parts = [self.block()]
        if self.at("catch"):
            s = self.advance().start
            own = []
            if self.eat("("):
                ps = self.token.start
                own.append(self.node("CatchParameter", ps, [self.binding(), self.annotation()]))
                self.need(")")
            own.append(self.block())
            parts.append(self.node("Catch", s, own))
        if self.eat("finally"):
            parts.append(self.block())
        return self.node("Try", start, parts)

    # Modules

    def module_name(self, kind: str) -> Node:
        if self.token.kind == "string":
            t = self.advance()
            return Node(kind, t.start, t.end, [], {"name": unquoted(t.text)})
        if self.token.kind in ("word", "keyword"):
            return self.leaf(kind)
        raise SyntaxTrouble(f"a name at {self.token.start}")

    def source_of(self) -> Node:
        if self.token.kind != "string":
            raise SyntaxTrouble(f"a module at {self.token.start}")
        t = self.advance()
        out = Node("String", t.start, t.end, [], {"value": unquoted(t.text)})
        if self.at("with", "assert") and self.peek().text == "{":
            self.advance()
            self.object()
        return out

    def specifiers(self, kind: str) -> list[Node]:
        """(imported or local, local or exported) names in braces; attrs: name, as_."""
        out = []
        self.need("{")
        while not self.at("}"):
            s = self.token.start
            if self.at("type") and self.peek().text not in (",", "}", "as") or self.at("type") and self.peek().text == "as" and token_at(self.source, self.peek().end, False).text == "as":
                self.advance()
            first = self.module_name("ModuleName")
            second = self.module_name("ModuleName") if self.eat("as") else first
            out.append(self.node(kind, s, [first] if first is second else [first, second], name=first.name, alias=second))
            if not self.eat(","):
                break
        self.need("}")
        return out

    def import_(self) -> Node:
        start = self.advance().start
        if self.token.kind == "string":
            source = self.source_of()
            self.semicolon()
            return self.node("Import", start, [source], source=source.value, specifiers=[])
        n = self.peek()
        if self.at("type") and (n.text in ("{", "*") or n.kind == "word" and (n.text != "from" or token_at(self.source, n.end, False).text == "from")):
            self.advance()
        found = []
        if self.is_word():
            s = self.token.start
            local = self.leaf("Binding")
            if self.at("="):
                self.advance()
                value = self.expression()
                self.semicolon()
                return self.node("ImportEquals", start, [local, value])
            found.append(self.node("ImportDefault", s, [local], local=local.name))
            self.eat(",")
        if self.at("*"):
            s = self.advance().start
            self.need("as")
            local = self.leaf("Binding")
            found.append(self.node("ImportNamespace", s, [local], local=local.name))
        elif self.at("{"):
            found += self.specifiers("ImportName")
        self.need("from")
        source = self.source_of()
        self.semicolon()
        return self.node("Import", start, [*found, source], source=source.value, specifiers=found)

    def export(self) -> Node:
        start = self.advance().start
        if self.eat("default"):
            if self.at("function") or self.at("async") and self.peek().text == "function":
                value = self.function("FunctionDeclaration")
            elif self.at("class", "@") or self.at("abstract") and self.peek().text == "class":
                found = self.decorators()
                self.eat("abstract")
                value = self.class_(True)
                value.children[:0] = found
            elif self.at("interface") and self.peek().kind == "word":
                value = self.interface()
            else:
                value = self.assignment()
                self.semicolon()
            return self.node("ExportDefault", start, [value], value=value)
        if self.at("*"):
            self.advance()
            alias = self.module_name("ModuleName") if self.eat("as") else None
            self.need("from")
            source = self.source_of()
            self.semicolon()
            return self.node("ExportAll", start, [alias, source], source=source.value, alias=alias)
        if self.at("type") and self.peek().text in ("{", "*"):
            self.advance()
            if self.at("*"):
                self.advance()
                alias = self.module_name("ModuleName") if self.eat("as") else None
                self.need("from")
                source = self.source_of()
                self.semicolon()
                return self.node("ExportAll", start, [alias, source], source=source.value, alias=alias)
        if self.at("{"):
            found = self.specifiers("ExportName")
            if self.eat("from"):
                source = self.source_of()
                self.semicolon()
                return self.node("ExportFrom", start, [*found, source], source=source.value, specifiers=found)
            self.semicolon()
            return self.node("ExportNames", start, found, specifiers=found)
        if self.at("="):
            self.advance()
            value = self.expression()
            self.semicolon()
            return self.node("ExportAssign", start, [value])
        if self.at("as"):
            self.skip()
            return self.node("ExportAsNamespace", start)
        if self.at("import"):
            value = self.import_()
            return self.node("Export", start, [value], value=value)
        found = self.decorators()
        value = self.declaration()
        if value is None:
            raise SyntaxTrouble(f"a declaration at {self.token.start}")
        value.children[:0] = found
        return self.node("Export", start, [value], value=value)

    # Functions, classes and other declarations

    def decorators(self) -> list[Node]:
        out = []
        while self.at("@"):
            s = self.advance().start
            out.append(self.node("Decorator", s, [self.postfix()]))
        return out

    def function(self, kind: str) -> Node:
        start = self.token.start
        self.eat("async")
        self.need("function")
        self.eat("*")
        name = self.leaf("Binding") if self.is_word() else None
        return self.rest_of_function(kind, start, name)

    def rest_of_function(self, kind: str, start: int, name: Node | None) -> Node:
        generics = self.type_parameters()
        params = self.parameters()
        returns = self.annotation()
        body = None
        if self.at("{"):
            body = self.function_body()
        elif kind in ("FunctionDeclaration", "Method"):
            self.semicolon()
        return self.node("Function", start, [name, generics, *params, returns, body], style=kind, id=name, params=params, body=body)

    def function_body(self) -> Node:
        before, self.no_in = self.no_in, False
        block = self.block()
        self.no_in = before
        block.kind = "Body"
        return block

    def parameters(self) -> list[Node]:
        out = []
        self.need("(")
        while not self.at(")"):
            s = self.token.start
            found = self.decorators()
            while self.token.text in ("public", "private", "protected", "readonly", "override") and self.peek().kind in ("word", "keyword", "punct") and self.peek().text not in (",", ")", ":", "=", "?", "."):
                self.advance()
            rest = bool(self.eat("..."))
            target = self.leaf("This") if self.at("this") else self.binding()
            optional = bool(self.eat("?"))
            annotation = self.annotation()
            init = self.assignment() if self.eat("=") else None
            out.append(self.node("RestParameter" if rest else "Parameter", s, [*found, target, annotation, init], target=target, optional=optional, annotation=annotation))
            if not self.eat(","):
                break
        self.need(")")
        return out

    def class_(self, declared: bool) -> Node:
        start = self.need("class").start
        name = self.leaf("Binding") if self.is_word() and not (self.at("implements") and not declared) else None
        generics = self.type_parameters()
        heritage, base = [], None
        while self.at("extends", "implements"):
            if self.advance().text == "extends":
                base = self.postfix(no_object=True)
                heritage.append(base)
                if self.at("<"):
                    heritage.append(self.type_arguments())
            else:
                while True:
                    heritage.append(self.node("Implements", self.token.start, [self.type_reference()]))
                    if not self.eat(","):
                        break
        s = self.need("{").start
        members = []
        while not self.at("}"):
            if not self.eat(";"):
                members.append(self.class_member())
        self.need("}")
        body = self.node("ClassBody", s, members)
        return self.node("Class", start, [name, generics, *heritage, body], id=name, members=members, base=base)

    def class_member(self) -> Node:
        start = self.token.start
        found, static = self.decorators(), False
        if self.at("static") and self.peek().text == "{":
            self.advance()
            return self.node("StaticBlock", start, [self.block()])
        while self.token.text in MODIFIERS and self.peek().text not in ("(", "=", ";", ":", "?", "!", "}", "<", ",") and not (self.peek().newline and self.at("async", "declare", "accessor")):
            static |= self.advance().text == "static"
        star = self.eat("*")
        kind = "method"
        if not star and self.at("get", "set") and self.peek().text not in ("(", "=", ";", ":", "?", "!", "}", "<", ","):
            kind = self.advance().text
        if self.at("[") and (sig := self.attempt(self.index_signature)):
            return self.node("IndexSignature", start, [sig])
        key = self.property_key()
        self.eat("?")
        self.eat("!")
        if self.at("(", "<"):
            value = self.rest_of_function("Method", self.token.start, None)
            return self.node("MethodDefinition", start, [*found, key, value], key=key, value=value, static=static, role=kind)
        annotation = self.annotation()
        init = self.assignment() if self.eat("=") else None
        self.semicolon()
        return self.node("PropertyDefinition", start, [*found, key, annotation, init], key=key, init=init, annotation=annotation, static=static)

    def index_signature(self) -> Node:
        start = self.need("[").start
        name = self.leaf("Binding")
        annotation = self.annotation()
        if annotation is None:
            raise SyntaxTrouble("not an index signature")
        self.need("]")
        return self.node("Index", start, [name, annotation, self.annotation()])

    def property_key(self) -> Node:
        t = self.token
        if t.kind in ("word", "keyword"):
            return self.leaf("Name")
        if t.kind == "private":
            return self.leaf("PrivateName", name=t.text[1:])
        if t.kind == "string":
            self.advance()
            return Node("String", t.start, t.end, [], {"name": unquoted(t.text), "value": unquoted(t.text)})
        if t.kind == "number":
            return self.leaf("Number")
        if t.text == "[":
            self.advance()
            e = self.assignment()
            self.need("]")
            return self.node("Computed", t.start, [e])
        raise SyntaxTrouble(f"a property at {t.start}")

    def enum(self, start: int) -> Node:
        self.need("enum")
        name = self.leaf("Binding")
        self.need("{")
        members = []
        while not self.at("}"):
            s = self.token.start
            key = self.property_key()
            members.append(self.node("EnumMember", s, [key, self.assignment() if self.eat("=") else None]))
            if not self.eat(","):
                break
        self.need("}")
        return self.node("Enum", start, [name, *members], id=name)

    def namespace(self) -> Node:
        start = self.advance().start
        name = None
        if self.token.kind == "string":
            name = self.source_of()
        elif self.is_word():
            name = self.leaf("Binding")
            while self.eat("."):
                self.leaf("Name")
        body = []
        if self.at("{"):
            body = [self.block()]
        else:
            self.semicolon()
        return self.node("Namespace", start, [name, *body])

    def interface(self) -> Node:
        start = self.advance().start
        name = self.leaf("Binding")
        generics = self.type_parameters()
        heritage = []
        if self.eat("extends"):
            while True:
                heritage.append(self.node("Extends", self.token.start, [self.type_reference()]))
                if not self.eat(","):
                    break
        s = self.token.start
        members = self.type_members()
        body = self.node("InterfaceBody", s, members)
        return self.node("Interface", start, [name, generics, *heritage, body], id=name, heritage=heritage, members=members)

    def alias(self) -> Node:
        start = self.advance().start
        name = self.leaf("Binding")
        generics = self.type_parameters()
        self.need("=")
        value = self.type()
        self.semicolon()
        return self.node("TypeAlias", start, [name, generics, value], id=name, value=value)

    # Patterns

    def binding(self) -> Node:
        t = self.token
        if t.text == "{" and t.kind == "punct":
            self.advance()
            parts = []
            while not self.at("}"):
                s = self.token.start
                if self.eat("..."):
                    parts.append(self.node("RestElement", s, [self.binding()]))
                else:
                    key = self.property_key()
                    if self.eat(":"):
                        value = self.default(self.binding())
                    else:
                        value = self.default(Node("Binding", key.start, key.end, [], dict(key.attrs)))
                    parts.append(self.node("BindingProperty", s, [key, value]))
                if not self.eat(","):
                    break
            self.need("}")
            return self.node("ObjectPattern", t.start, parts)
        if t.text == "[" and t.kind == "punct":
            self.advance()
            parts = []
            while not self.at("]"):
                if self.eat(","):
                    continue
                s = self.token.start
                parts.append(self.node("RestElement", s, [self.binding()]) if self.eat("...") else self.default(self.binding()))
                if not self.at("]"):
                    self.need(",")
            self.need("]")
            return self.node("ArrayPattern", t.start, parts)
        if t.kind == "word":
            return self.leaf("Binding")
        raise SyntaxTrouble(f"a binding at {t.start}")

    def default(self, target: Node) -> Node:
        if self.eat("="):
            return self.node("DefaultPattern", target.start, [target, self.assignment()])
        return target

    # Expressions

    def expression(self) -> Node:
        first = self.assignment()
        if not self.at(","):
            return first
        parts = [first]
        while self.eat(","):
            parts.append(self.assignment())
        return self.node("Sequence", first.start, parts)

    def assignment(self) -> Node:
        t = self.token
        if arrow := self.arrow():
            return arrow
        if t.text == "yield" and t.kind == "word" and self.peek().text not in ("=>", "=", ".", ")", ","):
            self.advance()
            star = self.eat("*")
            ends = self.at(")", "]", "}", ",", ";", ":") or self.token.newline and not star or self.token.kind == "eof"
            return self.node("Yield", t.start, [None if ends else self.assignment()])
        left = self.conditional()
        if self.token.kind == "punct" and self.token.text in ASSIGNMENT:
            op = self.advance().text
            return self.node("Assignment", left.start, [left, self.assignment()], op=op)
        return left

    def arrow(self) -> Node | None:
        """An arrow function, if one begins here."""
        t, n = self.token, None
        if t.kind == "word":
            n = self.peek()
            if n.text == "=>" and not n.newline:
                start = t.start
                param = self.node("Parameter", start, [self.leaf("Binding")])
                param.attrs["target"] = param.children[0]
                return self.arrow_body(start, [], [param], None)
            if t.text != "async" or n.newline or n.text not in ("(", "<") and n.kind != "word":
                return None
        elif t.text not in ("(", "<") or t.kind != "punct":
            return None
        if t.text == "(" and not self.may_be_arrow(t.start):
            return None
        if n is not None and n.text == "(" and not self.may_be_arrow(n.start):
            return None
        return self.attempt(self.full_arrow)

    def may_be_arrow(self, start: int) -> bool:
        """Whether an arrow or a colon follows the bracket that closes the one at a place."""
        if start in self.before_arrow:
            return self.before_arrow[start]
        # The brackets inside are answered on the way.
        open_, pos, t = [], start, None
        while True:
            t = token_at(self.source, pos, t is None or self.operand_next(t))
            if t.kind == "eof":
                self.before_arrow.update((p, False) for p in open_)
                return False
            if t.kind == "template" and t.text.endswith("${"):
                pos = self.behind_template(t)
                continue
            if t.kind == "punct" and t.text in ("(", "[", "{"):
                open_.append(t.start)
            elif t.kind == "punct" and t.text in (")", "]", "}"):
                self.before_arrow[open_.pop()] = token_at(self.source, t.end, False).text in ("=>", ":", "{")
                if not open_:
                    return self.before_arrow[start]
            pos = t.end

    def behind_template(self, t: Token) -> int:
        depth, pos = 0, t.end
        while True:
            x = token_at(self.source, pos, True)
            if x.kind == "eof":
                return pos
            if x.kind == "template" and x.text.endswith("${"):
                pos = self.behind_template(x)
                continue
            if x.text == "}" and not depth:
                piece = template_at(self.source, x.start)
                if not piece.text.endswith("${"):
                    return piece.end
                pos = piece.end
                continue
            depth += (x.text == "{") - (x.text == "}") if x.kind == "punct" else 0
            pos = x.end

    def full_arrow(self) -> Node:
        start = self.token.start
        if self.at("async") and self.peek().text != "=>":
            self.advance()
        if self.is_word():
            s = self.token.start
            target = self.leaf("Binding")
            return self.arrow_body(start, [], [Node("Parameter", s, target.end, [target], {"target": target})], None)
        generics = self.type_parameters()
        params = self.parameters()
        returns = self.annotation()
        if self.token.newline or not self.at("=>"):
            raise SyntaxTrouble(f"'=>' at {self.token.start}")
        return self.arrow_body(start, [generics], params, returns)

    def arrow_body(self, start: int, generics: list, params: list[Node], returns: Node | None) -> Node:
        self.need("=>")
        if self.at("{"):
            body = self.function_body()
        else:
            body = self.assignment()
        return self.node("Arrow", start, [*generics, *params, returns, body], params=params, body=body)

    def conditional(self) -> Node:
        test = self.binary(0)
        if self.at("?") and self.token.kind == "punct":
            self.advance()
            before, self.no_in = self.no_in, False
            yes = self.assignment()
            self.no_in = before
            self.need(":")
            return self.node("Conditional", test.start, [test, yes, self.assignment()])
        return test

    def binary(self, least: int) -> Node:
        left = self.unary()
        while True:
            t = self.token
            power = BINARY.get(t.text) if t.kind in ("punct", "keyword", "word") else None
            if not power or power <= least or t.text == "in" and self.no_in or t.text in ("as", "satisfies") and t.newline:
                return left
            if t.text in ("as", "satisfies"):
                self.advance()
                own = self.leaf("ConstType") if self.at("const") else self.type()
                left = self.node("As" if t.text == "as" else "Satisfies", left.start, [left, own], value=left, type=own)
                continue
            self.advance()
            right = self.binary(power - (t.text == "**"))
            left = self.node("Logical" if t.text in ("&&", "||", "??") else "Binary", left.start, [left, right], op=t.text)

    def unary(self) -> Node:
        t = self.token
        if t.kind == "punct" and t.text in ("!", "~", "+", "-") or t.kind == "keyword" and t.text in ("typeof", "void", "delete"):
            self.advance()
            return self.node("Unary", t.start, [self.unary()], op=t.text)
        if t.kind == "punct" and t.text in ("++", "--"):
            self.advance()
            return self.node("Update", t.start, [self.unary()])
        if t.text == "await" and t.kind == "word" and not (n := self.peek()).newline and (n.kind in ("word", "string", "number", "template", "private") or n.kind == "keyword" and n.text not in ("in", "instanceof") or n.text in ("(", "[", "{", "!", "-", "+", "<")):
            self.advance()
            return self.node("Await", t.start, [self.unary()])
        if t.text == "<" and t.kind == "punct":
            if self.jsx:
                return self.postfix_of(self.jsx_element())
            self.advance()
            own = self.const_or_type()
            self.close_angle()
            value = self.unary()
            return self.node("TypeAssertion", t.start, [own, value], value=value)
        e = self.postfix()
        if self.at("++", "--") and not self.token.newline:
            self.advance()
            return self.node("Update", e.start, [e])
        return e

    def const_or_type(self) -> Node:
        return self.leaf("ConstType") if self.at("const") else self.type()

    def postfix(self, no_object: bool = False) -> Node:
        return self.postfix_of(self.primary(), no_object=no_object)

    def postfix_of(self, e: Node, calls: bool = True, no_object: bool = False) -> Node:
        while True:
            t = self.token
            if t.kind == "template":
                e = self.node("TaggedTemplate", e.start, [e, self.template()])
                continue
            if t.kind != "punct":
                return e
            if t.text == ".":
                self.advance()
                if self.token.kind not in ("word", "keyword", "private"):
                    raise SyntaxTrouble(f"a name at {self.token.start}")
                name = self.leaf("PrivateName" if self.token.kind == "private" else "Name")
                e = self.node("Member", e.start, [e, name], object=e, name=name.name)
            elif t.text == "?." and calls:
                self.advance()
                if self.at("("):
                    e = self.call(e)
                elif self.at("["):
                    e = self.element(e)
                else:
                    name = self.leaf("Name")
                    e = self.node("Member", e.start, [e, name], object=e, name=name.name)
            elif t.text == "[":
                e = self.element(e)
            elif t.text == "!" and not t.newline:
                self.advance()
                e = self.node("NonNull", e.start, [e], value=e)
            elif t.text == "(" and calls:
                e = self.call(e)
            elif t.text in ("<", "<<") and (found := self.attempt(self.call_type_arguments)):
                if self.at("(") and calls:
                    e = self.call(e, found)
                elif self.token.kind == "template":
                    e = self.node("TaggedTemplate", e.start, [e, found, self.template()])
                elif not calls:
                    e = self.node("Instantiation", e.start, [e, found], value=e, arguments_=found)
                    return e
                else:
                    e = self.node("Instantiation", e.start, [e, found], value=e)
            else:
                return e

    def call_type_arguments(self) -> Node:
        found = self.type_arguments()
        if not (self.token.kind == "template" or self.token.text in ("(", ")", "]", ":", ";", ",", ".", "?.", "==", "===", "!=", "!==", "&&", "||", "??", "|", "&", "^", "}", "{", "extends", "implements") or self.token.kind == "eof" or self.token.newline):
            raise SyntaxTrouble("not type arguments")
        return found

    def arguments(self) -> list[Node]:
        out = []
        self.need("(")
        before, self.no_in = self.no_in, False
        while not self.at(")"):
            s = self.token.start
            out.append(self.node("Spread", s, [self.assignment()]) if self.eat("...") else self.assignment())
            if not self.eat(","):
                break
        self.no_in = before
        self.need(")")
        return out

    def call(self, callee: Node, generics: Node | None = None) -> Node:
        args = self.arguments()
        return self.node("Call", callee.start, [callee, generics, *args], callee=callee, arguments=args)

    def element(self, e: Node) -> Node:
        self.need("[")
        before, self.no_in = self.no_in, False
        index = self.expression()
        self.no_in = before
        self.need("]")
        return self.node("Element", e.start, [e, index], object=e)

    def primary(self) -> Node:
        t = self.token
        if t.kind == "number":
            return self.leaf("BigInt" if t.text.endswith("n") and not t.text.startswith("0x") else "Number")
        if t.kind == "string":
            self.advance()
            return Node("String", t.start, t.end, [], {"value": unquoted(t.text)})
        if t.kind == "regex":
            return self.leaf("Regex")
        if t.kind == "template":
            return self.template()
        if t.kind == "private":
            return self.leaf("PrivateName")
        if t.kind == "keyword":
            if t.text in ("true", "false"):
                return self.leaf("Boolean")
            if t.text in ("null", "this", "super"):
                return self.leaf(t.text.capitalize())
            if t.text == "function":
                return self.function("FunctionExpression")
            if t.text == "class":
                return self.class_(False)
            if t.text == "new":
                return self.new()
            if t.text == "import":
                self.advance()
                if self.eat("."):
                    return self.node("MetaProperty", t.start, [self.leaf("Name")])
                args = self.arguments()
                return self.node("ImportCall", t.start, args)
            raise SyntaxTrouble(f"an expression at {t.start}")
        if t.kind == "word":
            if t.text == "async" and self.peek().text == "function" and not self.peek().newline:
                return self.function("FunctionExpression")
            return self.leaf("Ref")
        if t.text == "(":
            self.advance()
            before, self.no_in = self.no_in, False
            value = self.expression()
            self.no_in = before
            self.need(")")
            return self.node("Paren", t.start, [value], value=value)
        if t.text == "[":
            return self.array()
        if t.text == "{":
            return self.object()
        if t.text == "@":
            found = self.decorators()
            out = self.class_(False)
            out.children[:0] = found
            return out
        if t.text in ("/", "/="):
            again = token_at(self.source, t.start, True)
            if again.kind == "regex":
                self.token = again
                return self.leaf("Regex")
        raise SyntaxTrouble(f"an expression at {t.start}: {t.text!r}")

    def new(self) -> Node:
        start = self.advance().start
        if self.eat("."):
            return self.node("MetaProperty", start, [self.leaf("Name")])
        callee = self.new() if self.at("new") else self.postfix_of(self.primary(), calls=False)
        generics = None
        if callee.kind == "Instantiation":
            callee, generics = callee.value, callee.arguments_
        args = self.arguments() if self.at("(") else []
        return self.node("New", start, [callee, generics, *args], callee=callee)

    def template(self) -> Node:
        start, parts = self.token.start, []
        piece = self.advance_template()
        parts.append(piece)
        while piece.name.endswith("${"):
            parts.append(self.expression())
            if not self.at("}"):
                raise SyntaxTrouble(f"'}}' at {self.token.start}")
            self.token = template_at(self.source, self.token.start)
            piece = self.advance_template()
            parts.append(piece)
        return self.node("Template", start, parts)

    def advance_template(self) -> Node:
        t = self.advance()
        return Node("TemplateElement", t.start, t.end, [], {"name": t.text})

    def array(self) -> Node:
        start, parts = self.need("[").start, []
        before, self.no_in = self.no_in, False
        while not self.at("]"):
            s = self.token.start
            if self.at(","):
                self.advance()
                parts.append(self.node("Elision", s))
                continue
            parts.append(self.node("Spread", s, [self.assignment()]) if self.eat("...") else self.assignment())
            if not self.at("]"):
                self.need(",")
        self.no_in = before
        self.need("]")
        return self.node("Array", start, parts)

    def object(self) -> Node:
        start, parts = self.need("{").start, []
        before, self.no_in = self.no_in, False
        while not self.at("}"):
            parts.append(self.object_member())
            if not self.eat(","):
                break
        self.no_in = before
        self.need("}")
        return self.node("Object", start, parts, members=parts)

    def object_member(self) -> Node:
        s = self.token.start
        if self.eat("..."):
            return self.node("Spread", s, [self.assignment()])
        ends = ("(", ",", "}", ":", "=", "<")
        if self.at("async") and self.peek().text not in ends and not self.peek().newline:
            self.advance()
        self.eat("*")
        if self.at("get", "set") and self.peek().text not in ends:
            self.advance()
        word = self.token
        key = self.property_key()
        if self.at("(", "<"):
            value = self.rest_of_function("ObjectMethod", self.token.start, None)
        elif self.eat(":"):
            value = self.assignment()
        elif word.kind == "word":
            value = Node("Ref", key.start, key.end, [], {"name": key.name})
            if self.eat("="):
                value = self.node("DefaultPattern", s, [value, self.assignment()])
        else:
            raise SyntaxTrouble(f"a member at {self.token.start}")
        return self.node("Property", s, [key, value], key=key, value=value)

    # JSX

    def jsx_element(self) -> Node:
        start = self.need("<").start
        parts = []
        if not self.at(">"):
            parts.append(self.jsx_name())
            if self.at("<"):
                parts.append(self.type_arguments())
            while not self.at(">", "/"):
                parts.append(self.jsx_attribute())
        if self.eat("/"):
            self.need(">")
            return self.node("JsxElement", start, parts)
        if not self.at(">"):
            raise SyntaxTrouble(f"'>' at {self.token.start}")
        self.jsx_text()
        while True:
            if self.token.kind == "text":
                parts.append(self.leaf_raw("JsxText"))
            elif self.at("{"):
                parts.append(self.jsx_container())
            elif self.at("<") and self.source.startswith("/", self.token.end):
                # Not a regular expression.
                self.tokens += [self.token, Token("punct", "/", self.token.end, self.token.end + 1, False)]
                self.token = token_at(self.source, self.token.end + 1, False)
                if not self.at(">"):
                    parts.append(self.jsx_name())
                self.need(">")
                return self.node("JsxElement", start, parts)
            elif self.at("<"):
                parts.append(self.jsx_element())
                self.jsx_again()
            else:
                raise SyntaxTrouble(f"an element's end at {self.token.start}")

    def leaf_raw(self, kind: str) -> Node:
        t = self.token
        self.tokens.append(t)
        self.token = token_at(self.source, t.end, True)
        return Node(kind, t.start, t.end, [], {"name": t.text})

    def jsx_text(self) -> None:
        """Behind a bracket that opens or closes children: raw text up to the next bracket."""
        t = self.token
        self.tokens.append(t)
        self.text_from(t.end)

    def jsx_again(self) -> None:
        self.text_from(self.last_end())

    def text_from(self, start: int) -> None:
        end = start
        while end < len(self.source) and self.source[end] not in "<{":
            end += 1
        self.token = Token("text", self.source[start:end], start, end, False) if self.source[start:end].strip() else token_at(self.source, end, True)

    def jsx_container(self) -> Node:
        start = self.need("{").start
        value = None
        if self.eat("..."):
            value = self.assignment()
        elif not self.at("}"):
            value = self.expression()
        if not self.at("}"):
            raise SyntaxTrouble(f"'}}' at {self.token.start}")
        self.jsx_text()
        return self.node("JsxContainer", start, [value])

    def jsx_name(self) -> Node:
        t = self.token
        end = t.end
        while end < len(self.source) and (self.source[end].isalnum() or self.source[end] in "-_$:"):
            end += 1
        if t.kind not in ("word", "keyword"):
            raise SyntaxTrouble(f"an element's name at {t.start}")
        text = self.source[t.start : end]
        self.tokens.append(Token("word", text, t.start, end, t.newline))
        self.token = token_at(self.source, end, False)
        kind = "Ref" if text[:1].isupper() or self.at(".") else "JsxName"
        name = Node(kind, t.start, end, [], {"name": text})
        while self.eat("."):
            name = self.node("JsxMember", t.start, [name, self.leaf("Name")])
        return name

    def jsx_attribute(self) -> Node:
        s = self.token.start
        if self.eat("{"):
            self.need("...")
            value = self.assignment()
            self.need("}")
            return self.node("JsxSpread", s, [value])
        key = self.jsx_name()
        key.kind = "JsxName"
        value = None
        if self.at("="):
            self.tokens.append(self.token)
            start = self.token.end
            t = token_at(self.source, start, True)
            if t.kind == "punct" and t.text == "{":
                self.token = t
                self.advance()
                inner = self.assignment() if not self.at("}") else None
                self.need("}")
                value = self.node("JsxContainer", t.start, [inner])
            elif self.source[t.start : t.start + 1] in ("'", '"'):
                end = self.source.find(self.source[t.start], t.start + 1) + 1 or len(self.source)
                self.tokens.append(Token("string", self.source[t.start : end], t.start, end, False))
                self.token = token_at(self.source, end, False)
                value = Node("String", t.start, end, [], {"value": self.source[t.start + 1 : end - 1]})
            else:
                self.token = t
                value = self.jsx_element()
        return self.node("JsxAttribute", s, [key, value])

    # Types

    def annotation(self) -> Node | None:
        if not self.at(":") or self.token.kind != "punct":
            return None
        start = self.advance().start
        value = self.return_type()
        return self.node("Annotation", start, [value], type=value)

    def return_type(self) -> Node:
        """A type, or a predicate as a function returns it."""
        s = self.token.start
        if self.at("asserts") and self.peek().kind in ("word", "keyword") and not self.peek().newline and self.peek().text != "is":
            self.advance()
            target = self.leaf("Ref")
            return self.node("Predicate", s, [target, self.type() if self.eat("is") else None])
        if (self.is_word() or self.at("this")) and self.peek().text == "is" and not self.peek().newline:
            target = self.leaf("Ref")
            self.advance()
            return self.node("Predicate", s, [target, self.type()])
        return self.type()

    def type_parameters(self) -> Node | None:
        if not self.at("<"):
            return None
        start, parts = self.advance().start, []
        while not self.at(">"):
            s = self.token.start
            while self.at("const", "in", "out") and self.peek().kind in ("word", "keyword") and self.peek().text != "extends":
                self.advance()
            name = self.leaf("Binding")
            limit = self.type() if self.eat("extends") else None
            parts.append(self.node("TypeParameter", s, [name, limit, self.type() if self.eat("=") else None]))
            if not self.eat(","):
                break
        self.close_angle()
        return self.node("TypeParameters", start, parts)

    def type_arguments(self) -> Node:
        start = self.need("<").start
        parts = []
        while not self.token.text.startswith(">"):
            parts.append(self.type())
            if not self.eat(","):
                break
        self.close_angle()
        return self.node("TypeArguments", start, parts)

    def type(self) -> Node:
        start = self.token.start
        if self.at("<") or self.at("(") and self.may_be_arrow(start) or self.at("new") or self.at("abstract") and self.peek().text == "new":
            if found := self.attempt(self.function_type):
                return found
        out = self.union()
        if self.at("extends") and not self.token.newline and not self.no_conditional:
            self.advance()
            self.no_conditional = True
            limit = self.union()
            self.no_conditional = False
            if self.eat("?"):
                yes = self.type()
                self.need(":")
                return self.node("ConditionalType", start, [out, limit, yes, self.type()])
        return out

    no_conditional = False

    def function_type(self) -> Node:
        start = self.token.start
        self.eat("abstract")
        builds = bool(self.eat("new"))
        generics = self.type_parameters()
        params = self.parameters()
        s = self.need("=>").start
        before, self.no_conditional = self.no_conditional, False
        value = self.return_type()
        self.no_conditional = before
        returns = self.node("Annotation", s, [value], type=value)
        return self.node("ConstructorType" if builds else "FunctionType", start, [generics, *params, returns], params=params, returns=value)

    def union(self) -> Node:
        start = self.token.start
        self.eat("|")
        parts = [self.intersection()]
        while self.eat("|"):
            parts.append(self.intersection())
        return parts[0] if len(parts) == 1 else self.node("UnionType", start, parts)

    def intersection(self) -> Node:
        start = self.token.start
        self.eat("&")
        parts = [self.type_operator()]
        while self.eat("&"):
            parts.append(self.type_operator())
        return parts[0] if len(parts) == 1 else self.node("IntersectionType", start, parts)

    def type_operator(self) -> Node:
        t = self.token
        if self.at("keyof", "unique", "readonly") and self.peek().text not in (",", ")", ">", ";", "]", "|", "&", "=", "}", "["):
            self.advance()
            return self.node("TypeOperator", t.start, [self.type_operator()])
        if self.at("keyof", "readonly") and self.peek().text == "[":
            self.advance()
            return self.node("TypeOperator", t.start, [self.type_operator()])
        if self.at("infer") and self.peek().kind == "word":
            self.advance()
            name = self.leaf("Binding")
            limit = None
            if self.at("extends"):
                limit = self.attempt(self.infer_limit)
            return self.node("InferType", t.start, [name, limit])
        return self.postfix_type()

    def infer_limit(self) -> Node:
        self.need("extends")
        before, self.no_conditional = self.no_conditional, True
        limit = self.type()
        self.no_conditional = before
        if self.at("?"):
            raise SyntaxTrouble("a conditional type")
        return limit

    def postfix_type(self) -> Node:
        out = self.primary_type()
        while self.at("[") and not self.token.newline:
            self.advance()
            if self.eat("]"):
                out = self.node("ArrayType", out.start, [out], element=out)
            else:
                index = self.type()
                self.need("]")
                out = self.node("IndexedType", out.start, [out, index])
        return out

    def primary_type(self) -> Node:
        t = self.token
        if t.kind == "punct":
            if t.text == "(":
                self.advance()
                before, self.no_conditional = self.no_conditional, False
                value = self.type()
                self.no_conditional = before
                self.need(")")
                return self.node("ParenType", t.start, [value], value=value)
            if t.text == "[":
                return self.tuple_type()
            if t.text == "{":
                return self.object_type()
            if t.text == "-":
                self.advance()
                return self.node("LiteralType", t.start, [self.node("Unary", t.start, [self.primary()], op="-")])
        if t.kind in ("string", "number"):
            return self.node("LiteralType", t.start, [self.primary()])
        if t.kind == "template":
            return self.template_type()
        if t.kind == "keyword":
            if t.text in ("true", "false"):
                return self.node("LiteralType", t.start, [self.primary()])
            if t.text in ("null", "void"):
                return self.leaf("KeywordType")
            if t.text == "this":
                return self.leaf("ThisType")
            if t.text == "typeof":
                self.advance()
                name = self.import_type() if self.at("import") else self.entity()
                return self.node("TypeQuery", t.start, [name, self.type_arguments() if self.at("<") and not self.token.newline else None], of=name)
            if t.text == "import":
                return self.import_type()
        if t.kind == "word" or t.kind == "keyword" and t.text not in RESERVED - {"this"}:
            if t.text in KEYWORD_TYPES and self.peek().text != ".":
                return self.leaf("KeywordType")
            return self.type_reference()
        raise SyntaxTrouble(f"a type at {t.start}: {t.text!r}")

    def template_type(self) -> Node:
        start, parts = self.token.start, []
        piece = self.advance_template()
        parts.append(piece)
        while piece.name.endswith("${"):
            parts.append(self.type())
            if not self.at("}"):
                raise SyntaxTrouble(f"'}}' at {self.token.start}")
            self.token = template_at(self.source, self.token.start)
            piece = self.advance_template()
            parts.append(piece)
        kind = "LiteralType" if len(parts) == 1 else "TemplateType"
        return self.node(kind, start, [self.node("Template", start, parts)] if len(parts) == 1 else parts)

    def entity(self) -> Node:
        start = self.token.start
        if self.token.kind not in ("word", "keyword"):
            raise SyntaxTrouble(f"a type's name at {start}")
        out = self.leaf("This" if self.at("this") else "Ref")
        while self.at(".") and self.token.kind == "punct":
            self.advance()
            name = self.leaf("Name")
            out = self.node("Qualified", start, [out, name], left=out, name=name.name)
        return out

    def type_reference(self) -> Node:
        start = self.token.start
        name = self.entity()
        args = self.type_arguments() if self.at("<") and not self.token.newline else None
        return self.node("TypeReference", start, [name, args], of=name, arguments=args)

    def import_type(self) -> Node:
        start = self.need("import").start
        self.need("(")
        source = self.type()
        while self.eat(","):
            self.object()
        self.need(")")
        parts = [source]
        while self.eat("."):
            parts.append(self.leaf("Name"))
        if self.at("<"):
            parts.append(self.type_arguments())
        return self.node("ImportType", start, parts, of=source)

    def tuple_type(self) -> Node:
        start, parts = self.need("[").start, []
        while not self.at("]"):
            s = self.token.start
            rest = bool(self.eat("..."))
            n = self.peek()
            label = None
            if self.token.kind in ("word", "keyword") and (n.text == ":" or n.text == "?" and token_at(self.source, n.end, False).text == ":"):
                label = self.leaf("Name")
                optional = bool(self.eat("?"))
                self.need(":")
            own = self.type()
            if label is not None:
                own = self.node("NamedMember", label.start, [label, own], label=label.name, optional=optional, type=own)
            elif self.eat("?"):
                own = self.node("OptionalType", s, [own], type=own)
            parts.append(self.node("RestType", s, [own], type=own) if rest else own)
            if not self.eat(","):
                break
        self.need("]")
        return self.node("TupleType", start, parts, elements=parts)

    def object_type(self) -> Node:
        start = self.token.start
        if mapped := self.attempt(self.mapped_type):
            return mapped
        members = self.type_members()
        return self.node("ObjectType", start, members, members=members)

    def mapped_type(self) -> Node:
        start = self.need("{").start
        self.eat("+") or self.eat("-")
        self.eat("readonly")
        self.need("[")
        name = self.leaf("Binding")
        self.need("in")
        over = self.type()
        parts = [name, over, self.type() if self.eat("as") else None]
        self.need("]")
        self.eat("+") or self.eat("-")
        self.eat("?")
        if self.eat(":"):
            parts.append(self.type())
        self.eat(";")
        self.need("}")
        return self.node("MappedType", start, parts)

    def type_members(self) -> list[Node]:
        self.need("{")
        before, self.no_conditional = self.no_conditional, False
        out = []
        while not self.at("}"):
            out.append(self.type_member())
            if not (self.eat(";") or self.eat(",") or self.at("}") or self.token.newline):
                raise SyntaxTrouble(f"';' at {self.token.start}")
        self.no_conditional = before
        self.need("}")
        return out

    def type_member(self) -> Node:
        s = self.token.start
        if self.at("(", "<"):
            generics, params = self.type_parameters(), self.parameters()
            return self.node("CallSignature", s, [generics, *params, self.annotation()])
        if self.at("new") and self.peek().text in ("(", "<"):
            self.advance()
            generics, params = self.type_parameters(), self.parameters()
            return self.node("ConstructSignature", s, [generics, *params, self.annotation()])
        ends = ("(", "<", ":", "?", ";", ",", "}")
        readonly = bool(self.at("readonly") and self.peek().text not in ends and self.advance())
        if self.at("[") and (sig := self.attempt(self.index_signature)):
            return self.node("IndexSignature", s, [sig])
        role = self.advance().text if self.at("get", "set") and self.peek().text not in ends else None
        key = self.property_key()
        optional = bool(self.eat("?"))
        if self.at("(", "<"):
            generics, params = self.type_parameters(), self.parameters()
            returns = self.annotation()
            return self.node("MethodSignature", s, [key, generics, *params, returns], key=key, optional=optional, params=params, returns=returns, role=role)
        annotation = self.annotation()
        return self.node("PropertySignature", s, [key, annotation], key=key, optional=optional, readonly=readonly, annotation=annotation)


def unquoted(text: str) -> str:
    """What a string literal stands for, of its escapes the common ones."""
    body = text[1:-1] if len(text) > 1 and text[-1] == text[0] else text[1:]
    if "\\" not in body:
        return body
    plain = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}
    out, i = [], 0
    while i < len(body):
        c = body[i]
        if c == "\\" and i + 1 < len(body):
            i += 1
            c = plain.get(body[i], body[i])
        out.append(c)
        i += 1
    return "".join(out)


#: Calls that one more level of nesting takes at most, from statement or type to what lies inside.
CALLS_A_LEVEL = 24


@contextmanager
def deep(source: str) -> Iterator[None]:
    """Room for as many nested calls as a source can have levels.

    Every level takes a character. Frames of Python functions lie on the heap, so that the limit is all that
    stands against deep nesting; it is the process's own again afterwards.
    """
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 1000 + CALLS_A_LEVEL * len(source)))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def parse(source: str, file: str = "a.ts") -> tuple[Node, list[Token], int]:
    """The program, its tokens and the number of statements that could not be read."""
    with deep(source):
        parser = Parser(source, file.endswith("x"))
        return parser.program(), parser.tokens, parser.errors
