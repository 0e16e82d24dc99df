"""Symbols and references of Go source.

One pass over the tokens turns a file into a flat list of events in document order: scopes open with the names they bind
and close, a file-level symbol begins and ends, a name is bound, referred to, called, or the base of a selector. What the
events refer to is settled afterwards, against the table of all symbols of the package; that is a loop over the list.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""(?P<ws>[ \t\r]+)|(?P<nl>\n)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<ident>[^\W\d]\w*)
    |(?P<num>(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?|0[bBoO][0-9_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)i?)
    |(?P<str>"(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:[^'\\\n]|\\(?:[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.))')
    |(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])""",
    re.S | re.X,
)
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
ENDS = frozenset(["break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
BINARY = frozenset("|| && == != < <= > >= + - | ^ * / % << >> & &^".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= &^=".split())
UNARY = frozenset("+ - ! ^ * & <- ~".split())


class GoSyntaxError(ValueError):
    """Source that isn't Go."""


@dataclass
class GoFile:
    path: str
    package: str = ""
    imports: list[str] = field(default_factory=list)
    import_names: set[str] = field(default_factory=set)
    symbols: list[tuple[str, str, int]] = field(default_factory=list)  # name, kind, line
    events: list[tuple] = field(default_factory=list)


def tokens(source: str) -> list[tuple[str, str, int]]:
    """(kind, text, line), with the semicolons that line ends stand for. Raises GoSyntaxError."""
    out: list[tuple[str, str, int]] = []
    at, line = 0, 1
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise GoSyntaxError(f"line {line}: unexpected {source[at]!r}")
        kind, text = m.lastgroup, m.group()
        breaks = "\n" in text and kind in ("nl", "comment") or kind == "comment" and text.startswith("//") and False
        if breaks and out and (out[-1][0] in ("ident", "num", "str") or out[-1][1] in ENDS):
            out.append(("op", ";", line))
        if kind == "ident":
            out.append(("kw" if text in KEYWORDS else "ident", text, line))
        elif kind in ("num", "str", "op"):
            out.append((kind, text, line))
        line += text.count("\n")
        at = m.end()
    if out and (out[-1][0] in ("ident", "num", "str") or out[-1][1] in ENDS):
        out.append(("op", ";", line))
    out.append(("eof", "", line))
    return out


class Parser:
    """Recursive descent over the tokens of one file; fills a GoFile."""

    def __init__(self, path: str, source: str):
        self.toks = tokens(source.removeprefix("﻿"))
        self.at = 0
        self.level = 0  # below 0 in the head of a control clause, where a brace opens the body
        self.file = GoFile(path)
        self.events = self.file.events

    # tokens

    @property
    def tok(self) -> str:
        return self.toks[self.at][1] if self.toks[self.at][0] != "str" else "\0str"

    @property
    def kind(self) -> str:
        return self.toks[self.at][0]

    @property
    def line(self) -> int:
        return self.toks[self.at][2]

    def fail(self, what: str) -> GoSyntaxError:
        return GoSyntaxError(f"{self.file.path}:{self.line}: expected {what}, found {self.toks[self.at][1]!r}")

    def take(self, text: str) -> None:
        if self.tok != text:
            raise self.fail(text)
        self.at += 1

    def skip(self, text: str) -> bool:
        if self.tok == text:
            self.at += 1
            return True
        return False

    def ident(self) -> str:
        if self.kind != "ident":
            raise self.fail("a name")
        self.at += 1
        return self.toks[self.at - 1][1]

    def end(self) -> None:
        """A statement or declaration ends at a semicolon or before a closing bracket."""
        if self.tok not in (")", "}") and not self.skip(";") and self.kind != "eof":
            raise self.fail("; or a line end")

    # events

    def push(self) -> list[str]:
        names: list[str] = []
        self.events.append(("push", names))
        return names

    def pop(self) -> None:
        self.events.append(("pop",))

    def ref(self, name: str) -> None:
        self.events.append(("ref", name))

    # declarations

    def parse(self) -> GoFile:
        self.take("package")
        self.file.package = self.ident()
        self.end()
        while self.skip("import"):
            self.group(self.import_spec)
            self.end()
        while self.kind != "eof":
            if self.tok == "func":
                self.func_decl()
            elif self.tok in ("const", "var", "type"):
                self.gen_decl(True)
            elif self.tok == "import":
                raise self.fail("a declaration other than import")
            else:
                raise self.fail("a declaration")
            self.end()
        self.file.imports.sort()
        return self.file

    def group(self, spec) -> None:
        if self.skip("("):
            while not self.skip(")"):
                spec()
                self.end()
        else:
            spec()

    def import_spec(self) -> None:
        name = None
        if self.kind == "ident":
            name = self.ident()
        elif self.skip("."):
            name = "."
        if self.kind != "str":
            raise self.fail("an import path")
        path = self.toks[self.at][1].strip('"`')
        self.at += 1
        self.file.imports.append(path)
        name = name or path.rstrip("/").rsplit("/", 1)[-1]
        if name not in ("_", "."):
            self.file.import_names.add(name)

    def gen_decl(self, top: bool) -> None:
        what = self.toks[self.at][1]
        self.at += 1
        self.group(lambda: self.type_spec(top) if what == "type" else self.value_spec(what, top))

    def value_spec(self, what: str, top: bool) -> None:
        names = []
        while True:
            line = self.line
            names.append((self.ident(), line))
            if not self.skip(","):
                break
        owner = next((n for n, _ in names if n != "_"), None) if top else None
        if top:
            self.file.symbols += [(n, what, line) for n, line in names if n != "_"]
        if owner:
            self.events.append(("sym", owner))
        if self.tok not in ("=", ";", ")"):
            self.type()
        if self.skip("="):
            self.expr_list()
        if owner:
            self.events.append(("endsym",))

    def type_spec(self, top: bool) -> None:
        line, name = self.line, self.ident()
        names = self.push()
        owned = top and name != "_"
        if owned:
            self.events.append(("sym", name))
        if self.tok == "[" and self.toks[self.at + 1][0] == "ident":
            self.type_params_or_array(names)
        else:
            self.skip("=")
            if self.tok in ("struct", "interface"):
                kind = self.tok
            else:
                kind = "type"
            self.type()
            self._symbol(owned, name, kind, line)
            self._close(owned)
            return
        kind = "type"
        if self.tok in ("struct", "interface"):
            kind = self.tok
        if self.tok not in (";", ")", "}") and self.kind != "eof":
            self.skip("=")
            self.type()
        self._symbol(owned, name, kind, line)
        self._close(owned)

    def _symbol(self, owned: bool, name: str, kind: str, line: int) -> None:
        if owned:
            self.file.symbols.append((name, kind, line))

    def _close(self, owned: bool) -> None:
        if owned:
            self.events.append(("endsym",))
        self.pop()

    def type_params_or_array(self, names: list[str]) -> None:
        """After a type's name: its parameters, or else the length of an array type, whose element type is read too."""
        mark, n_events = self.at, len(self.events)
        try:
            self.take("[")
            if self.toks[self.at + 1][1] in ("]", "+", "-", "/", "%", "<<", ">>", "."):
                raise self.fail("type parameters")
            found = self.type_params_tail()
            if self.tok in (";", "=") and self.tok != "=":
                raise self.fail("a type")
            names += found
        except GoSyntaxError:
            self.at = mark
            del self.events[n_events:]
            self.type()

    def type_params_tail(self) -> list[str]:
        names = []
        while self.tok != "]":
            names.append(self.ident())
            while self.skip(","):
                names.append(self.ident())
            self.constraint()
            if not self.skip(","):
                break
        self.take("]")
        return names

    def constraint(self) -> None:
        while True:
            self.skip("~")
            self.type()
            if not self.skip("|"):
                return

    def func_decl(self) -> None:
        line = self.line
        self.take("func")
        names = self.push()
        owner_at = len(self.events)
        self.events.append(("sym", ""))
        base, has_recv = "", False
        if self.tok == "(":
            has_recv = True
            base = self.receiver(names)
        name = self.ident()
        if self.tok == "[":
            self.at += 1
            names += self.type_params_tail()
        names += self.signature()
        full = f"{base}.{name}" if has_recv and base else name
        self.events[owner_at] = ("sym", full)
        if not has_recv or base:
            self.file.symbols.append((full, "method" if has_recv else "func", line))
        if self.tok == "{":
            self.body()
        self.pop()
        self.events.append(("endsym",))

    def receiver(self, names: list[str]) -> str:
        """Binds the receiver and gives the name of its base type, empty if it has none."""
        mark = self.at
        names += self.params()
        depth, found = 0, []
        for kind, text, _ in self.toks[mark : self.at]:
            if text == "[":
                depth += 1
            elif text == "]":
                depth -= 1
            elif depth == 0 and kind == "ident":
                found.append(text)
        return found[-1] if found else ""

    # types

    def signature(self) -> list[str]:
        """Parameters and results; the names they bind."""
        names = self.params()
        if self.tok == "(":
            names += self.params()
        elif self.starts_type():
            self.type()
        return names

    def starts_type(self) -> bool:
        return self.kind == "ident" or self.tok in ("*", "[", "(", "map", "chan", "func", "struct", "interface", "<-")

    def params(self) -> list[str]:
        self.take("(")
        entries: list[tuple[int, bool]] = []  # event of a bare name, whether a type follows it
        names: list[str] = []
        bare: list[tuple[str, int]] = []
        any_typed = False
        while self.tok != ")":
            del entries[:]
            if self.kind == "ident" and self.toks[self.at + 1][1] in (",", ")"):
                n = self.ident()
                bare.append((n, len(self.events)))
                self.ref(n)
            elif self.kind == "ident" and self.toks[self.at + 1][1] not in (".", "[") or self.kind == "ident" and self.toks[self.at + 1][1] == "[" and self.named_array():
                n = self.ident()
                any_typed = True
                names.append(n)
                self.skip("...")
                self.type()
            else:
                self.skip("...")
                self.type()
            if not self.skip(","):
                break
        self.take(")")
        if any_typed:  # bare names before a typed one are names too
            for n, i in bare:
                names.append(n)
                self.events[i] = ("nop",)
        return names

    def named_array(self) -> bool:
        """Whether ``name[`` is a parameter of array or slice type and not a generic type: something follows the bracket."""
        depth, i = 0, self.at + 1
        while True:
            text = self.toks[i][1]
            depth += (text == "[") - (text == "]")
            i += 1
            if depth == 0 or self.toks[i][0] == "eof":
                break
        return self.toks[i][1] not in (",", ")", ".")

    def type(self) -> None:
        t = self.tok
        if self.kind == "ident":
            n = self.ident()
            if self.skip("."):
                self.events.append(("sel", n, self.ident(), False))
            else:
                self.ref(n)
            if self.tok == "[" and self.toks[self.at + 1][1] != "]":
                self.take("[")
                while self.tok != "]":
                    self.type()
                    if not self.skip(","):
                        break
                self.take("]")
        elif t == "*":
            self.at += 1
            self.type()
        elif t == "(":
            self.at += 1
            self.type()
            self.take(")")
        elif t == "[":
            self.at += 1
            if not self.skip("]"):
                if not self.skip("..."):
                    self.inner(self.expr)
                self.take("]")
            self.type()
        elif t == "map":
            self.at += 1
            self.take("[")
            self.type()
            self.take("]")
            self.type()
        elif t == "chan":
            self.at += 1
            self.skip("<-")
            self.type()
        elif t == "<-":
            self.at += 1
            self.take("chan")
            self.type()
        elif t == "func":
            self.at += 1
            self.signature()
        elif t == "struct":
            self.struct()
        elif t == "interface":
            self.interface()
        else:
            raise self.fail("a type")

    def struct(self) -> None:
        self.take("struct")
        self.take("{")
        while not self.skip("}"):
            if self.kind == "ident" and self.toks[self.at + 1][1] not in (".", ";", "}") and self.toks[self.at + 1][0] != "str" and not (self.toks[self.at + 1][1] == "[" and not self.field_array()):
                self.ident()
                while self.skip(","):
                    self.ident()
                self.type()
            else:
                self.type()
            if self.kind == "str":
                self.at += 1
            self.end()

    def field_array(self) -> bool:
        depth, i = 0, self.at + 1
        while True:
            text = self.toks[i][1]
            depth += (text == "[") - (text == "]")
            i += 1
            if depth == 0 or self.toks[i][0] == "eof":
                break
        return self.toks[i][1] not in (";", "}") and self.toks[i][0] != "str"

    def interface(self) -> None:
        self.take("interface")
        self.take("{")
        while not self.skip("}"):
            if self.kind == "ident" and self.toks[self.at + 1][1] == "(":
                self.ident()
                self.signature()
            else:
                self.constraint()
            self.end()

    # expressions

    def inner(self, what) -> None:
        """Within brackets a brace opens a literal again."""
        held, self.level = self.level, 0
        what()
        self.level = held

    def expr_list(self) -> list[int | None]:
        """Events of the elements that are bare names, None for others."""
        out = [self.expr()]
        while self.skip(","):
            out.append(self.expr())
        return out

    def expr(self) -> int | None:
        bare = self.unary()
        while self.tok in BINARY:
            self.at += 1
            self.unary()
            bare = None
        return bare

    def unary(self) -> int | None:
        if self.tok == "<-" and self.toks[self.at + 1][1] == "chan":
            return self.primary()
        if self.tok in UNARY:
            self.at += 1
            self.unary()
            return None
        return self.primary()

    def primary(self) -> int | None:
        """An operand with its suffixes; the event of a bare name if it is nothing else."""
        first = len(self.events)
        bare: int | None = None
        literal = False  # whether a brace may open a literal of this type
        elided_map = False
        if self.kind in ("num", "str"):
            self.at += 1
        elif self.kind == "ident":
            bare, literal = first, True
            self.ref(self.ident())
        elif self.tok == "(":
            self.at += 1
            self.inner(lambda: self.type() if self.tok in ("map", "chan", "struct", "interface") and False else self.expr())
            self.take(")")
        elif self.tok == "func":
            self.func_lit()
        elif self.tok in ("[", "map", "chan", "struct", "interface", "<-"):
            elided_map = self.tok == "map"
            self.inner(self.type)
            if self.tok == "{":
                self.literal(elided_map)
        else:
            raise self.fail("an operand")
        sel: int | None = None
        while True:
            if self.tok == ".":
                self.at += 1
                if self.skip("("):
                    if not self.skip("type"):
                        self.inner(self.type)
                    self.take(")")
                    literal = False
                else:
                    member = self.ident()
                    sel = None
                    if bare is not None:
                        self.events[bare] = ("sel", self.events[bare][1], member, False)
                        sel = bare
                bare = None if bare is not None and self.events[bare][0] == "sel" else None
            elif self.tok == "(":
                if bare is not None:
                    self.events[bare] = ("call", self.events[bare][1])
                elif sel is not None:
                    _, base, member, _ = self.events[sel]
                    self.events[sel] = ("sel", base, member, True)
                self.at += 1
                self.inner(self.args)
                self.take(")")
                bare = sel = None
                literal = False
            elif self.tok == "[":
                self.at += 1
                self.inner(self.index)
                self.take("]")
                bare = sel = None
            elif self.tok == "{" and literal and self.level >= 0:
                self.literal(False)
                bare = sel = None
                literal = False
            else:
                return bare

    def args(self) -> None:
        while self.tok != ")":
            self.expr()
            self.skip("...")
            if not self.skip(","):
                return

    def index(self) -> None:
        while self.tok != "]":
            if not self.skip(":"):
                self.expr()
            self.skip(",")

    def literal(self, is_map: bool) -> None:
        """Elements in braces; a bare name before a colon is a field unless the literal is a map's."""
        self.take("{")
        held, self.level = self.level, 0
        while self.tok != "}":
            bare = self.element()
            if self.skip(":"):
                if bare is not None and not is_map:
                    self.events[bare] = ("nop",)
                self.element()
            if not self.skip(","):
                break
        self.take("}")
        self.level = held

    def element(self) -> int | None:
        if self.tok == "{":
            self.literal(False)
            return None
        return self.expr()

    def func_lit(self) -> None:
        at = len(self.events)
        names = self.push()
        self.take("func")
        names += self.signature()
        if self.tok == "{" and True:
            held, self.level = self.level, 0
            self.body()
            self.level = held
            self.pop()
        else:
            self.events[at] = ("nop",)

    # statements

    def body(self) -> None:
        self.push()
        self.take("{")
        self.statements(("}",))
        self.take("}")
        self.pop()

    def statements(self, stops: tuple[str, ...]) -> None:
        while self.tok not in stops and self.kind != "eof":
            self.statement()
            if self.tok not in stops and not self.skip(";"):
                raise self.fail("; or a line end")

    def statement(self) -> None:
        t = self.tok
        if t in ("var", "const", "type"):
            self.gen_decl(False)
        elif t == "{":
            self.body()
        elif t == "if":
            self.if_()
        elif t == "for":
            self.for_()
        elif t == "switch":
            self.switch()
        elif t == "select":
            self.select()
        elif t in ("go", "defer"):
            self.at += 1
            self.expr()
        elif t == "return":
            self.at += 1
            if self.tok not in (";", "}"):
                self.expr_list()
        elif t in ("break", "continue", "goto", "fallthrough"):
            self.at += 1
            if self.kind == "ident":
                self.ident()
        elif t in (";", "}"):
            return
        elif self.kind == "ident" and self.toks[self.at + 1][1] == ":":
            self.at += 2
            if self.tok not in ("}", ";"):
                self.statement()
        else:
            self.simple()

    def simple(self) -> None:
        """Expressions, assignments, definitions, sends, steps; of a definition the bare names on the left are bound."""
        if self.tok == "range":
            self.at += 1
            self.expr()
            return
        left = self.expr_list()
        if self.tok == ":=":
            self.at += 1
            for i in left:
                if i is not None:
                    self.events[i] = ("bind", self.events[i][1])
            self.right()
        elif self.tok in ASSIGN:
            self.at += 1
            self.right()
        elif self.tok in ("++", "--"):
            self.at += 1
        elif self.skip("<-"):
            self.expr()

    def right(self) -> None:
        if self.skip("range"):
            self.expr()
        else:
            self.expr_list()

    def header(self) -> None:
        """Up to three simple statements before the brace of a control clause."""
        held, self.level = self.level, -1
        while self.tok != "{":
            if self.tok != ";":
                self.simple()
            if not self.skip(";"):
                break
        self.level = held

    def if_(self) -> None:
        self.take("if")
        self.push()
        self.header()
        self.body()
        if self.skip("else"):
            self.if_() if self.tok == "if" else self.body()
        self.pop()

    def for_(self) -> None:
        self.take("for")
        self.push()
        self.header()
        self.body()
        self.pop()

    def switch(self) -> None:
        self.take("switch")
        self.push()
        self.header()
        self.clauses(lambda: self.types_or_exprs())
        self.pop()

    def types_or_exprs(self) -> None:
        while True:
            self.expr()
            if not self.skip(","):
                return

    def select(self) -> None:
        self.take("select")
        self.push()
        self.clauses(self.simple)
        self.pop()

    def clauses(self, head) -> None:
        self.push()  # the block
        self.take("{")
        while not self.skip("}"):
            self.push()
            if self.skip("case"):
                self.inner(head)
            else:
                self.take("default")
            self.take(":")
            self.statements(("case", "default", "}"))
            self.pop()
        self.pop()


def parse(path: str, source: str) -> GoFile:
    """Raises GoSyntaxError for source that isn't Go."""
    try:
        return Parser(path, source).parse()
    except IndexError as e:
        raise GoSyntaxError(f"{path}: unexpected end") from e


def mentions(file: GoFile) -> list[tuple[str, str, str, str, bool]]:
    """(symbol, call, ref or sel, name, member, called) of what the symbols of a file mention, sorted, each once: names that are
    neither local nor, unless called, those of imports. Which of them the package declares is not looked at."""
    scopes: list[set[str]] = []
    owners: list[str] = []
    out: set[tuple[str, str, str, str, bool]] = set()
    for event in file.events:
        what = event[0]
        if what == "push":
            scopes.append({n for n in event[1] if n != "_"})
        elif what == "pop":
            scopes.pop()
        elif what == "sym":
            owners.append(event[1])
        elif what == "endsym":
            owners.pop()
        elif what == "bind":
            if scopes and event[1] != "_":
                scopes[-1].add(event[1])
        elif what in ("ref", "call", "sel"):
            name = event[1]
            if not owners or not owners[-1] or name == "_" or any(name in s for s in scopes) or (what != "call" and name in file.import_names):
                continue
            out.add((owners[-1], what, name, event[2] if what == "sel" else "", what == "sel" and bool(event[3])))
    return sorted(out)


def resolve(file: GoFile, where: dict[str, str], kinds: dict[str, str]) -> list[tuple[str, str, str, str]]:
    """(source symbol, target file, target, kind) of the references of a file, sorted, each once. ``where`` and ``kinds``
    are the package's table: the least file that declares a name, and its kind."""
    out: set[tuple[str, str, str, str]] = set()
    for owner, what, name, member, called in mentions(file):
        if name not in kinds:
            continue
        kind = "call" if what == "call" and kinds[name] == "func" else "use"
        if what == "sel" and f"{name}.{member}" in kinds:
            name, kind = f"{name}.{member}", "call" if called else "use"
        if not (where[name] == file.path and owner == name):
            out.add((owner, where[name], name, kind))
    return sorted(out)


def index_directory(files: list[tuple[str, str]]) -> tuple[list[GoFile], dict[str, list[tuple[str, str, str, str]]], list[str]]:
    """Parsed files of a directory, the references of each, and the paths that couldn't be parsed. Files of one package
    clause see each other's symbols."""
    parsed, skipped = [], []
    for path, source in sorted(files):
        try:
            parsed.append(parse(path, source))
        except (GoSyntaxError, RecursionError):
            skipped.append(path)
    refs: dict[str, list[tuple[str, str, str, str]]] = {}
    for package in sorted({f.package for f in parsed}):
        own = [f for f in parsed if f.package == package]
        where: dict[str, str] = {}
        kinds: dict[str, str] = {}
        for f in own:
            for name, kind, _ in f.symbols:
                where.setdefault(name, f.path)
                kinds[name] = kind
        for f in own:
            refs[f.path] = resolve(f, where, kinds)
    return parsed, refs, skipped
