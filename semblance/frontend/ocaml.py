"""OCaml source to the intermediate language.

Expressions become statements where they stand in a row: a ``let`` is an assignment before what follows its ``in``, and what stands
last is the value returned. References are plain variables: ``ref e`` is e, ``!r`` reads r and ``r := e`` assigns it.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from .braces import Unreadable, tail_returns
from .il import E, Fn, S

TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<string>"(?:\\.|[^"\\])*"|\{(?P<q>[a-z_]*)\|.*?\|(?P=q)\})|(?P<char>'(?:\\(?:x[0-9a-fA-F]{2}|[0-9]{3}|.)|[^\\'\n])')|(?P<tyvar>'[a-z_]\w*)
  |(?P<num>0[xXoObB][\da-fA-F_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?[lLn]?)|(?P<id>[A-Za-z_][\w']*)
  |(?P<op>;;|->|<-|:=|::|\.\.|\|\||&&|\[\||\|\]|\[%|\[@+|[!?~](?![=])[!$%&*+./:<=>?@^|~-]*|[=<>@^|&+*/$%-][!$%&*+./:<=>?@^|~-]*|[()\[\]{},;:.'\#`])|(?P<other>.)""",
    re.X | re.S,
)
KEYWORDS = set("and as assert begin class constraint do done downto else end exception external for fun function functor if in include inherit initializer lazy let match method module mutable new nonrec object of open or private rec sig struct then to try type val virtual when while with".split())
#: Words that end an expression.
CLOSERS = {")", "]", "}", "|]", "end", "done", "in", "then", "else", "do", "to", "downto", "with", "and", "|", ";;", "->", "", "let*", "type", "module", "open", "exception", "include", "external", "val"}
#: Binary operators by their first characters, the loosest first, and whether they lean to the right.
LEVELS = [({"||", "or"}, "", True), ({"&&", "&"}, "", True), (set(), "=<>|&$", False), (set(), "@^", True), ({"::"}, "", True), (set(), "+-", False), ({"mod", "land", "lor", "lxor"}, "*/%", False), ({"lsl", "lsr", "asr"}, "", True)]
NAMES = {"=": "==", "<>": "!=", "==": "==", "!=": "!=", "^": "concat", "@": "append", "land": "&", "lor": "|", "lxor": "xor", "lsl": "<<", "asr": ">>", "lsr": ">>", "mod": "%", "+.": "+", "-.": "-", "*.": "*", "/.": "/", "&": "and", "or": "or"}


class Tok(NamedTuple):
    kind: str
    text: str
    line: int


def tokens(source: str) -> list[Tok]:
    out, at, line = [], 0, 1
    while at < len(source):
        if source.startswith("(*", at):
            depth, k = 1, at + 2
            while k < len(source) and depth:
                step = 2 if source.startswith(("(*", "*)"), k) else 1
                depth += source.startswith("(*", k) - source.startswith("*)", k)
                k += step
            line += source.count("\n", at, k)
            at = k
            continue
        m = TOKEN.match(source, at)
        if m.lastgroup != "space":
            kind = "string" if m.lastgroup == "q" else m.lastgroup
            out.append(Tok("word" if kind == "id" and m[0] in KEYWORDS else kind, m[0], line))
        line += m[0].count("\n")
        at = m.end()
    return out


class Parser:
    def __init__(self, toks: list[Tok]):
        self.t, self.i = toks, 0
        self.found: list[Fn] = []

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k].text if self.i + k < len(self.t) else ""

    def kind(self, k: int = 0) -> str:
        return self.t[self.i + k].kind if self.i + k < len(self.t) else ""

    @property
    def line(self) -> int:
        return self.t[min(self.i, len(self.t) - 1)].line if self.t else 1

    def take(self, text: str = "") -> str:
        x = self.peek()
        if text and x != text or not x:
            raise Unreadable(f"line {self.line}: {x!r} for {text!r}")
        self.i += 1
        return x

    def got(self, *texts: str) -> str:
        if self.peek() in texts and self.peek():
            self.i += 1
            return self.t[self.i - 1].text
        return ""

    def close(self, at: int) -> int:
        """The place of what closes the bracket at ``at``."""
        pairs, depth = {"(": ")", "[": "]", "{": "}", "[|": "|]", "begin": "end", "struct": "end", "sig": "end", "object": "end"}, []
        for k in range(at, len(self.t)):
            x = self.t[k].text
            if x in pairs and self.t[k].kind != "string":
                depth.append(pairs[x])
            elif depth and x == depth[-1]:
                depth.pop()
                if not depth:
                    return k
        raise Unreadable(f"line {self.t[at].line}: not closed")

    def skip_until(self, *stops: str) -> None:
        while self.peek() and self.peek() not in stops:
            self.i = self.close(self.i) + 1 if self.peek() in ("(", "[", "{", "[|") else self.i + 1

    def names(self, start: int, end: int) -> list[str]:
        """Variables that a pattern binds: fields, labels, types and paths aside."""
        out, k = [], start
        while k < end:
            t, after = self.t[k], self.t[k + 1].text if k + 1 < end else ""
            if t.text == ":" and self.t[k - 1].text != "~":
                while k < end and self.t[k].text not in (")", ",", "="):
                    k += 1
                continue
            lower = t.kind == "id" and (t.text[0].islower() or t.text[0] == "_" and t.text != "_")
            if lower and self.t[k - 1].text != "." and after not in (".", "=") and t.text not in ("true", "false") and t.text not in out:
                out.append(t.text)
            k += 1
        return out

    # statements
    def row(self) -> list[S]:
        """Expressions between semicolons, up to what closes them."""
        out: list[S] = []
        while self.peek() not in CLOSERS:
            if self.peek() == "let" and self._let_in():
                out += self.bindings()
                self.take("in")
                continue
            out += self.statement()
            if not self.got(";"):
                break
        return out

    def _let_in(self) -> bool:
        """Whether the let ahead is a definition of values (and not of a module), to be followed by in."""
        if self.peek(1) in ("open", "module", "exception"):
            self.skip_until("in")
            self.take("in")
            return False
        return True

    def bindings(self) -> list[S]:
        out: list[S] = []
        self.take("let")
        if self.peek() in ("%", "*"):
            self.i += 1
        self.got("rec")
        while True:
            out += self.binding()
            if not self.got("and"):
                return out

    def binding(self) -> list[S]:
        start, line = self.i, self.line
        if self.peek() == "(" and self.peek(2) == ")" and self.kind(1) == "op":
            name, self.i = self.peek(1), self.i + 3
        elif self.kind() == "id" and self.peek()[0].islower() or self.kind() == "id" and self.peek()[0] == "_" and self.peek() != "_":
            name = self.take()
            if self.peek() in (",", "::", "as"):
                name, self.i = "", start
        else:
            name = ""
        if not name:
            at = self.i
            self.skip_until("=")
            bound = self.names(at, self.i)
            if any(x.text == "let" for x in self.t[at : self.i]):
                raise Unreadable(f"line {line}: a pattern")
            self.take("=")
            value = self.block_of(self.row(), line)
            target = E("seq", "tuple", tuple(E("var", x, (), line) for x in bound), line)
            return [S("assign", (target, value), (), line)] if len(bound) > 1 else [S("assign", (E("var", bound[0], (), line), value), (), line)] if bound else [S("expr", (value,), (), line)]
        params, extra = self.params("=", ":")
        if self.got(":"):
            self.skip_until("=")
        self.take("=")
        if not params and self.peek() in ("fun", "function"):
            fn = self.function().fn
            params, body = list(fn.params), fn.body
        elif params:
            body = (*extra, *tail_returns(tuple(self.row())))
        else:
            value = self.block_of(self.row(), line)
            return [S("assign", (E("var", name, (), line), value), (), line)]
        fn = self.named(name, params, body, start)
        return [S("assign", (E("var", name, (), line), E("lambda", "", (), line, "", fn)), (), line)]

    def named(self, name: str, params: list[str], body: tuple[S, ...], start: int) -> Fn:
        mine = self.t[start : self.i]
        fn = Fn(name, tuple(params), body, self.t[start].line, mine[-1].line, len({x.line for x in mine}), tuple(x.text for x in mine))
        self.found.append(fn)
        return fn

    def params(self, *stops: str) -> tuple[list[str], list[S]]:
        """Names of parameters up to a stop, and assignments of what their patterns bind besides."""
        out: list[str] = []
        extra: list[S] = []
        while self.peek() and self.peek() not in stops:
            line = self.line
            if self.peek() in ("(", "[", "{"):
                end = self.close(self.i)
                bound = self.names(self.i + 1, end)
                self.i = end + 1
            else:
                x = self.take()
                if x[0] in "~?" and len(x) == 1 and self.kind() == "id":
                    x = self.take()
                    if self.got(":"):
                        continue
                elif x[0] in "~?":
                    continue
                bound = [x] if x != "_" else []
            name = bound[0] if bound else f"_{len(out)}"
            out.append(name)
            extra += [S("assign", (E("var", x, (), line), E("var", name, (), line)), (), line) for x in bound[1:]]
        return out, extra

    def statement(self) -> list[S]:
        line, x = self.line, self.peek()
        if x == "if":
            self.i += 1
            test = self.expr()
            self.take("then")
            yes = self.branch()
            no = self.branch() if self.got("else") else ()
            return [S("if", (test,), (yes, no), line)]
        if x == "match":
            self.i += 1
            subject = self.block_of(self.row(), line)
            self.take("with")
            return self.arms(subject, line)
        if x == "try":
            self.i += 1
            body = tuple(self.row())
            self.take("with")
            found = self.arms(E("var", "exn", (), line), line)
            return [S("try", (), (body, tuple(found)), line)]
        if x == "while":
            self.i += 1
            test = self.block_of(self.row(), line)
            self.take("do")
            body = tuple(self.row())
            self.take("done")
            return [S("loop", (test,), ((), body, ()), line)]
        if x == "for":
            self.i += 1
            name = E("var", self.take(), (), line)
            self.take("=")
            first, down = self.expr(), self.take() == "downto"
            last = self.expr()
            self.take("do")
            body = tuple(self.row())
            self.take("done")
            one = E("lit", "int", (), line, "1")
            step = S("assign", (name, E("op", "-" if down else "+", (name, one), line)), (), line)
            return [S("loop", (E("op", ">=" if down else "<=", (name, last), line),), ((S("assign", (name, first), (), line),), body, (step,)), line)]
        if x == "begin" and self.peek(self.close(self.i) + 1 - self.i) in CLOSERS | {";"}:
            end = self.close(self.i)
            self.i += 1
            out = self.row()
            self.i = end + 1
            return out
        e = self.expr()
        if self.got(":=", "<-"):
            return [S("assign", (e, self.expr()), (), line)]
        if self.got(","):
            parts = [e, self.expr()]
            while self.got(","):
                parts.append(self.expr())
            e = E("seq", "tuple", tuple(parts), line)
        return [S("expr", (e,), (), line)]

    def branch(self) -> tuple[S, ...]:
        """What an if chooses: up to the next semicolon, unless it starts with a word that reaches further."""
        return tuple(self.row()) if self.peek() in ("let", "match", "try", "fun", "function") else tuple(self.statement())

    def arms(self, subject: E, line: int) -> list[S]:
        """Cases as a chain of ifs."""
        found: list[tuple[E, tuple[S, ...]]] = []
        self.got("|")
        while True:
            start = self.i
            self.skip_until("->", "when")
            bound, test = self.names(start, self.i), E("op", "case", (subject,), self.line)
            if self.got("when"):
                test = E("op", "and", (test, self.expr()), self.line)
            self.take("->")
            bind = tuple(S("assign", (E("var", n), E("index", "case", (subject,), line)), (), line) for n in bound)
            found.append((test, bind + tuple(self.row())))
            if not self.got("|"):
                break
        rest: tuple[S, ...] = ()
        for test, body in reversed(found):
            rest = (S("if", (test,), (body, rest), line),)
        return list(rest)

    # expressions
    def block_of(self, body: list[S], line: int) -> E:
        """Statements where a value is wanted: the value itself if they are one, else a function called at once."""
        if len(body) == 1 and body[0].kind == "expr":
            return body[0].e[0]
        if not body:
            return E("lit", "unit", (), line)
        return E("call", "<block>", (E("lambda", "", (), line, "", Fn("<block>", (), tail_returns(tuple(body)), line, self.line)),), line, "block")

    def expr(self, level: int = 0) -> E:
        if level == len(LEVELS):
            return self.power()
        words, first, right = LEVELS[level]
        e = self.expr(level + 1)
        while True:
            x, line = self.peek(), self.line
            infix = x in words or self.kind() == "op" and x and x[0] in first and x not in ("->", "<-", "|", "|]", "||", "&&", "&", "**") and not x.startswith("**")
            if not infix:
                return e
            self.i += 1
            other = self.expr(level if right else level + 1)
            e = E("op", NAMES.get(x, x), (e, other), line)

    def power(self) -> E:
        line = self.line
        if self.got("-", "-."):
            return E("op", "neg", (self.power(),), line)
        e = self.apply()
        if self.peek().startswith("**"):
            self.i += 1
            return E("op", "**", (e, self.power()), line)
        return e

    def _argument(self) -> bool:
        return self.kind() in ("id", "num", "string", "char") or self.peek() in ("(", "[", "{", "[|", "begin", "`") or self.kind() == "op" and self.peek()[:1] in "!~?" and self.peek() != ""

    def apply(self) -> E:
        line = self.line
        if self.got("assert"):
            return E("call", "assert", (self.postfix(),), line)
        if self.got("lazy"):
            return self.postfix()
        if self.got("new"):
            return E("new", self.path(), (), line)
        head = self.peek() if self.kind() == "id" else ""
        f = self.postfix()
        args: list[E] = []
        while self._argument():
            if self.kind() == "op" and self.peek() in ("~", "?"):
                self.i += 1
                name = self.take()
                args.append(self.postfix() if self.got(":") else E("var", name, (), line))
            else:
                args.append(self.postfix())
        if not args:
            return E("seq", f.name, (), line) if f.kind == "new" else f
        if f.kind == "new":
            return f._replace(args=tuple(args))
        if f.kind == "var":
            if f.name == "ref":
                return args[0]
            if f.name in ("not", "raise", "failwith", "invalid_arg") and f.name == "not":
                return E("op", "not", tuple(args), line)
            return E("call", f.name, tuple(args), line)
        return E("call", f.name, tuple(args), line, "path") if f.kind == "field" and head[:1].isupper() else E("call", "", (f, *args), line, "dynamic")

    def path(self) -> str:
        x = self.take()
        while self.peek() == "." and self.kind(1) == "id":
            self.i += 1
            x = self.take()
        return x

    def postfix(self) -> E:
        line = self.line
        if self.kind() == "op" and self.peek()[:1] == "!":
            self.i += 1
            return self.postfix()
        e = self.primary()
        while True:
            if self.peek() == "." and self.kind(1) == "id":
                self.i += 1
                e = E("field", self.path(), (e,), line)
            elif self.peek() == "." and self.peek(1) in ("(", "[", "{"):
                self.i += 1
                end = self.close(self.i)
                self.i += 1
                at = self.block_of(self.row(), line)
                self.i = end + 1
                e = E("index", "", (e, at), line)
            elif self.peek() == "#" and self.kind(1) == "id":
                self.i += 1
                e = E("call", self.take(), (e,), line, "method")
            else:
                return e

    def function(self) -> E:
        line, word = self.line, self.take()
        if word == "fun":
            params, extra = self.params("->")
            self.take("->")
            body = (*extra, *tail_returns(tuple(self.row())))
        else:
            params, body = ["arg"], tail_returns(tuple(self.arms(E("var", "arg", (), line), line)))
        return E("lambda", "", (), line, "", Fn("<lambda>", tuple(params), body, line, self.t[self.i - 1].line))

    def items(self, end: int) -> tuple[E, ...]:
        """Values between semicolons up to a closing bracket."""
        out = []
        while self.i < end:
            (s, *more) = self.statement()
            out.append(self.block_of([s, *more], s.line))
            self.got(";")
        self.i = end + 1
        return tuple(out)

    def record(self, end: int) -> E:
        line, out = self.line, []
        while self.i < end:
            if self.kind() == "id" and self.peek(1) in ("=", ";", "}", "."):
                name = self.path()
                out.append(self.expr() if self.got("=") else E("var", name, (), line))
            else:
                out.append(self.expr())
                self.got("with")
            self.got(";")
        self.i = end + 1
        return E("seq", "record", tuple(out), line)

    def primary(self) -> E:
        line, x, kind = self.line, self.peek(), self.kind()
        if x in ("(", "begin"):
            end = self.close(self.i)
            self.i += 1
            if self.i == end:
                self.i = end + 1
                return E("lit", "unit", (), line)
            if self.kind() == "op" and self.i + 1 == end:
                name = self.take()
                self.i = end + 1
                return E("var", NAMES.get(name, name), (), line)
            e = self.block_of(self.row(), line)
            if self.got(":", ":>"):
                e = E("cast", self.peek(), (e,), line)
            if self.i < end and self.peek() not in (":", ":>") and e.kind != "cast":
                raise Unreadable(f"line {self.line}: {self.peek()!r}")
            self.i = end + 1
            return e
        if x in ("[", "[|"):
            end = self.close(self.i)
            self.i += 1
            return E("seq", "list" if x == "[" else "array", self.items(end), line)
        if x == "{":
            end = self.close(self.i)
            self.i += 1
            return self.record(end)
        if x in ("fun", "function"):
            return self.function()
        if x in ("if", "match", "try", "while", "for"):
            return self.block_of(self.statement(), line)
        if x == "let":
            return self.block_of(self.row(), line)
        if x == "`":
            self.i += 1
            return E("new", "`" + self.take(), (), line)
        self.take()
        if kind == "num":
            return E("lit", "float" if re.search(r"[.]|[eE](?!.*[xX])", x) and not x.startswith(("0x", "0X")) else "int", (), line, x.rstrip("lLn"))
        if kind == "string":
            return E("lit", "string", (), line, x[1:-1])
        if kind == "char":
            return E("lit", "char", (), line, x[1:-1])
        if kind == "id":
            if x in ("true", "false"):
                return E("lit", "bool", (), line, x)
            if x[0].isupper():
                if self.peek() == "." and self.kind(1) == "id":
                    self.i += 1
                    name = self.path()
                    return E("new", name, (), line) if name[0].isupper() else E("field", name, (), line)
                if self.peek() == "." and self.peek(1) in ("(", "[", "{"):
                    self.i += 1
                    return self.primary()
                return E("new", x, (), line)
            return E("var", x, (), line)
        raise Unreadable(f"line {line}: {x!r}")


def functions(source: str) -> list[Fn]:
    """Every named function of a file, in modules and in other functions too, and functions without a name inside them.

    A definition that can't be read is left out; the next let at the start of a line is tried again.
    """
    from .braces import lambdas_of

    toks = tokens(source)
    p = Parser(toks)
    while p.i < len(toks):
        if p.peek() != "let":
            p.i += 1
            continue
        start, kept = p.i, len(p.found)
        try:
            p.bindings()
            if p.peek() == "in":  # an expression among definitions
                p.i += 1
        except (Unreadable, IndexError, RecursionError, ValueError):
            del p.found[kept:]
            p.i = start + 1
            while p.i < len(toks) and p.peek() != "let":
                p.i += 1
    out: list[Fn] = []
    for f in sorted(p.found, key=lambda f: (f.line, -f.end)):
        out.append(f)
        for x in lambdas_of(f.body):
            out.append(x._replace(name=f"{f.name}::<lambda>", code_lines=x.end - x.line + 1, tokens=tuple(t.text for t in toks if x.line <= t.line <= x.end)))
    return out
