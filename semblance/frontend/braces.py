"""Rust, JavaScript, TypeScript, Go, C, C++ and Java source to the intermediate language.

One tolerant parser reads what these share: functions, statements and expressions in braces. What it can't
read becomes an ``unknown`` expression that still carries the operands before it; the rest of the function goes on.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from .il import SAME_OP, E, Fn, S

TOKEN = re.compile(
    r"""(?:(?P<punct>[;,(){}\[\]])|(?P<word>[AC-KM-Zac-qstv-z_$][\w$]*)|(?P<comment>//[^\n]*|/\*.*?\*/|^\#[^\n]*(?:\\\n[^\n]*)*)|(?P<space>[^\S\n]+)|(?P<line>\n)
  |(?P<string>b?r\#*"(?:.|\n)*?"\#*|(?:[bLu]|u8)?"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`)|(?P<char>b?'(?:\\(?:u\{[^}]*\}|.)[^']*|[^\\'\n])')|(?P<single>'(?:\\.|[^'\\\n])*')|(?P<life>'[A-Za-z_]\w*)
  |(?P<num>0[xXbo][\da-fA-F_]+\w*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[A-Za-z_]*\d*)|(?P<id>[A-Za-z_$][\w$]*)
  |(?P<op>>>>=|<<=|>>=|\.\.\.|\.\.=|===|!==|\*\*|=>|->|::|:=|&&|\|\||<-|\+\+|--|[-+*/%&|^]=|[=!<>]=|<<|\?\?|\?\.|\.\.|[-+*/%&|^!~<>=?:;,.(){}\[\]@\#])|(?P<other>.))[^\S\n]*""",
    re.X | re.S | re.M,
)
CONTROL = {"if", "for", "while", "switch", "match", "return", "catch", "else", "do", "loop", "sizeof", "new", "function", "func", "fn", "throw", "await", "typeof", "case", "default", "unsafe", "defer", "go", "delete", "using", "synchronized"}
BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 5, "^": 6, "&": 7, "==": 8, "!=": 8, "===": 8, "!==": 8, "<": 9, ">": 9, "<=": 9, ">=": 9, "instanceof": 9, "in": 9,
    "..": 4, "..=": 4, "<<": 10, "+": 11, "-": 11, "*": 12, "/": 12, "%": 12, "**": 13,
}
ASSIGN = {"=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "??="}
MODIFIERS = {"mut", "ref", "const", "let", "var", "final", "static", "unsafe", "async", "volatile", "register"}
OPENING, CLOSING = {"(", "[", "{"}, {")", "]", "}"}
NULLS = {"null", "nil", "None", "undefined", "NULL", "nullptr"}


class Tok(NamedTuple):
    kind: str
    text: str
    line: int


class Unreadable(Exception):
    pass


def tokens(source: str, lang: str) -> list[Tok]:
    out: list[Tok] = []
    line, parens, broke = 1, 0, False
    ends = lang in ("go", "js")
    # what can begin nothing else is looked for first
    kinds = {"word": "id", "punct": "op", "single": "string" if lang == "js" else "char"}
    for m in TOKEN.finditer(source):
        kind = m.lastgroup
        if kind == "space":
            continue
        text = m[kind]
        if kind in ("comment", "line"):
            broke |= "\n" in text
            line += text.count("\n")
            continue
        if ends and broke and out and not parens:
            last = out[-1]
            closes = last.kind in ("id", "num", "string", "char", "single") or last.text in (")", "]", "}", "++", "--")
            goes_on = lang == "js" and text in (".", ")", "]", ",", "?", ":", "&&", "||", "+", "-", "*", "/", "=", "=>", "{", "?.", "??")
            if closes and last.text not in CONTROL - {"return"} and not goes_on:
                out.append(Tok("op", ";", last.line))
        broke = False
        kind = kinds.get(kind, kind)
        out.append(Tok(kind, text, line))
        if kind == "id":
            continue
        if text in ("(", "["):
            parens += 1
        elif text in (")", "]"):
            parens = max(0, parens - 1)
        elif kind in ("string", "char"):
            line += text.count("\n")
    return out


class Parser:
    def __init__(self, toks: list[Tok], lang: str):
        self.t, self.i, self.lang = toks, 0, lang
        self.kinds, self.texts, self.lines = ([t[k] for t in toks] for k in range(3))
        # by the place of an opening bracket that of the closing one
        self.closed: dict[int, int] = {}
        around: list[int] = []
        for k, x in enumerate(self.texts):
            if x in OPENING and self.kinds[k] == "op":
                around.append(k)
            elif x in CLOSING and around and self.kinds[k] == "op":
                self.closed[around.pop()] = k

    # tokens
    def peek(self, k: int = 0) -> str:
        try:
            return self.texts[self.i + k]
        except IndexError:
            return ""

    def kind(self, k: int = 0) -> str:
        try:
            return self.kinds[self.i + k]
        except IndexError:
            return ""

    @property
    def line(self) -> int:
        try:
            return self.lines[self.i]
        except IndexError:
            return self.lines[-1]

    def take(self, text: str = "") -> str:
        if self.i >= len(self.texts) or (text and self.texts[self.i] != text):
            raise Unreadable(f"line {self.line}: {text or 'more'} expected")
        self.i += 1
        return self.texts[self.i - 1]

    def got(self, *texts: str) -> bool:
        i = self.i
        if i < len(self.texts) and self.texts[i] in texts and self.kinds[i] not in ("string", "char"):
            self.i += 1
            return True
        return False

    def close(self, at: int) -> int:
        """The place of the bracket that closes the one at ``at``."""
        if at in self.closed:
            return self.closed[at]
        depth, pairs = 0, {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}
        for k in range(at, len(self.t)):
            if self.t[k].kind == "op":
                depth += pairs.get(self.t[k].text, 0)
                if not depth:
                    return k
        raise Unreadable("a bracket isn't closed")

    def skip_type(self, stops: set[str]) -> None:
        depth = 0
        while self.i < len(self.t):
            x = self.peek()
            if depth <= 0 and x in stops:
                return
            if x in ("(", "["):
                self.i = self.close(self.i)
            elif x == "{" and self.peek(-1) in ("interface", "struct"):
                self.i = self.close(self.i)
            elif x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
            self.i += 1

    # blocks and statements
    def block(self) -> tuple[S, ...]:
        end = self.close(self.i)
        self.take("{")
        out: list[S] = []
        while self.i < end:
            at = self.i
            try:
                out += self.statement()
            except Unreadable:
                self.i = max(self.i, at)
            if self.i == at or self.i > end:
                # to the end of what can't be read
                self.i = max(at, min(self.i, end))
                out.append(S("expr", (E("unknown", "", (), self.line),), (), self.line))
                while self.i < end and self.peek() != ";":
                    self.i = self.close(self.i) + 1 if self.peek() in ("(", "[", "{") else self.i + 1
        self.i = end + 1
        return tuple(out)

    def body(self) -> tuple[S, ...]:
        return self.block() if self.peek() == "{" else tuple(self.statement())

    def names_in(self, start: int, end: int) -> list[str]:
        """Names that a pattern binds: lower-case identifiers that are not paths, calls or keywords."""
        out = []
        for k in range(start, end):
            x, after = self.t[k], self.t[k + 1].text if k + 1 < len(self.t) else ""
            if x.kind == "id" and x.text not in MODIFIERS and x.text not in ("_", "true", "false") and after not in ("(", "::", "{") and not (x.text[0].isupper() and self.lang == "rust") and self.t[k - 1].text != "::":
                out.append(x.text)
        return out

    def target(self, names: list[str], line: int) -> E:
        vs = tuple(E("var", n, (), line) for n in names)
        return vs[0] if len(vs) == 1 else E("seq", "tuple", vs, line)

    def statement(self) -> list[S]:
        line, x = self.line, self.peek()
        if self.kind() in ("string", "char"):
            x = ""
        if x == ";":
            self.take()
            return []
        if x == "{":
            return list(self.block())
        if x in ("if", "while"):
            self.take()
            init: list[S] = []
            if self.lang == "go" and self._semicolon_first():
                init = self.simple()
                self.take(";")
            binds, cond = self.condition()
            if x == "while":
                return [*init, S("loop", (cond,), ((), tuple(binds) + self.body(), ()), line)]
            then, other = tuple(binds) + self.body(), ()
            self.i += self.peek() == ";" and self.peek(1) == "else"
            if self.got("else"):
                other = self.body()
            return [*init, S("if", (cond,), (then, other), line)]
        if x in ("loop", "do"):
            self.take()
            body, cond = self.body(), E("lit", "bool", (), line, "true")
            if x == "do" and self.got("while"):
                cond = self.condition()[1]
            return [S("loop", (cond,), ((), body, ()), line)]
        if x == "for":
            return self.for_loop()
        if x in ("match", "switch", "select"):
            return self.cases()
        if x in ("return", "throw", "break", "continue", "yield", "defer", "go"):
            self.take()
            if x in ("defer", "go"):
                return self.simple()
            e = () if self.peek() in (";", "}", "") else (self.comma_list(),)
            self.got(";")
            return [S("return" if x == "return" else "throw" if x == "throw" else "expr" if x == "yield" else x, () if x in ("break", "continue") else e, (), line)]
        if x == "try" and self.peek(1) == "{":
            self.take()
            blocks = [self.block()]
            while self.got("catch"):
                if self.peek() == "(":
                    self.i = self.close(self.i) + 1
                blocks.append(self.block())
            tail = list(self.block()) if self.got("finally") else []
            return [S("try", (), tuple(blocks), line), *tail]
        if x in ("unsafe", "async") and self.peek(1) == "{":
            self.take()
            return list(self.block())
        if x == "let" or x in ("const", "var") and self.lang in ("js", "go"):
            return self.declare()
        if x in ("fn", "function", "func") and self.kind(1) == "id":
            f = function_at(self, self.i)
            if f:
                return [S("assign", (E("var", f.name), E("lambda", "", (), line, "", f)), (), line)]
        if self.lang in ("c", "cpp", "java") and (k := self._declared()):
            return self.typed(k)
        out = self.simple()
        self.got(";")
        return out

    def _semicolon_first(self) -> bool:
        k = self.i
        while k < len(self.t) and self.t[k].text not in ("{", ";"):
            k = self.close(k) if self.t[k].text in ("(", "[") else k
            k += 1
        return k < len(self.t) and self.t[k].text == ";"

    def condition(self) -> tuple[list[S], E]:
        if self.got("let"):  # a pattern against a value
            start, line = self.i, self.line
            while self.peek() != "=":
                self.i = self.close(self.i) + 1 if self.peek() in ("(", "[", "{") else self.i + 1
            names = self.names_in(start, self.i)
            self.take("=")
            v = self.expr(no_struct=True)
            return [S("assign", (E("var", n, (), line), E("index", "case", (v,), line)), (), line) for n in names], E("op", "case", (v,), line)
        return [], self.expr(no_struct=True)

    def for_loop(self) -> list[S]:
        line = self.line
        self.take("for")
        self.got("await")
        paren = self.lang not in ("rust", "go") and self.peek() == "("
        if paren:
            end = self.close(self.i)
            self.take("(")
        else:
            end = self.i
            while self.t[end].text != "{":
                end = self.close(end) if self.t[end].text in ("(", "[") else end
                end += 1
        inside = [self.t[k].text for k in range(self.i, end)]
        mark = next((w for w in ("in", "of", "range", ":") if w in inside and (w != ":" or self.lang in ("java", "cpp"))), None)
        if mark and ";" not in inside:
            at = self.i + inside.index(mark)
            stop = at - 1 if mark == "range" and self.t[at - 1].text in (":=", "=") else at
            names = self.names_in(self.i, stop)
            if self.lang in ("java", "cpp"):
                names = names[-1:]
            if self.lang == "go":
                names = [n for n in names if n != "_"]
            self.i = at + 1
            over = self.expr(no_struct=not paren)
            self.i = end + paren
            return [S("each", (self.target(names or ["_"], line), over), (self.body(),), line)]
        init, cond, step = [], E("lit", "bool", (), line, "true"), []
        if ";" in inside:
            init = [] if self.peek() == ";" else self.statement_before(";")
            self.got(";")
            if self.peek() != ";":
                cond = self.expr(no_struct=not paren)
            self.got(";")
            if self.i < end:
                step = self.simple(stop=end)
        elif inside:
            cond = self.expr(no_struct=True)
        self.i = end + paren
        return [*init, S("loop", (cond,), ((), self.body(), tuple(step)), line)]

    def statement_before(self, end: str) -> list[S]:
        if self.peek() in ("let", "const", "var"):
            return self.declare()
        if self.lang in ("c", "cpp", "java") and (k := self._declared()):
            return self.typed(k)
        return self.simple()

    def cases(self) -> list[S]:
        line, word = self.line, self.take()
        subject = E("lit", "bool", (), line, "true") if self.peek() == "{" else self.expr(no_struct=True)
        end = self.close(self.i)
        self.take("{")
        arms: list[tuple[list[str], E, tuple[S, ...]]] = []
        while self.i < end:
            start = self.i
            if word == "match":
                while self.i < end and self.peek() != "=>":
                    self.i = self.close(self.i) + 1 if self.peek() in ("(", "[", "{") else self.i + 1
                names, guard = self.names_in(start, self.i), E("op", "case", (subject,), self.line)
                texts = [self.t[k].text for k in range(start, self.i)]
                if "if" in texts:
                    after = self.i
                    self.i = start + texts.index("if") + 1
                    names = self.names_in(start, self.i - 1)
                    guard = E("op", "and", (guard, self.expr(no_struct=True)), self.line)
                    self.i = after
                self.take("=>")
                arms.append((names, guard, self.block() if self.peek() == "{" else tuple(self.arm())))
                self.got(",")
            else:
                test = ()
                if self.got("case"):
                    test = (self.comma_list(stop=":"),)
                elif not self.got("default"):
                    self.i += 1
                    continue
                if not self.got(":"):
                    self.got("->")
                out: list[S] = []
                while self.i < end and self.peek() not in ("case", "default"):
                    at = self.i
                    out += self.statement()
                    if self.i == at:
                        raise Unreadable("case")
                arms.append(([], E("op", "==", (subject, *test), line) if test else E("op", "case", (subject,), line), tuple(leaving(s) for s in out if s.kind != "break")))
        self.i = end + 1
        rest: tuple[S, ...] = ()
        for names, guard, body in reversed(arms):
            bind = tuple(S("assign", (E("var", n), E("index", "case", (subject,), line)), (), line) for n in names)
            rest = (S("if", (guard,), (bind + body, rest), line),)
        return list(rest) if word == "match" else [S("region", (), (rest,), line)]

    def arm(self) -> list[S]:
        return self.simple() if self.peek() not in ("return", "break", "continue", "if", "match") else self.statement()

    def declare(self) -> list[S]:
        word, line = self.take(), self.line
        start = self.i
        while self.peek() not in ("=", ";", ":", "", "}") and not (self.lang == "go" and self.kind() == "id" and self.kind(-1) == "id" and self.peek(-1) != word):
            self.i = self.close(self.i) + 1 if self.peek() in ("(", "[", "{") else self.i + 1
        names = self.names_in(start, self.i)
        if self.peek() not in ("=", ";"):
            self.skip_type({"=", ";"})
        if not self.got("="):
            self.got(";")
            return [S("assign", (E("var", n, (), line), E("lit", "null", (), line)), (), line) for n in names] if self.lang != "rust" else []
        v = self.comma_list() if self.lang == "go" else self.expr()
        out = [S("assign", (self.target(names or ["_"], line), v), (), line)]
        if self.got("else"):  # let ... else
            out.append(S("if", (E("op", "case", (v,), line),), ((), self.block()), line))
        while self.got(","):
            out += self.simple()
        self.got(";")
        return out

    def _declared(self) -> int:
        """Offset of the name if a typed declaration starts here, else 0."""
        k, words = self.i, 0
        while k < len(self.t):
            x = self.t[k]
            if x.kind == "id" and x.text not in CONTROL:
                if words and k + 1 < len(self.t) and self.t[k + 1].text in ("=", ";", ",", "[", "{") and (self.t[k - 1].kind == "id" or self.t[k - 1].text in ("*", "&", ">", "]")):
                    return k - self.i
                words += 1
            elif x.text == "<":
                depth = 0
                while k < len(self.t) and self.t[k].text not in (";", "{", "("):
                    depth += {"<": 1, ">": -1}.get(self.t[k].text, 0)
                    if not depth:
                        break
                    k += 1
            elif not (words and x.text in ("*", "&", "::", ".", "[", "]")):
                return 0
            k += 1
        return 0

    def typed(self, k: int) -> list[S]:
        self.i += k
        out: list[S] = []
        while True:
            line, name = self.line, self.take()
            while self.peek() == "[":
                self.i = self.close(self.i) + 1
            v = E("lit", "null", (), line)
            if self.got("="):
                v = self.expr()
                out.append(S("assign", (E("var", name, (), line), v), (), line))
            elif self.peek() == "{":
                self.i = self.close(self.i) + 1
            if not self.got(","):
                break
            while self.got("*", "&"):
                pass
        self.got(";")
        return out

    def comma_list(self, stop: str = "") -> E:
        line, xs = self.line, [self.expr()]
        while self.got(","):
            xs.append(self.expr())
        return xs[0] if len(xs) == 1 else E("seq", "tuple", tuple(xs), line)

    def simple(self, stop: int = 0) -> list[S]:
        line, left = self.line, self.comma_list() if self.lang == "go" else self.expr(no_struct=self.lang == "rust" and self.peek() in ("if", "match"))
        if self.peek() in ASSIGN and self.kind() == "op":
            op = self.take()
            right = self.comma_list() if self.lang == "go" else self.expr()
            if self.peek() in ASSIGN and self.kind() == "op":  # a = b = c
                more = self.take()
                value = self.expr()
                return [S("assign", (right, value), (), line), S("assign", (left, value if more == "=" else right), (), line)]
            if op not in ("=", ":="):
                right = E("op", op[:-1], (left, right), line)
            return [S("assign", (left, right), (), line)]
        if self.got("++", "--"):
            return [S("assign", (left, E("op", "+" if self.peek(-1) == "++" else "-", (left, E("lit", "int", (), line, "1")), line)), (), line)]
        if self.got(","):
            return [S("expr", (left,), (), line), *self.simple()]
        return [S("expr", (left,), (), line)]

    # expressions
    def expr(self, level: int = 0, no_struct: bool = False) -> E:
        left = self.unary(no_struct)
        while True:
            op, line = self.peek(), self.line
            if self.kind() in ("string", "char"):
                return left
            if op == "as" and self.lang in ("rust", "js"):
                self.take()
                start = self.i
                self._type_name()
                left = E("cast", self.t[start].text, (left,), line)
                continue
            if op == "?" and self.lang not in ("rust", "go") and level == 0:
                self.take()
                a = self.expr()
                self.take(":")
                left = E("pick", "", (left, a, self.expr()), line)
                continue
            if op == ">" and self.peek(1) == ">":
                power = 10
                if power < level:
                    return left
                self.i += 2
                left = E("op", ">>", (left, self.expr(power + 1, no_struct)), line)
                continue
            power = BINARY.get(op)
            if power is None or power < level or op == "in" and self.lang != "js":
                return left
            self.take()
            if op in ("..", "..=") and self.peek() in (")", "]", "{", ",", ";"):
                left = E("op", op, (left,), line)
                continue
            left = E("op", SAME_OP.get(op, op), (left, self.expr(power + 1, no_struct)), line)

    def _type_name(self) -> None:
        while self.got("&", "*", "mut", "const", "dyn"):
            pass
        self.take()
        while self.got("::", "."):
            self.take()
        if self.peek() == "<":
            depth = 0
            while self.i < len(self.t):
                depth += {"<": 1, ">": -1}.get(self.peek(), 0)
                self.take()
                if not depth:
                    return

    def unary(self, no_struct: bool) -> E:
        op, line = self.peek(), self.line
        if self.kind() == "op" and op in ("!", "-", "~", "+"):
            self.take()
            return E("op", {"!": "not", "-": "neg", "+": "pos"}.get(op, op), (self.unary(no_struct),), line)
        if self.kind() == "op" and op in ("&", "*", "&&", "..", "...", "<-"):
            self.take()
            while self.got("mut", "raw", "const"):
                pass
            return self.unary(no_struct)
        if op in ("++", "--"):
            self.take()
            return E("op", op[0], (self.unary(no_struct), E("lit", "int", (), line, "1")), line)
        if op in ("await", "typeof", "void", "delete", "move", "box") and self.kind() == "id":
            self.take()
            return self.unary(no_struct)
        if op in ("new",) and self.kind() == "id" and self.lang != "go":
            self.take()
            e = self.postfix(self.primary(no_struct), no_struct)
            return E("new", e.name, e.args, line)
        return self.postfix(self.primary(no_struct), no_struct)

    def arguments(self, closing: str) -> tuple[E, ...]:
        out = []
        while self.peek() != closing:
            if self.kind() == "id" and self.peek(1) == ":" and self.peek(2) != ":" and closing == "}":
                self.i += 2
            at = self.i
            try:
                out.append(self.expr())
            except Unreadable:
                self.i = at
            if self.peek() not in (",", closing):
                # something else stands here: it counts as unknown up to the next comma
                out.append(E("unknown", "", (), self.line))
                while self.peek() not in (",", closing):
                    if not self.peek():
                        raise Unreadable("arguments")
                    self.i = self.close(self.i) + 1 if self.peek() in ("(", "[", "{") else self.i + 1
            self.got(",")
        self.take(closing)
        return tuple(out)

    def postfix(self, e: E, no_struct: bool) -> E:
        while True:
            line, x = self.line, self.peek()
            if self.kind() in ("string", "char"):
                return e
            if x == "(":
                self.take()
                args = self.arguments(")")
                if e.kind == "field":
                    e = E("call", e.name, (*e.args, *args), line, "method")
                elif e.kind == "var":
                    e = E("call", e.name, args, line)
                else:
                    e = E("call", "", (e, *args), line, "dynamic")
            elif x in (".", "?.", "->") and (x != "->" or self.lang in ("c", "cpp")):
                self.take()
                if self.peek() == "[":
                    continue
                name = self.take()
                if self.got("::"):
                    self._generics()
                e = E("op", "await", (e,), line) if name == "await" else E("field", name, (e,), line)
            elif x == "[":
                self.take()
                args = []
                while self.peek() != "]":
                    if not self.got(":"):
                        args.append(self.expr())
                self.take("]")
                e = E("index", "slice" if len(args) != 1 else "", (e, *args), line)
            elif x == "?" and self.lang == "rust":
                self.take()
                e = E("op", "try", (e,), line)
            elif x == "!" and self.lang == "rust" and e.kind == "var" and self.peek(1) in ("(", "[", "{"):
                self.take()
                closing = {"(": ")", "[": "]", "{": "}"}[self.take()]
                e = E("call", e.name + "!", self.arguments(closing), line, "macro")
            elif x == "::" and self.kind() == "op":
                self.take()
                if self.peek() == "<":
                    self._generics()
                else:
                    e = E("var", self.take(), (), line, "path")
            elif x == "{" and not no_struct and self.lang in ("rust", "go", "cpp") and e.kind in ("var", "index") and (e.name[:1].isupper() or e.text == "path"):
                self.take()
                e = E("seq", "struct", self.arguments("}"), line)
            elif x in ("++", "--") and self.peek(1) in (")", "]", ",", "+", "-", "*", "<", ">", "=="):
                self.take()
                e = E("op", x[0], (e, E("lit", "int", (), line, "1")), line)
            else:
                return e

    def _generics(self) -> None:
        depth = 0
        while self.peek() and (depth or self.peek() == "<"):
            depth += {"<": 1, ">": -1}.get(self.peek(), 0)
            self.take()

    def primary(self, no_struct: bool) -> E:
        kind, x, line = self.kind(), self.peek(), self.line
        if kind == "num":
            self.take()
            real = ("." in x or "f32" in x or "f64" in x or ("e" in x.lower() and not x.lower().startswith("0x"))) and not x.lower().startswith("0x")
            return E("lit", "float" if real else "int", (), line, re.sub(r"(?<=\d)_?(?:[iuf](?:8|16|32|64|128|size)|usize|isize|[uUlLfF]+)$|_", "", x))
        if kind in ("string", "char"):
            self.take()
            return E("lit", kind, (), line, x.strip("\"'`"))
        if kind == "life":
            self.take()
            self.got(":")
            return self.primary(no_struct)
        if x == "(":
            if self.lang == "js" and self.t[self.close(self.i) + 1 : self.close(self.i) + 2] and self.t[self.close(self.i) + 1].text == "=>":
                return self.arrow()
            end = self.close(self.i)
            inside = self.t[self.i + 1 : end]
            if self.lang in ("c", "cpp", "java") and inside and all(t.kind == "id" or t.text in ("*", "::") for t in inside) and end + 1 < len(self.t) and (self.t[end + 1].kind in ("id", "num") or self.t[end + 1].text == "("):
                self.i = end + 1
                return E("cast", inside[0].text, (self.unary(no_struct),), line)
            self.take()
            xs = self.arguments(")")
            return xs[0] if len(xs) == 1 else E("seq", "tuple", xs, line)
        if x == "[":
            if self.lang == "go":  # a type: []T(...) or []T{...}
                self.i = self.close(self.i) + 1
                self._type_name()
                if self.peek() == "{":
                    self.take()
                    return E("seq", "list", self.arguments("}"), line)
                self.take("(")
                return E("cast", "slice", self.arguments(")"), line)
            if self.lang == "cpp":
                return self.closure_cpp()
            self.take()
            xs = []
            while self.peek() != "]":
                xs.append(self.expr())
                self.got(",", ";")
            self.take("]")
            return E("seq", "list", tuple(xs), line)
        if x == "{":
            if self.lang == "js":
                self.take()
                return E("seq", "dict", self.arguments("}"), line)
            return self.as_value(self.block(), line)
        if x in ("|", "||") and self.lang == "rust":
            names = []
            if self.take() == "|":
                start = self.i
                while self.peek() != "|":
                    self.i += 1
                names = self.names_in(start, self.i)
                self.take("|")
            if self.got("->"):
                self.skip_type({"{"})
            body = tail_returns(self.block()) if self.peek() == "{" else (S("return", (self.expr(no_struct=no_struct),), (), line),)
            return E("lambda", "", (), line, "", Fn("<lambda>", tuple(names), body, line, self.line))
        if kind == "id":
            if x in ("if", "match", "unsafe", "loop") and self.lang == "rust":
                return self.as_value(tuple(self.statement()), line)
            if x in ("function", "func", "async") and (self.peek(1) in ("(", "function") or self.kind(1) == "id" and x == "function"):
                f = function_at(self, self.i + (x == "async"))
                if f:
                    return E("lambda", "", (), line, "", f)
            if self.lang == "js" and self.peek(1) == "=>":
                return self.arrow()
            self.take()
            if x in ("true", "false", "True", "False"):
                return E("lit", "bool", (), line, x)
            if x in NULLS:
                return E("lit", "null", (), line)
            if x in ("map", "chan") and self.lang == "go" and self.peek() == "[":
                self.skip_type({"{", ")", ","})
                return E("seq", "dict", self._braced(), line)
            return E("var", x, (), line)
        raise Unreadable(f"line {line}: {x!r}")

    def _braced(self) -> tuple[E, ...]:
        if self.peek() != "{":
            return ()
        self.take()
        return self.arguments("}")

    def closure_cpp(self) -> E:
        line = self.line
        self.i = self.close(self.i) + 1
        names: list[str] = []
        if self.peek() == "(":
            names = param_names(self, self.i)
            self.i = self.close(self.i) + 1
        self.skip_type({"{"})
        return E("lambda", "", (), line, "", Fn("<lambda>", tuple(names), self.block(), line, self.line))

    def arrow(self) -> E:
        line = self.line
        if self.peek() == "(":
            names = param_names(self, self.i)
            self.i = self.close(self.i) + 1
        else:
            names = [self.take()]
        self.take("=>")
        body = self.block() if self.peek() == "{" else (S("return", (self.expr(),), (), line),)
        return E("lambda", "", (), line, "", Fn("<lambda>", tuple(names), body, line, self.t[self.i - 1].line))

    def as_value(self, body: tuple[S, ...], line: int) -> E:
        """A block, if or match where a value is wanted: a lambda called at once."""
        return E("call", "<block>", (E("lambda", "", (), line, "", Fn("<block>", (), tail_returns(body), line, self.line)),), line, "block")


def leaving(s: S) -> S:
    """A statement of a switch: a break in it, but for those of loops and switches inside, leaves the switch."""
    if s.kind == "break":
        return s._replace(kind="leave")
    return s if s.kind in ("loop", "each", "region") else s._replace(blocks=tuple(tuple(map(leaving, b)) for b in s.blocks))


def lambdas_of(body: tuple[S, ...], out: list[Fn] | None = None) -> list[Fn]:
    """Functions without a name in some statements, the inner ones after those around them; named ones are units of their own."""
    out = [] if out is None else out

    def of(e: E) -> None:
        if e.fn is not None:
            if e.fn.name == "<lambda>":
                out.append(e.fn)
            if e.fn.name in ("<lambda>", "<block>"):
                lambdas_of(e.fn.body, out)
        for a in e.args:
            if isinstance(a, E) and (a.args or a.fn is not None):
                of(a)

    for s in body:
        for e in s.e:
            if e.args or e.fn is not None:
                of(e)
        for b in s.blocks:
            lambdas_of(b, out)
    return out


def tail_returns(body: tuple[S, ...]) -> tuple[S, ...]:
    """Marks what stands last as the value returned."""
    if not body:
        return body
    *rest, last = body
    if last.kind == "expr" and not (last.e and last.e[0].kind == "unknown"):
        e = last.e[0]
        if e.text == "block" and e.args and e.args[0].fn:
            return (*rest, *e.args[0].fn.body)
        last = S("return", last.e, (), last.line)
    elif last.kind == "if":
        last = last._replace(blocks=tuple(map(tail_returns, last.blocks)))
    return (*rest, last)


def param_names(p: Parser, at: int) -> list[str]:
    end, out, part = p.close(at), [], []

    def done() -> None:
        ids = [t.text for t in part if t.kind == "id" and t.text not in MODIFIERS]
        texts = [t.text for t in part]
        if "..." in texts and p.lang == "js" and ids:
            out.append(ids[0])
        elif ids == ["self"] or ids[:1] == ["self"] or ids[:1] == ["this"]:
            out.append(ids[0])
        elif ids and (p.lang in ("rust", "js", "go")):
            out.append(ids[0])
        elif len(ids) > 1:
            cut = texts.index("[") if "[" in texts else len(texts)
            out.append([t.text for t in part[:cut] if t.kind == "id"][-1])

    k = at + 1
    while k < end:
        x = p.t[k]
        if x.text in ("(", "[", "{"):
            stop = p.close(k)
            part += p.t[k : stop + 1]
            k = stop
        elif x.text == ",":
            done()
            part = []
        else:
            part.append(x)
        k += 1
    done()
    return out


def function_at(p: Parser, at: int, arrow_name: str = "") -> Fn | None:
    """The function whose keyword or name stands at ``at``; the parser ends behind it."""
    k, line = at, p.t[at].line
    if p.t[k].text in ("fn", "function", "func"):
        k += 1
        if p.t[k].text == "*":
            k += 1
        if p.lang == "go" and p.t[k].text == "(" and p.t[p.close(k) + 1].kind == "id":
            k = p.close(k) + 1
    name = p.t[k].text if p.t[k].kind == "id" else "<lambda>"
    k += p.t[k].kind == "id"
    if p.t[k].text == "<" or (p.lang == "go" and p.t[k].text == "["):
        p.i = k
        p.skip_type({"("})
        k = p.i
    if p.t[k].text != "(":
        return None
    params = param_names(p, k)
    k = p.close(k) + 1
    while k < len(p.t) and p.t[k].text != "{":
        if p.t[k].text in (";", "}", "=") and p.lang != "rust" or p.t[k].text == ";":
            return None
        if p.t[k].text in ("(", "["):
            k = p.close(k)
        if p.t[k].text in ("interface", "struct") and p.t[k + 1].text == "{":
            k = p.close(k + 1)
        k += 1
    if k >= len(p.t):
        return None
    p.i, end = k, p.close(k)
    body = p.block()
    return Fn(name, tuple(params), tail_returns(body) if p.lang == "rust" else body, line, p.t[end].line)


def functions(source: str, lang: str) -> list[Fn]:
    """Every named function of a file, nested ones too, and the functions without a name inside them; lines stand for the tokens of these."""
    toks = tokens(source, lang)
    p, out = Parser(toks, lang), []
    words = {"rust": ("fn",), "go": ("func",), "js": ("function",)}.get(lang, ())
    for k, t in enumerate(toks):
        if t.kind != "id" or k + 1 >= len(toks):
            continue
        f = None
        try:
            if t.text in words:
                f = function_at(p, k) if toks[k + 1].kind == "id" or lang == "go" and toks[k + 1].text == "(" else None
            elif lang == "js" and t.text in ("const", "let", "var") and k + 3 < len(toks) and toks[k + 2].text == "=":
                at = k + 3 + (toks[k + 3].text == "async")
                p.i = at
                if toks[at].text == "(" and toks[p.close(at) + 1].text == "=>" or toks[at].kind == "id" and toks[at + 1].text == "=>":
                    e = p.arrow()
                    f = e.fn._replace(name=toks[k + 1].text, line=t.line)
            elif lang in ("c", "cpp", "java", "js") and toks[k + 1].text == "(" and t.text not in CONTROL and k:
                before = toks[k - 1]
                method = lang == "js" and before.text in ("{", "}", ";", "async", "static", "get", "set")
                typed = lang != "js" and (before.kind == "id" and before.text not in CONTROL or before.text in ("*", "&", ">", "::", "]", "~"))
                if method or typed:
                    f = function_at(p, k)
        except (Unreadable, IndexError, RecursionError):
            f = None
        if f and f.name != "<lambda>":
            mine = toks[k : p.i]
            out.append(f._replace(code_lines=len(set(p.lines[k : p.i])), tokens=tuple(p.texts[k : p.i])))
            for x in lambdas_of(f.body):
                part = [y for y in mine if x.line <= y.line <= x.end]
                out.append(x._replace(name=f"{f.name}::<lambda>", code_lines=len({y.line for y in part}), tokens=tuple(y.text for y in part)))
    return out
