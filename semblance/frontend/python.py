"""Python source to the intermediate language, with the standard parser."""

from __future__ import annotations

import ast
import io
import re
import tokenize

from .il import E, Fn, S

OPS = {
    ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%", ast.Pow: "**", ast.LShift: "<<", ast.RShift: ">>", ast.BitOr: "|", ast.BitXor: "^", ast.BitAnd: "&", ast.MatMult: "@",
    ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Is: "==", ast.IsNot: "!=", ast.In: "in", ast.NotIn: "not in", ast.And: "and", ast.Or: "or",
    ast.Not: "not", ast.USub: "neg", ast.UAdd: "pos", ast.Invert: "~",
}


def literal(v, line: int) -> E:
    kind = {bool: "bool", int: "int", float: "float", str: "string", bytes: "string", complex: "imag"}.get(type(v), "null")
    return E("lit", kind, (), line, str(v))


def expr(n: ast.AST | None) -> E:
    if n is None:
        return E("lit", "null")
    line = getattr(n, "lineno", 0)
    match n:
        case ast.Constant(value=v):
            return literal(v, line)
        case ast.Name(id=x):
            return E("var", x, (), line)
        case ast.BinOp(left=a, op=op, right=b):
            return E("op", OPS[type(op)], (expr(a), expr(b)), line)
        case ast.UnaryOp(op=op, operand=a):
            return E("op", OPS[type(op)], (expr(a),), line)
        case ast.BoolOp(op=op, values=vs):
            return E("op", OPS[type(op)], tuple(map(expr, vs)), line)
        case ast.Compare(left=a, ops=ops, comparators=bs):
            sides = [a, *bs]
            tests = [E("op", OPS[type(op)], (expr(x), expr(y)), line) for op, x, y in zip(ops, sides, bs, strict=False)]
            return tests[0] if len(tests) == 1 else E("op", "and", tuple(tests), line)
        case ast.Call(func=f, args=args, keywords=kw):
            rest = (*map(expr, args), *(expr(k.value) for k in kw))
            if isinstance(f, ast.Attribute):
                return E("call", f.attr, (expr(f.value), *rest), line, "method")
            return E("call", f.id, rest, line) if isinstance(f, ast.Name) else E("call", "", (expr(f), *rest), line, "dynamic")
        case ast.Attribute(value=v, attr=x):
            return E("field", x, (expr(v),), line)
        case ast.Subscript(value=v, slice=ast.Slice(lower=a, upper=b, step=c)):
            return E("index", "slice", (expr(v), *(expr(x) for x in (a, b, c) if x)), line)
        case ast.Subscript(value=v, slice=i):
            return E("index", "", (expr(v), expr(i)), line)
        case ast.List(elts=xs) | ast.Tuple(elts=xs) | ast.Set(elts=xs):
            return E("seq", type(n).__name__.lower(), tuple(map(expr, xs)), line)
        case ast.Dict(keys=ks, values=vs):
            return E("seq", "dict", tuple(expr(x) for k, v in zip(ks, vs, strict=True) for x in (k, v) if x), line)
        case ast.IfExp(test=c, body=a, orelse=b):
            return E("pick", "", (expr(c), expr(a), expr(b)), line)
        case ast.Lambda(args=a, body=b):
            return E("lambda", "", (), line, "", Fn("<lambda>", params(a), (S("return", (expr(b),), (), line),), line, n.end_lineno or line))
        case ast.ListComp(elt=x, generators=gs) | ast.SetComp(elt=x, generators=gs) | ast.GeneratorExp(elt=x, generators=gs):
            return comprehension((x,), gs, type(n).__name__.lower(), line)
        case ast.DictComp(key=k, value=v, generators=gs):
            return comprehension((k, v), gs, "dict", line)
        case ast.JoinedStr(values=vs):
            return E("op", "format", tuple(expr(v) for v in vs), line)
        case ast.FormattedValue(value=v) | ast.Await(value=v) | ast.Starred(value=v) | ast.YieldFrom(value=v):
            return expr(v)
        case ast.Yield(value=v):
            return E("op", "yield", (expr(v),), line)
        case ast.NamedExpr(target=t, value=v):
            return E("op", ":=", (expr(t), expr(v)), line)
    return E("unknown", type(n).__name__, (), line)


def comprehension(items, gens, kind: str, line: int) -> E:
    """A lambda of the loop variables over the sources, collected."""
    names = tuple(x.id for g in gens for x in ast.walk(g.target) if isinstance(x, ast.Name))
    guards = tuple(S("if", (expr(c),), ((), ()), line) for g in gens for c in g.ifs)
    value = expr(items[0]) if len(items) == 1 else E("seq", "pair", tuple(map(expr, items)), line)
    body = (*guards, S("return", (value,), (), line))
    return E("call", f"<{kind}>", (*(expr(g.iter) for g in gens), E("lambda", "", (), line, "", Fn("<lambda>", names, body, line, line))), line)


def params(a: ast.arguments) -> tuple[str, ...]:
    return tuple(x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])])


def block(ns) -> tuple[S, ...]:
    return tuple(s for n in ns for s in stmt(n))


def stmt(n: ast.stmt):
    line = n.lineno
    match n:
        case ast.Assign(targets=ts, value=v):
            yield from (S("assign", (expr(t), expr(v)), (), line) for t in ts)
        case ast.AnnAssign(target=t, value=v):
            if v:
                yield S("assign", (expr(t), expr(v)), (), line)
        case ast.AugAssign(target=t, op=op, value=v):
            yield S("assign", (expr(t), E("op", OPS[type(op)], (expr(t), expr(v)), line)), (), line)
        case ast.Expr(value=ast.Constant(value=str())):
            return
        case ast.Expr(value=v):
            yield S("expr", (expr(v),), (), line)
        case ast.If(test=c, body=a, orelse=b):
            yield S("if", (expr(c),), (block(a), block(b)), line)
        case ast.While(test=c, body=a, orelse=b):
            yield S("loop", (expr(c),), ((), block(a), ()), line)
            yield from block(b)
        case ast.For(target=t, iter=i, body=a, orelse=b) | ast.AsyncFor(target=t, iter=i, body=a, orelse=b):
            yield S("each", (expr(t), expr(i)), (block(a),), line)
            yield from block(b)
        case ast.Return(value=v):
            yield S("return", (expr(v),) if v else (), (), line)
        case ast.Raise(exc=x):
            yield S("throw", (expr(x),) if x else (), (), line)
        case ast.Assert(test=c):
            yield S("if", (expr(c),), ((), (S("throw", (), (), line),)), line)
        case ast.Try(body=a, handlers=hs, orelse=b, finalbody=f):
            yield S("try", (), (block(a) + block(b), *(block(h.body) for h in hs)), line)
            yield from block(f)
        case ast.With(items=items, body=a) | ast.AsyncWith(items=items, body=a):
            for x in items:
                v = expr(x.context_expr)
                yield S("assign", (expr(x.optional_vars), v), (), line) if x.optional_vars else S("expr", (v,), (), line)
            yield from block(a)
        case ast.Match(subject=x, cases=cs):
            rest: tuple[S, ...] = ()
            for c in reversed(cs):
                names = [m.name for m in ast.walk(c.pattern) if isinstance(m, ast.MatchAs) and m.name]
                bind = tuple(S("assign", (E("var", k), E("index", "case", (expr(x),), line)), (), line) for k in names)
                rest = (S("if", (E("op", "case", (expr(x),), line),), (bind + block(c.body), rest), line),)
            yield from rest
        case ast.FunctionDef(name=x) | ast.AsyncFunctionDef(name=x):
            yield S("assign", (E("var", x), E("lambda", "", (), line, "", function(n))), (), line)
        case ast.Break():
            yield S("break", (), (), line)
        case ast.Continue():
            yield S("continue", (), (), line)


def function(n, name: str = "") -> Fn:
    a = n.args
    every = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
    types = {x.arg: ast.unparse(x.annotation) for x in every if x.annotation}
    names = params(a)
    return Fn(name or n.name, names, block(n.body), n.lineno, n.end_lineno or n.lineno, types=tuple(types.get(x, "") for x in names))


#: What stands between lines and spaces in ASCII source without strings that have parts of their own.
TOKEN = re.compile(
    r"""(?P<space>[ \t\f]+|\\\n)|(?P<line>\n)|(?P<comment>\#[^\n]*)
  |(?P<string>(?:[bBuU]|[rR][bB]?|[bB][rR])?(?:\"{3}(?:[^\\]|\\.)*?\"{3}|'{3}(?:[^\\]|\\.)*?'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))
  |(?P<id>[A-Za-z_]\w*)|(?P<num>0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][-+]?\d(?:_?\d)*)?[jJ]?)
  |(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|>>|<<|[-+*/%&|^@=!<>]=|[-+*/%&|^@=<>~()\[\]{},:.;])""",
    re.X | re.S | re.A,
)
SKIPPED = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING, tokenize.ENDMARKER}
#: Formatted strings and line ends other than \n are left to the standard tokenizer.
PARTED = re.compile(r"""[fFtT][rR]?["']|[rR][fFtT]["']|[\r\0]""")


def tokens(source: str) -> list[tuple[str, int]]:
    """(text, line) of the tokens of source that parses, without comments and line ends."""
    if source.isascii() and not PARTED.search(source):
        out, line, at = [], 1, 0
        while (m := TOKEN.match(source, at)) is not None:
            kind, text, at = m.lastgroup, m[0], m.end()
            if kind not in ("space", "line", "comment"):
                out.append((text, line))
            if kind in ("space", "line", "string"):
                line += text.count("\n")
        if at == len(source):
            return out
    return [(t.string, t.start[0]) for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type not in SKIPPED]


def functions(source: str) -> list[Fn]:
    """Every function and lambda of a file; a lambda is named after the narrowest function around it."""
    tree = ast.parse(source)
    toks = tokens(source)
    docs: set[int] = set()
    out: list[Fn] = []
    # functions stand in statements, lambdas in expressions
    inside = ast.AST if "lambda" in source else (ast.stmt, ast.excepthandler, ast.match_case)

    def visit(n: ast.AST, parent: str) -> None:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Module)) and n.body and isinstance(n.body[0], ast.Expr) and isinstance(n.body[0].value, ast.Constant) and isinstance(n.body[0].value.value, str):
            docs.update(range(n.body[0].lineno, (n.body[0].end_lineno or n.body[0].lineno) + 1))
        held = (getattr(n, f, None) for f in n._fields)
        for x in [x for v in held for x in (v if isinstance(v, list) else (v,)) if isinstance(x, inside)]:
            name = parent
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(function(x))
                name = x.name
            elif isinstance(x, ast.Lambda):
                out.append(expr(x).fn._replace(name=f"{parent}::<lambda>" if parent else "<lambda>"))
            visit(x, name)

    visit(tree, "")
    for k, f in enumerate(out):
        mine = [t for t in toks if f.line <= t[1] <= f.end and t[1] not in docs]
        out[k] = f._replace(code_lines=len({t[1] for t in mine}), tokens=tuple(t[0] for t in mine))
    return out
