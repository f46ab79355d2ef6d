"""The small intermediate language that all front ends produce."""

from __future__ import annotations

from typing import NamedTuple


class E(NamedTuple):
    """An expression. Kinds: lit (name: kind of literal, text: value), var, op, call (name: callee; method calls have the receiver first),
    field, index, seq, lambda (fn), cast, new, pick (condition, then, else), unknown."""

    kind: str
    name: str = ""
    args: tuple = ()
    line: int = 0
    text: str = ""
    fn: object = None


class S(NamedTuple):
    """A statement. Kinds: assign (target, value), expr, if (cond, then, else), loop (init, cond, body, step), each (targets, over, body),
    return, throw, try (body, handlers), break, continue, region (body), leave (the innermost region)."""

    kind: str
    e: tuple = ()
    blocks: tuple = ()
    line: int = 0


class Fn(NamedTuple):
    name: str
    params: tuple[str, ...]
    body: tuple[S, ...]
    line: int
    end: int
    code_lines: int = 0
    tokens: tuple[str, ...] = ()
    types: tuple[str, ...] = ()


# Operators whose operands may trade places.
COMMUTATIVE = {"+", "*", "|", "^", "&", "and", "or", "xor", "==", "!=", "===", "!==", "is", "is not"}
SAME_OP = {"&&": "and", "||": "or", "===": "==", "!==": "!=", "is": "==", "is not": "!=", "!": "not"}


def shown(e: E) -> str:
    """An expression as text."""
    args = ", ".join(shown(a) if isinstance(a, E) else str(a) for a in e.args)
    if e.kind == "lit":
        return repr(e.text) if e.name in ("string", "char") else e.text or e.name
    if e.kind == "var":
        return e.name
    if e.kind == "lambda" or e.text == "block":
        fn = e.fn or e.args[0].fn
        return f"{'fn' if e.kind == 'lambda' else 'do'}({', '.join(fn.params)}) {{ {'; '.join(x.strip() for x in listing(fn.body))} }}"
    return f"{e.kind}{f'[{e.name}]' if e.name else ''}({args})"


def listing(body: tuple[S, ...], depth: int = 0) -> list[str]:
    """Statements as indented lines of text."""
    out, pad = [], "  " * depth
    for s in body:
        out.append(f"{pad}{s.kind} {' <- '.join(map(shown, s.e)) if s.kind == 'assign' else ', '.join(map(shown, s.e))}".rstrip())
        for k, b in enumerate(s.blocks):
            if k:
                out.append(f"{pad}--")
            out += listing(b, depth + 1)
    return out


def dump(fn: Fn) -> str:
    """A function's intermediate form."""
    return "\n".join([f"{fn.name}({', '.join(fn.params)})  # lines {fn.line} to {fn.end}", *listing(fn.body, 1)])
