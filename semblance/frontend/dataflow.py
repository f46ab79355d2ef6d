"""Data-flow graphs of functions, hashed with their surroundings.

The graph is built while walking the structured statements: an environment maps each variable to the node of its
value; branches that meet and loop heads get a merge node for each variable whose values differ. So names
vanish, copies cost nothing, and the order of independent statements does not matter.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..functions.hashing import MASK62, feed, mix, mix_pos
from .il import COMMUTATIVE, SAME_OP, E, Fn, S


@dataclass(frozen=True)
class Channels:
    """What a hash may see beyond structure."""

    call_names: bool = True
    int_values: bool = True
    strings: bool = False
    fields: bool = False
    floats: bool = False
    types: bool = False
    param_pos: bool = False
    thru_copies: bool = False
    exp_nodes: bool = True
    rounds: int = 1

    @property
    def bits(self) -> int:
        return sum(1 << k for k, x in enumerate((self.call_names, self.int_values, self.strings, self.fields, self.floats, self.types, self.param_pos, self.thru_copies, not self.exp_nodes)) if x) | self.rounds << 8


# Channels and rounds by language.
BASE = {
    "rust": Channels(rounds=2), "python": Channels(strings=True, fields=True, rounds=2), "c": Channels(strings=True, fields=True, rounds=0), "cpp": Channels(strings=True, fields=True, rounds=2), "ocaml": Channels(rounds=2),
}
#: Expressions that are folded into the one around them where expressions have no nodes of their own.
FOLDED = {"lit", "op", "field", "index"}
RICH = {"strings": True, "fields": True, "floats": True, "types": True, "param_pos": True}


def channels(lang: str) -> Channels:
    return BASE.get(lang, Channels())


@dataclass(slots=True)
class Node:
    seed: int
    preds: list[tuple[int, int]] = field(default_factory=list)
    commutative: bool = False
    emit: bool = False
    tag: str = ""
    label: str = ""
    line: int = 0
    copy: bool = False


@dataclass
class Shape:
    """Counts over the control flow."""

    nodes: int = 2
    edges: int = 1
    cond: int = 0
    join: int = 0
    ret: int = 0
    throw: int = 0
    instr: int = 0
    back: int = 0
    returns_value: bool = False


class Graph:
    def __init__(self, fn: Fn, ch: Channels):
        self.ch, self.nodes, self.shape = ch, [], Shape()
        self.calls: set[tuple[str, str, int]] = set()
        self.consts: dict[str, set[str]] = {"string": set(), "int": set(), "float": set()}
        self.unknown = 0
        self.merges: dict[tuple[int, ...], int] = {}
        # environments that leave the loops (by break, by continue) and the regions around a statement, the innermost last
        self.loops: list[tuple[list, list]] = []
        self.regions: list[list] = []
        self.extern = self.add(feed(0xEE))
        types = dict(enumerate(fn.types)) if ch.types else {}
        env = {p: self.add(feed(0xE0, *([k] if ch.param_pos else []), *([types[k]] if types.get(k) else [])), label="param") for k, p in enumerate(fn.params)}
        self.returns: list[int] = []
        self.block(fn.body, env)
        if ch.thru_copies:
            self.pass_copies()
        self.levels = self.propagate()

    def add(self, seed: int, preds=(), commutative=False, emit=False, tag="", label="", line=0, of: tuple[E, ...] = ()) -> int:
        """A node with its operands; ``of`` are the expressions that these are the values of.

        Without a node for each expression, operands that are expressions themselves give their seed and their own operands instead: one node stands
        for the whole, with the values it reads.
        """
        if not self.ch.exp_nodes and any(e.kind in FOLDED for e in of):
            folded, read = [], []
            for k, (p, e) in enumerate(zip(preds, of, strict=False)):
                inner = self.nodes[p]
                if e.kind in FOLDED:
                    inner.emit = False
                    read += [q for q, _ in inner.preds]
                    folded.append(inner.seed if commutative else mix_pos(inner.seed, k))
                else:
                    read.append(p)
            seed, preds = mix(seed, sum(folded) & MASK62), read
        self.nodes.append(Node(seed, [(p, k) for k, p in enumerate(preds)], commutative, emit, tag, label, line))
        return len(self.nodes) - 1

    # expressions: the node of a value
    def value(self, e: E, env: dict[str, int]) -> int:
        ch, line = self.ch, e.line
        if e.kind == "lit":
            if e.name in ("int", "float", "string", "char"):
                key = "string" if e.name == "char" else e.name
                if not (key == "int" and e.text in ("0", "1", "-1", "2")):
                    self.consts[key].add(e.text)
            seen = {"int": ch.int_values, "string": ch.strings, "char": ch.strings, "float": ch.floats, "bool": True}.get(e.name, False)
            return self.add(feed(0x13, e.name, *([e.text] if seen else [])), label=e.text or e.name, line=line)
        if e.kind == "var":
            return env.get(e.name, self.extern)
        if e.kind == "lambda":
            kept, self.returns = self.returns, []
            around, self.loops, self.regions = (self.loops, self.regions), [], []
            inner = dict(env) | {p: self.add(feed(0xE0), label="param") for p in e.fn.params}
            self.block(e.fn.body, inner)
            out = self.add(feed(0x03), self.returns, True, label="lambda", line=line)
            self.returns = kept
            self.loops, self.regions = around
            return out
        if e.kind == "call" and e.text == "block":
            kept, self.returns = self.returns, []
            self.block(e.args[0].fn.body, env, inner=True)
            found, self.returns = self.returns, kept
            return found[0] if len(found) == 1 else self.merge(found, line)
        if e.kind == "op" and e.name == ":=" and e.args[0].kind == "var":
            env[e.args[0].name] = self.value(e.args[1], env)
            return env[e.args[0].name]
        args = [self.value(a, env) for a in e.args]
        if e.kind == "cast":
            if not ch.types:
                return args[0]
            out = self.add(feed(0x1A, e.name), args, label=f"as {e.name}", line=line)
            self.nodes[out].copy = len(args) == 1
            return out
        if e.kind == "op":
            name = SAME_OP.get(e.name, e.name)
            return self.add(feed(0x10, name, len(args)), args, name in COMMUTATIVE, True, "unop" if len(args) == 1 else "binop", name, line, e.args)
        if e.kind == "call":
            self.calls.add((e.text or "named", e.name, len(args)))
            name = [e.name] if ch.call_names and e.name not in env else []
            args = ([env[e.name]] if e.name in env and not e.text else []) + args
            return self.add(feed(0x12, e.text or "named", len(args), *name), args, emit=True, tag="call", label=f"{e.name or 'call'}()", line=line, of=e.args if len(args) == len(e.args) else ())
        if e.kind == "new":
            return self.add(feed(0x1B, len(args), *([e.name] if ch.call_names else [])), args, emit=True, tag="call", label=f"new {e.name}", line=line)
        if e.kind == "field":
            return self.add(feed(0x15, *([e.name] if ch.fields else [])), args, emit=True, tag="field", label=f".{e.name}", line=line, of=e.args)
        if e.kind == "index":
            return self.add(feed(0x16, e.name), args, emit=True, tag="index", label="[]", line=line, of=e.args)
        if e.kind == "seq":
            return self.add(feed(0x17, e.name, len(args)), args, emit=bool(args), tag="construct", label=e.name, line=line)
        if e.kind == "pick":
            self.decide(args[0], line)
            return self.merge(args[1:], line)
        self.unknown += 1
        return self.add(feed(0x1F, e.name), args, label="unknown", line=line)

    def merge(self, values: list[int], line: int) -> int:
        """The node of a value that is one of several; one for each set of them."""
        values = list(dict.fromkeys(values))
        if len(values) == 1:
            return values[0]
        key = tuple(sorted(values))
        if key not in self.merges:
            self.merges[key] = self.add(feed(0x05, "merge", len(values)), values, True, label="merge", line=line)
        return self.merges[key]

    def decide(self, cond: int, line: int) -> None:
        self.shape.cond += 1
        self.shape.nodes += 3
        self.shape.edges += 4
        if self.nodes[cond].emit:
            self.add(feed(0x04), [cond], emit=True, tag="control", label="if", line=line)

    # statements: the environment after them, None if control goes elsewhere
    def block(self, body, env: dict[str, int], inner: bool = False) -> dict[str, int] | None:
        for s in body:
            if s.kind == "return" and inner:
                self.returns.append(self.value(s.e[0], env) if s.e else self.extern)
                return env
            env = self.statement(s, env, inner)
            if env is None:
                return None
        return env

    def joined(self, outs: list[dict[str, int] | None], line: int, env: dict[str, int]) -> dict[str, int] | None:
        self.shape.join += 1
        self.shape.nodes += 1
        self.shape.edges += sum(o is not None for o in outs)
        return self.meet(outs, line, env)

    def meet(self, outs: list[dict[str, int] | None], line: int, env: dict[str, int]) -> dict[str, int] | None:
        """The environment where some paths meet; None if none goes on."""
        live = [o for o in outs if o is not None]
        if len(live) < 2:
            return live[0] if live else None
        names = set().union(*live)
        return {n: self.merge([o.get(n, env.get(n, self.extern)) for o in live], line) for n in sorted(names)}

    def assign(self, target: E, value: int, env: dict[str, int], line: int) -> None:
        if target.kind == "var":
            env[target.name] = value
        elif target.kind == "seq":
            parts = self.nodes[value]
            whole = parts.label == "tuple" and len(parts.preds) == len(target.args)
            for k, t in enumerate(target.args):
                self.assign(t, parts.preds[k][0] if whole else self.add(feed(0x18, k), [value], label=f"part {k}", line=line), env, line)
        elif target.kind in ("field", "index"):
            names = [target.name] if target.kind == "field" and self.ch.fields else []
            into = [self.value(a, env) for a in target.args]
            self.add(feed(0x02, target.kind, *names), [*into, value], emit=True, tag=target.kind, label="store", line=line)
        elif target.kind == "cast":
            self.assign(target.args[0], value, env, line)
        else:
            self.add(feed(0x02, "other"), [self.value(target, env), value], emit=True, tag="index", label="store", line=line)

    def loop_env(self, body, env: dict[str, int], line: int) -> dict[str, int]:
        """Merge nodes for the variables that a loop body assigns."""
        out = dict(env)
        for n in sorted(assigned(body)):
            if n in env:
                out[n] = self.add(feed(0x05, "loop"), [env[n]], True, label="loop", line=line)
        return out

    def close_loop(self, head: dict[str, int], env: dict[str, int], after: dict[str, int] | None) -> None:
        self.shape.back += 1
        self.shape.edges += 1
        for n, k in head.items():
            if after and n in env and k != env[n] and after.get(n, k) != k:
                self.nodes[k].preds.append((after[n], 1))

    def statement(self, s: S, env: dict[str, int], inner: bool) -> dict[str, int] | None:
        sh, line = self.shape, s.line
        if s.kind in ("assign", "expr"):
            sh.instr += 1
            sh.nodes += 1
            sh.edges += 1
            if s.kind == "expr":
                self.value(s.e[0], env)
            else:
                self.assign(s.e[0], self.value(s.e[1], env), env, line)
            return env
        if s.kind == "if":
            self.decide(self.value(s.e[0], env), line)
            return self.joined([self.block(b, dict(env), inner) for b in s.blocks], line, env)
        if s.kind == "loop":
            init, body, step = s.blocks
            env = self.block(init, env, inner) or env
            head = self.loop_env((*body, *step), env, line)
            endless = s.e[0].kind == "lit"
            if not endless:
                self.decide(self.value(s.e[0], head), line)
            return self.turn(head, dict(head), env, body, step, line, inner, [] if endless else [head])
        if s.kind == "each":
            over = self.value(s.e[1], env)
            head = self.loop_env(s.blocks[0], env, line)
            self.decide(over, line)
            inside = dict(head)
            self.assign(s.e[0], self.add(feed(0x18, "each"), [over], emit=True, tag="control", label="each", line=line), inside, line)
            return self.turn(head, inside, env, s.blocks[0], (), line, inner, [head])
        if s.kind == "region":
            self.regions.append([])
            after = self.block(s.blocks[0], env, inner)
            return self.meet([after, *self.regions.pop()], line, env)
        if s.kind == "try":
            outs = [self.block(s.blocks[0], dict(env), inner)]
            outs += [self.block(b, dict(env), inner) for b in s.blocks[1:]]
            return self.joined(outs, line, env)
        if s.kind == "return":
            sh.ret += 1
            sh.nodes += 1
            sh.edges += 1
            v = self.value(s.e[0], env) if s.e else self.extern
            sh.returns_value |= bool(s.e)
            self.returns.append(v)
            if self.nodes[v].emit or len(self.nodes[v].preds) > 1:
                self.add(feed(0x05, "return"), [v], emit=True, tag="control", label="return", line=line)
            return None
        if s.kind == "throw":
            sh.throw += 1
            sh.nodes += 1
            sh.edges += 1
            self.add(feed(0x06), [self.value(e, env) for e in s.e], emit=True, tag="control", label="throw", line=line)
            return None
        if s.kind == "leave" and self.regions:
            self.regions[-1].append(dict(env))
        elif s.kind in ("break", "continue") and self.loops:
            self.loops[-1][s.kind == "continue"].append(dict(env))
        return None

    def turn(self, head: dict[str, int], inside: dict[str, int], env: dict[str, int], body, step, line: int, inner: bool, exits: list) -> dict[str, int]:
        """A loop's body from ``inside``, back to its head by its end or a continue; the environment after it, by its exits and breaks."""
        self.loops.append(([], []))
        after = self.block(body, inside, inner)
        breaks, again = self.loops.pop()
        back = self.meet([after, *again], line, env)
        if back is not None and step:
            back = self.block(step, dict(back), inner)
        self.close_loop(head, env, back)
        return self.meet([*map(dict, exits), *breaks], line, env) or dict(head)

    def pass_copies(self) -> None:
        """Edges from copies come from what they copy."""
        for n in self.nodes:
            for k, (p, pos) in enumerate(n.preds):
                seen = {p}
                while self.nodes[p].copy and self.nodes[p].preds[0][0] not in seen:
                    p = self.nodes[p].preds[0][0]
                    seen.add(p)
                n.preds[k] = (p, pos)

    def propagate(self) -> list[list[int]]:
        """The nodes' hashes at each level: the seeds, then what a node's own hash and those of its operands one level down make."""

        def up(node: Node, own: int, below: list[int]) -> int:
            if node.commutative:
                # a sum of hashes that each depend on the node's own does not depend on the operands' order
                total = 0
                for p, _ in node.preds:
                    total += mix(own, below[p])
                return mix(own, total & MASK62)
            for p, pos in node.preds:
                own = mix(own, mix_pos(below[p], pos))
            return own

        levels = [[n.seed for n in self.nodes]]
        while len(levels) <= self.ch.rounds:
            below = levels[-1]
            levels.append([up(n, h, below) if n.preds else h for n, h in zip(self.nodes, below, strict=True)])
        return levels

    def features(self) -> list[tuple[int, str]]:
        """Hashes of the emitting nodes: all seeds, later rounds where they differ."""
        out = []
        for k, n in enumerate(self.nodes):
            if n.emit:
                out += [(level[k], n.tag) for r, level in enumerate(self.levels) if not r or level[k] != self.levels[r - 1][k]]
        return out


def assigned(body) -> set[str]:
    """Variables that statements assign, in blocks below too."""
    out: set[str] = set()

    def of(target: E) -> None:
        if target.kind == "var":
            out.add(target.name)
        elif target.kind == "seq":
            for t in target.args:
                of(t)

    for s in body:
        if s.kind == "assign":
            of(s.e[0])
        elif s.kind == "each":
            of(s.e[0])
        for b in s.blocks:
            out |= assigned(b)
    return out


def delta_features(fn: Fn, base: Graph) -> list[tuple[int, str]]:
    """Hashes that names, values and types change, where the rich graph has the same nodes."""
    rich = Graph(fn, replace(base.ch, **RICH))
    if len(rich.nodes) != len(base.nodes):
        return []
    return [(feed(0x5A, level[k]), "delta") for r, level in enumerate(rich.levels) for k, n in enumerate(rich.nodes) if n.emit and level[k] != base.levels[r][k]]
