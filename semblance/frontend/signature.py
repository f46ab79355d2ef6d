"""A function's signature: weighted features of all channels, in tenths."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, replace

from ..functions.hashing import feed
from .dataflow import Channels, Graph, channels, delta_features
from .il import Fn

# Weights in tenths by tag and channel; bucket edges of the shape features.
TAG_WEIGHTS = {"binop": 10, "unop": 10, "call": 10, "field": 10, "index": 10, "construct": 10, "control": 10, "string": 8, "const": 8, "macro": 8}
MISC, SHAPE = 8, 3
PROFILES = {"structural": {}, "full": {"delta": 5, "calls": 8, "strings": 5, "ints": 5, "floats": 5}}
EDGES = {
    "nodes": [4, 8, 16, 32, 64, 128], "edges": [4, 10, 22, 46, 94, 190], "cyclomatic": [1, 3, 7, 15, 31], "cond": [0, 1, 3, 7, 15], "join": [0, 1, 3, 7, 15],
    "ret": [0, 1, 3, 7], "throw": [0, 1, 3], "instr": [2, 5, 11, 23, 47, 95], "back": [0, 1, 2, 4, 8],
}


@dataclass(frozen=True)
class Options:
    """What a user may change: rounds of propagation, channels (not_ before a name takes one away), weights by tag. The default of each is the language's own."""

    rounds: int | None = None
    extra: tuple[str, ...] = ()
    weights: dict[str, int] | None = None

    def channels(self, lang: str) -> Channels:
        on = {x.removeprefix("not_"): not x.startswith("not_") for x in self.extra}
        return replace(channels(lang), **on, **({} if self.rounds is None else {"rounds": self.rounds}))


def shape_features(g: Graph) -> list[int]:
    """Hashes of how large the function is, of how it branches and leaves, and of how it loops, each in coarse buckets."""
    counts = vars(g.shape) | {"cyclomatic": max(1, g.shape.edges - g.shape.nodes + 2)}
    kinds = {0xA0: ("back",), 0xA1: ("nodes", "edges", "cyclomatic"), 0xA2: ("cond", "join", "ret", "throw", "instr")}
    return [feed(kind, *(bisect_left(EDGES[x], counts[x]) for x in names)) for kind, names in kinds.items()]


def signature(fn: Fn, lang: str, profile: str = "structural", weights: dict[str, int] | None = None, graph: Graph | None = None) -> list[dict]:
    """[{h, w, tag}] sorted by hash, one per hash with its largest weight; features of weight 0 are left out."""
    g, by_tag = graph or Graph(fn, channels(lang)), TAG_WEIGHTS | (weights or {})
    found: list[tuple[int, int, str]] = [(h, by_tag.get(t, 10), t) for h, t in g.features()]
    p = PROFILES[profile]
    if p.get("delta"):
        found += [(h, p["delta"], t) for h, t in delta_features(fn, g)]
    if p.get("calls"):
        found += [(feed(0xB0, *c), p["calls"], "calls") for c in g.calls]
    for k, (key, channel) in enumerate((("string", "strings"), ("int", "ints"), ("float", "floats"))):
        if p.get(channel):
            found += [(feed(0xC0 + k, v), p[channel], channel) for v in g.consts[key]]
    found += [(feed(0xC3, len(fn.params)), MISC, "misc"), (feed(0xC4, min(g.shape.ret, 4) * g.shape.returns_value), MISC, "misc")]
    found += [(h, SHAPE, "shape") for h in shape_features(g)]
    best: dict[int, tuple[int, str]] = {}
    for h, w, t in found:
        if w > 0 and w > best.get(h, (0, ""))[0]:
            best[h] = (w, t)
    return [{"h": h, "w": w, "tag": t} for h, (w, t) in sorted(best.items())]
