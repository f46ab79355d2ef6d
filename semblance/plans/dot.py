"""Graphviz text of a function's data-flow graph, a graph for each round."""

from __future__ import annotations

import re

from ..frontend import Graph

COLOURS = {"binop": "lightblue", "unop": "lightblue", "call": "gold", "field": "palegreen", "index": "palegreen", "construct": "plum", "control": "salmon"}


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")


def file_name(name: str, rnd: int) -> str:
    return re.sub(r"[^A-Za-z0-9_]+", "_", name) + f"-round{rnd}.dot"


def dot(graph: Graph, name: str, rnd: int = 0) -> str:
    out = [f'digraph "{escape(name)}" {{', "  node [shape=box, style=filled, fillcolor=white];"]
    for k, n in enumerate(graph.nodes):
        h = graph.levels[min(rnd, len(graph.levels) - 1)][k]
        style = "" if n.emit else ", style=dashed"
        out.append(f'  n{k} [label="{escape(n.label or n.tag or "node")}\\n{h & 0xFFFFFF:06x}", fillcolor={COLOURS.get(n.tag, "white")}{style}];')
    out += [f'  n{p} -> n{k} [label="{"" if n.commutative else pos}"];' for k, n in enumerate(graph.nodes) for p, pos in n.preds]
    return "\n".join([*out, "}"])
