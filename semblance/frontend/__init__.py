"""Source code to units: parse, lower, build the data-flow graph, sign."""

from __future__ import annotations

import os

from . import braces, ocaml, python
from .dataflow import Graph
from .signature import Options, signature

LANG_OF = {
    ".py": "python", ".rs": "rust", ".js": "js", ".ts": "js", ".go": "go", ".java": "java", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".cppm": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp",
    ".ml": "ocaml", ".mli": "ocaml",
}
EXTENSION_OF = {"python": ".py", "rust": ".rs", "javascript": ".js", "js": ".js", "typescript": ".ts", "ts": ".ts", "go": ".go", "java": ".java", "c": ".c", "cpp": ".cpp", "c++": ".cpp", "ocaml": ".ml"}


def functions_of(path: str, text: str):
    """(language, functions) of a file; languages without a front end have none."""
    lang = LANG_OF.get(os.path.splitext(path)[1])
    if lang is None:
        return None, []
    if lang in ("python", "ocaml"):
        return lang, (python if lang == "python" else ocaml).functions(text)
    return lang, braces.functions(text, lang)


def units_of_source(path: str, text: str, profile: str = "full", options: Options | None = None) -> list[dict]:
    """A row for each function of a file; one that can't be signed has its reason."""
    lang, fns = functions_of(path, text)
    options, out = options or Options(), []
    for f in fns:
        row = {"name": f.name, "file": path, "lang": lang, "line_start": f.line, "line_end": f.end, "code_lines": f.code_lines, "tokens": list(f.tokens), "features": None, "nodes": None, "unknown": None, "error": None}
        try:
            graph = Graph(f, options.channels(lang))
            row |= {"features": signature(f, lang, profile, options.weights, graph), "nodes": len(graph.nodes), "unknown": graph.unknown}
        except RecursionError as e:
            row["error"] = f"{type(e).__name__}"
        out.append(row)
    return out


def nodes_of_source(path: str, text: str, options: Options | None = None) -> list[dict]:
    """A row for each node of each function of a file."""
    lang, fns = functions_of(path, text)
    options, out = options or Options(), []
    for f in fns:
        try:
            g = Graph(f, options.channels(lang))
        except RecursionError:
            continue
        unit = {"name": f.name, "file": path, "line_start": f.line, "line_end": f.end}
        out += [unit | {"idx": k, "line": n.line, "label": n.label, "tag": n.tag, "emit": n.emit, "commutative": n.commutative, "preds": [{"idx": p, "pos": pos} for p, pos in n.preds], "rounds": [level[k] for level in g.levels]} for k, n in enumerate(g.nodes)]
    return out


def function_at(path: str, text: str, name: str | None = None, line: int | None = None):
    """(language, function): the narrowest one over a line, else the first of a name, else the first."""
    lang, fns = functions_of(path, text)
    if not fns:
        raise LookupError(f"no function in {path}")
    over = [f for f in fns if line is not None and f.line <= line <= f.end]
    return lang, min(over, key=lambda f: f.end - f.line) if over else next((f for f in fns if f.name == name), fns[0])


def graph_of(path: str, text: str, name: str | None = None, line: int | None = None, options: Options | None = None) -> Graph:
    """The graph of the function that function_at() picks."""
    lang, f = function_at(path, text, name, line)
    return Graph(f, (options or Options()).channels(lang))


def unique_nodes(a: Graph, b: Graph) -> list[tuple[int, str]]:
    """(line, label) of the emitting nodes of a none of whose hashes occurs among those of b."""
    known = {h for h, _ in b.features()}
    return sorted({(n.line, n.label) for k, n in enumerate(a.nodes) if n.emit and not any(level[k] in known for level in a.levels)})
