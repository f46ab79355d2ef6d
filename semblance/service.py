"""The index behind JSON-RPC tools (standard input or HTTP), a pair explorer and editor diagnostics."""

from __future__ import annotations

import json
import os
import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .explorer import PAGE
from .operators.search import PairFilter, QueryFilter
from .plans import corpus, diagnose
from .plans.index import Index
from .sources.files import drafted, extract_units, unit_features
from .sources.scratch import Workspace

#: What an editor offers at a function: title and command.
ACTIONS = (("Find similar functions", "semblance.findSimilar"), ("Open the most similar one beside", "semblance.openAside"), ("Compare with the most similar one", "semblance.diffSimilar"))
#: A project is served only if this file stands at its root.
MARKER = ".semblance"
SNIPPET_LINES, EXPLORER_PAIRS, EXPLORER_FLOOR = 40, 5000, 0.3
TEXT, NUMBER, INTEGER, FLAG = {"type": "string"}, {"type": "number"}, {"type": "integer"}, {"type": "boolean"}
LIST = {"type": ["array", "string"], "items": TEXT}
SIDE = {"type": "object", "properties": {"code": TEXT, "language": TEXT, "file": TEXT, "line": INTEGER, "name": TEXT}}
FILTER = {"min_lines": INTEGER, "min_features": INTEGER, "include": LIST, "exclude": LIST}
#: Tools with what they do, their arguments and those that must be given.
TOOLS = {
    "find_similar": ("Functions like drafted code", {"code": TEXT, "language": TEXT, "k": INTEGER, "threshold": NUMBER, **FILTER}, ["code"]),
    "query_similar": ("Functions like one in the index", {"file": TEXT, "line": INTEGER, "name": TEXT, "k": INTEGER, "threshold": NUMBER, **FILTER}, ["file"]),
    "diff_functions": ("What two functions share and what each has alone", {"a": SIDE, "b": SIDE}, ["a", "b"]),
    "find_duplicates": ("Pairs of alike functions", {"threshold": NUMBER, "metric": {"enum": ["jaccard", "max"]}, "limit": INTEGER, "name": TEXT, "include_deps": FLAG, **FILTER}, []),
    "status": ("How far the index is", {}, []),
}


class Engine:
    """Builds the index in the background and answers tools; an index is replaced as a whole."""

    def __init__(self, spark: SparkSession, root: str, profile: str = "structural", store: str = ""):
        self.spark, self.root, self.profile, self.store = spark, os.path.realpath(root), profile, store
        self.index: Index | None = None
        self.counts = (0, 0)
        self.stage, self.failed = "starting", ""
        self.lock = threading.Lock()

    @property
    def allowed(self) -> bool:
        return os.path.exists(os.path.join(self.root, MARKER))

    def publish(self, index: Index, stage: str) -> None:
        """Replaces the index by one that is written and so carries no steps of the last."""
        index = index.written(Workspace(self.spark))
        self.counts = (index.units.select("file").distinct().count(), index.count())
        self.index, self.stage = index, stage

    def build(self) -> None:
        """The workspace first, which answers from then on; then its dependencies, if there is a store for them."""
        try:
            index = corpus.index_of(corpus.workspace(self.spark, [self.root], self.profile))
            self.publish(index, "workspace" if self.store else "complete")
            if self.store and (deps := corpus.dependencies(self.spark, [self.root], self.store, self.profile)) is not None:
                more = corpus.index_of(deps)
                with self.lock:
                    self.publish(self.index.append(more.units, more.features), "complete")
            self.stage = "complete"
        except Exception as e:  # the server lives on and says so in status
            self.failed = f"{type(e).__name__}: {e}"[:500]

    def refresh(self, path: str) -> Index:
        """Takes up a saved file; the index of its units alone."""
        with open(path, "rb") as f:
            files = self.spark.createDataFrame([(path, f.read())], "path string, content binary")
        fresh = corpus.index_of(extract_units(files, self.profile))
        with self.lock:
            self.publish(self.index.refresh(fresh.units, fresh.features), self.stage)
        return fresh

    def snippet(self, file: str, start: int, end: int) -> str:
        """Lines of a file of the index, at most SNIPPET_LINES."""
        if not os.path.realpath(file).startswith(self.root + os.sep):
            raise PermissionError(file)
        with open(file, encoding="utf-8", errors="replace") as f:
            lines = f.read().split("\n")[start - 1 : end]
        return "\n".join([*lines[:SNIPPET_LINES], *(["…"] if len(lines) > SNIPPET_LINES else [])])

    def call(self, tool: str, args: dict) -> object:
        if tool == "status":
            return {"root": self.root, "ready": self.index is not None, "stage": self.stage, "files": self.counts[0], "functions": self.counts[1], "error": self.failed}
        if not self.allowed:
            raise LookupError(f"{MARKER} is missing at {self.root}")
        if tool == "diff_functions":
            return diagnose.diff_sources(self._side(args["a"]), self._side(args["b"]), **{f"{s}_{k}": args[s].get(k) for s in "ab" for k in ("name", "line")})
        if self.index is None:
            raise LookupError("the index isn't ready")
        with self.lock:
            return getattr(self, tool)(args)

    def _side(self, x: dict) -> tuple[str, str]:
        from .frontend import EXTENSION_OF

        if "code" in x:
            return f"draft{EXTENSION_OF.get(str(x.get('language', 'rust')).lower(), '.rs')}", x["code"]
        path = os.path.join(self.root, x["file"])
        if not os.path.realpath(path).startswith(self.root + os.sep):
            raise PermissionError(x["file"])
        with open(path, encoding="utf-8", errors="replace") as f:
            return path, f.read()

    def _filter(self, a: dict, **base) -> dict:
        listed = lambda k: tuple([a[k]] if isinstance(a.get(k), str) else a.get(k) or ())
        return base | {"min_lines": int(a.get("min_lines", 0)), "min_features": int(a.get("min_features", 0)), "include": listed("include"), "exclude": listed("exclude")}

    def _hits(self, features, a: dict, names) -> list[dict]:
        flt = QueryFilter(**self._filter(a, threshold=float(a.get("threshold", 0.25)), limit=0))
        hits = self.index.search(features, flt).where("qid <> fid").join(names, "qid")
        out: dict[int, list[dict]] = {}
        for r in hits.where(F.col("rank") <= int(a.get("k", 5)) + 1).orderBy("qid", "rank").toLocalIterator():
            if len(out.setdefault(r.qid, [])) < int(a.get("k", 5)):
                out[r.qid].append({"query": r.q_name, "name": r["name"], "file": r.file, "line": r.line_start, "jaccard": round(r.jaccard, 3), "containment": round(r.containment, 3), "text": self.snippet(r.file, r.line_start, r.line_end)})
        return [x for v in out.values() for x in v]

    def find_similar(self, a: dict) -> list[dict]:
        units = extract_units(drafted(self.spark, a["code"], a.get("language", "rust")), self.profile).where("error is null").orderBy("line_start").limit(5)
        return self._hits(unit_features(units).withColumnRenamed("fid", "qid"), a, units.select(F.col("fid").alias("qid"), F.col("name").alias("q_name")))

    def query_similar(self, a: dict) -> list[dict]:
        u = self.index.units.where(F.col("file").endswith(a["file"]))
        if a.get("line") is not None:
            u = u.where((F.col("line_start") <= int(a["line"])) & (F.col("line_end") >= int(a["line"]))).orderBy(F.col("name").endswith("<lambda>"), F.col("line_end") - F.col("line_start"))
        else:
            u = u.orderBy(F.col("name") != a.get("name", ""), "line_start")
        u = u.limit(1)
        names = u.select(F.col("fid").alias("qid"), F.col("name").alias("q_name"))
        return self._hits(self.index.features.join(u.select("fid"), "fid", "left_semi").withColumnRenamed("fid", "qid"), a, names)

    def find_duplicates(self, a: dict) -> list[dict]:
        # one side is the workspace's; the other too, unless dependencies are asked for
        scope = {"origin_a": "workspace", "origin_b": None if a.get("include_deps") else "workspace"}
        flt = PairFilter(**self._filter(a, threshold=float(a.get("threshold", 0.7)), metric=a.get("metric", "jaccard"), name=a.get("name", ""), limit=int(a.get("limit", 50)), **scope))
        return [{"j": round(r.j, 3), "c": round(r.c, 3), **{s: {"name": r[f"{s}_name"], "file": r[f"{s}_file"], "line": r[f"{s}_line_start"], "end": r[f"{s}_line_end"]} for s in "ab"}} for r in self.index.duplicates(flt).collect()]

    def explorer(self) -> dict:
        pairs = self.find_duplicates({"threshold": EXPLORER_FLOOR, "metric": "max", "limit": EXPLORER_PAIRS + 1})
        return {"pairs": pairs[:EXPLORER_PAIRS], "truncated": len(pairs) > EXPLORER_PAIRS}

    def known(self, file: str, start: int, end: int) -> bool:
        return not self.index.units.where((F.col("file") == file) & (F.col("line_start") == start) & (F.col("line_end") == end)).isEmpty()


def rpc(engine: Engine, message: dict) -> dict | None:
    """The answer to a JSON-RPC message; none to a notification."""
    method, params, ident = message.get("method"), message.get("params") or {}, message.get("id")
    if ident is None:
        return None
    try:
        if method == "initialize":
            result: object = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "semblance", "version": "1"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [{"name": k, "description": v, "inputSchema": {"type": "object", "properties": args, "required": must}} for k, (v, args, must) in TOOLS.items()]}
        elif method == "tools/call":
            if params.get("name") not in TOOLS:
                raise LookupError(f"no tool {params.get('name')}")
            try:
                result = {"content": [{"type": "text", "text": json.dumps(engine.call(params["name"], params.get("arguments") or {}))}], "isError": False}
            except (LookupError, OSError, ValueError, TypeError) as e:
                result = {"content": [{"type": "text", "text": str(e)}], "isError": True}
        else:
            return {"jsonrpc": "2.0", "id": ident, "error": {"code": -32601, "message": f"no method {method}"}}
    except LookupError as e:
        return {"jsonrpc": "2.0", "id": ident, "error": {"code": -32602, "message": str(e)}}
    return {"jsonrpc": "2.0", "id": ident, "result": result}


def handler(engine: Engine):
    class Handler(BaseHTTPRequestHandler):
        def say(self, code: int, body: object, kind: str = "application/json") -> None:
            raw = body.encode() if isinstance(body, str) else json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            try:
                if url.path == "/":
                    self.say(200, PAGE, "text/html; charset=utf-8")
                elif url.path == "/api/status":
                    self.say(200, engine.call("status", {}))
                elif engine.index is None:
                    self.say(503, {"error": "the index isn't ready"})
                elif url.path == "/api/pairs":
                    self.say(200, engine.explorer())
                elif url.path == "/api/fn" and engine.known(q["file"], int(q["start"]), int(q["end"])):
                    self.say(200, {"text": engine.snippet(q["file"], int(q["start"]), int(q["end"]))})
                else:
                    self.say(404, {"error": "not found"})
            except (KeyError, ValueError, OSError) as e:
                self.say(400, {"error": str(e)})

        def do_POST(self) -> None:
            if urlsplit(self.path).path not in ("/", "/mcp", "/rpc"):
                return self.say(404, {"error": "not found"})
            try:
                answer = rpc(engine, json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0)))))
            except ValueError as e:
                return self.say(400, {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}})
            return self.say(200 if answer else 202, answer)

        def log_message(self, *_) -> None:
            pass

    return Handler


def framed(stream) -> dict | None:
    """The next message with a Content-Length header, as editors send them; None at the end."""
    n = 0
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            return json.loads(stream.read(n)) if n else {}
        if line.lower().startswith(b"content-length:"):
            n = int(line.split(b":")[1])
    return None


def lsp(engine: Engine, message: dict) -> list[dict]:
    """Answers and notifications to an editor's message: diagnostics of a saved file, similar functions on request."""
    method, p, ident = message.get("method"), message.get("params") or {}, message.get("id")
    if method == "initialize":
        able = {"textDocumentSync": {"openClose": True, "save": True}, "codeActionProvider": True}
        return [{"jsonrpc": "2.0", "id": ident, "result": {"capabilities": able, "serverInfo": {"name": "semblance"}}}]
    if method in ("textDocument/didOpen", "textDocument/didSave") and engine.index is not None:
        uri = p["textDocument"]["uri"]
        path = unquote(urlsplit(uri).path)
        # an opened file is what the index knows; a saved one has changed
        units = engine.refresh(path).units if method.endswith("didSave") else engine.index.units.where(F.col("file") == path)
        found = diagnose.diagnostics(engine.index, units).collect()
        said = [{"range": {"start": {"line": r.q_line_start - 1, "character": 0}, "end": {"line": r.q_line_start - 1, "character": 200}}, "severity": 3, "source": "semblance", "message": f"{r.q_name} is like {r.match['name']} ({r.match['file']}:{r.match.line_start}), {max(r.match.jaccard, r.match.containment):.2f}"} for r in found]
        return [{"jsonrpc": "2.0", "method": "textDocument/publishDiagnostics", "params": {"uri": uri, "diagnostics": said}}]
    if method == "textDocument/codeAction":
        at = {"file": unquote(urlsplit(p["textDocument"]["uri"]).path), "line": p["range"]["start"]["line"] + 1}
        actions = [{"title": title, "command": {"title": title, "command": command, "arguments": [at]}} for title, command in ACTIONS]
        return [{"jsonrpc": "2.0", "id": ident, "result": actions}]
    if method == "semblance/findSimilar":
        return [{"jsonrpc": "2.0", "id": ident, "result": engine.call("query_similar", {"threshold": 0.2, "k": 15} | p)}]
    if method == "semblance/functionText":
        return [{"jsonrpc": "2.0", "id": ident, "result": engine.snippet(p["file"], int(p["start"]), int(p["end"]))}]
    if method == "semblance/reindex":
        engine.build()
        return [{"jsonrpc": "2.0", "id": ident, "result": engine.call("status", {})}]
    return [{"jsonrpc": "2.0", "id": ident, "result": None}] if ident is not None else []


def start(mode: str, spark: SparkSession, root: str, profile: str, port: int, store: str = "") -> int:
    engine = Engine(spark, root, profile, store)
    threading.Thread(target=engine.build, daemon=True).start()
    if mode == "serve":
        ThreadingHTTPServer(("127.0.0.1", port), handler(engine)).serve_forever()
    elif mode == "rpc":
        for line in sys.stdin:
            if line.strip() and (answer := rpc(engine, json.loads(line))):
                print(json.dumps(answer), flush=True)
    else:
        while (message := framed(sys.stdin.buffer)) is not None and message.get("method") != "exit":
            for out in lsp(engine, message):
                raw = json.dumps(out).encode()
                sys.stdout.buffer.write(b"Content-Length: %d\r\n\r\n" % len(raw) + raw)
                sys.stdout.buffer.flush()
    return 0
