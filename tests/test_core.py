"""Operators on small tables, the index, sources, mining, streaming and the services."""

import io
import json
import threading
import urllib.request
from http.server import ThreadingHTTPServer

import fixtures_code as fx
from pyspark.sql import functions as F

from semblance import cli, service
from semblance.frontend.signature import Options
from semblance.functions import similarity, text
from semblance.operators import features, pairs, search, setops, stats
from semblance.plans import codemining, corpus, diagnose
from semblance.plans.index import Index, load, prune
from semblance.sources import files, store
from semblance.streaming import refresh


def brute_pairs(rows, cutoff):
    by, post = {}, {}
    for f, h, w in rows:
        by.setdefault(f, {})[h] = w
        post.setdefault(h, []).append(f)
    out = {}
    for f, sig in by.items():
        order = sorted(sig, key=lambda h: (len(post[h]), h))
        for k, h in enumerate(order):
            if k < 8 or len(post[h]) <= cutoff:
                for g in post[h]:
                    if g != f:
                        a, b = min(f, g), max(f, g)
                        s = sum(min(w, by[b].get(x, 0)) for x, w in by[a].items())
                        wa, wb = sum(by[a].values()), sum(by[b].values())
                        out[a, b] = (s / (wa + wb - s), max(s / wa, s / wb))
    return out


def test_scored_pairs_with_frequent_features(spark):
    import random

    rng = random.Random(9)
    rows = sorted({(f, rng.choice([rng.randrange(6), rng.randrange(60)])): rng.choice([3, 5, 10]) for f in range(40) for _ in range(14)}.items())
    rows = [(f, h, w) for (f, h), w in rows]
    df = spark.createDataFrame(rows, "fid bigint, h bigint, w int")
    want = brute_pairs(rows, 5)
    for threshold in (0.0, 0.35):
        got = {(r.a, r.b): (r.j, r.c) for r in pairs.scored_pairs(df, threshold=threshold, cutoff=5).collect()}
        assert got == {k: v for k, v in want.items() if max(v) >= threshold}
    some = spark.range(25).withColumnRenamed("id", "fid")
    got = {(r.a, r.b) for r in pairs.scored_pairs(df, threshold=0.35, cutoff=5, among=some).collect()}
    assert got == {k for k, v in want.items() if max(v) >= 0.35 and max(k) < 25}
    got = {(r.a, r.b) for r in pairs.scored_pairs(df, threshold=0.3, metric="jaccard", cutoff=5).collect()}
    assert got == {k for k, v in want.items() if v[0] >= 0.3}
    hits = pairs.scored_hits(df.withColumnRenamed("fid", "qid").where("qid < 5"), df, cutoff=5).where("qid <> fid").collect()
    for r in hits:
        assert abs(r.jaccard - want[min(r.qid, r.fid), max(r.qid, r.fid)][0]) < 1e-12


def test_pairs_whose_postings_are_long(spark, monkeypatch):
    """Pairs that share only features over NEAR are found by their prefixes, at any threshold and for both metrics."""
    import random

    found = 0
    for seed in range(3):
        rng = random.Random(seed)
        rows = sorted({(f, rng.choice([rng.randrange(12), rng.randrange(30), 100 + f])): rng.choice([1, 5, 10]) for f in range(30) for _ in range(12)}.items())
        rows = [(f, h, w) for (f, h), w in rows]
        df = spark.createDataFrame(rows, "fid bigint, h bigint, w int")
        want = brute_pairs(rows, 9)
        for near, threshold in ((1, 0.3), (2, 0.5), (3, 0.0)):
            monkeypatch.setattr(pairs, "NEAR", near)
            got = {(r.a, r.b): (r.j, r.c) for r in pairs.scored_pairs(df, threshold=threshold, cutoff=9).collect()}
            assert got == {k: v for k, v in want.items() if max(v) >= threshold}
            got = {(r.a, r.b) for r in pairs.scored_pairs(df, threshold=threshold, metric="jaccard", cutoff=9).collect()}
            assert got == {k for k, v in want.items() if v[0] >= threshold}
            found += len(got)
    assert found > 50


def test_signature_columns(spark):
    a, b = [(1, 10), (2, 5)], [(2, 10), (3, 5)]
    df = spark.createDataFrame([(a, b), (a, a), ([], [])], "a array<struct<h: bigint, w: int>>, b array<struct<h: bigint, w: int>>")
    got = df.select(similarity.weighted_jaccard(F.col("a"), F.col("b")).alias("j"), similarity.containment(F.col("a"), F.col("b")).alias("c")).collect()
    assert [(r.j, r.c) for r in got] == [(0.2, 1 / 3), (1.0, 1.0), (0.0, 0.0)]
    similarity.register(spark)
    df.createOrReplaceTempView("signed")
    assert [tuple(r) for r in spark.sql("select weighted_jaccard(a, b), containment(a, b), set_jaccard(transform(a, x -> string(x.h)), array('1', '7')) from signed").collect()] == [(0.2, 1 / 3, 1 / 3), (1.0, 1.0, 1 / 3), (0.0, 0.0, 0.0)]


def test_text_functions():
    assert text.crate_of("reg/serde-1.0.3/src/de.rs") == ("serde", "src/de.rs") and text.crate_of("a-b/c.rs") is None
    assert text.version_of("reg/serde-1.0.3/src") == "1.0.3" and text.major_of("0.4.2") == "0.4" and text.major_of("12.1") == "12"
    assert text.percent_decode("a%20b+c%zz%4") == "a b+c%zz%4" and text.percent_decode("a+b", plus=True) == "a b"
    assert text.split_list("a,,b") == ["a", "b"] and text.truncate("abcdef", 4) == "abc…"
    assert text.line_diff(["a", "b", "c"], ["  b", "x", "c"]) == [("a", None), ("b", "  b"), (None, "x"), ("c", "c")] and text.line_diff([], ["q"]) == [(None, "q")] and text.line_diff([], []) == []


def test_stats(spark):
    df = spark.createDataFrame([("x", float(v)) for v in (5, 1, 4, 2, 3)] + [("y", 7.0)], "k string, v double")
    got = {r.k: (r.p10, r.p50, r.p90) for r in stats.percentiles(df, "k", "v").collect()}
    assert got == {"x": (1.0, 3.0, 5.0), "y": (7.0, 7.0, 7.0)}
    assert df.groupBy("k").agg(stats.nearest_rank(F.collect_list("v"), 0.5).alias("p")).where("k = 'x'").first().p == 3.0
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (2.0, 5.0), (3.0, 4.0)], "x double, y double")
    assert abs(stats.spearman(rows, "x", "y").first().rho - 0.6324555320336759) < 1e-12
    ids = spark.range(100).repartition(7)
    assert sorted(r.id for r in stats.even_sample(ids, 7, "id").collect()) == [i * 100 // 7 for i in range(7)]
    ranks = spark.createDataFrame([("a", 1), ("a", 0), ("b", 4)], "kind string, rank int")
    got = {r.kind: r for r in stats.retrieval(ranks).collect()}
    assert (got["a"].mrr, got["a"].miss, got["b"].r5, got["ALL"].n) == (0.5, 0.5, 1.0, 3) and abs(got["ALL"].mrr - 1.25 / 3) < 1e-12


def test_positions_and_ranks(spark):
    """Places and sums in an order over many partitions; ranks by counting as by sorting; samples by kind."""
    import random

    rng = random.Random(2)
    vals = [rng.randrange(50) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(vals)), "id bigint, v bigint").repartition(7)
    order = sorted(range(300), key=lambda k: (vals[k], k))
    assert {r.id: r["_at"] for r in stats.with_position(df, ["v", "id"]).collect()} == {k: at for at, k in enumerate(order)}
    run, want = 0, {}
    for k in order:
        run += vals[k]
        want[k] = run
    assert {r.id: r["_upto"] for r in stats.with_running(df, ["v", "id"], "v").collect()} == want
    hits = spark.createDataFrame([(q, f, rng.randrange(4) / 4, rng.randrange(4) / 4) for q in range(5) for f in range(20)], "qid int, fid int, jaccard double, containment double")
    targets = spark.createDataFrame([(0, 3), (0, 4), (2, 19), (4, 99), (9, 1)], "qid int, fid int")
    by_sort = {(r.qid, r.fid): r["rank"] for r in search.competition_rank(hits).collect()}
    assert {(r.qid, r.fid): r["rank"] for r in search.rank_of(hits, targets).collect()} == {k: by_sort[k] for k in ((0, 3), (0, 4), (2, 19))}
    rows = spark.createDataFrame([("a", k, k / 10) for k in range(10)] + [("b", k, 0.5) for k in range(3)], "kind string, id int, s double")
    got = stats.stratified(rows, "kind", 4, F.col("s"), "id").collect()
    assert {r.id for r in got if r.kind == "b"} == {0, 1, 2} and {8, 9} < {r.id for r in got if r.kind == "a"} and len(got) == 7


def test_code_columns(spark):
    """Tokens without names, and packages, as columns and by hand."""
    paths = ["reg/serde-1.0.3/src/de.rs", "a-b/c.py", "x-0.4.2/y-2.0/z.cc", "k.ml", None, ""]
    tokens = [["let", "x", "=", "f", "(", "y", ")"], ["def", "a", ".", "b", "::", "c", "!", "d"], ["int", "q", "->", "r", "1"], [], ["self", "zz"], None]
    df = spark.createDataFrame(list(zip(tokens, paths, strict=True)), "tokens array<string>, file string")
    for r in df.select("tokens", "file", codemining.normalized(F.col("tokens"), F.col("file")).alias("n"), *[c.alias(k) for k, c in codemining.package_of(F.col("file")).items()]).collect():
        assert r.n == (None if r.tokens is None else codemining.normalize(r.tokens, r.file or ""))
        found, v = text.crate_of(r.file or ""), text.version_of(r.file or "")
        assert (r.crate, r.inner, r.version, r.major) == (*(found or (None, None)), v, text.major_of(v))


def test_diff_of_many_pairs(spark):
    """The relational difference against that of two graphs."""
    from semblance.frontend import graph_of, unique_nodes

    f = spark.createDataFrame([("a.py", fx.PYTHON.encode()), ("b.py", fx.PYTHON_B.encode()), ("bad.py", b"def x(:")], "path string, content binary")
    units = {(r.file, r["name"]): r.fid for r in files.extract_units(f, "structural").where("error is null").collect()}
    names = [(("a.py", fx.PYTHON), "settle", ("b.py", fx.PYTHON_B), "charge"), (("b.py", fx.PYTHON_B), "charge", ("a.py", fx.PYTHON), "settle"), (("a.py", fx.PYTHON), "label", ("b.py", fx.PYTHON_B), "steepest")]
    asked = spark.createDataFrame([(units[x[0], n], units[y[0], m]) for x, n, y, m in names], "a bigint, b bigint")
    got = {(r.a, r.b, r.line): r.labels for r in diagnose.only_in(files.extract_nodes(f), asked).collect()}
    want = {}
    for x, n, y, m in names:
        for line, lab in unique_nodes(graph_of(*x, n), graph_of(*y, m)):
            want.setdefault((units[x[0], n], units[y[0], m], line), []).append(lab)
    assert got == {k: sorted(set(v)) for k, v in want.items()} and got


def test_units_and_search(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text(fx.PYTHON)
    (tmp_path / "src/broken.py").write_text("def x(:")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/b.py").write_text(fx.PYTHON_B)
    (tmp_path / "notes.txt").write_text("no code")
    assert [p.rsplit("/", 1)[1] for p in files.list_sources([str(tmp_path)])] == ["a.py", "broken.py"]
    listed = files.source_files(spark, str(tmp_path)).select("path").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in listed) == ["a.py", "broken.py"]
    units = corpus.workspace(spark, [str(tmp_path)]).persist()
    assert units.where("error is not null").count() == 1
    index = corpus.index_of(units)
    assert index.count() == 3
    draft = files.extract_units(files.drafted(spark, fx.PYTHON_B, "python"), "structural")
    asked = files.unit_features(draft).withColumnRenamed("fid", "qid")
    hits = index.search(asked).join(draft.select(F.col("fid").alias("qid"), F.col("name").alias("q")), "qid").collect()
    best = {r.q: r["name"] for r in hits if r["rank"] == 1}
    assert best == {"steepest": "largest_step", "charge": "settle"}
    assert {r["name"] for r in index.search(asked, search.QueryFilter(threshold=0, name="SETT")).collect()} == {"settle"}
    assert [(r.file.rsplit("/", 1)[1], r.bad) for r in diagnose.worst_files(units).collect()] == [("broken.py", 1)]
    assert files.read_sources(spark, [f"file://{tmp_path}", str(tmp_path / "src")]).count() == 4 and files.local_files(spark, [str(tmp_path / "none")]).count() == 0
    stat = {r.lang: r for r in diagnose.parse_stats(units).collect()}
    assert stat["python"].units == 3 and sum(r.failed for r in stat.values()) == 1
    one = index.snapshot(str(tmp_path / "ix"), "v1")
    again = load(spark, str(tmp_path / "ix"))
    index.snapshot(str(tmp_path / "ix"), "v2")
    index.snapshot(str(tmp_path / "ix"), "v2")
    assert len(list((tmp_path / "ix/versions").iterdir())) == 3 and load(spark, str(tmp_path / "ix"), without="v2").n_units == 3
    prune(spark, str(tmp_path / "ix"))
    assert len(list((tmp_path / "ix/versions").iterdir())) == len(list((tmp_path / "ix/data").iterdir())) == 2
    again = load(spark, str(tmp_path / "ix"))
    assert again.n_units == 3 and again.features.count() == index.features.count()
    fresh = corpus.index_of(files.extract_units(spark.createDataFrame([(units.first().file, fx.PYTHON_B.encode())], "path string, content binary"), "structural"))
    changed = again.refresh(fresh.units, fresh.features)
    assert {r["name"] for r in changed.units.collect()} == {"steepest", "charge"}
    assert changed.features.select("fid").distinct().count() == 2
    both = Index(index.units, index.features).append(fresh.units.withColumn("file", F.lit("other.py")), fresh.features)
    got = both.duplicates(search.PairFilter(threshold=0.9)).collect()
    assert [{r.a_name, r.b_name} for r in got] == [{"largest_step", "steepest"}]
    found = diagnose.diagnostics(both, fresh.units.withColumn("file", F.lit("other.py"))).collect()
    assert {r.q_name: r.match["name"] for r in found}["steepest"] == "largest_step"


def test_nesting_and_narrowest(spark):
    units = spark.createDataFrame([(1, "f", "outer", 1, 20), (2, "f", "inner", 5, 9), (3, "f", "inner::<lambda>", 6, 6), (4, "g", "other", 5, 9)], "fid bigint, file string, name string, line_start int, line_end int")
    a, b = units.select([F.col(c).alias(f"a_{c}") for c in units.columns]), units.select([F.col(c).alias(f"b_{c}") for c in units.columns])
    nested = {(r.a_fid, r.b_fid) for r in a.crossJoin(b).where("a_fid < b_fid").where(search.nests("a_", "b_")).collect()}
    assert nested == {(1, 2), (1, 3), (2, 3)}
    points = spark.createDataFrame([(1, "f", 6), (2, "f", 15), (3, "g", 30)], "pid bigint, file string, line int")
    assert {(r.pid, r["name"]) for r in search.narrowest_at(units, points).collect()} == {(1, "inner"), (2, "outer")}
    assert search.first_by_name(units, "inner").first().fid == 2 and search.first_by_name(units, "zz").first().fid == 1
    pairs_ = spark.createDataFrame([(2, 1), (1, 2), (3, 3)], "a bigint, b bigint")
    assert [tuple(r) for r in setops.unordered(pairs_).collect()] == [(1, 2)]
    assert features.df_cutoff(10) == 100 and features.df_cutoff(10_000) == 200


def test_store_and_tsv(spark, tmp_path):
    units = files.extract_units(files.drafted(spark, fx.PYTHON, "python"), "structural")
    kept = store.SigStore(spark, str(tmp_path / "sig"))
    tag = store.config_tag("structural")
    assert kept.load("p", "1", tag) is None and len({tag, store.config_tag("structural", Options(weights={"call": 5})), store.config_tag("full"), store.config_tag("structural", Options(rounds=3)), store.config_tag("structural", Options(extra=("strings",)))}) == 5
    calls = []
    for _ in range(2):
        assert kept.load_or("p", "1", tag, lambda: calls.append(1) or units).count() == 3
    kept.save(units.limit(1), "p", "2", tag)
    assert calls == [1] and kept.load("p", "1", tag).count() == 3 and kept.load("p", "2", tag).count() == 1
    rows = spark.createDataFrame([("a", 1, "b", 2, 0.12345, 1.0)], store.SCORES)
    store.write_tsv(rows, str(tmp_path / "s"), store.SCORES)
    assert "".join(x.read_text() for x in (tmp_path / "s").glob("part*")) == "a\t1\tb\t2\t0.1235\t1.0000\n"
    (tmp_path / "p.tsv").write_text("pos\texact\tf\t1\t2\tn\tg\t3\t4\tm\nshort\trow\n")
    assert [(r.fa, r.lb) for r in store.read_tsv(spark, str(tmp_path / "p.tsv"), store.PAIRS).collect()] == [("f", 3)]
    pairs_ = spark.createDataFrame([("pos", "exact", "f", k, 1, "n", "g", k, 1, "m") for k in range(8)] + [("neg", "random", "f", 50, 1, "n", "g", 60, 1, "m"), ("neg", "random", "f", 70, 1, "n", "g", 70, 1, "m")], store.PAIRS)
    scores = spark.createDataFrame([("f", k, "g", k, k / 8, 1.0) for k in range(8)] + [("f", 50, "g", 60, 0.9, 0.9)], store.SCORES)
    got = store.judge_sample(pairs_, scores, 4).collect()
    assert {r.la for r in got if r.kind == "exact"} >= {0, 1} and sum(r.kind == "exact" for r in got) == 4 and [r.la for r in got if r.kind == "random"] == [50]
    assert store.judge_rows(pairs_, scores).where("jaccard is null").count() == 1


def test_code_mining_and_eval(spark, tmp_path):
    long = "def f(a, b):\n" + "".join(f"    x{k} = a + b * {k}\n" for k in range(8)) + "    return x1\n"
    for path, body in {"p-1.0/m.py": long, "p-2.0/m.py": long.replace("return x1", "return x2 - x3"), "q-0.1/n.py": long.replace("x", "yy").replace("def f", "def g")}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    units = corpus.workspace(spark, [str(tmp_path)]).persist()
    mined = codemining.mine(units).persist()
    got = {(r.label, r.kind) for r in mined.collect()}
    assert {("pos", "evolved_major")} <= got
    scored, skipped = store.eval_pairs(mined, units, files.unit_features(units))
    assert skipped == 0 and all(0 <= r.j <= r.c <= 1 for r in scored.collect())


def test_stream_refresh(spark, tmp_path):
    first = corpus.index_of(files.extract_units(files.drafted(spark, fx.PYTHON, "python"), "structural"))
    first.snapshot(str(tmp_path / "ix"), "start")
    saves = tmp_path / "saves"
    spark.createDataFrame([("draft.py", b"", 1), ("draft.py", fx.PYTHON_B.encode(), 2), ("new.py", fx.PYTHON.encode(), 1)], "path string, content binary, k int").selectExpr("path", "content", "timestamp_seconds(k) as saved").write.parquet(str(saves))
    seen = []
    stream = spark.readStream.schema(refresh.SAVES).parquet(str(saves))
    q = refresh.refresh_on_save(stream, str(tmp_path / "ix"), str(tmp_path / "cp"), on_snapshot=lambda ix, units: seen.append(units.count()), availableNow=True)
    q.awaitTermination(120)
    now = load(spark, str(tmp_path / "ix"))
    assert {(r["name"], r.file) for r in now.units.collect()} == {("steepest", "draft.py"), ("charge", "draft.py"), ("largest_step", "new.py"), ("settle", "new.py"), ("label", "new.py")} and seen == [5]
    # the batch runs again, as after a failure before its end was noted: the same units, once
    for x in ("0", ".0.crc"):
        (tmp_path / "cp/commits" / x).unlink()
    again = spark.readStream.schema(refresh.SAVES).parquet(str(saves))
    q = refresh.refresh_on_save(again, str(tmp_path / "ix"), str(tmp_path / "cp"), on_snapshot=lambda ix, units: seen.append(units.count()), availableNow=True)
    q.awaitTermination(120)
    assert seen == [5, 5] and sorted((r["name"], r.file) for r in load(spark, str(tmp_path / "ix")).units.collect()) == sorted((r["name"], r.file) for r in now.units.collect())


def test_services(spark, tmp_path):
    (tmp_path / "a.py").write_text(fx.PYTHON)
    (tmp_path / "b.py").write_text(fx.PYTHON_B)
    engine = service.Engine(spark, str(tmp_path))
    call = lambda tool, **a: service.rpc(engine, {"id": 1, "method": "tools/call", "params": {"name": tool, "arguments": a}})["result"]
    assert call("find_duplicates")["isError"]  # no marker yet
    (tmp_path / service.MARKER).write_text("")
    assert call("find_duplicates")["isError"]  # not built yet
    engine.build()
    assert json.loads(call("status")["content"][0]["text"])["functions"] == 5
    dupes = json.loads(call("find_duplicates", threshold=0.9)["content"][0]["text"])
    assert [{d["a"]["name"], d["b"]["name"]} for d in dupes] == [{"largest_step", "steepest"}]
    like = json.loads(call("find_similar", code=fx.PYTHON_B, language="python", k=1)["content"][0]["text"])
    assert {x["query"] for x in like} == {"steepest", "charge"} and all(x["text"] for x in like)
    near = json.loads(call("query_similar", file="b.py", name="steepest", k=2)["content"][0]["text"])
    assert near[0]["name"] == "largest_step"
    d = json.loads(call("diff_functions", a={"file": "a.py", "name": "settle"}, b={"code": fx.PYTHON_B, "language": "python", "name": "charge"})["content"][0]["text"])
    assert d["only_a"]
    assert call("diff_functions", a={"file": "../../etc/passwd"}, b={"code": ""})["isError"]
    assert service.rpc(engine, {"id": 2, "method": "nope"})["error"]["code"] == -32601 and service.rpc(engine, {"method": "x"}) is None
    assert len(service.rpc(engine, {"id": 3, "method": "tools/list"})["result"]["tools"]) == 5
    server = ThreadingHTTPServer(("127.0.0.1", 0), service.handler(engine))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    assert b"Alike functions" in urllib.request.urlopen(at + "/").read() and json.load(urllib.request.urlopen(at + "/api/status"))["stage"] == "complete"
    pairs_ = json.load(urllib.request.urlopen(f"{at}/api/pairs"))
    assert pairs_["pairs"] and not pairs_["truncated"]
    x = pairs_["pairs"][0]["a"]
    assert json.load(urllib.request.urlopen(f"{at}/api/fn?file={x['file']}&start={x['line']}&end={x['end']}"))["text"]
    for bad in (f"/api/fn?file={x['file']}&start=1&end=1", "/api/none"):
        try:
            urllib.request.urlopen(at + bad)
            raise AssertionError(bad)
        except urllib.error.HTTPError as e:
            assert e.code == 404
    server.shutdown()
    body = json.dumps({"id": 1, "method": "initialize"}).encode()
    assert service.framed(io.BytesIO(b"Content-Length: %d\r\n\r\n" % len(body) + body))["method"] == "initialize"
    said = service.lsp(engine, {"method": "textDocument/didSave", "params": {"textDocument": {"uri": f"file://{tmp_path}/b.py"}}})
    assert any("largest_step" in x["message"] for x in said[0]["params"]["diagnostics"])
    opened = service.lsp(engine, {"method": "textDocument/didOpen", "params": {"textDocument": {"uri": f"file://{tmp_path}/a.py"}}})
    assert any("steepest" in x["message"] for x in opened[0]["params"]["diagnostics"])
    actions = service.lsp(engine, {"id": 5, "method": "textDocument/codeAction", "params": {"textDocument": {"uri": f"file://{tmp_path}/b.py"}, "range": {"start": {"line": 3}}}})
    assert {x["command"]["command"] for x in actions[0]["result"]} == {c for _, c in service.ACTIONS} and actions[0]["result"][0]["command"]["arguments"][0]["line"] == 4


def test_dependencies_come_second(spark, tmp_path, monkeypatch):
    """The workspace answers first, then its dependencies too; pairs with them only if asked for."""
    from semblance.sources.deps import Package

    (tmp_path / "work").mkdir()
    (tmp_path / "dep").mkdir()
    (tmp_path / "work/a.py").write_text(fx.PYTHON)
    (tmp_path / "work" / service.MARKER).write_text("")
    (tmp_path / "dep/b.py").write_text(fx.PYTHON_B)
    monkeypatch.setattr(corpus, "packages_of", lambda root: [Package("dep", "1.0", str(tmp_path / "dep"))])
    engine = service.Engine(spark, str(tmp_path / "work"), store=str(tmp_path / "store"))
    stages, publish = [], engine.publish
    monkeypatch.setattr(engine, "publish", lambda index, stage: (publish(index, stage), stages.append((stage, engine.counts))))
    engine.build()
    assert not engine.failed and stages == [("workspace", (1, 3)), ("complete", (2, 5))] and engine.call("status", {})["stage"] == "complete"
    assert engine.find_duplicates({"threshold": 0.9}) == [] and len(engine.find_duplicates({"threshold": 0.9, "include_deps": True})) == 1


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text(fx.PYTHON)
    (tmp_path / "b.py").write_text(fx.PYTHON_B)
    assert cli.main(["dupes", str(tmp_path), "--threshold", "0.9"]) == 0
    assert "largest_step" in capsys.readouterr().out
    assert cli.main(["query", str(tmp_path / "a.py"), "--draft", str(tmp_path / "b.py"), "--k", "1"]) == 0
    assert "steepest: 1.000" in capsys.readouterr().out
    assert cli.main(["diff", str(tmp_path / "a.py"), str(tmp_path / "b.py"), "--a-name", "settle"]) == 0
    assert cli.main(["graph", str(tmp_path / "a.py"), "--name", "settle", "--out", str(tmp_path)]) == 0
    assert (tmp_path / "settle-round2.dot").exists()
    assert cli.main(["parse-stats", str(tmp_path), "--ext", "py", "--sample", "5"]) == 0
    capsys.readouterr()
    assert cli.main(["query", str(tmp_path / "a.py"), "--k", "1", "--", str(tmp_path / "b.py")]) == 0
    assert "steepest: 1.000" in capsys.readouterr().out
    assert cli.main(["dump-il", str(tmp_path / "b.py"), "--name", "charge"]) == 0
    assert capsys.readouterr().out.startswith("charge(rows, cost)  # lines 14 to 18\n  each row, rows\n")
    assert cli.main(["--weights", "call=3", "--iters", "0", "--with", "strings", "features", str(tmp_path), "--name", "charge"]) == 0
    assert capsys.readouterr().out.count("charge") > 5
    for bad in (["--with", "nothing"], ["--weights", "nothing=1"]):
        try:
            cli.main([*bad, "features", str(tmp_path)])
            raise AssertionError(bad)
        except SystemExit as e:
            assert "nothing" in str(e)


def test_shingles_by_arrays(spark):
    """The features of texts made many at a time are those of the raw rows, with long words, blanks and repeated ids."""
    rows = [(1, "A b\tC1 d  e"), (1, "a B c1 zz"), (2, None), (3, "x y"), (None, "a b c1"), (4, "É a b c " + "w" * 70 + " 1 2"), (5, "a b c a b c a b c")]
    rows += [(10 + k, " ".join(f"v{(k * i) % 7}" for i in range(30))) for k in range(20)]
    docs = spark.createDataFrame(rows, "fid bigint, text string")
    want = sorted(features.dedup_max(features.raw_shingle_features(docs, id_col="fid", text_col="text")).collect(), key=str)
    assert sorted(features.shingle_features(docs).collect(), key=str) == want
    once = docs.where("fid > 1")
    assert sorted(features.shingle_features(once, once=True).collect(), key=str) == [r for r in want if r.fid and r.fid > 1]
    pair = lambda rows: {(r.a, r.b): (r.a_features, r.b_features, r.j, r.c) for r in rows.collect()}
    from_rows, from_texts = pairs.scored_pairs(features.shingle_features(docs), threshold=0.3, cutoff=2), pairs.scored_pairs(None, threshold=0.3, cutoff=2, texts=docs)
    assert pair(from_rows) == pair(from_texts) and (1, None) not in pair(from_texts)
    brute = brute_pairs([(r.fid, r.h, r.w) for r in want if r.fid], 2)
    df = {h: n for h, n in features.document_frequency(features.shingle_features(docs)).collect()}
    assert {k: v[2:] for k, v in pair(from_texts).items()} == {k: v for k, v in brute.items() if max(v) >= 0.3} and max(df.values()) > 2


def test_containment_in_the_next(spark):
    """Across the ranges that ids are dealt out by, with gaps, texts without features, and negative, null and repeated ids."""
    words = lambda k: " ".join(f"w{i}" for i in range(k % 5, k % 5 + 8))
    rows = [(k, words(k)) for k in range(-3, 600) if k % 50 != 7] + [(9, "w1 w2 w3 a b"), (7, "too short"), (None, words(1))]
    got = {(r.a, r.b): r.c for r in pairs.containment_in_next(spark.createDataFrame(rows, "fid bigint, text string")).collect()}
    sig = {}
    for k, t in rows:
        ws = t.split()
        for s in zip(ws, ws[1:], ws[2:]):
            sig.setdefault(k, {})[s] = 5
            if not any(c.isdigit() for x in s for c in x):
                sig[k][s] = 10
    assert got == {(a, a + 1): sum(min(w, sig[a + 1].get(s, 0)) for s, w in sig[a].items()) / sum(sig[a].values()) for a in sig if a is not None and a + 1 in sig}


def test_tiles_of_many_blocks(spark, monkeypatch):
    """Candidates and scores over many small blocks, cut in small steps, with equal units in one block and in several, against brute force."""
    import random

    from semblance.operators import postings, tiles

    monkeypatch.setattr(postings, "FEW", 20)
    monkeypatch.setattr(postings, "HELD", 40)
    for name, value in (("STEP", 7), ("PAIRS", 5), ("CELLS", 16)):
        monkeypatch.setattr(tiles, name, value)
    rng = random.Random(4)
    sets = [[(rng.choice([rng.randrange(9), rng.randrange(40), 100 + f]), rng.choice([1, 5, 300])) for _ in range(9)] for f in range(14)]
    sets += [sets[k % 3] for k in range(16)]
    rows = [(f, h, w) for f, s in enumerate(sets) for h, w in sorted(dict(s).items())]
    df = spark.createDataFrame(rows, "fid bigint, h bigint, w int")
    want = brute_pairs(rows, 6)
    assert {tuple(r) for r in pairs.candidate_pairs(df, cutoff=6).collect()} == set(want)
    got = [tuple(r) for r in pairs.scored_pairs(df, threshold=0.3, metric="jaccard", cutoff=6).select("a", "b", "j", "c").collect()]
    assert len(got) == len(set(got)) and {(a, b): (j, c) for a, b, j, c in got} == {k: v for k, v in want.items() if v[0] >= 0.3}


def test_written_pairs_of_blocks_in_groups(spark, monkeypatch):
    """Tiles that a task has several of, blocks that come once for them: the same pairs as one by one, and all without a cutoff; the session's settings stay."""
    import random

    from semblance.operators import postings

    monkeypatch.setattr(postings, "FEW", 20)
    monkeypatch.setattr(postings, "HELD", 30)
    rng = random.Random(8)
    rows = [(f, h, w) for f in range(60) for h, w in sorted({rng.choice([rng.randrange(6), rng.randrange(60), 100 + f % 45]): rng.choice([5, 10]) for _ in range(9)}.items())]
    df, size = spark.createDataFrame(rows, "fid bigint, h bigint, w int"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for metric, cutoff in (("jaccard", features.ALL), ("jaccard", 4), ("max", features.ALL)):
        got = [(r.a, r.b, r.j, r.c) for r in pairs.scored_pairs(df, threshold=0.25, metric=metric, cutoff=cutoff, written=True).collect()]
        want = {k: v for k, v in brute_pairs(rows, cutoff).items() if (v[0] if metric == "jaccard" else max(v)) >= 0.25}
        assert len(got) == len(want) > 20 and {(a, b): (j, c) for a, b, j, c in got} == want
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == size


def test_weighted_jaccard_of_pairs_that_share_only_frequent_features(spark, tmp_path):
    """A passage of more documents than the cutoff makes all of them similar, however many rarer features each has; with a group of copies, and a pair just below."""
    import duckdb

    from semblance.queries import QUERIES, SQL

    passage = " ".join(f"p{'abcdefgh'[k % 8]}{'abcdefgh'[k // 8]}" for k in range(40))
    own = lambda k, n: " ".join(f"{k}x{i}" for i in range(n))
    rows = [(k, f"{own(k, 12)} {passage}") for k in range(110)] + [(200 + k, f"{own(7, 12)} {passage}") for k in range(3)]
    rows += [(300, f"{own(300, 76)} {passage}"), (301, passage), (302, f"{own(302, 77)} {passage}"), (400, "too short"), (401, None)]
    spark.createDataFrame([(k, "s", "en", t) for k, t in rows], "doc_id bigint, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sig = {}
    for k, t in rows:
        ws = (t or "").split()
        sig[k] = {s: 5 if any(c.isdigit() for x in s for c in x) else 10 for s in zip(ws, ws[1:], ws[2:])}
    weight, want = {k: sum(s.values()) for k, s in sig.items()}, {}
    for a in sorted(sig):
        for b in sorted(sig):
            s = sum(min(w, sig[b].get(x, 0)) for x, w in sig[a].items()) if a < b else 0
            if s and s / (weight[a] + weight[b] - s) >= 0.5:
                want[a, b] = s / (weight[a] + weight[b] - s)
    assert want[300, 301] == 0.5 and (301, 302) not in want and len(want) > 113 * 112 // 2
    got = [tuple(r) for r in QUERIES["weighted_jaccard"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and {(a, b): j for a, b, j in got} == want
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert {(a, b): j for a, b, j in con.execute(SQL["weighted_jaccard"]).fetchall()} == want


def test_ranks_without_all_hits(spark):
    """Ranks of targets from the query's rarest features alone, against the ranks among all hits; a target that is no hit has none."""
    import random

    from semblance.operators.postings import units_with_postings
    from semblance.sources.scratch import Workspace

    rng = random.Random(7)
    rows = [(f, h, w) for f in range(30) for h, w in sorted({rng.choice([rng.randrange(6), rng.randrange(40)]): rng.choice([5, 10]) for _ in range(9)}.items())]
    df = spark.createDataFrame(rows + [(90, 7, 5), (91, 900, 5)], "fid bigint, h bigint, w int")
    targets = spark.createDataFrame([(q, (7 * q + 3) % 30) for q in range(30) if (7 * q + 3) % 30 != q] + [(91, 2)], "qid bigint, fid bigint")
    work = Workspace(spark, tidies=False)
    hits = pairs.scored_hits(df.withColumnRenamed("fid", "qid"), df, cutoff=4).where("qid <> fid")
    want = {tuple(r) for r in search.rank_of(hits, targets).collect()}
    got = {tuple(r) for r in pairs.ranks_in_corpus(work.keep(units_with_postings(df)), targets, 4, work).collect()}
    assert got == want and len(want) > 10


def test_pairs_of_an_index_read_no_row_for_each_feature(spark):
    """Units extracted with their features meet by these arrays: the same pairs as by rows, with units that come twice too."""
    table = spark.createDataFrame([(f"{n}.py", fx.PYTHON.encode()) for n in "ab"] + [("c.py", fx.PYTHON_B.encode()), ("d.py", b"f = lambda x: x[1] + x[2], lambda y: g(y)\n")], "path string, content binary")
    index = corpus.index_of(files.extract_units(table, "structural").localCheckpoint())
    for flt in (search.PairFilter(threshold=0.3), search.PairFilter(threshold=0.999), search.PairFilter(threshold=0.5, metric="max")):
        got = index.duplicates(flt, sort=False).collect()
        rows = Index(index.units, index.features).duplicates(flt)
        assert got and sorted(got) == sorted(rows.collect())
    assert "Generate" not in index.lists._jdf.queryExecution().toString()


def test_sums_of_many_small_units_and_of_large_ones():
    import numpy as np

    from semblance.operators import tiles

    rng = np.random.default_rng(4)

    class Units:
        def __init__(self, sizes):
            self.start = np.concatenate([[0], np.cumsum(sizes)])
            self.h = np.concatenate([rng.choice(3 * n, n, replace=False) for n in sizes])
            self.w = rng.integers(1, 20, len(self.h)).astype(np.uint8)
            self.sig = [dict(zip(self.h[i:j].tolist(), self.w[i:j].tolist())) for i, j in zip(self.start, self.start[1:])]

    x, y = (Units([*rng.integers(1, 12, 40), *rng.integers(150, 300, 5)]) for _ in "xy")
    pairs_of = np.unique(rng.integers(0, 45 * 45, 900))
    a, b = pairs_of // 45, pairs_of % 45
    want = [sum(min(w, y.sig[j].get(h, 0)) for h, w in x.sig[i].items()) for i, j in zip(a, b)]
    assert tiles._sums(x, y, a, b).tolist() == want
    kept, tiles.STEP = tiles.STEP, 64
    try:
        assert tiles._sums(x, y, a, b).tolist() == want
    finally:
        tiles.STEP = kept
    assert tiles._sums(x, y, a[:0], b[:0]).tolist() == []
