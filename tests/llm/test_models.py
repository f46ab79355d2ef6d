"""Fitted operators: held-out accuracy, recall, mined rules; and the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from semblance.llm import neighbours, secrets, toxicity, urls
from semblance.llm.text import shingle_set, word_hashes


def test_hashes_ignore_blocks_and_ascii_case(monkeypatch):
    from semblance.llm import text

    s = "The quick\tBROWN fox É é jumps\n\nover " * 40 + "x" * 300
    whole = word_hashes(s)
    assert len(whole) == len(s.split()) and (whole == word_hashes(s.replace("BROWN", "brown"))).all()
    monkeypatch.setattr(text, "BLOCK", 64)
    assert (word_hashes(s) == whole).all()
    assert len(shingle_set(None)) == len(shingle_set(" \n")) == 0 and len(shingle_set("a b")) == 1


def test_toxicity_on_held_out_rows(spark, no_docs):
    rng = random.Random(2)
    plain, bad = [f"w{k}" for k in range(300)], ["nasty", "vile", "rotten", "foul"]
    rows = []
    for k in range(800):
        w = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        y = int(rng.random() < 0.25)
        for _ in range(y * rng.randint(3, 9)):
            w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", ".", "!"])
        rows.append((k, " ".join(w), y))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(None, None), (900, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y if k % 50 else None) for k, _, y in rows if k < 500] + [(1, rows[1][2])], "doc_id bigint, toxic int")
    model = toxicity.fit(toxicity.sample_of(docs, labels))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(got[k], y) for k, _, y in rows if k >= 500]
    assert np.mean([r.toxic == bool(y) for r, y in held]) > 0.95
    assert all(0 <= r.expected_severity <= toxicity.GRADES - 1 for r, _ in held)
    assert np.all(np.diff(model.thresholds) > 0)
    heavy = [r.expected_severity for r, y in held if y]
    assert min(heavy) > np.mean([r.expected_severity for r, y in held if not y])
    assert not got[None].toxic and not got[900].toxic
    kept = toxicity.drop_toxic(docs, model)
    assert kept.count() == sum(not r.toxic for r in got.values()) and kept.columns == docs.columns
    assert toxicity.score(no_docs, model).count() == 0
    none = toxicity.fit(toxicity.sample_of(docs, labels.where("toxic = 0")))
    assert not any(r.toxic for r in toxicity.score(docs, none).collect())


def test_toxicity_sample_is_bounded_by_rows(spark, monkeypatch):
    """An id in very many rows counts once; more rows than SAMPLE are refused; empty tables fit a model that rejects nothing."""
    docs = spark.range(50_000).selectExpr("bigint(7) as doc_id", "concat('text ', id % 3) as text").unionByName(spark.createDataFrame([(8, "vile words"), (None, "x")], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(7, 0), (8, 1), (9, 1), (None, 1), (8, None)], "doc_id bigint, toxic int")
    got = sorted((r.text[:4], r.toxic) for r in toxicity.sample_of(docs, labels).collect())
    assert got == [("text", 0), ("vile", 1)]
    monkeypatch.setattr(toxicity, "SAMPLE", 1)
    try:
        toxicity.fit(toxicity.sample_of(docs, labels, rows=5))
        raise AssertionError
    except ValueError as e:
        assert "more than 1" in str(e)
    monkeypatch.undo()
    none = labels.limit(0)
    for d, lab in ((docs, none), (docs.limit(0), labels), (docs.limit(0), none)):
        model = toxicity.fit(toxicity.sample_of(d, lab))
        assert not any(r.toxic for r in toxicity.score(docs.where("doc_id = 8 or doc_id is null"), model).collect())


def test_fit_against_a_plain_optimiser():
    """The penalised likelihood of the fit against descent by numeric differences on a function written anew."""
    rng = np.random.default_rng(12)
    x = np.log1p(rng.poisson(0.8, (300, 3)).astype(float))
    true = np.array([1.5, -0.5, 0.8])
    noise = rng.logistic(size=300)
    grade = np.digitize(x @ true + noise, [0.5, 1.6, 2.8])

    def loss(p):
        w, theta = p[:3], np.sort(p[3:])
        cum = lambda k: np.ones(300) if k == 3 else (np.zeros(300) if k < 0 else 1 / (1 + np.exp(x @ w - theta[k])))
        by_grade = np.stack([cum(k) - cum(k - 1) for k in range(4)], axis=1)
        return -np.log(np.maximum(by_grade[np.arange(300), grade], 1e-12)).mean() + toxicity.RIDGE / 2 * (w @ w)

    p = np.array([0.0, 0, 0, 0, 1, 2])
    for _ in range(1500):
        g = np.array([(loss(p + d) - loss(p - d)) / 2e-5 for d in 1e-5 * np.eye(6)])
        p = p - 0.5 * g
    row, col = np.nonzero(x)
    w, theta = toxicity._maximise(toxicity.Sparse(row, col, x[row, col], x.shape), grade)
    assert loss(np.concatenate([w, theta])) <= loss(p) + 1e-3 and np.abs(w - p[:3]).max() < 0.1 and np.abs(theta - p[3:]).max() < 0.15


def brute(rows, k=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    for q in sorted({i for i in ids.tolist() if i % 20 == 0}):
        s = x @ x[ids.tolist().index(q)]
        keep = ids != q
        o = np.lexsort((ids[keep], -s[keep]))[:k]
        yield q, ids[keep][o].tolist(), s[keep][o]


def vectors(n):
    rng = np.random.default_rng(4)
    out = [(k, rng.normal(size=16).round(3).tolist()) for k in range(n)]
    out += [(n + k, out[40][1]) for k in range(60)]  # equal vectors
    return [*out, (None, out[0][1]), (n + 100, None), (n + 101, [0.0] * 16), (n + 102, [float("nan")] * 16), (n + 103, [1.0, None] * 8), (n + 104, [1.0]), (n + 105, [float("inf")] * 16), out[7]]


def test_neighbours_exact_on_a_small_table(spark, scratch):
    rows = vectors(300)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, c1 int")
    got = {}
    for r in neighbours.nearest_neighbours(df, scratch).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = list(brute(rows))
    assert set(got) == {q for q, _, _ in want}
    for q, ids, scores in want:
        found = sorted(got[q])
        assert [x[0] for x in found] == list(range(1, len(ids) + 1))
        assert [x[1] for x in found] == ids and np.allclose([x[2] for x in found], scores)
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert neighbours.nearest_neighbours(empty, scratch).count() == 0


def found_by(df, scratch, **named):
    got = {}
    for r in neighbours.nearest_neighbours(df, scratch, **named).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return got


def test_neighbours_recall_and_blocks(spark, scratch, monkeypatch):
    """With pruning in force: without clusters at the default share, with clusters at a tenth of it."""
    monkeypatch.setattr(neighbours, "PROBE", 50)
    monkeypatch.setattr(neighbours, "BLOCK", 37)
    monkeypatch.setattr(neighbours, "LEAST_BLOCK", 40)
    rows = vectors(2000)
    got = found_by(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), scratch)
    want = list(brute(rows))
    assert np.mean([len(got[q] & set(ids)) / len(ids) for q, ids, _ in want]) >= 0.9
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(50, 16))
    rows = [(k, (centres[k % 50] + 0.15 * rng.normal(size=16)).tolist()) for k in range(3000)]
    got = found_by(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), scratch, probe=3000 * 35 // 1000)
    want = list(brute(rows))
    assert np.mean([len(got[q] & set(ids)) / len(ids) for q, ids, _ in want]) >= 0.9


def test_traversal_against_all_pairs():
    """Visited pairs hold enough entries, and all pairs nearer than the nearest one left out are among them, but for a stride."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        k, want = rng.integers(1, 12), int(rng.integers(1, 80))
        books, q = (rng.normal(size=(k, 3)), rng.normal(size=(k, 3))), rng.normal(size=6)
        counts = rng.poisson(0.7, (k, k))
        first, most = neighbours.traverse(q, books, counts, want)
        d1, d2 = -(books[0] @ q[:3]), -(books[1] @ q[3:])
        seen = np.zeros((k, k), bool)
        for i, m in zip(first, most, strict=True):
            seen[i] = d2 <= m
        assert counts[seen].sum() >= min(want, counts.sum())
        total, stride = d1[:, None] + d2[None, :], neighbours.STRIDE * np.ptp(d2)
        if (~seen & (counts > 0)).any() and seen.any():
            assert total[seen].max() <= total[~seen & (counts > 0)].min() + 2 * stride + 1e-9 or counts[seen & (total < total[seen].max())].sum() < want


def test_rows_of_one_id_ask_once(spark, scratch):
    """Of different vectors under one id the same one asks, however the rows are dealt out."""
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(60)] + [(20, rng.normal(size=8).tolist()) for _ in range(5)]
    runs = []
    for n in (1, 4):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(n)
        runs.append(sorted(map(tuple, neighbours.nearest_neighbours(df, scratch).where("query_id = 20").collect())))
    assert runs[0] == runs[1] and len(runs[0]) == 20 and all(v != 20 for _, _, v, _ in runs[0])


def test_url_rules(spark, scratch):
    rows = [
        (1, "https://a.Example.ORG/es/1"), (2, "http://org/"), (3, "http://org"), (4, "https://x.example.com/fr/a?b#c"), (5, "https://example.com/de/1"),
        (6, None), (7, "no scheme"), (8, "http://notorg/"), (9, "https://example.org/en/12"), (10, "ftp://h.net?x=/a://b"), (11, "https://fexample.org/es/"), (1, "https://a.Example.ORG/es/1"), (None, "http://a.net/x"),
    ]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id bigint, url string, host string, hit int")
    none = urls.mine(spark.createDataFrame([], "url string, bad boolean"), scratch)
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, none).collect()}
    assert got == {
        (1, "a.example.org", "/es/1", "example.org/es/", "block"), (2, "org", "/", "org/", "allow"), (3, "org", "", None, "allow"), (4, "x.example.com", "/fr/a", "com/fr/", "allow"), (5, "example.com", "/de/1", "com/de/", "block"),
        (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "notorg", "/", None, "allow"), (9, "example.org", "/en/12", "example.org/en/1", "block"), (10, "h.net", "", None, "allow"), (11, "fexample.org", "/es/", "org/", "allow"), (None, "a.net", "/x", None, "allow"),
    }
    assert urls.judge(pages.limit(0), none).count() == 0


def test_url_mining(spark, scratch):
    rows = [(f"https://{'win' if k % 4 == 0 else 'good'}.site.net/{'casino' if k % 4 == 0 and k % 3 else 'news'}/{k}", k % 4 == 0 and k % 3 > 0) for k in range(240)]
    labelled = spark.createDataFrame([*rows, (None, True), ("https://a.b/", None)], "url string, bad boolean")
    rules = urls.mine(labelled, scratch)
    got = {tuple(r.tokens): r for r in rules.collect()}
    n = len(rows)
    for tokens, r in got.items():
        has = [bad for url, bad in rows if all(t[2:] in url for t in tokens)]
        assert abs(r.confidence - np.mean(has)) < 1e-9 and r.confidence >= urls.MIN_CONFIDENCE
        assert r.key in tokens and sum(has) / n >= urls.MIN_SUPPORT
    assert ("p:casino",) in got and not any(set(a) < set(b) for a in got for b in got if got[a].confidence >= got[b].confidence)
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "page_id bigint, url string")
    judged = {r.page_id: r.verdict for r in urls.judge(pages, rules).collect()}
    for k, (url, bad) in enumerate(rows):
        assert (judged[k] == "block") == any(all(t[2:] in url for t in tokens) for tokens in got)
        assert judged[k] == "block" or not bad


def test_url_mining_needs_several_pages(spark, scratch):
    """One bad page, or a few, give no rule however few rows are labelled; equal tokens are mined once; wide URLs stay bounded."""
    clean = [(f"https://site{k % 7}.net/news/{'abcdefg'[k % 7]}", False) for k in range(90)]
    one = [("https://odd.example.net/casino/win", True)]
    schema = "url string, bad boolean"
    assert urls.mine(spark.createDataFrame(clean + one, schema), scratch).count() == 0
    assert urls.mine(spark.createDataFrame(clean + one * (urls.MIN_COUNT - 1), schema), scratch).count() == 0
    assert urls.mine(spark.createDataFrame(one * urls.MIN_COUNT, schema), scratch).count() == 0  # no lift
    got = urls.mine(spark.createDataFrame(clean + one * urls.MIN_COUNT, schema), scratch).collect()
    assert [len(r.tokens) for r in got] == [1] and got[0].support == urls.MIN_COUNT / 95
    wide = [(f"https://w.net/{'/'.join(f'x{j}' for j in range(40) if j != k)}", True) for k in range(12)]
    got = urls.mine(spark.createDataFrame(clean + wide + [(None, True), ("no scheme", False)], schema), scratch).collect()
    assert got and all(len(r.tokens) <= urls.WIDTH and r.confidence == 1.0 for r in got)
    long = "https://w.net/" + "x" * 100_000 + "/x1"
    pages = spark.createDataFrame([(1, long), (2, wide[0][0]), (3, None)], "page_id bigint, url string")
    rules = spark.createDataFrame([(["p:x1"], 1.0, 0.1, "p:x1")], "tokens array<string>, confidence double, support double, key string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, rules).collect()} == {1: "block", 2: "block", 3: "allow"}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from semblance.llm.common import documents

    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "secrets", "mix", "pack"]
    docs = documents(spark, sf)
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert counts[0] > counts[1] >= counts[2] == counts[3] and counts[4] and counts[5]
    texts = [r.text for r in spark.read.parquet(f"{tmp_path}/2").collect()]
    from semblance.llm.secrets import scan

    assert not any(k in ("access", "hex") for t in texts for k, _, _ in scan(t)[0])
    want = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in docs.collect())
    assert want == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())


def tagged(text, model):
    """P(any grade) of a text, word by word."""
    counts = {}
    for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or ""):
        if w:
            k = int(model.feature[int(word_hashes(w)[0] % np.uint64(toxicity.BUCKETS))])
            counts[k] = counts.get(k, 0) + 1
    tilt = sum(model.weights[k] * np.log1p(n) for k, n in counts.items() if k >= 0)
    return 1 - 1 / (1 + np.exp(tilt - model.thresholds[0]))


def test_pipeline_by_hand(spark, tmp_path):
    """Each stage over what the one before kept, against a version of it without Spark: nulls, blanks, repeated rows, clashing and extra columns."""
    import corpus_pipeline
    from test_texts import components_by_hand, tokenizer

    rng = random.Random(77)
    plain, bad = [f"word{k}" for k in range(400)], ["nasty", "vile", "rotten", "foul"]
    texts = []
    for k in range(150):
        w = [rng.choice(plain) for _ in range(rng.randint(12, 120))]
        for _ in range(6 if k % 5 == 0 else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w))
    texts += [texts[1] + " tail", texts[2], "password=longenough1 " + " ".join(reversed(texts[3].split())), "client_id=acme-prod-77 key x9Kd83jfLs02mQpZ7aRtY5wE", "", "  ", None, " ".join(t for k, t in enumerate(texts[:60]) if k % 5) * 3]
    rows = [(k, t, rng.choice(["en", "de", "fr", None]), rng.choice(["a", "a", "b", None]), None if t is None else len(t), 7) for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[7], "en", "b", 3, 7), (None, None, None, None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, node int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(0, 120)] + [(None, 1), (3, None)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    model = toxicity.fit(toxicity.sample_of(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = [tuple(r) for r in docs.collect()]
        if name != "pack":
            assert docs.columns == [x.split(" ")[0] for x in schema.split(", ")]
        if name == "toxicity":
            assert Counter(after) == Counter(r for r in before if tagged(r[1], model) < toxicity.REJECT)
            assert len(before) - len(after) >= 25 and {r[0] for r in rows if r[0] is None or 120 <= r[0] < 157 and r[0] % 5} <= {r[0] for r in after}
        if name == "near_duplicates":
            sets, roots, _ = components_by_hand(before, 80)
            stay = {}
            for r, s, root in zip(before, sets, roots, strict=True):
                if s:
                    stay[root] = min(stay.get(root, (True, 0)), (r[0] is None, r[0] or 0))
            want = [r[0] for r, s in zip(before, sets, strict=True) if not s] + [None if none else i for none, i in stay.values()]
            assert Counter(r[0] for r in after) == Counter(want) and set(after) <= set(before) and len(after) < len(before)
        if name == "secrets":
            clean = [(r[0], None if r[1] is None else secrets.redact(r[1], secrets.scan(r[1])[1]), *r[2:]) for r in before]
            assert Counter(after) == Counter((r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1]), r[5]) for r in clean)
            assert sum("[assign]" in (r[1] or "") for r in after) == 1 and sum("[random]" in (r[1] or "") for r in after) == 1
        if name == "mix":
            assert set(after) <= set(before)
            size = lambda r: len((r[1] or "").split())
            total, took = Counter(), Counter()
            for r in before:
                total[r[3]] += size(r)
            for r in after:
                took[r[3]] += size(r)
            n = Counter(after)
            assert all(n[r] <= 3 * Counter(before)[r] for r in n)
            weight = dict(zip(sorted(total, key=lambda s: (s is None, s or "")), (5, 2, 1), strict=False))
            target, open_ = {}, set(total)
            while over := {s for s in open_ if (sum(total.values()) - sum(target.values())) * weight[s] / sum(weight[x] for x in open_) > 3 * total[s]}:
                target |= {s: 3 * total[s] for s in over}
                open_ -= over
            left = sum(total.values()) - sum(target.values())
            target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            # the document that is taken in part comes whole or not at all
            assert all(abs(took[s] - target[s]) <= max(size(r) for r in before) / 2 + 1 for s in total)
        if name == "pack":
            enc, want = tokenizer(), Counter()
            for r in before:
                ids = np.array(enc.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
                head, at = len(ids) % 1024, 0
                for j, m in enumerate(([head] if head else []) + [1024] * (len(ids) // 1024)):
                    want[r[0], j, at, m, zlib.crc32(ids[at : at + m].tobytes())] += 1
                    at += m
            got = docs.collect()
            assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
            fill = Counter()
            for r in got:
                fill[r.sequence_id] += r.length
            assert max(fill.values()) <= 1024 and len(fill) <= sum(fill.values()) / 1024 * 1.1 + 1
        kept[name] = after
    assert Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(r[:5] for r in kept["pack"])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rules_of_frequent_tokens_in_wide_urls(spark, scratch):
    """A rule of the two most frequent tokens is found in URLs with more mined tokens than WIDTH."""
    # ten rarer tokens, each sure of nothing, stand beside the two
    rows = [(f"https://w.net/{'/'.join(['aa'] * (k % 2) + ['bb'] * (k // 2 % 2) + [f'x{j}' for j in range(12) if (k * 7 + j * j) % 5 < 2 or k % 4 == 3 and k % 3 == 0])}", k % 4 == 3) for k in range(240)]
    got = {tuple(r.tokens): r for r in urls.mine(spark.createDataFrame(rows, "url string, bad boolean"), scratch).collect()}
    assert got["p:aa", "p:bb"].confidence == 1.0 and got["p:aa", "p:bb"].support == 0.25
