"""Command line: features, dupes, query, diff, graph, dump-il, parse-stats, mine, eval, rank, judge-sample, corpus, serve, rpc, lsp."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .frontend import functions_of
from .frontend.dataflow import Channels
from .frontend.il import dump
from .frontend.signature import TAG_WEIGHTS, Options
from .functions.text import split_list
from .operators import stats
from .operators.pairs import scored_hits
from .operators.search import PairFilter, QueryFilter, rank_of
from .plans import codemining, corpus, diagnose, dot
from .sources import store
from .sources.files import extract_units, local_files, read_sources, unit_features


CHANNELS = tuple(f.name for f in fields(Channels) if f.name != "rounds")


def session() -> SparkSession:
    spark = SparkSession.builder.appName("semblance").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="semblance", description=__doc__)
    p.add_argument("--profile", choices=("structural", "full"), default="structural")
    p.add_argument("--iters", type=int, help="rounds of propagation, for every language")
    p.add_argument("--with", dest="channels", default="", help=f"channels to add, or to take away with not_ before: {', '.join(CHANNELS)}")
    p.add_argument("--weights", default="", help="tag=tenths,... of " + ", ".join(TAG_WEIGHTS))
    sub = p.add_subparsers(dest="command", required=True)

    def add(command: str, /, *positional: str, **options):
        c = sub.add_parser(command)
        for x in positional:
            c.add_argument(x, nargs="+" if x == "paths" else None)
        for k, v in options.items():
            c.add_argument(f"--{k.replace('_', '-')}", default=v, type=type(v) if v is not None else str)
        return c

    filters = {"name": "", "include": "", "exclude": "", "min_lines": 0, "min_features": 0}
    add("features", "paths", name="")
    add("dupes", "paths", threshold=0.5, metric="jaccard", limit=0, **filters)
    add("query", "paths", draft="", threshold=0.25, k=5, **filters)
    add("diff", "a", "b", a_name=None, b_name=None)
    add("graph", "path", name=None, out=".")
    add("dump-il", "paths", name="")
    add("parse-stats", "paths", ext="", sample=0, worst=10)
    add("mine", "paths", out="pairs.tsv")
    add("eval", "pairs", "root", scores_out="")
    add("rank", "pairs", "root")
    add("judge-sample", "pairs", "scores", quota=20, out="sample.tsv")
    add("corpus", "root", store="sigstore")
    add("serve", "root", port=8737, store="")
    add("rpc", "root", store="")
    add("lsp", "root", store="")
    return p


def options_of(a) -> Options:
    """--iters, --with and --weights; names that are none are refused."""
    extra = tuple(split_list(a.channels))
    weights = {k: int(v) for k, _, v in (x.partition("=") for x in split_list(a.weights))}
    if unknown := [x for x in extra if x.removeprefix("not_") not in CHANNELS] + [x for x in weights if x not in TAG_WEIGHTS]:
        raise SystemExit(f"unknown: {', '.join(unknown)}")
    return Options(a.iters, extra, weights or None)


def read(path: str) -> tuple[str, str]:
    with open(path, encoding="utf-8", errors="replace") as f:
        return path, f.read()


def pair_filter(a) -> PairFilter:
    return PairFilter(a.threshold, a.metric, a.min_lines, a.min_features, a.name, tuple(split_list(a.include)), tuple(split_list(a.exclude)), limit=a.limit)


def main(argv: list[str] | None = None) -> int:
    argv, after = list(sys.argv[1:] if argv is None else argv), []
    if "--" in argv:  # query PATHS -- DRAFTS
        at = argv.index("--")
        argv, after = argv[:at], argv[at + 1 :]
    a = parser().parse_args(argv)
    options = options_of(a)
    if a.command == "diff":
        print(json.dumps(diagnose.diff_sources(read(a.a), read(a.b), a_name=a.a_name, b_name=a.b_name), indent=2))
        return 0
    if a.command == "graph":
        g = diagnose.graph_of(*read(a.path), a.name, options=options)
        for r in range(len(g.levels)):
            with open(f"{a.out}/{dot.file_name(a.name or 'function', r)}", "w") as f:
                f.write(dot.dot(g, a.name or "function", r))
        return 0
    if a.command == "dump-il":
        for path in a.paths:
            for fn in functions_of(*read(path))[1]:
                if not a.name or fn.name == a.name:
                    print(dump(fn), end="\n\n")
        return 0
    if a.command in ("serve", "rpc", "lsp"):
        from . import service

        return service.start(a.command, session(), a.root, a.profile, getattr(a, "port", 0), a.store)
    spark = session()
    workspace = lambda paths: corpus.workspace(spark, paths, a.profile, options)
    if a.command == "features":
        units = workspace(a.paths).where(F.col("error").isNull() & ((F.lit(a.name) == "") | (F.col("name") == a.name)))
        for r in units.select("file", "name", F.explode("features").alias("x")).select("file", "name", "x.*").orderBy("file", "name", "h").toLocalIterator():
            print(f"{r.file}\t{r['name']}\t{r.h:016x}\t{r.w}\t{r.tag}")
    elif a.command == "dupes":
        for r in corpus.index_of(workspace(a.paths)).duplicates(pair_filter(a)).toLocalIterator():
            print(f"{r.j:.3f} {r.c:.3f} {r.a_file}:{r.a_line_start} {r.a_name}  {r.b_file}:{r.b_line_start} {r.b_name}")
    elif a.command == "query":
        index = corpus.index_of(workspace(a.paths))
        drafts = extract_units(local_files(spark, [*after, *([a.draft] if a.draft else [])]), a.profile, options=options)
        flt = QueryFilter(a.threshold, a.min_lines, a.min_features, a.name, tuple(split_list(a.include)), tuple(split_list(a.exclude)), limit=a.k)
        names = drafts.select(F.col("fid").alias("qid"), F.col("name").alias("q_name"))
        for r in index.search(unit_features(drafts).withColumnRenamed("fid", "qid"), flt).join(names, "qid").orderBy("q_name", "rank").toLocalIterator():
            print(f"{r.q_name}: {r.jaccard:.3f} {r.containment:.3f} {r['name']} {r.file}:{r.line_start}")
    elif a.command == "parse-stats":
        files = read_sources(spark, a.paths)
        if a.ext:
            files = files.where(F.col("path").endswith(a.ext if a.ext.startswith(".") else f".{a.ext}"))
        if a.sample:
            files = stats.even_sample(files, a.sample, "path")
        units = extract_units(files, a.profile, options=options).persist()
        diagnose.parse_stats(units).orderBy("lang").show(1000, truncate=False)
        diagnose.worst_files(units, a.worst).show(a.worst, truncate=False)
    elif a.command == "mine":
        store.write_tsv(codemining.mine(workspace(a.paths)), a.out, store.PAIRS)
    elif a.command == "judge-sample":
        sample = store.judge_sample(store.read_tsv(spark, a.pairs, store.PAIRS), store.read_tsv(spark, a.scores, store.SCORES), a.quota)
        store.write_tsv(sample, a.out, store.JUDGED)
    elif a.command in ("eval", "rank"):
        units = workspace([a.root])
        features = unit_features(units).persist()
        scored, skipped = store.eval_pairs(store.read_tsv(spark, a.pairs, store.PAIRS), units, features)
        if a.command == "eval":
            stats.rates(scored, "label", "kind").orderBy("label", "kind").show()
            if a.scores_out:
                store.write_tsv(scored, a.scores_out, store.SCORES)
        else:
            pos = scored.where("label = 'pos'").persist()
            asked = features.join(pos.select(F.col("a").alias("fid")).distinct(), "fid", "left_semi").withColumnRenamed("fid", "qid")
            hits = scored_hits(asked, features).where("qid <> fid")
            ranks = rank_of(hits, pos.select(F.col("a").alias("qid"), F.col("b").alias("fid"))).select(F.col("qid").alias("a"), F.col("fid").alias("b"), "rank")
            stats.retrieval(pos.join(ranks, ["a", "b"], "left").select("kind", F.coalesce("rank", F.lit(0)).alias("rank"))).orderBy("kind").show()
        print(f"skipped {skipped}")
    elif a.command == "corpus":
        corpus.with_dependencies(spark, [a.root], a.store, a.profile, options).groupBy("origin").count().show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
