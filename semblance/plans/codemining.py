"""Ground truth from source code: exact, renamed and evolved pairs, and negatives, as labelled pairs."""

from __future__ import annotations

import keyword
import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import VERSIONED
from . import mining

# Reserved words by language.
RUST = "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while".split()
C = "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while".split()
CPP = C + "alignas alignof bool catch class constexpr decltype delete dynamic_cast explicit export false friend mutable namespace new noexcept nullptr operator override private protected public reinterpret_cast static_assert static_cast template this throw true try typeid typename using virtual".split()
OCAML = "and as assert begin class constraint do done downto else end exception external false for fun function functor if in include inherit initializer lazy let match method module mutable new nonrec object of open or private rec sig struct then to true try type val virtual when while with".split()
PYTHON = keyword.kwlist
KEYWORDS = {".py": set(PYTHON), ".c": set(C), ".h": set(C), ".ml": set(OCAML), ".mli": set(OCAML)} | dict.fromkeys((".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx", ".cppm"), set(CPP))
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def normalize(tokens: list[str], file: str) -> list[str]:
    """Names to $, but for reserved words, what is called or a path or macro, and members."""
    words = KEYWORDS.get(os.path.splitext(file)[1], set(RUST))
    out = []
    for k, t in enumerate(tokens):
        before, after = tokens[k - 1] if k else "", tokens[k + 1] if k + 1 < len(tokens) else ""
        free = NAME.match(t) and t not in words and after not in ("(", "::", "!") and before not in ("::", ".", "->")
        out.append("$" if free else t)
    return out


def normalized(tokens: Column, file: Column) -> Column:
    """normalize() on columns."""
    words = F.lit(None).cast("array<string>")
    ext = F.regexp_extract(F.coalesce(file, F.lit("")), r"(\.[^./]+)$", 1)
    for reserved in (PYTHON, C, CPP, OCAML):
        words = F.when(ext.isin(*sorted(x for x, w in KEYWORDS.items() if w == set(reserved))), F.array(*map(F.lit, reserved))).otherwise(words)
    words = F.coalesce(words, F.array(*map(F.lit, RUST)))

    def one(t: Column, k: Column) -> Column:
        before, after = F.coalesce(F.get(tokens, k - 1), F.lit("")), F.coalesce(F.get(tokens, k + 1), F.lit(""))
        free = t.rlike("^[A-Za-z_][A-Za-z0-9_]*\\z") & ~F.array_contains(words, t) & ~after.isin("(", "::", "!") & ~before.isin("::", ".", "->")
        return F.when(free, "$").otherwise(t)

    return F.transform(tokens, one)


def package_of(file: Column) -> dict[str, Column]:
    """crate, inner path, version and its major part by the first path component like name-1.2; without one null, null and empty strings."""
    parts = F.split(F.coalesce(file, F.lit("")), "/")
    at = F.get(F.filter(F.transform(parts, lambda p, k: F.struct(p.alias("p"), k.alias("k"))), lambda x: x["p"].rlike(VERSIONED)), F.lit(0))
    version = F.when(at.isNull(), "").otherwise(F.regexp_extract(at["p"], VERSIONED, 2))
    nums = F.regexp_extract_all(version, F.lit(r"\d+"), F.lit(0))
    major = F.when(F.get(nums, F.lit(0)) == "0", F.array_join(F.slice(nums, 1, 2), ".")).otherwise(F.coalesce(F.get(nums, F.lit(0)), F.lit("")))
    inner = F.when(at.isNotNull(), F.array_join(F.slice(parts, at["k"] + 2, F.size(parts)), "/"))
    return {"crate": F.when(at.isNotNull(), F.regexp_extract(at["p"], VERSIONED, 1)), "inner": inner, "version": version, "major": major}


def code_entities(units: DataFrame) -> DataFrame:
    """Entities of extracted units (no lambdas) with 30 tokens or more, with name, line_end and package."""
    rows = units.where(F.col("error").isNull() & ~F.col("name").endswith("<lambda>")).withColumn("line", F.col("line_start")).withColumn("normal", normalized(F.col("tokens"), F.col("file")))
    keys = mining.entities(rows, min_tokens=mining.MIN_TOKENS)
    rkey = rows.select("fid", F.md5(F.array_join("normal", " ")).alias("rkey"))
    more = units.select("fid", "name", "line_end", *[c.alias(k) for k, c in package_of(F.col("file")).items()])
    return keys.drop("rkey").join(rkey, "fid").join(more, "fid")


def mine(units: DataFrame) -> DataFrame:
    """Labelled pairs of places: label, kind, fa, la, la_end, na, fb, lb, lb_end, nb."""
    ents = code_entities(units).persist()
    place = {s: ents.select(F.col("fid").alias(s), F.col("file").alias(f"f{s}"), F.col("line").alias(f"l{s}"), F.col("line_end").alias(f"l{s}_end"), F.col("name").alias(f"n{s}"), F.col("ekey").alias(f"e{s}")) for s in "ab"}
    pos = mining.partners(ents, "rkey").select("a", "b").withColumn("kind", F.lit(None).cast("string"))
    # versions of one function: same package, inner path and name, name unique in its file
    unique = ents.join(ents.groupBy("file", "name").agg(F.count(F.lit(1)).alias("n")).where("n = 1"), ["file", "name"]).where("crate is not null")
    steps = mining.evolved(unique.withColumn("v", F.struct("version", "fid", "major")), ["crate", "inner", "name"], "v", "rkey")
    evolved = steps.select(F.col("a.fid").alias("a"), F.col("b.fid").alias("b"), F.when(F.col("a.major") == F.col("b.major"), "evolved").otherwise("evolved_major").alias("kind"))
    positive = pos.unionByName(evolved).join(place["a"], "a").join(place["b"], "b").withColumn("label", F.lit("pos"))
    positive = positive.withColumn("kind", F.coalesce("kind", F.when(F.col("ea") == F.col("eb"), "exact").otherwise("renamed")))
    want = max(100, positive.count())
    random = mining.random_negatives(ents, want).withColumn("kind", F.lit("random"))
    same = mining.same_file_negatives(ents).orderBy(F.md5(F.col("a").cast("string"))).limit(want // 2).select("a", "b", F.lit("samefile").alias("kind"))
    negative = random.unionByName(same).join(place["a"], "a").join(place["b"], "b").withColumn("label", F.lit("neg"))
    return positive.unionByName(negative.select(positive.columns)).select("label", "kind", "fa", "la", "la_end", "na", "fb", "lb", "lb_end", "nb")
