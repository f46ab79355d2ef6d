"""Mixing sources to target weights by entropy balancing.

Each word of a document carries the base rate 1. The mix is the set of rates r nearest to it in Kullback-Leibler
divergence such that every source's words meet its target, while the words of each language and the mean
log length stay as near to the corpus' own as SLACK allows; no rate exceeds ``cap``. The dual of that problem is convex:

    D(a, b) = sum n phi(a_source + b.x) - sum target a - sum moment b + SLACK words |b|^2 / 2

over documents of n words with features x (language, log length), phi being exp up to the cap and its tangent beyond.
Documents of one source, language and length band have one rate, exp(a_source + b.x), so they are summed up
once, into a row for each source, and Newton's steps run over these sums. For any b the best a of a source follows from its row; so a
step is one aggregation, whose fixed number of sums gives value, gradient and curvature of the dual in b with the sources
eliminated. Steps are halved until the dual falls enough, and end when the moments hold to RESIDUAL; the targets hold throughout.

Rates become copies: every document gets floor(rate) of them, and the documents of least (random number - rest of the
rate) one more until the source's target is met; the last one of these is taken in part. Where that falls is found by
sums over ever finer slices, so no task orders a source.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, documents, let, words

#: Sources by code point take these weights in turn.
WEIGHTS = (5, 2, 1)
CAP = 3
#: Languages with a constraint of their own; all others (English, unknown and null) together are held by what is left of the total.
LANGUAGES = ("de", "es", "fr")
#: Words (as a share of the corpus, for a multiplier of 1) by which a language or the mean length may miss its moment.
SLACK = 0.02
#: Bands of the logarithm of a document's length in a unit.
BANDS = 8
#: Largest miss of a moment, as a share of all words, at which Newton's steps end; steps at most; decimals kept of a multiplier; rounds for a source.
RESIDUAL, STEPS, DECIMALS, ROUNDS = 1e-10, 60, 6, 25
#: Bits of a slice. Slices go by three parts of the priority, by the id's hash and by the row; a source has 2 ** SLICE_BITS of them at most.
SLICE_BITS = 11
K = len(LANGUAGES) + 1
NAMES = (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"), ("lang_col", "lang"))


class Solution(NamedTuple):
    """Multipliers: a of each source (sid, a), b of the features; the largest share of all words by which the moments are missed; steps."""

    sources: DataFrame
    b: list[float]
    residual: float
    steps: int


def numbered(per: DataFrame, scratch: Scratch) -> DataFrame:
    """per(source, ...) with sid: its place by code point from 0, null last. Places come from the sizes of ordered partitions."""
    dealt = scratch.keep(per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    inside = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    # a row for each partition
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("k")
    return dealt.withColumn("inside", inside).join(sizes.select("part", before.alias("before")), "part").withColumn("sid", F.col("before") + F.col("inside") - 1).drop("part", "inside", "before")


def source_targets(sized: DataFrame, scratch: Scratch, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, sid, source_size, target, full) of a table (source, size).

    Sources by code point, null last, take the weights in turn and share all words; a target stops at
    cap times its source's size and the excess is shared again by weight until none is above: each
    round is one sum over the sources.
    """
    per = numbered(sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size")), scratch)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    per = scratch.keep(per.withColumn("weight", weight))
    most = cap * F.col("source_size")
    level, open_before = None, -1
    while True:
        over = F.lit(False) if level is None else most <= F.col("weight") * level
        r = per.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, most)).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("w"), F.count_if(~over).alias("open")).first()
        if not r["w"] or r["open"] == open_before:
            break
        level, open_before = (r["all"] - (r["capped"] or 0)) / r["w"], r["open"]
    share = F.col("weight") * F.lit(float(level or 0))
    full = most <= share
    return per.select("source", "sid", "source_size", F.when(full, most.cast("double")).otherwise(share).alias("target"), full.alias("full"))


def language_of(lang: Column) -> Column:
    """The place of a language in LANGUAGES; their number for any other and for null."""
    out = F.lit(len(LANGUAGES))
    for k, x in enumerate(LANGUAGES):
        out = F.when(lang == x, k).otherwise(out)
    return out.cast("int")


def band_of(size: Column) -> Column:
    """The band of the natural logarithm of a length; 0 for empty texts."""
    return F.when(size > 0, F.round(F.log(size.cast("double")) * BANDS)).otherwise(0).cast("int")


def _features(language: Column, band: Column, mean: float) -> list[Column]:
    return [(language == k).cast("double") for k in range(len(LANGUAGES))] + [band / F.lit(float(BANDS)) - F.lit(mean)]


def _tilt(language: Column, band: Column, b: list[float], mean: float) -> Column:
    """b.x of a language and band."""
    out = F.lit(0.0)
    for k, x in enumerate(_features(language, band, mean)):
        out = out + F.lit(float(b[k])) * x
    return out


def solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The solution of a small linear system, by elimination with pivots."""
    n = len(right)
    m = [[*row, r] for row, r in zip(matrix, right, strict=True)]
    for i in range(n):
        p = max(range(i, n), key=lambda k: abs(m[k][i]))
        m[i], m[p] = m[p], m[i]
        for k in range(n):
            if k != i and m[i][i]:
                by = m[k][i] / m[i][i]
                m[k] = [x - by * y for x, y in zip(m[k], m[i], strict=True)]
    return [m[i][n] / m[i][i] if m[i][i] else 0.0 for i in range(n)]


def mean_band(cells: DataFrame) -> tuple[float, float]:
    """All words, and the mean over them of the band in units of the logarithm."""
    r = cells.agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.col("band")).cast("double").alias("s")).first()
    words_ = r["n"] or 0.0
    return words_, (r["s"] / words_ / BANDS if words_ else 0.0)


def _multiplier(b: list[float], mean: float, cap: int) -> Column:
    """a of a source (cells, target, source_size, full) such that its words at the rates exp(a + b.x), capped, are its target.

    Cells that come over the cap give what they can and the others make up for it, which can only bring more over the
    cap: after some rounds none is new. A full source gets a value that puts all of it at the cap whatever b.
    """
    tilted = F.transform("cells", lambda c: F.struct(c["n"].alias("n"), _tilt(c["language"], c["band"], b, mean).alias("t")))

    def rounds(cells: Column) -> Column:
        def again(a: Column, _: Column) -> Column:
            over = lambda c: a + c["t"] >= math.log(cap)
            sure = F.aggregate(cells, F.lit(0.0), lambda s, c: s + F.when(over(c), cap * c["n"]).otherwise(0.0))
            rest = F.aggregate(cells, F.lit(0.0), lambda s, c: s + F.when(over(c), 0.0).otherwise(c["n"] * F.exp(c["t"])))
            return F.when((rest > 0) & (F.col("target") > sure), F.log((F.col("target") - sure) / rest)).otherwise(a)

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.lit(-1e3), again)

    return F.when(F.col("full"), F.lit(1e3)).when((F.col("source_size") > 0) & (F.col("target") > 0), let(tilted, rounds)).otherwise(0.0)


def balance(cells: DataFrame, targets: DataFrame, scratch: Scratch, cap: int = CAP) -> Solution:
    """Newton's method on the dual, over cells(sid, language, band, n) and targets(sid, source_size, target, full).

    A source has at most as many cells as there are languages and bands, which its row holds. No documents give b = 0 and no sources.
    """
    words_, mean = mean_band(cells)
    rows = cells.groupBy("sid").agg(F.collect_list(F.struct("language", "band", F.col("n").cast("double").alias("n"))).alias("cells"))
    rows = scratch.keep(rows.join(targets.select("sid", "source_size", "target", "full"), "sid"))
    pairs, over = [(k, j) for k in range(K) for j in range(k, K)], math.log(cap)

    def at(b: list[float]):
        """The dual at b and the best a for it, its gradient and its curvature with the sources eliminated; one aggregation."""
        each = rows.withColumn("a", _multiplier(b, mean, cap)).select("sid", "target", "a", F.explode("cells").alias("c")).select("sid", "target", "a", "c.*")
        x, eta = _features(F.col("language"), F.col("band"), mean), F.col("eta")
        each = each.withColumn("eta", F.col("a") + _tilt(F.col("language"), F.col("band"), b, mean))
        taken = F.col("n") * F.when(eta < over, F.exp(eta)).otherwise(float(cap))
        curve = F.when(eta < over, taken).otherwise(0.0)
        worth = F.col("n") * F.when(eta < over, F.exp(eta)).otherwise(cap + cap * (eta - over))
        by_source = each.groupBy("sid", "target", "a").agg(
            F.sum(worth).alias("f"), F.sum(curve).alias("h"), *[F.sum(taken * x[k] - F.col("n") * x[k]).alias(f"m{k}") for k in range(K)], *[F.sum(curve * x[k]).alias(f"c{k}") for k in range(K)],
            *[F.sum(curve * x[k] * x[j]).alias(f"h{k}_{j}") for k, j in pairs],
        )
        part = lambda v: F.sum(F.when(F.col("h") > 0, v / F.col("h")).otherwise(0.0))
        r = by_source.agg(
            F.sum(F.col("f") - F.col("target") * F.col("a")).alias("f"), *[F.sum(f"m{k}").alias(f"m{k}") for k in range(K)], *[(F.sum(f"h{k}_{j}") - part(F.col(f"c{k}") * F.col(f"c{j}"))).alias(f"s{k}_{j}") for k, j in pairs]
        ).first()
        if r["f"] is None:
            return 0.0, [0.0] * K, []
        slack = SLACK * words_
        # the corpus' own moments are subtracted in m: the mean length has the moment 0, a language its words
        dual = r["f"] - sum(v * w for v, w in zip(b, own, strict=True)) + slack * sum(v * v for v in b) / 2
        return dual, [r[f"m{k}"] + slack * b[k] for k in range(K)], [[r[f"s{min(k, j)}_{max(k, j)}"] + (slack if k == j else 0.0) for j in range(K)] for k in range(K)]

    x = _features(F.col("language"), F.col("band"), mean)
    first = cells.agg(*[F.sum(F.col("n") * x[k]).alias(f"o{k}") for k in range(K)]).first()
    own = [first[f"o{k}"] or 0.0 for k in range(K)]
    b = [0.0] * K
    dual, slope, curvature = at(b)
    for steps in range(STEPS):
        residual = max(map(abs, slope)) / max(1.0, words_)
        if residual <= RESIDUAL:
            break
        move, step = solved(curvature, [-v for v in slope]), 1.0
        down = sum(v * w for v, w in zip(slope, move, strict=True))
        while True:
            then = [v + step * w for v, w in zip(b, move, strict=True)]
            found = at(then)
            if found[0] <= dual + 1e-4 * step * down + 1e-12 * abs(dual) or step < 1e-6:
                break
            step /= 2
        b, (dual, slope, curvature) = then, found
    else:
        steps, residual = STEPS, max(map(abs, slope)) / max(1.0, words_)
    b = [round(v, DECIMALS) for v in b]
    return Solution(rows.select("sid", F.round(_multiplier(b, mean, cap), DECIMALS).alias("a")), b, residual, steps)


def _cut(rows: DataFrame, need: DataFrame, scratch: Scratch, levels: list[str]) -> DataFrame:
    """(sid, before, levels): the slice in which the running sum of sizes reaches a source's need, found level by level."""
    cut = need.where("need > 0").select("sid", "need", F.lit(0).cast("bigint").alias("before"))
    for k, level in enumerate(levels):
        sums = rows.join(cut, ["sid", *levels[:k]]).groupBy("sid", *levels[:k], "need", "before", level).agg(F.sum("size").alias("s"))
        running = F.sum("s").over(W.partitionBy("sid").orderBy(level).rowsBetween(W.unboundedPreceding, W.currentRow))
        at = sums.withColumn("running", F.col("before") + running)
        cut = scratch.keep(at.where((F.col("running") >= F.col("need")) & (F.col("running") - F.col("s") < F.col("need"))).select("sid", *levels[:k], level, "need", (F.col("running") - F.col("s")).alias("before")))
    return cut


def mix(docs: DataFrame, scratch: Scratch, *, id_col="doc_id", text_col="text", source_col="source", lang_col="lang", weights=WEIGHTS, cap: int = CAP, extra=()) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, rate, copies (and ``extra`` columns).

    Null or empty texts have size 0 and are taken 0 times; null sources form one source, last
    in order; null and unknown languages are one language; a null id hashes as the empty string; repeated rows count as often as they
    stand there, and which of them is taken more often yields the same rows. An empty table gives an empty result. Only the named columns are read.
    """
    kept = [F.struct(*extra).alias("extra")] if extra else []
    h = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    number = lambda at, digits: F.conv(F.substring(h, at, digits), 16, 10).cast("bigint")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), language_of(F.col(lang_col)).alias("language"), F.size(words(F.col(text_col))).cast("bigint").alias("size"), number(1, 8).alias("u"), number(9, 3).alias("by_id"), F.monotonically_increasing_id().alias("row"), *kept)
    sized = scratch.keep(rows.withColumn("band", band_of(F.col("size"))))
    targets = scratch.keep(source_targets(sized.select("source", "size"), scratch, weights, cap))
    same = F.col("source").eqNullSafe(F.col("its_source"))
    cells = sized.groupBy("source", "language", "band").agg(F.sum("size").alias("n"))
    cells = scratch.keep(cells.join(targets.select(F.col("source").alias("its_source"), "sid"), same).select("sid", "language", "band", "n"))
    found = balance(cells, targets, scratch, cap)
    _, mean = mean_band(cells)

    eta = F.col("a") + _tilt(F.col("language"), F.col("band"), found.b, mean)
    rate = F.when(F.col("source_size") == 0, 0.0).when(F.col("full"), float(cap)).otherwise(F.least(F.lit(float(cap)), F.round(F.exp(eta), 9)))
    plan = scratch.keep(targets.join(found.sources, "sid"))
    rated = sized.join(plan.withColumnRenamed("source", "its_source"), same).withColumn("rate", rate).withColumn("base", F.floor("rate").cast("bigint"))
    # from 0 to 2 ** 32: the less, the sooner a document gets one more copy
    place = F.floor((F.col("u") / 2.0**32 - (F.col("rate") - F.col("base")) + 1) * 2.0**31).cast("bigint")
    low = (1 << SLICE_BITS) - 1
    levels = ["first", "second", "third", "by_id", "by_row"]
    by_place = {x: F.shiftrightunsigned(place, SLICE_BITS * k).bitwiseAND(F.lit(low)) for k, x in enumerate(("third", "second", "first"))}
    rated = rated.withColumns(by_place | {"by_row": F.xxhash64("row").bitwiseAND(F.lit(low))})
    may = (F.col("base") < cap) & (F.col("size") > 0)
    sums = rated.groupBy("sid", "target").agg(F.sum(F.col("base") * F.col("size")).alias("sure"), F.sum(F.when(may, F.col("size")).otherwise(0)).alias("most"))
    need = scratch.keep(sums.select("sid", F.greatest(F.lit(0), F.least("most", F.round("target").cast("bigint") - F.col("sure"))).alias("need")))
    cut = _cut(rated.where(may).select("sid", "size", *levels), need, scratch, levels)
    cut = cut.select("sid", F.struct(*levels).alias("cut"), "need", "before")

    rated = rated.withColumn("may", may).join(cut, "sid", "left").withColumn("at", F.struct(*levels))
    whole = rated.where(~F.coalesce((F.col("at") == F.col("cut")) & F.col("may"), F.lit(False)))
    whole = whole.withColumn("more", F.when(F.col("may") & (F.col("at") < F.col("cut")), F.col("size")).otherwise(0).cast("bigint"))
    edge = rated.where(F.col("may") & (F.col("at") == F.col("cut")))
    running = F.sum("size").over(W.partitionBy("sid").orderBy(F.xxhash64("row"), "row").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    edge = edge.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("need") - F.col("before") - running)).cast("bigint"))
    taken = (F.col("base") * F.col("size") + F.col("more")).cast("bigint")
    return whole.unionByName(edge).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "rate", (F.col("base") + (F.col("more") > 0).cast("int")).cast("int").alias("copies"), *(["extra.*"] if extra else []))


def mixed_documents(docs: DataFrame, scratch: Scratch, **named) -> DataFrame:
    """docs, with all its columns, in the copies that the mix takes of each.

    A document taken in part comes whole if half of it or more is taken. What has no words comes as often as its rate's whole copies; null and
    repeated ids as in mix(). An empty table stays empty.
    """
    names = docs.columns
    inside = docs.select(*[F.col(c).alias(f"__{c}") for c in names], *[F.col(named.get(k, d)).alias(f"_{d}") for k, d in NAMES])
    rest = {k: v for k, v in named.items() if k not in dict(NAMES)}
    rows = mix(inside, scratch, **{k: f"_{d}" for k, d in NAMES}, extra=tuple(f"__{c}" for c in names), **rest)
    whole = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.floor("rate")).cast("int")
    return rows.withColumn("times", whole).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*[F.col(f"__{c}").alias(c) for c in names])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), Scratch(spark, "op8")).select("doc_id", "size", "source_size", "target", "taken")


_X = [f"(language = {k})::int::double" for k in range(len(LANGUAGES))] + [f"(band / {float(BANDS)} - mean)"]


def _eta(a: str, b: str) -> str:
    return a + "".join(f" + {b}[{k + 1}] * {x}" for k, x in enumerate(_X))


#: Sweeps over the multipliers, first of the sources, then of the features, each solved with the others held: another way to the same point.
SWEEPS = 150
OP8_SQL = rf"""
with recursive sized as (
  select doc_id, source, case lang {" ".join(f"when '{x}' then {k}" for k, x in enumerate(LANGUAGES))} else {len(LANGUAGES)} end as language,
    coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '')) as h from documents),
banded as (select *, case when size > 0 then round(ln(size::double) * {BANDS})::int else 0 end as band from sized),
per as (select source, sum(size)::bigint as total from sized group by source),
weighed as (select *, row_number() over (order by source nulls last) - 1 as sid, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w from per),
levels as (
  select *, case when sum(w) over () - coalesce(sum(w) over b, 0) > 0 then
    (sum(total) over () - 3 * coalesce(sum(total) over b, 0))::double / (sum(w) over () - coalesce(sum(w) over b, 0))::double else 0 end as level
  from weighed window b as (order by total / w, source nulls last rows between unbounded preceding and 1 preceding)),
final as (select min_by(level, total / w) as c from levels where 3 * total > w * level),
targets as (
  select sid, source, total, 3 * total <= w * coalesce(c, 1e300) as full_, case when 3 * total > w * c then w * c else (3 * total)::double end as target
  from levels left join final on true),
cells as (select sid, language, band, sum(size)::double as n from banded join targets t on t.source is not distinct from banded.source group by all),
known as (select sum(n) as words, coalesce(sum(n * band) / nullif(sum(n), 0) / {float(BANDS)}, 0) as mean from cells),
moments as (select {", ".join(f"sum(n * {x}) as o{k}" for k, x in enumerate(_X))} from cells, known),
state(i, a, b) as (
  select 0, (select list(case when full_ then 100.0::double when target > 0 and total > 0 then ln(target / total) else 0 end order by sid) from targets), [{", ".join("0.0::double" for _ in _X)}]
  union all
  select i + 1, a, [{", ".join(f"b[{k + 1}] - (m{k} - o{k} + {SLACK} * words * b[{k + 1}]) / (h{k} + {SLACK} * words)" for k in range(K))}]
  from (select i, a, b, {", ".join(f"sum(taken * {x}) as m{k}, sum(case when taken < 3 * n then taken else 0 end * {x} * {x}) as h{k}" for k, x in enumerate(_X))}
    from (select s.*, language, band, mean, n, n * least(3.0::double, exp(least(50, {_eta("a[sid + 1]", "b")}))) as taken from (
      select i, b, list(case when full_ or taken <= 0 then now else now + ln(target / taken) end order by sid) as a
      from (select i, b, t.sid, t.full_, t.target, a[t.sid + 1] as now, sum(coalesce(n, 0) * least(3.0::double, exp(least(50, {_eta("a[t.sid + 1]", "b")})))) as taken
        from state, known, targets t left join cells using (sid) where i < {SWEEPS} group by all)
      group by i, b) s, cells, known)
    group by i, a, b), known, moments),
solution as (select list_transform(a, lambda x: round(x, {DECIMALS})) as a, list_transform(b, lambda x: round(x, {DECIMALS})) as b from state where i = {SWEEPS}),
rated as (
  select d.*, t.sid, total, target, case when total = 0 then 0 when full_ then 3 else least(3.0::double, round(exp(least(50, {_eta("a[t.sid + 1]", "b")})), 9)) end as rate
  from banded d join targets t on t.source is not distinct from d.source, known, solution),
based as (select *, floor(rate)::bigint as base, ('0x' || substr(h, 1, 8))::bigint as u, ('0x' || substr(h, 9, 3))::bigint as by_id from rated),
placed as (select *, base < 3 and size > 0 as may, floor((u / 4294967296.0::double - (rate - base) + 1) * 2147483648.0::double)::bigint as place, round(target)::bigint - sum(base * size) over (partition by sid) as need from based),
ranked as (select *, coalesce(sum(case when may then size else 0 end) over (partition by sid, may order by place, by_id, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from placed)
select doc_id, size, total as source_size, target, (base * size + case when may then greatest(0, least(size, need - before)) else 0 end)::bigint as taken from ranked
"""
