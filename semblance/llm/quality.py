"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms (character classes; common words of its language) are compared with
the reference of its language by the Jensen-Shannon distance (square root of the divergence
in bits, between 0 and 1). The references are sums over all documents of the language that
pass the base rules, so they cost one aggregation of a few numbers per document. A document
too short for a histogram to mean anything is not judged by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, documents, let, words

# The most common function words of each language.
COMMON = {
    "en": "the of and to in is that for it with as on be by this are was or an at from a not have which".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas avec ce il plus ne se".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le".split(),
}
#: The symbols that the base rule counts.
SYMBOLS = "#*$%&|<>"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
PUNCTUATION = ".,;:!?'\"()-"
#: Words in a window of the repetition rule.
WINDOW = 8
#: Fewer characters in words, or fewer words, than these: that histogram doesn't count.
MIN_CHARS, MIN_WORDS = 200, 60
#: Distances above which a document is rejected. That of a histogram of n words scatters as 1 / sqrt(n).
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, WORD_SCATTER = 0.30, 0.28, 0.6


def repeated_words(ws: Column) -> Column:
    """Words in windows of WINDOW words that occur at least twice in ws, the first included.

    Windows are compared as hashes of word hashes. Only a text that has a repeated window
    is sorted.
    """

    def covered(hs: Column) -> Column:
        def spans(z: Column) -> Column:
            same = lambda i, j: F.get(z, i)["h"].eqNullSafe(F.get(z, j)["h"])
            starts = F.array_sort(F.transform(F.filter(F.transform(z, lambda x, i: F.struct(x["i"].alias("i"), (same(i, i - 1) | same(i, i + 1)).alias("d"))), lambda x: x["d"]), lambda x: x["i"]))
            gaps = lambda s: F.aggregate(F.transform(s, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
            return let(starts, gaps)

        ordered = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(ordered, spans))

    one = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    return F.when(F.size(ws) <= WINDOW, F.lit(0)).otherwise(let(one(ws), lambda h: let(windows(h), covered)))


def class_counts(text: Column) -> Column:
    """Characters by class: lower case, upper case, digits, punctuation, symbols, others (white space aside).

    Each class is cut out of what the last has left, so the long passes are the first two.
    """
    cut = lambda s, chars: F.translate(s, chars, "")

    def chain(s: Column, left: list[str], out: list[Column]) -> Column:
        if not left:
            return F.array(*out, F.length(s).cast("long"))
        return let(cut(s, left[0]), lambda rest: chain(rest, left[1:], [*out, (F.length(s) - F.length(rest)).cast("long")]))

    return let(cut(text, BLANKS), lambda s: chain(s, [LOWER, UPPER, DIGITS, PUNCTUATION, SYMBOLS], []))


def common_counts(ws: Column, lang: Column) -> Column:
    """Counts of the common words of a language (in any case, punctuation at the end aside) and of all other words."""

    def of(common: list[str]) -> Column:
        known = F.array(*map(F.lit, common))
        bare = F.transform(ws, lambda w: F.rtrim(F.lower(w), F.lit(PUNCTUATION)))
        hits = F.filter(bare, lambda w: F.array_contains(known, w))
        counts = lambda h: F.concat(F.transform(known, lambda c: F.size(F.filter(h, lambda w: w == c)).cast("long")), F.array((F.size(ws) - F.size(h)).cast("long")))
        return let(hits, counts)

    case = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for k, v in COMMON.items():
        case = case.when(lang == k, of(v))
    return case


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null if either is empty or sums to 0."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y).cast("double")

    def of(n: Column, m: Column) -> Column:
        def term(x: Column, y: Column) -> Column:
            a, b = x / n, y / m
            mid = (a + b) / 2
            part = lambda v: F.when(v > 0, v * F.log2(v / mid)).otherwise(0.0)
            return (part(a) + part(b)) / 2

        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda x, y: x + y)))

    return let(total(p), lambda n: let(total(q), lambda m: F.when((n > 0) & (m > 0), of(n, m))))


def add_up(name: str, n: int) -> Column:
    return F.array(*[F.coalesce(F.sum(F.get(F.col(name), F.lit(i))), F.lit(0)) for i in range(n)])


def judge(docs: DataFrame, scratch: Scratch, *, id_col="doc_id", text_col="text", lang_col="lang", max_class=MAX_CLASS_DISTANCE, max_word=MAX_WORD_DISTANCE) -> DataFrame:
    """One row per row of docs with its base figures, both distances and the verdict.

    Null text counts as empty: no words, so base_failed. An unknown or null language has no
    word histogram and is compared with the characters of its own rows; a language all of whose documents
    fail the base rules has no reference, so only the base rules judge it. Repeated rows are judged alike.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text.alias("text"))
    base = rows.select(
        "doc_id",
        "lang",
        let(
            words(F.col("text")),
            lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws).cast("long").alias("n_repeat_words"), common_counts(ws, F.col("lang")).alias("common")),
        ).alias("w"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        class_counts(F.col("text")).alias("classes"),
    ).select("doc_id", "lang", "w.*", "n_dup_lines", "classes", F.get("classes", F.lit(4)).alias("n_symbols"), F.aggregate("classes", F.lit(0).cast("long"), lambda a, b: a + b).alias("word_chars"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    base = scratch.keep(base.withColumn("base_failed", failed))

    n = max(map(len, COMMON.values())) + 1
    refs = base.where(~F.col("base_failed")).groupBy("lang").agg(add_up("classes", 6).alias("ref_classes"), add_up("common", n).alias("ref_common")).withColumnRenamed("lang", "ref_lang")
    seen = base.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    seen = seen.withColumn("class_distance", F.when(F.col("word_chars") >= MIN_CHARS, distance(F.col("classes"), F.col("ref_classes"))))
    seen = seen.withColumn("word_distance", F.when(F.col("n_words") >= MIN_WORDS, distance(F.col("common"), F.slice("ref_common", 1, F.size("common")))))
    far = F.coalesce(F.col("class_distance") > max_class, F.lit(False)) | F.coalesce(F.col("word_distance") > max_word + WORD_SCATTER / F.sqrt("n_words"), F.lit(False))
    return seen.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance"
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), Scratch(spark, "op10")).drop("class_distance", "word_distance")


def _listed(words_: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words_) + "]"


def _js(name: str, counts: str) -> str:
    """SQL of the distances of lists of counts to those of their language."""
    return f"""{name}_x as (select r, lang, unnest({counts}) as n, unnest(range(1, len({counts}) + 1)) as i from b),
{name}_q as (select lang, i, sum(n)::double as m from {name}_x join b using (r, lang) where not base_failed group by lang, i union all select null, i, sum(n)::double from {name}_x join b using (r) where b.lang is null and not base_failed group by i),
{name}_p as (select x.r, x.n::double / sum(x.n) over (partition by x.r) as a, q.m / sum(q.m) over (partition by x.r) as b from {name}_x x join {name}_q q on q.i = x.i and q.lang is not distinct from x.lang),
{name} as (select r, sqrt(greatest(0, sum((case when a > 0 then a * log2(a / ((a + b) / 2)) else 0 end + case when b > 0 then b * log2(b / ((a + b) / 2)) else 0 end) / 2))) as d from {name}_p group by r)"""


OP10_SQL = rf"""
with d as (select row_number() over () as r, doc_id, lang, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') as s,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
win as (select r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') as x from (select r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from w where len(ws) > {WINDOW})),
dup as (select r, x from win group by r, x having count(*) > 1),
cov as (select r, count(distinct p) as n from (select win.r, unnest(range(i, i + {WINDOW})) as p from win join dup using (r, x)) group by r),
k as (select *, length(s) - length(regexp_replace(s, '[a-z]', '', 'g')) as c0, length(s) - length(regexp_replace(s, '[A-Z]', '', 'g')) as c1, length(s) - length(regexp_replace(s, '[0-9]', '', 'g')) as c2,
  length(s) - length(regexp_replace(s, '[.,;:!?''"()-]', '', 'g')) as c3, length(s) - length(regexp_replace(s, '[#*$%&|<>]', '', 'g')) as c4,
  case lang {" ".join(f"when '{k}' then {_listed(v)}" for k, v in COMMON.items())} end as known, list_transform(ws, lambda x: rtrim(lower(x), '.,;:!?''"()-')) as bare from w),
b as (select k.*, len(ws) as n_words, length(s) as word_chars, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words,
  len(ws) < 20 or 100 * coalesce(cov.n, 0) > 30 * len(ws) as base_failed, [c0, c1, c2, c3, c4, length(s) - c0 - c1 - c2 - c3 - c4] as classes,
  list_append(list_transform(known, lambda y: len(list_filter(bare, lambda x: x = y))), len(list_filter(bare, lambda x: not list_contains(known, x)))) as common from k left join cov using (r)),
{_js("jc", "classes")},
{_js("jw", "common")}
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, c4::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and not coalesce(word_chars >= {MIN_CHARS} and jc.d > {MAX_CLASS_DISTANCE}, false) and not coalesce(n_words >= {MIN_WORDS} and jw.d > {MAX_WORD_DISTANCE} + {WORD_SCATTER} / sqrt(n_words), false) as kept
from b left join jc using (r) left join jw using (r)
"""
