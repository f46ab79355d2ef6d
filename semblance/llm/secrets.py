"""Secret scans that link the parts of a credential.

Base spans are what the three patterns find by themselves. Weak candidates (a random-looking
token, an identifier given a name, an endpoint) are reported only if complementary parts
stand in their scope: the same paragraph, within REACH code points. Per document the starts and the
ends of the parts are kept in order, and each weak candidate is joined to its neighbours on both sides by binary search, so the
interval join is never quadratic; a document is one row, read in Arrow batches, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices

# The base patterns; the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_VALUE, MIN_ACCESS = 8, 16
#: What a text must hold, in lower case, for ASSIGN to be tried.
HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
BASE = ("assign", "access", "hex")

NAMED = re.compile(r"""(?:client_?id|account(?:_?id)?|user(?:name)?|(?<!secret)(?<!secret[_-])access_?key(?:_?id)?|tenant)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{4,})""", re.I | re.A)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""(?:https?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?\b""", re.A)
WEAK = ("named", "random", "endpoint")
KINDS = BASE + WEAK
#: Code points between a weak candidate and its complement; least entropy of a random token in bits a character.
REACH, MIN_ENTROPY = 400, 3.6

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    low = text.encode("utf-8", "surrogatepass").lower()
    out: list[Span] = []
    if any(h in low for h in HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak candidates with their complements in scope.

    A random token wants an identifier (access or named); a named identifier a secret (assign, hex
    or random token next to an access identifier); an endpoint an identifier and a secret. A candidate that overlaps a base span adds nothing.
    """
    taken = [(s, e) for _, s, e in base]  # in order of start
    starts, reached = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))

    def free(s: int, e: int) -> bool:
        """Whether no base span overlaps s to e: the furthest end of those that start before e is known."""
        k = bisect_left(starts, e)
        return not k or reached[k - 1] <= s

    def near(parts: list[tuple[int, int]]) -> Callable[[int, int], bool]:
        """Tells of s to e whether one of ``parts`` beside it lies within reach, with no blank line between; what it overlaps is no complement."""
        firsts, lasts = sorted(s for s, _ in parts), sorted(e for _, e in parts)

        def beside(s: int, e: int) -> bool:
            # of the parts on one side the nearest has the least between
            k, j = bisect_left(firsts, e), bisect_right(lasts, s)
            after = k < len(firsts) and firsts[k] - e <= reach and "\n\n" not in text[e : firsts[k]]
            return after or (j > 0 and s - lasts[j - 1] <= reach and "\n\n" not in text[lasts[j - 1] : s])

        return beside

    access = [(s, e) for k, s, e in base if k == "access"]
    secrets = [(s, e) for k, s, e in base if k != "access"]
    named = [m.span() for m in NAMED.finditer(text) if free(*m.span())] if "=" in text or ":" in text else []
    if not access and not named:  # every link needs one
        return []
    by_id = near(access + named)
    random = [m.span() for m in RANDOM.finditer(text) if free(*m.span()) and by_id(*m.span()) and entropy(m[0]) >= MIN_ENTROPY]
    by_secret = near(secrets + random)
    named = [x for x in named if by_secret(*x)]
    if not access and not named:
        return []
    by_id = near(access + named)
    ends = [m.span() for m in ENDPOINT.finditer(text) if free(*m.span()) and by_id(*m.span()) and by_secret(*m.span())]
    return [("named", *x) for x in named] + [("random", *x) for x in random] + [("endpoint", *x) for x in ends]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text, both in order of start, then kind. Null text: none."""
    text = text or ""
    base = base_spans(text)
    return base, in_order(base + linked_spans(text, base))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each covered run replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        found = [scan(t) for t in b.column("text").to_pylist()]
        count = lambda kind: pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *map(count, BASE), pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([written(x) for _, x in found], pa.string()), pa.array([len(x) - len(base) for base, x in found], pa.int64())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"],
        )


def find_secrets(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of docs, in any order: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Null and empty texts have no spans (the digest is that of the empty string). Repeated rows and null ids are kept as they are.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan_batches, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_linked bigint")


def _redact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        k = b.schema.get_field_index("text")
        texts = [None if t is None else redact(t, scan(t)[1]) for t in b.column(k).to_pylist()]
        cols = list(b.columns)
        cols[k] = pa.array(texts, b.schema.field(k).type)
        if (n := b.schema.get_field_index("n_chars")) >= 0:
            cols[n] = pa.array([None if t is None else len(t) for t in texts], b.schema.field(n).type)
        yield pa.RecordBatch.from_arrays(cols, schema=b.schema)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs (with columns text and, if there, n_chars) with every span of every text replaced; no row is dropped.

    Null texts stay null with null n_chars, empty ones empty; all other columns, repeated rows and null ids are kept as they are; an empty table stays empty.
    """
    return docs.mapInArrow(_redact_batches, docs.schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))
