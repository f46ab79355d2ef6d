"""Token counts that follow edits.

A document is cut into leaves of some LEAF characters at places where no pre-token crosses
(before a single space with no white space around it). A segment tree holds the sums of
characters and tokens of the leaves. An edit finds its leaves by descending the tree, joins them
with one leaf on either side as context, encodes only that text again, and corrects the sums on the
paths to the root. Leaves keep their number; one that has grown to several times its size is cut when the tree is built anew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices
from .packing import encode, encoder

LEAF = 512
#: A place where the pre-tokeniser always cuts: a single space between two characters other than white space.
SAFE = re.compile(r"(?<=\S) (?=\S)")
VOCABULARY = "byte_bpe_50k"
#: A tree is built anew once a leaf has grown by this factor.
GROWTH = 8

Edit = tuple[int, int, str]


def leaves_of(text: str, size: int = LEAF) -> list[str]:
    """The text in leaves of about ``size`` characters, each but the first starting at a safe cut."""
    out, at = [], 0
    while len(text) - at > size:
        m = SAFE.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


class TokenTree:
    """Leaves of a text under a binary tree of (characters, tokens)."""

    def __init__(self, text: str, vocabulary: str = VOCABULARY, leaf: int = LEAF):
        self.vocabulary, self.leaf, self.encoded = vocabulary, leaf, 0
        self._build(leaves_of(text, leaf))

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return len(encode(self.vocabulary, text))

    def _build(self, leaves: list[str], tokens: list[int] | None = None) -> None:
        self.leaves = leaves
        self.width = 1 << max(0, (len(leaves) - 1).bit_length())
        self.chars, self.tokens = np.zeros(2 * self.width, np.int64), np.zeros(2 * self.width, np.int64)
        self.chars[self.width : self.width + len(leaves)] = [len(x) for x in leaves]
        self.tokens[self.width : self.width + len(leaves)] = tokens if tokens is not None else [self._count(x) for x in leaves]
        for tree in (self.chars, self.tokens):
            at = self.width
            while at > 1:
                tree[at // 2 : at] = tree[at : 2 * at : 2] + tree[at + 1 : 2 * at : 2]
                at //= 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character place (the last one at the end), and its start."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place >= start + self.chars[node] and self.chars[node + 1] > 0:
                start += int(self.chars[node])
                node += 1
        return node - self.width, start

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        node = self.width + leaf
        by = (len(text) - int(self.chars[node]), tokens - int(self.tokens[node]))
        self.leaves[leaf] = text
        while node:
            self.chars[node] += by[0]
            self.tokens[node] += by[1]
            node //= 2

    def _filled(self, leaf: int, step: int) -> int:
        """The next leaf in a direction that holds text, else the last in that direction."""
        while 0 <= leaf + step < len(self.leaves):
            leaf += step
            if self.leaves[leaf]:
                break
        return leaf

    def edit(self, start: int, removed: int, added: str) -> int:
        """Replaces ``removed`` characters from ``start``; places beyond the text are taken as its end. Returns the new total.

        The context goes one filled leaf to either side, and further while the seam at its
        edge is not a safe cut of the edited text.
        """
        n = int(self.chars[1])
        start = min(max(0, start), n)
        removed = min(max(0, removed), n - start)
        first, at = self._find(start)
        last, _ = self._find(max(start, start + removed - 1))
        lo, hi = self._filled(first, -1), self._filled(last, 1)
        at -= sum(len(x) for x in self.leaves[lo:first])
        while True:
            old = "".join(self.leaves[lo : hi + 1])
            new = old[: start - at] + added + old[start - at + removed :]
            left, right = self._filled(lo, -1), self._filled(hi, 1)
            before = "".join(self.leaves[left:lo])[-1:]
            after = "".join(self.leaves[hi + 1 : right + 1])[:2]
            # leaves start at a safe cut; it stays one if what stands on its two sides still is no white space
            if before and not SAFE.match(before + new[:2], 1):
                at -= sum(len(x) for x in self.leaves[left:lo])
                lo = left
            elif after and not SAFE.match(new[-1:] + after, 1):
                hi = right
            else:
                break
        pieces = leaves_of(new, max(self.leaf, len(new) // (hi - lo + 1) + 1))
        for k in range(lo, hi + 1):
            x = pieces[k - lo] if k - lo < len(pieces) else ""
            if x != self.leaves[k]:
                self._set(k, x, self._count(x) if x else 0)
        if max(map(len, pieces)) > GROWTH * self.leaf:
            self._split()
        return self.total

    def _split(self) -> None:
        """Builds the tree anew, encoding only leaves that are cut."""
        leaves, tokens = [], []
        for k, x in enumerate(self.leaves):
            parts = leaves_of(x, self.leaf) if len(x) > GROWTH * self.leaf // 2 else [x]
            leaves += parts
            tokens += [int(self.tokens[self.width + k])] if len(parts) == 1 else [self._count(p) for p in parts]
        self._build(leaves, tokens)


def standing_edits(doc_id: int | None, text: str) -> list[Edit]:
    """Three edits that depend on the row alone: a word put in, a run taken out, a run replaced."""
    n, k = len(text), (doc_id or 0) % 97
    return [(n // 3 + k, 0, f" revised {k} "), (n // 2 + k, 40 + k, ""), (2 * n // 3, 16, text[k : k + 24])]


def _count_batches(edits_of, vocabulary: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder(vocabulary)
        for b in slices(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            edits = b.column("edits").to_pylist() if "edits" in b.schema.names else [None] * b.num_rows
            for doc_id, text, given in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), edits, strict=True):
                text = text or ""
                tree = TokenTree(text, vocabulary, leaf)
                before, seen = tree.total, tree.encoded
                todo = edits_of(doc_id, text) if edits_of else [(e["start"], e["removed"], e["added"] or "") for e in given or () if e]
                for start, removed, added in todo:
                    tree.edit(start or 0, removed or 0, added)
                for c, v in zip(out, (before, tree.total, int(tree.chars[1]), tree.encoded - seen, len(tree.leaves)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in out]], ["doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_encoded", "n_leaves"])

    return run


SCHEMA = "doc_id bigint, n_tokens bigint, n_tokens_edited bigint, n_chars_edited bigint, n_chars_encoded bigint, n_leaves bigint"


def count_tokens(docs: DataFrame, *, id_col="doc_id", text_col="text", edits_col: str | None = None, edits_of=None, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_tokens_edited, n_chars_edited, n_chars_encoded (by edits), n_leaves.

    Edits are (start, removed, added) in characters, applied in turn, each to the text the last one left: from a column of an array
    of such structs, or edits_of(doc_id, text). Null text counts as empty (0 tokens), null edits as none, nulls in an edit as 0 or the empty string. Repeated rows are
    counted each; a text of any length is held once.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.col(edits_col).alias("edits")] if edits_col else []))
    return rows.mapInArrow(_count_batches(None if edits_col else edits_of or (lambda *_: []), vocabulary, leaf), SCHEMA)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), edits_of=standing_edits)
