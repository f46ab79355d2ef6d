"""Scalar functions on text: words, lines, names, paths, versions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^ \t\n\r\f\x0b]+"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def contains_nocase(c: Column, needle: str) -> Column:
    """Substring test in any ASCII case; the empty needle fits all."""
    return F.lit(True) if not needle else F.contains(ascii_lower(c), F.lit(needle.translate(str.maketrans(UPPER, LOWER))))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(ascii_lower(c), F.lit("")), F.lit(WORDS), F.lit(0))


def code_lines(c: Column) -> Column:
    """Lines that hold something."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.length(F.translate(x, " \t\r\f\x0b", "")) > 0))


def line_slice(c: Column, first: int, last: int) -> Column:
    """Lines first to last, counted from 1, both included."""
    return F.array_join(F.slice(F.split(c, "\n"), first, max(0, last - first + 1)), "\n")


def bucket(c: Column, edges=(0, 1, 2, 4, 8, 16, 32)) -> Column:
    """Number of edges below the value: a coarse size."""
    out = F.lit(len(edges))
    for k in reversed(range(len(edges))):
        out = F.when(c <= edges[k], F.lit(k)).otherwise(out)
    return out.cast("int")


def share(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def split_list(s: str | None) -> list[str]:
    """Comma-separated values without empty ones."""
    return [x for x in (s or "").split(",") if x]


#: A path component of a package and its version.
VERSIONED = r"^(.*?)-(\d[^/]*\.[^/]*)$"
_VERSIONED = re.compile(VERSIONED)


def crate_of(path: str) -> tuple[str, str] | None:
    """(package name, path inside it) by the first path component like name-1.2; None without one."""
    parts = path.split("/")
    for k, part in enumerate(parts):
        if m := _VERSIONED.match(part):
            return m[1], "/".join(parts[k + 1 :])
    return None


def version_of(path: str) -> str:
    return next((m[2] for part in path.split("/") if (m := _VERSIONED.match(part))), "")


def major_of(version: str) -> str:
    """What may break between two versions: 0.x, or the first number."""
    nums = re.findall(r"\d+", version)
    return ".".join(nums[:2]) if nums[:1] == ["0"] else "".join(nums[:1])


_BYTE = re.compile(rb"%([0-9A-Fa-f]{2})")


def percent_decode(s: str, plus: bool = False) -> str:
    """Percent escapes to bytes, malformed ones kept as they stand; with plus, + is a space."""
    raw = (s.replace("+", " ") if plus else s).encode()
    return _BYTE.sub(lambda m: bytes([int(m[1], 16)]), raw).decode("utf-8", "replace")


def truncate(s: str, n: int) -> str:
    return s if len(s) <= n else s[: max(0, n - 1)] + "…"


def line_diff(a: list[str], b: list[str]) -> list[tuple[str | None, str | None]]:
    """Rows of two texts' lines, those of a longest common subsequence (blanks around them aside) side by side, others alone."""
    x, y = [s.strip() for s in a], [s.strip() for s in b]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in reversed(range(len(x))):
        for k in reversed(range(len(y))):
            best[i][k] = best[i + 1][k + 1] + 1 if x[i] == y[k] else max(best[i + 1][k], best[i][k + 1])
    rows: list[tuple[str | None, str | None]] = []
    i = k = 0
    while i < len(x) or k < len(y):
        if i < len(x) and k < len(y) and x[i] == y[k]:
            rows.append((a[i], b[k]))
            i, k = i + 1, k + 1
        elif k == len(y) or i < len(x) and best[i + 1][k] >= best[i][k + 1]:
            rows.append((a[i], None))
            i += 1
        else:
            rows.append((None, b[k]))
            k += 1
    return rows
