"""Splitting oversized items at natural boundaries (problem 6).

Method: a text becomes units (its lines; a line longer than the limit becomes fragments). Every gap between units has a
boundary strength. A sparse-table range-maximum index over the strengths answers, for each permissible length window,
where the strongest cut lies, ties going to the right; then the next piece steps back by the overlap.

Defined cases
    * null and empty texts give no piece; a text within the limit gives one piece.
    * line ends are ``\\n``, ``\\r\\n`` and ``\\r``; they stay with their line, and count as characters.
    * the overlap is two whole units; cuts where two and a new unit would be over the limit are taken only if a window has no
      other, and the overlap is shorter there (very long lines).
    * pieces without their overlap, joined, give the text back exactly.
    * ``start_line`` of a piece is that of the item (0 if null or negative) plus the lines before the piece; it is not
      corrected against ``end_line``, which is not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4000
OVERLAP = 2
SCHEMA = "evidence_id bigint, piece_no int, n_pieces int, start_line int, end_line int, overlap_chars int, piece string"

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z")
_DEFINITION = re.compile(r"\s*(?:@|(?:async\s+)?def\b|class\b|(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b|(?:export\s+)?class\b|interface\b|struct\b|impl\b|fn\b|func\b)")


class RangeMaximum:
    """Sparse table: index of the greatest value in a closed range in constant time, the rightmost among equals."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.levels = [np.arange(len(values))]
        width = 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            a, b = last[:-width], last[width:]
            self.levels.append(np.where(values[b] >= values[a], b, a))
            width *= 2

    def query(self, lo: int, hi: int) -> int:
        k = (hi - lo + 1).bit_length() - 1
        a, b = self.levels[k][lo], self.levels[k][hi - (1 << k) + 1]
        return int(b if self.values[b] >= self.values[a] else a)


def _cuts(ends: np.ndarray, strength: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first unit, new from, behind last unit) of each piece. ``ends[i]``: characters before unit i; ``strength[i]``: of the gap before it."""
    n = len(ends) - 1
    if n <= 0:
        return []
    gap = np.arange(n + 1)
    room = ends[np.minimum(gap + 1, n)] - ends[np.maximum(gap - overlap, 0)] <= limit
    index = RangeMaximum(np.where(room, strength.astype(np.int16) + 1, 0))
    out, start, cut = [], 0, 0
    while True:
        hi = int(np.searchsorted(ends, ends[start] + limit, "right")) - 1
        if hi >= n:
            out.append((start, cut, n))
            return out
        lo = max(cut + 1, int(np.searchsorted(ends, ends[start] + limit // 2, "left")))
        k = index.query(min(lo, hi), hi)
        out.append((start, cut, k))
        back = k
        while back > k - overlap and back - 1 > start and ends[k + 1] - ends[back - 1] <= limit:
            back -= 1
        start, cut = back, k


def _fragments(line: str, limit: int) -> list[str]:
    """An overlong line in parts of at most half the limit, cut after the strongest character there is."""
    if len(line) <= limit:
        return [line]
    code = np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32)
    after = np.zeros(len(code) + 1, dtype=np.int8)
    for chars, value in ((" \t", 2), (",)]>|", 2), (";}", 3), (".!?", 1)):
        after[1:][np.isin(code, [ord(c) for c in chars])] = value
    return [line[a:b] for a, _, b in _cuts(np.arange(len(code) + 1), after, limit // 2, 0)]


def _strengths(lines: list[str]) -> list[int]:
    """Of the gap before each line: a top-level definition 6, a top-level line after a blank one 5, after a blank line 4,
    a nested definition 3, a step out of a block 2, any other line end 1. Decorators and comments stay with what follows."""
    out, was_blank, was_indent, held = [], False, 0, False
    for line in lines:
        body = line.strip()
        indent = len(line) - len(line.lstrip(" \t"))
        if not body:
            s = 1
        elif held:
            s = 1
        elif _DEFINITION.match(line):
            s = 6 if indent == 0 else 3 + was_blank
        elif was_blank:
            s = 5 if indent == 0 else 4
        elif indent < was_indent:
            s = 2
        else:
            s = 1
        out.append(s)
        held = body.startswith(("@", "#", "//"))
        was_blank = not body
        was_indent = indent if body else was_indent
    return out


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(first line, last line, characters that repeat the piece before, piece), lines from 0."""
    lines = _LINE.findall(text)
    units, at, strength = [], [], []
    for no, (line, s) in enumerate(zip(lines, _strengths(lines))):
        for i, part in enumerate(_fragments(line, limit)):
            units.append(part)
            at.append(no)
            strength.append(0 if i else s)
    ends = np.concatenate([[0], np.cumsum([len(u) for u in units], dtype=np.int64)]) if units else np.zeros(1, dtype=np.int64)
    gaps = np.array([*strength, 0], dtype=np.int8)
    return [
        (at[a], at[b - 1], int(ends[new] - ends[a]), text[int(ends[a]) : int(ends[b])]) for a, new, b in _cuts(ends, gaps, limit, overlap)
    ]


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, oversized_only: bool = True) -> DataFrame:
    """Pieces of (evidence_id, start_line, source_code). Only texts over the limit leave the JVM if ``oversized_only``."""
    take = items.select("evidence_id", F.col("start_line").cast("int").alias("start_line"), "source_code").where("source_code is not null")
    if oversized_only:
        take = take.where(F.length("source_code") > limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, first, text in zip(pdf["evidence_id"], pdf["start_line"], pdf["source_code"]):
                base = 0 if pd.isna(first) or first < 0 else int(first)
                pieces = split(text, limit, overlap)
                rows += [(key, i + 1, len(pieces), base + a, base + b, o, p) for i, (a, b, o, p) in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=["evidence_id", "piece_no", "n_pieces", "start_line", "end_line", "overlap_chars", "piece"])

    return take.mapInPandas(run, SCHEMA)
