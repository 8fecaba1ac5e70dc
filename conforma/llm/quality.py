"""Quality rules on repetition inside a document, from a suffix array over its words.

Suffixes of all texts of a batch are sorted by prefix doubling; the longest common prefixes (LCP) of neighbours follow
from the ranks kept at each doubling. The deepest LCP interval around a suffix is the longest repeat that starts there
(the larger of its two neighbour LCPs): these are the maximal repeated substrings. The union of their spans gives the
covered fraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import string_buffers, text_slices
from .words import scan, span_hashes

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW = 5
MIN_WORDS = 10
BASE_PERCENT = 20
#: The method's own limits: repeats of MIN_REPEAT words and more may cover at most MAX_PERCENT of the words, and the
#: longest may have at most MAX_REPEAT words. Such repeats lie within the base's windows, so MAX_PERCENT must be less than
#: BASE_PERCENT to say anything of its own.
MIN_REPEAT = 10
MAX_PERCENT = 10
MAX_REPEAT = 50
#: Bytes of text measured at once.
SLICE = 1 << 20
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats_covered", "longest_repeat"]


def longest_repeats(symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each place the length of the longest substring that starts there and occurs elsewhere in the same row too.

    symbols: any integers; rows: ascending row of each place. Occurrences may overlap and end with the row.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    # a unique mark after each row keeps comparisons inside the row
    last = np.append(rows[1:] != rows[:-1], True)
    place = np.arange(n) + np.append(0, np.cumsum(last)[:-1])
    m = n + int(last.sum())
    marks = np.ones(m, dtype=bool)
    marks[place] = False
    row = np.zeros(m, np.int64)
    row[place] = rows
    row[marks] = rows[last]
    value = np.zeros(m, np.uint64)
    value[place] = symbols
    # rank by (row, symbol); marks are alone in their class
    order = np.lexsort((value, marks, row))
    new = np.ones(m, dtype=bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (value[order][1:] != value[order][:-1]) | marks[order][1:] | marks[order][:-1]
    rank = np.empty(m, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    levels = [rank]
    span = 1
    while True:
        # only suffixes that still share their rank are sorted on
        counts = np.bincount(rank, minlength=m)
        tied = np.flatnonzero(counts[rank] > 1)
        if not len(tied):
            break
        second = rank[np.minimum(tied + span, m - 1)]
        sub = tied[np.lexsort((second, rank[tied]))]
        head, tail = rank[sub], rank[np.minimum(sub + span, m - 1)]
        fresh = np.ones(len(sub), dtype=bool)
        fresh[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
        at = np.arange(len(sub))
        group = np.maximum.accumulate(np.where(np.append(True, head[1:] != head[:-1]), at, 0))
        inner = np.maximum.accumulate(np.where(fresh, at, 0))
        rank = rank.copy()
        rank[sub] = head + (inner - group)
        levels.append(rank)
        span *= 2
    suffixes = np.empty(m, np.int64)
    suffixes[rank] = np.arange(m)
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    common = np.zeros(m - 1, np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    for k in range(len(levels) - 1, -1, -1):
        x, y = a[live] + common[live], b[live] + common[live]
        inside = (x < m) & (y < m)
        same = np.zeros(len(live), dtype=bool)
        same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
        common[live[same]] += 1 << k
    best = np.zeros(m, np.int64)
    best[suffixes[:-1]] = common
    best[suffixes[1:]] = np.maximum(best[suffixes[1:]], common)
    return best[place]


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in the union of the spans [start, start + length)."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """FIELDS of each row of a text column given as bytes and row offsets."""
    n = len(offsets) - 1
    w = scan(data, offsets)
    n_words = np.diff(w.first)

    def per_row(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags, dtype=np.int64))
        return total[edges[1:]] - total[edges[:-1]]

    hashes = span_hashes(data, w.starts, w.ends)
    gap_free = np.zeros(len(data) + 1, np.int64)
    np.add.at(gap_free, w.starts, 1)
    np.add.at(gap_free, w.ends, -1)
    in_word = np.cumsum(gap_free[:-1]) > 0
    best = longest_repeats(hashes, w.rows)
    total = len(w.starts)
    window = np.flatnonzero(best >= WINDOW)
    repeated = _covered(window, np.full(len(window), WINDOW), total)
    long = np.flatnonzero(best >= MIN_REPEAT)
    covered = _covered(long, best[long], total)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, w.rows, best)
    # lines: between line ends; only lines with a word count
    line_ends = np.flatnonzero(data == 10)
    cuts = np.union1d(line_ends + 1, offsets)
    starts = cuts[cuts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = ends - (data[ends - 1] == 10) if len(starts) else ends
    words_in = np.searchsorted(w.starts, ends) - np.searchsorted(w.starts, starts)
    starts, ends = starts[words_in > 0], ends[words_in > 0]
    line_row = np.searchsorted(offsets, starts, side="right") - 1
    key = span_hashes(data, starts, ends)
    order = np.lexsort((key, line_row))
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (key[order][1:] == key[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    return {
        "n_words": n_words,
        "word_chars": per_row(in_word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_row(SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(line_row[order], weights=again, minlength=n).astype(np.int64),
        "n_repeat_words": per_row(repeated, w.first),
        "n_repeats_covered": per_row(covered, w.first),
        "longest_repeat": longest,
    }


def _verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"])
    fine = (100 * m["n_repeats_covered"] <= MAX_PERCENT * m["n_words"]) & (m["longest_repeat"] <= MAX_REPEAT)
    return failed, ~failed & fine


def score_quality(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, FIELDS, base_failed, kept.

    Nulls: a null text has no words and fails; null and repeated doc_ids are kept as they are. Texts are taken whole.
    n_repeats_covered: words covered by repeats of MIN_REPEAT words and more; longest_repeat: words of the longest repeat.
    Other columns are ignored; an empty table gives an empty result.
    """
    schema = "doc_id long, " + ", ".join(f"{x} long" for x in FIELDS) + ", base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, SLICE):
                m = measure(*string_buffers(part.column("text")))
                failed, kept = _verdicts(m)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(m[x], pa.int64()) for x in FIELDS), pa.array(failed), pa.array(kept)], ["doc_id", *FIELDS, "base_failed", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def keep_quality(docs: DataFrame) -> DataFrame:
    """The documents that score_quality keeps, with all their columns as they are. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, SLICE):
                yield part.filter(pa.array(_verdicts(measure(*string_buffers(part.column("text"))))[1]))

    return docs.mapInArrow(run, docs.schema)
