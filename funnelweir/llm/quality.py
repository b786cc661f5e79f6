"""Quality rules over whole texts, with repetition measured on suffix arrays.

Words are runs of anything but ASCII white space. Besides counts (word characters,
symbols, repeated lines, words in repeated 3-word windows) each text gets a suffix array
of its words by prefix doubling; the longest common prefixes of neighbouring suffixes give
the repeated passages. Passages of at least ``min_repeat`` words are taken at their full
length, the union of their spans is the covered part, and a text is rejected if it covers
over ``max_covered`` of its words or if the longest passage exceeds ``max_longest`` words.
Words of such passages also lie in repeated 3-word windows, of which the base rule allows half of
the words: only a ``max_covered`` well below that can reject a text that passes the base rule.

Null texts have no words. Texts are handled one by one: memory follows the longest text of
a batch. Every input row gives one output row; ids may be null or repeated, and other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelweir.llm.common import slices

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "repeat_words long, longest_repeat long, repeat_spans array<struct<start:long,stop:long>>, base_failed boolean, kept boolean"
)


def window_codes(words: np.ndarray, distinct: int, size: int) -> np.ndarray:
    """A number per window of ``size`` words, equal just for equal windows."""
    codes, n = words.astype(np.int64), len(words)
    for k in range(1, size):
        if (int(codes.max()) + 1) * distinct >= 1 << 62:
            codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        codes = codes[: n - k] * distinct + words[k:]
    return codes


def words_in_repeats(codes: np.ndarray, size: int) -> int:
    """Words that lie in a window whose code occurs twice or more."""
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(codes), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(codes) + size - 1, bool)
    for k in range(size):
        covered[k : k + len(codes)] |= again
    return int(covered.sum())


def suffix_repeats(words: np.ndarray, distinct: int) -> np.ndarray:
    """For every word the length of the longest passage from it on that occurs elsewhere too.

    Prefix doubling: after round k the suffixes are ranked by their first 2**k words, until
    all ranks differ. The rank tables then give the common prefix of neighbours in the
    order, from the largest power down.
    """
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    tables, step = [rank], 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        if rank.max() == n - 1:
            break
        tables.append(rank)
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for k in range(len(tables) - 1, -1, -1):
        # a table's equal ranks stand for equal words only where 2**k words are left
        inside = np.flatnonzero((a + (1 << k) <= n) & (b + (1 << k) <= n))
        same = inside[tables[k][a[inside]] == tables[k][b[inside]]]
        common[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    longest = np.zeros(n, np.int64)
    longest[order[1:]] = common
    longest[order[:-1]] = np.maximum(longest[order[:-1]], common)
    return longest


def repeated_spans(words: np.ndarray, distinct: int, min_repeat: int) -> tuple[list[tuple[int, int]], int]:
    """Union of the spans of repeated passages of at least ``min_repeat`` words, and the longest passage."""
    if len(words) <= min_repeat or not words_in_repeats(window_codes(words, distinct, min_repeat), min_repeat):
        return [], 0  # a passage of that length repeats just if a window of that length does
    longest = suffix_repeats(words, distinct)
    starts = np.flatnonzero(longest >= min_repeat)
    stops = np.maximum.accumulate(starts + longest[starts])
    first = np.concatenate(([True], starts[1:] > stops[:-1]))
    last = np.concatenate((first[1:], [True]))
    return list(zip(starts[first].tolist(), stops[last].tolist(), strict=True)), int(longest.max())


def measure(text: str, min_repeat: int, max_covered: float, max_longest: int) -> tuple:
    found = text.encode().split()
    n = len(found)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    doubled = len(lines) - len(set(lines))
    repeated, spans, longest = 0, [], 0
    if n >= 4:
        numbers: dict[bytes, int] = {}
        words = np.fromiter([numbers.setdefault(w, len(numbers)) for w in found], np.int64, n)
        repeated = words_in_repeats(window_codes(words, len(numbers), 3), 3)
        if repeated >= min_repeat:
            spans, longest = repeated_spans(words, len(numbers), min_repeat)
    covered = sum(stop - start for start, stop in spans)
    failed = n < 50 or 100 * repeated > 50 * n
    kept = not failed and covered <= max_covered * n and longest <= max_longest
    return n, chars, symbols, doubled, repeated, covered, longest, [{"start": a, "stop": b} for a, b in spans], failed, kept


def accepted(
    docs: DataFrame, min_repeat: int = 10, max_covered: float = 0.2, max_longest: int = 50, text_column: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns as they are."""
    where = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(where)
            yield batch.filter(pa.array([measure(texts[i].as_py() or "", min_repeat, max_covered, max_longest)[-1] for i in range(len(texts))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def quality(
    docs: DataFrame, min_repeat: int = 10, max_covered: float = 0.2, max_longest: int = 50, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """id and ``COLUMNS``; repeat_spans are word positions, stop excluded; repeat_words their union.

    ``min_repeat`` must be 3 or more: longer passages are looked for only where 3-word
    windows repeat.
    """
    if min_repeat < 3:
        raise ValueError("min_repeat must be 3 or more")
    names = [c.split(" ")[0] for c in COLUMNS.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1)
            rows = [measure(texts[i].as_py(), min_repeat, max_covered, max_longest) for i in range(len(texts))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=["id", *names])

    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = docs.schema[id_column].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, {COLUMNS}").withColumnRenamed("id", id_column)
