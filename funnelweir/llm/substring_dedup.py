"""Exact removal of passages that occur earlier in the corpus, by super-k-mers.

Words are runs of anything but ASCII white space. A window is ``width`` consecutive words of
one document; every word is removed that lies in a window whose words also start earlier
(smaller id, or the same document and a smaller position).

1. Each window has a minimiser, the least hash of its runs of ``seed_words`` words. Equal
   windows have equal minimisers, so a minimiser decides the bucket. Consecutive windows
   sharing it travel as one string of words (a super-k-mer), not window by window.
2. A task merges equal strings of a slice of texts first: only the earliest goes on, the
   others are known to be repeats. A passage in a third of all documents thus sends a
   string per slice, not per document. The strings of one slice and bucket are one
   compressed block.
3. Minimisers that own more than a quarter of a bucket are counted beforehand (a key with
   such a share has it in some slice, so slices report only those). Their windows are
   dealt out one by one, by a hash of all their words.
4. In a bucket the windows are sorted by hash, runs of equal hashes are compared word for
   word, and every window but the earliest of its kind gives its span.
5. Spans of a document are joined with its text, which loses the words they cover.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelweir.llm.common import slices

#: Text of one slice, and of one piece of a longer text.
SLICE_BYTES = 2 << 20
#: Packed text of one bucket, before compression.
BUCKET_BYTES = 16 << 20
#: Windows of one string at most; longer runs are cut, which loses no window.
RUN = 256
#: Longer words travel as a line feed, which no word holds, and their SHA-256.
LONG_WORD = 4096
#: The least share of a minimiser that is counted, so the list of them is bounded.
LEAST_SHARE = 1e-6

_ODD = 0x9E3779B97F4A7C15
_BYTE = 0x100000001B3


class Powers:
    """Powers of an odd number modulo 2**64 and their inverses, as many as were asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n += n // 4
            self.up, self.down = (np.append(np.uint64(1), np.cumprod(np.full(n, b, np.uint64))) for b in (self.base, self.inverse))
        return self.up, self.down


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Hashed:
    """Words of a text (joined by one space each): their places, and hashes of any run of them."""

    def __init__(self, text: bytes, powers: Powers) -> None:
        data = np.frombuffer(text, np.uint8)
        self.stops = np.append(np.flatnonzero(data == 32), len(data))
        self.starts = np.append(0, self.stops[:-1] + 1)
        up, self.down = powers.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def runs(self, first: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each ``first`` on."""
        begin = self.starts[first]
        return mixed((self.sums[self.stops[first + size - 1]] - self.sums[begin]) * self.down[begin])


def window_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` consecutive values."""
    least, have = values, 1
    while 2 * have <= size:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < size:
        least = np.minimum(least[: len(least) - (size - have)], least[size - have :])
    return least


def plain(words: list[bytes]) -> bytes:
    return b" ".join([w if len(w) <= LONG_WORD else b"\n" + hashlib.sha256(w).hexdigest().encode() for w in words])


def pieces(text: bytes, width: int) -> Iterator[tuple[int, int, bytes]]:
    """(position of the first word, number of words, words joined); a piece starts with the last ``width`` - 1 words of the one before."""
    at, done, tail = 0, 0, []
    while at < len(text):
        stop = min(at + SLICE_BYTES, len(text))
        while stop < len(text) and text[stop] not in b" \t\n\v\f\r":
            stop += 1
        words = tail + text[at:stop].split()
        yield done, len(words), plain(words) if len(text) > LONG_WORD else b" ".join(words)
        kept = min(len(words), width - 1)
        done, tail, at = done + len(words) - kept, words[len(words) - kept :], stop


class Slice:
    """Some texts in the order of their places: (id is missing, id, mark, first word's position, words) and the words."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.texts: list[bytes] = []
        self.size = 0


def slices_of(batch: pa.RecordBatch, width: int) -> Iterator[Slice]:
    """Slices of a batch (id, mark, text), rows in the order of their places, rows of one place once."""
    ids, marks = batch.column(0), batch.column(1)
    missing = np.asarray(ids.is_null())
    numbers, hashes = np.asarray(ids.fill_null(0)), np.asarray(marks)
    current, before = Slice(), None
    for i in np.lexsort((hashes, numbers, missing)).tolist():
        place = (bool(missing[i]), int(numbers[i]), int(hashes[i]))
        if place == before:
            continue
        before = place
        for first, n, words in pieces(batch.column(2)[i].as_py().encode(), width):
            if n >= width:
                current.rows.append((*place, first, n))
                current.texts.append(words)
                current.size += len(words)
            if current.size >= SLICE_BYTES:
                yield current
                current = Slice()
    if current.rows:
        yield current


def super_kmers(part: Slice, hashed: Hashed, width: int, seed_words: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first word, windows, key, row) of each super-k-mer of a slice.

    ``hot`` holds sorted minimisers whose windows are dealt one by one, by all their words.
    """
    lengths = np.fromiter((r[4] for r in part.rows), np.int64, len(part.rows))
    stops = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(part.rows)), lengths)
    keys = window_least(hashed.runs(np.arange(len(owner) - seed_words + 1), seed_words), width - seed_words + 1)
    at = np.flatnonzero(np.arange(len(keys)) + width <= stops[owner[: len(keys)]])
    keys, owner = keys[at], owner[at]
    alone = np.zeros(len(at), bool)
    if len(hot):
        found = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
        alone = hot[found] == keys
        if alone.any():
            keys[alone] = hashed.runs(at[alone], width)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]) | alone[1:]
    starts = np.flatnonzero(fresh)
    fresh |= (np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))) % RUN == 0
    starts = np.flatnonzero(fresh)
    return at[starts], np.diff(np.append(starts, len(at))), keys[starts], owner[starts]


def frequent_keys(texts: DataFrame, width: int, seed_words: int, share: float) -> np.ndarray:
    """Sorted minimisers that own at least ``share`` of all super-k-mers; at most 2 / share of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, none = Powers(_BYTE), np.empty(0, np.uint64)
        for batch in batches:
            for part in slices_of(batch, width):
                hashed = Hashed(b" ".join(part.texts), powers)
                keys, counts = np.unique(super_kmers(part, hashed, width, seed_words, none)[2], return_counts=True)
                often = counts >= share / 2 * counts.sum()
                names = [*keys[often].view(np.int64).tolist(), None]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([*counts[often].tolist(), int(counts.sum())], pa.int64())], names=["key", "n"])

    counted = texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    total = counted.filter("key is null").select(F.col("n").alias("total"))
    often = counted.filter("key is not null").join(F.broadcast(total), F.col("n") >= F.col("total") * F.lit(share / 2))
    return np.sort(np.array([r["key"] for r in often.select("key").collect()], np.int64).view(np.uint64))


#: How the places and sizes of a block's strings are kept, each column compressed.
COLUMNS = {"missing": np.bool_, "ids": np.int64, "marks": np.int64, "starts": np.int64, "sizes": np.int64}
BLOCK = "bucket int, strings long, missing binary, ids binary, marks binary, starts binary, sizes binary, length long, words binary"
SPANS = "missing boolean, id long, mark long, start long, stop long"


def packed_blocks(texts: DataFrame, width: int, seed_words: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """``BLOCK`` rows: the distinct strings of a slice that go to one bucket.

    A row without words holds spans that are known to be repeats, sizes in words.
    """
    names = [c.split(" ")[0] for c in BLOCK.split(", ")]
    types = [pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, codec = Powers(_BYTE), pa.Codec("zstd", 3)

        def row(bucket: int, columns: list[np.ndarray], words: bytes | None) -> pa.RecordBatch:
            packed = [codec.compress(c.astype(k).tobytes(), asbytes=True) for c, k in zip(columns, COLUMNS.values(), strict=True)]
            tail = [None, None] if words is None else [len(words), codec.compress(words, asbytes=True)]
            values = [bucket, len(columns[0]), *packed, *tail]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        for batch in batches:
            for part in slices_of(batch, width):
                text = b" ".join(part.texts)
                hashed = Hashed(text, powers)
                firsts, counts, keys, owner = super_kmers(part, hashed, width, seed_words, hot)
                sizes = counts + width - 1
                strings = [text[a:b] for a, b in zip(hashed.starts[firsts].tolist(), hashed.stops[firsts + sizes - 1].tolist(), strict=True)]
                seen: set[bytes] = set()
                fresh = np.fromiter((not (s in seen or seen.add(s)) for s in strings), bool, len(strings))
                missing, ids, marks, origin, lengths = (np.array(c, k) for c, k in zip(zip(*part.rows, strict=True), COLUMNS.values(), strict=True))
                starts = firsts - (np.cumsum(lengths) - lengths)[owner] + origin[owner]
                places = [missing[owner], ids[owner], marks[owner], starts]
                again = np.flatnonzero(~fresh)
                if len(again):
                    joint = np.ones(len(again), bool)  # neighbours in a text give one span
                    joint[1:] = (owner[again][1:] != owner[again][:-1]) | (again[1:] != again[:-1] + 1)
                    edges = np.flatnonzero(joint)
                    last = again[np.append(edges[1:], len(again)) - 1]
                    yield row(int(keys[0] % np.uint64(buckets)), [*(p[again[edges]] for p in places), starts[last] + sizes[last] - starts[again[edges]]], None)
                kept = np.flatnonzero(fresh)
                dealt = (mixed(keys[kept] * np.uint64(_ODD)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(dealt, kind="stable")
                kept, dealt = kept[order], dealt[order]
                edges = np.flatnonzero(np.append(True, dealt[1:] != dealt[:-1]))
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(kept)], strict=True):
                    chosen = kept[a:b]
                    yield row(int(dealt[a]), [*(p[chosen] for p in places), sizes[chosen]], b" ".join([strings[j] for j in chosen.tolist()]))
        pa.default_memory_pool().release_unused()

    return texts.mapInArrow(run, BLOCK)


def unpacked(block: dict) -> list[np.ndarray]:
    codec, n = pa.Codec("zstd"), block["strings"]
    return [np.frombuffer(codec.decompress(block[c], n * np.dtype(k).itemsize), k) for c, k in COLUMNS.items()]


def bucket_repeats(blocks: list[dict], width: int, powers: Powers) -> list[np.ndarray]:
    """(missing, ids, marks, starts, stops) of the spans whose windows all occur earlier."""
    codec, texts, columns, windows = pa.Codec("zstd"), [], [], []
    strings = words = 0
    for k, block in enumerate(blocks):
        texts.append(codec.decompress(block["words"], block["length"], asbytes=True))
        columns.append(unpacked(block))
        sizes = columns[-1][4]
        hashed = Hashed(texts[-1], powers)
        counts = sizes - width + 1
        string = np.repeat(np.arange(len(sizes)), counts)
        offset = np.arange(len(string)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = (np.cumsum(sizes) - sizes)[string] + offset
        windows.append([hashed.runs(at, width), string + strings, offset, at + words, np.full(len(at), k), hashed.starts[at], hashed.stops[at + width - 1]])
        strings, words = strings + len(sizes), words + len(hashed.starts)
    missing, ids, marks, starts, _ = (np.concatenate(c) for c in zip(*columns, strict=True))
    order = np.argsort(np.concatenate([w[0] for w in windows]))
    hashes, string, offset, at, block, begin, end = (np.concatenate(c) for c in zip(*windows, strict=True))
    same = hashes[order][1:] == hashes[order][:-1]
    order = order[np.append(same, False) | np.append(False, same)]
    hashes, string, offset, at = (c[order] for c in (hashes, string, offset, at))
    spelled = [texts[k][a:b] for k, a, b in zip(block[order].tolist(), begin[order].tolist(), end[order].tolist(), strict=True)]
    fresh = np.fromiter((a != b for a, b in zip([None, *spelled], spelled)), bool, len(spelled))
    if (fresh[1:] & (hashes[1:] == hashes[:-1])).any():  # equal hashes of different windows: number the windows themselves
        numbers: dict[bytes, int] = {}
        group = np.array([numbers.setdefault(s, len(numbers)) for s in spelled])
    else:
        group = np.cumsum(fresh)
    del spelled
    where = starts[string] + offset
    sort = np.lexsort((where, marks[string], ids[string], missing[string], group))
    group, string, where, at = group[sort], string[sort], where[sort], at[sort]
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, np.int64)
    head = np.repeat(head, np.diff(np.append(head, len(group))))
    later = (where != where[head]) | (marks[string] != marks[string[head]]) | (ids[string] != ids[string[head]]) | (missing[string] != missing[string[head]])
    sort = np.flatnonzero(later)
    sort = sort[np.argsort(at[sort])]
    string, where, at = string[sort], where[sort], at[sort]
    # the last window of a string lies width - 1 words before the next string, so a run never spans two
    edges = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1)) if len(at) else np.empty(0, np.int64)
    owner, last = string[edges], np.append(edges[1:], len(at))[: len(edges)] - 1
    return [missing[owner], ids[owner], marks[owner], where[edges], where[last] + width]


def repeated_spans(blocks: DataFrame, width: int, buckets: int) -> DataFrame:
    """``SPANS`` rows; the id is 0 where it is missing."""
    names = [c.split(" ")[0] for c in SPANS.split(", ")]

    def rows(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, current, held = Powers(_BYTE), None, []
        for batch in batches:
            for block in batch.to_pylist():
                if block["words"] is None:
                    missing, ids, marks, starts, sizes = unpacked(block)
                    yield rows(missing, ids, marks, starts, starts + sizes)
                    continue
                if block["bucket"] != current and held:
                    yield rows(*bucket_repeats(held, width, powers))
                    held = []
                current = block["bucket"]
                held.append(block)
        if held:
            yield rows(*bucket_repeats(held, width, powers))
        pa.default_memory_pool().release_unused()

    return blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, SPANS)


def without_repeats(docs: DataFrame, width: int = 20, seed_words: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (the words left, joined by one space).

    Null texts have no words and lose none. Texts of any length are handled in overlapping
    pieces; only the last step holds a text whole. Rows with a null id come after all
    others. Rows with equal ids are ordered by a hash of their texts, and of rows equal in both
    one counts as the earliest, so the others lose every word of a text of ``width`` words or
    more. Ids must be integers; other columns are not read. An empty table gives an empty one.
    """
    if docs.schema[id_column].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_column} must be an integer column")
    if not 0 < seed_words <= width:
        raise ValueError("seed_words must lie between 1 and width")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    base = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    size = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(3 * size / BUCKET_BYTES))
    long_enough = base.filter(F.octet_length("text") >= 2 * width - 1)
    hot = frequent_keys(long_enough, width, seed_words, max(1 / (4 * buckets), LEAST_SHARE))
    spans = repeated_spans(packed_blocks(long_enough, width, seed_words, buckets, hot), width, buckets)
    # no key is null, so equal rows, their spans and the join share one partitioning, and a text is shuffled once
    keys = ["missing", "id", "mark"]
    found = spans.groupBy(keys).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    own = base.select(F.col("id").isNull().alias("missing"), F.coalesce("id", F.lit(0)).alias("id"), "mark", "text")
    rows = own.groupBy(keys).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    joined = rows.join(found, keys, "left").select(F.when(~F.col("missing"), F.col("id")).alias("id"), "copies", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, left, kept = [], [], []
            for i in range(batch.num_rows):
                words = batch.column(2)[i].as_py().encode().split()
                sizes.append(len(words))
                given = batch.column(3)[i]
                if given.is_valid:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, np.asarray(given.values.field("start")), 1)
                    np.add.at(change, np.asarray(given.values.field("stop")), -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                left.append(len(words))
                kept.append(b" ".join(words).decode())
            n_words = np.array(sizes, np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(n_words), pa.array(n_words - np.array(left, np.int64)), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "copies", "n_words", "n_removed", "kept"])

    out = joined.mapInArrow(run, "id long, copies long, n_words long, n_removed long, kept string")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    emptied = (F.col("copy") > 1) & (F.col("n_words") >= width)
    return out.select(
        F.col("id").alias(id_column),
        "n_words",
        F.when(emptied, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(emptied, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )
