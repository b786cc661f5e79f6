"""Near duplicates by SimHash fingerprints and pigeonhole blocks.

1. Fingerprints: words are runs of anything but ASCII white space, A-Z lower-cased;
   shingles of ``words`` words (a shorter text: all its words) are hashed with XXH64; a bit
   is 1 if it is set in over half of the hashes, repeats included. No words: zero.
2. Equal fingerprints become one class before any join, so copies cost one row.
3. Pigeonhole: the 64 bits are split into five pieces. Two fingerprints that differ in at
   most 2 bits agree in three of them at least, and each choice of three is a block of
   about 38 bits. Classes are joined on blocks, then their Hamming distance is verified.
4. Blocks of more than ``crowd`` classes would give pairs in the square of their size.
   Their classes are linked exactly by another way: each gives itself and its 64
   neighbours at one bit. Two fingerprints differ in at most 2 bits just if they share
   such a key, so all that share one are linked, and a star per key loses no connection.
5. Components over the classes, then back to the documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelweir.llm.common import cut, slices
from funnelweir.llm.graph import components

SEED = 42
#: Hashes that are held at once for one text.
STEP = 1 << 18


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle in order, in arrays of at most ``STEP``; none if there is no word."""
    found = text.encode().lower().split()
    if not found:
        return
    joined = b" ".join(found)
    if len(found) <= words:
        yield np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
        return
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(found) - words + 1
    first, last = starts[:n].tolist(), ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        yield np.array([digest(joined[s:e], SEED) for s, e in zip(first[at : at + STEP], last[at : at + STEP], strict=True)], "<u8")


def text_marks(text: str, words: int, size: int = 0) -> tuple[int, bytes]:
    """The fingerprint, and the ``size`` smallest distinct hashes of the shingles, in order."""
    n, ones, least = 0, np.zeros(64, np.int64), np.empty(0, "<u8")
    for hashes in shingle_hashes(text, words):
        n += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        if size:
            least = np.unique(np.concatenate((least, hashes)))[:size]
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]), least.tobytes()


def fingerprints(docs: DataFrame, words: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp): the 64 bits as a signed long. Null texts have no words; null ids are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1)
            values = np.array([text_marks(texts[i].as_py(), words)[0] for i in range(len(texts))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def block_masks(distance: int, agree: int = 3) -> list[int]:
    """Bit masks of the blocks: every choice of ``agree`` among ``distance + agree`` pieces."""
    n = distance + agree
    edges = [round(64 * k / n) for k in range(n + 1)]
    pieces = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(pieces, agree)]


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def fingerprint_links(classes: DataFrame, crowd: int = 32) -> DataFrame:
    """Edges (u, v) over distinct fingerprints ``fp`` that connect all within 2 bits of each other."""
    distance = 2
    masks = F.array(*[F.struct(F.lit(k).alias("block"), F.lit(signed(m)).alias("mask")) for k, m in enumerate(block_masks(distance))])
    blocks = classes.select("fp", F.explode(masks).alias("m")).select("fp", F.col("m.block").alias("block"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("part"))
    sizes = cut(blocks.groupBy("block", "part").agg(F.count("*").alias("members")).filter("members > 1"))
    shared = blocks.join(sizes, ["block", "part"])
    roomy = shared.filter(F.col("members") <= crowd).select("block", "part", "fp")
    other = roomy.select("block", "part", F.col("fp").alias("v"))
    pairs = roomy.join(other, ["block", "part"]).filter(F.col("fp") > F.col("v"))
    near = pairs.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= distance).select(F.col("fp").alias("u"), "v")
    return near.union(crowd_links(shared.filter(F.col("members") > crowd).select("fp").distinct())).distinct()


def crowd_links(crowded: DataFrame) -> DataFrame:
    """Stars over shared keys: the value itself and its neighbours at one bit."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << b)) for b in range(64)])
    keys = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
    least = keys.groupBy("key").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).filter("v <> most").select("key", "v")
    return keys.join(least, "key").filter("fp <> v").select(F.col("fp").alias("u"), "v")


def near_duplicates(docs: DataFrame, words: int = 3, crowd: int = 32, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hexadecimal digits), component_id.

    component_id: the smallest id that links reach, the document's own included. Rows with
    a null id take part in links and get a component, but give none its id: only a
    component without any other id has null. Repeated rows stay repeated.
    """
    marked = cut(fingerprints(docs, words, id_column, text_column))
    classes = cut(marked.groupBy("fp").agg(F.min("id").alias("least")))
    labels = components(fingerprint_links(classes.select("fp"), crowd))
    placed = cut(classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = cut(placed.groupBy("component").agg(F.min("least").alias("component_id")))
    named = cut(placed.select("fp", "component").join(least, "component").select("fp", "component_id"))
    hexadecimal = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(named, "fp").select(F.col("id").alias(id_column), hexadecimal, "component_id")


# ---- estimates from the smallest hashes; no link rests on them


def sketch_similarity(a: bytes, b: bytes, size: int) -> float:
    """Jaccard similarity of two shingle sets: exact if both fit their sketches, else estimated from the smallest hashes of the union."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    union = np.union1d(x, y)
    if max(len(x), len(y)) >= size:
        union = union[:size]
    if not len(union):
        return 1.0
    return float(np.isin(union, np.intersect1d(x, y, assume_unique=True), assume_unique=True).mean())


def upper_halves(sketch: bytes) -> bytes:
    """The upper 32 bits of each hash: in the same order, at half the bytes."""
    return np.frombuffer(sketch, "<u4")[1::2].tobytes()


def spare_room(classes: DataFrame, similarity: float, size: int) -> DataFrame:
    """(class_id, fp, spare): how many hashes of its own a class could have and still be similar, less those it has.

    Similar sketches of n and m hashes differ in at most (n + m) * (1 - similarity) /
    (1 + similarity) hashes, and the first ``similarity * size`` of each are all compared.
    A hash that no other class has differs from every other sketch. So two classes are
    similar only if their ``spare`` sum up to 0 or more: no link that :func:`verified` would
    give is lost. Classes that no class can be similar to, texts of their own, are left out.
    Each hash is one row, counted before the shuffle, so frequent shingles are no hot keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sketches = batch.column(1)
            parts = [np.frombuffer(sketches[i].as_py(), "<i8") for i in range(len(sketches))]
            lengths = np.array([len(x) for x in parts], np.int64)
            place = np.concatenate([np.arange(n) for n in lengths]) if len(parts) else np.empty(0, np.int64)
            node = pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), lengths), pa.int64())
            values = pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([node, values, pa.array(place < similarity * size)], names=["class_id", "value", "early"])

    rows = classes.select("class_id", "sketch").mapInArrow(run, "class_id long, value long, early boolean")
    values = rows.groupBy("value").agg(F.count("*").alias("n"), F.min("class_id").alias("class_id"), F.max("early").alias("early"))
    own = values.filter("n = 1 and early").groupBy("class_id").agg(F.count("*").alias("own"))
    share = (1 - similarity) / (1 + similarity)
    spare = (F.octet_length("sketch") / 8 * share - F.coalesce("own", F.lit(0)) + 1e-9).alias("spare")
    return classes.join(own, "class_id", "left").select("class_id", "fp", spare).filter(F.col("spare") + size * share >= 0)


# ---- similar texts: pairs by fingerprints and by a complete prefix filter, verified on the whole shingle sets

#: Counters of shingles by the upper bits of their hashes: they only decide an order.
COUNTERS = 1 << 20
#: Bits of a filter by the upper bits of a hash: what it lets through is checked exactly later.
FILTER = 1 << 26


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct hashes of the shingles, in order."""
    return np.unique(np.concatenate([np.empty(0, "<u8"), *shingle_hashes(text, words)]))


def set_and_fingerprint(text: str, words: int) -> tuple[np.ndarray, int]:
    """As :func:`shingle_set` and :func:`text_marks` give them, from one pass over the shingles."""
    n, ones, parts = 0, np.zeros(64, np.int64), [np.empty(0, "<u8")]
    for hashes in shingle_hashes(text, words):
        n += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        parts.append(hashes)
    return np.unique(np.concatenate(parts)), int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def places(values: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` (a power of 2) slots each hash belongs to."""
    return (values.astype("<u8", copy=False) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def summed(parts: DataFrame, kind: str, merge: np.ufunc, size: int) -> np.ndarray:
    """Compressed arrays of ``size`` numbers, one per task, merged in a few tasks and then on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for batch in batches:
            for part in batch.column(0):
                merge(total, np.frombuffer(zlib.decompress(part.as_py()), kind), out=total)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["part"])

    total = np.zeros(size, kind)
    for row in parts.repartition(8).mapInArrow(run, "part binary").collect():
        merge(total, np.frombuffer(zlib.decompress(bytes(row["part"])), kind), out=total)
    return total


def shingle_counts(docs: DataFrame, words: int, text_column: str) -> np.ndarray:
    """How often the shingles of each counter occur, once per text: a fixed size, whatever the input's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, "<u4")
        for batch in slices(batches):
            texts = batch.column(0)
            for i in range(len(texts)):
                np.add.at(counts, places(shingle_set(texts[i].as_py(), words), COUNTERS), np.uint32(1))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=["part"])

    return summed(docs.select(F.coalesce(F.col(text_column), F.lit(""))).mapInArrow(run, "part binary"), "<u4", np.add, COUNTERS)


def presence(values: DataFrame) -> np.ndarray:
    """A filter for the hashes in the only column of ``values``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER // 8, np.uint8)
        for batch in slices(batches, 1 << 16):
            at = places(batch.column(0).to_numpy(zero_copy_only=False).view("<u8"), FILTER)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["part"])

    return summed(values.mapInArrow(run, "part binary"), "u1", np.bitwise_or, FILTER // 8)


def passed(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = places(values.view("<u8"), FILTER)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def parity(values: np.ndarray, size: int) -> np.ndarray:
    """``size`` bits as longs, each the parity of the hashes that fall on it: two sets differ in at least as many hashes as their bits do."""
    odd = np.bincount((values & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def marked_sets(docs: DataFrame, words: int, similarity: float, size: int, id_column: str, text_column: str) -> DataFrame:
    """(id, h, class_id, fp, n, weight, bits, prefix); h: hash of the whole text, class_id: of its set of n shingles, fp: its fingerprint.

    prefix: the rarest n - ceil(similarity * n) + 1 shingles by the counters, ties by hash.
    Sets that are similar enough share one of them in any order that holds for all sets.
    weight: the mean count of the prefix; the more a set has of its own, the smaller.
    """
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, words, text_column))
    names = ["id", "h", "class_id", "fp", "n", "weight", "bits", "prefix"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def one(text: str) -> tuple:
        own, fp = set_and_fingerprint(text, words)
        much = counts.value[places(own, COUNTERS)]
        keep = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1 if len(own) else 0
        first = np.lexsort((own, much))[:keep]
        weight = int(much[first].mean()) if keep else 0
        return signed(xxhash.xxh64_intdigest(own.tobytes(), SEED)), signed(fp), len(own), weight, parity(own, size).tolist(), own[first].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [one(text.as_py()) for text in batch.column(2)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns, kinds)], names=names)

    text = F.coalesce(F.col(text_column), F.lit(""))
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return rows.mapInArrow(run, f"id {kind}, h long, class_id long, fp long, n int, weight long, bits array<long>, prefix binary")


def prefix_rows(classes: DataFrame, among: np.ndarray | None = None) -> DataFrame:
    """(class_id, n, weight, value): a row for each hash of a prefix that the filter ``among`` lets through."""
    held = None if among is None else classes.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = [np.frombuffer(x.as_py(), "<i8") for x in batch.column(3)]
            values = np.concatenate([np.empty(0, "<i8"), *parts])
            row = np.repeat(np.arange(batch.num_rows), np.array([len(x) for x in parts], np.int64))
            if held is not None:
                stay = passed(values, held.value)
                values, row = values[stay], row[stay]
            own = [batch.column(k).take(pa.array(row)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(values, pa.int64())], names=["class_id", "n", "weight", "value"])

    return classes.select("class_id", "n", "weight", "prefix").mapInArrow(run, "class_id long, n int, weight long, value long")


def whole_sets(docs: DataFrame, needed: DataFrame, words: int, text_column: str) -> DataFrame:
    """(h, shingles): all hashes of the texts whose ``h`` is in ``needed``, made anew, and of a few others that the filter lets through."""
    held = docs.sparkSession.sparkContext.broadcast(presence(needed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            batch = batch.filter(pa.array(passed(batch.column(0).to_numpy(zero_copy_only=False), held.value), pa.bool_()))
            own = [shingle_set(text.as_py(), words).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["h", "shingles"])

    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(run, "h long, shingles binary")
    return rows.groupBy("h").agg(F.first("shingles").alias("shingles"))


def similar_sets(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether the exact Jaccard similarity of two sets of hashes is large enough."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, similarity: float, text_column: str) -> DataFrame:
    """The pairs (u, v) of classes whose whole shingle sets are similar enough.

    Sets are the widest rows here. They are keyed by their texts' hashes, as they come from
    the grouping, so both joins read that one shuffle; only pairs travel again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, y = batch.column(2), batch.column(3)
            good = [similar_sets(x[i].as_py(), y[i].as_py(), similarity) for i in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    texts = lambda c: classes.select(F.col("class_id").alias(c), F.col("h").alias(f"{c}_h"))
    named = cut(pairs.join(texts("u"), "u").join(texts("v"), "v").select("u", "v", "u_h", "v_h"))
    sets = whole_sets(docs, cut(named.select(F.explode(F.array("u_h", "v_h")).alias("h")).distinct()), words, text_column)
    left = sets.select(F.col("h").alias("u_h"), F.col("shingles").alias("x"))
    right = sets.select(F.col("h").alias("v_h"), F.col("shingles").alias("y"))
    return named.join(left, "u_h").join(right, "v_h").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (u, v) that connect all classes (class_id, fp, weight) whose fingerprints differ in at most 2 bits.

    Classes of one fingerprint meet its head, the class with most ``weight``; heads meet by
    pigeonhole blocks and their Hamming distance.
    """
    heads = cut(classes.groupBy("fp").agg(F.min(F.struct(-F.col("weight"), "class_id")).alias("head")).select("fp", F.col("head.class_id").alias("head")))
    equal = classes.select("fp", "class_id").join(heads, "fp").filter("class_id <> head").select(F.col("class_id").alias("u"), F.col("head").alias("v"))
    links = fingerprint_links(heads.select("fp")).withColumnsRenamed({"u": "a", "v": "b"})
    first, second = (heads.select(F.col("fp").alias(c), F.col("head").alias(n)) for c, n in (("a", "u"), ("b", "v")))
    return equal.union(links.join(first, "a").join(second, "b").select("u", "v"))


def similar_links(docs: DataFrame, classes: DataFrame, words: int, similarity: float, size: int, reach: int | None, text_column: str) -> DataFrame:
    """(node, component) of the classes that similar candidates connect.

    SimHash proposes the pairs whose fingerprints differ in at most 2 bits, by pigeonhole
    blocks. Similar texts may differ in more bits, so others come beside them: they share a
    shingle of their prefixes, and neither their lengths nor their parity bits rule the
    similarity out, so no similar pair is lost. All are verified on the whole sets. At first
    every class is compared with the leader of each of its shingles, the class with most ``weight``: of copies the one that was changed
    least. That connects large groups of near copies at the cost of a row per member. Then
    only classes that are not yet connected with a leader are compared with the others that
    have the shingle. What the second step leaves out is connected already, so no connection
    is lost. Members that look alike and are not similar enough stay pairs, whose number
    grows with the square of such a group.
    """
    share = (1 - similarity) / (1 + similarity)

    def near(a: str, b: str) -> Column:
        n, m = F.col(f"{a}n"), F.col(f"{b}n")
        x, y = F.col(f"{a}bits"), F.col(f"{b}bits")
        differ = sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(size // 64)), F.lit(0))
        fits = (F.least(n, m) >= F.greatest(n, m) * similarity - 1e-9) & (differ <= (n + m) * share + 1e-9)
        return fits if reach is None else fits & (F.bit_count(F.col(f"{a}fp").bitwiseXOR(F.col(f"{b}fp"))) <= reach)

    def side(prefix: str, *more: str) -> list[Column]:
        return [F.col(c).alias(prefix + c) for c in ("n", "bits", "fp", *more)]

    marks = classes.select("class_id", "n", "bits", "fp")

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that are near by their marks, which are joined to pairs only once."""
        left, right = (marks.select(F.col("class_id").alias(c), *[F.col(m).alias(f"{c}_{m}") for m in ("n", "bits", "fp")]) for c in ("u", "v"))
        return pairs.join(left, "u").join(right, "v").filter(near("u_", "v_")).select("u", "v")

    # a row per class and shingle stays narrow: it is the largest table here
    several = cut(prefix_rows(classes).groupBy("value").agg(F.count("*").alias("members")).filter("members > 1").select("value"))
    shared = cut(prefix_rows(classes, presence(several)).join(several, "value").select("value", "class_id", "n", "weight"))
    leads = shared.groupBy("value").agg(F.min(F.struct(-F.col("weight"), "class_id", "n")).alias("lead")).select("value", F.col("lead.class_id").alias("v"), F.col("lead.n").alias("v_n"))
    lengths = F.least("n", "v_n") >= F.greatest("n", "v_n") * similarity - 1e-9
    stars = shared.join(leads, "value").filter((F.col("class_id") != F.col("v")) & lengths).select(F.col("class_id").alias("u"), "v")
    # what fingerprints and leaders propose is verified together, so sets travel once for both
    proposed = cut(alike(fingerprint_pairs(classes).union(stars).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()))
    edges = cut(verified(proposed, docs, classes, words, similarity, text_column))
    labels = cut(components(edges).withColumnRenamed("node", "class_id"))
    grouped = shared.join(labels, "class_id", "left").select("value", "class_id", F.coalesce("component", "class_id").alias("group"), "weight")
    # shingles whose classes are connected already are done
    lead = F.min(F.struct(-F.col("weight"), "class_id", "group")).alias("lead")
    spread = grouped.groupBy("value").agg(F.min("group").alias("low"), F.max("group").alias("high"), lead).filter("low <> high")
    spread = spread.select("value", F.col("lead.group").alias("lead"))
    members = cut(grouped.drop("weight").join(spread, "value").join(marks, "class_id"))
    rest = members.filter("group <> lead").select("value", F.col("class_id").alias("u"), F.col("group").alias("u_group"), *side("u_"))
    open_pair = (F.col("group") != F.col("u_group")) & ((F.col("group") == F.col("lead")) | (F.col("u") < F.col("class_id")))
    pairs = members.select("value", "class_id", "group", "lead", *side("v_")).join(rest, "value").filter(open_pair & near("u_", "v_"))
    pairs = cut(pairs.select("u", F.col("class_id").alias("v")).distinct())
    return components(edges.union(verified(pairs, docs, classes, words, similarity, text_column)))


def without_near_copies(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, reach: int | None = None, size: int = 512, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows of ``docs`` of which one of each group of similar texts stays: the one with the smallest id.

    SimHash fingerprints and a prefix filter propose pairs, whole sets decide (see :func:`similar_links`). Texts link if the sets of their ``words``-word shingles have a Jaccard similarity of
    ``similarity`` or more, counted on the whole sets. All such pairs are found (shingles
    stand for their 64-bit hashes). ``size``: parity bits, a multiple of 64 and a power of 2,
    by which pairs that are surely apart are skipped; it does not change the result.
    ``reach``, if given, leaves out pairs whose fingerprints differ in more bits, similar ones too.
    Of repeated rows one stays. A row with a null id stays only if no row of its group has an id.
    """
    marked = cut(marked_sets(docs, words, similarity, size, id_column, text_column))
    named = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("h").alias("h"))
    first = [F.first(c).alias(c) for c in ("fp", "n", "weight", "bits", "prefix")]
    classes = cut(marked.groupBy("class_id").agg(F.min(named).alias("least"), F.min("h").alias("h"), *first))
    labels = similar_links(docs, classes, words, similarity, size, reach, text_column)
    groups = classes.select("class_id", "least").join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    stay = groups.groupBy(F.coalesce("component", "class_id").alias("g")).agg(F.min("least").alias("least"))
    stay = cut(stay.select(F.col("least.id").alias("__id"), F.col("least.h").alias("__h")))
    columns = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    # keys without nulls, the same for the join and for repeated rows: texts are shuffled once
    named = lambda c: {"__none": F.col(c).isNull(), "__name": F.coalesce(F.col(c).cast("string"), F.lit(""))}
    rows = docs.select(*[F.col(c).alias(n) for c, n in columns.items()])
    rows = rows.withColumns({**named(columns[id_column]), "__h": F.xxhash64(F.coalesce(F.col(columns[text_column]), F.lit("")))})
    keys = ["__none", "__name", "__h"]
    kept = rows.join(stay.withColumns(named("__id")).drop("__id"), keys).dropDuplicates(keys)
    return kept.select(*[F.col(n).alias(c) for c, n in columns.items()])
