"""Substring removal, hard negatives and whitening against brute force, and on odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from funnelweir.llm import hard_negatives, qd, queries, substring_dedup, whitening

SF = "/root/testdata/sf0.001"


# ---- substring removal


def brute_repeats(rows, width=20):
    """rows (id, text) -> sorted (id, n_words, n_removed, kept), nulls last, equal rows in any order."""
    placed = sorted(((i is None, i or 0, t or "") for i, t in rows))
    by_hash = {}
    for none, i, text in placed:
        by_hash.setdefault((none, i), []).append(text)
    seen, out = set(), []
    for none, i, text in placed:
        words = text.encode().split()
        covered = [False] * len(words)
        for a in range(len(words) - width + 1):
            window = tuple(words[a : a + width])
            if window in seen:
                covered[a : a + width] = [True] * width
            seen.add(window)
        kept = b" ".join(w for w, c in zip(words, covered, strict=True) if not c).decode()
        out.append((None if none else i, len(words), sum(covered), kept))
    return sorted(out, key=str)


def removed(df, **more):
    return sorted(map(tuple, substring_dedup.without_repeats(df, **more).collect()), key=str)


@pytest.fixture(scope="module")
def passages():
    """Distinct ids; shared passages, copies, a text that repeats itself, short, empty, null and long texts, odd white space."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, line = prose(55), prose(20)
    rows = [(1, prose(70)), (2, None), (3, ""), (4, " \n\t "), (5, prose(19)), (6, line), (7, line), (8, "x " * 600), (9, "y\x0bx\n" + "x\t" * 40)]
    rows += [(20 + k, f"{prose(30)}\n{shared}\x0c {prose(25)}") for k in range(40)]
    rows += [(100 + k, rows[0][1]) for k in range(30)]
    rows += [(200, prose(40_000)), (201, "é漢 " * 30 + shared), (202, "w" * 9000 + " " + line + " " + "w" * 9000), (203, "w" * 9000 + " " + line), (204, shared + " " + shared), (-5, line + " z")]
    rng.shuffle(rows)
    return rows


def test_repeats_equal_brute_force(spark, passages):
    for parts in (1, 5):
        df = spark.createDataFrame(passages, "doc_id long, text string").repartition(parts)
        assert removed(df) == brute_repeats(passages)


def test_repeats_do_not_depend_on_slices_pieces_or_frequent_keys(spark, passages, monkeypatch):
    rows = passages[:70]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute_repeats(rows, 6)
    assert removed(df, width=6, seed_words=2) == expected
    assert removed(df, width=6, seed_words=6) == expected


def test_repeats_in_small_slices_and_single_windows():
    """Pieces of a long text, slices of a batch and windows dealt one by one give the same spans."""
    import pyarrow as pa

    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") + rng.choice("de") for _ in range(rng.randint(0, 400))) for _ in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array([0] * 30), pa.array(texts)], names=["id", "mark", "text"])

    class Rows:
        def mapInArrow(self, run, schema):
            self.run = run
            return self

    def spans(hot, step):
        old, substring_dedup.SLICE_BYTES = substring_dedup.SLICE_BYTES, step
        try:
            made = [r for b in substring_dedup.packed_blocks(Rows(), 9, 3, 4, hot).run(iter([batch])) for r in b.to_pylist()]
        finally:
            substring_dedup.SLICE_BYTES = old
        covered, powers = {}, substring_dedup.Powers(substring_dedup._BYTE)
        for k in {r["bucket"] for r in made}:
            blocks = [r for r in made if r["bucket"] == k and r["words"] is not None]
            found = [c.tolist() for c in substring_dedup.bucket_repeats(blocks, 9, powers)] if blocks else [[]] * 5
            for r in made:
                if r["bucket"] == k and r["words"] is None:
                    _, ids, _, starts, sizes = substring_dedup.unpacked(r)
                    found = [found[0], found[1] + ids.tolist(), found[2], found[3] + starts.tolist(), found[4] + (starts + sizes).tolist()]
            for i, a, b in zip(found[1], found[3], found[4], strict=True):
                covered.setdefault(i, set()).update(range(a, b))
        return {i: len(c) for i, c in covered.items()}

    expected = {i: n for i, _, n, _ in brute_repeats(list(enumerate(texts)), 9) if n}
    none = np.empty(0, np.uint64)
    assert spans(none, 1 << 20) == expected
    assert spans(none, 100) == expected
    text = substring_dedup.Hashed(b" ".join(t.encode() for t in texts if t), substring_dedup.Powers(substring_dedup._BYTE))
    keys = np.unique(substring_dedup.window_least(text.runs(np.arange(len(text.starts) - 2), 3), 7))
    assert spans(keys, 300) == expected
    assert spans(keys[::2], 300) == expected


def test_equal_hashes_of_different_windows_stay_apart(monkeypatch):
    import pyarrow as pa

    texts = ["a b c d", "e f g h", "a b c d", "e f g x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array([0] * 4), pa.array(texts)], names=["id", "mark", "text"])

    class Rows:
        def mapInArrow(self, run, schema):
            return list(run(iter([batch.slice(k, 1) for k in range(4)])) and [r for k in range(4) for b in run(iter([batch.slice(k, 1)])) for r in b.to_pylist()])

    monkeypatch.setattr(substring_dedup.Hashed, "runs", lambda self, first, size: np.zeros(len(first), np.uint64))
    blocks = substring_dedup.packed_blocks(Rows(), 3, 2, 1, np.empty(0, np.uint64))
    missing, ids, marks, starts, stops = substring_dedup.bucket_repeats(blocks, 3, substring_dedup.Powers(substring_dedup._BYTE))
    covered = {}
    for i, a, b in zip(ids.tolist(), starts.tolist(), stops.tolist(), strict=True):
        covered.setdefault(i, set()).update(range(a, b))
    assert covered == {2: {0, 1, 2, 3}, 3: {0, 1, 2}}


def test_repeats_nulls_equal_rows_clashes_and_empty_tables(spark, passages):
    base = passages[0][1] if passages[0][1] and len(passages[0][1].split()) > 20 else "q " * 30 + "end"
    rows = [(None, base), (None, base), (1, base), (1, base), (2, "a b"), (2, "a b"), (None, None), (None, "own " * 25)]
    named = [(i, t, 1, "k", 2, 3, 4) for i, t in rows]
    df = spark.createDataFrame(named, "doc_id int, text string, id int, mark string, copies int, spans int, bucket int")
    out = substring_dedup.without_repeats(df)
    n = len(base.split())
    by = sorted(((r.doc_id, r.n_words, r.n_removed) for r in out.collect()), key=str)
    own = [r for r in brute_repeats(rows) if r[0] == 1]
    first = min(r[2] for r in own)
    assert by == sorted([(None, n, n), (None, n, n), (1, n, first), (1, n, n), (2, 2, 0), (2, 2, 0), (None, 0, 0), (None, 25, 24)], key=str)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept"]
    assert substring_dedup.without_repeats(df.filter("1 = 0")).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.without_repeats(df.withColumn("doc_id", F.lit("x")))


def test_op11_equals_brute_force(spark):
    import hashlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = [(i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in brute_repeats([tuple(r) for r in docs.select("doc_id", "text").collect()])]
    got = sorted(map(tuple, queries.QUERIES["op11_substring_dedup"](spark, SF).collect()), key=str)
    assert got == sorted(expected, key=str)


# ---- hard negatives


def brute_negatives(rows, every, k=5, least=80, most=100):
    """rows (id, label, integer vector)."""
    out = []
    for i, label, x in rows:
        if i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), j, other) for j, other, y in rows if j != i and len(y) == len(x)))
        for p, j, _ in [s for s in scored if s[2] == label][:k]:
            inside = [s for s in scored if s[2] != label and least * -p <= 100 * -s[0] <= most * -p][:k]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n, _) in enumerate(inside, 1)]
    return sorted(out)


def mined(df, **more):
    return sorted(map(tuple, hard_negatives.hard_negatives(df, **more).collect()))


@pytest.mark.parametrize("dim,labels,spread", [(3, 2, 0.1), (24, 4, 0.02), (8, 60, 0.3)])
def test_hard_negatives_equal_brute_force(spark, dim, labels, spread, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BUCKET_ROWS", 64)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(dim)
    centres = rng.standard_normal((6, dim))
    vectors = centres[rng.integers(0, 6, 900)] * rng.uniform(0.2, 2, (900, 1)) + spread * rng.standard_normal((900, dim))
    vectors[5], vectors[40:60] = 0, vectors[40]
    names = [f"l{k}" for k in rng.integers(0, labels, 900)]
    df = spark.createDataFrame([(i, names[i], vectors[i].tolist()) for i in range(900)], "vec_id long, label string, embedding array<double>").repartition(4)
    whole = [(i, names[i], [int(c) for c in np.floor(256 * vectors[i])]) for i in range(900)]
    assert mined(df, anchor_every=10) == brute_negatives(whole, 10)
    assert mined(df, anchor_every=30, least_percent=95, most_percent=110) == brute_negatives(whole, 30, 5, 95, 110)


def test_bucket_ranges_lose_no_row_and_prune():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.standard_normal((500, 6))).astype(np.int64)
    lengths = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    lists = np.argsort(hard_negatives.units(x, lengths), axis=0).T.astype(np.uint16)
    bucket = hard_negatives.Bucket(np.arange(500).tobytes(), x.tobytes(), lists.tobytes(), lengths.max(), 6, True)
    left = 0
    for q in range(0, 500, 7):
        scores = x @ x[q]
        for low in (int(np.sort(scores)[-3]), int(scores.max()), int(0.5 * scores.max()), 0, -5):
            rows = bucket.candidates(x[q] / lengths[q], lengths[q], low)
            assert set(np.flatnonzero(scores >= low)) <= set(rows.tolist())
            left += len(rows) if low == int(np.sort(scores)[-3]) else 0
    assert left < 0.5 * 500 * 72


def test_hard_negatives_odd_rows(spark):
    rows = [
        (0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.85, 0.0]), (3, 2, [0.85, 0.0]), (3, 2, [0.85, 0.0]), (100, 1, [0.0, 0.0]), (None, 1, [1.0, 0.0]), (4, None, [1.0, 0.0]), (5, 2, None),
        (6, 2, [None, 1.0]), (8, 2, [float("nan"), 1.0]), (9, 2, [float("inf"), 1.0]), (10, 2, []), (200, 2, []), (300, 3, [1.0]), (11, 3, [1.0]),
    ]
    named = [(*r, 1, "s", 2, 3) for r in rows]
    df = spark.createDataFrame(named, "vec_id long, label int, embedding array<float>, id int, slot string, x int, bounds int")
    whole = [(i, label, [int(np.floor(256 * np.float32(c))) for c in v]) for i, label, v in rows if i is not None and label and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    whole = [r for k, r in enumerate(whole) if r[0] != 3 or k == [x[0] for x in whole].index(3)]
    assert mined(df) == brute_negatives(whole, 100)
    assert hard_negatives.hard_negatives(df.filter("1 = 0")).collect() == []
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, 1, [1e30])], "vec_id long, label int, embedding array<double>"))


# ---- whitening


MATRICES = {
    "plain": lambda g: g.standard_normal((200, 24)),
    "few rows": lambda g: g.standard_normal((7, 24)),
    "rank 5": lambda g: g.standard_normal((200, 5)) @ g.standard_normal((5, 24)),
    "identity": lambda g: np.eye(12),
    "equal values": lambda g: (np.linalg.qr(g.standard_normal((30, 30)))[0] * np.repeat([5.0, 1.0, 1e-3], 10)) @ np.linalg.qr(g.standard_normal((30, 30)))[0],
    "equal columns": lambda g: g.standard_normal((50, 6))[:, [0, 1, 1, 2, 5, 5]] * [1, 1, 1, 0, 1, 1],
    "graded": lambda g: g.standard_normal((90, 20)) * 10.0 ** -np.arange(0, 10, 0.5),
    "one": lambda g: g.standard_normal((9, 1)),
    "zero": lambda g: np.zeros((4, 3)),
}


@pytest.mark.parametrize("name", MATRICES)
def test_qd_solver_equals_svd(name):
    a = MATRICES[name](np.random.default_rng(3))
    r, d = np.linalg.qr(a, mode="r"), a.shape[1]
    values, vectors = qd.right_singular(np.vstack((r, np.zeros((max(0, d - len(r)), d)))), 16)
    expected = np.append(np.linalg.svd(a, compute_uv=False), np.zeros(max(0, d - len(a))))
    assert np.allclose(values, expected, rtol=1e-12, atol=1e-13 * max(expected[0], 1e-300))
    assert len(vectors) == min(16, int((expected > 1e-10 * expected[0]).sum()) if expected[0] else 0)
    assert np.allclose(vectors @ vectors.T, np.eye(len(vectors)), atol=1e-10)
    for value, v in zip(values, vectors, strict=False):
        assert np.linalg.norm(a.T @ (a @ v) - value**2 * v) <= 1e-12 * values[0] ** 2


def test_small_singular_values_keep_their_digits():
    """A graded bidiagonal with known determinant: the product of the values is the product of the diagonal."""
    diagonal, above = 10.0 ** -np.arange(0.0, 12.0), 0.3 * 10.0 ** -np.arange(0.5, 11.0)
    squares = qd.squared_singular_values(diagonal, above)
    assert np.isclose(np.log(squares).sum(), 2 * np.log(diagonal).sum(), rtol=1e-13)


def exact_whitening(x, most=32):
    n = len(x)
    apart = n * x - x.sum(axis=0)
    cov = (apart / n).T @ (apart / n) / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return (apart.astype(object) ** 2).sum(axis=1), (apart / n) @ v / np.sqrt(e), e / np.trace(cov)


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(11)
    c = rng.standard_normal((3000, 40)) @ rng.standard_normal((40, 40)) + 100
    df = spark.createDataFrame([(i, c[i].tolist()) for i in range(3000)], "vec_id long, embedding array<double>").repartition(70)
    x = np.floor(64 * c).astype(np.int64) + 1_000_000
    deviation, whitened, explained = exact_whitening(x)
    rows = whitening.whiten(df).collect()
    assert len(rows) == 3000 * 32 and {r.n for r in rows} == {3000}
    got = np.zeros((3000, 32))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviation[r.vec_id]
        assert np.isclose(r.explained, explained[r.component - 1], rtol=1e-9)
        assert 0 <= r.identity_error < 1e-10
    signs = np.sign((got * whitened).sum(axis=0))
    assert np.allclose(got * signs, whitened, atol=1e-8)


def test_whitening_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.0, 5.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("-inf"), 1.0]), (7, [1.0]), (8, []), (9, [4.0, 4.0])]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<float>, id int, n int, x string")
    out = whitening.whiten(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in out) == sorted((i is None, i or 0, k) for i in (1, 1, None, 9) for k in (1, 2))
    assert {r.n for r in out} == {4}
    same = {(r.component, r.whitened) for r in out if r.vec_id == 1}
    assert len(same) == 2
    for kept in ("1 = 0", "vec_id = 1", "vec_id = 9", "vec_id = 8"):
        assert whitening.whiten(df.filter(kept)).collect() == []
    assert whitening.whiten(df.filter("1 = 0")).columns == whitening.whiten(df).columns
