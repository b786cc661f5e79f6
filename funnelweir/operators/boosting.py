"""Leaf-wise histogram boosting, many models in the same passes.

Rows are binned once into blocks of small integers, which stay cached in the executors
together with every model's scores. A tree takes one pass per level: tasks add up
gradients per (leaf, feature, bin), the sums of the blocks meet in a tree of partial
sums, and the driver, which sees histograms only, picks the splits. Only the smaller
child of a split is counted; its sibling is the difference. All leaves of a level are
split on trial, then the tree keeps the splits that best-first growth up to the allowed
number of leaves would have made, as a leaf's gain depends on its own rows alone.

Several models (targets, row groups, feature sets) share the blocks and every pass, so the
number of Spark jobs is trees * levels whatever their number.

RDDs are used here alone: a pass is imperative work on cached arrays, and thousands of
short jobs would each pay for query planning.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelweir.functions.scalars import safe_double
from funnelweir.session import cut

#: Rows of one cached block.
BLOCK_ROWS = 1 << 16
#: Rows times models of one task at least.
TASK_CELLS = 1 << 18
#: Trees between two checkpoints of the scores.
KEEP_EVERY = 50


@dataclass(frozen=True)
class Settings:
    trees: int = 250
    rate: float = 0.04
    depth: int = 6
    leaves: int = 31
    row_share: float = 0.85
    column_share: float = 0.85
    bins: int = 255
    min_rows: int = 20
    min_hessian: float = 1e-3


@dataclass(frozen=True)
class Task:
    """One model: a target column on the rows of a group (a boolean column; all rows if None)."""

    target: str
    features: tuple[str, ...]
    classify: bool = False
    group: str | None = None


@dataclass
class Tree:
    """Nodes in order of creation; a leaf has feature -1. Rows with bin <= cut go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def reached(self, bins: np.ndarray, levels: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, its rows as flags) where rows stop after at most ``levels`` steps; ``bins`` holds one feature a line.

        A split compares one line of bytes with its cut, so no row is looked up on its own. A right child follows its left one.
        """
        level = [(0, np.ones(bins.shape[1], bool))]
        for _ in range(levels):
            below = []
            for node, here in level:
                if self.feature[node] < 0:
                    yield node, here
                    continue
                right = bins[self.feature[node]] > self.cut[node]
                left = self.left[node]
                below += [(left, here > right), (left + 1, here & right)]
            level = below
        yield from level

    def walk(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row after at most ``levels`` steps."""
        out = np.zeros(bins.shape[1], np.min_scalar_type(len(self.feature)))
        for node, here in self.reached(bins, levels):
            out += here * out.dtype.type(node)
        return out


@dataclass
class Model:
    task: Task
    columns: list[int]  # of the features among the store's
    edges: list[np.ndarray]  # of the store's features
    start: float
    settings: Settings
    trees: list[Tree] = field(default_factory=list)

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(bins.shape[1], self.start)
        for tree in self.trees:
            out += np.array(tree.value)[tree.walk(bins, self.settings.depth)]
        return out

    def predict(self, bins: np.ndarray) -> np.ndarray:
        out = self.scores(bins)
        return 1 / (1 + np.exp(-out)) if self.task.classify else out


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """At most ``bins`` - 1 upper edges per feature, from one scan; equal values share a bin."""
    shares = [k / bins for k in range(1, bins)]
    found = df.agg(*[F.percentile_approx(safe_double(c, 0.0), shares, max(10_000, 20 * bins)).alias(f"c{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.array(found[f"c{i}"] or [], float)) for i in range(len(features))]


def binned(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "left").astype(np.uint8) for c, e in zip(columns, edges, strict=True)], axis=1)


def store(df: DataFrame, features: Sequence[str], targets: Sequence[str], groups: Sequence[str], edges: list[np.ndarray]) -> DataFrame:
    """One row per block: rows long, seed long, bins, y and groups binary. Missing features read 0, missing targets are NaN."""
    width = [len(features), len(targets), len(groups)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches):
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                columns = [part.column(i).to_numpy(zero_copy_only=False) for i in range(sum(width))]
                bins = binned(columns[: width[0]], edges)
                y = np.array(columns[width[0] : width[0] + width[1]], float).T.reshape(part.num_rows, -1)
                member = np.array(columns[width[0] + width[1] :], bool).T.reshape(part.num_rows, -1)
                values = [part.num_rows, (k << 20) + at, bins.tobytes(), y.tobytes(), member.tobytes()]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["rows", "seed", "bins", "y", "member"])

    chosen = df.select(
        *[safe_double(c, 0.0).alias(f"x{i}") for i, c in enumerate(features)],
        *[F.coalesce(safe_double(c), F.lit(float("nan"))).alias(f"y{i}") for i, c in enumerate(targets)],
        *[F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(f"m{i}") for i, c in enumerate(groups)],
    )
    blocks = chosen.mapInArrow(run, "rows long, seed long, bins binary, y binary, member binary")
    return blocks.withColumn("seed", F.col("seed") + F.spark_partition_id().cast("long") * (1 << 40))


@dataclass
class Block:
    """Cached arrays of some rows, which every pass reads: what models share is held once, and nothing for a model without rows here."""

    seeds: list[tuple[int, int]]  # of the draws and their numbers of rows, one after another
    bins: np.ndarray  # a line per feature
    y: list[np.ndarray]  # per target; bytes where they hold its values
    used: list[np.ndarray]  # per target and group
    scores: list[np.ndarray | None]  # per model
    of: list[tuple[int, int]]  # each model's places in ``y`` and ``used``
    drawn: list[np.ndarray | None] = field(default_factory=list)  # per model: bits of the rows that the present tree sees


def compact(y: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        small = y.astype(np.uint8)
    return small if (small == y).all() else y


def opened(row, tasks: Sequence[Task], features: Sequence[str], targets: Sequence[str], groups: Sequence[str], starts: Sequence[float]) -> Block:
    n = row["rows"]
    bins = np.ascontiguousarray(np.frombuffer(row["bins"], np.uint8).reshape(n, len(features)).T)
    y = np.ascontiguousarray(np.frombuffer(row["y"], float).reshape(n, len(targets)).T)
    member = np.ascontiguousarray(np.frombuffer(row["member"], bool).reshape(n, len(groups)).T)
    known = ~np.isnan(y)
    y = np.where(known, np.clip(y, -np.finfo(float).max, np.finfo(float).max), 0.0)
    pairs = list(dict.fromkeys((t.target, t.group) for t in tasks))
    used = [known[targets.index(t)] if g is None else known[targets.index(t)] & member[groups.index(g)] for t, g in pairs]
    of = [(targets.index(t.target), pairs.index((t.target, t.group))) for t in tasks]
    scores = [np.full(n, float(start)) if used[own].any() else None for (_, own), start in zip(of, starts, strict=True)]
    return Block([(row["seed"], n)], bins, [compact(v) for v in y], used, scores, of)


def joined(blocks: Iterable[Block], size: int = BLOCK_ROWS) -> Iterator[Block]:
    """Neighbouring blocks as one of up to ``size`` rows, as Arrow's batches are small and a block's sums cost the same whatever its rows.

    Blocks join only if the same models have rows in them.
    """
    held: list[Block] = []

    def whole() -> Block:
        first = held[0]
        if len(held) == 1:
            return first
        return replace(
            first,
            seeds=[part for b in held for part in b.seeds],
            bins=np.concatenate([b.bins for b in held], axis=1),
            y=[np.concatenate(parts) for parts in zip(*(b.y for b in held), strict=True)],
            used=[np.concatenate(parts) for parts in zip(*(b.used for b in held), strict=True)],
            scores=[None if parts[0] is None else np.concatenate(parts) for parts in zip(*(b.scores for b in held), strict=True)],
        )

    count, live = 0, None
    for block in blocks:
        rows, now = block.bins.shape[1], [v is not None for v in block.scores]
        if held and (count + rows > size or now != live):
            yield whole()
            held, count = [], 0
        held.append(block)
        count, live = count + rows, now
    if held:
        yield whole()


def redrawn(block: Block, tree_no: int, share: float, seed: int) -> Block:
    """The block with each model's draw of rows for a tree."""
    drawn: list[np.ndarray | None] = []
    for j, (_, own) in enumerate(block.of):
        if block.scores[j] is None:
            drawn.append(None)
            continue
        draws = [np.random.default_rng([seed, tree_no, j, s & 0xFFFFFFFF, s >> 32]).random(rows) < share for s, rows in block.seeds]
        drawn.append(np.packbits(block.used[own] & np.concatenate(draws)))
    return replace(block, drawn=drawn)


def advanced(block: Block, trees: Mapping[int, Tree], depth: int) -> Block:
    scores = list(block.scores)
    for j, tree in trees.items():
        if scores[j] is not None:
            scores[j] = scores[j] + np.array(tree.value)[tree.walk(block.bins, depth)]
    return replace(block, scores=scores)


@dataclass
class Growing:
    """A tree on trial: histograms of the leaves of the level, and each node's split."""

    columns: np.ndarray  # the features drawn for this tree
    first: int  # bins of the first of them, which hold every row once
    tree: Tree = field(default_factory=Tree)
    sums: dict[int, np.ndarray] = field(default_factory=dict)  # node -> (statistics, bins of all drawn features)
    splits: dict[int, tuple] = field(default_factory=dict)  # node -> (gain, feature, cut, left value, right value)
    counted: list[int] = field(default_factory=list)  # nodes that the next pass counts
    siblings: list[tuple[int, int, int]] = field(default_factory=list)  # (node, parent, counted sibling)


def counts(block: Block, asked: dict[int, tuple], classify: Sequence[bool], sizes: np.ndarray, level: int, out: dict[int, np.ndarray]) -> None:
    """Adds the block's rows to {model: (statistics, nodes, bins)}; statistics are gradient, rows and, for classes, hessian."""
    length = block.bins.shape[1]
    for j, (tree, columns, nodes) in asked.items():
        if block.scores[j] is None:
            continue
        draw = np.unpackbits(block.drawn[j], count=length).view(bool)
        place = {node: k + 1 for k, node in enumerate(nodes.tolist())}
        slots = np.zeros(length, np.min_scalar_type(len(nodes)))
        for node, here in tree.reached(block.bins, level):
            if node in place:
                slots += here * slots.dtype.type(place[node])
        rows = np.flatnonzero(draw & (slots > 0))
        slots = slots[rows] - slots.dtype.type(1)
        score, y = block.scores[j][rows], block.y[block.of[j][0]][rows]
        if classify[j]:
            p = 1 / (1 + np.exp(-score))
            statistics = [p - y, None, p * (1 - p)]
        else:
            statistics = [score - y, None]
        offsets = np.concatenate(([0], np.cumsum(sizes[columns])))
        if j not in out:
            out[j] = np.zeros((len(statistics), len(nodes), offsets[-1]))
        # places in the narrowest type that holds them: sums of two types would be made in a buffer, row by row
        kinds = {size: np.min_scalar_type(len(nodes) * size) for size in set(sizes[columns].tolist())}
        first = {size: slots.astype(kind) * kind.type(size) for size, kind in kinds.items()}
        for k, f in enumerate(columns.tolist()):
            size = int(sizes[f])
            at = first[size] + block.bins[f, rows].astype(kinds[size])
            for s, weight in enumerate(statistics):
                out[j][s, :, offsets[k] : offsets[k + 1]] += np.bincount(at, weight, len(nodes) * size).reshape(len(nodes), -1)


def added(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Sums of both; a model without rows on one side is in the other alone."""
    return {j: a[j] + b[j] if j in a and j in b else a[j] if j in a else b[j] for j in a | b}


def best_splits(sums: np.ndarray, columns: np.ndarray, sizes: np.ndarray, settings: Settings) -> list[tuple | None]:
    """(gain, feature, cut, left value, right value) of each node of (statistics, nodes, bins); ties go to the first feature and cut."""
    nodes, rows, at = sums.shape[1], np.arange(sums.shape[1]), 0
    gain, feature, cuts = np.full(nodes, 1e-12), np.full(nodes, -1), np.zeros(nodes, np.int64)
    left, right = np.zeros(nodes), np.zeros(nodes)
    for f in columns.tolist():
        part = sums[:, :, at : at + sizes[f]]
        at += sizes[f]
        whole, running = part.sum(axis=2), np.cumsum(part, axis=2)[:, :, :-1]
        if not running.shape[2]:
            continue
        g, n, h = running[0], running[1], running[-1]
        rest_g, rest_n, rest_h = (whole[k][:, None] - running[k] for k in (0, 1, -1))
        allowed = (n >= settings.min_rows) & (rest_n >= settings.min_rows) & (h >= settings.min_hessian) & (rest_h >= settings.min_hessian)
        with np.errstate(divide="ignore", invalid="ignore"):
            gains = np.where(allowed, g * g / h + rest_g * rest_g / rest_h - (whole[0] ** 2 / whole[-1])[:, None], -np.inf)
        k = np.argmax(gains, axis=1)
        better = gains[rows, k] > gain
        if better.any():
            i, c = rows[better], k[better]
            gain[i], feature[i], cuts[i] = gains[i, c], f, c
            left[i], right[i] = -g[i, c] / h[i, c] * settings.rate, -rest_g[i, c] / rest_h[i, c] * settings.rate
    return [(float(gain[i]), int(feature[i]), int(cuts[i]), float(left[i]), float(right[i])) if feature[i] >= 0 else None for i in rows]


def pruned(trial: Growing, settings: Settings) -> Tree:
    """The tree that best-first growth makes of the splits on trial."""
    out, heap = Tree(), []
    first = trial.sums[0][:, : trial.first].sum(axis=1)
    out.value[0] = float(-first[0] / first[-1] * settings.rate) if first[-1] >= settings.min_hessian else 0.0

    def offer(node: int, own: int) -> None:
        if node in trial.splits:
            heapq.heappush(heap, (-trial.splits[node][0], own, node))

    offer(0, 0)
    leaves = 1
    while heap and leaves < settings.leaves:
        _, own, node = heapq.heappop(heap)
        _, feature, cut_at, left_value, right_value = trial.splits[node]
        out.feature[own], out.cut[own], out.left[own] = feature, cut_at, len(out.feature)
        for child, value in ((0, left_value), (1, right_value)):
            out.feature.append(-1)
            out.cut.append(0)
            out.left.append(0)
            out.value.append(value)
            if trial.tree.feature[node] >= 0:  # splits of the last level have no children on trial
                offer(trial.tree.left[node] + child, len(out.feature) - 1)
        leaves += 1
    return out


def grown(blocks: RDD, models: list[Model], sizes: np.ndarray, tree_no: int, seed: int) -> dict[int, Tree]:
    """One tree for each model that still finds a split."""
    settings = models[0].settings
    classify = [m.task.classify for m in models]
    trials: dict[int, Growing] = {}
    for j, m in enumerate(models):
        drawn = max(1, round(settings.column_share * len(m.columns)))
        columns = np.sort(np.random.default_rng([seed, tree_no, j]).choice(m.columns, drawn, replace=False))
        trials[j] = Growing(columns, int(sizes[columns[0]]), counted=[0])
    for level in range(settings.depth):
        asked = {j: (t.tree, t.columns, np.array(t.counted)) for j, t in trials.items() if t.counted}
        if not asked:
            break

        def of_part(part: Iterator[Block], asked=asked, level=level) -> Iterator[dict]:
            total: dict[int, np.ndarray] = {}
            for block in part:
                counts(block, asked, classify, sizes, level, total)
            yield total

        partial = blocks.mapPartitions(of_part)
        few = blocks.getNumPartitions() <= 64
        found = partial.reduce(added) if few else partial.treeReduce(added, 3)
        for j, t in trials.items():
            if not t.counted:
                continue
            fresh = {node: found[j][:, k] for k, node in enumerate(t.counted)} if j in found else {}
            for node, parent, counted in t.siblings:
                fresh[node] = t.sums[parent] - fresh[counted]
            t.sums = {0: t.sums.get(0, fresh.get(0)), **fresh}
            t.counted, t.siblings = [], []
            if not fresh:
                continue
            order = sorted(fresh)
            for node, split in zip(order, best_splits(np.stack([fresh[k] for k in order], axis=1), t.columns, sizes, settings), strict=True):
                sums = fresh[node]
                if split is None:
                    continue
                t.splits[node] = split
                if level == settings.depth - 1:
                    continue
                left = len(t.tree.feature)
                t.tree.feature[node], t.tree.cut[node], t.tree.left[node] = split[1], split[2], left
                for _ in range(2):
                    t.tree.feature.append(-1)
                    t.tree.cut.append(0)
                    t.tree.left.append(0)
                    t.tree.value.append(0.0)
                below = feature_rows(sums, t.columns, sizes, split[1])
                small = left if below[: split[2] + 1].sum() <= below[split[2] + 1 :].sum() else left + 1
                t.counted.append(small)
                t.siblings.append((2 * left + 1 - small, node, small))
    return {j: pruned(t, settings) for j, t in trials.items() if t.splits}


def feature_rows(sums: np.ndarray, columns: np.ndarray, sizes: np.ndarray, feature: int) -> np.ndarray:
    at = int(sum(sizes[f] for f in columns.tolist() if f < feature))
    return sums[1, at : at + sizes[feature]]


def fit(df: DataFrame, tasks: Sequence[Task], settings: Settings | None = None, seed: int = 20260717) -> list[Model | None]:
    """A model per task, trained together; None where a target has no observed row.

    A target with one value gives a constant model. Every row of ``df`` is binned once; the
    edges come from all rows, so groups share them.
    """
    settings = settings or Settings()
    if not 2 <= settings.bins <= 256:
        raise ValueError("bins must lie between 2 and 256")
    features = list(dict.fromkeys(c for t in tasks for c in t.features))
    targets = list(dict.fromkeys(t.target for t in tasks))
    groups = list(dict.fromkeys(t.group for t in tasks if t.group is not None))
    edges = bin_edges(df, features, settings.bins)
    sizes = np.array([len(e) + 1 for e in edges])
    measured = []
    for j, t in enumerate(tasks):
        y = safe_double(t.target) if t.group is None else F.when(F.col(t.group).cast("boolean"), safe_double(t.target))
        measured += [F.avg(y).alias(f"a{j}"), F.min(y).alias(f"l{j}"), F.max(y).alias(f"h{j}")]
    row = df.agg(F.count("*").alias("rows"), *measured).first()
    models: list[Model | None] = []
    for j, t in enumerate(tasks):
        mean, low, high = row[f"a{j}"], row[f"l{j}"], row[f"h{j}"]
        start = None if mean is None else float(low) if low == high else mean
        if start is not None and t.classify:
            p = min(max(start, 1e-15), 1 - 1e-15)
            start = math.log(p / (1 - p))
        models.append(None if start is None else Model(t, [features.index(c) for c in t.features], edges, start, settings))
    live = [j for j in range(len(tasks)) if models[j] is not None and row[f"l{j}"] != row[f"h{j}"]]
    if not live:
        return models
    blocks = cut(store(df, features, targets, groups, edges))
    own, starts = [tasks[j] for j in live], [models[j].start for j in live]
    # a pass over fewer cells than this costs less than the tasks it would be dealt to
    parts = max(1, min(blocks.rdd.getNumPartitions(), math.ceil(row["rows"] * len(own) / TASK_CELLS)))
    share = settings.row_share
    whole = blocks.rdd.coalesce(parts).mapPartitions(lambda part: joined(opened(r, own, features, targets, groups, starts) for r in part))
    state = whole.map(lambda b: redrawn(b, 0, share, seed)).persist(StorageLevel.MEMORY_AND_DISK)
    fitted, before = [models[j] for j in live], None
    for k in range(settings.trees):
        trees = grown(state, fitted, sizes, k, seed)  # its first pass also brings the scores up to date
        if before is not None:
            before.unpersist()
        if not trees:
            break
        for j, tree in trees.items():
            fitted[j].trees.append(tree)
        before, state = state, state.map(lambda b, trees=trees, k=k: redrawn(advanced(b, trees, settings.depth), k + 1, share, seed)).persist(StorageLevel.MEMORY_AND_DISK)
        if k % KEEP_EVERY == KEEP_EVERY - 1:
            state.checkpoint()
    state.unpersist()
    return models


def predict(df: DataFrame, models: Mapping[str, Model | None]) -> DataFrame:
    """``df`` with one double column per model; null for a missing model."""
    given = {name: m for name, m in models.items() if m is not None}
    out = df.withColumns({name: F.lit(None).cast("double") for name, m in models.items() if m is None})
    if not given:
        return out
    first = next(iter(given.values()))
    if any(m.edges is not first.edges for m in given.values()):
        raise ValueError("models of one fit are applied together")
    features: dict[int, str] = {i: c for m in given.values() for i, c in zip(m.columns, m.task.features, strict=True)}
    used = sorted(features)
    with_x = out.withColumns({f"_x_{i}": safe_double(features[i], 0.0) for i in used})
    width = len(first.edges)
    names = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.zeros((width, batch.num_rows), np.uint8)
            for at, i in enumerate(used):
                bins[i] = np.searchsorted(first.edges[i], batch.column(len(names) + at).to_numpy(zero_copy_only=False), "left")
            made = [pa.array(m.predict(bins)) for m in given.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], names=[*names, *given])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    return with_x.mapInArrow(run, f"{fields}, {', '.join(f'`{n}` double' for n in given)}").select(*df.columns, *models)
