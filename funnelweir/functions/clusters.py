"""Influences summed per cluster over sorted rows, inside the tasks.

The code travels with each job.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# name of the intercept in a design
CONST = "const"


class Influence(NamedTuple):
    """What a task needs of a fit: ``weights`` has a row per reported combination over the design."""

    y: str
    design: tuple[str, ...]
    beta: np.ndarray
    weights: np.ndarray
    weight: str | None = None
    by: str | None = None
    level: str | None = None


def scores_of(columns: Mapping[str, np.ndarray], levels: Mapping[str, np.ndarray], fits: Sequence[Influence]) -> np.ndarray:
    """Per fit a sample flag and the row's contribution to every reported combination, side by side."""
    out = []
    for fit in fits:
        n = len(columns[fit.y])
        z = np.column_stack([np.ones(n) if c == CONST else columns[c] for c in fit.design])
        ok = np.isfinite(columns[fit.y]) & np.isfinite(z).all(axis=1)
        if fit.by:
            ok &= levels[fit.by] == fit.level
        z, y = np.where(ok[:, None], z, 0.0), np.where(ok, columns[fit.y], 0.0)
        residual = y - z @ fit.beta
        if fit.weight:
            residual = residual * np.nan_to_num(columns[fit.weight], nan=0.0, posinf=0.0, neginf=0.0)
        out += [ok[:, None].astype(float), (residual * ok)[:, None] * (z @ fit.weights.T)]
    return np.concatenate(out, axis=1)


def sorted_cluster_sums(groupings: Mapping[str, Sequence[str]], numbers: Sequence[str], fits: Sequence[Influence]):
    """Task code: rows sorted by cluster -> outer products of the clusters' summed influences.

    The first and the last cluster of a partition may go on in the next one, so their sums leave as they are.
    """
    keys = list(dict.fromkeys(k for by in groupings.values() for k in by))
    edges = np.cumsum([0, *[len(f.weights) + 1 for f in fits]])
    levels = list(dict.fromkeys(f.by for f in fits if f.by))

    def run(batches):
        totals = {g: [np.zeros((b - a, b - a)) for a, b in zip(edges[:-1], edges[1:])] for g in groupings}
        open_: dict[str, tuple] = {}
        ends: list[tuple] = []
        first = dict.fromkeys(groupings, True)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in numbers}
            scores = scores_of(columns, {c: np.asarray(batch.column(f"_by_{c}").to_pylist(), object) for c in levels}, fits)
            codes = {k: np.asarray(batch.column(k).dictionary_encode(null_encoding="encode").indices) for k in keys}
            for g, by in groupings.items():
                new = np.zeros(batch.num_rows, bool)
                for k in by:
                    new[1:] |= codes[k][1:] != codes[k][:-1]
                at = np.flatnonzero(new)
                key = lambda i: tuple(batch.column(k)[i].as_py() for k in by)  # noqa: B023, E731
                sums = np.add.reduceat(scores, np.append(0, at), axis=0)
                if g in open_ and open_[g][0] == key(0):
                    sums[0] += open_[g][1]
                elif g in open_:
                    sums = np.concatenate([open_[g][1][None], sums])
                closed = sums[:-1]
                if first[g] and len(closed):
                    ends.append((g, open_[g][0] if g in open_ else key(0), closed[0]))
                    closed, first[g] = closed[1:], False
                for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    totals[g][i] += outer_sums(closed[:, a:b])
                open_[g] = (key(batch.num_rows - 1), sums[-1])
        ends += [(g, *rest) for g, rest in open_.items()]
        padded = [(*key, *[None] * (len(keys) - len(key))) for _, key, _ in ends]
        rows = [(g, True, *key, 0, v.tolist()) for (g, _, v), key in zip(ends, padded)]
        rows += [(g, False, *[None] * len(keys), i, m.ravel().tolist()) for g, found in totals.items() for i, m in enumerate(found)]
        columns = list(zip(*rows))
        kinds = [pa.string(), pa.bool_(), *[pa.string()] * len(keys), pa.int32(), pa.list_(pa.float64())]
        names = ["label", "edge", *[f"key{i}" for i in range(len(keys))], "fit", "cells"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return run


def outer_sums(sums: np.ndarray) -> np.ndarray:
    """Sum of outer products of cluster rows (flag, combinations...); the flag counts clusters with sample rows."""
    marked = np.column_stack([sums[:, 0] > 0, sums[:, 1:]])
    return marked.T @ marked


cloudpickle.register_pickle_by_value(sys.modules[__name__])
