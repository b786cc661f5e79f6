"""Numbers as few bytes, and orders by block, inside tasks. The code travels with each job."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle


def code_bits(values: np.ndarray) -> int:
    return next(b for b in (1, 2, 4, 8, 16) if len(values) <= 1 << b)


def packed(x: np.ndarray, values: np.ndarray | None) -> bytes:
    """Numbers as bytes: doubles, or whole bytes or 1, 2 or 4 bits of places in ``values``."""
    if values is None:
        return x.tobytes()
    bits = code_bits(values)
    if bits >= 8:
        return x.astype(np.uint8 if bits == 8 else np.uint16).tobytes()
    each = 8 // bits
    cells = np.zeros((-(-len(x) // each), each), np.uint8)
    cells.ravel()[: len(x)] = x
    cells <<= np.arange(0, 8, bits, dtype=np.uint8)
    return np.bitwise_or.reduce(cells, axis=1).tobytes()


def unpacked(data: bytes, n: int, values: np.ndarray | None) -> np.ndarray:
    """The ``n`` numbers of :func:`packed`."""
    if values is None:
        return np.frombuffer(data)
    bits = code_bits(values)
    if bits >= 8:
        return values[np.frombuffer(data, np.uint8 if bits == 8 else np.uint16)]
    cells = np.frombuffer(data, np.uint8)[:, None] >> np.arange(0, 8, bits, dtype=np.uint8)
    return values[(cells & ((1 << bits) - 1)).ravel()[:n]]


def block_order(blocks: np.ndarray, count: int) -> np.ndarray:
    """Stable order by block; few enough blocks are sorted by their digits."""
    return np.argsort(blocks.astype(np.uint16) if count <= 1 << 16 else blocks, kind="stable")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
