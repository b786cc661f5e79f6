"""Singular values and right singular vectors of a small triangular matrix by qd algorithms.

1. Householder reflections from both sides bring the matrix to upper bidiagonal form.
2. dqds: the squares of the bidiagonal's entries go through shifted qd transforms. They
   multiply, divide and add positive numbers only, apart from the shift, so small singular
   values keep their digits. The sum of the inverses of a transform's d values is the trace
   of the inverse, and one over it a shift that never passes the least eigenvalue.
3. Twisted factorisations: for each value the stationary and the progressive transform meet
   at the index with the smallest pivot, and the vector is read off from there. Vectors of
   close values are made orthogonal.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(v, beta, alpha): (I - beta v v') x = alpha e1."""
    largest = np.abs(x).max(initial=0.0)
    if largest == 0.0 or not np.any(x[1:]):
        return np.zeros_like(x), 0.0, float(x[0])
    v = x / largest
    alpha = -np.copysign(np.linalg.norm(v), v[0])
    v[0] -= alpha
    return v, 2.0 / (v @ v), float(alpha * largest)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, float]]]:
    """(diagonal, entries above it, right reflectors) of a square matrix."""
    a, n = r.astype(float).copy(), r.shape[1]
    diagonal, above, right = np.zeros(n), np.zeros(max(n - 1, 0)), []
    for k in range(n):
        v, beta, diagonal[k] = reflector(a[k:, k].copy())
        if beta:
            a[k:, k + 1 :] -= np.outer(beta * v, v @ a[k:, k + 1 :])
        if k < n - 1:
            v, beta, above[k] = reflector(a[k, k + 1 :].copy())
            if beta:
                a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k + 1 :] @ v, beta * v)
            right.append((v, beta))
    return diagonal, above, right


def dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One shifted transform: (q, e, d) of the next matrix."""
    d = q[0] - shift
    new_q, new_e, ds = [], [], [d]
    for i in range(len(e)):
        top = d + e[i]
        new_q.append(top)
        ratio = q[i + 1] / top if top else 0.0
        new_e.append(e[i] * ratio)
        d = d * ratio - shift if top else q[i + 1] - shift
        ds.append(d)
    new_q.append(d)
    return new_q, new_e, ds


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray, rounds: int = 10_000) -> np.ndarray:
    """Eigenvalues of B'B for the bidiagonal B, falling. Raises if a block does not settle."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    blocks = [(((diagonal / scale) ** 2).tolist(), ((above / scale) ** 2).tolist(), 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        shift = 0.0
        for _ in range(rounds):
            # entries above the diagonal that no longer count split the block
            small = [i for i in range(len(e)) if e[i] <= EPS * EPS * (moved + min(q[i], q[i + 1])) or e[i] < 1e-300]
            if small or len(q) == 1:
                break
            new = dqds_step(q, e, shift)
            while shift and not min(new[2]) >= 0.0:  # rounding took the shift too far
                shift = shift / 4 if shift > EPS * (moved + min(q)) else 0.0
                new = dqds_step(q, e, shift)
            q, e, ds = new
            q, moved = [max(x, 0.0) for x in q], moved + shift
            least = min(ds)
            shift = (1 - 4 * EPS) / sum(1 / max(x, 1e-300) for x in ds) if least > 0 else 0.0
            if shift <= EPS * moved:
                shift = 0.0
        else:
            raise RuntimeError("a block of the bidiagonal matrix did not settle")
        if len(q) == 1:
            found.append(q[0] + moved)
            continue
        start = 0
        for i in [*small, len(e)]:
            blocks.append((q[start : i + 1], e[start:i], moved))
            start = i + 1
    return np.sort(np.array(found))[::-1] * scale * scale


def twisted_vector(d: np.ndarray, lower: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of L D L' (L unit lower bidiagonal) for an eigenvalue."""
    n, tiny = len(d), EPS * EPS * max(abs(value), d.max())
    down, up = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    s, p = np.zeros(n), np.zeros(n)
    s[0], p[-1] = -value, d[-1] - value
    for i in range(n - 1):
        pivot = s[i] + d[i]
        pivot = pivot if abs(pivot) > tiny else tiny
        down[i] = d[i] * lower[i] / pivot
        s[i + 1] = down[i] * lower[i] * s[i] - value
    for i in range(n - 2, -1, -1):
        pivot = d[i] * lower[i] * lower[i] + p[i + 1]
        ratio = d[i] / (pivot if abs(pivot) > tiny else tiny)
        up[i] = lower[i] * ratio
        p[i] = p[i + 1] * ratio - value
    twist = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def orthogonal(vector: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for o in others:
            vector = vector - (o @ vector) * o
    return vector


def right_singular(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, unit right singular vectors as rows), falling, at most ``most``.

    Values lost in rounding (dimension * eps times the largest) are left out. All values
    come first, so their squares sum to the squared norm of ``r``.
    """
    diagonal, above, right = bidiagonal(r)
    squares = squared_singular_values(diagonal, above)
    values = np.sqrt(np.maximum(squares, 0.0))
    if not len(values) or values[0] == 0.0:
        return values, np.empty((0, r.shape[1]))
    n, least = len(values), max(np.abs(diagonal).max(), np.abs(above).max(initial=0.0)) * EPS * EPS
    safe = np.where(np.abs(diagonal) > least, diagonal, least)
    # where the form splits, a vector lives in one part
    apart = np.flatnonzero(np.abs(above) <= EPS * np.sqrt(np.abs(safe[:-1] * safe[1:])))
    parts = [(a, b) for a, b in zip([0, *(apart + 1).tolist()], [*(apart + 1).tolist(), n], strict=True)]
    own = sorted(
        ((v, a, b) for a, b in parts for v in squared_singular_values(safe[a:b], above[a : b - 1])),
        key=lambda x: -x[0],
    )
    rng, vectors = np.random.default_rng(0), []
    for k, (square, a, b) in enumerate(own[:most]):
        if np.sqrt(square) <= n * EPS * values[0]:
            break
        d, lower = safe[a:b] ** 2, above[a : b - 1] / safe[a : b - 1]
        middle, side = d + np.append(0.0, lower**2 * d[:-1]), lower * d[:-1]
        z = np.zeros(n)
        z[a:b] = twisted_vector(d, lower, square)
        close = [vectors[j] for j in range(k) if own[j][0] - square <= 1e-3 * own[j][0]]
        z = orthogonal(z, close)
        for _ in range(8):
            size = np.linalg.norm(z)
            if size > 0.1:
                z /= size
                rest = (middle - square) * z[a:b]
                rest[:-1] += side * z[a + 1 : b]
                rest[1:] += side * z[a : b - 1]
                if np.linalg.norm(rest) <= 100 * n * EPS * values[0] ** 2:
                    break
            # the same vector again: a further one of the space by inverse iteration from a random start
            z = np.zeros(n)
            z[a:b] = rng.standard_normal(b - a)
            t = np.diag(middle - square + 8 * EPS * values[0] ** 2) + np.diag(side, 1) + np.diag(side, -1)
            for _ in range(3):
                z = orthogonal(z, close)
                z[a:b] = np.linalg.solve(t, z[a:b] / np.linalg.norm(z))
            z = orthogonal(z / np.linalg.norm(z), close)
        else:
            raise RuntimeError("a singular vector did not settle")
        vectors.append(z)
    out = np.array(vectors).reshape(-1, n).T
    for k in range(len(right) - 1, -1, -1):
        v, beta = right[k]
        if beta:
            out[k + 1 :] -= np.outer(beta * v, v @ out[k + 1 :])
    return values, out.T
