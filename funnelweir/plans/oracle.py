"""SQL text for least squares, used only on the comparison side."""

from __future__ import annotations

from collections.abc import Sequence

from funnelweir.functions.bijection import FACTORS, LEAST_HALF, ROUNDS, SHIFTS


def inverse_ctes(p: str, d: int) -> list[str]:
    """Gauss-Jordan steps on ``{p}_m0`` (i, j, v), the matrix with an identity to its right; result ``{p}_inv``."""
    out = []
    for k in range(d):
        out.append(
            f"""{p}_m{k + 1} AS MATERIALIZED (SELECT r.i, r.j, CASE WHEN r.i = {k} THEN r.v / piv.v ELSE r.v - c.v * pr.v / piv.v END AS v
            FROM {p}_m{k} r JOIN {p}_m{k} pr ON pr.i = {k} AND pr.j = r.j JOIN {p}_m{k} c ON c.j = {k} AND c.i = r.i
            JOIN {p}_m{k} piv ON piv.i = {k} AND piv.j = {k})"""
        )
    out.append(f"{p}_inv AS MATERIALIZED (SELECT i, j - {d} AS j, v FROM {p}_m{d} WHERE j >= {d})")
    return out


def _long(names: Sequence[tuple[int, int, str]], source: str) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {c} AS v FROM {source}" for i, j, c in names)


def ols_ctes(
    p: str,
    source: str,
    y: str,
    xs: Sequence[str],
    where: str = "TRUE",
    weight: str = "1",
    clusters: bool = True,
    hc1: bool = False,
) -> list[str]:
    """CTEs ending in ``{p}_b`` (i, v), ``{p}_inv``, ``{p}_n`` and, with errors, ``{p}_v`` (i, j, v).

    Index 0 is the constant.
    """
    d = len(xs) + 1
    z = ["1.0", *[f"x{i}" for i in range(1, d)]]
    complete = " AND ".join(f"({c}) IS NOT NULL" for c in [y, *xs])
    columns = ", ".join(f"({c})::DOUBLE AS x{i}" for i, c in enumerate(xs, 1))
    keys = "user_id, item_id, " if clusters else ""
    ctes = [
        f"{p}_d AS MATERIALIZED (SELECT {keys}({y})::DOUBLE AS y, ({weight})::DOUBLE AS w, {columns} FROM {source} WHERE {complete} AND ({where}))",
        f"{p}_g AS MATERIALIZED (SELECT COUNT(*)::DOUBLE AS n, SUM(w * y * y) AS yy, "
        + ", ".join(f"SUM(w * {z[i]} * {z[j]}) AS g{i}_{j}" for i in range(d) for j in range(i, d))
        + ", "
        + ", ".join(f"SUM(w * {z[i]} * y) AS b{i}" for i in range(d))
        + f" FROM {p}_d)",
        f"{p}_n AS (SELECT n FROM {p}_g)",
    ]
    cells = [(i, j, f"g{min(i, j)}_{max(i, j)}") for i in range(d) for j in range(d)]
    cells += [(i, d + j, "1.0" if i == j else "0.0") for i in range(d) for j in range(d)]
    ctes.append(f"{p}_m0 AS MATERIALIZED ({_long(cells, f'{p}_g')})")
    ctes += inverse_ctes(p, d)
    rhs = " UNION ALL ".join(f"SELECT {i} AS j, b{i} AS v FROM {p}_g" for i in range(d))
    ctes.append(f"{p}_r AS ({rhs})")
    ctes.append(f"{p}_b AS MATERIALIZED (SELECT i, SUM(a.v * r.v) AS v FROM {p}_inv a JOIN {p}_r r USING (j) GROUP BY i)")
    ctes.append(
        f"{p}_w AS MATERIALIZED (SELECT " + ", ".join(f"MAX(v) FILTER (WHERE i = {i}) AS c{i}" for i in range(d)) + f" FROM {p}_b)"
    )
    fitted = " + ".join(["c0", *[f"c{i} * x{i}" for i in range(1, d)]])
    ctes.append(f"{p}_e AS MATERIALIZED (SELECT d.*, y - ({fitted}) AS e FROM {p}_d d, {p}_w)")
    if not (clusters or hc1):
        return ctes
    scores = ", ".join(f"SUM(w * e * {z[i]}) AS s{i}" for i in range(d))
    pairs = [(i, j) for i in range(d) for j in range(d)]
    products = ", ".join(f"SUM(s{i} * s{j}) AS q{i}_{j}" for i, j in pairs)
    meats = []
    if hc1:
        single = ", ".join(f"w * e * {z[i]} AS s{i}" for i in range(d))
        ctes.append(f"{p}_q AS MATERIALIZED (SELECT {products} FROM (SELECT {single} FROM {p}_e))")
        meats.append(_long([(i, j, f"q{i}_{j} * (SELECT n / GREATEST(1, n - {d}) FROM {p}_g)") for i, j in pairs], f"{p}_q"))
    else:
        for label, keys_by, sign in (("u", "user_id", ""), ("i", "item_id", ""), ("p", "user_id, item_id", "-")):
            ctes.append(
                f"{p}_{label}q AS MATERIALIZED (SELECT COUNT(*)::DOUBLE AS gr, {products} FROM (SELECT {scores} FROM {p}_e GROUP BY {keys_by}))"
            )
            factor = f"{sign}1.0 * gr / (gr - 1) * (SELECT (n - 1) / (n - {d}) FROM {p}_g)"
            meats.append(_long([(i, j, f"q{i}_{j} * {factor}") for i, j in pairs], f"{p}_{label}q"))
    ctes.append(f"{p}_meat AS MATERIALIZED (SELECT i, j, SUM(v) AS v FROM ({' UNION ALL '.join(meats)}) GROUP BY i, j)")
    ctes.append(
        f"""{p}_v AS MATERIALIZED (SELECT a.i, b.j, SUM(a.v * m.v * b.v) AS v FROM {p}_inv a JOIN {p}_meat m ON a.j = m.i
        JOIN {p}_inv b ON b.i = m.j GROUP BY a.i, b.j)"""
    )
    return ctes


def effect_rows(p: str, treatments: Sequence[str], extra: str = "") -> str:
    """coefficient, std_error, z, n per treatment of one regression."""
    return " UNION ALL ".join(
        f"SELECT {extra}'{t}' AS treatment, b.v AS coefficient, sqrt(v.v) AS std_error, b.v / sqrt(v.v) AS z, n.n::BIGINT AS n "
        f"FROM {p}_b b, {p}_v v, {p}_n n WHERE b.i = {i} AND v.i = {i} AND v.j = {i}"
        for i, t in enumerate(treatments, 1)
    )


def joined(*groups: Sequence[str]) -> str:
    return ", ".join(c for g in groups for c in g)


def spread(source: str, x: str, key: str, out: str) -> str:
    """One more column, ``out``: the keyed mix of two expressions."""
    (one, two, three), (s1, s2, s3), mask = FACTORS, SHIFTS, (1 << 32) - 1
    a = f"SELECT *, (({x}) * {one}::BIGINT + ({key})) & {mask}::BIGINT AS _t FROM ({source})"
    b = f"SELECT * EXCLUDE (_t), (xor(_t, _t >> {s1}) * {two}::BIGINT) & {mask}::BIGINT AS _t FROM ({a})"
    c = f"SELECT * EXCLUDE (_t), (xor(_t, _t >> {s2}) * {three}::BIGINT) & {mask}::BIGINT AS _t FROM ({b})"
    return f"SELECT * EXCLUDE (_t), xor(_t, _t >> {s3}) AS {out} FROM ({c})"


def bootstrap_ctes(p: str, source: str, cluster: str, reps: int, seed: int, buckets: int = 64) -> list[str]:
    """CTEs ending in ``{p}``: ``source`` joined with (rep, times), how often a replicate draws each cluster."""
    dealt = f"('0x' || substr(md5('bucket|' || {cluster}), 1, 12))::BIGINT % {buckets}"
    out = [
        f"{p}_c AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY bucket ORDER BY {cluster}) - 1 AS idx, COUNT(*) OVER (PARTITION BY bucket) AS size FROM (SELECT *, {dealt} AS bucket FROM {source}))",
    ]
    levels = buckets.bit_length() - 1
    sizes = " UNION ALL ".join(f"SELECT ({buckets} + bucket) >> {levels - k} AS node, COUNT(*) AS size FROM {p}_c GROUP BY 1" for k in range(levels + 1))
    out.append(f"{p}_t AS MATERIALIZED ({sizes})")
    out.append(f"{p}_0 AS MATERIALIZED (SELECT rep::BIGINT AS rep, 1::BIGINT AS node, size AS n FROM range({reps}) r(rep), {p}_t WHERE node = 1)")
    for k in range(levels):
        share = f"SELECT d.rep, d.node, d.n, COALESCE(l.size, 0) / t.size AS p FROM {p}_{k} d JOIN {p}_t t USING (node) LEFT JOIN {p}_t l ON l.node = 2 * d.node"
        keyed = spread(spread(spread(share, "rep", str(seed), "k0"), "node", "k0", "a"), "node", "a", "b")
        mass = "CASE WHEN p = 0 THEN (k = 0)::INT WHEN p = 1 THEN (k = n)::INT ELSE exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p)) END"
        wide = f"SELECT rep, node, n, k, u, SUM({mass}) OVER (PARTITION BY rep, node ORDER BY k) AS below FROM (SELECT *, (a * 2097152 + (b >> 11)) / 9007199254740992.0 AS u, unnest(range(0, n + 1)) AS k FROM ({keyed}))"
        # rounding must not push the last value below u
        left = f"SELECT rep, node, n, LEAST(MIN(n), COUNT(*) FILTER (WHERE below <= u)) AS l FROM ({wide}) GROUP BY ALL"
        out.append(f"{p}_{k + 1} AS MATERIALIZED (SELECT rep, 2 * node + s AS node, CASE WHEN s = 0 THEN l ELSE n - l END AS n FROM ({left}), range(2) t(s) WHERE CASE WHEN s = 0 THEN l ELSE n - l END > 0)")
    draws = f"SELECT d.rep, d.node - {buckets} AS bucket, t.size, unnest(range(0, d.n)) AS j FROM {p}_{levels} d JOIN {p}_t t USING (node)"
    picked = spread(spread(spread(draws, "rep", str(seed + 1), "k0"), "bucket", "k0", "k1"), "j", "k1", "h")
    out.append(f"{p}_d AS (SELECT rep, bucket, (h * size) >> 32 AS idx, COUNT(*) AS times FROM ({picked}) GROUP BY ALL)")
    out.append(f"{p} AS MATERIALIZED (SELECT c.*, d.rep, d.times FROM {p}_d d JOIN {p}_c c USING (bucket, idx))")
    return out


def permuted_ctes(p: str, source: str, seed: int) -> list[str]:
    """CTEs ending in ``{p}`` (rep, pos, v): the keyed bijection of ``source`` (rep, pos, start, n), v = its place.

    ``pos`` is the dense index, ``start`` the first index of the row's group of ``n`` rows.
    """
    half = f"(SELECT MIN(h) FROM range({LEAST_HALF}, 31) t(h) WHERE (1::BIGINT << (2 * h)::INT) >= m)"
    sizes = f"{p}_h AS MATERIALIZED (SELECT m AS n, {half}::INT AS h FROM (SELECT DISTINCT n AS m FROM {source}))"
    keyed = spread(spread(f"SELECT rep, pos, start, n, h, pos - start AS v FROM {source} JOIN {p}_h USING (n)", "start % 2147483647", str(seed & 0x3FFFFFFF), "k0"), "rep", "k0", "k1")

    def network(source: str) -> str:
        q = f"SELECT rep, pos, start, n, h, k1, v >> h AS l, v & ((1::BIGINT << h) - 1) AS r FROM ({source})"
        for k in range(ROUNDS):
            q = spread(spread(q, f"{k}::BIGINT", "k1", "kr"), "r", "kr", "f")
            q = f"SELECT rep, pos, start, n, h, k1, r AS l, xor(l, f & ((1::BIGINT << h) - 1)) AS r FROM ({q})"
        return f"SELECT rep, pos, start, n, h, k1, (l << h) | r AS v FROM ({q})"

    first = f"{p}_k AS (SELECT rep, pos, start, n, h, k1, v FROM ({keyed}))"
    walk = f"{p}_w AS ({network(f'SELECT * FROM {p}_k')} UNION ALL {network(f'SELECT * FROM {p}_w WHERE v >= n')})"
    return [sizes, first, walk, f"{p} AS MATERIALIZED (SELECT rep, pos, start + v AS v FROM {p}_w WHERE v < n)"]
