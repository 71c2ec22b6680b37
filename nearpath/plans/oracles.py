"""DuckDB SQL for the registered queries, built from the same drawn numbers."""

from __future__ import annotations

from nearpath.functions.lsh import BaseHash, Family
from nearpath.sources.points import LINE_ORDER

_M64 = 1 << 64

LINES = f"SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS ord, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem"
EVENTS = "SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, hour(ts)::DOUBLE AS x, value AS y FROM events"
HOURS = "SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY hour(ts)) AS ord, hour(ts)::DOUBLE AS x, max(value) AS y FROM events GROUP BY user_id, hour(ts)"
VECTORS = "SELECT vec_id AS id, i + 1 AS ord, embedding[2 * i + 1]::DOUBLE AS x, embedding[2 * i + 2]::DOUBLE AS y FROM embeddings, range(0, len(embedding) // 2) AS r(i)"


def snapped(points: str, fam: str, delta: float) -> str:
    """Cells (f, id, i, cx, cy) without repeats, i from 0; fam has f, sx, sy."""
    cell = lambda c, s: f"(sign(({c} + {s}) / {delta!r}) * floor(abs(({c} + {s}) / {delta!r}) + 0.5))::BIGINT"
    return f"""SELECT f, id, row_number() OVER (PARTITION BY f, id ORDER BY ord) - 1 AS i, cx, cy FROM (
  SELECT f, id, ord, cx, cy, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM (
    SELECT f, id, ord, {cell('x', 'sx')} AS cx, {cell('y', 'sy')} AS cy FROM {points} CROSS JOIN {fam}) WINDOW w AS (PARTITION BY f, id ORDER BY ord))
  WHERE px IS NULL OR px <> cx OR py <> cy"""


def _upper(expr: str) -> str:
    """Upper 32 bits modulo 2**64."""
    return f"((((({expr}) % {_M64}) + {_M64}) % {_M64}) // {1 << 32})::BIGINT"


def _tables(bases: list[BaseHash], n: int) -> tuple[str, str]:
    fam = ", ".join(f"({f}, {b.shift_x!r}::DOUBLE, {b.shift_y!r}::DOUBLE)" for f, b in enumerate(bases))
    coef = ", ".join("(" + str(f) + ", [" + ", ".join(f"{c}::HUGEINT" for c in b.coefficients[:n]) + "])" for f, b in enumerate(bases))
    return f"fam AS (SELECT * FROM (VALUES {fam}) AS t(f, sx, sy))", f"coef AS (SELECT * FROM (VALUES {coef}) AS t(f, r))"


def base_hashes(points: str, family: Family, perturbed: bool = False) -> str:
    """CTEs up to ``base`` (f, id, h), functions numbered left side first."""
    bases = [b for side in (family.left, family.right) for group in side for b in group]
    delta, n = family.config.resolution, family.max_points + 1
    fam, coef = _tables(bases, n)
    ctes = [f"pts AS ({points})", fam, coef]
    source = "pts"
    if perturbed:
        moves = ", ".join("(" + str(f) + ", [" + ", ".join(f"{v!r}::DOUBLE" for v in b.offsets_x) + "], [" + ", ".join(f"{v!r}::DOUBLE" for v in b.offsets_y) + "])" for f, b in enumerate(bases))
        ctes.append(f"moves AS (SELECT * FROM (VALUES {moves}) AS t(f, dx, dy))")
        cell = lambda c: f"(sign(({c}) / {delta!r}) * floor(abs(({c}) / {delta!r}) + 0.5))::BIGINT"
        ctes.append(f"""first AS (SELECT f, id, ord, {cell('x + dx[ord]')} AS cx, {cell('y + dy[ord]')} AS cy FROM pts CROSS JOIN moves)""")
        ctes.append("""moved AS (SELECT f, id, ord, cx::DOUBLE AS x, cy::DOUBLE AS y FROM (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM first WINDOW w AS (PARTITION BY f, id ORDER BY ord)) WHERE px IS NULL OR px <> cx OR py <> cy)""")
        source = "moved"
    fam_join = "fam" if not perturbed else "(SELECT f AS f2, sx, sy FROM fam) AS g"
    cells = snapped(source, fam_join, delta)
    if perturbed:
        cells = cells.replace("FROM moved CROSS JOIN (SELECT f AS f2, sx, sy FROM fam) AS g", "FROM moved JOIN (SELECT f AS f2, sx, sy FROM fam) AS g ON f = f2")
    ctes.append(f"cells AS ({cells})")
    ctes.append(f"base AS (SELECT cells.f, id, {_upper('sum(cx::HUGEINT * (r[i + 1] % ' + str(1 << 32) + ') + cy::HUGEINT * (r[i + 2] % ' + str(1 << 32) + ')) + ' + str(1 << 32) + ' * sum(cx::HUGEINT * (r[i + 1] // ' + str(1 << 32) + ') + cy::HUGEINT * (r[i + 2] // ' + str(1 << 32) + '))')} AS h FROM cells JOIN coef ON cells.f = coef.f GROUP BY cells.f, id)")
    return ",\n".join(ctes)


def signatures(points: str, family: Family, perturbed: bool = False) -> str:
    """CTEs up to ``sig`` (id, t, hash)."""
    c, m = family.config, family.mixers
    left = (c.k + 1) // 2
    right = c.k // 2
    start = c.side * left
    weight = lambda f, n: "CASE " + " ".join(f"WHEN {f} % {n} = {j} THEN {m[j]}::HUGEINT" for j in range(n)) + " END"
    mix = lambda f, n: _upper(f"sum((h::HUGEINT * (({weight(f, n)}) // {1 << 32}) % {1 << 32}) * {1 << 32} + h::HUGEINT * (({weight(f, n)}) % {1 << 32}))")
    product = lambda v, w: f"({v}::HUGEINT * {w >> 32} % {1 << 32}) * {1 << 32} + {v}::HUGEINT * {w & 0xFFFFFFFF}"
    return f"""{base_hashes(points, family, perturbed)},
lefts AS (SELECT id, f // {left} AS a, {mix('f', left)} AS v FROM base WHERE f < {start} GROUP BY id, f // {left}),
rights AS (SELECT id, (f - {start}) // {right} AS b, {mix(f'(f - {start})', right)} AS v FROM base WHERE f >= {start} GROUP BY id, (f - {start}) // {right}),
sig AS (SELECT lefts.id, (a * {c.side} + b)::INTEGER AS t, {_upper(product('lefts.v', m[0]) + ' + ' + product('rights.v', m[1]))} AS hash FROM lefts JOIN rights ON lefts.id = rights.id WHERE a * {c.side} + b < {c.l})"""


def codes(l: int) -> str:  # noqa: E741
    """CTE ``code`` (id, c0, c1, ...) from ``sig``."""
    return "code AS (SELECT id, " + ", ".join(f"max(CASE WHEN t = {j} THEN hash END) AS c{j}" for j in range(l)) + " FROM sig GROUP BY id)"


def mask(l: int, a: str = "a", b: str = "b") -> str:  # noqa: E741
    return " | ".join(f"xor({a}.c{j}, {b}.c{j})" for j in range(l))


COLLIDE = "scored AS (SELECT q.id AS query, c.id AS candidate, count(*)::INTEGER AS score FROM sig q JOIN sig c ON q.t = c.t AND q.hash = c.hash GROUP BY q.id, c.id)"


def reach(pairs: str, bound: float) -> str:
    """CTEs ``curve`` and ``near``: the pairs (query, candidate) of a CTE within the Fréchet bound."""
    return f"""curve AS (SELECT id, list(x ORDER BY ord) AS xs, list(y ORDER BY ord) AS ys FROM pts GROUP BY id),
both_ AS (SELECT query, candidate, a.xs AS ax, a.ys AS ay, b.xs AS bx, b.ys AS bye FROM {pairs} JOIN curve a ON a.id = query JOIN curve b ON b.id = candidate),
free AS (SELECT query, candidate, len(ax) AS n, len(bx) AS m, i, j FROM both_, range(1, len(ax) + 1) AS r(i), range(1, len(bx) + 1) AS s(j)
  WHERE (ax[i] - bx[j]) * (ax[i] - bx[j]) + (ay[i] - bye[j]) * (ay[i] - bye[j]) <= {bound * bound!r}),
walk AS (SELECT query, candidate, n, m, i, j FROM free WHERE i = 1 AND j = 1
  UNION SELECT f.query, f.candidate, f.n, f.m, f.i, f.j FROM walk w JOIN free f ON f.query = w.query AND f.candidate = w.candidate
    AND f.i BETWEEN w.i AND w.i + 1 AND f.j BETWEEN w.j AND w.j + 1 AND f.i + f.j > w.i + w.j),
near AS (SELECT query, candidate FROM walk WHERE i = n AND j = m)"""


def starts_near(bound: float) -> str:
    """CTE ``close``: the pairs of all curves whose first and last points are within the bound."""
    width = bound * 1.001
    return f"""ends AS (SELECT id, arg_min(x, ord) AS fx, arg_min(y, ord) AS fy, arg_max(x, ord) AS lx, arg_max(y, ord) AS ly, floor(arg_min(x, ord) / {width!r}) AS cx, floor(arg_min(y, ord) / {width!r}) AS cy FROM pts GROUP BY id),
close AS (SELECT a.id AS query, b.id AS candidate FROM (SELECT ends.*, cx + i AS nx, cy + j AS ny FROM ends, range(-1, 2) AS r(i), range(-1, 2) AS s(j)) a JOIN ends b ON b.cx = nx AND b.cy = ny
  WHERE (a.fx - b.fx) * (a.fx - b.fx) + (a.fy - b.fy) * (a.fy - b.fy) <= {bound * bound!r} AND (a.lx - b.lx) * (a.lx - b.lx) + (a.ly - b.ly) * (a.ly - b.ly) <= {bound * bound!r})"""


ALL_PAIRS = "pairs AS (SELECT a.id AS query, b.id AS candidate FROM (SELECT DISTINCT id FROM pts) a, (SELECT DISTINCT id FROM pts) b)"


def distances(pairs: str) -> str:
    """CTE ``dist`` (query, candidate, distance): the recurrence, a list a row of it."""
    return f"""curve_ AS (SELECT id, list(x ORDER BY ord) AS xs, list(y ORDER BY ord) AS ys FROM pts GROUP BY id),
two AS (SELECT query, candidate, a.xs AS ax, a.ys AS ay, b.xs AS bx, b.ys AS bye FROM {pairs} JOIN curve_ a ON a.id = query JOIN curve_ b ON b.id = candidate),
costs AS (SELECT query, candidate, list_transform(range(1, len(ax) + 1), lambda i: list_transform(range(1, len(bx) + 1), lambda j: (ax[i] - bx[j]) * (ax[i] - bx[j]) + (ay[i] - bye[j]) * (ay[i] - bye[j]))) AS c FROM two),
ran AS (SELECT query, candidate, list_reduce(c[2:], lambda before, own: list_reduce(list_transform(range(1, len(own) + 1), lambda j: [least(before[j], coalesce(before[j - 1], before[j])), own[j]]),
    lambda acc, v: list_append(acc, greatest(v[2], CASE WHEN len(acc) = 0 THEN v[1] ELSE least(v[1], acc[-1]) END)), []::DOUBLE[]),
  list_reduce(list_transform(c[1], lambda v: [v]), lambda acc, v: list_append(acc, greatest(v[1], coalesce(acc[-1], 0.0))), []::DOUBLE[])) AS last FROM costs),
dist AS (SELECT query, candidate, sqrt(last[-1]) AS distance FROM ran)"""


def leaves(limits: list[float]) -> str:
    """CTE ``leaf`` (id, depth) from ``code`` c0 to c7 by its levels, one-character labels, ids in order."""
    node = lambda d: ", ".join(f"c{j} & {(1 << d) - 1}" for j in range(8))
    ctes = ["l1 AS (SELECT code.*, NULL::BIGINT AS since FROM code)"]
    for d, limit in enumerate(limits, 1):
        n = int(-(-limit // 1))
        ctes.append(f"""r{d} AS (SELECT *, row_number() OVER (PARTITION BY {node(d)} ORDER BY id) AS n, count(*) FILTER (id <= since) OVER (PARTITION BY {node(d)}) AS held FROM l{d}),
s{d} AS (SELECT *, min(id) FILTER (n = greatest({n}, held + 1)) OVER (PARTITION BY {node(d)}) AS split FROM r{d}),
l{d + 1} AS (SELECT id, {", ".join(f"c{j}" for j in range(8))}, split AS since FROM s{d} WHERE split IS NOT NULL{" AND false" if d == len(limits) else ""})""")
    last = len(limits)
    out = [f"SELECT id, {d}::BIGINT AS depth FROM s{d} WHERE split IS NULL" if d < last else f"SELECT id, {d} FROM s{d}" for d in range(1, last + 1)]
    return ",\n".join(ctes) + ",\nleaf AS (" + " UNION ALL ".join(out) + ")"


#: Characters 1 to 32 of ``code`` as a list, beside its columns.
CHARACTERS = "chars AS (SELECT *, list_transform(range(0, 32), lambda i: (" + " | ".join(f"(((c{j} >> i) & 1) << {j})" for j in range(8)) + ")::INTEGER) AS path FROM code)"
