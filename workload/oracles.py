"""SQL twins of the registered queries, for the same tables."""

from __future__ import annotations

import math

from marginspark.operators.sampling import MAX_BUCKETS
from marginspark.params import MarginParams
from workload import fixtures as fx
from workload.queries import K, PARTS, SEED, SIGMA

P = MarginParams()
LOW, HIGH, LAM, MU = P.low, P.high, P.lam, P.mu
D = f"{LOW**2}::double"
M_SQL = "(SELECT count(*) FROM pts)"


def num(v: float) -> str:
    return f"({v!r})::double"


def vec(values: list[float]) -> str:
    return "[" + ", ".join(num(v) for v in values) + "]"


def r6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def scored(n: int, w: list[float] | None = None) -> str:
    w = fx.weights(n) if w is None else w
    return f"""
scored AS (SELECT *, y * list_inner_product(x, {vec(w)}) AS s FROM pts)"""


LOSS = f"""CASE WHEN s < {LOW} THEN {num(LAM)} * ({LOW} - s) * ({LOW} - s) / {D}
       WHEN s > {HIGH} THEN {num(LAM * MU)} * (s - {HIGH}) * (s - {HIGH}) / {D}
       ELSE 0::double END"""
SLOPE = f"""CASE WHEN s < {LOW} THEN {num(2 * LAM)} * (s - {LOW}) / {D}
       WHEN s > {HIGH} THEN {num(2 * LAM * MU)} * (s - {HIGH}) / {D}
       ELSE 0::double END"""


def bands(points: str, n: int) -> str:
    return with_(points, scored(n)) + f"""
SELECT CASE WHEN s < {LOW} THEN 'low' WHEN s > {HIGH} THEN 'high' ELSE 'mid' END AS band,
       count(*) AS n, {r6(f"sum({LOSS}) / {M_SQL}")} AS loss
FROM scored GROUP BY 1"""


def gradient(points: str, n: int, w: list[float] | None = None) -> str:
    w = fx.weights(n) if w is None else w
    return with_(points, scored(n, w), f"""
long AS (
  SELECT generate_subscripts(x, 1) AS j1, unnest(x) AS v, y * ({SLOPE}) AS a FROM scored)
""") + f"""
SELECT (j1 - 1)::int AS j,
       {r6(f"sum(a * v) / {M_SQL} + any_value({vec(w)}[j1])")} AS g
FROM long GROUP BY j1"""


def key(id_: str = "id", seed: int = SEED) -> str:
    return f"md5('{seed}:' || {id_}::varchar)"


def bits(id_: str = "id") -> str:
    return f"('0x' || substr({key(id_)}, 1, 8))::bigint"


def centers(k: int = K, seed: int = SEED, name: str = "centers") -> str:
    by = f"{key(seed=seed)}, id"
    return f"""
{name} AS (
  SELECT (row_number() OVER (ORDER BY {by}) - 1)::int AS cid, x AS cx
  FROM (SELECT id, x FROM pts ORDER BY {by} LIMIT {k}))"""


D2 = "list_sum(list_transform(list_zip(p.x, c.cx), lambda e: (e[1] - e[2]) * (e[1] - e[2])))"
ASSIGNED = f"""
pairs AS (SELECT p.id, p.x, p.y, c.cid, {D2} AS d2 FROM pts p, centers c),
near AS (SELECT id, any_value(x) AS x, any_value(y) AS y,
                min(d2) AS d2, arg_min(cid, (d2, cid)) AS cid
         FROM pairs GROUP BY id)"""


def assign(points: str, distance: str) -> str:
    return with_(points, centers(), ASSIGNED) + f"""
SELECT id, cid, {r6(distance)} AS d FROM near"""


SCALED_ORDERS = fx.ORDERS_SQL.replace("pts AS", "raw_pts AS") + """,
pts AS (SELECT id, list_transform(x, lambda v: v * y) AS x, y FROM raw_pts)"""


def moved(prev: str, name: str) -> str:
    d2 = D2.replace("c.cx", f"c.{'cx'}")
    return f"""
{name}_pairs AS (SELECT p.id, p.x, c.cid, {d2} AS d2 FROM pts p, {prev} c),
{name}_near AS (SELECT id, any_value(x) AS x, arg_min(cid, (d2, cid)) AS cid
                FROM {name}_pairs GROUP BY id),
{name}_means AS (
  SELECT cid, j1, avg(v) AS c
  FROM (SELECT cid, generate_subscripts(x, 1) AS j1, unnest(x) AS v FROM {name}_near)
  GROUP BY cid, j1),
{name} AS (
  SELECT o.cid, coalesce(list(m.c ORDER BY m.j1) FILTER (m.c IS NOT NULL),
                         any_value(o.cx)) AS cx
  FROM {prev} o LEFT JOIN {name}_means m ON o.cid = m.cid GROUP BY o.cid)"""


def kmeans_steps(steps: int) -> str:
    names = ["centers"] + [f"step{i}" for i in range(1, steps + 1)]
    ctes = [moved(a, b) for a, b in zip(names, names[1:])]
    return with_(fx.ORDERS_SQL, centers(), *ctes) + f"""
SELECT cid, (j1 - 1)::int AS j, {r6("c")} AS c
FROM (SELECT cid, generate_subscripts(cx, 1) AS j1, unnest(cx) AS c FROM {names[-1]})"""


SPLIT = f"""
split AS (SELECT *, ({bits()} % {PARTS})::int AS part FROM pts)"""
INDEXED = """
indexed AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS slot FROM split)"""


def dealt(start: str) -> str:
    return with_(fx.ORDERS_SQL, centers(), ASSIGNED) + f"""
SELECT id, cid,
       ((row_number() OVER (PARTITION BY cid ORDER BY id) - 1 + {start}) % {PARTS})::int AS part
FROM near"""


def rbf(a: str, b: str) -> str:
    return (
        f"exp(-(list_sum(list_transform(list_zip({a}, {b}), "
        "lambda e: (e[1] - e[2]) * (e[1] - e[2])))) / 2)"
    )


def picks(k: int) -> str:
    """All self-kernels are 1, so the lowest id comes first; the second row is
    the one with the smallest squared kernel with it; the third has the smallest
    quadratic form with the inverse of the 2 x 2 Gram matrix."""
    z = "(SELECT x FROM z{0})"
    ctes = ["""
z1 AS (SELECT id, x FROM pts ORDER BY id LIMIT 1)"""]
    if k > 1:
        ctes.append(f"""
z2 AS (
  SELECT id, x FROM pts WHERE id NOT IN (SELECT id FROM z1)
  ORDER BY pow({rbf("x", z.format(1))}, 2), id LIMIT 1)""")
    if k > 2:
        ctes.append(f"""
kq AS (
  SELECT id, {rbf("x", z.format(1))} AS k1, {rbf("x", z.format(2))} AS k2,
         {rbf(z.format(1), z.format(2))} AS q
  FROM pts),
z3 AS (
  SELECT id FROM kq
  WHERE id NOT IN (SELECT id FROM z1) AND id NOT IN (SELECT id FROM z2)
  ORDER BY (k1 * k1 - 2 * q * k1 * k2 + k2 * k2) / (1 - q * q), id LIMIT 1)""")
    rows = "\nUNION ALL ".join(
        f"SELECT {i} AS pick, id FROM z{i + 1}" for i in range(k)
    )
    return with_(fx.ORDERS_SQL, *ctes) + rows


def recover(points: str) -> str:
    return with_(points, fx.DUALS_SQL) + f"""
SELECT (j1 - 1)::int AS j, {r6("sum(a * v)")} AS w
FROM (SELECT generate_subscripts(x, 1) AS j1, unnest(x) AS v, y * (zeta - beta) AS a
      FROM duals) GROUP BY j1"""


def kernel_rows(points: str, kernel: str) -> str:
    return with_(points, centers()) + f"""
SELECT p.id, c.cid AS q, {r6(kernel)} AS k FROM pts p, centers c"""


SCALED = """
scaled AS (SELECT id, list_transform(x, lambda v: v * y) AS s FROM pts)"""


def axpy(k: str, a: str, b: str) -> str:
    """``k * a + b`` of two lists."""
    return f"list_transform(list_zip({a}, {b}), lambda e: ({k}) * e[1] + e[2])"


PAR = f"""
par AS (SELECT count(*) * {D} / {num(2 * LAM)} AS c FROM pts)"""


def level(name: str, source: str, count: int, ridges: str = ", par") -> list[str]:
    """Sweeps over every part of ``source`` (id, part, s, q, zeta, beta), row by
    row: each visit is a recursion over the row numbers of the part.  The result
    ``name`` has the same columns and ``slot``."""
    ctes = [f"""
{name}_rows AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS slot FROM {source})""", f"""
{name}_u AS (
  SELECT part, list(v ORDER BY j) AS u FROM (
    SELECT part, j, sum(v) AS v FROM (
      SELECT part, generate_subscripts(s, 1) AS j, unnest(s) * (zeta - beta) AS v
      FROM {name}_rows) GROUP BY part, j) GROUP BY part)"""]
    u, state = f"{name}_u", {}
    for i in range(count):
        for a, sign, ridge, shift in (
            ("zeta", "1", "c", P.theta - 1), ("beta", "-1", f"(c / {MU})", P.theta + 1)
        ):
            visit = f"{name}_{a}{i}"
            old = f"(SELECT part, slot, {a} AS a FROM {name}_rows)"
            if a in state:
                old = f"(SELECT part, slot, a FROM {state[a]} WHERE slot >= 0)"
            ctes.append(f"""
{visit} AS (
  SELECT part, -1::bigint AS slot, u, 0::double AS a FROM {u}
  UNION ALL
  SELECT part, slot, {axpy(f"{sign} * (a - old)", "s", "u")} AS u, a
  FROM (SELECT r.part, r.slot, r.s, p.u, o.a AS old,
               greatest(0::double, o.a - ({sign} * list_inner_product(r.s, p.u)
                 + {ridge} * o.a + {num(shift)}) / (r.q + {ridge})) AS a
        FROM {visit} p JOIN {name}_rows r ON r.part = p.part AND r.slot = p.slot + 1
        JOIN {old} o ON o.part = r.part AND o.slot = r.slot{ridges}))""")
            u = f"(SELECT part, arg_max(u, slot) AS u FROM {visit} GROUP BY part)"
            state[a] = visit
    ctes.append(f"""
{name} AS (
  SELECT r.id, r.part, r.slot, r.s, r.q, z.a AS zeta, b.a AS beta
  FROM {name}_rows r JOIN {state["zeta"]} z ON z.part = r.part AND z.slot = r.slot
  JOIN {state["beta"]} b ON b.part = r.part AND b.slot = r.slot)""")
    return ctes


def first_rows(points: list[str], parts: str) -> list[str]:
    """The rows of ``parts`` (id, part) with the zero state."""
    return [*points, PAR, f"""
first AS (
  SELECT p.id, k.part, list_transform(p.x, lambda v: v * p.y) AS s,
         list_inner_product(p.x, p.x) AS q, 0::double AS zeta, 0::double AS beta
  FROM pts p JOIN {parts} k ON k.id = p.id)"""]


def level_ctes(
    points: list[str], parts: str, sizes: list[int], count: int, support: bool = False
) -> list[str]:
    """Train from the rows of ``parts`` (id, part) down the given part counts."""
    ctes = [*first_rows(points, parts), *level("l0", "first", count)]
    keep = "WHERE zeta + beta > 0" if support else ""
    for i, k in enumerate(sizes[1:], 1):
        source = f"""(SELECT id, (slot % {k})::int AS part, s, q, zeta, beta
         FROM l{i - 1} {keep})"""
        ctes += level(f"l{i}", source, count)
    return ctes


STATE = """
SELECT id, part, slot::int AS slot, round(zeta, 9) + 0.0 AS zeta,
       round(beta, 9) + 0.0 AS beta
FROM """


def levels(points: list[str], parts: str, sizes: list[int], count: int, support: bool) -> str:
    ctes = level_ctes(points, parts, sizes, count, support)
    return "WITH RECURSIVE " + ",".join(ctes) + STATE + f"l{len(sizes) - 1}"


def local_scale(k: int, count: int) -> str:
    """One level whose parts have their own number of rows as the scale."""
    own = f"""
own AS (SELECT part, count(*) * {D} / {num(2 * LAM)} AS c FROM first GROUP BY part)"""
    ctes = [*first_rows([fx.ORDERS_SQL], split(k)), own, *level("l0", "first", count, " JOIN own ON own.part = r.part")]
    return "WITH RECURSIVE " + ",".join(ctes) + STATE + "l0"


def run_of(select: str) -> str:
    """``select`` over each level (``{rows}``, numbered ``{level}``) of the run
    of 81 and 27 parts."""
    ctes = level_ctes([fx.ORDERS_SQL], split(81), [81, 27], 1)
    parts = [select.format(level=4 - i, rows=f"l{i}") for i in (0, 1)]
    return "WITH RECURSIVE " + ",".join(ctes) + " UNION ALL ".join(parts)


def strata(k: int) -> list[str]:
    """The first three landmarks, the nearest by RBF distance, and the deal."""
    picked = picks(3)
    ctes = picked[len("WITH ") : picked.index("SELECT 0 AS pick")]
    return [ctes.rstrip().rstrip(","), """
marks AS (SELECT 0 AS cid, x AS cx FROM z1 UNION ALL SELECT 1, x FROM z2
          UNION ALL SELECT 2, p.x FROM z3 JOIN pts p ON p.id = z3.id)""", f"""
near AS (
  SELECT id, arg_min(cid, (d2, cid)) AS cid
  FROM (SELECT p.id, c.cid, {D2} AS d2 FROM pts p, marks c) GROUP BY id)""", f"""
dealt AS (
  SELECT id, ((row_number() OVER (PARTITION BY cid ORDER BY id) - 1) % {k})::int AS part
  FROM near)"""]


def gauss(a: str, b: str, sigma: float = SIGMA) -> str:
    gap = f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return f"exp(-({gap}) / {num(2 * sigma * sigma)})"


def greedy(points: str, k: int, kernel, lower: bool = False, where: str = "true") -> str:
    """The picks of ``k`` landmarks, one after the other, with a column per pick:
    coordinates of a pivoted factor, or the solution by the lower triangle."""
    ctes = [points, f"""
f0 AS MATERIALIZED (
  SELECT id, x, {kernel("x", "x")} AS own, 0::double AS score, []::double[] AS z FROM pts WHERE {where})"""]
    for t in range(k):
        order = "(own, id)" if t == 0 else "(score, id)"
        taken = " AND ".join(f"id NOT IN (SELECT id FROM p{u})" for u in range(t)) or "true"
        free = "true" if lower else "own - score > 1e-9::double * greatest(own, 1::double)"
        dots = "coalesce(list_sum(list_transform(list_zip(f.z, p.z), lambda q: q[1] * q[2])), 0::double)"
        if lower:
            # the pick's row of the triangle: its kernels with the picks before
            kernels = ", ".join(f"{kernel('c.x', f'p{u}.x')}" for u in range(t))
            froms = "".join(f", p{u}" for u in range(t))
            pick_z, root = f"[{kernels}]::double[]", "c.own"
            gain = f"{kernel('f.x', 'p.x')} * col"
        else:
            froms, pick_z, root, gain = "", "c.z", "sqrt(c.own - c.score)", "col * col"
        ctes.append(f"""
p{t} AS MATERIALIZED (
  SELECT c.id, c.x, {pick_z} AS z, {root} AS root
  FROM (SELECT arg_min(id, {order}) AS id FROM f{t} WHERE {taken} AND {free}) w
  JOIN f{t} c ON c.id = w.id{froms.replace(", ", " CROSS JOIN ")})""")
        if t < k - 1:
            ctes.append(f"""
f{t + 1} AS MATERIALIZED (
  SELECT id, x, own, score + gain AS score, list_append(z, col) AS z FROM (
    SELECT f.*, ({kernel("f.x", "p.x")} - {dots}) / p.root AS col, {gain} AS gain
    FROM f{t} f, p{t} p))""")
    union = " UNION ALL ".join(f"SELECT {t} AS pick, id FROM p{t}" for t in range(k))
    return "WITH " + ",".join(ctes) + "\n" + union


def linear(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


#: The coordinates of ``pts`` in the span of three rows, and a bias.
FEATURES = [fx.ORDERS_SQL.replace("pts AS", "raw AS"), centers(3).replace("FROM pts", "FROM raw"), f"""
marks AS (
  SELECT *, {gauss("a", "b")} AS ab, {gauss("a", "c")} AS ac, {gauss("b", "c")} AS bc FROM (
    SELECT arg_max(cx, cid = 0) AS a, arg_max(cx, cid = 1) AS b, arg_max(cx, cid = 2) AS c FROM centers)),
roots AS (
  SELECT *, (bc - ab * ac) / rb AS lc FROM (SELECT *, sqrt(1 - ab * ab) AS rb FROM marks)),
spanned AS (
  SELECT id, y, {gauss("x", "a")} AS z1, {gauss("x", "b")} AS kb, {gauss("x", "c")} AS kc,
         ab, ac, rb, lc, sqrt(1 - ac * ac - lc * lc) AS rc FROM raw, roots),
pts AS (
  SELECT id, y, [z1, z2, (kc - ac * z1 - lc * z2) / rc, 1::double] AS x
  FROM (SELECT *, (kb - ab * z1) / rb AS z2 FROM spanned))"""]


def clusters(name: str, k: int, seed: int, steps: int = 2) -> list[str]:
    """``name`` (id, cid): the nearest of ``k`` centers after two rounds."""
    names = [f"{name}_c{i}" for i in range(steps + 1)]
    return [
        centers(k, seed, names[0]),
        *[moved(a, b) for a, b in zip(names, names[1:])], f"""
{name} AS (
  SELECT id, arg_min(cid, (d2, cid)) AS cid
  FROM (SELECT p.id, c.cid, {D2} AS d2 FROM pts p, {names[-1]} c) GROUP BY id)"""]


def clustered_levels(depth: int, count: int) -> str:
    """One part per cluster, found anew on each level, then one part with the
    support vectors of the last."""
    source = """(
  SELECT p.id, list_transform(p.x, lambda v: v * p.y) AS s,
         list_inner_product(p.x, p.x) AS q, 0::double AS zeta, 0::double AS beta
  FROM pts p)"""
    ctes = [fx.EMBEDDINGS_SQL, PAR]
    for lv in range(depth, 0, -1):
        ctes += clusters(f"k{lv}", 3**lv, SEED + lv)
        ctes += level(f"l{lv}", f"""(
  SELECT r.id, k.cid AS part, r.s, r.q, r.zeta, r.beta
  FROM {source} r JOIN k{lv} k ON k.id = r.id)""", count)
        source = f"l{lv}"
    ctes += level("l0", """(
  SELECT id, 0 AS part, s, q, zeta, beta FROM l1 WHERE zeta + beta > 0)""", count)
    return "WITH RECURSIVE " + ",".join(ctes) + """
SELECT id, part, slot::int AS slot, round(zeta, 9) + 0.0 AS zeta,
       round(beta, 9) + 0.0 AS beta FROM l0"""


def split(k: int) -> str:
    return f"(SELECT id, ({bits()} % {k})::int AS part FROM pts)"


def slope_of(e: str) -> str:
    k = num(2 * LAM / LOW**2)
    return (
        f"CASE WHEN {e} < {LOW} THEN {k} * ({e} - {LOW}) "
        f"WHEN {e} > {HIGH} THEN {k} * {MU} * ({e} - {HIGH}) ELSE 0::double END"
    )


def inner(name: str, start: str, anchor: str, rows: str, pull: float) -> list[str]:
    """One pass of corrected steps over ``rows`` (step, s), as a recursion."""
    dot_x, dot_z = "list_inner_product(b.s, r.x)", "list_inner_product(b.s, r.z)"
    move = f"({slope_of(dot_x)}) - ({slope_of(dot_z)})"
    back = num(-P.eta)
    parts = axpy("1", axpy("-1", "r.z", "r.x"), axpy(move, "b.s", "r.g"))
    pulled = axpy(num(pull), axpy("-1", "r.w", "r.x"), parts)
    return [f"""
{name}_g AS (
  SELECT list(g ORDER BY j) AS g FROM (
    SELECT j, sum(a * v) / {M_SQL} + any_value(z[j]) AS g FROM (
      SELECT generate_subscripts(s, 1) AS j, unnest(s) AS v, z,
             {slope_of("list_inner_product(s, z)")} AS a
      FROM scaled, (SELECT w AS z FROM {anchor})) GROUP BY j))""", f"""
{name}_r AS (
  SELECT -1::bigint AS step, a.w AS x, a.w, z.w AS z, g FROM {start} a, {anchor} z, {name}_g
  UNION ALL
  SELECT b.step, {axpy(back, pulled, "r.x")}, r.w, r.z, r.g
  FROM {name}_r r JOIN ({rows}) b ON b.step = r.step + 1)""", f"""
{name} AS (
  SELECT list(c ORDER BY j) AS w FROM (
    SELECT j, avg(v) AS c FROM (
      SELECT generate_subscripts(x, 1) AS j, unnest(x) AS v FROM {name}_r WHERE step >= 0)
    GROUP BY j))"""]


W0 = f"""
w0 AS (SELECT {vec(fx.weights(4))} AS w)"""
MODEL = "SELECT (generate_subscripts(w, 1) - 1)::int AS j, round(unnest(w), 6) + 0.0 AS w FROM "


def counted(kind: str, *numbers: str) -> str:
    text = " || ':' || ".join([f"'{SEED}:{kind}'", *[f"{n}::varchar" for n in numbers]])
    return f"('0x' || substr(md5({text}), 1, 13))::bigint"


def draws(total: int, source: str = "pts", stratum: str = "") -> list[str]:
    """``picked`` (step, id, st): draws with replacement from ``source``."""
    st = stratum or "0"
    quota = f"ceil(size * {total} / {M_SQL})::bigint" if stratum else str(total)
    buckets = (
        f"least(greatest({M_SQL} // 32, 1), greatest({MAX_BUCKETS} // "
        f"(SELECT count(DISTINCT {st}) FROM {source}), 1))"
    )
    return [f"""
ranked AS (
  SELECT id, st, row_number() OVER (PARTITION BY st ORDER BY b, id) - 1 AS pos
  FROM (SELECT id, {st} AS st, {bits()} % {buckets} AS b FROM {source}))""", f"""
tickets AS (
  SELECT st, {counted("draw", "st", "d")} % size AS pos,
         row_number() OVER (ORDER BY {counted("step", "st", "d")}, st, d) - 1 AS step
  FROM (SELECT st, size, unnest(range({quota})) AS d
        FROM (SELECT st, count(*) AS size FROM ranked GROUP BY st)))""", """
picked AS (SELECT t.step, r.id, r.st FROM tickets t JOIN ranked r ON t.st = r.st AND t.pos = r.pos)"""]


def start(n: int) -> str:
    return f"""
w0 AS (SELECT list({counted("start", "j")} / {2**52}::double ORDER BY j) AS w
       FROM (SELECT unnest(range({n})) AS j))"""


def epochs_over(epochs: int, steps: int) -> list[str]:
    """``w1``, ``w2``, ...: corrected steps over ``drawn`` (step, s), from ``w0``."""
    ctes = []
    for e in range(epochs):
        rows = (
            f"SELECT step - {e * steps} AS step, s FROM drawn "
            f"WHERE step >= {e * steps} AND step < {(e + 1) * steps}"
        )
        ctes += inner(f"w{e + 1}", f"w{e}", f"w{e}", rows, 0.0)
    return ctes


DRAWN = """
drawn AS (SELECT p.step, s.s FROM picked p JOIN scaled s ON p.id = s.id)"""


def svrg_drawn(epochs: int, steps: int) -> str:
    ctes = [fx.ORDERS_SQL, SCALED, start(4), *draws(epochs * steps), DRAWN]
    return "WITH RECURSIVE " + ",".join(ctes + epochs_over(epochs, steps)) + MODEL + f"w{epochs}"


def sampled_centers(k: int, steps: int, x: str = "x") -> list[str]:
    """``means``: centers after ``steps`` rounds over half the points."""
    names = [f"c{i}" for i in range(steps)] + ["means"]
    limit = f"{math.ceil(0.5 * 2**52):013x}"
    rounds = [centers(k, SEED, names[0]), *[moved(a, b) for a, b in zip(names, names[1:])]]
    rounds = [c.replace("FROM pts", "FROM half") for c in rounds]
    return [f"""
half AS (SELECT id, {x} AS x, y FROM pts WHERE substr({key()}, 1, 13) < '{limit}')""",
        *[c.replace(" AS (", " AS MATERIALIZED (") for c in rounds],
    ]


def kmeans_of_sample(k: int, steps: int) -> str:
    return with_(fx.ORDERS_SQL, *sampled_centers(k, steps)) + f"""
SELECT cid, (j1 - 1)::int AS j, {r6("c")} AS c
FROM (SELECT cid, generate_subscripts(cx, 1) AS j1, unnest(cx) AS c FROM means)"""


def stratified(total: int) -> list[str]:
    """``picked``: draws by the clusters of label-scaled features."""
    scaled_x = "list_transform(x, lambda v: v * y)"
    d2 = D2.replace("p.x", f"list_transform(p.x, lambda v: v * p.y)")
    return [*sampled_centers(20, 30, scaled_x), f"""
strata AS MATERIALIZED (
  SELECT id, arg_min(cid, (d2, cid)) AS cid
  FROM (SELECT p.id, c.cid, {d2} AS d2 FROM pts p, means c) GROUP BY id)""",
        *draws(total, "strata", "cid"),
    ]


def svrg_stratified(epochs: int, steps: int) -> str:
    ctes = [fx.ORDERS_SQL, SCALED, start(4), *stratified(epochs * steps), DRAWN]
    return "WITH RECURSIVE " + ",".join(ctes + epochs_over(epochs, steps)) + MODEL + f"w{epochs}"


def svrg_epochs(epochs: int, steps: int) -> str:
    ctes = [fx.ORDERS_SQL, SCALED, W0, f"""
drawn AS (SELECT s, row_number() OVER (ORDER BY {key()}, id) - 1 AS step
          FROM (SELECT id, s FROM scaled ORDER BY {key()}, id LIMIT {epochs * steps}))"""]
    ctes += epochs_over(epochs, steps)
    return "WITH RECURSIVE " + ",".join(ctes) + MODEL + f"w{epochs}"


def block_ctes(rounds: int, blocks: int, rows_per_part: int, pull: float) -> list[str]:
    ctes = [fx.ORDERS_SQL, SCALED, W0, f"""
parted AS (SELECT id, s, {bits()} % ceil({M_SQL} / {rows_per_part}::double)::bigint AS part
           FROM scaled)""", f"""
first_part AS (SELECT s, row_number() OVER (ORDER BY id) - 1 AS slot,
                      count(*) OVER () // {blocks} AS size FROM parted WHERE part = 0)"""]
    for r in range(rounds):
        rows = (
            f"SELECT slot - {r} * size AS step, s FROM first_part "
            f"WHERE slot // size = {r}"
        )
        ctes += inner(f"w{r + 1}", "w0", f"w{r}", rows, pull)
    return ctes


def block_rounds(rounds: int, blocks: int, rows_per_part: int, pull: float) -> str:
    ctes = block_ctes(rounds, blocks, rows_per_part, pull)
    return "WITH RECURSIVE " + ",".join(ctes) + MODEL + f"w{rounds}"


def block_trace(rounds: int, blocks: int, rows_per_part: int, pull: float) -> str:
    ctes = block_ctes(rounds, blocks, rows_per_part, pull)
    models = [
        f"SELECT {r}::int AS round, j, w FROM ({MODEL} w{r + 1})" for r in range(rounds)
    ]
    return "WITH RECURSIVE " + ",".join(ctes) + " UNION ALL ".join(models)


ORACLES: dict[str, str] = {
    "dual_two_sweeps": levels([fx.ORDERS_SQL], split(PARTS), [PARTS], 2, False),
    "dual_two_sweeps_split": levels([fx.ORDERS_SQL], split(PARTS), [PARTS], 2, False),
    "dual_two_sweeps_local_scale": local_scale(PARTS, 2),
    "run_history": run_of("""
SELECT {level}::int AS level, count(*)::int AS n_parts, sum(n)::bigint AS n_rows,
       sum(support)::bigint AS n_support, max(n)::bigint AS max_part_rows
FROM (SELECT count(*) AS n, count(*) FILTER (zeta > 0 OR beta > 0) AS support
      FROM {rows} GROUP BY part)"""),
    "run_coefficients": run_of("""
SELECT {level}::int AS level, id, round(y * (zeta - beta), 9) + 0.0 AS coef
FROM {rows} JOIN pts USING (id) WHERE y * (zeta - beta) <> 0"""),
    "trace_sink": block_trace(2, 20, 100_000, 0.2),
    "weight_text_sink": recover(fx.ORDERS_SQL),
    "random_two_levels": levels([fx.ORDERS_SQL], split(81), [81, 27], 1, False),
    "cascade_four_levels": levels([fx.EMBEDDINGS_SQL], split(8), [8, 4, 2, 1], 2, True),
    "divide_conquer_three_levels": clustered_levels(2, 2),
    "stratified_cascade_two_levels": levels(
        [fx.ORDERS_SQL, *clusters("near", K, SEED), f"""
dealt AS (
  SELECT id, ((row_number() OVER (PARTITION BY cid ORDER BY id) - 1) % {PARTS})::int AS part
  FROM near)"""], "dealt", [PARTS, PARTS // 2], 1, True,
    ),
    "distribution_aware_two_levels": levels(strata(64), "dealt", [64, 32], 1, False),
    "svrg_epochs": svrg_epochs(3, 10),
    "fit_svrg": svrg_drawn(20, 10),
    "fit_svrg_stratified": svrg_stratified(30, 100),
    "sample_with_replacement": with_(fx.ORDERS_SQL, *draws(3000)) + "SELECT step, id FROM picked",
    "stratified_sample": with_(fx.ORDERS_SQL, *stratified(3000))
    + "SELECT step, id, st AS cid FROM picked",
    "random_start": "WITH n AS (SELECT any_value(len(embedding)) + 1 AS n FROM embeddings), "
    f"""w AS (SELECT unnest(range(n)) AS j FROM n)
SELECT j::int AS j, {r6(counted("start", "j") + f" / {2**52}::double")} AS w FROM w""",
    "kmeans": kmeans_of_sample(20, 30),
    "block_svrg_rounds": block_rounds(2, 20, 100_000, 0.2),
    "parse_points": with_(fx.ORDER_LINES_SQL) + f"""
SELECT {r6("x0")} AS x0, {r6("x1")} AS x1, {r6("x2")} AS x2, {r6("x3")} AS x3,
       label::int AS y
FROM raw WHERE label IN ('1', '-1')""",
    "rejected_lines": with_(fx.ORDER_LINES_SQL) + """
SELECT CASE WHEN label = 'none' THEN 'non-numeric field'
            ELSE 'label is not +1 or -1' END AS reason, count(*) AS n
FROM raw WHERE label NOT IN ('1', '-1') GROUP BY 1""",
    "dims_count": with_(fx.EMBEDDINGS_SQL) + """
SELECT count(*) AS m, min(len(x))::bigint AS n_min, max(len(x))::bigint AS n_max FROM pts""",
    "label_scaled": with_(fx.EMBEDDINGS_SQL) + f"""
SELECT id, (j1 - 1)::int AS j, {r6("v * y")} AS v
FROM (SELECT id, y, generate_subscripts(x, 1) AS j1, unnest(x) AS v FROM pts)""",
    "margin_bands": bands(fx.LINEITEM_SQL, 5),
    "margin_bands_documents": bands(fx.DOCUMENTS_SQL, 4),
    "sample_loss": with_(fx.ORDERS_SQL, scored(4)) + f"""
SELECT id, {r6(f"CASE WHEN s < {LOW} OR s > {HIGH} THEN ({LOSS}) + "
               f"{num(0.5 * sum(v * v for v in fx.weights(4)) ** 0.5)} "
               "ELSE 0::double END")} AS loss
FROM scored""",
    "sample_gradient": with_(fx.ORDERS_SQL, scored(4), f"""
long AS (SELECT id, generate_subscripts(x, 1) AS j1, unnest(x) AS v, y * ({SLOPE}) AS a
         FROM scored)""") + f"""
SELECT id, (j1 - 1)::int AS j, {r6(f"a * v + {vec(fx.weights(4))}[j1]")} AS g FROM long""",
    "full_gradient": gradient(fx.LINEITEM_SQL, 5),
    "full_gradient_wide": gradient(fx.EMBEDDINGS_SQL, 65),
    "gradient_at_zero": gradient(fx.LINEITEM_SQL, 5, [0.0] * 5),
    "batch_loss": with_(fx.LINEITEM_SQL, scored(5)) + f"""
SELECT {r6(f"sum({LOSS}) / {M_SQL}")} AS batch_loss FROM scored""",
    "objective": with_(fx.LINEITEM_SQL, scored(5)) + f"""
SELECT {r6(f"sum({LOSS}) / {M_SQL} + {num(0.5 * sum(v * v for v in fx.weights(5)))}")}
       AS objective FROM scored""",
    "assign_linear": assign(SCALED_ORDERS, "sqrt(d2)"),
    "assign_euclid": assign(fx.EMBEDDINGS_SQL, "sqrt(sqrt(d2))"),
    "assign_rbf": assign(fx.ORDERS_SQL, "sqrt(2 - 2 * exp(-(d2) / 2))"),
    "cluster_stats": with_(fx.ORDERS_SQL, centers(), ASSIGNED) + f"""
SELECT cid, (j1 - 1)::int AS j, {r6("sum(v)")} AS total, count(*) AS n
FROM (SELECT cid, generate_subscripts(x, 1) AS j1, unnest(x) AS v FROM near)
GROUP BY cid, j1""",
    "kmeans_step1": kmeans_steps(1),
    "kmeans_step2": kmeans_steps(2),
    "cluster_counts": with_(fx.ORDERS_SQL, centers(), ASSIGNED) + """
SELECT cid, count(*) AS n FROM near GROUP BY cid""",
    "quotas": with_(fx.ORDERS_SQL, centers(), ASSIGNED) + f"""
SELECT cid, count(*) AS n, ceil(count(*) * 3000 / {M_SQL}::double)::bigint AS quota
FROM near GROUP BY cid""",
    "landmark_first": with_(fx.ORDERS_SQL) + """
SELECT 0 AS pick, id FROM pts ORDER BY list_inner_product(x, x), id LIMIT 1""",
    "landmark_second": picks(2),
    "landmark_third": picks(3),
    "landmarks_rbf": greedy(fx.ORDERS_SQL, 10, lambda a, b: gauss(a, b, 1.0)),
    "landmarks_linear": greedy(fx.ORDERS_SQL, 4, linear),
    "landmarks_lower": greedy(fx.ORDERS_SQL, 20, linear, lower=True),
    "landmarks_of_sample": greedy(
        fx.EMBEDDINGS_SQL, 20, gauss, where=f"substr({key()}, 1, 13) < '{math.ceil(0.5 * 2**52):013x}'"
    ),
    "kernel_vectors_sigma": kernel_rows(fx.ORDERS_SQL, gauss("p.x", "c.cx")),
    "rbf_features": with_(*FEATURES) + """
SELECT id, (generate_subscripts(x, 1) - 1)::int AS j, round(unnest(x), 6) + 0.0 AS v FROM pts""",
    "rbf_dual_two_sweeps": levels(FEATURES, split(PARTS), [PARTS], 2, False),
    "landmark_scores": with_(fx.ORDERS_SQL, centers(2), f"""
a AS (SELECT cx FROM centers WHERE cid = 0),
b AS (SELECT cx FROM centers WHERE cid = 1),
kq AS (SELECT id, {rbf("x", "a.cx")} AS k1, {rbf("x", "b.cx")} AS k2,
              {rbf("a.cx", "b.cx")} AS q FROM pts, a, b)""") + f"""
SELECT id, {r6("(k1 * k1 - 2 * q * k1 * k2 + k2 * k2) / (1 - q * q)")} AS score FROM kq""",
    "kernel_vectors": kernel_rows(fx.ORDERS_SQL, rbf("p.x", "c.cx")),
    "linear_kernel_vectors": kernel_rows(
        fx.EMBEDDINGS_SQL, "list_inner_product(p.x, c.cx)"
    ),
    "md5_sample": with_(fx.ORDERS_SQL) + f"""
SELECT id, y FROM pts WHERE substr({key()}, 1, 13) < '{math.ceil(0.3 * 2**52):013x}'""",
    "first_k": with_(fx.ORDERS_SQL) + f"""
SELECT id, y FROM pts ORDER BY {key()}, id LIMIT 20""",
    "random_split": with_(fx.ORDERS_SQL, SPLIT) + "SELECT id, part FROM split",
    "global_index": with_(fx.ORDERS_SQL) + """
SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM pts""",
    "local_index": with_(fx.ORDERS_SQL, SPLIT, INDEXED) + """
SELECT id, part, slot FROM indexed""",
    "local_index_hot_key": with_(fx.ORDERS_SQL) + """
SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY id) - 1 AS slot FROM pts""",
    "local_index_null_key": with_(fx.ORDERS_SQL) + """
SELECT id, nullif(y, 1)::varchar AS key,
       row_number() OVER (PARTITION BY nullif(y, 1) ORDER BY id) - 1 AS slot FROM pts""",
    "text_round_trip": with_(fx.ORDERS_SQL) + f"""
SELECT count(*) AS n, count(*) - 1 AS last_id, count(*) AS ids, sum(y)::bigint AS labels,
       {r6("sum(x[1])")} AS x0, {r6("sum(x[2])")} AS x1, {r6("sum(x[3])")} AS x2,
       {r6("sum(x[4])")} AS x3, 0::bigint AS rejected
FROM pts""",
    "coefficient_sink": with_(fx.ORDERS_SQL, fx.DUALS_SQL) + f"""
SELECT id, {r6("y * (zeta - beta)")} AS coef FROM duals WHERE y * (zeta - beta) <> 0""",
    "stratified_deal": dealt("0"),
    "stratified_deal_rotated": dealt("cid"),
    "merge_deal": with_(fx.ORDERS_SQL, SPLIT, INDEXED) + f"""
SELECT id, (slot % {PARTS // 2})::int AS part FROM indexed""",
    "merge_deal_pairwise": with_(fx.ORDERS_SQL, SPLIT) + f"""
SELECT id, (part % {PARTS // 2})::int AS part FROM split""",
    "part_sizes": with_(fx.ORDERS_SQL, SPLIT) + """
SELECT part, count(*) AS n, count(DISTINCT part) AS n_parts FROM split GROUP BY part""",
    "signed_coef": with_(fx.ORDERS_SQL, fx.DUALS_SQL) + f"""
SELECT id, {r6("y * (zeta - beta)")} AS coef FROM duals WHERE y * (zeta - beta) <> 0""",
    "support_filter": with_(fx.ORDERS_SQL, fx.DUALS_SQL) + f"""
SELECT id, {r6("zeta")} AS zeta, {r6("beta")} AS beta FROM duals WHERE zeta + beta > 0""",
    "recover_w": recover(fx.ORDERS_SQL),
    "recover_w_wide": recover(fx.EMBEDDINGS_SQL),
    "first_coordinate": with_(fx.ORDERS_SQL) + f"""
SELECT id, {r6(f"greatest({LOW} / (list_inner_product(x, x) + {M_SQL} * {D} / {2 * LAM}), 0)")}
       AS zeta FROM pts""",
    # the matrix entry by entry: every pair of rows of a part
    "gram_product": with_(fx.ORDERS_SQL, fx.DUALS_SQL, SPLIT.replace("pts", "duals")) + f"""
SELECT a.id, a.part, {r6("any_value(list_inner_product(a.x, a.x))")} AS diagonal,
       {r6("sum(a.y * b.y * list_inner_product(a.x, b.x) * (b.zeta - b.beta))")} AS product
FROM split a JOIN split b ON a.part = b.part GROUP BY a.id, a.part""",
    # zero violation certifies the unique optimum of a strictly convex problem
    "split_part_optimality": with_(fx.ORDERS_SQL) + f"""
SELECT ({bits()} % 3)::int AS part, count(*) AS n, 0::double AS violation
FROM pts GROUP BY 1""",
}
