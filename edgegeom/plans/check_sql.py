"""Check SQL: what each registered query must return, from set definitions over the same tables.

The statements follow the definitions directly and share no formula code with the operators. The
transport values come from the dual problem: the largest saving equals the cheapest integer price
assignment, and prices 0, 1, 2 on the few nodes that save anything are tried in full.
"""

from __future__ import annotations

import math

SEED = 11

CO_ORDER = """
e AS (
  SELECT DISTINCT 'co_order' AS graph_id, a.l_partkey AS u, b.l_partkey AS v
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"""

BY_FLAG = """
e AS (
  SELECT DISTINCT 'flag_' || a.l_returnflag AS graph_id, a.l_partkey AS u, b.l_partkey AS v
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
   AND a.l_returnflag = b.l_returnflag)"""

BY_LOT = """
e AS (
  SELECT DISTINCT 'flag_' || a.l_returnflag || '_' || ceil(a.l_quantity / 10)::INT AS graph_id, a.l_partkey AS u, b.l_partkey AS v
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
   AND a.l_returnflag = b.l_returnflag AND ceil(a.l_quantity / 10) = ceil(b.l_quantity / 10))"""

LATER_LOTS = BY_LOT.replace("lineitem", "(SELECT * FROM lineitem WHERE l_shipdate >="
                            " (SELECT date_trunc('month', min(l_shipdate)) + INTERVAL 1 MONTH FROM lineitem))")

STRUCTURE = """,
adj AS MATERIALIZED (
  SELECT graph_id AS g, u AS s, v AS d FROM e UNION ALL SELECT graph_id, v, u FROM e),
deg AS MATERIALIZED (SELECT g, s, count(*) AS k FROM adj GROUP BY ALL),
ed AS MATERIALIZED (
  SELECT e.graph_id, e.u, e.v, a.k AS du, b.k AS dv
  FROM e JOIN deg a ON a.g = e.graph_id AND a.s = e.u
         JOIN deg b ON b.g = e.graph_id AND b.s = e.v),
tri AS (
  SELECT e.graph_id, e.u, e.v, count(*) AS n_tri
  FROM e JOIN adj a ON a.g = e.graph_id AND a.s = e.u
         JOIN adj b ON b.g = e.graph_id AND b.s = e.v AND b.d = a.d GROUP BY ALL),
quad AS (
  SELECT e.graph_id, e.u, e.v, a.d AS k, b.d AS w, (x.d IS NULL AND y.d IS NULL) AS excl
  FROM e JOIN adj a ON a.g = e.graph_id AND a.s = e.u AND a.d <> e.v
         JOIN adj c ON c.g = e.graph_id AND c.s = a.d
         JOIN adj b ON b.g = e.graph_id AND b.s = e.v AND b.d = c.d AND b.d <> e.u
         LEFT JOIN adj x ON x.g = e.graph_id AND x.s = e.v AND x.d = a.d
         LEFT JOIN adj y ON y.g = e.graph_id AND y.s = e.u AND y.d = b.d),
touch AS (
  SELECT graph_id, u, v, 0 AS side, k AS node, count(*) AS c, max(excl::INT) AS open FROM quad GROUP BY ALL
  UNION ALL
  SELECT graph_id, u, v, 1, w, count(*), max(excl::INT) FROM quad GROUP BY ALL),
qn AS (
  SELECT graph_id, u, v, sum(open)::BIGINT AS n_quad, max(c) AS codeg_max FROM touch GROUP BY ALL),
loc AS MATERIALIZED (
  SELECT ed.*, coalesce(n_tri, 0) AS t, coalesce(n_quad, 0) AS x, coalesce(codeg_max, 0) AS cg,
         coalesce(codeg_max, 0) * greatest(du, dv) AS cap,
         least(du, dv) AS m, greatest(du, dv) AS mm
  FROM ed LEFT JOIN tri USING (graph_id, u, v) LEFT JOIN qn USING (graph_id, u, v)),
base AS MATERIALIZED (
  SELECT *, CASE WHEN m <= 1 THEN 0.0 ELSE 2.0/du + 2.0/dv - 2 + (2.0/mm + 1.0/m) * t + c4 END AS bf,
         2.0/du + 2.0/dv - 2 AS cs, 2.0/mm + 1.0/m AS ct, 1 - 1.0/m - 1.0/mm AS ck,
         1.0/(du+1) AS au, 1.0/(dv+1) AS av, abs(1.0/(du+1) - 1.0/(dv+1)) AS gap,
         -1 + 4.0 * least(1.0/(du+1), 1.0/(dv+1)) + 2 * abs(1.0/(du+1) - 1.0/(dv+1))
           + (du + dv - 2.0) / (du + dv + 2) AS env_const,
         1.0/(du+1) + 1.0/(dv+1) - 2.0/(du + dv + 2) AS env_slope
  FROM (SELECT *, CASE WHEN x > 0 AND cap > 0 THEN x::DOUBLE / cap ELSE 0.0 END AS c4 FROM loc))"""

TRANSPORT = """,
ab AS MATERIALIZED (
  SELECT graph_id, u, v, t, CASE WHEN du < dv THEN v ELSE u END AS a,
         CASE WHEN du < dv THEN u ELSE v END AS b, mm AS da, m AS db FROM loc),
near AS MATERIALIZED (
  SELECT g, p, q, min(h) AS h FROM (
    SELECT g, s AS p, d AS q, 1 AS h FROM adj
    UNION ALL
    SELECT x.g, x.d, y.d, 2 FROM adj x JOIN adj y ON x.g = y.g AND x.s = y.s AND x.d <> y.d)
  GROUP BY ALL),
lefts AS (
  SELECT ab.*, n.d AS l FROM ab JOIN adj n ON n.g = ab.graph_id AND n.s = ab.a AND n.d <> ab.b
    LEFT JOIN adj z ON z.g = ab.graph_id AND z.s = ab.b AND z.d = n.d WHERE z.d IS NULL),
rights AS (
  SELECT ab.graph_id, ab.u, ab.v, n.d AS r, z.d IS NOT NULL AS common
  FROM ab JOIN adj n ON n.g = ab.graph_id AND n.s = ab.b AND n.d <> ab.a
    LEFT JOIN adj z ON z.g = ab.graph_id AND z.s = ab.a AND z.d = n.d),
cell AS MATERIALIZED (
  SELECT l.graph_id, l.u, l.v, l.l, r.r, r.common,
         (CASE WHEN r.common THEN 2 ELSE 3 END) - near.h AS s
  FROM lefts l JOIN rights r USING (graph_id, u, v)
    JOIN near ON near.g = l.graph_id AND near.p = l.l AND near.q = r.r
  WHERE (CASE WHEN r.common THEN 2 ELSE 3 END) > near.h AND (NOT r.common OR l.da > l.db)),
met AS MATERIALIZED (
  SELECT graph_id, u, v, r, common, row_number() OVER (PARTITION BY graph_id, u, v ORDER BY r) - 1 AS i
  FROM (SELECT DISTINCT graph_id, u, v, r, common FROM cell)),
cnt AS (SELECT graph_id, u, v, count(*) AS nr, count(*) FILTER (NOT common) AS nu,
               count(*) FILTER (common) AS nc FROM met GROUP BY ALL),
trial AS (
  SELECT ab.*, coalesce(nu, 0) AS nu, coalesce(nc, 0) AS nc, pb,
         unnest(generate_series(0, (3 ** coalesce(nr, 0))::BIGINT - 1)) AS code
  FROM ab LEFT JOIN cnt USING (graph_id, u, v), (SELECT unnest([0, 1, 2]) AS pb)),
price AS MATERIALIZED (
  SELECT trial.graph_id, trial.u, trial.v, code, pb, r, common,
         (code // (3 ** i)::BIGINT) % 3 AS q, da, db
  FROM trial JOIN met USING (graph_id, u, v)),
left_price AS (
  SELECT graph_id, u, v, code, pb, sum(p_lazy)::BIGINT AS p_lazy, sum(p_plain)::BIGINT AS p_plain FROM (
    SELECT c.graph_id, c.u, c.v, code, pb, c.l, greatest(0, max(c.s - q)) AS p_lazy,
           greatest(0, max(c.s - greatest(q, CASE WHEN c.common THEN 1 - pb ELSE 2 - pb END))) AS p_plain
    FROM cell c JOIN price USING (graph_id, u, v, r) GROUP BY ALL) GROUP BY ALL),
right_price AS (
  SELECT graph_id, u, v, code, pb,
         sum(q * CASE WHEN common THEN da - db ELSE da + 1 END)::BIGINT AS r_lazy,
         sum(greatest(q, CASE WHEN common THEN 1 - pb ELSE 2 - pb END)
             * CASE WHEN common THEN da - db ELSE da END)::BIGINT AS r_plain
  FROM price GROUP BY ALL),
saved AS (
  SELECT graph_id, u, v,
         min(coalesce(r_lazy, 0) + (db + 1) * coalesce(p_lazy, 0)) AS s_lazy,
         min(coalesce(r_plain, 0) + db * coalesce(p_plain, 0) + db * pb
             + (db - 1 - t - nu) * da * (2 - pb)
             + (t - nc) * (da - db) * greatest(0, 1 - pb)) AS s_plain
  FROM trial LEFT JOIN left_price USING (graph_id, u, v, code, pb)
    LEFT JOIN right_price USING (graph_id, u, v, code, pb) GROUP BY ALL),
cur AS MATERIALIZED (
  SELECT base.*,
    1 - ((da-db)*(2*t+3) + (db-1-t)*(da+1)*3 - s_lazy)::DOUBLE / ((da+1)*(db+1)) AS or_lazy,
    1 - (da + (da-db)*t*2 + (db-1-t)*da*3 - s_plain)::DOUBLE / (da*db) AS or_plain
  FROM base JOIN (SELECT ab.*, s_lazy, s_plain FROM ab JOIN saved USING (graph_id, u, v)) USING (graph_id, u, v, t))"""


def lazy_lower(z: str, sharp: bool) -> str:
    keep = ("CASE WHEN or_plain >= 0 THEN least(au, av) ELSE greatest(au, av) END"
            if sharp else "least(au, av)")
    need = f"greatest(0.0, ({z} - cs - c4) / ct)"
    floor = f"(0.5 * greatest(c4, greatest(0.0, {z} - cs - ct * (m - 1))))"
    return (f"((1 - {keep}) * (-greatest(0.0, ck - {need}/mm - {floor})"
            f" - greatest(0.0, ck - {need}/m - {floor}) + {need}/mm) - gap)")


def lazy_upper(z: str) -> str:
    b = f"greatest(0.0, {z} - cs)"
    sg = "(du + dv + 2.0)"
    eta = f"(mm * (mm - 1.0) / {sg})"
    tmax = f"least(m - 1.0, {b} / ct)"

    def ratio(num: str, den: str) -> str:
        return f"CASE WHEN abs({den}) > 1e-15 THEN ({num}) / nullif({den}, 0) END"

    points = [
        "0.0::DOUBLE", tmax,
        ratio(f"{eta}*{b} - au*(du-1)", f"({eta}*ct - au)"),
        ratio(f"{eta}*{b} - av*(dv-1)", f"({eta}*ct - av)"),
        ratio("av*(dv-1) - au*(du-1)", "(av - au)"),
        ratio("au*(du-1) + av*(dv-1)", "(au + av + gap)"),
        ratio(f"(du+dv-2)/{sg} - au*(du-1)", f"(2/{sg} - au)"),
        ratio(f"(du+dv-2)/{sg} - av*(dv-1)", f"(2/{sg} - av)"),
        ratio(f"(du+dv-2.0) - mm*(mm-1.0)*{b}", "(2 - mm*(mm-1.0)*ct)"),
    ]
    t = f"greatest(0.0, least({tmax}, p))"
    value = (f"(-1 + 4*least(au, av) + 2*gap + 2*{t}*least(au, av) + greatest(0.0, least("
             f"(du-1-{t})*au, (dv-1-{t})*av, {eta}*({b} - ct*{t}), ((du+dv-2.0) - 2*{t})/{sg}))"
             f" + least({t}*gap, (du-1-{t})*au + (dv-1-{t})*av))")
    filtered = f"list_filter([{', '.join(points)}], lambda p: p IS NOT NULL)"
    return f"list_max(list_transform({filtered}, lambda p: {value}))"


def forman_lower(th: str) -> str:
    need = f"least(greatest(0.0, ({th} - env_const) / env_slope), m - 1.0)"
    return (f"(CASE WHEN m <= 1 THEN 0.0 WHEN {th} > env_const + env_slope*t + 1e-12 OR env_slope <= 1e-12"
            f" THEN cs + ct*t ELSE cs + ct * least({need}, t) END)")


def inverse(level: str, floor: str) -> str:
    k = f"greatest(0.0, ck - greatest(0.0, {floor}))"
    return (f"greatest(0.0, least(m - 1.0, greatest(({level} + 2*{k}) / (2.0/mm + 1.0/m),"
            f" ({level} + {k}) * mm / 2.0, {level} * mm)))")


def forman_upper(th: str, sharp: bool) -> str:
    keep = ("CASE WHEN or_plain >= 0 THEN least(au, av) ELSE greatest(au, av) END"
            if sharp else "least(au, av)")
    level = f"(({th} + gap) / (1 - {keep}))"
    return f"(cs + ct * {inverse(level, '0.5*c4')} + c4)"


REPORT = f""",
rep AS MATERIALIZED (
  SELECT *, env_const + env_slope * t AS env_at_tri,
    -1 + 4*least(au, av) + 2*gap + 2*t*least(au, av)
      + greatest(0.0, least((du-1-t)*au, (dv-1-t)*av, x::DOUBLE/(du+dv+2)))
      + least(t*gap, (du-1-t)*au + (dv-1-t)*av) AS env_transport,
    {lazy_lower('bf', True)} AS or_lo, {lazy_upper('bf')} AS or_hi,
    {forman_lower('or_lazy')} AS bf_lo, {forman_upper('or_lazy', True)} AS bf_hi
  FROM cur)"""


def r(x: str, name: str) -> str:
    """Six digits, on a grid shifted by 3e-8 so that exact halves cannot fall either way."""
    return f"round(({x})::DOUBLE + 3e-8, 6) + 0.0 AS {name}"


def stats(group: str, x: str = "value") -> str:
    points = [("q05", 0.05), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("q95", 0.95)]
    return ", ".join([
        f"count({x}) AS count", r(f"avg({x})", "mean"), r(f"stddev_pop({x})", "std"),
        r(f"min({x})", "min"), *[r(f"quantile_cont({x}, {p})", n) for n, p in points],
        r(f"max({x})", "max"),
    ])


def graph(select: str, source: str = BY_LOT, upto: str = "structure", extra: str = "") -> str:
    parts = source
    if upto in ("structure", "transport", "report"):
        parts += STRUCTURE
    if upto in ("transport", "report"):
        parts += TRANSPORT
    if upto == "report":
        parts += REPORT
    return f"WITH {parts}{extra}\n{select}"


KEY = "graph_id, u, v"


def per_edge(columns: list[str], table: str = "base", **kw) -> str:
    return graph(f"SELECT {KEY}, {', '.join(columns)} FROM {table}", **kw)


def unpivot(columns: dict[str, str], table: str, digits: int | None = None) -> str:
    def value(x: str) -> str:
        return f"({x})::DOUBLE" if digits is None else f"round(({x})::DOUBLE, {digits}) + 0.0"

    return " UNION ALL ".join(
        f"SELECT graph_id, '{name}' AS metric, {value(x)} AS value FROM {table}"
        for name, x in columns.items())


def draw(*parts: str) -> str:
    return (f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT"
            f"::DOUBLE / 4503599627370496.0)")


NODES = "p AS (SELECT 'parts' AS g, p_partkey AS id, count(*) OVER () AS n FROM part)"


def links(*targets: str, where: str = "TRUE") -> str:
    arms = " UNION ALL ".join(f"SELECT id AS s, {t} AS d FROM p WHERE {where}" for t in targets)
    return (f"WITH {NODES} SELECT DISTINCT 'parts' AS graph_id, least(s, d) AS u, greatest(s, d) AS v"
            f" FROM ({arms}) WHERE d IS NOT NULL AND s <> d")


ARCS = """arcs AS (
  SELECT (l_orderkey * 8 + l_linenumber) * 1000000000 + round(l_extendedprice * 100)::BIGINT AS pos,
         l_suppkey AS s, l_partkey AS d, l_extendedprice AS x FROM lineitem)"""

SHARES = """
lines AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, sum(l_quantity) AS q,
                 sum(round(l_extendedprice * 100)) AS e FROM lineitem GROUP BY ALL),
shares AS (SELECT l_orderkey, line, q / sum(q) OVER w AS sq, e / sum(e) OVER w AS se
           FROM lines WINDOW w AS (PARTITION BY l_orderkey))"""


def cost(lazy: bool) -> str:
    own = "" if not lazy else " UNION ALL SELECT graph_id, u, v, {end} FROM e"
    return graph(f"""
SELECT l.graph_id, l.u, l.v, l.n AS a, r.n AS b,
       (CASE WHEN l.n = r.n THEN 0 ELSE coalesce(h, 3) END)::INT AS d
FROM (SELECT e.graph_id, e.u, e.v, d AS n FROM e JOIN adj ON g = e.graph_id AND s = e.u{own.format(end='u')}) l
JOIN (SELECT e.graph_id, e.u, e.v, d AS n FROM e JOIN adj ON g = e.graph_id AND s = e.v{own.format(end='v')}) r
  USING (graph_id, u, v)
LEFT JOIN near ON near.g = l.graph_id AND near.p = l.n AND near.q = r.n""", upto="transport")


def bins(x: str, metric_sql: str, n: int, source: str, upto: str, density: bool) -> str:
    value = r("coalesce(c, 0) / (n * w)", "density") if density else (
        f"{r('lo + bin * w', 'left')}, {r('lo + bin * w + w', 'right')}, coalesce(c, 0) AS count")
    return graph(f"""
SELECT graph_id, metric, bin, {value} FROM slots LEFT JOIN held USING (graph_id, metric, bin)""",
        source=source, upto=upto, extra=f""",
vals AS ({metric_sql}),
rng AS (SELECT graph_id, metric, n, lo, (hi - lo) / {n} AS w FROM (
  SELECT graph_id, metric, count(*) AS n, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
         CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM vals GROUP BY ALL)),
slots AS (SELECT *, unnest(generate_series(0, {n - 1}))::INT AS bin FROM rng),
held AS (SELECT graph_id, metric, least({n - 1},
    len(list_filter(generate_series(0, {n}), lambda k: lo + k * w <= value)) - 1)::INT AS bin, count(*) AS c
  FROM vals JOIN rng USING (graph_id, metric) GROUP BY ALL)""")


def binned(x: str, series: dict[str, str], table: str, source: str, upto: str, n: int = 28) -> str:
    arms = " UNION ALL ".join(
        f"SELECT graph_id, '{k}' AS series, round(({x})::DOUBLE, 9) + 0.0 AS x, ({y})::DOUBLE AS y FROM {table}"
        for k, y in series.items())
    quant = ", ".join(
        r(f"coalesce(quantile_cont(y, {p}), 'nan'::DOUBLE)", name)
        for name, p in (("q_low", 0.1), ("q_mid", 0.5), ("q_high", 0.9)))
    return graph(f"""
SELECT graph_id, series, bin, {r('any_value(lo + (bin + 0.5) * w)', 'center')}, {quant}
FROM slots LEFT JOIN (SELECT graph_id, series, y, least(nb - 1,
    len(list_filter(generate_series(0, nb), lambda k: lo + k * w <= x)) - 1)::INT AS bin
  FROM vals JOIN rng USING (graph_id, series)) USING (graph_id, series, bin)
GROUP BY graph_id, series, bin""", source=source, upto=upto, extra=f""",
vals AS ({arms}),
rng AS (SELECT graph_id, series, min(x) AS lo, CASE WHEN min(x) = max(x) THEN 1 ELSE {n} END AS nb,
        CASE WHEN min(x) = max(x) THEN 1e-6 ELSE (max(x) - min(x)) / {n} END AS w FROM vals GROUP BY ALL),
slots AS (SELECT *, unnest(generate_series(0, nb - 1))::INT AS bin FROM rng)""")


RUN = {"or_lazy": "or_lazy", "bf": "bf", "env_slack": "env_transport - or_lazy",
       "theta_slack": "env_at_tri - or_lazy", "n_tri": "t", "n_quad": "x"}

COVER = """
  avg((or_lazy >= or_lo - 1e-9 AND or_lazy <= or_hi + 1e-9)::INT) AS or_in_band,
  avg((bf >= bf_lo - 1e-9 AND bf <= bf_hi + 1e-9)::INT) AS bf_in_band,
  avg((or_lazy <= env_transport + 1e-9)::INT) AS below_transport,
  avg((or_lazy <= env_at_tri + 1e-9)::INT) AS below_linear"""
WIDTH = " avg(or_hi - or_lo) AS or_width, avg(bf_hi - bf_lo) AS bf_width"
COVER_NAMES = ["or_in_band", "bf_in_band", "below_transport", "below_linear"]
WIDTH_NAMES = ["or_width", "bf_width"]

ENV_PARTS = [
    r("-1 + 4*least(au, av) + 2*gap + 2*t*least(au, av) + qp + tp", "upper"),
    r("least(au, av)", "shared_u"), r("least(au, av)", "shared_v"),
    r("greatest(0.0, au - av)", "excess_u"), r("greatest(0.0, av - au)", "excess_u_rev"),
    r("greatest(0.0, av - au)", "excess_v"), r("greatest(0.0, au - av)", "excess_v_rev"),
    r("qp", "quad_part"), r("tp", "tri_part"), r("du + dv + 2", "scale"),
    r("au", "mass_u"), r("av", "mass_v"),
]

BIN_RULES = """,
base9 AS (SELECT graph_id, round(bf, 9) + 0.0 AS bf FROM base),
b AS (SELECT graph_id, count(*) AS n, min(bf) AS lo, max(bf) AS hi, max(bf) - min(bf) AS sp, stddev_pop(bf) AS sd,
        quantile_cont(bf, 0.75) - quantile_cont(bf, 0.25) AS iqr, avg(bf) AS mu FROM base9 GROUP BY ALL),
k AS (SELECT b.*, (SELECT avg(((bf - mu) / sd) ** 3) FROM base9 WHERE base9.graph_id = b.graph_id) AS g1 FROM b),
w AS (
  SELECT graph_id, 'sqrt' AS rule, sp, sp / sqrt(n) AS w FROM k
  UNION ALL SELECT graph_id, 'sturges', sp, sp / (log2(n) + 1) FROM k
  UNION ALL SELECT graph_id, 'rice', sp, sp / (2 * n ** (1.0/3)) FROM k
  UNION ALL SELECT graph_id, 'scott', sp, sd * (24 * sqrt(pi()) / n) ** (1.0/3) FROM k
  UNION ALL SELECT graph_id, 'fd', sp, 2 * iqr / n ** (1.0/3) FROM k
  UNION ALL SELECT graph_id, 'doane', sp, sp / (1 + log2(n) + log2(1 + abs(g1) / sqrt(6.0*(n-2)/((n+1.0)*(n+3))))) FROM k
  UNION ALL SELECT graph_id, 'auto', sp, least(greatest(2 * iqr / n ** (1.0/3), sp / sqrt(n) / 2), sp / (log2(n) + 1)) FROM k),
tried AS (SELECT b.graph_id, n, lo, sp, unnest(generate_series(1, greatest(100, floor(sqrt(n))::BIGINT))) AS nb FROM b),
val AS (SELECT graph_id, bf, count(*) AS c FROM base9 GROUP BY ALL),
held AS (SELECT graph_id, n, sp, nb, sum(c) AS h
  FROM (SELECT t.graph_id, n, sp, nb, c, least(nb - 1, floor((bf - lo) / (sp / nb))
      - (bf < lo + floor((bf - lo) / (sp / nb)) * (sp / nb))::INT
      + (bf >= lo + (floor((bf - lo) / (sp / nb)) + 1) * (sp / nb))::INT) AS bin
    FROM tried t JOIN val USING (graph_id)) GROUP BY graph_id, n, sp, nb, bin),
loss AS (SELECT graph_id, nb, (2 - (n + 1) * sum((h::DOUBLE/n) ** 2)) * nb / sp AS j FROM held GROUP BY graph_id, n, sp, nb)"""

# The preset rows the suite queries start from, without grids and random graphs.
PRESET_SMALL = [("ws", 400), ("ws", 400), ("ba", 400), ("ba", 400), ("rg", 400), ("cycle", 200),
                ("tree", 3), ("complete", 60)]
PRESET_PAPER_TAGS = [
    ("hrg", "hrg_n800_R5.0_a1.0_T0.0"), ("hrg", "hrg_n800_R5.0_a1.0_T0.5"),
    ("ws", "ws_n800_k10_b0.05"), ("ws", "ws_n800_k10_b0.2"), ("ws", "ws_n1600_k10_b0.05"),
    ("ws", "ws_n1600_k10_b0.2"), ("ba", "ba_n800_m2"), ("ba", "ba_n800_m5"), ("ba", "ba_n1600_m2"),
    ("ba", "ba_n1600_m5"), ("rg", "rg_n800_r0.056419"), ("rg", "rg_n1600_r0.039894"),
    ("rreg", "rreg_n1000_d8"), ("rreg", "rreg_n2000_d8"),
    ("sbm2", "sbm2_n1000_pin0.012018_pout0.004006"), ("sbm2", "sbm2_n1000_pin0.004002_pout0.012006"),
    ("cycle", "cycle_n600"), ("torus", "torus_32x32"), ("torus", "torus_40x40"), ("tree", "tree_d4_h6"),
    ("complete", "complete_n120"),
]
PAPER_NAMES = [
    r"HRG $n=800$, $R=5.0$, $\alpha=1.0$, $T=0.0$", r"HRG $n=800$, $R=5.0$, $\alpha=1.0$, $T=0.5$",
    r"WS $n=800$, $k=10$, $\beta=0.05$", r"WS $n=800$, $k=10$, $\beta=0.2$",
    r"WS $n=1600$, $k=10$, $\beta=0.05$", r"WS $n=1600$, $k=10$, $\beta=0.2$",
    "BA $n=800$, $m=2$", "BA $n=800$, $m=5$", "BA $n=1600$, $m=2$", "BA $n=1600$, $m=5$",
    "RG $n=800$, $r=0.056419$", "RG $n=1600$, $r=0.039894$",
    "d-Reg $n=1000$, $d=8$", "d-Reg $n=2000$, $d=8$",
    r"SBM2 $n=1000$, $p_{\mathrm{in}}=0.012018$, $p_{\mathrm{out}}=0.004006$",
    r"SBM2 $n=1000$, $p_{\mathrm{in}}=0.004002$, $p_{\mathrm{out}}=0.012006$",
    "Cycle $C_{600}$", r"Torus $C_{32}\times C_{32}$", r"Torus $C_{40}\times C_{40}$",
    "4-ary Tree ($h=6$)", "Complete $K_{120}$",
]
CHOSEN = """chosen AS (
  SELECT DISTINCT 'grid' AS family, p_size::BIGINT AS a, (p_partkey % 7 + 2)::DOUBLE AS b FROM part
  UNION ALL SELECT DISTINCT 'er', p_partkey + 10, (p_partkey % 90 + 10) / 10000.0::DOUBLE FROM part)"""


def values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) if not isinstance(x, str) else "'" + x + "'" for x in row) + ")"
                     for row in rows)


ALL = {"source": CO_ORDER}
FLAG = {"source": BY_FLAG}
FULL = {"upto": "report"}
REPORT_COLUMNS = [
    "du AS deg_u", "dv AS deg_v", "t AS n_tri", "x AS n_quad", "cap AS quad_cap", r("c4", "quad_term"),
    *[r(c, c) for c in ("bf", "or_lazy", "or_plain", "env_const", "env_slope", "env_at_tri",
                        "env_transport", "or_lo", "or_hi", "bf_lo", "bf_hi")],
]

CHECKS = {
    "edge_report": per_edge(REPORT_COLUMNS, "rep", **FULL),
    "scan_edge_csv": """
SELECT DISTINCT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v
FROM lineitem WHERE l_linenumber IN (1, 2, 4) AND l_partkey <> l_suppkey""",
    "node_count": graph("SELECT graph_id, 1 + max(v) AS n FROM e GROUP BY ALL", **FLAG, upto="e"),
    "pairs_to_arcs": graph(
        "SELECT graph_id, u AS src, v AS dst FROM e UNION ALL SELECT graph_id, v, u FROM e", **ALL, upto="e"),
    "report_parquet": per_edge(
        ["t AS n_tri", "x AS n_quad", r("bf", "bf"), r("or_lazy", "or_lazy"), r("or_plain", "or_plain")],
        "cur", upto="transport"),
    "report_csv": per_edge(["du AS deg_u", "dv AS deg_v", "t AS n_tri", "x AS n_quad",
                            "cap AS quad_cap", r("bf", "bf")], **FLAG),
    "report_for_tag": graph(
        f"SELECT {KEY}, {r('bf', 'bf')} FROM base WHERE graph_id = (SELECT min(graph_id) FROM e)", **FLAG),
    "graph_sizes": graph(
        "SELECT graph_id, 1 + max(v) AS n, count(*) AS m FROM e GROUP BY ALL", **FLAG, upto="e"),
    "stray_reports": graph("""SELECT graph_id, 1 + max(v) AS n, count(*) AS m FROM e
WHERE graph_id <> (SELECT min(graph_id) FROM e) GROUP BY ALL""", **FLAG, upto="e"),
    "summary_json": graph(
        f"SELECT graph_id, metric, {stats('metric')} FROM ("
        + unpivot({"deg_u": "du", "deg_v": "dv"}, "ed") + ") GROUP BY graph_id, metric", **FLAG),
    "manifest_round_trip": graph(
        f"""SELECT graph_id AS tag, n, m, metric, {stats('metric')}
FROM ({unpivot(RUN, 'rep')}) JOIN (SELECT graph_id, 1 + max(v) AS n, count(*) AS m FROM e GROUP BY ALL)
USING (graph_id) GROUP BY graph_id, n, m, metric""", **FULL),
    "cycle": links("(id + 1) % n"),
    "grid": links("CASE WHEN id % 20 < 19 AND id + 1 < n THEN id + 1 END",
                  "CASE WHEN id + 20 < n THEN id + 20 END"),
    "torus": links("CASE WHEN id // 20 * 20 + (id + 1) % 20 < n THEN id // 20 * 20 + (id + 1) % 20 END",
                   "CASE WHEN (id // 20 + 1) % ((n + 19) // 20) * 20 + id % 20 < n"
                   " THEN (id // 20 + 1) % ((n + 19) // 20) * 20 + id % 20 END"),
    "tree": links("CASE WHEN id > 0 THEN (id - 1) // 3 END"),
    "complete": f"""WITH {NODES}
SELECT 'block_' || (a.id // 16) AS graph_id, a.id % 16 AS u, b.id % 16 AS v
FROM p a JOIN p b ON a.id // 16 = b.id // 16 AND a.id < b.id""",
    "radius_graph": f"""WITH {NODES},
pts AS (SELECT *, {draw(str(SEED), "'x'", 'g', 'id')} AS x, {draw(str(SEED), "'y'", 'g', 'id')} AS y FROM p)
SELECT 'parts' AS graph_id, a.id AS u, b.id AS v FROM pts a JOIN pts b ON a.id < b.id
WHERE (a.x-b.x)**2 + (a.y-b.y)**2 < 8.0::DOUBLE / (a.n * {math.pi!r})""",
    "canonical_edges": f"""WITH {ARCS}
SELECT DISTINCT 'supply' AS graph_id, least(s, d) AS u, greatest(s, d) AS v FROM arcs WHERE s <> d""",
    "neighbor_lists": graph(
        "SELECT g AS graph_id, s, string_agg(d::VARCHAR, ',' ORDER BY d) AS ns FROM adj GROUP BY ALL", **ALL),
    "degrees": graph("SELECT g AS graph_id, s, k FROM deg", **ALL),
    "arc_values": f"""WITH {ARCS}
SELECT 'supply' AS graph_id, least(s, d) AS u, greatest(s, d) AS v, {r('avg(x)', 'v_mean')},
  {r('sum(x)', 'v_sum')}, {r('min(x)', 'v_min')}, {r('max(x)', 'v_max')},
  {r('arg_min(x, pos)', 'v_first')} FROM arcs WHERE s <> d GROUP BY ALL""",
    "edgewise_threshold": per_edge(
        ["du AS deg_u", "dv AS deg_v", "0.25::DOUBLE AS zeta", r("u::DOUBLE / (v + 1)", "theta")], "ed", **ALL),
    "bounded_distances": graph("""
SELECT graph_id, source, dist, count(*) AS nodes, sum(node)::BIGINT AS node_sum FROM (
  SELECT graph_id, source, node, min(dist)::INT AS dist FROM (
    SELECT g AS graph_id, s AS source, s AS node, 0 AS dist FROM deg
    UNION ALL SELECT g, s, d, 1 FROM adj
    UNION ALL SELECT a.g, a.s, b.d, 2 FROM adj a JOIN adj b ON a.g = b.g AND a.d = b.s
    UNION ALL SELECT a.g, a.s, c.d, 3 FROM adj a JOIN adj b ON a.g = b.g AND a.d = b.s
      JOIN adj c ON c.g = b.g AND c.s = b.d) GROUP BY ALL) GROUP BY ALL""", **FLAG),
    "set_distances": graph("""
SELECT g AS graph_id, source, node, coalesce(min(dist), 10)::INT AS dist FROM (
  SELECT DISTINCT 'flag_' || l_returnflag AS g, l_partkey AS source, (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM part) AS node
  FROM lineitem)
LEFT JOIN (
    SELECT DISTINCT 'flag_' || l_returnflag AS g, l_partkey AS source, l_partkey AS node, 0 AS dist FROM lineitem
    UNION ALL SELECT g, s, d, 1 FROM adj
    UNION ALL SELECT DISTINCT a.g, a.s, b.d, 2 FROM adj a JOIN adj b ON a.g = b.g AND a.d = b.s
    UNION ALL SELECT DISTINCT a.g, a.s, c.d, 3 FROM adj a JOIN adj b ON a.g = b.g AND a.d = b.s JOIN adj c ON c.g = b.g AND c.s = b.d)
  USING (g, source, node) GROUP BY ALL""", **FLAG),
    "node_degrees": graph("""SELECT 'co_order' AS graph_id, p_partkey AS s, coalesce(k, 0) AS k
FROM part LEFT JOIN deg ON s = p_partkey""", **ALL),
    "triangles": graph("SELECT graph_id, u, v, n_tri FROM tri", **ALL),
    "exclusive_neighbors": graph("""
SELECT e.graph_id, e.u, e.v, 'u' AS side, a.d AS node FROM e JOIN adj a ON a.g = e.graph_id AND a.s = e.u AND a.d <> e.v
WHERE NOT EXISTS (SELECT 1 FROM adj x WHERE x.g = e.graph_id AND x.s = e.v AND x.d = a.d)
UNION ALL
SELECT e.graph_id, e.u, e.v, 'v', a.d FROM e JOIN adj a ON a.g = e.graph_id AND a.s = e.v AND a.d <> e.u
WHERE NOT EXISTS (SELECT 1 FROM adj x WHERE x.g = e.graph_id AND x.s = e.u AND x.d = a.d)""", **FLAG),
    "quads": graph("SELECT graph_id, u, v, k, w, excl FROM quad", **FLAG),
    "quad_nodes": graph("SELECT graph_id, u, v, n_quad FROM qn", **FLAG),
    "codegree_max": graph("""
SELECT graph_id, u, v, max(n) - 1 AS codeg_max FROM (
  SELECT graph_id, u, v, n FROM e JOIN adj k ON k.g = graph_id AND k.s = u AND k.d <> v
    JOIN both_near b ON b.g = graph_id AND b.p = least(k.d, v) AND b.q = greatest(k.d, v)
  UNION ALL
  SELECT graph_id, u, v, n FROM e JOIN adj w ON w.g = graph_id AND w.s = v AND w.d <> u
    JOIN both_near b ON b.g = graph_id AND b.p = least(w.d, u) AND b.q = greatest(w.d, u))
GROUP BY graph_id, u, v HAVING max(n) > 1""", **ALL, extra=""",
both_near AS MATERIALIZED (
  SELECT a.g, a.d AS p, b.d AS q, count(*) AS n FROM adj a JOIN adj b ON a.g = b.g AND a.s = b.s AND a.d < b.d GROUP BY ALL)"""),
    "quad_cap": per_edge(["cap AS quad_cap"], **FLAG),
    "local_structure": per_edge(["du AS deg_u", "dv AS deg_v", "t AS n_tri", "x AS n_quad",
                                 "cg AS codeg_max", "cap AS quad_cap"], **FLAG),
    "cost_lazy": cost(True),
    "cost_plain": cost(False),
    "uniform_transport": per_edge([r("1 - or_lazy", "w1")], "cur", upto="transport"),
    "transport_value": f"""WITH {SHARES},
steps AS (SELECT l_orderkey, line, lead(line) OVER w - line AS gap, sum(sq - se) OVER w AS diff
  FROM shares WINDOW w AS (PARTITION BY l_orderkey ORDER BY line))
SELECT l_orderkey, {r('sum(abs(diff) * coalesce(gap, 0))', 'value')} FROM steps GROUP BY ALL""",
    "transport_plan": f"WITH {SHARES} SELECT l_orderkey, line AS a, {r('sq', 'mass')} FROM shares",
    "quad_term": per_edge([r("c4", "quad_term")], **FLAG),
    "balanced_forman": per_edge([r("bf", "bf")], **FLAG),
    "lazy_curvature": per_edge([r("or_lazy", "or_lazy")], "cur", upto="transport"),
    "plain_curvature": per_edge([r("or_plain", "or_plain")], "cur", upto="transport"),
    "plain_curvature_reused": graph(f"""
SELECT graph_id, count(*) AS edges, {r('max(mean)', 'mean')}, count(*) FILTER (or_plain > mean) AS above
FROM cur JOIN (SELECT graph_id, avg(or_plain) AS mean FROM cur GROUP BY ALL) USING (graph_id) GROUP BY graph_id""", upto="transport"),
    "all_curvatures": per_edge(REPORT_COLUMNS[:10] + [r("env_slope", "env_slope")], "cur", upto="transport"),
    "degree_parameters": per_edge([
        r("cs", "base_term"), r("ct", "tri_weight"), r("ck", "spread_term"),
        r("t::DOUBLE/mm", "tri_share_max"), r("t::DOUBLE/m", "tri_share_min"), r("au", "laziness_u"),
        r("av", "neighbor_mass_v"), "du + dv + 2 AS mass_scale", r("least(au, av)", "shared_mass"),
        r("greatest(0.0, au-av)", "excess_u"), r("greatest(0.0, av-au)", "excess_u_rev"),
        r("greatest(0.0, av-au)", "excess_v"), r("greatest(0.0, au-av)", "excess_v_rev")], **FLAG),
    "transport_envelope": graph(f"SELECT {KEY}, {', '.join(ENV_PARTS)} FROM parts", extra=""",
parts AS (SELECT *, greatest(0.0, least((du-1-t)*au, (dv-1-t)*av, x::DOUBLE/(du+dv+2))) AS qp,
  least(t*gap, (du-1-t)*au + (dv-1-t)*av) AS tp FROM base)""", **FLAG),
    "const_slope": per_edge([r("env_const", "env_const"), r("env_slope", "env_slope")], **FLAG),
    "linear_envelope": per_edge([r("env_const + env_slope*t", "at_tri"),
                                 r("env_const + env_slope*1.5", "at_given")], **FLAG),
    "lazy_lower": per_edge([r(lazy_lower("bf", False), "or_lo_blunt"),
                            r(lazy_lower("bf", True), "or_lo_sharp")], "cur", upto="transport"),
    "lazy_upper": per_edge([r(lazy_upper("bf"), "or_hi"), r(lazy_upper("0.25::DOUBLE"), "or_hi_given")], **FLAG),
    "forman_lower": per_edge([
        r(forman_lower("or_lazy"), "bf_lo"), r(forman_lower("0.3"), "bf_lo_given"),
        r("cs + ct * least(greatest(0.0, (0.3 - env_const)/env_slope), m - 1.0)", "bf_lo_loose")],
        "cur", upto="transport"),
    "forman_upper": per_edge([r(forman_upper("or_lazy", False), "bf_hi_blunt"),
                              r(forman_upper("or_lazy", True), "bf_hi_sharp")], "cur", upto="transport"),
    "tradeoff": per_edge([
        "m AS small",
        r("-greatest(0.0, greatest(0.0, ck-0.5*c4) - t::DOUBLE/mm) - greatest(0.0, greatest(0.0, ck-0.5*c4)"
          " - t::DOUBLE/m) + t::DOUBLE/mm", "at_tri"),
        r(inverse("(-0.2)", "0.5*c4"), "t_max")], **FLAG),
    "bounds_from_forman": per_edge([r(lazy_lower("(bf*0.5)", True), "or_lo"),
                                    r(lazy_upper("(bf*0.5)"), "or_hi")], "cur", upto="transport"),
    "bounds_from_lazy": per_edge([r(forman_lower("(-0.1)"), "bf_lo"),
                                  r(forman_upper("(-0.1)", True), "bf_hi")], "cur", upto="transport"),
    "analyze": graph(f"""
SELECT graph_id, count(*) AS m, {r('avg(or_lazy)', 'mean_lazy')}, count(*) AS bf_count,
  {r('quantile_cont(bf, 0.5)', 'bf_median')} FROM cur GROUP BY ALL""", upto="transport"),
    "distribution": graph(
        f"SELECT graph_id, metric, {stats('metric')} FROM ("
        + unpivot({"bf": "bf", "n_tri": "t", "n_quad": "x", "quad_cap": "cap"}, "base")
        + ") GROUP BY graph_id, metric", **FLAG),
    "slack": per_edge([r("env_transport - or_lazy", "env_slack"),
                       r("env_at_tri - or_lazy", "theta_slack")], "rep", **FULL),
    "coverage": graph(f"SELECT graph_id, {', '.join(r(c, c) for c in COVER_NAMES)} FROM"
                      f" (SELECT graph_id, {COVER} FROM rep GROUP BY ALL)", **FULL),
    "band_widths": graph(f"SELECT graph_id, {', '.join(r(c, c) for c in WIDTH_NAMES)} FROM"
                         f" (SELECT graph_id, {WIDTH} FROM rep GROUP BY ALL)", **FULL),
    "run_summary": graph(f"""
SELECT graph_id, metric, {', '.join(r('any_value(' + c + ')', c) for c in COVER_NAMES + WIDTH_NAMES)}, {stats('metric')}
FROM ({unpivot(RUN, 'rep')}) JOIN (SELECT graph_id, {COVER}, {WIDTH} FROM rep GROUP BY ALL) USING (graph_id)
GROUP BY graph_id, metric""", **FULL),
    "histogram": bins("value", unpivot({"bf": "bf", "n_tri": "t"}, "base", 9), 60, BY_FLAG, "structure", False),
    "density_histogram": bins("value", unpivot({c: c for c in ("or_lazy", "or_lo", "or_hi")}, "rep", 9),
                              40, BY_LOT, "report", True),
    "bin_rules": graph("""
SELECT graph_id, rule, (CASE WHEN w > 0 THEN ceil(sp / w) ELSE 1 END)::BIGINT AS bins FROM w
UNION ALL SELECT graph_id, 'stone', arg_min(nb, (j, nb))::BIGINT FROM loss GROUP BY graph_id""",
        **FLAG, extra=BIN_RULES),
    "binned_quantiles": binned("du + dv", {"bf": "bf"}, "base", BY_FLAG, "structure"),
    "ribbon": binned("bf", {c: c for c in ("or_lazy", "or_lo", "or_hi")}, "rep", BY_LOT, "report"),
    "histogram_2d": graph("""
SELECT graph_id,
  least(29, len(list_filter(generate_series(0, 30), lambda k: lx + k * wx <= bf)) - 1)::INT AS bin_x,
  least(29, len(list_filter(generate_series(0, 30), lambda k: ly + k * wy <= or_lazy)) - 1)::INT AS bin_y,
  count(*) AS count
FROM tidy JOIN (SELECT graph_id, lx, (hx - lx) / 30 AS wx, ly, (hy - ly) / 30 AS wy FROM (
  SELECT graph_id, min(bf) - one_x AS lx, max(bf) + one_x AS hx, min(or_lazy) - one_y AS ly, max(or_lazy) + one_y AS hy
  FROM tidy JOIN (SELECT graph_id, CASE WHEN min(bf) = max(bf) THEN 0.5 ELSE 0 END AS one_x,
    CASE WHEN min(or_lazy) = max(or_lazy) THEN 0.5 ELSE 0 END AS one_y FROM tidy GROUP BY ALL) USING (graph_id)
  GROUP BY graph_id, one_x, one_y)) USING (graph_id) GROUP BY ALL""",
        upto="transport", extra=""",
tidy AS (SELECT graph_id, round(bf, 9) + 0.0 AS bf, round(or_lazy, 9) + 0.0 AS or_lazy FROM cur)"""),
    "quantile_profile": graph(f"""
SELECT graph_id, bf, count(*) AS count, {r('min(k)::DOUBLE / greatest(any_value(n) - 1, 1)', 'p_first')},
  {r('max(k)::DOUBLE / greatest(any_value(n) - 1, 1)', 'p_last')}
FROM (SELECT graph_id, bf, row_number() OVER (PARTITION BY graph_id ORDER BY bf) - 1 AS k,
        count(*) OVER (PARTITION BY graph_id) AS n
      FROM (SELECT graph_id, round(bf, 6) + 0.0 AS bf FROM base)) GROUP BY graph_id, bf""", **FLAG),
    "quantile_grid": graph(f"""
SELECT graph_id, k / 50.0::DOUBLE AS p, {r('qs[k + 1]', 'q')} FROM (
  SELECT graph_id, quantile_cont(bf, [{', '.join(repr(k / 50) for k in range(51))}]) AS qs FROM base GROUP BY ALL),
  (SELECT unnest(generate_series(0, 50)) AS k)""", **FLAG),
    "seeded_sample": graph(
        f"SELECT graph_id, u, v FROM e ORDER BY {draw(str(SEED), 'graph_id', 'u', 'v')}, graph_id, u, v LIMIT 25000",
        **ALL, upto="e"),
    "tolerant_series": graph(
        f"SELECT graph_id, metric, count(value) AS count, {r('avg(value)', 'mean')} FROM ("
        + unpivot({"bf": "bf", "quad_term": "c4"}, "base") + ") GROUP BY graph_id, metric", **FLAG),
    "suite_rows": f"""WITH {CHOSEN},
kept AS (SELECT * FROM (VALUES {values(PRESET_SMALL)}) AS t(family, a))
SELECT family, count(*) AS graphs, round(sum(a)::DOUBLE, 6) AS first_sum
FROM (SELECT family, a FROM chosen UNION ALL SELECT family, a FROM kept) GROUP BY ALL""",
    "tags": f"""WITH {CHOSEN}
SELECT family, CASE WHEN family = 'grid' THEN 'grid_' || a || 'x' || b::BIGINT
  ELSE 'er_n' || a || '_p' || b END AS tag FROM chosen
UNION ALL SELECT * FROM (VALUES {values(PRESET_PAPER_TAGS)}) AS t(family, tag)""",
    "display_names": f"""WITH {CHOSEN}
SELECT DISTINCT CASE WHEN family = 'grid' THEN 'grid_' || a || 'x' || b::BIGINT ELSE 'er_n' || a || '_p' || b END AS tag,
  CASE WHEN family = 'grid' THEN 'Grid ${{' || a || '\\times ' || b::BIGINT || '}}$'
    ELSE 'ER $n=' || a || '$, $p=' || b || '$' END AS name FROM chosen
UNION ALL SELECT DISTINCT 'real_' || replace(lower(p_type), ' ', '_'),
  'Real: ' || replace(replace(lower(p_type), ' ', '_'), '_', ' ') FROM part
UNION ALL SELECT * FROM (VALUES {values([(tag, name) for (_, tag), name in zip(PRESET_PAPER_TAGS, PAPER_NAMES)])}) AS t(tag, name)""",
    "resume": graph(f"""
SELECT graph_id AS tag, 1 + max(v) AS n, count(*) AS m,
  CASE WHEN graph_id = (SELECT min(graph_id) FROM e) THEN 0 ELSE count(*) END AS redone, {r('avg(bf)', 'mean_bf')}
FROM base GROUP BY graph_id"""),
    "suite_manifest": graph(f"""
SELECT graph_id AS tag, 1 + max(v) AS n, count(*) AS m, {r('avg(or_lazy)', 'mean_or_lazy')},
  {r('avg(bf)', 'mean_bf')}, {r('avg(t)', 'mean_n_tri')}, {r('avg(x)', 'mean_n_quad')}
FROM cur GROUP BY graph_id""", upto="transport"),
    "updated_report": per_edge(["t AS n_tri", "x AS n_quad", "cap AS quad_cap", r("bf", "bf"), r("or_lazy", "or_lazy"),
                                r("or_plain", "or_plain")], "cur", source=LATER_LOTS, upto="transport"),
    "report_buckets": per_edge([r("bf", "bf"), r("u::DOUBLE / (v + 1)", "x")], **FLAG),
    "sketch_summary": graph(f"""
SELECT graph_id, metric, count(*) AS count, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')},
  {r('min(value)', 'min')}, {r('max(value)', 'max')}, TRUE AS near
FROM (SELECT unnest([graph_id, 'all']) AS graph_id, metric, value FROM ({unpivot(
    {"bf": "bf", "n_tri": "t", "n_quad": "x", "quad_cap": "cap"}, "base")})) GROUP BY ALL""", **FLAG),
}
CHECKS |= {"load_edge_list": CHECKS["scan_edge_csv"], "stored_sizes": CHECKS["graph_sizes"], "published_suite": CHECKS["suite_manifest"]}
