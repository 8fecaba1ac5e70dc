"""DuckDB SQL for the queries: the same formulas, written from the definitions, over the raw tables."""

from __future__ import annotations

from .functions.special import ERFC_A, ERFC_P
from .operators.density import FINE
from .operators.measures import POINTS, PROBE, RADII
from .plans.figures import PALETTE
from .queries import GATE_SAMPLE, NEAREST, ONE, PICTURE_SIDE, QUERY_FRAMES, REACH as NEAR, REF, S_NUM, SAMPLE, SEED

REP = """rep AS (SELECT CAST(label AS INT) AS ensemble, vec_id AS frame, CAST(i - 1 AS INT) AS feature, CAST(embedding[i] AS DOUBLE) AS value
  FROM embeddings, range(1, 65) t(i))"""
XYZ = """xyz AS (SELECT CAST(label AS INT) AS ensemble, vec_id AS frame, CAST(a AS INT) AS atom, 4.0::DOUBLE * CAST(embedding[3 * a + 1] AS DOUBLE) AS x,
  4.0::DOUBLE * CAST(embedding[3 * a + 2] AS DOUBLE) AS y, 4.0::DOUBLE * CAST(embedding[3 * a + 3] AS DOUBLE) AS z FROM embeddings, range(0, 21) t(a))"""
CB = "sel AS (SELECT CAST(row_number() OVER (ORDER BY a) - 1 AS INT) AS pos, CAST(a AS INT) AS atom FROM range(0, 21) t(a) WHERE a % 7 <> 0)"
CA = "sel AS (SELECT CAST(a AS INT) AS pos, CAST(a AS INT) AS atom FROM range(0, 21) t(a))"
RANGE = "rng AS (SELECT min(value) AS lo, max(value) AS hi FROM rep)"
IDX = "idx AS (SELECT ensemble AS source, frame, row_number() OVER (PARTITION BY ensemble ORDER BY frame) - 1 AS idx, count(*) OVER (PARTITION BY ensemble) AS n FROM (SELECT DISTINCT ensemble, frame FROM rep))"


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0::DOUBLE"


def contact(select: str) -> str:
    return f"""WITH {XYZ}, {select},
c AS (SELECT ensemble, frame, pos, atom, x, y, z FROM xyz JOIN sel USING (atom)),
t AS (SELECT a.ensemble, a.frame, a.pos, sum(CASE WHEN abs(a.atom - b.atom) > 2 THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(greatest(-700.0::DOUBLE, least(700.0::DOUBLE,
  50.0::DOUBLE * (sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) - 1.0::DOUBLE))))) ELSE 0.0::DOUBLE END) AS v
  FROM c a JOIN c b ON a.ensemble = b.ensemble AND a.frame = b.frame GROUP BY ALL)
SELECT ensemble, frame, pos AS feature, {r('v')} AS value FROM t"""


def angle(features: int) -> str:
    return f"""WITH {XYZ},
w AS (SELECT ensemble, frame, atom, x, y, z, lead(x, 1) OVER o AS x1, lead(y, 1) OVER o AS y1, lead(z, 1) OVER o AS z1, lead(x, 2) OVER o AS x2, lead(y, 2) OVER o AS y2, lead(z, 2) OVER o AS z2
  FROM xyz WINDOW o AS (PARTITION BY ensemble, frame ORDER BY atom)),
v AS (SELECT ensemble, frame, atom, x - x1 AS ux, y - y1 AS uy, z - z1 AS uz, x2 - x1 AS vx, y2 - y1 AS vy, z2 - z1 AS vz FROM w WHERE atom < {features})
SELECT ensemble, frame, atom AS feature, {r('acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (ux * vx + uy * vy + uz * vz) / (sqrt(ux * ux + uy * uy + uz * uz) * sqrt(vx * vx + vy * vy + vz * vz)))))')} AS value FROM v"""


TORSION = f"""WITH {XYZ},
s AS (SELECT ensemble, frame, atom, lead(x) OVER o - x AS ax, lead(y) OVER o - y AS ay, lead(z) OVER o - z AS az FROM xyz WINDOW o AS (PARTITION BY ensemble, frame ORDER BY atom)),
w AS (SELECT *, lead(ax, 1) OVER o AS bx, lead(ay, 1) OVER o AS "by", lead(az, 1) OVER o AS bz, lead(ax, 2) OVER o AS cx, lead(ay, 2) OVER o AS cy, lead(az, 2) OVER o AS cz
  FROM s WINDOW o AS (PARTITION BY ensemble, frame ORDER BY atom)),
x AS (SELECT ensemble, frame, atom, ax, ay, az, bx, "by", bz, "by" * cz - bz * cy AS px, bz * cx - bx * cz AS py, bx * cy - "by" * cx AS pz,
  ay * bz - az * "by" AS qx, az * bx - ax * bz AS qy, ax * "by" - ay * bx AS qz FROM w WHERE atom < 18)
SELECT ensemble, frame, atom AS feature, {r('atan2(sqrt(bx * bx + "by" * "by" + bz * bz) * (ax * px + ay * py + az * pz), qx * px + qy * py + qz * pz)')} AS value FROM x"""


def density(values: str, keys: str, weight: str = "1") -> str:
    """CTEs bw and pdf (keys, k, s) over a CTE of that name; values of a row count weight times."""
    on = " AND ".join(f"v.{k} = b.{k}" for k in keys.split(", "))
    vk = ", ".join(f"v.{k}" for k in keys.split(", "))
    mean = f"(sum({weight} * value) / sum({weight}))"
    sd = "stddev_samp(value)" if weight == "1" else f"sqrt(greatest((sum({weight} * value * value) - sum({weight}) * {mean} * {mean}) / (sum({weight}) - 1.0::DOUBLE), 0.0::DOUBLE))"
    return f"""bw AS (SELECT {keys}, CAST(sum({weight}) AS DOUBLE) AS n, {sd} AS sd, {sd} * pow(CAST(sum({weight}) AS DOUBLE) * 0.75::DOUBLE, -0.2::DOUBLE) AS h FROM {values} GROUP BY {keys}),
pdf AS (SELECT {vk}, k, sum({'v.' + weight if weight != '1' else '1.0::DOUBLE'} * exp(-0.5::DOUBLE * pow((lo + k * ((hi - lo) / 99.0::DOUBLE) - v.value) / b.h, 2))) AS s
  FROM {values} v JOIN bw b ON {on} CROSS JOIN rng CROSS JOIN range(0, 100) g(k) GROUP BY {vk}, k)"""


def jsd_term(p: str, q: str) -> str:
    m = f"(({p} + {q}) / 2.0::DOUBLE)"
    return f"(CASE WHEN {p} > 0 THEN {p} * ln({p} / {m}) ELSE 0.0::DOUBLE END + CASE WHEN {q} > 0 THEN {q} * ln({q} / {m}) ELSE 0.0::DOUBLE END)"


def jsd_of(total: str) -> str:
    return f"sqrt(greatest({total} / ln(2.0::DOUBLE), 0.0::DOUBLE) / 2.0::DOUBLE)"


LOCAL = f"""{REP}, {RANGE}, {density('rep', 'ensemble, feature')},
norm AS (SELECT ensemble, feature, k, s / sum(s) OVER (PARTITION BY ensemble, feature) AS p FROM pdf),
loc AS (SELECT b.ensemble, b.feature, {jsd_of('sum(' + jsd_term('a.p', 'b.p') + ')')} AS jsd FROM norm a JOIN norm b ON a.feature = b.feature AND a.k = b.k AND a.ensemble = {REF} AND b.ensemble <> {REF} GROUP BY b.ensemble, b.feature)"""
LOCAL_REST = LOCAL[len(REP) + 2 :]


def drawn(variant: str, sample: int = SAMPLE) -> str:
    """CTEs up to boot(ensemble, kind, pair, feature, value) of the bootstrap; those of REP and RANGE stand before."""
    s, v1 = S_NUM, variant == "v1"
    # draws of the reference are side 0. v2: s of the reference, one of the other ensemble for each of the s * s pairs, then two for each pair within the reference, and within the other
    within = s * (s - 1)
    sides = f"SELECT d AS draw, CASE WHEN d < {s} THEN 0 ELSE 1 END AS side FROM range(0, {2 * s}) t(d)" if v1 else f"SELECT d AS draw, CASE WHEN d < {s} OR d BETWEEN {s + s * s} AND {s + s * s + within - 1} THEN 0 ELSE 1 END AS side FROM range(0, {s + s * s + 2 * within}) t(d)"
    feature = ", feature" if v1 else ""
    each = "CROSS JOIN (SELECT CAST(f AS INT) AS feature FROM range(0, 64) f(f))" if v1 else ""
    key = f"'{SEED}:' || ensemble || ':' || draw || ':' || {'feature || ' + chr(39) + ':' + chr(39) + ' || ' if v1 else ''}k"
    return f"""{IDX}, sides AS ({sides}),
plan AS (SELECT e.ensemble, CAST(draw AS INT) AS draw, CASE WHEN side = 0 THEN {REF} ELSE e.ensemble END AS source FROM (SELECT DISTINCT ensemble FROM rep WHERE ensemble <> {REF}) e CROSS JOIN sides),
sized AS (SELECT plan.*, n FROM plan JOIN (SELECT DISTINCT source, n FROM idx) USING (source)),
picks AS (SELECT ensemble, draw{feature}, source, CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % n AS idx FROM sized {each} CROSS JOIN range(0, {sample}) q(k)),
dr AS (SELECT ensemble, draw{feature}, source, idx, count(*) AS weight FROM picks GROUP BY ALL),
dv AS (SELECT dr.ensemble, dr.draw, rep.feature, rep.value, CAST(dr.weight AS DOUBLE) AS weight FROM dr JOIN idx USING (source, idx) JOIN rep ON rep.ensemble = dr.source AND rep.frame = idx.frame{' AND rep.feature = dr.feature' if v1 else ''})"""


def boot(variant: str, sample: int = SAMPLE) -> str:
    s, v1 = S_NUM, variant == "v1"
    other = "j" if v1 else f"i * {s} + j"
    inner = (f"side * {s} + a", f"side * {s} + b") if v1 else tuple(f"{s + s * s} + side * {s * (s - 1)} + 2 * k + {x}" for x in (0, 1))
    dens = density("dv", "ensemble, draw, feature", "weight").replace("bw AS", "dbw AS").replace("JOIN bw", "JOIN dbw").replace("pdf AS", "dpdf AS")
    return f"""{drawn(variant, sample)}, {dens},
dnorm AS (SELECT ensemble, draw, feature, k, s / sum(s) OVER (PARTITION BY ensemble, draw, feature) AS p FROM dpdf),
two AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS k FROM range(0, {s}) x(a), range(0, {s}) y(b) WHERE a < b),
sched(kind, pair, draw_a, draw_b) AS (SELECT 'inter', i * {s} + j, i, {s} + {other} FROM range(0, {s}) x(i), range(0, {s}) y(j)
  UNION ALL SELECT 'intra', side * {s * (s - 1) // 2} + k, {inner[0]}, {inner[1]} FROM two, range(0, 2) z(side)),
boot AS (SELECT a.ensemble, kind, CAST(pair AS INT) AS pair, a.feature, round({jsd_of('sum(' + jsd_term('a.p', 'b.p') + ')')}, 9) AS value
  FROM sched JOIN dnorm a ON a.draw = draw_a JOIN dnorm b ON b.draw = draw_b AND b.ensemble = a.ensemble AND b.feature = a.feature AND b.k = a.k GROUP BY ALL)"""


def erfc(x: str) -> str:
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {ERFC_P}::DOUBLE * {x}))"
    poly = "0.0::DOUBLE"
    for a in reversed(ERFC_A):
        poly = f"(({poly} + {a}::DOUBLE) * {t})"
    return f"{poly} * exp(-{x} * {x})"


def tests(keys: str) -> str:
    return f"""rk AS (SELECT {keys}, kind, CAST(rank() OVER (PARTITION BY {keys} ORDER BY value) AS DOUBLE) + (CAST(count(*) OVER (PARTITION BY {keys}, value) AS DOUBLE) - 1.0::DOUBLE) / 2.0::DOUBLE AS r,
  CAST(count(*) OVER (PARTITION BY {keys}, value) AS DOUBLE) AS t FROM boot),
st AS (SELECT {keys}, CAST(count(*) FILTER (kind = 'inter') AS DOUBLE) AS n1, CAST(count(*) FILTER (kind = 'intra') AS DOUBLE) AS n2, sum(CASE WHEN kind = 'inter' THEN r ELSE 0.0::DOUBLE END) AS r1, sum(t * t - 1.0::DOUBLE) AS ties FROM rk GROUP BY {keys}),
us AS (SELECT {keys}, n1, n2, greatest(r1 - n1 * (n1 + 1) / 2.0::DOUBLE, n1 * n2 - (r1 - n1 * (n1 + 1) / 2.0::DOUBLE)) AS u, sqrt(n1 * n2 / 12.0::DOUBLE * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM st),
zs AS (SELECT {keys}, n1, n2, u, (u - n1 * n2 / 2.0::DOUBLE - 0.5::DOUBLE) / sd AS z FROM us),
mw AS (SELECT {keys}, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, u, z, CASE WHEN z < 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, {erfc('(abs(z) / sqrt(2.0::DOUBLE))')}) END AS p FROM zs)"""


def colour(index: str) -> str:
    return f"CASE WHEN {index} < {len(PALETTE)} THEN [{', '.join(repr(c) for c in PALETTE)}][{index} + 1] ELSE '#' || substr(md5(CAST({index} AS VARCHAR)), 1, 6) END"


GATED = "CASE WHEN p >= 0.05 THEN 0.0::DOUBLE ELSE jsd END"
#: gl: gated local values of each comparison, with its p.
RECORDS = f"WITH {LOCAL}, {boot('v2')}, {tests('ensemble')}, gl AS (SELECT ensemble, feature, {GATED} AS local, p FROM loc JOIN mw USING (ensemble))"
GLOBAL = f"{RECORDS}, gb AS (SELECT ensemble AS ensemble_index, avg(local) AS y FROM gl GROUP BY ensemble)"
#: Each alpha carbon's share of sphere points outside all other atoms' spheres; all atoms have one radius.
REACH = f"({RADII['C']}::DOUBLE + {PROBE}::DOUBLE)"
SASA = f"""WITH {XYZ}, u AS (SELECT k, 2.0::DOUBLE * k / {POINTS} - 1.0::DOUBLE + 1.0::DOUBLE / {POINTS} AS uy, k * pi() * (3.0::DOUBLE - sqrt(5.0::DOUBLE)) AS t FROM range(0, {POINTS}) s(k)),
sp AS (SELECT k, cos(t) * sqrt(1.0::DOUBLE - uy * uy) AS ux, uy, sin(t) * sqrt(1.0::DOUBLE - uy * uy) AS uz FROM u),
nb AS (SELECT a.ensemble, a.frame, a.atom, a.x - b.x AS cx, a.y - b.y AS cy, a.z - b.z AS cz FROM xyz a JOIN xyz b ON a.ensemble = b.ensemble AND a.frame = b.frame AND a.atom <> b.atom
  WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 4.0::DOUBLE * {REACH} * {REACH}),
shut AS (SELECT ensemble, frame, atom, count(DISTINCT k) AS n FROM nb CROSS JOIN sp WHERE cx * cx + cy * cy + cz * cz + 2.0::DOUBLE * {REACH} * (cx * ux + cy * uy + cz * uz) < 0.0::DOUBLE GROUP BY ensemble, frame, atom)
SELECT ensemble, frame, atom AS feature, {r(f'4.0::DOUBLE * pi() * {REACH} * {REACH} * ({POINTS} - coalesce(n, 0)) / {POINTS}')} AS value FROM (SELECT ensemble, frame, atom FROM xyz) LEFT JOIN shut USING (ensemble, frame, atom)"""


def eigen(name: str, matrix: str) -> str:
    """CTEs {name}(v, l): leading eigenvector, its largest entry positive, and eigenvalue of the list of lists m of a CTE, by squaring m thirteen times."""
    return f"""{name}s AS (SELECT 0 AS k, m FROM {matrix} UNION ALL SELECT k + 1, [[x / t FOR x IN a] FOR a IN q]
  FROM (SELECT k, q, list_sum([q[i][i] FOR i IN range(1, len(q) + 1)]) AS t FROM (SELECT k, [[list_dot_product(a, b) FOR b IN m] FOR a IN m] AS q FROM {name}s WHERE k < 13))),
{name}c AS (SELECT [a FOR a, i IN m IF a[i] = list_max([b[j] FOR b, j IN m])][1] AS u FROM {name}s WHERE k = 13),
{name}n AS (SELECT [x / sqrt(list_dot_product(u, u)) * (CASE WHEN list_max(u) >= -list_min(u) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) FOR x IN u] AS v FROM {name}c),
{name} AS (SELECT v, list_dot_product(v, [list_dot_product(a, v) FOR a IN m]) AS l FROM {name}n, {matrix})"""


COMPONENTS = f"""WITH RECURSIVE {REP}, mu AS (SELECT feature, avg(value) AS mu FROM rep GROUP BY feature),
cen AS (SELECT ensemble, frame, feature, value - mu AS value FROM rep JOIN mu USING (feature)),
cov AS (SELECT a.feature AS i, b.feature AS j, sum(a.value * b.value) / (count(*) - 1) AS c FROM cen a JOIN cen b ON a.frame = b.frame AND a.ensemble = b.ensemble GROUP BY ALL),
m1 AS MATERIALIZED (SELECT list(a ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS a FROM cov GROUP BY i)), {eigen('e1', 'm1')},
m2 AS MATERIALIZED (SELECT [[x - l * v[i] * v[j] FOR x, j IN a] FOR a, i IN m] AS m FROM m1, e1), {eigen('e2', 'm2')},
wide AS (SELECT ensemble, frame, list(value ORDER BY feature) AS x FROM cen GROUP BY ensemble, frame),
pc AS (SELECT ensemble, frame, {r('list_dot_product(x, e1.v)', 5)} AS c1, {r('list_dot_product(x, e2.v)', 5)} AS c2 FROM wide, e1, e2)"""


def oracle_sql() -> dict[str, str]:
    all_v1 = f"WITH {LOCAL}, {boot('v1')}, {tests('ensemble, feature')}"
    all_v2 = f"WITH {LOCAL}, {boot('v2')}, {tests('ensemble')}"
    h = "stddev_samp({v}) * pow(CAST(count(*) AS DOUBLE) * 0.75::DOUBLE, -0.2::DOUBLE)"
    gate_v1 = f"WITH {LOCAL}, {boot('v1', GATE_SAMPLE)}, {tests('ensemble, feature')}"
    return {
        "atom_select": f"WITH {XYZ}, {CB} SELECT ensemble, frame, pos, {r('x')} AS x, {r('y')} AS y, {r('z')} AS z FROM xyz JOIN sel USING (atom)",
        "pair_distances": f"WITH {XYZ}, {CB}, c AS (SELECT * FROM xyz JOIN sel USING (atom)) SELECT a.ensemble, a.frame, a.pos AS i, b.pos AS j, {r('sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))')} AS d FROM c a JOIN c b ON a.ensemble = b.ensemble AND a.frame = b.frame AND a.pos < b.pos AND abs(a.atom - b.atom) > 2",
        "pair_degrees": f"WITH {XYZ}, {CB}, c AS (SELECT * FROM xyz JOIN sel USING (atom)) SELECT a.ensemble, a.pos, CAST(sum(CASE WHEN abs(a.atom - b.atom) > 2 THEN 1 ELSE 0 END) AS BIGINT) AS pair_rows FROM c a JOIN sel b ON true GROUP BY a.ensemble, a.pos",
        "contact_cb": contact(CB),
        "contact_ca": contact(CA),
        "bond_angle": angle(19),
        "bond_angle_v1": angle(18),
        "torsion": TORSION,
        "rep_long_to_wide": f"SELECT CAST(label AS INT) AS ensemble, vec_id AS frame, CAST(len(embedding) AS INT) AS n, {r('CAST(embedding[1] AS DOUBLE)')} AS f0, {r('CAST(embedding[32] AS DOUBLE)')} AS f31, {r('CAST(embedding[64] AS DOUBLE)')} AS f63 FROM embeddings",
        "value_range": f"WITH {REP}, {RANGE} SELECT {r('lo')} AS lo, {r('hi')} AS hi FROM rng",
        "bandwidth": f"WITH {REP} SELECT ensemble, feature, CAST(count(*) AS BIGINT) AS n, {r('stddev_samp(value)')} AS sd, {r(h.format(v='value'))} AS h FROM rep GROUP BY ensemble, feature",
        "bandwidth_lineitem": f"WITH li AS (SELECT l_returnflag AS ensemble, 0 AS feature, l_quantity AS value FROM lineitem UNION ALL SELECT l_returnflag, 1, l_extendedprice FROM lineitem UNION ALL SELECT l_returnflag, 2, l_discount FROM lineitem UNION ALL SELECT l_returnflag, 3, l_tax FROM lineitem) SELECT ensemble, CAST(feature AS INT) AS feature, CAST(count(*) AS BIGINT) AS n, {r('stddev_samp(value)', 4)} AS sd, {r(h.format(v='value'), 4)} AS h FROM li GROUP BY ensemble, feature",
        "kde_pdf": f"WITH {REP}, {RANGE}, {density('rep', 'ensemble, feature')} SELECT pdf.ensemble, pdf.feature, CAST(k AS INT) AS k, {r('lo + k * ((hi - lo) / 99.0::DOUBLE)')} AS x, {r('s / (n * h * sqrt(2.0::DOUBLE * pi()))')} AS p FROM pdf JOIN bw USING (ensemble, feature) CROSS JOIN rng",
        "kde_pdf_binned": f"""WITH {REP}, {RANGE}, bw AS (SELECT ensemble, feature, CAST(count(*) AS DOUBLE) AS n, {h.format(v='value')} AS h FROM rep GROUP BY ensemble, feature),
spot AS (SELECT ensemble, feature, (value - lo) * ({FINE - 1} / (hi - lo)) AS t, least(CAST(floor((value - lo) * ({FINE - 1} / (hi - lo))) AS BIGINT), {FINE - 2}) AS b FROM rep CROSS JOIN rng),
bins AS (SELECT ensemble, feature, b, sum(w) AS w FROM (SELECT ensemble, feature, b, 1 - (t - b) AS w FROM spot UNION ALL SELECT ensemble, feature, b + 1, t - b FROM spot) GROUP BY ALL)
SELECT ensemble, feature, CAST(k AS INT) AS k, {r('s / (n * h * sqrt(2.0::DOUBLE * pi()))')} AS p FROM (SELECT ensemble, feature, k, n, h, sum(w * exp(-0.5::DOUBLE * pow((lo + k * ((hi - lo) / 99.0::DOUBLE) - (lo + b * ((hi - lo) / {FINE - 1}))) / h, 2))) AS s
  FROM bins JOIN bw USING (ensemble, feature) CROSS JOIN rng CROSS JOIN range(0, 100) g(k) GROUP BY ALL)""",
        "kde_pdf_events": f"WITH rep AS (SELECT CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS ensemble, 0 AS feature, CAST(value AS DOUBLE) AS value FROM events), {RANGE}, {density('rep', 'ensemble, feature')} SELECT pdf.ensemble, CAST(k AS INT) AS k, {r('lo + k * ((hi - lo) / 99.0::DOUBLE)')} AS x, {r('s / (n * h * sqrt(2.0::DOUBLE * pi()))')} AS p FROM pdf JOIN bw USING (ensemble, feature) CROSS JOIN rng",
        "jsd_local": f"WITH {LOCAL} SELECT ensemble, feature, {r('jsd')} AS jsd FROM loc",
        "jsd_global": f"WITH {LOCAL} SELECT ensemble, {r('avg(jsd)')} AS jsd FROM loc GROUP BY ensemble",
        "bootstrap_draws": f"WITH {REP}, {drawn('v2')} SELECT ensemble, draw, source, frame, CAST(weight AS BIGINT) AS weight FROM dr JOIN idx USING (source, idx)",
        "bootstrap_draws_v1": f"WITH {REP}, {drawn('v1')} SELECT ensemble, draw, feature, source, idx, CAST(weight AS BIGINT) AS weight FROM dr",
        "jsd_bootstrap": f"WITH {REP}, {RANGE}, {boot('v2')} SELECT ensemble, kind, pair, feature, {r('value')} AS value FROM boot",
        "mann_whitney": f"WITH {REP}, {RANGE}, {boot('v2')}, {tests('ensemble')} SELECT ensemble, n1, n2, {r('u', 1)} AS u, {r('z')} AS z, {r('p')} AS p FROM mw",
        "mann_whitney_v1": f"WITH {REP}, {RANGE}, {boot('v1')}, {tests('ensemble, feature')} SELECT ensemble, feature, n1, n2, {r('u', 1)} AS u, {r('z')} AS z, {r('p')} AS p FROM mw",
        "significance_gate": f"{gate_v1} SELECT ensemble, feature, {r('jsd')} AS jsd, {r(GATED)} AS gated, {r('p')} AS p FROM loc JOIN mw USING (ensemble, feature)",
        "compare_ensembles": f"{all_v2}, g AS (SELECT ensemble, feature, {GATED} AS local, p FROM loc JOIN mw USING (ensemble)) SELECT ensemble, feature, {r('local')} AS local, {r('avg(local) OVER (PARTITION BY ensemble)')} AS global_dissimilarity, {r('p')} AS p FROM g",
        "compare_ensembles_v1": f"{all_v1}, g AS (SELECT ensemble, {GATED} AS local FROM loc JOIN mw USING (ensemble, feature)) SELECT ensemble, {r('avg(local)')} AS global_dissimilarity, CAST(count(*) FILTER (local > 0) AS BIGINT) AS significant FROM g GROUP BY ensemble",
        "exclude_reference": f"SELECT CAST(label AS INT) AS ensemble, CAST(count(*) AS BIGINT) AS frames, {r('avg(CAST(embedding[1] AS DOUBLE))')} AS mean0 FROM embeddings WHERE label <> {REF} GROUP BY label",
        "stack_ensembles": f"SELECT CAST(dense_rank() OVER (ORDER BY label) - 1 AS INT) AS ensemble, vec_id AS frame, {r('CAST(embedding[1] AS DOUBLE)')} AS f0 FROM embeddings",
        "concat_trajectories": "SELECT row_number() OVER (ORDER BY label, vec_id) - 1 AS frame, vec_id FROM embeddings",
        "heatmap_ticks": f"WITH c AS ({contact_raw()}), m AS (SELECT ensemble, CAST(floor(min(v)) AS BIGINT) AS lo, CAST(ceil(max(v)) AS BIGINT) AS hi FROM c GROUP BY ensemble), s AS (SELECT *, CAST(CASE WHEN hi - lo <= 10 THEN 1 WHEN hi - lo <= 50 THEN 5 ELSE 10 END AS BIGINT) AS step FROM m) SELECT ensemble, unnest(range(lo, lo + CAST(ceil((hi - lo) / step) AS BIGINT) * step + 1, step)) AS tick FROM s",
        "local_axis": f"{RECORDS} SELECT ensemble AS ensemble_index, CAST(feature + 1 AS INT) AS x, {r('local')} AS y, CAST(CASE WHEN count(*) OVER (PARTITION BY ensemble) <= 20 THEN 2 WHEN count(*) OVER (PARTITION BY ensemble) <= 50 THEN 5 ELSE 10 END AS INT) AS step FROM gl",
        "combined_local": f"{RECORDS} SELECT 'Ensemble ' || ensemble AS legend, {colour('ensemble')} AS colour, CAST(feature + 1 AS INT) AS x, {r('local')} AS y FROM gl",
        "palette_global_bar": f"{GLOBAL} SELECT ensemble_index, {r('y')} AS y, {colour('ensemble_index')} AS colour FROM gb",
        "palette_global_line": f"{GLOBAL} SELECT ensemble_index, {r('y')} AS y, 'black' AS colour, 'o' AS marker FROM gb",
        "comparison_json": f"{RECORDS} SELECT ensemble AS ensemble_index, {r('avg(local)')} AS global_dissimilarity, CAST(count(*) AS INT) AS features, {r('max(local)')} AS largest, {r('max(p)')} AS p_value FROM gl GROUP BY ensemble",
        "heatmap_cells": f"WITH c AS ({contact_raw()}) SELECT ensemble, frame AS y, CAST(feature AS INT) AS x, {r('v')} AS value, CAST(floor(min(v) OVER (PARTITION BY ensemble)) AS BIGINT) AS vmin, CAST(ceil(max(v) OVER (PARTITION BY ensemble)) AS BIGINT) AS vmax FROM c",
        "heatmap_pixels": f"WITH c AS ({contact_raw()}), m AS (SELECT *, max(frame) OVER w + 1 AS rs, max(feature) OVER w + 1 AS cs FROM c WINDOW w AS (PARTITION BY ensemble)) SELECT ensemble, CAST(frame * least(rs, {PICTURE_SIDE}) // rs AS INT) AS py, CAST(feature * least(cs, {PICTURE_SIDE}) // cs AS INT) AS px, CAST(count(*) AS BIGINT) AS n, {r('avg(v)')} AS value FROM m GROUP BY 1, 2, 3",
        "sasa": SASA,
        "near_atoms": f"WITH {XYZ}, nb AS (SELECT a.ensemble, a.frame, a.atom, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM xyz a JOIN xyz b ON a.ensemble = b.ensemble AND a.frame = b.frame AND a.atom <> b.atom) SELECT ensemble, frame, atom, CAST(count(*) FILTER (d < {NEAR}) AS BIGINT) AS near, {r(f'min(d) FILTER (d < {NEAR})')} AS nearest FROM nb GROUP BY ALL",
        "pairwise_distance_matrix": f"WITH {REP} SELECT a.frame AS frame_a, b.frame AS frame_b, {r('sqrt(sum((a.value - b.value) * (a.value - b.value)))')} AS d FROM rep a JOIN rep b ON a.feature = b.feature AND a.frame % {QUERY_FRAMES} = 0 AND a.frame <> b.frame GROUP BY a.frame, b.frame",
        "nearest_frames": f"WITH {REP}, d AS (SELECT a.ensemble AS ea, a.frame AS frame_a, b.ensemble AS eb, b.frame AS frame_b, sqrt(sum((a.value - b.value) * (a.value - b.value))) AS d FROM rep a JOIN rep b ON a.feature = b.feature AND a.frame <> b.frame GROUP BY ALL) SELECT frame_a, CAST(row_number() OVER w AS INT) AS rank, frame_b, {r('d')} AS d FROM d WINDOW w AS (PARTITION BY frame_a ORDER BY d, eb, frame_b) QUALIFY row_number() OVER w <= {NEAREST}",
        "pca": f"{COMPONENTS} SELECT ensemble, frame, c1, c2, {colour('ensemble')} AS colour FROM pc",
        "pca_points": f"{COMPONENTS} SELECT frame, c1, c2 FROM pc WHERE ensemble = {ONE}",
        "pca_variance": f"{COMPONENTS} SELECT CAST(1 AS INT) AS component, {r('l')} AS variance, {r('list_max(v)', 5)} AS largest FROM e1 UNION ALL SELECT CAST(2 AS INT), {r('l')}, {r('list_max(v)', 5)} FROM e2",
        "event_moments": f"SELECT CAST(ts AS DATE) AS day, event_type AS ensemble, CAST(count(value) AS BIGINT) AS n, {r('avg(value)', 4)} AS mean, {r('stddev_samp(value)', 4)} AS sd, {r('min(value)', 4)} AS lo, {r('max(value)', 4)} AS hi FROM events GROUP BY ALL",
    }


def contact_raw() -> str:
    return contact(CB).replace(r("v") + " AS value", "v")
