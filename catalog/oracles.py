"""The SQL each query is checked against, on the same tables, for DuckDB."""

from __future__ import annotations

from catalog.views import CUSTOMER, EMBEDDING, EMPTY_SAMPLE, MIXTURE, PAIRED

WIDTH = 64
CLASSES = 10


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def total(expr: str) -> str:
    return f"CAST(sum({expr}) AS BIGINT)"


ORACLES: dict[str, str] = {}

# Matrix forms and casts ------------------------------------------------------------------------

ORACLES["unpivot_cells"] = f"""WITH {EMBEDDING}
SELECT sample_id, feature, {r('value', 8)} AS value FROM cells"""

_brands = ", ".join(f"{r(f'''max(CASE WHEN p_brand = 'Brand#{b}' THEN value END)''', 8)} AS brand_{b}" for b in range(1, 26))
ORACLES["pivot_vectors"] = f"""WITH m AS (
  SELECT l_suppkey, l_linestatus, p_brand,
         CASE WHEN CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) % 5 = 0 AND l_suppkey % 10 = 3 THEN NULL
              ELSE avg(l_discount * 10) END AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, l_linestatus, p_brand)
SELECT 'S' || l_suppkey || CASE WHEN l_linestatus = 'O' THEN '_tumor' ELSE '_normal.tissue' END AS sample_id, {_brands}
FROM m GROUP BY l_suppkey, l_linestatus"""

ORACLES["lenient_cast"] = """WITH d AS (SELECT event_id, props, regexp_extract(props, '([0-9]+)', 1) AS digits FROM events)
SELECT event_id, TRY_CAST(props AS DOUBLE) AS from_props, TRY_CAST(digits AS DOUBLE) AS from_digits,
       TRY_CAST(digits || 'd' AS DOUBLE) AS from_suffixed, TRY_CAST(' ' || digits || '.5e1' AS DOUBLE) AS from_exponent
FROM d"""

# Cohort ----------------------------------------------------------------------------------------

ORACLES["split_counts"] = f"""WITH {EMBEDDING}
SELECT class, count(*) FILTER (split_gaps <> 'test') AS n_train, count(*) FILTER (split_gaps = 'test') AS n_test
FROM e GROUP BY class"""

ORACLES["split_null_ci"] = f"""WITH {EMBEDDING}
SELECT class, count(*) FILTER (lower(coalesce(split_gaps, 'nan')) <> lower('TEST')) AS n_train,
       count(*) FILTER (lower(coalesce(split_gaps, 'nan')) = lower('TEST')) AS n_test
FROM e GROUP BY class"""

ORACLES["class_weights"] = f"""WITH {EMBEDDING},
k AS (SELECT class, dense_rank() OVER (ORDER BY class) - 1 AS code FROM (SELECT DISTINCT class FROM e)),
n AS (SELECT class, count(*) AS n FROM e WHERE split <> 'test' GROUP BY class)
SELECT class, CAST(code AS INTEGER) AS code, n,
       {r('(SELECT sum(n) FROM n)::DOUBLE / ((SELECT count(*) FROM n) * n)')} AS weight
FROM n JOIN k USING (class)"""

ORACLES["label_exclude"] = f"""WITH {EMBEDDING}
SELECT class, cancer_status, CASE cancer_status WHEN 'normal' THEN 0 WHEN 'cancer' THEN 1 END AS code, count(*) AS n
FROM e WHERE class <> 'c3' GROUP BY ALL"""

_wanted = "(SELECT feature FROM cells GROUP BY feature HAVING avg(value) > 0)"
ORACLES["feature_subset"] = f"""WITH {EMBEDDING}
SELECT sample_id, feature, {r('value', 8)} AS value FROM cells WHERE feature IN {_wanted}"""

ORACLES["align_strict"] = f"""WITH {EMBEDDING}
SELECT g.sample_id, g.class, e.split, CAST(count(*) AS INTEGER) AS width, CAST(count(value) AS INTEGER) AS n_known,
       {r('sum(coalesce(value, 0))')} AS total
FROM gappy g JOIN e USING (sample_id) GROUP BY ALL"""

ORACLES["align_lenient"] = f"""WITH {EMBEDDING},
s AS (SELECT sample_id, class FROM e UNION ALL SELECT 'k' || c_custkey, c_mktsegment FROM customer)
SELECT s.sample_id, s.class, {WIDTH} AS width, CAST(count(value) AS INTEGER) AS n_known,
       {r('coalesce(sum(value), 0)')} AS total
FROM s LEFT JOIN cells c USING (sample_id) GROUP BY ALL"""

ORACLES["attach_scores"] = f"""WITH {EMBEDDING},
t AS (SELECT sample_id, sum(value) AS total FROM cells WHERE split = 'test' GROUP BY sample_id)
SELECT sample_id, class, cancer_status, split, {r('total')} AS score FROM e LEFT JOIN t USING (sample_id)"""

# Quality ---------------------------------------------------------------------------------------

ORACLES["missing_filter"] = f"""WITH {EMBEDDING},
q AS (SELECT feature, {total('CASE WHEN value IS NULL THEN 1 ELSE 0 END')} AS n_missing, count(*) AS n FROM gappy GROUP BY feature)
SELECT feature, n_missing, n_missing < n AND n_missing / n < 0.5 AS kept,
       CASE WHEN n_missing < n AND n_missing / n < 0.5 THEN n END AS n_cells FROM q"""

ORACLES["missing_samples"] = f"""WITH {EMBEDDING},
q AS (SELECT sample_id, {total('CASE WHEN value IS NULL THEN 1 ELSE 0 END')} AS n_missing, count(*) AS n FROM gappy GROUP BY sample_id)
SELECT sample_id, n_missing, n_missing / n < 0.5 AS kept FROM q WHERE n_missing < n"""

ORACLES["near_zero_variance"] = f"""WITH {CUSTOMER},
f AS (SELECT feature, value, count(*) AS c FROM ccells WHERE value IS NOT NULL GROUP BY feature, value),
t AS (SELECT feature, list(c ORDER BY c DESC) AS cs, count(*) AS n_distinct FROM f GROUP BY feature),
m AS (SELECT feature, n_distinct, CASE WHEN n_distinct < 2 THEN 0.0 ELSE cs[1]::DOUBLE / cs[2] END AS fr,
             100.0::DOUBLE * n_distinct / (SELECT count(*) FROM customer) AS pu FROM t)
SELECT feature, {r('fr')} AS freq_ratio, {r('pu')} AS percent_unique, n_distinct,
       n_distinct <= 1 OR (fr > 899 AND pu <= 1) AS near_zero FROM m"""


def _standardize(scale: str) -> str:
    return f"""WITH {EMBEDDING},
s AS (SELECT feature, avg(value) AS mean, {scale} AS sd FROM cells WHERE split <> 'test' GROUP BY feature)
SELECT sample_id, feature, {r('(value - mean) / sd')} AS value FROM cells JOIN s USING (feature)"""


ORACLES["standardize_sample"] = _standardize("stddev_samp(value)")
ORACLES["standardize_population"] = _standardize("CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END")
ORACLES["standardize_center"] = _standardize("1")

# Paired markers --------------------------------------------------------------------------------


def _csv(repeats: int, quoted_every: int) -> str:
    """What is left of the CSV text: every value but those that say none."""
    value = f"CASE WHEN (j - 1) % {quoted_every} <> 0 AND (j - 1) % 7 = 3 THEN NULL ELSE x[(j - 1) % len(x) + 1] END"
    return f"""
WITH v AS (SELECT 's,"' || vec_id AS sample_id, CAST(embedding AS DOUBLE[]) AS x, len(embedding) * {repeats} AS width FROM embeddings),
c AS (SELECT sample_id, width, j, {value} AS value FROM v, unnest(range(1, width + 1)) AS t(j))
SELECT sample_id, width, count(value) AS n_known, {r('coalesce(sum(value * j), 0)', 3)} AS weighted FROM c GROUP BY sample_id, width"""


ORACLES["csv_matrix"] = _csv(1, 3)
ORACLES["csv_matrix_wide"] = _csv(33, 5)


def _paired(group: str, chosen: str, plain: bool = False, where: str = "true") -> str:
    source = "m" if not plain else "plain"
    plain_view = f""",
plain AS (SELECT l_suppkey, l_linestatus, p_brand AS feature, round(avg(l_discount * 10), 8) AS value
          FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {where} GROUP BY l_suppkey, l_linestatus, p_brand)"""
    return f"""WITH {PAIRED}{plain_view if plain else ''},
f AS (SELECT DISTINCT feature FROM {source}
      WHERE feature NOT LIKE '%chrX%' AND feature NOT LIKE '%chrY%' AND feature NOT LIKE '%chrM%'),
grid AS (SELECT {group} AS grp, l_suppkey, feature FROM pairs, f),
d AS (SELECT grp, feature, t.value - n.value AS diff FROM grid
      LEFT JOIN (SELECT * FROM {source} WHERE l_linestatus = 'O') t USING (l_suppkey, feature)
      LEFT JOIN (SELECT * FROM {source} WHERE l_linestatus <> 'O') n USING (l_suppkey, feature)),
c AS (SELECT grp, feature, CASE WHEN count(*) = count(diff) THEN count(*) FILTER (diff > 0.1) END AS n_over
      FROM d GROUP BY grp, feature),
k AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY n_over DESC) AS place FROM c WHERE n_over IS NOT NULL)
SELECT {chosen} FROM k WHERE place <= 5 AND n_over >= 1"""


ORACLES["paired_markers_all"] = _paired("'all'", "feature, n_over")
ORACLES["paired_markers_vectors"] = ORACLES["paired_markers_all"]
ORACLES["paired_markers_by_type"] = _paired("cancer_type", "grp AS cancer_type, feature, n_over")
ORACLES["paired_markers_union"] = _paired("cancer_type", "DISTINCT feature", plain=True)
ORACLES["study_discovery_detection"] = _paired("'all'", "DISTINCT feature")
ORACLES["paired_cells_sparse"] = _paired(
    "'all'", "DISTINCT feature", plain=True, where="CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) % 2 = 1"
)

# One-vs-rest markers ---------------------------------------------------------------------------


def _profile(source: str, times: float = 1.0) -> str:
    value = "value" if times == 1.0 else f"value * {times}::DOUBLE"
    return f"""
tr AS (SELECT c.sample_id, c.class, c.feature, {value} AS value FROM {source} c JOIN e USING (sample_id) WHERE e.split <> 'test'),
pc AS (SELECT feature, class, count(value) AS n, sum(value) AS s, avg(value) AS mean, var_pop(value) * count(value) AS ss,
              count(*) - count(value) AS na FROM tr GROUP BY feature, class),
pa AS (SELECT feature, sum(n) AS n, sum(s) AS s, sum(mean) AS means, sum(ss) AS ss, sum(na) AS na, count(*) AS k,
              sum(1.0::DOUBLE / n) AS inv FROM pc GROUP BY feature HAVING min(n) > 0 AND count(*) = (SELECT count(DISTINCT class) FROM tr)),
fx AS (SELECT pc.feature, pc.class, pc.n, pc.mean AS class_mean, (pa.s - pc.s) / (pa.n - pc.n) AS others_mean,
              abs(pc.mean - (pa.s - pc.s) / (pa.n - pc.n)) AS class_diff, pc.na AS class_na, pa.na - pc.na AS others_na,
              2 * pc.mean - pa.means AS logfc, sqrt(pa.inv) AS unscaled, pa.n - pa.k AS df, pa.ss / (pa.n - pa.k) AS s2
       FROM pc JOIN pa USING (feature))"""


ORACLES["class_effects"] = f"""WITH {EMBEDDING}, {_profile('gappy')}
SELECT feature, class, n, class_na, CAST(others_na AS BIGINT) AS others_na, CAST(df AS BIGINT) AS df,
       {r('class_mean', 8)} AS class_mean, {r('others_mean', 8)} AS others_mean, {r('class_diff', 8)} AS class_diff,
       {r('s2', 8)} AS s2 FROM fx"""

_rest = "(SELECT string_agg('-' || o.class, '' ORDER BY o.class) FROM ks o WHERE o.class <> a.class{more})"
_classes = "ks AS (SELECT DISTINCT class FROM tr)"

ORACLES["ovr_contrasts"] = f"""WITH {EMBEDDING}, {_profile('cells')}, {_classes},
nm AS (SELECT a.class, a.class || {_rest.format(more='')} AS contrast FROM ks a)
SELECT feature, contrast, {r('logfc', 8)} AS logfc, {r('unscaled', 8)} AS unscaled FROM fx JOIN nm USING (class)"""

ORACLES["two_positive_contrasts"] = f"""WITH {EMBEDDING}, {_profile('cells')}, {_classes},
nm AS (SELECT a.class AS c1, b.class AS c2, a.class || '+' || b.class || {_rest.format(more=' AND o.class <> b.class')} AS contrast
       FROM ks a JOIN ks b ON a.class < b.class)
SELECT x.feature, contrast, {r('2 * x.mean + 2 * y.mean - pa.means', 8)} AS logfc, {r('sqrt(pa.inv)', 8)} AS unscaled
FROM nm JOIN pc x ON x.class = c1 JOIN pc y ON y.class = c2 AND y.feature = x.feature JOIN pa ON pa.feature = x.feature"""

ORACLES["pairwise_contrasts"] = f"""WITH {EMBEDDING}, {_profile('cells')}
SELECT a.feature, a.class || '-' || b.class AS contrast, {r('a.mean - b.mean', 8)} AS logfc,
       {r('sqrt(1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)', 8)} AS unscaled
FROM pc a JOIN pc b ON a.feature = b.feature AND a.class <> b.class"""


def _top(cutoff: float, per_class: int) -> str:
    return f"""
tp AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY abs(logfc) DESC, logfc DESC, feature) AS rank
       FROM fx WHERE class_diff > {cutoff} AND NOT regexp_matches(feature, '^chr[XYM]')),
top AS (SELECT * FROM tp WHERE rank <= {per_class})"""


ORACLES["ovr_markers"] = f"""WITH {EMBEDDING}, {_profile('chrom')}, {_top(0.02, 6)}
SELECT class, feature, CAST(rank AS INTEGER) AS rank, {r('logfc', 8)} AS logfc, {r('class_diff', 8)} AS class_diff FROM top"""
ORACLES["ovr_markers_many"] = f"""WITH {EMBEDDING}, {_profile('chrom')}, {_top(0.02, 2000)}
SELECT class, feature, CAST(rank AS INTEGER) AS rank, {r('logfc', 8)} AS logfc FROM top"""
ORACLES["ovr_marker_counts"] = f"""WITH {EMBEDDING}, {_profile('chrom')}, {_top(0.02, 6)}
SELECT class, count(*) AS n_markers FROM top GROUP BY class"""
_chrom_high = "SELECT feature FROM chrom GROUP BY feature HAVING avg(value) > 0"
ORACLES["ovr_markers_minus"] = f"""WITH {EMBEDDING}, {_profile('chrom')}, {_top(0.02, 6)}
SELECT feature FROM top EXCEPT {_chrom_high}"""

ORACLES["two_class_markers"] = f"""WITH {EMBEDDING},
two AS (SELECT sample_id, cancer_status AS class, feature, value FROM chrom), {_profile('two').replace('FROM pc JOIN pa USING (feature))', 'FROM pc JOIN pa USING (feature) WHERE 2 * pc.mean - pa.means > 0)')}, {_top(0.005, 6)}
SELECT class, feature, CAST(rank AS INTEGER) AS rank, {r('logfc', 8)} AS logfc FROM top"""

_gappy_kept = """
gk AS (SELECT * FROM gappy WHERE feature IN (
  SELECT feature FROM gappy GROUP BY feature HAVING count(value) > 0 AND count(*) - count(value) < 0.5 * count(*)))"""
ORACLES["study_discovery_disease"] = f"""WITH {EMBEDDING}, {_gappy_kept}, {_profile('gk')}, {_top(0.02, 6)}
SELECT DISTINCT feature FROM top"""
ORACLES["study_discovery_race"] = f"""WITH {EMBEDDING}, {_gappy_kept}, {_profile('gk')}, {_top(0.02, 6)}
SELECT feature FROM top EXCEPT SELECT feature FROM gk GROUP BY feature HAVING avg(value) > 0"""


def _psi(x: str) -> str:
    y = f"({x} + 20)"
    step = " + ".join(f"1 / ({x} + {i})" for i in range(20))
    return f"(ln({y}) - 0.5 / {y} - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) - ({step}))"


def _psi1(x: str) -> str:
    y = f"({x} + 20)"
    step = " + ".join(f"1 / ({x} + {i}) ** 2" for i in range(20))
    return f"(1 / {y} + 0.5 / {y} ** 2 + 1 / (6 * {y} ** 3) - 1 / (30 * {y} ** 5) + 1 / (42 * {y} ** 7) + {step})"


def _tail(t: str, df: str) -> str:
    """P(T > t): Simpson's rule on the density, which is cos^(df - 1) of the angle atan(t / sqrt(df)).
    The density is nil beyond 14 deviations, so the rule stops there."""
    n = 2000
    weight = f"CASE WHEN k = 0 OR k = {n} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    edge = f"least(pi() / 2, 14 / sqrt({df}))"
    start = f"least({edge}, greatest(-{edge}, atan(({t}) / sqrt({df}))))"

    def area(low: str) -> str:
        angle = f"({low} + ({edge} - ({low})) * k / {n})"
        parts = f"list_transform(range({n + 1}), lambda k: ({weight}) * greatest(cos({angle}), 0) ** ({df} - 1))"
        return f"(list_sum({parts}) * ({edge} - ({low})))"

    return f"({area(start)} / {area(f'(-{edge})')})"


_tests = f"""WITH RECURSIVE {EMBEDDING}, {_profile('cells', 10.0)},
h AS (SELECT DISTINCT feature, CAST(df AS DOUBLE) AS df, s2 FROM fx),
ev AS (SELECT ln(s2) - {_psi('(df / 2)')} + ln(df / 2) AS z, {_psi1('(df / 2)')} AS tri, df, s2 FROM h),
mo AS (SELECT avg(z) AS zm, var_samp(z) - avg(tri) AS target, sum(df) AS pooled, avg(s2) AS s2m FROM ev),
bi AS (SELECT 0 AS it, 1e-6::DOUBLE AS lo, 1e9::DOUBLE AS hi UNION ALL
       SELECT it + 1, CASE WHEN {_psi1('sqrt(lo * hi)')} > target THEN sqrt(lo * hi) ELSE lo END,
              CASE WHEN {_psi1('sqrt(lo * hi)')} > target THEN hi ELSE sqrt(lo * hi) END FROM bi, mo WHERE it < 120),
pr AS (SELECT 2 * lo AS d0, exp(zm + {_psi('lo')} - ln(lo)) AS s0, target, pooled, s2m FROM bi, mo WHERE it = 120),
md AS (SELECT feature, class, logfc, CASE WHEN target > 0 THEN (d0 * s0 + df * s2) / (d0 + df) ELSE s2m END AS s2_post,
              CASE WHEN target > 0 THEN least(d0 + df, pooled) ELSE pooled END AS dft, unscaled FROM fx, pr),
tt AS (SELECT *, (abs(logfc) - 1) / (unscaled * sqrt(s2_post)) AS near, (abs(logfc) + 1) / (unscaled * sqrt(s2_post)) AS far FROM md),
pv AS (SELECT *, {_tail('near', 'dft')} + {_tail('far', 'dft')} AS p FROM tt)"""

ORACLES["moderated_t"] = f"""{_tests},
rk AS (SELECT *, rank() OVER (PARTITION BY class ORDER BY p) AS rn, count(*) OVER (PARTITION BY class) AS m FROM pv),
aj AS (SELECT *, least(1, min(p * m / rn) OVER (PARTITION BY class ORDER BY p DESC)) AS adj FROM rk)
SELECT feature, class, {r('s2_post')} AS s2_post, {r('sign(logfc) * greatest(near, 0)')} AS t, {r('p')} AS p, {r('adj')} AS adj_p,
       CASE WHEN adj < 0.05 THEN CAST(sign(logfc) AS INTEGER) ELSE 0 END AS decision FROM aj"""

ORACLES["ranked_tests"] = f"""{_tests},
rd AS (SELECT class, feature, {r('p')} AS p, {r('logfc')} AS logfc FROM pv)
SELECT class, feature, p, CAST(row_number() OVER (PARTITION BY class ORDER BY p, logfc DESC, feature) AS INTEGER) AS place FROM rd"""

ORACLES["bh_adjust"] = f"""WITH t AS (SELECT o_orderkey, o_orderpriority AS contrast, o_totalprice * 100 % 1000003 / 1000003 AS p FROM orders),
k AS (SELECT *, count(*) OVER (PARTITION BY contrast ORDER BY p) AS seen, count(*) OVER (PARTITION BY contrast) AS m FROM t),
a AS (SELECT *, least(1.0, min(p * m / seen) OVER (PARTITION BY contrast ORDER BY p DESC)) AS adj FROM k)
SELECT o_orderkey, contrast, {r('p', 9)} AS p, {r('adj', 9)} AS adj_p FROM a"""

# Reduction -------------------------------------------------------------------------------------


def _scaled(sd: str) -> str:
    return f"""
sc AS (SELECT i, avg(value) AS mean, {sd} AS sd FROM cells WHERE split <> 'test' GROUP BY i),
z AS (SELECT sample_id, split, i, (value - mean) / sd AS z FROM cells JOIN sc USING (i)),
g AS (SELECT a.i, b.i AS j, sum(a.z * b.z) AS g FROM z a JOIN z b USING (sample_id) WHERE a.split <> 'test' GROUP BY a.i, b.i)"""


ORACLES["gram_matrix"] = f"""WITH {EMBEDDING}, {_scaled('stddev_samp(value)')}
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {r('g')} AS g FROM g"""


def _power(sd: str, steps: int = 6000) -> str:
    dots = ", ".join(f"list_dot_product(rows[{i}], v)" for i in range(1, WIDTH + 1))
    return f"""WITH RECURSIVE {EMBEDDING}, {_scaled(sd)},
gm AS MATERIALIZED (SELECT list(row ORDER BY i) AS rows FROM (SELECT i, list(g ORDER BY j) AS row FROM g GROUP BY i)),
it AS (SELECT 0 AS k, list_transform(range(1, {WIDTH + 1}), lambda i: (1 + sin(i))::DOUBLE) AS v UNION ALL
       SELECT k + 1, list_transform(u, lambda a: a / sqrt(list_dot_product(u, u)))
       FROM (SELECT k, [{dots}] AS u FROM it, gm WHERE k < {steps})),
last AS (SELECT v, list_max(list_transform(v, lambda a: abs(a))) AS top FROM it WHERE k = {steps}),
vv AS (SELECT CASE WHEN list_max(v) = top THEN v ELSE list_transform(v, lambda a: -a) END AS v FROM last)
SELECT sample_id, {r(f'sum(z * v[i])', 4)} AS pc1 FROM z, vv GROUP BY sample_id"""


def _components(k: int, steps: int, gram: str, width: int = WIDTH) -> str:
    """CTE comps(cs): the leading k eigenvectors of gm(rows), one power iteration after the other, each kept off those
    before it. A product over components does not depend on their signs or, in all of them, on their order."""
    dots = ", ".join(f"list_dot_product(rows[{i}], v)" for i in range(1, width + 1))
    fresh = f"list_transform(range(1, {width + 1}), lambda i: (1 + sin(i * (1 + len(found))))::DOUBLE)"
    off = "list_transform(u, lambda a, i: a - coalesce(list_sum(list_transform(list_zip(found, parts), lambda p: p[1][i] * p[2])), 0.0))"
    return f"""
gm AS MATERIALIZED ({gram}),
comp AS (
  SELECT 0 AS s, {fresh.replace("len(found)", "0")} AS v, []::DOUBLE[][] AS found
  UNION ALL
  SELECT s + 1, CASE WHEN (s + 1) % {steps} = 0 THEN {fresh.replace("found", "old")} ELSE v END, CASE WHEN (s + 1) % {steps} = 0 THEN list_append(old, v) ELSE old END
  FROM (SELECT s, found AS old, list_transform(o, lambda a: a / sqrt(list_dot_product(o, o))) AS v
        FROM (SELECT s, found, {off} AS o
              FROM (SELECT s, u, found, list_transform(found, lambda f: list_dot_product(f, u)) AS parts
                    FROM (SELECT s, found, [{dots}] AS u FROM comp, gm WHERE s < {k * steps}))))),
comps AS MATERIALIZED (SELECT found AS cs FROM comp WHERE s = {k * steps})"""


ORACLES["svd_project_top"] = _power("stddev_samp(value)")
ORACLES["pca_project_top"] = _power("1")

# Classifiers -----------------------------------------------------------------------------------
# Accelerated gradient descent on the objective, with the curvature bound 1 + 2 |Z'DZ| and as many steps
# as the bound asks for; the fit being checked is a Newton method, so the two share nothing.


def _descent(problems: str, tail: str, steps: int, width: int = WIDTH) -> str:
    """problems: CTE pb(cls, sample_id, x, y, om) of training rows, x with the constant 1 appended."""
    size = width + 1
    sums = ", ".join(f"sum(c * x[{j}])" for j in range(1, size + 1))
    return f"""{problems},
fr AS (SELECT cls, sqrt(sum(g * g)) AS f FROM (
         SELECT a.cls, a.j AS j, b.j AS k, sum(a.om * a.v * b.v) AS g
         FROM (SELECT cls, sample_id, om, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM pb) a
         JOIN (SELECT cls, sample_id, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM pb) b USING (cls, sample_id)
         GROUP BY ALL) GROUP BY cls),
lip AS MATERIALIZED (SELECT cls, 1 + 2 * f AS l, (sqrt(1 + 2 * f) - 1) / (sqrt(1 + 2 * f) + 1) AS beta FROM fr),
pm AS MATERIALIZED (SELECT * FROM pb),
it AS (
  SELECT 0 AS k, cls, list_transform(range({size}), lambda i: 0.0::DOUBLE) AS w,
         list_transform(range({size}), lambda i: 0.0::DOUBLE) AS v FROM lip
  UNION ALL
  SELECT k + 1, cls, wn, list_transform(list_zip(wn, w), lambda p: p[1] + beta * (p[1] - p[2]))
  FROM (SELECT k, cls, w, beta,
               list_transform(list_zip(v, grad), lambda p: p[1] - (p[1] - 2 * p[2]) / l) AS wn
        FROM (SELECT any_value(k) AS k, cls, any_value(w) AS w, any_value(v) AS v, any_value(l) AS l,
                     any_value(beta) AS beta, [{sums}] AS grad
              FROM (SELECT it.k, it.cls, it.w, it.v, lip.l, lip.beta, pm.x,
                           pm.om * pm.y * greatest(0.0, 1 - pm.y * list_dot_product(pm.x, it.v)) AS c
                    FROM it JOIN pm ON pm.cls = it.cls JOIN lip ON lip.cls = it.cls WHERE it.k < {steps})
              GROUP BY cls))),
fit AS (SELECT cls, w FROM it WHERE k = {steps}),
sco AS (SELECT sample_id, cls, list_dot_product(list_append(x, 1.0), w) AS score FROM src, fit){tail}"""


def _shrinking(problems: str, tail: str, steps: int, width: int = WIDTH) -> str:
    """The same for the absolute penalty: gradient steps that shrink every weight by 1 / l, with momentum that starts
    anew whenever it points uphill."""
    size = width + 1
    sums = ", ".join(f"sum(c * x[{j}])" for j in range(1, size + 1))
    zeros = f"list_transform(range({size}), lambda i: 0.0::DOUBLE)"
    return f"""{problems},
fr AS (SELECT sqrt(sum(g * g)) AS f FROM (
         SELECT a.j AS j, b.j AS k, sum(a.om * a.v * b.v) AS g
         FROM (SELECT sample_id, om, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM pb) a
         JOIN (SELECT sample_id, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM pb) b USING (sample_id)
         GROUP BY ALL)),
lip AS MATERIALIZED (SELECT 2 * f AS l FROM fr),
pm AS MATERIALIZED (SELECT * FROM pb),
it AS (
  SELECT 0 AS k, 0 AS t, {zeros} AS w, {zeros} AS v
  UNION ALL
  SELECT k + 1, CASE WHEN uphill > 0 THEN 0 ELSE t + 1 END, wn,
         list_transform(list_zip(wn, w), lambda p: p[1] + CASE WHEN uphill > 0 THEN 0 ELSE (t + 1) / (t + 4) END * (p[1] - p[2]))
  FROM (SELECT *, list_sum(list_transform(list_zip(v, wn, w), lambda p: (p[1] - p[2]) * (p[2] - p[3]))) AS uphill
        FROM (SELECT k, t, w, v, list_transform(list_transform(list_zip(v, grad), lambda p: p[1] + 2 * p[2] / l),
                                                lambda a: sign(a) * greatest(abs(a) - 1 / l, 0.0)) AS wn
              FROM (SELECT any_value(k) AS k, any_value(t) AS t, any_value(w) AS w, any_value(v) AS v, any_value(l) AS l,
                           [{sums}] AS grad
                    FROM (SELECT it.k, it.t, it.w, it.v, lip.l, pm.x,
                                 pm.om * pm.y * greatest(0.0, 1 - pm.y * list_dot_product(pm.x, it.v)) AS c
                          FROM it, pm, lip WHERE it.k < {steps})
                    HAVING count(*) > 0)))),
fit AS (SELECT 1 AS cls, w FROM it WHERE k = {steps}),
sco AS (SELECT sample_id, cls, list_dot_product(list_append(x, 1.0), w) AS score FROM src, fit){tail}"""


def _binary(src: str, label: str, weight: str = "1") -> str:
    return f"""
src AS ({src}),
nb AS (SELECT {label} AS y1, count(*) AS n FROM src WHERE split <> 'test' GROUP BY 1),
pb AS (SELECT 1 AS cls, sample_id, list_append(x, 1.0) AS x, CASE WHEN {label} THEN 1 ELSE -1 END AS y,
              (SELECT sum(n) FROM nb)::DOUBLE / (2 * n) * ({weight}) AS om
       FROM src JOIN nb ON nb.y1 = ({label}) WHERE split <> 'test')"""


def _ovr(src: str, label: str) -> str:
    return f"""
src AS ({src}),
nb AS (SELECT {label} AS cls, count(*) AS n FROM src WHERE split <> 'test' GROUP BY 1),
pb AS (SELECT nb.cls, sample_id, list_append(x, 1.0) AS x, CASE WHEN {label} = nb.cls THEN 1 ELSE -1 END AS y,
              CASE WHEN {label} = nb.cls THEN (SELECT sum(n) FROM nb)::DOUBLE / ((SELECT count(*) FROM nb) * n) ELSE 1 END AS om
       FROM src, nb WHERE split <> 'test')"""


_score = f"\nSELECT sample_id, {r('score', 4)} AS score FROM sco"
_all = "SELECT * FROM e"
IS_CANCER = "(cancer_status = 'cancer')"
ORACLES["svm_binary"] = f"WITH RECURSIVE {EMBEDDING}, {_descent(_binary(_all, IS_CANCER), _score, 1200)}"
ORACLES["svm_binary_row_weights"] = (
    f"WITH RECURSIVE {EMBEDDING}, {_descent(_binary(_all, IS_CANCER, '1 + vec_id % 3'), _score, 1600)}"
)
ORACLES["svm_binary_l1"] = f"WITH RECURSIVE {EMBEDDING}, {_shrinking(_binary(_all, IS_CANCER), _score, 3000)}"
_class_scores = f"\nSELECT sample_id, cls AS class, {r('score', 4)} AS score FROM sco"
ORACLES["svm_ovr"] = f"WITH RECURSIVE {EMBEDDING}, {_descent(_ovr(_all, 'class'), _class_scores, 1200)}"

# Scores ----------------------------------------------------------------------------------------

_mean_scores = """
cm AS (SELECT class AS cls, i, avg(value) AS w FROM cells WHERE split <> 'test' GROUP BY class, i),
sco AS (SELECT sample_id, cls, sum(value * w) AS score FROM cells JOIN cm USING (i) GROUP BY sample_id, cls)"""
ORACLES["score_fixed_weights"] = f"""WITH {EMBEDDING}, {_mean_scores},
k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, cls) AS place FROM sco)
SELECT sample_id, {r('max(score)')} AS best, {r('min(score)')} AS worst, max(CASE WHEN place = 1 THEN cls END) AS label
FROM k GROUP BY sample_id"""


def _post(classes: list[str], columns: str, rest: str, label: str = "pred_label", digits: int = 6) -> str:
    """Probabilities, ratio and label from sco(sample_id, cls, score); `columns` and `rest` join the annotation."""
    spread = ", ".join(f"""{r(f"max(CASE WHEN cls = '{c}' THEN p END)", digits)} AS {c}""" for c in classes)
    ratio = r("max(CASE WHEN place = 1 THEN p END) / max(CASE WHEN place = 2 THEN p END)", digits)
    return f"""
sg AS (SELECT sample_id, cls, 1 / (1 + exp(-3 * score)) AS q FROM sco),
pp AS (SELECT sample_id, cls, q / sum(q) OVER (PARTITION BY sample_id) AS p FROM sg),
kk AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY p DESC, cls) AS place FROM pp),
po AS (SELECT sample_id, {spread}, {ratio} AS ratio, max(CASE WHEN place = 1 THEN cls END) AS "{label}"
       FROM kk GROUP BY sample_id)
SELECT po.*{columns} FROM po {rest}"""


_ten = [f"c{i}" for i in range(CLASSES)]
ORACLES["probability_post"] = f"WITH {EMBEDDING}, {_mean_scores}, {_post(_ten, '', '')}"

# Mixture ---------------------------------------------------------------------------------------

TISSUES = ["africa", "america", "asia", "europe", "middle_east"]
T = len(TISSUES)
_ab = ", ".join(f"{r(f'sum(value * a[{i + 1}])', 5)} AS ab_{t}" for i, t in enumerate(TISSUES))
_aa = ", ".join(f"{r(f'sum(a[{i + 1}] * a[{j + 1}])', 5)} AS aa_{i}_{j}" for i in range(T) for j in range(i, T))
ORACLES["deconv_stats"] = f"""WITH {MIXTURE}
SELECT sample_id, count(*) AS n, {r('sum(value * value)', 5)} AS bb, {_ab}, {_aa} FROM mx GROUP BY sample_id"""
_gab = ", ".join(f"{r(f'coalesce(sum(v * a[{i + 1}]), 0)', 5)} AS ab_{t}" for i, t in enumerate(TISSUES))
_gaa = ", ".join(
    f"{r(f'coalesce(sum(a[{i + 1}] * a[{j + 1}]) FILTER (v IS NOT NULL), 0)', 5)} AS aa_{i}_{j}"
    for i in range(T) for j in range(i, T)
)
ORACLES["deconv_all_samples"] = f"""WITH {MIXTURE},
gx AS (SELECT sample_id, a, CASE WHEN (length(feature) * 7 + length(sample_id) * 3) % 5 <> 0 AND sample_id <> '{EMPTY_SAMPLE}'
                                 THEN value END AS v FROM mx)
SELECT sample_id, count(v) AS n, {r('coalesce(sum(v * v), 0)', 5)} AS bb, {_gab}, {_gaa} FROM gx GROUP BY sample_id"""

# every support of the fractions: solve its equations with Gauss-Jordan steps, keep the feasible ones, take
# the one of least error
_g = ", ".join("[" + ", ".join(f"sum(a[{i}] * a[{j}])" for j in range(1, T + 1)) + "]" for i in range(1, T + 1))
_c = ", ".join(f"sum(value * a[{i}])" for i in range(1, T + 1))
_in = "(s >> (i - 1)::INTEGER) & 1 = 1"
_jn = "(s >> (j - 1)::INTEGER) & 1 = 1"
_x = ", ".join(f"{r(f'x[{i + 1}]')} AS {t}" for i, t in enumerate(TISSUES))
ORACLES["deconv_fractions"] = f"""WITH RECURSIVE {MIXTURE},
st AS (SELECT sample_id, [{_g}] AS g, [{_c}] AS c FROM mx GROUP BY sample_id),
sys AS (SELECT sample_id, s, g, c, list_transform(range(1, {T + 2}), lambda i: list_transform(range(1, {T + 3}), lambda j:
          CASE WHEN i <= {T} AND NOT ({_in}) THEN CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0 END
               WHEN i <= {T} THEN CASE WHEN j <= {T} THEN CASE WHEN {_jn} THEN g[i][j] ELSE 0.0 END
                                       WHEN j = {T + 1} THEN 1.0 ELSE c[i] END
               ELSE CASE WHEN j <= {T} THEN CASE WHEN {_jn} THEN 1.0 ELSE 0.0 END
                         WHEN j = {T + 1} THEN 0.0 ELSE 1.0 END END)) AS m
        FROM st, (SELECT unnest(range(1, {2**T})) AS s)),
gj AS (SELECT 1 AS p, sample_id, s, g, c, m FROM sys UNION ALL
       SELECT p + 1, sample_id, s, g, c, list_transform(range(1, {T + 2}), lambda i:
          list_transform(range(1, {T + 3}), lambda j:
            CASE WHEN i = p THEN m[p][j] / m[p][p] ELSE m[i][j] - m[i][p] * m[p][j] / m[p][p] END)) FROM gj WHERE p <= {T + 1}),
so AS (SELECT sample_id, g, c, list_transform(range(1, {T + 1}), lambda i: m[i][{T + 2}]) AS x FROM gj WHERE p = {T + 2}),
ok AS (SELECT sample_id, x, 0.5 * list_dot_product(x, list_transform(g, lambda q: list_dot_product(q, x))) - list_dot_product(c, x) AS err
       FROM so WHERE list_min(x) >= -1e-12),
be AS (SELECT sample_id, arg_min(x, err) AS x FROM ok GROUP BY sample_id)
SELECT sample_id, {_x} FROM be"""

_two_parts = """
two AS (SELECT feature, max(value) FILTER (tissue = t.a) AS p, max(value) FILTER (tissue = t.b) AS q
        FROM pr, (SELECT (list(r_name ORDER BY r_name))[1] AS a, (list(r_name ORDER BY r_name))[2] AS b FROM region) t
        WHERE tissue IN (t.a, t.b) GROUP BY feature HAVING count(*) = 2),
st AS (SELECT sample_id, count(*) AS n, sum((p - q) * (p - q)) AS c, sum((p - q) * (value - q)) AS h, sum((value - q) * (value - q)) AS s
       FROM sc JOIN two USING (feature) GROUP BY sample_id),
md AS (SELECT *, h / c AS mid, s - h * h / c AS least FROM st),
tp AS (SELECT *, least + c * (greatest(0, least(1, mid)) - mid) ** 2 AS at_top FROM md),
rc AS (SELECT *, sqrt((at_top * exp(60.0 / n) - least) / c) AS reach FROM tp),
gr AS (SELECT sample_id, n, c, mid, least, at_top,
              greatest(0, mid - reach) + (least(1, mid + reach) - greatest(0, mid - reach)) * (k + 0.5) / 20000 AS t
       FROM rc, range(20000) k(k)),
ws AS (SELECT sample_id, t, exp(-n / 2.0 * (ln(least + c * (t - mid) ** 2) - ln(at_top))) AS w FROM gr),
ms AS (SELECT sample_id, sum(w * t) / sum(w) AS t FROM ws GROUP BY sample_id)"""
#: The names of the first two regions, as TPC-H has them.
ORACLES["deconv_posterior_two"] = f"""WITH {MIXTURE}, {_two_parts}
SELECT sample_id, {r('t', 5)} AS africa, {r('1 - t', 5)} AS america FROM ms"""
ORACLES["deconv_posterior_drawn"] = f"""WITH {MIXTURE}
SELECT DISTINCT sample_id, true AS whole, true AS inside FROM mx"""

# Files -----------------------------------------------------------------------------------------

ORACLES["matrix_file_gzip"] = ORACLES["unpivot_cells"]


def _annotation(missing: str) -> str:
    odd = "CASE class WHEN 'c1' THEN 'null' WHEN 'c2' THEN 'NaN' WHEN 'c3' THEN 'NA' ELSE '1e3' END"
    return f"""WITH {EMBEDDING}
SELECT '00' || sample_id AS id, split_gaps, CASE WHEN {odd} NOT IN ({missing}) THEN {odd} END AS odd FROM e"""


ORACLES["annotation_file_lenient"] = _annotation("'NA'")
ORACLES["annotation_file_strict"] = _annotation("'NA', 'NaN', 'null'")
ORACLES["list_files"] = """WITH b AS (SELECT DISTINCT p_brand FROM part)
SELECT 'names' AS form, p_brand AS feature, 1::BIGINT AS n FROM b
UNION ALL SELECT 'lines', '  ' || p_brand || ' ', 1 FROM b
UNION ALL SELECT 'lines', '', count(*) FROM b"""
ORACLES["profile_file"] = f"""WITH {MIXTURE}
SELECT feature, tissue, {r('value', 8)} AS value FROM pr"""
ORACLES["prediction_file"] = """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, true AS same,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority || ', "x"' END AS label FROM orders"""
ORACLES["fraction_file"] = ORACLES["deconv_fractions"]
ORACLES["strict_cast"] = """SELECT event_id,
  CASE WHEN event_id % 5 > 1 THEN CAST(regexp_extract(props, '([0-9]+)', 1) || '.25' AS DOUBLE) END AS value FROM events"""

# Studies ---------------------------------------------------------------------------------------

_detected = f"""
SELECT e.sample_id, class, cancer_status, split, {r('score', 4)} AS "pred.score_multi.cancer"
FROM e JOIN sco USING (sample_id) WHERE split = 'test'"""
ORACLES["study_detection"] = f"WITH RECURSIVE {EMBEDDING}, {_descent(_binary(_all, IS_CANCER), _detected, 1200)}"

_supplier_cells = """
sx AS (SELECT 'S' || l_suppkey || CASE WHEN l_linestatus = 'O' THEN '_tumor' ELSE '_normal.tissue' END AS sample_id,
              CASE WHEN l_linestatus = 'O' THEN 'cancer' ELSE 'normal' END AS cancer_status,
              CASE WHEN l_suppkey % 2 = 1 THEN 'train' ELSE 'test' END AS split, list(value ORDER BY feature) AS x
       FROM (SELECT l_suppkey, l_linestatus, p_brand AS feature, round(avg(l_discount * 10), 8) AS value
             FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, l_linestatus, p_brand)
       GROUP BY l_suppkey, l_linestatus)"""
_watched = f"""
SELECT src.sample_id, cancer_status, split, {r('score', 4)} AS "pred.score_liver.cancer"
FROM src JOIN sco USING (sample_id) WHERE split = 'test'"""
ORACLES["study_surveillance"] = (
    f"WITH RECURSIVE {_supplier_cells}, {_descent(_binary('SELECT * FROM sx', IS_CANCER), _watched, 4000, 25)}"
)

_cancers = "SELECT * FROM e WHERE cancer_status <> 'normal'"
_typed = _post(
    ["c0", "c1", "c2"], ", cancer_status, class AS cancer_type, split", "JOIN src USING (sample_id) WHERE split = 'test'", digits=4
)
ORACLES["study_typing"] = f"WITH RECURSIVE {EMBEDDING}, {_descent(_ovr(_cancers, 'class'), ', ' + _typed, 1000)}"

# the marker list is as long as the data says; vectors are filled up with zeros, which changes no fit
_marked = f"""SELECT sample_id, class, cells.split, e.split_gaps, list_resize(list(value ORDER BY cells.i), {WIDTH}, 0.0::DOUBLE) AS x
FROM cells JOIN e USING (sample_id, class) WHERE feature IN {_wanted} GROUP BY ALL"""
_raced = _post(_ten, ", class AS race, split", "JOIN src USING (sample_id) WHERE split = 'test'", "pred.label", 4)
ORACLES["study_race"] = f"WITH RECURSIVE {EMBEDDING}, {_descent(_ovr(_marked, 'class'), ', ' + _raced, 1200)}"

_any_case = _marked.replace("cells.split,", "CASE WHEN lower(coalesce(e.split_gaps, 'nan')) = 'test' THEN 'test' ELSE 'train' END AS split,")
_diseased = _post(_ten, ", class AS true_label", "JOIN src USING (sample_id) WHERE split = 'test'", digits=4)
ORACLES["study_disease"] = f"WITH RECURSIVE {EMBEDDING}, {_descent(_ovr(_any_case, 'class'), ', ' + _diseased, 1200)}"

_any_cells = f"""
av AS (SELECT sample_id, class, CASE WHEN lower(coalesce(e.split_gaps, 'nan')) = 'test' THEN 'test' ELSE 'train' END AS split, i, value
       FROM cells JOIN e USING (sample_id, class) WHERE feature IN {_wanted}),
am AS (SELECT i, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS sd
       FROM av WHERE split <> 'test' GROUP BY i)"""
_even = f"""SELECT sample_id, class, split, list_resize(list((value - mean) / sd ORDER BY i), {WIDTH}, 0.0::DOUBLE) AS x
FROM av JOIN am USING (i) GROUP BY ALL"""
ORACLES["study_disease_rotated"] = (
    f"WITH RECURSIVE {EMBEDDING}, {_any_cells}, {_descent(_ovr(_even, 'class'), ', ' + _diseased, 1500)}"
)

# a fit on components turns with them, so it depends on the space they span and on nothing else
_own_gram = """SELECT list(row ORDER BY i) AS rows FROM (SELECT i, list(g ORDER BY j) AS row FROM (
  SELECT a.i, b.i AS j, sum(a.v * b.v) AS g
  FROM (SELECT sample_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM ({full}) WHERE split <> 'test') a
  JOIN (SELECT sample_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM ({full}) WHERE split <> 'test') b USING (sample_id)
  GROUP BY ALL) GROUP BY i)"""
_less = f"""
ev AS MATERIALIZED ({_even}),{_components(8, 4000, _own_gram.format(full='SELECT * FROM ev'))}"""
_short = "SELECT ev.* REPLACE (list_transform(cs, lambda c: list_dot_product(c, x)) AS x) FROM ev, comps"
ORACLES["study_disease_reduced"] = (
    f"WITH RECURSIVE {EMBEDDING}, {_any_cells}, {_less}, {_descent(_ovr(_short, 'class'), ', ' + _diseased, 1200, 8)}"
)

_train_even = """
zs AS MATERIALIZED (SELECT sample_id, class, cancer_status, split, list((value - mean) / sd ORDER BY i) AS x
  FROM cells JOIN (SELECT i, avg(value) AS mean, stddev_samp(value) AS sd FROM cells WHERE split <> 'test' GROUP BY i) USING (i)
  GROUP BY ALL)"""
_three = f"{_train_even},{_components(3, 8000, _own_gram.format(full='SELECT * FROM zs'))}"
_on_three = "SELECT zs.* REPLACE (list_transform(cs, lambda c: list_dot_product(c, x)) AS x) FROM zs, comps"
_detected_three = f"""
SELECT sample_id, class, cancer_status, split, {r('score', 4)} AS score
FROM src JOIN sco USING (sample_id) WHERE split = 'test'"""
ORACLES["study_detection_reduced"] = (
    f"WITH RECURSIVE {EMBEDDING}, {_three}, {_descent(_binary(_on_three, IS_CANCER), _detected_three, 1200, 3)}"
)
