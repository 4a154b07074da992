"""Closed forms of point processes, checked in SQL by power iteration, Neumann sums and power series (HWK, CPL)."""

from __future__ import annotations

import math

import numpy as np

from tapeworks.operators import flow as fl
from tapeworks.operators import hawkes as hk
from tapeworks.plans.registry import query
from tapeworks.sources import parameters as par

_B = f"CAST({par.DECAY} AS DOUBLE)"


def _list(values) -> str:
    return "[" + ", ".join(_list(v) if isinstance(v, list) else f"CAST({v} AS DOUBLE)" for v in values) + "]"


_SIGNS = {6: [1, -1, 1, -1, -1, 1], 2: [1, -1]}

#: hp: every process with its signs p and branching matrix g. hw: after k steps the rates lam, the resolvent by columns rt,
#: a positive vector x and the branching ratio rho; the scaled kernel's ratio is rhos. hv: the state covariance.
_FORMS = (
    "hp AS (SELECT name, mu, p, list_transform(a, lambda r: list_transform(r, lambda v: v / " + _B + ")) AS g FROM (VALUES "
    + ", ".join(f"('{n}', {_list(mu)}, {_list(a)}, {_list(_SIGNS[len(mu)])})" for n, (mu, a) in (par.FLOWS | par.PAIRS).items() if len(mu) == 6)
    + " UNION ALL VALUES "
    + ", ".join(f"('{n}', {_list(mu)}, {_list(a)}, {_list(_SIGNS[len(mu)])})" for n, (mu, a) in (par.FLOWS | par.PAIRS).items() if len(mu) == 2)
    + """) v(name, mu, a, p)),
    hg AS (SELECT *, list_transform(g, lambda r, i: list_transform(r, lambda v, j: v * CASE WHEN p[i] = p[j] THEN 1 ELSE 0.5 :: DOUBLE END)) AS gs, list_transform(g, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = j THEN 1 :: DOUBLE ELSE 0 END)) AS eye FROM hp),
    hw AS (
        SELECT name, 0 AS k, mu, mu AS lam, p, g, gs, eye, eye AS rt, list_transform(mu, lambda v: 1 :: DOUBLE) AS x, list_transform(mu, lambda v: 1 :: DOUBLE) AS xs, 0 :: DOUBLE AS rho, 0 :: DOUBLE AS rhos FROM hg
        UNION ALL
        SELECT name, k + 1, mu, list_transform(g, lambda r, i: mu[i] + list_dot_product(r, lam)), p, g, gs, eye,
            list_transform(rt, lambda c, j: list_transform(g, lambda r, i: eye[i][j] + list_dot_product(r, c))), list_transform(y, lambda v: v / list_max(y)), list_transform(ys, lambda v: v / list_max(ys)), list_max(y), list_max(ys)
        FROM (SELECT *, list_transform(g, lambda r: list_dot_product(r, x)) AS y, list_transform(gs, lambda r: list_dot_product(r, xs)) AS ys FROM hw WHERE k < 300)
    ),
    hr AS (SELECT * FROM hw WHERE k = 300),
    hv AS (
        SELECT name, 0 AS k, lam, g, eye, list_transform(g, lambda r: list_transform(r, lambda v: 0 :: DOUBLE)) AS v FROM hr
        UNION ALL
        SELECT name, k + 1, lam, g, eye, list_transform(m, lambda r, i: list_transform(r, lambda z, j: eye[i][j] * lam[i] / (2 * """ + _B + """) + (z + m[j][i]) / 2))
        FROM (SELECT *, list_transform(g, lambda r: list_transform(v, lambda c: list_dot_product(r, c))) AS m FROM hv WHERE k < 300)
    ),
    hc AS (SELECT r.*, v.v, list_transform(r.g, lambda a, i: list_transform(a, lambda b, j: list_sum(list_transform(r.rt, lambda c, k: c[i] * r.lam[k] * c[j])))) AS c FROM hr r JOIN hv v ON v.name = r.name AND v.k = 300)"""
)

#: he: the response e by a power series at each horizon, phi its integral and psi the integral of that.
_RESPONSE = """ht AS (
        SELECT h, 0 AS m, g, eye, eye AS t, eye AS s FROM hr, (VALUES (0.1 :: DOUBLE), (1.0), (5.0), (10.0)) v(h) WHERE name = 'resilient'
        UNION ALL
        SELECT h, m + 1, g, eye, u, list_transform(s, lambda r, i: list_transform(r, lambda z, j: z + u[i][j]))
        FROM (SELECT *, list_transform(t, lambda r: list_transform(r, lambda z, j: list_sum(list_transform(r, lambda w, k: w * g[k][j])) * """ + _B + """ * h / (m + 1))) AS u FROM ht WHERE m < 160)
    ),
    h1 AS (SELECT h, list_transform(s, lambda r: list_transform(r, lambda z: z * exp(-h * """ + _B + """))) AS e FROM ht WHERE m = 160),
    h2 AS (SELECT h1.*, r.rt, r.eye, r.mu, r.lam, r.g, list_transform(e, lambda a, i: list_transform(r.rt, lambda c: list_dot_product(list_transform(a, lambda z, j: r.eye[i][j] - z), c) / """ + _B + """)) AS phi FROM h1, hr r WHERE r.name = 'resilient'),
    he AS (SELECT *, list_transform(phi, lambda a, i: list_transform(rt, lambda c: list_dot_product(list_transform(a, lambda z, j: h * eye[i][j] - z), c) / """ + _B + """)) AS psi FROM h2)"""


def forms_sql(body: str, more: str = "") -> str:
    return "WITH RECURSIVE " + _FORMS + (", " + more if more else "") + " " + body


@query(
    "HWK02_closed_forms",
    forms_sql(
        "SELECT name, round(rho, 9) AS branching_ratio, round(list_sum(lam), 9) AS total_rate, round(1 - list_sum(mu) / list_sum(lam), 9) AS endogenous_fraction, round(list_sum(lam) / list_sum(mu), 9) AS cluster_size, "
        "round(list_dot_product(p, list_transform(g, lambda r: list_dot_product(r, list_transform(p, lambda v, j: v * lam[j])))) / list_sum(lam), 9) AS signed_endogenous_fraction, "
        "round(list_sum(list_transform(rt, lambda x, j: p[j] * lam[j] * list_dot_product(p, x))) / list_sum(lam), 9) AS signed_descendants, "
        f"round(1 / ({_B} * (1 - rho)), 9) AS relaxation_time, round(list_sum(list_transform(v, lambda r, i: r[i])), 9) AS state_variance, round(list_sum(list_transform(c, lambda r, i: r[i])), 6) AS count_variance_rate FROM hc"
    ),
)
def hwk02(spark, sf_dir):
    """Branching ratios, rates, times and signed measures of every example process."""
    rows = []
    for name in (*par.FLOWS, *par.PAIRS):
        p = par.flow(name)
        signs = fl.PRESSURE if p.d == 6 else np.array([1.0, -1.0])
        values = (p.branching_ratio, p.rates.sum(), p.endogenous_fraction(), p.mean_cluster_size(), p.signed_endogenous_fraction(signs), p.signed_descendants(signs), p.relaxation_time(), np.trace(p.state_covariance()))
        rows.append((name, *(round(float(x), 9) for x in values), round(float(np.trace(p.count_covariance_rate())), 6)))
    return spark.createDataFrame(rows, "name string, branching_ratio double, total_rate double, endogenous_fraction double, cluster_size double, signed_endogenous_fraction double, signed_descendants double, relaxation_time double, state_variance double, count_variance_rate double")


@query("HWK03_built_from_rates", forms_sql("SELECT q AS branching_ratio, CAST(i - 1 AS INTEGER) AS type, round(lam[i] - q / rhos * list_dot_product(gs[i], lam), 9) AS baseline, round(lam[i], 9) AS rate FROM hr, (VALUES (0.1 :: DOUBLE), (0.3), (0.5)) v(q), range(1, 7) w(i) WHERE name = 'balanced'"))
def from_rates(spark, sf_dir):
    """A ladder of branching ratios at the same stationary rates."""
    p, rows = par.flow("balanced"), []
    for ratio in (0.1, 0.3, 0.5):
        q = hk.Hawkes.from_rates(p.rates, hk.cross_pressure_scaled(p.a, fl.PRESSURE, 0.5), p.beta, ratio)
        rows += [(ratio, k, round(float(q.mu[k]), 9), round(float(q.rates[k]), 9)) for k in range(q.d)]
    return spark.createDataFrame(rows, "branching_ratio double, type int, baseline double, rate double")


@query("HWK05_stationary_moments", forms_sql(f"SELECT CAST(i - 1 AS INTEGER) AS type, CAST(j - 1 AS INTEGER) AS other, round(lam[i] / {_B}, 9) AS state_mean, round(v[i][j], 9) AS state_covariance, round(c[i][j], 6) AS count_covariance_rate FROM hc, range(1, 7) a(i), range(1, 7) b(j) WHERE name = 'resilient'"))
def moments(spark, sf_dir):
    p = par.flow("resilient")
    v, c, m = p.state_covariance(), p.count_covariance_rate(), p.state_mean()
    return spark.createDataFrame([(i, j, round(float(m[i]), 9), round(float(v[i, j]), 9), round(float(c[i, j]), 6)) for i in range(6) for j in range(6)], "type int, other int, state_mean double, state_covariance double, count_covariance_rate double")


@query("HWK06_mean_response", forms_sql("SELECT h AS horizon, CAST(i - 1 AS INTEGER) AS type, CAST(j - 1 AS INTEGER) AS cause, round(e[i][j], 9) AS response, round(phi[i][j], 9) AS integral FROM he, range(1, 7) a(i), range(1, 7) b(j) WHERE h < 10", _RESPONSE))
def response(spark, sf_dir):
    p, rows = par.flow("resilient"), []
    for h in (0.1, 1.0, 5.0):
        e, phi = p.response(h), p.response_integral(h)
        rows += [(h, i, j, round(float(e[i, j]), 9), round(float(phi[i, j]), 9)) for i in range(6) for j in range(6)]
    return spark.createDataFrame(rows, "horizon double, type int, cause int, response double, integral double")


@query(
    "HWK07_forward_means",
    forms_sql(
        "SELECT h AS horizon, CAST(i - 1 AS INTEGER) AS type, round(s[i], 9) AS mean_state, round(n, 7) AS mean_count, round(n, 7) AS mean_count_about_the_mean FROM "
        f"(SELECT h, i, list_transform(e, lambda r, k: list_sum(r) + list_dot_product(phi[k], mu)) AS s, h * mu[i] + {_B} * list_dot_product(g[i], list_transform(phi, lambda r, k: list_sum(r) + list_dot_product(psi[k], mu))) AS n FROM he, range(1, 7) a(i) WHERE h <> 5)",
        _RESPONSE,
    ),
)
def hwk07(spark, sf_dir):
    """Expected states and counts ahead of a state of ones; the expectation about the mean is the same number."""
    p = par.flow("resilient")
    rows = []
    for h in (0.1, 1.0, 10.0):
        s, c = p.forward_state(np.ones(6), h), p.forward_counts(np.ones(6), h)
        rows += [(h, k, round(float(s["total"][k]), 9), round(float(c["total"][k]), 7), round(float(c["stationary"][k] + c["deviation"][k]), 7)) for k in range(6)]
    return spark.createDataFrame(rows, "horizon double, type int, mean_state double, mean_count double, mean_count_about_the_mean double")


@query(
    "CPL08_closed_forms",
    forms_sql(
        "SELECT round(r + (1 - r) * exp(-gone / 60), 9) AS fluid_touch, CASE WHEN drain > 0 THEN round(60 / gone * ln(1 + gone / (60 * drain)), 9) END AS emptying_time, round(25 / side, 9) AS diffusive_scale, round(push / 100, 9) AS second_regime_rate, "
        "round(push * power(1 / 10 :: DOUBLE - 0.5 / 8, 2), 9) AS flow_part, round(0.25 * list_sum(lam) / 64, 9) AS placement_part, round(push * power(1 / 10 :: DOUBLE - 0.5 / 8, 2) + 0.25 * list_sum(lam) / 64, 9) AS total "
        "FROM (SELECT lam, lam[5] AS gone, lam[2] - 0.2 * lam[3] AS drain, 60 * (0.2 * lam[3] - lam[2]) / lam[5] AS r, list_sum(list_transform(rt, lambda x, k: lam[k] * power(x[3] - x[2] - x[5], 2))) AS side, list_sum(list_transform(rt, lambda x, k: lam[k] * power(list_dot_product(p, x), 2))) AS push FROM hr WHERE name = 'balanced')"
    ),
)
def cpl08(spark, sf_dir):
    p, m = par.flow("balanced"), par.marks("unit")
    rates = fl.closed_form_rates(p, 5, np.full(6, 0.5), 4.0, 0.0)
    empty = fl.fluid_emptying_time(p, m, 60, 1.0)
    values = {"fluid_touch": fl.fluid_touch(p, m, 60, 1.0, np.array([1.0]))[0], "emptying_time": None if math.isinf(empty) else empty, "diffusive_scale": fl.diffusive_scale(p, 5), "second_regime_rate": fl.second_regime_rate(p, 5), **rates}
    return spark.createDataFrame([tuple(None if v is None else round(float(v), 9) for v in values.values())], ", ".join(f"{k} double" for k in values))
