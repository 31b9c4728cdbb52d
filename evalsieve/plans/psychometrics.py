"""Item response theory plans over a response matrix in long form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, irt
from .fixtures import FLAWED_SQL, RESPONSES_SQL, flawed_responses, responses, table
from .registry import query

GRID41 = "g AS (SELECT range AS g, -4e0 + range * 0.2e0 AS theta FROM range(41))"
PAR = "par AS (SELECT DISTINCT item, 0.4e0 + (item % 5) * 0.35e0 AS a, b_true AS b, (item % 4) * 0.1e0 AS c FROM responses)"
INFO = "info AS (SELECT item, g, theta, a * a * p * (1 - p) AS information FROM (SELECT item, g, theta, a, 1 / (1 + exp(-a * (theta - b))) AS p FROM par, g))"
RND = 6


def newton_sql(steps: int = 12) -> str:
    """CTEs that end in fit(item, a, b, fit_p_value, flags): Newton steps of the 2PL likelihood on logit abilities.

    The p-value of r over n pairs is 1 - 2 G((n - 1) / 2) / (sqrt(pi) G((n - 2) / 2)) times the integral of cos^(n - 3)
    from 0 to asin |r|, here by Simpson's rule.
    """
    out = "seen AS MATERIALIZED (SELECT item, response AS r, theta FROM responses JOIN abilities USING (model)), w0 AS (SELECT item, 1e0 AS u, 0e0 AS v FROM seen GROUP BY item)"
    for k in range(steps):
        out += f""",
    h{k} AS (SELECT item, any_value(u) AS u, any_value(v) AS v, sum(q * theta * theta) + 1e-10 AS aa, sum(q * theta) AS ab, sum(q) + 1e-10 AS bb, sum((r - p) * theta) AS ga, sum(r - p) AS gb
        FROM (SELECT *, p * (1 - p) AS q FROM (SELECT item, r, theta, u, v, 1 / (1 + exp(-greatest(-30e0, least(30e0, u * theta + v)))) AS p FROM seen JOIN w{k} USING (item))) GROUP BY item),
    w{k + 1} AS MATERIALIZED (SELECT item, u + greatest(-5e0, least(5e0, (bb * ga - ab * gb) / (aa * bb - ab * ab))) AS u, v + greatest(-5e0, least(5e0, (aa * gb - ab * ga) / (aa * bb - ab * ab))) AS v FROM h{k})"""
    return out + f""",
    tell AS (SELECT item, avg(r) AS mean, count(*) AS n, covar_pop(theta, r) / nullif(sqrt(var_pop(theta) * var_pop(r)), 0) AS rho FROM seen GROUP BY item),
    tail AS (SELECT item, greatest(0e0, 1 - 2 * exp(lgamma((n - 1) / 2e0) - lgamma((n - 2) / 2e0)) / sqrt(pi()) * asin(abs(rho)) / 3000 * list_sum(list_transform(range(1001),
        lambda i: (CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * power(cos(asin(abs(rho)) * i / 1000), n - 3)))) AS p FROM tell WHERE rho IS NOT NULL),
    fit AS (SELECT *, coalesce(nullif(concat_ws(',', CASE WHEN a < 0.3e0 AND a > 0 THEN 'LOW_DISCRIMINATION' END, CASE WHEN b > 3 THEN 'FLOOR' END, CASE WHEN b < -3 THEN 'CEILING' END), ''), 'OK') AS flags FROM (
        SELECT item, CASE WHEN mean >= 0.99e0 OR mean <= 0.01e0 THEN 0e0 ELSE u END AS a, CASE WHEN mean >= 0.99e0 THEN -4e0 WHEN mean <= 0.01e0 THEN 4e0 ELSE -v / u END AS b, p AS fit_p_value
        FROM w{steps} JOIN tell USING (item) LEFT JOIN tail USING (item)))"""


FIT_SQL = f"{FLAWED_SQL}, {newton_sql()}"
PAR_SQL = f"{FIT_SQL}, par AS (SELECT item, a, b FROM fit)"


def fitted(spark, sf_dir):
    """(item, a, b, flags, fit_p_value) estimated from the flawed response matrix."""
    return irt.fit(flawed_responses(spark, sf_dir).select("model", "item", "response"))


def parameters(spark, sf_dir):
    """Fixed parameters for each item: what an estimate would be."""
    return responses(spark, sf_dir).groupBy("item").agg(F.first("b_true").alias("b")).select("item", (0.4 + (F.col("item") % 5) * 0.35).alias("a"), "b", ((F.col("item") % 4) * 0.1).alias("c"))


def informed(spark, sf_dir):
    return irt.item_information(fitted(spark, sf_dir).select("item", "a", "b"), irt.grid(spark, -4.0, 4.0, 41))


@query(f"WITH {RESPONSES_SQL} SELECT model, round(theta, 6) AS theta FROM abilities")
def ability_logit(spark, sf_dir):
    return irt.abilities(responses(spark, sf_dir)).withColumn("theta", F.round("theta", RND))


@query(f"WITH {RESPONSES_SQL} SELECT model, item, CASE WHEN substr(md5(model || '-' || item), 1, 1) <> '0' THEN response ELSE 0.5e0 END AS response FROM responses")
def response_grid_fill(spark, sf_dir):
    r = responses(spark, sf_dir).select("model", "item", "response")
    kept = r.where(F.substring(F.md5(F.concat_ws("-", F.col("model").cast("string"), F.col("item").cast("string"))), 1, 1) != "0")
    return irt.filled(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("model")), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item")), kept)


@query(f"""WITH {RESPONSES_SQL}, {PAR}, {GRID41}, x AS (SELECT item, g, theta, a, b, c, 1 / (1 + exp(-a * (theta - b))) AS p2 FROM par, g), y AS (SELECT *, c + (1 - c) * p2 AS p3 FROM x)
    SELECT item, g, round(1 / (1 + exp(-(theta - b))), 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(a * a * p2 * (1 - p2), 6) AS info2, round(a * a * (1 - p3) / p3 * p2 * p2, 6) AS info3, round(a * a * (1 - p3) / p3 * p2 * p2 / ((1 - c) * (1 - c)), 6) AS info3_rescaled FROM y""")
def irt_info_grid(spark, sf_dir):
    x = parameters(spark, sf_dir).crossJoin(F.broadcast(irt.grid(spark, -4.0, 4.0, 41)))
    t, a, b, c = (F.col(k) for k in ("theta", "a", "b", "c"))
    shown = {"p1": irt.p_2pl(t, F.lit(1.0), b), "p2": irt.p_2pl(t, a, b), "p3": irt.p_3pl(t, a, b, c), "info2": irt.information_2pl(t, a, b), "info3": irt.information_3pl(t, a, b, c), "info3_rescaled": irt.information_3pl_rescaled(t, a, b, c)}
    return x.select("item", "g", *[F.round(v, RND).alias(k) for k, v in shown.items()])


@query(f"""WITH {PAR_SQL}, {GRID41}, {INFO}, r AS (SELECT item, theta, row_number() OVER (PARTITION BY item ORDER BY round(information, 12) DESC, g) AS nth FROM info)
    SELECT item, round(theta, 2) AS peak_theta FROM r WHERE nth = 1""")
def irt_peaks(spark, sf_dir):
    return irt.peaks(informed(spark, sf_dir))


@query(f"""WITH {PAR_SQL}, {GRID41}, {INFO}, t AS (SELECT g, theta, round(sum(information), 9) AS i FROM info GROUP BY ALL), m AS (SELECT max(i) AS most FROM t)
    SELECT round(min(theta) FILTER (i = most), 6) AS peak_theta, round(any_value(most), 6) AS most, count(*) FILTER (i > 0.1e0 * most) AS coverage FROM t, m""")
def test_info_peak(spark, sf_dir):
    return irt.test_summary(irt.test_information(informed(spark, sf_dir))).select(F.round("peak_theta", RND).alias("peak_theta"), F.round("most", RND).alias("most"), "coverage")


@query(f"""WITH {PAR_SQL}, g AS (SELECT range AS g, -2e0 + range AS theta FROM range(5)), {INFO}
    SELECT theta, round(1 / sqrt(greatest(sum(information), 1e-8)), 6) AS se FROM info GROUP BY theta""")
def irt_se(spark, sf_dir):
    at = irt.item_information(fitted(spark, sf_dir).select("item", "a", "b"), irt.grid(spark, -2.0, 2.0, 5))
    return irt.test_information(at).select("theta", F.round(irt.standard_error(F.col("information")), RND).alias("se"))


def at_abilities(spark, sf_dir):
    """(model, theta, information) at each model's ability: over the pairs of the response matrix, item by item."""
    r = flawed_responses(spark, sf_dir).select("model", "item", "response")
    x = r.join(fitted(spark, sf_dir).select("item", "a", "b"), "item").join(irt.abilities(r), "model")
    return x.groupBy("model", "theta").agg(F.sum(irt.information_2pl(F.col("theta"), F.col("a"), F.col("b"))).alias("information"))


RELIABILITY_SQL = f"""{PAR_SQL}, i AS (SELECT model, theta, sum(a * a * p * (1 - p)) AS information FROM (SELECT model, theta, a, 1 / (1 + exp(-a * (theta - b))) AS p FROM abilities, par) GROUP BY ALL),
    sm AS (SELECT quantile_cont(1 / sqrt(greatest(information, 1e-8)), 0.5) AS sem, var_pop(theta) AS variance FROM i),
    reliable AS (SELECT sem, variance, CASE WHEN variance > 0 THEN greatest(0e0, 1 - sem * sem / variance) ELSE 0 END AS reliability FROM sm)"""


def reliable(spark, sf_dir):
    return irt.reliability(at_abilities(spark, sf_dir))


@query(f"WITH {RELIABILITY_SQL} SELECT round(sem, 6) AS sem, round(variance, 6) AS variance, round(reliability, 6) AS reliability FROM reliable")
def reliability(spark, sf_dir):
    return reliable(spark, sf_dir).select(*[F.round(c, RND).alias(c) for c in ("sem", "variance", "reliability")])


@query(f"""WITH {PAR_SQL}, p AS (SELECT item, response AS r, least(1 - 1e-8, greatest(1e-8, 1 / (1 + exp(-a * (theta - b))))) AS p FROM responses JOIN abilities USING (model) JOIN par USING (item))
    SELECT item, round(sum(r * ln(p) + (1 - r) * ln(1 - p)), 5) AS log_likelihood FROM p GROUP BY item""")
def item_likelihood(spark, sf_dir):
    r = flawed_responses(spark, sf_dir)
    with_theta = r.join(irt.abilities(r), "model").select("item", "response", "theta")
    return irt.likelihood(with_theta, fitted(spark, sf_dir).select("item", "a", "b")).withColumn("log_likelihood", F.round("log_likelihood", 5))


@query(f"""WITH {RESPONSES_SQL}, x AS (SELECT item, response, theta FROM responses JOIN abilities USING (model))
    SELECT item, round(covar_pop(theta, response) / nullif(sqrt(var_pop(theta) * var_pop(response)), 0), 6) AS r FROM x GROUP BY item""")
def item_fit_r(spark, sf_dir):
    from ..operators.correlation import pearson

    r = responses(spark, sf_dir)
    return r.join(irt.abilities(r), "model").groupBy("item").agg(F.round(pearson("theta", "response"), RND).alias("r"))


@query(f"WITH {FIT_SQL} SELECT item, round(a, 3) AS a, round(b, 3) AS b, round(fit_p_value, 6) AS fit_p_value, flags FROM fit")
def irt_fit(spark, sf_dir):
    """Likelihood fits item by item; tests hold them against a grid search too."""
    f = fitted(spark, sf_dir)
    return f.select("item", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"), F.round("fit_p_value", 6).alias("fit_p_value"), F.array_join("flags", ",").alias("flags"))


@query(f"WITH {FIT_SQL} SELECT count(*) AS n_items, count(*) FILTER (contains(flags, 'LOW')) AS low_discrimination, count(*) FILTER (contains(flags, 'CEILING')) AS ceiling, count(*) FILTER (contains(flags, 'FLOOR')) AS floor FROM fit")
def irt_flag_counts(spark, sf_dir):
    return irt.flag_counts(fitted(spark, sf_dir))


WORST = "worst AS (SELECT item, row_number() OVER (ORDER BY CASE WHEN starts_with(flags, 'LOW') THEN 0 ELSE 1 END, item) AS rank FROM fit WHERE flags <> 'OK')"


@query(f"WITH {FIT_SQL}, {WORST} SELECT item, rank FROM worst WHERE rank <= 20")
def items_to_replace(spark, sf_dir):
    return irt.to_replace(fitted(spark, sf_dir))


@query(f"""WITH {FIT_SQL}, {WORST}, c AS (SELECT DISTINCT item FROM responses WHERE item % 3 = 0), u AS (
        SELECT item::VARCHAR AS item, rank AS o FROM worst WHERE rank <= 10
        UNION ALL SELECT item, 10 + row_number() OVER (ORDER BY item) FROM (SELECT item::VARCHAR AS item FROM c ORDER BY 1 LIMIT 10)),
    m AS (SELECT item, min(o) AS o FROM u GROUP BY item)
    SELECT item, place FROM (SELECT item, row_number() OVER (ORDER BY o) AS place FROM m) WHERE place <= 20""")
def replacement_priority(spark, sf_dir):
    bad = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("item")).where(F.col("item").cast("long") % 3 == 0)
    return audit.priority(irt.to_replace(fitted(spark, sf_dir)), bad, "item")


RECOVERY_SQL = f"{RESPONSES_SQL}, {newton_sql()}, truth AS (SELECT DISTINCT item, b_true FROM responses), mse AS (SELECT round(avg(power(b - b_true, 2)), 4) AS mse, count(*) AS n FROM fit JOIN truth USING (item))"


@query(f"WITH {RECOVERY_SQL} SELECT mse, n FROM mse")
def b_recovery_mse(spark, sf_dir):
    """Estimates from the sound response matrix against the difficulties that it was made with."""
    r = responses(spark, sf_dir)
    truth = r.groupBy("item").agg(F.first("b_true").alias("b_true"))
    return irt.recovery(irt.fit(r.select("model", "item", "response")), truth, "b_true")
