"""Two predictors compared on the same rows, a full report of one, and the penalised fits that calibrate scores."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators.calibration import effective_size, reliability_bins, weighted_mean
from lorewell.operators.ordering import numbered
from lorewell.sources import scratch
from lorewell.sources.tables import table

# Probabilities keep this distance from 0 and 1, a promotion's least probability, the share of rounds in which a
# rate must be defined, and the generator's step and masks.
EDGE, PROMOTED, VALID_SHARE = 1e-6, 0.75, 0.9
STEP, WORD = 0x6D2B79F5, 0xFFFFFFFF


def clamped(p: Column) -> Column:
    return F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p))


def seed_of(text: str) -> int:
    """A 32-bit seed from a text."""
    return int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)


def _times(a: Column, b: Column) -> Column:
    """The lower 32 bits of a product of 32-bit numbers, in halves that a long can hold."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftright(a, 16)
    return (low * b + F.shiftleft((high * b).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(WORD))


def uniform(seed: int, n: Column) -> Column:
    """The n-th number (from 1) of the generator of that seed, in [0, 1): its state is a counter, so any task can tell any
    number of the stream by itself."""
    s = (n.cast("long").bitwiseAND(F.lit(WORD)) * F.lit(STEP) + F.lit(seed)).bitwiseAND(F.lit(WORD))
    v = _times(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(F.lit(1)))
    v = v.bitwiseXOR((v + _times(v.bitwiseXOR(F.shiftright(v, 7)), v.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(WORD)))
    return v.bitwiseXOR(F.shiftright(v, 14)) / F.lit(4294967296.0)


def draws(spark: SparkSession, groups: int, rounds: int, seed: int) -> DataFrame:
    """round, number, times: how often each round of a bootstrap draws each of so many groups, with replacement."""
    n = F.col("id") + 1
    drawn = spark.range(groups * rounds).select(F.floor(F.col("id") / groups).cast("long").alias("round"), F.floor(uniform(seed, n) * groups).cast("long").alias("number"))
    return drawn.groupBy("round", "number").agg(F.count("*").alias("times"))


SUMS = ("w", "brier", "log_loss", "negative", "base_up", "base_false", "cand_up", "cand_false")


def paired_sums(p: DataFrame) -> DataFrame:
    """What each group adds to a comparison. p: group_id, candidate, baseline, target, weight."""
    c, b, y, w = clamped(F.col("candidate")), clamped(F.col("baseline")), F.col("target"), F.col("weight")
    loss = lambda q: -(y * F.log(q) + (1 - y) * F.log(1 - q))
    where = lambda cond: F.sum(F.when(cond, w).otherwise(0.0))
    return p.groupBy("group_id").agg(
        F.sum(w).alias("w"), F.sum(w * ((c - y) * (c - y) - (b - y) * (b - y))).alias("brier"), F.sum(w * (loss(c) - loss(b))).alias("log_loss"), where(y == 0).alias("negative"),
        where(b >= PROMOTED).alias("base_up"), where((b >= PROMOTED) & (y == 0)).alias("base_false"), where(c >= PROMOTED).alias("cand_up"), where((c >= PROMOTED) & (y == 0)).alias("cand_false"),
        F.count_if(b >= PROMOTED).alias("base_n"), F.count_if(c >= PROMOTED).alias("cand_n"),
    )


def deltas() -> dict[str, Column]:
    """Candidate minus baseline, from the sums."""
    c = F.col
    return {
        "brier": c("brier") / c("w"), "log_loss": c("log_loss") / c("w"), "false_promotion": F.try_divide(c("cand_false"), c("cand_up")) - F.try_divide(c("base_false"), c("base_up")),
        "false_positive": F.try_divide(c("cand_false") - c("base_false"), c("negative")), "coverage": (c("cand_up") - c("base_up")) / c("w"),
    }


def compare(p: DataFrame, rounds: int = 1000, seed: str = "comparison") -> DataFrame:
    """One row: differences of candidate and baseline (Brier score, log-loss, false promotion, false positives, coverage) with
    intervals of 95 % by a bootstrap of whole groups, and the counts behind them. Groups are drawn with replacement by a
    seeded generator over their sorted names; each round adds the sums of the drawn groups, so that rows are read once. A
    rate that less than VALID_SHARE of the rounds can tell has no interval. No rows give no row."""
    if not 100 <= rounds <= 5000:
        raise ValueError("rounds must be between 100 and 5000")
    sums = scratch.written(numbered(paired_sums(p), "group_id"), "groups")
    n = sums.count()
    if not n:
        return p.sparkSession.createDataFrame([], ", ".join(f"delta_{k} double, {k}_low double, {k}_high double" for k in deltas()) + ", rounds long, false_promotion_rounds long, false_positive_rounds long, baseline_promoted long, candidate_promoted long, groups long")
    per_round = draws(p.sparkSession, n, rounds, seed_of(seed)).join(sums, "number").groupBy("round").agg(*[F.sum(F.col("times") * F.col(k)).alias(k) for k in SUMS])
    found = per_round.select(*[v.alias(k) for k, v in deltas().items()])
    least = math.ceil(rounds * VALID_SHARE)
    bound = lambda k, q: F.round(F.when(F.count(k) >= least, F.expr(f"percentile({k}, {q})")), 6)
    spread = found.agg(*[bound(k, q).alias(f"{k}_{name}") for k in deltas() for name, q in (("low", 0.025), ("high", 0.975))], F.count("*").alias("rounds"), F.count("false_promotion").alias("false_promotion_rounds"), F.count("false_positive").alias("false_positive_rounds"))
    whole = sums.agg(*[F.sum(k).alias(k) for k in (*SUMS, "base_n", "cand_n")], F.count("*").alias("groups"))
    point = whole.select(*[F.round(v, 6).alias(f"delta_{k}") for k, v in deltas().items()], F.col("base_n").alias("baseline_promoted"), F.col("cand_n").alias("candidate_promoted"), "groups")
    return point.crossJoin(spread)  # a row each


def logistic_fit(rows: DataFrame, features: list[str], target: str = "target", weight: str | None = "weight", l2: float = 1.0, non_negative: bool = False, exact: bool = False, steps: int = 100) -> dict:
    """intercept, coefficients (of standardised features), means, deviations, converged and steps of a weighted logistic fit
    with a ridge on the coefficients. A step is one distributed sum of gradient and Hessian. non_negative: negative
    coefficients become 0 after each step (the plain rule); exact: bounds are an active set instead, and the fit ends at the
    optimum under them. No rows, or a null in them: ValueError."""
    d = len(features)
    own = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = rows.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(target).cast("double").alias("y"), own.alias("w"))
    x = scratch.written(x, "fit")
    every = F.forall(F.array(*x.columns), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    first = x.agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.count_if(~every | (F.col("w") <= 0)).alias("bad"), *[weighted_mean(F.col(f"x{i}"), "w").alias(f"m{i}") for i in range(d)], weighted_mean(F.col("y"), "w").alias("p")).first()
    if not first["n"] or first["bad"]:
        raise ValueError("a fit needs rows, finite numbers and positive weights")
    n, means = first["n"], [first[f"m{i}"] for i in range(d)]
    second = x.agg(*[weighted_mean((F.col(f"x{i}") - means[i]) * (F.col(f"x{i}") - means[i]), "w").alias(f"v{i}") for i in range(d)]).first()
    deviations = [s if (s := math.sqrt(second[f"v{i}"])) > 1e-9 else 1.0 for i in range(d)]
    scale = n / first["w"]  # weights of mean one
    design = [F.lit(1.0), *[(F.col(f"x{i}") - means[i]) / deviations[i] for i in range(d)]]
    share = (first["p"] * n + 0.5) / (n + 1)
    b = np.array([math.log(share / (1 - share)), *[0.0] * d])
    bounded, converged, done = np.array([False, *[non_negative] * d]), False, 0
    ridge = np.diag([1e-6, *[l2] * d])
    for done in range(1, steps + 1):
        g, h = _slopes(x, design, b, scale)
        g = g - np.array([0.0, *(l2 * b[1:])])
        free = np.ones(d + 1, bool)
        if exact and non_negative:
            free = ~(bounded & (b <= 0) & (g <= 0))
        delta = np.zeros(d + 1)
        try:
            delta[free] = np.linalg.solve((h + ridge)[np.ix_(free, free)], g[free])
        except np.linalg.LinAlgError:
            break
        if exact and non_negative and (outside := bounded & (b + delta < 0)).any():  # as far as the first bound
            delta = delta * min(1.0, float((b[outside] / -delta[outside]).min()))
            nearest = outside & (b + delta < 1e-12)
            new = np.where(nearest, 0.0, b + delta)
        else:
            new = np.where(bounded, np.maximum(b + delta, 0.0), b + delta)
        change, b = float(np.abs(new - b).max()), new
        if change < 1e-8 and (not exact or not (bounded & (b <= 0) & ~free & (g > 1e-8)).any()):
            converged = True
            break
    return {"intercept": float(b[0]), "coefficients": [float(v) for v in b[1:]], "means": means, "deviations": deviations, "converged": converged, "steps": done}


def _slopes(x: DataFrame, design: list[Column], b: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the weighted log-likelihood at b, one sum over the rows."""
    k = len(design)
    linear = sum((F.lit(float(b[i])) * design[i] for i in range(1, k)), F.lit(float(b[0])))
    d = x.select(clamped(1 / (1 + F.exp(-linear))).alias("p"), "y", (F.col("w") * scale).alias("w"), *[c.alias(f"d{i}") for i, c in enumerate(design)])
    r, h = F.col("w") * (F.col("y") - F.col("p")), F.col("w") * F.greatest(F.lit(1e-6), F.col("p") * (1 - F.col("p")))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    s = d.agg(*[F.sum(r * F.col(f"d{i}")).alias(f"g{i}") for i in range(k)], *[F.sum(h * F.col(f"d{i}") * F.col(f"d{j}")).alias(f"h{i}_{j}") for i, j in pairs]).first()
    hessian = np.zeros((k, k))
    for i, j in pairs:
        hessian[i, j] = hessian[j, i] = s[f"h{i}_{j}"]
    return np.array([s[f"g{i}"] for i in range(k)]), hessian


FITTED = "feature string, coefficient double, mean double, deviation double, intercept double, converged boolean, steps long"


def fitted(rows: DataFrame, features: list[str], **options) -> DataFrame:
    """A row a feature of a logistic_fit()."""
    f = logistic_fit(rows, features, **options)
    r = [(name, round(f["coefficients"][i], 6), round(f["means"][i], 6), round(f["deviations"][i], 6), round(f["intercept"], 6), f["converged"], f["steps"]) for i, name in enumerate(features)]
    return rows.sparkSession.createDataFrame(r, FITTED)


def predicted(rows: DataFrame, features: list[str], fit: dict) -> Column:
    """The fit's probability for a row."""
    linear = sum((fit["coefficients"][i] * (F.col(f) - fit["means"][i]) / fit["deviations"][i] for i, f in enumerate(features)), F.lit(fit["intercept"]))
    return clamped(1 / (1 + F.exp(-linear)))


def report(p: DataFrame, prevalence: float) -> DataFrame:
    """One row on a predictor: sizes, Brier score, log-loss, bias, expected calibration error, calibration line, skill against the
    prevalence in training, promotions and their errors, and the mean of the groups' Brier scores. p: id, group_id,
    probability, target, weight. Null where a rate has nothing to count."""
    p = scratch.written(p.withColumn("probability", clamped(F.col("probability"))), "predicted")
    x, y, w = F.col("probability"), F.col("target"), F.col("weight")
    up, base = x >= PROMOTED, min(max(prevalence, EDGE), 1 - EDGE)
    where = lambda cond: F.sum(F.when(cond, w).otherwise(0.0))
    chosen = F.when(up, w)
    error = (x - y) * (x - y)
    q = p.agg(
        F.count("*").alias("n"), F.sum(w).alias("weight"), F.round(effective_size(), 6).alias("effective"), weighted_mean(error).alias("b"), F.round(weighted_mean(-(y * F.log(x) + (1 - y) * F.log(1 - x))), 6).alias("log_loss"),
        F.round(weighted_mean(x) - weighted_mean(y), 6).alias("bias"), weighted_mean((F.lit(base) - y) * (F.lit(base) - y)).alias("base"), F.round(F.try_divide(where(up & (y == 0)), where(up)), 6).alias("false_promotion"),
        F.round(F.try_divide(where(up & (y == 0)), where(y == 0)), 6).alias("false_positive"), F.count_if(up).alias("promoted"), F.round(F.try_divide(F.sum(chosen) * F.sum(chosen), F.sum(chosen * chosen)), 6).alias("promoted_effective"),
        F.round(where(up) / F.sum(w), 6).alias("coverage"), F.count_if(y == 1).alias("positives"),
    )
    macro = p.groupBy("group_id").agg(weighted_mean(error).alias("b")).agg(F.round(F.avg("b"), 6).alias("macro_brier"))
    total = q.select("weight").first()["weight"]
    bins = reliability_bins(p, rounded=False)
    off = bins.agg(F.round(F.sum(F.col("w") / F.lit(total) * F.abs(F.round("predicted", 6) - F.round("observed", 6))), 6).alias("calibration_error"))
    counts = q.select("n", "positives").first()
    line: tuple = (None, None)
    if counts["n"] >= 20 and 0 < counts["positives"] < counts["n"]:
        f = logistic_fit(p.select(F.log(x / (1 - x)).alias("logit"), "target", "weight"), ["logit"], l2=0.001)
        if f["converged"]:
            slope = f["coefficients"][0] / f["deviations"][0]
            line = (round(f["intercept"] - slope * f["means"][0], 6), round(slope, 6))
    q = q.crossJoin(macro).crossJoin(off)  # a row each
    return q.select(
        "n", F.round("weight", 6).alias("weight"), "effective", F.round("b", 6).alias("brier"), "log_loss", "bias", "calibration_error", F.lit(line[0]).cast("double").alias("intercept"), F.lit(line[1]).cast("double").alias("slope"),
        F.when(F.col("base") > 1e-12, F.round(1 - F.col("b") / F.col("base"), 6)).alias("skill"), "false_promotion", "false_positive", "promoted", "promoted_effective", "coverage", "macro_brier",
    )


def sample_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two made-up predictors of the labelled documents' quality: one knows the label in part, one the length."""
    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    k = F.col("doc_id")
    return l.select(k.alias("id"), F.col("source").alias("group_id"), (0.1 + 0.55 * F.col("quality") + 0.034 * (k * 17 % 10)).alias("candidate"), (0.2 + 0.4 * F.col("quality") + 0.04 * (F.col("n_chars") % 10)).alias("baseline"), F.col("quality").cast("long").alias("target"), (1.0 + k % 3).alias("weight"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal scores of 0 to 100 as the two features of a beta calibration."""
    p = sample_pairs(spark, sf_dir)
    s = (F.col("target") * 30 + F.col("id") * 17 % 71 + 0.5) / 101
    return p.select("id", "target", "weight", F.log(s).alias("rise"), (-F.log(1 - s)).alias("fall"))


def _report(s, d):
    return report(sample_pairs(s, d).withColumnRenamed("candidate", "probability"), 0.4)


ROUNDS = 400
QUERIES = {
    "paired_comparison": lambda s, d: compare(sample_pairs(s, d), ROUNDS), "probability_report": _report,
    "beta_calibration": lambda s, d: fitted(scored(s, d), ["rise", "fall"], non_negative=True).drop("steps"),
}

P_SQL = """p AS MATERIALIZED (SELECT doc_id AS id, source AS group_id, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, 0.1::DOUBLE + 0.55::DOUBLE * quality + 0.034::DOUBLE * (doc_id * 17 % 10))) AS candidate,
    greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, 0.2::DOUBLE + 0.4::DOUBLE * quality + 0.04::DOUBLE * (n_chars % 10))) AS baseline, quality AS target, CAST(1 + doc_id % 3 AS DOUBLE) AS weight FROM labels JOIN documents USING (doc_id))"""
_IMUL = lambda a, b: f"(((({a}) & 65535) * ({b}) + ((((({a}) >> 16) * ({b})) & 65535) << 16)) & 4294967295)"
_LOSS = lambda q: f"-(target * ln({q}) + (1 - target) * ln(1 - {q}))"
_DELTAS = {
    "brier": "brier / w", "log_loss": "log_loss / w", "false_promotion": "cand_false / nullif(cand_up, 0) - base_false / nullif(base_up, 0)", "false_positive": "(cand_false - base_false) / nullif(negative, 0)", "coverage": "(cand_up - base_up) / w",
}
_NEWTON = """x AS (SELECT target, weight, ln(s) AS r, -ln(1 - s) AS f FROM (SELECT *, (target * 30 + id * 17 % 71 + 0.5::DOUBLE) / 101 AS s FROM p)),
    m AS (SELECT count(*) AS n, sum(weight) AS tw, sum(weight * r) / sum(weight) AS mr, sum(weight * f) / sum(weight) AS mf, sum(weight * target) / sum(weight) AS my FROM x),
    v AS (SELECT sqrt(sum(weight * (r - mr) ** 2) / sum(weight)) AS sr, sqrt(sum(weight * (f - mf) ** 2) / sum(weight)) AS sf FROM x, m),
    z AS MATERIALIZED (SELECT target AS y, weight * n / tw AS w, (r - mr) / sr AS a, (f - mf) / sf AS b FROM x, m, v),
    fit AS (SELECT 0 AS k, ln((my * n + 0.5) / (n + 1) / (1 - (my * n + 0.5) / (n + 1))) AS c, 0::DOUBLE AS ca, 0::DOUBLE AS cb, 1::DOUBLE AS moved FROM m
      UNION ALL SELECT k + 1, c + d0, greatest(0, ca + d1), greatest(0, cb + d2), greatest(abs(d0), abs(greatest(0, ca + d1) - ca), abs(greatest(0, cb + d2) - cb)) FROM (
        SELECT *, (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det AS d0,
          (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det AS d1, (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det AS d2
        FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM (
          SELECT k, c, ca, cb, sum(w * (y - q)) AS g0, sum(w * (y - q) * a) - ca AS g1, sum(w * (y - q) * b) - cb AS g2, sum(h) + 1e-6 AS h00, sum(h * a) AS h01, sum(h * b) AS h02, sum(h * a * a) + 1 AS h11, sum(h * a * b) AS h12, sum(h * b * b) + 1 AS h22
          FROM (SELECT *, w * greatest(1e-6, q * (1 - q)) AS h FROM (SELECT *, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, 1 / (1 + exp(-(c + ca * a + cb * b))))) AS q FROM fit, z WHERE moved >= 1e-8 AND k < 100)) GROUP BY k, c, ca, cb))))"""
SQL = {
    "paired_comparison": "WITH " + P_SQL + f""", g AS MATERIALIZED (SELECT row_number() OVER (ORDER BY group_id) - 1 AS number, count(*) OVER () AS groups, * FROM (SELECT group_id, sum(weight) AS w, sum(weight * ((candidate - target) ** 2 - (baseline - target) ** 2)) AS brier,
        sum(weight * ({_LOSS('candidate')} - ({_LOSS('baseline')}))) AS log_loss, sum(CASE WHEN target = 0 THEN weight ELSE 0 END) AS negative, sum(CASE WHEN baseline >= 0.75 THEN weight ELSE 0 END) AS base_up,
        sum(CASE WHEN baseline >= 0.75 AND target = 0 THEN weight ELSE 0 END) AS base_false, sum(CASE WHEN candidate >= 0.75 THEN weight ELSE 0 END) AS cand_up, sum(CASE WHEN candidate >= 0.75 AND target = 0 THEN weight ELSE 0 END) AS cand_false,
        count(*) FILTER (baseline >= 0.75) AS base_n, count(*) FILTER (candidate >= 0.75) AS cand_n FROM p GROUP BY 1)),
      s AS (SELECT i, (i * {STEP} + {seed_of('comparison')}) & {WORD} AS s FROM range(1, {ROUNDS} * (SELECT CAST(count(*) AS BIGINT) FROM g) + 1) t(i)), v AS (SELECT i, {_IMUL('xor(s, s >> 15)', 's | 1')} AS v FROM s),
      u AS (SELECT i, xor(v, (v + {_IMUL('xor(v, v >> 7)', 'v | 61')}) & {WORD}) AS v FROM v), d AS (SELECT (i - 1) // (SELECT count(*) FROM g) AS round, CAST(floor(xor(v, v >> 14) / 4294967296::DOUBLE * (SELECT count(*) FROM g)) AS BIGINT) AS number FROM u),
      per AS (SELECT round, """ + ", ".join(f"sum({k}) AS {k}" for k in SUMS) + " FROM d JOIN g USING (number) GROUP BY 1), e AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _DELTAS.items()) + " FROM per), t AS (SELECT " + ", ".join(f"sum({k}) AS {k}" for k in (*SUMS, "base_n", "cand_n")) + ", count(*) AS groups FROM g) SELECT "
    + ", ".join(f"round({v}, 6) AS delta_{k}" for k, v in _DELTAS.items()) + ", " + ", ".join(f"(SELECT CASE WHEN count({k}) >= {math.ceil(ROUNDS * VALID_SHARE)} THEN round(quantile_cont({k}, {q}), 6) END FROM e) AS {k}_{n}" for k in _DELTAS for n, q in (("low", 0.025), ("high", 0.975)))
    + ", CAST(base_n AS BIGINT) AS baseline_promoted, CAST(cand_n AS BIGINT) AS candidate_promoted, groups, (SELECT count(*) FROM e) AS rounds, (SELECT count(false_promotion) FROM e) AS false_promotion_rounds, (SELECT count(false_positive) FROM e) AS false_positive_rounds FROM t",
    "beta_calibration": "WITH RECURSIVE " + P_SQL + ", " + _NEWTON + ", last AS (SELECT * FROM fit ORDER BY k DESC LIMIT 1) SELECT 'rise' AS feature, round(ca, 6) AS coefficient, round(mr, 6) AS mean, round(sr, 6) AS deviation, round(c, 6) AS intercept, moved < 1e-8 AS converged FROM last, m, v UNION ALL SELECT 'fall', round(cb, 6), round(mf, 6), round(sf, 6), round(c, 6), moved < 1e-8 FROM last, m, v",
    "probability_report": "WITH RECURSIVE " + P_SQL.replace("AS candidate", "AS probability") + """, t AS (SELECT sum(weight) AS tw, count(*) AS n, least(10, floor(sum(weight) * sum(weight) / sum(weight * weight) / 20)) AS bins FROM p),
    o AS (SELECT *, sum(weight) OVER (ORDER BY probability, group_id, id ROWS UNBOUNDED PRECEDING) - weight / 2 AS mid FROM p), i AS (SELECT least(bins - 1, floor(mid / tw * bins)) AS bin, probability, target, weight, tw FROM o, t WHERE bins >= 1),
    e AS (SELECT round(sum(w / tw * abs(a - b)), 6) AS ece FROM (SELECT sum(weight) AS w, any_value(tw) AS tw, round(sum(weight * probability) / sum(weight), 6) AS a, round(sum(weight * target) / sum(weight), 6) AS b FROM i GROUP BY bin)),
    x AS (SELECT target AS y, weight AS w, ln(probability / (1 - probability)) AS x FROM p), m AS (SELECT count(*) AS n, sum(w) AS tw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM x), v AS (SELECT sqrt(sum(w * (x - mx) ** 2) / sum(w)) AS sx FROM x, m),
    z AS MATERIALIZED (SELECT y, w * n / tw AS w, (x - mx) / sx AS a FROM x, m, v),
    fit AS (SELECT 0 AS k, ln((my * n + 0.5) / (n + 1) / (1 - (my * n + 0.5) / (n + 1))) AS c, 0::DOUBLE AS ca, 1::DOUBLE AS moved FROM m
      UNION ALL SELECT k + 1, c + d0, ca + d1, greatest(abs(d0), abs(d1)) FROM (SELECT k, c, ca, (g0 * h11 - h01 * g1) / (h00 * h11 - h01 * h01) AS d0, (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS d1 FROM (
        SELECT k, c, ca, sum(w * (y - q)) AS g0, sum(w * (y - q) * a) - 0.001 * ca AS g1, sum(h) + 1e-6 AS h00, sum(h * a) AS h01, sum(h * a * a) + 0.001 AS h11
        FROM (SELECT *, w * greatest(1e-6, q * (1 - q)) AS h FROM (SELECT *, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, 1 / (1 + exp(-(c + ca * a))))) AS q FROM fit, z WHERE moved >= 1e-8 AND k < 100)) GROUP BY k, c, ca))),
    line AS (SELECT c - ca / sx * mx AS intercept, ca / sx AS slope FROM fit, m, v WHERE moved < 1e-8 ORDER BY k DESC LIMIT 1),
    b AS (SELECT sum(weight * (probability - target) ** 2) / sum(weight) AS brier, sum(weight * (0.4 - target) ** 2) / sum(weight) AS base FROM p)
    SELECT count(*) AS n, round(sum(weight), 6) AS weight, round(sum(weight) * sum(weight) / sum(weight * weight), 6) AS effective, round(any_value(brier), 6) AS brier, round(sum(weight * """ + _LOSS("probability") + """) / sum(weight), 6) AS log_loss,
      round(sum(weight * probability) / sum(weight) - sum(weight * target) / sum(weight), 6) AS bias, any_value(ece) AS calibration_error, round(any_value(intercept), 6) AS intercept, round(any_value(slope), 6) AS slope, round(1 - any_value(brier) / any_value(base), 6) AS skill,
      round(sum(weight) FILTER (probability >= 0.75 AND target = 0) / sum(weight) FILTER (probability >= 0.75), 6) AS raw_fp, round(coalesce(sum(weight) FILTER (probability >= 0.75 AND target = 0), 0) / sum(weight) FILTER (probability >= 0.75), 6) AS false_promotion,
      round(coalesce(sum(weight) FILTER (probability >= 0.75 AND target = 0), 0) / sum(weight) FILTER (target = 0), 6) AS false_positive, count(*) FILTER (probability >= 0.75) AS promoted,
      round(sum(weight) FILTER (probability >= 0.75) ** 2 / sum(weight * weight) FILTER (probability >= 0.75), 6) AS promoted_effective, round(coalesce(sum(weight) FILTER (probability >= 0.75), 0) / sum(weight), 6) AS coverage,
      (SELECT round(avg(g), 6) FROM (SELECT sum(weight * (probability - target) ** 2) / sum(weight) AS g FROM p GROUP BY group_id)) AS macro_brier FROM p, b, e, line""".replace("round(sum(weight) FILTER (probability >= 0.75 AND target = 0) / sum(weight) FILTER (probability >= 0.75), 6) AS raw_fp, ", ""),
}
