"""Calibration of judgements: gold labels, weights, probability metrics, reliability, splits, leakage groups, fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.operators.components import components
from lorewell.operators.ordering import summed
from lorewell.sources.tables import table

PROMOTED = 0.7


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """observation, label, reviewer, value: each label as three reviewers' votes, some of them turned by the id."""
    l = table(spark, sf_dir, "labels")
    both = l.select(F.col("doc_id").alias("observation"), F.explode(F.array(F.struct(F.lit("useful").alias("label"), (F.col("quality") == 1).alias("v")), F.struct(F.lit("supported").alias("label"), (F.col("toxic") == 0).alias("v")))).alias("x"))
    votes = both.select("observation", "x.label", "x.v", F.explode(F.array(*[F.lit(r) for r in ("r1", "r2", "r3", "r4")])).alias("reviewer"))
    turned = F.when(F.col("reviewer") == "r2", F.col("observation") % 7 == 0).when(F.col("reviewer") == "r3", F.col("observation") % 11 == 0).when(F.col("reviewer") == "r4", F.col("observation") % 7 == 0).otherwise(False)
    return votes.select("observation", "label", "reviewer", (F.col("v") != turned).alias("value"))


def gold(j: DataFrame) -> DataFrame:
    """The majority of the reviewers' votes; ties abstain."""
    g = j.groupBy("observation", "label").agg(F.count_if("value").alias("yes"), F.count_if(~F.col("value")).alias("no"))
    return g.filter("yes != no").select("observation", "label", (F.col("yes") > F.col("no")).alias("value"), (F.col("yes") + F.col("no")).alias("votes"))


def label_summary(j: DataFrame) -> DataFrame:
    """Counts and the Jeffreys posterior mean of each label."""
    return j.groupBy("label").agg(F.count("*").alias("n"), F.count_if("value").alias("yes"), F.round((F.count_if("value") + 0.5) / (F.count("*") + 1), 6).alias("rate"), F.countDistinct("observation").alias("observations"), F.countDistinct("reviewer").alias("reviewers"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, probability, target, group_id, weight: a made-up predictor over labelled documents."""
    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    p = 0.1 + 0.6 * F.col("quality") + 0.025 * (F.col("doc_id") * 17 % 10)
    return l.select(F.col("doc_id").alias("id"), p.alias("probability"), F.col("quality").cast("long").alias("target"), F.col("source").alias("group_id"), (1.0 + F.col("doc_id") % 3).alias("weight"))


def weighted_mean(value: Column, weight: str = "weight") -> Column:
    return F.sum(value * F.col(weight)) / F.sum(weight)


def effective_size(weight: str = "weight") -> Column:
    return F.sum(weight) * F.sum(weight) / F.sum(F.col(weight) * F.col(weight))


def probability_metrics(p: DataFrame) -> DataFrame:
    """Brier score, log-loss, bias, skill against prevalence, false promotion and false positive rate, coverage."""
    x, y, w = F.col("probability"), F.col("target"), F.col("weight")
    prevalence = p.agg(weighted_mean(y).alias("m"))
    q = p.crossJoin(F.broadcast(prevalence))  # one row
    up, missed = x >= PROMOTED, (x >= PROMOTED) & (y == 0)
    total = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    brier, base = weighted_mean((x - y) * (x - y)), weighted_mean((F.col("m") - y) * (F.col("m") - y))
    return q.agg(
        F.count("*").alias("n"), F.round(effective_size(), 6).alias("ess"), F.round(brier, 6).alias("brier"), F.round(weighted_mean(-(y * F.log(x) + (1 - y) * F.log(1 - x))), 6).alias("log_loss"),
        F.round(weighted_mean(x) - weighted_mean(y), 6).alias("bias"), F.round(1 - F.try_divide(brier, base), 6).alias("skill"), F.round(F.try_divide(total(missed), total(up)), 6).alias("false_promotion"),
        F.round(F.try_divide(total(missed), total(y == 0)), 6).alias("false_positive"), F.round(total(up) / F.sum(w), 6).alias("coverage"),
    )


def group_brier(p: DataFrame) -> DataFrame:
    e = (F.col("probability") - F.col("target")) * (F.col("probability") - F.col("target"))
    return p.groupBy("group_id").agg(F.count("*").alias("n"), F.round(weighted_mean(e), 6).alias("brier"))


def reliability_bins(p: DataFrame, most: int = 10, per_bin: int = 20, rounded: bool = True) -> DataFrame:
    """Bins of equal weight by the midpoint of cumulated weight; as many as the effective sample size bears. rounded: without,
    the bins' weight (w) comes along and nothing is rounded."""
    stats = p.agg(F.sum("weight").alias("total"), F.least(F.lit(most), F.floor(effective_size() / per_bin)).alias("bins"))
    placed = summed(p, "weight", "probability", "group_id", "id").crossJoin(F.broadcast(stats)).withColumn("mid", F.col("before") + F.col("weight") / 2)  # one row of stats
    b = placed.filter("bins >= 1").withColumn("bin", F.least(F.col("bins") - 1, F.floor(F.col("mid") / F.col("total") * F.col("bins"))))
    b = b.groupBy("bin").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.min("probability").alias("lower"), F.max("probability").alias("upper"), weighted_mean(F.col("probability")).alias("predicted"), weighted_mean(F.col("target")).alias("observed"))
    return b.select("bin", "n", *[F.round(c, 6).alias(c) for c in ("lower", "upper", "predicted", "observed")]) if rounded else b


def coverage_bands(p: DataFrame) -> DataFrame:
    """Counts and mean targets by group and probability band, with subtotals."""
    band = F.floor(F.col("probability") * 5).cast("long")
    return p.withColumn("band", band).groupingSets([["group_id", "band"], ["group_id"], ["band"], []], "group_id", "band").agg(F.count("*").alias("n"), F.round(F.avg("target"), 6).alias("rate"), F.grouping_id().alias("level"))


def leakage_groups(p: DataFrame) -> DataFrame:
    """Components of observations that share a session or a source: here every 50 ids a session, every 7th a source."""
    keys = p.select("id", F.concat(F.lit("s"), F.floor(F.col("id") / 50)).alias("key")).union(p.select("id", F.concat(F.lit("k"), F.col("id") % 1000)))
    links = keys.groupBy("key").agg(F.min("id").alias("a")).join(keys, "key").filter("a != id").select("a", F.col("id").alias("b"))
    c = components(links)
    return p.select("id").join(c, p["id"] == c["_id"], "left").select("id", F.coalesce("component", "id").alias("component"))


def chronological_split(p: DataFrame, share: float = 0.2) -> DataFrame:
    """Groups in time: the cutoff whose later groups weigh nearest to the share; groups across it are embargoed.

    Time is id % 97 here. Candidate cutoffs are the times that groups begin at."""
    g = p.withColumn("time", F.col("id") % 97).withColumn("g", F.floor(F.col("id") / 20)).groupBy("g").agg(F.min("time").alias("first"), F.max("time").alias("last"), F.sum("weight").alias("w"))
    g = g.withColumn("last", F.least(F.col("last"), F.col("first") + 8))
    at = g.groupBy("first").agg(F.sum("w").alias("starting"))  # at most a row a time
    later = at.select(F.col("first").alias("cutoff"), F.sum("starting").over(Window.orderBy(F.desc("first"))).alias("test"))
    total = g.agg(F.sum("w").alias("all"))
    best = later.crossJoin(F.broadcast(total)).orderBy(F.abs(F.col("test") / F.col("all") - share), "cutoff").limit(1).select("cutoff")
    side = F.when(F.col("first") >= F.col("cutoff"), "test").when(F.col("last") < F.col("cutoff"), "train").otherwise("embargo")
    return g.crossJoin(F.broadcast(best)).groupBy("cutoff", side.alias("side")).agg(F.count("*").alias("groups"), F.sum("w").alias("weight"))


def bootstrap_interval(p: DataFrame, rounds: int = 400, seed: int = 7) -> DataFrame:
    """Cluster bootstrap of the Brier score from each group's sufficient statistics, drawn on the cluster: in a round a
    group counts as often as a Poisson variable of mean 1 says."""
    e = (F.col("probability") - F.col("target")) * (F.col("probability") - F.col("target"))
    g = p.groupBy("group_id").agg(F.sum(e * F.col("weight")).alias("s"), F.sum("weight").alias("w"))
    u = F.pmod(F.xxhash64("group_id", "round", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    cdf, total, term = [], 0.0, float(np.exp(-1))
    for k in range(8):
        total += term
        cdf.append(total)
        term /= k + 1
    draws = sum((F.when(u >= c, 1).otherwise(0) for c in cdf), F.lit(0))
    r = g.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("n", draws)
    per = r.groupBy("round").agg(F.try_divide(F.sum(F.col("n") * F.col("s")), F.sum(F.col("n") * F.col("w"))).alias("brier"))
    return per.agg(F.count("brier").alias("rounds"), F.round(F.expr("percentile(brier, 0.025)"), 6).alias("low"), F.round(F.expr("percentile(brier, 0.975)"), 6).alias("high"))


def fit_logistic(p: DataFrame, l2: float = 0.001, steps: int = 25) -> DataFrame:
    """Penalised weighted logistic line of target on the logit of probability by Newton steps; each step is one
    distributed aggregation of five sums."""
    x = F.log(F.col("probability") / (1 - F.col("probability")))
    d = p.select(x.alias("x"), F.col("target").alias("y"), F.col("weight").alias("w"))
    m = d.agg(weighted_mean(F.col("x"), "w").alias("m"), F.sum("w").alias("n"), weighted_mean(F.col("x") * F.col("x"), "w").alias("q")).first()
    if not m["n"]:
        return p.sparkSession.createDataFrame([], "intercept double, slope double, steps int")
    sd = max(1e-9, (m["q"] - m["m"] ** 2) ** 0.5)
    z = (F.col("x") - m["m"]) / sd
    a = b = 0.0
    for k in range(steps):
        q = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * z)))
        r, h = F.col("w") * (F.col("y") - q), F.col("w") * q * (1 - q)
        s = d.agg(F.sum(r).alias("g0"), F.sum(r * z).alias("g1"), F.sum(h).alias("h0"), F.sum(h * z).alias("h1"), F.sum(h * z * z).alias("h2")).first()
        g = np.array([s["g0"], s["g1"] - l2 * b])
        step = np.linalg.solve(np.array([[s["h0"] + 1e-9, s["h1"]], [s["h1"], s["h2"] + l2 + 1e-9]]), g)
        a, b = a + float(step[0]), b + float(step[1])
        if abs(step).max() < 1e-8:
            break
    return p.sparkSession.createDataFrame([(round(a - b * m["m"] / sd, 6), round(b / sd, 6), k + 1)], "intercept double, slope double, steps int")


def integrity(j: DataFrame) -> DataFrame:
    """Violations of the label matrix: keys that occur twice, and expected (observation, label, reviewer) that lack."""
    keys = j.groupBy("observation", "label", "reviewer").agg(F.count("*").alias("n"))
    twice = keys.filter("n > 1").select(F.lit("duplicate").alias("rule"), "observation", "label", "reviewer")
    names = j.select("label", "reviewer").distinct()  # labels times reviewers, a handful
    expected = j.select("observation").distinct().crossJoin(F.broadcast(names))
    lacking = expected.join(keys.select("observation", "label", "reviewer"), ["observation", "label", "reviewer"], "left_anti").select(F.lit("missing").alias("rule"), "observation", "label", "reviewer")
    return twice.union(lacking)


def chain_violations(receipts: DataFrame) -> DataFrame:
    """Receipts (chain, phase, root, previous) that do not name the root before them."""
    w = Window.partitionBy("chain").orderBy("phase")
    return receipts.withColumn("before", F.lag("root").over(w)).filter(~F.col("previous").eqNullSafe(F.col("before"))).select("chain", "phase", "previous", "before")


def sample_chain(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 20).alias("chain"), F.col("event_id").alias("phase"), F.sha2(F.col("event_id").cast("string"), 256).alias("root"))
    before = F.lag("root").over(Window.partitionBy("chain").orderBy("phase"))
    return e.withColumn("previous", F.when(F.col("phase") % 50 == 7, F.lit("forged")).otherwise(before))


def damaged(j: DataFrame) -> DataFrame:
    k = F.col("observation")
    return j.filter(~((k % 29 == 0) & (F.col("reviewer") == "r3"))).union(j.filter((k % 31 == 0) & (F.col("reviewer") == "r1")))


J, P = judgements, predictions
QUERIES = {
    "gold_labels": lambda s, d: gold(J(s, d)), "calibration_summary": lambda s, d: label_summary(J(s, d)), "probability_metrics": lambda s, d: probability_metrics(P(s, d)), "group_brier": lambda s, d: group_brier(P(s, d)),
    "reliability_bins": lambda s, d: reliability_bins(P(s, d)), "coverage_bands": lambda s, d: coverage_bands(P(s, d)), "leakage_components": lambda s, d: leakage_groups(P(s, d)), "chrono_embargo_split": lambda s, d: chronological_split(P(s, d)),
    "bootstrap_interval": lambda s, d: bootstrap_interval(P(s, d)), "calibration_line": lambda s, d: fit_logistic(P(s, d)), "label_matrix_integrity": lambda s, d: integrity(damaged(J(s, d))), "hash_chain_violations": lambda s, d: chain_violations(sample_chain(s, d)),
}
J_SQL = "WITH j AS (SELECT doc_id AS observation, label, reviewer, v <> CASE reviewer WHEN 'r3' THEN doc_id % 11 = 0 WHEN 'r1' THEN false ELSE doc_id % 7 = 0 END AS value FROM (SELECT doc_id, 'useful' AS label, quality = 1 AS v FROM labels UNION ALL SELECT doc_id, 'supported', toxic = 0 FROM labels), (SELECT unnest(['r1', 'r2', 'r3', 'r4']) AS reviewer))"
P_SQL = "WITH p AS (SELECT doc_id AS id, CAST(0.1 AS DOUBLE) + CAST(0.6 AS DOUBLE) * quality + CAST(0.025 AS DOUBLE) * (doc_id * 17 % 10) AS probability, quality AS target, source AS group_id, CAST(1 + doc_id % 3 AS DOUBLE) AS weight FROM labels JOIN documents USING (doc_id))"
SQL = {
    "gold_labels": J_SQL + " SELECT observation, label, count(*) FILTER (value) > count(*) FILTER (NOT value) AS value, count(*) AS votes FROM j GROUP BY 1, 2 HAVING count(*) FILTER (value) <> count(*) FILTER (NOT value)",
    "calibration_summary": J_SQL + " SELECT label, count(*) AS n, count(*) FILTER (value) AS yes, round((count(*) FILTER (value) + 0.5) / (count(*) + 1), 6) AS rate, count(DISTINCT observation) AS observations, count(DISTINCT reviewer) AS reviewers FROM j GROUP BY 1",
    "probability_metrics": P_SQL + ", q AS (SELECT *, (SELECT sum(target * weight) / sum(weight) FROM p) AS m FROM p) SELECT count(*) AS n, round(sum(weight) * sum(weight) / sum(weight * weight), 6) AS ess, round(sum(weight * (probability - target) ** 2) / sum(weight), 6) AS brier, round(sum(-weight * (target * ln(probability) + (1 - target) * ln(1 - probability))) / sum(weight), 6) AS log_loss, round(sum(weight * probability) / sum(weight) - sum(weight * target) / sum(weight), 6) AS bias, round(1 - sum(weight * (probability - target) ** 2) / sum(weight * (m - target) ** 2), 6) AS skill, round(sum(weight) FILTER (probability >= 0.7 AND target = 0) / sum(weight) FILTER (probability >= 0.7), 6) AS false_promotion, round(sum(weight) FILTER (probability >= 0.7 AND target = 0) / sum(weight) FILTER (target = 0), 6) AS false_positive, round(sum(weight) FILTER (probability >= 0.7) / sum(weight), 6) AS coverage FROM q".replace("round(sum(weight) FILTER (probability >= 0.7 AND target = 0)", "round(coalesce(sum(weight) FILTER (probability >= 0.7 AND target = 0), 0)"),
    "group_brier": P_SQL + " SELECT group_id, count(*) AS n, round(sum(weight * (probability - target) ** 2) / sum(weight), 6) AS brier FROM p GROUP BY 1",
    "reliability_bins": P_SQL + ", s AS (SELECT *, sum(weight) OVER (ORDER BY probability, group_id, id ROWS UNBOUNDED PRECEDING) - weight / 2 AS mid, (SELECT sum(weight) FROM p) AS total, (SELECT least(10, floor(sum(weight) * sum(weight) / sum(weight * weight) / 20)) FROM p) AS bins FROM p) SELECT CAST(least(bins - 1, floor(mid / total * bins)) AS BIGINT) AS bin, count(*) AS n, round(min(probability), 6) AS lower, round(max(probability), 6) AS upper, round(sum(weight * probability) / sum(weight), 6) AS predicted, round(sum(weight * target) / sum(weight), 6) AS observed FROM s WHERE bins >= 1 GROUP BY 1",
    "coverage_bands": P_SQL + " SELECT group_id, CAST(floor(probability * 5) AS BIGINT) AS band, count(*) AS n, round(avg(target), 6) AS rate, CAST(grouping(group_id, CAST(floor(probability * 5) AS BIGINT)) AS BIGINT) AS level FROM p GROUP BY GROUPING SETS ((group_id, CAST(floor(probability * 5) AS BIGINT)), (group_id), (CAST(floor(probability * 5) AS BIGINT)), ())",
    "leakage_components": P_SQL.replace("WITH p AS", "WITH RECURSIVE p AS") + ", r AS (SELECT id, id AS low FROM p UNION SELECT p.id, r.low FROM r JOIN p ON p.id // 50 = r.id // 50 OR p.id % 1000 = r.id % 1000) SELECT id, min(low) AS component FROM r GROUP BY 1",
    "chrono_embargo_split": P_SQL + ", g AS (SELECT id // 20 AS g, min(id % 97) AS first, least(max(id % 97), min(id % 97) + 8) AS last, sum(weight) AS w FROM p GROUP BY 1), c AS (SELECT first AS cutoff, (SELECT sum(w) FROM g h WHERE h.first >= g.first) AS test FROM g GROUP BY 1, g.first), b AS (SELECT cutoff FROM c ORDER BY abs(test / (SELECT sum(w) FROM g) - 0.2), cutoff LIMIT 1) SELECT cutoff, CASE WHEN first >= cutoff THEN 'test' WHEN last < cutoff THEN 'train' ELSE 'embargo' END AS side, count(*) AS groups, sum(w) AS weight FROM g, b GROUP BY 1, 2",
    "label_matrix_integrity": J_SQL + ", k AS (SELECT * FROM j WHERE NOT (observation % 29 = 0 AND reviewer = 'r3') UNION ALL SELECT * FROM j WHERE observation % 31 = 0 AND reviewer = 'r1') SELECT 'duplicate' AS rule, observation, label, reviewer FROM k GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'missing', observation, label, reviewer FROM j WHERE observation % 29 = 0 AND reviewer = 'r3'",
    "hash_chain_violations": "WITH e AS (SELECT user_id % 20 AS chain, event_id AS phase, sha256(CAST(event_id AS VARCHAR)) AS root FROM events), b AS (SELECT *, lag(root) OVER (PARTITION BY chain ORDER BY phase) AS before FROM e) SELECT chain, phase, 'forged' AS previous, before FROM b WHERE phase % 50 = 7",
}
