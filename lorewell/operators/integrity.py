"""Integrity of calibration data, digests and plans, and quality metrics of digests, reviews and captures."""

from __future__ import annotations

import json
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.functions.rows import by_row
from lorewell.operators import facts
from lorewell.operators.sessions import CONFLICT_CEILING, MOST_SOURCES, MOST_UNITS, PER_SOURCE, PER_UNIT, STRENGTHS, confidence_of
from lorewell.operators.surfaces import f_beta
from lorewell.sources.tables import table

#: Versions of the models whose scores can be recomputed, and the evidence model that each salience model goes with.
MODELS = {"knowledge-salience-v1": "evidence-v1"}


def evidence_of(sources: Column, units: Column, conflict: Column) -> Column:
    """The evidence score of a snapshot: its strongest source, and what independent units and further sources add."""
    strength = F.create_map(*[F.lit(x) for kv in STRENGTHS.items() for x in kv])
    top = F.array_max(F.transform(sources, lambda s: F.element_at(strength, s)))
    more = F.least(F.lit(MOST_UNITS), (units - 1) * PER_UNIT) + F.least(F.lit(MOST_SOURCES), (F.size(F.array_distinct(sources)) - 1) * PER_SOURCE)
    score = F.round(F.least(F.lit(1.0), top + more) * 100)
    return F.when(F.size(sources) == 0, 0).otherwise(F.when(conflict, F.least(score, F.lit(CONFLICT_CEILING))).otherwise(score)).cast("long")


def snapshot_violations(s: DataFrame) -> DataFrame:
    """id, rule of snapshots (id, model, evidence_model, factors, salience, evidence, sources, units, conflict, status, rank,
    population, sampled, probability) whose fields contradict each other or whose scores their models do not give."""
    f = F.col("factors")
    names = F.create_map(*[F.lit(x) for kv in MODELS.items() for x in kv])
    rules = [
        ("units_without_sources", (F.size("sources") == 0) & (F.col("units") != 0)), ("sources_without_units", (F.size("sources") > 0) & (F.col("units") < 1)), ("fewer_units_than_sources", F.col("units") < F.size("sources")),
        ("rank_of_selected", (F.col("status") == "selected") & (F.col("rank").isNull() | (F.col("rank") > F.col("population")))), ("rank_of_others", (F.col("status") != "selected") & F.col("rank").isNotNull()),
        ("sample_probability", F.col("sampled") != (F.col("probability") > 0)), ("model", F.element_at(names, F.col("model")).isNull()), ("evidence_model", F.element_at(names, F.col("model")) != F.col("evidence_model")),
        ("salience", F.col("salience") != facts.salience(*[f[k] for k in facts.WEIGHTS])), ("evidence", F.col("evidence") != evidence_of(F.col("sources"), F.col("units"), F.col("conflict"))),
    ]
    broken = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]), lambda r: r.isNotNull())
    return s.select("id", F.explode(broken).alias("rule"))


def sample_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of labelled documents, some of them damaged."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "labels").select("doc_id").distinct()
    part = lambda m: F.round(F.pmod(k * m, F.lit(101)) / 100, 2)
    d = d.withColumn("factors", F.struct(*[part(m).alias(n) for m, n in zip((7, 11, 13, 17, 19), facts.WEIGHTS, strict=True)]))
    kinds = F.array(*[F.lit(x) for x in STRENGTHS])
    d = d.withColumn("sources", F.slice(kinds, F.lit(1), (k % 4 + 1).cast("int"))).withColumn("units", (k % 4 + 1 + k % 3).cast("int")).withColumn("conflict", k % 5 == 0)
    d = d.withColumn("salience", facts.salience(*[F.col("factors")[n] for n in facts.WEIGHTS])).withColumn("evidence", evidence_of(F.col("sources"), F.col("units"), F.col("conflict")))
    return d.select(
        k.alias("id"), F.when(k % 53 == 1, "other").otherwise("knowledge-salience-v1").alias("model"), F.when(k % 47 == 2, "evidence-v0").otherwise("evidence-v1").alias("evidence_model"), "factors", (F.col("salience") + F.when(k % 31 == 3, 1).otherwise(0)).alias("salience"),
        (F.col("evidence") - F.when(k % 29 == 4, 2).otherwise(0)).alias("evidence"), F.when(k % 43 == 5, F.array().cast("array<string>")).otherwise(F.col("sources")).alias("sources"), F.when(k % 41 == 6, 0).otherwise(F.col("units")).alias("units"), "conflict",
        F.when(k % 3 == 0, "selected").otherwise("candidate").alias("status"), F.when((k % 3 == 0) != (k % 37 == 7), (k % 9 + 1)).alias("rank"), F.lit(9).alias("population"), (k % 2 == 0).alias("sampled"), F.when((k % 2 == 0) != (k % 23 == 8), 0.5).otherwise(0.0).alias("probability"),
    )


def bijection_violations(frame: DataFrame, archive: DataFrame) -> DataFrame:
    """rule, token of what the frame and the archive (token) do not have exactly once each."""
    count = lambda df, name: df.groupBy("token").agg(F.count("*").alias(name))
    j = count(frame, "framed").join(count(archive, "archived"), "token", "full")
    rule = F.when(F.col("archived").isNull(), "not archived").when(F.col("framed").isNull(), "not framed").when((F.col("framed") > 1) | (F.col("archived") > 1), "repeated")
    return j.select(rule.alias("rule"), "token").filter("rule IS NOT NULL")


def canonical(value) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def domain_hash(domain: str, value) -> str:
    """A digest of a canonical value that differs by what it is for."""
    return sha256(f"{domain}\0{canonical(value)}".encode()).hexdigest()


def drift(bound: DataFrame, current: DataFrame) -> DataFrame:
    """name, state (changed, gone, new) of bound parts (name, hash) whose hash is not that of the current ones."""
    j = bound.select("name", F.col("hash").alias("was")).join(current.select("name", F.col("hash").alias("now")), "name", "full")
    state = F.when(F.col("now").isNull(), "gone").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("now"), "changed")
    return j.select("name", state.alias("state")).filter("state IS NOT NULL")


FACT_LINE = r"^- \[(\w+)\] (.+) \(s=(\d+), e=(\d+), c=(\w+)\)$"


def digest_facts(digests: DataFrame) -> DataFrame:
    """id, section, kind, statement, salience, evidence, confidence of digests (id, text): fact lines under their headings; a
    heading holds until the next."""
    lines = digests.select("id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    section = F.last(F.when(F.col("raw").startswith("### "), F.trim(F.substring("raw", 5, 1000))), ignorenulls=True).over(Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    part = lambda i: F.regexp_extract("raw", FACT_LINE, i)
    found = lines.withColumn("section", section).filter(F.col("raw").rlike(FACT_LINE))
    return found.select("id", "section", part(1).alias("kind"), part(2).alias("statement"), part(3).cast("long").alias("salience"), part(4).cast("long").alias("evidence"), part(5).alias("confidence"))


def attestation(text: Column) -> Column:
    return F.sha2(F.concat(F.lit("digest-v1\0"), text), 256)


def digest_violations(digests: DataFrame) -> DataFrame:
    """id, rule of digests (id, text, checksum): a checksum that is not the text's, scores out of range, a confidence that its
    evidence does not have, a fact under no heading."""
    sums = digests.filter(F.col("checksum") != attestation(F.col("text"))).select("id", F.lit("checksum").alias("rule"))
    f = digest_facts(digests)
    rules = [("range", (F.col("salience") > 100) | (F.col("evidence") > 100)), ("confidence", F.col("confidence") != confidence_of(F.col("evidence"))), ("section", F.col("section").isNull())]
    bad = f.select("id", F.explode(F.filter(F.array(*[F.when(b, F.lit(n)) for n, b in rules]), lambda r: r.isNotNull())).alias("rule"))
    return sums.union(bad.distinct())


def sample_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of conversations, some of them damaged."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    k = F.col("conv_id") * 31 + F.col("turn")
    evidence = k * 7 % 100
    told = F.when(k % 17 == 3, "high").otherwise(confidence_of(evidence))
    line = F.concat(F.when(k % 13 == 4, "").otherwise("### Ergebnisse\n"), F.lit("- [result] fact "), k.cast("string"), F.lit(" (s="), (k % 101 + F.when(k % 19 == 5, 60).otherwise(0)).cast("string"), F.lit(", e="), evidence.cast("string"), F.lit(", c="), told, F.lit(")"))
    g = c.groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return g.withColumn("checksum", F.when(F.col("id") % 6 == 1, "forged").otherwise(attestation(F.col("text"))))


#: What an expected atom weighs by its importance, and the weights and kinds of the quality categories.
IMPORTANCE = {"critical": 5, "high": 3, "medium": 1}
CATEGORIES = {"capture": (0.25, ("harvester_update", "session_digest")), "retrieval": (0.20, ("retrieval",)), "promotion": (0.20, ("promotion", "claim_extraction")), "review": (0.15, ("review",)), "background": (0.10, ("background",))}


def _words(text: str) -> list[str]:
    import unicodedata

    return regex.findall(r"[\p{L}\p{N}]+(?:[._:/-][\p{L}\p{N}]+)*", unicodedata.normalize("NFKC", text).lower())


def word_tokens(text: Column) -> Column:
    """Words as the metrics against copying count them: compounds are one word."""
    return by_row(lambda t: _words(t or ""), "array<string>", pa.list_(pa.string()))(text)


def atom_recall(atoms: DataFrame, sections: DataFrame) -> DataFrame:
    """id, recall, section_accuracy: the share of the expected atoms' (id, section, pattern, importance) weight that stands in a
    digest's sections (id, heading, content), and of those found the share that stands under its own heading."""
    weight = F.create_map(*[F.lit(x) for kv in IMPORTANCE.items() for x in kv])[F.col("importance")]
    j = atoms.withColumn("atom", F.struct("section", "pattern", "importance")).withColumn("w", weight).join(sections, "id", "left")
    hit = F.coalesce(F.regexp_like("content", F.concat(F.lit("(?i)"), "pattern")), F.lit(False))
    at = F.regexp_replace(F.lower("heading"), r"[^\p{L}\p{N}]+", " ") == F.regexp_replace(F.lower("section"), r"[^\p{L}\p{N}]+", " ")
    per = j.groupBy("id", "atom", "w").agg(F.max(hit).alias("hit"), F.max(hit & F.coalesce(at, F.lit(False))).alias("placed"))
    g = per.groupBy("id").agg(F.sum(F.when(F.col("hit"), F.col("w")).otherwise(0)).alias("got"), F.sum("w").alias("all"), F.count_if("placed").alias("placed"), F.count_if("hit").alias("hits"))
    return g.select("id", F.round(F.coalesce(F.try_divide("got", "all"), F.lit(1.0)), 6).alias("recall"), F.round(F.coalesce(F.try_divide("placed", "hits"), F.lit(1.0)), 6).alias("section_accuracy"))


def _longest(pair: dict) -> int:
    """The longest run of words that a and b have in common."""
    best, last = 0, {}
    at: dict[str, list[int]] = {}
    for j, w in enumerate(pair["b"] or ()):
        at.setdefault(w, []).append(j)
    for w in pair["a"] or ():
        now = {j: last.get(j - 1, 0) + 1 for j in at.get(w, ())}
        best, last = max([best, *now.values()]), now
    return best


def copying(pairs: DataFrame) -> DataFrame:
    """id, longest, coverage, compression, copied of generated texts and their sources (id, generated, source): the longest run of
    common words, the share of the generated 5-grams that are the source's, words against words, and whether the whole source
    of 20 words or more stands in the generated text."""
    p = pairs.withColumn("g", word_tokens(F.coalesce("generated", F.lit("")))).withColumn("s", word_tokens(F.coalesce("source", F.lit(""))))
    grams = lambda c: F.when(F.size(c) >= 5, F.transform(F.sequence(F.lit(1), F.size(c) - 4), lambda i: F.xxhash64(F.slice(c, i, F.lit(5))))).otherwise(F.array().cast("array<bigint>"))
    p = p.withColumn("gg", grams(F.col("g"))).withColumn("sg", F.array_distinct(grams(F.col("s"))))
    shared = F.size(F.array_intersect(F.array_distinct("gg"), "sg"))
    folded = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return p.select(
        "id", by_row(_longest, "long", pa.int64())(F.struct(F.col("g").alias("a"), F.col("s").alias("b"))).alias("longest"), F.round(F.coalesce(F.try_divide(shared, F.size(F.array_distinct("gg"))), F.lit(0.0)), 6).alias("coverage"),
        F.round(F.size("g") / F.greatest(F.size("s"), F.lit(1)), 6).alias("compression"), ((F.size("s") >= 20) & F.contains(folded(F.col("generated")), folded(F.col("source")))).alias("copied"),
    )


def category_score(results: DataFrame) -> DataFrame:
    """score of fixture results (type, score, gate): the categories' mean scores by weight, over the weights that were measured
    at all; 0 if a gate is closed."""
    of = F.create_map(*[x for c, (_, kinds) in CATEGORIES.items() for k in kinds for x in (F.lit(k), F.lit(c))])
    weight = F.create_map(*[x for c, (w, _) in CATEGORIES.items() for x in (F.lit(c), F.lit(w))])
    g = results.withColumn("category", of[F.col("type")]).filter("category IS NOT NULL").groupBy("category").agg(F.avg("score").alias("mean"), F.min("gate").alias("gate"))
    w = weight[F.col("category")]
    return g.agg(F.round(F.when(F.min("gate"), F.sum(F.col("mean") * w) / sum(x for x, _ in CATEGORIES.values())).otherwise(0.0), 6).alias("score"), F.count("*").alias("categories"))


def capture_metrics(expected: DataFrame, found: DataFrame) -> DataFrame:
    """recall, precision, f2, late, early of captured facts: expected (fact, late), found (fact, early, wanted)."""
    j = expected.join(found.select("fact", "early").distinct(), "fact", "left")
    e = j.agg(F.count("*").alias("expected"), F.count("early").alias("hits"), F.count_if("late").alias("n_late"), F.count_if(F.col("late") & F.col("early").isNotNull()).alias("late_hits"), F.count_if(F.col("late") & ~F.coalesce("early", F.lit(False))).alias("not_early"))
    both = e.crossJoin(found.agg(F.count_if(~F.col("wanted")).alias("noise")))  # one row each
    r, p = F.coalesce(F.try_divide("hits", "expected"), F.lit(1.0)), F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col("noise")), F.lit(1.0))
    share = lambda n: F.round(F.coalesce(F.try_divide(n, "n_late"), F.lit(1.0)), 6)
    return both.select(F.round(r, 6).alias("recall"), F.round(p, 6).alias("precision"), F.round(f_beta(p, r, 2.0), 6).alias("f2"), share("late_hits").alias("late"), share("not_early").alias("early"))


def review_stability(first: DataFrame, second: DataFrame, settled: DataFrame) -> DataFrame:
    """stability (shared ids over the larger of two runs) and returned (settled ids that come back in the second run)."""
    both = first.join(second, "item_id", "left_semi").agg(F.count("*").alias("shared"))
    sizes = first.agg(F.count("*").alias("a")).crossJoin(second.agg(F.count("*").alias("b"))).crossJoin(second.join(settled, "item_id", "left_semi").agg(F.count("*").alias("returned")))  # one row each
    return both.crossJoin(sizes).select(F.round(F.coalesce(F.try_divide(F.col("shared"), F.greatest("a", "b")), F.lit(1.0)), 6).alias("stability"), "returned")


def idempotency_violations(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows that only one of two runs has, as often as it has them more."""
    return first.exceptAll(second).withColumn("side", F.lit("first")).union(second.exceptAll(first).withColumn("side", F.lit("second")))


def missing_response_interval(low: Column, high: Column, rate: Column) -> tuple[Column, Column]:
    """Bounds of a mean within [-1, 1] of which only a share was observed, whatever the rest is."""
    return F.round(F.greatest(F.lit(-1.0), rate * low - (1 - rate)), 6), F.round(F.least(F.lit(1.0), rate * high + (1 - rate)), 6)


def review_coverage(j: DataFrame, n: int) -> DataFrame:
    """label, judged, rate of n observations; no rate without any."""
    return j.groupBy("label").agg(F.countDistinct("observation").alias("judged")).withColumn("rate", F.round(F.try_divide(F.col("judged"), F.lit(float(n))), 6))


def upper_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """The median of each key's values, of an even number the upper one."""
    return df.groupBy(key).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)").alias("median"))


docs = lambda s, d: table(s, d, "documents")
ids = lambda df, e: df.filter(e).select(F.col("doc_id").alias("item_id"))
QUERIES = {
    "snapshot_violations": lambda s, d: snapshot_violations(sample_snapshots(s, d)), "digest_facts": lambda s, d: digest_facts(sample_digests(s, d)), "digest_violations": lambda s, d: digest_violations(sample_digests(s, d)),
    "frame_bijection": lambda s, d: bijection_violations(docs(s, d).filter("doc_id % 19 <> 1").select(F.col("doc_id").alias("token")), docs(s, d).filter("doc_id % 23 <> 2").select(F.when(F.col("doc_id") % 29 == 3, 0).otherwise(F.col("doc_id")).alias("token"))),
    "plan_drift": lambda s, d: drift(*[docs(s, d).filter(F.col("doc_id") % 31 != r).select(F.concat(F.lit("part-"), "doc_id").alias("name"), F.sha2(F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % m == 0, "x").otherwise("")), 256).alias("hash")) for r, m in ((1, 17), (2, 34))]),
    "atom_recall": lambda s, d: atom_recall(*_atoms(s, d)), "copy_metrics": lambda s, d: copying(_copies(s, d)), "category_score": lambda s, d: category_score(_results(s, d)),
    "capture_metrics": lambda s, d: capture_metrics(docs(s, d).filter("doc_id % 3 = 0").select(F.col("doc_id").alias("fact"), (F.col("doc_id") % 2 == 0).alias("late")), docs(s, d).filter("doc_id % 4 < 2").select(F.col("doc_id").alias("fact"), (F.col("doc_id") % 5 == 0).alias("early"), (F.col("doc_id") % 3 == 0).alias("wanted"))),
    "review_stability": lambda s, d: review_stability(ids(docs(s, d), "doc_id % 7 <> 1"), ids(docs(s, d), "doc_id % 11 <> 2"), ids(docs(s, d), "doc_id % 50 = 2")),
    "idempotency": lambda s, d: idempotency_violations(docs(s, d).filter("doc_id % 97 <> 1").select("lang", "source"), docs(s, d).filter("doc_id % 89 <> 2").select("lang", "source")).groupBy("side", "lang").agg(F.count("*").alias("n")),
    "missing_response": lambda s, d: table(s, d, "labels").groupBy("quality").agg(F.avg(F.col("toxic") - 0.5).alias("m"), F.count_if(F.col("doc_id") % 3 != 0).alias("a"), F.count("*").alias("n")).select("quality", *[c.alias(k) for c, k in zip(missing_response_interval(F.col("m") - 0.1, F.col("m") + 0.1, F.col("a") / F.col("n")), ("low", "high"), strict=True)]),
    "review_coverage": lambda s, d: review_coverage(table(s, d, "labels").select(F.col("doc_id").alias("observation"), F.when(F.col("quality") == 1, "useful").otherwise("other").alias("label")), 1000), "upper_medians": lambda s, d: upper_median(table(s, d, "events"), "event_type", "value"),
}


def _atoms(s, d):
    c = table(s, d, "conversations").select(F.col("conv_id").alias("id"), "turn", F.coalesce("text", F.lit("")).alias("content"))
    level = F.get(F.array(*[F.lit(x) for x in IMPORTANCE]), (F.col("turn") % 3).cast("int"))
    atoms = c.select("id", F.concat(F.lit("Teil "), F.col("turn") % 2).alias("section"), F.concat(F.regexp_extract("content", r"([a-z]{3})", 1), F.lit(".{2}"), F.regexp_extract("content", r"([a-z]{2})\W*$", 1)).alias("pattern"), level.alias("importance"))
    return atoms.distinct(), c.select("id", F.concat(F.lit("teil_"), F.col("turn") % 2).alias("heading"), "content")


def _copies(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", "text")
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") % 3 == 0, F.concat_ws(" ", F.lit("before"), "text", F.lit("after"))).otherwise(nxt).alias("generated"), F.col("text").alias("source"))


def _results(s, d):
    kinds = [k for _, ks in CATEGORIES.values() for k in ks]
    k = F.col("doc_id")
    return docs(s, d).select(F.get(F.array(*[F.lit(x) for x in kinds]), (k % len(kinds)).cast("int")).alias("type"), (k % 101).cast("double").alias("score"), F.lit(True).alias("gate"))


KINDS = [k for _, ks in CATEGORIES.values() for k in ks]
DIGEST_SQL = "WITH c AS (SELECT conv_id, turn, conv_id * 31 + turn AS k, (conv_id * 31 + turn) * 7 % 100 AS e FROM conversations WHERE role = 'assistant'), f AS (SELECT *, conv_id AS id, k % 101 + CASE WHEN k % 19 = 5 THEN 60 ELSE 0 END AS salience, CASE WHEN k % 17 = 3 OR e >= 75 THEN 'high' WHEN e >= 45 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN max(CASE WHEN k % 13 <> 4 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) = 1 THEN 'Ergebnisse' END AS section FROM c)"
WEIGHT_OF = "CASE type " + " ".join(f"WHEN '{k}' THEN '{c}'" for c, (_, ks) in CATEGORIES.items() for k in ks) + " END"
SNAP = "SELECT DISTINCT doc_id AS k FROM labels"
SQL = {
    "snapshot_violations": "WITH l AS (" + SNAP + "), s AS (SELECT *, k % 4 + 1 AS n, k % 43 = 5 AS bare, CASE WHEN k % 43 = 5 THEN 0 ELSE k % 4 + 1 END AS ns, k % 4 + 1 + k % 3 AS u, CASE WHEN k % 41 = 6 THEN 0 ELSE k % 4 + 1 + k % 3 END AS units, k % 3 = 0 AS sel, (k % 3 = 0) <> (k % 37 = 7) AS ranked, k % 53 = 1 AS other FROM l), e AS (SELECT *, CASE WHEN k % 5 = 0 THEN least(raw, 44) ELSE raw END AS good, CASE WHEN bare THEN 0 WHEN k % 5 = 0 THEN least(now, 44) ELSE now END AS want FROM (SELECT *, round(least(1, CAST([0.36, 0.44, 0.5, 0.88][n] AS DOUBLE) + least(0.12, (u - 1) * CAST(0.04 AS DOUBLE)) + least(0.08, (n - 1) * CAST(0.04 AS DOUBLE))) * 100) AS raw, round(least(1, CAST([0.36, 0.44, 0.5, 0.88][n] AS DOUBLE) + least(0.12, (units - 1) * CAST(0.04 AS DOUBLE)) + least(0.08, (n - 1) * CAST(0.04 AS DOUBLE))) * 100) AS now FROM s)) SELECT k AS id, rule FROM (SELECT k, unnest(list_filter([CASE WHEN bare AND units <> 0 THEN 'units_without_sources' END, CASE WHEN NOT bare AND units < 1 THEN 'sources_without_units' END, CASE WHEN units < ns THEN 'fewer_units_than_sources' END, CASE WHEN sel AND NOT ranked THEN 'rank_of_selected' END, CASE WHEN NOT sel AND ranked THEN 'rank_of_others' END, CASE WHEN k % 23 = 8 THEN 'sample_probability' END, CASE WHEN other THEN 'model' END, CASE WHEN NOT other AND k % 47 = 2 THEN 'evidence_model' END, CASE WHEN k % 31 = 3 THEN 'salience' END, CASE WHEN good - CASE WHEN k % 29 = 4 THEN 2 ELSE 0 END <> want THEN 'evidence' END], lambda x: x IS NOT NULL)) AS rule FROM e)",
    "digest_facts": DIGEST_SQL + " SELECT id, section, 'result' AS kind, 'fact ' || k AS statement, salience, e AS evidence, confidence FROM f",
    "digest_violations": DIGEST_SQL + " SELECT DISTINCT id, 'checksum' AS rule FROM f WHERE id % 6 = 1 UNION ALL SELECT DISTINCT id, 'range' FROM f WHERE salience > 100 UNION ALL SELECT DISTINCT id, 'confidence' FROM f WHERE k % 17 = 3 AND e < 75 UNION ALL SELECT DISTINCT id, 'section' FROM f WHERE section IS NULL",
    "frame_bijection": "WITH a AS (SELECT doc_id AS token, count(*) AS n FROM documents WHERE doc_id % 19 <> 1 GROUP BY 1), b AS (SELECT CASE WHEN doc_id % 29 = 3 THEN 0 ELSE doc_id END AS token, count(*) AS n FROM documents WHERE doc_id % 23 <> 2 GROUP BY 1) SELECT CASE WHEN b.n IS NULL THEN 'not archived' WHEN a.n IS NULL THEN 'not framed' ELSE 'repeated' END AS rule, token FROM a FULL JOIN b USING (token) WHERE a.n IS NULL OR b.n IS NULL OR a.n > 1 OR b.n > 1",
    "plan_drift": "SELECT 'part-' || doc_id AS name, CASE WHEN doc_id % 31 = 2 THEN 'gone' WHEN doc_id % 31 = 1 THEN 'new' ELSE 'changed' END AS state FROM documents WHERE doc_id % 31 IN (1, 2) OR doc_id % 34 = 17",
    "category_score": "WITH r AS (SELECT [" + ", ".join(f"'{k}'" for k in KINDS) + f"][doc_id % {len(KINDS)} + 1] AS type, CAST(doc_id % 101 AS DOUBLE) AS score FROM documents), g AS (SELECT {WEIGHT_OF} AS c, avg(score) AS m FROM r GROUP BY 1) SELECT round(sum(m * CASE c " + " ".join(f"WHEN '{c}' THEN CAST({w} AS DOUBLE)" for c, (w, _) in CATEGORIES.items()) + " END) / 0.9, 6) AS score, count(*) AS categories FROM g",
    "capture_metrics": "WITH e AS (SELECT doc_id AS f, doc_id % 2 = 0 AS late FROM documents WHERE doc_id % 3 = 0), g AS (SELECT doc_id AS f, doc_id % 5 = 0 AS early, doc_id % 3 = 0 AS wanted FROM documents WHERE doc_id % 4 < 2), x AS (SELECT count(*) AS n, count(g.f) AS h, count(*) FILTER (late) AS l, count(*) FILTER (late AND g.f IS NOT NULL) AS lh, count(*) FILTER (late AND NOT coalesce(early, false)) AS ne, (SELECT count(*) FROM g WHERE NOT wanted) AS noise FROM e LEFT JOIN g USING (f)) SELECT round(h / n, 6) AS recall, round(h / (h + noise), 6) AS precision, round(5 * (h / (h + noise)) * (h / n) / (4 * (h / (h + noise)) + h / n), 6) AS f2, round(lh / l, 6) AS late, round(ne / l, 6) AS early FROM x",
    "review_stability": "WITH a AS (SELECT doc_id FROM documents WHERE doc_id % 7 <> 1), b AS (SELECT doc_id FROM documents WHERE doc_id % 11 <> 2) SELECT round((SELECT count(*) FROM a WHERE doc_id IN (SELECT doc_id FROM b)) / greatest((SELECT count(*) FROM a), (SELECT count(*) FROM b)), 6) AS stability, (SELECT count(*) FROM b WHERE doc_id % 50 = 2) AS returned",
    "idempotency": "WITH a AS (SELECT lang, source FROM documents WHERE doc_id % 97 <> 1), b AS (SELECT lang, source FROM documents WHERE doc_id % 89 <> 2) SELECT side, lang, count(*) AS n FROM (SELECT 'first' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'second', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY 1, 2",
    "missing_response": "WITH g AS (SELECT quality, avg(toxic - CAST(0.5 AS DOUBLE)) AS m, count(*) FILTER (doc_id % 3 <> 0) / count(*) AS r FROM labels GROUP BY 1) SELECT quality, round(greatest(-1, r * (m - CAST(0.1 AS DOUBLE)) - (1 - r)), 6) AS low, round(least(1, r * (m + CAST(0.1 AS DOUBLE)) + (1 - r)), 6) AS high FROM g",
    "review_coverage": "SELECT CASE WHEN quality = 1 THEN 'useful' ELSE 'other' END AS label, count(DISTINCT doc_id) AS judged, round(count(DISTINCT doc_id) / 1000, 6) AS rate FROM labels GROUP BY 1",
    "upper_medians": "SELECT event_type, quantile_disc(value, 0.5 ORDER BY value DESC) AS median FROM events GROUP BY 1".replace("quantile_disc(value, 0.5 ORDER BY value DESC)", "list_sort(list(value))[count(*) // 2 + 1]"),
}
