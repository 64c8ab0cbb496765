"""Evidence of facts: the smallest bounded set of items that bears a fact's score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.operators.sessions import MOST_SOURCES, MOST_UNITS, PER_SOURCE, PER_UNIT, STRENGTHS, sample_evidence
from lorewell.sources.tables import table

#: Items that a fact's digest names at most.
MOST_ITEMS = 4


def strength(source: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in STRENGTHS.items() for x in kv])[source]


def set_score(sources: Column) -> Column:
    """The score of items with distinct hashes, from their sources; null for none. An item of an unknown source spoils the set."""
    more = F.least(F.lit(MOST_UNITS), (F.size(sources) - 1) * PER_UNIT) + F.least(F.lit(MOST_SOURCES), (F.size(F.array_distinct(sources)) - 1) * PER_SOURCE)
    top = F.array_max(F.transform(sources, strength))
    return F.when((F.size(sources) > 0) & F.forall(sources, lambda s: strength(s).isNotNull()), F.round(F.least(F.lit(1.0), top + more) * 100).cast("long"))


def minimal_evidence(items: DataFrame, targets: DataFrame | None = None, most: int = MOST_ITEMS) -> DataFrame:
    """fact_id, step, ref, source, hash, score (of the chosen so far) from items (fact_id, ref, source, hash) and targets
    (fact_id, target; without: the score of all items): of equal hashes the strongest item stays (then the smallest ref);
    step by step the item joins that gives the highest score, the smallest ref first, until the score is the target or there
    are `most`. A score depends on sources alone, so only the first `most` refs of each source can ever be chosen, which
    bounds a fact's list whatever the number of its items. Items of unknown sources come last, as they spoil the score;
    null facts and hashes are left out."""
    keyed = items.filter("fact_id IS NOT NULL AND hash IS NOT NULL").select("fact_id", "ref", "source", "hash")
    weight = F.coalesce(strength(F.col("source")), F.lit(-1.0))
    best = keyed.groupBy("fact_id", "hash").agg(F.min(F.struct((-weight).alias("w"), "ref", "source")).alias("b")).select("fact_id", "hash", "b.ref", "b.source")
    if targets is None:
        g = best.groupBy("fact_id").agg(F.count("*").alias("n"), F.countDistinct("source").alias("kinds"), F.max(weight).alias("top"), F.min(weight).alias("least"))
        more = F.least(F.lit(MOST_UNITS), (F.col("n") - 1) * PER_UNIT) + F.least(F.lit(MOST_SOURCES), (F.col("kinds") - 1) * PER_SOURCE)
        targets = g.select("fact_id", F.when(F.col("least") >= 0, F.round(F.least(F.lit(1.0), F.col("top") + more) * 100).cast("long")).alias("target"))
    place = F.row_number().over(Window.partitionBy("fact_id", "source").orderBy("ref", "hash"))
    few = best.withColumn("place", place).filter(F.col("place") <= most)
    listed = few.groupBy("fact_id").agg(F.sort_array(F.collect_list(F.struct("ref", "hash", "source"))).alias("pool")).join(targets, "fact_id", "left")
    sources = lambda chosen: F.transform(chosen, lambda x: x["source"])

    def step(chosen: Column) -> Column:
        """chosen with the next item, or as it is if the target is reached or nothing is left."""
        left = F.filter("pool", lambda x: ~F.array_contains(F.transform(chosen, lambda c: c["hash"]), x["hash"]))
        ranked = F.array_sort(F.transform(left, lambda x: F.struct((-F.coalesce(set_score(F.concat(sources(chosen), F.array(x["source"]))), F.lit(-1))).alias("s"), x["ref"].alias("ref"), x["hash"].alias("hash"), x["source"].alias("source"))))
        first = F.get(ranked, F.lit(0))
        done = F.coalesce(set_score(sources(chosen)).eqNullSafe(F.col("target")), F.lit(False)) & (F.size(chosen) > 0)
        return F.when(done | (F.size(left) == 0), chosen).otherwise(F.concat(chosen, F.array(F.struct(first["ref"].alias("ref"), first["hash"].alias("hash"), first["source"].alias("source")))))

    rows = listed.withColumn("chosen", F.aggregate(F.array(*[F.lit(k) for k in range(most)]), F.slice("pool", 1, 0), lambda chosen, _: step(chosen)))
    out = rows.select("fact_id", "chosen", F.posexplode("chosen").alias("at", "x"))
    return out.select("fact_id", (F.col("at") + 1).cast("long").alias("step"), "x.ref", "x.source", "x.hash", set_score(sources(F.slice("chosen", F.lit(1), F.col("at") + 1))).alias("score"))


def sample_items(turns: DataFrame) -> DataFrame:
    """The messages of conversations as evidence, a fact being three conversations; some messages count as the same text."""
    kind = F.when(F.col("role") == "user", "phase").when(F.col("turn") % 4 == 1, "error_fix").when(F.col("turn") % 4 == 3, "bash_pair").otherwise("assistant_summary")
    said = F.concat((F.col("turn") % 5).cast("string"), F.substring(F.coalesce("text", F.lit("")), 1, 2))
    return turns.select(F.floor(F.col("conv_id") / 3).cast("long").alias("fact_id"), F.concat_ws(":", kind, F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("ref"), kind.alias("source"), F.sha2(said, 256).alias("hash"))


QUERIES = {"minimal_evidence": lambda s, d: minimal_evidence(sample_items(table(s, d, "conversations")))}
_WEIGHT = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in STRENGTHS.items()) + " END"
_SCORE = "CAST(round(least(1, list_max(list_transform({0}, lambda s: " + _WEIGHT.format("s") + f")) + least({MOST_UNITS}, (len({{0}}) - 1) * {PER_UNIT}) + least({MOST_SOURCES}, (len(list_distinct({{0}})) - 1) * {PER_SOURCE})) * 100) AS BIGINT)"
SQL = {
    "minimal_evidence": """WITH RECURSIVE i AS (SELECT conv_id // 3 AS fact_id, CASE WHEN role = 'user' THEN 'phase' WHEN turn % 4 = 1 THEN 'error_fix' WHEN turn % 4 = 3 THEN 'bash_pair' ELSE 'assistant_summary' END AS source,
        source || ':' || conv_id || ':' || turn AS ref, sha256((turn % 5) || substr(coalesce(text, ''), 1, 2)) AS hash FROM conversations),
      best AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY fact_id, hash ORDER BY """ + _WEIGHT.format("source") + """ DESC, ref) = 1),
      goal AS (SELECT fact_id, """ + _SCORE.format("ss") + """ AS target FROM (SELECT fact_id, list(source) AS ss FROM best GROUP BY 1)),
      r AS (SELECT fact_id, 0 AS step, '' AS ref, '' AS source, '' AS hash, CAST(NULL AS BIGINT) AS score, CAST([] AS VARCHAR[]) AS hs, CAST([] AS VARCHAR[]) AS ss FROM goal
        UNION ALL SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY score DESC, ref, hash) AS k FROM (
          SELECT r.fact_id, r.step + 1 AS step, b.ref, b.source, b.hash, """ + _SCORE.format("list_append(r.ss, b.source)") + """ AS score, list_append(r.hs, b.hash) AS hs, list_append(r.ss, b.source) AS ss
          FROM r JOIN goal g USING (fact_id) JOIN best b ON b.fact_id = r.fact_id AND NOT list_contains(r.hs, b.hash) WHERE r.step < 4 AND r.score IS DISTINCT FROM g.target)) WHERE k = 1)
      SELECT fact_id, CAST(step AS BIGINT) AS step, ref, source, hash, score FROM r WHERE step > 0""",
}
