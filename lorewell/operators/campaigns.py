"""Sealed campaigns as event logs: each step a receipt with the Merkle root of its rows and the root before it.

A root is made by levels: sorted rows are hashed, every FAN of them become one node, and so on until one is left, so that no
task holds more than FAN hashes of a group however many rows it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.operators.ordering import numbered
from lorewell.sources import scratch
from lorewell.sources.tables import table

FAN = 16
#: Steps of a campaign, each of which may follow only the one before it, once.
PHASES = ("register", "close", "result")


def leaf(*values: Column) -> Column:
    """The hash of a row's values: each with its length, so that no two rows read the same; null is told from the empty text."""
    parts = [F.coalesce(F.concat(F.length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat_ws("|", F.lit("leaf"), *parts), 256)


def merkle_roots(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, root, rows: the root of each group's leaves (column leaf) in sorted order. Equal leaves count as often as they occur;
    a group of one row has a node over its leaf."""
    n = scratch.written(numbered(rows.select(*keys, "leaf").withColumn("_u", F.monotonically_increasing_id()), *keys, "leaf", "_u"), "leaves")
    first = n.groupBy(*keys).agg(F.min("number").alias("first"), F.count("*").alias("rows"))
    level = n.join(first, keys).select(*keys, "rows", (F.col("number") - F.col("first")).alias("at"), F.col("leaf").alias("hash"))
    nodes, out = first.agg(F.max("rows")).first()[0] or 0, None
    while out is None or nodes > 1:
        hashes = F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"])  # FAN at most
        up = level.groupBy(*keys, "rows", F.floor(F.col("at") / FAN).cast("long").alias("up")).agg(F.sha2(F.concat_ws("|", F.lit("node"), F.array_join(hashes, "|")), 256).alias("hash"))
        level, nodes = scratch.written(up.withColumnRenamed("up", "at"), "level"), -(-nodes // FAN)
        whole = level.groupBy(*keys).agg(F.count("*").alias("n")).filter("n = 1").select(*keys)  # groups that are one node now
        roots = level.join(whole, keys, "left_semi").select(*keys, F.col("hash").alias("root"), "rows")
        out = roots if out is None else out.unionByName(roots)
        level = level.join(whole, keys, "left_anti")
    return out


def violations(receipts: DataFrame, rows: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """campaign, seq, phase, rule, told, found of all receipts (campaign, seq, phase, root, previous) that do not hold: `repeat`,
    a step that was taken before; `order`, one that may not follow the step before it; `previous`, a root before that is
    not that of the receipt before; `rows`, a root that the step's rows (campaign, phase, leaf) do not give, or rows without
    a receipt; `rollback`, an anchor (campaign, seq, root: seen earlier) that the log does not have any more."""
    w = Window.partitionBy("campaign").orderBy("seq")
    r = receipts.withColumn("before", F.lag("root").over(w)).withColumn("after", F.lag("phase").over(w))
    r = scratch.written(r.withColumn("time", F.row_number().over(Window.partitionBy("campaign", "phase").orderBy("seq"))), "receipts")
    allowed = F.create_map(*[F.lit(x) for i, p in enumerate(PHASES) for x in (p, PHASES[i - 1] if i else "")])[F.col("phase")]
    told = lambda rule, says, found: [F.lit(rule).alias("rule"), says.alias("told"), found.alias("found")]
    own = ["campaign", "seq", "phase"]
    again = r.filter("time > 1").select(*own, *told("repeat", F.col("phase"), F.col("time").cast("string")))
    order = r.filter(~allowed.eqNullSafe(F.coalesce("after", F.lit(""))) & (F.col("time") == 1)).select(*own, *told("order", F.col("phase"), F.col("after")))
    previous = r.filter(~F.col("previous").eqNullSafe(F.col("before"))).select(*own, *told("previous", F.col("previous"), F.col("before")))
    roots = merkle_roots(rows, ["campaign", "phase"])
    first = r.filter("time = 1").select(*own, "root")
    j = first.join(roots.select("campaign", "phase", F.col("root").alias("made")), ["campaign", "phase"], "full")
    torn = j.filter(~F.col("root").eqNullSafe(F.col("made"))).select(*own, *told("rows", F.col("root"), F.col("made")))
    out = again.union(order).union(previous).union(torn)
    if anchors is not None:
        a = anchors.select("campaign", "seq", F.col("root").alias("seen")).join(receipts.select("campaign", "seq", "phase", "root"), ["campaign", "seq"], "left")
        out = out.union(a.filter(~F.col("root").eqNullSafe(F.col("seen"))).select(*own, *told("rollback", F.col("seen"), F.col("root"))))
    return out


def sealed(rows: DataFrame) -> DataFrame:
    """The receipts of campaigns that were kept as they should be, from their rows (campaign, phase, leaf)."""
    place = F.create_map(*[F.lit(x) for i, p in enumerate(PHASES) for x in (p, i + 1)])[F.col("phase")]
    r = merkle_roots(rows, ["campaign", "phase"]).select("campaign", place.cast("long").alias("seq"), "phase", "root")
    return r.withColumn("previous", F.lag("root").over(Window.partitionBy("campaign").orderBy("seq")))


def sample_rows(labels: DataFrame) -> DataFrame:
    """Labels as the rows of eleven campaigns: what was registered, what was judged, and the result by judgement."""
    c = (F.col("doc_id") % 11).alias("campaign")
    first = labels.select(c, F.lit("register").alias("phase"), leaf(F.col("doc_id")).alias("leaf"))
    second = labels.select(c, F.lit("close").alias("phase"), leaf(F.col("doc_id"), F.col("quality"), F.col("toxic")).alias("leaf"))
    third = labels.groupBy(c, "quality").agg(F.count("*").alias("n")).select("campaign", F.lit("result").alias("phase"), leaf(F.col("quality"), F.col("n")).alias("leaf"))
    return first.union(second).union(third)


def _tampered(s: SparkSession, d: str) -> DataFrame:
    rows = scratch.written(sample_rows(table(s, d, "labels")), "campaigns")
    r = scratch.written(sealed(rows), "sealed")
    c, phase = F.col("campaign"), F.col("phase")
    forged = r.withColumn("previous", F.when((c == 1) & (phase == "close"), "forged").otherwise(F.col("previous"))).withColumn("root", F.when((c == 2) & (phase == "register"), F.lit("other")).otherwise(F.col("root")))
    forged = forged.filter(~((c == 3) & (phase == "close"))).filter(~((c == 4) & (phase == "result")))
    forged = forged.union(forged.filter((c == 5) & (phase == "result")).select("campaign", F.lit(4).cast("long"), "phase", "root", F.col("root").alias("previous")))
    return violations(forged, rows, r.filter("seq = 3").select("campaign", "seq", "root"))


QUERIES = {"campaign_roots": lambda s, d: sealed(sample_rows(table(s, d, "labels"))), "campaign_violations": _tampered}
_LEAF = lambda *v: "sha256(concat_ws('|', 'leaf', " + ", ".join(f"coalesce(length(CAST({x} AS VARCHAR)) || ':' || {x}, '-')" for x in v) + "))"
_ROOTS = f"""WITH RECURSIVE l AS (SELECT doc_id % 11 AS campaign, 'register' AS phase, {_LEAF('doc_id')} AS leaf FROM labels UNION ALL SELECT doc_id % 11, 'close', {_LEAF('doc_id', 'quality', 'toxic')} FROM labels
      UNION ALL SELECT campaign, 'result', {_LEAF('quality', 'n')} FROM (SELECT doc_id % 11 AS campaign, quality, count(*) AS n FROM labels GROUP BY 1, 2)),
    t AS (SELECT campaign, phase, 0 AS level, row_number() OVER (PARTITION BY campaign, phase ORDER BY leaf) - 1 AS place, leaf AS hash, count(*) OVER (PARTITION BY campaign, phase) AS n FROM l
      UNION ALL SELECT campaign, phase, level + 1, place // {FAN}, sha256('node|' || string_agg(hash, '|' ORDER BY place)), (n + {FAN - 1}) // {FAN} FROM t WHERE n > 1 OR level = 0 GROUP BY campaign, phase, level, place // {FAN}, n),
    r AS MATERIALIZED (SELECT campaign, CASE phase WHEN 'register' THEN 1 WHEN 'close' THEN 2 ELSE 3 END AS seq, phase, hash AS root FROM t WHERE n = 1 AND level > 0),
    s AS MATERIALIZED (SELECT campaign, CAST(seq AS BIGINT) AS seq, phase, root, lag(root) OVER (PARTITION BY campaign ORDER BY seq) AS previous FROM r)"""
SQL = {
    "campaign_roots": _ROOTS + " SELECT * FROM s",
    "campaign_violations": _ROOTS + """ SELECT campaign, seq, phase, 'previous' AS rule, 'forged' AS told, (SELECT root FROM s p WHERE p.campaign = 1 AND p.phase = 'register') AS found FROM s WHERE campaign = 1 AND phase = 'close'
      UNION ALL SELECT campaign, seq, phase, 'rows', 'other', root FROM s WHERE campaign = 2 AND phase = 'register' UNION ALL SELECT campaign, seq, phase, 'previous', previous, 'other' FROM s WHERE campaign = 2 AND phase = 'close'
      UNION ALL SELECT campaign, seq, phase, 'order', 'result', 'register' FROM s WHERE campaign = 3 AND phase = 'result' UNION ALL SELECT campaign, seq, phase, 'previous', previous, (SELECT root FROM s p WHERE p.campaign = 3 AND p.phase = 'register') FROM s WHERE campaign = 3 AND phase = 'result'
      UNION ALL SELECT campaign, NULL, phase, 'rows', NULL, root FROM s WHERE campaign = 3 AND phase = 'close' UNION ALL SELECT campaign, NULL, phase, 'rows', NULL, root FROM s WHERE campaign = 4 AND phase = 'result'
      UNION ALL SELECT campaign, seq, NULL, 'rollback', root, NULL FROM s WHERE campaign = 4 AND seq = 3 UNION ALL SELECT 5, 4, 'result', 'repeat', 'result', '2'""",
}
