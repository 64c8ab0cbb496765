"""Tool calls and their results: by id, else the latest open call.

A result that names an id belongs to the earliest open call of that id and to none if there is no such call; one without
an id belongs to the latest open call. Where no result without id falls between a call and the result of its id, the two
kinds cannot compete, and both are window functions over the log: by id, results are numbered as long as calls are open
and meet the call of that number; without, the running balance of what is left gives every call a height, and a result
takes the latest call of its height. Sessions where they compete are folded in order by one task each that keeps nothing
but the open calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.sources import scratch
from lorewell.sources.tables import table

CALL, RESULT = "tool_use", "tool_result"
COLUMNS = ["session", "call", "result", "by"]


def _balanced(e: DataFrame, *keys: str) -> DataFrame:
    """e with open: how many calls are open after the row, where a result at none open counts for nothing (idle)."""
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("step", F.when(F.col("kind") == CALL, 1).otherwise(-1)).withColumn("sum", F.sum("step").over(w))
    e = e.withColumn("floor", F.least(F.lit(0), F.min("sum").over(w))).withColumn("open", F.col("sum") - F.col("floor"))
    before = F.coalesce(F.lag("floor").over(Window.partitionBy(*keys).orderBy("ord")), F.lit(0))
    return e.withColumn("idle", F.col("floor") < before).drop("step", "sum", "floor")


def by_id(e: DataFrame) -> DataFrame:
    """Pairs of calls and results of one id, the earliest open call first. e: session, ord, kind, id (not null)."""
    b = _balanced(e, "session", "id").filter(~F.col("idle"))
    place = F.row_number().over(Window.partitionBy("session", "id", "kind").orderBy("ord"))
    b = b.select("session", "id", "kind", "ord", place.alias("n"))
    calls = b.filter(F.col("kind") == CALL).select("session", "id", "n", F.col("ord").alias("call"))
    results = b.filter(F.col("kind") == RESULT).select("session", "id", "n", F.col("ord").alias("result"))
    return calls.join(results, ["session", "id", "n"]).select("session", "call", "result", F.lit("id").alias("by"))


def by_height(e: DataFrame) -> DataFrame:
    """Pairs of results with the latest open call. e: session, ord, kind."""
    b = _balanced(e, "session").filter(~F.col("idle"))
    height = F.when(F.col("kind") == CALL, F.col("open")).otherwise(F.col("open") + 1)
    b = b.select("session", "kind", "ord", height.alias("height"))
    call = F.lag("ord").over(Window.partitionBy("session", "height").orderBy("ord"))
    return b.withColumn("call", call).filter(F.col("kind") == RESULT).select("session", "call", F.col("ord").alias("result"), F.lit("stack").alias("by"))


def folded(e: DataFrame) -> DataFrame:
    """The same by reading each session in order. Memory follows the calls that are open at a time."""
    kinds = e.select("session", "ord").schema
    ddl = f"session {kinds['session'].dataType.simpleString()}, call {kinds['ord'].dataType.simpleString()}, result {kinds['ord'].dataType.simpleString()}, by string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pending = object(), {}  # open calls in order: number to (place, id)
        waiting: dict = {}  # id to the numbers of its calls, in order; taken ones are skipped
        count = 0
        for b in batches:
            out = []
            for session, at, kind, name in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if session != now:
                    now, pending, waiting, count = session, {}, {}, 0
                if kind == CALL:
                    pending[count] = (at, name)
                    if name is not None:
                        waiting.setdefault(name, []).append(count)
                    count += 1
                    continue
                number = None
                if name is None:
                    number = next(reversed(pending), None)
                else:
                    calls = waiting.get(name, [])
                    while calls and calls[0] not in pending:
                        calls.pop(0)
                    number = calls.pop(0) if calls else None
                if number is not None:
                    out.append((session, pending.pop(number)[0], at, "stack" if name is None else "id"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], COLUMNS)

    sorted_rows = e.select("session", "ord", "kind", "id").repartition("session").sortWithinPartitions("session", "ord")
    return sorted_rows.mapInArrow(run, ddl)


def paired(e: DataFrame) -> DataFrame:
    """session, call, result (places), by (id or stack) from a log (session, ord, kind, id): ord is unique in a session. Other
    kinds are ignored, and so are rows without session or place."""
    log = e.filter("session IS NOT NULL AND ord IS NOT NULL").filter(F.col("kind").isin(CALL, RESULT)).select("session", "ord", "kind", "id")
    log = scratch.written(log, "tools")
    named = scratch.written(by_id(log.filter("id IS NOT NULL")), "pairs")
    marks = named.select("session", F.col("call").alias("ord"), F.lit(1).alias("step")).union(named.select("session", F.col("result").alias("ord"), F.lit(-1).alias("step")))
    loose = log.filter((F.col("kind") == RESULT) & F.col("id").isNull()).select("session", "ord", F.lit(0).alias("step"))
    inside = F.sum("step").over(Window.partitionBy("session").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    torn = marks.union(loose).withColumn("inside", inside).filter("step = 0 AND inside > 0").select("session").distinct()
    torn = scratch.written(torn, "torn")
    calm = lambda d: d.join(torn, "session", "left_anti")
    taken = named.select("session", F.col("call").alias("ord"))
    rest = log.filter((F.col("kind") == CALL) | F.col("id").isNull()).join(taken, ["session", "ord"], "left_anti")
    return calm(named).unionByName(by_height(calm(rest))).unionByName(folded(log.join(torn, "session", "left_semi")))


def sample_log(events: DataFrame) -> DataFrame:
    """Events as a log of tools: two types are results; every user of three names ids, every other third names some."""
    result = F.col("event_type").isin("click", "error")
    name = F.concat(F.lit("t"), (F.col("event_id") % 7).cast("string"))
    named = (F.col("user_id") % 3 == 0) | ((F.col("user_id") % 3 == 1) & (F.col("event_id") % 4 < 2))
    return events.select(F.col("user_id").alias("session"), F.col("event_id").alias("ord"), F.when(result, RESULT).otherwise(CALL).alias("kind"), F.when(named, name).alias("id"))


QUERIES = {"tool_pairing": lambda s, d: paired(sample_log(table(s, d, "events")))}
SQL = {
    "tool_pairing": """WITH RECURSIVE e AS (SELECT user_id AS session, event_id AS ord, event_type IN ('click', 'error') AS is_result,
        CASE WHEN user_id % 3 = 0 OR user_id % 3 = 1 AND event_id % 4 < 2 THEN 't' || (event_id % 7) END AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
      r AS (SELECT DISTINCT session, 0 AS n, CAST([] AS STRUCT(o BIGINT, i VARCHAR)[]) AS held, CAST(NULL AS STRUCT(o BIGINT, i VARCHAR)) AS hit, CAST(NULL AS BIGINT) AS spot, CAST(NULL AS VARCHAR) AS how FROM e
        UNION ALL SELECT session, n, CASE WHEN NOT is_result THEN list_append(held, {'o': ord, 'i': id}) WHEN found IS NULL THEN held ELSE list_filter(held, lambda x: x.o <> found.o) END, found, ord, CASE WHEN id IS NULL THEN 'stack' ELSE 'id' END
        FROM (SELECT r.session, e.n, r.held, e.is_result, e.ord, e.id, CASE WHEN NOT e.is_result THEN NULL WHEN e.id IS NULL THEN r.held[len(r.held)] ELSE list_filter(r.held, lambda x: x.i = e.id)[1] END AS found
          FROM r JOIN e ON e.session = r.session AND e.n = r.n + 1))
      SELECT session, hit.o AS "call", spot AS result, how AS "by" FROM r WHERE hit IS NOT NULL""",
}
