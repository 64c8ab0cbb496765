"""Admission of what a session proposes: gates of quality and feedback, a budget of new notes for each run, and what a
corrected source supersedes. The result is a plan table; nothing is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.sources import scratch
from lorewell.sources.tables import table

# What is too little to keep (characters; after bad feedback), how alike known knowledge is, where an action's
# notes live, and when feedback makes a gate strict or shuts it.
LEAST_CHARS, STRICT_CHARS, ALIKE = 35, 120, 0.76
BANAL = r"(?i)^(ok|done|erledigt|weiter|keine|nichts|test)$"
FOLDERS = {"save_answer": "Knowledge/Answers/", "flag_knowledge_gap": "Knowledge/Gaps/", "save_insight": "Knowledge/Insights/"}
STRICT_AT, SHUT_AT = 2, 3


def gates(feedback: DataFrame) -> DataFrame:
    """action, strict, shut, usefulness from feedback (action, outcome): strict from two rejections if they are more than the
    acceptances, shut from three without any acceptance."""
    yes, no = F.count_if(F.col("outcome") == "accepted"), F.count_if(F.col("outcome") == "rejected")
    g = feedback.groupBy("action").agg(yes.alias("yes"), no.alias("no"))
    return g.select("action", ((F.col("no") >= STRICT_AT) & (F.col("no") > F.col("yes"))).alias("strict"), ((F.col("no") >= SHUT_AT) & (F.col("yes") == 0)).alias("shut"), F.coalesce(F.try_divide("yes", F.col("yes") + F.col("no")), F.lit(1.0)).alias("usefulness"))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s-]", " "), r"\s+"), lambda w: F.length(w) >= 4))


def alike(left: DataFrame, right: DataFrame, least: float = ALIKE) -> DataFrame:
    """Keys of left (key, scope, words) for which some row of right (scope, words) of the same scope shares that part of the larger
    set. Sets that do share it have sizes that near and meet in the prefix of their rarest words. Equal sets are one, and words
    follow to pairs that can be alike only."""
    keyed = lambda d: d.filter(F.size("words") > 0).select("*", F.array_sort("words").alias("sorted")).withColumn("id", F.xxhash64("scope", "sorted"))
    own = scratch.written(keyed(left.select("key", "scope", "words")).select("key", "id", "scope", "sorted"), "alike")
    sides = [scratch.written(d.select("id", "scope", "sorted", F.size("sorted").alias("n")).dropDuplicates(["id"]), "sets") for d in (own, keyed(right.select("scope", "words")))]
    df = sides[1].select("scope", F.explode("sorted").alias("w")).groupBy("scope", "w").agg(F.count("*").alias("df"))
    prefixes = []
    for d in sides:
        place = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(0)), "w"))
        p = d.select("id", "scope", "n", F.explode("sorted").alias("w")).join(df, ["scope", "w"], "left").withColumn("place", place)
        prefixes.append(p.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("id", "scope", "w", "n", "place"))
    x, y = prefixes[0], prefixes[1].toDF("other", "scope", "w", "m", "at")
    larger = F.greatest("n", "m")
    # where sets first meet, what is left of the shorter rest bounds what they share
    met = x.join(y, ["scope", "w"]).filter((F.col("n") >= least * F.col("m")) & (F.col("m") >= least * F.col("n")) & ((1 + F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at"))) / larger >= least))
    met = met.select("id", "other").distinct().join(sides[0].select("id", "n", F.col("sorted").alias("a")), "id").join(sides[1].select(F.col("id").alias("other"), F.col("n").alias("m"), F.col("sorted").alias("b")), "other")
    near = met.filter(F.size(F.array_intersect("a", "b")) / larger >= least).select("id").distinct()
    return own.join(near, "id", "left_semi").select("key").distinct()


def gap_title(title: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(title, r"(?i)^#*\s*(wissenslücke|wissensluecke)\s*:\s*", ""), r"[?!.]+$", "")
    return F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " "))


def gated(items: DataFrame, known: DataFrame, feedback: DataFrame) -> DataFrame:
    """items (run, place, action, title, content, notes) with passes and reason: shut by feedback, too short or banal, known
    already, else passed. known: path, title, content, quelle, status of active notes. A gap is known by the title of an open
    gap, other knowledge by its source or by likeness; an action without a folder of its own counts as an insight."""
    folder = F.coalesce(F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv])[F.col("action")], F.lit(FOLDERS["save_insight"]))
    i = items.withColumn("scope", folder).withColumn("key", F.xxhash64("run", "place"))
    i = scratch.written(i.join(F.broadcast(gates(feedback)), "action", "left"), "items")  # a row an action
    where = F.coalesce(*[F.when(F.col("path").startswith(f), f) for f in FOLDERS.values()])
    k = known.withColumn("scope", where).filter("scope IS NOT NULL")
    both = lambda: F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    gap = F.col("action") == "flag_knowledge_gap"
    similar = alike(i.filter(~gap).select("key", "scope", words(both()).alias("words")), k.select("scope", words(both()).alias("words")))
    named = i.filter(~gap).join(k.filter("quelle IS NOT NULL").select("scope", F.col("quelle").alias("title")).distinct(), ["scope", "title"], "left_semi").select("key")
    open_gaps = k.filter((F.col("scope") == FOLDERS["flag_knowledge_gap"]) & (F.coalesce("status", F.lit("")) != "resolved")).select(gap_title(F.col("title")).alias("g")).filter("g != ''").distinct()
    asked = i.filter(gap).withColumn("g", gap_title(F.col("title"))).join(open_gaps, "g", "left_semi").select("key")
    twin = similar.union(named).union(asked).distinct().withColumn("twin", F.lit(True))
    text = F.trim(F.coalesce("content", F.lit("")))
    least = F.when(F.coalesce("strict", F.lit(False)), STRICT_CHARS).otherwise(LEAST_CHARS)
    short = F.regexp_like(text, F.lit(BANAL)) | (F.length(text) < least)
    reason = F.when(F.coalesce("shut", F.lit(False)), "shut by feedback").when(short, "too short").when(F.coalesce("twin", F.lit(False)), "known already").otherwise("passed")
    out = i.join(twin, "key", "left").withColumn("reason", reason)
    return out.select("run", "place", "action", "title", F.coalesce("notes", F.lit(0)).alias("notes"), (F.col("reason") == "passed").alias("passes"), "reason")


def admitted(items: DataFrame, budget: int) -> DataFrame:
    """run and place of the items (run, place, notes) that a budget of new notes for each run admits, in order: one that would go
    beyond it is left out, later ones may still fit. Items without new notes always do. A pass admits, for all runs at once,
    what fits by running sums up to the first that does not, so there are at most budget + 1 passes."""
    spark = items.sparkSession
    free = items.filter("notes <= 0").select("run", "place")
    left = scratch.written(items.filter((F.col("notes") > 0) & (F.col("notes") <= budget)).select("run", "place", "notes").withColumn("rest", F.lit(budget)), "left")
    out = free
    for _ in range(budget + 1):
        total = F.sum("notes").over(Window.partitionBy("run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
        t = left.withColumn("total", total).withColumn("fits", F.col("total") <= F.col("rest"))
        out = out.union(t.filter("fits").select("run", "place"))
        state = t.groupBy("run").agg(F.max(F.when(F.col("fits"), F.col("total")).otherwise(0)).alias("taken"))
        left = t.filter("NOT fits").join(state, "run").withColumn("rest", F.col("rest") - F.col("taken")).filter(F.col("notes") <= F.col("rest")).select("run", "place", "notes", "rest")
        left = scratch.written(left, "left")
        if left.isEmpty():
            break
    return out


def admission_plan(items: DataFrame, sources: DataFrame, manifest: DataFrame, known: DataFrame, feedback: DataFrame, budget: int = 20) -> DataFrame:
    """run, place, action, title, decision (admit, skip, archive, unchanged), reason. sources: run, hash; manifest: run, hash,
    archived, artifacts. A source whose hash the manifest has is unchanged and proposes nothing; one that changed first
    archives what its last run made (place: null)."""
    m = sources.join(manifest.filter("NOT archived").select("run", F.col("hash").alias("before"), "artifacts"), "run", "left")
    m = scratch.written(m.withColumn("same", F.coalesce(F.col("hash") == F.col("before"), F.lit(False))), "runs")
    row = lambda d, *cols: d.select("run", *cols)
    null = F.lit(None).cast("long")
    same = row(m.filter("same"), null.alias("place"), F.lit("manifest").alias("action"), F.lit(None).cast("string").alias("title"), F.lit("unchanged").alias("decision"), F.lit("same hash").alias("reason"))
    old = m.filter("NOT same AND before IS NOT NULL").select("run", F.explode(F.array_distinct("artifacts")).alias("title"))
    old = row(old, null.alias("place"), F.lit("archive").alias("action"), "title", F.lit("archive").alias("decision"), F.lit("superseded").alias("reason"))
    g = scratch.written(gated(items.join(m.filter("NOT same").select("run"), "run", "left_semi"), known, feedback), "gated")
    ok = admitted(g.filter("passes"), budget).withColumn("ok", F.lit(True))
    judged = g.join(ok, ["run", "place"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    judged = row(judged, F.col("place").cast("long").alias("place"), "action", "title", F.when(F.col("ok"), "admit").otherwise("skip").alias("decision"), F.when(F.col("passes") & ~F.col("ok"), "budget").otherwise(F.col("reason")).alias("reason"))
    return judged.unionByName(same).unionByName(old)


BUDGET = 6


def _plan(s: SparkSession, d: str) -> DataFrame:
    """Lines of every seventh document as proposals, those of every fifth as what is known."""
    docs = table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("doc_id")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "content"))
    action = F.get(F.array(*[F.lit(a) for a in FOLDERS]), ((F.col("place") + k) % 3).cast("int"))
    items = lines.filter(k % 7 == 0).select(k.alias("run"), "place", action.alias("action"), F.substring("content", 1, 30).alias("title"), "content", (F.col("place") % 4).alias("notes"))
    known = lines.filter((k % 5 == 0) & (k % 7 != 0)).select(F.concat(F.get(F.array(*[F.lit(f) for f in FOLDERS.values()]), (F.col("place") % 3).cast("int")), k.cast("string"), F.lit("-"), F.col("place").cast("string")).alias("path"), F.substring("content", 1, 30).alias("title"), "content", F.when(k % 10 == 0, F.substring("content", 1, 30)).alias("quelle"), F.when(k % 15 == 0, "resolved").alias("status"))
    sources = docs.filter(k % 7 == 0).select(k.alias("run"), F.sha2("text", 256).alias("hash"))
    manifest = docs.filter((k % 7 == 0) & (k % 3 != 2)).select(k.alias("run"), F.when(k % 3 == 0, F.sha2("text", 256)).otherwise("old").alias("hash"), (k % 2 == 1).alias("archived"), F.array(F.concat(F.lit("Knowledge/Insights/"), k.cast("string"), F.lit(".md")), F.lit("Knowledge/Gaps/x.md")).alias("artifacts"))
    labels = table(s, d, "labels")
    feedback = labels.select(F.when(F.col("doc_id") % 3 == 0, "save_insight").otherwise("save_answer").alias("action"), F.when(F.col("doc_id") % 2 == F.col("doc_id") % 3 % 2, "accepted").otherwise("rejected").alias("outcome"))
    return admission_plan(items, sources, manifest, known, feedback, BUDGET)


QUERIES = {"admission_plan": _plan}
_WORDS = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 4))"
_GAP = "trim(regexp_replace(lower(regexp_replace({0}, '[?!.]+$', '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_ACTIONS, _PLACES = "[" + ", ".join(f"'{a}'" for a in FOLDERS) + "]", "[" + ", ".join(f"'{f}'" for f in FOLDERS.values()) + "]"
SQL = {
    "admission_plan": f"""WITH RECURSIVE l AS (SELECT doc_id AS run, unnest(range(0, len(x))) AS place, unnest(x) AS content FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
      src AS (SELECT doc_id AS run, doc_id % 3 = 0 AND doc_id % 2 = 0 AS same, doc_id % 3 = 1 AND doc_id % 2 = 0 AS changed FROM documents WHERE doc_id % 7 = 0),
      i AS MATERIALIZED (SELECT run, place, ({_ACTIONS})[(place + run) % 3 + 1] AS action, ({_PLACES})[(place + run) % 3 + 1] AS scope, substr(content, 1, 30) AS title, content, place % 4 AS notes, {_WORDS.format("substr(content, 1, 30) || chr(10) || content")} AS w FROM l JOIN src USING (run) WHERE NOT same),
      k AS MATERIALIZED (SELECT ({_PLACES})[place % 3 + 1] AS scope, substr(content, 1, 30) AS title, CASE WHEN run % 10 = 0 THEN substr(content, 1, 30) END AS quelle, run % 15 = 0 AS resolved, {_WORDS.format("substr(content, 1, 30) || chr(10) || content")} AS w FROM l WHERE run % 5 = 0 AND run % 7 <> 0),
      f AS (SELECT action, count(*) FILTER (ok) AS yes, count(*) FILTER (NOT ok) AS no FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'save_insight' ELSE 'save_answer' END AS action, doc_id % 2 = doc_id % 3 % 2 AS ok FROM labels) GROUP BY 1),
      twins AS (SELECT DISTINCT run, place FROM i JOIN k USING (scope) WHERE action <> 'flag_knowledge_gap' AND (k.quelle = i.title OR len(i.w) > 0 AND len(k.w) > 0 AND len(list_intersect(i.w, k.w)) / greatest(len(i.w), len(k.w)) >= {ALIKE})
        OR action = 'flag_knowledge_gap' AND NOT resolved AND {_GAP.format("i.title")} = {_GAP.format("k.title")} AND {_GAP.format("i.title")} <> ''),
      g AS MATERIALIZED (SELECT i.*, CASE WHEN no >= 3 AND yes = 0 THEN 'shut by feedback' WHEN regexp_matches(trim(content), '{BANAL}') OR length(trim(content)) < CASE WHEN no >= 2 AND no > yes THEN {STRICT_CHARS} ELSE {LEAST_CHARS} END THEN 'too short'
        WHEN (i.run, i.place) IN (SELECT (run, place) FROM twins) THEN 'known already' ELSE 'passed' END AS reason FROM i LEFT JOIN f USING (action)),
      o AS MATERIALIZED (SELECT run, place, notes, row_number() OVER (PARTITION BY run ORDER BY place) AS n FROM g WHERE reason = 'passed' AND notes > 0),
      b AS (SELECT DISTINCT run, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS place, false AS ok FROM o UNION ALL SELECT o.run, o.n, CASE WHEN used + notes <= {BUDGET} THEN used + notes ELSE used END, o.place, used + notes <= {BUDGET} FROM b JOIN o ON o.run = b.run AND o.n = b.n + 1)
      SELECT g.run, g.place, action, title, CASE WHEN reason = 'passed' AND (notes <= 0 OR b.ok) THEN 'admit' ELSE 'skip' END AS decision, CASE WHEN reason = 'passed' AND notes > 0 AND NOT b.ok THEN 'budget' ELSE reason END AS reason FROM g LEFT JOIN b ON b.run = g.run AND b.place = g.place AND b.n > 0
      UNION ALL SELECT run, NULL, 'manifest', NULL, 'unchanged', 'same hash' FROM src WHERE same
      UNION ALL SELECT run, NULL, 'archive', unnest(['Knowledge/Insights/' || run || '.md', 'Knowledge/Gaps/x.md']), 'archive', 'superseded' FROM src WHERE changed""",
}
