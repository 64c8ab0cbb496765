"""Transcripts: phases, digests, intents, categories, claims, evidence and salience selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.sources import scratch
from lorewell.sources.tables import NOTES_SQL, dealt, notes, table


def phases(turns: DataFrame) -> DataFrame:
    """A user's message begins a phase; what follows belongs to it. conv_id, phase, turns, first and last turn."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    p = turns.withColumn("phase", F.sum((F.col("role") == "user").cast("long")).over(w))
    return p.groupBy("conv_id", "phase").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"))


def digest(turns: DataFrame, users: int = 3, assistants: int = 2) -> DataFrame:
    """Counts by role, and of each conversation the last user texts of more than 12 characters (240 of each, white space folded)
    and the last assistant texts of more than 50 (700 of each)."""
    said = F.trim("text")
    told = F.when(F.col("role") == "user", F.length(said) > 12).when(F.col("role") == "assistant", F.length(said) > 50).otherwise(False)
    t = turns.withColumn("told", F.coalesce(told, F.lit(False)))
    t = t.withColumn("back", F.row_number().over(Window.partitionBy("conv_id", "role", "told").orderBy(F.desc("turn"))))
    last = lambda role, n, chars: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("role") == role) & F.col("told") & (F.col("back") <= n), F.struct("turn", F.substring(F.regexp_replace(said, r"\s+", " "), 1, chars).alias("text"))))), lambda x: x["text"]), "|")
    return t.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), last("user", users, 240).alias("requests"), last("assistant", assistants, 700).alias("results"))


#: A word boundary that knows ASCII words only, as the rules' own engine does.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def matches(text: Column | str, pattern: str) -> Column:
    return F.regexp_like(text, F.lit("(?iu)" + pattern.replace(r"\b", EDGE)))


#: Intent, points, pattern (case-insensitive, whole words).
INTENTS = (
    ("implementation", 3, "umgesetzt|eingerichtet|konfiguriert|aktiviert|deploy|deployed|restart|reload|angewendet|applied|installed"),
    ("troubleshooting", 4, "fe(h|hl)er|error|failed|fix|workaround|gel(ö|oe)st|debug|troubleshoot|incident|root cause"),
    ("research", 4, "recherche|befund|prüf|pruef|analys|lookup|dig|whois|nslookup|read-only|herausfinden|nachschauen"),
    ("planning", 4, "plan|planung|entscheidung|entscheiden|festlegen|auswahl|abwägung|abwaegung|wartungsfenster|nächste schritte|naechste schritte|todo|soll|muss noch|offen|roadmap|konzept"),
    ("documentation", 3, "dokumentiert|notiz|readme|doku|beschreibung|zusammenfassung|runbook"),
    ("meeting", 5, "meeting|besprechung|protokoll|teilnehmer|agenda|termin|abstimmung"),
)
#: Rules of the same kind for the invented prose of the driver's tables.
SAMPLE_INTENTS = (("implementation", 3, "the|der"), ("troubleshooting", 4, "reth|sch"), ("research", 4, "que|oi"), ("planning", 4, "los|nder"), ("documentation", 3, "and|und"), ("meeting", 5, "hand|einer"))


def intents(texts: DataFrame, rules=INTENTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The intent of the most points, the first of the list on ties; unknown without any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    points = [F.when(F.regexp_like(low, F.lit(rf"(?<![A-Za-z0-9_])({p})(?![A-Za-z0-9_])")), n).otherwise(0) for _, n, p in rules]
    ranked = F.array_sort(F.array(*[F.struct((-x).alias("s"), F.lit(i).alias("i"), F.lit(r[0]).alias("intent")) for i, (r, x) in enumerate(zip(rules, points, strict=True))]))
    best, second = ranked[0], ranked[1]
    t = texts.select(key, best.alias("b"), (-second["s"]).alias("second")).withColumn("score", -F.col("b.s"))
    sure = F.when((F.col("score") >= 7) & (F.col("score") - F.col("second") >= 3), "high").when(F.col("score") >= 4, "medium").otherwise("low")
    return t.select(key, F.when(F.col("score") > 0, F.col("b.intent")).otherwise("unknown").alias("intent"), F.col("score").cast("long"), F.when(F.col("score") > 0, sure).otherwise("low").alias("confidence"))


#: name, keywords, filename hints, priority: a taxonomy for the invented prose.
CATEGORIES = (("Alpha", "en the and of ing".split(), "the an".split(), 3), ("Beta", "fr que la de le".split(), "que le".split(), 2), ("Gamma", "de der die und sch".split(), "sch der".split(), 1))


def categories(n: DataFrame, rules=CATEGORIES) -> DataFrame:
    """Tags 10 a hit, title hints 25 a hit, content keywords 2 each from three on, a tenth of the priority; at least 5."""
    low_title, low_body = F.lower("title"), F.lower("content")
    tags = F.transform("tags", lambda t: F.lower(t))
    found = []
    for i, (name, keywords, hints, priority) in enumerate(rules):
        hits = sum((F.when(F.contains(low_body, F.lit(k)), 1).otherwise(0) for k in keywords), F.lit(0))
        tagged = F.size(F.array_intersect(F.array(*[F.lit(k) for k in keywords]), F.array_union(tags, F.transform(tags, lambda t: F.split_part(t, F.lit("/"), F.lit(1))))))
        score = tagged * 10 + sum((F.when(F.contains(low_title, F.lit(h)), 25).otherwise(0) for h in hints), F.lit(0)) + F.when(hits >= 3, hits * 2).otherwise(0)
        found.append(F.when(score >= 5, F.struct((score + priority * 0.1).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("category"))))
    best = F.array_max(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return n.select("rel_path", best.alias("b")).select("rel_path", F.col("b.category").alias("category"), F.round("b.score", 1).alias("score"))


#: Modal verbs of a claim, what speaks to or of the writer instead of stating, instructions, and terms that are
#: too general to be shared. Sample words stand in for modal verbs and negations in the invented prose.
MODALS = "muss|soll|sollte|ist|sind|wird|werden|braucht|benötigt|benoetigt|should|must|needs|required|requires"
CHAT = (
    r"^(ich|du|wir)\b", r"^(ok|okay|alles klar|verstanden|nicht ganz|hier|sag|sobald|wenn|bitte|alternativ|kopier|kopiere|führe|fuehre|prüfe|pruefe|was ich von dir brauche|was du jetzt|soll ich)\b",
    r"^(zwei|drei|mehrere)\s+hinweise\s+sind\s+wichtig:?$", r"\b(das ist der entscheidende hinweis|entscheidende hinweis)\b", r"\b(sag bescheid|ich warte|ich melde mich|willst du|kannst du|soll ich|zum selber-ausführen|zum selber-ausfuehren)\b",
    r"^[-*]?\s*(docker|compose|pull|admin|jwt_secret|db_password)\s*:",
)
INSTRUCTIONS = (
    r"^`[^`]+`\s+(braucht|benötigt|benoetigt|ist|soll|muss)\b", r"\b(sudo|openvpn|ping|curl|nmap|smbclient|journalctl|systemctl|docker|kubectl)\b.*\b(--?[a-z0-9-]+|/tmp/|dev/tcp)\b", r"^(der|die|das)\s+befehl\b",
)
GENERAL_TERMS = ("sollte", "werden", "braucht", "required", "requires")
SAMPLE_MODALS, SAMPLE_NEGATIONS = "is|ist|est|es", "not|nicht|la|for"


def claims(docs: DataFrame, modals: str = MODALS, key: str = "doc_id") -> DataFrame:
    """Distinct sentences of 25 to 260 characters that state something: a modal verb, no question, no chat, no instruction."""
    parts = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?s)```.*?```", " "), r"\n|(?<=[.!?])\s+")
    line = F.trim(F.regexp_replace(F.col("line"), r"^[-*#\s>\d.]+", ""))
    s = docs.select(key, F.explode(parts).alias("line")).select(key, line.alias("claim")).filter((F.length("claim") >= 25) & (F.length("claim") <= 260))
    s = s.filter(matches("claim", rf"\b({modals})\b") & ~F.col("claim").endswith("?"))
    for pattern in (*CHAT, *INSTRUCTIONS):
        s = s.filter(~matches("claim", pattern))
    return s.distinct()


def normal_claim(claim: Column) -> Column:
    """What two spellings of one claim have in common: lower case without accents and marks."""
    bare = claim
    for accented, plain in (("àáâãäå", "a"), ("èéêë", "e"), ("ìíîï", "i"), ("òóôõö", "o"), ("ùúûü", "u"), ("ñ", "n"), ("ç", "c"), ("ýÿ", "y")):
        bare = F.translate(F.lower(bare), accented, plain * len(accented))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[`*_~>#\[\]().,:;!?/\\|-]+", " "), r"\s+", " "))


def new_claims(found: DataFrame, known: DataFrame, key: str = "doc_id", most: int = 20) -> DataFrame:
    """The first `most` claims of each source, in order of text, that are neither known (key: normal form) nor said before there."""
    c = found.withColumn("norm", normal_claim(F.col("claim"))).filter("norm != ''").join(known.select(F.col("key").alias("norm")).distinct(), "norm", "left_anti")
    first = F.row_number().over(Window.partitionBy(key, "norm").orderBy("claim"))
    c = c.withColumn("r", first).filter("r = 1").withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("claim")))
    return c.filter(F.col("r") <= most).select(key, "claim", "norm")


def contradictions(c: DataFrame, negations: str = "nicht|kein|keine|never|not|no", key: str = "doc_id", most: int = 5) -> DataFrame:
    """Pairs of claims of different documents that share two important terms and differ in negation; of each claim the
    first `most` partners. A claim's terms are its first ten; those of a partner count as often as it has them.
    Claims meet by pairs of terms (and a term that a partner repeats by itself), as places without texts: a claim is its
    document and its number there. Pairs of one side only go first; of each other one the partners that can be among the
    first are kept: 2 * `most` claims, of one document `most`. Texts come back to the partners that are left."""
    low = F.split(F.regexp_replace(F.lower("claim"), r"[^\p{L}\p{N}\s-]", " "), r"\s+")
    listed = F.slice(F.filter(low, lambda w: (F.length(w) >= 5) & ~w.isin(*GENERAL_TERMS)), 1, 10)
    negated = matches("claim", rf"\b({negations})\b")
    number = F.row_number().over(Window.partitionBy(key).orderBy("claim"))
    t = c.select(key, "claim").filter(F.col(key).isNotNull() & F.col("claim").isNotNull()).distinct().select(F.col(key).alias("id"), "claim", number.alias("r"))
    t = scratch.written(t.select("*", negated.alias("neg"), listed.alias("listed"), F.array_distinct(listed).alias("terms")), "claims")
    pair = lambda a, b, partner: F.struct(F.xxhash64(a, b).alias("h"), F.hash(a, b).alias("g"), partner.alias("partner"))  # 96 bits
    repeats = lambda a: F.size(F.filter("listed", lambda b: a == b)) > 1
    own = F.flatten(F.transform("terms", lambda a: F.transform(F.filter("terms", lambda b: a <= b), lambda b: pair(a, b, (a != b) | repeats(a)))))
    x = t.select("id", "r", "neg", F.inline(own))
    met = [F.max(on) for on in (F.col("neg"), ~F.col("neg"), F.col("partner") & ~F.col("neg"), F.col("partner") & F.col("neg"))]
    sides = x.groupBy("h", "g").agg(*[m.alias(f"m{i}") for i, m in enumerate(met)]).filter("m0 AND m2 OR m1 AND m3").select("h", "g")
    x = scratch.written(x.join(scratch.written(sides, "pairs"), ["h", "g"], "left_semi"), "places")
    # a partner of the claims that are not as it is
    p = x.filter("partner").select("h", "g", (~F.col("neg")).alias("neg"), "id", "r")
    by = Window.partitionBy("h", "g", "neg")
    p = p.withColumn("n", F.dense_rank().over(by.orderBy("id"))).filter(F.col("n") <= most + 1)
    p = p.withColumn("n", F.row_number().over(Window.partitionBy("h", "g", "neg", "id").orderBy("r"))).filter(F.col("n") <= most)
    p = p.withColumn("n", F.row_number().over(by.orderBy("id", "r"))).filter(F.col("n") <= 2 * most)
    p = scratch.written(p.groupBy("h", "g", "neg").agg(F.array_sort(F.collect_list(F.struct("id", "r"))).alias("first")), "partners")
    found = x.join(p, ["h", "g", "neg"]).select("id", "r", F.slice(F.filter("first", lambda o: o["id"] != F.col("id")), 1, most).alias("first"))
    found = found.groupBy("id", "r").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("first")))), 1, most).alias("first"))
    found = t.select("id", "r", "claim", "terms").join(found, ["id", "r"]).select("id", "claim", "terms", F.inline(F.transform("first", lambda o: F.struct(o["id"].alias("other_id"), o["r"].alias("other_r")))))
    other = t.select(F.col("id").alias("other_id"), F.col("r").alias("other_r"), F.col("claim").alias("other"), F.col("listed").alias("other_listed"))
    shared = F.size(F.filter("other_listed", lambda b: F.array_contains("terms", b))).cast("long")
    return found.join(other, ["other_id", "other_r"]).select(F.col("id").alias(key), "claim", "other_id", "other", shared.alias("shared"))


#: Fixed values of the evidence score: strength of a source, and what independent units and further sources add.
STRENGTHS = {"assistant_summary": 0.36, "error_fix": 0.44, "phase": 0.5, "bash_pair": 0.88}
PER_UNIT, MOST_UNITS, PER_SOURCE, MOST_SOURCES, CONFLICT_CEILING = 0.04, 0.12, 0.04, 0.08, 44


def evidence_scores(items: DataFrame) -> DataFrame:
    """fact_id, units, score of evidence items (fact_id, source, hash, origin). Items that share a hash or an origin, also
    through others, are one unit; its strongest item counts. Units are found by taking the smallest item over shared
    hashes and origins until nothing changes. A fact with an item in conflict (column conflict, if there is one) has
    CONFLICT_CEILING points at most."""
    from lorewell.operators.components import components

    keyed = items.withColumn("item", F.xxhash64("fact_id", "source", "hash", F.coalesce("origin", F.lit("")))).dropDuplicates(["item"])
    by_hash = keyed.select("item", F.xxhash64("fact_id", F.lit("h"), "hash").alias("key"))
    by_origin = keyed.filter("origin IS NOT NULL AND origin != ''").select("item", F.xxhash64("fact_id", F.lit("o"), "origin").alias("key"))
    keys = by_hash.union(by_origin)
    links = keys.groupBy("key").agg(F.min("item").alias("a")).join(keys, "key").filter("a != item").select("a", F.col("item").alias("b"))
    unit = components(links)
    strength = F.create_map(*[F.lit(x) for kv in STRENGTHS.items() for x in kv])[F.col("source")]
    u = keyed.join(unit, keyed["item"] == unit["_id"], "left").withColumn("unit", F.coalesce("component", "item"))
    best = u.groupBy("fact_id", "unit").agg(F.max_by("source", F.struct(strength, "source")).alias("source"), F.max(strength).alias("s"))
    f = best.groupBy("fact_id").agg(F.count("*").alias("units"), F.countDistinct("source").alias("sources"), F.max("s").alias("top"))
    more = F.least(F.lit(MOST_UNITS), (F.col("units") - 1) * PER_UNIT) + F.least(F.lit(MOST_SOURCES), (F.col("sources") - 1) * PER_SOURCE)
    score = F.round(F.least(F.lit(1.0), F.col("top") + more) * 100).cast("long")
    if "conflict" in items.columns:
        torn = items.groupBy("fact_id").agg(F.max(F.coalesce("conflict", F.lit(False))).alias("torn"))
        f, score = f.join(torn, "fact_id"), F.when(F.col("torn"), F.least(score, F.lit(CONFLICT_CEILING))).otherwise(score)
    return f.select("fact_id", "units", score.cast("long").alias("score")).withColumn("confidence", confidence_of(F.col("score")))


def confidence_of(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 45, "medium").otherwise("low")


def sample_evidence(turns: DataFrame) -> DataFrame:
    kind = F.when(F.col("role") == "user", "phase").when(F.col("turn") % 4 == 1, "error_fix").when(F.col("turn") % 4 == 3, "bash_pair").otherwise("assistant_summary")
    origin = F.when(F.col("turn") % 3 == 0, "o").when(F.col("turn") % 5 == 1, "p")
    return turns.select(F.col("conv_id").alias("fact_id"), kind.alias("source"), F.sha2("text", 256).alias("hash"), origin.alias("origin"), (F.col("conv_id") % 5 == 2).alias("conflict"))


def capture_scores(facts: DataFrame) -> DataFrame:
    """capture value, runbook readiness and review need of each session's facts (session, kind, salience, evidence)."""
    kind, salience, evidence = F.col("kind"), F.col("salience"), F.col("evidence")
    g = facts.groupBy("session").agg(
        F.max("salience").alias("top"), F.avg("salience").alias("mean"), F.count_if((kind == "change") & (evidence >= 75)).alias("changes"), F.count_if((kind == "verification") & (evidence >= 75)).alias("checks"),
        F.count_if((kind == "cause") & (evidence >= 45)).alias("causes"), F.count_if((salience >= 60) & (evidence < 45)).alias("weak"), F.count_if((salience >= 60) & (evidence >= 45) & (evidence < 75)).alias("medium"), F.count_if(kind == "open_question").alias("questions"),
    )
    ready = F.when(F.col("changes") > 0, 45).otherwise(0) + F.when(F.col("checks") > 0, 35).otherwise(0) + F.when(F.col("causes") > 0, 10).otherwise(0)
    ready = F.when((F.col("changes") == 0) | (F.col("checks") == 0), F.least(ready, F.lit(55))).otherwise(ready)
    need = 5 + F.when(F.col("weak") > 0, F.least(F.lit(50), 20 + F.col("weak") * 10)).otherwise(0) + F.least(F.lit(20), F.col("medium") * 5) + F.least(F.lit(20), F.col("questions") * 8)
    return g.select("session", F.least(F.lit(100), F.round(F.col("top") * 0.65 + F.col("mean") * 0.35)).cast("long").alias("capture_value"), ready.cast("long").alias("readiness"), F.least(F.lit(100), need).cast("long").alias("review_need"))


KINDS = ("cause", "decision", "change", "verification", "result", "constraint", "open_question", "context")


def sample_facts(turns: DataFrame) -> DataFrame:
    """Facts from a conversation's assistant turns, with kinds and scores derived from ids and lengths."""
    k = F.col("conv_id") * 31 + F.col("turn")
    kind = F.get(F.array(*[F.lit(x) for x in KINDS]), (k % len(KINDS)).cast("int"))
    return turns.filter("role = 'assistant'").select(F.col("conv_id").alias("session"), F.concat_ws("-", "conv_id", "turn").alias("fact_id"), kind.alias("kind"), F.col("text").alias("statement"), (40 + k * 7 % 60).cast("long").alias("salience"), (30 + k * 11 % 70).cast("long").alias("evidence"))


def seeded_sample(facts: DataFrame, k: int = 6, seed: str = "s1") -> DataFrame:
    """k facts of each session in order of a seeded hash, with inclusion probability and weight."""
    w = Window.partitionBy("session")
    order = F.row_number().over(w.orderBy(F.sha2(F.concat(F.lit(seed), "fact_id"), 256), "fact_id"))
    n = F.count("*").over(w)
    p = F.least(F.lit(k), n) / n
    return facts.select("session", "fact_id", order.alias("r"), F.round(p, 6).alias("probability"), F.round(1 / p, 6).alias("weight")).filter(F.col("r") <= k).drop("r")


conv = lambda s, d: table(s, d, "conversations")
docs = lambda s, d: dealt(s, d, "documents")
QUERIES = {
    "phase_segmentation": lambda s, d: phases(conv(s, d)), "transcript_digest": lambda s, d: digest(conv(s, d)), "intent_classify": lambda s, d: intents(docs(s, d), SAMPLE_INTENTS), "category_classify": lambda s, d: categories(notes(s, d)),
    "claim_candidates": lambda s, d: claims(docs(s, d), SAMPLE_MODALS), "claim_contradictions": lambda s, d: contradictions(claims(docs(s, d), SAMPLE_MODALS), SAMPLE_NEGATIONS), "new_claims": lambda s, d: new_claims(c, c.filter(F.col("doc_id") % 10 == 3).select(normal_claim(F.col("claim")).alias("key"))) if (c := claims(docs(s, d), SAMPLE_MODALS)) is not None else None, "evidence_score": lambda s, d: evidence_scores(sample_evidence(conv(s, d))),
    "capture_scores": lambda s, d: capture_scores(sample_facts(conv(s, d))), "seeded_sample": lambda s, d: seeded_sample(sample_facts(conv(s, d))),
}

INTENT_SQL = "WITH p AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), s AS (SELECT doc_id, unnest([" + ", ".join(f"{{'i': {i}, 'n': '{n}', 's': CASE WHEN regexp_matches(t, '(^|[^A-Za-z0-9_])({p})([^A-Za-z0-9_]|$)') THEN {x} ELSE 0 END}}" for i, (n, x, p) in enumerate(SAMPLE_INTENTS)) + "]) AS v FROM p), r AS (SELECT doc_id, v.n AS n, v.s AS s, row_number() OVER (PARTITION BY doc_id ORDER BY v.s DESC, v.i) AS k FROM s)"
CAT_SQL = ", ".join(
    f"{{'o': {i}, 'c': '{n}', 'p': {p}, 's': 10 * len(list_intersect(tags, {k})) + " + " + ".join(f"CASE WHEN contains(lower(title), '{h}') THEN 25 ELSE 0 END" for h in hs)
    + " + (SELECT CASE WHEN h >= 3 THEN 2 * h ELSE 0 END FROM (SELECT " + " + ".join(f"CASE WHEN contains(lower(content), '{w}') THEN 1 ELSE 0 END" for w in k) + " AS h))}"
    for i, (n, k, hs, p) in enumerate(CATEGORIES)
)
FACTS_SQL = "WITH facts AS (SELECT conv_id AS session, conv_id || '-' || turn AS fact_id, [" + ", ".join(f"'{k}'" for k in KINDS) + f"][(conv_id * 31 + turn) % {len(KINDS)} + 1] AS kind, 40 + (conv_id * 31 + turn) * 7 % 60 AS salience, 30 + (conv_id * 31 + turn) * 11 % 70 AS evidence FROM conversations WHERE role = 'assistant') "
CLAIMS_SQL = "c AS MATERIALIZED (SELECT DISTINCT doc_id, claim FROM (SELECT doc_id, trim(regexp_replace(l, '^[-*#\\s>\\d.]+', ''), ' ') AS claim FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''), '(?s)```.*?```', ' ', 'g'), '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(10), 'g'), '\\n')) AS l FROM documents)) WHERE length(claim) BETWEEN 25 AND 260 AND regexp_matches(claim, '(?i)\\b(" + SAMPLE_MODALS + ")\\b') AND NOT ends_with(claim, '?')" + "".join(f" AND NOT regexp_matches(claim, '(?i){p}')" for p in (*CHAT, *INSTRUCTIONS)) + ")"
NORM_SQL = "trim(regexp_replace(regexp_replace(lower(strip_accents(claim)), '[`*_~>#\\[\\]().,:;!?/\\\\|-]+', ' ', 'g'), '\\s+', ' ', 'g'))"
SQL = {
    "phase_segmentation": "WITH p AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS phase FROM conversations) SELECT conv_id, CAST(phase AS BIGINT) AS phase, count(*) AS turns, min(turn) AS first_turn, max(turn) AS last_turn, CAST(sum(length(text)) AS BIGINT) AS chars FROM p GROUP BY 1, 2",
    "transcript_digest": "WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, told ORDER BY turn DESC) AS back FROM (SELECT *, coalesce(CASE role WHEN 'user' THEN length(trim(text)) > 12 WHEN 'assistant' THEN length(trim(text)) > 50 END, false) AS told, regexp_replace(trim(text), '\\s+', ' ', 'g') AS said FROM conversations)) SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, coalesce(string_agg(substr(said, 1, 240), '|' ORDER BY turn) FILTER (role = 'user' AND told AND back <= 3), '') AS requests, coalesce(string_agg(substr(said, 1, 700), '|' ORDER BY turn) FILTER (role = 'assistant' AND told AND back <= 2), '') AS results FROM t GROUP BY 1",
    "intent_classify": INTENT_SQL + " SELECT a.doc_id, CASE WHEN a.s > 0 THEN a.n ELSE 'unknown' END AS intent, CAST(a.s AS BIGINT) AS score, CASE WHEN a.s >= 7 AND a.s - b.s >= 3 THEN 'high' WHEN a.s >= 4 THEN 'medium' ELSE 'low' END AS confidence FROM r a JOIN r b USING (doc_id) WHERE a.k = 1 AND b.k = 2",
    "category_classify": NOTES_SQL + f", v AS (SELECT rel_path, unnest([{CAT_SQL}]) AS v FROM notes), b AS (SELECT rel_path, v.c AS c, round(v.s + v.p * 0.1, 1) AS s, v.o AS o FROM v WHERE v.s >= 5), w AS (SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY s DESC, o) AS place FROM b) SELECT n.rel_path, c AS category, CAST(s AS DOUBLE) AS score FROM notes n LEFT JOIN w ON w.rel_path = n.rel_path AND place = 1",
    "claim_candidates": "WITH " + CLAIMS_SQL + " SELECT * FROM c",
    "claim_contradictions": "WITH " + CLAIMS_SQL + ", l AS MATERIALIZED (SELECT doc_id, claim, regexp_matches(claim, '(?i)\\b(" + SAMPLE_NEGATIONS + ")\\b') AS neg, list_slice(list_filter(string_split_regex(regexp_replace(lower(claim), '[^\\p{L}\\p{N} \\t-]', ' ', 'g'), '[ \\t]+'), lambda w: length(w) >= 5 AND w NOT IN (" + ", ".join(f"'{w}'" for w in GENERAL_TERMS) + ")), 1, 10) AS listed FROM c), a AS (SELECT doc_id, claim, neg, unnest(list_distinct(listed)) AS term FROM l), b AS (SELECT doc_id, claim, neg, unnest(listed) AS term FROM l), p AS (SELECT a.doc_id, a.claim, b.doc_id AS other_id, b.claim AS other, count(*) AS shared FROM a JOIN b USING (term) WHERE a.doc_id <> b.doc_id AND a.neg <> b.neg GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2) SELECT doc_id, claim, other_id, other, shared FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, claim ORDER BY other_id, other) AS k FROM p) WHERE k <= 5",
    "new_claims": "WITH " + CLAIMS_SQL + ", m AS (SELECT *, " + NORM_SQL + " AS norm FROM c), k AS (SELECT * FROM m WHERE norm <> '' AND norm NOT IN (SELECT norm FROM m WHERE doc_id % 10 = 3)), f AS (SELECT doc_id, norm, min(claim) AS claim FROM k GROUP BY 1, 2) SELECT doc_id, claim, norm FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY claim) AS r FROM f) WHERE r <= 20",
    "evidence_score": """WITH RECURSIVE i AS (SELECT row_number() OVER () AS item, * FROM (SELECT DISTINCT conv_id AS fact_id, CASE WHEN role = 'user' THEN 'phase' WHEN turn % 4 = 1 THEN 'error_fix' WHEN turn % 4 = 3 THEN 'bash_pair' ELSE 'assistant_summary' END AS source, text AS h, CASE WHEN turn % 3 = 0 THEN 'o' WHEN turn % 5 = 1 THEN 'p' END AS origin FROM conversations)),
      reach AS (SELECT item, item AS low, fact_id, h, origin FROM i UNION SELECT i.item, r.low, i.fact_id, i.h, i.origin FROM reach r JOIN i ON i.fact_id = r.fact_id AND (i.h = r.h OR i.origin = r.origin)),
      u AS (SELECT item, min(low) AS unit FROM reach GROUP BY 1), w AS (SELECT fact_id, unit, source, CASE source WHEN 'phase' THEN 0.5 WHEN 'error_fix' THEN 0.44 WHEN 'bash_pair' THEN 0.88 ELSE 0.36 END AS s FROM i JOIN u USING (item)),
      b AS (SELECT fact_id, unit, max(s) AS s FROM w GROUP BY 1, 2), f AS (SELECT fact_id, count(*) AS units, CAST(round(least(1, max(s) + least(0.12, (count(*) - 1) * 0.04) + least(0.08, (count(DISTINCT s) - 1) * 0.04)) * 100) AS BIGINT) AS raw FROM b GROUP BY 1)
      SELECT fact_id, units, score, CASE WHEN score >= 75 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT *, CASE WHEN fact_id % 5 = 2 THEN least(raw, 44) ELSE raw END AS score FROM f)""",
    "capture_scores": FACTS_SQL + ", g AS (SELECT session, max(salience) AS top, avg(salience) AS mean, count(*) FILTER (kind = 'change' AND evidence >= 75) AS ch, count(*) FILTER (kind = 'verification' AND evidence >= 75) AS ve, count(*) FILTER (kind = 'cause' AND evidence >= 45) AS ca, count(*) FILTER (salience >= 60 AND evidence < 45) AS weak, count(*) FILTER (salience >= 60 AND evidence >= 45 AND evidence < 75) AS med, count(*) FILTER (kind = 'open_question') AS q FROM facts GROUP BY 1), r AS (SELECT *, CASE WHEN ch > 0 THEN 45 ELSE 0 END + CASE WHEN ve > 0 THEN 35 ELSE 0 END + CASE WHEN ca > 0 THEN 10 ELSE 0 END AS ready FROM g) SELECT session, CAST(least(100, round(top * CAST(0.65 AS DOUBLE) + mean * CAST(0.35 AS DOUBLE))) AS BIGINT) AS capture_value, CAST(CASE WHEN ch = 0 OR ve = 0 THEN least(ready, 55) ELSE ready END AS BIGINT) AS readiness, CAST(least(100, 5 + CASE WHEN weak > 0 THEN least(50, 20 + weak * 10) ELSE 0 END + least(20, med * 5) + least(20, q * 8)) AS BIGINT) AS review_need FROM r",
    "seeded_sample": FACTS_SQL + "SELECT session, fact_id, round(least(6, n) / n, 6) AS probability, round(n / least(6, n), 6) AS weight FROM (SELECT *, count(*) OVER (PARTITION BY session) AS n, row_number() OVER (PARTITION BY session ORDER BY sha256('s1' || fact_id), fact_id) AS r FROM facts) WHERE r <= 6",
}
