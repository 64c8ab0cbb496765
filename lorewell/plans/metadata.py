"""Plans for frontmatter: what a note's profile asks for, and the fields that captures and claims should carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import markdown as md
from lorewell.operators import notes_overview, reports
from lorewell.operators.notes_overview import PROFILES, normal_tag, profile_of
from lorewell.operators.sessions import INTENTS, intents
from lorewell.sources.tables import AS_OF, NOTES_SQL, notes

#: The status of a profile's notes that lack one.
DEFAULT_STATUS, MOC_STATUS = "aktiv", "moc"


def field(fm: Column, name: str) -> Column:
    """A field's value, also under a name that is to become it; null if empty."""
    other = F.filter(F.map_entries(fm), lambda e: (F.lower(e["key"]) == name) & (e["key"] != name) & ~e["key"].startswith("_"))
    return F.nullif(F.coalesce(F.nullif(F.element_at(fm, F.lit(name)), F.lit("")), F.get(other, F.lit(0))["value"]), F.lit(""))


def frontmatter_fixes(n: DataFrame, profile: str | None = None, aliases: dict[str, str] | None = None, today: str = AS_OF[:10]) -> DataFrame:
    """rel_path, profile, change (rename or set), field, after: what makes frontmatter that its profile accepts. Names become
    lower case where nothing stands there yet; tags become normal, distinct and get the profile's own; a missing status
    (not of daily or archived notes), and dates, customer and source that the profile requires, are filled in."""
    path, fm = F.col("rel_path"), F.col("frontmatter")
    n = n.withColumn("listed", md.listed_tags(fm["tags"])).withColumn("normal", F.array_distinct(F.transform("listed", lambda t: normal_tag(t, aliases))))
    n = n.withColumn("profile", F.lit(profile) if profile else profile_of(path, fm, F.col("normal")))
    of = lambda k: F.create_map(*[x for name, v in PROFILES.items() for x in (F.lit(name), F.array(*[F.lit(y) for y in v[k]]).cast("array<string>"))])[F.col("profile")]
    change = lambda kind, name, value: F.struct(F.lit(kind).alias("change"), (F.lit(name) if isinstance(name, str) else name).alias("field"), value.alias("after"))
    renames = F.transform(F.filter(F.map_keys(fm), lambda k: ~k.startswith("_") & (F.lower(k) != k) & (F.coalesce(F.element_at(fm, F.lower(k)), F.lit("")) == "")), lambda k: change("rename", k, F.lower(k)))
    tags = F.concat("normal", F.filter(of(1), lambda t: ~F.array_contains("normal", t)))
    listed = F.coalesce(fm["tags"], F.lit("")).startswith("[") | (F.size("listed") > 0)
    asks = lambda name: F.array_contains(of(0), name) & field(fm, name).isNull()
    customer = F.nullif(F.regexp_extract(path, "^Kunden/([^/]+)", 1), F.lit(""))
    sets = F.array(
        F.when(~listed | (F.col("listed") != tags), change("set", "tags", F.concat(F.lit("["), F.array_join(tags, ", "), F.lit("]")))),
        F.when(~path.startswith("Archiv/") & (F.col("profile") != "Daily") & field(fm, "status").isNull(), change("set", "status", F.when(F.col("profile") == "MOC", MOC_STATUS).otherwise(DEFAULT_STATUS))),
        *[F.when(asks(d), change("set", d, F.lit(today))) for d in ("datum", "aktualisiert")], F.when(asks("kunde") & customer.isNotNull(), change("set", "kunde", customer)), F.when(asks("quelle"), change("set", "quelle", F.lower("profile"))),
    )
    every = F.concat(renames, F.filter(sets, lambda x: x.isNotNull()))
    return n.select("rel_path", "profile", F.inline(every))


def metadata_backfill(n: DataFrame) -> DataFrame:
    """rel_path, field, after: fields that captures and claims lack, with their values: type, stage, intent and scores of a
    capture (its own intent counts, if it has one), type, stage and status of a claim. What is both is a capture first."""
    fm, path = F.col("frontmatter"), F.col("rel_path")
    n = n.withColumn("capture", reports.is_capture(n)).withColumn("claim", F.array_contains("tags", "claim") | path.startswith("Knowledge/Claims/")).filter("capture OR claim")
    judged = intents(n.filter("capture"), INTENTS, "rel_path", "content").select("rel_path", F.col("intent").alias("told"), F.col("confidence").alias("sure"))
    n = n.join(judged, "rel_path", "left")
    own = F.element_at(fm, F.lit("session_intent"))
    n = n.withColumns({"intent": F.coalesce(own, "told"), "sure": F.when(own.isNotNull(), F.coalesce(F.element_at(fm, F.lit("intent_confidence")), F.lit("low"))).otherwise(F.col("sure"))})
    c = n.filter("capture").select("rel_path", "content", "tags", "intent", F.coalesce(F.element_at(fm, F.lit("client_match_method")), F.lit("none")).alias("method"), F.coalesce(F.expr("try_cast(frontmatter['redactions'] AS INT)"), F.lit(0)).alias("redactions"))
    n = n.join(reports.capture_scores_by_text(c), "rel_path", "left")
    text = lambda name: F.col(name).cast("string")
    capture = {"knowledge_type": F.lit("capture"), "source_stage": F.lit("stop_capture"), "session_intent": F.col("intent"), "intent_confidence": F.col("sure"), "sensitive": F.lit("false"), "redactions": F.lit("0"), "capture_value": text("value"), "runbook_readiness": text("readiness"), "review_need": text("need")}
    claim = {"knowledge_type": F.lit("claim"), "source_stage": F.lit("manual"), "claim_status": F.lit("provisional")}
    rows = []
    for name in dict.fromkeys([*capture, *claim]):
        value = F.coalesce(F.when(F.col("capture"), capture[name]) if name in capture else F.lit(None), F.when(F.col("claim"), claim[name]) if name in claim else F.lit(None))
        rows.append(F.when(F.coalesce(F.element_at(fm, F.lit(name)), F.lit("")) == "", F.struct(F.lit(name).alias("field"), value.cast("string").alias("after"))))
    return n.select("rel_path", F.inline(F.filter(F.array(*rows), lambda x: x["after"].isNotNull())))


QUERIES = {"frontmatter_fix_plan": lambda s, d: frontmatter_fixes(notes(s, d)), "metadata_backfill": lambda s, d: metadata_backfill(notes(s, d))}
_LINT = notes_overview.SQL["frontmatter_lint"]
_PROFILE_SQL = _LINT[: _LINT.index("SELECT rel_path, profile, 'status'")].rstrip()
_POINTS = ", ".join(f"{{'i': {i}, 'n': '{n}', 's': CASE WHEN regexp_matches(lower(content), '(^|[^A-Za-z0-9_])({p})([^A-Za-z0-9_]|$)') THEN {x} ELSE 0 END}}" for i, (n, x, p) in enumerate(INTENTS))
_ADD = lambda p, n: f"CASE WHEN regexp_matches(content, '(?i){p}') THEN {n} ELSE 0 END"
_CHECKED = r"## Validierung|\b(validiert|geprüft|geprueft|erfolgreich getestet)\b"
SQL = {
    "frontmatter_fix_plan": _PROFILE_SQL + """, d AS (SELECT *, list_filter(normal, lambda x, i: list_position(normal, x) = i) AS once, coalesce((SELECT list(tag ORDER BY tag) FROM advise a WHERE a.profile = p.profile), []) AS own FROM p),
      f AS (SELECT *, list_concat(once, list_filter(own, lambda t: NOT list_contains(once, t))) AS after_tags FROM d)
      SELECT rel_path, profile, 'rename' AS change, 'Owner' AS field, 'owner' AS after FROM f WHERE owner IS NOT NULL
      UNION ALL SELECT rel_path, profile, 'set', 'tags', '[' || array_to_string(after_tags, ', ') || ']' FROM f WHERE NOT tagged OR listed <> after_tags
      UNION ALL SELECT rel_path, profile, 'set', 'status', CASE profile WHEN 'MOC' THEN 'moc' ELSE 'aktiv' END FROM f WHERE status IS NULL AND NOT starts_with(rel_path, 'Archiv/') AND profile <> 'Daily'
      UNION ALL SELECT rel_path, profile, 'set', field, CASE field WHEN 'kunde' THEN regexp_extract(rel_path, '^Kunden/([^/]+)', 1) WHEN 'quelle' THEN lower(profile) ELSE '2024-06-01' END FROM f JOIN need USING (profile)
        WHERE CASE field WHEN 'quelle' THEN quelle IS NULL WHEN 'datum' THEN datum IS NULL WHEN 'kunde' THEN starts_with(rel_path, 'Kunden/') ELSE true END""",
    "metadata_backfill": NOTES_SQL + f""", m AS (SELECT *, {reports.CAPTURE} AS capture, list_contains(tags, 'claim') OR starts_with(rel_path, 'Knowledge/Claims/') AS claim FROM notes),
      v AS (SELECT rel_path, unnest([{_POINTS}]) AS v FROM m WHERE capture), w AS (SELECT rel_path, list(v ORDER BY v.s DESC, v.i) AS v FROM v GROUP BY 1),
      i AS (SELECT rel_path, CASE WHEN v[1].s > 0 THEN v[1].n ELSE 'unknown' END AS intent, CASE WHEN v[1].s >= 7 AND v[1].s - v[2].s >= 3 THEN 'high' WHEN v[1].s >= 4 THEN 'medium' ELSE 'low' END AS sure FROM w),
      r AS (SELECT m.*, intent, sure, 25 + {_ADD('## Zusammenfassung', 15)} + {_ADD('## Ablauf', 15)} + {_ADD('## Fehler und Workarounds', 15)} + CASE WHEN list_contains(tags, 'auto-capture') THEN 5 ELSE 0 END AS value,
        CASE WHEN intent IN ('implementation', 'troubleshooting') THEN 25 ELSE 0 END + {_ADD('## Ablauf', 15)} + {_ADD(_CHECKED, 10)} + {_ADD('## Fehler und Workarounds', 5)} AS ready, regexp_matches(content, '(?i){_CHECKED}') AS checked FROM m LEFT JOIN i USING (rel_path)),
      s AS (SELECT *, 10 + 20 + CASE WHEN intent IN ('research', 'planning') THEN 15 ELSE 0 END + CASE WHEN NOT checked AND ready >= 55 THEN 10 ELSE 0 END AS need FROM r),
      f AS (SELECT rel_path, unnest([{{'f': 'knowledge_type', 'a': CASE WHEN capture THEN 'capture' ELSE 'claim' END}}, {{'f': 'source_stage', 'a': CASE WHEN capture THEN 'stop_capture' ELSE 'manual' END}}, {{'f': 'claim_status', 'a': CASE WHEN claim THEN 'provisional' END}},
        {{'f': 'session_intent', 'a': CASE WHEN capture THEN intent END}}, {{'f': 'intent_confidence', 'a': CASE WHEN capture THEN sure END}}, {{'f': 'sensitive', 'a': CASE WHEN capture THEN 'false' END}}, {{'f': 'redactions', 'a': CASE WHEN capture THEN '0' END}},
        {{'f': 'capture_value', 'a': CASE WHEN capture THEN CAST(value AS VARCHAR) END}}, {{'f': 'runbook_readiness', 'a': CASE WHEN capture THEN CAST(ready AS VARCHAR) END}}, {{'f': 'review_need', 'a': CASE WHEN capture THEN CAST(need AS VARCHAR) END}}]) AS x FROM s WHERE capture OR claim)
      SELECT rel_path, x.f AS field, x.a AS after FROM f WHERE x.a IS NOT NULL""",
}
