from pyspark.sql import functions as F

from lorewell.operators import schedule, taxonomy
from lorewell.plans import metadata
from lorewell.sources.tables import parsed

TAXONOMY = taxonomy.load_taxonomy('{"_comment": 1, "Docker": {"keywords": ["docker", "compose"], "filenameHints": ["docker"], "priority": 5, "subcategories": {"Swarm": {"keywords": ["swarm", "raft"], "filenameHints": ["swarm"]}, "Images": {"keywords": ["registry"], "filenameHints": []}}}, "Web": {"keywords": ["nginx"], "filenameHints": ["web"]}}')


def vault(spark, *notes):
    df = spark.createDataFrame([(p, t) for p, t in notes], "rel_path string, raw string")
    return parsed(df.withColumn("last_modified", F.expr("timestamp_ntz'2024-05-30'")))


def test_classes_and_subcategories(spark):
    n = vault(
        spark, ("a.md", "---\ntags: [docker/swarm]\n---\n# Notes\nx"), ("b.md", "# Docker swarm\nraft and swarm"), ("c.md", "# Web page\nx"), ("d.md", "# Nothing\ndocker compose only two"), ("e.md", "---\ntags: [registry, docker]\n---\n# X\n"), ("f.md", ""),
    )
    got = {r["rel_path"]: (r["category"], r["subcategory"], r["confidence"]) for r in taxonomy.classified(n, TAXONOMY).collect()}
    assert got == {"a.md": ("Docker", "Swarm", 10.5), "b.md": ("Docker", "Swarm", 25.5), "c.md": ("Web", None, 25.0), "d.md": (None, None, 0.0), "e.md": ("Docker", "Images", 10.5), "f.md": (None, None, 0.0)}


def test_topics_and_their_log(spark, tmp_path):
    text = "# Docker\n" + "container-mesh " * 3 + "Swarm-manager " * 4 + "add-something " * 3 + "files-config.json node-12 " * 3 + "edge-gateway twice edge-gateway " + "grün-blau-tester " * 3
    n = vault(spark, ("a.md", text), ("b.md", "# Docker two\n" + "Container-Mesh " * 3), ("c.md", "# Other\n" + "container-mesh " * 5))
    t = taxonomy.topics(n, TAXONOMY)
    got = {(r["rel_path"], r["place"]): r["topic"] for r in t.collect()}
    assert got == {("a.md", 0): "container-mesh", ("a.md", 1): "files-config", ("a.md", 2): "grün-blau-tester", ("b.md", 0): "container-mesh"}
    log = tmp_path / "log.txt"
    rows = [r["value"] for r in taxonomy.suggestion_log(t, n.select("rel_path", "title"), taxonomy.AT).collect()]
    client = '2024-06-02T00:00:00Z VORSCHLAG: "Acme" als Kunde registrieren? (Pfad: /home/acme)\n  → x'
    broken = '2024-06-02T00:00:00Z VORSCHLAG Unterkategorie: "lost" unter Docker\n  Kontext: no path'
    log.write_text("\n\n".join([*rows, client, broken, "noise", client.replace("Acme", "ACME").replace("/home/acme", "/srv")]) + "\n\n")
    b = {(r["kind"], r["candidate"]): r for r in taxonomy.buckets(taxonomy.suggestions(taxonomy.read_suggestions(spark, str(log)))).collect()}
    assert {k: (r["parent"], r["count"], r["contexts"]) for k, r in b.items()} == {("topic", "container-mesh"): ("Docker", 2, 2), ("topic", "files-config"): ("Docker", 1, 1), ("topic", "grün-blau-tester"): ("Docker", 1, 1), ("client", "ACME"): (None, 2, 2)}
    plan = taxonomy.promotion_plan(taxonomy.buckets(taxonomy.suggestions(taxonomy.read_suggestions(spark, str(log)))), TAXONOMY, 2).collect()
    assert [(r["subcategory"], r["keyword"], r["existed"], r["decision"]) for r in plan] == [("Container-Mesh", "container-mesh", False, "promote")]
    odd = spark.createDataFrame([("topic", "Docker", "swarm", 5, 1), ("topic", "Nope", "x-y", 5, 1), ("topic", "Docker", "a/b", 5, 1)], "kind string, parent string, candidate string, count long, contexts long")
    assert {r["keyword"]: (r["existed"], r["decision"]) for r in taxonomy.promotion_plan(odd, TAXONOMY).collect()} == {"swarm": (True, "promote"), "x-y": (False, "unknown category"), "a/b": (False, "unsafe name")}


def test_frontmatter_becomes_what_its_profile_wants(spark):
    n = vault(
        spark, ("Kunden/Acme/x.md", "---\nTags: [A b]\nOwner: me\n---\n# X\n"), ("Daily/2024.md", "---\ntags: [daily]\n---\n"), ("m_MOC.md", "---\ntags: [moc, MOC]\nstatus: moc\nquelle: x\n---\n"), ("Archiv/a.md", "---\ntags: []\n---\n"), ("r.md", "---\nstatus: aktiv\ntags: [x]\n---\n"), ("p.md", "plain"),
    )
    got = {}
    for r in metadata.frontmatter_fixes(n).collect():
        got.setdefault(r["rel_path"], set()).add((r["change"], r["field"], r["after"]))
    assert got["Daily/2024.md"] == {("set", "datum", "2024-06-01")} and got["m_MOC.md"] == {("set", "tags", "[moc]")} and "r.md" not in got
    assert got["Kunden/Acme/x.md"] >= {("rename", "Owner", "owner"), ("set", "status", "aktiv"), ("set", "kunde", "Acme")}
    assert got["p.md"] == {("set", "tags", "[]"), ("set", "status", "aktiv")}


def test_backfill_of_captures_and_claims(spark):
    n = vault(
        spark, ("Captures/a.md", "---\nsession_intent: research\ntags: []\n---\n## Zusammenfassung\n## Ablauf\n"), ("b.md", "---\ntags: [claim]\nclaim_status: confirmed\n---\nx"), ("c.md", "---\ntags: [auto-capture, claim]\n---\nFehler: error fix debug"), ("d.md", "x"),
    )
    got = {}
    for r in metadata.metadata_backfill(n).collect():
        got.setdefault(r["rel_path"], {})[r["field"]] = r["after"]
    assert got["Captures/a.md"] == {"knowledge_type": "capture", "source_stage": "stop_capture", "intent_confidence": "low", "sensitive": "false", "redactions": "0", "capture_value": "55", "runbook_readiness": "15", "review_need": "45"}
    assert got["b.md"] == {"knowledge_type": "claim", "source_stage": "manual"} and "d.md" not in got
    assert got["c.md"]["knowledge_type"] == "capture" and got["c.md"]["claim_status"] == "provisional" and got["c.md"]["session_intent"] == "troubleshooting" and got["c.md"]["capture_value"] == "30"


def test_schedule(spark):
    n = vault(
        spark, ("Knowledge/a.md", "---\nrecheck_at: 2024-05-01\n---\nx"), ("b.md", "---\nexpires_at: 2024-06-20\n---\n"), ("c.md", "---\nrecheck_at: 2024-09-01\nexpires_at: 2024-06-02\n---\n"), ("d.md", "---\nrecheck_at: soon\n---\n"), ("Knowledge/Contradictions/q.md", "x"), ("Knowledge/Gaps/g.md", "---\nstatus: resolved\n---\n"),
    )
    got = [(r["id"], r["priority"], r["due"]) for r in schedule.schedule(n).orderBy("place").collect()]
    assert got == [("upcoming:Knowledge/a.md", "medium", "2024-05-01"), ("evidence:Knowledge/a.md", "high", "2024-06-01"), ("question:Knowledge/Contradictions/q.md", "high", "2024-06-01"), ("dashboard:Knowledge/_brain.md", "low", "2024-06-01"), ("upcoming:b.md", "medium", "2024-06-20"), ("upcoming:c.md", "medium", "2024-09-01")]
    assert [r["place"] for r in schedule.schedule(n.limit(0)).collect()] == [1] and schedule.schedule(n, horizon=0).count() == 5
