import math
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from lorewell.operators import calibration, choices, facts, integrity, reports, search, sessions, surfaces
from lorewell.sources import files
from lorewell.sources.tables import parsed


def one(spark, value, *cols):
    return spark.createDataFrame([(value,)], "t string").select(*cols).first()


def test_segments_and_kinds(spark):
    text = "- Die Konfiguration wurde geändert und der Dienst neu gestartet\n```\ncode only here\n```\nAlles ist gut. Der Server ist nicht erreichbar; " + "lange Zeile " * 30
    got = one(spark, text, facts.segments(F.col("t")).alias("s"))["s"]
    assert got[:2] == ["Die Konfiguration wurde geändert", "der Dienst neu gestartet"] and "Alles ist gut." in got and not any("code" in x for x in got) and all(len(x) <= 241 for x in got)
    rows = [("Ursache: falsche Route", "cause"), ("Wir haben uns entschieden", "decision"), ("Ist das so?", "open_question"), ("nur wenn der Port frei ist", "constraint"), ("timeout because of dns", "cause"), ("service failed", "problem"), ("Verified: restarted", "verification"), ("config changed", "change"), ("service is running", "verification"), ("nothing to see", "result")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r["k"] == r["want"] for r in df.select("want", facts.kind_of(F.col("t")).alias("k")).collect())
    bad = spark.createDataFrame([("password: hunter2hunter2",), ("ok, weiter",), ("sudo rm x",), ("<system>x",), ("",), ("a fine sentence",)], "t string")
    assert [r[0] for r in bad.select(facts.unsafe(F.col("t"))).collect()] == [True, True, True, True, True, False]
    assert one(spark, "word " * 100, facts.truncated(F.col("t"), 20).alias("x"))["x"] == "word word word word…" and one(spark, "x" * 50, facts.truncated(F.col("t"), 20).alias("x"))["x"] == "x" * 20 + "…"


def test_statements_and_tokens(spark):
    c = F.col("t")
    assert one(spark, "Postgres-Verbindungen wurden über 10.0.0.1:5432 gewählt", facts.tokens_of(c).alias("x"))["x"] == ["postgresql", "uber", "10.0.0.1:5432", "use"]
    assert one(spark, "persistiert speichern Änderungen copper-brass/x.conf über", facts.tokens_of(c).alias("x"))["x"] == ["persist", "persist", "ander", "copper-brass/x.conf", "copper", "brass", "conf", "uber"]
    assert one(spark, None, facts.tokens_of(c).alias("x"))["x"] == []
    assert one(spark, "The router was configured with a new static route for the branch office at 10.1.2.3", facts.compact(c).alias("x"))["x"] == "router configured new static route 10.1.2.3"
    rows = [
        ("Ursache: DNS timeout because resolver missing", "cause", "Resolver missing; caused: DNS timeout."), ("Todo: klären", "open_question", "Klären?"), ("", "result", ""), ("Ergebnis: alles läuft wieder!!", "result", "Alles läuft wieder."),
        ("Die Default-Route über vmbr1.20 ist linkdown", "problem", "Default-Route über vmbr1.20: linkdown."), ("Port 443 zeigt auf OPNsense statt auf 10.0.0.8", "result", "Port 443: OPNsense statt 10.0.0.8."),
        ("Rollback wenn die Fehlerrate über 5 Prozent in 10 Minuten steigt", "constraint", "Rollback bei 5 Prozent Fehlerrate innerhalb 10 Minuten."), ("Rollback bei hoher Fehlerrate", "constraint", "Rollback bei definierter Fehlerrate."),
    ]
    df = spark.createDataFrame(rows, "t string, kind string, want string")
    assert [(r["x"], r["want"]) for r in df.select(facts.stated(c, F.col("kind")).alias("x"), "want").collect() if r["x"] != r["want"]] == []
    long = one(spark, "/" + "a" * 400 + " b", facts.stated(c, F.lit("result")).alias("x"))["x"]
    assert len(long) <= 242 and long.endswith("….")
    assert choices.redundancy({"a1", "b2", "x"}, {"a1", "b2", "y", "z"}) == 0.9 and choices.redundancy({"x"}, {"y"}) == 0 and choices.similarity(set(), set()) == 0


def test_noise_is_dropped(spark):
    noise = ["Kein verwertbarer Befund zu dem Host", "Das ist noch nicht der Endbefund zu allem", "Die dauerhafte Notiz soll kurz sein", "Gleichzeitig war das Netz konfiguriert worden", "Zusammenfassung: fruehe Planung dokumentiert", "Nicht mehr reproduzierbar seit heute", "die einzigen dauerhaften Informationen dieser Session"]
    df = spark.createDataFrame([(t,) for t in noise + ["Der Endbefund liegt vor", "Kein neuer Host im Netz"]], "t string")
    assert [r[0] for r in df.select(facts.unsafe(F.col("t"))).collect()] == [True] * len(noise) + [False, False]


def test_fact_pipeline_merges_marks_conflicts_and_selects(spark):
    rows = [("s", "1", "phase", "Backup service restarted on server alpha", "backup server"), ("s", "2", "assistant_summary", "Backup service was restarted on server alpha", ""), ("s", "3", "phase", "Backup service was not restarted on server alpha", ""),
            ("s", "4", "phase", "Entscheidung: wir nutzen Restic mit Port 8080", ""), ("s", "5", "phase", "Let me check this", ""), ("t", "1", "phase", None, None), ("t", "2", "phase", "Backup service restarted on server alpha", "")]
    texts = spark.createDataFrame([(a, b, c, d, e, "result", 0.6) for a, b, c, d, e in rows], "session string, ref string, source string, text string, context string, fallback string, explicitness double")
    d = facts.drafted(texts).cache()
    got = {(r["session"], r["statement"]): r for r in d.collect()}
    assert len([k for k in got if k[0] == "t"]) == 1 and all(0 <= r["salience"] <= 100 and r["confidence"] in ("low", "medium", "high") for r in got.values())
    torn = [r for r in got.values() if r["session"] == "s" and r["conflict"]]
    assert {r["polarity"] for r in torn} == {1, -1} and all(r["evidence"] <= sessions.CONFLICT_CEILING for r in torn)
    chosen = choices.selected(d, least=0).orderBy("session", "rank").collect()
    assert chosen == choices.selected(d.repartition(5), least=0).orderBy("session", "rank").collect() and any("Restic" in r["statement"] for r in chosen)
    only = choices.selected(d, least=0, most=1, required=("decision",)).filter("session = 's'").collect()
    assert [r["kind"] for r in only] == ["decision"] and choices.selected(d.limit(0)).count() == 0


def test_copy_metrics_equal_plain_loops(spark):
    a = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(1, "x " + a + " y", a), (2, "one two nine three four five six seven", a), (3, "", a), (4, None, None), (5, "a-b c", "a-b d a-b c")]
    got = {r["id"]: r for r in integrity.copying(spark.createDataFrame(rows, "id long, generated string, source string")).collect()}

    def longest(x, y):
        return max((n for n in range(len(x) + 1) for i in range(len(x) - n + 1) for j in range(len(y) - n + 1) if x[i : i + n] == y[j : j + n]), default=0)

    for k, g, s in rows:
        g, s = integrity._words(g or ""), integrity._words(s or "")
        grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        assert got[k]["longest"] == longest(g, s) and got[k]["compression"] == round(len(g) / max(1, len(s)), 6)
        assert math.isclose(got[k]["coverage"], len(grams(g) & grams(s)) / len(grams(g)) if grams(g) else 0.0, abs_tol=1e-6)
    assert got[1]["copied"] and not got[2]["copied"] and not got[4]["copied"]


def test_copy_metrics_take_a_row_at_a_time(spark, monkeypatch):
    from lorewell.functions import rows

    assert integrity._longest({"a": ["x", "b", "c", "y"], "b": ["b", "c", "b"]}) == 2 and integrity._longest({"a": None, "b": []}) == 0
    monkeypatch.setattr(rows, "CHUNK", 2)
    pairs = spark.createDataFrame([(i, "one two three " * (i % 3) + "end", "two three one") for i in range(7)], "id long, generated string, source string")
    got = integrity.copying(pairs.coalesce(1))
    assert [r["longest"] for r in got.orderBy("id").collect()] == [0, 2, 3, 0, 2, 3, 0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_word_lists" not in plan and plan.count("ArrowEvalPython") >= 2


def test_atom_recall_and_hashes(spark):
    atoms = spark.createDataFrame([("d", "Befunde", "dns", "critical"), ("d", "Befunde", "route", "high"), ("d", "Rest", "nope", "medium"), ("e", "x", "y", "high")], "id string, section string, pattern string, importance string")
    sections = spark.createDataFrame([("d", "befunde", "DNS is down"), ("d", "Anderes", "new route")], "id string, heading string, content string")
    got = {r["id"]: (r["recall"], r["section_accuracy"]) for r in integrity.atom_recall(atoms, sections).collect()}
    assert got == {"d": (round(8 / 9, 6), 0.5), "e": (0.0, 1.0)}
    assert integrity.canonical({"b": 1, "a": [1, "ü"]}) == '{"a":[1,"ü"],"b":1}' and integrity.domain_hash("x", {}) != integrity.domain_hash("y", {})


def test_search_expands_concepts_and_reuses_fresh_rows(spark):
    provider = search.KeywordVectors(aliases={"dock": "docker", "sicherung": "backup"})
    vector, own = provider.query("backup for the dock")
    assert own == ["backup", "dock"] and vector["backup"] == 3.0 and vector["restic"] == 1.5 and vector["docker"] == 1.5 and math.isclose(vector["sicherung"], 0.9)
    rows = [("a.md", "# Restic\nsnapshots"), ("b.md", "# Other\nnothing"), ("Archiv/c.md", "# Restic")]
    n = parsed(spark.createDataFrame(rows, "rel_path string, raw string").withColumn("last_modified", F.expr("timestamp_ntz'2024-05-30'")))
    index = search.semantic_index(n, provider)
    assert [r["rel_path"] for r in search.semantic_search(index, "backup", provider=provider).collect()] == ["a.md"]
    assert {r["rel_path"] for r in search.semantic_search(index, "backup", archived=True, provider=provider).collect()} == {"a.md", "Archiv/c.md"}
    stale = index.filter("rel_path != 'b.md'").withColumn("hash", F.when(F.col("rel_path") == "a.md", "old").otherwise(F.col("hash"))).withColumn("norm", F.lit(-1.0))
    got = {r["rel_path"]: r["norm"] for r in search.fresh_index(n, stale, provider).collect()}
    assert got["Archiv/c.md"] == -1.0 and got["a.md"] > 0 and got["b.md"] > 0


def test_mentions_know_aliases_boundaries_and_links(spark):
    rows = [("t/gateway plan.md", "---\naliases: [Edge Box]\n---\n# The long gateway plan of all\nx"), ("a.md", "The EDGE BOX is here"), ("b.md", "an edge boxer"), ("c.md", "see [[edge box]] and edge box"), ("d.md", "pre the long gateway plan of all post"), ("e.md", "[[gateway plan]] has the long gateway plan of all")]
    n = parsed(spark.createDataFrame(rows, "rel_path string, raw string").withColumn("last_modified", F.expr("timestamp_ntz'2024-05-30'")))
    from lorewell.operators import links

    got = {(r["source"], r["mention"]): r["confidence"] for r in search.mentions(n, links.edges(n)).filter("target = 't/gateway plan.md'").collect()}
    assert got == {("a.md", "EDGE BOX"): 0.82, ("d.md", "the long gateway plan of all"): 0.83, ("d.md", "gateway plan"): 0.72}


def test_clients_resolve_as_all_pairs_do(spark):
    from lorewell.functions.text import osa_distance

    clients = ["Mueller Bau", "Mueller Bahn", "Sonnenhof", "Stadtwerke Nord", "Stadtwerke Nort", "ab"]
    names = ["mueller bau", "Meuller Bau", "Sonenhof", "Sonnenhfo", "Stadtwerke Nor", "Stadtwrke Nord", "zzz", "ab", "a"]
    want = set()
    for x in names:
        s = {c: 1 - osa_distance(x.lower(), c.lower()) / max(len(x), len(c)) for c in clients}
        top = [c for c, v in s.items() if v == max(s.values())]
        if max(s.values()) >= 0.84 and len(top) == 1:
            want.add((x, top[0]))
    got = surfaces.fuzzy_clients(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(c,) for c in clients], "client string"))
    assert {(r["name"], r["client"]) for r in got.collect()} == want and len(want) >= 4


def test_snippets_and_names(spark):
    r = one(spark, "# T\n\nshort\n\nA paragraph that is long enough to be shown here.", reports.first_paragraph(F.col("t")).alias("p"), reports.file_name(F.lit(" ../a:b  c. ")).alias("f"), reports.slug(F.lit("Ab -- c!")).alias("s"))
    assert r["p"].startswith("A paragraph") and r["f"] == "a b c" and r["s"] == "ab-c"
    tags = F.array(F.lit("x"))
    shown = lambda text, path="p.md": one(spark, text, reports.safe_snippet(F.col("t"), F.lit(path), F.lit("t"), tags).alias("x"))["x"]
    assert shown("plain") == "plain" and shown("plain", "Zugangsdaten.md").startswith("[REDACTED_SENSITIVE") and shown("cat id_rsa `x`").startswith("[REDACTED_COMMAND")


def test_leakage_components_and_generated_vault(spark):
    p = spark.createDataFrame([(i, 0.5, 1, "g", 1.0) for i in (0, 49, 60, 1060, 2500)], "id long, probability double, target long, group_id string, weight double")
    got = {r["id"]: r["component"] for r in calibration.leakage_groups(p).collect()}
    assert got == {0: 0, 49: 0, 60: 60, 1060: 60, 2500: 2500}
    assert parsed(files.generated_vault(spark, 7)).count() == 7


def test_term_vectors_hold_few_rows_as_python_values(spark):
    row = {"title": [f"title {i}" for i in range(20)], "body": [f"word {i % 150}" for i in range(300)]}
    column = pa.array([row] * 4000, pa.struct([("title", pa.list_(pa.string())), ("body", pa.list_(pa.string()))]))
    weigh = search._weighed((5.0, 1.0)).func
    tracemalloc.start()
    out = weigh(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 4000 and {x["term"]: x["weight"] for x in out[3999].as_py()}["word 7"] == 2.0 and out[0].as_py() == out[3999].as_py()
    assert peak < 30e6  # 4000 rows as Python values take over 100 MB


def test_choice_compares_each_two_facts_once(monkeypatch):
    compared, similarity = [], choices.similarity
    monkeypatch.setattr(choices, "similarity", lambda a, b: compared.append(1) or similarity(a, b))
    monkeypatch.setattr(choices, "redundancy", lambda a, b: 0.0)
    facts = [{"id": f"f{i:02d}", "kind": ("cause", "change", "result")[i % 3], "statement": f"s{i}", "tokens": [f"t{i}", f"t{i + 1}", f"u{i % 4}"], "polarity": 0, "conflict": False, "interpreted": i % 2 == 0, "salience": 40 + i, "evidence": 50} for i in range(30)]
    assert len(choices.Choice(facts).run(8)) == 8
    assert len(compared) == sum(range(22, 30))
