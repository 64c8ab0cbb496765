from pyspark.sql import functions as F

from lorewell.operators import links, taxonomy
from lorewell.plans import triage
from lorewell.sources.tables import parsed

TAXONOMY = taxonomy.load_taxonomy('{"Docker": {"keywords": ["docker", "compose"], "filenameHints": ["docker"], "priority": 5, "subcategories": {"Swarm": {"keywords": ["swarm", "raft"], "filenameHints": ["swarm"]}}}}')


def vault(spark, *notes):
    df = spark.createDataFrame([(p, t) for p, t in notes], "rel_path string, raw string")
    return parsed(df.withColumn("last_modified", F.expr("timestamp_ntz'2024-05-30'")))


def test_decisions_and_routes(spark):
    body = "docker compose nginx container deployment with a reverse proxy for the whole setup " * 3
    n = vault(
        spark, ("Inbox/a.md", f"# Docker compose setup\n{body}"), ("Technik/b.md", f"# Docker compose setup\n{body}"), ("Inbox/c.md", "# Acme meeting\nx"), ("Inbox/d.md", "# CVE list\nx"), ("Inbox/e.md", "# Docker swarm\nx"), ("Inbox/f.md", "# Hello\nnothing"), ("Inbox/g.md", "# Acme CVE\nansible"), ("other.md", "# Docker\nx"),
    )
    batch = triage.inbox(n)
    assert batch.count() == 6 and triage.inbox(n, "Inbox/", 2).count() == 2
    twins = triage.sure_twins(batch, n, 55)
    assert [r[0] for r in twins.collect()] == ["Inbox/a.md"]
    go = lambda **k: {r["rel_path"]: (r["decision"], r["target"], r["reason"], r["tags"]) for r in triage.triaged(batch, twins, TAXONOMY, (("acme", "Acme GmbH"), ("x", "X")), ("ansible",), **k).collect()}
    got = go()
    assert got["Inbox/a.md"][0] == "review_duplicate"
    assert got["Inbox/c.md"] == ("move", "Kunden/Acme GmbH/c.md", "client", ["kunde/acme"])
    assert got["Inbox/g.md"] == ("move", "Kunden/Acme GmbH/g.md", "client", ["ansible", "kunde/acme", "sicherheit"])
    plain = {r["rel_path"]: (r["decision"], r["target"], r["tags"]) for r in triage.triaged(batch, twins.limit(0), TAXONOMY).collect()}
    assert plain["Inbox/d.md"] == ("move", "Sicherheit/d.md", ["sicherheit"]) and plain["Inbox/e.md"] == ("move", "Technik/Docker/Swarm/e.md", ["docker", "docker/swarm"])
    assert plain["Inbox/f.md"] == ("review_low_confidence", "Inbox/f.md", ["inbox"])
    assert {r["decision"] for r in triage.triaged(batch, twins.limit(0), TAXONOMY, target_folder="Inbox").collect()} == {"normalize"}
    assert triage.triaged(batch, twins.limit(0), TAXONOMY, apply_low=True).filter("rel_path = 'Inbox/f.md'").first()["decision"] == "normalize"


def test_lookup_in_order(spark):
    n = vault(spark, ("a/One.md", "# First"), ("b/first.md", "# Second"), ("c.md", "# c"), ("c.md.md", "# z"))
    asked = spark.createDataFrame([("a/One.md",), ("a/One",), ("FIRST",), ("one",), ("c.md",), ("zzz",), (None,)], "asked string")
    got = {r["asked"]: (r["rel_path"], r["by"]) for r in triage.looked_up(asked, n).collect()}
    assert got == {"a/One.md": ("a/One.md", "path"), "a/One": ("a/One.md", "file"), "FIRST": ("a/One.md", "name"), "one": ("a/One.md", "name"), "c.md": ("c.md", "path"), "zzz": (None, None)}


def test_plain_mentions_probe_texts_and_scan_for_few_names_only(spark, monkeypatch):
    scanned, matching = [], triage.patterns.matching
    monkeypatch.setattr(triage.patterns, "matching", lambda p, t: scanned.extend(r["pattern_id"] for r in p.collect()) or matching(p, t))
    n = vault(
        spark, ("k/1234.md", "# ab c\nx51234y -- -.- 99 Ünder_way"), ("k/5678.md", "# 12 of-the 34\nab cd, 12  of the 34, 612 of-the 345"), ("k/ünder.md", "# one two three four\nzone two three fourth 123 4"), ("k/9012.md", "# -.- --\nab c1234 -.- -- one two  three four"),
        ("k/nichts.md", "# wort teil\nhauptwort teile, wort, teil and HAUPTWORT TEIL"),
    )
    rows = n.select("rel_path", "title", "content").collect()
    names = {}
    for r in sorted(rows, key=lambda r: r["rel_path"]):
        for name in {r["rel_path"].split("/")[-1][:-3].lower(), r["title"].lower()}:
            names[name] = r["rel_path"]
    want = {(r["rel_path"], t) for r in rows for name, t in names.items() if len(name) > 3 and name in r["content"].lower() and t != r["rel_path"]}
    got = triage.plain_mentions(n, links.edges(n)).collect()
    assert {(r["source"], r["target"]) for r in got} == want and len(got) == len(want) >= 3
    assert set(scanned) == {"ab c", "-.- --"}


def test_plain_mentions_equal_a_loop(spark):
    n = vault(
        spark, ("a.md", "# Gateway plan\nsee the other router and todos"), ("Other Router.md", "# Router two\n[[a]] gateway plan"), ("x/todos.md", "# todos\nGATEWAY PLAN, other router"), ("abc.md", "# abc\nrouter two"), ("Zwei.md", "# Gateway plan\nzwei"),
    )
    rows = n.select("rel_path", "title", "content", "out_links").collect()
    names = {}
    for r in sorted(rows, key=lambda r: r["rel_path"]):
        file = r["rel_path"].split("/")[-1][:-3].lower()
        for name in [file] * (file not in triage.NO_NAMES) + [r["title"].lower()] * (r["title"].lower() != file):
            if len(name) > 3:
                names[name] = r["rel_path"]
    edges = {(r["src"], r["dst"]) for r in links.edges(n).collect()}
    want = {(r["rel_path"], t) for r in rows for name, t in names.items() if name in r["content"].lower() and t != r["rel_path"] and (r["rel_path"], t) not in edges}
    got = triage.plain_mentions(n, links.edges(n)).collect()
    assert {(r["source"], r["target"]) for r in got} == want and len(got) == len(want) > 3


def test_plain_mentions_are_asked_by_runs_of_words(spark, monkeypatch):
    made, written = {}, triage.scratch.written
    monkeypatch.setattr(triage.scratch, "written", lambda df, name: made.setdefault(name, written(df, name)))
    title = "the old house of the restore plan today"
    rows = [("a/one.md", title, "x"), ("a/two.md", "Two", "see the OLD house of the restore plan todays"), ("a/three.md", "Three", "old house here, the restore here, plan of the"), ("a/four.md", "four words in it all", "four words in it all")]
    n = spark.createDataFrame([(p, t, c, [], {}) for p, t, c in rows], "rel_path string, title string, content string, out_links array<string>, frontmatter map<string,string>")
    got = {(r["source"], r["target"], r["mention"]) for r in triage.plain_mentions(n, spark.createDataFrame([], "src string, dst string")).collect()}
    assert got == {("a/two.md", "a/one.md", title)}
    names = [r["probe"] for r in made["probes"].filter(F.col("name") == title).collect()]
    asked = triage._probed(n.select(F.col("rel_path").alias("key"), F.lower("content").alias("low"))).filter(F.col("probe").isin(names))
    assert {r["key"] for r in asked.collect()} == {"a/two.md"}  # not the text that has some of the words
