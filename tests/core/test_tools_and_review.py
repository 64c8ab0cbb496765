import pytest
from pyspark.sql import functions as F

from lorewell.operators import links, notes_overview, review
from lorewell.plans import tools
from lorewell.sources.tables import parsed

SF = "/root/testdata/sf0.001"


def test_parameters_are_checked():
    p = tools.Parameter(int, 5, low=1, high=9)
    assert (p.checked("x", None), p.checked("x", 99), p.checked("x", -1)) == (5, 9, 1)
    assert tools.Parameter(float, 0.5).checked("x", 1) == 1.0
    for bad, value in ((p, "3"), (p, True), (tools.Parameter(bool, False), 1), (tools.Parameter(str), 2)):
        with pytest.raises(TypeError):
            bad.checked("x", value)
    for bad, value in ((tools.Parameter(str, required=True), None), (tools.Parameter(str, required=True), " "), (tools.Parameter(str, choices=("a",)), "b")):
        with pytest.raises(ValueError):
            bad.checked("x", value)


def test_modes_and_schemas():
    shown = tools.visible()
    assert "campaign_roots" not in shown and set(tools.visible(tools.JUDGING_MODE)) == {"campaign_roots"}
    with pytest.raises(ValueError):
        tools.visible("other")
    s = shown["find_duplicates"].schema()
    assert s["properties"]["mode"] == {"type": "string", "default": "blocked", "enum": ["blocked", "exact"]} and shown["search_notes"].schema()["required"] == ["query"]


def test_calls(spark):
    with pytest.raises(KeyError):
        tools.call(spark, SF, "nope")
    with pytest.raises(KeyError):
        tools.call(spark, SF, "campaign_roots")
    with pytest.raises(ValueError):
        tools.call(spark, SF, "search_notes", query="x", other=1)
    assert tools.call(spark, SF, "search_notes", query="tion", limit=3).count() == 3
    assert tools.call(spark, SF, "read_note", note="7").select("rel_path").first()[0].endswith("/7.md")
    assert tools.call(spark, SF, "list_notes", status="aktiv", tags=("decision",)).count() > 0
    assert tools.call(spark, SF, "low_quality_notes", max_score=100, limit=5).count() == 5
    assert tools.call(spark, SF, "campaign_roots", mode=tools.JUDGING_MODE).count() == 33


def test_review_names_every_kind(spark):
    raw = [("a.md", "# A\n[[b2]] short"), ("x/b2.md", "---\nstatus: aktiv\ntags: [claim]\nrecheck_at: 2024-01-01\n---\n# B"), ("Knowledge/Contradictions/c.md", "# C\ntext"), ("y.md", "# Y\n[[old/b2]]"), ("Archiv/z.md", "# Z")]
    n = parsed(spark.createDataFrame(raw, "rel_path string, raw string").withColumn("last_modified", F.expr("timestamp_ntz'2022-05-30'")))
    judged = notes_overview.quality_penalties(n, links.backlink_counts(links.edges(n)))
    broken = links.broken(links.resolved(links.link_texts(n), n))
    twins = spark.createDataFrame([("a.md", "y.md", 85, "merge"), ("a.md", "Archiv/z.md", 90, "merge"), ("x/b2.md", "y.md", 40, "link")], "left string, right string, score long, suggestion string")
    suggested = spark.createDataFrame([("a.md", 0.95), ("a.md", 0.92), ("y.md", 0.6)], "source string, confidence double")
    fresh = spark.createDataFrame([("fresh", 3), ("stale", 1)], "state string, n long")
    q = review.review(n, judged, twins, links.broken_candidates(broken, n), broken, suggested, fresh)
    got = {r["id"]: (r["category"], r["severity"]) for r in q.collect()}
    assert got["duplicate:a.md:y.md"] == ("duplicate", "high") and not any("Archiv/z.md" in i or i == "duplicate:x/b2.md:y.md" for i in got)
    assert got["safe:broken_links"] == ("safe_maintenance", "high") and got["safe:frontmatter"][1] == "medium" and got["link_suggestions:a.md"][1] == "medium" and "link_suggestions:y.md" not in got
    assert got["question:contradiction:Knowledge/Contradictions/c.md"] == ("contradiction", "critical") and got["semantic_index:rebuild"] == ("index", "low") and got["surface:hot_cache"] == ("working_memory", "low")
    assert any(i.startswith("evidence:x/b2.md") for i in got)
    more = review.review(n, judged, twins, links.broken_candidates(broken, n), broken, suggested, fresh.filter("state = 'fresh'"), True)
    assert {"duplicate:x/b2.md:y.md"} <= {r["id"] for r in more.collect()} and more.filter("category = 'index' AND id LIKE 'semantic%'").count() == 0
    first = [r["severity"] for r in review.page(q, 3).collect()]
    assert first[0] == "critical" and len(first) == 3 and review.page(q, 0).count() == 1
