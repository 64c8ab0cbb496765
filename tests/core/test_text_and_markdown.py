from pyspark.sql import functions as F

from lorewell.functions import markdown as md
from lorewell.functions import text as tx
from lorewell.operators import duplicates, links, notes_overview, search
from lorewell.plans import mutations, sinks
from lorewell.sources import files
from lorewell.sources.tables import parsed

NOTE = '---\nstatus: aktiv\ntags: [A, b-c]\ntitle: "x: y"\nstatus: planung\n---\n# Head line \n\nText #inline and [[a]] [[b|see]] [[c\\|table]] [[!no]] [[f/d]]\n- [ ] open one\n* [X] closed\n```\n# not a heading\n```\n## Two\n1. step\n'


def one(spark, value, *cols):
    return spark.createDataFrame([(value,)], "raw string").select(*cols).first()


def test_markdown_parts(spark):
    raw = F.col("raw")
    r = one(spark, NOTE, md.flat_frontmatter(raw).alias("fm"), md.title(md.body(raw), F.lit("z")).alias("title"), md.wikilinks(raw).alias("links"), md.todos(raw).alias("todos"), md.inline_tags(md.body(raw)).alias("tags"), md.code_blocks(raw).alias("code"), md.heading_count(raw, 2).alias("h2"), md.list_lines(raw).alias("items"))
    assert r["fm"] == {"status": "planung", "tags": "[A, b-c]", "title": "x: y"} and r["title"] == "Head line"
    assert r["links"] == ["a", "b", "c", "f/d"] and [(t["text"], t["done"], t["line"]) for t in r["todos"]] == [("open one", False, 10)]
    assert r["tags"] == ["inline"] and (r["code"], r["h2"], r["items"]) == (1, 1, 3)
    r = one(spark, "---\ntags:\n  - One\n  - \"two three\"\nkunde: x\nlist:\n- a\n---\n* [ ] no task\n- [x]no\n -  [ ] no\n  - [x] yes\nat#no #Straße/ops_1 [[a\\b]] [[c\\|d]]", md.flat_frontmatter(raw).alias("fm"), md.listed_tags(md.flat_frontmatter(raw)["tags"]).alias("listed"), md.todos(md.body(raw)).alias("todos"), md.inline_tags(md.body(raw)).alias("tags"), md.wikilinks(raw).alias("links"))
    assert r["fm"] == {"tags": '[One, "two three"]', "kunde": "x", "list": "[a]"} and r["listed"] == ["One", "two three"]
    assert [(t["text"], t["done"], t["line"]) for t in r["todos"]] == [("yes", True, 4)] and r["tags"] == ["straße/ops_1"] and r["links"] == ["a\\b", "c"]
    r = one(spark, "no frontmatter", md.flat_frontmatter(raw).alias("fm"), md.title(raw, F.lit("z")).alias("title"), md.list_value(F.lit("[a1, b1 ,c11]")).alias("l"))
    assert r["fm"] == {} and r["title"] == "z" and r["l"] == ["a1", "b1", "c11"]


def test_tokenizers_and_similarities(spark):
    r = one(spark, "Über_die Reverse-Proxy und a/bcd", tx.semantic_tokens(F.col("raw")).alias("s"), tx.title_tokens(F.col("raw")).alias("t"), tx.trigrams(F.lit("abcd")).alias("g"), tx.trigrams(F.lit("ab")).alias("g0"))
    assert r["s"] == ["ueber-die", "ueber", "reverse-proxy", "reverse", "proxy", "bcd"] and r["g"] == ["abc", "bcd"] and r["g0"] == []
    assert tx.osa_distance("ca", "ac") == 1 and tx.osa_distance("ca", "abc") == 3 and tx.osa_distance("", "ab") == 2
    r = one(spark, "x", tx.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("j"), tx.occurrences(F.lit("aaaa"), F.lit("aa")).alias("n"))
    assert abs(r["j"] - 1 / 3) < 1e-12 and r["n"] == 2
    r = one(spark, "password: hunter2 and ghp_" + "a" * 24, *[c.alias(k) for c, k in zip(tx.redacted(F.col("raw")), "tn", strict=True)])
    assert r["n"] == 2 and "hunter2" not in r["t"] and "ghp_" not in r["t"]


def vault(spark, *rows):
    return parsed(spark.createDataFrame([(p, t, None) for p, t in rows], "rel_path string, raw string, last_modified timestamp_ntz").withColumn("last_modified", F.expr("timestamp_ntz'2024-05-30'")))


def test_link_resolution_order(spark):
    n = vault(spark, ("a/Note.md", "[[Note]] [[note]] [[b/Note]] [[b/Note.md]] [[missing]]"), ("b/Note.md", "[[Note]]"), ("c/other.md", "[[OTHER]]"))
    got = {(r["src"], r["target"]): r["dst"] for r in links.resolved(links.link_texts(n), n).collect()}
    assert got == {("a/Note.md", "Note"): "a/Note.md", ("a/Note.md", "note"): "a/Note.md", ("a/Note.md", "b/Note"): "b/Note.md", ("a/Note.md", "b/Note.md"): "b/Note.md", ("a/Note.md", "missing"): None, ("b/Note.md", "Note"): "a/Note.md", ("c/other.md", "OTHER"): "c/other.md"}
    assert {r["src"] for r in links.broken(links.resolved(links.link_texts(n), n)).collect()} == {"a/Note.md"}


def test_broken_links_candidates_and_repair(spark):
    n = vault(spark, ("a/Plan.md", "x [[old/Single]] [[old/Single|say]] [[old/Twice]] [[Alpha beta gamma delta]]"), ("b/Single.md", "x"), ("c/Twice.md", "x"), ("d/twice.md", "x"), ("e/alpha beta gamma.md", "x"), ("e/alpha beta gamma delta more.md", "x"), ("e/alpha.md", "x"))
    c = links.broken_candidates(links.broken(links.resolved(links.link_texts(n), n)), n)
    assert sorted((r["target"], r["candidate"], r["confidence"]) for r in c.collect()) == [
        ("Alpha beta gamma delta", "e/alpha beta gamma delta more.md", "medium"), ("Alpha beta gamma delta", "e/alpha beta gamma.md", "low"), ("old/Single", "b/Single.md", "high"), ("old/Twice", "c/Twice.md", "medium"), ("old/Twice", "d/twice.md", "medium")]
    r = links.broken_fixes(n, c).collect()
    assert [(x["target"], x["replacement"], x["changes"]) for x in r] == [("old/Single", "b/Single", 2)] and "[[b/Single]] [[b/Single|say]] [[old/Twice]]" in r[0]["after"]


def test_lexical_scores(spark):
    n = vault(spark, ("a.md", "# dns setup\ndns"), ("b.md", "---\ntags: [dns]\n---\n# t\n"), ("c.md", "# t\ndns dns dns dns"), ("d.md", "---\nprojekt: dns\ncalibration_x: dns\n---\n# t\n"), ("e.md", "---\ncalibration_y: dns\n---\n# t\n"))
    got = {r["rel_path"]: r["score"] for r in search.lexical_search(n, "DNS").collect()}
    assert got["a.md"] == 12 and got["c.md"] == 4 and got["d.md"] == 3 and got["b.md"] == 8 and "e.md" not in got


def test_exact_duplicates_lose_no_pair(spark):
    import random

    rng = random.Random(6)
    pool = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(80):
        title = " ".join(rng.choices(pool, k=rng.randrange(1, 5)))
        if i % 4 == 1:
            title = "intro " + " ".join(rng.choices(pool, k=3)) + " " + rows[-1][1] + " outro " + " ".join(rng.choices(pool, k=4))
        tags = ", ".join(rng.sample([f"t{k}" for k in range(24)], 16 if i % 10 < 2 else 3))
        body = rows[-1][2] if i % 3 == 1 else " ".join(rng.choices(pool, k=60))
        rows.append((f"f{i % 5}/n{i:02d}.md", title, body, tags))
    n = vault(spark, *[(p, f"---\ntags: [{g}]\n---\n# {t}\n{b}") for p, t, b, g in rows])
    f = duplicates.features(n)
    every = f.select(F.col("id").alias("left")).join(f.select(F.col("id").alias("right")), F.col("left") < F.col("right"))
    want = sorted(map(tuple, duplicates.scored(every, f, 60).collect()))
    assert sorted(map(tuple, duplicates.scored(duplicates.exact_pairs(f, 60), f, 60).collect())) == want and len(want) > 5


def test_blocked_pairs_are_bounded_and_find_the_planted_pair(spark):
    n = parsed(files.generated_vault(spark, 1100))
    f = duplicates.features(n)
    pairs = duplicates.blocked_pairs(duplicates.block_keys(f)).cache()
    assert pairs.groupBy("left").count().agg(F.max("count")).first()[0] <= duplicates.CANDIDATES
    best = duplicates.scored(pairs, f, 60).orderBy(F.desc("score"), "left").limit(20).collect()
    assert ("Projekte/note-00000.md", "Technik/note-00001.md") in {(r["left"], r["right"]) for r in duplicates.scored(pairs, f, 50).collect()} and len(best) <= 20


def test_archive_names_are_free(spark):
    moves = spark.createDataFrame([("x/a.md", "Archiv"), ("y/a.md", "Archiv"), ("z/a.md", "Archiv"), ("x/a (5).md", "Archiv"), ("x/b.md", "Archiv"), ("y/b (2).md", "Archiv"), ("z/b.md", "Archiv"), ("q/c.md", "Other")], "rel_path string, folder string")
    taken = spark.createDataFrame([("Archiv/a.md",), ("Archiv/a (3).md",), ("Archiv/a (5).md",), ("Archiv/c.md",)], "rel_path string")
    got = {r["rel_path"]: r["target"] for r in mutations.archive_names(moves, taken).collect()}
    assert len(set(got.values())) == len(got) and not set(got.values()) & {r[0] for r in taken.collect()}
    assert [got[k] for k in ("x/a.md", "y/a.md", "z/a.md")] == ["Archiv/a (2).md", "Archiv/a (4).md", "Archiv/a (6).md"] and got["q/c.md"] == "Other/c.md"
    assert got["x/b.md"] == "Archiv/b.md" and {got["y/b (2).md"], got["z/b.md"]} <= {"Archiv/b (2).md", "Archiv/b (3).md", "Archiv/b (2) (2).md"}


def test_link_plan_skips_fences_links_and_ambiguous_mentions(spark):
    n = vault(spark, ("a.md", "```\nGate one\n```\nsee [[x]] Gate one\nthen gate one here"), ("b.md", "```\nGate one\n```\n"), ("c.md", "two"))
    found = spark.createDataFrame([("a.md", "t/gate.md", "Gate one"), ("b.md", "t/gate.md", "Gate one"), ("c.md", "t/x.md", "two"), ("c.md", "t/y.md", "Two")], "source string, target string, mention string")
    got = {(r["source"], r["target"]): r["reason"] for r in mutations.link_plan(found, n).collect()}
    assert got == {("a.md", "t/gate.md"): "linked", ("b.md", "t/gate.md"): "no plain mention", ("c.md", "t/x.md"): "ambiguous", ("c.md", "t/y.md"): "ambiguous"}


def test_quality_and_plans(spark):
    n = vault(spark, ("x.md", "short"), ("Archiv/y.md", "---\nstatus: aktiv\ndatum: 2024-01-01\ntags: [t]\n---\n# A fine long title\n[[x]]\n" + "word " * 30))
    q = notes_overview.quality_penalties(n, links.backlink_counts(links.edges(n)))
    got = {r["rel_path"]: (r["score"], r["grade"]) for r in q.collect()}
    assert got == {"x.md": (0, "poor"), "Archiv/y.md": (85, "excellent")}
    assert {(r["rel_path"], r["action"]) for r in notes_overview.lifecycle(q).collect()} == {("x.md", "activate"), ("Archiv/y.md", "archive")}
    raw = spark.createDataFrame([("---\na: 1\nstatus: old\n---\nx",), ("---\na: 1\n---\nx",), ("x",)], "raw string")
    assert [r[0] for r in raw.select(mutations.with_field(F.col("raw"), "status", F.lit("new"))).collect()] == ["---\na: 1\nstatus: new\n---\nx", "---\na: 1\nstatus: new\n---\nx", "---\nstatus: new\n---\n\nx"]
    r = mutations.rename_plan(vault(spark, ("a.md", "[[old]] [[old|x]] [[older]]")), "old", "new").first()
    assert r["changes"] == 2 and r["after"].strip() == "[[new]] [[new|x]] [[older]]"


def test_guarded_sink(spark, tmp_path):
    policy = {"save": {"write": True}, "look": {"write": False}}
    df = spark.range(3)
    assert not sinks.write_guarded(df, str(tmp_path), "out/t", "save", policy) and not (tmp_path / "out").exists()
    assert sinks.write_guarded(df, str(tmp_path), "out/t", "save", policy, dry_run=False) and spark.read.parquet(str(tmp_path / "out/t")).count() == 3
    for tool, path in (("look", "a"), ("none", "a"), ("save", "../a"), ("save", "/a"), ("save", ".git/a"), ("save", "a\nb")):
        assert not sinks.can_write(tool, path, policy)


def test_file_sources(spark, tmp_path):
    for name, text in (("a.md", NOTE), (".hidden/b.md", "x"), ("sub/c.md", "plain"), ("d.txt", "no")):
        p = tmp_path / "vault" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    for yaml in (False, True):
        read = {r["rel_path"]: r for r in files.read_notes(spark, str(tmp_path / "vault"), yaml).collect()}
        assert sorted(read) == ["a.md", "sub/c.md"] and read["a.md"]["tags"] == ["a", "b-c", "inline"] and read["a.md"]["frontmatter"]["title"] == "x: y"
    (tmp_path / "t.jsonl").write_text('{"message":{"role":"user","content":"hi"}}\nbroken\n{"message":{"role":"assistant","content":[{"type":"tool_use","id":"1","name":"Bash","input":{"command":"ls"}},{"type":"text","text":"ok"}]}}\n{"message":{"role":"user","content":[{"type":"tool_result","tool_use_id":"1","content":"out","is_error":true}]}}\n')
    t = files.read_transcript(spark, str(tmp_path / "t.jsonl"))
    assert [(r["role"], r["kind"]) for r in t.orderBy("line", "ord").collect()] == [("user", "text"), ("assistant", "tool_use"), ("assistant", "text"), ("user", "tool_result")]
    pair = files.paired_tools(t).collect()
    assert len(pair) == 1 and pair[0]["output"] == "out" and pair[0]["is_error"]
    (tmp_path / "log.jsonl").write_text('{"ts":"1","tool":"a","summary":"s"}\nnot json\n')
    assert [r["summary"] for r in files.read_action_log(spark, str(tmp_path / "log.jsonl")).collect()] == ["not json", "s"]
    src = spark.createDataFrame([("p", "t"), ("q", "u")], "path string, text string")
    done = src.filter("path = 'p'").select("path", F.sha2("text", 256).alias("hash"))
    assert [r["path"] for r in files.pending_sources(src, done).collect()] == ["q"]


def test_contradictions_behind_common_terms(spark):
    from lorewell.operators import sessions

    words = ["server", "backup", "restart", "network", "storage"]
    rows = [(i % 70, " ".join(sorted({words[i % 5], words[i // 5 % 5], words[i // 25 % 5]})) + f" n{i}" + " not" * (i % 3 == 0)) for i in range(200)]
    terms = {r: {w for w in r[1].split() if len(w) >= 5} for r in rows}
    expected = set()
    for a in rows:
        near = sorted((b[0], b[1], len(terms[a] & terms[b])) for b in rows if a[0] != b[0] and ("not" in a[1]) != ("not" in b[1]) and len(terms[a] & terms[b]) >= 2)
        expected |= {(*a, *b) for b in near[:5]}
    got = [tuple(r) for r in sessions.contradictions(spark.createDataFrame(rows, "doc_id long, claim string")).collect()]
    assert len(expected) > 500 and len(got) == len(expected) and set(got) == expected


def test_contradictions_meet_without_texts(spark, monkeypatch):
    from lorewell.operators import sessions
    from lorewell.sources import scratch

    made, written = {}, scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, name: made.setdefault(name, written(df, name)))
    rows = [(i, f"server backup of house n{i}" + " not" * (i == 3)) for i in range(40)] + [(100 + i, f"alone{i} other{i} words{i}") for i in range(40)]
    rows += [(7, f"server backup house m{i}") for i in range(20)]
    got = sessions.contradictions(spark.createDataFrame(rows, "doc_id long, claim string"))
    near = sorted(r for r in rows if "server" in r[1] and r[0] != 3)
    expected = {(*rows[3], *r, 3) for r in near[:5]} | {(*r, *rows[3], 3) for r in near}
    assert set(map(tuple, got.collect())) == expected and got.count() == len(expected)
    assert "string" not in dict(made["places"].dtypes).values()
    assert made["pairs"].count() == 3 and made["places"].count() == 3 * 60  # pairs of one side only are gone
    assert max(len(r["first"]) for r in made["partners"].collect()) <= 10


def test_pairs_by_titles_equal_all_pairs_and_are_not_exchanged(spark, monkeypatch):
    titles = ["Backup Server restore plan", "Backup Server restore plan today", "Firewall rules", "restore plan", "x"]
    rows = [(f"{'Kunden' if i % 3 else 'Technik'}/note-{i:03d}.md", titles[i % 11 % 5], [f"w{j}" for j in range(i % 4, 12)], [f"t{j}" for j in range(i % 13)]) for i in range(60)]
    n = spark.createDataFrame(rows, "rel_path string, title string, words array<string>, tags array<string>")
    n = n.select("rel_path", "title", "tags", F.array_join(F.transform("words", lambda w: F.concat(F.lit("word"), w)), " ").alias("content"), F.create_map(F.lit("status"), F.lit("aktiv")).alias("frontmatter"))
    f = duplicates.features(n)
    every = f.select(F.col("id").alias("left")).join(f.select(F.col("id").alias("right")), F.col("left") < F.col("right"))
    want = sorted((r["left"], r["right"], r["score"], r["suggestion"]) for r in duplicates.scored(every, f, 46).collect())
    monkeypatch.setattr(duplicates, "TITLE_BLOCK", 4)
    got = duplicates.named(duplicates.scored_by_titles(f, 46))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    by_title = duplicates.named(duplicates.scored_by_titles(f, 46, every=False))
    assert set(map(tuple, by_title.collect())) < set(want)
    plan = by_title._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0] and "Repartition" not in plan.split("Join")[0]  # nothing is exchanged after pairs meet


def test_best_pairs_equal_ranked_ones_and_few_contents_are_compared(spark, monkeypatch):
    titles = ["Backup Server restore plan", "Backup Server restore plan today", "Backup Server restore", "Firewall rules of house", "Firewall rules"]
    rows = [(f"{'Kunden' if i % 3 else 'Technik'}/note-{i:03d}.md", titles[i * 7 % 11 % 5], [f"w{j}" for j in range(6 + i // 3 % 2)], [f"t{j}" for j in range(i % 5)]) for i in range(60)]
    n = spark.createDataFrame(rows, "rel_path string, title string, words array<string>, tags array<string>")
    n = n.select("rel_path", "title", "tags", F.array_join(F.transform("words", lambda w: F.concat(F.lit("word"), w)), " ").alias("content"), F.create_map(F.lit("status"), F.lit("aktiv")).alias("frontmatter"))
    f = duplicates.features(n)
    every = f.select(F.col("id").alias("left")).join(f.select(F.col("id").alias("right")), F.col("left") < F.col("right"))
    seen, compared = [], duplicates.with_contents
    monkeypatch.setattr(duplicates, "with_contents", lambda j, f, least: seen.append(j.count()) or compared(j, f, least))
    for least, most, first in ((60, 20, 1), (60, 20, 100), (46, 300, 1), (46, 5000, 10), (200, 20, 1)):
        monkeypatch.setattr(duplicates, "FIRST_PAIRS", first)
        want = list(map(tuple, duplicates.ranked(compared(duplicates.rests(every, f, least), f, least), most).collect()))
        seen.clear()
        assert list(map(tuple, duplicates.best(every, f, least, most).collect())) == want
        if (most, first) == (20, 1):
            assert len(want) == (20 if least == 60 else 0) and sum(seen) <= duplicates.rests(every, f, least).count() // 4


def test_mentions_of_a_name_of_many_notes_are_ranked_once_for_sources_alike(spark, monkeypatch):
    paths = [f"src/n{i:02d}.md" for i in range(40)]
    rows = [(p, "Restore Plan", ["ops", "de"] if i % 2 else ["de"], "restore plan here", [], {"status": "aktiv"}) for i, p in enumerate(paths)]
    n = spark.createDataFrame(rows, "rel_path string, title string, tags array<string>, content string, out_links array<string>, frontmatter map<string,string>")
    links = {(paths[0], paths[k]) for k in range(1, 12)} | {(paths[3], paths[1])}
    groups = []
    written = search.scratch.written
    monkeypatch.setattr(search.scratch, "written", lambda df, name: (groups.append(df.count()) if name == "mention-groups" else None) or written(df, name))
    monkeypatch.setattr(search, "TARGET_BLOCK", 7)
    got = sorted(tuple(r) for r in search.mentions(n, spark.createDataFrame(sorted(links), "src string, dst string"), k=None).collect())
    want = []
    for i, source in enumerate(paths):
        worth = lambda j: min(0.98, round(0.78 + 0.04 * (2 if i % 2 and j % 2 else 1) + 0.08 + 0.05, 2))  # noqa: E731, B023
        left = sorted((-worth(j), t) for j, t in enumerate(paths) if t != source and (source, t) not in links)
        want += [(source, t, "restore plan", -w) for w, t in left[:5]]
    assert got == sorted(want)
    assert groups == [3]  # two sets of tags, and the note of eleven links: not a row a pair


def test_mentions_are_those_of_a_plain_search(spark, monkeypatch):
    import random

    import regex

    names = ["Restore Plan", "Plan B", "Backup Server restore plan of today", "server-room", "Über Größe", "a_b c_d", "-- --", "of the old house plan", "Firewall", "x-ray lab two", "(Blue) sky"]
    rng, made, written = random.Random(4), {}, search.scratch.written
    fill = ["plan", "of", "the", "server", "restore", "x", "house", "today", "--", "Größe", "b"]
    glue = [" ", " ", " ", ", ", "-", "\n", "_"]
    texts = ["".join(x for _ in range(12) for x in (rng.choice([*fill, *names, *(m.upper() for m in names[:5])]), rng.choice(glue))) for _ in range(60)]
    rows = [(f"s{i % 3}/n{i:02d}.md", names[i % 40] if i % 40 < len(names) else f"note number {i}", ["ops"] if i % 2 else [], t, [], {"status": "aktiv"}) for i, t in enumerate(texts)]
    n = spark.createDataFrame(rows, "rel_path string, title string, tags array<string>, content string, out_links array<string>, frontmatter map<string,string>")
    monkeypatch.setattr(search.scratch, "written", lambda df, name: made.setdefault(name, written(df, name)))
    got = {(r["source"], r["target"]) for r in search.mentions(n, spark.createDataFrame([], "src string, dst string"), per_source=100, k=None, least=0.0).collect()}
    tokens = lambda t: {w for w in regex.findall(r"[\p{L}\p{N}_-]+", t.lower()) if len(w) >= 2}
    rare = {r["term"]: r["token"] for r in made["names"].collect()}
    stands = lambda name, t: regex.search(r"(?:^|[^\p{L}\p{N}_])" + regex.escape(name.lower()) + r"(?=$|[^\p{L}\p{N}_])", t.lower()) and rare[name] in tokens(t)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and stands(b[1], a[3])}
    assert got == want and len(want) > 100
    # a run of words is looked up, so that texts with some words of a name are not asked for it
    assert len(made["held"].select("source", "term").distinct().collect()) == made["held"].count() > 50
    assert {r["only"] for r in made["names"].filter("term LIKE 'note number%'").collect()} == {True}


def test_targets_alike_meet_groups_of_sources_as_one(spark, monkeypatch):
    rows = [(f"src/n{i:03d}.md", "Restore Plan", ["ops", "de"] if i % 2 else ["de"], "restore plan here", [], {"status": "aktiv"}) for i in range(90)]
    n = spark.createDataFrame(rows, "rel_path string, title string, tags array<string>, content string, out_links array<string>, frontmatter map<string,string>")
    made, written = {}, search.scratch.written
    monkeypatch.setattr(search.scratch, "written", lambda df, name: made.setdefault(name, written(df, name)))
    found = search.mentions(n, spark.createDataFrame([("src/n000.md", "src/n001.md")], "src string, dst string"), k=None)
    assert found.count() == 5 * 90
    assert made["targets"].filter("nth = 1").count() == 2 and made["targets"].count() == 2 * 8  # not 90: the first ones by path of each two kinds


def test_words_of_a_note_are_counted_once(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    run = duplicates.by_row
    monkeypatch.setattr(duplicates, "by_row", lambda f, *kind: run(lambda v: (calls.add(1), f(v))[1], *kind))
    n = parsed(files.generated_vault(spark, 300))
    f = duplicates.features(n)
    ids = [r["rel_path"] for r in f.orderBy("id").collect()]
    assert ids == sorted(ids) and len(set(ids)) == len(ids) == calls.value


def test_pairs_that_cannot_reach_the_points_are_left_out_early(spark):
    import random

    rng, pool = random.Random(3), [f"word{i}" for i in range(30)]
    rows = [(f"f{i % 4}/n{i:03d}.md", f"# {' '.join(rng.choices(pool, k=rng.randrange(1, 9)))}\n{' '.join(rng.choices(pool, k=20))}") for i in range(120)]
    rows += [(f"g/n{i:03d}.md", "---\ntags: [a, b, c, d]\n---\n" + rows[i][1].replace("\n", " more\n", i % 2)) for i in range(30)]
    f = duplicates.features(vault(spark, *rows))
    keys = duplicates.block_keys(f)
    every, some = duplicates.blocked_pairs(keys), duplicates.blocked_pairs(keys, 60)
    rests = lambda p: sorted(map(tuple, duplicates.rests(p, f, 60).collect()))
    assert rests(every) == rests(some) and some.count() * 2 < every.count()
    a, b = f.select(F.col("id").alias("left"), F.col("brief").alias("a")), f.select(F.col("id").alias("right"), F.col("brief").alias("b"))
    bound = every.join(a, "left").join(b, "right").select("left", "right", duplicates.nearest(F.col("a"), F.col("b")).alias("most"))
    assert duplicates.rests(every, f, 0).join(bound, ["left", "right"]).filter("rest > most").count() == 0
