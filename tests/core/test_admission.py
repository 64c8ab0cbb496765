import random

from lorewell.plans import admission as ad


def plain_admitted(items, budget):
    out, used = set(), {}
    for run, place, n in sorted(items):
        if n <= 0:
            out.add((run, place))
        elif used.get(run, 0) + n <= budget:
            used[run] = used.get(run, 0) + n
            out.add((run, place))
    return out


def test_budget_equals_a_plain_loop(spark):
    rng = random.Random(1)
    items = [(run, place, rng.choice([0, 1, 1, 2, 3, 5, 9])) for run in range(12) for place in rng.sample(range(100), rng.randint(0, 25))]
    df = spark.createDataFrame(items, "run long, place long, notes long")
    for budget in (0, 4, 7):
        assert {tuple(r) for r in ad.admitted(df, budget).collect()} == plain_admitted(items, budget)
    assert ad.admitted(df.limit(0), 5).collect() == []


def test_likeness_equals_all_pairs(spark):
    rng = random.Random(2)
    pool = [f"word{i}" for i in range(30)]
    make = lambda: sorted(rng.sample(pool, rng.randint(1, 12)))
    left = [(i, rng.choice("ab"), make()) for i in range(80)]
    right = [(rng.choice("ab"), make()) for _ in range(80)] + [("a", left[0][2][:-1] + ["other"]), ("b", left[1][2])]
    want = {k for k, s, w in left if any(s == t and len(set(w) & set(v)) / max(len(w), len(v)) >= 0.6 for t, v in right)}
    got = ad.alike(spark.createDataFrame(left, "key long, scope string, words array<string>"), spark.createDataFrame(right, "scope string, words array<string>"), 0.6)
    assert {r["key"] for r in got.collect()} == want and len(want) > 5


def test_plan_tells_every_reason(spark):
    long = "a sentence that is long enough to pass every gate there is for new knowledge"
    items = [("s1", 0, "save_insight", "T", "ok", 1), ("s1", 1, "save_insight", "T", long, 2), ("s1", 2, "save_insight", "K", long.replace("sentence", "paragraph"), 2), ("s1", 3, "flag_knowledge_gap", "Wissenslücke: Was ist DNS?", long, 1),
             ("s1", 4, "save_answer", "Q", long + " and more", 1), ("s1", 5, "extract_claims", "C", long + " with quite different words than all the other ones here", 3), ("s1", 6, "save_insight", "Z", "other " * 30, 0), ("s2", 0, "save_insight", "T", long, 1), ("s3", 0, "save_insight", "N", None, 1)]
    df = spark.createDataFrame(items, "run string, place long, action string, title string, content string, notes long")
    sources = spark.createDataFrame([("s1", "h1"), ("s2", "h2"), ("s3", "h3")], "run string, hash string")
    manifest = spark.createDataFrame([("s2", "h2", False, ["x.md"]), ("s3", "old", False, ["a.md", "a.md", "b.md"]), ("s1", "h1", True, [])], "run string, hash string, archived boolean, artifacts array<string>")
    known = spark.createDataFrame([("Knowledge/Insights/k.md", "other", "nothing alike", "K", None), ("Knowledge/Gaps/g.md", "was ist dns", "", None, "open"), ("Knowledge/Answers/a.md", "Q", long + " and more", None, None), ("x.md", "T", long, None, None)], "path string, title string, content string, quelle string, status string")
    feedback = spark.createDataFrame([("extract_claims", "rejected")] * 3 + [("save_insight", "accepted")] * 2 + [("save_insight", "snoozed")], "action string, outcome string")
    got = {(r["run"], r["place"], r["title"]): (r["decision"], r["reason"]) for r in ad.admission_plan(df, sources, manifest, known, feedback, 2).collect()}
    assert got == {
        ("s1", 0, "T"): ("skip", "too short"), ("s1", 1, "T"): ("admit", "passed"), ("s1", 2, "K"): ("skip", "known already"), ("s1", 3, "Wissenslücke: Was ist DNS?"): ("skip", "known already"), ("s1", 4, "Q"): ("skip", "known already"),
        ("s1", 5, "C"): ("skip", "shut by feedback"), ("s1", 6, "Z"): ("admit", "passed"), ("s2", None, None): ("unchanged", "same hash"), ("s3", None, "a.md"): ("archive", "superseded"), ("s3", None, "b.md"): ("archive", "superseded"), ("s3", 0, "N"): ("skip", "too short"),
    }
    strict = {r["action"]: (r["strict"], r["shut"], r["usefulness"]) for r in ad.gates(feedback).collect()}
    assert strict == {"extract_claims": (True, True, 0.0), "save_insight": (False, False, 1.0)}


def test_likeness_of_repeated_sets_is_judged_once(spark, monkeypatch):
    sizes, written = [], ad.scratch.written
    monkeypatch.setattr(ad.scratch, "written", lambda df, name: (sizes.append(df.count()) if name == "sets" else None) or written(df, name))
    line, other = [f"w{i}" for i in range(40)], [f"v{i}" for i in range(40)]
    left = spark.createDataFrame([(i, "s", line[::-1] if i % 2 else line) for i in range(50)] + [(99, "s", other)], "key long, scope string, words array<string>")
    right = spark.createDataFrame([("s", line[:35]), ("s", line[:35][::-1]), ("t", other)], "scope string, words array<string>")
    assert sorted(r[0] for r in ad.alike(left, right).collect()) == list(range(50))
    assert sizes == [2, 2]
