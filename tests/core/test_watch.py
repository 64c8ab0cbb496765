import random

from pyspark.sql import functions as F

from lorewell.operators import link_updates, links
from lorewell.sources.tables import parsed
from lorewell.streaming import watch

RAW = "rel_path string, raw string, last_modified timestamp_ntz"


def raw(rng, names):
    kinds = [lambda n: n, lambda n: n.upper(), lambda n: f"dir/{n}", lambda n: f"{n}.md", lambda n: f"other/{n}.md"]
    return "---\ntags: [a]\n---\n# T\n" + " ".join(f"[[{rng.choice(kinds)(rng.choice(names))}]]" for _ in range(rng.randint(0, 5)))


def rebuilt(spark, vault):
    n = parsed(spark.createDataFrame([(p, t, None) for p, t in vault.items()], RAW))
    return sorted(map(tuple, links.resolved(links.link_texts(n), n).select("src", "ord", "target", "dst").collect()), key=str)


def plain(l):
    return sorted(map(tuple, l.select("src", "ord", "target", "dst").collect()), key=str)


def batch(rng, vault, names):
    """Changes of a vault, which they are applied to."""
    out = []
    for path in rng.sample(sorted(vault), min(len(vault), 3)):
        text = None if rng.random() < 0.5 else raw(rng, names)
        out.append((path, text))
    for _ in range(3):
        out.append((rng.choice(["", "dir/", "other/", "aa/"]) + rng.choice([rng.choice(names), rng.choice(names).upper()]) + ".md", raw(rng, names)))
    out = list(dict(out).items())
    for path, text in out:
        if text is None:
            vault.pop(path, None)
        else:
            vault[path] = text
    return out


def test_updates_equal_a_rebuild(spark):
    rng = random.Random(1)
    names = [f"n{i}" for i in range(12)]
    vault = {}
    batch(rng, vault, names)
    batch(rng, vault, names)
    n = parsed(spark.createDataFrame([(p, t, None) for p, t in vault.items()], RAW))
    l = links.resolved(links.link_texts(n), n)
    for _ in range(4):
        changes = batch(rng, vault, names)
        up = parsed(spark.createDataFrame([(p, t, None) for p, t in changes if t is not None], RAW))
        down = spark.createDataFrame([(p,) for p, t in changes if t is None] + [("never/was.md",), (None,)], "rel_path string")
        n, l = link_updates.updated(n, l, up, down)
        n, l = spark.createDataFrame(n.collect(), n.schema), spark.createDataFrame(l.collect(), "src string, ord int, target string, dst string")
        assert plain(l) == rebuilt(spark, vault)
        assert {r["rel_path"] for r in n.select("rel_path").collect()} == set(vault)


def test_a_batch_touches_what_it_must_only(spark):
    vault = {f"d/n{i}.md": f"# T\n[[n{i + 1}]] [[x{i}]]" for i in range(300)}
    n = parsed(spark.createDataFrame([(p, t, None) for p, t in vault.items()], RAW))
    l = links.resolved(links.link_texts(n), n)
    up = parsed(spark.createDataFrame([("new/X7.md", "# New\n[[n3]]", None)], RAW))
    after, new, gone = link_updates.changed_notes(n, up, spark.createDataFrame([("d/n9.md",)], "rel_path string"))
    delta = {(r["src"], r["ord"]): (r["target"], r["dst"], r["gone"]) for r in link_updates.link_delta(n, l, after, new, gone).collect()}
    assert delta == {("new/X7.md", 0): ("n3", "d/n3.md", False), ("d/n7.md", 1): ("x7", "new/X7.md", False), ("d/n8.md", 0): ("n9", None, False), ("d/n9.md", 0): (None, None, True), ("d/n9.md", 1): (None, None, True)}


def test_a_watched_vault(spark, tmp_path):
    rng = random.Random(2)
    names = [f"n{i}" for i in range(10)]
    vault, root = {}, f"file://{tmp_path}/index"
    for k in range(4):
        changes = batch(rng, vault, names)
        rows = [(p, t, f"2024-06-01 00:00:0{k}") for p, t in changes]
        spark.createDataFrame(rows, "rel_path string, raw string, at string").select("rel_path", "raw", F.col("at").cast("timestamp_ntz").alias("last_modified")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(watch.CHANGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        watch.watched(stream, root, str(tmp_path / "check")).awaitTermination()
        assert plain(watch.current(spark, root, "links")) == rebuilt(spark, vault)
        assert {r[0]: r[1] for r in watch.current(spark, root, "notes").select("rel_path", F.size("out_links")).collect()} == {p: len(parsed_links(t)) for p, t in vault.items()}
        if k == 1:
            watch.compact(spark, root)
            assert plain(watch.current(spark, root, "links")) == rebuilt(spark, vault)
        if k == 2:  # a batch that is run again
            df = spark.read.schema(watch.CHANGE).parquet(str(tmp_path / "in")).filter(F.col("last_modified") == "2024-06-01 00:00:02")
            watch.apply_batch(df, root, k)
            assert plain(watch.current(spark, root, "links")) == rebuilt(spark, vault)


def parsed_links(text):
    import re

    return re.findall(r"\[\[([^\]]+)\]\]", text)
