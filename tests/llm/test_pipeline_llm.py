import struct

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_pack_what_is_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90_001, "123 !!!", "en", "s", 7), (90_002, None, None, None, None), (90_003, docs.filter("doc_id = 3").first()["text"], "fr", "s", 1)], docs.schema)
    docs = docs.union(extra)
    kept = {}
    for name, stage in pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == list(pipeline.COLUMNS)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not {90_001, 90_002} & set(kept["language"]) and 90_003 in kept["language"]
    assert 90_003 not in kept["near_dedup"] and 3 in kept["near_dedup"]
    assert all(len(t) <= len(kept["near_dedup"][k]) for k, t in kept["repeats"].items())
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in t for t in kept["decontamination"].values() for i in items)
    assert len(kept["decontamination"]) > 0.6 * len(kept["language"])
    pieces = pipeline.STAGES[4][1](spark, docs, SF).collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in pieces:
        got.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    assert set(got) == set(kept["decontamination"])
    for k, text in kept["decontamination"].items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert b"".join(x for _, x in sorted(got[k])) == struct.pack(f"<{len(ids)}I", *ids)


def test_null_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    word = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(None, word("a")), (None, word("a")), (None, word("b")), (5, word("c")), (5, word("c")), (5, word("d")), (4, word("d")), (6, None), (6, None), (None, ""), (None, "")]
    table = lambda rows: spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], docs.select(*pipeline.COLUMNS).schema)
    near, cut, clean = (stage for _, stage in pipeline.STAGES[1:4])
    told = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    rest = [(6, None), (6, None), (None, ""), (None, "")]
    assert told(near(spark, table(rows), SF)) == sorted([(None, word("a")), (None, word("b")), (5, word("c")), (4, word("d")), *rest], key=str)
    assert told(cut(spark, table([*rows[:5], *rest, (None, "short"), (None, "short")]), SF)) == sorted([(None, word("a")), (None, word("b")), (5, word("c")), (6, ""), (6, ""), *rest[2:], (None, "short"), (None, "short")], key=str)  # null counts as empty
    leaking = word("e") + " " + item
    assert told(clean(spark, table([(None, leaking), (None, word("a")), (5, leaking), (5, word("c")), *rest]), SF)) == sorted([(None, word("a")), (5, word("c")), *rest], key=str)


def test_language_stage_takes_effect_and_stages_bear_empty_and_clashing_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wrong = docs.filter("lang = 'de'").limit(1).select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    out = pipeline.language_stage(spark, docs.join(wrong.select("doc_id"), "doc_id", "left_anti").select(*pipeline.COLUMNS).union(wrong), SF)
    assert out.filter(F.col("doc_id") == wrong.first()["doc_id"]).first()["lang"] == "de"
    clash = docs.limit(40).withColumns({c: F.lit("x") for c in ("row", "key", "hash", "rank", "lang_pred", "score", "gone", "_id", "mark", "kept", "component")})
    before, empty = clash, clash.limit(0)
    for _, stage in pipeline.STAGES:
        before, empty = stage(spark, before, SF), stage(spark, empty, SF)
        assert before.columns == empty.columns and empty.count() == 0 and before.count() > 20


def test_near_dedup_and_decontamination_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*pipeline.COLUMNS)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())

    def shingled(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {k: shingled(t) for k, t in rows}
    top = {k: k for k in sets}
    for i, (a, _) in enumerate(rows):
        for b, _ in rows[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((top[a], top[b]))
                top = {k: low if v == high else v for k, v in top.items()}
    assert sorted(r["doc_id"] for r in pipeline.near_dedup_stage(spark, docs, SF).collect()) == sorted(k for k in top if top[k] == k)
