"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, no rows, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimgraph.llm import fertility, fingerprint, kneser_ney, license_scan, mixing, near_dedup, preferences, runtime, secret_scan, sentencepieces, toxicity

KEY = "aK3x9QpLm2Zr8Tv5Wn1Yb7"
# Names that the operators use themselves.
CLASHES = ["copies", "copy", "toxic_score", "redacted", "n", "score", "path", "sketch", "short", "rep", "keeper_id", "mix_id", "mix_source", "_id", "_copies", "count", "part", "key", "h", "node"]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def long_text(words: int = 60_000) -> str:
    r = random.Random(1)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(words))


LONG = long_text()
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog today", "en", "web"),
    (2, "the quick brown fox jumps over the lazy dog today", "en", "web"),
    (3, "", "en", "web"), (4, None, None, None), (None, "no id here at all but words", "en", "web"),
    (5, "... --- !!!", None, "book"), (6, "single", "de", "book"), (7, f"key {KEY} end", "de", None),
    (7, f"key {KEY} end", "de", None), (8, LONG, "en", "book"), (9, "漢字 и кириллица 😀\n\n  two  spaces ", None, "web"),
    (None, None, None, None), (10, "a\x00b\tc\r\nd", "en", "web"),
]


def wide(df):
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})


@pytest.fixture(scope="module")
def docs(spark):
    return wide(spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 0), (6, 1, 0), (None, 1, 1), (2, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def no_labels(labels):
    return labels.limit(0)


def ids(df, column="doc_id"):
    return sorted((r[0] for r in df.select(column).collect()), key=repr)


ALL_IDS = sorted((r[0] for r in ROWS), key=repr)


def test_license(docs, empty, spark):
    assert license_scan.license_scan(docs).count() == license_scan.license_scan(empty).count() == 0
    text = "x\nReleased under the MIT License.\n" + LONG + "\nreleased under the mit license"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    got = [tuple(r) for r in license_scan.license_scan(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, "mit", "mit", 1, 5, 1.0), (1, "mit", "mit", 1, 5, 1.0), (None, "mit", "mit", 1, 5, 1.0)], key=repr)
    assert license_scan.license_scan(df, templates={}).count() == 0


def test_pieces(docs, empty):
    got = sentencepieces.encode(docs)
    assert ids(got) == ALL_IDS
    rows = got.collect()
    assert [r["lossless"] for r in rows if r["pieces"] is not None] == [True] * 11
    assert all(r["n_pieces"] is None and r["lossless"] is None for r in rows if r["pieces"] is None)
    assert [r["n_pieces"] for r in rows if r["doc_id"] == 3] == [0]
    seven = [r["pieces"] for r in rows if r["doc_id"] == 7]
    assert seven[0] == seven[1]
    back = sorted((tuple(r) for r in sentencepieces.decode(got).collect()), key=repr)
    assert back == sorted(((r[0], r[1]) for r in ROWS), key=repr)
    assert sentencepieces.encode(empty).count() == sentencepieces.decode(sentencepieces.encode(empty)).count() == 0


def test_toxicity(docs, empty, labels, no_labels):
    for k in (labels, no_labels):
        got = toxicity.toxicity(docs, k)
        assert ids(got) == ALL_IDS and got.where("is_toxic").count() == 0
        assert toxicity.toxicity(empty, k).count() == 0
        kept = toxicity.drop_toxic(docs, k)
        assert kept.columns == docs.columns and ids(kept) == ALL_IDS
    assert toxicity.drop_toxic(empty, labels).count() == 0


def test_near_duplicates(docs, empty):
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(docs).collect()) == [(2, 1)]
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    expected = [i for i in ALL_IDS if i != 2]
    expected.remove(7)  # of repeated rows one stays
    assert ids(kept) == expected
    assert near_dedup.near_duplicates(empty).count() == near_dedup.drop_near_duplicates(empty).count() == 0


def test_mixing(docs, empty):
    got = [tuple(r) for r in mixing.mix_counts(docs).collect()]
    assert sorted((g[:2] for g in got), key=repr) == sorted({(r[0], r[3]) for r in ROWS}, key=repr)
    assert all(g[2] >= 1 for g in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(n * sum((r[0], r[3]) == (i, s) for r in ROWS) for i, s, n in got)
    assert mixing.mix_counts(empty).count() == mixing.mix(empty).count() == 0
    only = mixing.mix_counts(docs, weights={"web": 1.0, None: 2.0}).collect()
    assert all(r["copies"] == 0 for r in only if r["source"] == "book")
    assert mixing.mix(docs, weights={"nothing": 1.0}).count() == 0


def test_secrets(docs, empty):
    got = [tuple(r)[:4] for r in secret_scan.secret_scan(docs).collect()]
    assert got == [(7, 4, 4 + len(KEY), "alnum")] * 2
    masked = secret_scan.redact_secrets(docs)
    assert masked.columns == docs.columns and ids(masked) == ALL_IDS
    seven = masked.where("doc_id = 7").select("text", "n_chars").collect()
    assert [tuple(r) for r in seven] == [("key <SECRET> end", 16)] * 2
    rest = lambda d: sorted(((r[0], r[1]) for r in d.where("doc_id IS NULL OR doc_id <> 7").select("doc_id", "text").collect()), key=repr)
    assert rest(masked) == rest(docs)
    assert secret_scan.secret_scan(empty).count() == secret_scan.redact_secrets(empty).count() == 0


def test_fertility(docs, empty):
    got = fertility.fertility(docs).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == ALL_IDS
    for r in got:
        if r["doc_id"] in (3, 4):
            assert not r["keep"] and r["piece_tokens"] == 0 and r["piece_evenness"] == 1.0
    assert [r["lang"] for r in got if r["doc_id"] == 5] == ["script:none"]
    assert fertility.fertility(empty).count() == 0


def test_kneser_ney(docs, empty, labels, no_labels):
    for k in (labels, no_labels):
        got = kneser_ney.quality(docs, k).collect()
        assert sorted((r["doc_id"] for r in got), key=repr) == ALL_IDS
        assert all((r["perplexity"] is None) == (not t) for r in got for t in [dict((x[0], x[1]) for x in ROWS).get(r["doc_id"])] if r["doc_id"] is not None)
        assert kneser_ney.quality(empty, k).count() == 0


def test_fingerprints(docs, empty, spark):
    against = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog today"), (2, None), (3, "")], "item_id long, text string")
    got = fingerprint.fingerprints(docs, against).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == ALL_IDS
    by = {r["doc_id"]: r for r in got}
    assert by[1]["resemblance"] == by[2]["resemblance"] == by[1]["containment"] == 1.0
    assert by[3]["sketch"] == by[5]["sketch"] == [] and by[3]["distinct_shingles"] == 0.0 and by[6]["distinct_shingles"] == 1.0
    assert fingerprint.fingerprints(empty, against).count() == 0
    none = fingerprint.fingerprints(docs, against.limit(0))
    assert none.count() == len(ROWS) and none.where("resemblance > 0 OR containment > 0").count() == 0


def test_merged_sketches_of_little(spark):
    df = spark.createDataFrame([("a", [3, 1]), ("a", [1, 2]), ("a", None), ("b", []), (None, [5]), (None, [5])], "k string, sketch array<long>").withColumn("h", F.lit(1))
    for salted in (df, df.repartition(5)):
        got = {r["k"]: r["sketch"] for r in fingerprint.merge_sketches(salted, ["k"], k=2).collect()}
        assert got == {"a": [1, 2], "b": [], None: [5]}
    assert fingerprint.merge_sketches(df.limit(0), ["k"]).count() == 0


def test_shards_of_the_edge_table(spark, docs, labels):
    a, b = (sorted((tuple(r) for r in kneser_ney.quality(docs, labels, **o).collect()), key=repr) for o in ({}, {"broadcast_grams": 0}))
    assert [x[:2] for x in a] == [x[:2] for x in b] and [x[2] for x in b] == pytest.approx([x[2] for x in a], nan_ok=True)


def test_clashing_columns_in_the_second_table(docs, labels):
    more = labels.withColumns({c: F.lit(0) for c in ("text", "side", "lo", "hi", "q", "t", "n")})
    assert ids(toxicity.toxicity(docs, more)) == ids(kneser_ney.quality(docs, more)) == ALL_IDS
    against = docs.select(F.col("doc_id").alias("item_id"), "text", F.lit(1).alias("sketch"), F.lit(2).alias("whole"), F.lit(3).alias("h"))
    assert ids(fingerprint.fingerprints(docs, against)) == ALL_IDS


def test_ids_of_other_types_are_refused_at_once(docs):
    texts = docs.withColumn("doc_id", F.concat(F.lit("x"), F.col("doc_id")))
    for operator in (license_scan.license_scan, sentencepieces.encode, near_dedup.near_duplicates, mixing.mix_counts, secret_scan.secret_scan, fertility.fertility, fingerprint.sketches):
        with pytest.raises(TypeError, match="whole number"):
            operator(texts)
    assert license_scan.license_scan(docs.withColumn("doc_id", F.lit(None))).count() == 0


def test_nothing_is_left_in_the_shared_folder(spark, docs, labels, sf):
    from urllib.parse import urlparse
    from pathlib import Path

    at = Path(urlparse(runtime.shared_dir(spark)).path) / "claimgraph"
    at.mkdir(parents=True, exist_ok=True)
    runtime.clear(spark)
    assert not list(at.iterdir())
    every = (lambda: near_dedup.drop_near_duplicates(docs), lambda: mixing.mix(docs), lambda: kneser_ney.quality(docs, labels), lambda: fertility.fertility(docs), lambda: corpus_pipeline.run(spark, sf))
    for make in every:
        made = make()
        assert made.count() > 0
        tables = sorted(p.name.split("-")[0] for p in at.iterdir())
        assert len(tables) <= 3, tables  # what the result itself is read from
        runtime.clear(spark)
        assert not list(at.iterdir())


def test_preferences(spark):
    conv = spark.createDataFrame(
        [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (1, 0, "user", "hi"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, None, None, None), (3, 0, "assistant", ""), (2, 1, "assistant", LONG), (None, 0, "user", "x"), (4, 0, "user", "alone"), (6, 0, "assistant", "same"), (7, 0, "assistant", "same")],
        "conv_id long, turn long, role string, text string",
    ).withColumns({"n": F.lit(1), "chosen": F.lit("x"), "turns": F.lit(2)})
    rows = preferences.format_preferences(preferences.mismatched_replies(conv)).collect()
    got = {r["conv_id"]: r for r in rows}
    assert set(got) == {0, 1, 2, 3, 7} and len(rows) == 5  # 6 is followed by an equal reply, 4 has none
    assert got[0]["prompt"] == "<|user|>\nhi<|end|>\n" and got[0]["chosen"] == "<|assistant|>\na<|end|>\n" and got[0]["rejected"] == "<|assistant|>\nb<|end|>\n"
    start, end = map(int, got[0]["chosen_mask"].split("-"))
    assert got[0]["chosen"][start:end] == "a<|end|>" and got[7]["rejected"] == "<|assistant|>\na<|end|>\n"
    assert LONG in got[2]["chosen"] and LONG in got[1]["rejected"] and got[2]["prompt"] == "<|unknown|>\n<|end|>\n"
    assert preferences.format_preferences(preferences.mismatched_replies(conv.limit(0))).count() == 0
    turn = "array<struct<role: string, text: string>>"
    pairs = spark.createDataFrame([(None, [], [("assistant", "x")]), (1, None, None), (2, [("user", None)], [("user", None)])], f"conv_id long, chosen {turn}, rejected {turn}")
    assert [(r["conv_id"], r["n_common"], r["chosen"]) for r in preferences.format_preferences(pairs).collect()] == [(None, 0, "")]
    nulls = spark.createDataFrame([(1, [("user", "q"), ("assistant", None)], [("user", "q"), None, (None, "r")])], f"conv_id long, chosen {turn}, rejected {turn}")
    r = preferences.format_preferences(nulls).first()
    assert (r["prompt"], r["chosen"], r["rejected"]) == ("<|user|>\nq<|end|>\n", "<|assistant|>\n<|end|>\n", "<|unknown|>\n<|end|>\n<|unknown|>\nr<|end|>\n")
    assert r["chosen_mask"] == "14-21" and r["chosen"][14:21] == "<|end|>" and r["rejected_mask"] == ""


def test_every_stage(spark, docs, empty, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    base = docs.select(COLUMNS)
    for given in (base, base.limit(0), docs):
        d = given
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            d = stage(spark, d, str(tmp_path))
            if i < 4:
                assert d.columns == given.columns
        assert (d.count() == 0) == given.isEmpty()


def test_whole_pipeline_of_nothing(spark, empty, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    empty.select(COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
