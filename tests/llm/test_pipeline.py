"""The corpus pipeline stage by stage against brute force, and whole."""

import re

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from test_filters import brute_components
from test_shapes import brute_targets, words_of
from tideline.llm import toxicity

SF = "/root/testdata/sf0.001"


def plain(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    (_, toxic), (_, near), (_, clean), (_, mix), (_, deal) = pipeline.STAGES
    ids = lambda df: sorted(r.doc_id for r in df.collect())

    one = toxic(spark, docs, SF).cache()
    assert one.columns == docs.columns
    assert ids(one) == ids(toxicity.score_toxicity(docs, labels).where("predicted = 0"))
    two = near(spark, one, SF).cache()
    groups = brute_components([(r.doc_id, r.text) for r in one.collect()], 5)
    assert ids(two) == sorted(d for d, (_, c) in groups.items() if c == d)
    three = clean(spark, two, SF).cache()
    spaced = [f" {' '.join(i)} " for i in items]
    held = {r.doc_id for r in two.collect() if any(i in f" {' '.join(plain(r.text))} " for i in spaced)}
    assert ids(three) == [d for d in ids(two) if d not in held]
    four = mix(spark, three, SF).cache()
    assert four.columns == docs.columns
    sizes, taken, size_of = {}, {}, {}
    for r in three.collect():
        size_of[r.doc_id] = len(words_of(r.text))
        sizes[r.source] = sizes.get(r.source, 0) + size_of[r.doc_id]
    for r in four.collect():
        taken[r.source] = taken.get(r.source, 0) + size_of[r.doc_id]
    most = max(size_of.values())
    assert all(abs(taken.get(s, 0) - t) <= most for s, t in brute_targets(sizes).items())
    assert four.groupBy("doc_id").count().where("count > 2").count() == 0
    five = deal(spark, four, SF)
    counts = [r["count"] for r in five.groupBy("shard").count().collect()]
    assert five.count() == four.count() and max(counts) - min(counts) <= 1


def test_the_whole_run_gives_the_same_rows_again(spark):
    rows = lambda: sorted((r.doc_id, r.shard, r.slot) for r in pipeline.run(spark, SF).select("doc_id", "shard", F.col("slot")).collect())
    assert rows() == rows() != []
