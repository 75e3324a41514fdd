"""The whole pipeline on odd rows, and a conversation that has the control's number already."""

import corpus_pipeline
import pytest
from tideline.llm import chat

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, row_id long, row string"


def _tables(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "the very passage that nobody may train on at all ever"), (2, None), (None, "x y z u v"), (3, "short one")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return f"file://{folder}"


def test_the_pipeline_on_odd_rows(spark, tmp_path):
    say = lambda n, salt: " ".join(f"w{salt}x{i}" for i in range(n))
    rows = [
        (1, say(30, 1), "en", "a", 1, "s", 1, "r"), (1, say(30, 1), "en", "a", 1, "s", 1, "r"), (None, say(30, 2), None, None, None, None, None, None), (None, say(30, 2), None, None, None, None, None, None),
        (2, None, "en", "a", 0, "s", 2, "r"), (3, "", "en", "b", 0, "s", 3, "r"), (4, say(20_000, 4), "en", "b", 1, "s", 4, "r"), (5, say(9, 5) + " the very passage that nobody may train on at all ever " + say(9, 6), "en", "b", 1, "s", 5, "r"),
        (6, "Short one!", "en", "c", 1, "s", 6, "r"), (7, say(40, 7), "en", "c", 1, "s", 7, "r"), (7, say(40, 8), "en", "c", 1, "s", 7, "r"),
    ]
    out = corpus_pipeline.run(spark, _tables(spark, tmp_path / "in", rows))
    got = out.collect()
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    texts = [r.text for r in got]
    assert {say(30, 1), say(30, 2), say(20_000, 4), say(40, 7), say(40, 8)} >= set(texts) and not any("nobody may train" in (t or "") or t == "Short one!" for t in texts)
    assert all(texts.count(t) <= 2 for t in texts) and len(got) >= 3
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_the_pipeline_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, _tables(spark, tmp_path / "in", [])).collect() == []


@pytest.mark.parametrize("rows", [[], [(-1, 0, "user", "mine."), (-1, None, None, None), (3, 0, "user", "hello.")]])
def test_a_given_control_conversation(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, more string")
    got = chat.with_control_conversation(df).collect()
    control = [r for r in got if r.conv_id == -1 and r.text and chat.START in r.text]
    assert len(got) == len(rows) + 2 and [(r.turn, r.role) for r in control] == [(0, "user"), (1, "assistant")] and got[0].__fields__ == ["conv_id", "turn", "role", "text"]
