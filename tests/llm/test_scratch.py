"""Scratch tables: each call owns and drops its own, whatever others do beside it."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from tideline.llm import contamination, minhash, mixing, queries, scratch

SF = "/root/testdata/sf0.001"


def folders(spark):
    top = f"{scratch.shared_folder(spark).removeprefix('file://')}/tideline"
    return {f"{top}/{d}" for d in os.listdir(top)} if os.path.isdir(top) else set()


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_two_operators_at_once(spark):
    alone = [sorted(queries.QUERIES[n](spark, SF).collect()) for n in ("op10_near_duplicates", "op2_mixing")]
    with ThreadPoolExecutor(2) as pool:
        for _ in range(2):
            jobs = [pool.submit(lambda n=n: sorted(queries.QUERIES[n](spark, SF).collect())) for n in ("op10_near_duplicates", "op2_mixing")]
            assert [j.result() for j in jobs] == alone
    assert spark.conf.get(scratch._CLEANUP) == "false" and not scratch._held


def test_an_unread_result_survives_what_comes_after(spark):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    first = minhash.drop_near_duplicates(documents(spark))
    other = scratch.materialize(documents(spark).limit(7), "other")
    second = contamination.decontaminate(documents(spark), benchmark)
    mixed = mixing.mixed_words(documents(spark))
    assert other.count() == 7 and first.count() > 0 and second.count() > 0 and mixed.count() == documents(spark).count()
    own, kept = scratch.numbered(documents(spark)), scratch.materialize(documents(spark).limit(3), "kept")
    scratch.drop(own)
    assert kept.count() == 3


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_a_query_leaves_one_folder(spark, name):
    before = folders(spark)
    rows = queries.QUERIES[name](spark, SF).count()
    left = folders(spark) - before
    assert len(left) == 1 and rows >= 0, left


def test_a_scope_drops_its_tables_on_errors(spark):
    before = folders(spark)
    with pytest.raises(ValueError), scratch.scope() as own:
        own.keep(scratch.materialize(documents(spark).limit(1), "kept"))
        scratch.materialize(documents(spark).limit(1), "gone")
        raise ValueError
    assert {os.path.basename(p).split("-")[0] for p in folders(spark) - before} == {"kept"}
