"""Texts made to collide, budgets counted by the tokenizer, lost attempts, walks by hand, recall, hubs, pairs of terms, scratch tables."""

import bisect
import hashlib
import random
import shutil

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_filters import brute_components, brute_statistics, odd_docs, rand_text
from tideline.llm import chat, contamination, minhash, quality, scratch, sharding, tokens, toxicity, warc
from tideline.llm import text_kernel as kernel
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def thue_morse(n, zero, one):
    s = [0]
    while len(s) < n:
        s += [1 - x for x in s]
    return "".join(one if x else zero for x in s[:n])


PAIRS = [(thue_morse(n, "e", "t"), thue_morse(n, "t", "e")) for n in (512, 1024, 2048, 8192)]


# ------------------------------------------------------------------ texts made to collide


@pytest.mark.parametrize("a, b", PAIRS)
def test_thue_morse_words_differ(a, b):
    data = np.frombuffer(f"{a} {b} {a}".encode(), np.uint8)
    for seed in (0, 1):
        alphabet = kernel.alphabet(kernel.ASCII_SPACE, fold_case=True)
        w = kernel.words(data, np.array([0, len(data)]), alphabet)
        h = kernel.span_hashes(data, w.start, w.end, alphabet, seed)
        assert h[0] == h[2] != h[1]


def test_spans_hash_alike_wherever_blocks_end(monkeypatch):
    rng = random.Random(1)
    data = np.frombuffer(" ".join("".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 40]))) for _ in range(400)).encode(), np.uint8)
    alphabet = kernel.alphabet(kernel.ASCII_SPACE, fold_case=False)
    whole = kernel.words(data, np.array([0, len(data)]), alphabet)
    monkeypatch.setattr(kernel, "_BLOCK", 7)
    cut = kernel.words(data, np.array([0, len(data)]), alphabet)
    text = data.tobytes()
    assert (whole.hash == cut.hash).all() and len(set(whole.hash.tolist())) == len({text[s:e] for s, e in zip(whole.start, whole.end, strict=True)})


def test_colliding_texts_are_counted_and_linked_apart(spark):
    lib = Tokenizer.from_file(PATH)
    texts = [t for pair in PAIRS for t in pair] + [f"{a}\n{b}" for a, b in PAIRS] + [f"{a} {b} {a} {b}" for a, b in PAIRS]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in tokens.prefix_answers(tokens.store_prefix_counts(docs, PATH), 1024).collect():
        assert r.n_tokens == len(lib.encode(texts[r.doc_id]).ids) and r.over_limit == (r.n_tokens > 1024)
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, shingle_words=4).collect()}
    assert near == brute_components(list(enumerate(texts)), 4)
    stats = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.text_statistics(docs).collect()}
    assert stats == {i: brute_statistics(t) for i, t in enumerate(texts)}


def test_equal_hashes_of_one_kind_are_told_apart():
    keys, docs = np.array([5, 5, 5, 7, 5], np.uint64), np.array([0, 0, 0, 0, 1])
    others = np.array([1, 2, 1, 1, 1], np.uint64)
    any_, later = quality._repeated(keys, others, docs)
    assert any_.tolist() == [True, False, True, False, False] and later.tolist() == [False, False, True, False, False]
    points = np.array([97, 98, 97, 99, 97, 98])
    first, back = tokens._alike(points, np.array([0, 2, 4]), np.array([2, 4, 6]), np.array([1, 1, 1], np.uint64))
    assert back.tolist() == [0, 1, 0] and first.tolist() == [0, 1]


# ------------------------------------------------------------------ token counts


def test_answers_from_stored_prefixes(spark):
    lib, rng = Tokenizer.from_file(PATH), random.Random(2)
    parts = ["Hello", " world", "  ", "\n", "é", "中文", "😀", "<|endoftext|>", "don't", "=" * 40]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(120)] + ["", "a b c " * 3000]
    docs = odd_docs(spark, [(100 + i, t, "s", 0, "x") for i, t in enumerate(texts)])
    stored = tokens.store_prefix_counts(docs, PATH)
    got = tokens.prefix_answers(stored, 20).collect()
    assert len(got) == docs.count() and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    for r in got:
        if r.doc_id and r.doc_id >= 100 and r.doc_id < 100 + len(texts) - 1:
            t = texts[r.doc_id - 100]
            assert r.n_tokens == count(t) and r.n_chars == len(t) and r.over_limit == (r.n_tokens > 20)
            assert r.fitting_chars == max((k + 1 for k in range(len(t)) if count(t[: k + 1]) <= 20), default=0)
    assert tokens.prefix_answers(tokens.store_prefix_counts(docs.limit(0), PATH), 5).count() == 0


# ------------------------------------------------------------------ chat windows


@pytest.mark.parametrize("budget", [90, 1024])
def test_every_window_is_within_the_budget_by_the_tokenizer(spark, budget):
    lib, rng, rows = Tokenizer.from_file(PATH), random.Random(3), []
    for t in range(200):
        rows.append((1, t, "user" if t % 2 else "assistant", "hello there friend"))
        rows.append((2, t, ["user", "assistant", "x" * 300, "two\nlines"][t % 4], rand_text(rng, rng.randrange(0, 60))))
        rows.append((3, t, "system" if t == 0 else "assistant", rng.choice(["", " ", "\n\n", "<|im_end|>", "<|endoftext|>", "é 中文"])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seen = 0
    for w in chat.format_windows(df, PATH, budget=budget, history_tokens=budget // 3).collect():
        n = len(lib.encode(w.formatted, add_special_tokens=False).ids)
        own = [s for s in w.turns if not s["repeated"]]
        assert n == w.tokens and (n <= budget or len(own) == 1)
        if n > budget:  # a turn that is too long on its own has the system turn at most beside it
            assert all(s["at"] == 0 for s in w.turns if s["repeated"])
        seen += len(own)
    assert seen == len(rows)


def test_windows_hold_as_many_turns_as_fit(spark):
    df = spark.createDataFrame([(1, t, "user", "word " * 10) for t in range(60)], "conv_id long, turn long, role string, text string")
    windows = sorted(chat.format_windows(df, PATH, budget=300, history_turns=0).collect(), key=lambda w: w.window)
    one = {round(w.tokens / len(w.turns)) for w in windows}
    assert len(one) == 1 and all(w.tokens + min(one) > 300 for w in windows[:-1])


# ------------------------------------------------------------------ WARC


def pages_of(spark, n=300, page=lambda i: i):
    rng = random.Random(4)
    return spark.createDataFrame([(page(i), f"http://a.org/{i}", rand_text(rng, rng.randrange(1, 300))) for i in range(n)], "page_id long, url string, html string")


def test_an_attempt_that_dies_leaves_no_trace(spark, tmp_path, monkeypatch):
    pages, folder = pages_of(spark), f"file://{tmp_path}/a"
    whole = warc.write_warc(pages, folder, shard_bytes=60_000, roll_bytes=15_000)
    before = sorted(map(tuple, whole.collect()))
    write = warc._writer(f"file://{tmp_path}/b", 15_000)
    (tmp_path / "b" / "_attempts").mkdir(parents=True)
    ready = pages.select("page_id", F.lit("x").alias("digest"), F.lit(0).alias("shard"), F.lit(0).alias("kind"), F.lit(1).alias("owner"), F.lit(False).alias("repeats"), "url", F.lit(None).cast("binary").alias("payload"))
    import pyarrow as pa

    lost = pa.RecordBatch.from_pylist([{**r.asDict(), "kind": k, "payload": b"lost", "page_id": 1} for r in ready.limit(1).collect() for k in (0, 1)])
    with pytest.raises(ValueError):  # an attempt that wrote a file and dies before its list is committed
        list(write(iter([lost, lost.set_column(lost.schema.get_field_index("digest"), "digest", pa.array(["y", "y"])).slice(1)])))
    again = warc.write_warc(pages, f"file://{tmp_path}/b", shard_bytes=60_000, roll_bytes=15_000)
    assert sorted(map(tuple, again.collect())) == before
    assert {p.name for p in (tmp_path / "b").iterdir()} == {p.name for p in (tmp_path / "a").iterdir()}
    assert warc.read_warc(again, f"file://{tmp_path}/b").count() == 300


def test_publishing_can_be_run_again_at_any_point(spark, tmp_path):
    import pyarrow as pa

    (tmp_path / "_attempts").mkdir()
    for name in ("one", "two"):
        (tmp_path / "_attempts" / f"{name}.tmp").write_bytes(b"123")
    rows = pa.RecordBatch.from_pylist([{"temporary": f"_attempts/{n}.tmp", "file": n, "shard": 0, "part": 0, "records": 1, "bytes": 3, "sha256": "x"} for n in ("one", "two")])
    publish = warc._publisher(f"file://{tmp_path}")
    list(publish(iter([rows.slice(0, 1)])))  # the first attempt ends after one file
    list(publish(iter([rows])))
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_file()) == ["one", "two"]
    (tmp_path / "two").unlink()
    with pytest.raises(ValueError, match="lost"):
        list(publish(iter([rows])))


def test_the_reader_holds_files_against_the_manifest(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    manifest = warc.write_warc(pages_of(spark), folder, shard_bytes=60_000, roll_bytes=15_000)
    first, second = sorted(r.file for r in manifest.collect())[:2]
    shutil.copy(tmp_path / "a" / first, tmp_path / "a" / second)  # whole records, but not those of this file
    with pytest.raises(Exception, match="not the file that the manifest lists"):
        warc.read_warc(manifest, folder).count()


@pytest.mark.parametrize("page", [lambda i: None, lambda i: 7, lambda i: i if i % 3 else None])
def test_pages_under_one_id_are_shared_out(spark, tmp_path, page):
    pages = pages_of(spark, page=page)
    manifest = warc.write_warc(pages, f"file://{tmp_path}/a", shard_bytes=30_000)
    sizes = [r.records for r in manifest.collect()]
    assert len(sizes) > 5 and max(sizes) < 100 and sum(sizes) == 300
    found = warc.read_warc(manifest, f"file://{tmp_path}/a")
    assert found.rdd.getNumPartitions() >= 1 and found.where("record_type = 'response'").count() == 300


# ------------------------------------------------------------------ sharding


def walk(docs, shards):
    """Shard and slot of each document, the ring walked by hand."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    points = sorted((int(md5(f"point {s} {r}")[:4], 16), md5(f"point {s} {r}"), s) for s in range(shards) for r in range(sharding.VIRTUAL))
    cells, owner = [p[0] for p in points], [p[2] for p in points]
    rows = sorted((md5(str(d)), d) for d in docs)
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    arc_of = {d: bisect.bisect_left(cells, int(h[:4], 16)) for h, d in rows}
    at, placed = {d: (a, 0) for d, a in arc_of.items()}, {}
    left = []
    for _, d in rows:  # each shard first takes its own, in the order of its arcs
        s = owner[arc_of[d] % len(points)]
        if room[s]:
            room[s], placed[d] = room[s] - 1, s
        else:
            left.append(d)
    for d in left:  # the rest go on clockwise
        step = 1
        while not room[s := owner[(arc_of[d] + step) % len(points)]]:
            step += 1
        room[s], placed[d], at[d] = room[s] - 1, s, (arc_of[d], step)
    order = {d: i for i, (_, d) in enumerate(rows)}
    slots = {}
    for s in range(shards):
        for i, d in enumerate(sorted((d for d in placed if placed[d] == s), key=lambda d: (*at[d], order[d]))):
            slots[d] = (s, i)
    return slots


@pytest.mark.parametrize("n, shards", [(7, 24), (600, 24), (2000, 25), (900, 3)])
def test_shards_are_those_of_a_walk_by_hand(spark, n, shards):
    df = spark.createDataFrame([(i, "t") for i in range(n)], "doc_id long, text string")
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(df, shards).collect()}
    want = walk(range(n), shards)
    assert {d: s for d, (s, _) in got.items()} == {d: s for d, (s, _) in want.items()}
    assert got == want


def test_one_more_shard_moves_a_tenth_at_most(spark):
    df = spark.createDataFrame([(i, "t") for i in range(6000)], "doc_id long, text string")
    before, after = ({r.doc_id: r.shard for r in sharding.shard(df, k).collect()} for k in (24, 25))
    assert sum(before[i] != after[i] for i in before) < 0.1 * len(before)
    with pytest.raises(ValueError):
        sharding.shard(df, sharding.MOST_SHARDS + 1)


# ------------------------------------------------------------------ near duplicates


def test_pairs_at_the_threshold_share_a_band():
    rng = np.random.Generator(np.random.PCG64(5))
    slices = minhash._second_permutation(minhash.BANDS * minhash.ROWS)
    missed = pairs = 0
    for n in (9, 18, 45, 90, 450):
        for _ in range(400):
            common, own = n * 8 // 9, n - n * 8 // 9  # 8 / (8 + 1 + 1) = 0.8
            s = rng.integers(0, 2**63, common + 2 * own).astype(np.uint64)
            x, y = (minhash._band_keys(np.sort(np.concatenate([s[:common], part])), slices) for part in (s[common : common + own], s[common + own :]))
            missed += not (x == y).any()
            pairs += 1
    assert pairs == 2000 and missed == 0


def test_a_hub_with_a_long_text_and_many_members(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 4)
    rng = random.Random(6)
    base = rand_text(rng, 3000, 100_000).split()
    docs = [(i, " ".join([*base[: 40 * (i % 12)], "changed", *base[40 * (i % 12) + 1 :], f"own{i}"])) for i in range(60)]
    docs += [(100 + i, rand_text(rng, 50, 100_000)) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs, 5)


# ------------------------------------------------------------------ decontamination


def test_a_benchmark_in_parts_finds_the_same(spark, monkeypatch):
    rng = random.Random(7)
    items = spark.createDataFrame([(i, rand_text(rng, 30, 5000)) for i in range(40)], "item_id long, text string")
    texts = [r.text for r in items.collect()]
    docs = spark.createDataFrame([(d, f"{rand_text(rng, 80, 5000)} {texts[d % 40] if d % 2 else ''} {rand_text(rng, 20, 5000)}") for d in range(120)], "doc_id long, text string")
    whole = sorted(map(tuple, contamination.contaminated(docs, items).collect()))
    monkeypatch.setattr(contamination, "LEAST_BITS", 6)
    monkeypatch.setattr(contamination, "MOST_BITS", 16)
    assert whole and sorted(map(tuple, contamination.contaminated(docs, items).collect())) == whole


def test_the_filter_passes_all_it_holds(spark):
    seeds = np.random.Generator(np.random.PCG64(8)).integers(-(2**63), 2**63, 3000)
    table = contamination._bits(spark.createDataFrame([(int(s),) for s in seeds], "seed long"), 17)
    assert len(contamination._passing(table, seeds.view(np.uint64))) == 3000
    others = np.random.Generator(np.random.PCG64(9)).integers(-(2**63), 2**63, 200_000).view(np.uint64)
    assert len(contamination._passing(table, others)) < 40


# ------------------------------------------------------------------ toxicity


@pytest.mark.parametrize("neutral", [False, True])
def test_a_pair_that_counts_only_together_is_learned_from_texts(spark, neutral):
    rng, docs, labels = random.Random(10), [], []
    for d in range(6000):
        kind = rng.randrange(4)
        planted = [["zork"], ["blim"], ["zork", "blim"], ["vile"] if neutral else []][kind]
        toxic = int(kind == 2 or neutral and kind == 3)  # if neutral, zork and blim are as common in clean rows as in toxic ones
        words = rand_text(rng, 30, 3000).split() + planted
        rng.shuffle(words)
        docs.append((d, " ".join(words)))
        labels.append((d, toxic))
    got = toxicity.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    want = dict(labels)
    assert sum(r.predicted == want[r.doc_id] for r in got) / len(got) > 0.98


def test_the_sample_is_bounded_where_one_document_repeats(spark):
    texts = [(4, f"w{i} common") for i in range(900)] + [(9, "other words")] * 900
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(4, 1), (9, 0)], "doc_id long, toxic int")
    fitted = []
    keep = toxicity.fit_machine
    try:
        toxicity.fit_machine = lambda x, y, places, **more: fitted.append(len(y)) or keep(x, y, places, epochs=1)
        toxicity.train(docs, labels, sample=100)
    finally:
        toxicity.fit_machine = keep
    assert fitted and fitted[0] <= 200


def test_terms_are_cut_between_letters():
    data = np.frombuffer("éééééé ééééée абвгдежз".encode(), np.uint8)
    doc, place = toxicity._terms(data, np.array([0, len(data)]))
    assert len(place) == 7  # three words, the first four and five letters of each, those of the first two in common


# ------------------------------------------------------------------ scratch and pipeline


def test_scratch_leaves_the_session_alone_and_goes_away(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    table = scratch.materialize(spark.range(5), "t")
    with scratch.batches_by_bytes(spark):
        assert int(spark.conf.get(key).rstrip("b")) <= scratch.BATCH_BYTES
    assert spark.conf.get(key) == before and table.count() == 5
    scratch.clean(spark)
    with pytest.raises(Exception, match="(?i)not.exist|no such file"):
        spark.read.schema("id long").parquet(table.written_to).count()

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://somewhere"})

    with pytest.raises(ValueError):
        scratch.shared_folder(Cluster)


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages_on_odd_inputs(spark, name, stage, tmp_path):
    rows = [(None, "a b c d e f g h", "en", "s", 1), (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "t", 4), (4, "one two three four five six seven", "en", "s", 5), (4, "one two three four five six seven", "en", "s", 5), (5, "word " * 20_000, None, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row_id", F.lit(1)).withColumn("shard", F.lit("x"))
    spark.createDataFrame([(1, "a passage of some words that nobody has")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(4, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = stage(spark, docs, str(tmp_path))
    assert got.columns[:5] == pipeline.COLUMNS
    n = {"near_duplicates": 6}.get(name, 7)
    assert name == "mixing" or got.count() == n
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
