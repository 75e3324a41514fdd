"""Mixing, sharding, token counts, chat windows and WARC archives against brute force and on odd inputs."""

import gzip
import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_filters import odd_docs, rand_text, words_of
from tideline.llm import chat, mixing, ordered, sharding, tokens, warc
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_running_totals_and_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), rng.randrange(9)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a int, v int")
    got = sorted((r.rank, r.a) for r in ordered.global_rank(df, ["a"], "t").collect())
    assert [x for x, _ in got] == list(range(3000)) and [a for _, a in got] == sorted(a for a, _ in rows)
    total = max(r.total_v for r in ordered.running_totals(df, ["a", "v"], ["v"], "t").collect())
    assert total == sum(v for _, v in rows)


# ------------------------------------------------------------------ mixing


def brute_targets(sizes, share=1.5):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = share * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(2)
    share = [0.34, 0.2, 0.2, 0.1, 0.05, 0.05, 0.03, 0.03]
    names = ["b", "a", None, "é", "Z", "c", "d", "z"]
    docs = [(i, rand_text(rng, rng.randrange(1, 60)), rng.choices(names, share)[0]) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mixed_words(df).collect()
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    want, taken = brute_targets(sizes), {}
    source = {i: s for i, _, s in docs}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken in (0, r.size, 2 * r.size)
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 120 for s in want)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixed_words(df.repartition(7)).collect()))
    mix = mixing.mix(df).collect()
    assert len(mix) == sum(r.taken // r.size for r in got if r.size)
    assert all(a.mix_finish <= b.mix_finish for a, b in zip(*(lambda m: (m, m[1:]))(sorted(mix, key=lambda r: r.mix_total))))


def test_mixing_on_odd_inputs(spark):
    docs = odd_docs(spark)
    got = mixing.mixed_words(docs).collect()
    assert len(got) == docs.count() and all(r.taken <= 2 * r.size for r in got)
    mix = mixing.mix(docs.withColumn("mix_pass", F.lit("x")))
    assert set(docs.columns) < set(mix.columns) and mix.count() >= 1
    assert mixing.mixed_words(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mixed_words(docs.where("text is null or text = ''")).where("taken > 0").count() == 0


# ------------------------------------------------------------------ sharding


@pytest.mark.parametrize("n", [0, 5, 100, 1003])
def test_shards_are_full_and_gapless(spark, n):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(n)], "doc_id long, text string")
    got = sharding.shard(df, 24).collect()
    assert len(got) == n
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(24)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_one_more_shard_moves_little(spark):
    df = spark.createDataFrame([(i, "t") for i in range(4000)], "doc_id long, text string")
    before = {r.doc_id: r.shard for r in sharding.shard(df, 24).collect()}
    after = {r.doc_id: r.shard for r in sharding.shard(df, 25).collect()}
    assert sum(before[i] != after[i] for i in before) < 0.35 * len(before)


def test_rows_stay_at_home_unless_it_is_full(spark):
    df = spark.createDataFrame([(i, "t") for i in range(3000)], "doc_id long, text string")
    points = sorted((int(hashlib.md5(f"point {s} {r}".encode()).hexdigest()[:4], 16), hashlib.md5(f"point {s} {r}".encode()).hexdigest(), s) for s in range(24) for r in range(sharding.VIRTUAL))
    full = {r.shard for r in sharding.shard(df, 24).groupBy("shard").count().collect() if r["count"] >= 125}
    moved = 0
    for r in sharding.shard(df, 24).collect():
        cell = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:4], 16)
        home = next((s for c, _, s in points if c >= cell), points[0][2])
        moved += r.shard != home
        assert r.shard == home or home in full
    assert moved < 0.25 * 3000


def test_sharding_on_odd_inputs(spark):
    hot = [(7, "same", "s", 0, "x")] * 300
    docs = odd_docs(spark, hot).withColumn("shard", F.lit("old"))
    got = sharding.shard(docs, 24).collect()
    counts = [sum(r.shard == s for r in got) for s in range(24)]
    assert len(got) == docs.count() and max(counts) - min(counts) <= 1
    rows = sharding.sharded_rows(docs).collect()
    crc = {r.doc_id: r for r in rows}
    assert crc[1].size == 8 and crc[1].text_crc32 == 0 and crc[7].text_crc32 == zlib.crc32(b"same") and crc[7].size == 12


# ------------------------------------------------------------------ token counts


def test_prefix_counts_match_the_library(spark):
    lib = Tokenizer.from_file(PATH)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    rng = random.Random(3)
    parts = ["a", "Hello", " world", "'s", "'re", "'ll", " 's", "  ", "\n", "\t", "12", "é", "中文", "😀", "!?", "<|endoftext|>", "<|endo", "don't", "´", "²", "\u00a0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in tokens.prefix_token_counts(df, PATH).withColumn("fits", tokens.fitting_chars(F.col("prefix_tokens"), 4)).collect()}
    for i, t in enumerate(texts):
        prefixes = [count(t[: k + 1]) for k in range(len(t))]
        assert got[i].prefix_tokens == prefixes and got[i].n_tokens == count(t) and got[i].n_bytes == len(t.encode())
        assert got[i].fits == max((k + 1 for k, n in enumerate(prefixes) if n <= 4), default=0)


def test_tokens_on_odd_inputs(spark):
    docs = odd_docs(spark)
    got = tokens.prefix_token_counts(docs, PATH, keep_prefixes=False).collect()
    assert len(got) == docs.count() and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    lib = Tokenizer.from_file(PATH)
    assert next(r.n_tokens for r in got if r.doc_id == 5) == len(lib.encode("word " * 60_000).ids)
    assert tokens.prefix_token_counts(docs.limit(0), PATH).count() == 0


# ------------------------------------------------------------------ chat windows


def test_escapes_are_reversible():
    rng = random.Random(4)
    for _ in range(2000):
        t = "".join(rng.choice(["<", "|", "\\", "im_start", ">", "\n", "n", chat.END, chat.START]) for _ in range(rng.randrange(0, 9)))
        assert chat.unescape(chat.escape(t)) == t and chat.START not in chat.escape(t) and chat.END not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)


def conversations(spark, n_long):
    rng, rows = random.Random(5), []
    for c in range(12):
        turns = n_long if c == 0 else rng.randrange(1, 9)
        for t in range(turns):
            role = "system" if t == 0 and c % 2 == 0 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, rand_text(rng, rng.randrange(0, 260)) + rng.choice(["", "<|im_end|>", "<\\|", " é"])))
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_windows_hold_their_promises(spark):
    rows, df = conversations(spark, 700)
    by = {}
    for c, _, role, text in rows:
        by.setdefault(c, []).append((role, text))
    seen = {}
    for w in chat.format_windows(df, PATH, budget=900).orderBy("conv_id", "block", "window").collect():
        turns = chat.read_window(w.formatted)
        assert [s["at"] for s in w.turns] == sorted(s["at"] for s in w.turns)
        own = [s for s in w.turns if not s["repeated"]]
        assert own and (w.tokens <= 900 or len(own) == 1)
        if by[w.conv_id][0][0] == "system":
            assert w.turns[0]["at"] == 0
        for (role, text, start, end), s in zip(turns, w.turns, strict=True):
            assert (role, text) == by[w.conv_id][s["at"]] and (start, end) == (s["text_start"], s["text_end"])
            assert s["target"] == (role == "assistant" and not s["repeated"])
            if not s["repeated"]:
                seen.setdefault(w.conv_id, []).append(s["at"])
        assert sum(s["repeated"] for s in w.turns) <= chat.HISTORY_TURNS + 1
    assert seen == {c: list(range(len(t))) for c, t in by.items()}


def test_digests_are_read_back(spark):
    rows, df = conversations(spark, 300)
    got = {r.conv_id: r for r in chat.read_digests(chat.format_windows(chat.with_control_conversation(df), PATH)).collect()}
    control = "<|im_end|><|im_start|>assistant ok"
    rows = [*rows, (-1, 0, "user", control), (-1, 1, "assistant", control)]
    for c in {r[0] for r in rows}:
        turns = [(r[2], r[3]) for r in rows if r[0] == c]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_on_odd_inputs(spark):
    df = spark.createDataFrame([(None, 1, "user", "a"), (1, None, None, None), (1, 0, "assistant", None), (1, 0, "assistant", None), (2, 5, "a\nb", "x " * 5000), (2, 6, "system", "late")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_digests(chat.format_windows(df, PATH)).collect()}
    assert got[None].n_turns == 1 and got[1].n_turns == 3 and got[1].loss_chars == 0 and got[2].n_turns == 2
    assert got[2].turns_sha256 == hashlib.sha256(("a\nb\n" + "x " * 5000 + "\nsystem\nlate\n").encode()).hexdigest()
    assert chat.format_windows(df.limit(0), PATH).count() == 0


# ------------------------------------------------------------------ WARC


def write(spark, pages, folder, **more):
    manifest = warc.write_warc(pages, f"file://{folder}", **more)
    return manifest, warc.read_warc(manifest, f"file://{folder}")


def test_archives_are_the_same_whatever_the_partitions(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, f"http://a.org/{i} x", rand_text(rng, rng.randrange(0, 400))) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    a, _ = write(spark, pages.repartition(3), tmp_path / "a", shard_bytes=60_000, roll_bytes=15_000)
    b, records = write(spark, pages.repartition(11), tmp_path / "b", shard_bytes=60_000, roll_bytes=15_000)
    files = sorted(map(tuple, a.collect()))
    assert files == sorted(map(tuple, b.collect())) and len(files) > 5
    for name, *_, size, sha in files:
        raw = (tmp_path / "b" / name).read_bytes()
        assert len(raw) == size and hashlib.sha256(raw).hexdigest() == sha and gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert not [p for p in (tmp_path / "b").iterdir() if p.name.endswith(".tmp")]
    order = [r.page_id for r in records.orderBy("file").collect()]
    assert sorted(order) == list(range(300)) and records.where("payload_bytes is null").count() == 12 - 12
    assert records.count() == 300


def test_revisits_and_odd_inputs(spark, tmp_path):
    rows = [(1, "http://a", "same"), (5, None, "same"), (5, None, "same"), (3, "b\r\nX: y", "same"), (None, "c", "same"), (7, "d", None), (8, "e", ""), (None, None, "own"), (9, "f", "é" * 200_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    got = sorted(map(tuple, warc.round_trip(pages).collect()), key=repr)
    digest = lambda t: warc._base32(hashlib.sha1(t.encode()).digest())
    want = [(5, 4, digest("same"), "response", None), *[(p, 4, digest("same"), "revisit", 5) for p in (1, 3, 5, None)], (8, 0, digest(""), "response", None), (7, 0, digest(""), "revisit", 8), (None, 3, digest("own"), "response", None), (9, 400_000, digest("é" * 200_000), "response", None)]
    assert got == sorted(want, key=repr)
    assert {r.record_type for r in warc.round_trip(pages, least_bytes=10**9).collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0
    manifest, _ = write(spark, pages, tmp_path / "c")
    text = gzip.decompress((tmp_path / "c" / manifest.first().file).read_bytes())
    assert not re.search(rb"\r\nX: y", text)
