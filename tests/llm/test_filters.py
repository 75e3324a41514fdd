"""Decontamination, URL filters, quality rules, toxicity and near duplicates against brute force and on odd inputs."""

import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pytest
from tideline.llm import contamination, minhash, quality, queries, toxicity, urls
from tideline.llm import text_kernel as kernel

DOCS = "doc_id long, text string, source string, size long, row string"
SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def odd_docs(spark, more=()):
    """Null ids and texts, empty and blank texts, repeated rows, a long text, and columns with names that operators use."""
    rows = [(None, "a b c d e f g h", "s", 1, "x"), (1, None, None, 2, "x"), (2, "", "s", 3, "x"), (3, " \n\t ", "t", 4, "x"), (4, "one two three four five six seven", "s", 5, "x"), (4, "one two three four five six seven", "s", 5, "x"), (5, "word " * 60_000, None, 6, "x")]
    return spark.createDataFrame([*rows, *more], DOCS)


def rand_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ------------------------------------------------------------------ decontamination


def test_contaminated_finds_whole_and_substituted_passages(spark):
    rng = random.Random(1)
    items = {i: rand_text(rng, rng.randrange(15, 40), 5000) for i in range(12)}
    items[12], items[13] = "five quick short words here", "tiny"
    docs, leaked = [], set()
    for d in range(60):
        body = rand_text(rng, 200, 5000).split()
        if d % 3 == 0:
            i = d // 3 % 13
            passage = items[i].split()
            if d % 2 and len(passage) > 12:
                for at in range(4, len(passage), 5):
                    passage[at] = "changed"
            at = rng.randrange(len(body))
            body[at:at] = [w.upper() + "," for w in passage]
            leaked.add((d, i))
        docs.append((d, " ".join(body)))
    found = contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == leaked
    text = {d: [w.strip(",").lower() for w in t.split()] for d, t in docs}
    for r in found:
        item = items[r.item_id].split()
        assert r.item_words == len(item) and r.n_same >= 0.6 * len(item)
        assert sum(a in item for a in text[r.doc_id][r.doc_word : r.doc_word + r.n_words]) >= r.n_same


def test_contaminated_is_the_same_however_places_are_split(spark, monkeypatch):
    rng = random.Random(3)
    items = spark.createDataFrame([(i, rand_text(rng, 20, 40)) for i in range(8)], "item_id long, text string")
    docs = spark.createDataFrame([(d, rand_text(rng, 300, 40)) for d in range(6)] + [(9, " ".join(r.text for r in items.collect()) + " end")], "doc_id long, text string")
    whole = sorted(contamination.contaminated(docs, items).collect())
    monkeypatch.setattr(contamination, "LAID", 1)
    assert whole and sorted(contamination.contaminated(docs, items).collect()) == whole


def test_best_stretch_is_the_best_of_all():
    rng = random.Random(2)
    for _ in range(300):
        same = np.array([rng.random() < 0.7 for _ in range(rng.randrange(1, 25))])
        value = lambda a, b: sum(1 if x else -contamination.MISMATCH for x in same[a:b])
        first, end, agree = contamination.best_stretch(same)
        assert value(first, end) == max(0, max(value(a, b) for a in range(len(same)) for b in range(a, len(same) + 1)))
        assert agree == same[first:end].sum()


def brute_enough(same):
    """Whether some stretch has enough words that agree and at least two of three that do."""
    ends = range(len(same) + 1)
    return any(sum(same[a:b]) >= min(12, 0.8 * len(same)) and 3 * sum(same[a:b]) >= 2 * (b - a) for a in ends for b in ends[a + 1 :])


def test_contaminated_finds_every_substitution_that_leaves_enough(spark):
    rng = random.Random(8)
    items, docs, sure, never = [], [], set(), set()
    for n in range(8, 61):
        passage = [f"p{n}x{i}" for i in range(n)]
        items.append((n, " ".join(passage)))
        bad = [set(rng.sample(range(n), k)) for k in range(n // 5 + 1) for _ in range(6)] + [set(range(at, n, 3)) for at in range(3)] + [set(rng.sample(range(n), n // 4))]
        for at in bad:
            d, same = len(docs), [i not in at for i in range(n)]
            docs.append((d, " ".join(["before"] * rng.randrange(9) + [w if ok else "changed" for w, ok in zip(passage, same)] + ["after"] * rng.randrange(9))))
            if not brute_enough(same):
                never.add((d, n))
            elif sum(same) >= 0.8 * n or at in bad[-4:-1]:
                sure.add((d, n))
    docs.append((len(docs), " ".join("changed" if i % 3 == 2 else f"long{i}" for i in range(200))))
    items.append((200, " ".join(f"long{i}" for i in range(200))))
    sure.add((len(docs) - 1, 200))
    got = contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert not sure - found and not never & found
    assert {r.n_same for r in got if r.item_id == 200} == {134}


def test_contaminated_finds_short_passages_with_one_word_replaced(spark):
    items = [(n, " ".join(f"p{n}x{i}" for i in range(n))) for n in (4, 5, 6, 7)]
    docs, want = [], set()
    for n, text in items:
        for bad in [(), *combinations(range(n), 1), *combinations(range(n), 2)]:
            if n > 4 and len(bad) < 2:
                want.add((len(docs), n))
            docs.append((len(docs), "before " + " ".join("changed" if i in bad else w for i, w in enumerate(text.split())) + " after"))
    got = contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_widest_stretch_is_the_widest_of_all():
    rng = random.Random(9)
    for _ in range(300):
        same = np.array([rng.random() < 0.6 for _ in range(rng.randrange(0, 25))], bool)
        first, end, agree = contamination.widest_stretch(same)
        assert agree == max((int(same[a:b].sum()) for a in range(len(same)) for b in range(a, len(same) + 1) if 3 * same[a:b].sum() >= 2 * (b - a)), default=0)
        assert agree == same[first:end].sum() and 3 * agree >= 2 * (end - first)


def test_contaminated_on_odd_inputs(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h"), (None, "one two three four five six seven"), (2, None), (3, ""), (4, "one two three four five six seven"), (4, "one two three four five six seven")], "item_id long, text string")
    docs = odd_docs(spark)
    assert {(r.doc_id, r.item_id, r.n_same) for r in contamination.contaminated(docs, items).collect()} == {(4, 4, 7)}
    kept = contamination.decontaminate(docs, items)
    assert kept.columns == docs.columns and kept.where("doc_id = 4").count() == 0 and kept.count() == 5
    assert contamination.contaminated(docs.limit(0), items).count() == 0
    assert contamination.contaminated(docs, items.limit(0)).count() == 0


def test_decontaminate_goes_by_row(spark):
    rng = random.Random(11)
    item, clean = rand_text(rng, 20, 5000), [rand_text(rng, 60, 5000) for _ in range(3)]
    docs = spark.createDataFrame([(1, f"{clean[0]} {item}"), (1, clean[1]), (None, item), (None, clean[2]), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = lambda **how: {(r.doc_id, r.text) for r in contamination.decontaminate(docs, items, **how).collect()}
    assert texts(null_ids=True) == {(1, clean[1]), (None, clean[2]), (None, None)}
    assert texts() == {(1, clean[1]), (None, item), (None, clean[2]), (None, None)}
    assert [(r.doc_id, r.doc_word, r.n_same) for r in contamination.contaminated(docs, items).collect()] == [(1, 60, 20)]


# ------------------------------------------------------------------ near duplicates


def brute_components(docs, k, percent=80):
    sets = {}
    for d, text in docs:
        w = [x.lower() if x.isascii() else x for x in words_of(text)]
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_match_brute_force(spark, k):
    rng = random.Random(3)
    docs, base = [], [rand_text(rng, rng.randrange(1, 120)) for _ in range(25)]
    for d in range(220):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(["zz", "W1", "yy"])
        docs.append((d, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle_words=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_on_odd_inputs(spark):
    docs = odd_docs(spark, [(9, "ONE two three four five six SEVEN", "s", 0, "")])
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id and r.n_shingles} == {(4, 4), (5, 5), (9, 4)}
    assert all(r.component_id == r.doc_id and r.kept for r in got if r.n_shingles == 0)
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_go_by_row(spark):
    rng = random.Random(10)
    a, b, c, d = (rand_text(rng, 40, 5000) for _ in range(4))
    rows = [(3, b), (7, a), (7, b), (8, c), (8, c), (None, d), (None, d), (None, a), (9, None), (9, None), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = lambda **how: sorted(minhash.drop_near_duplicates(docs, **how).collect(), key=repr)
    assert [tuple(r) for r in left(one_row=True)] == sorted([(3, b), (7, a), (8, c), (None, d), (9, None), (9, None), (None, " ")], key=lambda r: f"Row(doc_id={r[0]!r}, text={r[1]!r})")
    assert [tuple(r) for r in left()] == sorted([r for r in rows if r != (7, b)], key=lambda r: f"Row(doc_id={r[0]!r}, text={r[1]!r})")


def test_second_permutation_is_shifted_in_a_circle():
    table = minhash._second_permutation(7)
    assert sorted(table[:, 0].tolist()) == list(range(minhash.UNIVERSE))
    assert (table[5] == [table[(5 + k) % minhash.UNIVERSE, 0] for k in range(7)]).all()
    assert table[minhash.UNIVERSE - 1, 1] == table[0, 0]


# ------------------------------------------------------------------ URL filters


def fits(rule, url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    rule_host, _, rest = rule.partition("/")
    return (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rest)


def test_urls_match_brute_force(spark):
    rng = random.Random(4)
    rules = [*urls.RULES, ("block", "www.example.org/"), ("allow", "a+b.com/x(1)/"), ("block", "com/fr/x")]
    hosts = ["example.org", "EXAMPLE.org", "my-example.org", "www.example.org", "a.com", "org", "a+b.com", "example.org:80", ""]
    paths = ["/es/", "/es", "/en/1", "/en/12?x=/es/", "/fr/x", "/fr/", "/de/#a", "/x(1)/y", "", "//es/", "/EN/1"]
    given = [f"{rng.choice(['http://', 'https://', '', 'x://y://'])}{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + [None, "", "no url", "http://", "http://a.com/\nfr/"]
    pages = spark.createDataFrame([(i % 250, u, "h") for i, u in enumerate(given)], "page_id long, url string, host string")
    got = sorted((r.page_id, r.rule or "", r.verdict) for r in urls.filter_urls(pages, rules).collect())
    want = []
    for i, u in enumerate(given):
        best = max(((len(r), a == "block", r, a) for a, r in rules if fits(r, u)), default=None)
        want.append((i % 250, best[2] if best else "", best[3] if best else urls.DEFAULT))
    assert got == sorted(want)


def test_urls_on_odd_inputs(spark):
    pages = spark.createDataFrame([(None, None), (1, "http://example.org/es/a"), (1, "http://example.org/es/a")], "page_id long, url string")
    assert sorted((r.page_id or 0, r.verdict) for r in urls.filter_urls(pages).collect()) == [(0, "allow"), (1, "block"), (1, "block")]
    assert urls.filter_urls(pages.limit(0)).count() == 0
    everywhere = urls.filter_urls(pages, [("block", "/es/")]).collect()
    assert sorted((r.rule or "", r.verdict) for r in everywhere) == [("", "allow"), ("/es/", "block"), ("/es/", "block")]


# ------------------------------------------------------------------ quality rules


def brute_statistics(text):
    w, text = words_of(text), text or ""
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = {x for x in windows if windows.count(x) > 1}
    inside = {j for i, x in enumerate(windows) if x in often for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if words_of(line)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_statistics_match_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "bé", "c#", "d\n", "\n", "中|", "e\x0bf", " x"]) for _ in range(rng.randrange(0, 60))) for _ in range(150)] + ["a b c d e " * 4, "a\na\na", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.text_statistics(docs).collect()}
    assert got == {i: brute_statistics(t) for i, t in enumerate(texts)}


def test_learned_rules_are_found_again():
    rng = np.random.Generator(np.random.PCG64(6))
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    junk = ((x["a"] > 0.8) & (x["b"] > 0.5)) | (x["c"] < 0.1)
    rules = quality.learn_rules(x, junk, np.arange(3000) % 3)
    said = np.zeros(3000, bool)
    for r in rules:
        said |= quality._covers(r, x)
    assert (said == junk).mean() > 0.98 and len(rules) <= 4
    assert quality.learn_rules(x, np.zeros(3000, bool), np.arange(3000) % 3) == []


def test_quality_on_labelled_rows_and_odd_inputs(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.judge_quality(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.1
    odd = odd_docs(spark)
    rows = quality.judge_quality(odd, labels.limit(0)).collect()
    assert len(rows) == odd.count() and all(r.base_failed and not r.kept for r in rows if r.n_words < 10)
    assert quality.judge_quality(odd.limit(0), labels).count() == 0


# ------------------------------------------------------------------ toxicity


def test_machine_learns_a_pair_that_counts_only_together():
    rng = random.Random(7)
    x = [np.array(sorted(rng.sample(range(10), rng.randrange(0, 6)))) .astype(int) for _ in range(4000)]
    y = np.array([1.0 if {2, 5} <= set(r.tolist()) else 0.0 for r in x])
    m = toxicity.fit_machine(x, y, np.arange(10))
    dense = np.zeros((4000, 10), np.float32)
    for i, r in enumerate(x):
        dense[i, r] = 1
    assert (((m.score(dense) >= 0.5) == (y == 1)).mean()) > 0.99
    z = m.bias + dense @ m.weight
    brute = [z[i] + sum(float(m.factor[a] @ m.factor[b]) for a, b in combinations(x[i].tolist(), 2)) for i in range(200)]
    assert np.allclose(m.score(dense[:200]), 1 / (1 + np.exp(-np.array(brute))), atol=1e-4)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.score_toxicity(docs, labels).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97
    assert got[got.toxic == 0].predicted.mean() < 0.02


def test_toxicity_on_odd_inputs(spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    docs = odd_docs(spark)
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.score_toxicity(docs, labels.limit(0)).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.drop_toxic(docs, labels.limit(0)).columns == docs.columns


# ------------------------------------------------------------------ SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rows = con.execute(queries.ORACLES[name])
    names = [c[0] for c in rows.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, rows.fetchall()))


def test_words_of_kernel():
    data, offsets = np.frombuffer(b"ab cd ab\tAB", np.uint8), np.array([0, 5, 11])
    w = kernel.words(data, offsets, kernel.alphabet(kernel.ASCII_SPACE, fold_case=True))
    assert w.bounds.tolist() == [0, 2, 4] and w.hash[0] == w.hash[2] == w.hash[3] != w.hash[1]
