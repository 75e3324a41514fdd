"""Language: gradients by differences, scoring stretch by stretch, held-out rows, odd rows."""

import numpy as np
from tideline.llm import language

SF = "/root/testdata/sf0.01"


def test_gradients_equal_differences():
    reader = language.new_reader(("a", "b", "c"), units=3)
    reader = language.Reader(reader.langs, {k: v.astype(np.float64) for k, v in reader.of.items()})
    codes, live = language._grid([b"abcde", b"xy", b"hello w"])
    lang = np.array([0, 2, 1])
    _, grads = language.loss_and_gradients(reader, codes, live, lang)
    rng = np.random.default_rng(1)
    for name, values in reader.of.items():
        for _ in range(20):
            i = tuple(int(rng.integers(n)) for n in values.shape)
            i = (i[0], int(rng.choice(codes[live])), i[2]) if name.endswith("_in") else i
            kept, losses = values[i], []
            for step in (1e-6, -1e-6):
                values[i] = kept + step
                losses.append(language.loss_and_gradients(reader, codes, live, lang)[0])
            values[i] = kept
            assert abs((losses[0] - losses[1]) / 2e-6 - grads[name][i]) < 1e-7


def _plain(of, kind, text):
    """One stretch, one byte at a time."""
    squash = lambda x: x / (1 + np.abs(x))
    h, out = np.zeros(language.UNITS), []
    for b in text if kind == "forward" else text[::-1]:
        x = of[f"{kind}_in"][:, b]
        z, r = (0.5 * squash(x[i] + h @ of[f"{kind}_state"][i]) + 0.5 for i in range(2))
        new = squash(x[2] + r * (h @ of[f"{kind}_state"][2] + of[f"{kind}_inner"]))
        h = new + z * (h - new)
        out.append(h)
    return out if kind == "forward" else out[::-1]


def test_document_probabilities_equal_a_plain_reading():
    reader = language.new_reader(("de", "en", "fr"))
    texts = [b"", b"a", "Ein Wörtchen ".encode() * 40, b"x" * language.STRETCH, b"the end" * 500]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = language.document_probabilities(reader, data, offsets)
    for text, p in zip(texts, got, strict=True):
        each = []
        for at in range(0, len(text), language.STRETCH):
            part = text[at : at + language.STRETCH]
            scores = np.concatenate([_plain(reader.of, "forward", part), _plain(reader.of, "backward", part)], axis=1) @ reader.of["out"] + reader.of["bias"]
            each += list(np.exp(scores) / np.exp(scores).sum(1, keepdims=True))
        assert np.allclose(p, np.mean(each, axis=0) if each else 0, atol=1e-4)


def test_held_out_languages_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.predict_language(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = sum(r.lang_pred == r.lang for r in rows)
    assert len(rows) > 250 and right >= 0.97 * len(rows)
    for lang in ("de", "en", "es", "fr"):
        own = [r for r in rows if r.lang == lang]
        assert sum(r.lang_pred == lang for r in own) >= 0.9 * len(own)


def test_labels_of_held_out_rows_and_sources_are_not_seen(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    other = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 'xx', lang) AS lang", "'s' AS source", "n_chars")
    assert sorted(language.predict_language(docs).collect()) == sorted(language.predict_language(other).collect())


def test_odd_texts(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 -- 77 ①", "de"), (4, "ж", None), (None, "the and of", "en"), (6, "the and of", "en"), (6, "the and of", "en"), (7, "the " * 100_000, None), (8, "der und die", "de")]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = language.predict_language(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1, 2, 3))
    assert all(by[i].lang_pred in ("en", "de") and 0 <= by[i].score <= 1 for i in (4, None, 6, 7, 8)) and by[None].held_out is False
    assert language.predict_language(df.limit(0)).collect() == []
    assert {r.lang_pred for r in language.predict_language(df.withColumn("lang", df.lang_pred.substr(9, 1)).where("lang <> ''")).collect()} <= {"und"}
    nothing = language.predict_language(df.selectExpr("doc_id", "text", "cast(null as string) AS lang")).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
