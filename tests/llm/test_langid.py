from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cairnwork.llm import langid


def test_ngrams_of_each_text():
    texts = ["Ab, c", "", "é", "x" * 40]
    for n, (codes, bounds) in zip(langid.ORDERS, langid.ngrams(texts)):
        for i, t in enumerate(texts):
            b = langid._bytes(t)
            want = [int.from_bytes(b[k : k + n], "big") | n << 56 for k in range(len(b) - n + 1)]
            assert codes[bounds[i] : bounds[i + 1]].tolist() == want


def test_lookup_returns_every_language_that_has_the_ngram():
    model = langid.Model(["a", "b"], [np.zeros(1 << 16, np.uint8)], np.zeros(2), np.ones(2), 16)
    for bit, text in ((1, "shared alpha"), (2, "shared beta")):
        for codes, _ in langid.ngrams([text]):
            for at in langid.slots(codes, 16):
                model.tables[0][at] |= np.uint8(bit)
    shares = model.shares(["shared", "alpha", "beta"])
    assert (shares[0] == 1).all() and shares[1][0] == 1 > shares[1][1] and shares[2][1] == 1 > shares[2][0]


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    pred = langid.predict(docs.select("doc_id", "text", langid.held_out(F.col("doc_id")).alias("held_out"), F.col("lang").alias("truth")), langid.fit_documents(docs))
    rows = pred.filter("held_out").collect()
    assert len(rows) > 150 and np.mean([r.truth == r.lang_pred for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_cases(spark):
    rows = [(i, "the cat sat on the mat with the hat", "en") for i in range(40)] + [(100 + i, "der hund und die katze sind im haus", "de") for i in range(40)]
    rows += [(200, None, "en"), (201, "12 34 !!", "en"), (202, "the hat", None), (203, "a", "en"), (203, "a", "en"), (None, "und die katze", "de"), (204, "the cat " * 20_000, "xx")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit_documents(docs)).collect()}
    assert len(got) == len(rows) - 1
    assert got[200].lang_pred == got[201].lang_pred == "und" and got[200].score == 0
    assert got[202].lang_pred == "en" and got[None].lang_pred == "de" and got[203].lang_pred != "und"
    assert langid.predict(docs.limit(0), langid.fit_documents(docs.limit(0))).count() == 0
    assert langid.predict(docs, langid.fit_documents(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0


def test_against_exact_sets(spark, sf_dir):
    """The query's languages with plain sets of n-grams in place of filters, learned from the same rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.withColumn("held", langid.held_out(F.col("doc_id"))).collect()

    def grams(text):
        data = langid._bytes(text)
        return [data[i : i + n] for n in langid.ORDERS for i in range(len(data) - n + 1)]

    texts = {}
    for r in rows:
        if not r.held and r.lang is not None and r.text is not None:
            texts.setdefault(r.lang, []).append(r.text)
    known, usual = {}, {}
    for lang, own in texts.items():
        n = Counter(g for t in own for g in set(grams(t)))
        enough = max(2, 0.004 * len(own)) if len(own) > 20 else 1
        known[lang] = {g for g, k in n.items() if k >= enough}
    share = lambda text, lang: sum(g in known[lang] for g in grams(text)) / max(1, len(grams(text)))
    for lang, own in texts.items():
        usual[lang] = max(0.05, float(np.median([share(t, lang) for t in own])))
    want = {r.doc_id: max(sorted(known), key=lambda x, t=r.text: share(t, x) / usual[x]) if r.text and langid.has_letter(r.text) else "und" for r in rows}
    got = {r.doc_id: r.lang_pred for r in langid.op3_langid(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and sum(got[i] == want[i] for i in got) >= 0.99 * len(got)


def test_letters():
    assert [langid.has_letter(x) for x in ("½ Ⅷ ² 12", "½a", "漢", "_-!", "ª", "")] == [False, True, True, False, True, False]


def test_more_languages_than_a_word_has_bits(spark):
    word = lambda i, k: f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}qu{chr(97 + (i * 7 + k) % 26)}"
    rows = [(100 * i + j, " ".join(word(i, k) for k in range(j, j + 12)), f"l{i:03d}") for i in range(70) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(docs, langid.fit(docs.withColumnRenamed("doc_id", "id"))).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98 and len({r.lang_pred for r in got}) >= 69
