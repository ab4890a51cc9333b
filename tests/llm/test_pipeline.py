import random
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.test_minhash import shingle_set

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    """(doc_id, text) that reach the packing stage, by plain loops."""
    rows = [r for r in rows if r[1] and re.search(r"[a-zA-Zé]", r[1])]
    best = {}
    for doc, text in sorted(set(rows), key=lambda r: (-len(r[1]), r[0])):
        best.setdefault(re.sub(r"[\x20\x09-\x0d]", "", text), (doc, text))
    rows = sorted(best.values())
    sets = [shingle_set(t, 5) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    rows = [r for i, r in enumerate(rows) if group[i] == i]
    texts, seen = [t.encode() for _, t in rows], {}
    for t in texts:
        for i in range(len(t) - cp.PASSAGE_BYTES + 1):
            seen[t[i : i + cp.PASSAGE_BYTES]] = seen.get(t[i : i + cp.PASSAGE_BYTES], 0) + 1
    out = {}
    for (doc, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - cp.PASSAGE_BYTES + 1):
            if seen[t[i : i + cp.PASSAGE_BYTES]] > 1:
                gone[i : i + cp.PASSAGE_BYTES] = True
        out[doc] = bytes(np.frombuffer(t, np.uint8)[~gone]).decode(errors="ignore")
    return out


def made():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopé") for _ in range(r.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(120)
    rows = [(i, text(r.choice([3, 30, 200]))) for i in range(40)]
    base = text(150)
    rows += [(100, base), (101, base.replace(" ", "  ", 3)), (102, base + " tail"), (103, "start " + base), (104, base)]
    rows += [(110 + i, f"{text(60)} {passage} {text(60)}") for i in range(4)]
    rows += [(120, None), (121, ""), (122, "123 !!"), (104, base)]
    rows += [(130, "Совсем другой язык и другие буквы " * 9), (131, "½ ² Ⅷ")]
    return rows


def packed_texts(pieces):
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append((p.start, bytes(p.ids)))
    return {doc: np.frombuffer(b"".join(b for _, b in sorted(held)), "<u4").tolist() for doc, held in by.items()}


def test_run_against_brute_force(spark, tmp_path):
    rows = made()
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], COLUMNS)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = packed_texts(cp.run(spark, f"file://{tmp_path}").collect())
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert got == {doc: [*tok.encode(t, add_special_tokens=False).ids, 2] for doc, t in brute(rows).items()}


def test_stages_keep_the_columns_and_survive_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.dtypes == [tuple(c.split()) if c.split()[1] != "long" else (c.split()[0], "bigint") for c in COLUMNS.split(", ")], name
        assert docs.count() == 0
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_language_keeps_all_without_labels(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text", None, "s", 9), (2, None, None, "s", 0)], COLUMNS)
    assert cp.language(spark, docs, str(tmp_path)).count() == 2


def test_stages_with_nulls_and_clashing_columns(spark, tmp_path):
    """Ids that are null, rows given twice, columns with names that the stages use inside."""
    text = "one two three four five six seven eight nine ten " * 3
    rows = [(None, text, "en", "s", 9, 1, 2, "x"), (None, text, "en", "s", 9, 1, 2, "x"), (3, text + "eleven", "en", "s", 9, 1, 2, "y"), (4, "others here", "en", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, COLUMNS + ", kept long, label long, others string")
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[-3:] == ["kept", "label", "others"], name
        assert docs.count() in (2, 3, 4), name
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 2
