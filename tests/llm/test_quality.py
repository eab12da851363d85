import re

import numpy as np

from brindle.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def check(docs, found):
    assert len(docs) == len(found)
    for d, r in zip(sorted(docs, key=str), sorted(found, key=str), strict=True):
        assert (d[0], *brute(d[1])) == r


FIELDS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = quality.query(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r[f] for f in FIELDS[1:]) == brute(docs[r.doc_id])
        assert not (r.base_failed and r.kept)
    quality_of = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(quality_of[r.doc_id], r.kept) for r in rows if r.doc_id in quality_of and not r.base_failed]
    assert sum(q == k for q, k in judged) / len(judged) > 0.95


def test_odd_texts(spark):
    texts = [None, "", " \n\t\x0b", "é\x0bü|x\n\n a \n a \nb\x1cc", "a " * 30_000, " ".join(map(str, range(100))) + " " + " ".join(map(str, range(50, 80))), "x" * 200_000, "a b c d e f g h a b c d e f g h i"]
    docs = [(i, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 0), (None, "a", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, __words int")
    found = {(r.doc_id, *(r[f] for f in FIELDS[1:])) for r in quality.statistics(df).collect()}
    assert found == {(d, *brute(t)) for d, t, _ in docs}
    assert quality.statistics(df).where("base_failed").count() > 0
    labels = spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality int")
    assert quality.fit(df, labels) == []
    assert quality.statistics(df.limit(0)).count() == 0


def test_learns_a_conjunction():
    draw = np.random.default_rng(1)
    x = draw.random((2000, len(quality.FEATURES)))
    bad = (x[:, 2] > 0.7) & (x[:, 4] > 0.5)
    rules = quality.learn(x, bad)
    caught = np.zeros(len(x), bool)
    for rule in rules:
        caught |= quality.covers(rule, x)
    assert (caught == bad).mean() > 0.98
