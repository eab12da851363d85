"""The pipeline against plain Python on a small table."""

import hashlib

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from brindle.llm import langid, pii

from .test_decontaminate import brute
from .test_pii import brute as brute_pii
from .test_simhash import brute_groups


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    ids = sorted(rows)
    labels, scores = langid.fit(docs).predict([rows[i] for i in ids])
    kept = [i for i, x, s in zip(ids, labels, scores, strict=True) if x != "und" and s >= corpus_pipeline.LEAST_SCORE]
    assert len(kept) > 0.95 * len(ids)
    groups = brute_groups([(i, rows[i]) for i in kept])
    staged = spark.createDataFrame([(i, rows[i], None, None, 0) for i in kept], "doc_id long, text string, lang string, source string, n_chars long")
    single = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, staged, sf).collect())
    assert single == [i for i in kept if groups.get(i, i) == i]
    kept = single
    bad = {d for d, _ in brute([(i, rows[i]) for i in kept], items)}
    kept = [i for i in kept if i not in bad]
    theirs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert sorted(found) == kept
    left = spark.createDataFrame([(i, rows[i]) for i in kept], "doc_id long, text string")
    spans = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in pii.report(left, pii.trained(spark)).collect()}
    for i in kept:
        text, out, at = rows[i], [], 0
        assert {(k, int(s), int(e)) for k, s, e in spans[i]} >= set(brute_pii(text))
        for kind, s, e in ((k, int(s), int(e)) for k, s, e in spans[i]):
            if s >= at:
                out += [text[at:s], f"[{kind.upper()}]"]
            at = max(at, e)
        ids_ = theirs.encode("".join(out) + text[at:], add_special_tokens=False).ids
        assert found[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids_)).encode()).hexdigest()
    assert any(kind == "secret" for s in spans.values() for kind, _, _ in s)


def test_long_texts_and_clashing_columns(spark, tmp_path):
    """A very long text, and columns named as those that stages make, in all stages."""
    long = " ".join(f"the word{i} of" for i in range(30_000))
    rows = [(1, long, "en", None, 1, "x", 2.0, 3), (2, long + " end", "en", None, 1, "x", 2.0, 3), (3, "the cat and the dog of it", "en", None, 1, "x", 2.0, 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, group_id int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "what is the answer to this one question", "y")], "item_id long, text string, doc_id string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [1, 3]


def test_near_copies_are_caught(spark, tmp_path):
    """Copies in which every thirtieth word is another one: 0.9 of them go, and no other document."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    base = [(d, t) for d, t in docs if t and len(t.split()) > 150][:150]
    copies = [(500_000 + d, " ".join("changed" if k % 30 == d % 30 else w for k, w in enumerate(t.split()))) for d, t in base]
    frame = lambda rows: spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    alone = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(docs), "").collect()}
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(docs + copies), "").collect()}
    assert len(kept & {i for i, _ in copies}) <= 0.1 * len(copies)
    assert kept - {i for i, _ in copies} == alone


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "the and of that is", "en", None, 18), (4, "the and of that is mail a@b.cd", "en", "x", 30), (4, "the and of that is mail a@b.cd", "en", "x", 30)]
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "what is the answer to this one question")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in out), key=str) == [4, None]
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
