import hashlib

import numpy as np

from brindle.llm import suffix


def brute(docs):
    """Of (id, text) pairs: bytes, removed bytes, spans and digest."""
    seen, out = set(), {}
    for key, text in sorted(docs):
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[key] = (len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def found(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expect = brute(docs)
    rows = found(suffix.query(spark, sf).collect())
    assert rows == expect
    assert sum(x[1] for x in expect.values()) > 10_000


def test_periodic_and_overlapping(spark, tmp_path):
    draw = np.random.default_rng(4)
    word = lambda n: "".join(draw.choice(list("abcdé"), n))
    shared, other = word(400), word(150)
    texts = ["a" * 1000, "ab" * 700, word(37) * 30, shared, word(50) + shared[:250] + word(30) + shared[100:] + word(9), other + word(3) + other, shared + shared, "a" * 99, "a" * 100, "", word(105) * 3, ("x" + word(99)) * 4 + "x", "\0" * 300, "\0" * 150 + word(80) + "\0" * 150]
    docs = list(enumerate(texts)) + [(20 + i, word(60) + shared[i : i + 130] + word(60)) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert found(suffix.query(spark, str(tmp_path)).collect()) == brute(docs)


def test_marks_of_many_ranges_of_a_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffix, "ROWS", 3)
    draw = np.random.default_rng(6)
    word = lambda n: "".join(draw.choice(list("abcdefgh"), n))
    shared = word(300)
    docs = [(i, word(40) + shared[i : i + 120 + i] + word(40)) for i in range(50)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert found(suffix.query(spark, str(tmp_path)).collect()) == brute(docs)
    assert suffix.read_at(spark.read.parquet(f"{tmp_path}/documents.parquet")) is not None
    # The same texts without files, and with every row twice.
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(suffix.deduplicate(df).collect()) == brute(docs)
    twice = suffix.deduplicate(df.unionByName(df)).collect()
    assert len(twice) == 100 and found(twice) == brute(docs)


def test_suffix_array_and_prefixes():
    draw = np.random.default_rng(2)
    for t in (draw.integers(0, 3, 3000), np.tile(draw.integers(0, 9, 70), 20), np.zeros(500)):
        t = t.astype(np.uint8) + 1
        data = t.tobytes()
        order, _ = suffix.suffix_array(t)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: data[i:])
        lcp = suffix.kasai(t, order, 100, 7)
        for k in range(1, len(t)):
            a, b = data[order[k - 1] :][:100], data[order[k] :][:100]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert lcp[k] == n


def test_odd_rows(spark):
    long = "".join(chr(97 + i * i % 26) + str(i) for i in range(300))
    rows = [(1, None, 0), (2, long, 0), (2, long, 0), (2, long + "!", 0), (None, long, 0), (3, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fkey int")
    out = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix.deduplicate(df).collect()), key=str)
    n = len(long)
    assert (None, n, n) in out and (1, 0, 0) in out and (3, 0, 0) in out
    assert sorted(x[1:] for x in out if x[0] == 2) in ([(n, 0), (n, 0), (n + 1, n)], [(n, n), (n, n), (n + 1, 0)])
    assert suffix.deduplicate(df.limit(0)).count() == 0
    assert suffix.deduplicate(df.where("doc_id = 3")).count() == 1
