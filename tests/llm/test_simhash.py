import re

import numpy as np
import pytest
import xxhash

from brindle.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    ids, fps = [r[0] for r in rows], np.array([r[1] for r in rows], np.uint64)
    parent = {i: i for i in range(len(ids))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 4).tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return {ids[i]: least[root(i)] for i in range(len(ids))}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expect = [(d, brute_fingerprint(t)) for d, t in docs]
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, sf).collect()}
    groups = brute_components(expect)
    assert found == {d: (f"{f:016x}", groups[d]) for d, f in expect}
    assert len(set(groups.values())) < len(groups)


def test_sliced_equals_direct():
    draw = np.random.default_rng(3)
    centres = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 64, (50, 4), dtype=np.uint64), axis=1) for c in centres]))
    for radius in (0, 3, 4, 7):
        q, place = simhash.within(fps[:100], simhash.planes_of(fps), radius)
        found = {(a, b) for a, b in zip(q.tolist(), place.tolist(), strict=True) if b < len(fps)}
        near = np.bitwise_count(fps[:100, None] ^ fps[None]) <= radius
        assert found == set(zip(*(x.tolist() for x in near.nonzero()), strict=True))


def test_all_layouts_find_all_links(spark):
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 63, 200, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 64, (200, k), dtype=np.uint64), axis=1) for k in (3, 4, 5))]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    rows = list(zip(range(len(fps)), fps.tolist(), strict=True))
    expect = brute_components(rows)
    for count in (10, 1 << 25, 1 << 31):
        at = {x: i for i, x in enumerate(fps.view(np.int64).tolist())}
        labels = np.arange(len(fps))
        edges = simhash.links(df, count).collect()
        labels = simhash.unite(labels, np.array([at[e.a] for e in edges]), np.array([at[e.b] for e in edges]))
        assert {i: int(x) for i, x in enumerate(labels)} == expect


def test_odd_rows(spark):
    rows = [(9, None, 1), (2, "", 1), (None, " \t", 1), (5, "a b", 1), (5, "A\nB", 1), (7, "word " * 30_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert found == {(9, 2), (2, 2), (None, 2), (5, 5), (7, 7)}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def shingle_set(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_similar_groups_find_near_copies(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    draw = np.random.default_rng(8)
    base = [(d, t) for d, t in docs if len(t.split()) > 120][:40]
    for k, (d, t) in enumerate(base):
        words = t.split()
        for i in draw.integers(0, len(words), max(1, len(words) // 120)).tolist():
            words[i] = "changed"
        docs.append((100_000 + k, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    groups = {r.doc_id: r.group_id for r in simhash.similar_groups(df).collect()}
    assert groups == brute_groups(docs)
    assert sum(groups.get(100_000 + k) == d for k, (d, _) in enumerate(base)) > 10


def brute_groups(docs):
    """Smallest id of each group of two or more, by all pairs of different sets and fingerprints."""
    sets, ids, holders = {d: frozenset(shingle_set(t or "")) for d, t in docs}, {}, {}
    labels = {d: d for d, _ in docs}

    def root(d):
        while labels[d] != d:
            d = labels[d]
        return d

    def link(a, b):
        a, b = sorted((root(a), root(b)))
        labels[b] = a

    for d, t in docs:
        link(d, ids.setdefault(tuple((t or "").encode().lower().split()), d))
    for d in set(ids.values()):
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    common = {}
    for held in holders.values():
        for i, b in enumerate(held):
            for a in held[:i]:
                common[a, b] = common.get((a, b), 0) + 1
    for (a, b), n in common.items():
        if 25 * n * n >= 16 * len(sets[a]) * len(sets[b]):
            link(a, b)
    for d, r in brute_components([(d, brute_fingerprint(t)) for d, t in docs]).items():
        link(d, r)
    least = {d: root(d) for d, _ in docs}
    shared = {r for d, r in least.items() if d != r}
    return {d: r for d, r in least.items() if r in shared}


def test_similar_groups_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 400)
    monkeypatch.setattr(simhash, "BLOCK", 900)
    draw = np.random.default_rng(4)
    base, docs = draw.integers(0, 10_000, 60).astype(str).tolist(), []
    for d in range(150):  # a chain of near copies, some of which have no leader near
        docs.append((d, " ".join(base)))
        base = list(base)
        base[int(draw.integers(60))] = f"n{d}"
    docs += [(200, docs[3][1]), (201, docs[3][1].upper()), (202, ""), (203, None), (204, "one two")]
    df = spark.createDataFrame([(None, docs[3][1])] + docs, "doc_id long, text string").repartition(3)
    groups = {r.doc_id: r.group_id for r in simhash.similar_groups(df).collect()}
    assert groups == brute_groups(docs)
    assert simhash.similar_groups(df.limit(0)).count() == 0


def test_runs_of_all_lengths_link_as_pairs_do(spark, monkeypatch):
    draw = np.random.default_rng(6)
    for words, radius in ((1, 4), (simhash.WORDS, simhash.WIDE_RADIUS), (3, 1)):
        centres = draw.integers(0, 1 << 63, (40, words), dtype=np.uint64)
        flips = np.uint64(1) << draw.integers(0, 64, (2000, words), dtype=np.uint64)
        fps = centres[draw.integers(0, 40, 2000)] ^ flips * (draw.random((2000, words)) < 0.6)
        runs = np.sort(np.concatenate([draw.integers(0, 900, 1300), np.full(700, 450)]))
        child, parent = simhash.links_of_runs(runs, fps, radius)
        labels = np.arange(len(fps))
        labels[child] = parent
        expect = np.arange(len(fps))
        near = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2) <= radius
        for i, j in zip(*np.nonzero(near & (runs[:, None] == runs[None])), strict=True):
            expect = simhash.unite(expect, np.array([i]), np.array([j])) if expect[i] != expect[j] else expect
        assert labels.tolist() == expect.tolist()


def test_large_buckets_in_pairs_of_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 40)
    draw = np.random.default_rng(12)
    base = draw.integers(0, 1 << 62, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << np.uint64(k)) for k in range(9))]))
    rows = [(0, i % 2, int(f), int(f)) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "tab int, key long, node long, fp long")
    found = {tuple(sorted((r.a, r.b))) for r in simhash.links_in(simhash.in_pairs(df, f"{tmp_path}/b"), 2).collect()}
    labels, at = np.arange(len(fps)), {int(f): i for i, f in enumerate(fps)}
    labels = simhash.unite(labels, np.array([at[a] for a, _ in found]), np.array([at[b] for _, b in found]))
    expect = np.arange(len(fps))
    for i in range(len(fps)):
        near = [j for j in range(len(fps)) if (i - j) % 2 == 0 and (int(fps[i]) ^ int(fps[j])).bit_count() <= 2]
        expect = simhash.unite(expect, np.full(len(near), i), np.array(near))
    assert labels.tolist() == expect.tolist()


def test_marks_of_large_files_are_joined(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MARKS", 1)
    text = " ".join(map(str, range(100)))
    docs = [(1, text), (2, text + " more"), (3, "other words"), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in simhash.similar_groups(df).collect()} == {1: 1, 2: 1}


def test_links_of_other_radii(spark):
    draw = np.random.default_rng(9)
    base = draw.integers(0, 1 << 63, 300, dtype=np.uint64)
    for radius in (0, 2, 6, 7):
        # Bits spread over the whole width, so that few blocks agree.
        other = base ^ np.array([np.bitwise_or.reduce(np.uint64(1) << draw.choice(64, max(radius, 1), replace=False).astype(np.uint64)) for _ in base])
        fps = np.unique(np.concatenate([base, other]))
        near = np.bitwise_count(fps[:, None] ^ fps[None]) <= radius
        expect = {(int(fps[i]), int(fps[j])) for i, j in zip(*np.nonzero(near), strict=True) if i < j}
        frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
        found = [tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in simhash.links(frame, len(fps), radius).collect()]
        at = {int(f): i for i, f in enumerate(fps)}
        trees = [simhash.unite(np.arange(len(fps)), np.array([at[a] for a, _ in some], int), np.array([at[b] for _, b in some], int)).tolist() for some in (found, expect)]
        assert trees[0] == trees[1] and set(found) <= expect and all(a != b for a, b in found) and (len(expect) >= 300 or radius == 0)
    with pytest.raises(ValueError):
        simhash.links(frame, len(fps), 8)
