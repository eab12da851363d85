import random
import re
from collections import Counter

from brindle.llm import decontaminate


def shingles(text):
    words = re.sub(r"[^\w\s]|_", "", (text or "").lower()).split()
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def brute(docs, items):
    out = {}
    goals = [(i, shingles(t)) for i, t in items if shingles(t)]
    for d, text in docs:
        have = shingles(text)
        mine = set(have)
        for i, goal in goals:
            if not mine.intersection(goal):
                continue
            want = Counter(goal)
            for s in range(-len(goal) + 1, len(have)):
                window = Counter(have[max(0, s) : s + len(goal)])
                common = sum((window & want).values())
                sim = common / (sum(window.values()) + len(goal) - common)
                if sim >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), sim)
    return out


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.query(spark, sf).collect()}
    expect = brute(docs, items)
    assert found.keys() == expect.keys()
    assert all(abs(found[k] - expect[k]) < 1e-9 for k in expect)
    assert expect


def test_edits_and_odd_rows(spark):
    item = " ".join(f"w{i}" for i in range(60))
    changed = item.replace("w30 ", "other ")
    looped = "a b c d e " * 12
    docs = [(1, f"x y z {item.upper()}! tail", 0), (2, f"lead {changed} more", 0), (3, item[: len(item) // 2], 0), (4, None, 0), (5, "", 0), (6, "tiny item", 0), (7, f"{looped} {looped}", 0), (None, item, 0), (1, f"x y z {item}", 0), (8, "q " * 30_000 + item, 0), (9, "a tiny item here", 0)]
    items = [(10, item, "t"), (11, item, "t"), (12, None, "t"), (13, "", "t"), (14, "Tiny item!", "t"), (15, looped, "t")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    assert found == {(k, i) for k in (1, 2, None, 8) for i in (10, 11)} | {(6, 14), (7, 15)}
    assert decontaminate.contaminated(d.limit(0), b).count() == 0
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0


def test_every_start_counts(spark):
    """Reordered, repeated and edited items in longer documents, against all windows."""
    draw = random.Random(3)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(n))) for i, n in enumerate((60, 61, 90, 44))] + [(4, "a b c d e f " * 9), (5, "g h g h i " * 7 + "j k l m n o p q")]
    docs = []
    for i, text in items:
        words = text.split()
        third = len(words) // 3
        for cut in (len(words) // 2, third, 2 * third):
            for lead in (0, 3, 40):
                docs.append(" ".join([*["x"] * lead, *words[cut:], *words[:cut], *["y"] * draw.choice((0, 2, 50))]))
        for lead in (0, 20):
            changed = [w if draw.random() > 0.03 else "other" for w in words]
            docs.append(" ".join([*["x"] * lead, *changed[:third], *["z"] * draw.choice((1, 3)), *changed[third:], *changed[:third]]))
            docs.append(" ".join([*["x"] * lead, *words[4:], *["y"] * lead]))
    docs = list(enumerate(docs))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(d, b).collect()}
    expect = brute(docs, items)
    assert found.keys() == expect.keys()
    assert all(abs(found[k] - expect[k]) < 1e-9 for k in expect)
    assert len(expect) > 40
