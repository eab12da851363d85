"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact similarity.

A window is as many words as a benchmark item has; both are multisets of five-word shingles and
a document is contaminated if one of its windows has weighted (multiset) Jaccard similarity of
``SIMILARITY`` or more with the item.  Words are compared in lower case without punctuation.

All of it is column expressions and joins, in four steps.

1. *Where items can be.*  A window of that similarity consists of the item's shingles for the
   most part.  A bit filter over all items' shingles (two probes, at most ``MOST_BITS`` bits) marks
   a document's hits; documents with fewer hits than the least item needs are left behind in the
   scan.  The filter has false hits but misses none, so this loses nothing.
2. *Fingerprints.*  Every item-sized window of the others that begins at a hit and holds enough
   hits is fingerprinted: ``BITS`` bit counts of its shingles, several to a long, and a majority.
   Other starts need none: a window that begins inside the document gets no worse by moving right
   to the next hit, and one cut off by the document's begin gets no worse by ending at its last.
3. *Multi-index.*  Fingerprints are cut in ``BLOCKS`` blocks.  Items are entered under every value
   within ``NEAR`` bits of each block, so any two fingerprints within ``RADIUS`` bits, which is
   ``BLOCKS * (NEAR + 1) - 1``, meet in some block: no pair within the radius is missed.
4. *Verification.*  For the pairs found, the best window over all starts is computed exactly.  A
   hit counts in a window unless as many equal shingles as the item has stand before it there, so
   one sweep over the hits gives the overlap at every start.

At a similarity of 0.8 a bit differs with probability 0.15, some 9.5 of 63 with a deviation of
2.8; the radius of 20 leaves 0.0001 of such windows out.

What is written out in between are items and documents with enough hits, never the corpus.  The
planner knows the sizes and broadcasts what is under its threshold; beyond it both sides are dealt
by hash.

Defined results: null and empty texts match nothing; items without words are never found; items
of fewer than five words match documents that are just these words; repeated documents and items
are reported under their ids, a null ``doc_id`` as null; empty tables give no rows; very long texts
and items take time in proportion to their hits; of windows that tie any will do.  Only ``doc_id``
and ``text``, ``item_id`` and ``text`` are read, so other columns may have any names.
"""

from __future__ import annotations

import functools
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import built_fast, new_folder, once, table, words_of

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints, and counters of 9 bits (windows of up to 511 shingles) or of 21, 63 bits a long.
BITS, COUNTERS = 63, (9, 21)
BLOCKS, NEAR = 7, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Bits of the filter for each item shingle, and at most.
BITS_EACH, MOST_BITS = 64, 1 << 23


def shingles(text: Column) -> tuple[Column, Column]:
    """The normalised words, and from the column ``__words`` the hashes of their shingles."""
    plain = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    words = F.col("__words")
    hashes = F.when(F.size(words) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))).when(F.size(words) > 0, F.array(F.xxhash64(words)))
    return words_of(plain), hashes


def with_shingles(rows: DataFrame, key: str, number: str) -> DataFrame:
    """``number`` tells rows apart that repeat a key."""
    words, hashes = shingles(F.col("text"))
    return rows.select(key, F.monotonically_increasing_id().alias(number), once(words).alias("__words")).select(key, number, once(hashes).alias("__h")).where("__h IS NOT NULL")


def needed(m: Column, size: Column | None = None) -> Column:
    """The fewest shingles that an item of m must share with a window of this size, or of any."""
    least = SIMILARITY * m if size is None else SIMILARITY / (1 + SIMILARITY) * (m + size)
    return F.ceil(least - 1e-6).cast("int")


# --- the filter ---------------------------------------------------------------------------------


def probes(h: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(h, by).bitwiseAND(F.lit(bits - 1).cast("long")) for by in (0, 32)]


def filter_of(wanted: DataFrame) -> tuple[list[int], int]:
    """The filter's words, and its number of bits, which is bounded whatever the items are."""
    hashes = wanted.select("hash").distinct()
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(12, (BITS_EACH * hashes.count()).bit_length()))
    at = hashes.select(F.explode(F.array(*probes(F.col("hash"), bits))).alias("p"))
    word = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    words = [0] * (bits >> 6)
    for r in at.groupBy(F.shiftright("p", 6).cast("int").alias("i")).agg(F.bit_or(word).alias("w")).collect():
        words[r.i] = r.w
    return words, bits


def is_hit(h: Column, words: Column, bits: int) -> Column:
    tests = [F.call_function("getbit", F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1 for p in probes(h, bits)]
    return functools.reduce(lambda a, b: a & b, tests)


# --- fingerprints -------------------------------------------------------------------------------


def packed(width: int, value: int = 1) -> int:
    return sum(value << i for i in range(0, BITS, width))


def simhash(hashes: Column, size: Column, width: int) -> Column:
    """Fingerprint of an array of hashes: ``width`` longs of counters ``width`` bits wide."""
    ones, tops = F.lit(packed(width)).cast("long"), F.lit(packed(width, 1 << (width - 1))).cast("long")
    start = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in range(width)])
    add = lambda a, h: F.struct(*[(a[f"c{k}"] + F.shiftright(h, k).bitwiseAND(ones)).alias(f"c{k}") for k in range(width)])
    # A counter's top bit is set if it and this make half its range, that is if it is the majority.
    more = (F.lit(1 << (width - 1)) - 1 - F.floor(size / 2)).cast("long") * ones

    def majority(a: Column) -> Column:
        lanes = [F.shiftleft(F.shiftright((a[f"c{k}"] + more).bitwiseAND(tops), width - 1), k) for k in range(width)]
        return functools.reduce(lambda x, y: x.bitwiseOR(y), lanes)

    return F.aggregate(hashes, start, add, majority)


def fingerprint(hashes: Column, size: Column) -> Column:
    small, large = COUNTERS
    return F.when(size < 1 << small, simhash(hashes, size, small)).otherwise(simhash(hashes, size, large))


def windows(hashes: Column, hits: Column, sizes: Column) -> Column:
    """(m, fp) of the windows that an item of one of the sizes may be in; ``hits`` are positions."""
    n = F.size(hashes)

    def of(m: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(hits) - 1)
        begin = F.transform(numbers, lambda i: F.struct(m.alias("m"), F.get(hits, i).alias("at"), F.least(m, n - F.get(hits, i)).alias("size"), i.alias("first")))
        whole = F.filter(begin, lambda w: F.get(hits, w["first"] + needed(m, w["size"]) - 1) < w["at"] + w["size"])
        end = F.transform(F.filter(numbers, lambda i: (F.get(hits, i) < m - 1) & (i + 1 >= needed(m, F.get(hits, i) + 1))), lambda i: F.struct(m.alias("m"), F.lit(0).alias("at"), (F.get(hits, i) + 1).alias("size"), F.lit(0).alias("first")))
        return F.concat(whole, end)

    fitting = F.filter(sizes, lambda m: needed(m) <= F.size(hits))
    every = F.flatten(F.transform(fitting, of))
    return F.transform(every, lambda w: F.struct(w["m"].alias("m"), fingerprint(F.slice(hashes, w["at"] + 1, w["size"]), w["size"]).alias("fp")))


# --- blocks -------------------------------------------------------------------------------------


def block_values(fp: Column) -> list[Column]:
    width = BITS // BLOCKS
    return [F.shiftright(fp, b * width).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for b in range(BLOCKS)]


def near_values() -> list[int]:
    return [sum(1 << i for i in chosen) for k in range(NEAR + 1) for chosen in combinations(range(BITS // BLOCKS), k)]


def keyed(values: list[Column]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(b).alias("block"), v.alias("value")) for b, v in enumerate(values)])).alias("key")


def entered(items: DataFrame) -> DataFrame:
    """``block, value, m, item, item_fp``: the multi-index over ``item, m, item_fp``."""
    rows = items.select("item", "m", "item_fp", keyed(block_values(F.col("item_fp"))))
    return rows.select("item", "m", "item_fp", F.col("key.block").alias("block"), F.explode(F.transform(F.array(*[F.lit(x).cast("long") for x in near_values()]), lambda x: x.bitwiseXOR(F.col("key.value")))).alias("value"))


def met(found: DataFrame, index: DataFrame) -> DataFrame:
    """``doc, item`` whose fingerprints ``fp`` of a window and ``item_fp`` are within the radius."""
    asked = found.select("doc", "m", "fp", keyed(block_values(F.col("fp")))).select("doc", "m", "fp", "key.block", "key.value")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    return asked.join(index, ["m", "block", "value"]).where(near).select("doc", "item").distinct()


# --- verification -------------------------------------------------------------------------------


def best_window(hits: Column, n: Column, m: Column) -> Column:
    """The highest similarity of a window; ``hits``: (pos, back), sorted.

    ``back`` is the position from which on an equal shingle is one too many, or -1.
    """
    begun = F.struct(F.lit(0).alias("common"), F.lit(0.0).alias("best"))
    ratio = lambda common, size: common / (size + m - common)

    def cut_off(a: Column, h: Column) -> Column:
        common = a["common"] + F.when(h["back"] < 0, 1).otherwise(0)
        return F.struct(common.alias("common"), F.when(h["pos"] < m, F.greatest(a["best"], ratio(common, h["pos"] + 1))).otherwise(a["best"]).alias("best"))

    # A hit counts for the starts after both its back and the window's length before it, up to itself.
    comes = F.transform(hits, lambda h: F.struct((F.greatest(h["back"], h["pos"] - m) + 1).alias("at"), F.lit(0).alias("starts")))
    starts = F.transform(hits, lambda h: F.struct(h["pos"].alias("at"), F.lit(1).alias("starts")))

    def inside(a: Column, e: Column) -> Column:
        now = F.greatest(a["best"], ratio(a["common"], F.least(m, n - e["at"])))
        return F.struct((a["common"] + F.when(e["starts"] == 1, -1).otherwise(1)).alias("common"), F.when(e["starts"] == 1, now).otherwise(a["best"]).alias("best"))

    return F.greatest(F.aggregate(hits, begun, cut_off, lambda a: a["best"]), F.aggregate(F.sort_array(F.concat(comes, starts)), begun, inside, lambda a: a["best"]))


def verified(pairs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, item_id, similarity`` of the pairs ``doc, item`` that reach ``SIMILARITY``."""
    at = rows.select("doc_id", "doc", F.size("__h").alias("n"), F.posexplode("__h").alias("pos", "hash"))
    shared = at.join(wanted, "hash").join(pairs, ["doc", "item"], "left_semi")
    grouped = shared.groupBy("doc", "item").agg(*[F.first(c).alias(c) for c in ("doc_id", "item_id", "n", "m")], F.collect_list(F.struct("hash", "pos", "times")).alias("hits"))
    enough = grouped.where(F.size("hits") >= needed(F.col("m"))).withColumn("hits", once(F.sort_array("hits")))
    earlier = lambda h, i: F.get("hits", i - h["times"])
    placed = F.transform("hits", lambda h, i: F.struct(h["pos"].alias("pos"), F.when(earlier(h, i)["hash"] == h["hash"], earlier(h, i)["pos"]).otherwise(-1).alias("back")))
    best = enough.withColumn("placed", once(F.sort_array(placed))).select("doc_id", "item_id", once(best_window(F.col("placed"), F.col("n"), F.col("m"))).alias("similarity"))
    return best.where(F.col("similarity") >= SIMILARITY).groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


@built_fast
def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, similarity``: the best window of each document for each item found."""
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "decontaminate")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    size = F.size("__h")
    items = written(with_shingles(benchmark.select("item_id", "text"), "item_id", "item").select("item_id", "item", size.alias("m"), fingerprint(F.col("__h"), size).alias("item_fp"), "__h"), "items")
    each = items.select("item_id", "item", "m", F.explode("__h").alias("hash"))
    wanted = written(each.groupBy("item", "hash").agg(F.first("item_id").alias("item_id"), F.first("m").alias("m"), F.count("*").cast("int").alias("times")), "shingles")
    sizes = sorted(r.m for r in items.select("m").distinct().collect())
    if not sizes:
        return docs.select("doc_id").join(benchmark.select("item_id"), F.lit(False)).select("doc_id", "item_id", F.lit(0.0).alias("similarity"))
    index = written(entered(items), "index")
    words, bits = filter_of(wanted)
    # The optimizer folds these into literals.
    marks = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    lengths = F.split(F.lit(",".join(map(str, sizes))), ",").cast("array<int>")
    hits = F.filter(F.transform("__h", lambda h, i: F.when(is_hit(h, marks, bits), i)), lambda i: i.isNotNull())
    least = min(-int(-(SIMILARITY * m - 1e-6) // 1) for m in sizes)
    rows = written(with_shingles(docs.select("doc_id", "text"), "doc_id", "doc").withColumn("hits", once(hits)).where(F.size("hits") >= least), "rows")
    found = rows.select("doc", F.explode(windows(F.col("__h"), F.col("hits"), lengths)).alias("w")).select("doc", "w.m", "w.fp")
    return verified(written(met(found, index), "pairs"), rows, wanted)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
