"""SimHash near-duplicates, compared bit-sliced.

Fingerprints are made in one pass over the scan.  Equal ones collapse first, so a group of exact
copies is one row from then on.  Candidates come from all ways to choose equal blocks: with
``n + RADIUS`` blocks, fingerprints that differ in at most ``RADIUS`` bits agree on some ``n`` of
them, so no pair within the radius is missed; more blocks are used as fingerprints grow in
number, which keeps buckets small.  Each bucket yields a spanning forest of its links, never all
pairs, and components are contracted in Spark.

Buckets of all sizes are compared vertically: bit planes hold one bit of 64 fingerprints per
word, differences of three planes at a time go through a carry-save adder into bitwise counters,
and words in which every counter exceeds the radius are abandoned.  Small buckets lie side by side
in the planes, and a pair counts if its bucket is one.  A bucket of more than ``BUCKET`` entries is
dealt in blocks, each pair of which is a comparison for any task.

Defined results: null or empty text has no words and fingerprint zero, linked like any other;
repeated rows share a component; a null ``doc_id`` takes the smallest id of its component, or
null if there is none; an empty table gives no rows.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import new_folder, slices, table
from .graph import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: (fingerprints up to, blocks, blocks that agree)
TABLES = ((1 << 24, 6, 2), (1 << 30, 7, 3), (1 << 63, 8, 4))
#: Fingerprints that are asked at once, and that they are compared with at once.
QUERIES, PLACES = 256, 1 << 14
#: Entries of a bucket that one task compares; larger buckets are dealt in pairs of blocks.
BUCKET = 8192
ONE = np.uint64(1)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - shingle] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(((2 * counts > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the trees of each a and b; a label is its tree's smallest index."""
    while True:
        ra, rb = labels[a], labels[b]
        apart = ra != rb
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (deeper := labels[labels]).tobytes() != labels.tobytes():
            labels = deeper


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit j of word w of plane b is bit b of fingerprint 64 w + j, which may have several words."""
    fps = fps.reshape(len(fps), -1)
    padded = np.zeros((-(-len(fps) // 64) * 64, fps.shape[1]), "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(queries: np.ndarray, planes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indices (query, place) of all fingerprints of the planes within the radius.

    Fingerprints are rows of one or more 64-bit words; ``planes`` has 64 planes for each.
    """
    queries = queries.reshape(len(queries), -1)
    total = len(planes)
    # Counter bits 1, 2, 4 and so on up to the radius; the last row says that they ran over.
    width = max(radius, 1).bit_length()
    columns = np.arange(planes.shape[1])
    c = np.zeros((width + 1, len(queries), len(columns)), np.uint64)

    def add(bit: int, x: np.ndarray) -> None:
        for k in range(bit, width):
            carry = c[k] & x
            c[k] ^= x
            x = carry
        c[width] |= x

    def exceeds() -> np.ndarray:
        over, same = c[width].copy(), np.full_like(c[0], FULL)
        for k in range(width - 1, -1, -1):
            if radius >> k & 1:
                same &= c[k]
            else:
                over |= same & c[k]
                same &= ~c[k]
        return over

    def difference(b: int) -> np.ndarray:
        mask = np.where((queries[:, b >> 6] >> np.uint64(b & 63)) & ONE, FULL, np.uint64(0))
        return planes[b][None, columns] ^ mask[:, None]

    step = max(1, total // 16)
    looked = 0
    for b in range(0, total - 2, 3):
        x, y, z = (difference(b + i) for i in range(3))
        half = x ^ y
        add(0, half ^ z)
        add(1, (x & y) | (half & z)) if width > 1 else np.bitwise_or(c[width], (x & y) | (half & z), out=c[width])
        if b > radius and b - looked >= 3 * step:
            looked = b
            alive = (exceeds() != FULL).any(0)
            if not alive.all():
                columns, c = columns[alive], np.ascontiguousarray(c[:, :, alive])
                if not len(columns):
                    return np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in range(total - total % 3, total):
        add(0, difference(b))
    near = np.unpackbits(np.ascontiguousarray(~exceeds()).astype("<u8").view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little")
    q, place = near.nonzero()
    return q, columns[place >> 6] * 64 + (place & 63)


def links_of_runs(runs: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each run of equal, sorted numbers, as index pairs.

    Runs of any length are compared alike: many short ones share the words of a plane, and a pair
    counts only if its run is one.  A query meets the planes from its own place to its run's end.
    """
    n = len(runs)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    labels, planes = np.arange(n), planes_of(fps)
    ends = np.searchsorted(runs, runs, "right")
    for at in range(0, n, QUERIES):
        stop = int(ends[min(at + QUERIES, n) - 1])
        for first in range(at // 64, -(-stop // 64), PLACES // 64):
            last = min(first + PLACES // 64, -(-stop // 64))
            q, place = within(fps[at : at + QUERIES], planes[:, first:last], radius)
            q, place = q + at, place + first * 64
            ok = place > q
            q, place = q[ok], place[ok]
            ok = place < ends[q]
            labels = unite(labels, q[ok], place[ok])
    child = np.flatnonzero(labels != np.arange(n))
    return child, labels[child]


def runs_of(keys: list[np.ndarray]) -> np.ndarray:
    """Numbers of the runs in which all of the sorted keys are equal."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def links_in(entries: DataFrame, radius: int) -> DataFrame:
    """``a, b``: links of ``tab, key, one, two, node, fp`` between nodes of equal first four.

    ``fp`` is a long, or binary of several words.  Streams the sorted entries of a task; what is held is a
    batch and a run, which is of bounded length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def flush(part: list[np.ndarray]) -> pa.RecordBatch:
            runs, nodes, fps = runs_of(part[:4]), part[4], part[5]
            # Most buckets hold one entry: they have nothing to compare.
            size = np.bincount(runs) if len(runs) else np.zeros(0, int)
            some = size[runs] > 1 if len(runs) else np.zeros(0, bool)
            nodes = nodes[some]
            a, b = links_of_runs(runs[some], fps[some], radius)
            return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            fps = batch.column(5)
            fps = fps.to_numpy().view(np.uint64).reshape(-1, 1) if pa.types.is_int64(fps.type) else np.frombuffer(b"".join(fps.to_pylist()), "<u8").reshape(len(batch), -1)
            part = [*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)), fps]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part, strict=True)]
            runs = runs_of(part[:4])
            end = int(np.searchsorted(runs, runs[-1]))  # the last run may go on
            yield flush([x[:end] for x in part])
            held = [x[end:] for x in part]
        if held is not None:
            yield flush(held)

    where = ["tab", "key", "one", "two"]
    dealt = entries.select(*where, "node", "fp").repartition(*where).sortWithinPartitions(*where)
    return dealt.mapInArrow(run, "a long, b long").where("a != b")


def in_pairs(entries: DataFrame, folder: str) -> DataFrame:
    """Adds ``one`` and ``two`` to ``tab, key, node, fp``: buckets as pairs of blocks.

    A bucket of more than ``BUCKET`` entries is dealt in blocks of about half that, and each pair
    of blocks is compared on its own, by any task.  Only sizes of such buckets are written.
    """
    large = entries.groupBy("tab", "key").count().where(F.col("count") > BUCKET)
    large.select("tab", "key", F.ceil(F.col("count") / (BUCKET // 2)).cast("int").alias("blocks")).write.parquet(folder)
    sized = entries.join(entries.sparkSession.read.parquet(folder), ["tab", "key"], "left")
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.coalesce("blocks", F.lit(1))).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda other: F.struct(F.least(own, other).alias("one"), F.greatest(own, other).alias("two")))
    return sized.select("tab", "key", "node", "fp", F.explode(others).alias("p")).select("tab", "key", "p.one", "p.two", "node", "fp")


def layout(count: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """The tables for so many fingerprints: of each, the (shift, bits) whose values make its key."""
    if not 0 <= radius < 8:
        raise ValueError("the bitwise counters hold a radius of 0 to 7")
    agree = next(k for most, _, k in TABLES if count <= most)
    blocks = agree + radius
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    spans = [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [list(chosen) for chosen in combinations(spans, agree)]


def links(fps: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links between different fingerprints ``fp`` that connect all within the radius."""
    entries = []
    for tab, chosen in enumerate(layout(count, radius)):
        key = F.lit(0).cast("long")
        for shift, bits in chosen:
            part = F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long"))
            key = F.shiftleft(key, bits).bitwiseOR(part) if bits < 64 else part
        entries.append(F.struct(F.lit(tab).alias("tab"), key.alias("key")))
    rows = fps.select(F.col("fp").alias("node"), "fp", F.explode(F.array(*entries)).alias("e")).select("e.tab", "e.key", "node", "fp")
    return links_in(in_pairs(rows, new_folder(fps.sparkSession, "buckets")), radius)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id``."""
    spark = docs.sparkSession
    folder = new_folder(spark, "simhash")
    fingerprints(docs).write.parquet(f"{folder}/docs")
    rows = spark.read.parquet(f"{folder}/docs")
    rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).write.parquet(f"{folder}/fps")
    fps = spark.read.parquet(f"{folder}/fps")
    roots = components(links(fps, fps.count(), radius))
    # Only fingerprints that copies or links have in common go back to the documents.
    linked = fps.join(roots, fps.fp == roots.node, "left").where("n > 1 OR root IS NOT NULL").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked.join(least, "root").select("fp", "component_id").write.parquet(f"{folder}/linked")
    return rows.join(spark.read.parquet(f"{folder}/linked"), "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


# --- groups by similarity of five-word shingles --------------------------------------------------
#
# Similarity is the cosine of two documents' sets of shingles, which is what a SimHash estimates: a
# bit differs with the share of the angle in a half circle.  At 0.8 that is 0.2, some 13 bits of
# 64, where no choice of equal blocks selects.  So buckets come from bands of min-wise hashes (a pair
# of a cosine of 0.8 has a Jaccard similarity of 0.64 or more and shares a band with probability
# 0.99997), and fingerprints of 256 bits, compared bit-sliced, screen them: 52 bits differ at 0.8,
# 64 between sets of three and two shingles, with a deviation of 7.  The sets of shingles themselves
# decide.  A Jaccard similarity of 0.8 is a cosine of 0.88 or more.

SET_SHINGLE, ROWS, BANDS, WORDS, WIDE_RADIUS = 5, 2, 20, 4, 88
#: The least similarity as a fraction.
PART, WHOLE = 4, 5
#: Shingles of a group in a piece and in a block of a larger one, about; leaders of a group.
PIECE, BLOCK, LEADERS = 1 << 15, 1 << 17, 4
#: Marks of one input file that a task looks up; documents of files with more are joined.
MARKS = 1 << 20
_DRAW = np.random.default_rng(17)
FACTORS = _DRAW.integers(0, 1 << 63, (ROWS * BANDS, 2), dtype=np.uint64) * np.uint64(2) + ONE
LANES = _DRAW.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + ONE


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Hashes of the different five-word shingles, in order."""
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SET_SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - SET_SHINGLE] + 1])
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[SET_SHINGLE - 1 :].tolist(), strict=True)], np.uint64))


def words_in(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def sketch(text: str | None) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Digest of the word sequence, size, wide fingerprint and band keys of the set of shingles."""
    words = words_in(text)
    hashes = shingle_set(words)
    least = np.array([(hashes * f + g).min() for f, g in FACTORS], np.uint64).reshape(BANDS, ROWS)
    bands = mix(mix(least[:, 0] + np.arange(BANDS, dtype=np.uint64)) ^ least[:, 1])
    wide = np.empty(WORDS, np.uint64)
    for k in range(WORDS):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 8192):
            counts += np.unpackbits(mix(hashes[at : at + 8192] * LANES[k]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        wide[k] = ((2 * counts > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum()
    return xxhash.xxh64_intdigest(b" ".join(words), 7), len(hashes), wide, bands


def sketches(docs: DataFrame) -> DataFrame:
    """One row per document: what decides its candidates, and its 64-bit fingerprint ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [(*sketch(text), fingerprint(text)) for text in (t.as_py() for t in batch.column(1))]
            node, fp = (np.fromiter((f[k] for f in found), np.uint64, len(found)).view(np.int64) for k in (0, 4))
            wide = pa.array([f[2].astype("<u8").tobytes() for f in found], pa.binary())
            bands = pa.array([f[3].view(np.int64).tolist() for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), pa.array(fp), pa.array([f[1] for f in found], pa.int64()), wide, bands, batch.column(2)], ["doc_id", "node", "fp", "size", "wide", "bands", "file"])

    return docs.select("doc_id", "text", "file").mapInArrow(run, "doc_id long, node long, fp long, size long, wide binary, bands array<long>, file long")


def forest(n: int, near: Callable[[int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a symmetric relation of n things; ``near`` gives the partners of one.

    Leaders first gather what is near them; pairs inside the largest tree are then connected
    already, and only the others are compared with all.
    """
    labels, alone = np.arange(n), np.ones(n, bool)
    for _ in range(16):
        i = int(alone.argmax())
        if not alone[i]:
            break
        found = near(i)
        alone[found] = False
        alone[i] = False
        labels = unite(labels, np.full(len(found), i), found)
    largest = np.bincount(labels).argmax()
    for i in np.flatnonzero(labels != largest).tolist():
        found = near(i)
        labels = unite(labels, np.full(len(found), i), found)
    child = np.flatnonzero(labels != np.arange(n))
    return child, labels[child]


def wide_links(nodes: DataFrame, folder: str, radius: int = WIDE_RADIUS) -> DataFrame:
    """``a, b``: links between documents of different word sequences, connected per band."""
    entries = nodes.select(F.posexplode("bands").alias("tab", "key"), F.col("doc_id").alias("node"), F.col("wide").alias("fp"))
    return links_in(in_pairs(entries.select("tab", "key", "node", "fp"), folder), radius)


def similar_in(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of sets whose cosine is 0.8 or more, by shared members."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(sizes)
    _, member = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(member, kind="stable")]
    count = np.bincount(member)
    first = np.cumsum(count) - count

    def near(i: int) -> np.ndarray:
        own = member[ends[i] - sizes[i] : ends[i]]
        many = count[own]
        places = np.repeat(first[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
        common = np.bincount(holders[places], minlength=len(sets))
        return np.flatnonzero((WHOLE * common) ** 2 >= PART**2 * sizes[i] * sizes)

    return forest(len(sets), near)


def joined(pieces: DataFrame) -> DataFrame:
    """``root, doc_id, rep`` for each piece of ``root, one, two, first, doc_id, text``.

    ``rep`` stands for all that are connected inside the piece: the smallest id, of those marked
    ``first`` if there are any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, late, sets = None, [], [], []

        def flush() -> pa.RecordBatch:
            reps: list[int] = []
            if sets:
                child, parent = similar_in(sets)
                tree = np.arange(len(sets))
                tree[child] = parent
                best = np.full(len(sets), len(sets))
                rank = np.lexsort((ids, late))
                np.minimum.at(best, tree[rank], np.arange(len(sets)))
                reps = [ids[rank[k]] for k in best[tree].tolist()]
            root = key[0] if key else 0
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([root] * len(ids), ids, reps)], ["root", "doc_id", "rep"])

        for batch in slices(batches, 5):
            for *k, first, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    yield flush()
                    key, ids, late, sets = k, [], [], []
                ids.append(doc_id)
                late.append(not first)
                sets.append(shingle_set(words_in(text)))
        yield flush()

    dealt = pieces.select("root", "one", "two", "first", "doc_id", "text").repartition("root", "one", "two").sortWithinPartitions("root", "one", "two")
    return dealt.mapInArrow(run, "root long, doc_id long, rep long")


def share(parts: str) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.col(parts)).cast("int")


def every(parts: str) -> Column:
    return F.sequence(F.lit(0), F.col(parts) - 1)


def verified_links(members: DataFrame, folder: str) -> DataFrame:
    """``a, b`` that connect all similar documents of each group of ``doc_id, root, size, text``.

    A group is dealt in pieces of bounded size.  A few of its members, drawn by hash, are leaders
    and go to every piece, so that what is like them is one cluster across pieces.  Whoever is not
    in a group's largest cluster then meets the whole group, in blocks: what lies inside that
    cluster is connected already.
    """
    spark = members.sparkSession
    leaders = F.array(*[F.min(F.struct(F.xxhash64("doc_id", F.lit(k)).alias("h"), "doc_id"))["doc_id"] for k in range(LEADERS)])
    totals = members.groupBy("root").agg(F.ceil(F.sum("size") / PIECE).cast("int").alias("parts"), F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"), leaders.alias("leaders"))
    totals.write.parquet(f"{folder}/totals")
    totals = spark.read.parquet(f"{folder}/totals")
    placed = members.join(totals, "root").withColumn("first", F.array_contains("leaders", F.col("doc_id")))
    dealt = placed.select("root", F.explode(F.when(F.col("first"), every("parts")).otherwise(F.array(share("parts")))).alias("one"), F.lit(0).alias("two"), "first", "doc_id", "text")
    joined(dealt).write.parquet(f"{folder}/inside")
    inside = spark.read.parquet(f"{folder}/inside")
    large = totals.where("parts > 1").select("root", "blocks")
    clusters = inside.join(large, "root").groupBy("root", "blocks", "rep").agg(F.count("*").alias("n")).groupBy("root", "blocks").agg(F.max_by("rep", F.struct("n", "rep")).alias("main"))
    inside.join(clusters, "root").where("rep != main").select("root", "blocks", "doc_id").distinct().write.parquet(f"{folder}/outside")
    outside = spark.read.parquet(f"{folder}/outside")
    asked = outside.join(members.select("root", "doc_id", "size", "text"), ["root", "doc_id"])
    asking = asked.groupBy("root", "blocks").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("rows"))
    whole = members.join(asking, "root").select("root", share("blocks").alias("one"), F.explode(every("rows")).alias("two"), F.lit(False).alias("first"), "doc_id", "text")
    parts = asked.join(asking.select("root", "rows"), "root").select("root", F.explode(every("blocks")).alias("one"), share("rows").alias("two"), F.lit(False).alias("first"), "doc_id", "text")
    across = joined(whole.unionByName(parts))
    return inside.unionByName(across).where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()


def members_of(docs: DataFrame, marks: str) -> DataFrame:
    """``doc_id, root, size, text`` of the documents that ``marks`` names, without a shuffle.

    Marks lie in the shared folder, one partition per input file; the task that reads a file looks
    up its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in batches:
            rows: list[tuple] = []
            for at, (doc_id, file) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if file != now:
                    now, known = file, {}
                    system, path = fs.FileSystem.from_uri(marks)
                    for info in system.get_file_info(fs.FileSelector(f"{path}/file={file}", allow_not_found=True)):
                        if info.path.endswith(".parquet"):
                            with system.open_input_file(info.path) as part:
                                known |= {r["doc_id"]: (r["root"], r["size"]) for r in pq.ParquetFile(part).read(["doc_id", "root", "size"]).to_pylist()}
                if doc_id in known:
                    rows.append((at, *known[doc_id]))
            chosen = batch.take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([chosen.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)), chosen.column(1)], ["doc_id", "root", "size", "text"])

    return docs.select("doc_id", "text", "file").mapInArrow(run, "doc_id long, root long, size long, text string")


def members(docs: DataFrame, folder: str, schema: StructType) -> DataFrame:
    """As ``members_of``; the documents of files with more than ``MARKS`` marks are joined by id."""
    marks = docs.sparkSession.read.schema(schema).parquet(folder)
    large = [r.file for r in marks.groupBy("file").count().where(F.col("count") > MARKS).select("file").collect()]
    if not large:
        return members_of(docs, folder)
    joined = docs.where(F.col("file").isin(large)).join(marks.where(F.col("file").isin(large)).select("doc_id", "root", "size"), "doc_id").select("doc_id", "root", "size", "text")
    return members_of(docs.where(~F.col("file").isin(large)), folder).unionByName(joined)


def similar_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, group_id`` for documents with others in their group; group_id is the smallest id.

    Documents are linked if the cosine of their sets of five-word shingles is 0.8 or more, or
    if their 64-bit fingerprints are within the radius.  Equal word sequences collapse before
    candidates are made; candidates meet in coarse groups, where the sets decide.  Null ids take
    no part.  Rows that repeat an id are one document that has the links of all its texts.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "similar")
    named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.input_file_name()).alias("file"))
    sketches(named).write.parquet(f"{folder}/docs")
    rows = spark.read.parquet(f"{folder}/docs")
    ids = rows.select("doc_id", "node")
    ids.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).write.parquet(f"{folder}/first")
    first = spark.read.parquet(f"{folder}/first")
    rows.join(first, (F.col("doc_id") == F.col("first")) & (rows.node == first.node), "left_semi").dropDuplicates(["node"]).write.parquet(f"{folder}/nodes")
    nodes = spark.read.parquet(f"{folder}/nodes")
    coarse = components(wide_links(nodes, f"{folder}/buckets"))
    sized = nodes.select(F.col("doc_id").alias("node"), "size", "file")
    marks = coarse.join(sized, "node").groupBy("file", F.col("node").alias("doc_id"), "root").agg(F.max("size").alias("size"))
    marks.repartition("file", F.pmod(F.xxhash64("doc_id"), F.lit(16))).write.partitionBy("file").parquet(f"{folder}/marks")
    members(named, f"{folder}/marks", marks.schema).write.parquet(f"{folder}/members")
    exact = verified_links(spark.read.parquet(f"{folder}/members"), folder)
    copies = ids.join(first.where("n > 1"), "node").where("doc_id != first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    by_fp = nodes.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    by_fp.write.parquet(f"{folder}/fps")
    by_fp = spark.read.parquet(f"{folder}/fps")
    same_fp = nodes.select("fp", "doc_id").join(by_fp.where("n > 1"), "fp").where("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    one, two = (by_fp.select(F.col("fp").alias(x), F.col("id").alias(f"{x}_id")) for x in ("a", "b"))
    close = links(by_fp.select("fp"), by_fp.count()).join(one, "a").join(two, "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    found = components(exact.unionByName(copies).unionByName(same_fp).unionByName(close))
    return found.select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
