"""Removal of repeated 100-byte strings, by suffix arrays of what may repeat.

A window is a string of ``LENGTH`` bytes inside one document; every byte of a window that also
starts earlier (smaller ``doc_id``, or the same document further left) is removed.

1. *Segments.*  The key of a window is the least hash of its ``GRAM``-byte strings, so equal
   windows have equal keys.  Neighbouring windows of one key form a segment of some 35 windows,
   which is described by key, digest and place.  Descriptions, not texts, are dealt by key, after
   each task has set aside its own repeats.  Segments equal to an earlier one are removed whole;
   the first ones whose key has other segments too, or that repeat inside, are asked for.
2. *Suffix arrays.*  Each shard, some documents of a task, sorts the suffixes of the segments
   asked for by Larsson-Sadakane refinement in numpy: suffixes are ordered by eight bytes, then
   only groups that are still equal are ordered by the ranks of what follows, doubling the depth.
   Kasai's common prefixes tell which windows are equal; a shard marks its own repeats and passes
   on the digests of its first windows in order.
3. *Merging.*  Ordered shards meet by digest and are merged two by two by binary search; the later
   of two equal windows is removed.

Texts are not shuffled: marks go back to the tasks that read the documents through tables in the
shared folder, one partition per ``ROWS`` rows of an input file, so a file of any size is as many
partitions as it needs.  A frequent passage is one row per task in any exchange, and all else
spreads evenly.  Where an id is repeated or null, or the documents do not come from Parquet files,
each text is written once more by ranges of its number in the order of ids.

Defined results: null text is empty; texts under 100 bytes lose nothing; rows that repeat an id
with another text come in the order of a hash of the text, rows that repeat id and text are one
document, and null ids come last; an empty table gives no rows.  Only ``doc_id`` and ``text`` are
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, table

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Bytes hashed at once, segments gathered before they are dealt, bytes of a suffix array's shard.
CHUNK, GATHERED, SHARD = 1 << 18, 1 << 18, 1 << 20
#: Rows of an input file whose marks are kept, and loaded, together.
ROWS = 1 << 16
NULL_ID = (1 << 63) - 1
U64 = np.uint64


class Rolling:
    """Digests of all substrings: prefix sums of random byte values times powers, modulo 2**64."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.values = draw.integers(0, 1 << 63, 256, dtype=U64) * U64(2) + draw.integers(0, 2, 256, dtype=U64)
        self.base = int(draw.integers(1 << 40, 1 << 62)) * 8 + 5
        self.back = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def grow(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, b, U64)]), dtype=U64) for b in (self.base, self.back))

    def prefix(self, t: np.ndarray) -> np.ndarray:
        self.grow(len(t) + 1)
        out = np.zeros(len(t) + 1, U64)
        np.cumsum(self.values[t] * self.up[: len(t)], out=out[1:])
        return out

    def digest(self, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((prefix[stop] - prefix[start]) * self.down[start] + (stop - start).astype(U64))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(31))) * U64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(32))


FIRST, SECOND = Rolling(1), Rolling(2)
GRAM_VALUES = np.random.default_rng(9).integers(0, 1 << 63, 256, dtype=U64)


def window_keys(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and of each window the least of its grams' hashes."""
    h, width, factor = GRAM_VALUES[t], 1, 0x9E3779B97F4A7C15
    while width < GRAM:
        h = h[:-width] * U64(factor) + h[width:]
        width, factor = 2 * width, factor * factor & (1 << 64) - 1
    h = mix(h)
    m, width = h, 1
    while 2 * width <= SPAN:
        m, width = np.minimum(m[:-width], m[width:]), 2 * width
    return h, np.minimum(m[: len(m) - (SPAN - width)], m[SPAN - width :]) if SPAN > width else m


def segments(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Of each segment: document (index), start, windows, key, digest, and if its key recurs in it."""
    t = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    none = {"doc": np.zeros(0, np.int64), "a": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "m": np.zeros(0, U64), "d": np.zeros(0, U64), "own": np.zeros(0, bool)}
    if len(t) < LENGTH:
        return none
    h, m = window_keys(t)
    edge = np.zeros(len(t) + 1, np.int32)
    np.add.at(edge, np.maximum(starts, ends - LENGTH + 1), 1)
    np.add.at(edge, ends, -1)
    valid = np.cumsum(edge[: len(m)]) == 0
    if not valid.any():
        return none
    turn = np.empty(len(m), bool)
    turn[0], turn[1:] = True, (m[1:] != m[:-1]) | (valid[1:] != valid[:-1])
    at = np.flatnonzero(turn)
    stop = np.append(at[1:], len(m))
    inside = valid[at]
    at, stop = at[inside], stop[inside]
    n, key = stop - at, m[at]
    short, count = (h >> U64(32)).astype(np.uint32), np.zeros(len(at), np.int32)
    key32, last = (key >> U64(32)).astype(np.uint32), stop + SPAN - 2
    for k in range(int(min(n.max(initial=0), SPAN)) + SPAN - 1):
        place = at + k
        count += (short[np.minimum(place, len(short) - 1)] == key32) & (place <= last)
    doc = np.searchsorted(starts, at, "right") - 1
    prefix = FIRST.prefix(t)
    return {"doc": doc, "a": at - starts[doc], "n": n, "m": key, "d": FIRST.digest(prefix, at, stop + LENGTH - 1), "own": (count > 1) | (n > SPAN)}


# --- suffix arrays -------------------------------------------------------------------------------


def words_at(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, the first in front; zeros stand past the end."""
    padded = np.concatenate([t, np.zeros(8, np.uint8)]).astype(U64)
    word = np.zeros(len(t), U64)
    for k in range(8):
        word = (word << U64(8)) | padded[k : k + len(t)]
    return word


def suffix_array(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and each one's rank.  The order is whole: Kasai's bound needs that."""
    n = len(t)
    key = words_at(t)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 8
    while h < n:
        slots = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(slots):
            return order, rank
        suffix = order[slots]
        after = suffix + h
        both = rank[suffix] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(both)
        suffix, both = suffix[by], both[by]
        order[slots] = suffix
        new[slots[1:]] |= both[1:] != both[:-1]
        rank[suffix] = np.maximum.accumulate(np.where(new[slots], slots, 0))
        h *= 2
    # Zeros past the end may have tied with zeros of the text: these few go by their length.
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    if len(slots):
        by = np.lexsort((-order[slots], rank[order[slots]]))
        order[slots] = order[slots][by]
        rank[order[slots]] = slots
    return order, rank


#: A word under the k-th of these has k leading zero bytes or more.
ZERO_BYTES = [U64(1 << 64 - 8 * k) for k in range(1, 8)]


def kasai(t: np.ndarray, order: np.ndarray, cap: int = LENGTH, lanes: int = 2048) -> np.ndarray:
    """Common prefixes with the suffix before, up to ``cap``.

    Lanes run through the text abreast, each as Kasai's bound goes: a suffix has at least one byte
    less in common than the one that starts a byte before it.  Eight bytes are compared at once.
    """
    n = len(t)
    word = words_at(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    plcp = np.zeros(n, np.int64)
    steps = -(-n // lanes)
    lane = np.arange(0, n, steps)
    h = np.zeros(len(lane), np.int64)
    for s in range(steps):
        i = lane + s
        i = i[i < n]
        j = before[i]
        most = np.where(j < 0, 0, np.minimum(cap, n - np.maximum(i, j)))
        h = np.minimum(np.maximum(h[: len(i)] - 1, 0), most)
        go = np.flatnonzero(h < most)
        while len(go):
            differs = word[i[go] + h[go]] ^ word[j[go] + h[go]]
            same = np.where(differs == 0, 8, 0)
            for bound in ZERO_BYTES:
                same += (differs < bound) & (differs > 0)
            h[go] += same
            go = go[(same == 8) & (h[go] < most[go])]
        h = np.minimum(h, most)
        plcp[i] = h
    return plcp[order]


def equal_windows(t: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Group numbers of the windows at ``starts``: the same for equal windows."""
    order, _ = suffix_array(t)
    group = np.empty(len(t), np.int64)
    group[order] = np.cumsum(kasai(t, order) < LENGTH)
    return group[starts]


# --- exchanged blocks ----------------------------------------------------------------------------

BLOCK = "bucket long, kind int, fkey long, p binary, q binary, ids binary, a binary, n binary"
NAMES = [x.split()[0] for x in BLOCK.split(", ")]
KINDS = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
COVER, ASK, SEGMENT, WINDOW = range(4)


def small(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as all of them need; the reader divides by their count."""
    most = int(x.max(initial=0))
    return x.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def large(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // count}").astype(np.int64) if count else np.zeros(0, np.int64)


def block(bucket: int, kind: int, fkey: int, ids: np.ndarray, a: np.ndarray, n: np.ndarray | None = None, p: np.ndarray | None = None, q: np.ndarray | None = None) -> tuple:
    """Ids are stored as differences, which compress well where they are in order."""
    blobs = [b"" if x is None else x.astype("<u8").tobytes() for x in (p, q)]
    return bucket, kind, fkey, *blobs, np.diff(ids, prepend=0).astype("<i8").tobytes(), small(a), b"" if n is None else small(n)


def ids_of(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<i8"))


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], NAMES)


def split(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs with the places of its items, in their order."""
    if not len(buckets):
        return
    order = np.argsort(buckets, kind="stable")
    found, at = np.unique(buckets[order], return_index=True)
    for b, places in zip(found.tolist(), np.split(order, at[1:]), strict=True):
        yield b, places


def later(key: tuple[np.ndarray, ...], order: np.ndarray) -> np.ndarray:
    """Along an order, true for items whose key equals that of the item before."""
    same = np.zeros(len(order), bool)
    if len(order):
        same[1:] = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in key])
    return same


def blocks_of_segments(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        gathered = 0

        def emit() -> pa.RecordBatch:
            rows = []
            for fkey, parts in held.items():
                m, d, ids, a, n, own = (np.concatenate([p[i] for p in parts]) for i in range(6))
                order = np.lexsort((a, ids, d, m))
                again = later((m, d), order)
                rest, first = np.sort(order[again]), np.sort(order[~again])
                if len(rest):
                    rows.append(block(int(m[rest[0]] % U64(buckets)), COVER, fkey, ids[rest], a[rest], n[rest]))
                for b, k in split(m[first] % U64(buckets)):
                    k = first[k]
                    rows.append(block(b, SEGMENT, fkey, ids[k], 2 * a[k] + own[k], n[k], m[k], d[k]))
            held.clear()
            return batch_of(rows)

        for batch in batches:
            fkeys, ids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), [x.encode() for x in batch.column(2).to_pylist()]
            at = 0
            while at < len(texts):
                size, stop = 0, at
                while stop < len(texts) and fkeys[stop] == fkeys[at] and (stop == at or size + len(texts[stop]) <= CHUNK):
                    size += len(texts[stop])
                    stop += 1
                s = segments(texts[at:stop])
                held.setdefault(int(fkeys[at]), []).append((s["m"], s["d"], ids[at:stop][s["doc"]], s["a"], s["n"], s["own"]))
                gathered += len(s["m"])
                at = stop
                if gathered >= GATHERED:
                    yield emit()
                    gathered = 0
        yield emit()

    return docs.mapInArrow(run, BLOCK)


def route_segments(blocks: DataFrame) -> DataFrame:
    """Segments equal to an earlier one are covered; others of shared keys are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            through = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[1] == COVER:
                    through.append(row)
                else:
                    ids = ids_of(row[5])
                    a = large(row[6], len(ids))
                    parts.append((np.frombuffer(row[3], "<u8"), np.frombuffer(row[4], "<u8"), ids, a >> 1, large(row[7], len(ids)), (a & 1).astype(bool), np.full(len(ids), row[2])))
            yield batch_of(through)
        if not parts:
            return
        m, d, ids, a, n, own, fkey = (np.concatenate([p[i] for p in parts]) for i in range(7))
        parts.clear()
        order = np.lexsort((a, ids, d, m))
        again = later((m, d), order)
        new_key, first = ~later((m,), order), ~again
        number = np.cumsum(new_key) - 1
        shared = np.bincount(number, weights=first)[number] > 1 if len(number) else first
        asked = order[first & (shared | own[order])]
        for kind, chosen in ((COVER, order[again]), (ASK, asked)):
            chosen = chosen[np.lexsort((a[chosen], ids[chosen]))]
            _, group = np.unique(fkey[chosen], return_inverse=True)
            yield batch_of([block(0, kind, int(fkey[chosen[k[0]]]), ids[chosen[k]], a[chosen[k]], n[chosen[k]]) for _, k in split(group)])

    return blocks.repartition("bucket").mapInArrow(run, BLOCK)


class Marks:
    """The marks of some rows of an input file, read from the shared folder when its rows come by."""

    def __init__(self, folders: list[str], kind: int):
        self.folders, self.kind, self.key, self.marks = folders, kind, None, None

    def of(self, fkey: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.key != fkey:
            found: list[tuple] = []
            for folder in self.folders:
                system, path = fs.FileSystem.from_uri(folder)
                for info in system.get_file_info(fs.FileSelector(f"{path}/fkey={fkey}", allow_not_found=True)):
                    if info.path.endswith(".parquet"):
                        with system.open_input_file(info.path) as file:
                            for row in pq.ParquetFile(file).read(["kind", "ids", "a", "n"]).to_pylist():
                                if row["kind"] == self.kind:
                                    ids = ids_of(row["ids"])
                                    found.append((ids, large(row["a"], len(ids)), large(row["n"], len(ids))))
            ids, a, n = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
            order = np.lexsort((a, ids))
            self.key, self.marks = fkey, (ids[order], a[order], n[order])
        return self.marks

    def of_doc(self, fkey: int, doc_id: int) -> tuple[np.ndarray, np.ndarray]:
        ids, a, n = self.of(fkey)
        lo, hi = np.searchsorted(ids, doc_id, "left"), np.searchsorted(ids, doc_id, "right")
        return a[lo:hi], n[lo:hi]


def spread(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [a, a + n), one range after the other."""
    return np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(a) else np.zeros(0, np.int64)


def blocks_of_windows(docs: DataFrame, asked: str, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks([asked], ASK)
        pieces: list[bytes] = []
        where: list[tuple] = []
        size = 0

        def emit() -> pa.RecordBatch:
            t = np.frombuffer(b"".join(pieces), np.uint8)
            offset, ids, a, n, fkey = (np.array(x) for x in zip(*where, strict=True))
            at = spread(offset, n)
            ids, start, fkey = np.repeat(ids, n), spread(a, n), np.repeat(fkey, n)
            group = equal_windows(t, at)
            order = np.lexsort((start, ids, group))
            again = later((group,), order)
            rows = []
            for _, k in split(np.unique(fkey[order[again]], return_inverse=True)[1]):
                k = order[again][k]
                k = k[np.lexsort((start[k], ids[k]))]
                rows.append(block(int(start[k[0]]) % buckets, COVER, int(fkey[k[0]]), ids[k], start[k], np.ones(len(k), int)))
            first = order[~again]
            one, two = (r.digest(r.prefix(t), at[first], at[first] + LENGTH) for r in (FIRST, SECOND))
            for b, k in split(two % U64(buckets)):
                for f in np.unique(fkey[first[k]]).tolist():
                    j = k[fkey[first[k]] == f]
                    j = j[np.argsort(one[j], kind="stable")]
                    rows.append(block(b, WINDOW, f, ids[first[j]], start[first[j]], None, one[j], two[j]))
            return batch_of(rows)

        for batch in batches:
            for fkey, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                a, n = marks.of_doc(fkey, doc_id)
                if not len(a):
                    continue
                data = text.as_py().encode()
                for x, k in zip(a.tolist(), n.tolist(), strict=True):
                    pieces.append(data[x : x + k + LENGTH - 1])
                    where.append((size, doc_id, x, k, fkey))
                    size += k + LENGTH - 1
                if size >= SHARD:
                    yield emit()
                    pieces, where, size = [], [], 0
        if where:
            yield emit()

    return docs.mapInArrow(run, BLOCK)


Run = tuple[np.ndarray, ...]


def merge(x: Run, y: Run) -> tuple[Run, Run]:
    """Two ordered runs (p, q, id, start, fkey) as one, and the later ones of equal windows."""
    at = np.searchsorted(x[0], y[0])
    near = np.minimum(at, len(x[0]) - 1)
    hit = (x[0][near] == y[0]) & (x[1][near] == y[1])
    i, j = near[hit], np.flatnonzero(hit)
    first = (y[2][j] < x[2][i]) | ((y[2][j] == x[2][i]) & (y[3][j] < x[3][i]))
    lost = tuple(np.where(first, u[i], v[j]) for u, v in zip(x, y, strict=True))
    out = []
    for u, v in zip(x, y, strict=True):
        u = u.copy()
        u[i[first]] = v[j[first]]
        out.append(np.insert(u, at[~hit], v[~hit]))
    return tuple(out), lost


def route_windows(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[Run]] = {}
        for batch in batches:
            through = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[1] == COVER:
                    through.append(row)
                else:
                    ids = ids_of(row[5])
                    runs.setdefault(row[0], []).append((np.frombuffer(row[3], "<u8"), np.frombuffer(row[4], "<u8"), ids, large(row[6], len(ids)), np.full(len(ids), row[2])))
            yield batch_of(through)
        for _, level in sorted(runs.items()):
            losers: list[Run] = []
            while len(level) > 1:
                merged = [merge(x, y) for x, y in zip(level[::2], level[1::2], strict=False)]
                losers += [lost for _, lost in merged]
                level = [both for both, _ in merged] + level[len(level) - len(level) % 2 :]
            if losers:
                _, _, ids, start, fkey = (np.concatenate([x[i] for x in losers]) for i in range(5))
                order = np.lexsort((start, ids))
                ids, start, fkey = ids[order], start[order], fkey[order]
                yield batch_of([block(0, COVER, int(fkey[k[0]]), ids[k], start[k], np.ones(len(k), int)) for _, k in split(np.unique(fkey, return_inverse=True)[1])])

    return blocks.repartition("bucket").mapInArrow(run, BLOCK)


def removed_from(docs: DataFrame, folders: list[str]) -> DataFrame:
    schema = "fkey long, id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(folders, COVER)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for fkey, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data, removed, spans = text.as_py().encode(), 0, 0
                n_bytes = len(data)
                a, n = marks.of_doc(fkey, doc_id)
                if len(a):
                    edge = np.zeros(n_bytes + 1, np.int64)
                    np.add.at(edge, a, 1)
                    np.add.at(edge, np.minimum(a + n + LENGTH - 1, n_bytes), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    data = np.frombuffer(data, np.uint8)[~gone].tobytes()
                for column, value in zip(rows, (n_bytes, removed, spans, hashlib.sha256(data).hexdigest(), data.decode(errors="replace")), strict=True):
                    column.append(value)
            arrays = [pa.array(c, k) for c, k in zip(rows, [*[pa.int64()] * 3, pa.string(), pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names)

    return docs.mapInArrow(run, schema)


def read_at(docs: DataFrame) -> Column | None:
    """A key of the file and of the ``ROWS`` rows of it that a row stands among; none if not read so.

    Rows keep their number in a file however it is cut into tasks, so a scan that is repeated with
    fewer executors gives the same keys.
    """
    try:
        place = docs.metadataColumn("_metadata")
        docs.select(place["file_path"], place["row_index"])
    except AnalysisException:
        return None
    return F.xxhash64(place["file_path"], F.floor(place["row_index"] / ROWS))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``; ``kept`` is the rest as text."""
    spark = docs.sparkSession
    folder = new_folder(spark, "suffix")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = read_at(docs)
    rows = docs.select((F.lit(0) if place is None else place).cast("long").alias("fkey"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    numbered = place is None or rows.groupBy("id").count().where(f"count > 1 OR id = {NULL_ID}").limit(1).count() > 0
    if numbered:
        # Ids that name several texts, or no file to read again: number the texts in order, write
        # each once by ranges of numbers and go by these.
        named = rows.drop("fkey").withColumn("h", F.xxhash64("text"))
        named.select("id", "h").distinct().orderBy("id", "h").withColumn("number", F.monotonically_increasing_id()).write.parquet(f"{folder}/numbers")
        numbers = spark.read.parquet(f"{folder}/numbers")
        texts = named.dropDuplicates(["id", "h"]).join(numbers, ["id", "h"]).select(F.floor(F.col("number") / ROWS).alias("fkey"), F.col("number").alias("id"), "text")
        texts.repartition("fkey").sortWithinPartitions("fkey", "id").write.parquet(f"{folder}/texts")
        rows = spark.read.parquet(f"{folder}/texts")
    route_segments(blocks_of_segments(rows, buckets)).repartition("fkey").write.partitionBy("fkey").parquet(f"{folder}/1")
    route_windows(blocks_of_windows(rows, f"{folder}/1", buckets)).repartition("fkey").write.partitionBy("fkey").parquet(f"{folder}/2")
    out = removed_from(rows, [f"{folder}/1", f"{folder}/2"]).drop("fkey")
    if numbered:
        named = named.select("id", "h").join(numbers, ["id", "h"]).select(F.col("id").alias("own"), "number")
        out = out.join(named, F.col("id") == F.col("number")).drop("id", "number").withColumnRenamed("own", "id")
    return out.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("kept")
