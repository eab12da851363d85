"""BPE encoding and decoding with a contiguous rank array.

A word is an array of symbol ids beside an array of the ranks of adjacent pairs.  The lowest
rank (leftmost on ties) is found by a scan, its boundary is deleted and the two neighbouring
ranks are looked up again.  Scans are cheapest on the short words that texts consist of; pieces
over ``LONG_WORD`` symbols merge in the same order through a heap, which keeps one unbroken run
of a whole document from taking quadratic time.

Defined results: null text counts as empty, an empty text has no tokens and decodes to the
empty string, repeated rows give repeated results, and only ``doc_id`` and ``text`` are read,
so further columns of any name are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

LONG_WORD = 128
#: Entries of a worker's word cache; it starts anew when full, so its memory is bounded.
CACHE_WORDS = 300_000
CACHED_LENGTH = 64
NO_RANK = 1 << 60
#: Unicode white space, written as part of a character class.
SPACE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + f"{chr(0x2000)}-{chr(0x200A)}"


def spanned(spans: str) -> frozenset[str]:
    """The characters of code points and spans of them, in hex."""
    ends = [(s.split("-")[0], s.split("-")[-1]) for s in spans.split()]
    return frozenset(chr(c) for a, b in ends for c in range(int(a, 16), int(b, 16) + 1))


#: Letters and numbers of the ``regex`` library that are neither to the tokenizers library, whose Unicode is older.
NOT_YET = spanned(
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CF A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 "
    "11DF1 1246F 12475-1247F 12550-12686 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 "
    "1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E "
    "2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)
#: Marks that are starters to the tokenizers library, whose normal forms are of Unicode 9, and a vowel sign that composes since.
NO_MARKS = spanned(
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E "
    "11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF "
    "1E4EC-1E4EF "
)
#: Capitals (first, last, lower case of the first) that Python's Unicode has not or does not lower yet.
CAPITALS = [(0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]
LOWER = {a + i: d + i for a, b, d in CAPITALS for i in range(b - a + 1)}


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return [table[b] for b in range(256)]


class WordCache(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.encode(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class RankBpe:
    """A vocabulary with word ends, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.id_text = {i: str(i) for i in self.tokens}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + end] for c in alphabet]
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+").findall
        newer = "".join(sorted(NOT_YET))
        self.older_pieces = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{newer}]]+|[\p{{N}}--[{newer}]]|[[^{SPACE}\p{{L}}\p{{N}}]||[{newer}]]+").findall
        self.odd = NO_MARKS.union(map(chr, LOWER))
        self.split_marks = regex.compile(f"([{''.join(sorted(NO_MARKS))}])").split
        self.separators = regex.compile("[\x1c-\x1f]")
        self.words = regex.compile(f"[^{SPACE}]+").findall
        self.cache = WordCache(self.encode_word)

    def merge(self, ids: list[int]) -> list[int]:
        if len(ids) > LONG_WORD:
            return self.merge_long(ids)
        find = self.rank.get
        ranks = [find(a << 20 | b, NO_RANK) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            lowest = min(ranks)
            if lowest == NO_RANK:
                break
            i = ranks.index(lowest)
            ids[i] = self.merged[lowest]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = find(ids[i] << 20 | ids[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = find(ids[i - 1] << 20 | ids[i], NO_RANK)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        n, find = len(ids), self.rank.get
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := find(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = self.merged[r], 1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (s := find(ids[i] << 20 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (s, i, ids[i], ids[after[i]]))
            if (k := before[i]) >= 0 and (s := find(ids[k] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (s, k, ids[k], ids[i]))
        return [x for x, g in zip(ids, gone, strict=True) if not g]

    def encode_word(self, word: str) -> tuple[int, ...]:
        out: list[int] = []
        pieces = self.pieces if word.isascii() or NOT_YET.isdisjoint(word) else self.older_pieces
        for piece in pieces(word):
            ids = [self.inner[b] for b in piece.encode()]
            ids[-1] = self.last[piece.encode()[-1]]
            out += self.merge(ids)
        return tuple(out)

    def encode_plain(self, text: str) -> list[int]:
        if not text.isascii() and not self.odd.isdisjoint(text):
            # Nothing is reordered or composed across a starter.
            text = "".join(unicodedata.normalize("NFC", part) for part in self.split_marks(text)).translate(LOWER)
        else:
            text = unicodedata.normalize("NFC", text)
        # Lower case goes by character: a sigma at a word's end has no form of its own.
        text = (text.replace("Σ", "σ") if "Σ" in text else text).lower()
        words = self.words(text) if self.separators.search(text) else text.split()
        return list(chain.from_iterable(map(self.cache.__getitem__, words)))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.split_added is None or not any(a in text for a in self.added):
            return self.encode_plain(text)
        out: list[int] = []
        for part in self.split_added.split(text):
            out += [self.added[part]] if part in self.added else self.encode_plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def load(path: str) -> RankBpe:
    return RankBpe(path)


def encode(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` and ``decoded``.

    One pass over the scan's partitions without a shuffle; a worker holds an Arrow batch.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches, 1):
            rows: list[list] = [[] for _ in range(5 if keep_ids else 3)]
            for text in batch.column(1):
                ids = bpe.encode(text.as_py())
                decoded = bpe.decode(ids)
                joined = " ".join(map(bpe.id_text.__getitem__, ids))
                found = [len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                for column, value in zip(rows, [*found, ids, decoded] if keep_ids else found, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(rows, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(arrays) + 1])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
