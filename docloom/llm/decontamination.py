"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select five tokens of a short span and ignore the others, so a substituted token hides a passage from
some masks but not from all. The benchmark's seed hashes are sorted block by block, and each block is broadcast and joined
with the hashes of every training window under every mask; around each hit the aligned texts are compared token by token. A hit counts when the
best overlap on its diagonal is long enough and at least 0.8 of its tokens agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BATCH_ROWS, batched, numbered, staged, text_of

#: Seeds of compared positions (1) and up to two ignored ones (0), for items of at least LONG tokens and for
#: shorter ones, which must agree from end to end. One of them hits in every passage that agrees by 0.8.
MASKS = ("11111", "111011", "110111", "1101101", "1110011", "1100111", "1011011")
SHORT_MASKS = ("1111", "10111", "11011", "11101")
LONG = 13
TOKEN = re.compile(r"[^\W_]+")
_FOLD = 1 << 20

OVERLAPS = "doc_id long, item_id long, start long, n_tokens long, n_matched long, similarity double"


def tokens(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return TOKEN.findall(text.lower())


class SeedIndex:
    """Spaced-seed hashes of one bounded block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, min_overlap: int):
        self.similarity, self.min_overlap = similarity, min_overlap
        self.codes: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            words = tokens(text)
            if len(words) >= 5:
                self.items.append((item, np.array([self.codes.setdefault(w, len(self.codes) + 1) for w in words], dtype=np.int64)))
        rng = np.random.default_rng(11)
        # unknown words have code 0; they fall in no seed of the index, as the full check below shows
        self.value = np.r_[np.uint64(0), rng.integers(1, 2**63, size=len(self.codes), dtype=np.uint64)]
        self.factor = rng.integers(1, 2**63, size=5, dtype=np.uint64) | np.uint64(1)
        self.tables = []
        for masks, fits in ((MASKS, lambda n: n >= LONG), (SHORT_MASKS, lambda n: n < LONG)):
            if any(fits(len(code)) for _, code in self.items):
                self.tables += [self.table([i for i, c in enumerate(m) if c == "1"], fits) for m in masks]

    def table(self, mask: list[int], fits) -> tuple:
        """A mask, which hash beginnings occur under it, and the sorted hashes of the items with their owners and places."""
        found = [(k, self.hashes(self.value[code], mask)) for k, (_, code) in enumerate(self.items) if fits(len(code))]
        key = np.concatenate([h for _, h in found])
        owner = np.concatenate([np.full(len(h), k) for k, h in found])
        place = np.concatenate([np.arange(len(h)) for _, h in found])
        order = np.argsort(key, kind="stable")
        seen = np.zeros(_FOLD, dtype=bool)
        seen[(key >> np.uint64(44)).astype(np.int64)] = True
        return mask, seen, key[order], owner[order], place[order]

    def hashes(self, value: np.ndarray, mask: list[int]) -> np.ndarray:
        n = len(value) - mask[-1]
        if n <= 0:
            return np.empty(0, np.uint64)
        h = value[mask[0] : mask[0] + n] * self.factor[0]
        for f, at in zip(self.factor[1:], mask[1:], strict=False):
            h = h + value[at : at + n] * f
        return h ^ (h >> np.uint64(29))

    def find(self, text: str) -> list[tuple[int, int, int, int, float]]:
        """The best overlap with each item: item, start token, tokens, matching tokens, similarity."""
        return self.find_all([text])[0]

    def find_all(self, texts: list[str]) -> list[list[tuple[int, int, int, int, float]]]:
        """find() of each text. The texts' tokens are hashed as one array, kept apart by more zeros than a mask spans."""
        get, gap = self.codes.get, max(map(len, MASKS + SHORT_MASKS))
        codes: list[int] = []
        bounds = []
        for text in texts:
            first = len(codes)
            codes += [get(w, 0) for w in tokens(text)]
            bounds.append((first, len(codes)))
            codes += [0] * gap
        code = np.array(codes, dtype=np.int64)
        value, starts = self.value[code], np.array([a for a, _ in bounds], dtype=np.int64)
        diagonals: set[tuple[int, int, int]] = set()
        for mask, seen, key, owner, place in self.tables:
            h = self.hashes(value, mask)
            at = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(key, h[at], "left"), np.searchsorted(key, h[at], "right")
            for p, a, b in zip(at[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                d = int(np.searchsorted(starts, p, "right")) - 1
                diagonals.update((d, int(o), int(p) - int(q)) for o, q in zip(owner[a:b], place[a:b], strict=True))
        best: dict[tuple[int, int], tuple[int, int, int, int, float]] = {}
        for d, k, shift in diagonals:
            (low, high), (item, own) = bounds[d], self.items[k]
            first, last = max(0, low - shift), min(len(own), high - shift)
            same = code[first + shift : last + shift] == own[first:last]
            a, b = longest_dense(same, self.similarity)
            n, matched = b - a, int(same[a:b].sum())
            if n and n >= min(self.min_overlap, len(own)):
                found = (item, a + first + shift - low, n, matched, matched / n)
                best[d, k] = max(best.get((d, k), found), found, key=lambda x: (x[3], -x[1]))
        out: list[list[tuple[int, int, int, int, float]]] = [[] for _ in texts]
        for (d, _), found in sorted(best.items()):
            out[d].append(found)
        return out


def longest_dense(same: np.ndarray, share: float) -> tuple[int, int]:
    """Bounds of the longest run, from a match to a match, of which at least the given share are matches."""
    hits = np.flatnonzero(same)
    best = (0, 0)
    if not len(hits):
        return best
    # matches i..j span hits[j]-hits[i]+1 tokens: dense if (j-i+1) >= share * span
    level = np.arange(len(hits)) - share * hits
    lowest = np.minimum.accumulate(level)
    for j in range(len(hits)):
        i = int(np.searchsorted(-lowest[: j + 1], -(level[j] + 1 - share + 1e-9), "left"))
        if i <= j and hits[j] + 1 - hits[i] > best[1] - best[0]:
            best = (int(hits[i]), int(hits[j]) + 1)
    return best


def seed_indexes(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", similarity: float = 0.8, min_overlap: int = 13, block_chars: int = 16_000_000) -> tuple[int, Iterator[SeedIndex]]:
    """The number of blocks of about block_chars characters that the benchmark makes, and their indexes, built one at a time.

    Only one block is on the driver at once. An item is not cut: one longer than a block is as large a block as it is.
    """
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), text_of(text_col).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(size) // block_chars))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return blocks, (SeedIndex([(r["item_id"], r["text"]) for r in items.filter(block == b).toLocalIterator()], similarity, min_overlap) for b in range(blocks))


def _joined(rows: DataFrame, benchmark: DataFrame, join, schema: str, options: dict) -> DataFrame:
    """join(index, batch) of every block, one block after another: beyond one, each block's result is written first."""
    blocks, indexes = seed_indexes(benchmark, **options)
    out = None
    for index in indexes:
        shared = rows.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield join(shared.value, batch)

        part = batched(rows, run, schema)
        if blocks > 1:
            part = staged(part, "overlaps")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document and benchmark item that share a passage, with the best overlap of the two.

    A passage is at least min_overlap (13) tokens, or the whole item if that is shorter, of which at least
    similarity (0.8, for which the seeds are made) agree in place. Items of fewer than five tokens are no evidence and
    match nothing. Null or empty texts match nothing; texts are read whole, however long; repeated rows give repeated
    results; empty tables give none; other columns are not read. The documents are read once for each block of the
    benchmark, whose seed hashes are joined with theirs in place.
    """

    def join(index: SeedIndex, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = index.find_all(batch.column(1).to_pylist())
        rows = [(doc, *hit) for doc, hits in zip(batch.column(0).to_pylist(), found, strict=True) for hit in hits]
        names = ["doc_id", "item_id", "start", "n_tokens", "n_matched", "similarity"]
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "similarity" else pa.int64()) for c, n in zip(columns, names, strict=True)], names=names)

    return _joined(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), benchmark, join, OVERLAPS, options)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents that share no passage with the benchmark, columns unchanged, whatever their names. Null texts stay.

    With one block the texts stay in place; with more, the leaking texts' 128-bit hashes are gathered and taken out at the end.
    """
    blocks, indexes = seed_indexes(benchmark, **options)
    if blocks == 1:
        shared = docs.sparkSession.sparkContext.broadcast(next(indexes))

        @F.pandas_udf("boolean")
        def leaks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in texts:
                yield pd.Series([bool(hits) for hits in shared.value.find_all(part.tolist())], dtype=bool)

        docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return docs.filter(~leaks(text_of(text_col)))

    def join(index: SeedIndex, batch: pa.RecordBatch) -> pa.RecordBatch:
        hit = [bool(hits) for hits in index.find_all(batch.column(2).to_pylist())]
        return batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    plain, (text,) = numbered(docs, text_col)
    key = {"_a": F.xxhash64(text_of(text)), "_b": F.xxhash64(text_of(text), F.lit(1))}
    leaking = _joined(plain.select(key["_a"].alias("_a"), key["_b"].alias("_b"), text_of(text).alias("text")), benchmark, join, "_a long, _b long", options)
    return plain.withColumns(key).join(leaking.distinct(), ["_a", "_b"], "left_anti").select(*plain.columns).toDF(*docs.columns)
