"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

An island is a random share of the pieces, small enough for one task. Its first population is best fit in random
orders. Each epoch evolves every island's population: crossover injects whole well-filled bins of one parent into the other, drops the bins that then hold
duplicates, and best-fits the displaced pieces. Between epochs each island's elite bins migrate, as patterns of
lengths, to the next island on a ring, which realises them with its own pieces. Afterwards every island opens its
least-filled bins and hands their pieces to islands an eighth as many, until one is left, so that no waste per
island remains however large the corpus is.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import staged

Bin = tuple[int, ...]


class Packer:
    """Grouping genetic search over one island's lengths."""

    def __init__(self, lengths: list[int], capacity: int, seed: int, population: int = 4, generations: int = 10):
        self.lengths, self.capacity, self.rng = lengths, capacity, random.Random(seed)
        self.population, self.generations = population, generations
        self.least = -(-sum(lengths) // capacity)
        self.crossovers = 0

    def fill(self, items: Iterable[int]) -> int:
        return sum(map(self.lengths.__getitem__, items))

    def best_fit(self, bins: list[list[int]], items: list[int]) -> list[list[int]]:
        """Put items, in their order, each into the fullest bin that takes it. Free room is kept as a bit mask."""
        room: dict[int, list[int]] = {}
        mask = 0
        for k, b in enumerate(bins):
            free = self.capacity - self.fill(b)
            if free:
                room.setdefault(free, []).append(k)
                mask |= 1 << free
        for item in items:
            size = self.lengths[item]
            fits = mask >> size
            if fits:
                free = size + (fits & -fits).bit_length() - 1
                same = room[free]
                k = same.pop()
                if not same:
                    mask ^= 1 << free
                bins[k].append(item)
                free -= size
            else:
                k, free = len(bins), self.capacity - size
                bins.append([item])
            if free:
                same = room.setdefault(free, [])
                if not same:
                    mask |= 1 << free
                same.append(k)
        return bins

    def decreasing(self, items: Iterable[int]) -> list[int]:
        """Longest first."""
        return sorted(items, key=self.lengths.__getitem__, reverse=True)

    def fitness(self, bins: list[list[int]]) -> float:
        """Mean square fill: of two packings with as many bins, the one with fuller and emptier bins is better."""
        return sum((self.fill(b) / self.capacity) ** 2 for b in bins) / max(1, len(bins))

    def crossover(self, one: list[list[int]], other: list[list[int]]) -> list[list[int]]:
        """A child of one with a random half of other's well-filled bins injected whole."""
        good = sorted(other, key=self.fill, reverse=True)[: max(1, len(other) // 2)]
        injected = [list(b) for b in good if self.rng.random() < 0.5]
        taken = {i for b in injected for i in b}
        kept, displaced = [], []
        for b in one:
            if taken.isdisjoint(b):
                kept.append(list(b))
            else:
                displaced += [i for i in b if i not in taken]
        return self.best_fit(injected + kept, self.decreasing(displaced))

    def realise(self, patterns: list[list[int]]) -> list[list[int]]:
        """A packing whose first bins repeat migrated patterns of lengths, as often as own pieces allow."""
        by_length: dict[int, list[int]] = {}
        for i, size in enumerate(self.lengths):
            by_length.setdefault(size, []).append(i)
        bins = []
        for pattern in patterns:
            need: dict[int, int] = {}
            for size in pattern:
                need[size] = need.get(size, 0) + 1
            if all(len(by_length.get(size, ())) >= n for size, n in need.items()):
                bins.append([by_length[size].pop() for size in pattern])
        return self.best_fit(bins, self.decreasing(i for rest in by_length.values() for i in rest))

    def newcomer(self) -> list[list[int]]:
        """Best fit in a random order: a member of the first population."""
        return self.best_fit([], self.rng.sample(range(len(self.lengths)), len(self.lengths)))

    def evolve(self, start: list[list[list[int]]]) -> list[list[int]]:
        """The best packing found; ends early at the lower bound. crossovers counts the children made.

        A population that misses the bound gets best fit decreasing as a member and goes on, so it never ends up worse.
        """
        people = [p for p in start if p]
        while len(people) < self.population:
            people.append(self.newcomer())
        for late in (False, True):
            if late and len(people[0]) > self.least:
                people.append(self.best_fit([], self.decreasing(range(len(self.lengths)))))
            people.sort(key=self.rank)
            for _ in range(self.generations):
                if len(people[0]) <= self.least:
                    break
                one, other = self.rng.sample(people, 2)
                self.crossovers += 1
                people = sorted([*people, self.crossover(one, other)], key=self.rank)[: self.population]
        return people[0]

    def rank(self, bins: list[list[int]]) -> tuple[int, float]:
        return len(bins), -self.fitness(bins)


STATE = "island long, doc_id long, piece int, length long, bin long, pattern array<int>"


def _epoch(capacity: int, islands: int, elites: int, seed: int, generations: int):
    """Evolves one island: rows of pieces (pattern null), and migrated patterns (piece null)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        is_elite = rows["pattern"].notna()
        own = rows[~is_elite].sort_values(["length", "doc_id", "piece"], kind="stable")
        if own.empty:
            return own
        island = int(own["island"].iloc[0])
        own = own.astype({"length": "int64"})
        packer = Packer(own["length"].tolist(), capacity, seed * 7919 + island, generations=generations)
        start = []
        if own["bin"].notna().all():
            groups: dict[int, list[int]] = {}
            for i, b in enumerate(own["bin"].tolist()):
                groups.setdefault(b, []).append(i)
            start.append(list(groups.values()))
            patterns = sorted([[int(x) for x in p] for p in rows.loc[is_elite, "pattern"]])
            if patterns:
                start.append(packer.realise(patterns))
        bins = packer.evolve(start)
        number = np.empty(len(own), dtype="int64")
        for k, b in enumerate(bins):
            number[b] = k
        own = own.assign(bin=number)
        if not elites or islands < 2:
            return own
        full = sorted({tuple(sorted(packer.lengths[i] for i in b)) for b in bins}, key=lambda p: (-sum(p), p))[:elites]
        more = pd.DataFrame({"island": (island + 1) % islands, "doc_id": None, "piece": None, "length": None, "bin": None, "pattern": [list(p) for p in full]})
        return pd.concat([own.astype(object), more.astype(object)], ignore_index=True)

    return run


def _close(capacity: int, last: bool):
    """Splits an island's bins into closed ones, with offsets, and the least-filled that are opened again."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bin", "doc_id", "piece"], kind="stable")
        length, number = rows["length"].to_numpy("int64"), rows["bin"].to_numpy("int64")
        before = np.cumsum(length) - length
        first = np.r_[True, number[1:] != number[:-1]]
        offset = before - np.maximum.accumulate(np.where(first, before, 0))
        fills = pd.Series(length).groupby(number).sum()
        poor = fills[fills < capacity - capacity // 50].sort_values(kind="stable").index[: max(4, len(fills) // 8)]
        opened = np.isin(number, [] if last else poor)
        return rows[["island", "doc_id", "piece", "length", "bin"]].assign(offset=offset, opened=opened)

    return run


def pack(pieces: DataFrame, *, capacity: int = 4096, island_pieces: int = 8192, epochs: int = 2, generations: int = 40, elites: int = 64, seed: int = 7) -> DataFrame:
    """Pack rows (doc_id, piece, length) into sequences: adds sequence_id and offset, gapless from 0.

    Pieces as long as a sequence stand alone. Lengths are from 1 to capacity. Every row is placed exactly once,
    repeated rows too; an empty table gives none. Bins and migrants of an island are bounded by island_pieces
    and elites, and only counts reach the driver.
    """
    rows = pieces.select("doc_id", "piece", F.col("length").cast("long").alias("length"))
    alone = rows.filter(F.col("length") >= capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_rows = rows.filter(F.col("length") < capacity)
    n = open_rows.count()
    closed, tier, islands = [alone], 0, max(1, -(-n // island_pieces))
    while n:
        state = open_rows.select(F.pmod(F.xxhash64("doc_id", "piece", "length", F.lit(tier)), F.lit(islands)).cast("long").alias("island"), "doc_id", "piece", "length", F.lit(None).cast("long").alias("bin"), F.lit(None).cast("array<int>").alias("pattern"))
        for epoch in range(epochs if islands > 1 else 1):
            migrate = elites if epoch < epochs - 1 else 0
            state = state.groupBy("island").applyInPandas(_epoch(capacity, islands, migrate, seed + 31 * tier + epoch, generations), STATE)
        done = staged(state.filter(F.col("pattern").isNull()).groupBy("island").applyInPandas(_close(capacity, islands == 1), "island long, doc_id long, piece int, length long, bin long, offset long, opened boolean"), "packed")
        number = (F.lit(tier) * (1 << 58)).bitwiseOR(F.shiftleft("island", 20)).bitwiseOR(F.col("bin"))
        closed.append(done.filter(~F.col("opened")).select("doc_id", "piece", "length", number.alias("sequence_id"), "offset"))
        if islands == 1:
            break
        open_rows, tier, islands = done.filter("opened").select("doc_id", "piece", "length"), tier + 1, max(1, islands // 8)
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(pieces: DataFrame, **options) -> DataFrame:
    """Pack rows of token_pieces and carry their other columns along.

    Rows are numbered as they are written, so every job sees the same numbers; ids may be null or repeat.
    """
    keyed = staged(pieces.withColumn("_n", F.monotonically_increasing_id()), "pieces")
    placed = pack(keyed.select(F.col("_n").alias("doc_id"), "piece", "length"), **options)
    return keyed.join(placed.select(F.col("doc_id").alias("_n"), "sequence_id", "offset"), "_n").drop("_n")
