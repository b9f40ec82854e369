"""Near copies at a Jaccard similarity of word shingles, by SimHash and BK-trees with an exact check.

At a similarity of 0.8, 64-bit fingerprints differ in too many bits for pigeonhole blocks to keep shards small. So
fingerprints are wider here, and shards go by bands of minima over a text's shingles instead: texts that agree in all
minima of a band share a shard, which those at the similarity do in some band but for 2 pairs in 10,000, and fewer the
more alike they are. A shard's fingerprints form a BK-tree, and only edges within the radius are followed. Of the pairs
that it finds, and whose sizes allow the similarity, a shard hands on a spanning set; a large shard is cut into chunks, and each
pair of chunks is a task. What these links hold together is a group, in which every pair within the radius of some shard lies.
Then each group's texts, not its pairs, are dealt out, a large group's by pairs of chunks again, and a task counts the shingles
that its texts share, all pairs of a few hundred at once. It hands on a spanning set of the links that are similar enough. So no
link is lost, a false link hides nothing, and rows do not grow with the pairs of a group.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import batched, join_named, numbered, staged, text_of
from docloom.llm.simhash import Forest, components, shingle_hashes

SEED = 9
#: Links up to this many are joined in one task, more by rounds over the shared folder.
FEW_LINKS = 500_000
#: Bands of minima, minima a band, longs of a fingerprint, and the bits by which fingerprints of linked texts may differ.
BANDS, MINIMA, LONGS, RADIUS = 16, 4, 4, 72
#: Spanning sets of links that a shard hands on: one holds together all that its links do.
FORESTS = 1
#: A group's texts are compared in this many chunks, of at least and at most so many shingles; shorter texts count as LEAST_SHINGLES.
CHUNKS, CHUNK, LEAST_SHINGLES = 8, (1 << 15, 1 << 19), 128
#: A bitmap's size for picking the texts to compare.
SPOTS = 1 << 26
_MIX = np.random.default_rng(SEED).integers(1, 2**63, size=(2, BANDS * MINIMA), dtype=np.uint64) | np.uint64(1)
_SALT = np.random.default_rng(SEED + 1).integers(1, 2**63, size=LONGS, dtype=np.uint64)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes as signed longs."""
    return np.unique(shingle_hashes(text, width).view("<i8"))


def _class(s: np.ndarray) -> int:
    """A name of a set of shingles: XXH64 of its sorted hashes."""
    h = xxhash.xxh64_intdigest(s.tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


def _mixed(h: np.ndarray) -> np.ndarray:
    """Each hash scattered over all its bits."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def sketch(s: np.ndarray) -> tuple[list[int], list[int]]:
    """(a key per band, the fingerprint as signed longs) of a set of shingles; no bands for an empty set."""
    if not len(s):
        return [], [0] * LONGS
    least, counts = np.full(BANDS * MINIMA, 2**64 - 1, dtype=np.uint64), np.zeros(64 * LONGS, dtype=np.int64)
    for k in range(0, len(s), 4096):
        h = s[k : k + 4096].view(np.uint64)[:, None]
        hashed = h * _MIX[0] + _MIX[1]
        least = np.minimum(least, (hashed ^ (hashed >> np.uint64(29))).min(axis=0))
        bits = np.unpackbits(_mixed(h + _SALT).view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    keys = [xxhash.xxh64_intdigest(least[MINIMA * b : MINIMA * (b + 1)].tobytes(), b) for b in range(BANDS)]
    signed = np.array(keys, dtype=np.uint64).view(np.int64).tolist()
    return signed, np.packbits(counts * 2 > len(s), bitorder="little").view("<i8").tolist()


class NearTree:
    """A BK-tree of wide fingerprints that tells how near its finds are."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int, owner: int) -> None:
        if self.root is None:
            self.root = [value, owner, {}]
            return
        node = self.root
        while (child := node[2].get(d := (node[0] ^ value).bit_count())) is not None:
            node = child
        node[2][d] = [value, owner, {}]

    def within(self, value: int, radius: int, far: array, owners: array) -> None:
        """Appends the distances and owners of all fingerprints at most radius bits away."""
        todo = [self.root] if self.root else []
        while todo:
            own, owner, children = todo.pop()
            d = (own ^ value).bit_count()
            if d <= radius:
                far.append(d)
                owners.append(owner)
            if children:
                todo += [c for e, c in children.items() if d - radius <= e <= d + radius]


def spanning_links(fps: list[int], sizes: list[int], tree: list[bool], one: bool, similarity: float, forests: int = FORESTS) -> list[tuple[int, int]]:
    """(i, j) of links that span what all pairs within the radius connect, the nearest first, forests times.

    Pairs are those of all members, or, unless one, of members in the tree with the others.
    """
    found, far, left, right = NearTree(), array("i"), array("i"), array("i")
    if not one:
        for i, fp in enumerate(fps):
            if tree[i]:
                found.add(fp, i)
    for i, fp in enumerate(fps):
        if one or not tree[i]:
            found.within(fp, RADIUS, far, right)
            left.extend([i] * (len(far) - len(left)))
        if one:
            found.add(fp, i)
    if not len(far):
        return []
    d, i, j = (np.frombuffer(x, dtype=np.int32) for x in (far, left, right))
    n = np.array(sizes)
    fits = np.flatnonzero(np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6)
    todo, out = fits[np.argsort(d[fits], kind="stable")].tolist(), []
    for _ in range(forests):
        if not todo:
            break
        forest, rest = Forest(), []
        for k in todo:
            (out if forest.join(left[k], right[k]) else rest).append(k)
        todo = rest
    return [(left[k], right[k]) for k in out]


def _in_pairs(k: Column) -> Column:
    """A class's places (lo, hi, tree) when its group is cut into k chunks and each pair of chunks is a task."""
    mine = F.pmod(F.xxhash64("cls", F.lit(3)), k).cast("int")
    return F.transform(F.sequence(F.lit(0), k - 1), lambda t: F.struct(F.least(t, mine).alias("lo"), F.greatest(t, mine).alias("hi"), (mine <= t).alias("tree")))


def _in_groups(dealt: DataFrame, links: Callable[[list[tuple], bool], list[tuple[int, int]]]) -> DataFrame:
    """Distinct a < b of what links finds in each (key, lo, hi) of dealt (key, lo, hi, tree, cls and more).

    links gets a group's rows, from tree on, and whether its two chunks are one, and gives places in the group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        group: list[tuple] = []

        def found() -> list[tuple[int, int]]:
            ends = [(group[i][1], group[j][1]) for i, j in links(group, at[1] == at[2])] if len(group) > 1 else []
            return [(min(e), max(e)) for e in ends]

        def emit(ends: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends], pa.int64()) for i in range(2)], names=["a", "b"])

        for batch in batches:
            ends = []
            for key, lo, hi, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (key, lo, hi) != at:
                    ends += found()
                    at, group = (key, lo, hi), []
                group.append(tuple(row))
            yield emit(ends)
        yield emit(found())

    ordered = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "cls")
    return batched(ordered, run, "a long, b long").distinct()


def shard_links(classes: DataFrame, *, similarity: float, chunk: int = 512) -> DataFrame:
    """Links a < b between classes (cls, n, fp, bands): each shard's spanning sets, all shards' together."""
    dealt = classes.select("cls", "n", *(F.get("fp", F.lit(k)).alias(f"f{k}") for k in range(LONGS)), F.explode("bands").alias("key"))
    shards = dealt.groupBy("key").count().filter("count > 1").select("key", F.ceil(F.col("count") / chunk).cast("int").alias("k"))
    dealt = dealt.join(shards, "key").withColumn("p", F.explode(_in_pairs(F.col("k"))))
    forests = FORESTS

    def links(group: list[tuple], one: bool) -> list[tuple[int, int]]:
        tree, _, sizes, *longs = zip(*group, strict=True)
        fps = [sum((f & (2**64 - 1)) << (64 * k) for k, f in enumerate(fp)) for fp in zip(*longs, strict=True)]
        return spanning_links(fps, sizes, tree, one, similarity, forests)

    return _in_groups(dealt.select("key", "p.lo", "p.hi", "p.tree", "cls", "n", *(f"f{k}" for k in range(LONGS))), links)


def _common(left: list[np.ndarray], right: list[np.ndarray], slab: int = 4096) -> np.ndarray:
    """How many hashes each of left shares with each of right."""
    ends, rows = [np.concatenate(x) for x in (left, right)], [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    shared = np.intersect1d(*ends)
    out = np.zeros((len(left), len(right)))
    where = []
    for hashes, row in zip(ends, rows, strict=True):
        column = np.searchsorted(shared, hashes)
        there = np.flatnonzero((column < len(shared)) & (np.r_[shared, 0][column] == hashes))
        there = there[np.argsort(column[there], kind="stable")]
        where.append((row[there], column[there]))
    for k in range(0, len(shared), slab):
        marks = []
        for (row, column), sets in zip(where, (left, right), strict=True):
            a, b = np.searchsorted(column, (k, k + slab))
            m = np.zeros((len(sets), min(slab, len(shared) - k)), dtype=np.float32)
            m[row[a:b], column[a:b] - k] = 1
            marks.append(m)
        out += marks[0] @ marks[1].T
    return out


def similar_links(sets: list[np.ndarray], tree: list[bool], one: bool, similarity: float, part: int = 256) -> list[tuple[int, int]]:
    """(i, j) of links that span what all similar pairs connect; every pair is compared unless it is joined already.

    Pairs are those of all members, or, unless one, of members in the tree with the others.
    """
    n = np.array([len(s) for s in sets])
    sides = [np.flatnonzero(np.array(tree) | one), np.flatnonzero(~np.array(tree) | one)]
    sides = [x[np.argsort(n[x], kind="stable")].tolist() for x in sides]
    forest, out = Forest(), []
    for a in range(0, len(sides[0]), part):
        for b in range(a if one else 0, len(sides[1]), part):
            left, right = sides[0][a : a + part], sides[1][b : b + part]
            apart = n[left[-1]] < similarity * n[right[0]] - 1e-6 or n[right[-1]] < similarity * n[left[0]] - 1e-6
            if apart or len({forest.find(i) for i in (*left, *right)}) == 1:
                continue
            hits = _common([sets[i] for i in left], [sets[j] for j in right]) * (1 + similarity) >= similarity * (n[left][:, None] + n[right]) - 1e-6
            out += [(left[i], right[j]) for i, j in np.argwhere(hits).tolist() if forest.join(left[i], right[j])]
    return out


def similar_in_groups(groups: DataFrame, texts: DataFrame, *, width: int, similarity: float) -> DataFrame:
    """Links a < b of similar texts (cls, z) within groups (cls, component, n): of each task a spanning set.

    A text is dealt out once for each chunk of its group, of which there are few: chunks grow with the group.
    """
    sizes = groups.groupBy("component").agg(F.sum(F.greatest("n", F.lit(LEAST_SHINGLES))).alias("w"), F.count("*").alias("members"))
    chunk = F.greatest(F.lit(CHUNK[0]), F.least(F.lit(CHUNK[1]), F.col("w") / CHUNKS))
    sizes = sizes.select("component", F.ceil(F.col("w") / chunk).cast("int").alias("k"), "members")
    placed = staged(join_named(groups, staged(sizes, "sizes"), "component", "members").select("cls", "component", "k"), "placed")
    dealt = texts.join(placed, "cls").withColumn("p", F.explode(_in_pairs(F.col("k"))))

    def links(group: list[tuple], one: bool) -> list[tuple[int, int]]:
        tree, _, packed = zip(*group, strict=True)
        return similar_links([shingle_set(zlib.decompress(z).decode("utf-8", "surrogatepass"), width) for z in packed], tree, one, similarity)

    return _in_groups(dealt.select(F.col("component").alias("key"), "p.lo", "p.hi", "p.tree", "cls", "z"), links)


def _labels(edges: DataFrame) -> DataFrame:
    """cls and component of every end of edges (a < b)."""
    if edges.count() > FEW_LINKS:
        # components gives no row to the node that names a component
        named = components(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("node").alias("cls"), "component")
        return staged(named.union(named.select("component", "component")).distinct(), "labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for b in batches:
            for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                forest.join(x, y)
        nodes = list(forest.parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())], names=["cls", "component"])

    return staged(batched(edges.select("a", "b").coalesce(1), run, "cls long, component long"), "labels")


def _packed(rows: DataFrame, spots: DataFrame, width: int) -> DataFrame:
    """cls and z, the compressed text, of the rows (text, v) whose v is among spots; texts aren't dealt out."""
    words = spots.select(F.shiftright("v", 6).alias("w"), F.expr("shiftleft(1L, int(v & 63))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    marks = np.zeros(SPOTS // 64, dtype=np.int64)
    marks[[r["w"] for r in words]] = [r["b"] for r in words]
    shared = rows.sparkSession.sparkContext.broadcast(marks.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = shared.value, set()
        for batch in batches:
            v = batch.column(1).to_numpy()
            cls, packed = [], []
            for k in np.flatnonzero(marks[v >> 6] >> (v & 63).astype(np.uint64) & np.uint64(1)):
                t = batch.column(0)[int(k)].as_py()
                c = _class(shingle_set(t, width))
                if c not in seen:
                    seen.add(c)
                    cls.append(c)
                    packed.append(zlib.compress(t.encode("utf-8", "surrogatepass"), 1))
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(packed, pa.binary())], names=["cls", "z"])

    return staged(batched(rows, run, "cls long, z binary").groupBy("cls").agg(F.first("z").alias("z")), "packed")


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each component stays, columns unchanged: of its rows the one with the smallest id.

    Documents are linked if the Jaccard similarity of their distinct width-word shingles (A-Z lower-cased, words parted
    by blanks) is at least similarity, for which BANDS and RADIUS are made. Null ids come last and don't link; null texts
    and texts without words are one component. Ids needn't be unique: rows of one id with unlinked texts all stay. Columns
    may have any names; an empty table gives none.
    """
    plain, (own, text) = numbered(docs, id_col, text_col)
    key = {"_k": F.xxhash64(text_of(text)), "_i": F.coalesce(F.col(own).cast("long"), F.lit(-(2**63)))}

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, sizes, fps, bands = [], [], [], []
            for t in batch.column(3).to_pylist():
                s = shingle_set(t, width)
                keys, fp = sketch(s)
                cls.append(_class(s))
                sizes.append(len(s))
                fps.append(fp)
                bands.append(keys)
            columns = [*batch.columns[:3], pa.array(cls, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (fps, bands))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_k", "_i", "cls", "n", "fp", "bands"])

    rows = plain.select(F.col(own).cast("long").alias("doc_id"), key["_k"].alias("_k"), key["_i"].alias("_i"), text_of(text).alias("text"))
    prints = batched(rows, sketches, "doc_id long, _k long, _i long, cls long, n long, fp array<long>, bands array<long>")
    first = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("_k"), F.col("_i"))
    classes = staged(prints.groupBy("cls").agg(F.min(first).alias("own"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "classes")

    groups = staged(_labels(staged(shard_links(classes, similarity=similarity), "links")).join(classes.select("cls", "n"), "cls"), "groups")
    spots = classes.join(groups, "cls", "left_semi").select(F.pmod(F.xxhash64("own._k", "own._i"), F.lit(SPOTS)).alias("v"))
    texts = _packed(plain.select(text_of(text).alias("text"), F.pmod(F.xxhash64(key["_k"], key["_i"]), F.lit(SPOTS)).alias("v")), spots, width)
    named = _labels(staged(similar_in_groups(groups, texts, width=width, similarity=similarity), "edges"))
    keep = classes.select("cls", "own").join(named, "cls", "left").groupBy(F.coalesce("component", "cls").alias("c")).agg(F.min("own").alias("own"))
    keep = staged(keep.select("own._k", "own._i"), "kept")
    # a sort-merge join at every size: the texts are dealt out once, and by the key that repeats go by
    return plain.withColumns(key).join(keep.hint("merge"), ["_k", "_i"], "left_semi").dropDuplicates(["_k", "_i"]).select(*plain.columns).toDF(*docs.columns)
