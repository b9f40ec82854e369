"""SimHash near-duplicates with BK-trees.

Distinct fingerprints are dealt to shards by pigeonhole: of the blocks a fingerprint is cut into, two within the
radius agree on some choice of them, and each choice has a shard of its own. A shard's fingerprints form a BK-tree,
children keyed by Hamming distance to the parent, and every fingerprint follows only the edges within the radius.
Choices grow finer with the number of fingerprints, so that shards stay small; a shard that is large all the same
is cut into chunks, and each pair of chunks is a task with one tree. Links go through a union-find before they leave
a task, so a task emits fewer links than fingerprints. Trees travel with their shard instead of being broadcast,
since their size grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import batched, join_named, numbered, staged, text_of

SEED = 42


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each shingle of width words, one of all words if there are fewer, none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and blanks are ASCII
    if not words:
        return np.empty(0, dtype="<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.r_[0, ends[:-width]].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8")


def fingerprint(text: str, width: int = 4) -> int:
    """SimHash of width-word shingles: a bit is set if it is set in over half of the shingles' XXH64."""
    h = shingle_hashes(text, width)
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 8192):
        part = h[k : k + 8192]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, keyed: bool = False) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, and with keyed the text's xxhash64 as key.

    Null texts count as empty and have fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            columns = [batch.column(0), pa.array(fps), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "key"][: len(columns)])

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *[F.xxhash64(text).alias("key")] * keyed)
    return batched(rows, run, "doc_id long, fp long" + ", key long" * keyed)


class BKTree:
    """Fingerprints by Hamming distance to their parent."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int, owner: int) -> None:
        if self.root is None:
            self.root = [value, owner, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            child = node[2].get(d)
            if child is None:
                node[2][d] = [value, owner, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        """Owners of the fingerprints at most radius bits away."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            own, owner, children = todo.pop()
            d = (own ^ value).bit_count()
            if d <= radius:
                out.append(owner)
            if children:
                low, high = d - radius, d + radius
                todo += [c for e, c in children.items() if low <= e <= high]
        return out


class Forest:
    """Union-find that reports only the links which join two sets."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent.setdefault(x, x)
        while p != x:
            self.parent[x] = self.parent[p]
            x, p = p, self.parent[p]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def block_choices(n: int, radius: int, shard: int = 256) -> list[int]:
    """Bit masks such that values within the radius agree on all bits of some mask; more bits for more values."""
    for agree in range(1, 9):
        blocks = radius + agree
        bits = 64 * agree // blocks
        if n >> bits <= shard or agree == 8:
            edges = [round(64 * k / blocks) for k in range(blocks + 1)]
            parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
            return [sum(c) for c in combinations(parts, agree)]
    raise AssertionError


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shard_links(classes: DataFrame, *, radius: int = 4, chunk: int = 2048) -> DataFrame:
    """Links a > b between representatives of classes (fp, rep) at most radius bits apart: a spanning set per shard."""
    masks = block_choices(classes.count(), radius)
    shards = F.explode(F.array(*(F.struct(F.lit(k).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks))))
    dealt = classes.select("fp", "rep", shards.alias("s")).select("fp", "rep", "s.c", "s.key")
    large = dealt.groupBy("c", "key").count().filter(F.col("count") > chunk).withColumn("k", F.ceil(F.col("count") / chunk).cast("int")).drop("count")
    mine = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("k")).cast("int")
    pairs = F.when(F.col("k").isNull(), F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(True).alias("tree")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1), lambda t: F.struct(F.least(t, mine).alias("lo"), F.greatest(t, mine).alias("hi"), (mine <= t).alias("tree"))))
    dealt = dealt.join(large, ["c", "key"], "left").select("fp", "rep", "c", "key", F.explode(pairs).alias("p")).select("c", "key", "p.lo", "p.hi", "p.tree", "fp", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        group: list[tuple[bool, int, int]] = []

        def links() -> list[tuple[int, int]]:
            if len(group) < 2:
                return []
            out, forest, tree = [], Forest(), BKTree()
            within_one = at[2] == at[3]
            for in_tree, fp, rep in group:
                if in_tree and not within_one:
                    tree.add(fp, rep)
            for in_tree, fp, rep in group:
                if within_one or not in_tree:
                    out += [(max(rep, o), min(rep, o)) for o in tree.within(fp, radius) if forest.join(rep, o)]
                    if within_one:
                        tree.add(fp, rep)
            return out

        def emit(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            found = []
            for c, key, lo, hi, tree, fp, rep in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (c, key, lo, hi) != at:
                    found += links()
                    at, group = (c, key, lo, hi), []
                group.append((tree, fp & (2**64 - 1), rep))
            yield emit(found)
        yield emit(links())

    dealt.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    ordered = dealt.repartition("c", "key", "lo", "hi").sortWithinPartitions("c", "key", "lo", "hi", "rep")
    return batched(ordered, run, "a long, b long").distinct()


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """node and component, its smallest connected node, for every node of edges (a > b): alternating star contraction.

    Each round is written to the shared folder; only a count and a checksum reach the driver.
    """

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        return r["n"], r["s"]

    edges = staged(edges.select("a", "b"), "edges")
    before = state(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        large = staged(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = state(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
    raise RuntimeError("components did not settle")


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _grouped(fps: DataFrame, radius: int) -> DataFrame:
    """fp, its smallest doc_id and its component, named by a fingerprint: ids needn't tell classes apart."""
    classes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    linked = components(shard_links(classes.select("fp", F.col("fp").alias("rep")), radius=radius))
    return staged(classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "grouped")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, its smallest linked doc_id.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows give repeated results; a null
    doc_id takes part but never names a component that has another. Empty tables give none.
    """
    fps = staged(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "fingerprints")
    grouped = _grouped(fps, radius)
    names = grouped.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = join_named(grouped, names, "component", "members").select("fp", "component_id", "n")
    return join_named(fps, staged(named, "named"), "fp", "n").select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row of each component stays, one with the smallest id, columns unchanged.

    Null ids come last. Ids needn't be unique: rows of one id, or of none, whose texts aren't linked all stay. Columns
    may have any names.
    """
    plain, (own, text) = numbered(docs, id_col, text_col)
    # a row goes by its text and its id; rows alike in both are alike in their component too
    key = {"_k": F.xxhash64(text_of(text)), "_i": F.coalesce(F.col(own).cast("long"), F.lit(-(2**63)))}
    fps = staged(fingerprints(plain, id_col=own, text_col=text, width=width, keyed=True), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("key"))
    rows = fps.groupBy("fp").agg(F.min(first).alias("own"))
    keep = rows.join(_grouped(fps, radius), "fp").groupBy("component").agg(F.min("own").alias("own"))
    keep = staged(keep.select(F.col("own.key").alias("_k"), F.coalesce("own.doc_id", F.lit(-(2**63))).alias("_i")), "kept")
    # a sort-merge join at every size: the texts are dealt out once, and by the key that repeats go by
    return plain.withColumns(key).join(keep.hint("merge"), ["_k", "_i"], "left_semi").dropDuplicates(["_k", "_i"]).select(*plain.columns).toDF(*docs.columns)
