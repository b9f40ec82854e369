"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import shared_dir, staged, table

__all__ = ["batched", "crc_mod", "join_named", "labelled_sample", "numbered", "shared_dir", "staged", "table", "text_of"]

#: Rows handed to Python at a time; keeps a batch of very long texts within a worker's memory.
BATCH_ROWS = 256


def text_of(name: str = "text") -> Column:
    """The text column, null counted as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def batched(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with small input batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def numbered(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """docs with its columns renamed c0, c1 and so on, which clash with no working column, and the new names of some.

    toDF(*docs.columns) on a result with the same columns undoes it; renaming costs nothing in the plan.
    """
    lower = [c.lower() for c in docs.columns]
    return docs.toDF(*(f"c{k}" for k in range(len(lower)))), [f"c{lower.index(n.lower())}" for n in names]


def crc_mod(name: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo mod."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % F.lit(mod)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, id_col: str = "doc_id", text_col: str = "text", most_rows: int, most_chars: int | None = None, seed: int) -> DataFrame:
    """doc_id, text and y of about most_rows labelled documents at most, drawn by a hash of the id and written out.

    Only the drawn ids, a number that most_rows bounds, go to the documents, which are read once and never dealt out.
    A document labelled more than once has its mean label, a half counting as 1; of documents that share an id the one
    whose text hashes lowest stands for all. Null labels and ids are left out, null texts are empty. If the drawn texts have more
    than most_chars characters, fewer documents are taken; texts are never cut. Empty tables give an empty sample.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11)
    share = min(1.0, most_rows / max(1, known.count()))
    drawn = known.filter(place <= int(share * 2**53))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).join(F.broadcast(drawn), "doc_id")
    rows = staged(texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y")), "labelled")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if most_chars is not None and size > most_chars:
        rows = rows.filter(place <= int(share * most_chars / size * 2**53))
    return rows


def join_named(rows: DataFrame, names: DataFrame, key: str, weight: str, *, share: int = 1000) -> DataFrame:
    """rows with the columns of names, one row a key, where weight counts the key's rows; rows without a key's name go.

    Keys with more than a share-th of all rows, fewer than share of them, are broadcast, so that their rows are not dealt
    out; the others' rows are dealt by key, none of which then fills a task.
    """
    total = names.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = F.col(weight) * share > F.lit(total)
    often = F.broadcast(names.filter(hot).drop(weight))
    rest = rows.join(often.select(key), key, "left_anti").join(names.filter(~hot).drop(weight), key)
    return rows.join(often, key).unionByName(rest)
