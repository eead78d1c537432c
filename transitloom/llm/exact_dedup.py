"""Exact duplicates by two-pass Bloom filtering.

One scan turns texts into digests, written as a narrow table. Over it a Bloom filter that counts to two is built (first pass)
and asked (second pass): rows whose hash cannot occur twice pass straight through, only the others shuffle and are grouped
by their whole digest. False alarms of the filter cost a little shuffling and change nothing.

Defined cases: null text counts as empty; texts are equal when their bytes are, after lower-casing A-Z; of equal texts the
largest id stays (a null id is smaller than any); rows that repeat id and text are one group in which one row stays; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from transitloom.llm.bloom import MAX_CELLS, Bloom, hit
from transitloom.llm.groups import with_totals
from transitloom.llm.text import BLOCK, groups, tidy, whole_texts
from transitloom.session import load, store_counted


def _digest(text: bytes) -> bytes:
    return hashlib.sha256(text.lower()).digest()  # bytes.lower() changes A-Z only


def _hash(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


@tidy
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_digest(t) for _, texts in groups(batch.column(1), BLOCK, 256) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, pa.binary()), pa.array([_hash(d) for d in found], pa.int64())], names=["id", "digest", "hash"]
        )


def _marked(bits, cells: int, at: int, names: list[str]):
    """Rows as they are, with the digest of their text where it may stand twice, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [_digest(t) for _, texts in groups(batch.column(at), BLOCK, 256) for t in texts]
            maybe = hit(bits.value, np.array([_hash(d) for d in digests], dtype=np.int64), cells).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([d if m else None for d, m in zip(digests, maybe)], pa.binary())], names=names)

    return tidy(run)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_cells: int = MAX_CELLS) -> tuple[DataFrame, Bloom]:
    """One row per row of ``docs`` (id, digest, keep_id, group_size, kept), and the filter that knows which hashes may repeat."""
    narrow = whole_texts(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    found = narrow.mapInArrow(_digests, f"id {kind}, digest binary, hash long")
    path, rows = store_counted(found)
    table = load(docs.sparkSession, found.schema, path)
    repeats = Bloom(table.select("hash"), rows, max_cells, twice=True)
    flagged = table.withColumn("maybe", repeats.test(F.col("hash")))
    alone = flagged.where(~F.col("maybe")).select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    grouped = with_totals(
        flagged.where("maybe").select("id", "digest"), ["digest"], F.col("id"),
        {"_m": F.max("id"), "_c": F.count(F.lit(1))}, {"keep_id": F.max("_m"), "group_size": F.sum("_c")},
    )
    best = F.col("id").eqNullSafe(F.col("keep_id"))
    # Rows with the same id and text: the window holds only rows of one id.
    turn = F.row_number().over(Window.partitionBy("digest", "id").orderBy("group_size"))
    return alone.union(grouped.select("id", "digest", "keep_id", "group_size", (best & (turn == 1)).alias("kept"))), repeats


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the dropped copies, all columns kept. Texts that cannot repeat are not shuffled."""
    decisions, repeats = exact_duplicates(docs, id_col, text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    flat = docs.toDF(*names)
    marked = flat.mapInArrow(_marked(repeats.bits, repeats.cells, docs.columns.index(text_col), [*names, "_digest"]), StructType([*flat.schema.fields]).add("_digest", "binary"))
    back = F.struct(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
    rows = marked.select(back.alias("row"), F.col(names[docs.columns.index(id_col)]).alias("_id"), "_digest")
    # By id and digest: an id may stand on several texts, of which one stays and another goes.
    decided = decisions.where("group_size > 1").groupBy(F.col("id").alias("_k"), F.col("digest").alias("_d")).agg(F.max("kept").alias("_kept"))
    same = F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_digest") == F.col("_d"))
    met = rows.where("_digest IS NOT NULL").join(decided, same, "left").where("_kept IS NULL OR _kept")
    turn = F.row_number().over(Window.partitionBy("_id", "_digest").orderBy("_kept"))
    once = met.withColumn("_turn", turn).where("_kept IS NULL OR _turn = 1")
    return rows.where("_digest IS NULL").select("row.*").union(once.select("row.*"))


def dedup_report(docs: DataFrame) -> DataFrame:
    decisions, _ = exact_duplicates(docs)
    return decisions.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))

