"""Packing token sequences by minimum bin slack.

Documents are encoded once; each becomes pieces of ``capacity`` ids and one shorter rest, written as a table. Full pieces are
sequences already. For the rests only the number of pieces of each length matters (at most capacity - 1 numbers, whatever the
corpus size): a bitset subset-sum over that multiset finds the fill closest to capacity, the bits are traced back to counts per
length, and the pattern is used as often as the counts allow. The patterns (a few thousand at most) are then dealt to the
pieces by their number within their length, in Spark.

When no multiset fills a sequence exactly, the few pieces that are left are laid end to end and cut at capacity; what remains
of them at the end is cut into powers of two, which need no padding.

Defined cases: null text counts as empty and still has its end token; every id lies in exactly one piece; repeated rows and ids
are packed once per row; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from transitloom.llm import bpe
from transitloom.llm.text import tidy
from transitloom.session import load, step_folder

CAPACITY = 1024
END_ID = 0


def _pieces(source, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = bpe.encoder(source)
        for batch in batches:
            rows, docs = [], []
            for i, ids in enumerate(tool.column(batch.column(2))):
                ids = np.append(ids, end).astype("<u4")
                for a in range(0, len(ids), capacity):
                    own = ids[a : a + capacity]
                    rows.append((a, len(own), zlib.crc32(own.tobytes()), len(ids), own.tobytes()))
                    docs.append(i)
                if len(rows) > 4000:
                    yield _batch(batch, docs, rows)
                    rows, docs = [], []
            if rows:
                yield _batch(batch, docs, rows)

    def _batch(batch, docs, rows):
        at = pa.array(docs, pa.int64())
        start, length, crc, tokens, ids = zip(*rows)
        numbers = [pa.array(c, pa.int64()) for c in (start, length, crc, tokens)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *numbers, pa.array(ids, pa.binary())], names=["id", "row", "start", "length", "crc", "tokens", "ids"])

    return tidy(run)


def best_fill(counts: dict[int, int], capacity: int) -> tuple[int, dict[int, int]]:
    """(fill, count per length) of the multiset whose sum is closest to capacity, longest lengths first.

    Bit s of a mask says that sum s can be reached with the lengths so far; counts are split into powers of two.
    """
    limit = (1 << (capacity + 1)) - 1
    mask, trail = 1, []
    for length in sorted(counts, reverse=True):
        left, block = min(counts[length], capacity // length), 1
        while left:
            n = min(block, left)
            trail.append((length, n, mask))
            mask |= (mask << (length * n)) & limit
            left -= n
            block *= 2
        if mask >> capacity:
            break
    fill = mask.bit_length() - 1
    rest, used = fill, {}
    for length, n, before in reversed(trail):
        if not before >> rest & 1:
            used[length] = used.get(length, 0) + n
            rest -= length * n
    return fill, used


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """([(times, count per length)] of exactly filled sequences, what is left)."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        fill, used = best_fill(left, capacity)
        if fill < capacity:
            break
        times = min(left[k] // n for k, n in used.items())
        out.append((times, used))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out, left


def _numbered(rests: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 within each length. A length may hold a third of all rows: rows are numbered within (length, salt)."""
    rests = rests.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(64)).cast("int"))
    sizes = rests.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("row")) - 1
    return rests.withColumn("_r", local).join(offsets, ["length", "_salt"]).withColumn("rank", F.col("_r") + F.col("_before")).drop("_r", "_before", "_salt")


def _cut_at(total: int, capacity: int, first: int):
    """Cuts pieces (with ``place``, their start in one long line of ``total`` ids) at the borders of sequences."""
    tail, borders = total - total % capacity, []
    for bit in reversed(range(capacity.bit_length())):
        if (total - tail) >> bit & 1 and sum(n for _, n in borders) + (1 << bit) <= total - tail:
            borders.append((tail + sum(n for _, n in borders), 1 << bit))

    def spans(a: int, b: int):
        """(begin, end, sequence, begin of the sequence) of the parts of a..b."""
        while a < b:
            if a < tail:
                begin, size, number = a - a % capacity, capacity, a // capacity
            else:
                k = max(i for i, (at, _) in enumerate(borders) if at <= a)
                (begin, size), number = borders[k], tail // capacity + k
            end = min(b, begin + size)
            yield a, end, first + number, begin
            a = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            start, length, tokens, ids, place = (c.to_pylist() for c in batch.columns[2:])
            for i in range(batch.num_rows):
                for a, b, number, begin in spans(place[i], place[i] + length[i]):
                    own = ids[i][4 * (a - place[i]) : 4 * (b - place[i])]
                    rows.append((start[i] + a - place[i], b - a, zlib.crc32(own), tokens[i], own, number, a - begin))
                    at.append(i)
            if rows:
                *numbers, own, number, offset = zip(*rows)
                picked = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(picked), batch.column(1).take(picked), *[pa.array(c, pa.int64()) for c in numbers], pa.array(own, pa.binary()), pa.array(number, pa.int64()), pa.array(offset, pa.int64())],
                    names=["id", "row", "start", "length", "crc", "tokens", "ids", "sequence_id", "offset"],
                )

    return tidy(run)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """One row per piece: id, row (number of the input row), start, length, crc, tokens, ids (little-endian unsigned 32-bit),
    sequence_id, offset."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    source = bpe.load_source(docs, tokenizer)
    schema = f"id {narrow.schema['id'].dataType.simpleString()}, row long, start long, length long, crc long, tokens long, ids binary"
    path = f"{step_folder(spark)}/{uuid.uuid4().hex}"
    narrow.mapInArrow(_pieces(source, capacity, end), schema).write.option("compression", "zstd").parquet(path)
    pieces = load(spark, schema, path)
    short = pieces.where(F.col("length") < capacity)
    counts = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # under capacity rows
    patterns, left = plan(counts, capacity)

    # Where each length's pieces go: (length, from rank, to rank, pieces a sequence, first sequence, offset of the first).
    rows, used, first = [], dict.fromkeys(counts, 0), 0
    for times, own in patterns:
        offset = 0
        for length, n in own.items():
            rows.append((length, used[length], used[length] + n * times, n, first, offset))
            used[length] += n * times
            offset += n * length
        first += times
    lines, total = [], 0
    for length, n in left.items():
        lines.append((length, used[length], total))
        total += length * n
    sequences = first + total // capacity + bin(total % capacity).count("1")

    columns = ["id", "row", "start", "length", "crc", "tokens", "ids"]
    ranked = _numbered(short)
    # Both tables are bounded by the capacity, not by the data.
    deal = F.broadcast(spark.createDataFrame(rows, "length long, low long, high long, each long, first long, base long"))
    here = F.col("rank") - F.col("low")
    dealt = ranked.join(deal, (ranked["length"] == deal["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(
        *[ranked[c] for c in columns],
        (F.col("first") + F.floor(here / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + ranked["length"] * F.pmod(here, F.col("each"))).cast("long").alias("offset"),
    )
    full = pieces.where(F.col("length") == capacity).select(*columns, (F.lit(sequences) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    line = F.broadcast(spark.createDataFrame(lines, "length long, low long, at long"))
    loose = ranked.join(line, (ranked["length"] == line["length"]) & (F.col("rank") >= F.col("low"))).select(
        ranked["id"], ranked["row"], "start", ranked["length"], "tokens", "ids", (F.col("at") + ranked["length"] * (F.col("rank") - F.col("low"))).alias("place")
    )
    cut_schema = schema + ", sequence_id long, offset long"
    return full.union(dealt).union(loose.mapInArrow(_cut_at(total, capacity, first), cut_schema))


def packing_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    packed = pack(docs, tokenizer)
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), "sequence_id", "offset")
