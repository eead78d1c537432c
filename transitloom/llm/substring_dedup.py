"""Repeated passages by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one text. Its minimiser is the smallest hash of the ``MER``-word runs in it, so
equal windows have equal minimisers wherever they stand. Consecutive windows with one minimiser travel as one packed string
(a super-k-mer) to the bucket of that minimiser, where sorting finds each window's copies, on the words themselves.

1. Minimisers that occur under one id only cannot hold a repeated window: they are counted first, as numbers, and a Bloom
   filter of the shared ones (of bounded size, false alarms only travel in vain) decides which strings are packed at all.
2. Equal strings are combined before they travel; a bucket gets distinct strings with the smallest id of each.
3. Minimisers with more than ``HOT`` windows (a line that a third of the corpus holds) are not sorted in one task: their
   windows are grouped by 128-bit digest across all tasks, combined before the shuffle.

Defined cases: null, empty and short texts have no windows and keep all words; texts without id keep all words and remove
none; windows that repeat only under one id stay; repeated ids, also with different texts, are judged text by text; kept words are joined by one space; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from transitloom.llm.bloom import Bloom, hit
from transitloom.llm.groups import with_totals
from transitloom.llm.text import as_long, blocks, raw_texts, sequence_hashes, tidy, whole_texts
from transitloom.session import cut, load, store_counted

WINDOW = 50
MER = 12
HOT = 1 << 16


def _sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Smallest of each k values in a row."""
    have = 1
    while have * 2 <= k:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (k - have)], x[k - have :]) if k > have else x


def _runs(mers: np.ndarray, window: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser) of each super-k-mer of one text, given its mer hashes."""
    least = _sliding_min(mers, window - mer + 1)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    return first, np.diff(np.append(first, len(least))), least[first]


def _text_runs(column: pa.Array, window: int, mer: int):
    """(position in the column, runs or None) of each text."""
    for block in blocks(column):
        mers = sequence_hashes(block.hashes(), mer)
        for i, (a, b) in enumerate(zip(block.words[:-1].tolist(), block.words[1:].tolist())):
            yield block.first + i, _runs(mers[a : b - mer + 1], window, mer) if b - a >= window else None


def _minimisers(window: int, mer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, hashes, counts = [], batch.column(0), [], []
            for i, runs in _text_runs(batch.column(1), window, mer):
                if runs:
                    own, at = np.unique(runs[2], return_inverse=True)
                    hashes.append(own)
                    counts.append(np.bincount(at, weights=runs[1]).astype(np.int64))
                    rows.append(np.full(len(own), i))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.concatenate(rows))), pa.array(as_long(np.concatenate(hashes))), pa.array(np.concatenate(counts))], names=["id", "hash", "windows"]
                )

    return tidy(run)


def _key(packed: bytes) -> bytes:
    return hashlib.blake2b(packed, digest_size=16).digest()


def _pack(window: int, mer: int, bits, cells: int, kind: pa.DataType):
    """One row per text (words, sha), one per packed run (sha, key, start), one per distinct string of the batch (packed)."""
    names = ["id", "words", "sha", "key", "start", "hash", "packed"]
    types = [kind, pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), raw_texts(batch.column(1))
            docs, places, strings = [], [], {}
            for i, runs in _text_runs(batch.column(1), window, mer):
                words = texts[i].split()  # the same white space as in ``text``
                sha = hashlib.sha256(b" ".join(words)).hexdigest()
                docs.append((ids[i], len(words), sha, None, None, None, None))
                if runs is None or ids[i] is None:
                    continue
                first, count, least = runs
                for j in np.flatnonzero(hit(bits.value, least, cells)):
                    packed = b" ".join(words[first[j] : first[j] + count[j] + window - 1])
                    key = _key(packed)
                    places.append((ids[i], None, sha, key, int(first[j]), None, None))
                    seen = strings.get(key)
                    if seen is None or ids[i] < seen[0]:
                        strings[key] = (ids[i], None, None, key, None, int(as_long(least[j : j + 1])[0]), packed)
            rows = docs + places + list(strings.values())
            for a in range(0, len(rows), 20000):
                part = list(zip(*rows[a : a + 20000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, types)], names=names)

    return tidy(run)


def _windows(packed: bytes, window: int) -> Iterator[bytes]:
    spaces = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32).tolist()
    starts, ends = [0, *(s + 1 for s in spaces)], [*spaces, len(packed)]
    for i in range(len(starts) - window + 1):
        yield packed[starts[i] : ends[i + window - 1]]


def _sorted_bucket(window: int, kind: pa.DataType):
    """Rows come sorted by minimiser; for each string the runs of windows with one smallest id (of type ``kind``)."""

    def flush(group: list[tuple]) -> Iterator[tuple]:
        entries = sorted((w, first, k, i) for k, (packed, first) in enumerate(group) for i, w in enumerate(_windows(packed, window)))
        found: list[list[int]] = [[] for _ in group]
        smallest, before = None, None
        for w, first, k, i in entries:
            if w != before:
                smallest, before = first, w
            found[k].append((i, smallest))
        for (packed, _), own in zip(group, found):
            own.sort()
            firsts = [f for _, f in own]
            at = [0, *(i for i in range(1, len(firsts)) if firsts[i] != firsts[i - 1])]
            key = _key(packed)
            yield from ((key, a, b - a, firsts[a]) for a, b in zip(at, [*at[1:], len(firsts)]))

    def out(rows):
        key, at, n, first = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(first, kind)], names=["key", "at", "n", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, rows = None, [], []
        for batch in batches:
            for h, packed, first in zip(*(c.to_pylist() for c in batch.columns)):
                if h != now and group:
                    rows.extend(flush(group))
                    group = []
                    if len(rows) > 20000:
                        yield out(rows)
                        rows = []
                now = h
                group.append((packed, first))
        if group:
            rows.extend(flush(group))
        if rows:
            yield out(rows)

    return tidy(run)


def _digests(window: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for packed, first in zip(*(c.to_pylist() for c in batch.columns)):
                key = _key(packed)
                rows.extend((_key(w), key, i, first) for i, w in enumerate(_windows(packed, window)))
            for a in range(0, len(rows), 50000):
                digest, key, at, first = zip(*rows[a : a + 50000])
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(key, pa.binary()), pa.array(at, pa.int64()), pa.array(first, kind)], names=["digest", "key", "at", "first"])

    return tidy(run)


@tidy
def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops the words in the spans; a span is a first word and a number of words."""
    for batch in batches:
        rows = []
        for text, spans in zip(raw_texts(batch.column(1)), batch.column(2).to_pylist()):
            words = text.split()
            step = np.zeros(len(words) + 1, dtype=np.int64)
            for s in spans:
                step[s["start"]] += 1
                step[s["start"] + s["length"]] -= 1
            gone = np.cumsum(step[:-1]) > 0
            kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
            rows.append((len(words), int(gone.sum()), hashlib.sha256(b" ".join(words)).hexdigest(), hashlib.sha256(kept).hexdigest(), kept))
        n, removed, sha, kept_sha, kept = zip(*rows) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["id", "words", "removed", "sha", "kept_sha", "kept"],
        )


def _sha(text: Column) -> Column:
    """Digest of the words, joined by one space."""
    return F.sha2(F.array_join(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), " "), 256)


class Repeats:
    """``texts``: id, words, sha (of the words) of every row. ``spans``: id, sha, spans (array of start, length) of texts that lose words.

    An id may stand on several texts: places and spans go by id and sha.
    """

    def __init__(self, docs: DataFrame, window: int = WINDOW, mer: int = MER, hot: int = HOT) -> None:
        from pyspark.sql.pandas.types import to_arrow_type

        spark, kind = docs.sparkSession, docs.schema["id"].dataType
        name = kind.simpleString()
        self.docs = whole_texts(docs)
        seen = docs.where("id IS NOT NULL").mapInArrow(_minimisers(window, mer), f"id {name}, hash long, windows long")
        counted = seen.groupBy("hash").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.sum("windows").alias("windows"))
        shared = counted.where("low < high").select("hash", "windows")
        path, count = store_counted(shared)
        shared = load(spark, shared.schema, path)
        common = Bloom(shared.select("hash"), count)

        schema = f"id {name}, words long, sha string, key binary, start long, hash long, packed binary"
        packed = docs.mapInArrow(_pack(window, mer, common.bits, common.cells, to_arrow_type(kind)), schema)
        where = f"{path}-packed"
        packed.write.option("compression", "zstd").parquet(where)
        step = load(spark, schema, where)
        self.texts = step.where("words IS NOT NULL").select("id", "words", "sha")

        strings = step.where("packed IS NOT NULL").groupBy("hash", "packed").agg(F.min("id").alias("first"))
        crowded = shared.where(F.col("windows") > hot).select("hash")
        strings = cut(strings.join(crowded.withColumn("crowded", F.lit(True)), "hash", "left").select("hash", "packed", "first", F.coalesce("crowded", F.lit(False)).alias("crowded")))
        runs_schema = f"key binary, at long, n long, first {name}"
        arrow = to_arrow_type(kind)
        cold = strings.where("NOT crowded").select("hash", "packed", "first").repartition("hash").sortWithinPartitions("hash").mapInArrow(_sorted_bucket(window, arrow), runs_schema)
        exploded = strings.where("crowded").select("packed", "first").mapInArrow(_digests(window, arrow), f"digest binary, key binary, at long, first {name}")
        warm = with_totals(exploded, ["digest"], F.xxhash64("key", "at"), {"_m": F.min("first")}, {"smallest": F.min("_m")})
        # Neighbouring windows with one smallest id become one run again, so that a place meets few rows.
        turn = F.row_number().over(Window.partitionBy("key", "smallest").orderBy("at"))
        warm = warm.select("key", "smallest", "at", (F.col("at") - turn).alias("_g")).groupBy("key", "smallest", "_g").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
        runs = cold.union(warm.select("key", "at", "n", F.col("smallest").alias("first")))
        places = step.where("start IS NOT NULL").select("id", "sha", "key", "start")
        cuts = places.join(runs, "key").where("first < id").select("id", "sha", (F.col("start") + F.col("at")).alias("start"), (F.col("n") + (window - 1)).alias("length"))
        spans = cuts.groupBy("id", "sha").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
        path, self.count = store_counted(spans)
        self.spans = load(spark, spans.schema, path)

    def stripped(self) -> DataFrame:
        """id, words, removed, sha (of all words), kept_sha, kept (text) of the texts that lose words; other texts are not shuffled."""
        ids = Bloom(self.spans.select(F.xxhash64("id")), self.count)
        texts = self.docs.where("id IS NOT NULL").where(ids.test(F.xxhash64("id")))
        kind = self.docs.schema["id"].dataType.simpleString()
        rows = texts.withColumn("sha", _sha(F.col("text"))).join(self.spans, ["id", "sha"]).select("id", "text", "spans")
        return rows.mapInArrow(_strip, f"id {kind}, words long, removed long, sha string, kept_sha string, kept string")


def removal_report(docs: DataFrame) -> DataFrame:
    found = Repeats(docs.select(F.col("doc_id").alias("id"), "text"))
    cut_rows = found.stripped().select(F.col("id").alias("_id"), F.col("sha").alias("_sha"), "removed", "kept_sha").distinct()
    rows = found.texts.join(cut_rows, (F.col("id") == F.col("_id")) & (F.col("sha") == F.col("_sha")), "left")
    return rows.select(F.col("id").alias("doc_id"), F.col("words").alias("n_words"), F.coalesce("removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages cut out of the text; ``length_col`` follows where it exists. Other rows stay as they are."""
    found = Repeats(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), window)
    changed = found.stripped().select(F.col("id").alias("_id"), "sha", "kept").dropDuplicates(["_id", "sha"])
    lost = Bloom(found.spans.select(F.xxhash64("id")), found.count)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_i"))
    rows = rows.withColumn("_maybe", F.col("_i").isNotNull() & lost.test(F.coalesce(F.xxhash64("_i"), F.lit(0).cast("long"))))
    # Several rows may share an id; each meets its own text by the digest of its words.
    touched = rows.where("_maybe").withColumn("_sha", _sha(F.col(f"row.{text_col}"))).join(changed, (F.col("_i") == F.col("_id")) & (F.col("_sha") == F.col("sha")), "left")
    fields = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        if c == text_col:
            old = F.coalesce("kept", old)
        elif c == length_col:
            old = F.when(F.col("kept").isNotNull(), F.length("kept").cast(docs.schema[c].dataType)).otherwise(old)
        fields.append(old.alias(c))
    return rows.where(~F.col("_maybe")).select("row.*").union(touched.select(*fields))
