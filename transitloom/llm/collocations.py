"""Phrase collocations by stripes: each prefix keys an associative counter of the words that follow it.

Lengths grow one word at a time. In a pass over the texts every task counts, block by block, the next words of the prefixes
(a stripe); stripes are shuffled as arrays, in one row per block and bucket, and merged element by element. The entries of a merged
stripe are the counts of the longer phrases, which the next pass has as totals of its prefixes, so prefix occurrences that no counted word
follows leave no task. The largest entry says whether an extension to the right covers the prefix. All later steps read
these written stripes only.

A phrase can only be frequent if both phrases without its first and without its last word are, so a pass counts a next word
only where a Bloom filter of the frequent phrases of the last length passes both. The filter never rejects a frequent one; its
size follows their number up to ``max_cells`` (16 MB), beyond which more is counted than needed, never less. Within a block
(about ``SIZE`` bytes) phrases are told apart by 64-bit hashes, across blocks by their text.

Hot prefixes: the stripes of prefixes that begin with one of the words with more than 1/``HOT_SHARE`` of all occurrences (fewer than
``HOT_SHARE`` words) are dealt over ``PLACES`` places by next word. Phrase counts with more than that share, at most ``HOT_SHARE`` per
length, are looked up by broadcast, all others by shuffle.

A candidate lies inside a longer phrase with the same count exactly if it does so in one with one word more, since counts
do not grow with length; so looking one word to the right and to the left covers all longer candidates.

Defined cases: null text counts as empty, null language as ``und``; repeated rows count each; other columns are ignored; an empty
table, or one without frequent phrases, gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from transitloom.llm.bloom import MAX_CELLS, Bloom, hit
from transitloom.llm.text import LOWER, groups, mix, sequence_hashes, span_hashes, tidy, whole_texts
from transitloom.session import cut, load, store_counted

MIN_COUNT = 100
MAX_WORDS = 5
FIRST = 2000
SIZE = 3 << 21
HOT_SHARE = 1000
PLACES = 64
BUCKETS = 256
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True
_NEXT = np.uint64(0xD6E8FEB86659FD93)


class Words:
    """The words of some texts: hashes by language, piece numbers, and their bytes with single spaces between."""

    def __init__(self, texts: list[bytes], langs: np.ndarray) -> None:
        """``langs``: a 64-bit number per text."""
        buf = LOWER[np.frombuffer(b"\n".join([b"", *texts, b""]), dtype=np.uint8)]
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        at = 1 + np.cumsum(sizes + 1) - sizes - 1
        gap = _GAP[buf]
        starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        self.text = np.searchsorted(at, starts, side="right") - 1
        self.piece = np.cumsum(_BREAK[buf], dtype=np.int64)[starts]
        self.hash = mix(span_hashes(buf, starts, ends) ^ langs[self.text])
        # One gap byte after each word stays and becomes a space.
        kept = ~gap
        kept[ends] = True
        buf[ends] = 32
        self.buf = buf[kept]
        place = np.cumsum(kept, dtype=np.int64)
        self.starts, self.ends = place[starts] - 1, place[ends] - 1

    def phrases(self, first: np.ndarray, width: int) -> pa.Array:
        """The texts of the phrases of ``width`` words that start at the words ``first``."""
        starts, ends = self.starts[first], self.ends[first + width - 1]
        offsets = np.zeros(len(first) + 1, dtype=np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        own = np.repeat(starts - offsets[:-1], ends - starts) + np.arange(offsets[-1])
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(self.buf[own].tobytes())).cast(pa.string())


def _lang_numbers(langs: list[str]) -> np.ndarray:
    known = {x: int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "big") for x in set(langs)}
    return np.fromiter((known[x] for x in langs), dtype=np.uint64, count=len(langs))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, pa.Array]]:
    """Words of consecutive texts and the language of each text. Batches (lang, text) are put together up to ``SIZE`` bytes."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[tuple[Words, pa.Array]]:
        table = pa.Table.from_batches(held).combine_chunks()
        langs = table.column(0).combine_chunks()
        numbers = _lang_numbers(langs.to_pylist())
        for first, texts in groups(table.column(1).combine_chunks(), SIZE, table.num_rows):
            yield Words(texts, numbers[first : first + len(texts)]), langs.slice(first, len(texts))

    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > SIZE:
            yield from flush()
            held = []
        if batch.num_rows:
            held.append(batch)
    if held:
        yield from flush()


@tidy
def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for words, langs in _blocks(batches):
        _, first, n = np.unique(words.hash, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pc.take(langs, pa.array(words.text[first])), words.phrases(first, 1), pa.array(n)], names=["lang", "phrase", "n"])


@tidy
def _hash_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of whole phrases (columns lang, phrase), as counting tasks compute them."""
    for words, _ in _blocks(batches):
        if len(words.text):
            first = np.flatnonzero(np.append(True, words.text[1:] != words.text[:-1]))
            width = int(len(words.text) / len(first))
            yield pa.RecordBatch.from_arrays([pa.array(sequence_hashes(words.hash, width)[first].view(np.int64))], names=["h"])


def _stripes(width: int, bits, cells: int, hot: np.ndarray):
    """Stripes of the prefixes of ``width`` words that the filter passes, packed as ``merge_stripes`` reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs in _blocks(batches):
            own = sequence_hashes(words.hash, width)
            if not len(own):
                continue
            inside = words.piece[: len(own)] == words.piece[width - 1 :]
            known = np.zeros(len(own) + 1, dtype=bool)
            known[np.flatnonzero(inside)] = hit(bits.value, own[inside].view(np.int64), cells)
            at = np.flatnonzero(known[:-1] & known[1:])
            at = at[words.piece[at] == words.piece[at + width]]
            if not len(at):
                continue
            last, prefix = at + width, own[at]
            _, first, n = np.unique(mix(prefix * _NEXT + words.hash[last]), return_index=True, return_counts=True)
            place = np.where(np.isin(words.hash[at[first]], hot), words.hash[last[first]] % np.uint64(PLACES), 0).astype(np.int32)
            order = np.lexsort((place, prefix[first]))
            first, n, place = first[order], n[order], place[order]
            heads = np.flatnonzero(np.append(True, (prefix[first][1:] != prefix[first][:-1]) | (place[1:] != place[:-1])))
            offsets = pa.array(np.append(heads, len(first)), pa.int32())
            cells_of = pc.binary_join_element_wise(pa.array(n).cast(pa.string()), words.phrases(last[first], 1), " ")
            keys = pc.binary_join_element_wise(
                words.phrases(at[first[heads]], width), pa.array(place[heads]).cast(pa.string()), pc.take(langs, pa.array(words.text[at[first[heads]]])), "\n"
            )
            cells_of = pc.binary_join(pa.ListArray.from_arrays(offsets, cells_of), "\n")
            # All stripes of the block that go to one bucket are one row.
            bucket = (mix(prefix[first[heads]] + place[heads].astype(np.uint64) * _NEXT) % np.uint64(BUCKETS)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            bucket, starts = np.unique(bucket[by], return_index=True)
            offsets, by = pa.array(np.append(starts, len(by)), pa.int32()), pa.array(by)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.ListArray.from_arrays(offsets, keys.take(by)), pa.ListArray.from_arrays(offsets, cells_of.take(by))], names=["bucket", "keys", "cells"]
            )

    return tidy(run)


def merge_stripes(stripes: DataFrame, frequent: DataFrame, min_count: int) -> DataFrame:
    """lang, prefix, total, widest (largest frequent count of a next word) and the entries that are frequent.

    A stripe travels as two strings, as words hold neither spaces nor line ends: prefix, place and language, and its cells
    (count and next word). Stripes are dealt by bucket once, which follows from the key; both groupings below use that.
    A prefix has one row per place with frequent entries and one with its total, which ``frequent`` (lang, phrase, n) brings.
    """
    # Cells become rows straight from the arrays of a block: there is no row per block and prefix between.
    dealt = stripes.repartition("bucket").select("bucket", F.arrays_zip("keys", "cells").alias("s"))
    cells = F.flatten(F.transform("s", lambda x: F.transform(F.split(x["cells"], "\n"), lambda c: F.struct(x["keys"].alias("key"), c.alias("c")))))
    each = dealt.select("bucket", F.inline(cells)).select(
        "bucket", "key", F.expr("substr(c, instr(c, ' ') + 1)").alias("next"), F.expr("cast(substr(c, 1, instr(c, ' ') - 1) as bigint)").alias("n")
    )
    summed = each.groupBy("bucket", "key", "next").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    merged = summed.groupBy("bucket", "key").agg(F.max("n").alias("widest"), F.collect_list(F.struct("next", "n")).alias("entries"))
    part = F.split("key", "\n", 3)
    found = merged.select(part[2].alias("lang"), part[0].alias("prefix"), F.lit(0).cast("long").alias("total"), "widest", "entries")
    totals = frequent.select("lang", F.col("phrase").alias("prefix"), F.col("n").alias("total"), F.lit(None).cast("long").alias("widest"), F.array().cast(found.schema["entries"].dataType).alias("entries"))
    return found.union(totals)


def phrase_stripes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                   max_cells: int = MAX_CELLS) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n: all word occurrences), and the merged stripes of prefixes of 1, 2, ... max_words - 1 words."""
    texts = whole_texts(docs).select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    counted = texts.mapInArrow(_count_words, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    # Only totals and frequent words are kept of the counts: rare words are summed per language while writing.
    kept = F.when(F.col("n") >= min_count, F.col("phrase"))
    words = cut(counted.groupBy("lang", kept.alias("phrase")).agg(F.sum("n").alias("n")))
    totals = cut(words.groupBy("lang").agg(F.sum("n").alias("n")))
    every = totals.agg(F.sum("n")).first()[0] or 0
    frequent = words.where("phrase IS NOT NULL").select("lang", "phrase", "n")
    hot_rows = frequent.where(F.col("n") * HOT_SHARE > every).select("lang", "phrase").toPandas()  # fewer than HOT_SHARE rows
    hot = Words([w.encode() for w in hot_rows["phrase"]], _lang_numbers(list(hot_rows["lang"]))).hash if len(hot_rows) else np.zeros(0, np.uint64)
    found: list[DataFrame] = []
    for width in range(1, max_words):
        hashed = frequent.select("lang", "phrase").mapInArrow(_hash_phrases, "h long")
        path, rows = store_counted(hashed)
        if not rows:
            break
        bloom = Bloom(load(docs.sparkSession, hashed.schema, path), rows, max_cells)
        stripes = texts.mapInArrow(_stripes(width, bloom.bits, bloom.cells, hot), "bucket int, keys array<string>, cells array<string>")
        merged = cut(merge_stripes(stripes, frequent, min_count))
        found.append(merged)
        frequent = merged.select("lang", "prefix", F.explode("entries").alias("e")).select("lang", F.concat_ws(" ", "prefix", "e.next").alias("phrase"), F.col("e.n").alias("n"))
    return totals, found


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language that no longer phrase covers."""
    spark = docs.sparkSession
    totals, levels = phrase_stripes(docs, text_col, lang_col, min_count, max_words)
    if not levels:
        return spark.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    stripes = levels[0].withColumn("width", F.lit(1))
    for i, level in enumerate(levels[1:], 2):
        stripes = stripes.unionByName(level.withColumn("width", F.lit(i)))
    prefixes = cut(stripes.groupBy("lang", "prefix", "width").agg(F.sum("total").alias("f"), F.max("widest").alias("widest")).where(F.col("f") >= min_count))
    entries = stripes.select("lang", "prefix", "width", F.explode("entries").alias("e"))
    candidates = cut(entries.select("lang", F.concat_ws(" ", "prefix", "e.next").alias("phrase"), (F.col("width") + 1).alias("words"), F.col("e.n").alias("a")))

    # Candidates that an extension by one word covers, to the right (from the stripe) or to the left.
    right = prefixes.select("lang", F.col("prefix").alias("phrase"), F.col("widest").alias("to_right"))
    tail = F.expr("substr(phrase, instr(phrase, ' ') + 1)")
    left = candidates.where("words > 2").groupBy("lang", tail.alias("phrase")).agg(F.max("a").alias("to_left"))
    free = candidates.join(right, ["lang", "phrase"], "left").join(left, ["lang", "phrase"], "left").where(
        (100 * F.coalesce("to_right", F.lit(0)) < 100 * F.col("a")) & (100 * F.coalesce("to_left", F.lit(0)) < 100 * F.col("a"))
    )
    counts = prefixes.select("lang", F.col("prefix").alias("part"), "f")
    every = totals.agg(F.sum("n").alias("all")).first()["all"]
    often = F.broadcast(counts.where(F.col("f") * HOT_SHARE > every))  # at most HOT_SHARE rows per length
    seldom = counts.where(F.col("f") * HOT_SHARE <= every)

    def looked_up(rows: DataFrame, part: str, name: str) -> DataFrame:
        keyed = rows.withColumnRenamed(part, "part")
        found = keyed.join(often, ["lang", "part"], "left")
        rest = found.where("f IS NULL").drop("f").join(seldom, ["lang", "part"])
        return found.where("f IS NOT NULL").unionByName(rest).withColumnRenamed("f", name).drop("part")

    split = F.split("phrase", " ")
    cuts = free.select("lang", "phrase", "a", split.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"),
    )
    parts = looked_up(cut(looked_up(cuts, "head", "l")), "rest", "r").join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(4, 0)) * (cast(a as decimal(17, 0)) * cast(n as decimal(17, 0)))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    lowest = parts.select("*", score.alias("score")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    return lowest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "c.l", "c.r", "n", "c.score")
