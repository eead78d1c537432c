"""N-gram Jaccard join by grouped prefixes.

Documents become sets of shingle hashes. Shingles have one global order: rare before frequent, by a counting sketch of fixed
size over the whole corpus, then by hash. Two sets that reach the threshold share a shingle among the first few of each
(the prefix). Documents with the same prefix and set size collapse into one group; groups that share a prefix shingle are
candidates; member pairs are verified on the shingle sets of the whole texts.

Only links between different sets matter, and only until their components are known, so no group is expanded into all pairs:

1. stars: every set of a group meets the group's first, every group of a prefix shingle meets that shingle's first group;
2. the rest: where a prefix shingle still joins several components, the members outside its largest component meet all of
   other components (exactly, without a cap).

Defined cases: null, empty and blank texts have no shingles and no links; fewer words than the width make one shingle; equal
sets are one class whatever their number; repeated ids count once per row in the result and once in links, each of their
texts for itself where they differ; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from transitloom.llm.bloom import Bloom
from transitloom.llm.groups import components, with_totals
from transitloom.llm.text import as_long, blocks, mix, shingle_sets, tidy, whole_texts
from transitloom.session import cut, load, store_counted

BUCKETS = 1 << 20
_CHUNK = 1 << 16


def _sketch(width: int):
    """Shingle counts by bucket, one set of chunks per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for block in blocks(batch.column(0), lower=True):
                sets = shingle_sets(block, width)
                if sets:
                    counts += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=BUCKETS)
        for i in range(BUCKETS // _CHUNK):
            own = counts[i * _CHUNK : (i + 1) * _CHUNK]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names=["chunk", "counts"])

    return tidy(run)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}  # at most BUCKETS / _CHUNK entries
    for batch in batches:
        for at, own in zip(*(c.to_pylist() for c in batch.columns)):
            own = np.frombuffer(zlib.decompress(own), np.int64)
            sums[at] = sums[at] + own if at in sums else own
    for at, own in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["chunk", "counts"])


def shingle_levels(docs: DataFrame, text_col: str, width: int):
    """Broadcast array: for each bucket the magnitude (base 2) of the number of sets that hold its shingles; BUCKETS bytes."""
    schema = "chunk int, counts binary"
    summed = docs.select(F.col(text_col).alias("text")).mapInArrow(_sketch(width), schema).repartition(BUCKETS // _CHUNK, "chunk").mapInArrow(_add, schema)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at, own in summed.collect():  # BUCKETS counts in all
        counts[at * _CHUNK : (at + 1) * _CHUNK] = np.frombuffer(own, np.int64)
    return docs.sparkSession.sparkContext.broadcast(np.ceil(np.log2(counts + 1)).astype(np.uint8).tobytes())


def _spread(own: np.ndarray) -> bytes | None:
    """How many hashes fall into each of equal ranges; the ranges halve with the set size, so any two can be folded together."""
    bits = 6 if len(own) < 512 else 8 if len(own) < 4096 else 10
    counts = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype("<u2").tobytes() if counts.max() < 1 << 16 else None


def _possible(num: int, den: int):
    """Keeps pairs that may reach num / den: no more hashes can be common than the smaller count of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(c.to_pylist() for c in batch.columns[2:])):
                if x is None or y is None:
                    keep.append(True)
                    continue
                x, y = np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")
                size = min(len(x), len(y))
                most = int(np.minimum(x.reshape(size, -1).sum(axis=1), y.reshape(size, -1).sum(axis=1)).sum())
                keep.append(den * most >= num * (na + nb - most))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return tidy(run)


def _likely(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Drops pairs that sizes and counts by range rule out, before any text is moved."""
    own = classes.select("class_id", "n", "spread")
    left = own.select(F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("spread").alias("sa"))
    right = own.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("spread").alias("sb"))
    met = pairs.join(left, "a").join(right, "b").where(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")
    kind = pairs.schema["a"].dataType.simpleString()
    return met.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_possible(num, den), f"a {kind}, b {kind}")


def _prefixes(width: int, num: int, den: int, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        for batch in batches:
            rows = []
            for block in blocks(batch.column(1), lower=True):
                for own in shingle_sets(block, width):
                    n = len(own)
                    if not n:
                        rows.append((0, 0, 0, 0, None, None))
                        continue
                    length = n - -(-num * n // den) + 1
                    order = np.lexsort((own, level[(own >> np.uint64(44)).astype(np.int64)]))[:length]
                    prefix = own[order]
                    sums = [int(mix(own + np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (1, 2)]
                    head = int(mix(np.sort(prefix) + np.uint64(3)).sum(dtype=np.uint64).view(np.int64))
                    rows.append((n, *sums, head, as_long(prefix), _spread(own)))
            n, d1, d2, head, prefix, spread = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(head, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(spread, pa.binary())],
                names=["id", "n", "d1", "d2", "head", "prefix", "spread"],
            )

    return tidy(run)


def _overlaps(width: int, num: int, den: int):
    """Keeps pairs of texts whose shingle sets reach num / den."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 64  # pairs whose texts are open at a time
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                left = [s for b in blocks(part.column(2), lower=True) for s in shingle_sets(b, width)]
                right = [s for b in blocks(part.column(3), lower=True) for s in shingle_sets(b, width)]
                keep = []
                for x, y in zip(left, right):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], names=["a", "b"])

    return tidy(run)


def verify(pairs: DataFrame, count: int, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole texts are similar enough. Only texts that pairs name are shuffled."""
    named = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    wanted = Bloom(named.select(F.xxhash64("id").alias("h")), 2 * count)
    texts = docs.where(wanted.test(F.xxhash64("id")))
    first = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = first.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "ta", "tb").mapInArrow(_overlaps(width, num, den), f"a {kind}, b {kind}")


def _key(row_id: Column, text: Column) -> Column:
    """An id together with its text, for tables where an id stands on several texts; orders by id first."""
    return F.when(row_id.isNotNull(), F.struct(row_id.alias("id"), F.xxhash64(text).alias("text")))


def _classes(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(id, n_shingles, class_id, component_id per row, whether the three ids are keys of id and text)."""
    narrow = whole_texts(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    levels = shingle_levels(narrow, "text", width)
    sets = _sets(narrow, width, num, den, levels)
    several = sets.where("id IS NOT NULL").groupBy("id").agg((F.min("d1") < F.max("d1")).alias("d1"), (F.min("d2") < F.max("d2")).alias("d2"))
    nested = bool(several.where("d1 OR d2").take(1))
    if nested:
        narrow = narrow.withColumn("id", _key(F.col("id"), F.col("text")))
        sets = _sets(narrow, width, num, den, levels)
    return _linked(narrow, sets, width, num, den), nested


def _sets(narrow: DataFrame, width: int, num: int, den: int, levels) -> DataFrame:
    kind = narrow.schema["id"].dataType.simpleString()
    return cut(narrow.mapInArrow(_prefixes(width, num, den, levels), f"id {kind}, n long, d1 long, d2 long, head long, prefix array<long>, spread binary"))


def jaccard_classes(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, class_id (smallest id with the same set), component_id."""
    found, nested = _classes(docs, width, num, den, id_col, text_col)
    return found.select(*[F.col(f"{c}.id" if nested and c != "n_shingles" else c).alias(c) for c in found.columns])


def _linked(narrow: DataFrame, sets: DataFrame, width: int, num: int, den: int) -> DataFrame:
    spark = narrow.sparkSession
    full = sets.where("n > 0 AND id IS NOT NULL")
    members = cut(with_totals(full.select("id", "n", "d1", "d2"), ["n", "d1", "d2"], F.col("id"), {"_m": F.min("id")}, {"class_id": F.min("_m")}).select("id", "n", "class_id"))
    firsts = members.where("id = class_id").select("class_id").distinct()
    classes = full.select("id", "n", "head", "prefix", "spread").join(firsts.withColumnRenamed("class_id", "id"), "id", "left_semi").dropDuplicates(["id"])
    grouped = with_totals(classes, ["n", "head"], F.col("id"), {"_m": F.min("id")}, {"group_id": F.min("_m")})
    classes = cut(grouped.select(F.col("id").alias("class_id"), "n", "group_id", "spread", F.when(F.col("id") == F.col("group_id"), F.col("prefix")).alias("prefix")))
    postings = classes.where("prefix IS NOT NULL").select("group_id", "n", F.size("prefix").alias("length"), F.posexplode("prefix").alias("place", "token"))
    tokens = postings.groupBy("token").agg(F.min("group_id").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = cut(postings.join(tokens.select("token", "hub"), "token").select("token", "hub", "group_id", "n", "place"))

    # Both places of the shared shingle bound what can be common (see _unsettled, which meets pairs that are first met elsewhere).
    hubs = shared.where("hub = group_id").select("token", F.col("n").alias("hn"), F.col("place").alias("hp"))
    need = f"ceil({num} * (n + hn) / {num + den})"
    stars = (
        shared.where("hub <> group_id").join(hubs, "token").where(f"least(n - place, hn - hp) >= {need}").select(F.col("hub").alias("a"), F.col("group_id").alias("b"))
        .union(classes.where("class_id <> group_id").select(F.col("group_id").alias("a"), F.col("class_id").alias("b"))).distinct()
    )
    stars = _likely(stars, classes, num, den)
    path, count = store_counted(stars)
    stars = load(spark, stars.schema, path)
    links = cut(verify(stars, count, narrow, width, num, den))
    labels = cut(components(classes.select(F.col("class_id").alias("node")), links))

    rest = _likely(_unsettled(classes, shared, labels, num, den), classes, num, den).join(stars, ["a", "b"], "left_anti")
    path, count = store_counted(rest)
    if count:
        more = cut(verify(load(spark, rest.schema, path), count, narrow, width, num, den))
        if more.take(1):
            labels = cut(components(classes.select(F.col("class_id").alias("node")), links.union(more)))
    labelled = labels.select(F.col("node").alias("class_id"), F.col("label").alias("component_id"))
    known = members.join(labelled, "class_id").select("id", F.col("n").alias("n_shingles"), "class_id", "component_id")
    bare = sets.where("n = 0 OR id IS NULL").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    return known.union(bare)


def _unsettled(classes: DataFrame, shared: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate class pairs (a, b) that lie in different components so far."""
    marked = classes.select("class_id", "group_id", "n").join(labels.select(F.col("node").alias("class_id"), "label"), "class_id")
    marked = cut(marked)
    spans = marked.groupBy("group_id").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"))
    at = shared.select("token", "group_id", "place").join(spans, "group_id")
    open_tokens = at.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("token")
    # A pair of different components only shares open tokens, so it is met once, at the first open token that both have. Each entry
    # carries the open tokens of its group before its own, at most a prefix.
    held = shared.select("token", "group_id", "place").join(open_tokens, "token").groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("own"))
    by_token = held.select("group_id", "own", F.posexplode("own").alias("i", "at")).select(
        F.col("at.token").alias("key"), "group_id", F.col("at.place").alias("place"), F.transform(F.slice("own", F.lit(1), F.col("i")), lambda e: e["token"]).alias("before"), F.lit(False).alias("inner")
    )
    # The classes of one group are candidates of each other: the group acts as one more token.
    by_group = spans.where("low <> high").select(
        F.xxhash64(F.lit("group"), "group_id").alias("key"), "group_id", F.lit(0).alias("place"), F.array().cast("array<long>").alias("before"), F.lit(True).alias("inner")
    )
    entries = by_token.union(by_group).join(marked, "group_id").select("key", "inner", "group_id", "before", "class_id", "n", "label", "place")
    entries = cut(entries)
    keys = ["key", "inner"]
    largest = entries.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    side = lambda df, name: df.select(
        *keys, F.col("class_id").alias(name), *[F.col(c).alias(f"{s}{name}") for c, s in [("n", "n"), ("label", "l"), ("place", "p"), ("before", "b"), ("group_id", "g"), ("main", "m")]]
    )
    marked_entries = entries.join(largest, keys)
    left, right = side(marked_entries.where("label <> main"), "x"), side(marked_entries, "y")
    # Position filter: a pair that qualifies passes at its first common shingle, after which all its common shingles come.
    need = f"ceil({num} * (nx + ny) / {num + den})"
    near = left.join(right, keys).where(
        # Where both lie outside the largest component, one side meets the other.
        f"lx <> ly AND (ly = my OR x < y) AND (inner OR gx <> gy) AND {den} * least(nx, ny) >= {num} * greatest(nx, ny) AND least(nx - px, ny - py) >= {need} AND NOT arrays_overlap(bx, by)"
    )
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components_report(docs: DataFrame) -> DataFrame:
    found = jaccard_classes(docs, width=4, num=85, den=100)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "class_id")


def keep_one_per_component(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row (the smallest id) of each group of near copies; rows without id stay."""
    found, nested = _classes(docs, width, num, den, id_col, text_col)
    gone = found.where("id <> component_id").select(F.col("id").alias("_gone")).distinct()
    own = _key(F.col(id_col), F.col(text_col)) if nested else F.col(id_col)
    return docs.select(F.struct("*").alias("row"), own.alias("_id")).join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("row.*")
