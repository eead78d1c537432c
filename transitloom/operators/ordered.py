"""Order-dependent steps that do not put a whole key group into one task.

Every helper takes a ``bucket`` column that never decreases along the order (for example the hour
of the timestamp). Rows are sorted only inside (key, bucket); what crosses a bucket border is a
small per-bucket summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from transitloom.session import cut


def number_rows(df: DataFrame, keys: list[str], order: list[str], bucket: str, out: str = "idx") -> DataFrame:
    """Exact 1-based ``row_number`` per key."""
    sizes = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy(*keys, bucket).orderBy(*order)
    numbered = df.withColumn("_rn", F.row_number().over(local))
    joined = numbered.join(offsets, [*keys, bucket])
    return joined.withColumn(out, (F.col("_rn") + F.col("_off")).cast("bigint")).drop("_rn", "_off")


def previous_row(df: DataFrame, keys: list[str], order: list[str], bucket: str, fields: list[str], out: str = "prev") -> DataFrame:
    """Adds a struct ``out`` with ``fields`` of the preceding row of the key (null on the first)."""
    packed = F.struct(*[F.col(c) for c in fields])
    local = Window.partitionBy(*keys, bucket).orderBy(*order)
    last = df.groupBy(*keys, bucket).agg(F.max_by(packed, F.struct(*[F.col(c) for c in order])).alias("_last"))
    chain = Window.partitionBy(*keys).orderBy(bucket)
    carried = last.select(*keys, bucket, F.lag("_last").over(chain).alias("_carry"))
    with_local = df.withColumn("_local", F.lag(packed).over(local))
    return (
        with_local.join(carried, [*keys, bucket])
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_local", "_carry")
    )


def trailing_rows(df: DataFrame, keys: list[str], idx: str, back: int, outputs: dict[str, Column], chunk: int = 20000) -> DataFrame:
    """Window aggregates over the last ``back + 1`` rows, given the row number ``idx``.

    The key is cut into chunks of ``chunk`` rows; each chunk also receives the last ``back`` rows of
    the chunk before it, which are dropped again after the window.
    """
    position = (F.col(idx) - 1) % chunk
    home = F.floor((F.col(idx) - 1) / chunk).cast("bigint")
    # F.when without otherwise yields null for rows that are in no halo; array_compact drops it.
    spread = df.withColumn(
        "_place",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(home.alias("chunk"), F.lit(False).alias("halo")),
                    F.when(position >= chunk - back, F.struct((home + 1).alias("chunk"), F.lit(True).alias("halo"))),
                )
            )
        ),
    ).select("*", F.col("_place.chunk").alias("_chunk"), F.col("_place.halo").alias("_halo")).drop("_place")
    w = Window.partitionBy(*keys, "_chunk").orderBy(idx).rowsBetween(-back, 0)
    for name, expression in outputs.items():
        spread = spread.withColumn(name, expression.over(w))
    return spread.filter(~F.col("_halo")).drop("_chunk", "_halo")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float], splits: int = 64) -> DataFrame:
    """Exact linear-interpolated quantiles per key, one output column per entry of ``fractions``.

    A mergeable sketch proposes split points; counts per split tell which splits hold the wanted
    ranks, and only those splits are sorted. Equal values are counted together first, and these counts
    are written once, so ``df`` is evaluated a single time.
    """
    counted = cut(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")))
    grid = F.array(*[F.lit(i / splits) for i in range(1, splits)])
    # Split points over the distinct values: what is sorted later is one row per distinct value.
    sketch = counted.groupBy(*keys).agg(F.percentile_approx(value, grid, F.lit(1000)).alias("_cuts"), F.sum("_c").alias("_total"))
    placed = counted.join(sketch, keys).withColumn(
        "_split", F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    )
    sizes = placed.groupBy(*keys, "_split").agg(F.sum("_c").alias("_n"), F.first("_total").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranks = F.array(
        *[F.floor(F.lit(p) * (F.col("_total") - 1)) for p in fractions.values()],
        *[F.ceil(F.lit(p) * (F.col("_total") - 1)) for p in fractions.values()],
    )
    wanted = (
        sizes.withColumn("_rank", F.explode(F.array_distinct(ranks)))
        .filter((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_n")))
        .groupBy(*keys, "_split")
        .agg(F.first("_start").alias("_start"), F.sort_array(F.collect_set("_rank")).alias("_ranks"))
    )
    inner = Window.partitionBy(*keys, "_split").orderBy(value)
    hit = (
        placed.select(*keys, "_split", value, "_c", "_total")
        .join(wanted, [*keys, "_split"])
        .withColumn("_end", F.col("_start") + F.sum("_c").over(inner))
        .withColumn("_rank", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_end") - F.col("_c")) & (r < F.col("_end")))))
    )
    found = hit.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", value))).alias("_at"), F.first("_total").alias("_total")
    )
    columns = []
    for name, p in fractions.items():
        position = F.lit(p) * (F.col("_total") - 1)
        low = F.element_at("_at", F.floor(position))
        high = F.element_at("_at", F.ceil(position))
        columns.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return found.select(*keys, *columns)
