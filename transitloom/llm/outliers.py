"""Quality rules by robust multivariate outliers: minimum covariance determinant per language and source.

Every text becomes five counts. Fixed rules reject very short and very repetitive texts; for the others the counts become a
vector of transformed statistics, each (language, source) gets a robust centre and covariance of its vectors, and texts far from
the centre by Mahalanobis distance are rejected. Only DataFrame functions are used.

The covariance is that of the ``SUPPORT`` share of a cell's rows with the smallest determinant, found by concentration steps
from three fixed starts (classical moments; medians and median deviations; moments of the rows near the medians), then
reweighted once; the best start after ``FIRST_STEPS`` steps goes on until no determinant falls. Each statistic counts as measured with an error of its ``floor``, whose square is added to its variance, so a
statistic that is constant in a cell leaves the determinant positive. A step counts rows by bin of the
distance, which gives each cell its limit, and sums the rows within it: counts and sums are combined before the shuffle, a cell
has a bounded number of bins, and a cell that holds most rows needs no task of its own. Bins are 1/``BINS`` wide in the logarithm
of the squared distance; all rows of the bin that reaches the share belong to the subset.

Cells with fewer than ``MIN_ROWS`` rows that pass the fixed rules are judged by the estimates of their language, and languages
with fewer by those of all rows.

Defined cases: null text holds no words and fails the fixed rules; null language or source counts as the empty string; repeated
rows are judged each and count each; ids may be null or repeated; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from transitloom.session import cut, load, store_counted

SUPPORT = 0.75
MIN_ROWS = 100
FIRST_STEPS = 2
MAX_STEPS = 20
TOLERANCE = 1e-4
BINS = 32
#: Values are multiples of 1/GRID, so that sums of values and products are exact up to millions of rows.
GRID = 1024
#: Quantiles of the chi-squared distribution with five degrees of freedom at 0.5, 0.975 and 0.9999.
CHI_MEDIAN, CHI_REWEIGHT, CHI_REJECT = 4.35146, 12.83250, 25.74483
CELL = ["level", "k1", "k2"]
WINDOW = 8


@dataclass(frozen=True)
class Statistic:
    """A column expression over the counts and the error it is measured with."""

    name: str
    value: Column
    floor: float


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """doc_id, k1, k2, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row.

    Hashes of eight-word windows are built by doubling (1, 2, 4, 8 words) with ``zip_with``. Only texts in which a hash stands
    twice sort their windows; equal neighbours are then compared by their words.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), key(keys[0]).alias("k1"), key(keys[1]).alias("k2"), text.alias("t"))
    rows = rows.select("*", F.array_remove(F.split(F.regexp_replace("t", "[\t-\r]", " "), " "), "").alias("w"))
    rows = rows.select("*", F.size("w").alias("n"), F.transform("w", lambda v: F.xxhash64(v)).alias("h"))
    span = 1
    while span < WINDOW:
        ahead = F.slice("h", F.lit(span + 1), F.greatest(F.col("n") - span, F.lit(0)))
        rows = rows.withColumn("h", F.zip_with("h", ahead, lambda a, b: F.xxhash64(a, b)))
        span *= 2
    rows = rows.withColumn("h", F.slice("h", F.lit(1), F.greatest(F.col("n") - (WINDOW - 1), F.lit(0))))
    placed = F.array_sort(F.transform("h", lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), placed)).drop("h")

    def equal(e: Column, k: Column) -> Column:
        other = F.get(F.col("s"), k)
        words = reduce(lambda a, b: a & b, [F.get(F.col("w"), e["i"] + j) == F.get(F.col("w"), other["i"] + j) for j in range(WINDOW)])
        return F.coalesce((e["h"] == other["h"]) & words, F.lit(False))

    twice = F.filter(F.transform("s", lambda e, k: F.struct(e["i"].alias("i"), (equal(e, k - 1) | equal(e, k + 1)).alias("r"))), lambda e: e["r"])
    rows = rows.withColumn("p", F.array_sort(F.transform(twice, lambda e: e["i"])))
    widths = F.transform("p", lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("p"), k + 1) - v, F.lit(WINDOW))).cast("bigint"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^ \t-\r]"))
    return rows.select(
        "doc_id", "k1", "k2", F.col("n").cast("bigint").alias("n_words"), F.length(F.regexp_replace("t", "[ \t-\r]+", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.aggregate(widths, F.lit(0).cast("bigint"), lambda a, b: a + b), F.lit(0).cast("bigint")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def statistics() -> list[Statistic]:
    """The vector: word length, symbol share and length by logarithm, repeated lines by logarithm, repetition by square root."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [
        Statistic("word_length", F.log(chars / words), 0.05),
        Statistic("symbols", F.log1p(100 * F.col("n_symbols") / chars), 0.1),
        Statistic("dup_lines", F.log1p(F.col("n_dup_lines")), 0.35),
        Statistic("repetition", F.sqrt(F.col("n_repeat_words") / words), 0.2),
        Statistic("length", F.log(words), 0.25),
    ]


def _names(p: int) -> tuple[list[str], list[tuple[int, int]]]:
    return [f"x{i}" for i in range(p)], [(i, j) for i in range(p) for j in range(i + 1)]


def _sums(p: int, when: Column | None = None, prefix: str = "") -> list[Column]:
    """Count, sums and sums of products of the vectors (of those where ``when`` holds)."""
    names, pairs = _names(p)
    only = (lambda c: c) if when is None else (lambda c: F.when(when, c))
    first = F.count(F.lit(1)) if when is None else F.count_if(when)
    return [
        first.alias(f"{prefix}n"), *[F.sum(only(F.col(x))).alias(f"{prefix}s{i}") for i, x in enumerate(names)],
        *[F.sum(only(F.col(names[i]) * F.col(names[j]))).alias(f"{prefix}q{i}{j}") for i, j in pairs],
    ]


def _factor(cov: DataFrame, keep: list[str], p: int) -> DataFrame:
    """``keep``, m0.., the Cholesky factor l00, l10, l11, ... and the log determinant, from m and c columns."""
    steps = []
    for j in range(p):
        for i in range(j, p):
            rest = " - ".join([f"c{i}{j}", *[f"l{i}{k} * l{j}{k}" for k in range(j)]])
            steps.append(f"sqrt(greatest({rest}, 1e-12D)) AS l{i}{j}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    logdet = " + ".join(f"2 * ln(l{i}{i})" for i in range(p))
    # Later expressions name earlier ones of the same list.
    return cov.selectExpr(*keep, *[f"m{i}" for i in range(p)], *steps, f"{logdet} AS logdet")


def _estimates(sums: DataFrame, keep: list[str], floors: list[float]) -> DataFrame:
    """Centre and factor from sums; the square of each floor is added to its variance."""
    p = len(floors)
    means = [f"s{i} / n AS m{i}" for i in range(p)]
    parts = [
        f"greatest(q{i}{j} / n - m{i} * m{j}, 0D) + {floors[i] ** 2!r}D AS c{i}{j}" if i == j else f"q{i}{j} / n - m{i} * m{j} AS c{i}{j}" for i, j in _names(p)[1]
    ]
    return _factor(sums.where("n > 0").selectExpr(*keep, *means, *parts), keep, p)


def _distance(rows: DataFrame, p: int) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance, by forward substitution."""
    steps = [f"({' - '.join([f'x{i}', f'm{i}', *[f'l{i}{k} * z{k}' for k in range(i)]])}) / l{i}{i} AS z{i}" for i in range(p)]
    return rows.selectExpr("*", *steps, " + ".join(f"z{i} * z{i}" for i in range(p)) + " AS d2").drop(*[f"z{i}" for i in range(p)])


def _bin() -> Column:
    return F.floor(BINS * F.log(F.greatest(F.col("d2"), F.lit(1e-12)))).cast("int")


def _up_to(parts: DataFrame, keys: list[str], at: str, share: float) -> DataFrame:
    """Adds ``total`` and ``before`` (rows in smaller bins) and whether the bin is needed to reach the share."""
    w = Window.partitionBy(*keys)
    out = parts.withColumn("total", F.sum("n").over(w)).withColumn("before", F.sum("n").over(w.orderBy(at)) - F.col("n"))
    return out.withColumn("inside", F.col("before") < F.ceil(F.col("total") * share))


def _medians(members: DataFrame, p: int) -> DataFrame:
    """CELL, med0.., mad0..: median and median deviation of every statistic, from counts per grid value."""
    each = members.select(*CELL, F.posexplode(F.array(*[F.round(F.col(f"x{i}") * BINS).cast("int") for i in range(p)])).alias("dim", "v"))
    counts = each.groupBy(*CELL, "dim", "v").agg(F.count(F.lit(1)).alias("n"))
    keys = [*CELL, "dim"]
    middle = _up_to(counts, keys, "v", 0.5).where("inside").groupBy(*keys).agg(F.max("v").alias("med"))
    away = counts.join(middle, keys).groupBy(*keys, "med", F.abs(F.col("v") - F.col("med")).alias("a")).agg(F.sum("n").alias("n"))
    spread = _up_to(away, keys, "a", 0.5).where("inside").groupBy(*keys, "med").agg(F.max("a").alias("mad"))
    return spread.groupBy(*CELL).agg(
        *[F.max(F.when(F.col("dim") == i, F.col("med") / BINS)).alias(f"med{i}") for i in range(p)],
        *[F.max(F.when(F.col("dim") == i, 1.4826 * F.col("mad") / BINS)).alias(f"mad{i}") for i in range(p)],
    )


def _starts(members: DataFrame, floors: list[float]) -> DataFrame:
    p = len(floors)
    medians = cut(_medians(members, p))
    near = reduce(lambda a, b: a & b, [F.abs(F.col(f"x{i}") - F.col(f"med{i}")) <= 2.5 * (F.col(f"mad{i}") + floors[i]) for i in range(p)])
    sums = cut(members.join(medians, CELL).groupBy(*CELL).agg(*_sums(p), *_sums(p, near, "near_")))
    fields = [c for c in sums.columns if c not in CELL and not c.startswith("near_")]
    classical = _estimates(sums.withColumn("start", F.lit(0)), [*CELL, "start"], floors)
    trimmed = _estimates(sums.select(*CELL, F.lit(2).alias("start"), *[F.col(f"near_{c}").alias(c) for c in fields]), [*CELL, "start"], floors)
    own = [f"mad{i} * mad{i} + {floors[i] ** 2!r}D AS c{i}{j}" if i == j else f"0D AS c{i}{j}" for i, j in _names(p)[1]]
    diagonal = medians.selectExpr(*CELL, "1 AS start", *[f"med{i} AS m{i}" for i in range(p)], *own)
    return classical.unionByName(_factor(diagonal, [*CELL, "start"], p)).unionByName(trimmed)


def robust_estimates(members: DataFrame, floors: list[float], support: float = SUPPORT) -> DataFrame:
    """CELL, centre, Cholesky factor and ``scale`` of every cell. ``members``: CELL and x0..; a row may belong to several cells."""
    p = len(floors)
    keys = [*CELL, "start"]

    def placed(estimates: DataFrame) -> DataFrame:
        return _distance(members.join(estimates, CELL), p).withColumn("bin", _bin())

    def reached(estimates: DataFrame, by: list[str], share: float) -> DataFrame:
        """The last bin that the share needs."""
        counts = placed(estimates).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
        return _up_to(counts, by, "bin", share).where("inside").groupBy(*by).agg(F.max("bin").alias("last"))

    def refined(estimates: DataFrame, limit: DataFrame, by: list[str]) -> DataFrame:
        near = placed(estimates.join(limit, by)).where(F.col("bin") <= F.col("last"))
        return _estimates(near.groupBy(*by).agg(*_sums(p)), by, floors)

    now = cut(_starts(members, floors))
    for _ in range(FIRST_STEPS):
        now = cut(refined(now, cut(reached(now, keys, support)), keys))
    rest = [c for c in now.columns if c not in keys]
    now = cut(now.groupBy(*CELL).agg(F.min_by(F.struct(*rest), F.struct(F.round("logdet", 9), "start")).alias("e")).select(*CELL, "e.*"))
    for _ in range(MAX_STEPS):
        better = refined(now, cut(reached(now, CELL, support)), CELL)
        pair = now.select(*CELL, F.struct(*rest).alias("old")).join(better.select(*CELL, F.struct(*rest).alias("new")), CELL)
        falls = F.col("new.logdet") < F.col("old.logdet") - TOLERANCE
        joined = pair.select(*CELL, F.when(falls, F.col("new")).otherwise(F.col("old")).alias("e"), falls.alias("falls"))
        path, moving = store_counted(joined, F.col("falls"))
        now = load(members.sparkSession, joined.schema, path).select(*CELL, "e.*")
        if not moving:
            break

    def scale(estimates: DataFrame) -> DataFrame:
        """How far the median of the squared distance lies above the expected one, 1 at least."""
        middle = reached(estimates, CELL, 0.5)
        return middle.select(*CELL, F.greatest(F.lit(1.0), F.exp((F.col("last") + 1) / BINS) / CHI_MEDIAN).alias("scale"))

    limit = cut(scale(now).select(*CELL, F.floor(BINS * F.log(F.col("scale") * CHI_REWEIGHT)).cast("int").alias("last")))
    final = cut(refined(now, limit, CELL))
    return cut(final.join(scale(final), CELL))


def _cells(pairs: DataFrame, min_rows: int) -> DataFrame:
    """k1, k2, own (the cell that judges them) and members (the cells they help to estimate)."""
    cell = lambda level, a, b: F.struct(F.lit(level).alias("level"), a.alias("k1"), b.alias("k2"))
    none = F.lit("")
    langs = pairs.groupBy("k1").agg(F.sum("n").alias("lang_n"), F.min("n").alias("least"))
    langs = langs.withColumn("lang_small", F.col("lang_n") < min_rows).withColumn("lang_used", ~F.col("lang_small") & (F.col("least") < min_rows))
    world = langs.agg(F.coalesce(F.max("lang_small"), F.lit(False)).alias("world_used")).withColumn("one", F.lit(1))
    own = F.when(F.col("n") >= min_rows, cell(2, F.col("k1"), F.col("k2"))).when(~F.col("lang_small"), cell(1, F.col("k1"), none)).otherwise(cell(0, none, none))
    joined = pairs.join(langs, "k1").withColumn("one", F.lit(1)).join(world, "one")
    members = F.array_compact(F.array(
        F.when(F.col("n") >= min_rows, cell(2, F.col("k1"), F.col("k2"))), F.when(F.col("lang_used"), cell(1, F.col("k1"), none)), F.when(F.col("world_used"), cell(0, none, none)),
    ))
    return joined.select("k1", "k2", own.alias("own"), members.alias("members"))


def outlier_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, str] = ("lang", "source"), min_rows: int = MIN_ROWS,
                  support: float = SUPPORT, reject: float = CHI_REJECT) -> DataFrame:
    """The counts of every row with base_failed, distance (null where base_failed), the level of the cell used, and kept."""
    vector = statistics()
    p, floors = len(vector), [s.floor for s in vector]
    on_grid = [F.when(~base_failed(), F.round(s.value * GRID) / GRID).alias(f"x{i}") for i, s in enumerate(vector)]
    rows = cut(text_counts(docs, id_col, text_col, keys).select("*", base_failed().alias("base_failed"), *on_grid))
    judged = rows.where("NOT base_failed")
    cells = cut(_cells(judged.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")), min_rows))
    members = judged.join(cells, ["k1", "k2"]).select(F.explode("members").alias("c"), *[f"x{i}" for i in range(p)])
    found = robust_estimates(cut(members.select("c.*", *[f"x{i}" for i in range(p)])), floors, support)
    used = cells.select("k1", "k2", "own.level", F.col("own.k1").alias("c1"), F.col("own.k2").alias("c2"))
    named = found.select(F.col("level"), F.col("k1").alias("c1"), F.col("k2").alias("c2"), *[c for c in found.columns if c not in CELL])
    judges = used.join(named, ["level", "c1", "c2"]).drop("c1", "c2")
    out = _distance(rows.join(judges, ["k1", "k2"], "left"), p)
    distance = F.when(~F.col("base_failed"), F.sqrt(F.col("d2") / F.col("scale")))
    return out.select(
        "doc_id", F.col("k1").alias(keys[0]), F.col("k2").alias(keys[1]), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        distance.alias("distance"), F.when(~F.col("base_failed"), F.col("level")).alias("level"),
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= F.col("scale") * reject, F.lit(False))).alias("kept"),
    )


def rules_report(docs: DataFrame) -> DataFrame:
    return outlier_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
