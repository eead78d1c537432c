"""Column expressions: service time, density classes, ids, names and display text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from transitloom import constants as C


def round_scaled(value: Column, digits: int) -> Column:
    """Rounds the scaled double half away from zero; ``round`` looks at the decimal digits of the unscaled one instead."""
    return F.round(value * float(10**digits)) / float(10**digits)


def service_seconds(text: Column) -> Column:
    """``HH:MM:SS`` to seconds after midnight (hours may pass 24); null when malformed."""
    parts = F.split(F.trim(text), ":")

    def number(i: int) -> Column:
        return F.get(parts, F.lit(i)).try_cast("int")

    return F.when(F.size(parts) == 3, number(0) * 3600 + number(1) * 60 + number(2))


def service_text(seconds: Column) -> Column:
    """Seconds to ``HH:MM:SS`` on the 24 h clock."""
    s = F.pmod(seconds.cast("bigint"), F.lit(86400))

    def two(c: Column) -> Column:
        return F.lpad(c.cast("string"), 2, "0")

    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s / 60) % 60), two(s % 60))


def normal_id(value: Column) -> Column:
    """Trim, drop a trailing ``.0``, null becomes the empty string."""
    return F.coalesce(F.regexp_replace(F.trim(value.cast("string")), r"\.0$", ""), F.lit(""))


def natural_order(value: Column) -> list[Column]:
    """Sort keys that put numeric ids first, by number, and the rest by text."""
    number = value.try_cast("int")
    return [number.isNull().asc(), number.asc(), value.asc()]


def clamp_load(load: Column, cap: float = C.LOAD_CAP) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.least(load, F.lit(cap))), F.lit(C.DENSITY_FALLBACK))


# Class names are fixed output values.
DENSITY_CLASSES = ["sepi", "sedang", "padat", "sangat_padat"]


def density_rank(load: Column) -> Column:
    return F.when(load < 0.5, 0).when(load < 0.8, 1).when(load < 1.0, 2).otherwise(3)


def density_class(load: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in DENSITY_CLASSES]), density_rank(load) + 1)


def density_label(load: Column, low: float = 0.5, high: float = 0.8) -> Column:
    return F.when(load < low, "Sepi").when(load < high, "Sedang").otherwise("Padat")


def _band(seconds: Column, field: int) -> Column:
    second = F.pmod(seconds.cast("bigint"), F.lit(86400))
    picked = None
    for band in C.TIME_BANDS[:-1]:
        inside = (second >= band[1]) & (second < band[2])
        picked = F.when(inside, band[field]) if picked is None else picked.when(inside, band[field])
    return picked.otherwise(C.TIME_BANDS[-1][field])


def band_name(seconds: Column) -> Column:
    return _band(seconds, 0)


def band_weight(seconds: Column) -> Column:
    return _band(seconds, 3)


def day_type(date: Column) -> Column:
    return F.when(F.weekday(date) >= 5, "weekend").otherwise("weekday")


def squeeze(text: Column) -> Column:
    """Lower case with runs of white space made single."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def platform_name(text: Column) -> Column:
    """Stop name without one trailing direction suffix."""
    return F.regexp_replace(squeeze(text), r" arah (utara|selatan|barat|timur)$", "")


def is_numbered(text: Column) -> Column:
    return F.trim(text).rlike(r"(^|\s)\d+$")


def base_name(text: Column) -> Column:
    """Name without a last all-digit word, spaces made single."""
    single = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.regexp_replace(single, r"(^| )\d+$", "")



def minutes(seconds: Column) -> Column:
    """Whole minutes, ties to even."""
    return F.bround(seconds / 60.0, 0).cast("int")


def rupiah(amount: Column) -> Column:
    return F.concat(F.lit("Rp"), F.translate(F.format_number(F.round(amount), 0), ",", "."))


def clock_text(seconds: Column) -> Column:
    m = F.floor(seconds / 60) % 1440
    return F.concat(
        F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit("."), F.lpad((m % 60).cast("string"), 2, "0")
    )


def kilometres(meters: Column) -> Column:
    tenths = F.floor(meters / 100.0 + 0.5) / 10.0
    return F.concat(F.format_string("%.1f", tenths), F.lit(" km"))


def anchored_clock(anchor: Column, elapsed_secs: Column, speed: Column, playing: Column) -> Column:
    """Service clock that runs ``speed`` times as fast and wraps in 05:00..23:00."""
    start, end = 18000, 82800
    inside = F.least(F.greatest(anchor, F.lit(start)), F.lit(end)) - start
    moved = F.floor(elapsed_secs * speed).cast("bigint")
    return F.when(~playing, anchor.cast("bigint")).otherwise(start + F.pmod(inside + moved, F.lit(end - start)))
