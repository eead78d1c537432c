"""Live readings, relay states, message checks, latency and power statistics, chunk reassembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from transitloom import constants as C
from transitloom.operators.ordered import exact_quantiles, number_rows, previous_row, trailing_rows
from transitloom.sources.sinks import newest_per_key

HOUR_MS = 3600000


def tolerant_timestamp(text: Column) -> Column:
    """ISO-8601 text with 1..9 fraction digits; ``Z`` and no zone both mean UTC. Null when malformed."""
    trimmed = F.regexp_replace(F.trim(text), "Z$", "+00:00")
    zone = F.regexp_extract(trimmed, r"([+-]\d{2}:?\d{2})$", 1)
    body = F.regexp_replace(F.regexp_replace(trimmed, r"([+-]\d{2}:?\d{2})$", ""), "T", " ")
    whole = F.regexp_replace(body, r"\.\d+$", "")
    fraction = F.rpad(F.substring(F.regexp_extract(body, r"\.(\d+)$", 1), 1, 6), 6, "0")
    return F.try_to_timestamp(F.concat(whole, F.lit("."), fraction, F.when(zone == "", "+00:00").otherwise(zone)), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSSxxx"))


def freshness(keys: DataFrame, readings: DataFrame, key: str, now_ms: int | Column, ttl_ms: int) -> DataFrame:
    """Newest reading per known key with outcome unknown, stale or ok; stale readings show no value."""
    newest = newest_per_key(readings, [key], ["ms", "event_id"])
    joined = keys.select(key).distinct().join(newest, key, "left")
    age = now_ms - F.col("ms") if isinstance(now_ms, Column) else F.lit(now_ms) - F.col("ms")
    outcome = F.when(F.col("ms").isNull(), "unknown").when(age > ttl_ms, "stale").otherwise("ok")
    return joined.withColumn("outcome", outcome).withColumn("shown", F.when(F.col("outcome") == "ok", F.greatest(F.col("passengers"), F.lit(0))))


def relay_status(relays: DataFrame, reports: DataFrame, now_ms: int | Column, stale_ms: int) -> DataFrame:
    """State per relay: connecting without reports, disconnected when all are stale, connected when any
    fresh report says so, else the most recent fresh report."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    fresh = F.col("ms") >= now - stale_ms
    per = reports.groupBy("relay").agg(
        F.count_if(fresh).alias("fresh"), F.count_if(fresh & (F.col("status") == "tersambung")).alias("up"),
        F.max_by("status", F.when(fresh, F.struct("ms", "event_id"))).alias("last"),
    )
    state = F.when(F.col("fresh").isNull(), "menyambung").when(F.col("fresh") == 0, "terputus").when(F.col("up") > 0, "tersambung").otherwise(F.col("last"))
    return relays.select("relay").distinct().join(per, "relay", "left").select("relay", state.alias("state"))


# ---- camera and power messages -----------------------------------------------------------------


def decode_image(text: Column) -> Column:
    """Bytes of a Base64 image, with or without a data-URI head; null when not Base64."""
    return F.try_to_binary(F.regexp_replace(text, r"^data:[^,]*,", ""), F.lit("base64"))


def is_jpeg(blob: Column) -> Column:
    marker = lambda start, length: F.hex(F.substring(blob, start, length))
    size = F.octet_length(blob)
    return (size >= 4) & (marker(1, 2) == "FFD8") & (F.hex(F.substr(blob, size - 1, F.lit(2))) == "FFD9")


def latency_rows(messages: DataFrame) -> DataFrame:
    """Status and latencies of camera messages (received_ms, payload, retain, offset_ms).

    Rules apply in order; the first that fails names the status. Latencies stay null where they
    cannot be known, negative ones are kept but flagged.
    """
    parsed = F.from_json("payload", "timestamp STRING, image STRING")
    rows = messages.withColumn("_j", F.when(F.col("payload").rlike(r"^\s*\{"), parsed))
    stamp = F.col("_j.timestamp").try_cast("bigint")
    valid_stamp = (stamp >= C.EPOCH_MS_MIN) & (stamp < C.EPOCH_MS_MAX)
    rows = rows.withColumn("device_ms", F.when(valid_stamp, stamp))
    # A data URI is not Base64 and thus an invalid image here.
    blob = F.try_to_binary(F.col("_j.image"), F.lit("base64"))
    raw = F.col("received_ms") - F.col("device_ms")
    corrected = raw + F.col("offset_ms")
    status = (
        F.when(F.col("_j").isNull(), "invalid_payload").when(F.col("device_ms").isNull(), "invalid_timestamp")
        .when(blob.isNull() | ~is_jpeg(blob), "invalid_image").when(F.col("retain"), "retained").when(F.col("offset_ms").isNull(), "ntp_unavailable")
        .when(corrected < 0, "clock_ahead").otherwise("ok")
    )
    out = rows.withColumn("latency_raw_ms", raw).withColumn("latency_corrected_ms", corrected).withColumn("status", status)
    counted = F.col("status").isin("ok", "ntp_unavailable", "clock_ahead") & F.when(F.col("offset_ms").isNotNull(), corrected >= 0).otherwise(raw >= 0)
    return out.withColumn("raw_counts", F.coalesce(counted, F.lit(False))).withColumn("valid", F.col("status") == "ok").drop("_j", "_img")


def measure_stats(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """n, mean, median, p95, min and max of several measures per key; medians and p95 are exact.

    The measures are stacked so that one pass serves all of them.
    """
    stacked = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), v.cast("double").alias("v")) for n, v in values.items()])).alias("m")).select(*keys, "m.*")
    stacked = stacked.filter("v IS NOT NULL")
    by = [*keys, "measure"]
    plain = stacked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    return plain.join(exact_quantiles(stacked, by, "v", {"median": 0.5, "p95": 0.95}), by)


def power_fields(messages: DataFrame) -> DataFrame:
    """Voltage (V), current (mA) and power (mW) from current or legacy field names and units."""
    names = ["voltage_v", "voltage", "current_ma", "current_a", "power_mw", "power_w"]
    parsed = F.from_json("payload", ", ".join(f"{n} DOUBLE" for n in names))
    rows = messages.withColumn("_j", parsed)
    return rows.select(
        *messages.columns, F.coalesce("_j.voltage_v", "_j.voltage").alias("voltage_v"), F.coalesce(F.col("_j.current_ma"), F.col("_j.current_a") * 1000).alias("current_ma"),
        F.coalesce(F.col("_j.power_mw"), F.col("_j.power_w") * 1000).alias("power_mw"),
    )


def inter_arrival(df: DataFrame, keys: list[str], ms: str = "received_ms", tie: str = "event_id") -> DataFrame:
    """Time since the previous message of the key."""
    hourly = df.withColumn("_hour", F.floor(F.col(ms) / HOUR_MS))
    linked = previous_row(hourly, keys, [ms, tie], "_hour", [ms])
    return linked.withColumn("inter_arrival_ms", F.col(ms) - F.col(f"prev.{ms}")).drop("prev", "_hour")


def clock_offsets(samples: DataFrame, session: str, tie: str) -> DataFrame:
    """Best clock sample per session: smallest round trip among valid four-timestamp exchanges."""
    delay = (F.col("t4") - F.col("t1")) - (F.col("t3") - F.col("t2"))
    offset = ((F.col("t2") - F.col("t1")) + (F.col("t3") - F.col("t4"))) / 2
    valid = samples.withColumn("rtt", F.greatest(F.lit(0.0), delay.cast("double"))).withColumn("offset", offset).filter((F.col("t3") >= F.col("t2")) & (delay >= -0.001))
    best = valid.groupBy(session).agg(F.min(F.struct("rtt", tie, "offset")).alias("b"), F.count(F.lit(1)).alias("samples"))
    return best.select(session, "b.offset", "b.rtt", "samples")


# ---- order-dependent smoothing -----------------------------------------------------------------


def smoothed_counts(readings: DataFrame, key: str, median_rows: int = 5, mean_rows: int = 10) -> DataFrame:
    """Rolling median (rounded half to even) and moving mean per vehicle; the mean only on every n-th row."""
    hourly = readings.withColumn("_hour", F.floor(F.col("ms") / HOUR_MS))
    numbered = number_rows(hourly, [key], ["ms", "event_id"], "_hour").drop("_hour")
    # Both windows share one frame length, so shorter windows look at the tail of the same rows.
    rows = trailing_rows(numbered, [key], "idx", mean_rows - 1, {"_last": F.collect_list("passengers")})
    tail = F.slice("_last", -F.least(F.size("_last"), F.lit(median_rows)), median_rows)
    ordered = F.sort_array(tail)
    n = F.size(ordered)
    median = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    mean = F.aggregate("_last", F.lit(0.0), lambda a, x: a + x) / F.size("_last")
    return rows.withColumn("median", F.bround(median, 0).cast("bigint")).withColumn(
        "moving_mean", F.when(F.col("idx") % mean_rows == 0, mean)
    ).drop("_last")


def throttled(readings: DataFrame, key: str, interval_ms: int) -> DataFrame:
    """Rows a throttled sender lets through: a row passes when ``interval_ms`` have gone by since the last that passed.

    Every row points to the first row at least one interval later. A row after a gap of one interval
    always passes and starts a run; from the run heads the pointers are followed by doubling, so the
    number of rounds is the logarithm of the longest run.
    """
    from transitloom.session import cut

    span = F.floor(F.col("ms") / interval_ms)
    rows = number_rows(readings.withColumn("_span", span), [key], ["ms", "event_id"], "_span").withColumnRenamed("_span", "span")
    rows = cut(rows)
    slim = rows.select(key, "idx", "ms", "span")
    # The successor lies in the next span or is the first row of a later non-empty span.
    firsts = slim.groupBy(key, "span").agg(F.min(F.struct("idx", "ms")).alias("f"))
    chain = Window.partitionBy(key).orderBy("span")
    firsts = firsts.withColumn("f1", F.lead("f").over(chain)).withColumn("s1", F.lead("span").over(chain)).withColumn("f2", F.lead("f", 2).over(chain))
    near = slim.select(key, F.col("span").alias("s1"), F.col("idx").alias("nidx"), F.col("ms").alias("nms"))
    placed = slim.join(firsts.select(key, "span", "s1", "f1", "f2"), [key, "span"])
    adjacent = placed.filter(F.col("s1") == F.col("span") + 1)
    inside = _first_later(adjacent, near, key, interval_ms)
    joined = placed.join(inside, [key, "idx"], "left")
    after = F.when(F.col("s1") == F.col("span") + 1, F.coalesce("in_next", "f2.idx")).otherwise(F.col("f1.idx"))
    nxt = joined.select(key, "idx", after.alias("jump"))
    gap = previous_row(rows, [key], ["ms", "event_id"], "span", ["ms"]).select(key, "idx", (F.col("ms") - F.col("prev.ms")).alias("gap"))
    reached = cut(gap.filter(F.col("gap").isNull() | (F.col("gap") >= interval_ms)).select(key, "idx"))
    jumps = cut(nxt.filter("jump IS NOT NULL"))
    while True:
        step = reached.join(jumps, [key, "idx"]).select(key, F.col("jump").alias("idx"))
        wider = cut(reached.union(step).distinct())
        if wider.count() == reached.count():
            break
        reached = wider
        onward = jumps.select(key, F.col("idx").alias("jump"), F.col("jump").alias("_to"))
        jumps = cut(jumps.join(onward, [key, "jump"]).select(key, "idx", F.col("_to").alias("jump")))
    return rows.join(reached, [key, "idx"], "left_semi").drop("span")


def _first_later(rows: DataFrame, near: DataFrame, key: str, interval_ms: int) -> DataFrame:
    """First row of the next span at least one interval after each row.

    Both sides are merged in time order inside (key, span), with each row placed at its due time, so a
    span is sorted once instead of meeting the next span pair by pair.
    """
    due = rows.select(key, F.col("s1").alias("s"), (F.col("ms") + interval_ms).alias("at"), F.lit(0).alias("kind"), "idx", F.lit(None).cast("bigint").alias("nidx"))
    seen = near.select(key, F.col("s1").alias("s"), F.col("nms").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("idx"), "nidx")
    w = Window.partitionBy(key, "s").orderBy("at", "kind", "nidx").rowsBetween(0, Window.unboundedFollowing)
    merged = due.unionByName(seen).withColumn("in_next", F.min("nidx").over(w))
    return merged.filter("kind = 0").select(key, "idx", "in_next")


def keep_last(readings: DataFrame, key: str, keep: int) -> DataFrame:
    """Flags the newest ``keep`` rows per key; only those are ever ranked."""
    w = Window.partitionBy(key).orderBy(F.desc("ms"), F.desc("event_id"))
    newest = readings.select(key, "ms", "event_id").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep)
    edge = newest.groupBy(key).agg(F.min(F.struct("ms", "event_id")).alias("_edge"))
    return readings.join(edge, key).withColumn("kept", F.struct("ms", "event_id") >= F.col("_edge")).drop("_edge")


# ---- chunks ---------------------------------------------------------------------------------------


def check_chunks(chunks: DataFrame, chunk_size: int = C.CHUNK_BYTES, max_bytes: int = C.MAX_IMAGE_BYTES) -> DataFrame:
    """Adds ``valid``: header arithmetic and body length of every chunk message agree."""
    expected = F.least(F.lit(chunk_size), F.col("total_len") - F.col("chunk_index") * chunk_size)
    ok = (
        (F.col("total_len") > 0) & (F.col("total_len") <= max_bytes) & (F.col("total_chunks") == F.ceil(F.col("total_len") / chunk_size))
        & (F.col("chunk_index") >= 0) & (F.col("chunk_index") < F.col("total_chunks")) & (F.length("body") == expected)
    )
    return chunks.withColumn("valid", ok)


def assemble_chunks(chunks: DataFrame) -> DataFrame:
    """One row per frame: status, counters and, for completed frames, the joined body.

    Copies of a chunk are reduced first (one row per frame, index and body), so a chunk that is sent
    very often costs one row. The header of the first valid chunk counts. A frame completes when all
    chunks are there before anything disagrees with it; a disagreement before that drops the frame.
    """
    checked = check_chunks(chunks)
    good = checked.filter("valid")
    header = F.struct("total_chunks", "total_len")
    kinds = good.groupBy("frame_id", "chunk_index", "body", header.alias("header")).agg(F.count(F.lit(1)).alias("copies"), F.min("seen").alias("seen"))
    # The first header needs no bodies: a small map-side combined aggregate next to the big shuffle.
    first = good.groupBy("frame_id").agg(F.min(F.struct("seen", "chunk_index", header.alias("header"))).alias("f")).select("frame_id", F.col("f.header").alias("first_header"))
    kinds = kinds.join(first, "frame_id")
    same = F.col("header") == F.col("first_header")
    per_chunk = kinds.groupBy("frame_id", "chunk_index", "first_header").agg(
        F.min(F.when(same, F.struct("seen", "body"))).alias("hit"), F.min(F.when(~same, F.col("seen"))).alias("header_break"),
        F.sum(F.when(same, F.col("copies")).otherwise(0)).alias("n"),
        F.collect_set(F.when(same, F.struct("seen", "body"))).alias("_bodies"),
    )
    conflict = F.array_min(F.transform(F.filter("_bodies", lambda b: b["body"] != F.col("hit.body")), lambda b: b["seen"]))
    per_chunk = per_chunk.withColumn("body_break", conflict)
    frames = per_chunk.groupBy("frame_id", "first_header").agg(
        F.count("hit").alias("present"), F.max("hit.seen").alias("done_at"), F.min(F.least("header_break", "body_break")).alias("broken_at"),
        F.sum(F.when(F.col("n") > 0, F.col("n") - 1).otherwise(0)).alias("duplicates"),
        F.sort_array(F.collect_list(F.when(F.col("hit").isNotNull(), F.struct("chunk_index", "hit.body")))).alias("_parts"),
    )
    whole = F.col("present") == F.col("first_header.total_chunks")
    empty = F.lit("").cast(chunks.schema["body"].dataType)  # bodies are bytes; text serves as well
    in_time = F.col("broken_at").isNull() | (F.col("done_at") < F.col("broken_at"))
    status = F.when(whole & in_time, "completed").when(F.col("broken_at").isNotNull(), "dropped").otherwise("expired")
    invalid = checked.filter("NOT valid").groupBy("frame_id").agg(F.count(F.lit(1)).alias("invalid"))
    out = frames.withColumn("status", status).withColumn(
        "body", F.when(F.col("status") == "completed", F.aggregate("_parts", empty, lambda whole, p: F.concat(whole, p["body"])))
    )
    joined = out.select("frame_id", "status", "present", F.col("first_header.total_chunks").alias("total_chunks"), "duplicates", "body").join(invalid, "frame_id", "full")
    return joined.fillna({"invalid": 0, "status": "invalid", "present": 0, "duplicates": 0})


# ---- detections ---------------------------------------------------------------------------------------


def box_verdict(width: int, height: int, min_area: float = C.BOX_MIN_AREA, max_area: float = C.BOX_MAX_AREA, min_aspect: float = C.BOX_MIN_ASPECT) -> Column:
    """``ok`` or the reason a detection box (w, h) is rejected in a frame of the given size."""
    area = F.col("w") * F.col("h") / float(width * height)
    return (
        F.when((F.col("w") <= 0) | (F.col("h") <= 0) | (F.col("h") / F.col("w") < min_aspect), "aspect").when(area < min_area, "low_area").when(area > max_area, "high_area").otherwise("ok")
    )


def box_counts(detections: DataFrame, width: int, height: int) -> DataFrame:
    """Raw, valid and rejected boxes per image."""
    judged = detections.withColumn("_v", box_verdict(width, height))
    return judged.groupBy("image").agg(
        F.count(F.lit(1)).alias("raw"), *[F.count_if(F.col("_v") == v).alias(n) for n, v in [("valid", "ok"), ("aspect_rejected", "aspect"), ("low_area_rejected", "low_area"), ("high_area_rejected", "high_area")]]
    )


def count_metrics(counts: DataFrame, truth: DataFrame) -> DataFrame:
    """Error, absolute error and accuracy of predicted counts.

    Images without any detection count as 0; images without ground truth are flagged.
    """
    return _judged(counts.join(truth, "image", "full").fillna({"predicted": 0}), counts.columns)


def _judged(joined: DataFrame, columns: list[str]) -> DataFrame:
    """The measures of rows that have both counts."""
    error = F.col("predicted") - F.col("actual")
    accuracy = F.when((F.col("actual") == 0) & (F.col("predicted") == 0), 100.0).when(F.col("actual") == 0, 0.0).otherwise((1 - F.abs(error) / F.col("actual")) * 100)
    return joined.select(
        *columns, "actual", error.alias("error"), F.abs(error).alias("abs_error"), accuracy.alias("accuracy"), F.greatest(F.lit(0.0), accuracy).alias("accuracy_bounded"),
        F.col("actual").isNull().alias("missing_truth"),
    )


def threshold_sweep(detections: DataFrame, truth: DataFrame, thresholds: list[float], sizes: list[int], width: int, height: int) -> DataFrame:
    """Accuracy summary of every (threshold, input size) configuration over all images.

    The valid boxes of an image become a histogram over the thresholds they pass (one map-side combined
    aggregate), and configurations are unfolded from it, so plan and code do not grow with the grid.
    Every image with ground truth takes part; one without detections counts as 0. Unfolded rows carry their true count and are summed where
    they are made: nothing of the grid is shuffled or sorted.
    """
    steps = F.array(*[F.lit(t) for t in sorted(thresholds)])
    passed = F.size(F.filter(steps, lambda t: F.col("conf") >= t))
    per_image = detections.filter(box_verdict(width, height) == "ok").groupBy("image", passed.alias("passed")).agg(F.count(F.lit(1)).alias("n"))
    per_image = per_image.groupBy("image").agg(F.collect_list(F.struct("passed", "n")).alias("_h"))
    grid = F.array(*[F.struct(F.lit(t).alias("conf"), F.lit(s).alias("imgsz"), F.lit(i).alias("at")) for i, t in enumerate(sorted(thresholds), 1) for s in sizes])
    counted = truth.select("image", "actual").join(per_image, "image", "left").select("image", "actual", "_h", F.explode(grid).alias("c"))
    predicted = F.aggregate(F.filter("_h", lambda x: x["passed"] >= F.col("c.at")), F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    rows = counted.select("image", "actual", "c.conf", "c.imgsz", F.coalesce(predicted, F.lit(0).cast("bigint")).alias("predicted"))
    rows = _judged(rows, ["image", "conf", "imgsz", "predicted"])
    return rows.groupBy("conf", "imgsz").agg(
        F.count(F.lit(1)).alias("images"), F.avg("abs_error").alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.avg(F.when(F.col("abs_error") == 0, 100.0).otherwise(0.0)).alias("exact_rate"), F.avg("accuracy").alias("mean_accuracy"),
        F.avg("accuracy_bounded").alias("mean_accuracy_bounded"),
    )


def quality_flags(blur: Column, brightness: Column, contrast: Column, low_blur: float = 30.0, dark: float = 25.0, bright: float = 245.0, flat: float = 10.0) -> Column:
    return F.array_join(
        F.array_compact(F.array(
            F.when(blur < low_blur, "blurry"), F.when(brightness < dark, "too_dark"), F.when(brightness > bright, "too_bright"), F.when(contrast < flat, "low_contrast")
        )), "|",
    )
