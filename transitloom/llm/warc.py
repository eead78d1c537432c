"""WARC archives: writing records, finding record borders, reading them back.

Writing uses the text sink: a row is a record and the sink's line separator is the blank lines that end a record, so files are
plain (gzip-compressed) WARC files of a bounded number of records.

Reading splits files at every ``WARC/1.0`` line start, true or not, as payloads may hold that text too. Each candidate names its
successor (its own offset plus header and Content-Length). Pointer jumping from the start of each file keeps the candidates that
the chain reaches: in round k the reached set doubles and pointers double their reach, so a file of n records takes about log2(n)
rounds. Only offsets take part; payload bytes are digested where they are read. A record whose payload holds the magic text is
spread over several candidates; only those are brought together again.

Defined cases: null payloads count as empty; payloads under ``REVISIT_BYTES`` are never referred to; of equal payloads the
largest id is the response (a null id is smaller than any); rows that repeat id and payload are
all responses or all revisits; an empty table gives no records.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from transitloom.llm.bloom import Bloom
from transitloom.llm.groups import with_totals
from transitloom.session import cut, load, step_folder, store_counted

REVISIT_BYTES = 1000
RECORDS_PER_FILE = 1 << 14
_MAGIC = "WARC/1.0\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One column ``record`` with a whole WARC record (without the blank lines at its end) per row.

    Only id, size and digest of large payloads are shuffled to find copies; then rows whose digest cannot be shared pass straight
    through, the others meet the id that answers for them.
    """
    rows = pages.select(F.col(id_col).alias("number"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    keys = rows.where(F.col("size") >= REVISIT_BYTES).select("number", "digest")
    shared = with_totals(keys, ["digest"], F.col("number"), {"_m": F.max("number"), "_c": F.count(F.lit(1))}, {"response": F.max("_m"), "n": F.sum("_c")}).where("n > 1")
    shared = shared.select(F.col("number").alias("_n"), F.col("digest").alias("_d"), "response").distinct()
    path, count = store_counted(shared)
    shared = load(pages.sparkSession, shared.schema, path)
    maybe = Bloom(shared.select(F.xxhash64("_d")), count).test(F.xxhash64("digest"))
    rows = rows.withColumn("_maybe", maybe)
    alone = rows.where(~F.col("_maybe")).drop("_maybe").withColumn("response", F.lit(None).cast(shared.schema["response"].dataType))
    met = rows.where("_maybe").drop("_maybe").join(shared, F.col("number").eqNullSafe(F.col("_n")) & (F.col("digest") == F.col("_d")), "left").drop("_n", "_d")
    return alone.union(met).select(_record().alias("record"))


def _record() -> Column:
    revisit = F.col("response").isNotNull() & ~F.col("number").eqNullSafe(F.col("response"))
    block = F.when(revisit, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), F.col("payload")))
    none = F.lit("")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    header = F.concat(
        F.lit(_MAGIC), _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.when(F.col("number").isNotNull(), _line("WARC-Record-ID", urn("number"))).otherwise(none),
        _line("WARC-Date", "1970-01-01T00:00:00Z"), _line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Profile", _PROFILE), _line("WARC-Refers-To", urn("response")), _line("WARC-Payload-Length", F.col("size").cast("string")))).otherwise(none),
        _line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.concat(header, F.lit("\r\n"), block)


def write_archives(recs: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    recs.select("record").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """What stands between places of the magic text: file, block and row (their order), value."""
    lines = spark.read.option("lineSep", _MAGIC).text(path)
    return lines.select(F.xxhash64(F.input_file_name()).alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("row"), "value")


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def parsed(df: DataFrame, keep: list[str]) -> DataFrame:
    """Header fields of ``value`` and, where it is one whole record, size and digest of the payload."""
    head = F.when(F.instr("value", "\r\n\r\n") > 0, F.substring_index("value", "\r\n\r\n", 1))
    df = df.select(*keep, "value", head.alias("head"), F.octet_length("value").cast("long").alias("size"))
    df = df.withColumn("body_at", F.octet_length("head").cast("long") + 4).withColumn("length", _field("Content-Length").try_cast("long"))
    whole = F.coalesce((F.col("length") >= 0) & (F.col("size") == F.col("body_at") + F.col("length") + 4), F.lit(False))
    body = F.substring(F.col("value").cast("binary"), (F.col("body_at") + 1).cast("int"), F.col("length").cast("int"))
    http = F.octet_length(F.substring_index(body.cast("string"), "\r\n\r\n", 1)).cast("int") + 4
    payload = F.substring(body, http + 1, F.greatest(F.col("length").cast("int") - http, F.lit(0)))
    urn = lambda name: F.nullif(F.regexp_extract(_field(name), "<urn:page:(.*)>", 1), F.lit(""))
    return df.select(
        *keep, "size", "body_at", "length", whole.alias("whole"), _field("WARC-Type").alias("type"), urn("WARC-Record-ID").alias("id"), urn("WARC-Refers-To").alias("refers"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "sha1:(.*)", 1).alias("stated_digest"), _field("WARC-Payload-Length").try_cast("long").alias("stated_bytes"),
        F.when(whole, F.octet_length(payload).cast("long")).alias("bytes"), F.when(whole, F.sha1(payload)).alias("digest"),
    )


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place of the magic text with its offset and that of its successor (null where no header follows)."""
    found = cut(parsed(segments(spark, path), ["file", "block", "row"]))
    long = F.col("size") + len(_MAGIC)
    sizes = found.groupBy("file", "block").agg(F.sum(long).alias("_s"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("file", "block", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_before"))
    local = F.coalesce(F.sum(long).over(Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = found.withColumn("_local", local).join(sizes, ["file", "block"]).withColumn("offset", F.col("_before") + F.col("_local") - len(_MAGIC)).drop("_before", "_local")
    after = F.col("offset") + len(_MAGIC) + F.col("body_at") + F.col("length") + 4
    return cut(placed.where("offset >= 0").withColumn("next", F.when(F.col("length") >= 0, after)))


def reached(found: DataFrame) -> DataFrame:
    """(file, offset) of the candidates on the chain from the start of their file."""
    spark = found.sparkSession
    jump = found.where("next IS NOT NULL").select("file", "offset", "next")
    parts = [cut(found.where("offset = 0").select("file", "offset"))]
    while True:
        so_far = parts[0]
        for p in parts[1:]:
            so_far = so_far.union(p)
        new = so_far.join(jump, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        path, count = store_counted(new)
        if not count:
            break
        parts.append(load(spark, new.schema, path))
        far = jump.select("file", F.col("offset").alias("next"), F.col("next").alias("_far"))
        jump = cut(jump.join(far, ["file", "next"]).select("file", "offset", F.col("_far").alias("next")))
    return found.select("file", "offset").join(so_far, ["file", "offset"], "left_semi")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: id, type, refers, bytes, digest of the payload, and stated_digest, stated_bytes from its header."""
    found = candidates(spark, path)
    real = cut(found.join(reached(found), ["file", "offset"], "left_semi"))
    columns = ["id", "type", "refers", "bytes", "digest", "stated_digest", "stated_bytes"]
    split = real.where("NOT whole").select("file", F.col("offset").alias("begin"), "next")
    inside = found.select("file", "block", "row", "offset").join(split, "file").where("offset >= begin AND offset < next").select("file", "block", "row", "offset", "begin")
    stored, count = store_counted(inside)
    whole = real.where("whole").select(*columns)
    if not count:
        return whole
    # Payloads that hold the magic text: their segments, and no others, are read again and joined.
    inside = load(spark, inside.schema, stored)
    wanted = Bloom(inside.select(F.xxhash64("file", "row")), count)
    again = segments(spark, path).where(wanted.test(F.xxhash64("file", "row"))).join(inside, ["file", "block", "row"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"])
    joined = again.groupBy("file", "begin").agg(F.array_join(ordered, _MAGIC).alias("value"))
    return whole.union(parsed(joined, []).select(*columns))


def archive_report(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = f"{step_folder(spark)}/{uuid.uuid4().hex}.warc"
    write_archives(records(pages), path)
    read = read_archives(spark, path)
    kind = pages.schema["page_id"].dataType
    revisit = F.col("type") == "revisit"
    return read.select(
        F.col("id").cast(kind).alias("page_id"), F.when(revisit, F.col("stated_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest")).alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers").cast(kind).alias("refers_to"),
    )
