"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from transitloom.llm import (
    bpe, collocations, exact_dedup, filter_audit, neighbours, ngram_join, outliers, packing, quality, substring_dedup, token_counts, toxicity, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary of the contract; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def register(name: str, sql: str | None = None):
    def wrap(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap


@register(
    "op6_exact_dedup",
    f"""
    WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY norm)
    """,
)
def exact_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.dedup_report(table(spark, folder, "documents"))


@register(
    "op2_ngram_jaccard",
    f"""
    WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS words FROM documents),
    s AS (
      SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' ')) END) AS shingles FROM w),
    e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
    o AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS shared FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM o WHERE 100 * shared >= 85 * (nx + ny - shared)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x)
    SELECT s.doc_id, len(s.shingles) AS n_shingles, (SELECT min(b) FROM reach WHERE a = s.doc_id) AS component_id,
      min(s.doc_id) OVER (PARTITION BY CASE WHEN len(s.shingles) = 0 THEN [s.doc_id::VARCHAR] ELSE list_sort(s.shingles) END, len(s.shingles) = 0) AS class_id FROM s
    """,
)
def ngram_join_query(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.components_report(table(spark, folder, "documents"))


@register(
    "op5_substring_dedup",
    f"""
    WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
    k AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS i, words FROM w WHERE len(words) >= 50),
    h AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS win FROM k),
    c AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS low FROM h),
    g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM c WHERE low < doc_id),
    r AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
    SELECT doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
      sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i)), lambda i: words[i]) END, ' ')) AS kept_sha256
    FROM w LEFT JOIN r USING (doc_id)
    """,
)
def substring_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.removal_report(table(spark, folder, "documents"))


@register("op4_packing")
def packing_query(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packing_report(table(spark, folder, "documents"), tokenizer_path())


@register("op7_bpe_roundtrip")
def bpe_query(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.roundtrip_report(table(spark, folder, "documents"), tokenizer_path())


@register(
    "op9_warc",
    """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM m
    """,
)
def warc_query(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_report(table(spark, folder, "pages"))


@register("op3_hilbert_neighbours")
def neighbours_query(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.neighbour_report(table(spark, folder, "embeddings"))


@register("op1_weak_label_quality")
def quality_query(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(table(spark, folder, "documents"))


@register("op8_token_rollups")
def rollup_query(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.rollup_report(table(spark, folder, "documents"), tokenizer_path())


@register("op10_compression_toxicity")
def toxicity_query(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register(
    "op11_filter_audit",
    r"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS low FROM t),
    f AS (SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
                 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(low < doc_id, false) AS e FROM w),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic, a::INT + b::INT + c::INT + d::INT + e::INT AS fails
          FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order FROM x p, x q, x r, x s, x t
          WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
    s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS own, substr(filter_order, 1, step::INT - 1) AS earlier FROM o, range(1, 6) AS g(step)),
    k AS (SELECT m.*, s.*, CASE own WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS hit,
                 (a AND contains(earlier, 'A')) OR (b AND contains(earlier, 'B')) OR (c AND contains(earlier, 'C')) OR (d AND contains(earlier, 'D')) OR (e AND contains(earlier, 'E')) AS gone
          FROM m, s),
    r AS (SELECT part, filter_order, step, any_value(own) AS own, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
                 sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN hit AND fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
                 sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
          FROM k GROUP BY part, filter_order, step)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
    """,
)
def filter_audit_query(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.interaction_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register(
    "op12_collocations",
    r"""
    WITH p AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
    g AS (SELECT lang, array_to_string(words[i : i + k - 1], ' ') AS phrase, k FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, 6) AS ks(k) WHERE len(words) >= k)),
    f AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
    n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
    c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
    s AS (SELECT lang, a, unnest(flatten([[[array_to_string(ws[i : i + m - 1], ' ')] FOR i IN range(1, k - m + 2)] FOR m IN range(2, k)])) AS sub FROM c WHERE k >= 3),
    x AS (SELECT lang, sub[1] AS phrase, max(a) AS longest FROM s GROUP BY ALL),
    u AS (SELECT c.* FROM c LEFT JOIN x USING (lang, phrase) WHERE coalesce(100 * longest, 0) < 100 * a),
    t AS (SELECT lang, phrase, a, cut, array_to_string(ws[1 : cut], ' ') AS head, array_to_string(ws[cut + 1 : k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM u)),
    q AS (SELECT t.lang, t.phrase, a, cut, h.f AS l, r.f AS r, n.n, (1000::HUGEINT * a * n.n) // (h.f::HUGEINT * r.f) AS score
          FROM t JOIN f h ON h.lang = t.lang AND h.phrase = t.head JOIN f r ON r.lang = t.lang AND r.phrase = t.rest JOIN n ON n.lang = t.lang),
    b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS turn FROM q),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b WHERE turn = 1)
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o WHERE rank <= 2000
    """,
)
def collocation_query(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


@register("op13_quality_outliers")
def outlier_query(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.rules_report(table(spark, folder, "documents"))
