"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickline.llm.bpe import round_trip
from wickline.llm.collocations import collocations
from wickline.llm.exact_dedup import exact_dedup
from wickline.llm.lattice import score_documents
from wickline.llm.licences import scan_licences
from wickline.llm.ngram_join import JaccardJoin, jaccard_components
from wickline.llm.packing import pack_documents
from wickline.llm.quality import assess
from wickline.llm.resampling import resample
from wickline.llm.scratch import fresh_path
from wickline.llm.secrets import joined_spans, of_kinds, scan_secrets
from wickline.llm.sharding import uniform_shards
from wickline.llm.token_counts import count_tokens
from wickline.llm.warc import archive_pages

Query = Callable[[SparkSession, str], DataFrame]
OPENING = 128  # characters by which copies of a work are told


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op2_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, fresh_path(spark, "token-counts"))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 2048).alias("over_limit"),
    )


def op3_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), digests=True)


def op4_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` has no paths. A document's directory is the work that it is a copy
    of, by its first ``OPENING`` characters; each file there speaks for its work, so
    copies that lost their notice inherit it from those that kept it."""
    opening = F.when(F.length("text") > 0, F.md5(F.substring("text", 1, OPENING).cast("binary")))
    path = F.concat(opening, F.lit("/NOTICE."), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"))
    return scan_licences(docs, "path")


def op6_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = JaccardJoin(width=4, percent=85)
    found = jaccard_components(table(spark, sf_dir, "documents"), rule)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op7_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    return uniform_shards(rows, shards=8, seed=7).withColumns(
        {"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}
    )


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive_pages(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return assess(table(spark, sf_dir, "documents")).select(
        F.col("id").cast("long").alias("doc_id"), *counts, "base_failed", "kept"
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup(table(spark, sf_dir, "documents"), keep="largest")
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = ("assign", "access", "hex")
    counts = {f"n_{k}": F.size(of_kinds(F.col("spans"), (k,))).cast("long") for k in (*base, "random")}
    return found.select(
        "doc_id",
        *[n.alias(name) for name, n in counts.items()],
        F.sha2(joined_spans(of_kinds(F.col("spans"), base)), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )


def op12_burst_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return sampled.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Query] = {
    "op1_subword_lattice": op1_subword_lattice,
    "op2_digest_cache": op2_digest_cache,
    "op3_segment_tree_bpe": op3_segment_tree_bpe,
    "op4_swap_packing": op4_swap_packing,
    "op5_licence_scan": op5_licence_scan,
    "op6_token_groups": op6_token_groups,
    "op7_uniform_shards": op7_uniform_shards,
    "op8_warc_index": op8_warc_index,
    "op9_line_frequency": op9_line_frequency,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_randomness_secrets": op11_randomness_secrets,
    "op12_burst_collocations": op12_burst_collocations,
    "op13_importance_resampling": op13_importance_resampling,
}

STATEMENTS: dict[str, str] = {
    "op8_warc_index": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last_id FROM p)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN strlen(html) >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN strlen(html) >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
        FROM m""",
    "op6_token_groups": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(ws[p:p + 3], ' ') AS g
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS p FROM w WHERE len(ws) > 0)),
        sized AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
                 FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs JOIN sized x ON a = x.doc_id JOIN sized y ON b = y.doc_id
                  WHERE 100 * k >= 85 * (x.n + y.n - k)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
                  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
        FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN sized USING (doc_id)""",
    "op9_line_frequency": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
        places AS (
            SELECT doc_id, p, array_to_string(ws[p:p + 4], ' ') AS five
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5)),
        twice AS (SELECT doc_id, p FROM places
                  QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
        covered AS (SELECT doc_id, count(DISTINCT p + k) AS n
                    FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
        lines AS (
            SELECT doc_id, host, text, line,
                   regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS lw
            FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d)),
        full_lines AS (SELECT *, array_to_string(lw, ' ') AS normal FROM lines WHERE len(lw) > 0),
        dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY doc_id),
        common AS (
            SELECT host, normal FROM full_lines GROUP BY host, normal HAVING count(DISTINCT text) > 10),
        cut AS (SELECT doc_id, sum(len(lw)) AS n FROM full_lines JOIN common USING (host, normal) GROUP BY doc_id),
        counted AS (
            SELECT doc_id, len(ws)::BIGINT AS n_words,
                   coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                   coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
                   coalesce(cut.n, 0) AS n_cut
            FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN cut USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
               AND 100 * (n_words - n_cut) >= 20 * n_words AS kept
        FROM counted""",
    "op10_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.text) AS text_sha256
        FROM t JOIN g ON t.text = g.text""",
    "op12_burst_collocations": r"""
        WITH d AS (
            SELECT coalesce(lang, 'und') AS lang,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents),
        p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
        grams AS (
            SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS a
            FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
                  FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)
            GROUP BY ALL),
        cand AS (SELECT *, string_split(phrase, ' ') AS ws FROM grams WHERE k >= 2 AND a >= 30),
        cuts AS (
            SELECT c.lang, c.phrase, c.a, c.j, x.a AS l, y.a AS r,
                   ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score
            FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
            JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.j], ' ')
            JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.j + 1:c.k], ' ')),
        lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        inner_phrases AS (
            SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer
            FROM (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS i
                  FROM cand, (SELECT unnest([2, 3]) AS m) WHERE m < k)
            GROUP BY ALL),
        ranked AS (
            SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
            FROM lowest s LEFT JOIN inner_phrases i ON i.lang = s.lang AND i.phrase = s.phrase
            WHERE longer IS NULL OR 100 * longer < 80 * a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
