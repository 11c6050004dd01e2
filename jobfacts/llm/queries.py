"""The registered queries of these operators and, where SQL can express them, their SQL twins."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobfacts.llm import (
    centroids,
    decontam,
    exact,
    langid,
    lengths,
    linededup,
    mixing,
    neardup,
    ngram,
    packing,
    prefixtrie,
    sharding,
    twins,
    warc,
)
from jobfacts.llm.common import table, written

LIMIT, END_ID, SHARDS = 2048, 1, 40


def vocabulary() -> str:
    """Where the installed vocabulary files have the byte-level one."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary(), LIMIT, END_ID)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def held_out(part: int) -> Column:
    """Documents that a model must not learn from: those whose CRC of the id leaves 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % part == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = langid.identify(docs, langid.fit(docs.filter(~held_out(4))))
    return rows.select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neardup.near_duplicates(table(spark, sf_dir, "documents"), 85, 5)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captured = F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.pmod("page_id", F.lit(1 << 28)), F.lit(0)))
    index = warc.capture_index(table(spark, sf_dir, "pages"), 0, captured)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.without_repeated_lines(table(spark, sf_dir, "documents"), find=linededup.lines_repeated_anywhere)
    return rows.select("doc_id", "n_lines", "n_removed", "owners", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score(table(spark, sf_dir, "documents"), held_out(7))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.limits(lengths.histogram(table(spark, sf_dir, "documents"), vocabulary()))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_owners(table(spark, sf_dir, "documents"), largest=True)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(table(spark, sf_dir, "documents"), (3, 1, 2), share=1.5, limit=2.0, carry=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = centroids.clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed=3)
    return rows.withColumn("centroid_sha256", F.sha2(F.array_join("centroid", ","), 256)).drop("centroid")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = written(prefixtrie.sequences(table(spark, sf_dir, "conversations")), "conversations")
    head = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % 100
    return prefixtrie.prefix_trie(prefixtrie.rebuilt(convs, head, base, 5)).drop("name")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_sharding": op2_sharding,
    "op3_language_id": op3_language_id,
    "op4_near_dedup": op4_near_dedup,
    "op5_warc": op5_warc,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_token_counts": op9_token_counts,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_mixing": op11_mixing,
    "op12_centroids": op12_centroids,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE = {
    "op4_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
            FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
            FROM s AS a JOIN s AS b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n AS x ON a = x.doc_id JOIN n AS y ON b = y.doc_id
            WHERE 100 * i >= 85 * (x.n + y.n - i)),
        r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
        c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)""",
    "op5_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        o AS (SELECT html, max(page_id) AS owner, sha1(html) AS hex FROM p GROUP BY html),
        b AS (SELECT html, owner, array_to_string(list_transform(range(0, 32), lambda j:
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || hex[j // 4 * 5 + 1:j // 4 * 5 + 5])::BIGINT
                >> (15 - 5 * (j % 4))) & 31)]), '') AS payload_digest FROM o)
        SELECT page_id, strlen(html) AS payload_bytes, payload_digest,
            CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> owner THEN owner END AS refers_to
        FROM p JOIN b USING (html)""",
    "op7_decontamination": r"""
        WITH d AS (SELECT doc_id, text, row_number() OVER () AS k FROM documents),
        dw AS (SELECT k, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
        bw AS (SELECT item_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bn AS (SELECT item_id, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS phrase
            FROM bn, unnest(range(1, len(w) - n + 2)) AS u(s)),
        sizes AS (SELECT DISTINCT n FROM win),
        dwin AS (SELECT k, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase
            FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS u(s) WHERE len(w) >= n),
        hit AS (SELECT k, s, n, item_id FROM dwin JOIN win USING (n, phrase)),
        words AS (SELECT k, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + n)) AS u(p) GROUP BY k),
        items AS (SELECT k, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
            FROM (SELECT DISTINCT k, item_id::VARCHAR AS i FROM hit) GROUP BY k)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN words USING (k) LEFT JOIN items USING (k)""",
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(text) AS text_sha256
        FROM d JOIN g USING (text)""",
    "op11_mixing": twins.MIXING,
    "op12_centroids": twins.centroids(10),
    "op13_prefix_trie": twins.PREFIX_TRIE,
}
