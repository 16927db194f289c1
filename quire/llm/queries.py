"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_piece_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .piece_tokenizer import piece_digests

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return piece_digests(_table(spark, sf_dir, "documents"), f.read())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .toxicity import fit, held_out, score_toxicity

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out()))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeated_words

    return remove_repeated_words(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return pack_documents(_table(spark, sf_dir, "documents"), f.read())


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import as_events, chat_digests, format_chats

    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(format_chats(as_events(rows.unionByName(more))))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_digests, store_media

    return media_digests(store_media(_table(spark, sf_dir, "documents")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import held_out, score_texts

    scored = score_texts(_table(spark, sf_dir, "documents"), ~held_out()).withColumn("held_out", held_out())
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_piece_tokenizer": op2_piece_tokenizer,
    "op3_toxicity": op3_toxicity,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_packing": op5_packing,
    "op6_chat_format": op6_chat_format,
    "op7_media": op7_media,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_ppm": op10_ppm,
}

SQL = {
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
    "op1_suffix_dedup": r"""
        WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        p AS (SELECT doc_id, unnest(range(length(h) // 2)) AS pos, h FROM b),
        c AS (SELECT doc_id, pos, substring(h, 2 * pos + 1, 2) AS byte, CASE WHEN pos + 100 <= length(h) // 2 THEN substring(h, 2 * pos + 1, 200) END AS content FROM p),
        f AS (SELECT doc_id, pos, byte, CASE WHEN content IS NOT NULL AND row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) > 1 THEN 1 ELSE 0 END AS again FROM c),
        g AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
        e AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), 0) = 0 AS starts FROM g),
        a AS (SELECT doc_id, count(*) AS n_bytes, CAST(sum(gone) AS BIGINT) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans, coalesce(string_agg(byte, '' ORDER BY pos) FILTER (WHERE gone = 0), '') AS kept FROM e GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id
    """,
    "op4_substring_dedup": r"""
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM w),
        c AS (SELECT *, CASE WHEN pos + 19 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS content FROM p),
        f AS (SELECT *, CASE WHEN content IS NOT NULL AND row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) > 1 THEN 1 ELSE 0 END AS again FROM c),
        g AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
        a AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0), '') AS kept FROM g GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id
    """,
    "op6_chat_format": r"""
        WITH r AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, 13 + length(role) + length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '### ', ''))) // 4 + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS n FROM r)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
    """,
    "op9_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM w),
        c AS (SELECT doc_id, pos, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s FROM p),
        t AS (SELECT DISTINCT doc_id, CASE WHEN n < 4 THEN '<' || n || ' ' || s ELSE s END AS s FROM c WHERE pos + 3 <= n OR n < 4 AND pos = 1),
        k AS (SELECT doc_id, count(*) AS k FROM t GROUP BY doc_id),
        pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM t a JOIN t b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM pr JOIN k a ON a.doc_id = x JOIN k b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.k + b.k - shared)),
        v AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, v.y FROM r JOIN v ON v.x = r.b)
        SELECT d.doc_id, coalesce(k.k, 0) AS n_shingles, m.c AS component_id FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
    """,
}
