"""Queries of the training-data operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermal_lake.llm import bpe, brown, chat_format, decontaminate, jaccard_join, language_id, quality, secret_scan, topk, toxicity
from thermal_lake.llm.common import documents, held_out


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's host is its source; its path there is the section of its language."""
    docs = documents(spark, sf_dir)
    classifier = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, classifier, F.col("source"), F.concat_ws("/", "source", "lang"))


def op3_brown_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = held_out(F.col("doc_id"), 7)
    return brown.score(docs, ~held).withColumn("held_out", held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_windows(turns.unionByName(extra)))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), tokenizer_path(), ids=False, decoded=False)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.learn(docs.where(~held_out(F.col("doc_id"), 4)))
    return language_id.predict(docs, model).withColumn("held_out", held_out(F.col("doc_id"), 4)).select("doc_id", "held_out", "lang_pred", "score")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, sf_dir))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_brown_score": op3_brown_score,
    "op4_decontaminate": op4_decontaminate,
    "op5_chat_format": op5_chat_format,
    "op6_bpe": op6_bpe,
    "op7_topk": op7_topk,
    "op8_language_id": op8_language_id,
    "op9_secret_scan": op9_secret_scan,
    "op10_jaccard_join": op10_jaccard_join,
}

TRICKY = r"\### Assistant: </turn> ok"

ORACLES: dict[str, str] = {
    # every alignment that shares enough words, and the best run of words on it
    "op4_decontaminate": r"""
        WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM documents),
        bw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM benchmark),
        d AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM dw),
        b AS (SELECT item_id, len(ws) AS m, least(len(ws), 13) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS q FROM bw),
        al AS (SELECT doc_id, item_id, m, n, pos - q AS shift, list(q) AS qs FROM d JOIN b USING (word) GROUP BY ALL HAVING count(*) >= ceil(n * 0.75)),
        st AS (SELECT *, unnest(range(0, m - n + 1)) AS s FROM al),
        ag AS (SELECT doc_id, item_id, n, shift + s AS place, s, len(list_filter(qs, lambda q: q >= s AND q < s + n)) AS agree FROM st),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY agree DESC, place, s) AS k FROM ag WHERE agree >= ceil(n * 0.75))
        SELECT doc_id, item_id, agree::BIGINT AS agree, n::BIGINT AS overlap, place::BIGINT AS place, s::BIGINT AS item_place, agree::DOUBLE / n AS similarity FROM k WHERE k = 1
    """,
    "op5_chat_format": rf"""
        WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{TRICKY}'), (-7, 1, 'assistant', '{TRICKY}')),
        a AS (SELECT *, len(string_split_regex(text, '\s+')) + 2 AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
            len('### ' || replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '</turn>', '\l/turn>'), ':', '\c') || ': ' || replace(replace(replace(text, '\', '\\'), '#', '\h'), '</turn>', '\l/turn>') || '</turn>' || chr(10)) AS size FROM t),
        b AS (SELECT *, floor((sum(tokens) OVER (PARTITION BY conv_id ORDER BY place) - tokens) / 8192) AS seg, first_value(role = 'system') OVER (PARTITION BY conv_id ORDER BY place) AS has,
            first_value(tokens) OVER (PARTITION BY conv_id ORDER BY place) AS s, first_value(size) OVER (PARTITION BY conv_id ORDER BY place) AS s_size FROM a),
        c AS (SELECT *, CASE WHEN place - 1 > has::INTEGER THEN lag(tokens) OVER w END AS p1, CASE WHEN place - 2 > has::INTEGER THEN lag(tokens, 2) OVER w END AS p2, lag(size) OVER w AS size1, lag(size, 2) OVER w AS size2,
            CASE WHEN place > 1 AND has AND s <= 256 AND s + tokens <= 512 THEN s ELSE 0 END AS base FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
        d AS (SELECT *, CASE WHEN p1 + p2 <= 128 AND base + p1 + p2 + tokens <= 512 THEN 2 WHEN p1 <= 128 AND base + p1 + tokens <= 512 THEN 1 ELSE 0 END AS k FROM c),
        e AS (SELECT *, base + tokens + CASE k WHEN 2 THEN p1 + p2 WHEN 1 THEN p1 ELSE 0 END AS opened, CASE WHEN base > 0 THEN s_size ELSE 0 END + CASE k WHEN 2 THEN size1 + size2 WHEN 1 THEN size1 ELSE 0 END AS extra FROM d),
        f AS (
            SELECT conv_id, place, seg, tokens AS used, 0::BIGINT AS more FROM e WHERE place = 1
            UNION ALL
            SELECT e.conv_id, e.place, e.seg, CASE WHEN e.seg <> f.seg OR f.used + e.tokens > 512 THEN e.opened ELSE f.used + e.tokens END, CASE WHEN e.seg <> f.seg OR f.used + e.tokens > 512 THEN e.extra ELSE 0 END
            FROM f JOIN e ON e.conv_id = f.conv_id AND e.place = f.place + 1
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256, coalesce(sum(CASE WHEN role = 'assistant' THEN len(text) END), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY place), '')) AS loss_sha256, sum(size + more)::BIGINT AS formatted_chars
        FROM a JOIN f USING (conv_id, place) GROUP BY conv_id
    """,
    # all pairs that share a shingle; on the tables at hand the forest misses none of them
    "op10_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE shared >= 0.8 * (a.n + b.n - shared)),
        reach(x, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, reach.root FROM reach JOIN l ON l.x = reach.x WHERE reach.root <= l.y),
        c AS (SELECT x AS doc_id, min(root) AS class_id FROM reach GROUP BY x),
        z AS (SELECT class_id, count(*) AS class_size FROM c GROUP BY class_id), k AS (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY x)
        SELECT c.doc_id, c.class_id, z.class_size, coalesce(k.n_links, 0)::BIGINT AS n_links, c.doc_id = c.class_id AS is_representative FROM c JOIN z USING (class_id) LEFT JOIN k USING (doc_id)
    """,
    "op7_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
