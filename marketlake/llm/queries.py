"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (embedding_join, exact_dedup, html_text, mixing, ngram_join, packing, positional_index, prefix_trie, sharding, token_alignment,
    token_counts, tool_calls, toxicity)
from .common import table


def op1_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.turns_as_calls(table(spark, sf_dir, "conversations"))
    return tool_calls.link_tool_calls(calls, results, tool_calls.TURN_TOOLS).withColumn("errors", F.array_join("errors", ","))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), threshold=0.8, n=5)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op7_embedding_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.embedding_join(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10, slack=2)


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vector_packing": op1_vector_packing,
    "op2_tool_call_linking": op2_tool_call_linking,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_minimax_shards": op4_minimax_shards,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_token_counts": op6_token_counts,
    "op7_embedding_grid_join": op7_embedding_grid_join,
    "op8_source_mixing": op8_source_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_html_main_text": op10_html_main_text,
    "op11_benchmark_decontamination": op11_benchmark_decontamination,
    "op12_conversation_prefix_trie": op12_conversation_prefix_trie,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op2_tool_call_linking": r"""
        WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
        calls AS (
            SELECT *, 'call-' || conv_id || '-' || (turn - CASE WHEN short AND turn >= 2 THEN 2 ELSE 0 END) AS call_id,
                   CASE WHEN role = 'system' THEN 'system_prompt' ELSE 'answer' END AS name
            FROM (SELECT *, length(text) < 60 AS short, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM t WHERE role <> 'assistant')
        ),
        firsts AS (SELECT conv_id, call_id, min(turn) AS turn FROM calls GROUP BY ALL),
        answers AS (
            SELECT c.conv_id, c.call_id, arg_min(r.text, r.turn) AS content, min(r.turn) AS turn, count(*) AS n
            FROM t r JOIN calls c ON c.conv_id = r.conv_id AND c.turn = r.turn - 1 WHERE r.role = 'assistant' GROUP BY ALL
        ),
        wanted AS (SELECT conv_id, call_id, turn, unnest(CASE WHEN turn % 8 IN (4, 5) THEN [0, turn // 2, turn + 2] ELSE [0, turn // 2] END) AS parent FROM calls),
        edges AS (
            SELECT DISTINCT w.conv_id, w.call_id, w.turn, p.call_id AS parent_id, p.turn AS parent_turn
            FROM wanted w JOIN firsts p ON p.conv_id = w.conv_id AND p.call_id = 'call-' || w.conv_id || '-' || w.parent WHERE p.call_id <> w.call_id
        ),
        parents AS (SELECT conv_id, call_id, count(DISTINCT parent_id) AS n FROM edges GROUP BY ALL),
        odd AS (SELECT DISTINCT conv_id FROM edges WHERE parent_turn >= turn),
        e AS (SELECT DISTINCT conv_id, call_id, parent_id FROM edges WHERE conv_id IN (FROM odd)),
        above AS (SELECT conv_id, call_id, parent_id FROM e UNION SELECT a.conv_id, a.call_id, e.parent_id FROM above a JOIN e ON e.conv_id = a.conv_id AND e.call_id = a.parent_id),
        stuck AS (
            SELECT DISTINCT conv_id, call_id FROM above WHERE (conv_id, parent_id) IN (SELECT (conv_id, call_id) FROM above WHERE call_id = parent_id) OR call_id = parent_id
        ),
        level AS (
            SELECT conv_id, call_id, 0 AS level FROM firsts WHERE conv_id IN (FROM odd) AND (conv_id, call_id) NOT IN (SELECT (conv_id, call_id) FROM stuck)
            UNION SELECT e.conv_id, e.call_id, l.level + 1 FROM level l JOIN e ON e.conv_id = l.conv_id AND e.parent_id = l.call_id WHERE (e.conv_id, e.call_id) NOT IN (SELECT (conv_id, call_id) FROM stuck)
        ),
        levels AS (SELECT conv_id, call_id, max(level) AS level FROM level GROUP BY ALL UNION ALL SELECT conv_id, call_id, 2147483647 FROM stuck)
        SELECT c.conv_id, c.call_id, name, c.turn AS position, row_number() OVER (PARTITION BY c.conv_id ORDER BY coalesce(l.level, 0), c.turn) - 1 AS topo_order, coalesce(p.n, 0) AS n_parents,
               CASE WHEN c.turn > f.turn THEN 'duplicate' WHEN l.level = 2147483647 THEN 'cycle' WHEN a.n IS NULL THEN 'unanswered' WHEN a.turn < c.turn THEN 'answered before call' ELSE 'answered' END AS status,
               coalesce(a.n, 0) AS n_results,
               concat_ws(',', CASE WHEN lines > 1 THEN 'lines:unknown' END, CASE WHEN c.text = '' THEN 'query:missing' END, CASE WHEN short THEN 'turn:type' END) AS errors,
               '{"arguments":{' || concat_ws(',', CASE WHEN lines > 1 THEN '"lines":' || lines END, CASE WHEN role = 'system' THEN '"pinned":true' END, CASE WHEN c.text <> '' THEN '"query":' || to_json(c.text)::VARCHAR END,
               '"turn":' || CASE WHEN short THEN '"' || c.turn || '"' ELSE c.turn::VARCHAR END) || '},"id":"' || c.call_id || '","name":"' || name || '","result":' || coalesce(to_json(a.content)::VARCHAR, 'null') || '}' AS canonical_json
        FROM calls c JOIN firsts f ON f.conv_id = c.conv_id AND f.call_id = c.call_id LEFT JOIN answers a ON a.conv_id = c.conv_id AND a.call_id = c.call_id
        LEFT JOIN parents p ON p.conv_id = c.conv_id AND p.call_id = c.call_id LEFT JOIN levels l ON l.conv_id = c.conv_id AND l.call_id = c.call_id
    """,
    "op3_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1 AS kept, h AS text_sha256
        FROM t
    """,
    "op11_benchmark_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        i AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + 9], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM b WHERE len(w) > 0)),
        p AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i))),
        m AS (SELECT DISTINCT doc_id, item_id, s, p.n FROM p JOIN i ON p.t = i.t AND p.n = i.n),
        h AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM m) GROUP BY 1),
        f AS (SELECT t, count(*) AS n FROM (SELECT unnest(w) AS t FROM d) GROUP BY 1),
        r AS (SELECT item_id, ts, n0 AS n, arg_min(x, (f.n, x)) AS rarest FROM (SELECT item_id, n AS n0, string_split(t, ' ') AS ts, unnest(string_split(t, ' ')) AS x FROM i) u JOIN f ON f.t = u.x GROUP BY ALL),
        o AS (SELECT doc_id, w, k, w[k] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d) WHERE t IN (SELECT rarest FROM r)),
        y AS (SELECT doc_id, count(DISTINCT item_id) AS n FROM (
            SELECT doc_id, item_id, w, ts, r.n, k - unnest(range(0, r.n + 2)) AS s FROM o JOIN r ON r.rarest = o.t
        ) WHERE list_has_all(w[greatest(1, s) : s + n + 1], ts) GROUP BY 1),
        x AS (SELECT doc_id, string_agg(item_id, ',' ORDER BY item_id) AS ids, count(*) AS n FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(x.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated, coalesce(y.n, 0) AS n_near_items
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
    """,
    "op12_conversation_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        -- CRC-32 of the decimal number: a step for each byte, and one for each of its bits
        crc AS (
            SELECT conv_id, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
                       lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                       lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 6 AS h
            FROM (SELECT DISTINCT conv_id FROM t)
        ),
        c AS (SELECT crc.conv_id, h, conv_id - conv_id % 100 AS base, least(h, coalesce(n, 0)) AS taken
              FROM crc LEFT JOIN (SELECT conv_id AS b, count(*) AS n FROM t GROUP BY 1) ON b = conv_id - conv_id % 100),
        x AS (
            SELECT c.conv_id, t.r AS d, role, text FROM c JOIN t ON t.conv_id = c.base AND t.r <= h
            UNION ALL SELECT c.conv_id, t.r - h + taken, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.r > h
        ),
        p AS (
            SELECT conv_id, d, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w) AS k, length(text) AS n FROM x
            WINDOW w AS (PARTITION BY conv_id ORDER BY d)
            UNION ALL SELECT conv_id, 0, '', 0 FROM c
        ),
        q AS (SELECT *, lag(k) OVER w AS up, d = max(d) OVER (PARTITION BY conv_id) AS last FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
        node AS (SELECT d, k, up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM q GROUP BY d, k, up),
        kids AS (SELECT up AS k, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY 1),
        pairs AS (SELECT DISTINCT a.k, b.k AS below FROM q a JOIN q b ON a.conv_id = b.conv_id AND b.d >= a.d),
        sums AS (SELECT pairs.k, count(*) FILTER (kids.k IS NULL) AS n_leaves, sum((n_convs - 1) * n)::BIGINT AS saved_tokens
                 FROM pairs JOIN node ON node.k = pairs.below LEFT JOIN kids ON kids.k = pairs.below GROUP BY 1),
        ends AS (SELECT k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS e FROM q WHERE last GROUP BY 1)
        SELECT node.conv_id, node.d AS depth, parent.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
               coalesce(e, sha256('')) AS ends_sha256
        FROM node JOIN sums ON sums.k = node.k LEFT JOIN kids ON kids.k = node.k LEFT JOIN ends ON ends.k = node.k LEFT JOIN node parent ON parent.k = node.up
    """,
}
