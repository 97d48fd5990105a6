"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftwood.llm.common import read_table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwood.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(read_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwood.llm.mixing import mix_sources

    return mix_sources(read_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwood.llm.decontaminate import find_overlaps

    return find_overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("doc_key")


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwood.llm.pseudonyms import pseudonym_report

    key = spark.conf.get("spark.siftwood.pseudonymKey", "siftwood-test-key")
    return pseudonym_report(read_table(spark, sf_dir, "documents"), key)


def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwood.llm.reply_trees import TRAP, format_conversations

    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return format_conversations(table.unionByName(spark.createDataFrame(TRAP, "conv_id long, turn long, role string, text string")))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwood.llm.licenses import scan_licenses

    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwood.llm.quality import score_quality

    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwood.llm.substring_dedup import remove_repeated_windows

    return remove_repeated_windows(read_table(spark, sf_dir, "documents"), with_text=False)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwood.llm.embedding_dedup import embedding_near_duplicates

    return embedding_near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwood.llm.sharding import shard_documents

    return shard_documents(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_mix_sources": op2_mix_sources,
    "op3_decontaminate": op3_decontaminate,
    "op4_pseudonyms": op4_pseudonyms,
    "op5_reply_trees": op5_reply_trees,
    "op6_licenses": op6_licenses,
    "op7_quality": op7_quality,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_shard": op10_shard,
}

#: The escaped form has one more character for each of the four that are coded; a turn adds "<turn ", ">", "</turn>" and a line feed.
_OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), x AS (
  SELECT *, 15 + length(role) + length(text)
    + length(role || text) - length(replace(replace(replace(replace(role || text, '\', ''), '<', ''), '>', ''), '#', '')) AS chars
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""

_WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP1_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS_SQL.replace("coalesce(text, '')", "lower(coalesce(text, ''))")} AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS gram FROM d, unnest(range(1, greatest(len(ws) - 3, 2))) AS r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g a JOIN g b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b, m = x.n AND m = y.n AS equal FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE m >= 0.8 * (x.n + y.n - m) - 1e-9),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM l WHERE l.a = doc_id AND equal), doc_id)) AS class_id,
  (SELECT count(*) FROM l WHERE l.a = doc_id)::BIGINT AS n_links, component_id, doc_id = component_id AS kept
FROM documents JOIN c ON c.a = doc_id
"""

#: Every diagonal of every pair. A stretch from the i-th to the j-th match of a diagonal, at places q, scores 3 (j - i + 1) - 2 (q_j - q_i + 1).
_PLAIN_SQL = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\[-`{-~]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_OP3_SQL = rf"""
WITH dx AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM (SELECT doc_id, {_PLAIN_SQL} AS ws FROM documents)),
ix AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS q FROM (SELECT item_id, {_PLAIN_SQL} AS ws FROM benchmark)),
c AS (SELECT doc_id, item_id, n, p - q AS diagonal, count(*) AS matched FROM dx JOIN ix USING (w) GROUP BY ALL HAVING count(*) = n OR (n >= 7 AND count(*) >= least(0.6 * n, 5))),
m AS (SELECT c.*, q, row_number() OVER g AS r FROM c JOIN ix USING (item_id) JOIN dx ON dx.doc_id = c.doc_id AND dx.p = q + diagonal AND dx.w = ix.w WINDOW g AS (PARTITION BY c.doc_id, c.item_id, diagonal ORDER BY q)),
f AS (SELECT *, 3 * r - 2 * q - min(3 * r - 2 * q) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY q ROWS UNBOUNDED PRECEDING) + 1 AS score FROM m),
j AS (SELECT doc_id, item_id, n, diagonal, matched, max(score) AS score FROM f GROUP BY ALL HAVING matched = n OR matched >= 0.6 * n OR max(score) >= 13)
SELECT doc_id, item_id, n::BIGINT AS n_item_words, matched::BIGINT AS n_matched, score::BIGINT AS score, greatest(0, diagonal)::BIGINT AS first_word FROM j
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, score DESC, greatest(0, diagonal)) = 1
"""

_OP8_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(ws) - 48)) AS r(i)),
f AS (SELECT h, min(doc_id) AS low FROM p GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM p JOIN f USING (h), unnest(range(0, 50)) AS r(k) WHERE doc_id > low),
w AS (SELECT doc_id, j, ws[j] AS word FROM d, unnest(range(1, len(ws) + 1)) AS r(j)),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS kept FROM w ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

_OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT a AS vec_id, (SELECT count(*) FROM l WHERE l.a = reach.a)::BIGINT AS n_links, min(b) AS component_id, a = min(b) AS kept FROM reach GROUP BY a
"""

ORACLES: dict[str, str] = {
    "op1_ngram_join": _OP1_SQL,
    "op3_decontaminate": _OP3_SQL,
    "op5_reply_trees": _OP5_SQL,
    "op8_substring_dedup": _OP8_SQL,
    "op9_embedding_dedup": _OP9_SQL,
}
