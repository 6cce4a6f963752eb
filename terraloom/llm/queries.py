"""The opN_ queries and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, langid, near_dedup, perplexity, pii, substring_dedup, toxicity, warc
from ._common import crc_mod, table, written


def tokenizer(name: str) -> str:
    return importlib.import_module("public_tokenizers").path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS top FROM q)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to
FROM r
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') s FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) i FROM w)),
hit AS (SELECT doc_id, i FROM win JOIN (SELECT s, min(doc_id) m FROM win GROUP BY s) USING (s) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) p FROM hit),
each AS (SELECT doc_id, unnest(words) word, generate_subscripts(words, 1) p FROM w),
kept AS (SELECT doc_id, count(*) n, string_agg(word, ' ' ORDER BY p) t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(words)::BIGINT n_words, (len(words) - coalesce(n, 0))::BIGINT n_removed, sha256(coalesce(t, '')) kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def op4_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.cluster(table(spark, sf_dir, "documents"), size=4)


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') s FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 3, least(len(words), 1)))) i FROM w)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
walk(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT b, root FROM walk JOIN ways ON doc_id = a),
c AS (SELECT doc_id, min(root) component_id FROM walk GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT n_shingles, component_id, doc_id = component_id kept FROM c LEFT JOIN n USING (doc_id)
"""


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(id AS BIGINT) AS turn, IF(id = 0, 'user', 'assistant') AS role, '" + said + "' AS text FROM range(2)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    output = written(chat.format_paths(chat.paths(chat.chained(rows), score=None)), "chat")
    back = chat.parse(output)
    said_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said_turns.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
k AS (SELECT *, length(role || text) + length(regexp_replace(role || text, '[^<\\[\\]\\\\]', '', 'g')) + 9 AS size FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars
FROM k GROUP BY conv_id
"""


def chat_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as trees in which every third message answers the one before the last: the two branches with the most text of each."""
    rows = chat.chained(table(spark, sf_dir, "conversations")).withColumn("score", F.length(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("parent", F.when(F.col("node") % 3 == 0, F.col("node") - 2).otherwise(F.col("parent")))
    back = chat.parse(chat.format_paths(chat.paths(rows, branches=2)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.col("tree").alias("conv_id"), "leaf", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"))


REPLY_TREES_SQL = """
WITH RECURSIVE n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) node, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
m AS (SELECT *, CASE WHEN node % 3 = 0 THEN node - 2 ELSE node - 1 END parent FROM n),
leaves AS (SELECT conv_id, node FROM m WHERE NOT EXISTS (SELECT 1 FROM m c WHERE c.conv_id = m.conv_id AND c.parent = m.node)),
walk AS (SELECT conv_id, node leaf, node, 0 back FROM leaves UNION ALL SELECT w.conv_id, leaf, m.parent, back + 1 FROM walk w JOIN m ON w.conv_id = m.conv_id AND w.node = m.node WHERE m.parent > 0),
p AS (SELECT w.conv_id, leaf, back, role, text FROM walk w JOIN m ON w.conv_id = m.conv_id AND w.node = m.node),
b AS (SELECT conv_id, leaf, sum(length(text)) score, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY back DESC)) turns_sha256 FROM p GROUP BY 1, 2)
SELECT conv_id, leaf, n_turns::BIGINT n_turns, turns_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, leaf) place FROM b) WHERE place <= 2
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = toxicity.train(docs, labels, learn=crc_mod("doc_id", 5) != 0)
    return toxicity.score(docs, weights).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pieces = table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model")
    model = langid.train(docs, pieces, learn=crc_mod("doc_id", 3) != 1)
    return langid.predict(docs, pieces, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_bpe": op2_bpe,
    "op3_substring": op3_substring,
    "op4_perplexity": op4_perplexity,
    "op5_minhash": op5_minhash,
    "op6_chat": op6_chat,
    "op7_toxicity": op7_toxicity,
    "op8_langid": op8_langid,
    "op9_pii": op9_pii,
    "op10_decontam": op10_decontam,
    "chat_reply_trees": chat_reply_trees,
}

ORACLE_SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op3_substring": OP3_SQL, "op5_minhash": OP5_SQL, "op6_chat": OP6_SQL, "chat_reply_trees": REPLY_TREES_SQL}
