"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindergrid.llm import (byte_bpe, chat_format, conversation_trie, decision_list, decontaminate, embedding_whitening, katz, language_id,
                            ngram_join, pii, quality_classifier, simhash_variants, warc_zip)
from cindergrid.session import cut_lineage


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def site():
    """Host and path of a document: its source, and the part of it in one language."""
    return F.col("source"), F.col("lang")


def op1_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), *site())


def op3_decision_list(spark, sf_dir):
    return decision_list.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op4_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))

    def joined(spans):
        order = F.transform(spans, lambda s: F.struct(F.array_position(F.array(*map(F.lit, pii.KINDS)), s["kind"]).alias("o"),
                                                      s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k")))
        return F.array_join(F.transform(F.sort_array(order), lambda s: F.concat_ws(":", s["k"], s["a"], s["b"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op5_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))],
                                 "conv_id long, turn long, role string, text string")
    rows = rows.unionByName(more).select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("payload"))
    turns = chat_format.canonical_turns(rows, "payload")
    return chat_format.digests(chat_format.read_turns(chat_format.format_turns(turns)), "conv_id", ["turn", "position", "read_role", "read_text"])


def op6_warc_zip(spark, sf_dir):
    return warc_zip.round_trip(table(spark, sf_dir, "pages")).withColumnRenamed("page", "page_id")


def op7_decontaminate(spark, sf_dir):
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_byte_bpe(spark, sf_dir):
    path = tokenizer()
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def fold(remainder: int):
    """Whether the CRC-32 of the id, as text, leaves this remainder modulo 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == remainder, F.lit(False))


def op9_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"), fold(0))


def op10_katz(spark, sf_dir):
    return katz.score(table(spark, sf_dir, "documents"), fold(1))


def op11_conversation_trie(spark, sf_dir):
    turns, convs = conversation_trie.grafted(cut_lineage(conversation_trie.numbered(table(spark, sf_dir, "conversations"))))
    return conversation_trie.trie(turns, convs).drop("key")


def op12_simhash_variants(spark, sf_dir):
    return simhash_variants.near_duplicates(table(spark, sf_dir, "documents"))


def op13_whitening(spark, sf_dir):
    return embedding_whitening.whiten(table(spark, sf_dir, "embeddings"))


#: CRC-32 bit by bit over the decimal id, conversations rebuilt, every opening as a path, subtrees by all pairs of node and ancestor.
OP11_SQL = """
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, count(*) AS n FROM turns GROUP BY c),
bits AS (
  SELECT c, n, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 9 AS h
  FROM own),
plans AS (SELECT b.c, b.h, b.n, b.base, least(b.h, coalesce(o.n, 0)) AS taken FROM bits b LEFT JOIN own o ON o.c = b.base),
rebuilt AS (
  SELECT p.c, t.pos, t.role, t.text FROM plans p JOIN turns t ON t.c = p.base AND t.pos <= p.h
  UNION ALL
  SELECT p.c, t.pos - p.h + p.taken, t.role, t.text FROM plans p JOIN turns t ON t.c = p.c AND t.pos > p.h),
openings AS (
  SELECT c, pos AS depth, string_agg(to_json([role, text])::VARCHAR, ',') OVER (PARTITION BY c ORDER BY pos) AS path, strlen(text) AS bytes
  FROM rebuilt
  UNION ALL SELECT c, 0, '', 0 FROM plans),
lasts AS (SELECT c, max(depth) AS depth FROM openings GROUP BY c),
nodes AS (
  SELECT o.path, min(o.c) AS conv_id, any_value(o.depth) AS depth, count(*) AS n_convs, any_value(o.bytes) AS bytes,
         sha256(coalesce(string_agg(CASE WHEN l.depth = o.depth THEN o.c::VARCHAR END, ',' ORDER BY o.c), '')) AS ends_sha256
  FROM openings o JOIN lasts l ON l.c = o.c GROUP BY o.path),
above AS (
  SELECT n.path, n.depth, n.n_convs, n.bytes, a.path AS ancestor, a.depth AS place
  FROM nodes n JOIN openings a ON a.c = n.conv_id AND a.depth <= n.depth),
children AS (SELECT ancestor AS path, count(*) AS n FROM above WHERE place = depth - 1 GROUP BY ancestor),
totals AS (
  SELECT a.ancestor AS path, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((a.n_convs - 1) * a.bytes) AS saved_tokens
  FROM above a LEFT JOIN children k ON k.path = a.path GROUP BY a.ancestor)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, t.n_leaves,
       CAST(t.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN totals t ON t.path = n.path LEFT JOIN children k ON k.path = n.path
LEFT JOIN above u ON u.path = n.path AND u.place = n.depth - 1 LEFT JOIN nodes p ON p.path = u.ancestor"""


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_quality_classifier, op3_decision_list, op4_pii, op5_chat_format, op6_warc_zip, op7_decontaminate,
                                  op8_byte_bpe, op9_language_id, op10_katz, op11_conversation_trie, op12_simhash_variants,
                                  op13_whitening)}
ORACLES: dict[str, str] = {"op11_conversation_trie": OP11_SQL}
