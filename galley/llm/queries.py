"""The queries of the subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import (
    bpe,
    chat,
    digest,
    divergence,
    language_id,
    line_dedup,
    mixing,
    near_vectors,
    negatives,
    ngram_join,
    quality,
    toxicity,
    wrappers,
)
from galley.sources.tables import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose two turns hold the template's control strings."""
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from documents whose crc32(doc_id) mod 4 is not 2; predicted from the text alone."""
    held_out = language_id.held_out(F.col("doc_id"), 4, 2)
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~held_out))
    texts = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language_id.identify(texts, model, with_spans=False).drop("text")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by the wrapper of its host."""
    return wrappers.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, and what they decode to."""
    got = bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file())
    return got.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its edited text and against the next document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest.compare_with_edits(docs, digest.corpus_ranks(docs))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and the verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines that many sources share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    got = F.col("line_dedup")
    return line_dedup.without_boilerplate(docs).select(
        "doc_id",
        got["n_lines"].alias("n_lines"),
        got["n_removed"].alias("n_removed"),
        F.length(got["text"]).cast("long").alias("n_chars"),
        F.sha2(got["text"], 256).alias("text_sha256"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from labels of documents whose crc32(doc_id) mod 5 is not 0; scored from the text alone."""
    held_out = language_id.held_out(F.col("doc_id"), 5, 0)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.filter(~held_out))
    got = toxicity.score(docs.withColumn("held_out", held_out), model).drop("text")
    return got.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share 85 % or more of their four-word shingles, and the groups they form."""
    return ngram_join.groups(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=85)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth row as anchor; every seventh has the label after its own."""
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one label whose vectors have a cosine of 0.98 or more, and the groups that they form."""
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of every language against one another and against the language, by their terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_language_id,
        op3_html_extraction,
        op4_bpe_codec,
        op5_source_mixing,
        op6_fingerprints,
        op7_quality_rules,
        op8_line_dedup,
        op9_toxicity,
        op10_ngram_join,
        op11_hard_negatives,
        op12_embedding_dedup,
        op13_source_divergence,
    )
}
_CHAT_SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
forms AS (SELECT *, replace(replace(x, '</turn>', '<\/turn>'), '### ', '##\# ') AS once,
  replace(replace(replace(x, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# ') AS twice FROM rows),
bodies AS (SELECT *, CASE WHEN contains(x, '\') OR contains(x, '</turn>') OR contains(x, '### ') THEN
  CASE WHEN regexp_replace(once, '(?s)\\(.)', '\1', 'g') = x AND NOT contains(once, '</turn>') AND NOT contains(once, '### ')
  THEN once ELSE twice END ELSE x END AS body FROM forms)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(regexp_replace(r, '([\\:/#])', '\\\1', 'g')) + 2 + length(body) + 9)::BIGINT AS formatted_chars,
  true AS roundtrip
FROM bodies GROUP BY conv_id"""

_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, weight * coalesce(max(CASE WHEN NOT cap < weight * level THEN level END) OVER (), 0)) AS target,
  ('0x' || substr(md5(coalesce(source, chr(0) || 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l),
p AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS place FROM d)
SELECT doc_id, size, source_size, target,
  size * least(3, floor(u + coalesce(target / nullif(source_size, 0), 0) * place) - floor(u + coalesce(target / nullif(source_size, 0), 0) * (place - 1)))::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source"""

_LINES_SQL = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
k AS (SELECT *, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS key FROM l),
n AS (SELECT greatest(5, ceil(count(DISTINCT coalesce(source, chr(0) || 'null')) / 2)) AS half FROM k WHERE length(key) > 0),
b AS (SELECT key, min(doc_id) AS first FROM k, n WHERE length(key) > 0 GROUP BY key, half HAVING count(DISTINCT coalesce(source, chr(0) || 'null')) >=
  CASE WHEN length(key) - length(replace(key, ' ', '')) < 2 AND strlen(key) < 16 THEN half ELSE 5 END),
m AS (SELECT k.*, b.first IS NOT NULL AND doc_id <> b.first AS gone FROM k LEFT JOIN b USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  length(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS n_chars,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM m GROUP BY doc_id"""

_JOIN_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS shingle FROM w),
n AS (SELECT w.doc_id, count(shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.a, r.root FROM r JOIN l ON l.b = r.node)
SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id FROM r JOIN n ON n.doc_id = node GROUP BY 1, 2"""

_DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS whole FROM t GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 3),
v AS (SELECT lang, count(*) AS v, sum(whole) AS n FROM k GROUP BY 1),
o AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
n AS (SELECT lang, source, sum(c) AS n FROM o GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, (1 + 1000000000 * (coalesce(o.c, 0) + 1)::HUGEINT // (coalesce(n.n, 0) + v.v))::BIGINT AS p,
  (1 + 1000000000 * (whole + 1)::HUGEINT // (v.n + v.v))::BIGINT AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN o USING (lang, source, term) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 3),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= 200"""

_NEGATIVES_SQL = r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s WHERE alike QUALIFY place <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.vec_id)::INT AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.r = s.r AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10"""

_NEAR_VECTORS_SQL = r"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
v AS (SELECT * FROM e WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND list_cosine_similarity(a.v, b.v) >= 0.98),
t(node, root) AS (SELECT r, vec_id FROM e UNION SELECT l.a, t.root FROM t JOIN l ON l.b = t.node),
c AS (SELECT node, min(root) AS component_id FROM t GROUP BY 1),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM e JOIN c ON c.node = e.r LEFT JOIN n ON n.a = e.r"""

#: Languages, main texts, tokens, fingerprints, quality and toxicity have no SQL: they are tested against plain Python.
ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": _CHAT_SQL,
    "op5_source_mixing": _MIX_SQL,
    "op8_line_dedup": _LINES_SQL,
    "op10_ngram_join": _JOIN_SQL,
    "op11_hard_negatives": _NEGATIVES_SQL,
    "op12_embedding_dedup": _NEAR_VECTORS_SQL,
    "op13_source_divergence": _DIVERGENCE_SQL,
}
