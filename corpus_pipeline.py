"""From raw documents to encoded ones, in stages that each apply one operator to all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import bpe, language_id, line_dedup, mixing, ngram_join
from galley.llm.queries import tokenizer_file
from galley.sources.tables import materialise, table

#: No SQL: language scores, hashes of offsets and the tokenizer have none. The stages are tested against plain Python.
ORACLE_SQL = None

#: A text in which no language has this share of the letters is of none.
LEAST_SHARE = 0.4


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language, with lang as predicted; those without a letter or a leading language go."""
    model = language_id.fit(docs)
    got = language_id.identify(docs, model, with_spans=False)
    kept = got.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return kept.select(*[F.col("lang_pred").alias("lang") if c == "lang" else c for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; a document that consisted of nothing else goes with them."""
    got = line_dedup.without_boilerplate(docs)
    text = F.col("line_dedup")["text"]
    emptied = (F.col("line_dedup")["n_removed"] > 0) & ~F.rlike(text, F.lit(r"[^\x20\x09-\x0D]"))
    return got.filter(~F.coalesce(emptied, F.lit(False))).select(
        *[
            (text if c == "text" else F.length(text).cast("long") if c == "n_chars" else F.col(c)).alias(c)
            for c in docs.columns
        ]
    )


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % or more of their five-word shingles, by links, the one with the smallest doc_id."""
    return ngram_join.one_of_each(docs, width=5, percent=80).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document once for each copy that the mix takes."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded of each copy."""
    got = bpe.encode_documents(docs, tokenizer_file())
    return got.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language ID", keep_languages),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("source mixing", mix_sources),
    ("BPE encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to shared storage and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
