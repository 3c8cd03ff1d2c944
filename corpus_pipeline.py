"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing, SentencePiece.

Each stage works on all that its predecessor kept and returns the columns of documents, the last
one token ids. run() writes every stage to the folder that spark.checkpoint.dir names and reads it
again, so a lost executor costs no more than a stage's task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import hyperminhash, line_templates, mixing, rule_ledger, wfst
from tessera.llm.common import remove, shared_folder, table
from tessera.llm.queries import vocabulary

#: SQL has neither the template tree nor the tokenizer.
ORACLE_SQL = None


def _rest(docs: DataFrame, *own: str) -> Column:
    """The columns that a stage doesn't work on, out of reach of the operator's names."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return (F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))).alias("rest")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of policy web.v2 go.

    Null and empty texts have no words and go; a null id or another null doesn't matter; repeated
    rows are judged each for itself; texts of any length are judged whole; an empty table stays
    empty; columns keep their names and values, whatever they are called.
    """
    judged = rule_ledger.ledger(docs.select("text", _rest(docs, "text")))
    kept = judged.filter(rule_ledger.apply_policy(judged, "web.v2"))
    return kept.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, and documents of which no word is left by that.

    n_chars, if there is such a column, follows the text. Null texts stay null; repeated rows of an
    id and text count as one document and are treated alike; a null id comes last in the order; an
    empty table stays empty; other columns keep their names and values.
    """
    less = line_templates.drop_recurring(docs.select("doc_id", "text", _rest(docs, "doc_id", "text", "n_chars")))
    empty = F.length(F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " "))) == 0
    less = less.filter((F.col("n_dropped") == 0) | ~empty)
    now = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return less.select(*[now[c] if c in now else F.col("rest").getField(c).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the least id stays.

    Documents without words, and rows without an id, stay; rows that repeat the id that stays do,
    too; an empty table stays empty; columns keep their names and values.
    """
    return hyperminhash.drop_near_duplicates(docs, size=5, percent=80).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, each copy with the columns it had.

    A null source is a source of its own; null and empty texts have no words and stay once for each
    complete epoch; an empty table stays empty.
    """
    return mixing.mixed_documents(docs).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, n_byte_tokens, round_trip, a row a document.

    Null and empty texts have no ids; an empty table gives no rows; other columns don't matter.
    """
    return wfst.encode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written goes when the next one has been written."""
    docs, top, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before is not None:
            remove(spark, before)
        before = f"{top}/{name}"
    return docs
