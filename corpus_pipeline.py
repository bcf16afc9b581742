"""From raw documents to packed training sequences.

Each stage is (spark, docs, sf_dir) -> DataFrame. All but the last return the
columns of ``documents``; the last returns pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstride.llm import decontam, langid, lines, packing, simhash
from gridstride.llm.common import durable, table
from gridstride.llm.queries import language_model, tokenizer_file


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and one clearly nearest language. Languages are learnt from ``docs``."""
    found = langid.identify(docs.select(F.struct(*docs.columns).alias("row"), "text"), language_model(docs))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")).select("row.*")


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that nearly repeat an earlier one; a document that loses all its words goes. ``n_chars`` follows the text."""
    done = lines.deduplicate(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    done = done.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    chars = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("text").cast("long"))
    new = {"text": F.col("text"), "n_chars": chars}
    return done.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the document of the smallest id, nulls last, once."""
    return simhash.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("language_id", known_language), ("line_dedup", distinct_lines), ("near_dedup", one_of_each), ("decontamination", uncontaminated), ("packing", pack)]

#: Learnt languages, reachability and merging tokens have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)  # several passes of the next stage read it
    return docs
