"""Training-data pipeline over documents: five stages, each written as Parquet and reread by the next.

toxicity, exact dedup, n-gram Jaccard join, benchmark decontamination and SentencePiece encoding, in this
order. Each stage judges all that its predecessor kept; the first four return the columns of documents,
the last doc_id and ids.

Rows are judged by their text, so null ids and ids that several rows share make no difference: a row goes
for its own text alone, and of rows that agree in id and text, as of other copies, one stays. Null and
empty texts are equal to the exact dedup, hold no item, link with nothing and have no ids. Without labels no row is toxic,
without benchmark items none is contaminated, and without documents the result is empty. Columns of documents pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terradrift.llm import decontaminate, exact_dedup, ngram_join, sentencepiece_lattice, toxicity
from terradrift.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are toxic more likely than not; the model is fitted on the labelled ones."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest doc_id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more, that with the smallest doc_id."""
    return ngram_join.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold four fifths or more of a benchmark item's shingles."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and ids of the pieces of every whole text."""
    import public_tokenizers

    return sentencepiece_lattice.encode(docs, sentencepiece_lattice.PieceTable.load(public_tokenizers.path("piece_bpe_32k.model"), "bpe"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode),
]

#: SQL can express neither the fitted model of the first stage nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, with their results in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
