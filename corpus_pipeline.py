"""A training corpus from raw documents in five stages.

Each stage takes what the one before kept, whole, and its decisions take effect: rejected documents go, repeated lines
go, one document of each group of near copies stays, sources are thinned to their target weights, and what is left is
encoded (and decoded again, to prove that nothing is lost).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.bpe import with_tokens
from ridgeline.llm.common import documents, materialize, table
from ridgeline.llm.lines import drop_repeated_lines
from ridgeline.llm.mixing import mix, word_count
from ridgeline.llm.quality import score, train
from ridgeline.llm.queries import MIX_SHARE, MIX_TEMPER, mixing_dims
from ridgeline.llm.shingles import keep_one_of_near

# The mixing stage ends its rounds when no probability moves by more than this, at the latest after so many rounds.
MIX_TOLERANCE, MIX_MOST_ROUNDS = 1e-3, 40

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts, as they were.

    Null and empty texts have a score like others; repeated rows are judged alike, and each stays or goes. Ties at the
    threshold stay. Without labels every document stays. An empty table gives an empty one. Other columns than those of
    documents are left out.
    """
    docs = docs.select(*DOCUMENT)
    return score(docs, train(docs, table(spark, sf_dir, "labels")), filtering=True)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that three documents or more share, but for the largest doc_id of each line.

    Every row stays; a null text stays null, with a null ``n_chars``, and a text that loses all its lines is empty.
    Rows with one id keep a line together; rows without id count as documents but own no line. An empty table gives an
    empty one.
    """
    kept = drop_repeated_lines(docs.select(*DOCUMENT), min_docs=3, min_chars=20)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that a chain of Jaccard similarities of 0.8 or more connects.

    Candidates come from SimHash tries, and from min-hash bands where the tries leave texts apart; similarities are exact.
    The smallest id stays, with all rows that have it; null, empty and blank texts are copies of each other; rows without
    id stay. Texts of any length are compared as a whole. An empty table gives an empty one.
    """
    return keep_one_of_near(docs.select(*DOCUMENT), words=5, limit=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that source, language and topic have their target weights, ``MIX_SHARE`` of all tokens.

    Null is a source or language like others; documents of cells without tokens stay. The draw is a hash of the id (of
    the text without id), so repeated rows stay or go together and every run draws alike. Cells that are wanted more
    than whole stay whole. An empty table gives an empty one.
    """
    words = word_count(F.col("text"))
    mixed = mix(docs.select(*DOCUMENT), mixing_dims(), words, temper=MIX_TEMPER, rounds=MIX_MOST_ROUNDS, share=MIX_SHARE, tolerance=MIX_TOLERANCE)
    return mixed.where("sampled").select(*DOCUMENT)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and whether decoding gives the text back.

    A row for each row; a null text counts as empty. Texts of any length are encoded whole. An empty table gives an empty
    one.
    """
    import public_tokenizers

    encoded = with_tokens(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.drop("text")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_copy_stage),
    ("mixing", mixing_stage),
    ("bpe", token_stage),
]

# A trained classifier cannot be written in SQL; tests compare the stages with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{place}")
    return docs
