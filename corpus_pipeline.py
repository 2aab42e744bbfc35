"""Cleaning a corpus in five stages, each an operator of leafmill.llm over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import linededup, mixing, pieces, quality, setjoin
from leafmill.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base tests or a learned rule reject go.

    Null and empty texts have no words and go. Repeated rows are judged alike, each by itself. Labels that are null, or of no
    document, aren't learned from; of an id with several labels the smallest counts; without labels the base tests alone hold. Empty
    tables give empty ones; working columns have names of their own, so other columns may have any."""
    return quality.keep(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many documents of a source have go; no document goes.

    Documents with a null source are one source. A null text stays null and counts as a document; a document that loses all lines
    stays, with an empty text. n_chars is counted anew, null for a null text. Repeated rows are documents of their own."""
    return linededup.drop_boilerplate(docs.select(*COLUMNS), "text", "source").withColumn("n_chars", F.length("text").cast("long"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or more, the one with the smallest id stays.

    Null and empty texts are linked with nothing and stay, as do rows without an id. Rows of one id are one document, of which
    the first by text, then by the other columns, stays."""
    return setjoin.representatives(docs.select(*COLUMNS), words=5, percent=80).select(*COLUMNS)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources come near their targets.

    A null source is one source. Texts without words have no size and are never taken. Rows of one id and size are in order of
    their columns, so reruns agree; an empty table gives an empty one."""
    return mixing.emit(mixing.mix(docs.select(*COLUMNS)), list(COLUMNS))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled pieces of each document, and as text what they decode to, which is the document's text again.

    A null text stays null and has no pieces, an empty one has none. Rows of one id and text get equal pieces, for the id is the seed;
    a null id is a seed, too."""
    return pieces.roundtrip(docs.select(*COLUMNS))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources", mixing_weights),
    ("SentencePiece pieces", piece_ids),
]

#: The learned rules and the sampled segmentations have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
