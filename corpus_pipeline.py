"""A training-data pipeline over `documents`: filter, deduplicate, decontaminate, redact, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
one's docs. All but the last return the columns of documents, and other columns that docs may have as they are.
For every stage: an empty table gives no rows, whole texts count, however long, and rows that repeat a doc_id
are judged each. Rows with a null doc_id or text go through: they are not toxic, no duplicates, not contaminated,
and are packed as the end token alone.
"""

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.common import read, scratch, stored
from quillgraph.llm.decontaminate import drop_contaminated
from quillgraph.llm.jaccard import first_of_each
from quillgraph.llm.packing import pack
from quillgraph.llm.secrets import redact_secrets
from quillgraph.llm.toxicity import drop_toxic, fit_chain


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go. Equal texts go together; without labels of both classes none goes."""
    return drop_toxic(docs, fit_chain(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 on five-word shingles, the smallest doc_id stays, with all its rows."""
    return first_of_each(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of a benchmark item's words with tiles go; without items none goes."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text give way to marks, and n_chars follows; no document goes, repeated rows all stay."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their place in sequences of 1024 tokens; repeated rows are packed each."""
    return pack(docs, capacity=1024)


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

#: Classifiers, redaction and packing are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that a stage makes for itself go when its result is written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
