"""From raw documents to token ids: five stages, each written and read again before the next.

Documents whose language is not recognised go, then exact copies, then near copies (one of each
group stays), then documents that share a window with the benchmark. What is left is encoded.
"""

from pyspark.sql import DataFrame, SparkSession

from skilltide.llm.bpe import digests
from skilltide.llm.decontaminate import without_contaminated
from skilltide.llm.exact import without_copies
from skilltide.llm.jaccard import without_near_copies
from skilltide.llm.langid import in_known_language
from skilltide.llm.queries import QUERIES, read, vocabulary_path
from skilltide.storage import settle


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_known_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests(docs, vocabulary_path())


STAGES = [
    ("language", language),
    ("exact_copies", exact),
    ("near_copies", near),
    ("decontamination", decontaminate),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


# language ID and the tokenizer are no SQL; tests/llm compare with brute force
ORACLE_SQL = None

QUERIES["pipeline"] = run
