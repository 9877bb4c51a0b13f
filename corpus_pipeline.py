"""A training-corpus pipeline over ``documents``: five stages, each on all that its predecessor kept.

    toxicity           documents that score as toxic go
    quality rules      documents that the cascade rejects go
    n-gram Jaccard     of each class of near-duplicates the document of the least id stays
    mixing             sources are mixed to their target weights: a row per document and pass, its
                       text the words taken
    byte-level BPE     every row of the mix is encoded, and decoded again

The first four return the columns of ``documents``.  A stage leaves the session with Arrow batches of 8 MB at most, unless
it names a size of its own: of Spark's usual 64 MB, a task holds several copies in the JVM and in Python.

Defined cases: null or empty texts score as a text without terms and fail the quality rules, so they go there;
a null or repeated id is a row like any other until the Jaccard stage, where rows of one id count as
one document; a null source is a source of its own, last in order; other columns, whatever their
names, pass through the first four stages unchanged; a very long text is worked on whole, by one task;
an empty ``documents`` or ``labels`` gives an empty result or a constant toxicity score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shardwright.llm import mixing, parity_join, quality, toxicity
from shardwright.llm.common import stored
from shardwright.llm.queries import bpe_digests
from shardwright.session import keep_batches_small

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def lean(stage: Stage) -> Stage:
    """The stage in small Arrow batches; its rows are made later, when the caller asks for them, so the setting stays."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        keep_batches_small(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxic_filter(docs, machine)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return parity_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", lean(clean)),
    ("quality rules", lean(good)),
    ("n-gram Jaccard join", lean(distinct)),
    ("mixing sources to target weights", lean(mix)),
    ("byte-level BPE encoding and decoding", lean(tokens)),
]

#: The fitted machine, the drawn mix and BPE have no SQL form; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
