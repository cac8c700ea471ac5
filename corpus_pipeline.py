"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; all but the last return the
columns of ``documents``. The stages are written as Parquet to the shared folder in between.

Of all stages: an empty table gives an empty one; further columns, whatever their names, are left out; texts are worked on whole, however long;
tests/llm holds the cases and a brute-force version of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import kept, shared_folder, table
from quarrylens.llm.decontaminate import decontaminate
from quarrylens.llm.jaccard_join import keep_one
from quarrylens.llm.mixing import mixed
from quarrylens.llm.quality_classifier import classify
from quarrylens.llm.token_files import read_tokens, write_tokens

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if it is more likely bad than good.
LEAST_GOOD = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the classifier rejects go.

    Null and empty texts are judged by statistics of 0, null sources and languages are sites of their own. Repeated rows are judged alike. At
    exactly ``LEAST_GOOD`` a document stays. Without labels of both kinds nothing is rejected (unless all labels are bad).
    """
    return classify(docs, table(spark, sf_dir, "labels"), keep=COLUMNS).filter(F.col("p_good") >= LEAST_GOOD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of near copies stays: that of the least id, null ids last; of equal ids that of the least hash of its text.

    Null texts and those without words are copies of nothing and stay, but equal rows (id and text; a null text is as an empty one) count once.
    """
    return keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: benchmark passages are cut out of the texts; a document of nothing else goes.

    A text without a passage is passed on as it is, null included. Repeated rows are cut alike; overlapping passages are cut as one. An empty
    benchmark, and items without words, cut nothing.
    """
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    out = out.filter((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words")))
    hit = F.col("n_hit") > 0
    return out.select("doc_id", F.when(hit, F.col("clean_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(hit, F.length("clean_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents in target shares of their sources, up to twice each.

    Null and wordless texts have size 0 and are never taken; a null source is the last. Equal rows share their copies; ties in the shuffle go by id
    and size. A document is taken whole, if its middle lies before its source's line.
    """
    return mixed(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: token-id files; returned is what reading them back gives.

    Null and empty texts have the end id alone. Null ids come first; rows of equal ids lie in the order of a hash of their texts.
    """
    return read_tokens(spark, write_tokens(docs, shared_folder(spark, "corpus-tokens")))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: A fitted classifier and a tokenizer are beyond SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = kept(stage(spark, docs, sf_dir), folder, f"{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
