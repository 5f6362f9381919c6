"""A corpus pipeline: toxic documents out, near copies out, personal data replaced, sources mixed, texts encoded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.bpe import encode_documents
from noticeloom.llm.common import WORD, cut, fresh, join_small, shared_folder, table
from noticeloom.llm.mixing import mixed_documents
from noticeloom.llm.neardup import near_duplicates
from noticeloom.llm.surrogates import pseudonymize
from noticeloom.llm.toxicity import train_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows of the folder's ``documents``, scores below one half.

    Each row is judged by its own whole text; a null or empty text has a score too, that of a text without any sign. Repeated rows, null
    ids and ids with several texts stay or go each by itself; other columns pass unchanged; an empty table gives none.
    """
    model = train_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = fresh(docs, "toxicity_score")
    return model.score(docs, name=name).where(F.col(name) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, before all one without an id.

    A row without an id is a document of its own, named by its text, of which equal ones stay once. Rows that share an id are one document,
    linked by any of their texts: they stay or go together, repeated ones too. Null and empty texts are like nothing else, and all stay.
    Other columns pass unchanged, even one named like what is added here; an empty table gives none.
    """
    own = fresh(docs, "near_id")
    named = docs.withColumn(own, F.coalesce(F.col("doc_id"), -1 - F.pmod(F.xxhash64("text"), F.lit(1 << 62))))
    gone = cut(near_duplicates(named, num=4, den=5, id_col=own).where("not kept").select(F.col("doc_id").alias(own)).distinct())
    left = join_small(named, gone, own, "left_anti")
    nameless = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    return left.where(~nameless).unionByName(left.where(nameless).dropDuplicates([own, "text"])).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with surrogates for personal data, and ``n_chars`` brought up to date.

    Equal entities get equal surrogates in all rows, repeated rows and null ids among them; a null text stays null, with a null
    length, an empty one empty. No row is added or lost; other columns pass unchanged; an empty table gives none.
    """
    return pseudonymize(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice.

    Decided by id: rows that share one, or have none, are taken alike. A null source is a source of its own; a null or empty text has
    no size and is taken like the others of its place. Other columns pass unchanged; an empty table gives none.
    """
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the tokens and of the decoded text, of every row.

    A null text counts as empty; repeated rows and null ids are encoded each; a very long text is encoded whole; other columns
    play no part; an empty table gives none.
    """
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("personal_data", replace_personal_data),
    ("source_mix", mix),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the encoder; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again.

    The stages' tables stay below ``corpus-pipeline-<id>`` of that folder, so that a run can be looked into or taken up again; whoever
    owns the folder clears them, as the last is read by the result.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
