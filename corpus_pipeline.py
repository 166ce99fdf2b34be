"""A training-corpus pipeline out of the operators of ``cohortlab.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.

Defined cases: null and blank texts fail the base rules and go in the first stage; given to a later stage alone, the
classifier rejects them, the join keeps each as a class of its own, mixing counts them as one token and encoding gives no
ids. A null doc_id is never held for another document's; rows that repeat are one class. Null languages and sources are
strata and sources of their own. Texts of any length are taken whole. Empty tables give empty results; other columns
travel along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import mixing, ngram_join, quality_rules, site_quality, tree_bpe
from cohortlab.llm._common import save, sieved, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return site_quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the least doc_id stays, one without doc_id only if no other has one.
    Rows are numbered when they are written, so that no hash or repeated id can take one document for another."""
    named = save(docs.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    found = ngram_join.near_duplicates(named, id_col="__id").select("__id", "class_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__id"))["__id"]
    firsts = save(named.select("doc_id", "__id").join(found, "__id").groupBy("class_id").agg(first.alias("__id")).select("__id"), "firsts")
    gone = save(named.select("__id").join(firsts.hint("merge"), "__id", "left_anti"), "gone")
    # most texts are known to stay by a sieve of those that go; the rest is merged with their list, which grows with the documents
    names = [F.col(f"`{c}`") for c in docs.columns]
    sifted = sieved(named, gone, ["__id"], "__maybe_gone")
    rest = sifted.where("__maybe_gone").join(gone.hint("merge"), "__id", "left_anti")
    return sifted.where("not __maybe_gone").select(*names).unionByName(rest.select(*names))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to the target weights; a document is there as often as its source's budget has it."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text of the mix is encoded and decoded."""
    return tree_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("n-gram Jaccard join", one_of_each), ("mixing sources to target weights", mix), ("BPE encoding and decoding", encode)]

#: No SQL says what the classifier and the tokenizer do; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(docs, f"stage-{i + 1}")
    return docs
