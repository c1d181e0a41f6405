"""A training corpus in five stages, each an operator of quillgraph.llm on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read back for the next one. All
but the last return the columns of documents, others that docs may have are left out, and so no name can clash. Rows
that a stage keeps are whole, however long; a stage that filters reads its decisions by doc_id, so rows that repeat an
id, and those with a null one, share a decision: they stay if one of them would. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.bayes_dedup import near_duplicates
from quillgraph.llm.common import discard, materialise
from quillgraph.llm.langid import UNKNOWN, fit, measure
from quillgraph.llm.mixing import mix
from quillgraph.llm.packing import pack
from quillgraph.llm.weak_quality import score_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5


def _kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs whose id is among those decided; null ids are kept if a null is."""
    docs, ids = docs.select(*COLUMNS), materialise(decided.select("doc_id"))  # read twice
    known = docs.join(ids.where("doc_id is not null").distinct(), "doc_id", "left_semi")
    null = ids.where("doc_id is null").limit(1).select(F.lit(True).alias("_null"))  # one row at most
    return known.union(docs.where("doc_id is null").join(F.broadcast(null), F.col("_null"), "left_semi"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained scorer takes for good, those on its cut too; null, empty and blank texts go."""
    return _kept(docs, score_quality(docs).where("keep"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those of no letters or without one of at least LEAST_SCORE go, and those that have
    less than half the share of known words, or half the margin per word over the second language, of the median row
    that is labelled and found to be of that language. A score alone says nothing of long texts: it grows with them.
    Null and empty texts go, a null label is only not learned from, and rows on a bound stay; without any label there is
    no language, so all go.
    """
    found = materialise(measure(docs, fit(docs)))
    usual = found.where("lang = lang_pred").groupBy("lang_pred").agg(F.percentile_approx("known", 0.5).alias("_known"), F.percentile_approx("margin", 0.5).alias("_margin"))
    sure = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).join(F.broadcast(usual), "lang_pred")
    return _kept(docs, sure.where("2 * known >= _known and 2 * margin >= _margin"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words a shingle, similarity 0.8), the one of smallest id.

    Rows that repeat an id are one document, of which the least row stays, by text, language, source and size; texts
    that are null, empty or without an id are near nothing and stay, each row of them without an id.
    """
    docs, ids = docs.select(*COLUMNS), materialise(near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct())
    known = docs.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("_row")).select("doc_id", "_row.*")
    return known.union(docs.where("doc_id is null"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated by Poisson counts, so that sources share the bytes by the square roots of theirs.

    A null source is a source of its own; one whose texts are all null or empty has no copies. Rows that repeat an id
    share a count, and copies of a document are rows of the same id.
    """
    return mix(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens: each row is packed, whatever its id; a null or empty text
    is its closing id alone."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("language ID", language), ("MinHash near-dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: The trained scorers and the tokenizer are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each result is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs, before = materialise(stage(spark, docs, sf_dir)), docs
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
