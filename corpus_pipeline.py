"""The training-data pipeline: language ID, exact dedup, near dedup, PII surrogates, packing.

Every stage works on all that the stage before kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofline.llm.exact_dedup import exact_dedup
from proofline.llm.folds import fold
from proofline.llm.langid import fit, identify
from proofline.llm.minhash import near_dedup
from proofline.llm.packing import pack
from proofline.llm.pii import pii_surrogates
from proofline.llm.queries import KEY, tokenizer_file
from proofline.session import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None  # learnt language models, weighted samples, keyed surrogates and BPE tokens are beyond SQL


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; one without a letter, or unlike every learnt language, goes."""
    model = fit(docs.filter(fold(F.col("doc_id")) != 0))
    out = identify(docs.select(*COLUMNS), model, keep=("text", "lang", "source", "n_chars"))
    return out.filter("not rejected").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every text, one row of it; a NULL text counts as empty."""
    return _staying(docs, exact_dedup(docs, keep="smallest"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates, the one with the smallest id, and one row of it."""
    return _staying(docs, near_dedup(docs, digest=True))


BITS = 26  # of the hashes that tell which ids lose a row


def _staying(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """As many rows of each id and text as are marked as kept. Rows that repeat both are alike to an operator; of those that
    differ in another column the smallest stays.

    Ids that lose a row set a bit in a bitmap of 2^26 bits, of which at most 2^20 words of 64 bits are broadcast. Rows whose id's bit is
    not set pass as they are, and only the others are joined by id and digest, so that few texts move while few rows go.
    """
    counts = marked.groupBy(F.col("doc_id").alias("_gone"), F.unhex("text_sha256").alias("_sha")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("kept").alias("_stay"))
    less = cut(counts.filter("_stay < _n"), "less")
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITS))
    word, place = lambda c: F.shiftright(bit(c), 6), lambda c: F.expr(f"shiftleft(1L, cast(pmod(xxhash64({c}), 64) as int))")
    words = cut(less.groupBy(word("_gone").alias("_word")).agg(F.bit_or(place("_gone")).alias("_set")), "bits")
    docs = docs.select(*COLUMNS)
    told = docs.withColumn("_word", word("doc_id")).join(F.broadcast(words), "_word", "left")
    touched = F.coalesce(F.col("_set").bitwiseAND(place("doc_id")) != 0, F.lit(False))
    some_go = told.filter(touched).select(*COLUMNS)
    same = F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)) == F.col("_sha"))
    some = less.filter("_stay > 0")  # rows are repeated, and one of them stays
    row = F.struct("lang", "source", "n_chars", "text")
    once = some_go.join(some.hint("merge"), same).groupBy("doc_id", "_sha").agg(F.min(row).alias("_row")).select("doc_id", "_row.*").select(*COLUMNS)
    return told.filter(~touched).select(*COLUMNS).unionByName(some_go.join(less.hint("merge"), same, "left_anti")).unionByName(once)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; ``n_chars`` is that of the new text."""
    out = pii_surrogates(docs, KEY, keep=("lang", "source"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, with their ids."""
    return pack(docs, tokenizer_file("byte_bpe_50k.json"), window=1024, end_id=0)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("pii", pii), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
