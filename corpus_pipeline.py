"""The corpus pipeline: from raw documents to token ids, each stage one operator over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import language_id, minhash, mixing, sentence_pieces, substrings
from tidewire.llm.common import WORD, Staged, few, table, whole_row


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of no learned language go: those without a letter (null and empty ones too), and those of whose 3-grams the
    model knows too few, whatever their length. Repeated rows and rows of one id are judged each by its text."""
    model = language_id.train(docs)
    named = language_id.predict(docs, model, passing=True, out=("__lang", "__score"), learned="__learned")
    return named.where((F.col("__lang") != language_id.UNKNOWN) & F.col("__learned")).select(*docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__key``: the id of a row that has one to itself, a hash of the whole row, nulls and all, otherwise.

    Such hashes have 64 bits: of n rows that share ids or have none, two different ones get one with a chance of n^2 / 2^65.
    """
    alone = F.col("doc_id").isNotNull() & F.col("__shared").isNull()
    shared = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("__shared"))
    rows = docs.join(few(shared), "doc_id", "left").select(*docs.columns, "__shared")
    whole = F.xxhash64(*whole_row(docs.columns))
    return rows.select(*docs.columns, alone.alias("__alone"), F.when(alone, F.col("doc_id")).otherwise(whole).alias("__key"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row of the smallest key stays, once.

    Rows are told apart by ``keyed``, so different texts of one id, or without an id, are documents of their own;
    rows that are equal in every column are one. Texts without words are in no class and stay.
    """
    rows = keyed(docs)
    gone = few(minhash.near_duplicates(rows, key="__key").where(~F.col("kept")).select(F.col("id").alias("__key")).distinct())
    rows = rows.join(gone, "__key", "left_anti")
    return rows.where("__alone").select(*docs.columns).unionByName(rows.where("not __alone").dropDuplicates(["__key"]).select(*docs.columns))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier row (by key, see ``keyed``) holds are cut out; texts of which no word is left go.

    Null texts and texts without a word have nothing left and go, too. n_chars becomes that of the new text.
    """
    rows = keyed(docs)
    spans = substrings.repeated_passages(rows, key="__key")
    rest = substrings.without_spans(rows, spans, key="__key")
    rest = rest.where(F.col("text").rlike(WORD))
    return rest.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in shards that are shuffled. Null and empty texts count no words; rows
    that are equal in every column are one, rows that share an id are not."""
    return mixing.mix(docs).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether they decode to it again; null and empty texts have no ids, equal rows equal ones."""
    model = sentence_pieces.model_bytes()
    coded = sentence_pieces.encode(docs, model, check="round_trip")
    return coded.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again by the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        staged = Staged(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        docs, before = staged.df, staged
    return docs
