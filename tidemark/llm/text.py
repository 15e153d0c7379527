"""Words, row keys and Arrow plumbing shared by the operators of this package."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lower-cases A-Z; every byte that is not a digit, a letter or part of a multi-byte character becomes a space.
#: On UTF-8 bytes, splitting the result gives the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: The same pattern for the JVM, after lower-casing A-Z.
FOLDED_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLAIN_WORD = r"[^\x20\x09-\x0D]+"


def folded_words(text: bytes) -> list[bytes]:
    """Lower-cased letter and digit runs."""
    return text.translate(FOLD).split()


def plain_words(text: bytes) -> list[bytes]:
    """Runs without white space (space and 0x09 to 0x0D, which is what splitting bytes means)."""
    return text.split()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column, empty for null."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def type_of(df: DataFrame, column: str) -> str:
    """The SQL type of a column, for output schemas that carry it along."""
    return df.schema[column].dataType.simpleString()


def drop_rows(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of ``docs`` without those whose (doc_id, text) is in ``rejected`` (``doc_id``, ``text_key``).

    Nulls compare equal. Spark broadcasts ``rejected`` where its measured size allows it.
    """
    key = rejected.select(F.col("doc_id").alias("_rejected_id"), F.col("text_key").alias("_rejected_key"))
    same = docs["doc_id"].eqNullSafe(key["_rejected_id"]) & text_key(docs["text"]).eqNullSafe(key["_rejected_key"])
    return docs.join(key, same, "left_anti")


def with_texts(manifest: DataFrame, docs: DataFrame, text_md5: str) -> DataFrame:
    """Rows of a manifest (``doc_id``, the md5 of the text, ...) with the ``_text`` of that document.

    Both sides are keyed by columns that are never null, so that the texts are shuffled once: to be made
    distinct, and in the same partitions to be joined.
    """
    def keyed(df: DataFrame, md5: Column) -> DataFrame:
        return df.withColumns({"_id_key": F.to_json(F.struct(df["doc_id"].alias("id"))), "_text_key": F.coalesce(md5, F.lit(""))})

    texts = keyed(docs, F.md5(docs["text"])).groupBy("_id_key", "_text_key").agg(F.first(docs["text"]).alias("_text"))
    return keyed(manifest, manifest[text_md5]).join(texts, ["_id_key", "_text_key"]).drop("_id_key", "_text_key")


def text_key(text: Column) -> Column:
    """64 bits that, together with the document's id, name a text; null for null."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def word_count(text: Column) -> Column:
    """Words between white space (space and 0x09 to 0x0D), without a regular expression; 0 for null."""
    spaced = F.coalesce(text, F.lit(""))
    for blank in ("\t", "\n", "\x0b", "\f", "\r"):
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("bigint")
