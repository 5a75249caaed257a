"""Small awkward tables: nulls, empty and long texts, repeated rows, ties, clashing extra columns."""

from __future__ import annotations

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{k % 977} lorem{k % 13}" for k in range(30000))
PASSAGE = "the quick brown fox jumps over the lazy dog while forty two bright lanterns sway above the quiet harbour " * 3
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta.", "en", "a"),
    (1, "Alpha beta gamma delta epsilon zeta.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (4, "123 -- 456 !!", "de", "b"),
    (5, "password = \"abc123def\" and api_key: zz99yy88 here", "en", None),
    (6, PASSAGE + "unique ending one", "fr", "c"),
    (7, "another start " + PASSAGE, None, "c"),
    (8, LONG, "en", "a"),
    (None, "a row without an id éàü ß 日本語", "fr", "a"),
    (9, "Él niño está aquí y la casa es grande", "es", "c"),
    (10, "Der Hund läuft über die Straße und bellt", "de", "c"),
]
#: Names that operators use inside or add.
CLASH = ["size", "copies", "score", "row", "id", "fp", "component", "Key", "lang_pred", "_score", "a.b", "parts"]


def messy(spark, clash: bool = True):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("bigint"))
    for name in CLASH if clash else []:
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark, clash: bool = True):
    return messy(spark, clash).limit(0)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
