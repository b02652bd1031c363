"""Documents with every awkward case: nulls, empties, very long texts, ties, repeated rows and clashing column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
COPY = " ".join(f"copy{i}" for i in range(60))
NEAR = COPY.replace("copy59", "other")
CLASH = "score double, lang_pred string, gid long, component long, node long, _text string, _key string, bucket long, rank int, n_tokens long, slot int, digest string, rep long, terms string, batch int, size int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows() -> list[tuple]:
    texts = [
        (0, None, None), (1, "", "en"), (2, " \t\n", "en"), (3, LONG, "en"), (4, COPY, "en"), (5, COPY, "fr"), (6, NEAR, None), (7, "one two", "en"), (8, "ONE two", "en"), (8, "ONE two", "en"),
        (9, "a@b.c_d@e.f and +1 (555) 010-2345, 10.0.0.255 1.2.3.4.5.6.7.8 or 256.1.1.1; 4111 1111 1111 1111!", "en"), (10, "1" * 5000, None), (11, "x" * 50_000 + "." * 50_000, None), (12, "a@" + "b.c" * 3000, "en"),
        (13, "The the é <|endoftext|>    \U0001f600 <|im_end|>\\<\\|", "fr"), (None, COPY, "en"), (14, "12345 !!! ???", "en"),
    ]
    return [(i, t, lang, "s", len(t) if t is not None else None) for i, t, lang in texts]


def documents(spark: SparkSession, clash: bool = False) -> DataFrame:
    df = spark.createDataFrame(rows(), DOCS).repartition(3)
    if clash:
        for c in CLASH.split(", "):
            name, kind = c.split()
            df = df.selectExpr("*", f"CAST(NULL AS {kind}) AS {name}")
    return df


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)
