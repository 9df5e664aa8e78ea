"""Small tables for the corpus operators."""
import pandas as pd
import pyarrow.parquet as pq

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def real_texts():
    t = pq.read_table(f"{SMALL}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


def documents(spark, texts, **columns):
    """A documents table of (doc_id, text) rows; other columns can be given, and columns beyond them clash with results on purpose."""
    n = len(texts)
    rows = [(d, t, (columns.get("lang") or ["en"] * n)[i], (columns.get("source") or ["src0"] * n)[i], len(t) if t is not None else None)
            for i, (d, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in columns.get("clash", ()):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "a"), (903, "a"), (None, "no id at all"), (904, "x" * 30_000), (905, "été ß   İ K ſ 😀 end")]


def odd_and_real():
    return real_texts() + ODD


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def frame(df) -> pd.DataFrame:
    return df.toPandas()
