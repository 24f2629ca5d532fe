"""Small tables that have every odd case, for all operators."""

import pandas as pd


def documents(spark, rows, extra=True):
    """Rows ``(doc_id, text)`` or ``(doc_id, text, lang, source)`` as documents, with columns whose names clash."""
    full = [(i, t, *(r or ["en", "src0"])) for i, t, *r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
    if extra:
        for name in ("key", "n", "label", "score", "fp", "sha", "bucket", "start", "end", "value", "root", "rank", "budget", "h", "y"):
            df = df.selectExpr("*", f"'clash' as `{name}`")
    return df


ODD = [
    (5, None), (3, ""), (4, "   \n\t "), (7, "one two three four five six"), (8, "one two three four five six"), (9, "one  two three\nfour five six"),
    (9, "one  two three\nfour five six"), (None, "a row without an id"), (11, "one"), (12, "word " * 30000), (13, "Ünïcode 日本語 \U0001f600 text"), (14, "\x00 nul and \x1c odd spaces"),
]


def frame(df) -> pd.DataFrame:
    return df.toPandas()
