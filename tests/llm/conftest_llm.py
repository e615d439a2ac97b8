"""Small tables for the tests of this folder."""


def documents(spark, rows, extra=True):
    """A documents table of (doc_id, text, lang, source) rows, with columns whose
    names clash with those that operators add."""
    full = [(i, t, lang, src, len(t or ""), "x", 1, "y") for i, t, lang, src in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, "
                                     "size string, n int, toxic_score string")
    return df if extra else df.drop("size", "n", "toxic_score")
