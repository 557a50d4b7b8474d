"""Small inputs that every operator has to take: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "Word " * 40), (5, "Word " * 40), (6, "déjà vu, naïve — ½ 字 \U0001f600 ok. " * 30), (None, "a text without an id, twice"),
    (None, "a text without an id, twice"), (7, "x" * 5000), (-3, "a,b.c ;d\x00e\x1cf  g\n\nh"), (8, "long " + "line of words that go on and on, " * 3000),
]
SCHEMA = "doc_id long, text string"
#: Names the operators use inside themselves.
CLASHES = ["text_hash", "class", "key", "component", "score", "spans", "words", "start", "end", "ids", "target", "n", "lang_pred", "parts", "sequence_id"]


def odd(spark, rows=ODD):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("extra") for c in CLASHES})


def empty(spark):
    return odd(spark, []).limit(0)


def some_docs(duck, n=120):
    return duck.sql(f"SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT {n}").fetchall()
