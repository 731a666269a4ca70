"""Small tables with the awkward cases that every operator must take."""

LONG = "alpha beta gamma delta " * 4000 + "end"
PASSAGE = " ".join(f"passage{i}" for i in range(60))

AWKWARD = [
    (1, "Plain words here, and then some more of them.", "en", "a", 45),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n\x0b\x0c\r ", "en", None, 7),
    (5, "one", "en", "b", 3),
    (6, "Two words", "en", "b", 9),
    (7, LONG, "en", "a", len(LONG)),
    (8, "Plain words here, and then some more of them.", "en", "c", 45),
    (8, "Plain words here, and then some more of them.", "en", "c", 45),
    (9, "Grüße aus Köln 😀 – naïve café\nGrüße aus Köln 😀 – naïve café", "de", "a", 60),
    (10, f"intro words {PASSAGE} outro", "en", "a", None),
    (11, f"other start\n{PASSAGE}\nother end", "en", "b", None),
    (None, "a document without an id", "en", "a", 24),
    (12, "x" * 70000 + " y", "en", "a", 70002),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    """The cases above, with further columns whose names clash with ones the operators use inside."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(AWKWARD, SCHEMA)
    for name in ("fp", "row_key", "words", "n_words", "host", "bucket", "places", "start", "kept", "score", "spans", "count"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
