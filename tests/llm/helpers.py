"""Small tables with the awkward rows that every operator must take."""

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, length string"


def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with clashing names."""
    long = "the quick brown fox jumps over the lazy dog and runs away from it.\n" * 3000
    rows = [
        (1, "The cat sat on the mat and looked at the dog for a while, then it went home.\nNext line here.", "en", "a", 10, "x", "y"),
        (2, None, "en", "a", None, None, None),
        (3, "", None, None, 0, "x", "y"),
        (4, " \n\t ", "de", "b", 4, "x", "y"),
        (5, long, "en", "a", len(long), "x", "y"),
        (6, "Eine kleine Katze saß auf der Matte und sah den Hund an.", "de", None, 5, "x", "y"),
        (7, "The cat sat on the mat and looked at the dog for a while, then it went home.\nNext line here.", "en", "a", 10, "x", "y"),
        (8, "日本語 текст 🙂   <|endoftext|> x", "en", "b", 5, "x", "y"),
        (8, "日本語 текст 🙂   <|endoftext|> x", "en", "b", 5, "x", "y"),
        (None, "no id here", "en", "b", 5, "x", "y"),
    ]
    return spark.createDataFrame(rows, DOCS)
