"""Documents for the tests of the training-data operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, text_key string, runs int, lines int, size string, score string, member int"


def make_docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 7, "k", 1, 2, "big", "s", 3) for i, t, lang, s in rows], DOCS)


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]
