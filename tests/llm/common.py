from gridloom.llm import entry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, fingerprint int"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa\n" * 20000
ROWS = [
    (1, "The cat sat on the mat and looked at the moon above.\nReleased under the MIT License.", "en"),
    (1, "The cat sat on the mat and looked at the moon above.\nReleased under the MIT License.", "en"),
    (2, None, "en"), (3, "", None), (4, "   \n\t ", "de"), (5, "1234 !!", "fr"), (None, "Ein Satz ohne Nummer und ohne Ziel steht hier.", "de"),
    (6, LONG, "en"), (7, "é漢🙂 mixed <|endoftext|> text", "fr"), (8, "The cat sat on the mat and looked at the moon above.\nAll rights reserved.", "en"),
]


def odd_docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", 1) for i, t, lang in rows], SCHEMA)


def run(name, spark, sf_dir):
    return entry.QUERIES[name](spark, sf_dir)
