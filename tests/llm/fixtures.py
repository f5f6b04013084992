"""Small inputs with the hard cases, and the driver's smallest tables."""

import random

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("kind", T.StringType())])

WORDS = "the of and to in is that it for was on are as with his they at be this from or had by hot word but what some we can".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", "s", "ed", "ing", ".\n", ","]) for _ in range(n))


def documents(spark):
    """Null and empty texts, nulls in all columns, ties, repeated rows, a very long text, and columns with names that clash."""
    base = prose(1, 300)
    words = base.split(" ")
    near = " ".join([*words[:100], "changed", *words[101:]])
    texts = [None, "", " \t\n", "one", "one ", "a b c d e", base, base, base.replace(" ", "\n"), near, prose(2, 120) + " " + " ".join(words[20:80]), prose(3, 200), "é ü 日本語 テスト 🙂 " * 20, prose(4, 20000), "x" * 50000, "\n".join(["same", "three", "lines"] * 5), "A B C D E f", " ".join(words[:40] * 3)]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}" if i % 4 else None, len(t) if t else None, "k", i, None) for i, t in enumerate(texts)]
    rows += [rows[6], rows[9], (None, "lost words here", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
