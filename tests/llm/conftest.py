import random

import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType()),
                    # names that the operators use themselves
                    T.StructField("block", T.StringType()), T.StructField("n_words", T.StringType()),
                    T.StructField("k", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("r", T.LongType())])


def words(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


VOCABULARY = ["".join(random.Random(i).choice("abcdefghiklmnoprstuvé") for _ in range(2 + i % 7)) for i in range(600)]


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, odd white space, nulls and repeated rows."""
    rng = random.Random(7)
    passage = words(rng, 60)
    base = [words(rng, rng.randint(30, 200)) for _ in range(12)]
    texts = list(base)
    texts += [base[0], base[0], base[1].upper()]
    for k in range(2, 8):  # near copies
        w = base[k].split(" ")
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [words(rng, 20) + " " + passage + "\n\t" + words(rng, 25), passage, "x " + passage.replace(" ", "  "), None, "", " \n\t ",
              "one", "One", "two words", "two words", "three more words", words(rng, 13), "é ü " * 30, "a " * 500, words(rng, 6000),
              "mixed 漢字 😀 <|endoftext|> it's  \x00 end"]
    out = [(i * 3, t, ["en", "de", None][i % 3], "s", len(t or ""), "b", "w", i, "z", 1) for i, t in enumerate(texts)]
    out.append(out[5])  # a repeated row
    out.append((None, base[3], "en", "s", 1, None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOC).repartition(3)
    path = spark.conf.get("spark.checkpoint.dir") + "/llm-fixture"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
