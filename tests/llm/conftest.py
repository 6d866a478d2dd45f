import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with hard cases beside the smallest table, and clashing extra columns."""
    import random

    rng = random.Random(5)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "n_chars").collect()]
    long = " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "é", "x1"]) + str(rng.randrange(5000)) for _ in range(20000))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    base = max((r[1] for r in rows if 1500 < len(r[1]) < 2500), key=len)
    rows += [
        (None, None, None, None), (900001, None, "en", None), (900002, "", "en", 0), (900003, " \n\t ", None, 4),
        (900004, long, "en", len(long)), (900005, base, "en", 1), (900005, base, "en", 1), (900006, base + " tail", "en", 1),
        (None, base, "en", 1), (900007, "intro words here. " + item + " outro", "en", 1), (900008, "a" * 5000, "en", 1),
        (900009, "ab" * 700 + "é" * 300, "fr", 1), (900009, "another text under the same id", "fr", 1), (900010, "one", "en", 3),
        (900011, "<|endoftext|> ΣΑΣ 日本語 \x1c x", "en", 1),
    ]
    schema = "doc_id long, text string, lang string, n_chars long"
    df = spark.createDataFrame(rows, schema).repartition(5)
    from pyspark.sql import functions as F

    for name in ("fp", "hits", "cuts", "verdict", "text_key", "gram", "n", "ids", "__own"):
        df = df.withColumn(name, F.lit(7))
    path = f"{spark.conf.get('spark.sql.warehouse.dir').removeprefix('file:')}/llm-corpus"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus.where("false")
