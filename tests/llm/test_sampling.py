"""Bounded samples and bounds that don't depend on tasks."""

from pyspark.sql import functions as F

from weftline.llm import language_model
from weftline.llm.sampling import first_by_hash


def test_samples_repeat_themselves(spark):
    df = spark.range(2000)
    pick = lambda d: [r.id for r in first_by_hash(d, 20, F.xxhash64("id"), "id").collect()]
    assert pick(df) == pick(df.repartition(9)) and len(pick(df)) == 20
    assert sorted(pick(spark.range(5))) == list(range(5)) and pick(df.limit(0)) == []
    smallest = sorted(df.select("id", F.shiftrightunsigned(F.xxhash64("id"), 1).alias("h")).collect(), key=lambda r: r.h)[:20]
    assert pick(df) == [r.id for r in smallest]


def test_most_frequent_words_are_over_one_count(spark):
    rows = [(bytes(f"w{i}", "ascii"), c) for i, c in enumerate([100, 90, 90, 5, 5, 5, 5, 1])]
    df = spark.createDataFrame(rows, "word binary, c long")
    assert [r["c"] for r in language_model.most_frequent(df, 4)] == [100, 90, 90]
    assert len(language_model.most_frequent(df, 100)) == 8 and language_model.most_frequent(df.limit(0), 5) == []
