"""Languages where the text leaves no doubt."""

from pyspark.sql import functions as F

from stratum.operators import language
from stratum.sources.tables import sources

D = "/root/testdata/sf0.01"


def test_the_sure_are_right(spark):
    s = sources(spark, D)
    found = language.sure_language(s, language.profiles(s.where("source_id % 2 = 0").select("language", "text")))
    held = found.join(s.select("source_id", F.col("language").alias("true")), "source_id").where("source_id % 2 = 1 and true is not null").toPandas()
    told = held[held.language.notna()]
    assert (told.language == told.true).mean() > 0.97 and len(told) > 0.8 * len(held)


def test_doubtful_texts_have_none(spark):
    known = language.profiles(spark.createDataFrame([("a", "aba abba baab " * 20), ("b", "xyx xyyx yxxy " * 20), (None, "zzz")], "language string, text string"))
    assert {r.language for r in known.collect()} == {"a", "b"}
    rows = [(1, "abba baab aba abba baab aba"), (2, "aba xyx abba xyyx baab yxxy aba xyx"), (3, "aba"), (4, None), (5, ""), (6, "12 34 !?"), (7, "XYX, Xyyx; yxxy xyx xyyx YXXY"), (8, "qqq www rrr ttt uuu iii ooo ppp")]
    got = {r.source_id: r.language for r in language.sure_language(spark.createDataFrame(rows, "source_id long, text string"), known).collect()}
    assert got == {1: "a", 2: None, 3: None, 4: None, 5: None, 6: None, 7: "b", 8: None}
    assert language.sure_language(spark.createDataFrame([], "source_id long, text string"), known).count() == 0


def test_trigrams_are_counted_where_texts_lie(spark):
    rows = [(1, "Ab, ab \U00010400É a"), (2, "x"), (3, None), (4, "1 2")]
    got = sorted(map(tuple, language.trigrams(spark.createDataFrame(rows, "source_id long, text string"), "source_id").collect()))
    assert got == sorted([(1, "", 7), (1, " ab", 2), (1, "ab ", 2), (1, " \U00010428é", 1), (1, "\U00010428é ", 1), (1, " a ", 1), (2, "", 1), (2, " x ", 1)])
    twice = spark.createDataFrame([(5, "aba"), (5, "aba")], "source_id long, text string")
    known = spark.createDataFrame([("a", "aba", 3)], "language string, gram string, weight int")
    assert [r.language for r in language.sure_language(twice, known).collect()] == [None]  # six letters
    plan = language.sure_language(twice, known)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan  # texts make no row a letter
