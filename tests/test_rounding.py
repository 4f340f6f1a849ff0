from ledgermill.plans.catalog_text import places


def test_halves_are_rounded_as_the_sql_rounds_them(spark):
    """DuckDB's round(x, 6) of these scores of nine places; Spark's own gives 0.129725, 0.523927 and 0.253577."""
    scores = spark.createDataFrame([(0.1297245,), (0.5239265,), (0.2535765,), (0.1234567,), (None,)], "score double")
    assert [r[0] for r in scores.select(places("score", 6)).collect()] == [0.129724, 0.523926, 0.253576, 0.123457, None]
