from pyspark.sql import functions as F

from threadloom.functions import columns as c
from threadloom.functions import stats


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


def test_names(spark):
    for raw, want in ((" r/AskThings\t", "askthings"), ("R/x", "x"), ("r/", None), ("  ", None), (None, None), ("　Kneeclub\xa0", "kneeclub")):
        assert one(spark, raw, c.compare_name) == want
    for raw, want in (("\tT3_AB ", "ab"), ("t3_", None), ("ab", "ab"), (None, None)):
        assert one(spark, raw, c.post_key) == want


def test_strip_equals_python(spark):
    for raw in (" a ", "\x1c\x1da ", " a b ", "", "\x85"):
        assert one(spark, raw, c.strip) == raw.strip()


def test_authors(spark):
    cases = {" [Deleted] ": None, "[removed]": None, "": None, " bob ": "bob", None: None}
    for raw, want in cases.items():
        assert one(spark, raw, c.valid_author) == want
    assert one(spark, " bob ", c.author_as_written) == " bob "
    assert one(spark, " [Deleted] ", c.author_as_written) is None


def test_times(spark):
    assert one(spark, "1654100000.7", c.epoch_seconds) == 1654100000
    assert one(spark, "inf", c.epoch_seconds) is None
    assert one(spark, "x", c.epoch_seconds) is None
    assert one(spark, 0, c.epoch_month, "long") == "1970-01"
    assert one(spark, -1, c.epoch_month, "long") == "1969-12"
    assert one(spark, 1 << 60, c.epoch_month, "long") is None
    assert one(spark, "2022-12", c.month_index) == 2022 * 12 + 11
    assert one(spark, "2022-13", c.month_index) is None and one(spark, "x", c.month_index) is None
    assert one(spark, 2022 * 12 + 11, c.index_month, "long") == "2022-12"


def test_share(spark):
    df = spark.createDataFrame([(1, 0), (1, 4), (None, 4)], "a int, b int").select(c.share(F.col("a"), F.col("b")).alias("s"))
    assert [r.s for r in df.collect()] == [0.0, 0.25, 0.0]


def test_tails():
    assert abs(stats.normal_two_sided(1.959963985) - 0.05) < 1e-9
    assert abs(stats.chi2_sf(3.841458821, 1) - 0.05) < 1e-9
    assert abs(stats.chi2_sf(18.30703805, 10) - 0.05) < 1e-9
    assert abs(stats.t_two_sided(2.228138852, 10) - 0.05) < 1e-9
    assert abs(stats.mann_whitney_p(0, 3, 3, []) - 0.1) < 1e-12
    assert abs(stats.mann_whitney_p(4, 4, 5, []) - 2 * 12 / 126) < 1e-9
    assert stats.spearman_p(1.0, 5) == 0.0
