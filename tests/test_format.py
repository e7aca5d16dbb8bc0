from pyspark.sql import functions as F

from needledrop.functions import format as fmt


def test_display_forms(spark):
    values = [45_000, 90_000, 720_000, 10_800_000, 216_000_000, 12 * 86_400_000, 120 * 86_400_000, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v bigint").orderBy("i")
    assert [r[0] for r in df.select(fmt.duration(F.col("v"))).collect()] == ["45 sec", "1.5 min", "12 min", "3.0 h", "2.5 days", "12 days", "4 months", "—"]
    one = spark.createDataFrame([(1700000000000, 1694000000000, None, 0.875, 1234567, "the two")], "a bigint, b bigint, c bigint, d double, e bigint, f string")
    got = one.select(fmt.short_date(F.col("a")), fmt.date_time(F.col("b")), fmt.short_date(F.col("c")), fmt.percent(F.col("d")), fmt.number(F.col("e")), fmt.capitalised(F.col("f"))).first()
    assert tuple(got) == ("14 Nov 2023", "06 Sept 2023, 11:33", "—", "88%", "1,234,567", "The two")
