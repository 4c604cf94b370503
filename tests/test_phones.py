"""Numbers of five plans and more, as written, against their E.164 form."""

from pyspark.sql import functions as F

from tamarack.functions import phones, places

CASES = (
    ("GB", "020 7946 0958", "+442079460958"), ("GB", "+44 (0)20 7946 0958", "+442079460958"), ("GB", "07911 123456", "+447911123456"), ("GB", "123", None), ("GB", "00 33 1 42 68 53 00", "+33142685300"),
    ("DE", "030 901820", "+4930901820"), ("DE", "0151-23456789", "+4915123456789"), ("DE", "+49 89 636-48018", "+498963648018"), ("DE", "0 12", None),
    ("FR", "01 42 68 53 00", "+33142685300"), ("FR", "+33 6 12 34 56 78", "+33612345678"), ("FR", "01 42 68 53", None),
    ("ES", "912 345 678", "+34912345678"), ("ES", "112 345 678", None), ("IT", "06 698 12345", "+390669812345"), ("IT", "+39 347 1234567", "+393471234567"),
    ("AU", "(02) 9374 4000", "+61293744000"), ("AU", "1300 975 707", "+611300975707"), ("AU", "0011 44 20 7946 0958", "+442079460958"), ("AU", "13 11 26", "+61131126"),
    ("JP", "03-1234-5678", "+81312345678"), ("JP", "010 1 512 555 0100", "+15125550100"), ("IN", "098765 43210", "+919876543210"), ("BR", "(11) 96123-4567", "+5511961234567"), ("MX", "55 1234 5678", "+525512345678"),
    ("US", "(512) 555-0100", "+15125550100"), ("US", "011 44 20 7946 0958", "+442079460958"), ("CA", "1-604-555-0199", "+16045550199"), (None, "512.555.0100", "+15125550100"), ("us", "+44 20 7946 0958", "+442079460958"),
    ("US", "555-0100", None), ("US", "1-800-FLOWERS", None), ("ZZ", "020 7946 0958", None), ("ZZ", "+44 20 7946 0958", "+442079460958"), ("GB", None, None), ("GB", "", None), ("GB", "+999 123456", None),
)


def test_numbers_as_written(spark):
    rows = spark.createDataFrame([(i, r, n) for i, (r, n, _) in enumerate(CASES)], "i int, region string, raw string")
    got = {r.i: r.e for r in rows.select("i", phones.to_e164(F.col("raw"), F.col("region")).alias("e")).collect()}
    assert {CASES[i]: e for i, e in got.items() if e != CASES[i][2]} == {}


def test_north_america_unchanged(spark):
    rows = spark.createDataFrame([(x,) for x in ("(212) 736-5000", "+1 212 736 5000", "1 212 736 5000", "212 111 5000", "+52 55 1234 5678", "911", "2127365000 ")], "raw string")
    got = rows.select(phones.to_e164(F.col("raw"), F.lit("US")).alias("a"), places.to_e164(F.col("raw")).alias("b")).collect()
    assert [r.a for r in got if not (r.a or "").startswith("+52")] == [r.b for r in got if not (r.a or "").startswith("+52")]
