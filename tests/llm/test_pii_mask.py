"""Masking of spans that overlap."""

from pyspark.sql import functions as F

from erascope.llm import pii


def test_overlapping_spans_are_masked_whole(spark):
    text = "call +49 151 2345678@x.com now"
    cases = [
        ([(5, 20, "phone"), (13, 26, "email")], "call [PHONE] now"),
        ([(5, 26, "email"), (9, 12, "phone")], "call [EMAIL] now"),
        ([(5, 20, "phone"), (20, 26, "email")], "call [PHONE][EMAIL] now"),
        ([], text),
    ]
    frame = spark.createDataFrame([(i, text, s) for i, (s, _) in enumerate(cases)], "id int, text string, spans array<struct<start:int,end:int,kind:string>>")
    got = frame.select("id", pii.mask(F.col("text"), F.col("spans")).alias("text")).orderBy("id").collect()
    assert [r["text"] for r in got] == [want for _, want in cases]


def test_number_before_an_address_leaves_nothing(spark):
    docs = spark.createDataFrame([(1, "phone +49 151 2345678@x.com")], "doc_id long, text string")
    assert "@x.com" not in pii.mask_personal_data(docs).first()["text"]
