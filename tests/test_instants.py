import pandas as pd
import pytest
from pyspark.sql import functions as F
from reading import read

from lodestream.functions.timestamps import with_instants
from lodestream.operators.increments import p1_found, p3_found
from lodestream.operators.instants import TimestampDictionary, published_rows, url_host, with_profile
from lodestream.session import fresh_dir


def test_every_published_text_reads_as_by_hand(spark, sf):
    rows = published_rows(spark, sf)
    got = TimestampDictionary(spark, fresh_dir(spark, "t")).resolve(rows, "published_at", "tz_name", "date_order").toPandas()
    assert len(got) == rows.count() > 0
    for r in got.itertuples():
        want = read(r.published_at, r.tz_name, r.date_order)
        assert (None if pd.isna(r.utc_us) else int(r.utc_us)) == want, (r.published_at, r.tz_name, r.date_order)


@pytest.mark.parametrize(
    "raw,tz,order,want",
    [
        ("2024-03-10T02:30:00", "America/New_York", "MDY", None),  # skipped
        ("2024-11-03 01:30:00", "America/New_York", "MDY", None),  # repeated
        ("2024-11-03T01:30:00-05:00[America/New_York]", "America/New_York", "MDY", 1730615400000000),
        ("Sun, 3 Nov 2024 01:30:00 EST", "Asia/Tokyo", None, 1730615400000000),
        ("2024-12-31T24:00:00Z", None, None, 1735689600000000),
        ("2024-12-31T24:00:01Z", None, None, None),
        ("2023-02-29", "UTC", None, None),
        ("13/05/2024", "UTC", "MDY", None),
        ("05/06/2024", "UTC", None, None),
        ("06/06/2024", "UTC", None, 1717632000000000),
        ("2018-11-04", "America/Sao_Paulo", None, 1541300400000000),  # midnight is skipped there
        ("1700000000", None, None, 1700000000000000),
        ("1700000000123", None, None, 1700000000123000),
        ("2024-01-01T00:00:00.1234569Z", None, None, 1704067200123456),
        ("12:00 AM", "UTC", None, None),
        ("May 5, 2024 12:00:00 AM", "UTC", None, 1714867200000000),
        ("1. März 2024 10:00:00", "Europe/Berlin", None, 1709283600000000),
        ("2024-01-01 10:00:00", "Mars/Base", None, None),
        ("soon", "UTC", None, None), ("", "UTC", None, None), (None, "UTC", None, None), ("0000-00-00", "UTC", None, None),
        ("2024-01-01 " * 3000, "UTC", None, None),
    ],
)
def test_single_texts(spark, raw, tz, order, want):
    df = spark.createDataFrame([(raw, tz, order, 1)], "raw string, tz string, o string, utc_us_ int")
    assert with_instants(df, "raw", "tz", "o").head()["utc_us"] == want


def test_dictionary_grows_by_new_texts_only(spark):
    root = fresh_dir(spark, "t")
    one = spark.createDataFrame([("2024-01-01", 1), ("2024-01-01", 2), (None, 3)], "raw string, raw_ int")
    book = TimestampDictionary(spark, root)
    assert book.resolve(one, "raw").count() == 3
    two = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02Z", 2)], "raw string, _td_raw int")
    again = TimestampDictionary(spark, root)
    out = again.resolve(two, "raw", out="t").collect()
    assert len(again.parts) == 2 and spark.read.parquet(again.parts[1]).count() == 1
    assert {r["_td_raw"]: r["t"] for r in out} == {1: None, 2: None} or len(out) == 2
    empty = spark.createDataFrame([], "raw string")
    assert again.resolve(empty, "raw").count() == 0


def test_hosts_and_profiles(spark):
    df = spark.createDataFrame([("HTTP://u@Blog.X.example:80/a",), ("blog",), (None,), ("https://www.x.example?q",)], "u string")
    assert [r[0] for r in df.select(url_host(F.col("u"))).collect()] == ["blog.x.example", None, None, "x.example"]
    prof = spark.createDataFrame([("a", None, "UTC", "DMY"), ("b", "s", "Asia/Tokyo", "MDY"), ("b", "s", "UTC", "MDY")], "tab string, scope string, tz_name string, date_order string")
    rows = spark.createDataFrame([("a", None, 1), ("b", "s", 2), ("b", None, 3)], "tab string, scope string, id int")
    assert {r["id"]: r["tz_name"] for r in with_profile(rows, prof, "tab", "scope").collect()} == {1: "UTC", 2: "Asia/Tokyo", 3: None}


def test_found_columns(spark, sf):
    got = p3_found(spark, sf)
    assert [f"{a} {b}" for a, b in got.dtypes] == ["tab string", "rec_id bigint", "utc_us bigint"] and got.count() > 0
    assert [f"{a} {b}" for a, b in p1_found(spark, sf).dtypes] == ["tab string", "rec_id bigint"]
