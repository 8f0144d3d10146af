import pytest
from lexforge.operators import instants as I

FEEDS = [("us", "America/New_York", "MDY"), ("de", "Europe/Berlin", "DMY"), ("jp", "Asia/Tokyo", "YMD"), ("in", "Asia/Kolkata", "DMY"), ("au", "Australia/Sydney", "DMY"), ("uk", "Europe/London", "DMY"), ("core", "UTC", "YMD")]
ZONES = {f: (z, o) for f, z, o in FEEDS}
ABBR = I.abbreviations([z for _, z, _ in FEEDS])


def parse(text, feed=None):
    return I.parse_instant(text, *ZONES.get(feed, (None, None)), ABBR)


@pytest.mark.parametrize(
    ("text", "feed", "expected"),
    [
        ("2024-05-01T10:00:00Z", None, "2024-05-01T10:00:00.000000Z"),
        ("2024-05-01t10:00:00.1234567z", None, "2024-05-01T10:00:00.123456Z"),
        ("2024-05-01 10:00:00,5 +05:30", None, "2024-05-01T04:30:00.500000Z"),
        ("2025-11-17T01:14:21-0500", None, "2025-11-17T06:14:21.000000Z"),
        ("2022-11-10 18:13:01 [America/New_York]", "de", "2022-11-10T23:13:01.000000Z"),
        ("2021-11-13 20:36:42 America/Chicago", None, "2021-11-14T02:36:42.000000Z"),
        ("2021-11-07T01:22:39-05:00[America/New_York]", None, "2021-11-07T06:22:39.000000Z"),
        ("2021-07-01 12:00:00 IST", None, "2021-07-01T06:30:00.000000Z"),
        ("2023-08-20 01:01:02 AEST", None, "2023-08-19T15:01:02.000000Z"),
        ("01/02/2024 4:32 pm", "us", "2024-01-02T21:32:00.000000Z"),
        ("01/02/2024 4:32 pm", "de", "2024-02-01T15:32:00.000000Z"),
        ("12/31/2023 12:05 am", "us", "2023-12-31T05:05:00.000000Z"),
        ("  12 June 2024, 21:50 ", "us", "2024-06-13T01:50:00.000000Z"),
        ("Jul 11, 2022 8:50:59 AM", "jp", "2022-07-10T23:50:59.000000Z"),
        ("Mon, 24 Jul 2023 00:36:28 -0400", None, "2023-07-24T04:36:28.000000Z"),
        ("20230328144618", "core", "2023-03-28T14:46:18.000000Z"),
        ("1645988104", "us", "2022-02-27T18:55:04.000000Z"),
        ("1760729884468", None, "2025-10-17T19:38:04.468000Z"),
        ("20230115", None, "2023-01-15"),
        ("1er septembre 2019", None, "2019-09-01"),
        ("8. Juli 2021", None, "2021-07-08"),
        ("06-FEB-2021", None, "2021-02-06"),
        ("February 3, 2020", None, "2020-02-03"),
        ("2012/07/04", "us", "2012-07-04"),
        ("13.05.2020", "de", "2020-05-13"),
        ("Revised: 11/2020", None, "2020-11"),
        ("Nov 2018", None, "2018-11"),
        ("2021-11", None, "2021-11"),
    ],
)
def test_readings(text, feed, expected):
    assert parse(text, feed) == expected


@pytest.mark.parametrize(
    ("text", "feed"),
    [("2024-03-31T01:31:51", "uk"), ("2022-03-13T02:29:10", "us"), ("2022-11-06 01:35:00", "us"), ("2023-02-30 10:15:00", "in"), ("2023-09-14T25:10:00Z", None), ("2022-13-04T08:00:00Z", None), ("20171340", None),
     ("2019-02-29", None), ("N/A", None), ("TBD", None), ("", None), (None, None), ("--", None), ("2024-05-01 10:00:00", None), ("03/04/2022", None), ("13/13/2022", "us"), ("2024-05-01 10:00:00 XYZ", "us"),
     ("Tue, 24 Jul 2023 00:36:28 -0400", None), ("01/02/2024 16:32 pm", "us"), ("x" * 100_000, "us")],
)
def test_no_single_reading(text, feed):
    assert parse(text, feed) is None


def test_dictionary_is_extended(spark, tmp_path):
    feeds = spark.createDataFrame(FEEDS, "feed_id string, tz_name string, date_order string")
    known = I.InstantDictionary(spark, feeds, str(tmp_path / "d"))
    schema = "id string, feed string, stamp string, raw string, tz_name string, iso_utc string"
    first = spark.createDataFrame([("1", "us", "2024-05-01 10:00:00", "r", "t", "old"), ("2", "de", "2024-05-01 10:00:00", "r", "t", None), ("3", "us", None, None, None, None), ("4", None, "2024-05-01", None, None, None), ("4", None, "2024-05-01", None, None, None)], schema)
    out = sorted((r["id"], r["iso_utc"], r["raw"]) for r in known.normalise(first, "stamp", "feed").collect())
    assert out == [("1", "2024-05-01T14:00:00.000000Z", "r"), ("2", "2024-05-01T08:00:00.000000Z", "r"), ("4", "2024-05-01", None), ("4", "2024-05-01", None)]
    assert known.table().count() == 3
    second = spark.createDataFrame([("5", "us", "2024-05-01 10:00:00", None, None, None), ("6", "us", "nothing", None, None, None), ("7", "zz", "20240502", None, None, None)], schema)
    assert sorted((r["id"], r["iso_utc"]) for r in known.normalise(second, "stamp", "feed").collect()) == [("5", "2024-05-01T14:00:00.000000Z"), ("7", "2024-05-02")]
    assert known.table().count() == 5
    assert known.normalise(second.limit(0), "stamp", "feed").count() == 0
    assert known.table().count() == 5


def test_dictionary_outlives_runs_and_can_be_compacted(spark, tmp_path):
    feeds = spark.createDataFrame([("f", "Europe/Berlin", "DMY"), ("g", None, None)], "feed_id string, tz_name string, date_order string")
    spark.conf.set(I.KEPT, str(tmp_path / "kept"))
    try:
        path = I.dictionary_path(spark, feeds)
        assert path == I.dictionary_path(spark, feeds) and path.startswith(str(tmp_path))
    finally:
        spark.conf.unset(I.KEPT)
    rows = lambda *x: spark.createDataFrame([(i, "f", r) for i, r in enumerate(x)], "id int, feed_id string, raw string")
    read = lambda df: {tuple(r) for r in I.InstantDictionary(spark, feeds, path).normalise(df, "raw", "feed_id").select("id", "iso_utc").collect()}
    assert read(rows("2024-01-02", "junk")) == {(0, "2024-01-02")}
    assert read(rows("03.02.2024", "2024-01-02")) == {(0, "2024-02-03"), (1, "2024-01-02")}
    known = I.InstantDictionary(spark, feeds, path)
    assert len(known.batches()) == 2
    # nothing new: nothing is parsed or written
    assert read(rows("junk", "03.02.2024")) == {(1, "2024-02-03")} and len(known.batches()) == 2
    known.compact()
    assert len(known.batches()) == 1 and known.table().count() == 3 and read(rows("2024-01-02")) == {(0, "2024-01-02")}


def test_scopes_delete_what_was_staged(spark):
    from lexforge.session import stage, staging

    with staging():
        inner = stage(spark.range(5), "scoped")
        assert inner.count() == 5
        file = inner.inputFiles()[0]
    import os

    assert not os.path.exists(file.removeprefix("file:").replace("///", "/").replace("//", "/"))
