"""Mixed timestamp formats and zones to one UTC form (problem 5).

The distinct (raw text, zone, day order) triples form a dictionary; each is parsed once by
``parse_instant`` and written to a table that later batches extend; rows get their instant by a join.

Defined results: null, blank, unparsable or impossible values (also a weekday that does not fit its
date, or hour 0 or 13 with am/pm) have no instant; a time without zone is wall time of the feed's zone,
and one that occurred twice or never there has none; without a known feed such a time has none. An
offset wins over a zone name beside it. Bare dates and months stay dates and months.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import uuid
import zoneinfo

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, shared_folder, stage

# Month names by number, in English, German, French, Spanish, Portuguese and Italian.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene janeiro gennaio gen",
    2: "february feb februar février fevrier févr fevr febrero fevereiro fev febbraio",
    3: "march mar märz maerz mrz mars marzo março marco",
    4: "april apr avril avr abril abr aprile",
    5: "may mai mayo maio mag maggio",
    6: "june jun juni juin junio junho giugno giu",
    7: "july jul juli juillet juil julio julho luglio lug",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre setembro set settembre",
    10: "october oct oktober okt octobre octubre outubro out ottobre ott",
    11: "november nov novembre noviembre novembro",
    12: "december dec dezember dez décembre decembre déc diciembre dic dezembro dicembre",
}
# Weekday names, Monday first.
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")

_MONTH_OF = {name: n for n, names in MONTHS.items() for name in names.split()}
_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[ap])\.?m\.?(?![a-z]))?"
_ZONE = r"(?:\s*(?P<off>[+-]\d{2}:?\d{2}|[+-]\d{2}))?(?:\s*\[?(?P<name>[A-Za-z]+(?:/[A-Za-z_+-]+\d*)*)\]?)?"
_WORD = r"[^\W\d_]+"
_DATES = (
    r"(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})",
    r"(?P<y>\d{4})[/.](?P<m>\d{1,2})[/.](?P<d>\d{1,2})",
    r"(?P<a>\d{1,2})(?P<sep>[/.-])(?P<b>\d{1,2})(?P=sep)(?P<y>\d{4})",
    rf"(?P<d>\d{{1,2}})(?:\.|er|st|nd|rd|th|º|°)?[\s-]*(?:de\s+)?(?P<mon>{_WORD})\.?[\s,-]*(?:de\s+)?(?P<y>\d{{4}})",
    rf"(?P<mon>{_WORD})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})",
)
_STAMPS = tuple(re.compile(rf"(?:(?P<wd>[A-Za-z]{{3}})[a-z]*,?\s+)?{d}(?:(?:\s*,\s*|\s+|[Tt]){_TIME}{_ZONE})?", re.I) for d in _DATES)
_COMPACT = re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?:[T ]?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d+))?(?P<z>Z|[+-]\d{2}:?\d{2})?)?", re.I)
_MONTHS_ONLY = (
    re.compile(r"(?P<y>\d{4})[-/](?P<m>\d{1,2})"),
    re.compile(r"(?P<m>\d{1,2})[-/](?P<y>\d{4})"),
    re.compile(rf"(?P<mon>{_WORD})\.?,?\s+(?:de\s+)?(?P<y>\d{{4}})"),
)
_LABEL = re.compile(rf"{_WORD}(?:\s+{_WORD})?\s*:\s*")
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def abbreviations(zones: list[str]) -> dict[str, int]:
    """Zone abbreviations in use in these zones since 2000, with their offset in seconds.

    An abbreviation with two offsets among the zones has no single reading and is left out.
    """
    found: dict[str, set[int]] = {"UTC": {0}, "GMT": {0}, "Z": {0}}
    for zone in zones:
        try:
            tz = zoneinfo.ZoneInfo(zone)
        except (ValueError, OSError, zoneinfo.ZoneInfoNotFoundError):
            continue
        for year in range(2000, 2038):
            for month in (1, 4, 7, 10):
                t = dt.datetime(year, month, 15, tzinfo=tz)
                if t.tzname().isalpha():
                    found.setdefault(t.tzname(), set()).add(int(t.utcoffset().total_seconds()))
    return {k: v.pop() for k, v in found.items() if len(v) == 1}


def _utc(t: dt.datetime, fraction: str | None) -> str:
    return t.strftime("%Y-%m-%dT%H:%M:%S").rjust(19, "0") + "." + ((fraction or "") + "000000")[:6] + "Z"


def _wall(t: dt.datetime, zone: str) -> dt.datetime | None:
    """UTC of a wall time that occurred exactly once in the zone."""
    try:
        tz = zoneinfo.ZoneInfo(zone)
    except (ValueError, OSError, zoneinfo.ZoneInfoNotFoundError):
        return None
    early, late = t.replace(tzinfo=tz), t.replace(tzinfo=tz, fold=1)
    if early.utcoffset() != late.utcoffset():
        return None
    return (t - early.utcoffset()).replace(tzinfo=dt.timezone.utc)


def _day(m: dict, order: str | None) -> dt.date | None:
    y = int(m["y"])
    if m.get("mon"):
        month = _MONTH_OF.get(m["mon"].lower())
        pairs = [(month, int(m["d"]))] if month else []
    elif m.get("a"):
        a, b = int(m["a"]), int(m["b"])
        pairs = {"MDY": [(a, b)], "DMY": [(b, a)]}.get(order or "", [(a, b), (b, a)])
    else:
        pairs = [(int(m["m"]), int(m["d"]))]
    days = set()
    for month, day in pairs:
        try:
            days.add(dt.date(y, month, day))
        except ValueError:
            pass
    return days.pop() if len(days) == 1 else None


def parse_instant(raw: str | None, zone: str | None, order: str | None, abbr: dict[str, int]) -> str | None:
    """The normal form of one stamp, or None where no single reading exists."""
    text = " ".join((raw or "").split())
    if not text:
        return None
    try:
        if re.fullmatch(r"-?\d{10}(?:\d{3}|\d{6}|\d{9})?", text):  # seconds, milli-, micro- or nanoseconds
            digits = text.lstrip("-")
            n = int(text) * 10 ** (19 - len(digits)) // 1000  # microseconds
            t = _EPOCH + dt.timedelta(microseconds=n)
            return _utc(t, f"{t.microsecond:06d}")
        text = re.sub(r"^" + _LABEL.pattern + r"(?=[\d\w])", "", text) if re.match(_LABEL.pattern + r"(?!\d{2}\b:)", text) else text
        m = _COMPACT.fullmatch(text)
        g = m.groupdict() if m else None
        if g is None:
            for p in _STAMPS:
                if m := p.fullmatch(text):
                    g = m.groupdict()
                    break
        if g is None:
            for p in _MONTHS_ONLY:
                if m := p.fullmatch(text):
                    g = m.groupdict()
                    month = _MONTH_OF.get(g["mon"].lower()) if g.get("mon") else int(g["m"])
                    return f"{int(g['y']):04d}-{month:02d}" if month and 1 <= month <= 12 and int(g["y"]) > 0 else None
            return None
        day = _day(g, order)
        if day is None or (g.get("wd") and g["wd"].lower() != WEEKDAYS[day.weekday()]):
            return None
        if g.get("h") is None:
            return day.isoformat()
        hour = int(g["h"])
        if g.get("ap"):
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + 12 * (g["ap"].lower() == "p")
        t = dt.datetime(day.year, day.month, day.day, hour, int(g["mi"]), int(g["s"] or 0))
        off, name = g.get("off") or g.get("z"), g.get("name")
        if off and off.upper() != "Z":
            sign, digits = (-1 if off[0] == "-" else 1), off[1:].replace(":", "").ljust(4, "0")
            if int(digits[:2]) > 15 or int(digits[2:]) > 59:
                return None
            utc = t - sign * dt.timedelta(hours=int(digits[:2]), minutes=int(digits[2:]))
        elif off:
            utc = t
        elif name and name.upper() in abbr:
            utc = t - dt.timedelta(seconds=abbr[name.upper()])
        elif name and "/" not in name:
            return None
        else:
            utc = _wall(t, name or zone) if name or zone else None
        return utc and _utc(utc, g.get("f"))
    except (ValueError, OverflowError):
        return None


def dictionary(keys: DataFrame, abbr: dict[str, int]) -> DataFrame:
    """(raw, tz_name, date_order, iso_utc) of each distinct key; iso_utc is null where nothing can be read."""
    schema = pa.schema([(c, pa.string()) for c in ("raw", "tz_name", "date_order", "iso_utc")])

    def run(batches):
        for b in batches:
            raw, zone, order = (b.column(i).to_pylist() for i in range(3))
            iso = [parse_instant(*k, abbr) for k in zip(raw, zone, order)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (raw, zone, order, iso)], schema=schema)

    return keys.select("raw", "tz_name", "date_order").distinct().mapInArrow(run, "raw string, tz_name string, date_order string, iso_utc string")


def _keys(df: DataFrame, raw: str, feed: str, feeds: DataFrame) -> DataFrame:
    """(row, raw, tz_name, date_order): the rows with a value, packed so that no column name clashes."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "iso_utc"]).alias("row"), F.col(raw).alias("raw"), F.col(feed).alias("feed_id"))
    # staged, so that its size is known
    zones = stage(feeds.select("feed_id", "tz_name", "date_order").dropDuplicates(["feed_id"]), "feeds")
    return packed.where(F.col("raw").isNotNull() & (F.trim("raw") != "")).join(broadcast_if_small(zones), "feed_id", "left").select("row", "raw", "tz_name", "date_order")


class InstantDictionary:
    """A parsed dictionary of stamps kept as a table in a shared folder and extended batch by batch.

    feeds (feed_id, tz_name, date_order) gives each feed's zone and day order; only the zones, of which there
    are a few hundred in the world, reach the driver.
    """

    def __init__(self, spark: SparkSession, feeds: DataFrame, path: str):
        zones = sorted(r[0] for r in feeds.select("tz_name").where("tz_name is not null").distinct().collect())
        self.spark, self.feeds, self.path, self.abbr = spark, feeds, path, abbreviations(zones)

    def batches(self) -> list[str]:
        """The folders of all finished batches, so plans over different states stay distinct."""
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(Path(self.path)):
            return []
        return sorted(str(x.getPath()) for x in fs.listStatus(Path(self.path)) if fs.exists(Path(x.getPath(), "_SUCCESS")))

    def table(self) -> DataFrame | None:
        """All finished batches, each key once."""
        batches = self.batches()
        if not batches:
            return None
        rows = self.spark.read.schema("raw string, tz_name string, date_order string, iso_utc string").parquet(*batches)
        # a batch holds each key once; batches written at the same time may repeat one, never with another value
        return rows if len(batches) == 1 else rows.dropDuplicates(["raw", "tz_name", "date_order"])

    def compact(self) -> None:
        """Make one batch of all; for times when nobody reads the table."""
        batches = self.batches()
        if len(batches) < 2:
            return
        self.table().write.parquet(f"{self.path}/batch-{uuid.uuid4().hex}")
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for b in batches:
            fs.delete(Path(b), True)

    def normalise(self, df: DataFrame, raw: str, feed: str) -> DataFrame:
        """df with iso_utc; values not met before are parsed and appended to the table first."""
        rows = _keys(df, raw, feed, self.feeds)
        keys, known = rows.select("raw", "tz_name", "date_order"), self.table()
        if known is not None:
            same = [keys[c].eqNullSafe(known[c]) for c in ("raw", "tz_name", "date_order")]
            keys = stage(keys.distinct().join(known, same[0] & same[1] & same[2], "left_anti"), "stamps")
        if known is None or not keys.isEmpty():
            dictionary(keys, self.abbr).write.parquet(f"{self.path}/batch-{uuid.uuid4().hex}")
        known = self.table().where("iso_utc is not null")
        # raw is the join key; the zone columns, null for unknown feeds, are compared null-safe
        on = (rows["raw"] == known["raw"]) & rows["tz_name"].eqNullSafe(known["tz_name"]) & rows["date_order"].eqNullSafe(known["date_order"])
        return rows.join(known, on).select("row.*", known["iso_utc"])


#: Session setting that names a folder for dictionaries that outlive the session.
KEPT = "spark.lexforge.instants.dir"


def dictionary_path(spark: SparkSession, feeds: DataFrame) -> str:
    """Where the dictionary of these feeds lies: kept from run to run below the folder named by KEPT, else fresh.

    Kept ones are told apart by the zones, which decide how abbreviations are read.
    """
    kept = spark.conf.get(KEPT, None)
    if kept is None:
        return shared_path(spark, "instants")
    zones = sorted(r[0] for r in feeds.select("tz_name").where("tz_name is not null").distinct().collect())
    return f"{kept}/{hashlib.sha256('|'.join(zones).encode()).hexdigest()[:16]}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints that all executors share; it goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)  # only what exists can be marked
    fs.deleteOnExit(at)
    return path
