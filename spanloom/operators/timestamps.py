"""Mixed timestamp texts to UTC instants.

The distinct pairs of raw text and zone form a dictionary that is parsed once, exhaustively, and can be kept and
extended from run to run; the instants are joined back to the rows. Timestamps repeat within and between
tables, so that parsing isn't paid per row, and a third of all rows sharing one text costs one parse.

Defined results
* Null, empty and unreadable texts, impossible dates and instants outside the asked years give no instant.
* Texts with zone (offset, Z, abbreviation, bracketed zone after an offset) and epoch numbers ignore the zone column.
* Texts without zone are wall times of the zone column; null, blank or unknown zones give no instant.
* A wall time that occurs twice is the earlier instant; a skipped one is read with the offset before the change.
* Digits beyond microseconds are cut off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.runtime import new_path

US = 1_000_000
LOW_YEAR, HIGH_YEAR = 2020, 2029
#: Fixed offsets in minutes of zone abbreviations that stand in timestamps.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330,
    "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "BRT": -180, "BRST": -120,
}
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}

_MON = r"(?P<mon>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_DAYNAME = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[ap])\.?m\.?)?"
_ZONE = r"(?:\s*(?P<off>[+-]\d{2}(?::?\d{2})?|[a-z]{1,5}))?(?:\s*\[[\w/+\-]+\])?"
_FORMS = [
    re.compile(p + r"$", re.IGNORECASE | re.ASCII)
    for p in (
        r"(?P<y>\d{4})(?P<sep>[-/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})(?:\s*[t_]\s*|\s+)" + _TIME + _ZONE,
        r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})[t ]?(?P<h>\d{2})(?P<mi>\d{2})(?:(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?P<ap>)" + _ZONE,
        _DAYNAME + r"(?P<d>\d{1,2})[ \-/]" + _MON + r"[ \-/,]+(?P<y>\d{4}),?[t ]\s*" + _TIME + _ZONE,
        _DAYNAME + _MON + r"\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4}),?\s+(?:at\s+)?" + _TIME + _ZONE,
        _DAYNAME + _MON + r"\s+(?P<d>\d{1,2})\s+" + _TIME + r"(?:\s+(?P<off>[+-]\d{4}|[a-z]{1,5}))?\s+(?P<y>\d{4})",
    )
]
_EPOCH = re.compile(r"(\d{9,20})(?:[.,](\d+))?$", re.ASCII)
_EPOCH0 = datetime(1970, 1, 1)


@lru_cache(256)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (ValueError, OSError, KeyError):
        return None


def _us(d: datetime) -> int:
    return (d - _EPOCH0) // timedelta(microseconds=1)


def _epoch(text: str, low: int, high: int) -> int | None:
    m = _EPOCH.match(text)
    if not m:
        return None
    whole, frac = int(m[1]), ((m[2] or "") + "000000000")[:9]
    for unit in (US, 1000, 1):  # seconds, milliseconds, microseconds
        us = whole * unit + int(frac) * unit // 10**9
        if low <= us < high:
            return us
    us = whole // 1000  # nanoseconds
    return us if low <= us < high else None


@lru_cache(16)
def _range(low_year: int, high_year: int) -> tuple[int, int]:
    return _us(datetime(low_year, 1, 1)), _us(datetime(high_year + 1, 1, 1))


def parse_instant(raw: str | None, zone: str | None, low_year: int = LOW_YEAR, high_year: int = HIGH_YEAR) -> int | None:
    """Microseconds since 1970 UTC of a timestamp text, or None."""
    if raw is None:
        return None
    text = raw.strip()
    low, high = _range(low_year, high_year)
    if _EPOCH.match(text):
        us = _epoch(text, low, high)
        if us is not None or len(text) not in (12, 14):
            return us
    m = next((m for f in _FORMS if (m := f.match(text))), None)
    if m is None:
        return None
    g = m.groupdict()
    month = MONTHS[g["mon"].lower()] if g.get("mon") else int(g["m"])
    hour = int(g["h"])
    if g.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (g["ap"].lower() == "p")
    try:
        wall = datetime(int(g["y"]), month, int(g["d"]), hour, int(g["mi"]), int(g["s"] or 0), int(((g["f"] or "") + "000000")[:6]))
    except ValueError:
        return None
    off = g.get("off")
    if off:
        if off[0] in "+-":
            digits = off[1:].replace(":", "").ljust(4, "0")
            minutes = int(digits[:2]) * 60 + int(digits[2:])
            if minutes > 18 * 60 or int(digits[2:]) > 59:
                return None
            minutes = -minutes if off[0] == "-" else minutes
        elif off.upper() in ABBREVIATIONS:
            minutes = ABBREVIATIONS[off.upper()]
        else:
            return None
        us = _us(wall) - minutes * 60 * US
    else:
        z = _zone(zone.strip()) if zone and zone.strip() else None
        if z is None:
            return None
        try:
            us = _us(wall) - wall.replace(tzinfo=z).utcoffset() // timedelta(microseconds=1)
        except OverflowError:
            return None
    return us if low <= us < high else None


_DICT = "raw STRING, zone STRING, utc_us BIGINT"


def _parse(low_year: int, high_year: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, zone = b.column("raw"), b.column("zone")
            us = [parse_instant(r, z, low_year, high_year) for r, z in zip(raw.to_pylist(), zone.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([raw, zone, pa.array(us, pa.int64())], names=["raw", "zone", "utc_us"])

    return run


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def dictionary_place(path: str, low_year: int, high_year: int) -> str:
    """What an epoch number means depends on the years asked for, so each range has a dictionary of its own."""
    return f"{path}/years={low_year}-{high_year}"


def read_dictionary(spark: SparkSession, path: str, low_year: int = LOW_YEAR, high_year: int = HIGH_YEAR) -> DataFrame:
    """(raw, zone, utc_us); a pair that two writers stored at the same time stands once."""
    known = spark.read.schema(_DICT).parquet(dictionary_place(path, low_year, high_year))
    return known.groupBy("raw", "zone").agg(F.max("utc_us").alias("utc_us"))


def update_dictionary(values: DataFrame, path: str, low_year: int = LOW_YEAR, high_year: int = HIGH_YEAR) -> DataFrame:
    """Adds the pairs (raw, zone) of ``values`` that the dictionary at ``path`` lacks; gives the dictionary."""
    spark, place = values.sparkSession, dictionary_place(path, low_year, high_year)
    new = values.where(F.col("raw").isNotNull()).select("raw", F.coalesce("zone", F.lit("")).alias("zone")).distinct()
    if _exists(spark, place):
        new = new.join(spark.read.schema(_DICT).parquet(place).select("raw", "zone"), ["raw", "zone"], "left_anti")
    new.mapInArrow(_parse(low_year, high_year), _DICT).write.mode("append").option("compression", "zstd").parquet(place)
    return read_dictionary(spark, path, low_year, high_year)


def normalise(values: DataFrame, dictionary: str | None = None, updated: bool = False) -> DataFrame:
    """Adds ``utc_us`` to rows with columns ``raw`` and ``zone``; rows without instant keep null.

    ``dictionary`` is the path of a dictionary that is kept between runs; by default a new one in the shared folder.
    ``updated`` tells that it holds all pairs already.
    """
    spark = values.sparkSession
    known = read_dictionary(spark, dictionary) if updated else update_dictionary(values, dictionary or new_path(spark, "instants"))
    known = known.where(F.col("utc_us").isNotNull()).select(F.col("raw").alias("_raw"), F.col("zone").alias("_zone"), "utc_us")
    return values.join(known, (F.col("raw") == F.col("_raw")) & (F.coalesce("zone", F.lit("")) == F.col("_zone")), "left").drop("_raw", "_zone")


def session_times(export: DataFrame, tools: DataFrame, log: DataFrame) -> list[DataFrame]:
    """(src, row_id, msg_pos, raw, zone) of every timestamp of each of the three session tables."""
    zone = F.col("host_tz").alias("zone")
    own = export.select(F.lit("session_export").alias("src"), "row_id", F.lit(-1).alias("msg_pos"), F.col("info.time.created").alias("raw"), zone)
    parts = [
        own.unionByName(export.select(F.lit("session_export").alias("src"), "row_id", F.posexplode("messages.info.time.created").alias("msg_pos", "raw"), zone)),
        tools.select(F.lit("session_with_tools").alias("src"), "row_id", F.posexplode("messages.timestamp").alias("msg_pos", "raw"), zone),
        log.select(F.lit("session_log").alias("src"), "row_id", F.lit(-1).alias("msg_pos"), F.col("timestamp").alias("raw"), zone),
    ]
    return [p.where(F.col("raw").isNotNull()) for p in parts]


def found(export: DataFrame, tools: DataFrame, log: DataFrame, dictionary: str | None = None) -> DataFrame:
    """One table after the other adds what the dictionary lacks; then all rows are joined with it."""
    dictionary = dictionary or new_path(export.sparkSession, "instants")
    parts = session_times(export, tools, log)
    for p in parts:
        update_dictionary(p, dictionary)
    rows = normalise(parts[0].unionByName(parts[1]).unionByName(parts[2]), dictionary, updated=True)
    return rows.where(F.col("utc_us").isNotNull()).select("src", "row_id", "msg_pos", "utc_us")
