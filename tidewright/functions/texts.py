"""Names, versions, hashes and text formats, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.seaway import half_up


def _comma(x: Column, digits: int) -> Column:
    return F.replace(F.format_string(f"%.{digits}f", half_up(x * 10**digits) / 10**digits), F.lit("."), F.lit(","))


def degrees_minutes(lat: Column, lon: Column) -> Column:
    """N 58°12,3′ Ø 10°45,6′."""

    def one(x: Column, plus: str, minus: str) -> Column:
        whole = F.floor(F.abs(x))
        return F.concat(F.when(x >= 0, plus).otherwise(minus), F.lit(" "), whole.cast("string"), F.lit("°"), _comma((F.abs(x) - whole) * 60, 1), F.lit("′"))

    return F.concat_ws(" ", one(lat, "N", "S"), one(lon, "Ø", "V"))


def semver(version: Column) -> Column:
    """struct(major, minor, patch); NULL parts unless the text is three whole numbers."""
    part = [F.regexp_extract(version, r"^(\d+)\.(\d+)\.(\d+)$", i).try_cast("long") for i in (1, 2, 3)]
    return F.struct(part[0].alias("major"), part[1].alias("minor"), part[2].alias("patch"))


def semver_compatible(client: Column, package: Column) -> Column:
    return semver(client)["major"] == semver(package)["major"]


def run_time(name: Column) -> Column:
    """The ISO time of a run's file name."""
    at = [F.regexp_extract(name, r"(\d{4})(\d{2})(\d{2})T(\d{2})Z", i) for i in (1, 2, 3, 4)]
    return F.when(at[0] != "", F.concat(at[0], F.lit("-"), at[1], F.lit("-"), at[2], F.lit("T"), at[3], F.lit(":00:00Z")))


def last_epoch(text: Column) -> Column:
    """The last number of a text, if it is a time of 2020 to 2100."""
    number = F.floor(F.element_at(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), -1).cast("double")).cast("long")
    return F.when((number >= 1577836800) & (number < 4102444800), number)


def tile_url(base: Column, z: Column, x: Column, y: Column) -> Column:
    return F.concat(base, F.lit("/"), F.lpad(z.cast("string"), 2, "0"), F.lit("/"), y.cast("string"), F.lit("/"), x.cast("string"), F.lit(".png"))


def tile_of_url(url: Column) -> Column:
    z, y, x = (F.regexp_extract(url, r"/(\d+)/(\d+)/(\d+)\.png$", i).try_cast("long") for i in (1, 2, 3))
    return F.struct(z.alias("z"), x.alias("x"), y.alias("y"))


def file_stamp(at: Column) -> Column:
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz"))
    return F.date_format(utc, "yyyy-MM-dd'T'HH-mm-ss'-'SSS'Z'")


def local_clock(t: Column, zone: str = "Europe/Oslo") -> Column:
    utc = F.timestamp_add("SECOND", t, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc), "HH:mm")


def slug(name: Column) -> Column:
    plain = F.replace(F.replace(F.replace(F.lower(name), F.lit("æ"), F.lit("ae")), F.lit("ø"), F.lit("o")), F.lit("å"), F.lit("a"))
    return F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-"))


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """JSON with its keys in order."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def fnv1a64(text: Column) -> Column:
    """The 64-bit FNV-1a hash in hex: exclusive-or with each byte, times the prime modulo 2 to the 64th.

    The prime is 2^40 + 435; products are taken in 20-digit decimals, so nothing overflows."""
    pairs = F.filter(F.split(F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "$1,"), ","), lambda x: x != "")

    def mix(acc: Column, byte: Column) -> Column:
        low = acc["lo"].bitwiseXOR(F.conv(byte, 16, 10).cast("long"))
        # hi and lo are 32-bit halves: (hi * 2^32 + lo) * (2^40 + 435)
        lo = low * 435
        hi = acc["hi"] * 435 + F.shiftright(lo, 32) + F.shiftleft(low, 8)
        return F.struct(hi.bitwiseAND(0xFFFFFFFF).alias("hi"), lo.bitwiseAND(0xFFFFFFFF).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    done = F.aggregate(pairs, start, mix)
    return F.lower(F.concat(F.lpad(F.hex(done["hi"]), 8, "0"), F.lpad(F.hex(done["lo"]), 8, "0")))
