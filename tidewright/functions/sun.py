"""Solar position after the public NOAA equations, as Column expressions. Times are UTC epoch seconds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.angles import clamp

DAY_S, HORIZON_DEG, WINDOW_S, HALVINGS = 86_400, -0.833, 3600, 24


def bind(x: Column, then: Callable[[Column], Column]) -> Column:
    """Name a value, so that what follows holds a reference to it and not its whole expression again."""
    return F.transform(F.array(x), then)[0]


def day_start(t: Column) -> Column:
    return (F.floor(t / DAY_S) * DAY_S).cast("long")


def solar(t: Column) -> Column:
    """struct(declination in degrees, equation of time in minutes). The NOAA coefficients."""

    def orbit(c: Column) -> Column:
        return F.struct(
            c.alias("c"), ((280.46646 + c * (36000.76983 + 0.0003032 * c)) % 360).alias("long"), F.radians(357.52911 + c * (35999.05029 - 0.0001537 * c)).alias("anomaly"),
            (0.016708634 - c * (0.000042037 + 0.0000001267 * c)).alias("e"), F.radians(125.04 - 1934.136 * c).alias("node"),
        )

    def tilted(o: Column) -> Column:
        c, m = o["c"], o["anomaly"]
        centre = F.sin(m) * (1.914602 - c * (0.004817 + 0.000014 * c)) + F.sin(2 * m) * (0.019993 - 0.000101 * c) + F.sin(3 * m) * 0.000289
        tilt = 23 + (26 + (21.448 - c * (46.815 + c * (0.00059 - c * 0.001813))) / 60) / 60 + 0.00256 * F.cos(o["node"])
        apparent = o["long"] + centre - 0.00569 - 0.00478 * F.sin(o["node"])
        return F.struct(F.radians(o["long"]).alias("long"), m.alias("m"), o["e"].alias("e"), F.radians(tilt).alias("tilt"), F.radians(apparent).alias("apparent"))

    def position(s: Column) -> Column:
        y, e, m = F.tan(s["tilt"] / 2) * F.tan(s["tilt"] / 2), s["e"], s["m"]
        terms = y * F.sin(2 * s["long"]) - 2 * e * F.sin(m) + 4 * e * y * F.sin(m) * F.cos(2 * s["long"]) - 0.5 * y * y * F.sin(4 * s["long"]) - 1.25 * e * e * F.sin(2 * m)
        return F.struct(F.degrees(F.asin(F.sin(s["tilt"]) * F.sin(s["apparent"]))).alias("declination"), (4 * F.degrees(terms)).alias("equation"))

    return bind((t / DAY_S + 2440587.5 - 2451545.0) / 36525, lambda c: bind(orbit(c), lambda o: bind(tilted(o), position)))


def altitude(lat: Column, lon: Column, t: Column) -> Column:
    """Degrees above the horizon, without refraction."""

    def up(t: Column, s: Column) -> Column:
        hour = F.radians(((t - F.floor(t / DAY_S) * DAY_S) / 60 + s["equation"] + 4 * lon) / 4 - 180)
        declination = F.radians(s["declination"])
        return 90 - F.degrees(F.acos(clamp(F.sin(F.radians(lat)) * F.sin(declination) + F.cos(F.radians(lat)) * F.cos(declination) * F.cos(hour), -1.0, 1.0)))

    return bind(t, lambda t: bind(solar(t), lambda s: up(t, s)))


def is_night(lat: Column, lon: Column, t: Column) -> Column:
    return altitude(lat, lon, t) < HORIZON_DEG


def refined(lat: Column, lon: Column, guess: Column, rising: bool) -> Column:
    """The crossing of the horizon near a guess by halving; the guess itself where the window holds no change of sign."""
    sign = 1 if rising else -1

    def above(t: Column) -> Column:
        return sign * (altitude(lat, lon, t) - HORIZON_DEG)

    def halve(acc: Column, _: Column) -> Column:
        middle = (acc["lo"] + acc["hi"]) / 2
        return bind(above(middle) < 0, lambda low: F.struct(F.when(low, middle).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(middle).alias("hi")))

    def search(g: Column) -> Column:
        start = F.struct((g - WINDOW_S).alias("lo"), (g + WINDOW_S).alias("hi"))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda acc: (acc["lo"] + acc["hi"]) / 2)
        return F.when((above(g - WINDOW_S) > 0) | (above(g + WINDOW_S) < 0), g).otherwise(found)

    return bind(guess, search)


def events(lat: Column, lon: Column, t: Column) -> Column:
    """struct(sunrise, sunset, polar) of the UTC day; polar is none, day or night, and then there are no times."""

    return _events(lat, lon, t, lambda guess, rising: refined(lat, lon, guess, rising))


def _events(lat: Column, lon: Column, t: Column, crossing: Callable[[Column, bool], Column]) -> Column:
    def horizon(s: Column) -> Column:
        p, d = F.radians(lat), F.radians(s["declination"])
        cosine = F.cos(F.radians(F.lit(90 - HORIZON_DEG))) / (F.cos(p) * F.cos(d)) - F.tan(p) * F.tan(d)
        return F.struct(cosine.alias("cosine"), s["equation"].alias("equation"))

    def times(h: Column, day: Column) -> Column:
        angle = F.degrees(F.acos(clamp(h["cosine"], -1.0, 1.0)))
        rise, set_ = (F.when(F.abs(h["cosine"]) <= 1, crossing(day + (720 - 4 * (lon + side * angle) - h["equation"]) * 60, side > 0)) for side in (1, -1))
        polar = F.when(h["cosine"] > 1, "night").when(h["cosine"] < -1, "day").otherwise("none")
        return F.struct(rise.alias("sunrise"), set_.alias("sunset"), polar.alias("polar"))

    return bind(day_start(t), lambda day: bind(solar(day + (720 - 4 * lon) * 60), lambda s: bind(horizon(s), lambda h: times(h, day))))


def altitudes(lat: np.ndarray, lon: np.ndarray, t: np.ndarray) -> np.ndarray:
    """`altitude` of many places and moments at once."""
    j = (t / DAY_S + 2440587.5 - 2451545.0) / 36525
    long, m = np.radians(np.fmod(280.46646 + j * (36000.76983 + 0.0003032 * j), 360)), np.radians(357.52911 + j * (35999.05029 - 0.0001537 * j))
    e, node = 0.016708634 - j * (0.000042037 + 0.0000001267 * j), np.radians(125.04 - 1934.136 * j)
    centre = np.sin(m) * (1.914602 - j * (0.004817 + 0.000014 * j)) + np.sin(2 * m) * (0.019993 - 0.000101 * j) + np.sin(3 * m) * 0.000289
    tilt = np.radians(23 + (26 + (21.448 - j * (46.815 + j * (0.00059 - j * 0.001813))) / 60) / 60 + 0.00256 * np.cos(node))
    apparent = np.radians(np.fmod(280.46646 + j * (36000.76983 + 0.0003032 * j), 360) + centre - 0.00569 - 0.00478 * np.sin(node))
    y = np.tan(tilt / 2) * np.tan(tilt / 2)
    equation = 4 * np.degrees(y * np.sin(2 * long) - 2 * e * np.sin(m) + 4 * e * y * np.sin(m) * np.cos(2 * long) - 0.5 * y * y * np.sin(4 * long) - 1.25 * e * e * np.sin(2 * m))
    declination = np.arcsin(np.sin(tilt) * np.sin(apparent))
    hour = np.radians(((t - np.floor(t / DAY_S) * DAY_S) / 60 + equation + 4 * lon) / 4 - 180)
    p = np.radians(lat)
    return 90 - np.degrees(np.arccos(np.clip(np.sin(p) * np.sin(declination) + np.cos(p) * np.cos(declination) * np.cos(hour), -1.0, 1.0)))


def with_events(rows: DataFrame) -> DataFrame:
    """rows (lat, lon, day, ...) with the events of the day as `e`: as `events` has them, the halvings of a batch together."""

    @F.pandas_udf("double")
    def refined_all(lat: pd.Series, lon: pd.Series, guess: pd.Series, sign: pd.Series) -> pd.Series:
        lat, lon, guess, sign = (x.to_numpy(np.float64) for x in (lat, lon, guess, sign))
        lo, hi = guess - WINDOW_S, guess + WINDOW_S
        stays = (sign * (altitudes(lat, lon, lo) - HORIZON_DEG) > 0) | (sign * (altitudes(lat, lon, hi) - HORIZON_DEG) < 0)
        for _ in range(HALVINGS):
            middle = (lo + hi) / 2
            low = sign * (altitudes(lat, lon, middle) - HORIZON_DEG) < 0
            lo, hi = np.where(low, middle, lo), np.where(low, hi, middle)
        return pd.Series(np.where(stays, guess, (lo + hi) / 2))

    rows = rows.withColumn("g_", _events(F.col("lat"), F.col("lon"), F.col("day"), lambda guess, _: guess))
    rise, set_ = (F.when(F.col(f"g_.{x}").isNotNull(), refined_all("lat", "lon", f"g_.{x}", F.lit(sign))).alias(x) for x, sign in (("sunrise", 1.0), ("sunset", -1.0)))
    return rows.withColumn("e", F.struct(rise, set_, F.col("g_.polar").alias("polar"))).drop("g_")


def daylight_arrival(lat: Column, lon: Column, t: Column, margin_s: int = 3600) -> Column:
    """struct(is_daylight, kind)."""
    return bind(events(lat, lon, t), lambda e: arrival_verdict(e, t, margin_s))


def arrival_verdict(e: Column, t: Column, margin_s: int = 3600) -> Column:
    """The same by the events of its day."""
    inside = F.coalesce((t >= e["sunrise"] + margin_s) & (t <= e["sunset"] - margin_s), F.lit(False))
    return F.struct(
        F.when(e["polar"] == "none", inside).otherwise(e["polar"] == "day").alias("is_daylight"),
        F.when(e["polar"] == "none", "window").otherwise(F.concat(F.lit("polar-"), e["polar"])).alias("kind"),
    )


def light_meets(e: Column, since: Column, until: Column, margin_s: int = 3600) -> Column:
    """Does the light of a day's events meet the span?"""
    low, high = e["sunrise"] + margin_s, e["sunset"] - margin_s
    return (e["polar"] == "day") | F.coalesce((low <= high) & (low <= until) & (high >= since), F.lit(False))


def daylight_within(lat: Column, lon: Column, since: Column, until: Column, margin_s: int = 3600) -> Column:
    """Does any day's light, from a day before to a day after, meet the span?"""

    def meets(e: Column) -> Column:
        return light_meets(e, since, until, margin_s)

    days = F.transform(F.sequence(since - DAY_S, until + DAY_S, F.lit(DAY_S).cast("long")), lambda t: events(lat, lon, t))
    return F.when(until < since, F.lit(False)).otherwise(F.exists(days, meets))
