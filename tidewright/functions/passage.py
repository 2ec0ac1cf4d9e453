"""Rules of a passage's steps, bounds and gates, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.angles import angle_between, norm360, step_lat, step_lon
from tidewright.functions.seaway import boat_speed, half_up, wave_factor

#: Speeds at or below this stand still; longest detour of an eight-neighbour path; the default slack and margin of a reach; bits of missing fields.
STILL_KN, DETOUR, SLACK, MARGIN = 0.05, math.sqrt(4 - 2 * math.sqrt(2)), 1.09, 0.25
NO_WAVES, NO_CURRENT = 1 << 8, 1 << 10
#: A member's wind counts for so long after departure, and the margin that keeps a harbour's bound admissible.
MEMBER_HORIZON_S, ADMISSIBLE_KN = 48 * 3600, 0.3
MOTOR, NIGHT, BEAT, AGAINST = 2, 4, 8, 16


def guard_band(local: Column, field: Column) -> Column:
    """The local decode error where it is finite and not negative, else the field's."""
    return F.when(local.isNull() | F.isnan(local) | (local < 0) | (local == float("inf")), field).otherwise(local)


def hard_limit(tws: Column, band: Column, hs: Column, max_tws: float, max_hs: float) -> Column:
    """tws, hs or ok: which of the boat's limits is passed first. The wind's limit is lowered by the band, unknown waves pass."""
    return F.when(tws > max_tws - band, "tws").when(F.coalesce(hs > max_hs, F.lit(False)), "hs").otherwise("ok")


def through_water(heading: Column, wind_from: Column, tws: Column, hs: Column, waves_from: Column, motor_below: float, motor_kn: float) -> dict[str, Column]:
    """twa, bsp and motor of one step. Waves without a direction come with the wind."""
    twa = angle_between(wind_from, heading)
    waves = F.when(hs.isNull(), 1.0).otherwise(wave_factor(hs, F.coalesce(angle_between(waves_from, heading), twa)))
    sails = boat_speed(tws, twa) * waves
    motor = sails < motor_below
    return {"twa": twa, "bsp": F.when(motor, motor_kn * waves).otherwise(sails), "motor": motor}


def over_ground(heading: Column, bsp: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """Speeds to the east and north."""
    return bsp * F.sin(F.radians(heading)) + F.coalesce(u, F.lit(0.0)), bsp * F.cos(F.radians(heading)) + F.coalesce(v, F.lit(0.0))


def made_good(bsp: Column, east: Column, north: Column) -> Column:
    """Speed over ground, NULL where the boat stands still."""
    return F.when((bsp > STILL_KN) & (F.hypot(east, north) > STILL_KN), F.hypot(east, north))


def course_of(east: Column, north: Column) -> Column:
    return norm360(F.degrees(F.atan2(east, north)))


def kinematics(lat: Column, lon: Column, heading: Column, wind_from: Column, tws: Column, hs: Column, waves_from: Column, u: Column, v: Column, step_s: int, motor_below: float, motor_kn: float) -> dict[str, Column]:
    """twa, bsp, motor, sog, course, nm and the next position of one step; speeds are NULL where the boat stands still."""
    water = through_water(heading, wind_from, tws, hs, waves_from, motor_below, motor_kn)
    east, north = over_ground(heading, water["bsp"], u, v)
    sog = made_good(water["bsp"], east, north)
    course, nm = F.when(sog.isNotNull(), course_of(east, north)), sog * step_s / 3600
    return water | {"sog": sog, "course": course, "nm": nm, "next_lat": step_lat(lat, course, nm), "next_lon": step_lon(lat, lon, course, nm)}


def soft_costs(twa: Column, motor: Column, night: Column, against: Column, step_s: int, penalty_s: Column, beat_twa: float = 60.0) -> dict[str, Column]:
    """Time with the penalty, and the seconds of beating, motor and night without it; flags."""
    beat = twa < beat_twa

    def when(x: Column, value: int) -> Column:
        return F.when(x, value).otherwise(0)

    return {"dt": step_s + penalty_s, "beat": when(beat, step_s), "motor": when(motor, step_s), "night": when(night, step_s), "flags": when(beat, BEAT) + when(motor, MOTOR) + when(night, NIGHT) + when(against, AGAINST)}


def accumulated(parent: Column, part: Column) -> Column:
    """Each step's part is rounded half up before it is added."""
    return parent + half_up(part)


def missing_data(current: Column, waves: Column) -> Column:
    return F.when(current.isNull(), NO_CURRENT).otherwise(0) + F.when(waves.isNull(), NO_WAVES).otherwise(0)


def reach_nm(bound_s: Column, vmax_kn: Column, slack: Column, margin: Column) -> Column:
    """How far the field's bound lets a search go; NULL where it is unbounded."""
    return F.when(vmax_kn > 0, F.coalesce(slack, F.lit(SLACK)) * vmax_kn * bound_s * (1 + F.coalesce(margin, F.lit(MARGIN))) / 3600)


def field_bound_nm(raw_nm: Column, cell_deg: float, widest_lat: float) -> Column:
    """What a path along cells proves of the true distance: without the longest detour and two cells' diagonals."""
    diagonal = math.hypot(cell_deg * 60, cell_deg * 60 * math.cos(math.radians(widest_lat)))
    return F.greatest(F.lit(0.0), raw_nm / DETOUR - 2 * diagonal)


def share_of(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.try_divide(part, whole))


def depth_gate(depth: Column, other: Column, required: Column) -> Column:
    """missing, shallow or ok; of two depths the lesser counts."""
    least = F.least(depth, other)
    return F.when(least.isNull(), "missing").when(least < required, "shallow").otherwise("ok")


def length_weight(weight: Column, nm: Column) -> Column:
    """A ranking weight that grows with the passage's length."""
    return weight * (1 + F.log10(F.greatest(F.lit(1.0), nm / 10)))


def wave_level(hs: Column, tp: Column, from_deg: Column) -> dict[str, Column]:
    """Waves count only with a height, never below 0; period and direction may lack."""
    return {"hs": F.when(hs.isNotNull(), F.greatest(hs, F.lit(0.0))), "tp": F.when(hs.isNotNull(), tp), "from_deg": F.when(hs.isNotNull(), from_deg)}
