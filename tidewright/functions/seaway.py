"""Boat, wind, waves, traffic rules, cells and flags, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.angles import angle_between, clamp, norm180, norm360

#: The names of the route flags, by bit.
FLAG_NAMES = [
    "USIKKER_TILLIT", "MOTOR", "NATT", "KRYSS", "VIND_MOT_STROM", "TSS_LANGS", "SJOEGANGS_MARGIN_OVERSKREDET", "NEGATIV_VANNSTAND_RISIKO",
    "SJOEGANG_DATA_MANGLER", "VAERDEKNING_BEGRENSET", "STROM_DATA_MANGLER", "STROM_KYSTSONE", "BOLGE_PUNKT_KATEGORI_UNDER_5NM",
    "BOLGE_PUNKT_KATEGORI_5_20NM", "BOLGE_PUNKT_KATEGORI_OVER_20NM", "STROM_UKJENT_VED_ANKOMST",
]
WAVE_BITS = (1 << 12, 1 << 13, 1 << 14)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def course_sector(course: Column) -> Column:
    return F.floor(norm360(course + 22.5) / 45) % 8


def state_key(cell: Column, sector: Column) -> Column:
    return cell * 9 + sector


def cell_key(lat: Column, lon: Column, south: float, west: float, step_lat: float, step_lon: float, rows: int, columns: int) -> Column:
    """The cell of half-up rounded indices; NULL outside the domain."""
    i, j = half_up((lat - south) / step_lat), half_up((lon - west) / step_lon)
    return F.when((i >= 0) & (i < rows) & (j >= 0) & (j < columns), i * columns + j)


def tack_side(course: Column, wind_from: Column, beat_twa: float = 60.0) -> Column:
    """-1 or 1 on the wind, 0 off it."""
    twa = angle_between(course, wind_from)
    return F.when(twa >= beat_twa, 0).otherwise(F.signum(norm180(course - (wind_from + 180))).cast("int"))


def tack_penalty(course: Column, next_course: Column, tack: Column, next_tack: Column) -> Column:
    """Seconds lost by a manoeuvre."""
    turn = angle_between(course, next_course)
    flip = (tack != 0) & (next_tack != 0) & (tack != next_tack)
    return F.when(turn <= 15, 0).otherwise(half_up(30 * clamp(turn / 90, 0.0, 2.0) + F.when(flip, 60).otherwise(0))).cast("long")


def tss_rule(kind: Column, angle: Column, with_direction: Column) -> Column:
    """ok, flag or reject of a course through a traffic scheme: across at 60 degrees or more, along only with the lane."""
    return F.when(kind == "none", "ok").when(kind == "crossing", F.when(angle >= 60, "ok").otherwise("reject")).otherwise(F.when(with_direction, "flag").otherwise("reject"))


def wind_u(speed: Column, from_deg: Column) -> Column:
    return -speed * F.sin(F.radians(from_deg))


def wind_v(speed: Column, from_deg: Column) -> Column:
    return -speed * F.cos(F.radians(from_deg))


def wind_from(u: Column, v: Column) -> Column:
    """Where it blows from; 180 of no wind at all."""
    return F.when((u == 0) & (v == 0), 180.0).otherwise(norm360(F.degrees(F.atan2(-u, -v))))


def steepness(hs: Column, period: Column) -> Column:
    return F.when(period > 0, 2 * 3.141592653589793 * hs / (9.81 * period * period))


def boat_speed(tws: Column, twa: Column, cruising: float = 1.0) -> Column:
    """The test boat's polar: nothing below 32 degrees, best at 100."""
    shape = F.when(twa < 32, 0.0).when(twa <= 100, 0.55 + 0.45 * (twa - 32) / 68).otherwise(1 - 0.25 * (twa - 100) / 80)
    return 8.5 * (1 - F.exp(-F.least(tws, F.lit(25.0)) / 9)) * shape * cruising


def wave_factor(hs: Column, relative: Column) -> Column:
    k = F.when(relative < 60, 0.09).when(relative <= 120, 0.045).otherwise(0.02)
    return F.when(hs <= 0, 1.0).otherwise(F.greatest(F.lit(0.45), 1 - k * hs))


def wind_against_current(wind_from_deg: Column, u: Column, v: Column) -> Column:
    """Half a knot or more that sets over 135 degrees off where the wind blows to."""
    sets = norm360(F.degrees(F.atan2(u, v)))
    return F.coalesce((F.hypot(u, v) >= 0.5) & (angle_between(sets, norm360(wind_from_deg + 180)) > 135), F.lit(False))


def wave_category(nm: Column) -> Column:
    near, middle, far = WAVE_BITS
    return F.when(nm.isNull() | F.isnan(nm), 0).when(nm < 5, near).when(nm <= 20, middle).otherwise(far)


def flag_names(flags: Column) -> Column:
    return F.array_compact(F.array(*[F.when(flags.bitwiseAND(1 << bit) != 0, F.lit(name)) for bit, name in enumerate(FLAG_NAMES)]))


def direction_error(speed: Column, error: Column) -> Column:
    """The largest error of a direction, in degrees; NULL where the speed is within the error."""
    return F.when(error <= 0, 0.0).when(speed > error, F.degrees(F.asin(F.least(F.lit(1.0), F.try_divide(error, speed)))))


def cone_constant(parallel_1: float, parallel_2: float) -> Column:
    """Of a Lambert conformal conic projection."""
    p, q = F.radians(F.lit(parallel_1)), F.radians(F.lit(parallel_2))
    if parallel_1 == parallel_2:
        return F.sin(p)
    quarter = 3.141592653589793 / 4
    return F.ln(F.cos(p) / F.cos(q)) / F.ln(F.tan(quarter + q / 2) / F.tan(quarter + p / 2))


def convergence(lon: Column, cone: Column, central: float) -> Column:
    """Radians between grid north and true north."""
    return cone * F.radians(norm180(lon - central))


def rotate_u(u: Column, v: Column, angle: Column) -> Column:
    return u * F.cos(angle) + v * F.sin(angle)


def rotate_v(u: Column, v: Column, angle: Column) -> Column:
    return v * F.cos(angle) - u * F.sin(angle)


def float_down(x: Column) -> Column:
    """The largest float32 that is not above x, as a double. The step to the float below is half an ulp, rounded back."""
    near = x.cast("float").cast("double")
    return F.when(near <= x, near).otherwise((near - F.abs(near) * 2.0**-24 - 1e-46).cast("float").cast("double"))


def bits_for(codes: Column) -> Column:
    return F.when(codes <= 0, 1).otherwise(F.ceil(F.log2((codes + 1).cast("double"))))


def clearance_required(offing: Column, hs: Column, per_m: float = 0.1) -> Column:
    return offing + F.coalesce(hs * per_m, F.lit(0.0))
