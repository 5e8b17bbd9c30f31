"""Scalar formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rpm_to_radians(rpm: Column) -> Column:
    return rpm * F.pi() * 2 / 60


def quadratic_roots(a: Column, b: Column, c: Column) -> Column:
    """struct(r1, r2, imag) of a x^2 + b x + c: real parts, larger first, and the imaginary part; null if a is 0."""
    d, mid = b * b - 4 * a * c, -b / (2 * a)
    half = F.sqrt(F.abs(d)) / F.abs(2 * a)
    return F.when(a != 0, F.struct(F.when(d >= 0, mid + half).otherwise(mid).alias("r1"), F.when(d >= 0, mid - half).otherwise(mid).alias("r2"), F.when(d < 0, half).otherwise(F.lit(0.0)).alias("imag")))


def hat(x: Column, span: Column) -> Column:
    """The hat function on [0, span]: up to 1 in the middle, down to 0 again; 0 outside."""
    tip = span / 2
    return F.when((x < 0) | (x > span), F.lit(0.0)).when(x < tip, x / tip).otherwise(2 - x / tip)


def second_order_response(s: Column, sigma: Column, omega: Column) -> Column:
    """Step response of a second-order system in the Laplace domain at ``s``; null where s or omega is 0."""
    far = (s + sigma) * (s + sigma) + omega * omega
    return F.when((s != 0) & (omega != 0) & (far != 0), 1 / s - (s + sigma) / far - sigma / far)


def motion_profile(distance: Column, speed: Column, up: Column, down: Column) -> Column:
    """struct(peak, t_up, t_flat, t_down, total) of a move that speeds up, runs and slows down; the peak is lowered if it can't be reached."""
    peak = F.least(speed, F.sqrt(2 * distance * up * down / (up + down)))
    flat = F.greatest(F.lit(0.0), F.try_divide(distance - peak * peak / (2 * up) - peak * peak / (2 * down), peak))
    return F.struct(peak.alias("peak"), (peak / up).alias("t_up"), flat.alias("t_flat"), (peak / down).alias("t_down"), (peak / up + flat + peak / down).alias("total"))


def distance_at(t: Column, p: Column, up: Column, down: Column) -> Column:
    """How far a profile has come at time ``t``."""
    t1, t2, total = p["t_up"], p["t_up"] + p["t_flat"], p["total"]
    left = total - t
    end = p["peak"] * p["t_up"] / 2 + p["peak"] * p["t_flat"] + p["peak"] * p["t_down"] / 2
    return F.when(t <= 0, F.lit(0.0)).when(t <= t1, up * t * t / 2).when(t <= t2, p["peak"] * t1 / 2 + p["peak"] * (t - t1)).when(t < total, end - down * left * left / 2).otherwise(end)


def descent_at(t: Column, p: Column, up: Column, down: Column) -> Column:
    """The height left at time ``t`` of the way back, run as the way up in reverse."""
    return distance_at(p["total"] - t, p, up, down)


def time_at(d: Column, p: Column, distance: Column, up: Column, down: Column) -> Column:
    """When a profile has come ``d`` far."""
    d1 = p["peak"] * p["t_up"] / 2
    d2 = d1 + p["peak"] * p["t_flat"]
    return F.when(d <= 0, F.lit(0.0)).when(d >= distance, p["total"]).when(d < d1, F.sqrt(2 * d / up)).when(d > d2, p["total"] - F.sqrt(2 * (distance - d) / down)).otherwise(p["t_up"] + (d - d1) / p["peak"])


def modulus(v: Column, iv: Column) -> Column:
    return F.sqrt(v * v + iv * iv)


def five_chars(v: Column) -> Column:
    """A number in about five characters, padded: a two-digit mantissa and exponent from 10000, whole from 100 or if it is, one decimal from 10, else two."""
    a = F.abs(v)
    e = F.floor(F.log10(a)).cast("int") - 1
    e = F.when(e >= 10, e + 1).otherwise(e)
    whole = F.abs(v - v.cast("bigint")) <= 1e-8
    n = v.cast("bigint")
    return (
        F.when(a >= 10000, F.concat(F.when(v < 0, F.lit(" ")).otherwise(F.lit("  ")), (v / F.pow(F.lit(10.0), e)).cast("bigint").cast("string"), F.lit("e"), e.cast("string"), F.lit(" ")))
        .when(a >= 100, F.format_string("%6d ", n)).when((a >= 10) & whole, F.format_string("%5d  ", n)).when(a >= 10, F.format_string("%6.1f ", v))
        .when(whole, F.format_string("%4d   ", n)).otherwise(F.format_string("%6.2f ", v))
    )


def rotor_thickness(speed: Column, conductivity: Column) -> Column:
    """The least rotor thickness of a homopolar bearing at its lowest speed. Fixed value: 4 pi 10e-7."""
    return F.sqrt(2 / (speed * conductivity * 4 * F.pi() * 10e-7))


def flux_gradients(remanent: Column, magnet_in: Column, magnet_out: Column, rotor: Column, gap: Column, spare: Column) -> Column:
    """struct(inner, outer, middle): radial flux gradients from radii, rotor thickness, air gap and emergency gap."""
    span = rotor + gap * 2
    return F.struct(
        (remanent * ((magnet_in - gap - rotor - spare) - (magnet_in - spare)) / span).alias("inner"),
        (remanent * ((magnet_out + spare) - (magnet_out + gap + spare)) / span).alias("outer"),
        (-2 * remanent / (rotor + 2 * (gap + spare))).alias("middle"),
    )


def normal_flux(speed: Column, time: Column, displacement: Column, angle: Column, middle: Column) -> Column:
    """struct(change, density): change in time and density of the normal flux. Fixed value: a homopolar part of 0.244 T."""
    scale = speed * displacement * -middle
    return F.struct((scale * F.cos(speed * time + angle)).alias("change"), (scale * F.sin(speed * time + angle) + 0.244).alias("density"))


def flywheel(rims: DataFrame, height: float, rpm: float) -> DataFrame:
    """Inertia, energy and hoop-limit speed of each device from its rims (device, r_in, r_out, density, strength)."""
    w = rpm * 2 * 3.141592653589793 / 60
    totals = rims.groupBy("device").agg(
        (F.lit(3.141592653589793 / 2 * height) * F.sum(F.col("density") * (F.pow("r_out", F.lit(4.0)) - F.pow("r_in", F.lit(4.0))))).alias("inertia"),
        F.max_by(F.sqrt(F.col("strength") / F.col("density")), "r_out").alias("hoop_speed"),
    )
    return totals.select("device", "inertia", (F.col("inertia") * (w * w / 2)).alias("energy"), "hoop_speed")
