"""Masses, radii, positions and geometric transforms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layout units are stored as integers of a twentieth.
QUANTUM = 20


def mass(cites: Column, exponent: float = 1.0) -> Column:
    """0.2 for a paper without citations, and 0.2 for each, to the power ``exponent``; null counts as none."""
    return 0.2 + 0.2 * F.pow(F.coalesce(cites, F.lit(0)).cast("double"), F.lit(exponent))


def radius(mass_: Column) -> Column:
    return F.sqrt(mass_ / math.pi)


def quantised(x: Column) -> Column:
    """A layout coordinate as stored: twentieths, halves away from zero."""
    return F.round(x * QUANTUM).cast("int")


def dequantised(x: Column) -> Column:
    return x.cast("double") / QUANTUM


def world_to_screen(x: Column, y: Column, scale: float, dx: float, dy: float) -> tuple[Column, Column]:
    return x * scale + dx, y * scale + dy


def screen_to_world(x: Column, y: Column, scale: float, dx: float, dy: float) -> tuple[Column, Column]:
    return (x - dx) / scale, (y - dy) / scale


def fitting_scale(sd_x: float, sd_y: float, width: float, height: float, deviations: float) -> float:
    """The scale at which ``deviations`` standard deviations to either side of the centre fill the screen."""
    return min(width / max(2 * deviations * sd_x, 1e-12), height / max(2 * deviations * sd_y, 1e-12))


def rotated(x: Column, y: Column, angle: Column | float) -> tuple[Column, Column]:
    """Turned about the origin by ``angle`` radians."""
    a = F.lit(angle) if isinstance(angle, (int, float)) else angle
    return x * F.cos(a) - y * F.sin(a), x * F.sin(a) + y * F.cos(a)


def link_weight(freq: Column, other: Column | None = None, ref_factor: float = 1.0, other_factor: float = 0.0) -> Column:
    """Weight of a link: the reference's frequency squared, and any other weight, each with its factor."""
    base = ref_factor * freq.cast("double") * freq
    return base if other is None else base + other_factor * F.coalesce(other, F.lit(0.0))


def age_weakening(id_a: Column, id_b: Column) -> Column:
    """Factor by which a link between papers far apart in time may be weakened."""
    return 0.4 + 0.6 * F.exp(-F.pow(1e-7 * (id_a - id_b), 2))


def heat(days: Column) -> Column:
    """How recent a paper is: a normal curve of four years' deviation with an exponential tail."""
    return F.exp(-F.pow(days / F.lit(4.0 * 365), 2) / 2 - 0.0001 * days)
