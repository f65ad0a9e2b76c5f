"""Colours of papers on the map and in the layout view, as structs (r, g, b) of doubles from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"))


def heat_colour(heat: Column, cold: tuple[float, float, float], warm: tuple[float, float, float]) -> Column:
    """Between the cold and the warm colour, by heat."""
    return _rgb(*[F.lit(c) + (w - c) * heat for c, w in zip(cold, warm)])


def category_colour(col: Column, dim: Column, age: Column) -> Column:
    """A category's colour, pale and dark for old papers, full and bright for new ones.

    col: array of 3; dim: array of 2 (base and gain of the dimming); age: 0 old, 1 new.
    """
    pale = 0.1 + 0.3 * (1 - age)
    dimmed = F.least(F.lit(1.0), dim[0] + dim[1] * F.exp(-4 * (1 - age) * (1 - age)))
    return _rgb(*[dimmed * (pale + col[k] * (1 - pale)) for k in range(3)])


def grey(rgb: Column) -> Column:
    """The same luminance without hue."""
    lum = 0.289 * rgb["r"] + 0.587 * rgb["g"] + 0.114 * rgb["b"]
    return _rgb(lum, lum, lum)


def layout_colour(col: Column, age: Column) -> Column:
    """The layout view's colour: paler when old, redder when new."""
    pale, red = 0.6 * (1 - age), F.pow(age, 4)
    return _rgb(pale + (col[0] * (1 - red) + red) * (1 - pale), *[pale + col[k] * (1 - red) * (1 - pale) for k in (1, 2)])
