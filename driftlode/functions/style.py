"""How a map shows posterior cells and vessels: colours, radii and opacities as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The colours between which a cell's share is blended, from none to the largest.
RAMP = ((11, 60, 92), (16, 122, 138), (53, 224, 210), (188, 255, 244))


def cell_colour(share: Column, opacity: Column) -> Column:
    """array(red, green, blue, opacity) of a cell whose share of the largest is ``share``."""
    x = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (len(RAMP) - 1)
    low = F.least(F.floor(x), F.lit(len(RAMP) - 2)).cast("int")
    stops = [F.array(*[F.lit(c[k]) for c in RAMP]) for k in range(3)]
    mixed = [F.floor(F.get(s, low) + (F.get(s, low + 1) - F.get(s, low)) * (x - low) + 0.5).cast("int") for s in stops]
    return F.array(*mixed, opacity.cast("int"))


def cell_radius_m(share: Column) -> Column:
    return 900 + 5200 * F.sqrt(share)


def cell_opacity(age: Column, leads: Column) -> Column:
    """The cells of the time shown stand out, earlier ones fade."""
    return F.when(leads, 210).otherwise(F.greatest(F.lit(70), 190 - age * 12))


def vessel_radius_px(score: Column, selected: Column) -> Column:
    return F.when(selected, 10.0).otherwise(6 + score / 100 * 4)


def vessel_colour(score: Column, inside: Column) -> Column:
    s = score / 100
    mixed = [F.floor(a + b * s + 0.5).cast("int") for a, b in ((78, 177), (122, -32), (140, -45))]
    return F.array(*mixed, F.when(inside, 235).otherwise(130))
