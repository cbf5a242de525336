"""Colour maps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Value and red, green, blue from 0 to 255, by rising value.
Stops = list[tuple[float, int, int, int]]


def mapped(value: Column, stops: Stops) -> tuple[Column, Column, Column]:
    """Red, green and blue of a value, linear between the stops of a colour table and constant beyond its ends; null stays null."""
    out = []
    for k in range(1, 4):
        c = F.when(value >= stops[-1][0], F.lit(float(stops[-1][k])))
        for low, high in reversed(list(zip(stops, stops[1:]))):
            c = c.when(value >= low[0], low[k] + (value - low[0]) * (high[k] - low[k]) / (high[0] - low[0]))
        out.append(c.when(value < stops[0][0], F.lit(float(stops[0][k]))))
    return tuple(out)
