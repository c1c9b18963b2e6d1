"""From traffic flow to speed to seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the flow curve: flow = A v^2 + B v.
A, B = -1.4648375, 93.75
MAX_FLOW, MAX_SPEED = 1500.0, 60.0
DEFAULT_FLOW, FALLBACK_SPEED, DELAY_S = 500.0, 30.0, 30.0


def speed(flow: Column, over_capacity: bool = False) -> Column:
    """km/h at a flow: the faster root (the slower one over capacity), 0 to 60, rounded half to even; null outside 0 to 1500."""
    root = F.sqrt(F.lit(B * B) + F.lit(4 * A) * flow)
    v = (F.lit(-B) + root if over_capacity else F.lit(-B) - root) / F.lit(2 * A)
    return F.when(flow.between(F.lit(0.0), F.lit(MAX_FLOW)), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(MAX_SPEED), v)), 0))


def seconds(distance_m: Column, kmh: Column) -> Column:
    """Driving time to two places; null for no speed."""
    return F.when(kmh > 0, F.bround(distance_m / (kmh * 1000 / 3600), 2))


def edge_seconds(distance_m: Column, flow: Column, unit: float = 1.0) -> Column:
    """Time over an edge with a fixed delay; flows off the curve drive at a fallback speed. ``unit``: flow units in a vehicle an hour."""
    kmh = speed(flow * unit)
    return seconds(distance_m, F.when(kmh > 0, kmh).otherwise(F.lit(FALLBACK_SPEED))) + F.lit(DELAY_S)


def minutes_text(cost: Column) -> Column:
    """``m min s sec`` of whole seconds; null for no cost."""
    whole = F.floor(cost).cast("long")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(" min "), (whole % 60).cast("string"), F.lit(" sec"))


def desirability(pheromone: Column, cost: Column, alpha: float = 1.0, beta: float = 2.0) -> Column:
    """pheromone^alpha * (1/cost)^beta; a cost of zero counts as the smallest positive step."""
    return F.pow(pheromone, F.lit(alpha)) * F.pow(1 / F.when(cost == 0, F.lit(1e-9)).otherwise(cost), F.lit(beta))
