"""Curve operators: a curve is an array of 256 outputs, and each operator is an expression over arrays."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.color import byte, half_up, num

CONTROL_POINTS = 12


def _by_value(fn) -> Column:
    """An array over the input values 0..255."""
    return F.transform(F.sequence(F.lit(0), F.lit(255)), fn)


def bound(c: Column, fn) -> Column:
    """fn of c, where c is computed once however often fn uses it, as inside a function over an array."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def at(curve: Column, v: Column) -> Column:
    return F.element_at(curve, v + 1)


def blend(curve: Column, amount: float) -> Column:
    a = min(1.0, max(0.0, amount))
    return F.transform(curve, lambda c, v: half_up(v + (c - v) * num(a)))


def toward_identity(curve: Column, strength: float) -> Column:
    return curve if strength >= 1 else blend(curve, strength)


def monotonic(curve: Column) -> Column:
    def add(acc: Column, c: Column) -> Column:
        return F.concat(acc, F.array(F.greatest(c, F.coalesce(F.try_element_at(acc, F.lit(-1)), c))))

    return F.aggregate(curve, F.array().cast("array<int>"), add)


def smooth(curve: Column, radius: float) -> Column:
    """Box mean over 2r + 1 values, mirrored at both ends."""
    if radius < 1:
        return curve
    return bound(curve, lambda c: _smooth(c, min(64, math.floor(radius))))


def _smooth(curve: Column, r: int) -> Column:
    mirror = lambda i: F.when(i < 0, -i).when(i > 255, 510 - i).otherwise(i)

    def mean(v: Column) -> Column:
        total = F.aggregate(F.sequence(v - r, v + r), F.lit(0), lambda acc, i: acc + at(curve, mirror(i)))
        return half_up(total / num(2 * r + 1))

    return _by_value(mean)


def cap(curve: Column, ratio: float, start: Column | int = 0, end: Column | int = 255) -> Column:
    """Soft limit of the slope: each output follows its neighbour by ratio * tanh(step / ratio), upwards and then downwards, from start to end."""
    if ratio <= 0:
        return curve
    lo = F.greatest(F.lit(0), F.least(F.lit(254), F.lit(start) if isinstance(start, int) else start))
    hi = F.greatest(lo + 1, F.least(F.lit(255), F.lit(end) if isinstance(end, int) else end))

    def follow(c: Column, first: Column, last: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            before = F.element_at(acc, -1)
            i = F.size(acc)
            soft = byte(before + num(ratio) * F.tanh((x - before) / num(ratio)))
            return F.concat(acc, F.array(F.when((i > first) & (i <= last), soft).otherwise(x)))

        return F.aggregate(F.slice(c, 2, 255), F.slice(c, 1, 1), add)

    return bound(F.struct(lo.alias("lo"), hi.alias("hi")), lambda e: F.reverse(follow(F.reverse(follow(curve, e["lo"], e["hi"])), 255 - e["hi"], 255 - e["lo"])))


def process(curve: Column, amount: float = 1.0, smooth_radius: float = 0, max_stretch: float = 999, start: Column | int = 0, end: Column | int = 255) -> Column:
    """Cap (for ratios below 100), blend, smooth, monotone."""
    if 0 < max_stretch < 100:
        curve = cap(curve, max_stretch, start, end)
    return monotonic(smooth(blend(curve, amount), smooth_radius))


@dataclass(frozen=True)
class Dimensions:
    value: float = 100
    chroma: float = 100
    hue_shift: float = 0
    contrast: float = 100
    neutralize: float = 0
    separation: float = 100


def dimensions(r: Column, g: Column, b: Column, o: Dimensions) -> tuple[Column, Column, Column]:
    """Chroma, hue, value, neutral ends, separation and contrast of the three curves together; each is monotone after."""
    c, s = math.cos(math.radians(o.hue_shift)), math.sin(math.radians(o.hue_shift))
    k, pull = 1 / math.sqrt(3), min(1.0, max(0.0, o.neutralize / 100))

    def one(i: int, r: Column, g: Column, b: Column):
        def at_value(v: Column) -> Column:
            own = [at(x, v) for x in (r, g, b)]
            mean = (own[0] + own[1] + own[2]) / num(3)
            d = [(x - mean) * num(o.chroma / 100) for x in own]
            if o.hue_shift:
                dot = (d[0] + d[1] + d[2]) * num(k) * num(k)
                turned = num(k) * (d[(i + 1) % 3] - d[(i + 2) % 3])
                part = d[i] * num(c) + turned * num(s) + dot * num(1 - c)
            else:
                part = d[i]
            x = v + (mean - v) * num(o.value / 100) + part
            if pull > 0:
                far = (v - num(127.5)) / num(127.5)
                x = x + (v - x) * (num(pull) * far * far)
            if o.separation != 100:
                x = num(127.5) + (x - num(127.5)) * num(o.separation / 100)
            if o.contrast != 100 and o.contrast > 0:
                t = (F.greatest(num(0), F.least(num(255), x)) / num(255) - num(0.5)) * num(2)
                x = (num(0.5) + F.when(t < 0, num(-1)).otherwise(num(1)) * F.pow(F.abs(t), num(100 / o.contrast)) * num(0.5)) * num(255)
            return byte(x)

        return at_value

    three = F.struct(r.alias("r"), g.alias("g"), b.alias("b"))
    curve = lambda i: bound(three, lambda x: _by_value(one(i, x["r"], x["g"], x["b"])))
    return tuple(monotonic(curve(i)) for i in range(3))


@dataclass(frozen=True)
class Zone:
    amount: float = 100
    anchor: float = 127
    falloff: float = 50
    bias: float = 0


ZONES = (Zone(anchor=42), Zone(anchor=127), Zone(anchor=212))


def zone_weights(zones: tuple[Zone, Zone, Zone] = ZONES) -> Column:
    """256 weights: amounts shared out by bells around the anchors, which bias makes stronger."""

    def at_value(v: Column) -> Column:
        bells = []
        for z in zones:
            sigma = 18 + z.falloff / 100 * 60
            bells.append(num(math.exp(z.bias / 50)) * F.exp(-((v - num(z.anchor)) * (v - num(z.anchor))) * num(1 / (2 * sigma * sigma))))
        total = bells[0] + bells[1] + bells[2]
        return (num(zones[0].amount / 100) * bells[0] + num(zones[1].amount / 100) * bells[1] + num(zones[2].amount / 100) * bells[2]) / F.when(total == 0, num(1)).otherwise(total)

    return _by_value(at_value)


def zone_weights_of(zones: Column) -> Column:
    """As zone_weights, for a column of array<struct<amount, anchor, falloff, bias>>: every row has zones of its own."""
    part = lambda z, sigma: F.struct((z["amount"] / num(100)).alias("amount"), z["anchor"].alias("anchor"), F.exp(z["bias"] / num(50)).alias("top"), (num(2) * sigma * sigma).alias("width"))

    def at_value(parts: Column, v: Column) -> Column:
        bell = lambda z: z["top"] * F.exp(-((v - z["anchor"]) * (v - z["anchor"])) / z["width"])
        add = lambda acc, z: bound(bell(z), lambda b: F.struct((acc["own"] + z["amount"] * b).alias("own"), (acc["all"] + b).alias("all")))
        return F.aggregate(parts, F.struct(num(0).alias("own"), num(0).alias("all")), add, lambda x: x["own"] / F.when(x["all"] == 0, num(1)).otherwise(x["all"]))

    return bound(F.transform(zones, lambda z: part(z, num(18) + z["falloff"] / num(100) * num(60))), lambda parts: _by_value(lambda v: at_value(parts, v)))


@dataclass(frozen=True)
class Knot:
    position: float
    weight: float
    smooth: bool | None = None


ENVELOPE = (Knot(0, 1, True), Knot(127, 1, True), Knot(255, 1, True))


def tangents(x: list[float], y: list[float]) -> list[float]:
    """Slopes at the knots of a monotone cubic: zero at extrema, and limited from left to right."""
    steps = [(y[k + 1] - y[k]) / ((x[k + 1] - x[k]) or 1) for k in range(len(x) - 1)]
    m = [steps[0], *[0 if p * q <= 0 else (p + q) / 2 for p, q in zip(steps, steps[1:], strict=False)], steps[-1]]
    for k, step in enumerate(steps):
        if step == 0:
            m[k] = m[k + 1] = 0
        elif (size := math.hypot(m[k] / step, m[k + 1] / step)) > 3:
            m[k], m[k + 1] = m[k] * 3 / size, m[k + 1] * 3 / size
    return m


def envelope_weights(knots: tuple[Knot, ...] = ENVELOPE) -> Column:
    """256 weights through the knots: cubic between two smooth knots, else straight; held outside."""
    if len(knots) < 2:
        return F.array_repeat(num(max(0, knots[0].weight) if knots else 1), 256)
    p = sorted(knots, key=lambda q: q.position)
    if any(not math.isfinite(q.position) or not math.isfinite(q.weight) for q in p):
        raise ValueError("a knot needs a position and a weight")
    x, y = [q.position for q in p], [max(0, q.weight) for q in p]
    m = tangents(x, y)

    def at_value(v: Column) -> Column:
        out = F.when(v <= x[0], num(y[0]))
        out = out.when(v >= x[-1], num(y[-1]))
        for i in range(len(p) - 1):
            h = (x[i + 1] - x[i]) or 1
            t = (v - num(x[i])) / num(h)
            if p[i].smooth is not False and p[i + 1].smooth is not False:
                t2, t3 = t * t, t * t * t
                val = (num(2) * t3 - num(3) * t2 + num(1)) * num(y[i]) + (t3 - num(2) * t2 + t) * num(h * m[i]) + (num(3) * t2 - num(2) * t3) * num(y[i + 1]) + (t3 - t2) * num(h * m[i + 1])
            else:
                val = num(y[i]) + num(y[i + 1] - y[i]) * t
            out = out.when(v <= x[i + 1], F.greatest(num(0), val))
        return out

    return _by_value(at_value)


def tangents_of(knots: Column) -> Column:
    """As tangents, for a column of two or more knots (position, weight) in order."""
    n = F.size(knots)
    gap = lambda k: F.get(knots, k + 1)["position"] - F.get(knots, k)["position"]
    steps = F.transform(F.sequence(F.lit(0), n - 2), lambda k: (F.get(knots, k + 1)["weight"] - F.get(knots, k)["weight"]) / F.when(gap(k) == 0, num(1)).otherwise(gap(k)))

    def limited(d: Column) -> Column:
        mean = lambda k: F.when(k == n - 1, F.get(d, n - 2)).when(F.get(d, k - 1) * F.get(d, k) <= 0, num(0)).otherwise((F.get(d, k - 1) + F.get(d, k)) / num(2))

        def walk(acc: Column, k: Column) -> Column:
            step, new = F.get(d, k), mean(k + 1)
            size = F.hypot(acc["now"] / step, new / step)
            held = lambda m: F.when(step == 0, num(0)).when(size > 3, m * num(3) / size).otherwise(m)
            return F.struct(F.concat(acc["done"], F.array(held(acc["now"]))).alias("done"), held(new).alias("now"))

        start = F.struct(F.array().cast("array<double>").alias("done"), F.get(d, F.lit(0)).alias("now"))
        return F.aggregate(F.sequence(F.lit(0), n - 2), start, walk, lambda acc: F.concat(acc["done"], F.array(acc["now"])))

    return bound(steps, limited)


def envelope_weights_of(knots: Column) -> Column:
    """As envelope_weights, for a column of array<struct<position, weight, smooth>>: every row has knots of its own; null where a knot lacks a position or weight.

    What a piece between two knots has is computed once a piece, and a value's piece and place in it once a value."""
    sound = F.coalesce(F.forall(knots, lambda k: k["position"].isNotNull() & k["weight"].isNotNull() & ~F.isnan(k["position"]) & ~F.isnan(k["weight"])), F.lit(True))
    ready = F.array_sort(F.transform(knots, lambda k, i: F.struct(k["position"].alias("position"), i.alias("i"), F.greatest(num(0), k["weight"]).alias("weight"), F.coalesce(k["smooth"], F.lit(True)).alias("smooth"))))
    flat = F.array_repeat(F.coalesce(F.get(ready, F.lit(0))["weight"], num(1)), 256)

    def piece(both: Column, i: Column) -> Column:
        a, b = F.get(both["p"], i), F.get(both["p"], i + 1)
        gap = b["position"] - a["position"]
        h = F.when(gap == 0, num(1)).otherwise(gap)
        ends = {"x": a["position"], "h": h, "ya": a["weight"], "yb": b["weight"], "ma": h * F.get(both["m"], i), "mb": h * F.get(both["m"], i + 1), "smooth": a["smooth"] & b["smooth"], "end": b["position"]}
        return F.struct(*[c.alias(name) for name, c in ends.items()])

    def inside(s: Column, t: Column) -> Column:
        t2, t3 = t * t, t * t * t
        cubic = (num(2) * t3 - num(3) * t2 + num(1)) * s["ya"] + (t3 - num(2) * t2 + t) * s["ma"] + (num(3) * t2 - num(2) * t3) * s["yb"] + (t3 - t2) * s["mb"]
        return F.greatest(num(0), F.when(s["smooth"], cubic).otherwise(s["ya"] + (s["yb"] - s["ya"]) * t))

    def drawn(pieces: Column) -> Column:
        def at_value(v: Column) -> Column:
            met = F.get(F.filter(pieces, lambda s: v <= s["end"]), F.lit(0))
            return bound(met, lambda s: bound((v - s["x"]) / s["h"], lambda t: inside(s, t)))

        first, last = F.get(pieces, F.lit(0)), F.element_at(pieces, -1)
        return _by_value(lambda v: F.when(v <= first["x"], first["ya"]).when(v >= last["end"], last["yb"]).otherwise(at_value(v)))

    def pieces(both: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(both["p"]) - 2), lambda i: piece(both, i))

    return F.when(sound, F.when(F.coalesce(F.size(knots), F.lit(0)) < 2, flat).otherwise(bound(ready, lambda p: bound(bound(F.struct(p.alias("p"), tangents_of(p).alias("m")), pieces), drawn))))


def apply_weights(curve: Column, weights: Column) -> Column:
    return bound(weights, lambda w: F.transform(curve, lambda c, v: byte(v + (c - v) * F.element_at(w, v + 1))))


def zone_envelope(curve: Column, zones: tuple[Zone, Zone, Zone] = ZONES, knots: tuple[Knot, ...] = ENVELOPE) -> Column:
    both = F.zip_with(zone_weights(zones), envelope_weights(knots), lambda a, b: a * b)
    return monotonic(apply_weights(curve, both))


def control_points(curve: Column, n: int = CONTROL_POINTS) -> Column:
    """n points x, y at even steps."""
    x = lambda i: half_up(i / num(n - 1) * num(255))
    return bound(curve, lambda c: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(x(i).alias("x"), at(c, x(i)).alias("y"))))


def average(r: Column, g: Column, b: Column) -> Column:
    return F.zip_with(F.zip_with(r, g, lambda x, y: x + y), b, lambda x, y: half_up((x + y) / num(3)))


def rows(curves: DataFrame) -> DataFrame:
    """v, r, g, b of one row of arrays."""
    zipped = curves.select(F.posexplode(F.arrays_zip("r", "g", "b")).alias("v", "x"))
    return zipped.select("v", "x.r", "x.g", "x.b")


def polyline(drawn: DataFrame, step: int) -> DataFrame:
    """The points of rows(v, ...) that a plot draws: every step-th value and the last."""
    return drawn.filter((F.col("v") % step == 0) | (F.col("v") == 255))
