"""Colour arithmetic as column expressions. Bytes are integers from 0 to 255; rounding is half up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Linear sRGB to XYZ and back (D65), white point, Rec. 709 luma weights.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)
LUMA = (0.2126, 0.7152, 0.0722)


def num(x: float) -> Column:
    return F.lit(float(x))


def half_up(c: Column) -> Column:
    return F.floor(c + num(0.5)).cast("int")


def byte(c: Column) -> Column:
    """Rounded and held in 0..255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), half_up(c)))


def luma(r: Column, g: Column, b: Column) -> Column:
    return num(LUMA[0]) * r + num(LUMA[1]) * g + num(LUMA[2]) * b


def srgb_to_linear(c: Column) -> Column:
    x = c / num(255)
    return F.when(x <= num(0.04045), x / num(12.92)).otherwise(F.pow((x + num(0.055)) / num(1.055), num(2.4)))


def linear_to_srgb(c: Column) -> Column:
    x = F.when(c <= num(0.0031308), num(12.92) * c).otherwise(num(1.055) * F.pow(F.greatest(num(0), c), num(1 / 2.4)) - num(0.055))
    return byte(x * num(255))


def _mix(rows: tuple, v: tuple) -> list[Column]:
    return [num(m[0]) * v[0] + num(m[1]) * v[1] + num(m[2]) * v[2] for m in rows]


def with_lab(df: DataFrame, r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """df with lab_l, lab_a, lab_b. Each step is a column of its own, so that no step is computed twice."""
    f = lambda t: F.when(t > num(0.008856), F.pow(t, num(1 / 3))).otherwise(num(7.787) * t + num(16 / 116))
    df = df.withColumns({f"_lin_{i}": srgb_to_linear(F.col(c)) for i, c in enumerate((r, g, b))})
    df = df.withColumns({f"_xyz_{i}": v / num(WHITE[i]) for i, v in enumerate(_mix(TO_XYZ, tuple(F.col(f"_lin_{k}") for k in range(3))))})
    df = df.withColumns({f"_f_{i}": f(F.col(f"_xyz_{i}")) for i in range(3)})
    x, y, z = (F.col(f"_f_{i}") for i in range(3))
    df = df.withColumns({"lab_l": num(116) * y - num(16), "lab_a": num(500) * (x - y), "lab_b": num(200) * (y - z)})
    return df.drop(*[f"{p}{i}" for p in ("_lin_", "_xyz_", "_f_") for i in range(3)])


def with_rgb(df: DataFrame, l: Column, a: Column, b: Column, out: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:  # noqa: E741
    """df with bytes of the Lab colour l, a, b."""
    y = (l + num(16)) / num(116)
    df = df.withColumns({"_f_0": a / num(500) + y, "_f_1": y, "_f_2": y - b / num(200)})
    df = df.withColumns({f"_c_{i}": F.col(f"_f_{i}") * F.col(f"_f_{i}") * F.col(f"_f_{i}") for i in range(3)})
    df = df.withColumns({f"_xyz_{i}": F.when(F.col(f"_c_{i}") > num(0.008856), F.col(f"_c_{i}")).otherwise((F.col(f"_f_{i}") - num(16 / 116)) / num(7.787)) * num(WHITE[i]) for i in range(3)})
    df = df.withColumns({f"_lin_{i}": v for i, v in enumerate(_mix(FROM_XYZ, tuple(F.col(f"_xyz_{k}") for k in range(3))))})
    df = df.withColumns({name: linear_to_srgb(F.col(f"_lin_{i}")) for i, name in enumerate(out)})
    return df.drop(*[f"{p}{i}" for p in ("_f_", "_c_", "_xyz_", "_lin_") for i in range(3)])


def rgb_to_hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in [0, 1), saturation, lightness; the largest channel is the first of r, g, b among equals."""
    rn, gn, bn = (c / num(255) for c in (r, g, b))
    top, low = F.greatest(rn, gn, bn), F.least(rn, gn, bn)
    d, l = top - low, (top + low) / num(2)  # noqa: E741
    s = F.when(d == 0, num(0)).when(l > num(0.5), d / (num(2) - top - low)).otherwise(d / (top + low))
    h = F.when(d == 0, num(0)).when(top == rn, (gn - bn) / d + F.when(gn < bn, num(6)).otherwise(num(0))).when(top == gn, (bn - rn) / d + num(2)).otherwise((rn - gn) / d + num(4))
    return h / num(6), s, l


def hsl_to_rgb(h: Column, s: Column, l: Column) -> tuple[Column, Column, Column]:  # noqa: E741
    q = F.when(l < num(0.5), l * (num(1) + s)).otherwise(l + s - l * s)
    p = num(2) * l - q

    def part(shift: float) -> Column:
        t0 = h + num(shift)
        t = F.when(t0 < 0, t0 + num(1)).when(t0 > 1, t0 - num(1)).otherwise(t0)
        v = F.when(t < num(1 / 6), p + (q - p) * num(6) * t).when(t < num(0.5), q).when(t < num(2 / 3), p + (q - p) * (num(2 / 3) - t) * num(6)).otherwise(p)
        return half_up(F.when(s == 0, l).otherwise(v) * num(255))

    return part(1 / 3), part(0.0), part(-1 / 3)


def pack(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def hash01(i: Column) -> Column:
    """A fixed number in [0, 1) for each index."""
    return (((i.cast("bigint") + 1) * F.lit(2654435761)) % F.lit(4294967296)) / num(4294967296)
