"""The engine's front: match(source, target) fits curves; the result applies them, bakes them and samples them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import curves as C
from tessera.operators import dist as D
from tessera.operators import pixels as P


@dataclass(frozen=True)
class Params:
    mode: str = "full"
    color_space: str = "rgb"
    amount: float = 1.0
    smooth: float = 0
    max_stretch: float = 999
    dimensions: C.Dimensions = C.Dimensions()
    zones: tuple[C.Zone, C.Zone, C.Zone] = C.ZONES
    envelope: tuple[C.Knot, ...] = C.ENVELOPE
    preset: str = "color"


@dataclass(frozen=True)
class Curves:
    """One row of three arrays of 256 outputs, and the parameters it came from."""

    df: DataFrame
    params: Params

    def apply(self, px: DataFrame, weight: str | None = None) -> DataFrame:
        """px with matched r, g, b. Presets blend with the original; with a weight column (a palette's, a mask's or a selection's, 0 to 1) the outcome counts only so far."""
        made = P.mapped(px, self.df)
        return P.preset_weighted(made, self.params.preset, weight) if weight else P.preset(made, self.params.preset)

    def to_lut(self, size: int = 33, strength: float = 1.0) -> DataFrame:
        return P.lut_grid(self.df, size, self.params.preset, strength)

    def control_points(self, n: int = C.CONTROL_POINTS) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(c).alias("ch"), C.control_points(F.col(c), n).alias("p")) for c in P.RGB])
        return self.df.select(F.explode(rows).alias("x")).select("x.ch", F.posexplode("x.p").alias("i", "p")).select("ch", "i", "p.x", "p.y")

    def rows(self) -> DataFrame:
        return C.rows(self.df)


def match(source: DataFrame, target: DataFrame, params: Params = Params()) -> Curves:
    """Fits source to target, then cap, blend, smooth, dimensions, zones and envelope in this order."""
    df = D.arrays(D.fit(source, target, params.mode, params.color_space))
    df = df.select(*[C.process(F.col(c), params.amount, params.smooth, params.max_stretch).alias(c) for c in P.RGB])
    if params.dimensions != C.Dimensions():
        df = df.select(*[x.alias(c) for c, x in zip(P.RGB, C.dimensions(*map(F.col, P.RGB), params.dimensions), strict=True)])
    if params.zones != C.ZONES or params.envelope != C.ENVELOPE:
        df = df.select(*[C.zone_envelope(F.col(c), params.zones, params.envelope).alias(c) for c in P.RGB])
    return Curves(df, params)
