"""Layer trees as adjacency lists: layer_id, parent_id, ord, name, kind, visible.

Ways to the root are found by pointer doubling: every layer holds the way to an ancestor, and a round joins it with that ancestor's
own way, so a tree of depth d takes log2(d) + 1 rounds, each one join of written tables; no recursion limit and no row limit applies. Layers
that are their own ancestors are an error, found as soon as a way holds its own next layer, not a walk without end; layers below
a parent that is missing stand under no root and are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import discard, materialize


def ways(layers: DataFrame) -> DataFrame:
    """layer_id, ids, names and place (orders) of the way from the root down to each layer, itself included: a written table."""
    own = {"ids": F.array("layer_id"), "names": F.array("name"), "place": F.array("ord")}
    way = materialize(layers.select("layer_id", F.col("parent_id").alias("up"), *[c.alias(n) for n, c in own.items()]), "ways")
    while True:
        pending = F.col("up").isNotNull()
        left, circles = way.agg(F.count_if(pending), F.count_if(pending & F.expr("array_contains(ids, up)"))).first()
        if circles:
            raise ValueError("layers that are their own ancestors")
        if not left:
            return way.drop("up")
        above = way.select(F.col("layer_id").alias("_id"), F.col("up").alias("_up"), *[F.col(c).alias(f"_{c}") for c in own])
        longer = way.filter(pending).join(above, F.col("up") == F.col("_id")).select("layer_id", F.col("_up").alias("up"), *[F.concat(f"_{c}", c).alias(c) for c in own])
        before, way = way, materialize(way.filter(~pending).unionByName(longer), "ways")
        discard(before)


def levels(layers: DataFrame) -> DataFrame:
    """layers with depth, names (of the way from the root) and place (orders along the way, which sort in pre-order)."""
    way = ways(layers).select(F.col("layer_id").alias("_id"), (F.size("names") - 1).alias("depth"), "names", "place")
    return layers.join(way, F.col("layer_id") == F.col("_id")).drop("_id")


def paths(layers: DataFrame, own_group: Column) -> DataFrame:
    """layer_id and path A / B / leaf of all pixel layers and smart objects outside our own groups."""
    skipped = layers.withColumn("_own", own_group)
    tree = levels(skipped.withColumn("name", F.when(F.col("_own"), F.lit(None)).otherwise(F.col("name"))).drop("_own"))
    seen = ~F.exists("names", lambda n: n.isNull())
    return tree.filter(seen & (F.col("kind").isin("pixel", "smartObject") | F.col("kind").isNull())).select("layer_id", F.array_join("names", " / ").alias("path"))


def consolidate(layers: DataFrame, ours: Column) -> DataFrame:
    """The shallowest of our groups, first in pre-order, takes in the children of the others, which go."""
    groups = levels(layers).filter(ours & (F.col("kind") == "group")).select("layer_id", "depth", "place")
    best = groups.groupBy().agg(F.min_by("layer_id", F.struct("depth", "place")).alias("canonical"))
    mine = groups.select("layer_id", F.lit(True).alias("ours"))
    df = layers.join(mine, "layer_id", "left").join(groups.select(F.col("layer_id").alias("parent_id"), F.lit(True).alias("under")), "parent_id", "left").crossJoin(F.broadcast(best))
    kept = df.filter(F.col("ours").isNull() | (F.col("layer_id") == F.col("canonical")))
    return kept.select("layer_id", F.when(F.col("under"), F.col("canonical")).otherwise(F.col("parent_id")).alias("parent_id"), "name")


def next_branch(layers: DataFrame, group: str) -> DataFrame:
    """The name that the working group gets when it is set aside: the highest number so far and one, of two digits at least."""
    n = F.coalesce(F.max(F.try_to_number(F.nullif(F.regexp_extract("name", rf"^\Q{group}\E _(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int")), F.lit(0)) + 1
    return layers.agg(n.alias("n")).select("n", F.concat(F.lit(f"{group} _"), F.when(F.col("n") < 10, F.concat(F.lit("0"), F.col("n").cast("string"))).otherwise(F.col("n").cast("string"))).alias("name"))


def first_of(layers: DataFrame, wanted: Column) -> DataFrame:
    """layer_id of the first wanted layer in pre-order, where several are (copies of one, or groups of one name); no row if there is none."""
    found = levels(layers.withColumn("_wanted", wanted)).filter("_wanted")
    return found.groupBy().agg(F.min_by("layer_id", "place").alias("layer_id")).filter("layer_id IS NOT NULL")


def branch(layers: DataFrame, group: str) -> DataFrame:
    """layers with the working group (the first of that name in pre-order) set aside: under its next number, and hidden."""
    active = first_of(layers, (F.col("name") == group) & (F.col("kind") == "group")).withColumn("_active", F.lit(True))
    new = next_branch(layers, group).select(F.col("name").alias("_new"))
    df = layers.join(F.broadcast(active), "layer_id", "left").crossJoin(F.broadcast(new))
    name, shown = F.when(F.col("_active"), F.col("_new")).otherwise(F.col("name")), F.when(F.col("_active"), F.lit(False)).otherwise(F.col("visible"))
    return df.withColumns({"name": name, "visible": shown}).select(*layers.columns)


PREFIXES = {"rgb": ("Match RGB", "Match Curves"), "lab": ("Match Lab",), "lut": ("Match LUT",)}


def visibility(layers: DataFrame, own_group: Column, mode: str) -> DataFrame:
    """layer_id and visible: below the first own group in pre-order, outputs of the mode are shown and those of other modes hidden; all other layers are left alone."""
    tree = levels(layers.withColumn("_own", own_group & (F.col("kind") == "group")))
    first = tree.filter("_own").groupBy().agg(F.min("place").alias("place"))
    up = first.select(F.col("place").alias("_group"))
    below = tree.crossJoin(F.broadcast(up)).filter((F.size("place") > F.size("_group")) & (F.slice("place", F.lit(1), F.size("_group")) == F.col("_group"))).select("layer_id", F.lit(True).alias("_below"))
    shown = F.col("visible")
    for m, names in PREFIXES.items():
        for p in names:
            shown = F.when(F.col("name").startswith(p), F.lit(m == mode)).otherwise(shown)
    return layers.join(below, "layer_id", "left").select("layer_id", F.when(F.col("_below"), shown).otherwise(F.col("visible")).alias("visible"))


def ancestors(layers: DataFrame, wanted: int) -> DataFrame:
    """layer_id of a layer and all its ancestors; a round doubles the steps that are known, and circles end where they close."""
    kind = layers.schema["layer_id"].dataType.simpleString()
    found = layers.sparkSession.createDataFrame([(wanted,)], "layer_id long").select(F.col("layer_id").cast(kind))
    jump = layers.filter("parent_id IS NOT NULL").select("layer_id", F.col("parent_id").alias("up"))
    n = 1
    while True:
        above = jump.join(found, "layer_id", "left_semi").select(F.col("up").alias("layer_id"))
        found = materialize(found.union(above).distinct(), "ancestors")
        before, n = n, found.count()
        if n == before:
            return found
        jump = materialize(jump.alias("a").join(jump.alias("b"), F.col("a.up") == F.col("b.layer_id")).select("a.layer_id", "b.up"), "jumps")


def isolate(layers: DataFrame, wanted: int) -> DataFrame:
    """layer_id and visible: the wanted layer and its ancestors stay, all else is hidden."""
    kept = ancestors(layers, wanted).withColumn("_kept", F.lit(True))
    return layers.join(kept, "layer_id", "left").select("layer_id", F.coalesce("_kept", F.lit(False)).alias("visible"))
