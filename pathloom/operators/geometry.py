"""Surface meshes, parcels and nearest assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.columns import distance, triangle_area
from pathloom.session import is_small, materialize

CENTROID_LIMIT = 2000  # centroids that fit in one expression; more use the grid


def vertex_areas(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """A third of the area of every incident face."""
    c = faces
    for i in range(3):
        c = c.join(vertices.select(
            F.col("v").alias(f"v{i}"), *[F.col(a).alias(f"{a}{i}") for a in "xyz"]), f"v{i}")
    p = [[F.col(f"{a}{i}") for a in "xyz"] for i in range(3)]
    share = c.select((triangle_area(*p) / 3.0).alias("a"),
                     F.explode(F.array("v0", "v1", "v2")).alias("v"))
    return share.groupBy("v").agg(F.sum("a").alias("area"))


def parcel_centroids(vertices: DataFrame, areas: DataFrame, label: str = "label") -> DataFrame:
    """Area-weighted centroid, unweighted when a parcel has no area."""
    j = vertices.join(areas, "v", "left").withColumn("w", F.coalesce("area", F.lit(0.0)))
    total = F.sum("w")
    return j.groupBy(label).agg(
        total.alias("area"), F.count(F.lit(1)).alias("n_vertices"),
        *[F.when(total > 0, F.sum(F.col("w") * F.col(a)) / total).otherwise(F.avg(a)).alias(a)
          for a in "xyz"])


def nearest(points: DataFrame, centroids: DataFrame, key: str, name: str,
            limit: int = CENTROID_LIMIT) -> DataFrame:
    """Nearest centroid per point; the smallest ``ord`` wins ties.

    ``points`` (key, x, y, z), ``centroids`` (name, ord, x, y, z).  Few centroids
    become an array literal evaluated in the scan of the points; many go
    through a grid with equi-joins only.
    """
    if not is_small(centroids, limit):
        return _nearest_grid(points, centroids, key, name)
    rows = centroids.select(name, "ord", "x", "y", "z").collect()  # at most ``limit`` rows
    table = F.array(*[F.struct(
        F.lit(float(r["x"])).alias("x"), F.lit(float(r["y"])).alias("y"),
        F.lit(float(r["z"])).alias("z"), F.lit(r["ord"]).alias("ord"),
        F.lit(r[name]).alias("name")) for r in rows])
    best = F.array_min(F.transform(table, lambda c: F.struct(
        distance((F.col("x"), F.col("y"), F.col("z")), (c["x"], c["y"], c["z"])).alias("dist"),
        c["ord"].alias("ord"), c["name"].alias("name"))))
    return points.withColumn("b", best).select(
        key, F.col("b.name").alias(name), F.col("b.dist").alias("dist"))


def _nearest_grid(points: DataFrame, centroids: DataFrame, key: str, name: str) -> DataFrame:
    """Exact search in growing grids.

    A centroid closer than one cell lies in the 27 cells around the point, so a
    point whose best distance is within the cell size is settled; the others
    retry with cells twice as large.
    """
    box = centroids.agg(
        *[F.min(a).alias(f"lo_{a}") for a in "xyz"], *[F.max(a).alias(f"hi_{a}") for a in "xyz"],
        F.count(F.lit(1)).alias("n")).first()
    reach = points.agg(*[F.min(a).alias(f"lo_{a}") for a in "xyz"],
                       *[F.max(a).alias(f"hi_{a}") for a in "xyz"]).first()
    span = max(max(box[f"hi_{a}"], reach[f"hi_{a}"]) - min(box[f"lo_{a}"], reach[f"lo_{a}"])
               for a in "xyz")
    size = max(box[f"hi_{a}"] - box[f"lo_{a}"] for a in "xyz") / max(box["n"] ** (1 / 3), 1.0)
    size = size or 1.0
    left, found = points, None
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k"))
                       for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    while True:
        last = size >= span
        cell = lambda a: F.floor(F.col(a) / size)
        c = centroids.select(name, "ord", cell("x").alias("gx"), cell("y").alias("gy"),
                             cell("z").alias("gz"), F.col("x").alias("cx"),
                             F.col("y").alias("cy"), F.col("z").alias("cz"))
        probe = left.withColumn("o", F.explode(around)).select(
            key, "x", "y", "z", (cell("x") + F.col("o.i")).alias("gx"),
            (cell("y") + F.col("o.j")).alias("gy"), (cell("z") + F.col("o.k")).alias("gz"))
        d = distance((F.col("x"), F.col("y"), F.col("z")), (F.col("cx"), F.col("cy"), F.col("cz")))
        best = materialize(probe.join(c, ["gx", "gy", "gz"]).groupBy(key).agg(
            F.min(F.struct(d.alias("dist"), F.col("ord").alias("ord"),
                           F.col(name).alias("name"))).alias("b")))
        sure = best if last else best.where(F.col("b.dist") <= size)
        found = sure if found is None else found.unionByName(sure)
        if last:
            break
        left = materialize(left.join(sure.select(key), key, "left_anti"))
        if left.isEmpty():
            break
        size *= 2
    return found.select(key, F.col("b.name").alias(name), F.col("b.dist").alias("dist"))


def active_parcels(assigned: DataFrame, centroids: DataFrame, name: str) -> DataFrame:
    """Area, centroid and electrode count of the parcels that have electrodes."""
    n = assigned.groupBy(name).agg(F.count(F.lit(1)).alias("n_electrodes"))
    return centroids.join(n, name).select(name, "area", "x", "y", "z", "n_electrodes")
