"""Zone outlines: polygons as rows of vertices, read from tables or from GeoJSON lines.

A vertex is (zone, ring, seq, x, y): rings are closed by themselves, and whether one is an outer ring or a hole is told by what it lies in (even-odd rule).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

VERTICES = T.StructType([T.StructField("zone", T.StringType()), T.StructField("ring", T.LongType()), T.StructField("seq", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_POINTS = "array<array<double>>"


def read_geojson(spark: SparkSession, path: str, code: str = "STUSPS") -> DataFrame:
    """VERTICES of the Polygon and MultiPolygon features of GeoJSON lines (a feature a line), `code` being the property that names the zone.

    Features of other kinds, without geometry or without that property are left out. Rings are numbered within a zone; several features of one zone are parts of it.
    """
    feature = f"struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>"
    read = spark.read.text(path).select(F.from_json("value", feature).alias("f")).select(F.try_element_at("f.properties", F.lit(code)).alias("zone"), "f.geometry.*").where("zone IS NOT NULL")
    polygons = F.when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", f"array<{_POINTS}>"))).when(F.col("type") == "MultiPolygon", F.from_json("coordinates", f"array<array<{_POINTS}>>"))
    parts = read.select("zone", F.xxhash64("coordinates").alias("part"), F.posexplode(F.flatten(polygons)).alias("place", "points"))
    # rings of one feature follow each other; equal features of a zone would cancel out, so they count once
    rings = parts.dropDuplicates(["zone", "part", "place"]).withColumn("ring", F.xxhash64("part", "place"))
    return rings.select("zone", "ring", F.posexplode("points").alias("seq", "p")).select("zone", "ring", "seq", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


def check_vertices(vertices: DataFrame) -> DataFrame:
    """The columns of VERTICES, cast; an error if one is absent."""
    absent = [f.name for f in VERTICES if f.name not in vertices.columns]
    if absent:
        raise ValueError(f"outlines lack {', '.join(absent)}")
    return vertices.select(*[F.col(f.name).cast(f.dataType) if f.name != "zone" else F.col("zone") for f in VERTICES])


def edges(vertices: DataFrame) -> DataFrame:
    """zone, x1, y1, x2, y2 of each edge that is not level, lower end first, so that zones that share an edge have the same numbers for it. Vertices with a null coordinate are left out."""
    ring = W.partitionBy("zone", "ring").orderBy("seq")
    whole = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    good = check_vertices(vertices).where("x IS NOT NULL AND y IS NOT NULL")
    ends = good.withColumns({f"{c}n": F.coalesce(F.lead(c).over(ring), F.first(c).over(whole)) for c in ("x", "y")}).where(F.col("y") != F.col("yn"))
    up = F.col("y") < F.col("yn")
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    return ends.select("zone", pick("x", "xn").alias("x1"), pick("y", "yn").alias("y1"), pick("xn", "x").alias("x2"), pick("yn", "y").alias("y2"))
