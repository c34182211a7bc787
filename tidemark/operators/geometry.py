"""Polygons as edge rows (poly_id, k, x1, y1, x2, y2): covering, nearest points and areas by joins.

Points and edges meet in grid cells, so that no point meets an edge far away from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geo import DEGREE
from tidemark.operators.scans import stored

CELL = 0.1
#: Height of the bands of latitude in which points and edges of a polygon meet.
BAND = 0.02
#: Edges are put together by cells of this size, these by cells WIDER times as large, and so on up to the whole globe.
GROUP, WIDER = CELL / 4, 4


def cells(low: str, high: str, size: float, more: int):
    return F.explode(F.sequence(F.floor(F.col(low) / size) - more, F.floor(F.col(high) / size) + more))


BOX = {"w": F.least, "e": F.greatest, "s": F.least, "n": F.greatest}


def boxed(edges: DataFrame, *keys) -> DataFrame:
    """The box around each key's edges: w, e, s, n."""
    ends = {c: f(*(("x1", "x2") if c in "we" else ("y1", "y2"))) for c, f in BOX.items()}
    return edges.groupBy(*keys).agg(*((F.min if f is F.least else F.max)(ends[c]).alias(c) for c, f in BOX.items()))


def inside(points: DataFrame, edges: DataFrame, band: float) -> DataFrame:
    """Of (key, lat, lng, poly_id), those that their polygon covers: an odd number of its edges lie to the east. They meet only edges that reach into their band of latitude."""
    banded = edges.withColumns({"s": F.least("y1", "y2"), "n": F.greatest("y1", "y2")}).filter("s < n").select("poly_id", "x1", "y1", "x2", "y2", cells("s", "n", band, 0).alias("band"))
    crossing = F.expr("case when (y1 > lat) <> (y2 > lat) and lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 then 1 else 0 end")
    met = points.withColumn("band", F.floor(F.col("lat") / band)).join(banded, ["poly_id", "band"])
    return met.groupBy("key", "poly_id").agg((F.sum(crossing) % 2).alias("odd")).filter("odd = 1")


def border_cells(edges: DataFrame, cell: float = CELL) -> DataFrame:
    """(poly_id, cx, cy) of the cells that a polygon's edges can reach; its other cells are wholly inside or outside."""
    grid = edges.withColumns({c: f(*(("x1", "x2") if c in "we" else ("y1", "y2"))) for c, f in BOX.items()})
    return grid.select("poly_id", "s", "n", cells("w", "e", cell, 0).alias("cx")).select("poly_id", "cx", cells("s", "n", cell, 0).alias("cy")).distinct()


def inner_cells(wanted: DataFrame, edges: DataFrame, cell: float = CELL, band: float = BAND) -> DataFrame:
    """Of cells (cx, cy), those that lie wholly inside some polygon, by one test of their middle for each polygon that has them in its box."""
    boxes = boxed(edges, "poly_id")
    grid = boxes.select("poly_id", "s", "n", cells("w", "e", cell, 0).alias("cx")).select("poly_id", "cx", cells("s", "n", cell, 0).alias("cy"))
    clear = wanted.join(grid, ["cx", "cy"]).join(border_cells(edges, cell), ["poly_id", "cx", "cy"], "left_anti")
    middle = clear.select("poly_id", F.struct("cx", "cy").alias("key"), ((F.col("cx") + 0.5) * cell).alias("lng"), ((F.col("cy") + 0.5) * cell).alias("lat"))
    return inside(middle, edges, band).select("key.cx", "key.cy").distinct()


def covered(points: DataFrame, edges: DataFrame, cell: float = CELL, band: float = BAND) -> DataFrame:
    """Distinct (pid) of points (pid, lat, lng) that a polygon covers.

    All points of a cell that lies inside a polygon are covered at once. Points meet edges in border cells only, and there only
    those of their band: a point sees few edges of a polygon, however many corners that has, and a polygon is many keys.
    """
    placed = points.filter("lat is not null and lng is not null").select("pid", "lat", "lng", F.floor(F.col("lng") / cell).alias("cx"), F.floor(F.col("lat") / cell).alias("cy"))
    whole = placed.join(inner_cells(placed.select("cx", "cy").distinct(), edges, cell, band), ["cx", "cy"], "left_semi").select("pid")
    near = placed.join(border_cells(edges, cell), ["cx", "cy"]).select(F.col("pid").alias("key"), "lat", "lng", "poly_id")
    return whole.unionByName(inside(near, edges, band).select(F.col("key").alias("pid"))).distinct()


def far(east, north):
    """Metres of a way in degrees, by the latitude of the point at hand."""
    return F.hypot(east * DEGREE * F.cos(F.radians("lat")), north * DEGREE)


def bounded(met: DataFrame) -> DataFrame:
    """(lat, lng, gx, gy, reach) of spots and boxes that can hold their nearest edge.

    No box has an edge that is nearer than the box, and each has one that is no farther than its farthest corner: the least of
    these is the spot's `reach`.
    """
    span = lambda low, high, at: (F.greatest(F.col(low) - F.col(at), F.col(at) - F.col(high), F.lit(0.0)), F.greatest(F.abs(F.col(low) - F.col(at)), F.abs(F.col(high) - F.col(at))))
    (least_x, most_x), (least_y, most_y) = span("w", "e", "lng"), span("s", "n", "lat")
    met = met.select("lat", "lng", "gx", "gy", far(least_x, least_y).alias("least"), far(most_x, most_y).alias("most"))
    met = met.withColumn("reach", F.min("most").over(Window.partitionBy("lat", "lng")))
    return met.filter(F.col("least") <= F.col("reach") * 1.000001 + 0.001).select("lat", "lng", "gx", "gy", "reach")


def nearest(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(pid, metres, near_lat, near_lng, poly_id) of the nearest point on an edge; ties by poly_id and k.

    Boxes around groups of edges form a pyramid of cells. Spots (distinct positions) look around themselves in cells of the lowest level;
    those that find no box within a cell's width go on to the next one, so the rounds are logarithmic in the
    distance. What is found on a level goes down by the boxes of the one below, as far as they can still hold the
    nearest edge, and only edges of the lowest boxes that are left are measured.
    """
    of_group = {"gx": F.floor(F.col("x1") / GROUP), "gy": F.floor(F.col("y1") / GROUP)}
    lowest = stored(boxed(edges, *(v.alias(k) for k, v in of_group.items())))

    def boxes(level: int) -> DataFrame:
        up = lambda c: F.floor(F.col(c) / WIDER**level).alias(c)
        return lowest.groupBy(up("gx"), up("gy")).agg(*((F.min if f is F.least else F.max)(c).alias(c) for c, f in BOX.items())) if level else lowest

    placed = points.filter("lat is not null and lng is not null").select("pid", "lat", "lng")
    open_, found, size = stored(placed.select("lat", "lng").distinct()), [], GROUP * WIDER
    while True:
        grid = boxes(len(found)).select("*", cells("w", "e", size, 1).alias("cx")).select("*", cells("s", "n", size, 1).alias("cy"))
        keyed = open_.select("*", F.floor(F.col("lng") / size).alias("cx"), F.floor(F.col("lat") / size).alias("cy"))
        met = bounded(keyed.join(grid, ["cx", "cy"]))
        # All that lies within a cell's width was met; at last, cells are wider than the globe.
        found.append(stored(met if size > 360 else met.filter(F.col("reach") <= size * DEGREE * F.cos(F.radians("lat")))))
        if size > 360:
            break
        open_ = stored(open_.join(found[-1].select("lat", "lng").distinct(), ["lat", "lng"], "left_anti"))
        if open_.isEmpty():
            break
        size *= WIDER
    front = found[-1]
    for level in reversed(range(len(found) - 1)):
        above = front.select("lat", "lng", F.col("gx").alias("ux"), F.col("gy").alias("uy"))
        below = boxes(level).withColumns({"ux": F.floor(F.col("gx") / WIDER), "uy": F.floor(F.col("gy") / WIDER)})
        front = bounded(above.join(below, ["ux", "uy"])).unionByName(found[level])
    met = front.select("lat", "lng", "gx", "gy").join(edges.withColumns(of_group), ["gx", "gy"])
    scale = F.cos(F.radians("lat"))
    met = met.withColumns({"ax": (F.col("x1") - F.col("lng")) * DEGREE * scale, "ay": (F.col("y1") - F.col("lat")) * DEGREE, "bx": (F.col("x2") - F.col("lng")) * DEGREE * scale, "by": (F.col("y2") - F.col("lat")) * DEGREE})
    along = F.expr("least(1.0, greatest(0.0, case when (bx - ax) * (bx - ax) + (by - ay) * (by - ay) = 0 then 0.0 else -(ax * (bx - ax) + ay * (by - ay)) / ((bx - ax) * (bx - ax) + (by - ay) * (by - ay)) end))")
    met = met.withColumn("t", along).withColumn("d", F.expr("sqrt(power(ax + t * (bx - ax), 2) + power(ay + t * (by - ay), 2))"))
    pick = F.min(F.struct("d", "poly_id", "k", F.expr("y1 + t * (y2 - y1)").alias("near_lat"), F.expr("x1 + t * (x2 - x1)").alias("near_lng"))).alias("x")
    best = met.groupBy("lat", "lng").agg(pick).select("lat", "lng", F.col("x.d").alias("metres"), "x.near_lat", "x.near_lng", "x.poly_id")
    return placed.join(best, ["lat", "lng"]).select("pid", "metres", "near_lat", "near_lng", "poly_id")


def water_distance(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(pid, metres): 0 for covered points, else whole metres to the nearest edge. Points, and what covers some, are worked out once."""
    points = stored(points.select("pid", "lat", "lng"))
    wet = stored(covered(points, edges))
    dry = nearest(points.join(wet, "pid", "left_anti"), edges)
    return wet.select("pid", F.lit(0).cast("long").alias("metres")).unionByName(dry.select("pid", F.round("metres").cast("long").alias("metres")))


def areas(edges: DataFrame) -> DataFrame:
    """(poly_id, km2) by the shoelace formula, in local metres of the polygon's mean latitude."""
    middle = F.avg("y1").over(Window.partitionBy("poly_id"))
    twice = F.expr("x1 * y2 - x2 * y1")
    return edges.withColumn("middle", middle).groupBy("poly_id").agg((F.abs(F.sum(twice)) / 2 * F.cos(F.radians(F.first("middle"))) * (DEGREE * DEGREE) / 1e6).alias("km2"))
