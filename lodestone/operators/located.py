"""Joins of two located tables: all pairs within a radius, and the k nearest of each row.

The globe is cut into bands of latitude as high as the radius, each band into cells at least as wide
as the radius is there. A row of the right side lies in one cell; one of the left side looks in the few
cells that its radius can reach. So pairs meet in an equi-join on cells and distance is worked out for
those alone. Cells with very many right rows are split, and what looks into them goes to each part.
"""

from __future__ import annotations

from math import degrees, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import MILES, haversine
from ..sources.scratch import stored

#: Right rows of a cell that one task takes; half the way round the globe, in miles.
PART, FARTHEST = 20_000, pi * MILES + 1
#: Points of a square that is not cut further, the most cuts (a metre or two), and squares of a level that are broadcast.
LEAF, DEEPEST, SENT = 16, 24, 100_000


def _wide(lat: Column, d: float) -> Column:
    """Degrees of longitude within d degrees of arc of a point at this latitude; 360 near a pole."""
    ratio = F.sin(F.radians(F.lit(min(d, 90.0)))) / F.cos(F.radians(F.least(F.abs(lat), F.lit(89.999999))))
    return F.when((F.abs(lat) + d >= 89.9) | (ratio >= 1), F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + 1e-6)


def _columns(band: Column, d: float) -> Column:
    """Cells of a band: as many as are each as wide as the radius at the band's poleward edge."""
    south = band * d - 90
    edge = F.greatest(F.abs(south), F.abs(south + d))
    return F.greatest(F.floor(360.0 / _wide(edge, d)), F.lit(1)).cast("int")


def _band(lat: Column, d: float) -> Column:
    return F.floor((lat + 90) / d).cast("int")


def _column(lon: Column, columns: Column) -> Column:
    turned = (lon + 540) - F.floor((lon + 540) / 360) * 360
    return F.least(F.floor(turned * columns / 360).cast("int"), columns - 1)


def _cell(lat: Column, lon: Column, d: float) -> Column:
    band = _band(lat, d)
    return F.struct(band.alias("band"), _column(lon, _columns(band, d)).alias("column"))


def _reach(lat: Column, lon: Column, d: float) -> Column:
    """The cells that a radius of d degrees around a point touches."""
    band, wide = _band(lat, d), _wide(lat, d)

    def across(b: Column) -> Column:
        n = _columns(b, d)
        first = F.floor((lon - wide + 540) * n / 360).cast("int")
        last = F.floor((lon + wide + 540) * n / 360).cast("int")
        turns = F.sequence(first, F.least(last, first + n - 1))
        return F.transform(turns, lambda c: F.struct(b.alias("band"), F.pmod(c, n).alias("column")))

    return F.array_distinct(F.flatten(F.transform(F.array(band - 1, band, band + 1), across)))


def geo_join(left: DataFrame, right: DataFrame, miles: float, lat: str = "lat", lon: str = "lon", right_lat: str | None = None, right_lon: str | None = None, distance: str = "miles", densest: int | None = None) -> DataFrame:
    """All pairs of a left and a right row within the radius, with both rows' columns and the distance;
    the right's own latitude and longitude columns go by `right_lat` and `right_lon`. Rows without
    coordinates, or with a latitude beyond a pole, meet nothing. Column names must differ otherwise.
    densest: the most right rows of a square of one degree, if known, which may spare a count of cells."""
    right_lat, right_lon = right_lat or lat, right_lon or lon
    d = min(degrees(miles / MILES) + 1e-6, 181.0)
    here = left.where(F.col(lat).between(-90, 90) & F.col(lon).isNotNull()).withColumns({"_lat": F.col(lat).cast("double"), "_lon": F.col(lon).cast("double")})
    there = right.where(F.col(right_lat).between(-90, 90) & F.col(right_lon).isNotNull()).withColumns({"_rlat": F.col(right_lat).cast("double"), "_rlon": F.col(right_lon).cast("double")})
    if right_lat == lat:
        there = there.drop(right_lat)
    if right_lon == lon:
        there = there.drop(right_lon)
    there = there.withColumn("_cell", _cell(F.col("_rlat"), F.col("_rlon"), d))
    here = here.withColumn("_cell", F.explode(_reach(F.col("_lat"), F.col("_lon"), d)))
    light = densest is not None and densest * (d + 2) * 362 <= PART
    heavy = there.groupBy("_cell").agg(F.count("*").alias("_n")).where(F.col("_n") > PART).select("_cell", F.ceil(F.col("_n") / PART).cast("int").alias("_parts"))
    if not light and not heavy.isEmpty():
        salt = F.pmod(F.xxhash64(*[c for c in there.columns if c != "_cell"]), F.coalesce("_parts", F.lit(1))).cast("int")
        there = there.join(heavy, "_cell", "left").withColumn("_part", salt).drop("_parts")
        here = here.join(heavy, "_cell", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        on = ["_cell", "_part"]
    else:
        on = ["_cell"]
    pairs = here.join(there, on).withColumn(distance, haversine(F.col("_lat"), F.col("_lon"), F.col("_rlat"), F.col("_rlon")))
    return pairs.where(F.col(distance) <= miles).drop("_lat", "_lon", "_rlat", "_rlon", "_cell", "_part")


def _squares(lat: Column, lon: Column) -> list[Column]:
    """Row and column of a point in the finest grid of the tree, from the south pole and the date line."""
    turned = (lon + 540) - F.floor((lon + 540) / 360) * 360
    most = F.lit(2**DEEPEST - 1)
    return [F.least(F.floor((lat + 90) * (2**DEEPEST / 180)), most).alias("_x"), F.least(F.floor(turned * (2**DEEPEST / 360)), most).alias("_y")]


def _upper(level: str = "_level") -> list[str]:
    """A square of the finest grid as one of a level's."""
    return [f"shiftright({c}, {DEEPEST} - {level}) AS {c}" for c in ("_x", "_y")]


def _tree(points: DataFrame) -> DataFrame:
    """(_level, _x, _y, _n, _inner): squares of latitude and longitude, each cut into four while it holds
    more than LEAF points, with their number of points."""
    squares = points.groupBy("_x", "_y").agg(F.count("*").alias("_n")).withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(DEEPEST))))
    counted = squares.selectExpr("_level", *_upper(), "_n").groupBy("_level", "_x", "_y").agg(F.sum("_n").alias("_n"))
    nodes = stored(counted.withColumn("_inner", (F.col("_n") > LEAF) & (F.col("_level") < DEEPEST)), "squares")
    above = nodes.where("_inner").selectExpr("_level + 1 AS _level", "_x AS _px", "_y AS _py")
    below = nodes.withColumns({"_px": F.expr("shiftright(_x, 1)"), "_py": F.expr("shiftright(_y, 1)")}).join(above, ["_level", "_px", "_py"], "left_semi")
    return stored(nodes.where("_level = 0").unionByName(below.select(*nodes.columns)), "tree")


def _bounds() -> tuple[Column, Column]:
    """Miles from a point that no place of a node's square is nearer than, nor farther."""
    size = F.pow(F.lit(0.5), F.col("_level"))
    south, west = F.col("_x") * size * 180 - 90, F.col("_y") * size * 360
    north, east, turned = south + size * 180, west + size * 360, F.pmod(F.col("_lon") + 540, F.lit(360.0))
    around = lambda x: F.least(F.abs(turned - x), 360 - F.abs(turned - x))
    opposite = F.pmod(turned + 180, F.lit(360.0))
    low, high = F.greatest(south - F.col("_lat"), F.col("_lat") - north, F.lit(0.0)), F.greatest(F.abs(F.col("_lat") - south), F.abs(F.col("_lat") - north))
    short = F.when(turned.between(west, east), 0.0).otherwise(F.least(around(west), around(east)))
    long = F.when(opposite.between(west, east), 180.0).otherwise(F.greatest(around(west), around(east)))
    narrow = F.cos(F.radians(F.least(F.greatest(F.abs(south), F.abs(north)), F.lit(90.0))))
    wide = F.when((south <= 0) & (north >= 0), 1.0).otherwise(F.cos(F.radians(F.least(F.abs(south), F.abs(north)))))

    def miles(up: Column, across: Column, cosine: Column) -> Column:
        a = F.pow(F.sin(F.radians(up) / 2), 2) + F.cos(F.radians("_lat")) * cosine * F.pow(F.sin(F.radians(across) / 2), 2)
        return 2 * MILES * F.asin(F.sqrt(F.least(a, F.lit(1.0))))

    return miles(low, short, narrow), miles(high, long, wide)


def geo_knn_join(left: DataFrame, right: DataFrame, k: int, left_key: str, right_key: str, lat: str = "lat", lon: str = "lon", right_lat: str | None = None, right_lon: str | None = None, most: float = FARTHEST, distance: str = "miles") -> DataFrame:
    """Of each left row its k nearest right rows within `most` miles, by distance, then by right key, with
    `rank` from 1. Right rows lie in a tree of squares; all left rows go down it together, a level at a
    time, and keep the squares that can hold one of their k nearest: those not farther than a distance
    within which other squares hold k. So a row is compared with the rows of a few squares, however
    unevenly the right rows lie. Of right rows at one place k are enough. `left_key` tells left rows
    apart."""
    right_lat, right_lon = right_lat or lat, right_lon or lon
    here = left.where(F.col(lat).between(-90, 90) & F.col(lon).isNotNull()).select(F.col(left_key).alias("_q"), F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon"))
    there = right.where(F.col(right_lat).between(-90, 90) & F.col(right_lon).isNotNull()).withColumns({"_rlat": F.col(right_lat).cast("double"), "_rlon": F.col(right_lon).cast("double")})
    kept = [c for c in right.columns if not (right_lat == lat and c == lat) and not (right_lon == lon and c == lon)]
    at_place = F.row_number().over(Window.partitionBy("_rlat", "_rlon").orderBy(right_key))
    there = there.withColumn("_k", at_place).where(F.col("_k") <= k).select(F.struct(*kept).alias("_row"), "_rlat", "_rlon", *_squares(F.col("_rlat"), F.col("_rlon")))
    there = stored(there, "points")
    tree = _tree(there)
    levels = {r["_level"]: r["count"] for r in tree.groupBy("_level").count().collect()}
    deepest = max(levels, default=0)
    sent = lambda frame, rows: F.broadcast(frame) if rows <= SENT else frame
    leaves = sent(tree.where("NOT _inner").select("_level", "_x", "_y"), sum(levels.values()))
    spread = there.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(deepest)))).selectExpr("_level", *_upper(), "_row", "_rlat", "_rlon")
    spread = stored(spread.join(leaves, ["_level", "_x", "_y"]), "leaves")
    near, far = _bounds()
    # Dealt by number: the rows are few bytes, but each goes down the tree.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    root = tree.where("_level = 0").first()
    waiting = here.withColumns({c: F.lit(root[c] if root else 0).cast(kind) for c, kind in tree.dtypes})
    waiting = stored(waiting if root else waiting.limit(0), "asked").repartition(tasks, "_q")
    own = Window.partitionBy("_q")
    upward = own.orderBy("_far", "_level", "_x", "_y").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for level in range(1, deepest + 1):
        below = tree.where(F.col("_level") == level).selectExpr("shiftright(_x, 1) AS _px", "shiftright(_y, 1) AS _py", "_level AS _l", "_x AS _cx", "_y AS _cy", "_n AS _cn", "_inner AS _ci")
        inside = F.col("_inner") & (F.col("_x") == F.col("_px")) & (F.col("_y") == F.col("_py"))
        waiting = waiting.withColumns({c: F.when(F.col("_inner"), F.col(c)).otherwise(-F.col(c) - 1) for c in ("_x", "_y")})
        waiting = waiting.join(sent(below, levels[level]), inside, "left")
        own_square = {c: F.when(F.col("_l").isNotNull(), F.col(n)).otherwise(F.col(c) if c[1] not in "xy" else -F.col(c) - 1) for c, n in (("_level", "_l"), ("_x", "_cx"), ("_y", "_cy"), ("_n", "_cn"), ("_inner", "_ci"))}
        waiting = waiting.select("_q", "_lat", "_lon", *[x.alias(c) for c, x in own_square.items()]).withColumns({"_near": near, "_far": far})
        enough = F.min(F.when(F.col("_held") >= k, F.col("_far"))).over(own)
        waiting = waiting.withColumn("_held", F.sum("_n").over(upward)).withColumn("_enough", F.least(enough, F.lit(float(most))))
        waiting = waiting.where(F.col("_near") <= F.col("_enough") * (1 + 1e-9) + 1e-6).select("_q", "_lat", "_lon", "_level", "_x", "_y", "_n", "_inner")
    pairs = waiting.select("_q", "_lat", "_lon", "_level", "_x", "_y").join(spread, ["_level", "_x", "_y"])
    pairs = pairs.select("_q", "_row.*", haversine(F.col("_lat"), F.col("_lon"), F.col("_rlat"), F.col("_rlon")).alias(distance)).where(F.col(distance) <= most)
    ranked = pairs.withColumn("rank", F.row_number().over(own.orderBy(distance, right_key))).where(F.col("rank") <= k)
    return left.join(ranked, F.col("_q").eqNullSafe(left[left_key])).drop("_q")
