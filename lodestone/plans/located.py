"""Queries that join located tables, and that search by many vectors at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import located, similar
from .registry import query

C = F.col
_D = "2 * 3958.8e0 * asin(sqrt(least(1.0e0, pow(sin(radians(z.lat - f.lat) / 2), 2) + cos(radians(f.lat)) * cos(radians(z.lat)) * pow(sin(radians(z.lon - f.lon) / 2), 2))))"


@query("geo_join", f"select f.code, z.zip, round({_D}, 4) as miles from (select code, lat, lon from facility where approved and lat is not null) f join zcta z on {_D} <= 60", "facility zcta")
def _(t):
    """Every approved facility with the ZIP areas within 60 miles of it."""
    f = t.facility.where("approved").select("code", "lat", "lon")
    return located.geo_join(f, t.zcta, 60.0).select("code", "zip", F.round("miles", 4).alias("miles"))


@query("geo_knn_join", f"select code, zip, miles, rank from (select f.code, z.zip, round({_D}, 4) as miles, cast(row_number() over (partition by f.code order by {_D}, z.zip) as int) as rank from (select code, lat, lon from facility where lat is not null) f, zcta z) where rank <= 5", "facility zcta")
def _(t):
    """Of each facility the five nearest ZIP areas."""
    f = t.facility.select("code", "lat", "lon")
    return located.geo_knn_join(f, t.zcta, 5, "code", "zip").select("code", "zip", F.round("miles", 4).alias("miles"), "rank")


@query("geo_near_zips", f"""with p as (select z.zip, f.code, f.state, {_D} as miles from (select * from facility where approved and is_school and lat is not null) f join zcta z on {_D} <= 100),
k as (select *, row_number() over (partition by zip order by miles, code) as rank from p) select zip, code, state, round(miles, 4) as miles from k where rank <= 8""", "facility zcta")
def _(t):
    """Around every ZIP area at once, the eight nearest schools within a hundred miles."""
    schools = t.facility.where(C("approved") & C("is_school")).select("code", "state", C("lat").alias("y"), C("lon").alias("x"))
    near = located.geo_knn_join(t.zcta, schools, 8, "zip", "code", right_lat="y", right_lon="x", most=100.0)
    return near.select("zip", "code", "state", F.round("miles", 4).alias("miles"))


_COS = "list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[]))"


@query("vector_topk_batch", f"""with s as (select q.vec_id as query_id, e.vec_id, round({_COS}, 6) as score from embeddings q join embeddings e on q.vec_id % 20 = 0 and q.vec_id <> e.vec_id)
select query_id, vec_id, score, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s where score >= 0.05 qualify rank <= 10""")
def _(t):
    """Every twentieth vector as a query against all others: ten each."""
    queries = t.embeddings.where("vec_id % 20 = 0").select(C("vec_id").alias("query_id"), "embedding")
    return similar.topk_batch(t.embeddings, queries, 10, 0.05)
