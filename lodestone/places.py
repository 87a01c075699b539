"""Places named in text: states by name or letters, the longest city, and a point to measure from."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import ALNUM, normalize

C = F.col


def _words(text: str) -> str:
    return f" {' '.join(re.findall(ALNUM, text.lower()))} "


def named_state(text: str, states: dict[str, str]) -> tuple[str | None, str | None]:
    """The state that a text names, and one that its last two letters may stand for. A full name
    counts first, then two letters behind a comma (not a lower-case `me`), then a text that is two
    letters; two letters at the end of more text count if a city of that state is there too."""
    said, letters = _words(text), set(states.values())
    for name, short in states.items():
        if f" {' '.join(re.findall(ALNUM, name.lower()))} " in said:
            return short, None
    comma = re.search(r",\s*([A-Za-z]{2})\b", text)
    if comma and comma[1].upper() in letters and comma[1] != "me":
        return comma[1].upper(), None
    last = re.search(r"\b([A-Za-z]{2})\s*$", text)
    if last and last[1].upper() in letters:
        return (last[1].upper(), None) if text.strip().upper() == last[1].upper() else (None, last[1].upper())
    return None, None


def resolve_area(text: str, facilities: DataFrame, zcta: DataFrame, states: dict[str, str]) -> DataFrame:
    """One row or none: label, city, state, lat, lon, zip, for a place that a text names.

    `facilities` have city, state, zip, lat and lon. Of the cities in the text, of the state if one is
    named, the longest counts; without a state, cities of several states are ambiguous and give no row.
    The point is that of the ZIP most used in the city (of equal ones the least), else the mean of the
    facilities there. A text without a state or a known city gives no row."""
    state, maybe = named_state(text, states)
    said = F.concat(F.lit(" "), normalize(F.lit(text)), F.lit(" "))
    cities = facilities.select("city", "state").distinct()
    cities = cities.where((normalize(C("city")) != "") & F.contains(said, F.concat(F.lit(" "), normalize(C("city")), F.lit(" "))))
    if state is None and maybe is not None:
        # The letters at the end count if one of the cities in the text lies in that state.
        there = cities.agg(F.max(C("state") == maybe).alias("there"))
        cities = cities.crossJoin(F.broadcast(there)).where(~F.coalesce("there", F.lit(False)) | (C("state") == maybe)).drop("there")
    elif state is not None:
        cities = cities.where(C("state") == state)
    one = cities.agg(F.count_distinct("state").alias("states"), F.max_by(F.struct("city", "state"), F.struct(F.length(normalize(C("city"))), "city")).alias("p"))
    one = one.where("states = 1").select("p.city", "p.state")
    rows = facilities.join(F.broadcast(one.select(F.lower("city").alias("_city"), C("state").alias("_state"))), (F.lower("city") == C("_city")) & (C("state") == C("_state"))).drop("_city", "_state")
    rows = rows.withColumn("named", F.lit(True))
    if state is not None:
        # Without a city the state itself is the place.
        rows = rows.unionByName(facilities.where(C("state") == state).withColumn("named", F.lit(False)))
    zips = rows.where(F.regexp_like("zip", F.lit("^[0-9]{5}"))).groupBy("named", F.substring("zip", 1, 5).alias("zip")).agg(F.count("*").alias("n"))
    zips = zips.groupBy("named").agg(F.min_by("zip", F.struct((-C("n")).alias("n"), "zip")).alias("zip"))
    means = rows.groupBy("named").agg(F.min_by("city", "city").alias("city"), F.first("state").alias("state"), F.avg("lat").alias("mean_lat"), F.avg("lon").alias("mean_lon"))
    points = means.join(zips, "named", "left").join(zcta.select("zip", C("lat").alias("zip_lat"), C("lon").alias("zip_lon")), "zip", "left")
    lat, lon = (F.coalesce(F.when(C("named"), C(f"zip_{x}")), C(f"mean_{x}")).alias(x) for x in ("lat", "lon"))
    label = F.when(C("named"), F.concat(F.initcap("city"), F.lit(", "), "state")).otherwise(C("state")).alias("label")
    found = points.select(label, F.when(C("named"), C("city")).alias("city"), "state", lat, lon, F.coalesce("zip", F.lit("")).alias("zip"), "named")
    return found.where("lat is not null and lon is not null").orderBy(C("named").desc()).limit(1).drop("named")


def candidates(text: str, facilities: DataFrame, k: int = 6) -> DataFrame:
    """The places that an ambiguous text may mean: label, city, state and how many facilities are there."""
    said = F.concat(F.lit(" "), normalize(F.lit(text)), F.lit(" "))
    hit = facilities.where((normalize(C("city")) != "") & F.contains(said, F.concat(F.lit(" "), normalize(C("city")), F.lit(" "))))
    rows = hit.groupBy("city", "state").agg(F.count("*").alias("n"))
    return rows.withColumn("label", F.concat(F.initcap("city"), F.lit(", "), "state")).orderBy(C("n").desc(), "city", "state").limit(k)
