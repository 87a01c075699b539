"""The engine's operations as methods over a catalog of DataFrames. Each is a plan; none collects."""

from __future__ import annotations

import inspect
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import geo, vector
from .functions.text import tokens, variants, whole_word
from .operators import fulltext, graph, joins, located, ranking
from .places import candidates, resolve_area
from .search import Spec, first_that_answers, matching, program_index, program_search, within_results

C = F.col


class RequestError(ValueError):
    """A request that the engine cannot answer: an unknown name or a value out of range."""


def coerced(value: object, kind: str) -> object:
    """A value as what an annotation names: whole and other numbers, truth and lists from text."""
    names = [x.strip() for x in kind.split("|")]
    if value is None or (isinstance(value, str) and not value.strip() and "None" in names):
        return None
    if isinstance(value, str) and "str" not in names:
        text = value.strip()
        if "bool" in names and text.lower() in ("true", "false", "yes", "no", "1", "0"):
            return text.lower() in ("true", "yes", "1")
        if "int" in names or "float" in names:
            number = float(text)
            if "int" in names and "float" not in names:
                if number != int(number):
                    raise ValueError(f"{value!r} is no whole number")
                return int(number)
            return number
        if names[0].startswith("list["):
            return [x.strip() for x in text.split(",") if x.strip()]
    if isinstance(value, float) and "int" in names and "float" not in names and value == int(value):
        return int(value)
    return value


@dataclass
class Catalog:
    """facility (code, name, state, approved, is_employer, is_school, lat, lon, zip), program (code,
    ptype, description), zcta (zip, lat, lon), triples (s, p, o), crosswalk (cip, soc), completions
    (unitid, cip, awlevel, awards), and (url, topic) resources if any. Where `name` tells the catalog
    apart, its indexes are written once, and again when the files behind a table change."""

    facility: DataFrame
    program: DataFrame
    zcta: DataFrame
    triples: DataFrame
    crosswalk: DataFrame
    completions: DataFrame
    resources: DataFrame | None = None
    name: str | None = None

    def programs(self) -> fulltext.Index:
        """The index of programs: the stored one where the catalog has a name."""
        return program_index(self.program, self.name)

    def entities(self, docs: DataFrame, key: str, fields: list[str]) -> fulltext.Index:
        """The index of a table of entities by fields, likewise."""
        if self.name is not None:
            return fulltext.index_of(docs, key, fields, f"{self.name}#{key}")
        posts = fulltext.postings(docs, key, fields)
        return fulltext.Index(posts, fulltext.lengths(posts, key), key)


class Engine:
    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def call(self, operation: str, **arguments) -> DataFrame:
        """An operation by name; unknown names and arguments raise RequestError. Arguments that come as
        text, or as one value for a list, are made what the operation takes; what cannot be is refused."""
        method = getattr(self, operation, None) if operation in OPERATIONS else None
        if method is None:
            raise RequestError(f"unknown operation {operation!r}")
        try:
            kinds = inspect.signature(method).parameters
            return method(**{k: coerced(v, str(kinds[k].annotation)) if k in kinds else v for k, v in arguments.items()})
        except (TypeError, ValueError) as e:
            raise RequestError(str(e)) from e

    def search_entities(self, docs: DataFrame, key: str, fields: list[str], terms: list[str], k: int = 5, main: list[str] | None = None, weights: dict[str, float] | None = None, index: fulltext.Index | None = None) -> DataFrame:
        """key, tier, score: all terms in the main fields (the first, if none are named), then any term
        there, then any term anywhere, up to k; one reading of the index. Fields weigh one by default."""
        if not terms:
            raise RequestError("no terms")
        index = index or self.catalog.entities(docs, key, fields)
        return fulltext.field_tiers(index, terms, main or fields[:1], weights or dict.fromkeys(fields, 1.0), max(1, min(int(k), 50)))

    def entity(self, iri: str) -> DataFrame:
        """An entity's facts: each predicate with its values in order."""
        by = self.catalog.triples.where(C("s") == iri).groupBy("s", "p").agg(F.sort_array(F.collect_set("o")).alias("os"))
        return by.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("p", "os"))).alias("facts"))

    def related(self, iri: str, through: str, title: str = "title", k: int = 8) -> DataFrame:
        rows = graph.match(self.catalog.triples, [(iri, through, "?r"), ("?other", through, "?r"), ("?other", title, "?title")])
        return rows.where(C("other") != iri).select("other", "title").distinct().orderBy("title", "other").limit(max(1, min(int(k), 8)))

    def resolve_location(self, place: str, states: dict[str, str] | None = None) -> DataFrame:
        """The place that a text names, one row, and where it is in doubt its candidates instead:
        label, city, state, lat, lon, zip. Facilities without a city have their state for one."""
        f = self.catalog.facility
        rows = f if "city" in f.columns else f.withColumn("city", C("state"))
        found = resolve_area(place, rows, self.catalog.zcta, states or {})
        if not found.isEmpty():
            return found
        nothing = [F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit("").alias("zip")]
        return candidates(place, rows).select("label", "city", "state", *nothing)

    def _within(self, lat: float, lon: float, miles: float, employer: bool | None = None, among: DataFrame | None = None) -> DataFrame:
        if not (-90 <= lat <= 90 and -180 <= lon <= 180):
            raise RequestError("coordinates out of range")
        rows = self.catalog.facility.where(C("approved") & geo.in_box(C("lat"), C("lon"), (lat, lon), miles))
        if employer is not None:
            rows = rows.where(C("is_employer") == employer)
        if among is not None:
            rows = within_results(rows, among)
        return rows.withColumn("miles", geo.haversine(F.lit(lat), F.lit(lon), C("lat"), C("lon"))).where(C("miles") <= miles)

    def nearby(self, lat: float, lon: float, miles: float = 50.0, k: int = 20, employer: bool | None = None, among: DataFrame | None = None) -> DataFrame:
        """The k nearest, of those of an earlier result if one is given."""
        return self._within(lat, lon, miles, employer, among).orderBy("miles", "code").limit(max(1, int(k)))

    def nearby_zip(self, zips: list[str], miles: float = 100.0, k: int = 8, employer: bool | None = None) -> DataFrame:
        """zip, rank and miles with the k nearest approved facilities of each ZIP; unknown ZIPs have none."""
        spots = self.catalog.zcta.where(C("zip").isin(*zips)).select("zip", "lat", "lon")
        rows = self.catalog.facility.where("approved")
        if employer is not None:
            rows = rows.where(C("is_employer") if employer else C("is_school"))
        rows = rows.withColumnsRenamed({"lat": "facility_lat", "lon": "facility_lon", "zip": "facility_zip"})
        return located.geo_knn_join(spots, rows, max(1, int(k)), "zip", "code", right_lat="facility_lat", right_lon="facility_lon", most=float(miles))

    def facility_search(self, lat: float, lon: float, miles: float, vectors: DataFrame, query: list[float], least: float = 0.62, k: int = 20, words: list[str] = (), terms: list[str] = (), among: DataFrame | None = None) -> DataFrame:
        """Facilities in the radius by likeness of their vectors (code, embedding) to the query's and by
        the share of its words in their names; where none is like enough, schools, then the nearest of
        any kind, marked by stage. Those of a fallback are verified if a program of theirs has a term.
        Distance is settled first, so that only near ones are compared."""
        near = self._within(lat, lon, miles, among=among).select("code", "name", "miles", "is_school")
        q, said = F.array(*[F.lit(float(x)) for x in query]), F.array(*map(F.lit, words)).cast("array<string>")
        rows = near.join(vectors.select("code", "embedding"), "code").withColumn("score", vector.hybrid(C("embedding"), q, said, tokens(C("name")))).where(C("score") >= least).drop("embedding")
        bare = near.withColumn("score", F.lit(None).cast("double"))
        proof = None
        if terms:
            spec = Spec(list(terms))
            proof = matching(self.catalog.program, spec, False, self.catalog.programs())
        found = first_that_answers([("alike", rows), ("school", bare.where("is_school")), ("nearest", bare)], proof)
        return found.drop("is_school").orderBy(C("score").desc_nulls_last(), "miles", "code").limit(max(1, int(k)))

    def program_search(self, terms: list[str] | str, fallback: DataFrame | None = None, **options) -> DataFrame:
        spec = Spec.of(terms, **options) if isinstance(terms, str) else Spec(terms, **options)
        return program_search(self.catalog.program, self.catalog.facility, spec, fallback, self.catalog.programs())

    def local_training(self, soc: str, lat: float, lon: float, miles: float, names: DataFrame | None = None, k: int = 20) -> DataFrame:
        """Programs that lead to an occupation at institutions in the radius, with the facility whose name
        is theirs: `names` (unitid, name) are the institutions' names, by default the facilities' own."""
        found = self.crosswalk_search(soc, lat, lon, k=None).where(C("miles") <= miles)
        f = self.catalog.facility.where("approved").select("code", C("name").alias("facility"))
        names = names if names is not None else self.catalog.facility.select(C("code").alias("unitid"), "name")
        named = found.select("unitid").distinct().join(names, "unitid")
        pairs = joins.name_match(named, f, "unitid", "name", "code", "facility")
        return found.join(pairs, "unitid", "left").orderBy("miles", C("awards").desc(), "unitid", "cip").limit(k)

    def crosswalk_search(self, soc: str, lat: float | None = None, lon: float | None = None, state: str | None = None, k: int | None = 20) -> DataFrame:
        """Programs that lead to an occupation; a state given is honoured whatever the place. All of
        them, in no order, where k is None."""
        cips = self.catalog.crosswalk.where(C("soc") == soc).select("cip").distinct()
        rows = self.catalog.completions.join(cips, "cip").groupBy("unitid", "cip").agg(F.sum("awards").alias("awards"))
        f = self.catalog.facility.select(C("code").alias("unitid"), "name", "state", "lat", "lon")
        rows = rows.join(f.where(F.upper("state") == state.upper()) if state else f, "unitid")
        miles = F.lit(None).cast("double") if lat is None or lon is None else geo.haversine(F.lit(lat), F.lit(lon), C("lat"), C("lon"))
        rows = rows.withColumn("miles", miles)
        return rows if k is None else rows.orderBy(C("miles").asc_nulls_last(), C("awards").desc(), "unitid", "cip").limit(k)

    def find_facility(self, code: int | None = None, name: str | None = None) -> DataFrame:
        """By code, or by name: equal once normal, else one that holds it, or the best share of tokens."""
        f = self.catalog.facility
        if code is not None:
            return f.where(C("code") == code)
        if not name:
            raise RequestError("a code or a name is needed")
        asked = f.sparkSession.createDataFrame([(0, name)], "q int, asked string")
        best = joins.find_name(asked, f, "q", "asked", "code", "name")
        return f.join(F.broadcast(best.select("code")), "code", "left_semi")

    def details(self, code: int, terms: list[str] = (), k: int = 6, mode: str = "sample", required: list[str] = ()) -> DataFrame:
        """A facility's programs by type: the number of all, of those that match, and the programs of a
        mode: all; relevant, those that match; or sample, k of them, required descriptions first, then
        those that match. The facility's name, state and ZIP go with each type."""
        if mode not in ("all", "relevant", "sample"):
            raise RequestError(f"unknown mode {mode!r}")
        hit = F.lit(False)
        for term in terms:
            for v in variants(term):
                hit = hit | C("description").rlike(whole_word(v))
        rows = self.catalog.program.where(C("code") == code).withColumn("hit", hit)
        rows = rows.withColumn("must", C("description").isin(*required) if required else F.lit(False)).withColumn("score", C("hit").cast("int"))
        counts = rows.groupBy("ptype").agg(F.count("*").alias("all"), F.count_if("hit").alias("matching"))
        shown = rows if mode == "all" else rows.where(C("hit") | C("must")) if mode == "relevant" else ranking.pinned(rows, ["ptype"], "must", "score", "description", k)
        item = F.struct((~C("must")).alias("later"), (-C("score")).alias("less"), "description")
        shown = shown.groupBy("ptype").agg(F.sort_array(F.collect_list(item)).alias("x"))
        about = self.catalog.facility.where(C("code") == code).select("name", "state", "zip")
        out = counts.join(shown, "ptype", "left").select("ptype", "all", "matching", F.coalesce(F.transform("x", lambda x: x["description"]), F.array().cast("array<string>")).alias("programs"))
        return out.crossJoin(F.broadcast(about))

    def official_resources(self, topics: list[str]) -> DataFrame:
        if self.catalog.resources is None:
            raise RequestError("the catalog has no resources")
        return self.catalog.resources.where(C("topic").isin(*topics)).dropDuplicates(["url", "topic"])

    def stats(self) -> DataFrame:
        c = self.catalog
        one = lambda n, d: d.agg(F.lit(n).alias("table"), F.count("*").alias("rows"))
        return one("facility", c.facility).unionByName(one("program", c.program)).unionByName(one("triples", c.triples)).unionByName(one("completions", c.completions))


#: The operations that can be called by name.
OPERATIONS = ("search_entities", "entity", "related", "resolve_location", "nearby", "nearby_zip", "facility_search", "program_search", "local_training", "crosswalk_search", "find_facility", "details", "official_resources", "stats")
