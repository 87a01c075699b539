"""Program search: keywords over descriptions, strict, then relaxed, then by meaning, by facility and place."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import geo, vector
from .functions.text import index_tokens, query_terms, variants, whole_word
from .operators import fulltext, joins, ranking
from .operators.tables import row_hash
from .sources.scratch import stored

C = F.col
#: Programs shown of a facility, facilities of a first and of a later page.
SHOWN, FIRST_PAGE, LATER_PAGE = 6, 100, 50
#: Orders that a request can ask for: nearest, most terms held, best rank, or name; ties as the search's own.
ORDERS = ("distance", "matches", "rank", "name")


@dataclass(frozen=True)
class Lexicon:
    """What a catalog's wording needs, all the user's: words left out of a query, short terms that are
    kept and must match exactly, words listed as forms of a term, a phrase that says a term in full,
    words that mean a term, marks of a wrong match by the beginning of a term, and wrong matches."""

    stop: frozenset[str] = frozenset()
    exact: frozenset[str] = frozenset()
    compounds: dict[str, list[str]] = field(default_factory=dict)
    phrases: dict[str, str] = field(default_factory=dict)
    swaps: dict[str, list[str]] = field(default_factory=dict)
    markers: dict[str, list[str]] = field(default_factory=dict)
    wrong: tuple[tuple, ...] = ()


@dataclass
class Spec:
    """A request, checked when it is made: terms, place, radius, page, lexicon, excluded markers, and the
    order of facilities if it is not to be the search's own: one of `ORDERS`."""

    terms: list[str]
    at: tuple[float, float] | None = None
    miles: float | None = None
    state: str | None = None
    offset: int = 0
    size: int | None = None
    markers: list[str] = field(default_factory=list)
    lexicon: Lexicon = Lexicon()
    order: str | None = None

    def __post_init__(self):
        if not self.terms:
            raise ValueError("a search needs a term")
        if self.miles is not None and self.at is None:
            raise ValueError("a radius needs a place")
        if self.order is not None and self.order not in ORDERS:
            raise ValueError(f"no such order: {self.order}")
        if self.order == "distance" and self.at is None:
            raise ValueError("an order by distance needs a place")
        self.offset = max(0, int(self.offset))
        self.size = (LATER_PAGE if self.offset else FIRST_PAGE) if self.size is None else max(1, int(self.size))

    @classmethod
    def of(cls, keyword: str, lexicon: Lexicon = Lexicon(), **options) -> Spec:
        """A request from words as they are typed."""
        return cls(query_terms(keyword, set(lexicon.stop), 3, set(lexicon.exact)), lexicon=lexicon, **options)

    def _phrase(self, term: str) -> list[str]:
        return [self.lexicon.phrases[term]] if term in self.lexicon.phrases else []

    def patterns(self) -> list[list[str]]:
        """For each term the patterns one of which a description must hold."""
        x = self.lexicon
        return [
            [whole_word(v, tail=t not in x.exact) for v in variants(t, x.compounds)] + [whole_word(p, tail=False) for p in self._phrase(t)] + [whole_word(v) for v in x.swaps.get(t, ())]
            for t in self.terms
        ]

    def prefixes(self) -> list[list[str]]:
        """For each term the beginnings of words by which the index finds it."""
        x = self.lexicon
        return [[*variants(t, x.compounds), *[p.split()[0] for p in self._phrase(t)], *x.swaps.get(t, ())] for t in self.terms]

    def joined(self) -> list[str]:
        """Several terms written as one word."""
        return ["".join(self.terms)] if len(self.terms) > 1 else []


def _any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def keyed(programs: DataFrame) -> DataFrame:
    """Programs (code, ptype, description, did), each once, with their description's key: a hash of it.
    They have a type of null if they have none."""
    if "ptype" not in programs.columns:
        programs = programs.withColumn("ptype", F.lit(None).cast("string"))
    return programs.select("code", "ptype", "description").distinct().withColumn("did", row_hash(programs.select("description")))


def _tables(programs: DataFrame, stemmed: bool) -> dict:
    """The tables of an index of programs, each from those before it: the programs, each description once
    with its words and the number of its programs, and postings of these descriptions."""
    words = F.size(index_tokens(F.coalesce(C("description"), F.lit("")))).cast("long")
    return {
        "rows": keyed(programs),
        "texts": lambda done: done["rows"].groupBy("did", "description").agg(F.count("*").alias("copies")).withColumn("len", words),
        "postings": lambda done: fulltext.postings(done["texts"], "did", ["description"], stemmed).sortWithinPartitions("token", "did"),
    }


def program_index(programs: DataFrame, name: str | None = None, stemmed: bool = False) -> fulltext.Index:
    """The index of descriptions with the programs themselves; with a name it is written once, and again
    when the programs' files change, and read otherwise. Many programs share a description: its words
    are cut, kept and matched once."""
    build = lambda: _tables(programs, stemmed)
    done = {} if name is None else fulltext.stored_tables(programs, build, name, "programs", stemmed)
    if not done:
        for table, frame in build().items():
            done[table] = frame(done) if callable(frame) else frame
    sizes = done["rows"].join(done["texts"].where("len > 0").select("did", "len"), "did").select("code", "ptype", "did", "len")
    return fulltext.Index(done["postings"], sizes, "did", stemmed, done["rows"], done["texts"])


def placed(facilities: DataFrame, spec: Spec) -> DataFrame:
    """Approved facilities of the state and within the radius, with their miles; with a place asked
    for, those without coordinates are left out."""
    rows = facilities.where("approved")
    if spec.state:
        rows = rows.where(F.upper("state") == spec.state.upper())
    rows = rows.select("code", "name", "state", "lat", "lon")
    if spec.at is None:
        return rows.withColumn("miles", F.lit(None).cast("double"))
    if spec.miles is not None:
        rows = rows.where(geo.in_box(C("lat"), C("lon"), spec.at, spec.miles))
    rows = rows.withColumn("miles", geo.haversine(F.lit(spec.at[0]), F.lit(spec.at[1]), C("lat"), C("lon"))).where("miles is not null")
    return rows if spec.miles is None else rows.where(C("miles") <= spec.miles)


def described(programs: DataFrame, spec: Spec, index: fulltext.Index) -> DataFrame:
    """The descriptions that hold a form of every term (tier 0), or of any (1), as a word, or all terms in
    one word (0), with rank (BM25 of the tier, six places, less is better) and hits (terms held). The
    index finds candidates for both tiers at once, and patterns are tried on these, each once however
    many programs it is of. Those with an excluded marker are left out."""
    text = C("description")
    ranked = index.tiers(spec.prefixes(), compound=spec.joined())
    held = [_any(text, g) for g in spec.patterns()]
    joined = _any(text, [whole_word(x) for x in spec.joined()]) if spec.joined() else F.lit(False)
    rows = index.texts.select(index.key, "description").join(ranked, index.key)
    rows = rows.withColumns({**{f"_held{i}": h for i, h in enumerate(held)}, "_joined": joined})
    holds = [f"_held{i}" for i in range(len(held))]
    loose = f"(loose IS NOT NULL AND ({' OR '.join([*holds, '_joined'])}))"
    strict = f"(strict IS NOT NULL AND (({' AND '.join(holds)}) OR _joined))"
    rows = rows.withColumn("tier", F.expr(f"CASE WHEN {strict} THEN 0 WHEN {loose} THEN 1 END")).where("tier IS NOT NULL")
    rank = {"rank": "round(CASE WHEN tier = 0 THEN strict ELSE loose END, 6)", "hits": " + ".join(f"int({h})" for h in holds), "_loose": f"CASE WHEN {loose} THEN round(loose, 6) END"}
    rows = rows.withColumns({c: F.expr(x) for c, x in rank.items()})
    marks = [*spec.markers, *{m for b, ms in spec.lexicon.markers.items() if any(t.startswith(b) for t in spec.terms) for m in ms}]
    for m in sorted(marks):
        rows = rows.where(~F.lower(text).contains(m.lower()))
    return rows.drop("strict", "loose", "_joined", *[f"_held{i}" for i in range(len(held))])


def tiers(programs: DataFrame, spec: Spec, index: fulltext.Index | None = None, near: DataFrame | None = None) -> DataFrame:
    """The programs of `described`. Wrong matches are left out. near: facilities (code and more) that
    programs are to be of. Programs are many: facilities and descriptions are written first, so that
    where these are few, programs are read in place and not dealt."""
    index = index or program_index(programs)
    found = stored(described(programs, spec, index), "descriptions")
    rows = index.rows.drop("description")
    rows = rows if near is None else rows.join(stored(near, "near"), "code")
    return _not_wrong(rows.join(found, index.key), programs, spec)


def _not_wrong(rows: DataFrame, programs: DataFrame, spec: Spec) -> DataFrame:
    if not spec.lexicon.wrong:
        return rows
    wrong = programs.sparkSession.createDataFrame(list(spec.lexicon.wrong), programs.select("code", "description").schema)
    return joins.without_pairs(rows, wrong, ["code", "description"])


def matching(programs: DataFrame, spec: Spec, every: bool, index: fulltext.Index | None = None) -> DataFrame:
    """The programs of `tiers` with every term, or with any, as a search by that tier alone ranks them."""
    rows = tiers(programs, spec, index)
    rows = rows.where("tier = 0") if every else rows.withColumn("rank", C("_loose")).where(C("rank").isNotNull())
    return rows.drop("tier", "_loose")


def _by_facility(rows: DataFrame, spec: Spec, order: list) -> DataFrame:
    """A page of facilities, with the number of all of them and of their programs."""
    shown = F.when(F.row_number().over(Window.partitionBy("code").orderBy("rank", "description", "ptype")) <= SHOWN, F.struct("rank", "description", "ptype"))
    rows = rows.withColumn("_shown", shown)
    grouped = rows.groupBy("code", "name", "state", "miles").agg(
        F.sort_array(F.collect_list("_shown")).alias("programs"), F.count("*").alias("n_programs"), F.min("rank").alias("best_rank"), F.max("hits").alias("hits"), F.min("tier").alias("tier")
    )
    totals = grouped.agg(F.count("*").alias("total_facilities"), F.sum("n_programs").alias("total_programs"))
    page = grouped.orderBy(*order, "code").offset(spec.offset).limit(spec.size).drop("tier").crossJoin(F.broadcast(totals))
    return page.withColumn("remaining", F.greatest(F.lit(0), C("total_facilities") - spec.offset - spec.size)).withColumn("programs", F.transform("programs", lambda p: p.dropFields("rank")))


def program_search(programs: DataFrame, facilities: DataFrame, spec: Spec, fallback: DataFrame | None = None, index: fulltext.Index | None = None) -> DataFrame:
    """Facilities with matching programs, a page of them in order: code, name, state, miles, programs
    (six of them, best first), n_programs, best_rank, hits, total_facilities, total_programs, remaining.

    The place is settled first. Among what lies there, programs with all terms decide if there are any;
    else, of several terms, those with any term: the matches of both are written once, by one plan, and
    the least tier among them is one row. Where neither gives a row, `fallback`, (description, score) rows of like meaning, is grouped alike. With a
    place nearer facilities come first; then, of relaxed matches, more terms, then rank or likeness;
    or first by the request's own order."""
    index = index or program_index(programs)
    return _by_facility(found_programs(programs, facilities, spec, fallback, index), spec, _order(spec))


def program_pages(programs: DataFrame, facilities: DataFrame, specs: list[Spec], index: fulltext.Index | None = None) -> list[DataFrame]:
    """The pages of requests that differ in order, offset and size alone: their programs are found once."""
    if any(replace(s, order=None, offset=0, size=1) != replace(specs[0], order=None, offset=0, size=1) for s in specs):
        raise ValueError("requests that share what they find differ in order, offset and size alone")
    rows = found_programs(programs, facilities, specs[0], index=index or program_index(programs))
    return [_by_facility(rows, s, _order(s)) for s in specs]


def found_programs(programs: DataFrame, facilities: DataFrame, spec: Spec, fallback: DataFrame | None = None, index: fulltext.Index | None = None) -> DataFrame:
    """The programs that `program_search` groups, with their facilities."""
    near = placed(facilities, spec)
    index = index or program_index(programs)
    found = stored(tiers(programs, spec, index, near).drop("_loose"), "matches")
    rows = ranking.cascade(found if len(spec.terms) > 1 else found.where("tier = 0"))
    if fallback is not None and rows.isEmpty():
        alike = fallback.select("description", (-C("score")).alias("rank"))
        own = index.rows.drop("description").join(index.texts.select(index.key, "description").join(alike, "description"), index.key)
        rows = _not_wrong(own, programs, spec).join(near, "code").withColumns({"hits": F.lit(0), "tier": F.lit(2)})
    return rows


def _order(spec: Spec) -> list:
    order = [*([C("miles")] if spec.at is not None else []), F.when(C("tier") == 1, -C("hits")).otherwise(0), C("best_rank")]
    first = {"distance": [C("miles")], "matches": [C("hits").desc()], "rank": [C("best_rank")], "name": [F.lower("name"), C("name")]}
    return [*first.get(spec.order, []), *order]


def semantic_programs(vectors: DataFrame, query: DataFrame, group: str, least: float, k: int) -> DataFrame:
    """The k rows most like the one-row query, at least so like it, and by group the best score."""
    q = query.select(C("embedding").alias("_q")).limit(1)
    rows = vectors.join(F.broadcast(q)).withColumn("score", F.round(vector.cosine(C("embedding"), C("_q")), 6)).where(C("score") >= least)
    top = rows.orderBy(C("score").desc(), "vec_id").limit(k)
    return top.groupBy(group).agg(F.max("score").alias("score"), F.count("*").alias("n"))


def within_results(rows: DataFrame, earlier: DataFrame, key: str = "code") -> DataFrame:
    """A search within an earlier result: the rows whose key that result holds, whatever its size."""
    return rows.join(earlier.select(key).distinct(), key, "left_semi")


def first_that_answers(stages: list[tuple[str, DataFrame]], proof: DataFrame | None = None, key: str = "code") -> DataFrame:
    """A chain of fallbacks: the rows of the first stage that has any, with its name as stage. Rows of
    later stages are said to be verified only if `proof`, say matching programs, has their key."""
    proven = None if proof is None else proof.select(key).distinct().withColumn("_proof", F.lit(True))
    last = stages[-1][1]
    for i, (name, rows) in enumerate(stages):
        if rows is last or not rows.isEmpty():
            rows = rows.withColumn("stage", F.lit(name))
            if i == 0 or proven is None:
                return rows.withColumn("verified", F.lit(i == 0))
            return rows.join(proven, key, "left").withColumn("verified", F.coalesce("_proof", F.lit(False))).drop("_proof")
    return last
