"""Addresses resolved against a base, by the rules of RFC 3986, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def _once(value: Column, body) -> Column:
    """body(value), the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parts(url: Column) -> Column:
    """scheme, authority, path, query, fragment; null where a part is absent, which is not the same as
    empty, but for the path, which is always there."""
    scheme = F.nullif(F.regexp_extract(url, _SCHEME, 1), F.lit(""))
    rest = F.regexp_replace(url, _SCHEME, "")
    return F.struct(
        scheme.alias("scheme"),
        F.when(rest.startswith("//"), F.regexp_extract(rest, r"^//([^/?#]*)", 1)).alias("authority"),
        F.regexp_extract(rest, r"^(?://[^/?#]*)?([^?#]*)", 1).alias("path"),
        F.when(rest.rlike(r"^[^?#]*\?"), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)).alias("query"),
        F.when(F.contains(rest, F.lit("#")), F.regexp_extract(rest, r"(?s)^[^#]*#(.*)$", 1)).alias("fragment"),
    )


def without_dots(path: Column) -> Column:
    """A path without its . and .. segments; one that climbs above its root stays there."""
    segments = F.split(path, "/", -1)
    least = F.when(path.startswith("/"), 1).otherwise(0)

    def step(held: Column, s: Column) -> Column:
        up = F.when(F.size(held) > least, F.slice(held, F.lit(1), F.size(held) - 1)).otherwise(held)
        return F.when(s == ".", held).when(s == "..", up).otherwise(F.concat(held, F.array(s)))

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    open_end = F.element_at(segments, -1).isin(".", "..")
    return _once(kept, lambda k: F.array_join(F.when(open_end & (F.size(k) > 0), F.concat(k, F.array(F.lit("")))).otherwise(k), "/"))


def _written(scheme: Column, authority: Column, path: Column, query: Column, fragment: Column) -> Column:
    lead = lambda before, c, after="": F.when(c.isNotNull(), F.concat(F.lit(before), c, F.lit(after))).otherwise(F.lit(""))
    return F.concat(lead("", scheme, ":"), lead("//", authority), path, lead("?", query), lead("#", fragment))


def resolved(base: Column, reference: Column) -> Column:
    """The address that a reference on a page stands for. Without a base it is the reference itself,
    without a reference the page, its fragment aside; null where both are."""
    def with_parts(both: Column) -> Column:
        b, r = both["b"], both["r"]
        merged = F.when(r["path"].startswith("/"), r["path"]).when(b["authority"].isNotNull() & (b["path"] == ""), F.concat(F.lit("/"), r["path"])).otherwise(F.concat(F.regexp_replace(b["path"], r"[^/]*$", ""), r["path"]))
        own = r["scheme"].isNotNull() | r["authority"].isNotNull()
        path = F.when(own, without_dots(r["path"])).when(r["path"] == "", b["path"]).otherwise(without_dots(merged))
        query = F.when(own | (r["path"] != "") | r["query"].isNotNull(), r["query"]).otherwise(b["query"])
        scheme = F.coalesce(r["scheme"], b["scheme"])
        authority = F.when(own, r["authority"]).otherwise(b["authority"])
        return _written(scheme, authority, path, query, r["fragment"])

    said, page = F.trim(F.coalesce(reference, F.lit(""))), F.trim(F.coalesce(base, F.lit("")))
    full = _once(F.struct(parts(page).alias("b"), parts(said).alias("r")), with_parts)
    return F.when(base.isNotNull() | reference.isNotNull(), F.when(page == "", said).otherwise(full))
