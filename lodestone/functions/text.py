"""Text expressions: normal forms, tokens, query terms, cleaners, addresses, links."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALNUM = "[a-z0-9]+"


def tokens(c: Column) -> Column:
    """Runs of a-z and digits of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({ALNUM})"), F.lit(1))


def normalize(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def squeeze(c: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[ \\t\\n\\r]+", " "))


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text holds; 0 without query tokens."""
    q = F.array_distinct(query)
    return F.size(F.array_intersect(q, text)) / F.greatest(F.size(q), F.lit(1))


def _plain_letters() -> tuple[str, str]:
    """Letters that are one letter and marks, and those letters, from the Unicode tables."""
    found = {}
    for i in range(0x80, 0x30000):
        bare = [c for c in unicodedata.normalize("NFD", chr(i)) if not unicodedata.category(c).startswith("M")]
        if len(bare) == 1 and bare[0] != chr(i):
            found[chr(i)] = bare[0]
    return "".join(found), "".join(found.values())


MARKED, BARE = _plain_letters()


def fold(c: Column) -> Column:
    """Lower case without marks, of letters of any script; worked out in the JVM. Syllables of Hangul,
    which are several letters and no marks, stay whole."""
    # A text of as many bytes as characters is ASCII and has no marks.
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.lower(F.translate(F.regexp_replace(c, r"\p{M}+", ""), MARKED, BARE)))


def index_tokens(c: Column) -> Column:
    """The words that an index holds of a text: runs of letters and digits of any script, in lower case
    and without their marks."""
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def index_words(text: str | None, stemmed: bool = False) -> list[str]:
    """`index_tokens` of one text, say a query, stemmed if asked."""
    from .stem import stem

    plain = "".join(c for c in (text or "") if not unicodedata.category(c).startswith("M")).translate(str.maketrans(MARKED, BARE))
    found = re.findall(r"[^\W_]+", plain.lower())
    return [stem(w) for w in found] if stemmed else found


@F.pandas_udf(T.StringType())
def stems(words: pd.Series) -> pd.Series:
    """The stems of words, each worked out once a batch."""
    from .stem import stem

    known = {w: stem(w) for w in words.unique()}
    return words.map(known)


def number(c: Column) -> Column:
    return c.try_cast("double")


def round_even(c: Column) -> Column:
    return F.bround(number(c)).cast("bigint")


def present(c: Column) -> Column:
    """The value, or null where it is blank."""
    return F.nullif(F.trim(c), F.lit(""))


def first_present(*cs: Column) -> Column:
    """The first column that is there; one that is present but empty wins over later ones."""
    return F.coalesce(*cs)


def address(*parts: Column) -> Column:
    return F.concat_ws(", ", *[present(p) for p in parts])


#: The names of lines that hold nothing but an address.
ADDRESS_LINES = "Program details|Program info|School website|Official Resources?"


def clean_message(c: Column) -> Column:
    """A reply as plain text: a list of suggestions at its end goes, then lines of addresses, addresses,
    their names left alone, blank lines past one, bold marks; list marks become dashes."""
    steps = [
        (r"(?is)\n\s*suggestions\s*:\s*\[.*\]\s*$", ""),
        (rf"(?im)^\s*(?:{ADDRESS_LINES}):\s*https?://\S+\s*$", ""),
        (r"https?://\S+", ""),
        (rf"(?m)^\s*(?:{ADDRESS_LINES}):\s*$", ""),
        (r"\n{3,}", "\n\n"),
        (r"\*\*(.+?)\*\*", "$1"),
        (r"(?m)^\s*[-*]\s+", "- "),
    ]
    plain = reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)
    return F.regexp_replace(F.regexp_replace(plain, r"^\s+", ""), r"\s+$", "")


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    """One host is the other or a subdomain of it, `www.` aside."""
    return (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a))


def with_scheme(url: Column) -> Column:
    return F.when(~F.regexp_like(url, F.lit("(?i)^https?://")), F.concat(F.lit("https://"), url)).otherwise(url)


def percent_encode(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def json_block(c: Column, first_key: str = "message") -> Column:
    """The JSON of a fenced block; else the text if it begins with a brace, or from the last object
    that begins with `first_key`. Null where that does not parse: the caller falls back to the text."""
    t = F.trim(c)
    fenced = F.nullif(F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1), F.lit(""))
    last = F.nullif(F.regexp_extract(t, rf'(?s)^.*(\{{"{re.escape(first_key)}".*)$', 1), F.lit(""))
    found = F.coalesce(fenced, F.when(t.startswith("{"), t), last)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def whole_word(term: str, tail: bool = True) -> str:
    """A pattern for a term as a word, with one more word character after it if `tail`."""
    return rf"(?i)\b{re.escape(term)}{r'\w?' if tail else ''}\b"


#: An ending, the least length of a term for it, and the endings that take its place.
ENDINGS = (("er", 5, ("ing", "e", "ed")), ("ing", 6, ("er", "e", "ed")), ("e", 4, ("er", "ing", "ed")), ("ed", 5, ("", "er", "ing")))


def variants(term: str, compounds: dict[str, list[str]] | None = None) -> list[str]:
    """A term, its forms by `ENDINGS`, and the words listed for it. Only -ed leaves a bare root, and
    -eed is no ending, so that care does not find car, nor speed spe."""
    forms = {term, *(compounds or {}).get(term, ())}
    for ending, least, others in ENDINGS:
        if term.endswith(ending) and len(term) >= least and not term.endswith("eed"):
            forms |= {term[: -len(ending)] + x for x in others}
    return sorted(forms)


def query_terms(text: str, stop: set[str], least: int = 3, allowed: set[str] = frozenset(), digits: bool = True) -> list[str]:
    """Distinct tokens of a query in order: long enough or allowed, and not stop words."""
    found = dict.fromkeys(re.findall(ALNUM, text.lower()))
    return [t for t in found if (len(t) >= least or t in allowed) and t not in stop and (digits or not t.isdigit())]


def query_terms_col(text: Column, stop: list[str], least: int = 3, allowed: list[str] = (), digits: bool = True) -> Column:
    ok = F.array_distinct(F.array_except(tokens(text), F.array(*map(F.lit, stop))))
    keep = lambda t: ((F.length(t) >= least) | t.isin(*allowed or [""])) & (F.lit(True) if digits else ~F.regexp_like(t, F.lit("^[0-9]+$")))
    return F.filter(ok, keep)


def canonical_json(c: Column) -> Column:
    """A JSON text in one form: keys in order at every depth, no spaces, numbers as they are short, other
    than ASCII escaped. Null where the text is no JSON."""
    text = F.to_json(F.try_parse_json(c))
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(ch: Column) -> Column:
        n = F.ascii(ch)
        pair = F.concat(unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), unit(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(F.lit(0x3FF))))
        return F.when(n < 0x80, ch).when(n < 0x10000, unit(n)).otherwise(pair)

    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(text, ""), escaped), "")).otherwise(text)


def versioned_key(c: Column, version: str) -> Column:
    """SHA-256 of a JSON text in its one form with the version of what answers it: equal for payloads
    that differ in the order of keys and in spaces alone."""
    return F.sha2(F.concat(F.lit('{"payload":'), canonical_json(c), F.lit(',"version":"' + version.replace("\\", "\\\\").replace('"', '\\"') + '"}')), 256)
