"""Quality rules, line first: failing lines go, then texts that lose too much of themselves.

Only DataFrame functions run here, and all work on a row stays in that row: nothing is shuffled,
so no source or group of copies can make one task larger than its share of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, words


@dataclass(frozen=True)
class Rules:
    """Limits; shares are in hundredths and compared in whole numbers, so every engine agrees."""

    window: int = 5
    least_words: int = 10
    most_repeated: int = 20
    symbols_per_100_words: int = 30
    shouts: int = 3
    caps_words: int = 5
    ended_words: int = 4
    crumbs: int = 2
    crumb_words: int = 4
    menu_words: int = 12
    menu_share: int = 60
    most_lost: int = 40


#: Phrases that mark a line as boilerplate of web pages, in lower case, by language.
BOILERPLATES = {
    "en": ("lorem ipsum", "enable javascript", "use of cookies", "uses cookies", "accept all cookies", "terms of use", "privacy policy", "click here to", "sign up for our newsletter", "page not found", "skip to content"),
    "de": ("verwendet cookies", "cookies akzeptieren", "datenschutzerkl\u00e4rung", "allgemeine gesch\u00e4ftsbedingungen", "newsletter anmelden", "seite nicht gefunden", "javascript aktivieren", "hier klicken"),
    "fr": ("utilise des cookies", "accepter les cookies", "politique de confidentialit\u00e9", "conditions d'utilisation", "mentions l\u00e9gales", "abonnez-vous \u00e0 notre", "page introuvable", "activer javascript", "cliquez ici"),
    "es": ("utiliza cookies", "aceptar cookies", "pol\u00edtica de privacidad", "t\u00e9rminos de uso", "aviso legal", "suscr\u00edbete a nuestro", "p\u00e1gina no encontrada", "habilitar javascript", "haga clic aqu\u00ed"),
}
BOILERPLATE = tuple(p for ps in BOILERPLATES.values() for p in ps)
#: Words of menus, in lower case, by language; and what stands between crumbs and links.
MENUS = {
    "en": ("home", "about", "contact", "login", "logout", "register", "menu", "search", "next", "previous", "prev", "top", "sitemap", "faq", "help", "share", "print", "subscribe", "blog", "news", "shop", "cart"),
    "de": ("startseite", "kontakt", "impressum", "datenschutz", "anmelden", "abmelden", "suche", "weiter", "zur\u00fcck", "hilfe", "\u00fcbersicht", "warenkorb", "drucken"),
    "fr": ("accueil", "connexion", "rechercher", "suivant", "pr\u00e9c\u00e9dent", "retour", "aide", "panier", "imprimer", "partager", "boutique"),
    "es": ("inicio", "contacto", "buscar", "siguiente", "anterior", "ayuda", "acceder", "carrito", "imprimir", "compartir", "tienda"),
}
MENU = tuple(w for ws in MENUS.values() for w in ws)
BAR = "[|\u00bb\u203a\u00b7\u2022>/]"
CRUMB, NO_LETTER = "[ \\t]*[|\u00bb\u203a\u00b7\u2022][ \\t]*|[ \\t][>/][ \\t]", "[^a-z\u00df-\u00f6\u00f8-\u00ff]+"
SYMBOLS = "#*$%&|<>"
#: What may close a line: sentence marks, then closing quotes, brackets and white space.
MARKS = (".", "!", "?", ":", ";", "\u2026", "\u3002")
CLOSERS = "\"')]\u00bb\u201c\u201d\u2019 \t\x0b\x0c\r"


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", ""))


def word_chars(tokens: Column) -> Column:
    return F.length(F.array_join(tokens, "")).cast("long")


def repeat_words(tokens: Column, window: int) -> Column:
    """Words inside windows that are found twice or more in the text, the first one included.

    A window is known by a 64-bit hash. Texts whose windows all differ, as most do, end with that
    test; in the others the windows are sorted by hash, neighbours that agree give the positions,
    and each position covers its window, or less where the next position follows sooner.
    """

    def covered(win: Column) -> Column:
        def gaps(p: Column) -> Column:
            return F.aggregate(
                F.transform(p, lambda s, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - s, F.lit(window)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            )

        def alike(pairs: Column) -> Column:
            again = F.filter(
                pairs,
                lambda p, k: F.coalesce(F.get(pairs, k - 1)["h"] == p["h"], F.lit(False))
                | F.coalesce(F.get(pairs, k + 1)["h"] == p["h"], F.lit(False)),
            )
            return let(F.array_sort(F.transform(again, lambda p: p["i"])), gaps)

        pairs = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(let(pairs, alike))

    def hashed(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(h) - window + 1)
        return let(F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, window))), covered)

    return F.when(F.size(tokens) <= window, F.lit(0).cast("long")).otherwise(
        let(F.transform(tokens, lambda w: F.xxhash64(w)), hashed)
    )


def line_stands(line: Column, r: Rules) -> Column:
    """Whether a line passes the rules. Lines without a word pass; they hold nothing to lose."""

    def of(n: Column) -> Column:
        symbols = 100 * n_symbols(line) > r.symbols_per_100_words * n
        unended = (n >= r.ended_words) & ~F.right(F.rtrim(line, F.lit(CLOSERS)), F.lit(1)).isin(*MARKS)
        shouted = (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) >= 2 * r.shouts
        capitals = (n >= r.caps_words) & (F.upper(line) == line) & (F.lower(line) != line)
        return (n == 0) | ~(symbols | unended | shouted | capitals | boilerplate(line) | navigation(line, n, r))

    return let(F.size(words(line)), of)


def navigation(line: Column, n: Column, r: Rules) -> Column:
    """Whether a line of n words is a breadcrumb or a row of links, short items between separators, or
    a menu: few words, most of them such as menus have."""
    # Most lines have none of the separators, and a look for single characters is cheap.
    crumbs = F.when(line.rlike(BAR), F.size(F.split(line, CRUMB)) - 1).otherwise(F.lit(0))
    short = (crumbs >= r.crumbs) & (n <= r.crumb_words * (crumbs + 1)) & ~line.startswith("|")
    words_ = F.filter(F.split(F.lower(line), NO_LETTER), lambda w: w != "")
    menu = let(words_, lambda w: 100 * F.size(F.filter(w, lambda x: x.isin(*MENU))) >= r.menu_share * F.size(w))
    return short | ((n >= 2) & (n <= r.menu_words) & menu)


def boilerplate(text: Column) -> Column:
    return let(F.lower(text), lambda x: reduce(or_, [F.contains(x, F.lit(p)) for p in BOILERPLATE]))


def judged(docs: DataFrame, text: str = "text", rules: Rules = Rules(), to: str = "quality") -> DataFrame:
    """Every column of `docs`, and a struct `to` of the counts, the verdict and the cleaned text.

    A null text counts as empty: no words, failed. An empty table gives an empty one. Repeated rows
    are each judged. A column of the input of the name `to` is replaced, whatever its case.
    """
    t, r = F.coalesce(F.col(f"`{text}`"), F.lit("")), rules
    lines = F.split(t, "\n", -1)
    worded = F.filter(lines, lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]")))
    counts = let(
        words(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            word_chars(w).alias("word_chars"),
            repeat_words(w, r.window).alias("n_repeat_words"),
        ),
    )

    def parted(stands: Column) -> Column:
        # Which lines stand is worked out once; lines keep to it by their number.
        lost = F.filter(lines, lambda x, i: ~F.get(stands, i))
        left = F.when(F.forall(stands, lambda x: x), t).otherwise(F.array_join(F.filter(lines, lambda x, i: F.get(stands, i)), "\n"))
        return F.struct(left.alias("text"), word_chars(words(F.array_join(lost, "\n"))).alias("lost"))

    found = F.struct(
        counts.alias("c"),
        n_symbols(t).cast("long").alias("n_symbols"),
        let(worded, lambda w: F.size(w) - F.size(F.array_distinct(w))).cast("long").alias("n_dup_lines"),
        let(F.transform(lines, lambda x: line_stands(x, r)), parted).alias("cleaned"),
    )

    def verdict(q: Column) -> Column:
        n = q["c"]["n_words"]
        failed = (n < r.least_words) | (100 * q["c"]["n_repeat_words"] > r.most_repeated * n)
        lost = 100 * q["cleaned"]["lost"] > r.most_lost * q["c"]["word_chars"]
        return F.struct(
            n.alias("n_words"),
            q["c"]["word_chars"].alias("word_chars"),
            q["n_symbols"].alias("n_symbols"),
            q["n_dup_lines"].alias("n_dup_lines"),
            q["c"]["n_repeat_words"].alias("n_repeat_words"),
            q["cleaned"]["lost"].alias("lost_chars"),
            failed.alias("base_failed"),
            (~failed & ~lost).alias("kept"),
            q["cleaned"]["text"].alias("text"),
        )

    return docs.withColumn(to, let(found, verdict))


def clean(docs: DataFrame, text: str = "text", rules: Rules = Rules(), n_chars: str = "n_chars") -> DataFrame:
    """The documents that pass, without their failing lines, in the columns of `docs`."""
    (to,) = fresh(docs, "quality")
    # An outer explode of one element keeps Spark from working the struct out for the filter and again
    # for its fields.
    q = judged(docs, text, rules, to).withColumn(to, F.explode_outer(F.array(to))).where(F.col(f"{to}.kept"))
    new = {text: F.col(f"{to}.text")}
    if n_chars in docs.columns:
        new[n_chars] = F.length(F.col(f"{to}.text")).cast(docs.schema[n_chars].dataType)
    return q.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
