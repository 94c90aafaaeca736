"""Keyword intelligence on lower-cased text: company type, intent, shop, markets, decision-maker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import rules
from leadloom.functions.text import among, contains_any, first_of, hits_in, let, lookup, null_if_empty, occurring, personal_email, words

# Fixed value: how a person's name looks in Latin or Arabic letters.
PERSON = (
    r"(?:[A-Z][A-Za-z.\-]+(?:\s+[A-Z][A-Za-z.\-]+){1,2}"
    r"|[\x{0600}-\x{06FF}]{2,}(?:\s+[\x{0600}-\x{06FF}]{2,}){1,3})"
)


SIGNALS = [
    *[p for phrases in rules.COMPANY_TYPE_SIGNALS.values() for p in phrases], *rules.STRONG_FORWARDER, *rules.INTENT_SIGNALS, *rules.STORE_MARKERS,
    *[p for phrases in rules.MARKET_SIGNALS.values() for p in phrases], *[t for titles in rules.ROLE_TITLES.values() for t in titles],
]


def phrases(low: Column) -> Column:
    """All phrases of the rules that occur in a lower-cased text, read in one pass. Settle it before using it more than once.

    The text is read between blanks, as some phrases are whole words by their blanks.
    """
    return occurring(F.concat(F.lit(" "), low, F.lit(" ")), SIGNALS)


def has_store(found: Column) -> Column:
    return among(found, rules.STORE_MARKERS)


def company_type(found: Column, category: Column) -> Column:
    """Type with most phrase hits, earlier type on a tie.

    A forwarder by weak words only gives way to the best customer type; a text without any hit
    falls back to the category.
    """
    ranked = []
    for order, (kind, own) in enumerate(rules.COMPANY_TYPE_SIGNALS.items()):
        hits = F.size(F.array_intersect(found, words(own)))
        if kind == "Ecommerce":
            hits = hits + has_store(found).cast("int")
        ranked.append(F.struct(hits.alias("hits"), F.lit(-order).alias("order"), F.lit(kind).alias("kind")))
    customers = [r for r, kind in zip(ranked, rules.COMPANY_TYPE_SIGNALS) if kind in rules.CUSTOMER_TYPES]
    scores = F.struct(F.greatest(*ranked).alias("best"), F.greatest(*customers).alias("customer"), among(found, rules.STRONG_FORWARDER).alias("strong"))

    def decide(s: Column) -> Column:
        weak = (s["best"]["kind"] == "Freight Forwarder") & (s["customer"]["hits"] > 0) & ~s["strong"]
        return (
            F.when((s["best"]["hits"] > 0) & weak, s["customer"]["kind"])
            .when(s["best"]["hits"] > 0, s["best"]["kind"])
            .when(contains_any(F.lower(category), ["freight", "forwarder"]), F.lit("Freight Forwarder"))
            .otherwise(F.lit("Unknown"))
        )

    return let(scores, decide)


def shipping_intent(found: Column, kind: Column) -> Column:
    """Points of all phrases present, shop bonus and base of the type, at most 100."""
    total = F.when(has_store(found), F.lit(rules.STORE_INTENT_BONUS)).otherwise(0)
    for value in sorted(set(rules.INTENT_SIGNALS.values())):
        total = total + F.size(F.array_intersect(found, words([p for p, v in rules.INTENT_SIGNALS.items() if v == value]))) * value
    base = F.coalesce(
        F.try_element_at(lookup({k: str(v) for k, v in rules.TYPE_BASE_INTENT.items()}), kind).cast("int"), F.lit(0)
    )
    return F.least(total + base, F.lit(rules.MAX_INTENT))


def intent_phrases(found: Column) -> Column:
    return F.array_sort(F.array_intersect(found, words(list(rules.INTENT_SIGNALS))))


def platform_rank(low_markup: Column) -> Column:
    """Place in the rules of the first platform one of whose fingerprints occurs in the raw markup, from 1; null for none."""
    marks = list(rules.STORE_PLATFORMS.values())
    return let(occurring(low_markup, [m for own in marks for m in own]), lambda found: F.coalesce(*[F.when(among(found, own), F.lit(i)) for i, own in enumerate(marks, 1)]))


def platform_of_rank(rank: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, rules.STORE_PLATFORMS)), rank)


def store_platform(low_markup: Column) -> Column:
    """First platform one of whose fingerprints occurs in the raw markup."""
    return platform_of_rank(platform_rank(low_markup))


def markets(found: Column) -> Column:
    """Markets named in the text, in rule order."""
    return F.array_compact(F.array(*[F.when(among(found, marks), F.lit(m)) for m, marks in rules.MARKET_SIGNALS.items()]))


def site_intent(intent: Column, found_markets: Column, store: Column) -> Column:
    """Intent of a whole site: extra points per foreign market and for a shop."""
    foreign = F.size(F.filter(found_markets, lambda m: ~F.startswith(m, F.lit(rules.LOCAL_MARKET_PREFIX))))
    bonus = F.when(store, F.lit(rules.STORE_INTENT_BONUS)).otherwise(0)
    return F.least(intent + rules.MARKET_INTENT_BONUS * foreign + bonus, F.lit(rules.MAX_INTENT))


def decision_maker(text: Column, emails: Column, found: Column) -> Column:
    """(name, role, email) of the strongest role named in the text; null when none is. ``found``: its ``phrases``."""
    titles = [t for words_ in rules.ROLE_TITLES.values() for t in words_]
    roles = lookup({t: role for role, words_ in rules.ROLE_TITLES.items() for t in words_})
    title = first_of(F.array_intersect(words(titles), found))

    def near(title: Column) -> Column:
        quoted = F.concat(F.lit(r"\Q"), title, F.lit(r"\E"))
        before = F.concat(F.lit(rf"(?iuU)({PERSON})\s*[,\-–—|:]\s*"), quoted)
        after = F.concat(F.lit(r"(?iuU)"), quoted, F.lit(rf"\s*[:\-–—|]\s*({PERSON})"))
        found = [null_if_empty(F.call_function("regexp_extract", text, p, F.lit(1))) for p in (before, after)]
        return F.trim(F.coalesce(*found))

    def contact(title: Column) -> Column:
        return F.when(
            title.isNotNull(),
            F.struct(
                near(title).alias("name"), F.try_element_at(roles, title).alias("role"), personal_email(emails).alias("email")
            ),
        )

    return let(title, contact)


def mapped_category(category: Column, needles: dict[str, str], default: str) -> Column:
    """Directory category by the first needle found; no category gives the default, no hit null."""
    hit = let(F.lower(category), lambda c: first_of(hits_in(c, list(needles))))
    out = F.try_element_at(lookup(needles), hit)
    return F.when(category.isNull() | (category == ""), F.lit(default)).otherwise(out)


def relevant_category(category: Column, hints: list[str]) -> Column:
    return category.isNull() | (category == "") | contains_any(F.lower(category), hints)


def location_wanted(city: Column, governorate: Column, tokens: Column) -> Column:
    """Every wanted token occurs in city or governorate; no tokens pass."""
    hay = F.lower(F.concat(F.coalesce(city, F.lit("")), F.lit(" "), F.coalesce(governorate, F.lit(""))))
    wanted = F.filter(F.transform(tokens, lambda t: F.lower(F.trim(t))), lambda t: t != "")
    return F.coalesce(F.forall(wanted, lambda t: F.contains(hay, t)), F.lit(True))


def country_named(address: Column, country: Column, name: Column, wanted: str) -> Column:
    blob = F.lower(F.concat_ws(" ", address, country, name))
    return F.contains(blob, F.lit(wanted.strip().lower()))


def search_text(category: Column, role: Column, place: Column, country: Column) -> Column:
    """Search phrase of a request: category, role word, place, country."""
    empty = F.lit("")
    named = F.coalesce(role, empty)
    phrase = F.lower(named)
    for name, word in rules.ROLE_WORDS.items():
        phrase = F.when(named == name, F.lit(word)).otherwise(phrase)
    what = F.concat_ws(" ", null_if_empty(category), null_if_empty(phrase))
    what = F.when(what == "", F.lit("companies")).otherwise(what)
    where = F.when(F.coalesce(place, empty) != "", F.concat(F.lit(" in "), place)).otherwise(empty)
    land = F.when(F.coalesce(country, empty) != "", F.concat(F.lit(" "), country)).otherwise(empty)
    return F.trim(F.concat(what, where, land))
