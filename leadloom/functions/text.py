"""Names, domains, e-mails and other short text fields as Column expressions."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import rules

# Patterns of name characters and e-mail cells.
# Letters, digits, underscore and the whole Arabic block count as word characters.
NAME_GAP = r"[^\p{L}\p{N}_\x{0600}-\x{06FF}]+"
WORD_CHAR = r"[\p{L}\p{N}_\x{0600}-\x{06FF}]"
EMAIL_SHAPE = r"^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}$"
DOUBLED_TLD = r"(\.[a-z]{2,6})\1$"
CELL_SPLIT = r"[\s,;|]+"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def null_if_empty(c: Column | str) -> Column:
    """Empty text becomes null; everything else stays."""
    return F.nullif(col_of(c), F.lit(""))


def has_value(c: Column | str) -> Column:
    """True when a text is neither null nor empty."""
    c = col_of(c)
    return c.isNotNull() & (c != "")


SEP, SUB, SLOT = "\u0001", "\u0002", "\u0003"


def words(values: list[str]) -> Column:
    """Array literal of texts; folds to a constant, so long lists stay one small expression."""
    return F.split(F.lit(SEP.join(values)), SEP)


def lookup(pairs: dict[str, str]) -> Column:
    """Map literal of texts."""
    return F.str_to_map(F.lit(SEP.join(f"{k}{SUB}{v}" for k, v in pairs.items())), F.lit(SEP), F.lit(SUB))


def hashed(pairs: dict[str, str], slots: int = 1024):
    """Look-up in a long fixed table: ``hashed(pairs)(key)`` is the value, null where there is none.

    The table is an array of slots by the key's checksum with a few entries each, so a look-up does not walk through it.
    """
    cells = [""] * slots
    for key, value in pairs.items():
        cells[zlib.crc32(key.encode()) % slots] += f"{SEP}{key}{SUB}{value}{SEP}"
    table = F.split(F.lit(SLOT.join(cells)), SLOT)

    def of(key: Column) -> Column:
        cell = F.get(table, (F.crc32(key.cast("binary")) % slots).cast("int"))
        return null_if_empty(F.split_part(F.split_part(cell, F.concat(F.lit(SEP), key, F.lit(SUB)), F.lit(2)), F.lit(SEP), F.lit(1)))

    return of


def settle(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add or replace columns that are computed once per row.

    Unlike ``withColumns``, later filters and projections see them as plain attributes: costly
    expressions are not copied into a pushed-down filter or into every use.
    """
    kept = [c for c in df.columns if c not in cols]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in cols.items()]))))


def spread_key(key: Column | str, *salt: str) -> Column:
    """Text key for probing a left join; a blank one gets a value of its own from the ``salt`` columns.

    All-null keys would meet in one task although none of them can match.
    """
    return F.coalesce(col_of(key), F.concat(F.lit("\u0000"), F.xxhash64(*salt).cast("string")))


def contains_any(text: Column, needles: list[str]) -> Column:
    """True when any needle is a substring of ``text``; false on null text."""
    if len(needles) == 0:
        return F.lit(False)
    found = let(text, lambda t: F.exists(words(needles), lambda needle: F.contains(t, needle)))
    return F.coalesce(found, F.lit(False))


def hits_in(text: Column, needles: list[str]) -> Column:
    """The needles that occur in ``text``; ``text`` should be a column or a bound variable."""
    return F.filter(words(needles), lambda needle: F.contains(text, needle))


def prefix_tree(phrases: list[str]) -> str:
    """One pattern that takes the longest of the phrases at a place."""
    tree: dict = {}
    for phrase in phrases:
        node = tree
        for letter in phrase:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [(letter if letter.isalnum() or letter == " " else rf"\x{{{ord(letter):x}}}") + pattern(below) for letter, below in sorted(node.items()) if letter]
        if not ways:
            return ""
        return (f"(?:{'|'.join(ways)})" if len(ways) > 1 or "" in node else ways[0]) + ("?" if "" in node else "")

    return pattern(tree)


def occurring(text: Column, phrases: list[str]) -> Column:
    """The phrases that occur in ``text``, overlapping ones too: one pass, whatever their number.

    At every place the longest phrase is taken from a prefix tree, without moving on by more than a letter; a fixed table
    adds the phrases that begin it. Any other phrase inside it begins at a place of its own.
    """
    phrases = sorted(set(phrases))
    first = "".join(sorted({p[0] for p in phrases}))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=[{first}])(?=({prefix_tree(phrases)}))"), F.lit(1)))
    inside = {p: [q for q in phrases if p.startswith(q)] for p in phrases}
    longer = [x for p, own in inside.items() if len(own) > 1 for x in (F.lit(p), words(own))]
    if longer:
        found = F.array_distinct(F.flatten(F.transform(found, lambda p: F.coalesce(F.try_element_at(F.create_map(*longer), p), F.array(p)))))
    return F.coalesce(found, F.array().cast("array<string>"))


def among(found: Column, phrases: list[str]) -> Column:
    """True when one of the phrases was found."""
    return F.arrays_overlap(found, words(list(phrases)))


def one_of(value: Column, values: list[str]) -> Column:
    """True when the value is in the list; false for null."""
    if not values:
        return F.lit(False)
    return F.coalesce(F.array_contains(words(list(values)), value), F.lit(False))


def first_of(array: Column) -> Column:
    """First array element, null when there is none."""
    return F.try_element_at(array, F.lit(1))


def name_key(name: Column | str) -> Column:
    """Company name folded for exact matching: lower case, word characters, single spaces."""
    folded = F.regexp_replace(F.lower(col_of(name)), NAME_GAP, " ")
    return F.coalesce(F.trim(folded), F.lit(""))


def site_domain(url: Column | str) -> Column:
    """Host of a web address without port and leading ``www.``; a missing scheme is assumed."""
    trimmed = F.trim(col_of(url))
    full = F.when(F.contains(trimmed, F.lit("://")), trimmed).otherwise(F.concat(F.lit("http://"), trimmed))
    authority = F.lower(F.regexp_extract(full, r"^[^:/?#]+://([^/?#]*)", 1))
    host = F.split_part(authority, F.lit(":"), F.lit(1))
    return F.when(trimmed != "", null_if_empty(F.regexp_replace(host, r"^www\.", "")))


def url_with_scheme(url: Column | str) -> Column:
    """``https://`` in front of an address that names no scheme."""
    u = col_of(url)
    return F.when(has_value(u) & ~F.contains(u, F.lit("://")), F.concat(F.lit("https://"), u)).otherwise(u)


def cell_email(cell: Column | str) -> Column:
    """First usable address of a messy cell, or null."""
    tokens = F.split(F.lower(F.trim(F.replace(col_of(cell), F.lit("%20"), F.lit(" ")))), CELL_SPLIT)

    def repaired(token: Column) -> Column:
        token = F.regexp_replace(token, r"^\.+|\.+$", "")
        at = F.instr(token, "@")
        mailbox = F.substring(token, F.lit(1), at - 1)
        host = F.regexp_replace(F.substr(token, at + 1), DOUBLED_TLD, "$1")
        return F.when(at > 0, F.concat(mailbox, F.lit("@"), host))

    def usable(address: Column) -> Column:
        return address.isNotNull() & F.rlike(address, F.lit(EMAIL_SHAPE)) & ~contains_any(address, rules.CELL_EMAIL_JUNK)

    return first_of(F.filter(F.transform(tokens, repaired), usable))


def lead_email_key(email: Column | str) -> Column:
    return null_if_empty(F.lower(F.trim(col_of(email))))


def personal_email(emails: Column) -> Column:
    """First address whose mailbox is not a role name."""

    def personal(address: Column) -> Column:
        mailbox = F.lower(F.split_part(address, F.lit("@"), F.lit(1)))
        return (mailbox != "") & ~one_of(mailbox, rules.ROLE_MAILBOXES)

    return first_of(F.filter(emails, personal))


def place_label(value: Column | str) -> Column:
    """Panel text without its field prefix."""
    prefixes = "|".join(rules.PLACE_LABELS)
    return null_if_empty(F.trim(F.regexp_replace(F.trim(col_of(value)), rf"(?iu)^({prefixes})\s*", "")))


def list_text(values: Column | str) -> Column:
    return F.coalesce(F.array_join(col_of(values), ", "), F.lit(""))


def whatsapp_number(social_links: Column | str) -> Column:
    """Number at the end of the WhatsApp link, null without one."""
    link = F.try_element_at(col_of(social_links), F.lit("whatsapp"))
    return F.when(has_value(link), F.substring_index(link, "/", -1))


def reason_text(reasons: Column | str) -> Column:
    """Score breakdown in words; an unknown factor shows as it is."""
    labels = lookup(rules.REASON_LABELS)
    named = F.transform(col_of(reasons), lambda r: F.coalesce(F.try_element_at(labels, r["factor"]), r["factor"]))
    return F.coalesce(F.array_join(named, rules.REASON_SEPARATOR), F.lit(""))


def status_label(status: Column | str) -> Column:
    s = col_of(status)
    return F.coalesce(F.try_element_at(lookup(rules.STATUS_LABELS), s), s)


def status_of_label(label: Column | str) -> Column:
    """Back from a label to the stage; anything unknown is a new lead."""
    codes = lookup({v: k for k, v in rules.STATUS_LABELS.items()})
    return F.coalesce(F.try_element_at(codes, col_of(label)), F.lit("new"))


# Common ways to write a day, month names in English; where both orders are possible the month comes first.
DATE_FORMS = ["yyyyMMdd", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy/M/d", "yyyy.M.d", "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM yyyy", "MMMM yyyy"]


def lenient_date(value: Column | str) -> Column:
    """Date of a loosely written cell, null when it is none. A time of day after the date is left out."""
    cell = F.trim(col_of(value).cast("string"))
    bare = F.regexp_replace(cell, r"(?i)(?:T|,?\s+)\d{1,2}:\d{2}.*$", "")
    plain = F.regexp_replace(F.regexp_replace(bare, r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\b", "$1"), r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+|[,\s]+", " ")
    forms = [F.try_to_timestamp(F.trim(plain), F.lit(f)).cast("date") for f in DATE_FORMS]
    return F.coalesce(F.when(F.rlike(cell, F.lit(r"^\d{4}-")), F.try_to_timestamp(cell).cast("date")), *forms)


def looks_blocked(error: Column | str) -> Column:
    return contains_any(F.lower(F.coalesce(col_of(error), F.lit(""))), rules.BLOCK_SIGNALS)
