"""Reading landed HTML inside a row: text, anchors, contacts, links. No shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import rules
from leadloom.functions.phone import valid_phones
from leadloom.functions.text import SEP, col_of, contains_any, first_of, hashed, let, null_if_empty, one_of, prefix_tree, words

# The first letter stands before the choices, so other letters are passed by at once.
HIDDEN = (
    r"(?is)<(?:!--.*?(?:-->|$)|script\b[^>]*>.*?(?:</script\s*>|$)"
    r"|style\b[^>]*>.*?(?:</style\s*>|$)|template\b[^>]*>.*?(?:</template\s*>|$))"
)
TAG = r"<[/!?a-zA-Z][^>]*>"
GAP = SEP
OUTER_SPACE = r"^[\s\x{00A0}]+|[\s\x{00A0}]+$"
ANCHOR = r"(?is)<a\s[^>]*>.*?</a\s*>"
# Patterns that decide which texts count as a phone, an e-mail or a WhatsApp link.
PHONE_LIKE = r"(\+?\d[\d\s\-()]{7,}\d)"
EMAIL_LIKE = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
HIDDEN_EMAIL = r'data-cfemail="([0-9a-fA-F]{6,})"'
WHATSAPP = r"(?i)(?:wa\.me/|whatsapp\.com/send\?phone=|whatsapp://send\?phone=)\+?(\d{6,15})"


def squeeze_ends(c: Column) -> Column:
    return F.regexp_replace(c, OUTER_SPACE, "")


def decode_entities(text: Column, in_attribute: bool = False) -> Column:
    """Character references to characters, read once from left to right, so nothing is decoded twice.

    All names of HTML are known; some may go without ``;``, of those the longest is read, in an attribute only if no letter,
    digit or ``=`` follows. A number that is no character becomes U+FFFD; an unknown name stays as it is.
    """
    known = hashed(rules.NAMED_ENTITIES)
    open_names = prefix_tree([n for n in rules.NAMED_ENTITIES if not n.endswith(";")])
    bare = rf"^({open_names}){'(?![A-Za-z0-9=])' if in_attribute else ''}"

    def character(code: Column) -> Column:
        real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        exact = F.decode(F.unhex(F.lpad(F.hex(F.when(real, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.when(code.between(128, 159), F.get(words(rules.NUMBERED_ENTITIES), (code - 128).cast("int"))).otherwise(exact)

    def numbered(part: Column) -> Column:
        decimal = F.regexp_extract(part, r"^#([0-9]{1,18})(?![0-9])", 1)
        hexa = F.regexp_extract(part, r"^#[xX]([0-9a-fA-F]{1,15})(?![0-9a-fA-F])", 1)
        code = F.when(decimal != "", decimal.cast("long")).when(hexa != "", F.conv(hexa, 16, 10).cast("long"))
        return F.concat(character(code), F.regexp_replace(part, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", ""))

    def named(part: Column) -> Column:
        whole = F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]{1,31};)", 1)
        short = F.regexp_extract(part, bare, 1)
        found = lambda name: F.concat(known(name), F.substr(part, F.length(name) + 1))
        return F.coalesce(F.when(whole != "", let(whole, found)), F.when(short != "", let(short, found)), F.concat(F.lit("&"), part))

    def tail(part: Column) -> Column:
        return F.when(F.startswith(part, F.lit("#")), F.coalesce(numbered(part), F.concat(F.lit("&"), part))).otherwise(named(part))

    parts = F.split(text, "&")
    read = F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, 2, 1 << 30), tail), ""))
    return F.when(F.contains(text, F.lit("&")), read).otherwise(text)


def visible_text(html: Column | str) -> Column:
    """What a reader sees: text pieces between tags, trimmed, joined by one space."""

    def read(markup: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(markup, HIDDEN, ""), TAG, GAP)
        pieces = F.transform(F.split(let(bare, lambda t: decode_entities(t)), GAP), squeeze_ends)
        joined = F.array_join(F.filter(pieces, lambda p: p != ""), " ")
        return F.when(F.contains(markup, F.lit("<")), joined).otherwise(squeeze_ends(decode_entities(markup)))

    return let(col_of(html), read)


def attribute(tag: Column, name: str) -> Column:
    """Attribute value of an opening tag, '' when absent."""
    pattern = rf"""(?is)^<[^>]*?\s{name}\s*=\s*(?:"([^">]*)"|'([^'>]*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])


def anchors(html: Column | str) -> Column:
    """Links of a page in document order: array of (pos, href, text)."""
    shown = F.regexp_replace(col_of(html), HIDDEN, "")
    found = F.regexp_extract_all(shown, F.lit(ANCHOR), F.lit(0))
    linked = F.filter(found, lambda a: F.rlike(a, F.lit(r"(?is)^<a\s(?:[^>]*?\s)?href\s*=")))
    return F.transform(
        linked,
        lambda a, i: F.struct(
            i.alias("pos"),
            squeeze_ends(decode_entities(attribute(a, "href"), in_attribute=True)).alias("href"),
            visible_text(a).alias("text"),
        ),
    )


def whatsapp_numbers(html: Column | str, region: str = rules.DEFAULT_REGION) -> Column:
    return valid_phones(_whatsapp_texts(col_of(html)), region)


def _whatsapp_texts(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(WHATSAPP), F.lit(1)), lambda d: F.concat(F.lit("+"), d))


def phones_of(html: Column, links: Column, text: Column, region: str = rules.DEFAULT_REGION) -> Column:
    """Valid numbers of a page: WhatsApp links, then ``tel:`` links, then the text."""
    dialled = F.transform(
        F.filter(links, lambda a: F.startswith(a["href"], F.lit("tel:"))), lambda a: F.substring(a["href"], 5, 1 << 30)
    )
    written = F.regexp_extract_all(text, F.lit(PHONE_LIKE), F.lit(1))
    return valid_phones(F.concat(_whatsapp_texts(html), dialled, written), region)


def decode_hidden_emails(html: Column | str) -> Column:
    """Addresses hidden as hex behind a one-byte XOR key."""

    def plain(code: Column) -> Column:
        key = F.conv(F.substring(code, 1, 2), 16, 10).cast("int")
        starts = F.sequence(F.lit(3), F.length(code) - 1, F.lit(2))
        letters = F.transform(
            starts, lambda i: F.chr(F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int").bitwiseXOR(key))
        )
        return F.array_join(letters, "")

    codes = F.regexp_extract_all(col_of(html), F.lit(HIDDEN_EMAIL), F.lit(1))
    even = F.filter(codes, lambda c: F.length(c) % 2 == 0)
    return F.array_distinct(F.filter(F.transform(even, plain), lambda e: F.contains(e, F.lit("@"))))


def useful_email(email: Column) -> Column:
    def useful(low: Column) -> Column:
        bad_end = F.exists(words(rules.PAGE_EMAIL_BAD_ENDINGS), lambda ending: F.endswith(low, ending))
        return ~contains_any(low, rules.PAGE_EMAIL_JUNK) & ~bad_end

    return let(F.lower(email), useful)


def emails_of(html: Column, links: Column, text: Column) -> Column:
    """Useful addresses of a page: ``mailto:`` links, then the text, then hidden ones."""
    mailed = F.transform(
        F.filter(links, lambda a: F.startswith(a["href"], F.lit("mailto:"))),
        lambda a: F.split_part(F.substring(a["href"], 8, 1 << 30), F.lit("?"), F.lit(1)),
    )
    written = F.regexp_extract_all(text, F.lit(EMAIL_LIKE), F.lit(0))
    every = F.transform(F.concat(mailed, written, decode_hidden_emails(html)), lambda e: F.lower(F.trim(e)))
    return F.array_distinct(F.filter(every, lambda e: (e != "") & useful_email(e)))


def facebook_handle(href: Column) -> Column:
    """True for a link that names a page, not the bare host."""
    behind = F.regexp_replace(href, r"^.*?facebook\.com/", "")
    tail = F.regexp_replace(F.split_part(behind, F.lit("?"), F.lit(1)), r"^/+|/+$", "")
    return (tail != "") & ~one_of(F.lower(tail), rules.FACEBOOK_NO_HANDLE)


def social_profiles(links: Column) -> Column:
    """First Facebook page and first LinkedIn profile among the links, as a map."""

    def on_facebook(a: Column) -> Column:
        return F.contains(F.lower(a["href"]), F.lit("facebook.com/"))

    def page(a: Column) -> Column:
        return on_facebook(a) & ~contains_any(F.lower(a["href"]), rules.FACEBOOK_WIDGETS) & facebook_handle(a["href"])

    def pairs(facebook: Column) -> Column:
        free = F.coalesce(facebook["pos"], F.lit(1 << 30))

        def profile(a: Column) -> Column:
            low = F.lower(a["href"])
            named = F.contains(low, F.lit("linkedin.com/company/")) | F.contains(low, F.lit("linkedin.com/in/"))
            return named & (~on_facebook(a) | (a["pos"] > free))

        linkedin = first_of(F.filter(links, profile))
        return F.array(
            F.struct(F.lit("facebook").alias("key"), F.split_part(facebook["href"], F.lit("?"), F.lit(1)).alias("value")),
            F.struct(F.lit("linkedin").alias("key"), F.split_part(linkedin["href"], F.lit("?"), F.lit(1)).alias("value")),
        )

    found = F.filter(let(first_of(F.filter(links, page)), pairs), lambda p: p["value"].isNotNull())
    return F.map_from_entries(found)


def first_external(links: Column, own_host: str | Column) -> Column:
    """First absolute link that leads neither to the directory itself nor to a social host."""
    own = F.lit(own_host) if isinstance(own_host, str) else own_host

    def external(a: Column) -> Column:
        low = F.lower(a["href"])
        return F.startswith(a["href"], F.lit("http")) & ~F.contains(low, own) & ~contains_any(low, rules.SOCIAL_HOSTS)

    return first_of(F.filter(links, external))["href"]


def labelled_address(text: Column, stops: list[str]) -> Column:
    """Text behind an ADDRESS label up to the next label."""
    pattern = rf"(?is)\bADDRESS\b[:\s]+(.+?)(?:\s+(?:{'|'.join(stops)})\b|$)"
    return null_if_empty(F.trim(F.regexp_extract(text, pattern, 1)))


def labelled_website(text: Column) -> Column:
    return null_if_empty(F.regexp_extract(text, r"""(?i)\bWEBSITE\b[:\s]+(https?://[^\s"<]+)""", 1))


def phone_payload(payload: Column | str) -> Column:
    """Phone texts of a nested JSON list, distinct in order; loose digits when it is no JSON."""
    p = col_of(payload)
    nested = F.flatten(F.from_json(p, "array<array<string>>"))
    flat = F.filter(F.from_json(p, "array<string>"), lambda v: ~F.startswith(v, F.lit("[")))
    listed = F.when(F.rlike(p, F.lit(r"^\s*\[\s*\[")), nested).when(F.rlike(p, F.lit(r"^\s*\[")), flat)
    loose = F.regexp_extract_all(p, F.lit(r"[\d\-+()\s]{7,}"), F.lit(0))
    texts = F.transform(F.coalesce(listed, loose), lambda v: F.trim(v))
    return F.array_distinct(F.filter(texts, lambda v: v.isNotNull() & (v != "")))
