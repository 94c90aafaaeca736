"""Landed pages: scan, freshness, and the listing layouts read from them.

Every layout cuts a page into blocks at the opening tag of its repeated element and reads
fields inside the block with expressions, all within the row. Exploding the blocks is the only
widening; nothing is shuffled until a caller asks for first-per-key.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import rules
from leadloom.functions import html as h
from leadloom.functions import text as tx
from leadloom.functions import urls as u
from leadloom.functions.text import let
from leadloom.operators.firsts import keep_first, pair_with_preceding
from leadloom.session import cut
from leadloom.sources.catalogue import register_extractor

NULL_TEXT = "string"


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


PLACE = ["file", "row"]


def located(pages: DataFrame) -> DataFrame:
    """``pages`` with the ``file`` and ``row`` each was read from. What does not come straight from files is written first."""
    try:
        pages.select("_metadata.row_index")
    except AnalysisException:
        pages = cut(pages)
    return pages.withColumns({"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")})


def fetch(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """Whole rows of ``pages`` (as files, see ``located``) by ``file`` and ``row`` in ``chosen``, which has each place once."""
    return located(pages).join(chosen.select(*PLACE), PLACE, "left_semi").drop(*PLACE)


def newest_places(pages: DataFrame, order: list[str]) -> DataFrame:
    """``url, file, row`` of the newest landing of each address, from ``located`` pages: only keys and times are shuffled."""
    newest = pages.select("url", *order, *PLACE).groupBy("url").agg(F.max_by(F.struct(*PLACE), F.struct(*order, *PLACE)).alias("at"))
    return newest.select("url", "at.*")


def fresh_pages(pages: DataFrame, as_of: Column, ttl_seconds: int = rules.PAGE_TTL_SECONDS) -> DataFrame:
    """Newest landing of each address, as long as it is younger than the time to live.

    The age filter runs before the shuffle, and the newest is chosen by address, time and place in its file (with
    equal times by the other short columns); markup is only fetched for what is chosen.
    """
    places = located(pages)
    young = places.where(F.col("fetched_at") > as_of - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    ties = [c for c in pages.columns if c not in ("url", "fetched_at", "html")]
    chosen = newest_places(young, ["fetched_at", *ties])
    return places.join(chosen.select(*PLACE), PLACE, "left_semi").select("url", *[c for c in pages.columns if c not in ("url", "fetched_at")])


# ------------------------------------------------------------------ reading inside a block
# Fixed values of HTML: elements whose closing tag may be left out, each with the elements that hold it and the tags that end it.
_ROWS = ["tr", "tbody", "thead", "tfoot", "caption", "colgroup"]
_CELLS = ["td", "th", *_ROWS]
_TEXT_BLOCKS = [
    "address", "article", "aside", "blockquote", "center", "dd", "dir", "div", "dl", "dt", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
]
HOLDERS = {
    "td": ["table"], "th": ["table"], "tr": ["table"], "tbody": ["table"], "thead": ["table"], "tfoot": ["table"],
    "li": ["ul", "ol", "menu", "dir"], "dt": ["dl"], "dd": ["dl"], "option": ["select", "datalist"], "p": ["button", "object"],
}
ENDERS = {
    "td": _CELLS, "th": _CELLS, "tr": _ROWS, "tbody": _ROWS[1:], "thead": _ROWS[1:], "tfoot": _ROWS[1:],
    "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "option": ["option", "optgroup"], "p": _TEXT_BLOCKS,
}
# A tag that may hold or end one of them.
_CUTTING = r"</?(?:" + "|".join(sorted({t for tags in [*HOLDERS.values(), *ENDERS.values()] for t in tags})) + r")[\s/>]"


def _tags(table: dict[str, list[str]], name: Column, default: Column) -> Column:
    """The tags of ``table`` under ``name``, parted by bars."""
    return F.coalesce(*[F.when(name == key, F.lit("|".join(tags))) for key, tags in table.items()], default)


def element(markup: Column) -> Column:
    """The element that ``markup`` starts with, up to its own end, which is left out.

    Where nothing of its kind stands before the first closing tag, that tag is the end: two look-ups, no cutting
    into tags. Else opening and closing tags are counted in order, so elements of the same kind inside it are part of it and what
    follows it is not. Cells, rows, items and paragraphs that are never closed end at the next of their kind
    in the same table or list, or where that table or list ends. Other elements that are never closed run to the end.
    """

    def whole(text: Column) -> Column:
        kind = F.lower(F.regexp_extract(text, r"^<(\w[\w\-]*)", 1))
        return let(kind, lambda name: F.when(name == "", text).otherwise(let(F.lower(text), lambda low: placed(text, name, low))))

    def placed(text: Column, name: Column, low: Column) -> Column:
        close = F.position(F.concat(F.lit("</"), name), low)
        again = F.position(F.concat(F.lit("<"), name), low, F.lit(2))
        at = F.struct(close.alias("close"), again.alias("again"))

        def simple(at: Column) -> Column:
            end = at["close"]
            own = F.rlike(F.substr(low, end + F.length(name) + 2, F.lit(1)), F.lit(r"[\s/>]"))
            cut_short = name.isin(list(ENDERS)) & F.rlike(F.substr(low, F.lit(2), end - 2), F.lit(_CUTTING))
            # lower case may lengthen a text; places in it are then not those of the text
            same = F.length(low) == F.length(text)
            return (end > 0) & ((at["again"] == 0) | (at["again"] > end)) & same & own & ~cut_short

        return let(at, lambda at: F.when(simple(at), F.substr(text, F.lit(1), at["close"] - 1)).otherwise(counted(text, name)))

    def counted(text: Column, name: Column) -> Column:
        kinds = F.struct(_tags(HOLDERS, name, name).alias("hold"), _tags(ENDERS, name, F.lit(None)).alias("end"))

        def cut_up(of: Column) -> Column:
            tags = F.concat_ws("|", of["hold"], of["end"])
            marked = F.regexp_replace(text, F.concat(F.lit("(?i)(</?(?:"), tags, F.lit(r")(?=[\s/>]))")), F.lit(h.GAP + "$1"))
            lists = F.struct(F.split(of["hold"], r"\|").alias("hold"), F.split(F.coalesce(of["end"], F.lit("")), r"\|").alias("end"))
            return let(lists, lambda of: let(F.split(marked, h.GAP), lambda pieces: ended(pieces, of)))

        return let(kinds, cut_up)

    def ended(pieces: Column, of: Column) -> Column:
        """Pieces before the first that ends the element; the opening tag is the second piece."""
        start = F.struct(F.lit(2).alias("i"), F.lit(0).alias("depth"), F.lit(1 << 30).alias("end"))

        def step(at: Column, piece: Column) -> Column:
            closes = F.startswith(piece, F.lit("</"))
            tag = F.lower(F.regexp_extract(piece, r"^</?(\w[\w\-]*)", 1))
            return let(F.struct(closes.alias("closes"), F.array_contains(of["hold"], tag).alias("holds")), lambda t: moved(at, t, F.array_contains(of["end"], tag)))

        def moved(at: Column, t: Column, may_end: Column) -> Column:
            stops = (at["end"] == 1 << 30) & (at["depth"] == 0) & F.when(t["holds"], t["closes"]).otherwise(may_end)
            turn = F.when(~t["holds"], 0).when(t["closes"], -1).otherwise(1)
            return F.struct((at["i"] + 1).alias("i"), (at["depth"] + turn).alias("depth"), F.when(stops, at["i"]).otherwise(at["end"]).alias("end"))

        end = F.aggregate(F.slice(pieces, 3, 1 << 30), start, step, lambda at: at["end"])
        return F.array_join(F.slice(pieces, F.lit(1), end), "")

    return let(markup, whole)


def blocks(html: Column, opening: str) -> Column:
    """The elements of a page that start with a match of ``opening``, each to its own end or the next match."""
    marked = F.regexp_replace(F.regexp_replace(html, h.HIDDEN, ""), f"(?is)({opening})", h.GAP + "$1")
    return F.transform(F.slice(F.split(marked, h.GAP), 2, 1 << 30), element)


def with_class(tag: str, name: str) -> str:
    """Pattern of an opening tag that carries a class."""
    return rf"""<{tag}\b[^>]*\bclass\s*=\s*["'](?:[^"'>]*\s)?{name}(?:\s[^"'>]*)?["'][^>]*>"""


def starting(block: Column, opening: str) -> Column:
    """Markup from the first tag that matches ``opening`` on; '' when there is none."""
    return F.regexp_extract(block, rf"(?is)({opening}.*)$", 1)


def content(markup: Column) -> Column:
    """Markup inside the element that ``markup`` starts with."""
    return F.regexp_replace(element(markup), r"^<[^>]*>", "")


def texts(*starts: Column) -> Column:
    """Visible texts of the elements that each markup starts with, null when missing or blank.

    One expression reads them all, so a layout's plan does not grow by a reader for each of its fields.
    """
    return F.transform(F.array(*starts), lambda markup: tx.null_if_empty(h.visible_text(content(markup))))


def named(name: str) -> str:
    """Pattern of the opening tag of any element that carries a class."""
    return with_class(r"(\w+)", name)


def tag_attribute(block: Column, opening: str, name: str) -> Column:
    """Attribute of the first tag that matches ``opening``, null when missing or blank."""
    return tx.null_if_empty(F.trim(h.decode_entities(h.attribute(F.regexp_extract(block, f"(?is){opening}", 0), name))))


def first_link(links: Column, test) -> Column:
    return tx.first_of(F.filter(links, test))


def _exploded(pages: DataFrame, opening: str, inside: str | None = None, links: bool = True) -> DataFrame:
    """One row per block with the position on its page, its ``links``, and ``_link``, the first link of its first element ``inside``."""
    keep = [c for c in pages.columns if c != "html"]
    rows = pages.select(*keep, F.posexplode(blocks(F.col("html"), opening)).alias("item", "block"))
    block = F.col("block")
    rows = tx.settle(rows, {"_anchors": F.transform(F.array(*[block] * links, *[content(starting(block, inside))] * bool(inside)), h.anchors)})
    read = {"links": F.get("_anchors", F.lit(0))} if links else {}
    if inside:
        read["_link"] = tx.first_of(F.get("_anchors", F.lit(int(links))))
    return rows.withColumns(read).drop("_anchors")


def _request(pages: DataFrame, name: str) -> Column:
    """Value of the request a page was fetched for, where the page carries it."""
    return F.col(name) if name in pages.columns else F.lit(None).cast(NULL_TEXT)


def _listing(rows: DataFrame, key: str, **cols: Column) -> DataFrame:
    """Listings with the given fields, each read once per block; blocks without a name drop out."""
    carried = [c for c in ("page_id", "item") if c in rows.columns]
    read = tx.settle(rows, {"source": F.lit(key), **cols})
    return read.select(*carried, "source", *cols).where(F.col("company_name").isNotNull())


# ----------------------------------------------------------------------------- the layouts
@register_extractor("egydir")
def company_cards(pages: DataFrame, base: str = "https://www.egydir.com") -> DataFrame:
    """Cards with name link, dialable or written phone, website, address and category."""
    heading = named("company-name")
    rows = _exploded(pages, with_class("div", "company-card"), heading)
    block = F.col("block")
    rows = tx.settle(
        rows,
        {
            "_texts": texts(*[starting(block, o) for o in (heading, *map(named, ("company-phone", "company-address", "company-category")))]),
            "_tel": first_link(F.col("links"), lambda a: F.startswith(a["href"], F.lit("tel:"))),
        },
    )
    link, tel = F.col("_link"), F.col("_tel")
    title, phone, address, category = (F.get("_texts", F.lit(i)) for i in range(4))
    name = F.coalesce(tx.null_if_empty(link["text"]), title)
    dialled = F.coalesce(tx.null_if_empty(F.trim(F.substring(tel["href"], 5, 1 << 30))), tx.null_if_empty(tel["text"]))
    return _listing(
        rows, "egydir",
        company_name=name,
        source_url=F.when(tx.has_value(link["href"]), u.resolve(F.lit(base), link["href"])),
        phone_raw=F.when(tel.isNotNull(), dialled).otherwise(phone),
        website=tag_attribute(block, with_class("a", "company-website"), "href"),
        address=address,
        city=_request(pages, "city"),
        category=F.coalesce(category, _request(pages, "category")),
    )


@register_extractor("forwarding_companies")
def table_rows(pages: DataFrame, base: str = "https://forwardingcompanies.com") -> DataFrame:
    """Table rows with a name attribute or link, a location and a titled description."""
    opening = with_class("tr", "company-data")
    rows = _exploded(pages, opening, named("company-name"), links=False)
    block = F.col("block")
    rows = tx.settle(rows, {"_texts": texts(*[starting(block, named(c)) for c in ("address-wrap", "about-title", "about-description")])})
    link = F.col("_link")
    location, title, about = (F.get("_texts", F.lit(i)) for i in range(3))
    city, country = u.location_place(location)
    return _listing(
        rows, "forwarding_companies",
        company_name=F.coalesce(tag_attribute(block, opening, "data-name"), tx.null_if_empty(link["text"])),
        source_url=F.when(tx.has_value(link["href"]), u.resolve(F.lit(base), link["href"])),
        city=city, country=country, address=location,
        category=_request(pages, "category"),
        description=tx.null_if_empty(F.concat_ws(" ", title, about)),
    )


def company_links(pages: DataFrame, base: str = "https://www.freightclub.net") -> DataFrame:
    """Links of a page as company, phone or other, in document order."""
    rows = pages.select(
        *[c for c in pages.columns if c != "html"], F.explode(h.anchors("html")).alias("a")
    )
    href, text = F.col("a.href"), F.col("a.text")
    slug = F.regexp_extract(href, r"/companies/([^/?#]+)/?$", 1)
    is_slug = (slug != "") & (slug != "feed")
    return rows.select(
        *[c for c in rows.columns if c != "a"],
        F.col("a.pos").alias("pos"),
        (is_slug & (F.length(text) > 1)).alias("is_company"),
        (~is_slug & F.startswith(href, F.lit("tel:"))).alias("is_phone"),
        text.alias("name"),
        u.resolve(F.lit(base), href).alias("url"),
        F.trim(F.substring(href, 5, 1 << 30)).alias("phone"),
    )


@register_extractor("freightclub")
def link_then_phone(pages: DataFrame) -> DataFrame:
    """Company links followed by a phone link; pages are named by ``page_id``. Category and country are the request's."""
    asked = [c for c in ("category", "country") if c in pages.columns]
    paired = pair_with_preceding(company_links(pages), carried=asked)
    return paired.select(
        "page_id", F.col("pos").alias("item"), F.lit("freightclub").alias("source"), "company_name", "source_url", "phone_raw", *asked
    )


@register_extractor("wsdconnect")
def onclick_cards(pages: DataFrame, own_host: str = "wsdconnect.com") -> DataFrame:
    """Cards whose address stands in ``onclick``; first mail, first outside link, first list item."""
    opening = with_class("div", "listing-card")
    rows = _exploded(pages, opening)
    block, links = F.col("block"), F.col("links")
    mail = first_link(links, lambda a: F.startswith(a["href"], F.lit("mailto:")))
    meta = F.regexp_extract(block, rf"(?is){with_class(r'(?:div|ul|p)', 'listing-meta')}(.*)$", 1)
    rows = tx.settle(rows, {"_texts": texts(starting(meta, named("listing-item")), *[starting(block, named(c)) for c in ("listing-company-name", "listing-category-tag")])})
    item, name, category = (F.get("_texts", F.lit(i)) for i in range(3))
    item = F.regexp_replace(item, r"(?i)\s*\+\d+\s*more\s*$", "")
    rows = tx.settle(rows, {"_place": tx.null_if_empty(F.trim(item))})
    place = F.col("_place")
    city, country = u.location_place(place)
    target = F.regexp_extract(F.regexp_extract(block, f"(?is)^{opening}", 0), r"window\.location\s*=\s*'([^']+)'", 1)
    return _listing(
        rows, "wsdconnect",
        company_name=name,
        source_url=tx.null_if_empty(target),
        email=tx.null_if_empty(F.trim(F.split_part(F.substring(mail["href"], 8, 1 << 30), F.lit("?"), F.lit(1)))),
        website=h.first_external(links, own_host),
        city=city, country=country, address=place,
        category=F.coalesce(category, _request(pages, "category")),
    )


def _first_per_link(rows: DataFrame) -> DataFrame:
    """First row of each link on a page, rows without name or link left out."""
    named = rows.where(tx.has_value("company_name") & tx.has_value("href"))
    firsts = keep_first(named, ["page_id", "href"], "item") if "page_id" in rows.columns else keep_first(named, ["href"], "item")
    return firsts.drop("href")


@register_extractor("textile_council")
def member_grid(pages: DataFrame, base: str = "https://textile-egypt.org/textile-egypt.org") -> DataFrame:
    """Grid of members: picture text is the name, the member link leads to the contacts."""
    rows = _exploded(pages, with_class(r"(?:div|li|article)", "grid-item"))
    rows = tx.settle(rows, {"_link": first_link(F.col("links"), lambda a: F.contains(a["href"], F.lit("members/")))})
    link = F.col("_link")
    out = _listing(
        rows, "textile_council",
        company_name=tag_attribute(F.col("block"), r"<img\b[^>]*\salt\s*=[^>]*>", "alt"),
        href=link["href"],
        source_url=u.resolve(F.lit(base.rstrip("/") + "/"), link["href"]),
        category=F.lit("Textiles"), country=F.lit("Egypt"),
    )
    return _first_per_link(out)


@register_extractor("aece")
def directory_table(pages: DataFrame, base: str = "https://aecegy.com", hint: str = "business-directory/") -> DataFrame:
    """Table whose first cell is the name and whose link contains a hint."""
    rows = _exploded(pages, r"<tr\b[^>]*>")
    rows = tx.settle(rows, {"_link": first_link(F.col("links"), lambda a: F.contains(a["href"], F.lit(hint)))})
    link = F.col("_link")
    out = _listing(
        rows, "aece",
        company_name=F.get(texts(starting(F.col("block"), r"<td\b[^>]*>")), F.lit(0)),
        href=link["href"],
        source_url=u.resolve(F.lit(base.rstrip("/") + "/"), link["href"]),
        category=F.lit("Garments"), country=F.lit("Egypt"),
    )
    return _first_per_link(out)


@register_extractor("yellowpages_eg")
def result_rows(pages: DataFrame, base: str = "https://www.yellowpages.com.eg") -> DataFrame:
    """Result rows with a company id in the profile link and an address to split."""
    rows = _exploded(pages, with_class(r"\w[\w\-]*", "item-row"), named("category"), links=False)
    block = F.col("block")
    title = with_class("a", "item-title")
    rows = tx.settle(rows, {"_href": tag_attribute(block, title, "href"), "_texts": texts(starting(block, named("address-text")), starting(block, title))})
    href, address, name = F.col("_href"), F.get("_texts", F.lit(0)), F.get("_texts", F.lit(1))
    city, governorate = u.address_place(address)
    category = F.col("_link")["text"]
    return _listing(
        rows, "yellowpages_eg",
        company_name=name,
        source_url=u.listing_url(href, base),
        address=address, city=city, governorate=governorate, country=F.lit("Egypt"),
        category=F.coalesce(tx.null_if_empty(category), _request(pages, "category")),
        company_id=tx.null_if_empty(F.regexp_extract(F.coalesce(href, F.lit("")), r"/profile/[^/]+/(\d+)", 1)),
    )


# ------------------------------------------------------------------------- detail pages
# Labels that end an address.
TEXTILE_STOPS = ["OFFICE", "FACTORY", "HEAD", "SHOWROOM", "WEBSITE", "E-?MAILS?", "PHONES?", "MOBILE", "FAX", "TEL", "CONTACT", "GENERAL"]
APPAREL_STOPS = ["TEL", "PHONE", "MOBILE", "FAX", "E-?MAILS?", "WEBSITE", "FACTORY", "OFFICE", "CONTACT"]


def member_details(pages: DataFrame, own_domain: str, labelled_site: bool, stops: list[str]) -> DataFrame:
    """Phones, e-mails, website and address of member pages; the directory's own mail is left out."""
    read = tx.settle(pages, {"text": h.visible_text("html"), "links": h.anchors("html")})
    site = h.labelled_website(F.col("text")) if labelled_site else h.first_external(F.col("links"), own_domain)
    mails = h.emails_of(F.col("html"), F.col("links"), F.col("text"))
    return read.select(
        "url",
        h.phones_of(F.col("html"), F.col("links"), F.col("text")).alias("detail_phones"),
        F.filter(mails, lambda e: ~F.contains(e, F.lit(own_domain))).alias("detail_emails"),
        site.alias("detail_website"),
        h.labelled_address(F.col("text"), stops).alias("detail_address"),
    )


def join_details(listing: DataFrame, details: DataFrame) -> DataFrame:
    """Fill listings from their detail pages; a listing without a detail page stays as it is.

    The website is taken as found, phones, e-mail and address only where the page has some.
    """
    known = set(listing.columns)

    def old(name: str, kind: str = NULL_TEXT) -> Column:
        return F.col(name) if name in known else F.lit(None).cast(kind)

    salt = [c for c in ("page_id", "item", "company_name") if c in known]
    joined = listing.join(details, tx.spread_key("source_url", *salt) == details["url"], "left")
    called = F.size("detail_phones") > 0
    return joined.withColumns(
        {
            "phone_raw": F.when(called, tx.first_of(F.col("detail_phones"))).otherwise(old("phone_raw")),
            "extra_phones": F.when(called, F.slice("detail_phones", 2, 1 << 30)).otherwise(old("extra_phones", "array<string>")),
            "email": F.coalesce(tx.first_of(F.col("detail_emails")), old("email")),
            "website": F.coalesce(F.col("detail_website"), old("website")),
            "address": F.coalesce(F.col("detail_address"), old("address")),
        }
    ).drop("url", "detail_phones", "detail_emails", "detail_website", "detail_address")
