"""Queries over landed pages: text, links, contacts, listing layouts, detail pages.

``pages`` and ``documents`` are read as they are. Listing and member pages are derived from
``customer``: twenty companies per listing page, written in the markup of each layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import rules
from leadloom.functions import html as h
from leadloom.functions import intel, urls
from leadloom.functions import text as tx
from leadloom.operators.firsts import pair_with_preceding
from leadloom.queries import sqltext as s
from leadloom.queries.base import spread, table
from leadloom.sources import pages as pg
from leadloom.sources.catalogue import extract_all

PER_PAGE = 20


# ---------------------------------------------------------------- pages as they are
def visible_text(spark, d):
    text = tx.settle(table(spark, d, "pages").select("page_id", "html"), {"text": h.visible_text("html")})
    return text.select("page_id", F.md5("text").alias("text_hash"), F.length("text").alias("text_length"))


def page_anchors(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(h.anchors("html")).alias("a"))
    return links.select("page_id", F.col("a.pos").alias("pos"), F.col("a.href").alias("href"), F.col("a.text").alias("text"))


LINK_FORMS = ["sub/x", "?q=1", "#top", "//cdn.example/x", "http://other.example/y", "./z"]


def resolved_links(spark, d):
    """Absolute address and same-host test of every link, plus one link of each written form."""
    forms = tx.words(LINK_FORMS)
    extra = F.get(forms, F.pmod(F.col("page_id"), F.lit(len(LINK_FORMS))).cast("int"))
    hrefs = F.concat(F.transform(h.anchors("html"), lambda a: a["href"]), F.array(extra))
    links = table(spark, d, "pages").select("page_id", "url", F.explode(hrefs).alias("href"))
    full = urls.resolve("url", "href")
    return links.select("page_id", "href", full.alias("full"), (urls.host_of(full) == urls.host_of("url")).alias("same_host"))


NAV = (
    '<a href="/about">About us</a><a href="/contact-us">Write to us</a><a href="/contact-us/">again</a>'
    '<a href="https://other.invalid/contact">elsewhere</a><a href="/list?p=1">Our Products</a><a href="tel:123">call</a>'
)


def site_subpages(spark, d):
    """Pages worth reading behind each page, contact pages first, at most three."""
    pages = table(spark, d, "pages").select("page_id", "url", F.concat("html", F.lit(NAV)).alias("html"))
    pages = tx.settle(pages, {"links": h.anchors("html")})
    return pages.select("page_id", F.posexplode(urls.subpages(F.col("links"), "url", 3)).alias("rank", "subpage"))


def fresh_pages(spark, d):
    """Newest landing per address within a day before a fixed time."""
    landed = table(spark, d, "pages").select(
        F.regexp_replace("url", r"[?#].*$", "").alias("url"), "html", "page_id",
        F.timestamp_add("MINUTE", F.col("page_id") * 7, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("fetched_at"),
    )
    limit = F.lit("2024-01-02 06:00:00").cast("timestamp")
    return pg.fresh_pages(landed, limit).select("url", "page_id", F.md5("html").alias("html_hash"))


def document_phones(spark, d):
    found = F.regexp_extract_all("text", F.lit(h.PHONE_LIKE), F.lit(1))
    rows = table(spark, d, "documents").select("doc_id", F.size(found).alias("candidates"), F.array_join(h.valid_phones(found), ",").alias("phones"))
    return rows


def document_emails(spark, d):
    none = F.array().cast("array<struct<pos:int,href:string,text:string>>")
    return table(spark, d, "documents").select("doc_id", F.array_join(h.emails_of(F.col("text"), none, F.col("text")), ",").alias("emails"))


# ---------------------------------------------------------------- company pages from customer
def companies(spark: SparkSession, d: str, *by: str) -> DataFrame:
    """Keys of all companies with the listing page each stands on, spread by ``by``: only keys are shuffled, before any markup is written."""
    keys = table(spark, d, "customer").selectExpr("c_custkey AS k", f"c_custkey div {PER_PAGE} AS page_id")
    return spread(keys, *by).selectExpr("k", "lpad(string(k), 8, '0') AS k8", "lpad(string(k), 7, '0') AS k7", "page_id")


def contact_pages(spark, d) -> DataFrame:
    """One contact page per company with every kind of contact and some noise."""
    rows = companies(spark, d).withColumn("hidden", F.expr("concat('Boss', k, '@site', k, '.biz')"))
    code = F.expr(
        "concat('2a', array_join(transform(sequence(1, length(hidden)), i -> lower(lpad(hex(ascii(substr(hidden, i, 1)) ^ 42), 2, '0'))), ''))"
    )
    return rows.withColumn("code", code).selectExpr(
        "k", "concat('https://site', k, '.example/contact') AS url",
        "concat('<html><head><style>a{x:1}</style><script>var p=\"+201099999999\";</script></head><body><!-- <a href=\"tel:+201088888888\">x</a> -->', "
        "'<p>Tax ID 12345 &mdash; since 2009</p>', "
        "IF(k % 2 = 0, concat('<a href=\"tel:+2010', k8, '\">Call</a>'), ''), "
        "IF(k % 3 = 0, concat('<a class=w href=''https://wa.me/2011', k8, '''>WhatsApp</a>'), ''), "
        "'<p>Office: (02) 2', k7, ' or 1234567890123</p>', "
        "'<a href=\"mailto:Info@Site', k, '.net?subject=hi\">mail</a><a href=\"mailto:noreply@site', k, '.net\">no</a>', "
        "'<p>sales@site', k, '.org, logo@2x.png &amp; test@example.com</p><span data-cfemail=\"', code, '\">[hidden]</span>', "
        "'<a href=\"https://facebook.com/sharer/sharer.php?u=linkedin.com/in/no\">share</a><a href=\"https://facebook.com/\">bare</a>', "
        "IF(k % 5 <> 0, concat('<a href=\"https://www.Facebook.com/Page', k, '?ref=1\">f</a>'), ''), "
        "IF(k % 7 = 0, concat('<a href=\"https://linkedin.com/company/c', k, '/?x=1\">l</a>'), ''), "
        "'<a href=\"https://partner', k, '.example/x\">partner</a></body></html>') AS html",
    )


def page_contacts(spark, d):
    """Phones by trust, WhatsApp numbers, e-mails and social profiles of each contact page."""
    pages = tx.settle(contact_pages(spark, d), {"text": h.visible_text("html"), "links": h.anchors("html")})
    html, links, text = F.col("html"), F.col("links"), F.col("text")
    out = tx.settle(
        pages,
        {
            "phones": h.phones_of(html, links, text), "wa": h.whatsapp_numbers("html"),
            "emails": h.emails_of(html, links, text), "socials": h.social_profiles(links),
        },
    )
    return out.select(
        "k", F.array_join("phones", ",").alias("phones"), tx.first_of(F.col("phones")).alias("best_phone"),
        F.array_join("wa", ",").alias("whatsapp"), F.array_join("emails", ",").alias("emails"),
        F.try_element_at("socials", F.lit("facebook")).alias("facebook"),
        F.try_element_at("socials", F.lit("linkedin")).alias("linkedin"),
    )


PAGE_CONTACTS_SQL = """
WITH c AS (SELECT c_custkey AS k, lpad(c_custkey::VARCHAR, 8, '0') AS k8, lpad(c_custkey::VARCHAR, 7, '0') AS k7 FROM customer),
p AS (SELECT k, list_filter([CASE WHEN k % 3 = 0 THEN '+2011' || k8 END, CASE WHEN k % 2 = 0 THEN '+2010' || k8 END, '+202' || '2' || k7], lambda v: v IS NOT NULL) AS phones FROM c)
SELECT k, array_to_string(phones, ',') AS phones, phones[1] AS best_phone, CASE WHEN k % 3 = 0 THEN '+2011' || k8 ELSE '' END AS whatsapp,
  'info@site' || k || '.net,sales@site' || k || '.org,boss' || k || '@site' || k || '.biz' AS emails,
  CASE WHEN k % 5 <> 0 THEN 'https://www.Facebook.com/Page' || k END AS facebook,
  CASE WHEN k % 7 = 0 THEN 'https://linkedin.com/company/c' || k || '/' END AS linkedin
FROM c JOIN p USING (k)"""


def hidden_emails(spark, d):
    return contact_pages(spark, d).select("k", F.array_join(h.decode_hidden_emails("html"), ",").alias("emails"))


def external_links(spark, d):
    pages = tx.settle(contact_pages(spark, d), {"links": h.anchors("html")})
    own = F.concat(F.lit("site"), F.col("k").cast("string"), F.lit(".example"))
    return pages.select(
        "k", h.first_external(F.col("links"), own).alias("website"), h.first_external(F.col("links"), "partner1").alias("not_partner1")
    )


def phone_payloads(spark, d):
    """Phone texts of JSON answers, of broken answers and of plain texts."""
    rows = companies(spark, d).selectExpr(
        "k",
        "CASE k % 4 WHEN 0 THEN concat('[[\"010', k8, '\", \" 02 2', k7, ' \"], [\"010', k8, '\", \"\"], []]') "
        "WHEN 1 THEN concat('[\"011', k8, '\", \"011', k8, '\"]') WHEN 2 THEN concat('call 010', k8, ' now') ELSE 'closed' END AS payload",
    )
    return rows.select("k", F.array_join(h.phone_payload("payload"), "|").alias("phones"))


def decision_makers(spark, d):
    """Strongest role with name and personal address in company texts."""
    rows = companies(spark, d).selectExpr(
        "k",
        "CASE k % 6 WHEN 0 THEN concat('Ahmed Hassan - Export Manager. Call us ', k) WHEN 1 THEN 'Our Logistics Manager: Mona Ali' "
        "WHEN 2 THEN 'CEO | Sara Nabil and the Supply Chain Manager' WHEN 3 THEN 'للتواصل مع مدير التصدير' "
        "WHEN 4 THEN concat('Products of company ', k) ELSE 'the owner' END AS text",
        "IF(k % 3 = 0, array('info@x.com', concat('p', k, '@x.com')), array('Sales@x.com', 'office@x.com')) AS emails",
    )
    rows = tx.settle(rows, {"c": intel.decision_maker(F.col("text"), F.col("emails"), intel.phrases(F.lower("text")))})
    return rows.select("k", F.col("c.name").alias("name"), F.col("c.role").alias("role"), F.col("c.email").alias("email"))


DECISION_SQL = """SELECT c_custkey AS k,
  CASE c_custkey % 6 WHEN 0 THEN 'Ahmed Hassan' WHEN 1 THEN 'Mona Ali' END AS name,
  CASE c_custkey % 6 WHEN 0 THEN 'Export Manager' WHEN 1 THEN 'Logistics Manager' WHEN 2 THEN 'Logistics Manager' WHEN 3 THEN 'Export Manager' WHEN 5 THEN 'Owner / CEO' END AS role,
  CASE WHEN c_custkey % 6 <> 4 AND c_custkey % 3 = 0 THEN 'p' || c_custkey || '@x.com' END AS email FROM customer"""


# ---------------------------------------------------------------- listing layouts
# After the last block: nothing here belongs to a listing.
FOOTER = '<footer><a href="mailto:desk@directory.example">write</a><a href="https://ads.example/offer">ad</a></footer>'


def listing_pages(spark, d, source: str, block: str, before: str = "", after: str = "") -> DataFrame:
    """Pages of twenty companies in a layout; ``block`` is SQL text over k, k8, k7. The companies of a page are together before it is written."""
    rows = companies(spark, d, "page_id").selectExpr("page_id", "k", f"{block} AS block")
    grouped = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("k", "block"))).alias("b"))
    body = F.array_join(F.transform("b", lambda x: x["block"]), "\n")
    return grouped.select(
        "page_id", F.lit(source).alias("source"),
        F.concat(F.lit("<html><body><h1>Directory</h1>" + before), body, F.lit(after + FOOTER + "</body></html>")).alias("html"),
        F.lit("Cairo").alias("city"), F.lit("Furniture").alias("category"),
    )


CARD = (
    "concat('<div class=\"company-card big\"><h3 class=\"company-name\"><h3></h3><a href=\"/c/', k, '\"> Firm ', k, ' &amp; Co</a></h3>', "
    "CASE k % 3 WHEN 0 THEN concat('<a href=\"tel:010', k8, '\">ring</a>') WHEN 1 THEN concat('<span class=\"company-phone\">02 2', k7, '</span>') ELSE '' END, "
    "IF(k % 2 = 0, concat('<a class=\"company-website\" href=\"http://firm', k, '.example\">site</a>'), ''), "
    "'<p class=\"company-address\">Street ', k, '</p>', IF(k % 5 = 0, '<span class=\"company-category\">Textiles</span>', ''), '</div>')"
)
ROW = (
    "concat('<tr class=\"company-data\"', IF(k % 2 = 0, concat(' data-name=\"Firm ', k, '\"'), ''), '><td class=\"company-name\"><a href=\"/company/f', k, '\">Firm ', k, '</a></td>"
    "<td class=\"address-wrap\">', IF(k % 3 = 0, 'Egypt', concat('City', k % 9, ', Region, Egypt')), '</td><td><b class=\"about-title\">About</b>', "
    "IF(k % 4 <> 0, concat('<p class=\"about-description\">We move <i>goods</i> no ', k, '</p>'), ''), '</td></tr>')"
)
LINKS = (
    "concat('<div><a href=\"/companies/firm-', k, '/\">Firm ', k, '</a>', IF(k % 4 = 1, concat('<a href=\"/companies/other-', k, '\">Other ', k, '</a>'), ''), "
    "IF(k % 5 = 0, '<a href=\"/companies/feed\">feed</a>', ''), '<a href=\"/companies/x-', k, '/\">x</a>', "
    "IF(k % 3 <> 2, concat('<a href=\"tel: 010', k8, '\">p</a>'), ''), IF(k % 6 = 0, concat('<a href=\"tel:011', k8, '\">q</a>'), ''), '</div>')"
)
ONCLICK = (
    "concat('<div class=\"listing-card\" onclick=\"window.location=''https://wsd.example/l/', k, '''\"><div class=\"listing-company-name\"><div>Firm</div> ', k, '</div>"
    "<span class=\"listing-category-tag\">Freight</span><div class=\"listing-meta\"><div class=\"listing-item\">', "
    "CASE k % 3 WHEN 0 THEN concat('Port ', k, ', Zone, Egypt +3 more') WHEN 1 THEN 'Jordan' ELSE 'City, Sudan' END, '</div><div class=\"listing-item\">Air, Sea</div></div>"
    "<a href=\"mailto:ops', k, '@firm.example?x=1\">m</a><a href=\"https://wsdconnect.com/l/', k, '\">own</a><a href=\"https://www.facebook.com/f\">f</a>"
    "<a href=\"https://firm', k, '.example/home\">w</a></div>')"
)
GRID = (
    "concat('<div class=\"grid-item\"><a href=\"members/m', IF(k % 10 = 9, k - 1, k), '.html\"><img src=\"l.png\" alt=\"Firm ', k, ' &amp; Sons\"></a></div>')"
)
DIRECTORY = (
    "concat(IF(k % 20 = 0, '<tr><th>Name</th></tr>', ''), '<tr><td><b>Firm</b> ', k, '</td><td>', IF(k % 4 <> 3, concat('<a href=\"/business-directory/f', k, '/\">more</a>'), ''), '</td></tr>')"
)
RESULT = (
    "concat('<yp-row class=\"item-row x\"><a class=\"item-title\" href=\"//www.yp.example/en/profile/firm-', k, '/', k * 7, '?pos=1\">Firm ', k, '</a>"
    "<span class=\"address-text\">', CASE k % 3 WHEN 0 THEN concat('Street ', k, ', City', k % 9, ', Cairo .') WHEN 1 THEN 'Giza' ELSE concat(k, ' Road, Giza.') END, '</span>"
    "<div class=\"category\"><a href=\"/c\">', IF(k % 2 = 0, 'Plastics', ''), '</a></div></yp-row>')"
)
BASE_COLS = ["page_id", "item", "company_name"]


def company_cards(spark, d):
    rows = pg.company_cards(listing_pages(spark, d, "egydir", CARD))
    return rows.select(*BASE_COLS, "source_url", "phone_raw", "website", "address", "city", "category")


def table_rows(spark, d):
    rows = pg.table_rows(listing_pages(spark, d, "forwarding_companies", ROW, "<table>", "</table>"))
    return rows.select(*BASE_COLS, "source_url", "city", "country", "address", "description")


def link_then_phone(spark, d):
    rows = pg.link_then_phone(listing_pages(spark, d, "freightclub", LINKS))
    return rows.select("page_id", "company_name", "source_url", "phone_raw")


def nearest_preceding_link(spark, d):
    """Same pairing on a table of links: each order is a page, its line items are the links."""
    li = table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS page_id", "((l_linenumber * 10000 + l_suppkey) * 1000000 + l_partkey) * 100 + bigint(l_quantity) AS pos", "l_returnflag <> 'A' AND l_linestatus = 'O' AS is_company",
        "l_returnflag = 'A' AS is_phone", "concat('Part ', l_partkey) AS name", "concat('/p/', l_partkey) AS url", "concat('010', l_suppkey) AS phone",
    )
    return pair_with_preceding(li).select("page_id", "company_name", "source_url", "phone_raw")


def onclick_cards(spark, d):
    rows = pg.onclick_cards(listing_pages(spark, d, "wsdconnect", ONCLICK))
    return rows.select(*BASE_COLS, "source_url", "email", "website", "city", "country", "address", "category")


def member_grid(spark, d):
    rows = pg.member_grid(listing_pages(spark, d, "textile_council", GRID, '<div class="members">', "</div>"))
    return rows.select(*BASE_COLS, "source_url", "category", "country")


def directory_table(spark, d):
    rows = pg.directory_table(listing_pages(spark, d, "aece", DIRECTORY, "<table>", "</table>"))
    return rows.select("page_id", "company_name", "source_url", "category", "country")


def result_rows(spark, d):
    rows = pg.result_rows(listing_pages(spark, d, "yellowpages_eg", RESULT))
    return rows.select(*BASE_COLS, "source_url", "address", "city", "governorate", "category", "company_id")


def all_layouts(spark, d):
    """Listings of every registered layout in one table, counted per source."""
    pages = None
    for source, block in (("egydir", CARD), ("forwarding_companies", ROW), ("freightclub", LINKS), ("wsdconnect", ONCLICK),
                          ("textile_council", GRID), ("aece", DIRECTORY), ("yellowpages_eg", RESULT)):
        part = listing_pages(spark, d, source, block)
        pages = part if pages is None else pages.unionByName(part)
    return extract_all(pages).groupBy("source").agg(F.count(F.lit(1)).alias("listings"), F.count("phone_raw").alias("with_phone"))


# ---------------------------------------------------------------- member details
def member_pages(spark, d) -> DataFrame:
    return companies(spark, d).where("k % 6 <> 5").selectExpr(
        "concat('https://textile-egypt.org/textile-egypt.org/members/m', k, '.html') AS url",
        "concat('<html><body><table><tr><td>ADDRESS:</td><td>', k, ' Mill St., Zone ', k % 9, '</td></tr><tr><td>TEL</td><td>+20 10 ', k8, ' / 02 2', k7, '</td></tr>"
        "<tr><td>E-MAIL</td><td>info@textile-egypt.org ', IF(k % 2 = 0, concat('mill', k, '@mill.net'), ''), '</td></tr>', "
        "IF(k % 3 = 0, concat('<tr><td>WEBSITE:</td><td>http://mill', k, '.example/a</td></tr>'), ''), '</table><a href=\"https://facebook.com/x\">f</a>"
        "<a href=\"https://textile-egypt.org/home\">home</a><a href=\"http://ads', k, '.example\">ad</a></body></html>') AS html",
    )


def member_details(spark, d):
    """Labelled contacts of member pages, read with both variants of the website rule."""
    a = pg.member_details(member_pages(spark, d), "textile-egypt.org", True, pg.TEXTILE_STOPS)
    b = pg.member_details(member_pages(spark, d), "textile-egypt.org", False, pg.APPAREL_STOPS)
    cols = ["url", F.array_join("detail_phones", ",").alias("phones"), F.array_join("detail_emails", ",").alias("emails"),
            F.col("detail_website").alias("website"), F.col("detail_address").alias("address")]
    return a.select(F.lit("labelled").alias("rule"), *cols).unionByName(b.select(F.lit("linked").alias("rule"), *cols))


def listings_with_details(spark, d):
    """Grid listings filled from their member pages; those without a page stay."""
    grid = pg.member_grid(listing_pages(spark, d, "textile_council", GRID))
    details = pg.member_details(member_pages(spark, d), "textile-egypt.org", True, pg.TEXTILE_STOPS)
    rows = pg.join_details(grid, details)
    return rows.select("company_name", "phone_raw", F.array_join("extra_phones", ",").alias("extras"), "email", "website", "address")


# ---------------------------------------------------------------- SQL
K = "(SELECT c_custkey AS k, lpad(c_custkey::VARCHAR, 8, '0') AS k8, lpad(c_custkey::VARCHAR, 7, '0') AS k7, c_custkey // 20 AS page_id, (c_custkey % 20)::INT AS item FROM customer)"
HIDDEN_SQL = (
    "regexp_replace(html, '(?is)<!--.*?(?:-->|$)|<script\\b[^>]*>.*?(?:</script\\s*>|$)|<style\\b[^>]*>.*?(?:</style\\s*>|$)', '', 'g')"
)
ANCHORS_SQL = f"""l AS (SELECT page_id, url, regexp_extract_all({HIDDEN_SQL}, '(?is)<a\\s[^>]*>.*?</a\\s*>') AS found FROM src),
x AS (SELECT page_id, url, i - 1 AS pos, found[i] AS a FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM l)),
a AS (SELECT page_id, url, CAST(pos AS INT) AS pos, replace(regexp_extract(a, '(?is)href\\s*=\\s*"([^">]*)"', 1), '&amp;', '&') AS href, {s.visible_text('a')} AS text FROM x)"""


def _subpages_sql() -> str:
    hay = "lower(path) || ' ' || lower(text)"
    contact = s.any_of(f"({hay})", rules.CONTACT_PAGE_HINTS)
    any_hint = s.any_of(f"({hay})", rules.CONTACT_PAGE_HINTS + rules.OTHER_PAGE_HINTS)
    return f"""WITH src AS (SELECT page_id, url, html || {s.q(NAV)} AS html FROM pages), {ANCHORS_SQL},
    r AS (SELECT page_id, pos, text, regexp_extract(url, '^[a-z]+://[^/?#]*') || href AS "full", url, split_part(href, '?', 1) AS path FROM a WHERE href LIKE '/%'),
    g AS (SELECT *, {contact} AS contact, regexp_replace(path, '/+$', '') AS key FROM r WHERE {any_hint} AND "full" <> url),
    f AS (SELECT * FROM g WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY page_id, key ORDER BY pos) = 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY contact DESC, pos) AS nth FROM f)
    SELECT page_id, CAST(nth - 1 AS INT) AS rank, "full" AS subpage FROM n WHERE nth <= 3"""


FORM_CASE = "CASE page_id % 6 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(LINK_FORMS)) + " END"
QUERIES = {
    "visible_text": (visible_text, f"SELECT page_id, md5(text) AS text_hash, length(text) AS text_length FROM (SELECT page_id, {s.visible_text('html')} AS text FROM pages)"),
    "page_anchors": (page_anchors, f"WITH src AS (SELECT * FROM pages), {ANCHORS_SQL} SELECT page_id, pos, href, text FROM a"),
    "resolved_links": (resolved_links, f"""WITH src AS (SELECT * FROM pages), {ANCHORS_SQL},
        every AS (SELECT page_id, url, href FROM a UNION ALL SELECT page_id, url, {FORM_CASE} FROM pages),
        p AS (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^(.*/)', 1) AS folder FROM every),
        f AS (SELECT page_id, url, href, CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^[a-z]+:') || href
          WHEN href LIKE '/%' THEN root || href WHEN href LIKE '?%' THEN regexp_extract(url, '^[^?#]*') || href WHEN href LIKE '#%' THEN regexp_extract(url, '^[^#]*') || href
          ELSE root || CASE WHEN folder = '' THEN '/' ELSE folder END || regexp_replace(href, '^\\./', '') END AS "full" FROM p)
        SELECT page_id, href, "full", lower(regexp_extract("full", '//([^/?#]*)', 1)) = lower(regexp_extract(url, '//([^/?#]*)', 1)) AS same_host FROM f"""),
    "site_subpages": (site_subpages, _subpages_sql()),
    "fresh_pages": (fresh_pages, """WITH l AS (SELECT regexp_replace(url, '[?#].*$', '') AS url, html, page_id, TIMESTAMP '2024-01-01' + to_minutes(CAST(page_id * 7 AS INT)) AS landed FROM pages)
        SELECT url, page_id, md5(html) AS html_hash FROM l WHERE landed > TIMESTAMP '2024-01-01 06:00:00' QUALIFY row_number() OVER (PARTITION BY url ORDER BY landed DESC) = 1"""),
    "document_phones": (document_phones, f"SELECT doc_id, len(found) AS candidates, array_to_string({s.valid_phones('found')}, ',') AS phones FROM (SELECT doc_id, regexp_extract_all(text, '(\\+?\\d[\\d\\s\\-()]{{7,}}\\d)') AS found FROM documents)"),
    "document_emails": (document_emails, f"""SELECT doc_id, array_to_string({s.distinct("list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}'), lambda e: lower(e)), lambda e: NOT " + s.any_of('e', rules.PAGE_EMAIL_JUNK) + " AND NOT regexp_matches(e, '\\.(png|jpg|jpeg|gif|webp|svg|css|js)$'))")}, ',') AS emails FROM documents"""),
    "page_contacts": (page_contacts, PAGE_CONTACTS_SQL),
    "hidden_emails": (hidden_emails, f"SELECT k, 'Boss' || k || '@site' || k || '.biz' AS emails FROM {K}"),
    "external_links": (external_links, f"SELECT k, CASE WHEN k % 3 = 0 THEN 'https://wa.me/2011' || k8 ELSE 'https://partner' || k || '.example/x' END AS website, CASE WHEN k % 3 = 0 THEN 'https://wa.me/2011' || k8 WHEN k::VARCHAR NOT LIKE '1%' THEN 'https://partner' || k || '.example/x' END AS not_partner1 FROM {K}"),
    "phone_payloads": (phone_payloads, f"SELECT k, CASE k % 4 WHEN 0 THEN '010' || k8 || '|02 2' || k7 WHEN 1 THEN '011' || k8 WHEN 2 THEN '010' || k8 ELSE '' END AS phones FROM {K}"),
    "decision_makers": (decision_makers, DECISION_SQL),
    "company_cards": (company_cards, f"""SELECT page_id, item, 'Firm ' || k || ' & Co' AS company_name, 'https://www.egydir.com/c/' || k AS source_url,
        CASE k % 3 WHEN 0 THEN '010' || k8 WHEN 1 THEN '02 2' || k7 END AS phone_raw, CASE WHEN k % 2 = 0 THEN 'http://firm' || k || '.example' END AS website,
        'Street ' || k AS address, 'Cairo' AS city, CASE WHEN k % 5 = 0 THEN 'Textiles' ELSE 'Furniture' END AS category FROM {K}"""),
    "table_rows": (table_rows, f"""SELECT page_id, item, 'Firm ' || k AS company_name, 'https://forwardingcompanies.com/company/f' || k AS source_url,
        CASE WHEN k % 3 <> 0 THEN 'City' || (k % 9) END AS city, 'Egypt' AS country, CASE WHEN k % 3 = 0 THEN 'Egypt' ELSE 'City' || (k % 9) || ', Region, Egypt' END AS address,
        CASE WHEN k % 4 = 0 THEN 'About' ELSE 'About We move goods no ' || k END AS description FROM {K}"""),
    "link_then_phone": (link_then_phone, f"""WITH a AS (SELECT page_id, k * 10 AS pos, 'Firm ' || k AS nm, 'https://www.freightclub.net/companies/firm-' || k || '/' AS url, NULL AS tel FROM {K}
        UNION ALL SELECT page_id, k * 10 + 1, 'Other ' || k, 'https://www.freightclub.net/companies/other-' || k, NULL FROM {K} WHERE k % 4 = 1
        UNION ALL SELECT page_id, k * 10 + 4, NULL, NULL, '010' || k8 FROM {K} WHERE k % 3 <> 2 UNION ALL SELECT page_id, k * 10 + 5, NULL, NULL, '011' || k8 FROM {K} WHERE k % 6 = 0),
        i AS (SELECT *, count(nm) OVER (PARTITION BY page_id ORDER BY pos) AS island FROM a)
        SELECT page_id, max(nm) AS company_name, max(url) AS source_url, arg_min(tel, pos) AS phone_raw FROM i WHERE island > 0 GROUP BY page_id, island HAVING count(tel) > 0"""),
    "nearest_preceding_link": (nearest_preceding_link, """WITH a AS (SELECT l_orderkey AS page_id, ((l_linenumber * 10000 + l_suppkey) * 1000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS pos,
        CASE WHEN l_returnflag <> 'A' AND l_linestatus = 'O' THEN l_partkey END AS p, CASE WHEN l_returnflag = 'A' THEN '010' || l_suppkey END AS tel FROM lineitem),
        i AS (SELECT *, count(p) OVER (PARTITION BY page_id ORDER BY pos) AS island FROM a WHERE p IS NOT NULL OR tel IS NOT NULL)
        SELECT page_id, 'Part ' || max(p) AS company_name, '/p/' || max(p) AS source_url, arg_min(tel, pos) AS phone_raw FROM i WHERE island > 0 GROUP BY page_id, island HAVING count(tel) > 0"""),
    "onclick_cards": (onclick_cards, f"""SELECT page_id, item, 'Firm ' || k AS company_name, 'https://wsd.example/l/' || k AS source_url, 'ops' || k || '@firm.example' AS email,
        'https://firm' || k || '.example/home' AS website, CASE k % 3 WHEN 0 THEN 'Port ' || k WHEN 2 THEN 'City' END AS city,
        CASE k % 3 WHEN 0 THEN 'Egypt' WHEN 1 THEN 'Jordan' ELSE 'Sudan' END AS country,
        CASE k % 3 WHEN 0 THEN 'Port ' || k || ', Zone, Egypt' WHEN 1 THEN 'Jordan' ELSE 'City, Sudan' END AS address, 'Freight' AS category FROM {K}"""),
    "member_grid": (member_grid, f"SELECT page_id, item, 'Firm ' || k || ' & Sons' AS company_name, 'https://textile-egypt.org/textile-egypt.org/members/m' || k || '.html' AS source_url, 'Textiles' AS category, 'Egypt' AS country FROM {K} WHERE k % 10 <> 9"),
    "directory_table": (directory_table, f"SELECT page_id, 'Firm ' || k AS company_name, 'https://aecegy.com/business-directory/f' || k || '/' AS source_url, 'Garments' AS category, 'Egypt' AS country FROM {K} WHERE k % 4 <> 3"),
    "result_rows": (result_rows, f"""SELECT page_id, item, 'Firm ' || k AS company_name, 'https://www.yp.example/en/profile/firm-' || k || '/' || (k * 7) AS source_url,
        CASE k % 3 WHEN 0 THEN 'Street ' || k || ', City' || (k % 9) || ', Cairo .' WHEN 1 THEN 'Giza' ELSE k || ' Road, Giza.' END AS address,
        CASE k % 3 WHEN 0 THEN 'City' || (k % 9) WHEN 2 THEN k || ' Road' END AS city, CASE k % 3 WHEN 0 THEN 'Cairo' ELSE 'Giza' END AS governorate,
        CASE WHEN k % 2 = 0 THEN 'Plastics' ELSE 'Furniture' END AS category, CAST(k * 7 AS VARCHAR) AS company_id FROM {K}"""),
    "member_details": (member_details, f"""WITH m AS (SELECT *, 'https://textile-egypt.org/textile-egypt.org/members/m' || k || '.html' AS url FROM {K} WHERE k % 6 <> 5),
        r AS (SELECT unnest(['labelled', 'linked']) AS rule)
        SELECT rule, url, '+2010' || k8 || ',+2022' || k7 AS phones, CASE WHEN k % 2 = 0 THEN 'mill' || k || '@mill.net' ELSE '' END AS emails,
        CASE WHEN rule = 'linked' THEN 'http://ads' || k || '.example' WHEN k % 3 = 0 THEN 'http://mill' || k || '.example/a' END AS website,
        k || ' Mill St., Zone ' || (k % 9) AS address FROM m CROSS JOIN r"""),
    "listings_with_details": (listings_with_details, f"""SELECT 'Firm ' || k || ' & Sons' AS company_name, CASE WHEN k % 6 <> 5 THEN '+2010' || k8 END AS phone_raw,
        CASE WHEN k % 6 <> 5 THEN '+2022' || k7 END AS extras, CASE WHEN k % 6 <> 5 AND k % 2 = 0 THEN 'mill' || k || '@mill.net' END AS email,
        CASE WHEN k % 6 <> 5 AND k % 3 = 0 THEN 'http://mill' || k || '.example/a' END AS website, CASE WHEN k % 6 <> 5 THEN k || ' Mill St., Zone ' || (k % 9) END AS address
        FROM {K} WHERE k % 10 <> 9"""),
}
LAYOUT_SOURCES = {
    "egydir": "company_cards", "forwarding_companies": "table_rows", "freightclub": "link_then_phone", "wsdconnect": "onclick_cards",
    "textile_council": "member_grid", "aece": "directory_table", "yellowpages_eg": "result_rows",
}
WITH_PHONE = ("egydir", "freightclub")
QUERIES["all_layouts"] = (
    all_layouts,
    " UNION ALL ".join(
        f"SELECT '{source}' AS source, count(*) AS listings, {'count(phone_raw)' if source in WITH_PHONE else 'CAST(0 AS BIGINT)'} AS with_phone FROM ({QUERIES[name][1]})"
        for source, name in LAYOUT_SOURCES.items()
    ),
)
