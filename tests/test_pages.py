"""Reading HTML: contacts, links, entities, layouts, freshness."""

import re

from pyspark.sql import functions as F

from leadloom.functions import html as h
from leadloom.functions import text as tx
from leadloom.functions.urls import subpages
from leadloom.sources import pages as pg


def read(spark, html):
    df = spark.createDataFrame([(html,)], "html string")
    df = tx.settle(df, {"text": h.visible_text("html"), "links": h.anchors("html")})
    page, links, text = F.col("html"), F.col("links"), F.col("text")
    return df.select(
        "text", "links", h.phones_of(page, links, text).alias("phones"), h.whatsapp_numbers("html").alias("wa"),
        h.emails_of(page, links, text).alias("emails"), h.social_profiles(links).alias("social"),
    ).first()


def test_junk_number_before_the_real_one(spark):
    r = read(spark, "<p>Tax ID 12345 - established 2009</p><a href='tel:+201001234567'>call us</a>")
    assert r.phones == ["+201001234567"]


def test_whatsapp_first(spark):
    r = read(spark, "<a href='tel:+20226785885'>l</a><a href='https://wa.me/201001234567'>w</a>")
    assert r.phones == ["+201001234567", "+20226785885"] and r.wa == ["+201001234567"]


def test_emails(spark):
    key = 0x2A
    hidden = f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in "boss@real.com")
    r = read(spark, f"<a href='mailto:Sales@real.com?subject=x'>e</a><a href='mailto:noreply@real.com'>n</a>logo@2x.png test@example.com it@real.com"
                    f'<i data-cfemail="{hidden}">x</i><i data-cfemail="2a5">y</i>')
    assert r.emails == ["sales@real.com", "it@real.com", "boss@real.com"]


def test_social(spark):
    r = read(spark, "<a href='https://facebook.com/sharer/sharer.php?u=x'>s</a><a href='https://facebook.com/'>b</a>"
                    "<a href='https://www.facebook.com/MyFactory?x=1'>f</a><a href='https://www.linkedin.com/company/m'>l</a>")
    assert r.social == {"facebook": "https://www.facebook.com/MyFactory", "linkedin": "https://www.linkedin.com/company/m"}
    assert read(spark, "<a href='https://facebook.com/plugins/like.php'>x</a>").social == {}


def test_names_of_html(values):
    import html

    cases = ["info&commat;firm&period;com", "&copy 2020", "&copyx; &copy;", "a &amp;lt; b", "&notit; &notin; &no", "&CounterClockwiseContourIntegral;&NotEqualTilde;", "&#64;&#x40;&#64 x&#128;&#x9f;&#0;&#xD800;&#1114112;",
             "&AMP&lt&quot", "&unknown; & &; &&amp;", "&ampamp;", "5 &lt 6 &gt 4", "&Tab;x&NewLine;y"]
    assert values(h.decode_entities, cases) == [html.unescape(c) for c in cases]
    links = ["/x?a=1&copy=2&amp;lt=3", "/x?a=1&copy;2", "/x?a&ampb", "/x?a&amp"]
    assert values(lambda t: h.decode_entities(t, in_attribute=True), links) == ["/x?a=1&copy=2&lt=3", "/x?a=1\u00a92", "/x?a&ampb", "/x?a&"]
    assert read_mail(values, "<p>info&commat;firm&period;com</p>") == ["info@firm.com"]


def read_mail(values, page):
    return values(lambda x: h.emails_of(x, h.anchors(x), h.visible_text(x)), [page])[0]


def test_text_and_entities(spark):
    r = read(spark, "<html><style>p{}</style><script>var t='</p>';</script><!-- no --><p> A &amp; B </p><p>&#1605;&#x41;&nbsp;</p>&amp;lt; <b>x</b></html>")
    assert r.text == "A & B مA &lt; x"


def test_anchor_forms(spark):
    r = read(spark, '<a class="x" href="/a?x=1&amp;y=2">A <b>b</b></a><a name="n">no</a><A HREF=/c>C</A><!-- <a href="/no">n</a> -->')
    assert [(a.href, a.text) for a in r.links] == [("/a?x=1&y=2", "A b"), ("/c", "C")]


def test_subpages(spark):
    html = ('<a href="/about">About</a><a href="/contact">C</a><a href="/contact/">again</a><a href="https://o.example/contact">o</a>'
            '<a href="#contact">x</a><a href="mailto:contact@x.y">m</a><a href="/p">Our products</a><a href="/blog">b</a>')
    df = spark.createDataFrame([(html,)], "html string").select(subpages(h.anchors("html"), F.lit("https://s.example/"), 3).alias("v"))
    assert df.first().v == ["https://s.example/contact", "https://s.example/about", "https://s.example/p"]


def test_link_then_phone(spark):
    html = ('<a href="tel:1">orphan</a><a href="/companies/a/">Alpha</a><a href="/companies/b/">Beta</a><a href="tel:010">p</a><a href="tel:011">second</a>'
            '<a href="/companies/feed">feed</a><a href="/companies/c/">C</a><a href="/companies/d/">Delta</a><a href="tel:012">p</a>')
    rows = pg.link_then_phone(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("item").collect()
    assert [(r.company_name, r.phone_raw) for r in rows] == [("Beta", "010"), ("Delta", "012")]


def test_directory_skips_header_and_repeats(spark):
    html = ('<table><tr><th>Name</th></tr><tr><td>A</td><td><a href="/business-directory/a/">x</a></td></tr>'
            '<tr><td>A2</td><td><a href="/business-directory/a/">x</a></td></tr><tr><td>B</td><td>-</td></tr></table>')
    rows = pg.directory_table(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    assert [(r.company_name, r.source_url) for r in rows] == [("A", "https://aecegy.com/business-directory/a/")]


def test_details_keep_listing_without_page(spark):
    listing = spark.createDataFrame([("A", "u1"), ("B", "u2")], "company_name string, source_url string")
    pages = spark.createDataFrame([("u1", "<p>ADDRESS: 5 Mill St. TEL 01012345678 WEBSITE: http://a.example/x</p>")], "url string, html string")
    out = pg.join_details(listing, pg.member_details(pages, "own.example", True, pg.TEXTILE_STOPS))
    got = {r.company_name: (r.phone_raw, r.website, r.address) for r in out.collect()}
    assert got == {"A": ("+201012345678", "http://a.example/x", "5 Mill St."), "B": (None, None, None)}


def test_freshness(spark):
    rows = [("u", "old", "2024-01-01 00:00:00"), ("u", "new", "2024-01-02 00:00:00"), ("v", "gone", "2023-12-30 00:00:00")]
    df = spark.createDataFrame(rows, "url string, html string, t string").withColumn("fetched_at", F.col("t").cast("timestamp")).drop("t")
    got = pg.fresh_pages(df, F.lit("2024-01-02 06:00:00").cast("timestamp")).collect()
    assert [(r.url, r.html) for r in got] == [("u", "new")]


def shuffled_columns(df):
    """Columns that any shuffle of the plan carries."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    parts = [p for p in plan.split("\n\n") if re.match(r"\(\d+\) Exchange\b", p.strip())]
    return {c for p in parts for c in re.findall(r"(\w+)#", re.search(r"Input[^:]*: \[(.*)\]", p).group(1))}


def test_markup_is_fetched_for_the_newest_landings_only(spark, tmp_path):
    from leadloom.operators.enrich import site_pages

    home = "<a href='/contact'>c</a>"
    rows = [(u, f"{html}{k}", k) for u, html in (("https://a.eg", home), ("https://a.eg/contact", "<p>tel</p>"), ("https://b.eg", "x")) for k in range(3)]
    pages = spark.createDataFrame(rows, "url string, html string, k int").withColumn("fetched_at", F.timestamp_add("HOUR", "k", F.lit("2024-01-01").cast("timestamp"))).drop("k")
    pages.repartition(3).write.parquet(f"{tmp_path}/pages")
    landed = spark.read.parquet(f"{tmp_path}/pages")
    fresh = pg.fresh_pages(landed, F.lit("2024-01-01 12:00:00").cast("timestamp"))
    assert sorted((r.url, r.html) for r in fresh.collect()) == [("https://a.eg", home + "2"), ("https://a.eg/contact", "<p>tel</p>2"), ("https://b.eg", "x2")]
    assert "url" in shuffled_columns(fresh) and "html" not in shuffled_columns(fresh)
    sites = spark.createDataFrame([("https://a.eg",), ("https://c.eg",)], "site string")
    read = site_pages(sites, landed)
    assert sorted(map(tuple, read.collect())) == [("https://a.eg", 0, home + "2"), ("https://a.eg", 1, "<p>tel</p>2")]
    assert "html" not in shuffled_columns(read)
    assert sorted(map(tuple, site_pages(sites, pages.drop("fetched_at").where("html like '%2'")).collect())) == sorted(map(tuple, read.collect()))


def test_elements_end_where_they_end(values):
    from leadloom.sources.pages import element

    cases = {
        "<div a><div>x</div>y</div>z": "<div a><div>x</div>y", "<p>a</p><p>b</p>": "<p>a", "<div>open <p>x</p>": "<div>open <p>x</p>",
        "<td><table><tr><td>i</td></tr></table>t</td><td>n</td>": "<td><table><tr><td>i</td></tr></table>t", "<b>x</b>": "<b>x", "<DIV><div></DIV>k</div>r": "<DIV><div></DIV>k",
        "<div><divider>q</divider></div>r": "<div><divider>q</divider>", "": "",
        "<td>a<td>b</td>": "<td>a", "<td>a</tr><tr><td>b</td>": "<td>a", "<TD>a</TR>": "<TD>a", "<td>a<b>x</b></table>f</td>": "<td>a<b>x</b>",
        "<td><table><tr><td>i<td>j</table>t<td>n": "<td><table><tr><td>i<td>j</table>t", "<td>a<thead2>b</td>": "<td>a<thead2>b",
        "<tr><td>a<td>b<tr><td>c": "<tr><td>a<td>b", "<tr><td>a</td></table>foot": "<tr><td>a</td>", "<tr><td><table><tr><td>i</table>o</td></tr>z": "<tr><td><table><tr><td>i</table>o</td>",
        "<li>a<li>b</li>": "<li>a", "<li>a<ul><li>i<li>j</ul>k</ul>z": "<li>a<ul><li>i<li>j</ul>k", "<dt>a<dd>b": "<dt>a", "<dd>a</dl>z": "<dd>a",
        "<p>a<div>b</div>": "<p>a", "<p>a</div>z": "<p>a", "<p>a <pretty>b</pretty></p>z": "<p>a <pretty>b</pretty>", "<span>a<li>b</span>c": "<span>a<li>b",
        "<b>\u0130\u0130</b>z": "<b>\u0130\u0130", "<link>a</link2>b</link>c": "<link>a</link2>b", "<div>a</DIV >b": "<div>a",
    }
    assert values(element, list(cases)) == list(cases.values())


def test_unclosed_rows_cells_and_items(spark):
    """Layouts on pages that leave out the closing tags that HTML lets them leave out."""
    table = ("<table><tr><td>Alpha<td><a href='business-directory/a'>more</a><tr><td>Beta<table><tr><td>inner</table><td><a href='business-directory/b'>more</a></table>"
             "<p>foot <a href='business-directory/z'>z</a>")
    got = pg.directory_table(spark.createDataFrame([(1, table)], "page_id long, html string")).collect()
    assert [r.company_name for r in got if r.source_url.endswith("/a")] == ["Alpha"] and not any(r.source_url.endswith("/z") for r in got)
    card = ("<div class='listing-card'><p class='listing-company-name'>Firm<div class='listing-meta'><ul><li class='listing-item'>Cairo, Egypt +2 more<li class='listing-item'>x</ul></div></div>")
    row = pg.onclick_cards(spark.createDataFrame([(1, card)], "page_id long, html string")).first()
    assert (row.company_name, row.address) == ("Firm", "Cairo, Egypt")
    grid = "<ul><li class='grid-item'><img alt='Mill A'><a href='members/a'>a</a><li class='grid-item'><img alt='Mill B'><a href='members/b'>b</a></ul><img alt='ad'><a href='members/ad'>ad</a>"
    rows = pg.member_grid(spark.createDataFrame([(1, grid)], "page_id long, html string")).collect()
    assert sorted(r.company_name for r in rows) == ["Mill A", "Mill B"]


def test_last_card_ends_before_the_footer(spark):
    from leadloom.sources import pages as pg

    html = ("<div class='listing-card' onclick=\"window.location='https://w.example/1'\"><div class='listing-company-name'><div>A</div> Co</div></div>"
            "<footer><a href='mailto:foot@x.example'>m</a><a href='https://ads.example'>ad</a></footer>")
    got = pg.onclick_cards(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert [(r.company_name, r.email, r.website) for r in got] == [("A Co", None, None)]


def test_one_failing_source_leaves_the_others(spark):
    from leadloom.sources import catalogue as cat

    pages = spark.createDataFrame([(1, "egydir", "<div class='company-card'><h3 class='company-name'>Firm</h3></div>"), (2, "broken", "x")], "page_id long, source string, html string")
    cat._EXTRACTORS["broken"] = lambda rows: rows.select("source", F.raise_error(F.lit("layout changed")).alias("company_name"))
    try:
        rows, errors = cat.extract_each(pages, ["egydir", "broken"])
    finally:
        del cat._EXTRACTORS["broken"]
    assert [r.company_name for r in rows.collect()] == ["Firm"]
    assert [(r.source, "layout changed" in r.error) for r in errors.collect()] == [("broken", True)]


def test_request_fields_reach_paired_links(spark):
    from leadloom.sources import pages as pg

    html = "<a href='/companies/firm-1/'>Firm</a><a href='tel:010'>c</a>"
    row = pg.link_then_phone(spark.createDataFrame([(1, html, "Freight Forwarder", "Jordan")], "page_id long, html string, category string, country string")).first()
    assert (row.company_name, row.category, row.country) == ("Firm", "Freight Forwarder", "Jordan")
