"""Short text fields: phones, domains, names, e-mails, labels, places, links."""

from pyspark.sql import functions as F

from leadloom import rules
from leadloom.functions import html as h
from leadloom.functions import text as tx
from leadloom.functions import urls
from leadloom.functions.intel import search_text
from leadloom.functions.phone import e164


def test_phone(values):
    cases = {
        "+20 100 123 4567": "+201001234567", "0100 123 4567": "+201001234567", "01012345678": "+201012345678",
        "+20226785885": "+20226785885", "201001234567": "+201001234567", "0020 11 12345678": "+201112345678",
        "+966 51 234 5678": "+966512345678", "٠١٠١٢٣٤٥٦٧٨": "+201012345678", "+20 0100 1234567": "+201001234567",
        None: None, "": None, "hello": None, "123": None, "4111 1111 1111 1111": None, "+44 20 7946 0958": "+442079460958", "+44 (0)20 7946 0958": "+442079460958", "0130": None,
        "02 25937958 ext 5": "+20225937958", "+1 212 555 0123 x99": "+12125550123", "+999 1234567": None, "+1 12 3": None,
    }
    assert values(e164, list(cases)) == list(cases.values())


def test_invalid_foreign_numbers(values):
    bad = ["+1 123 456 7890", "+1 212 123 4567", "+7 1000000000", "+34 112345678", "+44 4123456789", "+90 1234567890", "+212 123456789", "+800 1234", "+999 12345678", "+888 12345678"]
    good = ["+1 212 555 4567", "+7 9161234567", "+34 612345678", "+44 7912345678", "+90 5321234567", "+212 612345678", "+800 1234 5678", "+881 631 555 123", "+870 773 111 632", "+33 1 42 68 53 00", "+86 139 1234 5678"]
    assert values(e164, bad) == [None] * len(bad)
    assert values(e164, good) == ["+" + "".join(c for c in x if c.isdigit()) for x in good]


def test_phone_of_every_calling_code(values):
    numbers = """
    +12015550123 +78123456789 +27101234567 +302123456789 +31101234567 +3212345678 +33123456789 +34810123456 +3611234567 +390212345678 +40211234567
    +41212345678 +431234567890 +441212345678 +4532123456 +468123456 +4721234567 +48123456789 +4930123456 +5111234567 +522001234567 +5371234567
    +541123456789 +551123456789 +56221234567 +576012345678 +582121234567 +60323856789 +61212345678 +622112345678 +63212345678 +6432345678 +6561234567
    +6621234567 +81312345678 +8222123456 +842101234567 +861012345678 +902123456789 +917410410123 +922123456789 +93234567890 +94112345678 +951234567
    +982123456789 +211181234567 +212520123456 +21312345678 +21630010123 +2205661234 +221301012345 +22235123456 +22320212345 +22430241234 +2250123456789
    +22620491234 +22720201234 +22822212345 +2290195123456 +22997123456 +2302012345 +23121234567 +23222221234 +233302345678 +23412345678 +23522501234
    +23621612345 +237222123456 +2382211234 +2392221234 +240333091234 +2416123456 +242222123456 +242061234567 +243123456789 +244222123456 +2454432012
    +2463709100 +24762889 +2484217123 +250250123456 +251111112345 +2525522010 +25321360003 +254202012345 +255222345678 +256312345678 +25722201234
    +25821123456 +260211234567 +261202123456 +262262161234 +2631312345 +26461221234 +2651234567 +26622123456 +2672401234 +26822171234 +2697712345
    +29022158 +2918370362 +2975212345 +298201234 +299321000 +35020012345 +351212345678 +35227123456 +35322123456 +3544101234 +35522345678 +35621001234
    +35722345678 +358131234567 +35921234567 +37052123456 +37163123456 +3723212345 +37322212345 +37410123456 +375152450911 +376712345 +37799123456
    +3780549886377 +380311234567 +381101234567 +38230234567 +38328012345 +38512345678 +38612345678 +38730212345 +38922012345 +420212345678 +421221234567
    +4232345678 +50031234 +5012221234 +50222456789 +50321234567 +50422123456 +50521234567 +50622123456 +5072001234 +508430123 +50922453300 +590590201234
    +59122123456 +5922191234 +59322123456 +594594101234 +595212345678 +596596301234 +597211234 +59821231234 +5997151234 +67021121234 +672106609
    +6732345678 +6744441234 +6753123456 +67620123 +67740123 +67822123 +6793212345 +6802771234 +681499712 +68221234 +6834002 +68522123 +68631234 +687201234
    +68820123 +68940412345 +6903010 +6913201234 +6922471234 +85021123456 +85221234567 +85328212345 +85523756789 +85621212862 +88027111234 +886221234567
    +9606701234 +9611123456 +96315213456 +96412345678 +9671234567 +96823123456 +97022234567 +97221234567 +97317001234 +9752345678 +97653123456
    +97714567890 +992372123456 +99312345678 +994123123456 +995322123456 +996312123456 +998612345678 +201001234567 +966512345678 +971501234567 +96522345678
    +97444123456 +96262001234 +218912345678 +249912345678 +80012345678 +80812345678 +870773111632 +878101234567890
    +881612345678 +8823421234 +883510012345 +979123456789
    """.split()
    codes = {code for code, _, _ in rules.NUMBERING.values()} | set(rules.WORLD_LENGTHS)
    assert not [c for c in codes if not any(n.startswith("+" + c) for n in numbers)]
    assert dict(zip(numbers, values(e164, numbers))) == {n: n for n in numbers}
    cases = {"00225 07 12 34 56 78": "+2250712345678", "+229 01 97 12 34 56": "+2290197123456", "+242 06 123 4567": "+242061234567", "+229 197123456": None, "+225 712345678": None}
    assert values(e164, list(cases)) == list(cases.values())


def test_domain(values):
    cases = {
        "https://www.Example.com/path?x=1": "example.com", "HTTP://Sub.Site.CO/": "sub.site.co", "example.com": "example.com",
        "http://h.example:8080/x": "h.example", "http://u:p@h.example/": "u", "   ": None, None: None, "www.": None,
    }
    assert values(tx.site_domain, list(cases)) == list(cases.values())


def test_name_key(values):
    cases = {"  Nile   Beauty!! ": "nile beauty", None: "", "شركة النيل - Nile": "شركة النيل nile", "--": "", "Éclair_2": "éclair_2"}
    assert values(tx.name_key, list(cases)) == list(cases.values())


def test_cell_email(values):
    cases = {
        "INFO@Nile.example": "info@nile.example", "%20info@makkacorp.com": "info@makkacorp.com",
        "sales@dubaigate.com.com": "sales@dubaigate.com", "cs@ecc.com | export@ecc.net": "cs@ecc.com", "noreply@x.com": None,
        "not-an-email": None, None: None, "a@b.co.uk;c@d.com": "a@b.co.uk", ".x@y.org.": "x@y.org",
    }
    assert values(tx.cell_email, list(cases)) == list(cases.values())


def test_place_label_and_dates(values):
    assert values(tx.place_label, ["Phone: 010", "الهاتف: 012", "Website:", None, " plain "]) == ["010", "012", None, None, "plain"]
    days = values(tx.lenient_date, ["2024-03-05", "2024-03-05 10:00:00", "soon", None])
    assert [str(x) if x else None for x in days] == ["2024-03-05", "2024-03-05", None, None]


def test_blocked(values):
    assert values(tx.looks_blocked, ["HTTP 403 Forbidden", "Cloudflare", "429", "connection reset", None]) == [True, True, True, False, False]


def test_status_labels(values):
    labels = values(tx.status_label, [*rules.STATUS_LABELS, "quarantined"])
    assert labels == [*rules.STATUS_LABELS.values(), "quarantined"]
    assert values(tx.status_of_label, [*rules.STATUS_LABELS.values(), "?"]) == [*rules.STATUS_LABELS, "new"]


def test_places(spark):
    df = spark.createDataFrame([("12 St., Smouha, Alexandria .",), ("Giza",), (None,)], "a string")
    city, gov = urls.address_place("a")
    assert [tuple(r) for r in df.select(city, gov).collect()] == [("Smouha", "Alexandria"), (None, "Giza"), (None, None)]
    city, country = urls.location_place("a")
    assert [tuple(r) for r in df.select(city, country).collect()] == [("12 St.", "Alexandria ."), (None, "Giza"), (None, None)]


def test_resolve(spark):
    base = "https://h.example/a/b?q=1"
    cases = {
        "x": "https://h.example/a/x", "/x": "https://h.example/x", "//c.example/y": "https://c.example/y", "?p=2": "https://h.example/a/b?p=2",
        "#t": "https://h.example/a/b?q=1#t", "http://o.example": "http://o.example", "./x": "https://h.example/a/x", "../x": "https://h.example/x",
        "": base, "mailto:a@b.c": "mailto:a@b.c",
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, h string")
    got = [r.v for r in df.select("i", urls.resolve(F.lit(base), "h").alias("v")).orderBy("i").collect()]
    assert got == list(cases.values())
    listed = df.select("i", urls.listing_url("h", "https://b.example/").alias("v")).orderBy("i").collect()
    assert [r.v for r in listed][:3] == ["x", "https://b.example/x", "https://c.example/y"] and listed[8].v is None


def test_search_text(spark):
    rows = [("Cosmetics", "Manufacturer", "Cairo", "Egypt"), ("Cosmetics", "Agent", None, "Egypt"), (None, None, "Giza", None), ("Food", None, "", "")]
    df = spark.createDataFrame(rows, "c string, r string, p string, l string")
    got = [r.v for r in df.select(search_text(F.col("c"), F.col("r"), F.col("p"), F.col("l")).alias("v")).collect()]
    assert got == ["Cosmetics manufacturers in Cairo Egypt", "Cosmetics agent Egypt", "companies in Giza", "Food"]


def test_phone_payload(values):
    cases = {'[["a1","b"],["a1"],[]]': ["a1", "b"], '["x"," x ","y"]': ["x", "y"], "call 010-1234567": ["010-1234567"], "closed": [], "[]": []}
    assert values(h.phone_payload, list(cases)) == list(cases.values())


def test_links_resolve_as_the_standard_library_does(spark):
    from urllib.parse import urljoin

    from leadloom.functions import urls

    bases = ["http://h.example/a/b/c/d/e/", "http://h.example/a/b", "http://h.example", "http://h.example/a/b/?q#f"]
    links = ["../../../../x", "..", ".", "../", "./x", "../x?y=../z", "/a/../b/./c", "/../../x", "x/../../y", "a/..", "../" * 12 + "x/", "img.png", "/p", "?q", "#f"]
    rows = [(b, x, urljoin(b, x)) for b in bases for x in links]
    made = spark.createDataFrame(rows, "b string, h string, want string").withColumn("got", urls.resolve("b", "h"))
    assert made.where("got <> want").collect() == []


def test_references_and_bad_numbers(values):
    from leadloom.functions.html import decode_entities

    texts = ["&larr;x&Eacute;", "&#9999999;", "a&#0;b&#xD800;c", "&amp;lt;", "&nosuch; & &", "&#x41;&#66;", "&apos;&quot;"]
    assert values(decode_entities, texts) == ["←xÉ", "\ufffd", "a\ufffdb\ufffdc", "&lt;", "&nosuch; & &", "AB", "'\""]


def test_common_ways_to_write_a_day(values):
    import datetime as dt

    cells = ["12/31/2024", "Dec 5 2024", "5 March 2023", "20240105", "2024-03-05T10:00:00", "March 5th, 2023", "31/12/2024", "2024/1/9", "Tue, 5 Mar 2024 10:30", "1/2/2024", "soon", "99999999", ""]
    want = ["2024-12-31", "2024-12-05", "2023-03-05", "2024-01-05", "2024-03-05", "2023-03-05", "2024-12-31", "2024-01-09", "2024-03-05", "2024-01-02", None, None, None]
    assert values(tx.lenient_date, cells) == [w and dt.date.fromisoformat(w) for w in want]
