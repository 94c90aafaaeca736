"""Classification, gates, segments and both scoring engines."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadloom import rules
from leadloom.functions import intel
from leadloom.operators import qualify as ql


def classify(spark, text, category=None):
    df = spark.createDataFrame([(text, category)], "description string, category string")
    low = intel.phrases(F.lower(F.coalesce("description", F.lit(""))))
    df = df.withColumn("kind", intel.company_type(low, F.col("category")))
    return df.select("kind", intel.shipping_intent(low, F.col("kind")).alias("intent"), intel.has_store(low).alias("store"), intel.intent_phrases(low).alias("signals")).first()


def test_company_types(spark):
    assert classify(spark, "We export cosmetics to GCC. International shipping.").kind == "Exporter"
    assert classify(spark, "We export cosmetics to GCC. International shipping.").intent >= 60
    assert classify(spark, "Our factory and production line; shipping and delivery").kind == "Manufacturer"
    assert classify(spark, "Freight forwarder, customs clearance").kind == "Freight Forwarder"
    assert classify(spark, "We are a forwarder, we import").kind == "Importer"
    assert tuple(classify(spark, ""))[:3] == ("Unknown", 0, False)
    assert classify(spark, "", "Freight Forwarder").kind == "Freight Forwarder"
    assert classify(spark, "shop now").store and classify(spark, "we import and export").signals == ["export", "import", "we import"]


def test_phrases_equal_a_search_for_each(values):
    import random

    from leadloom.functions import text as tx

    rng = random.Random(1)
    known = ["ab", "abc", "abcd", "bc", "cab", "c.b", " a", "b ", "aaa", "aa", "cabc", "d+"]
    texts = ["".join(rng.choice("aaabbcd. +") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["abcabcd", "aaaa", ""]
    assert [sorted(x) for x in values(lambda t: tx.occurring(t, known), texts)] == [sorted(p for p in known if p in t) for t in texts]
    real = [*rng.choices(intel.SIGNALS, k=300), "we exportimporter", "freight forwardering", "export managerexport manager", "تخليص جمركي"]
    glued = ["".join(rng.choices(real, k=4)) for _ in range(200)]
    assert [sorted(x) for x in values(intel.phrases, glued)] == [sorted({p for p in intel.SIGNALS if p in f" {t} "}) for t in glued]
    assert values(intel.phrases, [None]) == [[]]


def test_platforms_and_markets(values):
    marks = ["<script src='cdn.shopify.com/x'>", "/wp-content/plugins/woocommerce/x.css", "powered by salla.sa", "zid.store", "plain", None]
    assert values(intel.store_platform, marks) == ["Shopify", "WooCommerce", "Salla", "Zid", None, None]
    assert values(lambda low: intel.markets(intel.phrases(low)), ["saudi arabia, uae, europe, egypt", "", None, "our eu office"]) == [["GCC", "Europe", "Local (Egypt)"], [], [], ["Europe"]]


def test_decision_maker(spark):
    rows = [("Ahmed Hassan - Export Manager. For logistics contact Mona Ali.", ["info@co.com", "ahmed@co.com"]), ("للتواصل مع مدير التصدير", []),
            ("just a homepage", ["a@b.c"]), ("Managing Director: Sara Nabil.", ["sales@x.com"])]
    df = spark.createDataFrame(rows, "t string, e array<string>").select(intel.decision_maker(F.col("t"), F.col("e"), intel.phrases(F.lower("t"))).alias("c"))
    got = [tuple(r.c) if r.c else None for r in df.collect()]
    assert got == [("Ahmed Hassan", "Export Manager", "ahmed@co.com"), (None, "Export Manager", None), None, ("Sara Nabil.", "Owner / CEO", None)]


LEAD = dict(pos=1, company_name="Nile Co", source="s", phone_raw="01012345678", website="nile.example", category=None, description=None, followers=None, last_activity_date=None)
TYPES = "pos long, company_name string, source string, phone_raw string, website string, category string, description string, followers int, last_activity_date date"


def rate(spark, scoring=rules.SCORING, **fields):
    row = {**LEAD, **fields}
    df = spark.createDataFrame([tuple(row[c] for c in LEAD)], TYPES)
    return ql.qualify(df, scoring=scoring, as_of=dt.date(2026, 6, 1)).first()


@pytest.mark.parametrize("fields, outcome, reason", [
    ({}, "keep", None), ({"company_name": " "}, "quarantine", "no_identity"), ({"company_name": "--"}, "quarantine", "junk_name"),
    ({"phone_raw": "x", "website": None}, "quarantine", "no_contact"), ({"followers": 10}, "drop", "low_followers"),
    ({"last_activity_date": dt.date(2022, 1, 1)}, "drop", "inactive"), ({"followers": 10, "last_activity_date": dt.date(2022, 1, 1)}, "drop", "inactive"),
])
def test_gates(spark, fields, outcome, reason):
    r = rate(spark, **fields)
    assert (r.outcome, r.reason) == (outcome, reason)


@pytest.mark.parametrize("fields, segment", [
    ({"description": "freight forwarder"}, "competitor"), ({"category": "Cosmetics"}, "P1"), ({"category": "Gift Shops"}, "P2"),
    ({"category": "Import & Export"}, "P3"), ({"source": "aece"}, "P3"), ({"description": "digital agency"}, "service"),
    ({"description": "marketing department of our factory"}, "P1"), ({"description": "our factory, add to cart"}, "P1"), ({}, "other"),
])
def test_segments(spark, fields, segment):
    assert rate(spark, **fields).segment == segment


def test_bands(spark):
    maker = rate(spark, description="Our factory, production line. We export to Europe. add to cart")
    assert maker.score >= 90 and maker.tier == "Hot" and maker.score_reasons[0].factor == "band:product_maker"
    assert 60 <= rate(spark, description="we import").score <= 80
    assert 45 <= rate(spark, category="Import & Export").score <= 60
    service, rival = rate(spark, description="consulting"), rate(spark, description="freight forwarder")
    assert (service.score, len(service.score_reasons)) == (20, 1) and (rival.score, rival.tier) == (10, "Weak")
    assert rate(spark, company_name="").score_reasons == []


def test_additive_engine(spark):
    cfg = {"weights": {"has_website": 20, "has_phone": 20, "in_freight_directory": 15}, "activity": [{"max_months": 3, "points": 15}, {"max_months": 12, "points": 5}],
           "followers": [{"min": 5000, "points": 10}, {"min": 1000, "points": 5}], "freight_sources": ["s"], "max_score": 100}
    r = rate(spark, cfg, followers=1500, last_activity_date=dt.date(2026, 4, 30))
    assert {x.factor: x.points for x in r.score_reasons} == {"has_website": 20, "has_phone": 20, "in_freight_directory": 15, "recent_activity": 15, "followers": 5}
    assert (r.score, r.tier) == (75, "Hot")


def test_equal_thresholds_take_the_later_tier(values):
    assert values(lambda c: ql.tier_of(c, {"A": 10, "B": 10, "Weak": 0}), [5, 10, 50], "int") == ["Weak", "B", "B"]


def test_custom_filters_build(spark):
    df = spark.createDataFrame([(None, "a.example", None, None, 5)], "phone_e164 string, website string, domain string, email string, followers int").withColumn("last_activity_date", F.lit(None).cast("date"))
    strict = {"require_phone": True, "require_contact": True}
    assert df.select(ql.filter_reason(strict).alias("r")).first().r == "no_phone"
    assert df.select(ql.filter_reason({"activity": {"enabled": True, "drop_if_activity_unknown": True}}).alias("r")).first().r == "activity_unknown"
    assert df.select(ql.filter_reason({}).alias("r")).first().r is None


def test_reasons_in_words(spark):
    from leadloom.functions.text import reason_text

    df = spark.sql("SELECT array(named_struct('factor', 'has_phone', 'points', 6), named_struct('factor', 'odd', 'points', 1)) AS r, cast(NULL AS array<struct<factor:string,points:int>>) AS n")
    assert tuple(df.select(reason_text("r"), reason_text("n")).first()) == ("رقم ✓، odd", "")
