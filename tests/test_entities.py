"""Entity resolution against a plain sequential fold, merge policy, stored leads, skew."""

import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators import qualify as ql
from leadloom.operators import resolve as rs
from leadloom.operators.enrich import enrich
from leadloom.sources import lead_table as lt
from leadloom.sources.lead_table import compact, fold_into_table, read_leads, write_leads


def fold(rows):
    """One record after the other, as a person would do it."""
    leads, out = [], {}
    for pos, phone, domain, name, city, seed in rows:
        hit = None
        if not seed:
            if phone:
                hit = next((x for x in leads if x["phone"] == phone), None)
            if hit is None and domain:
                hit = next((x for x in leads if x["domain"] == domain), None)
            if hit is None and name:
                hit = next((x for x in leads if x["name"] == name and x["city"] == city), None)
        if hit is None:
            leads.append(dict(pos=pos, phone=phone, domain=domain, name=name, city=city))
            out[pos] = pos
        else:
            out[pos] = hit["pos"]
            for k, v in (("phone", phone), ("domain", domain), ("city", city)):
                hit[k] = hit[k] or v
    return out


def assigned(spark, rows, partitions=8):
    df = spark.createDataFrame(rows, rs.KEY_SCHEMA).repartition(partitions)
    return {r.pos: r.lead for r in rs.assign(df).collect()}


def random_rows(seed, groups, seeds=0.0):
    rnd = random.Random(seed)
    made = []
    for g in range(groups):
        for _ in range(rnd.choice([2, 5, 9, 14])):
            def pick(kind, n, blank):
                return None if rnd.random() < blank else f"{kind}{g}_{rnd.randrange(n)}"

            made.append((pick("p", 4, 0.35), pick("d", 3, 0.35), pick("n", 2, 0.1), pick("c", 2, 0.4)))
    rnd.shuffle(made)
    cut = int(len(made) * seeds)
    return [(i, *m, i < cut) for i, m in enumerate(made)]


@pytest.mark.parametrize("seed, seeds", [(1, 0.0), (2, 0.3)])
def test_equals_sequential_fold(spark, seed, seeds):
    rows = random_rows(seed, 150, seeds)
    assert assigned(spark, rows) == fold(rows)


def test_independent_of_partitions_and_slices(spark, monkeypatch):
    rows = random_rows(3, 60)
    first = assigned(spark, rows, 1)
    monkeypatch.setattr(rs, "SLICE", 7)
    shuffled = rows[:]
    random.Random(4).shuffle(shuffled)
    assert assigned(spark, shuffled, 5) == first == fold(rows)


@pytest.mark.parametrize("seed, seeds", [(6, 0.0), (7, 0.25)])
def test_rounds_narrow_to_what_may_move(spark, seed, seeds):
    rows = random_rows(seed, 120, seeds)
    assert assigned(spark, rows) == fold(rows)


def test_a_round_writes_three_tables(spark, monkeypatch):
    """What moved, the state and the holdings; the last round, in which nothing moves, writes no more of them than the start."""
    rows, written, rounds = random_rows(8, 10), [], []
    plain_cut, plain_reassign = rs.cut, rs._reassign
    monkeypatch.setattr(rs, "cut", lambda df: written.append(df.columns) or plain_cut(df))
    monkeypatch.setattr(rs, "_reassign", lambda *given: rounds.append(1) or plain_reassign(*given))
    assert assigned(spark, rows) == fold(rows)
    assert len(rounds) > 1 and len(written) <= 3 * len(rounds)


def test_hot_keys(spark):
    """A third of all records share a phone, a third a domain, a third a name without city."""
    rnd = random.Random(5)
    rows = []
    for i in range(3000):
        kind = i % 3
        rows.append((i, "hot" if kind == 0 else f"p{rnd.randrange(900)}" if rnd.random() < 0.5 else None,
                     "hot.example" if kind == 1 else None, "hot" if kind == 2 else f"n{rnd.randrange(500)}", None if rnd.random() < 0.7 else "x", False))
    assert assigned(spark, rows) == fold(rows)


def test_keys_grow(spark):
    rows = [(1, "p1", None, "a", None, False), (2, "p1", "d1", "b", "x", False), (3, None, "d1", "c", None, False),
            (4, None, None, "a", "x", False), (5, "p2", None, "z", None, False), (6, "p1", "d2", "z", None, False), (7, None, "d2", "q", None, False)]
    assert assigned(spark, rows) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 1, 7: 7} == fold(rows)


RAW = "pos long, company_name string, source string, phone_raw string, website string, email string, city string, description string, social_links map<string,string>"


def listing(pos, name="Nile Co", source="a", phone=None, site=None, email=None, city=None, description=None, links=None):
    return (pos, name, source, phone, site, email, city, description, links or {})


def rated(spark, rows):
    return ql.qualify(spark.createDataFrame(rows, RAW))


def by_name(df):
    return {r.company_name: r for r in df.collect()}


def test_merge_policy(spark):
    rows = [
        listing(1, "Nile", "b", phone="01012345678", links={"facebook": "f1", "linkedin": "l1"}, description="we import"),
        listing(2, "Nile Two", "a", phone="01012345678", site="nile.example", email="x@nile.net", links={"facebook": "f2"}),
        listing(3, "Delta", "a", phone="01112345678", city="Cairo"),
        listing(4, "Nile Three", "c", phone="01212345678", site="nile.example", city="Giza", description="we export"),
        listing(5, "Delta", "c", site="delta.example", city="Giza"),
    ]
    got = by_name(rs.upsert(rated(spark, rows)))
    nile = got["Nile"]
    assert nile.sightings == 3 and nile.website == "https://nile.example" and nile.email == "x@nile.net" and nile.city == "Giza"
    assert nile.source == "b" and nile.sources_seen == ["a", "b", "c"]
    assert nile.extra_phones == ["+201212345678"] and nile.social_links == {"facebook": "f2", "linkedin": "l1"}
    assert nile.company_type == "Exporter" and nile.status == "new"
    assert len(got) == 3 or sorted(r.sightings for r in rs.upsert(rated(spark, rows)).collect()) == [1, 1, 3]


def test_policy_switches(spark):
    rows = [listing(1, phone="01012345678", description="we import"), listing(2, "--", phone="01012345678"), listing(3, "X Co", phone="01012345678", description="hello")]
    safe = rs.upsert(rated(spark, rows[:2])).first()
    assert safe.score > 0 and safe.status == "new"
    plain = rs.upsert(rated(spark, rows[:2]), keep_score_on_quarantine=False).first()
    assert (plain.score, plain.tier) == (0, "Weak")
    assert rs.upsert(rated(spark, [rows[0], rows[2]])).first().company_type == "Importer"
    assert rs.upsert(rated(spark, [rows[0], rows[2]]), unknown_type_is_blank=False).first().company_type == "Unknown"


def test_quarantine_is_kept_but_hidden(spark, tmp_path):
    path = str(tmp_path / "leads")
    write_leads(rs.upsert(rated(spark, [listing(1, phone="01012345678"), listing(2, "No Contact"), listing(3, "--", phone="01112345678")])), path)
    assert read_leads(spark, path).count() == 1
    assert {r.quarantine_reason for r in read_leads(spark, path, True).collect()} == {None, "no_contact", "junk_name"}


def test_second_batch_updates_stored_leads(spark, tmp_path):
    path = str(tmp_path / "leads")
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    write_leads(rs.upsert(rated(spark, [listing(1, phone="01012345678", city="Cairo")]), run_id=1, now=now).drop("created", "sightings"), path)
    stored = read_leads(spark, path, True)
    stored = stored.withColumn("notes", F.lit("called")).withColumn("status", F.lit("contacted"))
    again = rs.upsert(rated(spark, [listing(1, "Other", "z", phone="01012345678", site="n.example"), listing(2, "New Co", site="new.example")]), stored, run_id=2,
                      now=F.lit("2024-02-01").cast("timestamp_ntz"))
    got = by_name(again)
    old, new = got["Nile Co"], got["New Co"]
    assert (old.notes, old.status, old.run_id, old.sources_seen, old.domain) == ("called", "contacted", 1, ["a", "z"], "n.example")
    assert (str(old.created_at.date()), str(old.updated_at.date()), old.created) == ("2024-01-01", "2024-02-01", False)
    assert new.created and new.run_id == 2 and new.lead_id > old.lead_id


def test_all_numbers_stay_with_the_lead(spark, tmp_path):
    path = str(tmp_path / "leads")
    for batch in range(2):
        rows = [listing(i, phone=f"0101234567{4 * batch + i}", site="one.example") for i in range(4)]
        fold_into_table(rated(spark, rows), path)
    lead = read_leads(spark, path).collect()
    assert len(lead) == 1 and {lead[0].phone_e164, *lead[0].extra_phones} == {f"+20101234567{i}" for i in range(8)}


def test_unfinished_version_is_not_read(spark, tmp_path):
    path = str(tmp_path / "leads")
    fold_into_table(rated(spark, [listing(1, phone="01012345678")]), path)
    (tmp_path / "leads" / "version=2").mkdir()  # runs that died while writing
    (tmp_path / "leads" / "part=2" / "leads").mkdir(parents=True)
    assert read_leads(spark, path).count() == 1
    for i in range(3):
        fold_into_table(rated(spark, [listing(1, f"Firm {i}", phone=f"0111234567{i}")]), path)
    assert read_leads(spark, path).count() == 4
    assert sorted(p.name for p in (tmp_path / "leads").iterdir() if p.name.startswith("version")) == ["version=3", "version=4"]
    fold_into_table(rated(spark, [listing(1, "--")]).where("false"), str(tmp_path / "none"))
    assert read_leads(spark, str(tmp_path / "none"), True).count() == 0
    fold_into_table(rated(spark, [listing(1, phone="01012345678")]), str(tmp_path / "none"))
    assert read_leads(spark, str(tmp_path / "none")).count() == 1


def _plain(leads):
    kept = [c for c in leads.columns if c not in ("lead_id", "created", "sightings", "created_at", "updated_at", "run_id")]
    return sorted(str(r) for r in leads.select(*sorted(kept)).collect())


def test_batches_equal_one_fold(spark, tmp_path, monkeypatch):
    """Many small batches with parts merged on the way, and a compaction, give the leads of one fold."""
    rng = random.Random(5)
    rows = [listing(i, rng.choice(["Nile Co", "Delta Co", f"Firm {i}"]), phone=rng.choice([None, f"010123456{rng.randint(10, 25)}"]), site=rng.choice([None, f"https://s{rng.randint(1, 9)}.example"]),
                    city=rng.choice([None, "Cairo", "Giza"])) for i in range(60)]
    monkeypatch.setattr(lt, "FANOUT", 3)
    all_rated = rated(spark, rows).cache()
    path = str(tmp_path / "leads")
    parts = []
    for k, (low, high) in enumerate([(0, 40), (40, 45), (45, 50), (50, 55), (55, 60)]):
        fold_into_table(all_rated.where(f"pos >= {low} and pos < {high}"), path, writer="w", batch=k)
        parts.append(len(lt.newest_version(spark, path).parts))
        if k == 1:
            compact(spark, path)
            assert len(lt.newest_version(spark, path).parts) == 1
    assert max(parts) < 5 and lt.folded_batches(spark, path) == {"w": 4}
    assert _plain(read_leads(spark, path, True)) == _plain(rs.upsert(all_rated))
    assert read_leads(spark, path, True).groupBy("lead_id").count().where("count > 1").isEmpty()


def test_a_batch_reads_and_writes_by_its_size(spark, tmp_path):
    """Files opened and bytes written for a batch do not follow the table's size."""
    def size(folder):
        return sum(p.stat().st_size for p in folder.rglob("*.parquet"))

    written, opened, table = [], [], []
    for n in (40, 400):
        path = str(tmp_path / f"leads{n}")
        fold_into_table(rated(spark, [listing(i, f"Firm {i}", phone=f"0101234{i:04d}", site=f"https://s{i}.example") for i in range(n)]), path)
        batch = rated(spark, [listing(1, "Firm 7", phone="01012340007", site="https://new.example"), listing(2, "Fresh", phone="01112345678")])
        version = lt.newest_version(spark, path)
        asked = lt.match_keys(batch, "pos").select("kind", "key").distinct()
        found = lt.leads_holding(spark, path, asked, version)
        stored = lt.leads_by_id(spark, path, found, version)
        assert [r.company_name for r in stored.collect()] == ["Firm 7"]
        opened.append((len(found.inputFiles()), len(stored.select("lead_id").inputFiles())))
        fold_into_table(batch, path)
        table.append(size(tmp_path / f"leads{n}" / "part=1"))
        written.append(size(tmp_path / f"leads{n}" / "part=2"))
        assert read_leads(spark, path).count() == n + 1
    assert table[1] > table[0] and written[1] < 1.1 * written[0]
    assert max(opened[1]) <= 5 + 1  # a bucket a key, and one a lead


def test_a_batch_is_written_once_before_it_is_folded(spark, tmp_path, monkeypatch):
    path, written = str(tmp_path / "leads"), []
    fold_into_table(rated(spark, [listing(1, phone="01012345678")]), path)
    for module in (lt, rs):
        monkeypatch.setattr(module, "cut", lambda df, plain=module.cut: written.append("outcome" in df.columns) or plain(df))
    placed = fold_into_table(rated(spark, [listing(1, "Other", phone="01012345678"), listing(2, "Fresh", phone="01112345678")]), path)
    assert sum(written) == 1 and sorted((r.pos, r.created) for r in placed.collect()) == [(1, False), (2, True)]
    assert read_leads(spark, path).count() == 2


def test_repeated_batch_is_skipped(spark, tmp_path):
    from leadloom.streaming import jobs

    path, landing = str(tmp_path / "leads"), str(tmp_path / "in")
    spark.createDataFrame([listing(1, phone="01012345678"), listing(2, "No Key"), listing(3, "--")], RAW).write.parquet(landing)
    stream = jobs.read_landed(spark, landing, spark.read.parquet(landing).schema)
    for _ in range(2):  # the second run has lost its progress and gets the batch again
        state = str(tmp_path / "state")
        jobs.upsert_batches(stream, path, state)
        for name in ("0", ".0.crc"):
            (tmp_path / "state" / "commits" / name).unlink()
    assert read_leads(spark, path, True).count() == 3


def test_match_priority(spark):
    known = spark.createDataFrame([(1, "+201", None, "a", None), (2, None, "d", "b", None), (3, None, None, "c", "x"), (4, None, "d", "c", None)],
                                  "lead_id long, phone_e164 string, domain string, company_name_norm string, city string")
    new = spark.createDataFrame([(1, "+201", "d", "c", "x"), (2, "+209", "d", "c", "x"), (3, None, None, "c", "x"), (4, None, None, "c", None), (5, None, None, "", None)],
                                "pos long, phone_e164 string, domain string, company_name_norm string, city string")
    got = {r.pos: (r.lead_id, r.matched_on) for r in rs.match_existing(new, known).collect()}
    assert got == {1: (1, "phone"), 2: (2, "domain"), 3: (3, "name_city"), 4: (4, "name_city"), 5: (None, None)}


WEB = [
    ("https://shop.example", "<a href='/about'>About</a><a href='/contact'>Contact</a><p>We export to Saudi Arabia and Europe.</p><script src='https://cdn.shopify.com/x.js'></script>"),
    ("https://shop.example/contact", "<a href='tel:+201001234567'>c</a><a href='https://wa.me/201112345678'>w</a><a href='mailto:info@shop.net'>m</a>"),
    ("https://shop.example/about", "<p>Managing Director: Sara Nabil, sara@shop.net</p>"),
]


def test_enrichment(spark):
    pages = spark.createDataFrame(WEB, "url string, html string")
    rows = [listing(1, "Shop", phone="01212345678", site="https://shop.example"), listing(2, "Gone", site="https://gone.example"), listing(3, "None", phone="01012345679")]
    got = by_name(ql.qualify(spark.createDataFrame(rows, RAW), enrich=lambda df: enrich(df, pages)))
    shop = got["Shop"]
    assert shop.enriched and shop.phone_e164 == "+201112345678" and shop.extra_phones == ["+201212345678", "+201001234567"]
    assert shop.social_links["whatsapp"] == "https://wa.me/201112345678" and shop.email == "info@shop.net"
    assert (shop.contact_name, shop.contact_role, shop.contact_email) == ("Sara Nabil", "Owner / CEO", "sara@shop.net")
    assert shop.store_platform == "Shopify" and shop.has_online_store and shop.target_markets == ["GCC", "Europe"] and shop.company_type == "Exporter"
    assert shop.tier == "Hot" and not got["Gone"].enriched and got["None"].phone_e164 == "+201012345679"


def test_hot_keys_are_split(spark):
    """A phone, a domain and a name that very many records share: adaptive execution splits their rows."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.files.maxPartitionBytes": "64k"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        for hot in ("phone_e164", "domain", "company_name_norm"):
            rows = spark.range(40_000).repartition(8).selectExpr("id AS pos", *[
                f"CASE WHEN id % 2 = 0 THEN 'hot' ELSE concat('k', id) END AS {c}" if c == hot else f"cast(NULL AS string) AS {c}" for c in ("phone_e164", "domain", "company_name_norm", "city")])
            known = spark.range(3000).selectExpr("id AS lead_id", *[f"IF(id = 0, 'hot', concat('k', id)) AS {c}" if c == hot else f"cast(NULL AS string) AS {c}" for c in ("phone_e164", "domain", "company_name_norm", "city")])
            found = rs.match_existing(rows, known)
            assert len(found.collect()) == 40_000
            assert "skew=true" in found._jdf.queryExecution().executedPlan().toString(), hot
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
