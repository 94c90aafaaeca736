"""Entity resolution: which lead a sighting belongs to, and what the merged lead looks like.

Sightings arrive in order (``pos``). Each one joins the lead that holds its phone, else the
oldest lead holding its domain, else the oldest lead with the same name and city; otherwise it
founds a lead. A lead fills its blank keys from the sightings it absorbs, so later sightings
can match on keys the founder never had. The outcome depends on the order and is not a
transitive closure.

Done here without walking the records one by one. A lead changes its keys at most three times
(phone, domain, city), so the state over time is a small table of *holdings*: key, lead and
the stretch of positions in which that lead answers for the key. Given holdings, all sightings
are assigned by equi-joins; given an assignment, the holdings follow by aggregation. Starting
from "everybody founds", both steps are repeated until no sighting moves. What happens at a
position only depends on earlier positions, so every round settles at least the first position
still wrong, the fixpoint is unique, and it equals the sequential outcome. Rounds needed are
the length of the longest chain of key hand-overs, a handful on business data, independent of
how many sightings share a key. No component, key or lead is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leadloom import rules
from leadloom.functions import text as tx
from leadloom.session import cut, drop_cut, is_cut

FOREVER = (1 << 62)
# Positions per slice when a key's history is thinned out; bounds the rows of one window group.
SLICE = 1_000_000

KEY_SCHEMA = "pos long, phone string, domain string, name string, city string, seed boolean"


def key_columns(df: DataFrame) -> DataFrame:
    """Match keys of leads or sightings; blank keys are null."""
    return df.select(
        "pos",
        tx.null_if_empty("phone_e164").alias("phone"),
        tx.null_if_empty("domain").alias("domain"),
        tx.null_if_empty("company_name_norm").alias("name"),
        tx.null_if_empty("city").alias("city"),
    )


def match_existing(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Lead each incoming record matches in a fixed table: phone, else domain, else name and city.

    ``incoming`` carries ``pos`` and ``existing`` carries ``lead_id`` besides the key columns.
    Among several leads with one key the lowest id answers. Who answers for a key is written before
    it is joined, so both sides of each join come from exchanges alone and a hot key can be split.
    """
    known = key_columns(existing.withColumnRenamed("lead_id", "pos")).withColumnRenamed("pos", "lead_id")

    def by(kind: str, cols: list[str]) -> DataFrame:
        place = F.coalesce(cols[1], F.lit("")) if len(cols) > 1 else F.lit("")
        filled = known.where(F.col(cols[0]).isNotNull()).groupBy(F.col(cols[0]).alias("key"), place.alias("place"))
        return filled.agg(F.min("lead_id").alias("lead_id")).withColumn("kind", F.lit(kind))

    held = cut(by("phone", ["phone"]).unionByName(by("domain", ["domain"])).unionByName(by("name", ["name", "city"])))

    def of(kind: str, key: str) -> DataFrame:
        return held.where(F.col("kind") == kind).select(F.col("key").alias(key), F.col("place").alias("city_key"), F.col("lead_id").alias(f"by_{key}"))

    probe = key_columns(incoming).select(
        "pos", *[tx.spread_key(k, "pos").alias(k) for k in ("phone", "domain", "name")], F.coalesce("city", F.lit("")).alias("city_key")
    )
    return (
        probe.join(of("phone", "phone").drop("city_key"), "phone", "left")
        .join(of("domain", "domain").drop("city_key"), "domain", "left")
        .join(of("name", "name"), ["name", "city_key"], "left")
        .select(
            "pos",
            F.coalesce("by_phone", "by_domain", "by_name").alias("lead_id"),
            F.when(F.col("by_phone").isNotNull(), "phone")
            .when(F.col("by_domain").isNotNull(), "domain")
            .when(F.col("by_name").isNotNull(), "name_city")
            .alias("matched_on"),
        )
    )


def _leads_of(state: DataFrame) -> DataFrame:
    """Keys each lead holds and since which position, from the present assignment."""

    def first(key: str) -> Column:
        return F.min(F.when(F.col(key).isNotNull(), F.struct("pos", F.col(key).alias("key"))))

    founder = F.col("pos") == F.col("lead")
    return (
        state.groupBy("lead")
        .agg(
            first("phone").alias("phone"),
            first("domain").alias("domain"),
            first("city").alias("city"),
            F.max(F.when(founder, F.struct("name"))).alias("founder"),
        )
        .where(F.col("founder").isNotNull())
        .select(
            "lead",
            F.col("phone.key").alias("phone"), F.col("phone.pos").alias("phone_at"),
            F.col("domain.key").alias("domain"), F.col("domain.pos").alias("domain_at"),
            F.col("city.key").alias("city"), F.col("city.pos").alias("city_at"),
            F.col("founder.name").alias("name"),
        )
    )


def _holdings(leads: DataFrame) -> DataFrame:
    """Who answers for a phone (``p``), a domain (``d``), a name in a city (``n``), and for which positions.

    An entry answers for positions in ``(since, until]``; entries of one key never overlap. The first lead to gain a phone keeps
    it. A domain or a name in a city goes to the oldest lead holding it so far, so it changes only when an older lead gains it.
    Leads founded without a city answer for (name, no city), here ``w``, until a city is filled in: another takes over where it
    waits longer. In each case an entry counts that sets a new low of ``rank`` when a key's history is read in order, so all kinds
    are thinned together: first inside slices of positions, then over the few survivors, so a key held by very many leads is
    thinned by many tasks. The table is written, as joins then read it straight from an exchange, and hot keys can be split.
    """
    none, forever = F.lit(""), F.lit(FOREVER)

    def entry(kind: str, known: Column, key: str, place: Column, since: str, until: Column, rank: Column) -> Column:
        row = F.struct(
            F.lit(kind).alias("kind"), F.col(key).alias("key"), place.alias("place"), F.col(since).alias("since"), until.alias("until"), rank.alias("rank")
        )
        return F.when(known, row)

    waits = F.coalesce("city_at", forever)
    named = F.col("name").isNotNull()
    entries = F.array_compact(F.array(
        entry("p", F.col("phone").isNotNull(), "phone", none, "phone_at", forever, F.lit(0).cast("long")),
        entry("d", F.col("domain").isNotNull(), "domain", none, "domain_at", forever, F.col("lead")),
        entry("n", named & F.col("city").isNotNull(), "name", F.coalesce("city", none), "city_at", forever, F.col("lead")),
        entry("w", named & (waits > F.col("lead")), "name", none, "lead", waits, -waits),
    ))
    rows = leads.select("lead", F.explode(entries).alias("_entry")).select("lead", "_entry.*")
    key = ["kind", "key", "place"]

    def thinned(df: DataFrame, *by: str) -> DataFrame:
        lowest = F.min("rank").over(W.partitionBy(*by).orderBy("since", "lead").rowsBetween(W.unboundedPreceding, -1))
        return df.withColumn("_new", lowest.isNull() | (F.col("rank") < lowest)).where("_new").drop("_new")

    local = thinned(rows.withColumn("_slice", F.floor(F.col("since") / SLICE)), *key, "_slice").drop("_slice")
    history = W.partitionBy(*key).orderBy("since", "lead")
    waiting = F.col("kind") == "w"
    held = thinned(local, *key).withColumns({"_next": F.lead("since").over(history), "_before": F.lag("until").over(history)})
    return cut(held.select(
        F.when(waiting, "n").otherwise(F.col("kind")).alias("kind"), "key", "place",
        F.when(waiting, F.greatest("since", "_before")).otherwise(F.col("since")).alias("since"),
        F.when(F.col("kind").isin("d", "n"), F.coalesce("_next", forever)).otherwise(F.col("until")).alias("until"),
        "lead",
    ))


def _reassign(rows: DataFrame, held: DataFrame) -> DataFrame:
    """New lead of the given sightings (no seeds) from written holdings; the old one in ``lead_before``."""
    pos = F.col("pos")
    out = rows.withColumns(
        {"p_probe": tx.spread_key("phone", "pos"), "d_probe": tx.spread_key("domain", "pos"), "n_probe": tx.spread_key("name", "pos"),
         "city_key": F.coalesce("city", F.lit(""))}
    )
    for kind in "pdn":
        mine = held.where(F.col("kind") == kind).select(*[F.col(c).alias(f"{kind}_{c}") for c in ("key", "place", "since", "until", "lead")])
        meets = (F.col(f"{kind}_probe") == F.col(f"{kind}_key")) & (F.col(f"{kind}_since") < pos) & (pos <= F.col(f"{kind}_until"))
        out = out.join(mine, meets & (F.col("city_key") == F.col("n_place")) if kind == "n" else meets, "left")
    found = F.coalesce("p_lead", "d_lead", "n_lead", "pos")
    return out.select("pos", F.col("lead").alias("lead_before"), found.alias("lead"))


def _affected(state: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Sightings whose outcome may change: those with a key for which the holdings ``before`` and ``after`` a round differ.

    These keys are few after the first rounds, so the semi-joins scan ``state`` without shuffling it
    whenever Spark finds them small enough to broadcast.
    """
    both = before.withColumn("_in", F.lit(-1)).unionByName(after.withColumn("_in", F.lit(1)))
    differ = both.groupBy(*after.columns).agg(F.sum("_in").alias("_in")).where("_in <> 0").select("kind", "key", "place")
    place = F.coalesce("city", F.lit(""))
    asked = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"), (place if kind == "n" else F.lit("")).alias("place"))
        for kind, key in (("p", "phone"), ("d", "domain"), ("n", "name"))
    ])
    open_rows = state.where(~F.col("seed"))
    probes = open_rows.select("pos", F.explode(asked).alias("_probe")).select("pos", "_probe.*").where(F.col("key").isNotNull())
    hits = probes.join(differ, ["kind", "key", "place"], "left_semi").select("pos").distinct()
    return open_rows.join(hits, "pos", "left_semi")


def assign(keys: DataFrame) -> DataFrame:
    """``(pos, lead)``: the founding position of the lead every sighting ends up in.

    ``keys`` has the columns of ``KEY_SCHEMA``; ``seed`` marks leads already stored, which keep
    standing for themselves and must have the lowest positions. Rounds after the first look only at
    sightings that may still move. Tables of finished rounds are deleted.
    """
    state = cut(keys.withColumn("lead", F.col("pos")))
    held = _holdings(_leads_of(state))
    todo, finished = state.where(~F.col("seed")), []
    while True:
        moved = cut(_reassign(todo, held).where(F.col("lead") != F.col("lead_before")).select("pos", F.col("lead").alias("new_lead")))
        drop_cut(*finished)
        if moved.isEmpty():
            drop_cut(moved, held)
            return state.select("pos", "lead")
        after = cut(
            state.join(moved, "pos", "left").withColumn("lead", F.coalesce("new_lead", "lead")).drop("new_lead")
        )
        drop_cut(moved, state)
        new_held = _holdings(_leads_of(after))
        todo, finished = _affected(after, held, new_held), [held]
        state, held = after, new_held


# Fields a lead fills from later sightings only while blank.
FILL_FIELDS = {
    "phone_e164": "string", "phone_raw": "string", "email": "string", "website": "string", "domain": "string",
    "address": "string", "city": "string", "governorate": "string", "country": "string", "category": "string",
    "description": "string", "source": "string", "source_url": "string", "followers": "int",
    "last_activity_date": "date", "rating": "double", "branches": "int", "has_online_store": "boolean",
    "facebook": "string", "linkedin": "string", "store_platform": "string", "contact_name": "string",
    "contact_role": "string", "contact_email": "string",
}


def lead_numbers(sightings: DataFrame, assignment: DataFrame, keep_other_phones: bool = True) -> DataFrame:
    """Every number seen per lead, as ``(lead, number)``."""
    spoken = F.array_compact(F.array("phone_e164")) if keep_other_phones else F.array().cast("array<string>")
    every = F.concat(F.coalesce(F.col("extra_phones"), F.array().cast("array<string>")), spoken)
    return sightings.join(assignment, "pos").select("lead", F.explode(every).alias("number")).distinct()


def merge(
    sightings: DataFrame, assignment: DataFrame,
    keep_score_on_quarantine: bool = True, unknown_type_is_blank: bool = True, keep_other_phones: bool = True,
) -> DataFrame:
    """Merged lead per ``lead`` from its sightings, by aggregation alone.

    Blank fields take the first value in order; type, product, segment, markets and intent the
    latest value; score, tier and reasons the latest rating; sources, extra phones and social
    links are united. A lead's distinct numbers are one cell of its row, whole, as they are one cell of
    export and feed; repeats are removed by many tasks before they meet. With all three switches off a
    broken sighting resets the score, an Unknown type replaces a known one, and a later sighting's own
    phone is not kept as extra.
    """
    rows = sightings.join(assignment, "pos")
    pos = F.col("pos")
    text = {c for c, t in FILL_FIELDS.items() if t == "string"}

    def first_filled(c: str) -> Column:
        known = tx.has_value(c) if c in text else F.col(c).isNotNull()
        return F.min_by(F.col(c), F.when(known, pos))

    def latest(value: Column | str, known: Column) -> Column:
        return F.max_by(F.col(value) if isinstance(value, str) else value, F.when(known, pos))

    rated = (F.col("outcome") == "keep") if keep_score_on_quarantine else F.lit(True)
    typed = tx.has_value("company_type")
    if unknown_type_is_blank:
        typed = typed & (F.col("company_type") != "Unknown")
    founder = pos == F.col("lead")
    merged = rows.groupBy("lead").agg(
        F.count(F.lit(1)).alias("sightings"),
        F.min_by("company_name", "pos").alias("company_name"),
        F.min_by("company_name_norm", "pos").alias("company_name_norm"),
        F.min_by("extra_phones", "pos").alias("_own_numbers"),
        *[first_filled(c).alias(c) for c in FILL_FIELDS],
        F.coalesce(latest("score", rated), F.lit(0)).alias("score"),
        F.coalesce(latest("tier", rated), F.lit("Weak")).alias("tier"),
        latest("score_reasons", rated).alias("score_reasons"),
        F.coalesce(latest("company_type", typed), F.max("company_type")).alias("company_type"),
        latest("product_type", tx.has_value("product_type")).alias("product_type"),
        latest("segment", tx.has_value("segment")).alias("segment"),
        latest("shipping_intent", F.col("shipping_intent").isNotNull()).alias("shipping_intent"),
        latest("target_markets", F.size("target_markets") > 0).alias("target_markets"),
        F.max("enriched").alias("enriched"),
        F.array_sort(F.collect_set("source")).alias("sources_seen"),
        F.max(F.when(founder & (F.col("outcome") == "quarantine"), F.col("reason"))).alias("quarantine_reason"),
        F.max(founder & (F.col("outcome") == "quarantine")).alias("_broken"),
    )
    merged = merged.withColumn("status", F.when(F.col("_broken"), F.lit(rules.QUARANTINED)).otherwise("new"))
    spoken = F.array_compact(F.array("phone_e164")) if keep_other_phones else F.array().cast("array<string>")
    # Numbers and links are reduced per lead and value first, so a busy lead is combined map-side.
    extras = lead_numbers(sightings, assignment, keep_other_phones).groupBy("lead").agg(F.array_sort(F.collect_list("number")).alias("numbers"))
    links = (
        rows.select("lead", "pos", F.explode("social_links").alias("network", "url"))
        .groupBy("lead", "network")
        .agg(F.max_by("url", "pos").alias("url"))
        .groupBy("lead")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("network", "url")))).alias("social_links"))
    )
    return (
        merged.join(extras, "lead", "left")
        .join(links, "lead", "left")
        .withColumn("numbers", F.array_remove("numbers", F.coalesce("phone_e164", F.lit(""))))
        .withColumn("extra_phones", F.when(F.col("sightings") == 1, F.col("_own_numbers")).otherwise(F.col("numbers")))
        .withColumn("extra_phones", F.when(F.size("extra_phones") > 0, F.col("extra_phones")))
        .drop("numbers", "_own_numbers", "_broken")
    )


def upsert(sightings: DataFrame, existing: DataFrame | None = None, **options) -> DataFrame:
    """Stored leads after a batch: see ``fold_batch``."""
    return fold_batch(sightings, existing, **options)[0]


def fold_batch(
    sightings: DataFrame, existing: DataFrame | None = None, run_id: int | None = None, now: Column | None = None,
    top: int | None = None, **policy,
) -> tuple[DataFrame, DataFrame]:
    """(stored leads after a batch, lead of every sighting).

    New leads are inserted, matched ones merged. ``sightings`` are rated leads with ``pos``;
    dropped ones do not take part. A stored lead takes part as the first sighting of itself. New
    ids follow the highest stored id in order of arrival (unique and ordered, not gapless, so no
    global numbering pass is needed); ``top`` names it where ``existing`` is a part of the stored leads
    (see ``sources.lead_table``). The second table holds ``pos``, ``lead_id`` and ``created``.
    """
    batch = sightings.where(F.col("outcome") != "drop")
    if top is None:
        top = 0 if existing is None else existing.agg(F.max("lead_id")).first()[0] or 0
    # The rated batch is read four times below: write it once, unless it is, instead of rating it four times.
    batch = (batch if is_cut(sightings) else cut(batch)).withColumn("pos", F.col("pos") + F.lit(top + 1))
    keys = key_columns(batch).withColumn("seed", F.lit(False))
    everything = batch
    if existing is not None:
        # A stored score stands until a newer rating; stage and reason are taken over further down.
        stored = existing.withColumnRenamed("lead_id", "pos").withColumns(
            {"outcome": F.lit("keep"), "reason": F.lit(None).cast("string")}
        )
        keys = keys.unionByName(key_columns(stored).withColumn("seed", F.lit(True)))
        everything = batch.unionByName(stored.select([c for c in stored.columns if c in batch.columns]), allowMissingColumns=True)
    assignment = assign(keys)
    placed = assignment.where(F.col("pos") > top).select(
        (F.col("pos") - (top + 1)).alias("pos"), F.col("lead").alias("lead_id"), (F.col("pos") == F.col("lead")).alias("created")
    )
    leads = merge(everything, assignment, **policy).withColumnRenamed("lead", "lead_id")
    stamp = F.lit(None).cast("timestamp_ntz") if now is None else now
    crm = {
        "notes": "string", "assigned_to": "string", "last_contact_date": "date", "next_followup_date": "date",
        "pushed_to_sheet": "boolean", "sheet_synced_at": "timestamp_ntz", "run_id": "long",
        "created_at": "timestamp_ntz", "updated_at": "timestamp_ntz",
    }
    leads = leads.withColumn("created", F.col("lead_id") > top)
    if existing is None:
        owned = {c: F.lit(None).cast(t) for c, t in crm.items()}
        leads = leads.withColumns(owned)
    else:
        present = [c for c in (*crm, "sources_seen", "status", "quarantine_reason") if c in existing.columns]
        before = existing.select("lead_id", *[F.col(c).alias(f"_{c}") for c in present])
        leads = leads.join(before, "lead_id", "left")
        leads = leads.withColumns(
            {c: (F.col(f"_{c}") if c in present else F.lit(None)).cast(t) for c, t in crm.items()}
        )
        if "sources_seen" in present:
            leads = leads.withColumn("sources_seen", F.array_sort(F.array_union("sources_seen", F.coalesce("_sources_seen", F.col("sources_seen")))))
        if "status" in present:
            leads = leads.withColumn("status", F.coalesce("_status", "status"))
        if "quarantine_reason" in present:
            leads = leads.withColumn("quarantine_reason", F.coalesce("_quarantine_reason", "quarantine_reason"))
        leads = leads.drop(*[f"_{c}" for c in present])
    leads = leads.withColumns(
        {
            "pushed_to_sheet": F.coalesce("pushed_to_sheet", F.lit(False)),
            "run_id": F.coalesce("run_id", F.lit(run_id).cast("long")),
            "created_at": F.coalesce("created_at", stamp),
            "updated_at": F.when(F.col("created") | (F.col("sightings") > 1), F.coalesce(stamp, F.col("updated_at"))).otherwise(F.col("updated_at")),
        }
    )
    return leads, placed
