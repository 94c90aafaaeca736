"""ANSI/DuckDB SQL texts of the engine's rules, used only to check results.

They are written from the rule tables, independent of the Column expressions, so a wrong
expression shows as a difference.
"""

from __future__ import annotations

from leadloom import rules


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def any_of(text: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(n)})" for n in needles) + ")"


def hits(text: str, needles: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {q(n)}) AS INT)" for n in needles) + ")"


def filled(c: str) -> str:
    return f"({c} IS NOT NULL AND {c} <> '')"


def e164(raw: str, region: str = rules.DEFAULT_REGION) -> str:
    """One SQL expression; the written part and its digits are taken once through a one-element list."""
    code, trunk, plan = rules.NUMBERING[region]
    trunks = "|".join([c for c, t, _ in rules.NUMBERING.values() if t] + [c for c in rules.WORLD_LENGTHS if c not in rules.KEEP_ZERO])
    world = "|".join([f"{c}(?:{p})" for c, _, p in rules.NUMBERING.values()]
                     + [f"{c}\\d{{{a},{b}}}" for c, (a, b) in rules.WORLD_LENGTHS.items()])
    leading = "|".join([c for c, _, _ in rules.NUMBERING.values()] + [f"{c}(?:{rules.WORLD_LEADING.get(c, '[0-9]' if c in rules.KEEP_ZERO else '[1-9]')})" for c in rules.WORLD_LENGTHS])
    home = "regexp_replace(x.d, '^0', '')" if trunk else "x.d"
    abroad = f"regexp_replace(CASE WHEN x.w LIKE '+%' THEN x.d ELSE substr(x.d, 3) END, '^({trunks})0', '\\1')"
    bare = f"regexp_replace(x.d, '^({code})0', '\\1')"
    written = f"regexp_replace(regexp_extract({raw}, '[+0-9](?s:.*)'), '(?i)[\\s,;]*(?:ext\\.?|extension|x|#|;ext=)[\\s.:=]*\\d{{1,7}}\\s*$', '')"
    return (
        f"list_transform([{{'w': {written}, 'd': regexp_replace({written}, '[^0-9]', '', 'g')}}], lambda x: "
        f"CASE WHEN length(x.d) > 17 OR regexp_matches(x.w, '(?:[A-Za-z][^A-Za-z]*){{3}}') THEN NULL "
        f"WHEN x.w LIKE '+%' OR x.d LIKE '00%' THEN CASE WHEN regexp_full_match({abroad}, '(?:{world})') AND regexp_matches({abroad}, '^(?:{leading})') THEN '+' || {abroad} END "
        f"WHEN regexp_full_match({home}, '(?:{plan})') THEN '+{code}' || {home} "
        f"WHEN regexp_full_match({bare}, '{code}(?:{plan})') THEN '+' || {bare} END)[1]"
    )


def valid_phones(array: str) -> str:
    """Distinct valid numbers of a list in order."""
    return distinct(f"list_filter(list_transform({array}, lambda p: {e164('p')}), lambda p: p IS NOT NULL)")


def distinct(array: str) -> str:
    """Distinct elements in order of first occurrence."""
    return f"list_transform([{array}], lambda a: list_filter(a, lambda v, i: list_position(a, v) = i))[1]"


def name_key(name: str) -> str:
    return f"trim(regexp_replace(lower({name}), '[^\\p{{L}}\\p{{N}}_\\x{{0600}}-\\x{{06FF}}]+', ' ', 'g'))"


def domain(url: str) -> str:
    full = f"CASE WHEN contains({url}, '://') THEN trim({url}) ELSE 'http://' || trim({url}) END"
    authority = f"lower(regexp_extract({full}, '^[^:/?#]+://([^/?#]*)', 1))"
    return f"CASE WHEN trim({url}) <> '' THEN nullif(regexp_replace(split_part({authority}, ':', 1), '^www\\.', ''), '') END"


def cell_email(cell: str) -> str:
    """RE2 has no back-reference: a doubled ending is found by comparing the last two labels."""
    tokens = f"string_split_regex(lower(trim(replace({cell}, '%20', ' '))), '[\\s,;|]+')"
    last = "regexp_extract(t, '(\\.[a-z]{2,6})$', 1)"
    repaired = f"CASE WHEN {last} <> '' AND ends_with(t, {last} || {last}) AND contains(t, '@') THEN left(t, length(t) - length({last})) ELSE t END"
    junk = any_of("t", rules.CELL_EMAIL_JUNK)
    return (
        f"list_filter(list_transform(list_transform({tokens}, lambda t: trim(t, '.')), lambda t: {repaired}), "
        f"lambda t: regexp_full_match(t, '[a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.[a-z]{{2,}}') AND NOT {junk})[1]"
    )


def has_store(low: str) -> str:
    return any_of(low, rules.STORE_MARKERS)


def company_type(low: str, category: str) -> str:
    kinds = list(rules.COMPANY_TYPE_SIGNALS)
    counts = {k: hits(low, v) for k, v in rules.COMPANY_TYPE_SIGNALS.items()}
    counts["Ecommerce"] = f"({counts['Ecommerce']} + CAST({has_store(low)} AS INT))"
    rows = ", ".join(f"{{'h': {counts[k]}, 'o': {-i}, 'k': {q(k)}}}" for i, k in enumerate(kinds))
    strong = any_of(low, rules.STRONG_FORWARDER)
    cat = f"lower(coalesce({category}, ''))"
    return (
        f"list_transform([[{rows}]], lambda r: list_transform([{{'b': list_max(r), "
        f"'c': list_max(list_filter(r, lambda s: s.k <> 'Freight Forwarder'))}}], lambda z: "
        f"CASE WHEN z.b.h > 0 AND z.b.k = 'Freight Forwarder' AND NOT {strong} AND z.c.h > 0 THEN z.c.k "
        f"WHEN z.b.h > 0 THEN z.b.k "
        f"WHEN contains({cat}, 'freight') OR contains({cat}, 'forwarder') THEN 'Freight Forwarder' "
        f"ELSE 'Unknown' END)[1])[1]"
    )


def intent(low: str, kind: str) -> str:
    points = " + ".join(f"CASE WHEN contains({low}, {q(p)}) THEN {n} ELSE 0 END" for p, n in rules.INTENT_SIGNALS.items())
    base = " ".join(f"WHEN {q(k)} THEN {n}" for k, n in rules.TYPE_BASE_INTENT.items())
    return f"least({points} + CASE WHEN {has_store(low)} THEN {rules.STORE_INTENT_BONUS} ELSE 0 END + CASE {kind} {base} ELSE 0 END, {rules.MAX_INTENT})"


def intent_phrases(low: str) -> str:
    items = ", ".join(f"CASE WHEN contains({low}, {q(p)}) THEN {q(p)} END" for p in rules.INTENT_SIGNALS)
    return f"array_to_string(list_sort(list_filter([{items}], lambda v: v IS NOT NULL)), ',')"


def platform(low: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(low, m)} THEN {q(n)}" for n, m in rules.STORE_PLATFORMS.items()) + " END"


def markets(low: str) -> str:
    padded = f"(' ' || {low} || ' ')"
    items = ", ".join(f"CASE WHEN {any_of(padded, w)} THEN {q(m)} END" for m, w in rules.MARKET_SIGNALS.items())
    return f"list_filter([{items}], lambda v: v IS NOT NULL)"


def invalid_reason() -> str:
    chars = "length(regexp_replace(company_name, '[^\\p{L}\\p{N}_\\x{0600}-\\x{06FF}]', '', 'g'))"
    contact = " OR ".join(filled(c) for c in ("phone_e164", "email", "website", "domain"))
    return (
        f"CASE WHEN trim(company_name) = '' THEN 'no_identity' WHEN {chars} < 2 THEN 'junk_name' "
        f"WHEN NOT ({contact}) THEN 'no_contact' "
        f"WHEN {filled('phone_e164')} AND NOT regexp_full_match(phone_e164, '\\+[0-9]{{6,15}}') THEN 'bad_phone' END"
    )


def filter_reason(cutoff_year: int, min_followers: int, phone: bool = False, site: bool = False, activity: bool = False) -> str:
    parts = []
    if phone:
        parts.append(f"WHEN NOT {filled('phone_e164')} THEN 'no_phone'")
    if site:
        parts.append(f"WHEN NOT ({filled('website')} OR {filled('domain')}) THEN 'no_website'")
    contact = " OR ".join(filled(c) for c in ("phone_e164", "email", "website", "domain"))
    parts.append(f"WHEN NOT ({contact}) THEN 'no_contact'")
    parts.append(f"WHEN year(last_activity_date) <= {cutoff_year} THEN 'inactive'")
    if activity:
        parts.append("WHEN last_activity_date IS NULL THEN 'activity_unknown'")
    parts.append(f"WHEN followers < {min_followers} THEN 'low_followers'")
    return "CASE " + " ".join(parts) + " END"


def segment() -> str:
    cfg = rules.SEGMENTS
    words = "lower(concat_ws(' ', nullif(category, ''), nullif(company_name, ''), nullif(description, ''), nullif(product_type, '')))"
    cat = "trim(coalesce(category, ''))"
    kind = "coalesce(company_type, '')"
    return (
        f"CASE WHEN {kind} = 'Freight Forwarder' THEN 'competitor' "
        f"WHEN {kind} IN {in_list(rules.PRODUCT_TYPES)} OR {cat} IN {in_list(cfg['p1_categories'])} THEN 'P1' "
        f"WHEN coalesce(has_online_store, false) OR {filled('store_platform')} OR {kind} = 'Ecommerce' OR {cat} IN {in_list(cfg['p2_categories'])} THEN 'P2' "
        f"WHEN {kind} = 'Exporter' OR coalesce(source, '') IN {in_list(cfg['p3_sources'])} OR {cat} IN {in_list(cfg['p3_categories'])} THEN 'P3' "
        f"WHEN {any_of(words, cfg['service_keywords'])} THEN 'service' ELSE 'other' END"
    )


def band() -> str:
    cat = "lower(coalesce(category, ''))"
    kind = "coalesce(company_type, '')"
    return (
        f"CASE WHEN segment = 'competitor' OR {kind} = 'Freight Forwarder' THEN 'competitor' "
        f"WHEN segment = 'service' THEN 'service' WHEN {kind} IN {in_list(rules.MAKER_TYPES)} THEN 'product_maker' "
        f"WHEN {kind} IN {in_list(rules.TRADER_TYPES)} THEN 'trader' WHEN {kind} = 'Ecommerce' THEN 'ecommerce' "
        f"WHEN segment = 'P1' THEN 'trader' WHEN segment = 'P2' THEN 'ecommerce' WHEN segment = 'P3' THEN 'general_trading' "
        f"WHEN contains({cat}, 'import') AND contains({cat}, 'export') THEN 'general_trading' ELSE 'default' END"
    )


def band_parts() -> list[tuple[str, str]]:
    """(factor, points) expressions of the band engine, in breakdown order."""
    bonus = rules.SCORING["bonuses"]
    open_band = f"band NOT IN {in_list(rules.FLAT_BANDS)}"
    foreign = "len(list_filter(coalesce(target_markets, []), lambda m: NOT starts_with(m, 'Local'))) > 0"
    tests = {
        "has_website": f"{filled('website')} OR {filled('domain')}",
        "has_online_store": "coalesce(has_online_store, false)",
        "ships": f"{foreign} OR coalesce(shipping_intent, 0) >= {rules.SHIPS_INTENT}",
        "has_phone": filled("phone_e164"),
        "has_email": filled("email"),
        "has_contact_person": f"{filled('contact_name')} OR {filled('contact_role')}",
        "has_linkedin": filled("linkedin"),
    }
    base = "CASE band " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in rules.SCORING["base_bands"].items()) + " END"
    return [("'band:' || band", base)] + [
        (q(k), f"CASE WHEN {open_band} AND ({t}) THEN {bonus[k]} ELSE 0 END") for k, t in tests.items()
    ]


def score_of(parts: list[tuple[str, str]], top: int = 100) -> str:
    return f"least({' + '.join(p for _, p in parts)}, {top})"


def reasons_of(parts: list[tuple[str, str]]) -> str:
    """Breakdown as text ``factor=points``, joined by commas."""
    items = ", ".join(f"CASE WHEN {p} <> 0 THEN {n} || '=' || CAST({p} AS VARCHAR) END" for n, p in parts)
    return f"array_to_string(list_filter([{items}], lambda v: v IS NOT NULL), ',')"


def tier(score: str, tiers: dict[str, int]) -> str:
    ordered = sorted(tiers.items(), key=lambda t: -t[1])
    return "CASE " + " ".join(f"WHEN {score} >= {n} THEN {q(k)}" for k, n in ordered) + " ELSE 'Weak' END"


def visible_text(html: str) -> str:
    hidden = (
        "(?is)<!--.*?(?:-->|$)|<script\\b[^>]*>.*?(?:</script\\s*>|$)|<style\\b[^>]*>.*?(?:</style\\s*>|$)"
        "|<template\\b[^>]*>.*?(?:</template\\s*>|$)"
    )
    bare = f"regexp_replace(regexp_replace({html}, '{hidden}', '', 'g'), '<[/!?a-zA-Z][^>]*>', chr(1), 'g')"
    for name in "lt gt quot apos nbsp copy reg trade middot bull hellip ndash mdash lsquo rsquo ldquo rdquo laquo raquo times deg euro pound eacute egrave agrave ouml uuml auml szlig ntilde".split():  # those the pages may hold
        bare = f"replace({bare}, '&{name};', {q(rules.NAMED_ENTITIES[name + ';'])})"
    bare = f"replace({bare}, '&amp;', '&')"
    ends = "'^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$'"
    return f"array_to_string(list_filter(list_transform(string_split({bare}, chr(1)), lambda p: regexp_replace(p, {ends}, '', 'g')), lambda p: p <> ''), ' ')"
