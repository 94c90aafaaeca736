"""Web addresses: resolving links, splitting places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import rules
from leadloom.functions.text import col_of, contains_any, let, null_if_empty


def host_of(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col_of(url), r"^[^:/?#]+://([^/?#]*)", 1))


def path_of(url: Column | str) -> Column:
    return F.regexp_extract(col_of(url), r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def without_dots(path: Column) -> Column:
    """A path from the root without ``.`` and ``..`` steps, however many there are; steps above the root stay at the root."""

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    def walk(parts: Column) -> Column:
        kept = F.aggregate(F.slice(parts, 2, 1 << 30), F.array().cast("array<string>"), step)
        return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))

    dotted = F.rlike(path, F.lit(r"/\.\.?(?:/|$)"))
    return F.when(dotted, let(F.split(path, "/"), walk)).otherwise(path)


def resolve(base: Column | str, href: Column | str) -> Column:
    """Absolute form of a link found on page ``base``."""
    b, h = col_of(base), col_of(href)
    scheme = F.regexp_extract(b, r"^([^:/?#]+:)//", 1)
    root = F.regexp_extract(b, r"^([^:/?#]+://[^/?#]*)", 1)
    page = F.regexp_extract(b, r"^([^?#]*)", 1)
    folder = F.regexp_extract(path_of(b), r"^(.*/)", 1)
    tail = F.regexp_extract(h, r"^[^?#]*((?s:.*))$", 1)
    here = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), F.regexp_extract(h, r"^[^?#]*", 0))
    relative = F.concat(root, without_dots(here), tail)
    return (
        F.when(h == "", b)
        .when(F.rlike(h, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:")), h)
        .when(F.startswith(h, F.lit("//")), F.concat(scheme, h))
        .when(F.startswith(h, F.lit("/")), F.concat(root, without_dots(F.regexp_extract(h, r"^[^?#]*", 0)), tail))
        .when(F.startswith(h, F.lit("?")), F.concat(page, h))
        .when(F.startswith(h, F.lit("#")), F.concat(F.regexp_extract(b, r"^([^#]*)", 1), h))
        .otherwise(relative)
    )


def listing_url(href: Column | str, base: str) -> Column:
    """Listing link without its query, made absolute."""
    cut = F.trim(F.split_part(F.coalesce(col_of(href), F.lit("")), F.lit("?"), F.lit(1)))
    return (
        F.when(cut == "", F.lit(None).cast("string"))
        .when(F.startswith(cut, F.lit("//")), F.concat(F.lit("https:"), cut))
        .when(F.startswith(cut, F.lit("/")), F.concat(F.lit(base.rstrip("/")), cut))
        .otherwise(cut)
    )


def address_place(address: Column | str) -> tuple[Column, Column]:
    """(city, governorate) from the last comma parts of an address."""
    parts = F.filter(
        F.transform(F.split(F.regexp_replace(col_of(address), r"[ .]+$", ""), ","), lambda p: F.trim(p)), lambda p: p != ""
    )
    city = F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2)))
    return city, F.try_element_at(parts, F.lit(-1))


def location_place(location: Column | str) -> tuple[Column, Column]:
    """(city, country) from the first and last comma part; without a comma it is the country."""
    loc = null_if_empty(location)
    parts = F.transform(F.split(loc, ","), lambda p: F.trim(p))
    city = F.when(F.contains(loc, F.lit(",")), F.try_element_at(parts, F.lit(1)))
    return city, F.when(F.contains(loc, F.lit(",")), F.try_element_at(parts, F.lit(-1))).otherwise(loc)


def subpages(links: Column, base: Column | str, limit: int) -> Column:
    """Addresses of pages worth reading on the same host, contact pages first, at most ``limit``.

    Works on the array of one page: candidates are sorted by path to drop repeats, then by
    rank, so a page with very many links costs n log n.
    """
    b = col_of(base)

    def candidate(a: Column) -> Column:
        full = resolve(b, a["href"])
        hay = F.concat(F.lower(path_of(full)), F.lit(" "), F.lower(a["text"]))
        return F.struct(
            F.regexp_replace(path_of(full), r"/+$", "").alias("path"),
            a["pos"].alias("pos"),
            full.alias("full"),
            contains_any(hay, rules.CONTACT_PAGE_HINTS).alias("contact"),
            contains_any(hay, rules.CONTACT_PAGE_HINTS + rules.OTHER_PAGE_HINTS).alias("hinted"),
        )

    pageable = F.filter(links, lambda a: ~F.rlike(a["href"], F.lit(r"^(?:mailto:|tel:|#|javascript:)")))
    good = F.filter(
        F.transform(pageable, candidate),
        lambda c: c["hinted"] & (host_of(c["full"]) == host_of(b)) & (c["path"] != "") & (c["full"] != b),
    )

    def ranked(by_path: Column) -> Column:
        firsts = F.filter(by_path, lambda c, i: (i == 0) | (F.get(by_path, i - 1)["path"] != c["path"]))
        return F.array_sort(
            F.transform(firsts, lambda c: F.struct((~c["contact"]).alias("late"), c["pos"], c["full"]))
        )

    return F.transform(F.slice(let(F.array_sort(good), ranked), 1, limit), lambda c: c["full"])
