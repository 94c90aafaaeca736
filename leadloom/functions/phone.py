"""Phone numbers to E.164 by numbering plans.

The regions of ``rules.NUMBERING`` have a full plan; numbers of other countries, written with ``+`` or ``00``, are
checked by calling code, leading digits (``rules.WORLD_LEADING``) and length (``rules.WORLD_LENGTHS``). All plans are one
pattern, a tree of the digits of calling codes, so a number is only held against the plan of its own code. An
extension after the number is left out; vanity letters are not read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import rules
from leadloom.functions.text import col_of, let

ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
LATIN_DIGITS = "01234567890123456789"
TRUNK_CODES = "|".join([code for code, trunk, _ in rules.NUMBERING.values() if trunk] + [c for c in rules.WORLD_LENGTHS if c not in rules.KEEP_ZERO])


def _plans() -> dict[str, str]:
    """Calling code -> pattern of national numbers."""
    out = {code: plan for code, _, plan in rules.NUMBERING.values()}
    for code, (low, high) in rules.WORLD_LENGTHS.items():
        first = rules.WORLD_LEADING.get(code, r"\d" if code in rules.KEEP_ZERO else "[1-9]")
        out[code] = rf"(?=(?:{first}))\d{{{low},{high}}}"
    return out


def _digit_tree(plans: dict[str, str]) -> str:
    """One pattern for all codes: a branch a digit, at its end the plan, beside it longer codes."""
    ways = [f"(?:{plans['']})$"] if "" in plans else []
    for digit in sorted({code[0] for code in plans if code}):
        ways.append(digit + _digit_tree({code[1:]: plan for code, plan in plans.items() if code[:1] == digit}))
    return f"(?:{'|'.join(ways)})" if len(ways) > 1 else ways[0]


INTERNATIONAL = "^" + _digit_tree(_plans())
EXTENSION = r"(?i)[\s,;]*(?:ext\.?|extension|x|#|;ext=)[\s.:=]*\d{1,7}\s*$"


def e164(raw: Column | str, region: str = rules.DEFAULT_REGION) -> Column:
    """Validated E.164 form of a phone text, or null."""
    code, trunk, plan = rules.NUMBERING[region]
    latin = F.translate(col_of(raw), ARABIC_DIGITS, LATIN_DIGITS)
    written = F.regexp_replace(F.regexp_extract(latin, r"[+0-9](?s:.*)", 0), EXTENSION, "")

    def read(written: Column) -> Column:
        return let(F.regexp_replace(written, r"[^0-9]", ""), lambda digits: number(written, digits))

    def number(written: Column, digits: Column) -> Column:
        plus, zeros = F.startswith(written, F.lit("+")), F.startswith(digits, F.lit("00"))
        abroad = F.when(plus, digits).otherwise(F.substring(digits, 3, 40))
        world = F.regexp_replace(abroad, rf"^({TRUNK_CODES})0", "$1")
        home = F.regexp_replace(digits, "^0", "") if trunk else digits
        bare = F.regexp_replace(digits, rf"^({code})0", "$1")
        return F.when(
            (F.length(digits) <= 17) & ~F.rlike(written, F.lit(r"(?:[A-Za-z][^A-Za-z]*){3}")),
            F.when(plus | zeros, F.when(F.rlike(world, F.lit(INTERNATIONAL)), F.concat(F.lit("+"), world)))
            .when(F.rlike(home, F.lit(f"^(?:{plan})$")), F.concat(F.lit("+" + code), home))
            .when(F.rlike(bare, F.lit(f"^{code}(?:{plan})$")), F.concat(F.lit("+"), bare)),
        )

    return let(written, read)


def valid_phones(candidates: Column, region: str = rules.DEFAULT_REGION) -> Column:
    """Valid numbers of an array of phone texts, distinct, in order."""
    return F.array_distinct(F.array_compact(F.transform(candidates, lambda p: e164(p, region))))
