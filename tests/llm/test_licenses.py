import random
import re
from collections import defaultdict

import pytest
from helpers import documents

from leadloom.llm import licenses


def words(text):
    """Normalised words without copyright lines, and their lines."""
    out = []
    for i, line in enumerate((text or "").split("\n")):
        if not re.match(r"[ \t\r\x0b\x0c/*#-]*(copyright\b|\(c\)|\u00a9)", line, re.I):
            out += [(w, i) for w in re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", line.translate(FOLD)).split(" ") if w]
    return out


FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(w):
    return set(zip(w, w[1:]))


def plain_scan(text, templates, threshold):
    """The best passage of all, then the best apart from it, and so on: every run of words against every template."""
    w = words(text)
    only = [x for x, _ in w]
    known = [(name, grams([x for x, _ in words(t)])) for name, t in templates]
    found = []
    for a in range(len(w)):
        for b in range(a + 2, len(w) + 1):
            own = grams(only[a:b])
            for name, g in known:
                dice = 2 * len(own & g) / (len(own) + len(g))
                if dice >= threshold - 1e-9:
                    found.append((-dice, -len(g), name, b - a, a, b))
    out = []
    for dice, _, name, _, a, b in sorted(found):
        if all(b <= x or a >= y for x, y, *_ in out):
            out.append((a, b, w[a][1], w[b - 1][1], name, round(-dice, 9)))
    return sorted(out)


def scanned(spark, texts, **options):
    out = defaultdict(list)
    for r in licenses.scan(documents(spark, texts), **options).collect():
        out[r.doc_id].append((r.first_word, r.first_word + r.words, r.first_line, r.last_line, r.licence, round(r.dice, 9)))
    return {k: sorted(v) for k, v in out.items()}


def test_passages_equal_all_runs_of_words(spark):
    rng = random.Random(3)
    vocabulary = "the of use code free may not copy sell a".split()
    templates = [(f"L{k}", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 12)))) for k in range(6)]
    texts = []
    for i in range(60):
        parts = [rng.choice([rng.choice(templates)[1], rng.choice(vocabulary), "zz", "\n", "\n\n", "\nCopyright (c) X\n", "The USE,"]) for _ in range(rng.randint(1, 9))]
        texts.append((i, " ".join(parts)))
    want = {i: p for i, t in texts if (p := plain_scan(t, templates, 0.8))}
    assert scanned(spark, texts, templates=templates, threshold=0.8) == want and len(want) > 20


MIT = licenses.TEMPLATES[0][1]
PARAGRAPHS = MIT.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
CODE = "def f(x): return x\n" * 60


def test_licences_as_they_stand_in_files(spark):
    full = dict(licenses.TEMPLATES)
    texts = [
        (1, "MIT License\n\nCopyright (c) 2020 Someone\n\n" + PARAGRAPHS + "\n\n" + CODE), (2, "This code is now Released under the MIT License. Have fun."),
        (3, CODE + "# " + full["BSD-2-Clause"].replace(". ", ".\n# ")), (4, full["Zlib"] + "\n\n" + full["Unlicense"]), (5, MIT.replace("software", "program", 1) + "\n\nrest of the text"),
        (6, None), (7, ""), (8, "under the of a licence"), (9, "This work is licensed under the GNU General Public License, version 2."), (10, "x " * 50_000 + "\nReleased under the MIT License."),
        (11, "Released\n\nunder the MIT\n\nLicense."), (None, "Released under the MIT License."), (12, "Released under the MIT License. " * 3), (13, "\u00e9 \u00fc Released under the MIT License. \u00df"), (14, full["BSD-3-Clause"]),
    ]
    found = {k: [x[4] for x in v] for k, v in scanned(spark, texts + texts[:1]).items()}
    assert found == {1: ["MIT", "MIT"], 2: ["MIT"], 3: ["BSD-2-Clause"], 4: ["Zlib", "Unlicense"], 5: ["MIT"], 9: ["GPL-3.0"], 10: ["MIT"], 11: ["MIT"], None: ["MIT"], 12: ["MIT"] * 3, 13: ["MIT"], 14: ["BSD-3-Clause"]}
    spans = scanned(spark, texts)
    assert spans[11][0][2:4] == (0, 4) and spans[1][0][5] > 0.98


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.95])
def test_bounds_lose_nothing(threshold):
    known = licenses.Templates(threshold=threshold)
    for size in (1, 4, 7, 160):
        for n in range(1, 400):
            for common in range(min(n, size) + 1):
                if 2 * common / (n + size) >= threshold:
                    assert common >= known.fewest(size)


def test_endless_repeats_end_soon():
    raw = b"under the mit license " * 50_000
    assert len(licenses.scan_text(raw[:22 * 4], licenses.Templates())) == 4
    assert len(licenses.passages(licenses.common.windows(licenses.words_of(raw)[0], 2), licenses.Templates().grams[0], 0.8)) < 200_000


def test_empty_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "Released under the MIT License.", "x")], "doc_id long, text string, licence string")
    assert licenses.scan(rows).count() == 1 and licenses.scan(rows.where("false")).count() == 0
