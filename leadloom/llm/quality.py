"""Quality by weak supervision: rules vote or abstain, and a latent verdict explains the votes.

Every rule reads a few counts of a text and votes good, bad or abstains. Expectation-maximisation over
the votes of all documents estimates how often each rule casts each vote on good and on bad documents,
and the posterior probability of "good" takes the place of a filter that every rule must pass.

The votes of a document are one code in base 3, so the model is learned from one row per code: at most
``3 ** len(RULES)`` rows (59,049) however many documents there are, counted by a map-side combined
aggregation. The same bound holds for the table of posteriors that is joined back.

Defined results: a null or empty text has zero counts, fails the base rules and is not kept. Null ids,
repeated rows and ties need no care, as each row is judged by itself. Other columns of the input are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common

GOOD, BAD, ABSTAIN = 1, 2, 0
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_distinct_words", "n_letter_words", "n_upper_words", "n_end_words", "n_shouts", "n_same_words"]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``value`` is in the bad range, good in the good range, and abstains in between."""

    name: str
    kind: str                  # of bad documents that the rule is made for
    value: str                 # SQL over the counts; null: abstain
    bad: str                   # SQL over v
    good: str


RULES = [
    Rule("symbols", "noise", "n_symbols / n_words", "v > 0.1", "v < 0.02"),
    Rule("repeats", "repetition", "n_repeat_words / n_words", "v > 0.3", "v < 0.1"),
    Rule("dup_lines", "repetition", "IF(n_lines >= 3, n_dup_lines / n_lines, NULL)", "v > 0.5", "v < 0.2"),
    Rule("word_length", "noise", "word_chars / n_words", "v < 3 OR v > 10", "v BETWEEN 4 AND 7"),
    Rule("letters", "noise", "n_letter_words / n_words", "v < 0.8", "v > 0.95"),
    Rule("variety", "repetition", "IF(n_words >= 50, n_distinct_words / sqrt(n_words), NULL)", "v < 3", "v > 6"),
    Rule("capitals", "shouting", "n_upper_words / n_words", "v > 0.3", "v < 0.1"),
    Rule("sentence_ends", "noise", "n_end_words / n_words", "v < 0.01", "v > 0.03"),
    Rule("shouting", "shouting", "n_shouts / n_words", "v > 0.1", "v < 0.01"),
    Rule("echo", "repetition", "n_same_words / n_words", "v > 0.2", "v < 0.05"),
]

# What is believed of the votes (good, bad; an abstention says nothing) before they are seen. A bad document
# is bad in one way, so every kind of rule has a class of its own and the other rules may well find it good.
PRIOR_GOOD, FIRST_GOOD, FIRST_OWN, FIRST_OTHER = 0.7, 0.007, 0.6, 0.02  # chance of a bad vote: good document, own kind, other kind
TRUST = 1.0  # weight of what is believed of good documents (a Beta prior at FIRST_GOOD), as a share of all documents


def _counts(batches: Iterator[pa.RecordBatch], text: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    symbols, upper, lower = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(256, np.int64)
    symbols[list(b"#*$%&|<>")] = 1
    upper[65:91] = 1
    lower[97:123] = 1
    ends = np.zeros(256, bool)
    ends[list(b".!?")] = True

    def sums(flags: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))

    for batch in common.chunks(batches, text):
        texts = batch.column(batch.schema.get_field_index(text))
        words = common.Words(texts, fold=False)
        raw, at, starts, stops, bounds = words.raw, words.at, words.starts, words.ends, words.bounds
        numbers = words.numbers()
        runs = common.windows(numbers, 3)
        chars = sums((raw & 0xC0) != 0x80)          # code points up to a byte
        symbol, capital, small, high = sums(symbols[raw]), sums(upper[raw]), sums(lower[raw]), sums(raw >= 0x80)
        letter = (capital[stops] - capital[starts]) + (small[stops] - small[starts]) + (high[stops] - high[starts]) > 0
        shout = (capital[stops] > capital[starts]) & (small[stops] == small[starts]) & (stops - starts > 1)
        last = raw[stops - 1] if len(stops) else raw[:0]
        bang = (last == 33) & (stops - starts > 1)
        bang[bang] = raw[stops[bang] - 2] == 33
        lines = _lines(raw, at)
        out = {name: np.zeros(batch.num_rows, np.int64) for name in COUNTS}
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            out["n_lines"][i], out["n_dup_lines"][i] = lines(i)
            out["n_symbols"][i] = symbol[at[i + 1]] - symbol[at[i]]
            if a == b:
                continue
            own = numbers[a:b]
            out["n_words"][i] = b - a
            out["word_chars"][i] = (chars[stops[a:b]] - chars[starts[a:b]]).sum()
            out["n_distinct_words"][i] = len(np.unique(own))
            out["n_letter_words"][i] = letter[a:b].sum()
            out["n_upper_words"][i] = shout[a:b].sum()
            out["n_end_words"][i] = ends[last[a:b]].sum()
            out["n_shouts"][i] = bang[a:b].sum()
            out["n_same_words"][i] = (own[1:] == own[:-1]).sum()
            if b - a > 3:
                _, which, times = np.unique(runs[a:b - 2], return_inverse=True, return_counts=True)
                again = times[which] > 1
                if again.any():
                    covered = np.zeros(b - a, bool)
                    for step in range(3):
                        covered[step:b - a - 2 + step] |= again
                    out["n_repeat_words"][i] = covered.sum()
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(out[c]) for c in COUNTS], [*keep, *COUNTS])


def _lines(raw: np.ndarray, at: np.ndarray):
    data = raw.tobytes()

    def of(i: int) -> tuple[int, int]:
        """Lines with a word, and those of them equal to an earlier one."""
        lines = [x for x in data[at[i]:at[i + 1]].split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
        return len(lines), len(lines) - len(set(lines))

    return of


def count_texts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The counts of every text beside the columns ``keep`` (default: ``doc_id``)."""
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*dict.fromkeys([*keep, text]))
    fields = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} long" for c in COUNTS])
    return rows.mapInArrow(lambda batches: _counts(batches, text, keep), fields)


def votes_code(rules: list[Rule] = RULES) -> Column:
    """Votes as one number in base 3."""
    parts = []
    for i, r in enumerate(rules):
        value = f"CASE WHEN n_words > 0 THEN {r.value} END"
        bad, good = (x.replace("v ", f"({value}) ") for x in (r.bad, r.good))
        parts.append(f"{3 ** i} * (CASE WHEN {bad} THEN {BAD} WHEN {good} THEN {GOOD} ELSE {ABSTAIN} END)")
    return F.expr(" + ".join(parts)).cast("int")


def learn(codes: np.ndarray, counts: np.ndarray, rules: list[Rule] = RULES, rounds: int = 200, tolerance: float = 1e-9) -> tuple[np.ndarray, dict]:
    """Posterior of "good" per code, and the model, by EM over the counted codes.

    Classes are "good" and a bad class for each kind of rule. The model has the share of every class and,
    per class and rule, the chance that a vote is bad: the rule's accuracy there. An abstention carries no
    weight. The good class has a Beta prior whose weight follows the corpus, so it stays what its name says at every
    size; every round gains in likelihood times prior.
    """
    votes = (codes[:, None] // 3 ** np.arange(len(rules))) % 3
    good, bad, weight = (votes == GOOD).astype(float), (votes == BAD).astype(float), counts.astype(float)
    kinds = list(dict.fromkeys(r.kind for r in rules))
    rates = np.array([[FIRST_OWN if r.kind == kind else FIRST_OTHER for r in rules] for kind in kinds] + [[FIRST_GOOD] * len(rules)])
    shares = np.array([(1 - PRIOR_GOOD) / len(kinds)] * len(kinds) + [PRIOR_GOOD])
    trust = TRUST * weight.sum()
    gains: list[float] = []
    before, found = -np.inf, np.zeros((len(codes), len(shares)))
    for _ in range(rounds):
        logs = bad @ np.log(rates).T + good @ np.log1p(-rates).T + np.log(shares)
        top = logs.max(axis=1, keepdims=True)
        found = np.exp(logs - top)
        total = found.sum(axis=1, keepdims=True)
        found /= total
        prior = trust * (FIRST_GOOD * np.log(rates[-1]) + (1 - FIRST_GOOD) * np.log1p(-rates[-1])).sum()
        prior += 0.5 * (np.log(rates) + np.log1p(-rates)).sum() + 0.5 * np.log(shares).sum()
        likelihood = float(((weight * (top + np.log(total))[:, 0]).sum() + prior) / max(1.0, weight.sum()))
        gains.append(likelihood)
        if abs(likelihood - before) < tolerance:
            break
        before = likelihood
        mass = found.T * weight
        held = np.array([0.0] * len(kinds) + [trust])[:, None]
        rates = (mass @ bad + 0.5 + held * FIRST_GOOD) / (mass @ (bad + good) + 1 + held)
        shares = (mass.sum(axis=1) + 0.5) / (weight.sum() + 0.5 * len(shares))
    return found[:, -1], {"shares": shares, "bad_vote": rates, "kinds": kinds, "gains": gains}


def posteriors(counted: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``votes, p_good``: the posterior of every code of votes that occurs; at most ``3 ** len(rules)`` rows."""
    found = counted.groupBy(votes_code(rules).alias("votes")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("votes")
    codes, counts = found["votes"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    share, _ = learn(codes, counts, rules)
    return counted.sparkSession.createDataFrame([(int(c), float(s)) for c, s in zip(codes, share)], "votes int, p_good double")


def judge(counted: DataFrame, known: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``counted`` with ``p_good``, ``base_failed`` and ``kept``."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (counted.withColumn("votes", votes_code(rules)).join(F.broadcast(known), "votes", "left").withColumn("base_failed", base)
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5)))


def quality(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Counts and verdict per row of ``docs``, beside the columns ``keep``. The counts are written once."""
    counted = common.cut(count_texts(docs, text, keep))
    return judge(counted, posteriors(counted))


def kept_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept. Texts are read twice, to learn and to judge, rather than written beside their counts."""
    known = posteriors(count_texts(docs, text, []))
    rows, place = common.numbered(docs)
    return common.renamed(judge(count_texts(rows, place[text], list(place.values())), known).where("kept"), place)
