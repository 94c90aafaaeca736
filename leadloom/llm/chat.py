"""Chat formatting: records of any known layout to canonical turns, turns to marked text with a loss mask.

*Schema fingerprinting.* A record is JSON. Its nested field paths (lists as ``[]``) are cut to those that a mapping
names and hashed; the fingerprint picks the declarative mapping that says where turns, roles and texts are found.
Further fields do not matter, and of several mappings that fit the one with the most required paths is taken. No
layout is guessed from contents; a record of an unknown layout keeps the fingerprint of all its paths and has no
turns. Contents in parts (a list of texts, or of objects with a ``text``) are the parts' texts, one after the other.

*Template.* A turn is ``### role: text </turn>`` and a line end. Inside roles and texts a backslash is put
before every backslash, ``###``, ``</turn>`` and, in roles, ``:``, so marks never occur there unescaped and
reading back returns every text exactly. The loss mask of a turn is the range of its escaped text if the
role is trained on, else empty.

Turns are formatted row by row. Conversations are put in order by one sort and read as a stream, so a
conversation of any length takes no more memory than its longest turn.

Defined results: a null text is empty, a null role is empty and not trained on; a null conversation id is a
conversation of its own. Turns equal in number are ordered by role and text, null numbers come first, and
repeated rows are repeated turns. Text that is no JSON, or nested too deep to read, is a record without layout; halves of
surrogate pairs become U+FFFD. Very long texts are read whole. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", " </turn>\n"
TRAINED = ("assistant",)


# ------------------------------------------------------------------ layouts
@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``fields``: (path, role) of top-level texts in order of speech, or ``turns`` with the paths of role and text
    inside each element. ``join``: paths whose texts are one turn, parted by a blank line.
    """

    name: str
    paths: tuple[str, ...]                       # required paths
    optional: tuple[str, ...] = ()
    fields: tuple[tuple[str, str], ...] = ()
    turns: str = ""
    role: str = ""
    text: str = ""
    join: tuple[tuple[str, str], ...] = ()       # (path, path it is added to)


MAPPINGS = [
    Mapping("messages", ("messages[].role", "messages[].content"), turns="messages", role="role", text="content"),
    Mapping("parts", ("messages[].role", "messages[].content[].text"), turns="messages", role="role", text="content"),
    Mapping("listed", ("messages[].role", "messages[].content[]"), turns="messages", role="role", text="content"),
    Mapping("shared", ("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value"),
    Mapping("message", ("role", "content"), fields=(("content", "@role"),)),
    Mapping("prompt", ("prompt", "response"), ("system",), (("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Mapping("prompt_only", ("prompt",), (), (("prompt", "user"),)),
    Mapping("response_only", ("response",), (), (("response", "assistant"),)),
    Mapping("completion", ("prompt", "completion"), (), (("prompt", "user"), ("completion", "assistant"))),
    Mapping("instruction", ("instruction", "output"), ("input", "system"),
            (("system", "system"), ("instruction", "user"), ("output", "assistant")), join=(("input", "instruction"),)),
    Mapping("instruction_only", ("instruction",), (), (("instruction", "user"),)),
    Mapping("output_only", ("output",), (), (("output", "assistant"),)),
    Mapping("dialogue", ("dialogue.turns[].speaker", "dialogue.turns[].utterance"), turns="dialogue.turns", role="speaker", text="utterance"),
]
#: Names that layouts use for the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def field_paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value, lists as ``[]``; of lists, the paths of all elements together."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(field_paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha1("\n".join(sorted(paths)).encode("utf-8", "replace")).hexdigest()[:16]


def registry(mappings: list[Mapping] = MAPPINGS) -> dict[str, Mapping]:
    """Mapping of every fingerprint: each choice of optional fields is a layout of its own."""
    out = {}
    for m in mappings:
        for k in range(1 << len(m.optional)):
            extra = [p for i, p in enumerate(m.optional) if k >> i & 1]
            out[fingerprint([*m.paths, *extra])] = m
    return out


def layout_of(paths: frozenset[str], mappings: list[Mapping], known: dict[str, Mapping]) -> tuple[Mapping | None, str]:
    """Mapping whose fingerprint the paths have, once cut to those it names, and that fingerprint."""
    for m in sorted(mappings, key=lambda m: -len(m.paths)):
        mark = fingerprint(paths & {*m.paths, *m.optional})
        if known.get(mark) is m:
            return m, mark
    return None, fingerprint(paths)


_HALF = re.compile("[\ud800-\udfff]")


def _texts(value) -> str:
    if isinstance(value, list):
        value = "".join(_texts(x.get("text") if isinstance(x, dict) else x) for x in value)
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return _HALF.sub("\ufffd", text)


def turns_of(record: dict, m: Mapping, roles: dict[str, str] = ROLES) -> list[tuple[str, str]]:
    def named(role) -> str:
        role = _texts(role)
        return roles.get(role, role)

    if m.turns:
        for part in m.turns.split("."):
            record = record[part]
        return [(named(t.get(m.role)), _texts(t.get(m.text))) for t in record if isinstance(t, dict)]
    added = {}
    for path, to in m.join:
        if record.get(path):
            added[to] = "\n\n" + _texts(record[path])
    return [(named(record.get(role[1:])) if role[0] == "@" else role, _texts(record[path]) + added.get(path, "")) for path, role in m.fields if path in record]


def canonical_turns(records: DataFrame, record: str = "record", keep: list[str] | None = None, mappings: list[Mapping] = MAPPINGS, roles: dict[str, str] = ROLES) -> DataFrame:
    """Rows of JSON text -> ``keep`` columns, ``layout`` (null: unknown), ``fingerprint`` and one row per turn:
    ``part`` (its place in the record), ``role``, ``text``. A record without turns gives one row with null ``part``.
    ``roles``: the canonical role for names that layouts use; others stay as they are."""
    keep = keep or []
    known = registry(mappings)
    rows = records.select(*keep, F.col(record).alias("_record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts: dict[frozenset, tuple] = {}
        for batch in batches:
            at, out = [], []
            for i, raw in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                try:
                    value = json.loads(raw) if raw is not None else None
                    paths = frozenset(field_paths(value)) if isinstance(value, dict) else None
                except (ValueError, RecursionError):
                    paths = None
                if len(layouts) > 10_000:
                    layouts.clear()
                if paths is not None and paths not in layouts:
                    layouts[paths] = layout_of(paths, mappings, known)
                m, mark = layouts[paths] if paths is not None else (None, None)
                for part, (role, text) in enumerate(turns_of(value, m, roles)) if m else ():
                    at.append(i)
                    out.append((m.name, mark, part, role, text))
                if not m or not at or at[-1] != i:
                    at.append(i)
                    out.append((m.name if m else None, mark, None, None, None))
            columns = list(zip(*out)) if out else [[]] * 5
            take = pa.array(at, pa.int64())
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(j).take(take) for j in range(len(keep))] + [pa.array(c, t) for c, t in zip(columns, types)], [*keep, "layout", "fingerprint", "part", "role", "text"])

    fields = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + ["layout string, fingerprint string, part int, role string, text string"])
    return rows.mapInArrow(run, fields)


# ------------------------------------------------------------------ template
def escape(text: Column, in_role: bool = False) -> Column:
    marks = r"(\\|###|</turn>|:)" if in_role else r"(\\|###|</turn>)"
    return F.regexp_replace(F.coalesce(text, F.lit("")), marks, r"\\$1")


def format_turns(turns: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """``turns`` (``role``, ``text``) with ``formatted`` and the loss mask ``loss_start``, ``loss_end``: code points in it."""
    head = F.concat(F.lit(OPEN), escape(F.col("role"), in_role=True), F.lit(": "))
    rows = turns.withColumn("_head", head).withColumn("_body", escape(F.col("text")))
    rows = rows.withColumn("formatted", F.concat("_head", "_body", F.lit(CLOSE)))
    rows = rows.withColumn("loss_start", F.length("_head"))
    masked = F.when(F.col("role").isin(*trained), F.length("_body")).otherwise(0)
    return rows.withColumn("loss_end", F.col("loss_start") + masked).drop("_head", "_body")


_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not formatted.endswith(CLOSE) or not (m := _TURN.fullmatch(formatted[:-len(CLOSE)])):
        raise ValueError(f"not a turn: {formatted[:80]!r}")
    return unescape(m[1]), unescape(m[2])


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Formatted turns in order of conversations -> a digest of each conversation, read from the formatted text."""
    now, state = None, None

    def close() -> tuple:
        return (now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    def batch_of(rows: list) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in _DIGEST.split(", ")])

    for batch in batches:
        done = []
        for conv, formatted, start, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if now != (conv,):
                if now:
                    done.append(close())
                now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = read_turn(formatted)
            loss = unescape(formatted[start:end])
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += len(formatted)
        if done:
            yield batch_of(done)
    if now:
        yield batch_of([close()])


def conversations(formatted: DataFrame) -> DataFrame:
    """Digest of each conversation from its formatted turns (``conv_id, turn, part, role, text, formatted, loss_*``)."""
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "role", "text")
    return rows.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(_read_back, _DIGEST)
