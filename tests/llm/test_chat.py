import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.llm import chat, queries


def turns(spark, records):
    rows = chat.canonical_turns(spark.createDataFrame([(i, r) for i, r in enumerate(records)], "n int, record string"), keep=["n"])
    out = {}
    for r in rows.orderBy("n", "part").collect():
        out.setdefault(r.n, [r.layout]).append((r.role, r.text))
    return out


def test_layouts_become_turns(spark):
    records = [
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]},
        {"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "p", "response": "r"}, {"system": "s", "prompt": "p", "response": "r"}, {"completion": "c", "prompt": "p"},
        {"instruction": "i", "input": "more", "output": "o"}, {"instruction": "i", "output": "o"}, {"instruction": "i", "input": "", "output": None},
        {"dialogue": {"turns": [{"speaker": "bot", "utterance": "hi"}]}}, {"role": "tool", "content": "x"},
        {"messages": []}, {"other": 1}, [1],
    ]
    found = turns(spark, [json.dumps(r) for r in records] + ["{", None])
    assert found[0] == ["messages", ("system", "s"), ("user", "u")]
    assert found[1] == ["shared", ("user", "u"), ("assistant", "a")]
    assert found[2] == ["prompt", ("user", "p"), ("assistant", "r")]
    assert found[3] == ["prompt", ("system", "s"), ("user", "p"), ("assistant", "r")]
    assert found[4] == ["completion", ("user", "p"), ("assistant", "c")]
    assert found[5] == ["instruction", ("user", "i\n\nmore"), ("assistant", "o")]
    assert found[6] == ["instruction", ("user", "i"), ("assistant", "o")]
    assert found[7] == ["instruction", ("user", "i"), ("assistant", "")]
    assert found[8] == ["dialogue", ("assistant", "hi")]
    assert found[9] == ["message", ("tool", "x")]
    assert all(found[i] == [None, (None, None)] for i in range(10, 15))


def test_further_fields_parts_and_malformed_records(spark):
    deep = "[" * 100_000 + "]" * 100_000
    records = [
        json.dumps({"id": 7, "meta": {"lang": "en"}, "messages": [{"role": "user", "content": "u", "name": "x"}, {"role": "assistant", "content": None}], "source": None}),
        json.dumps({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "url": "u"}, {"type": "text", "text": "b"}]}]}),
        json.dumps({"messages": [{"role": "user", "content": ["a", "b"]}, {"role": "gpt", "content": "c"}]}),
        json.dumps({"role": "gpt", "content": "x"}), json.dumps({"prompt": "p", "completion": "c", "response": "r"}),
        '{"role": "user", "content": "\\ud800 half \\ud83d\\ude00"}', '{"prompt": "p", "\\udfff": 1}', deep, '{"prompt": ' + deep + "}", '{"messages": [1, {"role": "user", "content": "u"}]}',
    ]
    found = turns(spark, records)
    assert found[0] == ["messages", ("user", "u"), ("assistant", "")]
    assert found[1] == ["parts", ("user", "ab")]
    assert found[2] == ["messages", ("user", "ab"), ("assistant", "c")]
    assert found[3] == ["message", ("assistant", "x")]
    assert found[4] == ["prompt", ("user", "p"), ("assistant", "r")]
    assert found[5] == ["message", ("user", "\ufffd half \U0001F600")]
    assert found[6] == ["prompt_only", ("user", "p")]
    assert found[7] == found[8] == [None, (None, None)]
    assert found[9] == ["messages", ("user", "u")]


def test_fingerprints_follow_paths_alone():
    paths = chat.field_paths({"a": [{"b": 1}, {"c": {"d": None}}], "e": "x"})
    assert paths == {"a[].b", "a[].c.d", "e"}
    assert chat.fingerprint(paths) == chat.fingerprint(reversed(sorted(paths)))
    assert len(chat.registry()) == sum(1 << len(m.optional) for m in chat.MAPPINGS)


HOSTILE = st.lists(st.sampled_from(["\\", "###", "### ", "</turn>", ":", ": ", " </turn>\n", "a", "é", "\n", "😀", "#", "</", "assistant"]), max_size=8).map("".join)


def test_texts_come_back_exactly(spark):
    rows = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(HOSTILE, HOSTILE)
    def collect(role, text):
        rows.append((len(rows), role, text))

    collect()
    made = chat.format_turns(spark.createDataFrame(rows + [(len(rows), None, None)], "i int, role string, text string")).collect()
    for r in made:
        assert chat.read_turn(r.formatted) == (r.role or "", r.text or "")
        assert chat.unescape(r.formatted[r.loss_start:r.loss_end]) == ((r.text or "") if r.role == "assistant" else "")
        assert r.formatted.count(chat.CLOSE) == 1 and r.formatted.startswith(chat.OPEN)
    whole = "".join(r.formatted for r in made)
    assert [x + chat.CLOSE for x in whole.split(chat.CLOSE)[:-1]] == [r.formatted for r in made]


def test_conversations_equal_plain_digest(spark, sf_copy):
    rows = [(1, 1, "assistant", "b" * 200_000), (1, 0, "user", "é\n### assistant: no </turn>"), (1, 2, "assistant", None), (2, None, "user", "x"), (2, 0, "human", "y"),
            (None, 0, "assistant", "z"), (3, 5, None, "w"), (3, 5, None, "w"), (4, 0, "assistant", "tie b"), (4, 0, "assistant", "tie a"), (5, 0, "gpt", "")]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    found = {r.conv_id: r for r in queries.op10_chat_format(spark, sf_copy(conversations=table)).collect()}
    rows += [(-7, i, role, "\\### Assistant: </turn> ok") for i, role in enumerate(("user", "assistant"))]
    convs = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(conv, []).append((role or "", text or ""))
    assert set(found) == set(convs)
    for conv, own in convs.items():
        loss = "".join(t for r, t in own if r == "assistant")
        r = found[conv]
        assert r.n_turns == len(own) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert set(r.conv_id for r in queries.op10_chat_format(spark, sf_copy(conversations=table.where("false"))).collect()) == {-7}
