import pyarrow as pa
from helpers import shingle_set, words
from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.llm import common

TEXT = st.one_of(st.none(), st.text(alphabet="aAbé \t\n\x0b\r\x85 東", max_size=40))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=8), st.integers(0, 3))
def test_words_of_a_column(texts, skipped):
    column = pa.array(["skip"] * skipped + texts, pa.string()).slice(skipped)
    found = common.Words(column, fold=False)
    got = [[found.text(i).decode() for i in range(a, b)] for a, b in zip(found.bounds[:-1], found.bounds[1:])]
    assert got == [words(t) for t in texts]
    numbers = dict(zip((found.text(i) for i in range(len(found.starts))), found.numbers().tolist()))
    assert len(set(numbers.values())) == len(numbers)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=8), st.integers(1, 4))
def test_shingle_sets(texts, size):
    sets = common.shingle_sets(pa.array(texts, pa.string()), size)
    assert [len(s) for s in sets] == [len(shingle_set(t, size)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(set(sets[i].tolist()) & set(sets[j].tolist())) == len(shingle_set(a, size) & shingle_set(b, size))


def test_chunks_hold_every_row():
    texts = ["x" * n for n in (5, 0, 900, 3, 3)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["i", "text"])
    parts = list(common.chunks(iter([batch, batch.slice(0, 0)]), "text", 10))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(6)) and len(parts) > 2
