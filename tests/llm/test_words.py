import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from facetide.llm import words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \t\n\x0b\x0c\ré\xa0 ", max_size=40)), max_size=12)


def split(texts, lower=True):
    return [((t or "").encode().lower() if lower else (t or "").encode()).split() for t in texts]


def same_partition(values, things):
    """Equal things have equal hashes and different things different ones."""
    seen = {}
    assert all(seen.setdefault(t, v) == v for t, v in zip(things, values))
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.booleans(), st.integers(1, 5), st.booleans())
def test_words_and_shingles(texts, lower, k, whole):
    array = W.as_large(pa.array(texts, pa.string()))
    hashes, at = W.word_hashes(array, lower)
    expected = split(texts, lower)
    assert list(np.diff(at)) == [len(x) for x in expected]
    same_partition(hashes.tolist(), [w for x in expected for w in x])
    grams, at = W.shingles(hashes, at, k, whole)
    shingles = [[tuple(x[i : i + k]) for i in range(len(x) - k + 1)] or ([tuple(x)] if whole and x else []) for x in expected]
    assert list(np.diff(at)) == [len(x) for x in shingles]
    same_partition(grams.tolist(), [s for x in shingles for s in x])
    distinct, at = W.distinct_in_texts(grams, at)
    assert list(np.diff(at)) == [len(set(x)) for x in shingles]


def test_slices_cover_all_rows_once():
    texts = W.as_large(pa.array(["x" * n for n in (0, 10, 3, 50, 0, 1)]))
    cuts = list(W.slices(texts, 12))
    assert cuts[0][0] == 0 and cuts[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert list(W.slices(texts.slice(0, 0))) == []
