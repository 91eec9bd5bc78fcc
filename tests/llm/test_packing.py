import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from facetide.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(FILE)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAbB' \t\n\x0b\x1c\x85ßİΣσé́ﬁ½²12<|>endoftxsr.,;—日本😀‍ "), max_size=40), max_size=6))
def test_ids_are_the_tokenizers(texts):
    ids, at = packing.encoder(FILE).encode([t.encode() for t in texts])
    tokenizer = Tokenizer.from_file(FILE)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_forgets_what_is_met_least(whole, words_of, monkeypatch):
    """What a worker remembers stays within bounds, common chunks stay, and the ids are the tokenizer's all the same."""
    monkeypatch.setattr(packing, "CHUNKS_REMEMBERED", 60)
    encoder = packing.Encoder(FILE)
    learnt = []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda new: (learnt.extend(new), learn(new)))
    for n in range(30):
        texts = [" ".join(["Common,", "ünï", *words_of(700 + n, 20), "İΣ <|x", "Common,"]), "", "ünï Common,"]
        ids, at = encoder.encode([t.encode() for t in texts])
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(3)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder._places) <= 60 + 30 and len(encoder._met) == len(encoder._places) == len(encoder._starts) - 1
    assert learnt.count(b"Common,") == learnt.count("ünï".encode()) == 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_completed_fits_and_is_no_worse_than_first_fit(lengths):
    sequence = packing.completed(np.array(lengths, dtype=np.int64), 64)
    filled = np.bincount(sequence, lengths) if lengths else np.zeros(0)
    assert (filled <= 64).all() and (filled > 0).all()
    bins = []
    for x in sorted(lengths, reverse=True):
        for k, room in enumerate(bins):
            if x <= room:
                bins[k] -= x
                break
        else:
            bins.append(64 - x)
    assert len(filled) <= max(len(bins), 1) + 1


@settings(max_examples=120, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(1, 40), max_size=9))
def test_filling_wastes_least(gap, lengths):
    """The bound prunes no filling that wastes less: against all subsets."""
    left = [lengths.count(x) for x in range(gap + 1)]
    largest = lambda x: next((y for y in range(x, 0, -1) if left[y]), 0)
    before = list(left)
    got = packing._filling(gap, largest, left, 1, 10_000)
    sums = {0}
    for x in lengths:
        sums |= {x + y for y in sums}
    assert sum(got) == max(y for y in sums if y <= gap)
    assert left == before and all(got.count(x) <= left[x] for x in got)


def test_usable_room_bounds_what_is_left():
    left = [0, 0, 1, 0, 0, 2, 0]
    largest = lambda x: next((y for y in range(min(x, len(left) - 1), 0, -1) if left[y]), 0)
    assert [packing._usable(room, largest(room), largest, left) for room in (1, 2, 5, 9, 20)] == [0, 2, 5, 9, 12]


def test_search_beats_best_fit():
    lengths = np.array([6, 5, 4, 4, 3, 2], dtype=np.int64)  # best fit alone would put 6 with 4 first, and so does it
    assert packing.completed(lengths, 12).max() == 1


@pytest.mark.parametrize("per_group", [10_000, 7])
def test_pieces_and_sequences(spark, documents, odd_rows, whole, per_group):
    docs = documents(odd_rows)
    out = packing.pack(packing.pieces(docs, FILE, with_ids=True), per_group=per_group).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.id, []).append(r)
    assert set(by_doc) == {i for i, _ in odd_rows}
    for i, text in odd_rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        rows = sorted(by_doc[i], key=lambda r: r.piece)
        if i != 5:
            assert [x for r in rows for x in r.ids] == ids
            assert [r.start for r in rows] == list(range(0, len(ids), 4096))
        for r in rows:
            part = np.array(ids[r.start : r.start + 4096], dtype="<u4")
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(part.tobytes()))
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    if per_group == 10_000:
        assert len(sequences) == -(-sum(r.length for r in out) // 4096)


def test_empty_table(documents):
    assert packing.pack(packing.pieces(documents([]), FILE)).collect() == []
