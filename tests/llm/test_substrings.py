import numpy as np
import pytest

from facetide.llm import substrings as S


def test_compact_windows_are_the_tree_nodes():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, width, bits = int(rng.integers(0, 120)), int(rng.integers(1, 20)), 10
        v = (rng.integers(1, 50, n).astype(np.uint64) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
        divider = rng.random(n) < 0.03
        v[divider] &= np.uint64(1023)
        expected = []
        for c in np.flatnonzero(~divider):
            a = b = c
            while a > 0 and v[a - 1] > v[c]:
                a -= 1
            while b < n - 1 and v[b + 1] > v[c]:
                b += 1
            if b - a + 1 >= width:
                expected.append((a, c, b))
        assert sorted(zip(*(x.tolist() for x in S.compact_windows(v, width, bits)))) == sorted(expected)


def repeats(rows, least=50):
    """For each text the places of ``least``-word windows that a text of smaller id holds."""
    seen, out = {}, {}
    for i, text in sorted((r for r in dict(rows).items() if r[0] is not None), key=lambda r: r[0]):
        w = (text or "").encode().lower().split()
        for k in range(len(w) - least + 1):
            if seen.setdefault(tuple(w[k : k + least]), i) != i:
                out.setdefault(i, []).append(k)
    return out


def holds_all(found, rows):
    spans = {}
    for r in found:
        spans.setdefault(r.id, []).append((r.start, r.end))
    for i, places in repeats(rows).items():
        for k in places:
            assert any(a <= k + 2 and k + 48 <= b for a, b in spans.get(i, [])), (i, k)


def test_planted_passages(documents, words_of):
    """A passage of many texts, passages that texts share beside it, short lines, an edited passage."""
    common, line = words_of(1, 60), words_of(2, 12)
    pair, edited = words_of(3, 55), words_of(4, 100)
    rows = [(i, " ".join(words_of(50 + i, 30) + common + words_of(90 + i, 40))) for i in range(12)]
    rows += [(100 + i, " ".join(words_of(150 + i, 80) + line + words_of(190 + i, 80))) for i in range(12)]
    rows += [(200 + i, " ".join(words_of(250 + i, 20) + line + pair + words_of(290 + i, 20))) for i in range(3)]
    changed = list(edited)
    changed[30] = changed[70] = "other"
    rows += [(300, " ".join(words_of(301, 30) + edited)), (301, " ".join(changed + words_of(302, 30)))]
    found = S.shared_passages(documents(rows)).collect()
    holds_all(found, rows)
    assert {r.id for r in found} == {*range(1, 12), 201, 202, 301}
    assert all(r.head < r.id and r.similarity >= 0.8 and r.end - r.start >= 50 for r in found)
    whole = [r for r in found if r.id == 301 and r.end - r.start >= 95]
    assert whole and whole[0].head == 300


def test_short_passages_with_a_word_put_in_or_left_out(documents, words_of):
    """Every pair of texts whose planted passages are alike by brute force is found."""
    rows, expected = [], set()
    for n in range(60):
        size, at = 50 + n % 11, 11 + (7 * n) % 28
        passage = words_of(1000 + n, size + n % 2)
        edited = passage[:at] + passage[at + 1 :] if n % 2 else [*passage[:at], "inserted", *passage[at:]]
        one, two = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (passage, edited))
        if 100 * len(one & two) >= 80 * len(one | two):
            expected.add((2 * n + 1, 2 * n))
        rows.append((2 * n, " ".join(words_of(2000 + n, 40 + n) + passage + words_of(3000 + n, 70))))
        rows.append((2 * n + 1, " ".join(words_of(4000 + n, 65) + edited + words_of(5000 + n, 30 + n))))
    found = {(r.id, r.head) for r in S.shared_passages(documents(rows)).collect()}
    assert len(expected) > 50 and found == expected


def test_odd_rows_and_cut(documents, odd_rows):
    docs = documents(odd_rows)
    found = S.shared_passages(docs)
    holds_all(found.collect(), odd_rows)
    assert {r.id for r in found.collect()} == {5, 9}
    out = S.cut_passages(docs, found, n_chars="n_chars")
    assert out.columns == docs.columns and out.count() == docs.count()
    after = {r.doc_id: r for r in out.collect()}
    before = dict(odd_rows)
    assert all(after[i].text == before[i] for i in before if i not in (5, 9))
    assert after[5].text.split() == [] and after[5].n_chars == len(after[5].text)
    assert after[9].text.split() == ["tail"]


def test_empty_table(documents):
    docs = documents([])
    assert S.shared_passages(docs).collect() == []
    assert S.cut_passages(docs, S.shared_passages(docs)).collect() == []


@pytest.mark.parametrize("name", ["sf0.001"])
def test_given_documents(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    holds_all(S.shared_passages(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_nearest_smaller_places():
    rng = np.random.default_rng(8)
    for v in (rng.permutation(300), np.arange(50), np.arange(50)[::-1].copy(), np.zeros(0, np.int64), np.array([4])):
        assert S._smaller_before(v).tolist() == [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(len(v))]


def test_windows_of_a_slice_get_their_keys_together():
    """Least hashes are made once for all texts of a slice, and those of a text are what it would have alone."""
    rng = np.random.default_rng(9)
    texts = [rng.integers(1, 1 << 60, n).astype(np.uint64) for n in (80, 3, 120)]
    factors = S.W.odd_constants(4, 25)
    whole = S._Slice(np.concatenate(texts)).minima(39, factors)
    alone = S._Slice(texts[2]).minima(39, factors)
    for one, two, factor in zip(whole, alone, factors):
        hashed = S.W.mix(texts[2] * factor)
        assert one[83 : 83 + len(two)].tolist() == two.tolist() == [hashed[i : i + 39].min() for i in range(120 - 38)]
    assert all(len(x) == 0 for x in S._Slice(texts[1]).minima(39, factors))


def test_shared_spans_with_repeats_and_edits():
    rng = np.random.default_rng(10)
    passage = rng.integers(1, 1 << 60, 70).astype(np.uint64)
    other = lambda n: rng.integers(1, 1 << 60, n).astype(np.uint64)
    a = np.concatenate([other(20), passage, other(30), passage[:10]])
    b = np.concatenate([other(5), passage[:35], other(2), passage[35:], other(9)])
    assert S._shared_spans(a, b, 46, 80) == [(20, 89, 5, 76, 70 / 72)]
    assert S._shared_spans(a, other(90), 46, 80) == [] == S._shared_spans(a, a[:0], 46, 80)


def test_windows_whose_key_one_text_has_are_left_out_before_they_are_put_in_order_by_side(spark):
    rows = [(1, 5 | 6 << 31, 0, 0, 10, 100, None, None), (1, 5 | 7 << 31, 0, 0, 11, 101, None, None), (1, 8 | 7 << 31, 0, 0, 12, 102, None, None)]
    rows += [(2, 5, 5, 5, 13, 103, None, None), (2, 5, 5, 5, 13, 104, None, None), (3, 5, 0, 0, 14, 105, None, None)]  # one text
    rows += [(4, None, None, None, 15, 106, 9, 90), (5, 0, 0, 0, 16, 107, None, None), (5, 0, 0, 0, 17, 108, None, None)]  # tied before; no side
    ties = S._first_ties(spark.createDataFrame(rows, S.WINDOWS))
    assert sorted(map(tuple, ties.collect())) == [(11, 101, 10, 100), (12, 102, 11, 101), (15, 106, 9, 90)]
    plan = ties._jdf.queryExecution().optimizedPlan().toString().splitlines()
    lowest = max(i for i, x in enumerate(plan) if " Window [" in x)
    assert any("Filter" in x and "isnotnull(head" in x for x in plan[lowest - 2 : lowest])


def test_spans_with_too_few_shared_tokens_are_given_up_early(monkeypatch):
    """Every eighth token shared: no set of the other text's tokens can be similar enough, so none is made."""
    rng = np.random.default_rng(12)
    a, b = (rng.integers(1, 1 << 60, 120).astype(np.uint64) for _ in range(2))
    b[::8] = a[::8]
    asked, among = [], S._among
    monkeypatch.setattr(S, "_among", lambda values, ascending: asked.append(len(values)) or among(values, ascending))
    assert S._shared_spans(a, b, 46, 80) == [] and asked == [120]


def test_first_window_of_a_key_and_side_is_the_head():
    """Of equal keys and sides the smallest id, then place, goes on, in whatever order windows come."""
    rng = np.random.default_rng(13)
    key, ids, place = rng.integers(0, 9, 400), rng.integers(0, 40, 400), rng.permutation(400)
    sides = [rng.integers(0, 4, 400).astype(np.int32) for _ in S.SIDES]
    got = {r for t in S._tied(key, sides, ids, place) for r in zip(*(t.column(c).to_pylist() for c in ("id", "place", "head", "head_place")))}
    expected, heads = set(), set()
    for side in sides:
        first = {}
        for k in np.lexsort((place, ids)).tolist():
            if side[k]:
                h = first.setdefault((key[k], side[k]), k)
                heads.add((ids[h], place[h], None, None))
                if ids[h] != ids[k]:
                    expected.add((ids[k], place[k], ids[h], place[h]))
    assert got == expected | heads
