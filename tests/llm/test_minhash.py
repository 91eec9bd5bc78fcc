import random

import pytest

from facetide.llm import minhash


def brute(rows, shingle, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        own = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
        sets[i] = own
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for p, i in enumerate(names):
        for j in names[:p]:
            common, a, b = len(sets[i] & sets[j]), find(i), find(j)
            if sets[i] and sets[j] and a != b and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in sets}


def near_copies(words_of, n, seed=3, size=120, edits=(0, 1, 2, 3, 5, 8, 12)):
    rng = random.Random(seed)
    base, out = words_of(seed, size), []
    for i in range(n):
        own = list(base)
        for _ in range(rng.choice(edits)):
            own[rng.randrange(size)] = f"new{rng.randrange(40)}"
        out.append((1000 + i, " ".join(own)))
    return out


def found(frame):
    return {tuple(r) for r in frame.select("id", "n_shingles", "component_id", "kept").collect()}


@pytest.mark.parametrize("small, small_difference", [(128, 2048), (4, 3)])
def test_same_components_as_brute_force(spark, documents, words_of, monkeypatch, small, small_difference):
    """Also with every list so short that heads and differences decide, several levels deep."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "SMALL_DIFFERENCE", small_difference)
    passage = words_of(9, 60)
    rows = near_copies(words_of, 60) + [(i, " ".join(passage + words_of(100 + i, 70))) for i in range(20)]
    assert found(minhash.near_duplicates(documents(rows), shingle=3, percent=85)) == brute(rows, 3, 85)


def test_odd_rows(documents, odd_rows):
    rows = [*odd_rows, (None, "x y z")]
    got = minhash.near_duplicates(documents(rows), shingle=3, percent=85).collect()
    assert len(got) == len(odd_rows)
    assert {(r.id, r.n_shingles, r.component_id, r.kept) for r in got} == brute(dict(odd_rows).items(), 3, 85)


def test_empty_table(documents):
    assert minhash.near_duplicates(documents([])).collect() == []


def test_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(minhash.near_duplicates(docs, shingle=3, percent=85)) == brute(rows, 3, 85)
