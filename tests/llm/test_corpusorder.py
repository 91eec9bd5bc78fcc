"""Suffix-array dedup against every 50-byte string, byte by byte."""

import hashlib
import random

import numpy as np
import pytest

from facetide.llm import corpusorder, queries


def brute(rows, least=50):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for k in range(len(b) - least + 1):
                first[b[k : k + least]] = min(i, first.get(b[k : k + least], i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - least + 1):
                if first[b[k : k + least]] < i:
                    gone[k : k + least] = b"\1" * least
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def judged(docs):
    return sorted((tuple(r) for r in corpusorder.deduplicated(docs).collect()), key=str)


@pytest.fixture(scope="module")
def repetitive(words_of):
    """Copies, near copies, shared lines and passages that begin and end anywhere, and texts of one byte."""
    rng = random.Random(4)
    text = " ".join(words_of(2, 900))
    line = "a line that stands in a great many texts, with Ünïcode, of about seventy bytes"
    rows = [(i, " ".join(words_of(100 + i, 60))) for i in range(40)]
    for i in range(40, 120):
        p, n = rng.randrange(len(text)), rng.choice([40, 48, 49, 50, 51, 60, 90, 200, 900, 3_000])
        own = " ".join(words_of(100 + i, 12))
        rows.append((i, own[: rng.randrange(len(own))] + text[p : p + n] + rng.choice(["", "\n" + line, line[rng.randrange(20) :]]) + own))
    words = text.split(" ")
    for i in range(120, 135):
        near = list(words[:400])
        near[rng.randrange(400)] = "changed"
        rows.append((i, " ".join(near)))
    rows += [(200, text), (201, text), (202, "a" * 70), (203, "a" * 55 + "b" * 60), (204, "b" * 49), (205, "ab" * 100), (206, "x" + text[7:57] + "y"), (207, text[7:56])]
    return rows


def test_as_brute_force(spark, documents, repetitive):
    rng = random.Random(5)
    shuffled = list(repetitive)
    rng.shuffle(shuffled)
    got = judged(documents(shuffled).repartition(5))
    assert got == brute(repetitive)
    assert sum(r[2] > 0 for r in got) > 60


def test_all_routes_agree(spark, documents, repetitive, monkeypatch):
    """Small blocks, buckets and dictionaries; triggers that count as hot; phrases of another spacing."""
    expected = brute(repetitive)
    for name, value in (("BLOCK_BYTES", 2_000), ("BUCKET_BYTES", 3_000), ("ENTRIES", 5), ("SUFFIXES", 7), ("SPACING", 16)):
        monkeypatch.setattr(corpusorder, name, value)
    assert judged(documents(repetitive).repartition(4)) == expected
    monkeypatch.setattr(corpusorder, "HOT", 1)
    assert judged(documents(repetitive).repartition(4)) == expected


def test_defined_cases(spark, documents, odd_rows):
    same = "the same seventy bytes again and again, in rows that are repeated whole"
    rows = [*odd_rows, (None, same), (50, same), (50, same), (50, same + " and more of it"), (51, "é" * 60), (52, "é" * 40)]
    assert judged(documents(rows)) == brute(rows)
    assert judged(documents([])) == []
    assert judged(documents([(1, None), (None, None)])) == brute([(1, None), (None, None)])


def test_query_as_brute_force(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op11_suffix_array_dedup(spark, folder).collect()), key=str)
    assert got == brute(rows)


def test_suffix_classes():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 2, 400).astype(np.uint8)
    for least in (25, 50, 64):
        places = np.arange(len(data) - least + 1)
        rank = corpusorder.suffix_classes(data, places, least)
        strings = [data[p : p + least].tobytes() for p in places]
        order = {s: k for k, s in enumerate(sorted(set(strings)))}
        seen = [order[s] for s in strings]
        assert (np.argsort(rank, kind="stable") == np.argsort(seen, kind="stable")).all()
        assert all((rank[a] == rank[b]) == (seen[a] == seen[b]) for a, b in zip(places[:-1], places[1:]))
