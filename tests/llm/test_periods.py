"""Periodic runs against a search for every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from facetide.llm import periods, queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def runs_of(words):
    found = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q) and not any(q % p == 0 and s <= i and s + n >= i + length for s, n, p in found):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def digest(words):
    found = runs_of(words)
    keep = [True] * len(words)
    for s, n, p in found:
        keep[s + p : s + n] = [False] * (n - p)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
    return len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), sha(b" ".join(w for w, k in zip(words, keep) if k))


def planted(doc_id, text):
    words = WORD.findall((text or "").encode())
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def repeated(words, period, times, rest=0):
    return (words[:period] * (times + rest // period + 1))[: period * times + rest]


@pytest.fixture(scope="module")
def periodic(words_of):
    """Runs of all octaves, runs in runs, runs side by side, periods that are multiples, two letters at random."""
    w = words_of(1, 4_000)
    rows = [w[:30] + repeated(w[40:], p, 3, r) + w[50:90] for p, r in ((1, 30), (2, 20), (5, 9), (7, 6), (8, 0), (9, 1), (15, 2), (16, 0), (31, 30), (33, 0), (127, 5), (250, 1))]
    rows.append(repeated(w, 12, 6) + repeated(w, 13, 4) + repeated(w, 12, 3))
    inner = repeated(w, 3, 9)
    rows.append(repeated(inner + w[100:111], 38, 4, 17))
    rows.append(["x"] * 200)
    rows.append(repeated(["x", "x", "y"], 3, 40) + ["x"] * 50)
    rows.append(repeated(w, 10, 2, 3) + w[500:530])  # 23 words: too short
    rows.append(repeated(w, 8, 2, 7))
    rng = random.Random(3)
    rows += [[rng.choice("ab") for _ in range(400)] for _ in range(6)]
    return [" ".join(r) for r in rows]


def test_runs_against_search(spark, documents, periodic):
    rows = list(enumerate(periodic))
    got = {r.id: tuple(r)[1:] for r in periods.digests(periods.periodic_runs(documents(rows))).collect()}
    for i, text in rows:
        assert got[i] == digest(WORD.findall(text.encode())), i
    assert sum(n[0] > 0 for n in got.values()) >= 15


def test_stitched_over_tiles(spark, documents, words_of):
    """A run of many tiles, and one cut by a single other word."""
    w = words_of(8, 300)
    long = repeated(w, 100, 90)
    cut = [*long[:4_000], "other", *long[4_001:]]
    shown = {r.id: [tuple(x) for x in r.runs] for r in periods.periodic_runs(documents([(1, " ".join(long)), (2, " ".join(cut))])).collect()}
    assert shown[1] == [(0, 9_000, 100)]
    assert shown[2] == [(0, 4_000, 100), (4_001, 4_999, 100)]


def test_query_as_brute_force(spark, folder):
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if len(r.text or "") < 20_000}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, folder).collect()}
    for i, text in source.items():
        assert got[i] == digest(planted(i, text)), i


def test_defined_cases(spark, documents, odd_rows):
    same = " ".join(["a b c"] * 20)
    rows = [*odd_rows, (None, same), (30, same), (30, same), (30, "x" * 5)]
    out = periods.digests(periods.periodic_runs(documents(rows))).collect()
    assert len(out) == len(rows)
    got = [tuple(r) for r in out if r.id in (None, 30) and r.n_runs]
    assert [r[1:6] for r in got] == [(1, 0, 60, 3, 20000)] * 3
    empty = [r for r in out if r.id in (1, 2, 3)]
    assert {tuple(r)[1:] for r in empty} == {(0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())}
    assert periods.digests(periods.periodic_runs(documents([]))).collect() == []


@pytest.mark.parametrize("text", ["aaaa", "abab", "abcab", "a", "aabaab"])
def test_z_function(text):
    z = periods.z_function(list(text), len(text))
    for i in range(1, len(text)):
        n = next((k for k in range(len(text) - i) if text[k] != text[i + k]), len(text) - i)
        assert z[i] == n
