import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from facetide.llm import toxicity
from facetide.session import stored

BAD = ["grobnak", "skarvel", "vudrik"]


def planted(words_of, n=700):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        own = words_of(i, rng.randint(20, 90))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                own[rng.randrange(len(own))] = rng.choice(BAD) + rng.choice(["", "", "ko", "sha"])
        rows.append((i, " ".join(own)))
        if i % 7:
            labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_shape(spark, documents, words_of):
    rows, known = planted(words_of)
    labels = spark.createDataFrame([*known, (None, 1), (1, None)], "doc_id long, toxic int")
    out = toxicity.score(documents(rows), labels).collect()
    assert sorted(r.id for r in out) == [i for i, _ in rows]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out]
    right = sum((r.id % 4 == 0) == bool(r.predicted) for r in held)
    assert right >= 0.95 * len(held)


def test_folds_follow_the_checksum(spark):
    got = spark.range(50).select("id", toxicity.fold("id").alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_held_out_labels_are_never_used(spark, documents, words_of):
    rows, known = planted(words_of, 300)
    docs = documents(rows)
    held = {r.id for r in docs.select(F.col("doc_id").alias("id"), toxicity.fold("doc_id").alias("f")).where("f = 0").collect()}
    one = spark.createDataFrame(known, "doc_id long, toxic int")
    other = spark.createDataFrame([(i, 1 - t if i in held else t) for i, t in known], "doc_id long, toxic int")
    scores = [{r.id: r.score for r in toxicity.score(docs, x).collect()} for x in (one, other)]
    assert scores[0] == scores[1]


def test_odd_rows_and_no_labels(spark, documents, odd_rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = documents(odd_rows)
    out = toxicity.score(docs, none)
    assert out.count() == len(odd_rows) and {r.score for r in out.collect()} == {0.0}
    assert out.select("row.*").columns == docs.columns
    some = spark.createDataFrame([(i, i % 2) for i, _ in odd_rows], "doc_id long, toxic int")
    assert toxicity.score(docs, some).count() == len(odd_rows)
    assert toxicity.score(documents([]), some).collect() == []


def test_shared_backoff_smooths_rare_expressions():
    """A spelling unlike any gives no evidence, one like toxic expressions more than one like ordinary ones."""
    words = {"abcab": (0, 9), "cabba": (0, 9), "xyzzy": (9, 0)}
    grams = {}
    for word, counts in words.items():
        marked = f"\x02{word}\x03"
        for size in range(1, toxicity.ORDER + 1):
            for i in range(len(marked) - size + 1):
                old = grams.get(marked[i : i + size], (0, 0))
                grams[marked[i : i + size]] = (old[0] + counts[0], old[1] + counts[1])
    model = (*toxicity.spelling([(g, *c) for g, c in grams.items()]), words, (1.0, 2.0), (9.0, 18.0))
    of = lambda w: toxicity.evidence(model, w)
    assert of("xyzzy") > of("qqqq") == 0.0 > of("abcab")
    assert of("xyzzyq") > of("abcabq")
    assert of("...") == 0.0


def test_scores_as_one_model_in_one_process(spark, documents, words_of, monkeypatch):
    """Blocks and groups give each text what a model of all counts in one process gives it."""
    rows, known = planted(words_of, 160)
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, "... --"), (903, None), (904, "Grobnak, (grobnak) unmet"), (904, "x")]
    known += [(900, 1), (900, 0), (905, 1)]
    monkeypatch.setattr(toxicity, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(toxicity, "GROUP_BYTES", 9000)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    words_in = lambda text: [w for w in (t.strip(toxicity._EDGES) for t in (text or "").lower().split()) if w]

    words = {}
    for i, text in rows:
        for j, toxic in known:
            if i == j and 1 <= fold(i) <= 3:
                for w in set(words_in(text)):
                    words.setdefault(w, [0, 0])[1 - toxic] += 1
    raw = {}
    for w, counts in words.items():
        marked = f"\x02{w}\x03"
        for size in range(1, toxicity.ORDER + 1):
            for k in range(len(marked) - size + 1):
                gram = raw.setdefault(marked[k : k + size], [0, 0])
                gram[0] += counts[0]
                gram[1] += counts[1]
    grams = [(g, *(x if len(g) == toxicity.ORDER or g[0] == "\x02" else [sum(1 for h, y in raw.items() if h[1:] == g and y[c]) for c in (0, 1)])) for g, x in raw.items()]
    kinds = tuple(float(sum(1 for x in words.values() if x[c])) for c in (0, 1))
    totals = tuple(float(sum(x[c] for x in words.values())) for c in (0, 1))
    model = (*toxicity.spelling(grams), {w: tuple(x) for w, x in words.items()}, kinds, totals)

    def features(text):
        own = words_in(text)
        if not own:
            return [0.0] * toxicity.FEATURES
        top = sorted((toxicity.evidence(model, w) for w in set(own)), reverse=True)[: toxicity.TOP]
        return [sum(toxicity.evidence(model, w) for w in own) / len(own), *top, *[0.0] * (toxicity.TOP - len(top)), math.log1p(len(set(own)))]

    texts = dict(rows)
    fit = sorted({(i, t) for i, t in known if fold(i) == 4 and i in texts})
    w = toxicity._fit(np.array([features(texts[i]) for i, _ in fit]), np.array([t for _, t in fit]))
    got = toxicity.score(documents(rows), spark.createDataFrame(known, "doc_id long, toxic int")).select("id", "score", "row.text").collect()
    assert sorted((r.id, r.text or "") for r in got) == sorted((i, t or "") for i, t in rows)
    for r in got:
        assert abs(r.score - 1 / (1 + math.exp(-(np.dot(features(r.text), w[:-1]) + w[-1])))) < 1e-9


def test_tables_kept_on_disk_are_small(spark, documents, words_of, monkeypatch):
    """Evidence is as large as the lists of expressions and asked once, so it isn't written to the shared folder too."""
    kept = []
    monkeypatch.setattr(toxicity, "stored", lambda df, purpose: kept.append(purpose) or stored(df, purpose))
    rows, known = planted(words_of, 60)
    assert toxicity.score(documents(rows), spark.createDataFrame(known, "doc_id long, toxic int")).count() == 60
    assert "blocks" in kept and "answers" not in kept


def test_packed_numbers_come_back_and_are_smaller():
    rng = np.random.default_rng(3)
    for values in (rng.geometric(0.01, 50_000).astype(np.int32), rng.normal(size=999), np.zeros(0, np.int64), np.array([-1, 1 << 40])):
        assert toxicity._numbers(toxicity._pack(values), values.dtype).tolist() == values.tolist()
    gaps = rng.geometric(0.01, 50_000).astype(np.int32)
    assert len(toxicity._pack(gaps)) < 0.9 * len(toxicity._pack(gaps.tobytes()))
