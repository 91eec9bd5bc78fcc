"""Toxicity by two class-conditional Kneser-Ney models of expressions.

Every word of a training text is an expression, counted once per text. In each class (toxic, ordinary) an
expression has its discounted count and, for the mass taken off, a backoff to how it is spelt: an
interpolated Kneser-Ney model of order ``ORDER`` over its characters from a start to an end mark, in which the longest
n-grams (and those from the start mark on) have the class's counts and shorter ones its continuation
counts. The lowest order is one distribution for both classes, so rare expressions are smoothed by shared
backoff counts. An expression's evidence is the difference of its two log-likelihoods divided by its length; a
text's features are the mean over all its expressions, its most toxic ones, and how many kinds these were
picked from. A logistic curve turns the features into the score.

The model is a table of all expressions and one of all n-grams, as large as the corpus makes them, and is never gathered
in one place. One pass cuts the documents into blocks of about ``BLOCK_BYTES`` of text (or one longer text): each lists its
distinct expressions once, dealt by checksum over groups (one per ``GROUP_BYTES`` of text) and packed, and its different texts as
numbers into that list, packed by byte planes. A group adds up its expressions' counts, asks the n-gram table for the n-grams that spell them and
answers each block with their evidence. The curve is fitted on at most ``CALIBRATION_ROWS`` labelled rows per class of
a fold that was not counted. Scores come back to the rows by the texts' MD5.

Defined cases: null and empty texts have no expressions and get the curve's value for no evidence; an unlabelled
corpus or one without toxic rows gives every text the score 0; several labels of one id count each; rows with a
null label or id teach nothing; of rows with equal ids one text of the curve's fold is used; equal texts have equal scores;
labels, language, source and id are never inputs of a score (the id only divides the rows into folds).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .shared import BROADCAST_ROWS, map_texts

ORDER = 5
CALIBRATION_ROWS = 4_000
DISCOUNT = 0.75  # of n-grams
WORD_DISCOUNT = 1.0  # of expressions: one met once in a class counts there by its spelling and in the backoff's mass only
BLOCK_BYTES = 8 << 20
GROUP_BYTES = 32 << 20
GRAMS_REMEMBERED = 250_000  # counts kept by a task before it hands them on
FOLDS = 5  # 0: held out, 4: the curve, others: counts
TOP = 3
FEATURES = TOP + 2

_START, _END = "\x02", "\x03"
_EDGES = ".,;:!?\"'()[]{}<>|*#$%&~^`+=_-/\\"


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


class _Places(dict):
    """Numbers of the expressions that tokens hold, in the order they are met; -1 for tokens of marks only."""

    def __init__(self):
        super().__init__()
        self.words: dict[str, int] = {}

    def __missing__(self, token: str) -> int:
        word = token.strip(_EDGES)
        place = self[token] = self.words.setdefault(word, len(self.words)) if word else -1
        return place


class _Block:
    """Texts as numbers of their expressions, each different text and expression once."""

    def __init__(self):
        self.places = _Places()
        self.texts: dict[bytes, int] = {}
        self.kinds: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.taught: list[list[int]] = []  # how often each text was labelled toxic, ordinary
        self.bytes = 0

    def add(self, digest: bytes, text: str, toxic: int, ordinary: int) -> None:
        at = self.texts.setdefault(digest, len(self.kinds))
        if at == len(self.kinds):
            tokens = text.lower().split()
            places = np.fromiter(map(self.places.__getitem__, tokens), dtype=np.int32, count=len(tokens))
            kinds, counts = np.unique(places[places >= 0], return_counts=True)
            self.kinds.append(kinds)
            self.counts.append(counts.astype(np.int32))
            self.taught.append([0, 0])
            self.bytes += len(text)
        self.taught[at][0] += toxic
        self.taught[at][1] += ordinary

    def row(self, number: int, groups: int) -> pa.RecordBatch:
        words = list(self.places.words)
        group = np.fromiter((zlib.crc32(w.encode()) % groups for w in words), dtype=np.int64, count=len(words))
        order = np.argsort(group, kind="stable")
        rank = np.empty(len(words), dtype=np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        sizes, taught = np.array([len(x) for x in self.kinds], dtype=np.int32), np.array(self.taught)
        kinds, counts, text = rank[np.concatenate(self.kinds)], np.concatenate(self.counts), np.repeat(np.arange(len(sizes)), sizes)
        classes = [np.bincount(kinds, taught[text, c], len(words)).astype(np.int64) for c in (0, 1)]
        ends = np.searchsorted(group[order], np.arange(groups + 1))
        asks = []
        for g in np.flatnonzero(np.diff(ends)).tolist():
            i, j = ends[g], ends[g + 1]
            asks.append({"group": g, "words": _pack("\n".join(words[k] for k in order[i:j].tolist()).encode()), "taught": _pack(np.concatenate([c[i:j] for c in classes]))})
        inside = np.lexsort((kinds, text))
        own = {"block": number, "digests": list(self.texts), "sizes": sizes, "kinds": _pack(np.diff(kinds[inside], prepend=np.int32(0))), "counts": _pack(counts[inside]), "asks": asks}
        return pa.RecordBatch.from_pylist([own], _BLOCK)


_ASK = pa.struct([("group", pa.int64()), ("words", pa.binary()), ("taught", pa.binary())])
_BLOCK = pa.schema([("block", pa.int64()), ("digests", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("kinds", pa.binary()), ("counts", pa.binary()), ("asks", pa.list_(_ASK))])


def _pack(values: np.ndarray | bytes) -> bytes:
    """Numbers go in planes, all their first bytes before all second ones: the high ones are nearly all alike."""
    if isinstance(values, bytes):
        return zstandard.ZstdCompressor(level=3).compress(values)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _numbers(packed: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(_unpack(packed), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _blocks(rows: DataFrame, groups: int) -> DataFrame:
    """A row per block of ``rows`` (digest, text, toxic, ordinary: how often the row was labelled so)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = _Block()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                block.add(*row)
                if block.bytes >= BLOCK_BYTES:
                    yield block.row(number, groups)
                    number, block = number + 1, _Block()
        if block.kinds:
            yield block.row(number, groups)

    return map_texts(rows, of, "block long, digests array<binary>, sizes array<int>, kinds binary, counts binary, asks array<struct<group: long, words: binary, taught: binary>>")


def _words(asks: pa.Table) -> Iterator[list[str]]:
    """The expressions of each ask."""
    return (_unpack(x).decode().split("\n") for x in asks["words"].to_pylist())


def _tally(asks: pa.Table) -> dict[str, tuple[int, int]]:
    """How many texts labelled toxic, and ordinary, hold each expression of a group that any of them holds."""
    total: dict[str, tuple[int, int]] = {}
    for words, taught in zip(_words(asks), asks["taught"].to_pylist()):
        counts = _numbers(taught, np.int64).reshape(2, len(words))
        for k in np.flatnonzero(counts.any(axis=0)).tolist():
            t, o = total.get(words[k], (0, 0))
            total[words[k]] = (t + int(counts[0, k]), o + int(counts[1, k]))
    return total


def _expressions(asks: pa.Table) -> pa.Table:
    """``word``, ``toxic``, ``ordinary`` of a group's taught expressions."""
    total = _tally(asks)
    columns = [pa.array(list(total), pa.string()), *(pa.array([x[c] for x in total.values()], pa.int64()) for c in (0, 1))]
    return pa.table(columns, ["word", "toxic", "ordinary"])


def _counted(counts: tuple[dict, dict]) -> pa.RecordBatch:
    names = list(counts[0].keys() | counts[1].keys())
    columns = [pa.array(names, pa.string())] + [pa.array([g.get(x, 0) for x in names], pa.int64()) for g in counts]
    return pa.RecordBatch.from_arrays(columns, ["gram", "toxic", "ordinary"])


def _gram_counts(counted: DataFrame) -> DataFrame:
    """``gram``, ``toxic``, ``ordinary``: the counts of all expressions that spell each n-gram."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: tuple[dict, dict] = ({}, {})
        for batch in batches:
            for word, *counts in zip(*(c.to_pylist() for c in batch.columns)):
                marked = f"{_START}{word}{_END}"
                for into, n in zip(grams, counts):
                    if n:
                        for size in range(1, ORDER + 1):
                            for i in range(len(marked) - size + 1):
                                gram = marked[i : i + size]
                                into[gram] = into.get(gram, 0) + n
            if len(grams[0]) + len(grams[1]) > GRAMS_REMEMBERED:
                yield _counted(grams)
                grams = ({}, {})
        yield _counted(grams)

    parts = map_texts(counted.select("word", "toxic", "ordinary"), of, "gram string, toxic long, ordinary long")
    return parts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _kneser_ney(grams: DataFrame) -> DataFrame:
    """The counts each order uses: of occurrences, or of the kinds of character that stand before."""
    size = F.length("gram")
    shorter = grams.where(size > 1).select(F.expr("substring(gram, 2)").alias("gram"), "toxic", "ordinary")
    before = shorter.groupBy("gram").agg(F.count_if(F.col("toxic") > 0).alias("t"), F.count_if(F.col("ordinary") > 0).alias("o"))
    whole = (size == ORDER) | F.col("gram").startswith(_START)
    pick = lambda raw, kinds: F.when(whole, F.col(raw)).otherwise(F.coalesce(kinds, F.lit(0))).alias(raw)
    return grams.join(before, "gram", "left").select("gram", pick("toxic", "t"), pick("ordinary", "o"))


Pair = tuple[float, float]  # toxic, ordinary

#: Logs of n-gram probabilities given their history; logs of histories' backoff weights; counts of expressions; their kinds; their total.
Model = tuple[dict[str, Pair], dict[str, Pair], dict[str, tuple[int, int]], Pair, Pair]


def _with_histories(grams: DataFrame) -> DataFrame:
    """``grams`` and, as ``sum_`` and ``kinds_`` of each class, what follows each n-gram."""
    after = grams.where(F.length("gram") > 1).groupBy(F.expr("substring(gram, 1, length(gram) - 1)").alias("gram"))
    sums = [f(c).alias(n + c) for n, f in (("sum_", F.sum), ("kinds_", lambda c: F.count_if(F.col(c) > 0))) for c in ("toxic", "ordinary")]
    return grams.join(after.agg(*sums), "gram", "left")


def _histories(rows: list[tuple[str, int, int]]) -> dict[str, list[int]]:
    """Sums and kinds of what follows each n-gram, where ``rows`` are all there are."""
    histories: dict[str, list[int]] = {}
    for gram, *counts in rows:
        if len(gram) > 1:
            h = histories.setdefault(gram[:-1], [0, 0, 0, 0])
            for c in (0, 1):
                if counts[c]:
                    h[c] += counts[c]
                    h[2 + c] += 1
    return histories


def spelling(rows: list[tuple[str, int, int]], histories: dict[str, list[int]] | None = None, shared: int | None = None) -> tuple[dict[str, Pair], dict[str, Pair]]:
    """The first two parts of a model from Kneser-Ney counts (gram, toxic, ordinary).

    ``rows`` may be a part that holds with an n-gram all that it holds itself; then ``histories`` (sums and kinds of what
    follows) and ``shared`` (the sum of the lowest order) are those of the whole.
    """
    if histories is None:
        histories = _histories(rows)
    if shared is None:
        shared = sum(t + o for gram, t, o in rows if len(gram) == 1)
    shared = shared or 1
    weight = {h: tuple(DISCOUNT * x[2 + c] / x[c] if x[c] else 1.0 for c in (0, 1)) for h, x in histories.items()}
    floor = (0.1 / shared, 0.1 / shared)
    p: dict[str, Pair] = {}
    for gram, *counts in sorted(rows, key=lambda r: len(r[0])):
        if len(gram) == 1:
            both = (sum(counts) + 0.1) / shared
            p[gram] = (both, both)
            continue
        lower = p.get(gram[1:], floor)
        h, w = histories[gram[:-1]], weight[gram[:-1]]
        p[gram] = tuple((max(counts[c] - DISCOUNT, 0.0) / h[c] if h[c] else 0.0) + w[c] * lower[c] for c in (0, 1))
    for x in (p, weight):
        for k, (t, o) in x.items():
            x[k] = math.log(t), math.log(o)
    return p, weight


def evidence(model: Model, word: str) -> float:
    """Difference of an expression's log-likelihoods over its length: above 0 toxic is likelier."""
    grams, backoff, words, kinds, totals = model
    word = word.strip(_EDGES)
    if not word:
        return 0.0
    marked = f"{_START}{word}{_END}"
    toxic = ordinary = 0.0
    for end in range(2, len(marked) + 1):
        begin = max(0, end - ORDER)
        while begin < end:
            found = grams.get(marked[begin:end])
            if found is not None:
                toxic += found[0]
                ordinary += found[1]
                break
            found = backoff.get(marked[begin : end - 1])
            if found is not None:
                toxic += found[0]
                ordinary += found[1]
            begin += 1
    counts = words.get(word)
    if counts is None:
        ratio = toxic - ordinary + math.log(kinds[0] / totals[0]) - math.log(kinds[1] / totals[1])
    else:
        spelt = (math.exp(toxic), math.exp(ordinary))
        t, o = ((max(counts[c] - WORD_DISCOUNT, 0.0) + WORD_DISCOUNT * kinds[c] * spelt[c]) / totals[c] for c in (0, 1))
        ratio = math.log(max(t, 1e-300)) - math.log(max(o, 1e-300))
    return ratio / (len(marked) - 1)


def _substrings(asks: pa.Table) -> pa.Table:
    """The n-grams that spell a group's expressions, once each."""
    grams = set()
    for word in set().union(*_words(asks)):
        marked = f"{_START}{word}{_END}"
        for size in range(1, ORDER + 1):
            grams.update(marked[i : i + size] for i in range(len(marked) - size + 1))
    return pa.table({"group": pa.array([asks["group"][0].as_py()] * len(grams), pa.int64()), "gram": pa.array(list(grams), pa.string())})


def _answers(asks: DataFrame, counted: DataFrame, grams: DataFrame) -> DataFrame:
    """``asker``, ``group``, ``evidence`` (packed, in the order asked) of every ask, from the counts of all n-grams."""
    each = (("kinds", lambda c: F.count_if(F.col(c) > 0)), ("total", F.sum))
    sums = counted.agg(*(f(c).alias(f"{n}_{c}") for c in ("toxic", "ordinary") for n, f in each)).first()
    kinds, totals = (tuple(float(sums[f"{n}_{c}"] or 1) for c in ("toxic", "ordinary")) for n in ("kinds", "total"))
    shared = grams.where(F.length("gram") == 1).agg(F.sum(F.col("toxic") + F.col("ordinary"))).first()[0]

    def of(asks: pa.Table, found: pa.Table) -> pa.Table:
        rows, after = [], {}
        for part in found.to_batches(max_chunksize=10_000):
            for gram, toxic, ordinary, *follow in zip(*(part[c].to_pylist() for c in ("gram", "toxic", "ordinary", "sum_toxic", "sum_ordinary", "kinds_toxic", "kinds_ordinary"))):
                rows.append((gram, toxic, ordinary))
                if follow[0] is not None:
                    after[gram] = follow
        spelt = spelling(rows, after, shared)
        del rows, after  # the largest of what a task holds
        model = (*spelt, _tally(asks), kinds, totals)
        known: dict[str, float] = {}
        out = []
        for words in _words(asks):
            for w in words:
                if w not in known:
                    known[w] = evidence(model, w)
            out.append(_pack(np.fromiter(map(known.__getitem__, words), dtype=np.float64, count=len(words))))
        return pa.table({"asker": asks["block"], "group": asks["group"], "evidence": pa.array(out, pa.binary())})

    asked = asks.groupBy("group").applyInArrow(_substrings, "group long, gram string")
    return asks.groupBy("group").cogroup(asked.join(grams, "gram").groupBy("group")).applyInArrow(of, "asker long, group long, evidence binary")


def _features(block: pa.Table, answers: pa.Table) -> pa.Table:
    """Per text of a block: mean evidence, the ``TOP`` highest of distinct expressions, log of how many kinds there are.

    Sums are rounded once, so equal texts get equal features in whatever block they are.
    """
    sizes = block["sizes"].combine_chunks().flatten().to_numpy()
    kinds, counts = (_numbers(block[c][0].as_py(), np.int32) for c in ("kinds", "counts"))
    of = np.concatenate([np.zeros(0), *(_numbers(x, np.float64) for x in answers.sort_by("group")["evidence"].to_pylist())])
    values = of[np.cumsum(kinds, dtype=np.int32)]
    weighted, ends = values * counts, np.cumsum(sizes).tolist()
    out = np.zeros((len(sizes), FEATURES))
    for i, (a, b) in enumerate(zip([0, *ends], ends)):
        if a < b:
            out[i, 0] = math.fsum(weighted[a:b].tolist()) / counts[a:b].sum()
            top = np.sort(values[a:b])[: -TOP - 1 : -1]
            out[i, 1 : 1 + len(top)] = top
            out[i, -1] = math.log1p(b - a)
    lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, FEATURES, dtype=np.int32), pa.array(out.ravel()))
    return pa.table({"digest": block["digests"].combine_chunks().flatten(), "features": lists})


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and intercept of a logistic curve, classes weighted alike, by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    each = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) * len(y)
    w, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (each * (y - p)) - ridge @ w)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
    return w


def _lessons(named: DataFrame) -> DataFrame:
    """``id``, ``toxic``, ``ordinary``: how many labels of each class the ids of the counting folds have."""
    counting = named.where(fold("id").between(1, FOLDS - 2))
    return counting.groupBy("id").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("ordinary"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``id``, ``held_out``, ``score``, ``predicted`` of every document, and its whole ``row`` as a struct."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), F.coalesce(fold(id_col), F.lit(0)).alias("fold"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("toxic IN (0, 1) AND id IS NOT NULL")
    lessons = _lessons(named)
    few = named.count() <= BROADCAST_ROWS
    taught = bare.join(F.broadcast(lessons) if few else lessons, "id", "left").select("digest", "text", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("toxic", "ordinary")))

    groups = max(1, -(-(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // GROUP_BYTES))
    blocks = stored(_blocks(taught, groups), "blocks")
    asks = blocks.select("block", F.inline("asks"))
    counted = stored(asks.groupBy("group").applyInArrow(_expressions, "word string, toxic long, ordinary long"), "expressions")
    grams = stored(_kneser_ney(stored(_gram_counts(counted), "grams")), "counts")
    answers = _answers(asks, counted, stored(_with_histories(grams), "histories"))  # asked once, so not stored
    found = blocks.drop("asks").groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(_features, "digest binary, features array<double>")
    found = stored(found.dropDuplicates(["digest"]), "features")

    curve = named.where(fold("id") == FOLDS - 1).distinct()
    some, others = (curve.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(CALIBRATION_ROWS) for c in (1, 0))
    chosen = bare.join(F.broadcast(some.union(others)), "id").groupBy("id", "toxic").agg(F.min("digest").alias("digest"))  # at most 2 * CALIBRATION_ROWS rows
    fitted = chosen.join(found, "digest").select("id", "toxic", "features").toArrow().sort_by([("id", "ascending"), ("toxic", "ascending")])
    y = fitted["toxic"].to_numpy()
    if not len(y) or y.min() == y.max():
        out = bare.withColumn("score", F.lit(0.0))
    else:
        w = _fit(np.array(fitted["features"].to_pylist()), y)
        z = F.lit(float(w[-1]))
        for k in range(FEATURES):
            z = z + F.lit(float(w[k])) * F.get("features", F.lit(k))
        out = bare.join(found.select("digest", (1 / (1 + F.exp(-z))).alias("score")), "digest")
    return out.select("id", (F.col("fold") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "row")
