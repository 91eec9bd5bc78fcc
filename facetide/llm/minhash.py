"""MinHash near-dedup: a signature-coordinate inverted join with exact confirmation.

Equal shingle sets become one class first. Every class is posted under each of its first ``POSTED``
(coordinate, minimum) pairs. Two classes of the wanted similarity agree on at least ``LEAST`` of them
(but for a chance of 1e-6), so they also share one of the ``POSTED - LEAST + 1`` rarest pairs of
both: only this prefix is merged, the rest of the postings is skipped, and classes with fewer than
``LEAST`` pairs that any other class has drop out. Agreement is then counted on the whole
signature, and what passes is confirmed on the full shingle sets.

A posting list of up to ``SMALL`` classes is merged pair by pair. A longer one (a large group of near
copies) is not: its head, the class with most copies, is compared with each member. Let D(x) be the
symmetric difference of x and the head. If x and y are linked and D(x), D(y) are disjoint, then
|D(y)| + |D(x)| <= (1 - s) |x u y|, from which both are linked to the head, so nothing is lost by skipping
the pair. Otherwise x and y share a difference, so members are posted anew under the rarest of their
differences, and so on until every list is short (here up to ``SMALL_DIFFERENCE``: such pairs are
settled from their differences alone). Exact for lists of any length.

Defined cases: null or empty texts and texts without words have no shingles, are linked with nothing
and stay; null ids are dropped, equal ids are taken as one document each time; texts with fewer
words than a shingle have their whole sequence as their one shingle; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import words as W
from .shared import components, map_texts, only

COORDINATES = 256  # two bits of each are kept to count agreement: eight longs
PLANE = COORDINATES // 64
POSTED = 32
SMALL = 128
SMALL_DIFFERENCE = 2048
DEVIATIONS = 4.5  # least agreement: so many standard deviations below the mean at the wanted similarity


def least_agreement(n: int, chance: float) -> int:
    return max(1, int(np.floor(n * chance - DEVIATIONS * np.sqrt(n * chance * (1 - chance)))))


def agreement(x: str, y: str) -> Column:
    """Of how many coordinates both kept bits are equal: of all equal minima, and a quarter of the others."""
    differ = F.lit(0)
    for i in range(PLANE):
        one, two = (F.get(x, F.lit(j)).bitwiseXOR(F.get(y, F.lit(j))) for j in (i, i + PLANE))
        differ = differ + F.bit_count(one.bitwiseOR(two))
    return F.lit(COORDINATES) - differ


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """Per document: size and two hashes of its shingle set, posted minima, one byte of every minimum."""
    factors = W.odd_constants(COORDINATES, 3)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = W.as_large(batch.column(1))
            for i, j in W.slices(texts):
                yield _signed(batch.column(0).slice(i, j - i), texts.slice(i, j - i))

    def _signed(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        sets, at = W.distinct_in_texts(*W.shingles(*W.word_hashes(texts), shingle, whole_if_short=True))
        n = len(texts)
        sizes = np.diff(at)
        full = np.flatnonzero(sizes)
        minima = np.zeros((n, COORDINATES), dtype=np.uint64)
        sums = np.zeros((n, 2), dtype=np.uint64)
        if len(full):
            begins = at[full]
            for k in range(COORDINATES):
                minima[full, k] = np.minimum.reduceat(sets * factors[k], begins)
            sums[full, 0] = np.add.reduceat(W.mix(sets), begins)
            sums[full, 1] = np.add.reduceat(W.mix(sets ^ factors[0]), begins)
        mixed = W.mix(minima)
        posted = np.ascontiguousarray(mixed[:, :POSTED].astype(np.uint32)).view(np.int32)
        planes = np.concatenate([mixed & np.uint64(1), (mixed >> np.uint64(1)) & np.uint64(1)], axis=1)
        bits = np.packbits(planes.astype(np.uint8), axis=1).view(np.int64)
        lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
        columns = [ids, pa.array(sizes, pa.int64()), *(pa.array(sums[:, k].view(np.int64)) for k in (0, 1)), lists(bits), lists(posted)]
        return pa.RecordBatch.from_arrays(columns, ["id", "n", "set_a", "set_b", "bits", "posted"])

    return map_texts(docs, of, "id long, n long, set_a long, set_b long, bits array<long>, posted array<int>")


def _compared(pairs: DataFrame, texts: DataFrame, shingle: int, differences: bool) -> DataFrame:
    """Exact set sizes and intersection of the pairs (a, b), with the hashes of their difference if asked for."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            a_texts, b_texts = W.as_large(batch.column(2)), W.as_large(batch.column(3))
            out = []
            for i, j in W.slices(b_texts):
                sets, at = W.distinct_in_texts(*W.shingles(*W.word_hashes(b_texts.slice(i, j - i)), shingle, whole_if_short=True))
                for r in range(i, j):
                    head = batch.column(0)[r].as_py()
                    if last is None or last[0] != head:
                        last = (head, W.distinct_in_texts(*W.shingles(*W.word_hashes(a_texts.slice(r, 1)), shingle, whole_if_short=True))[0])
                    mine = sets[at[r - i] : at[r - i + 1]]
                    common = np.intersect1d(last[1], mine, assume_unique=True)
                    own = None
                    if differences:
                        new = np.setdiff1d(mine, common, assume_unique=True)
                        lost = np.setdiff1d(last[1], common, assume_unique=True)
                        own = np.concatenate([W.mix(new), W.mix(~lost)]).view(np.int64)
                    out.append((len(last[1]), len(mine), len(common), own))
            sides = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *sides, pa.array([x[3] for x in out], pa.list_(pa.int64()))],
                ["a", "b", "n_a", "n_b", "common", "differences"],
            )

    rows = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    rows = rows.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    rows = rows.select("a", "b", "text_a", "text_b")
    return map_texts(rows, of, "a long, b long, n_a long, n_b long, common long, differences array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id``, ``kept`` of every document.

    Documents are linked if 100 * |intersection| >= ``percent`` * |union| of their distinct
    ``shingle``-word shingles; ``component_id`` is the smallest id reachable over links, its holder is kept.
    """
    bare = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    signed = stored(signatures(bare, shingle), "signatures")
    least, agree = least_agreement(POSTED, percent / 100), least_agreement(COORDINATES, (1 + 3 * percent / 100) / 4)

    by_set = ["n", "set_a", "set_b"]
    named = signed.where("n > 0").groupBy(*by_set).agg(F.min(F.struct("id", "bits", "posted")).alias("x"), F.count(F.lit(1)).alias("copies"))
    classes = stored(named.select("x.*", *by_set, "copies"), "classes")

    links = _linked(bare, classes, shingle, percent, least, agree)
    found = components(links).select(F.col("node").alias("id"), "component")
    known = classes.join(found, "id", "left").select(*by_set, F.coalesce("component", "id").alias("component"))
    out = signed.select("id", *by_set).join(known, by_set, "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _linked(bare: DataFrame, classes: DataFrame, shingle: int, percent: int, least: int, agree: int) -> DataFrame:
    """Enough links between classes to reach every class that is reachable over all links."""
    postings = classes.select("id", F.posexplode("posted").alias("k", "v")).select("id", F.xxhash64("k", "v").alias("key"))
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = postings.join(shared, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))  # at most POSTED
    prefix = ranked.where(F.size("keys") >= least).select("id", F.explode(F.expr(f"slice(keys, 1, size(keys) - {least - 1})")).alias("x"))
    prefix = stored(prefix.select("id", "x.key"), "prefix")
    sizes = prefix.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    posted = stored(prefix.join(sizes, "key").join(classes.select("id", "n", "copies", "bits"), "id"), "posted")

    short = posted.where(F.col("size") <= SMALL).select("key", "id", "n", "bits")
    other = short.toDF("key_b", "b", "n_b", "other")
    agreed = agreement("bits", "other")
    near = F.least("n", "n_b") * 100 >= F.greatest("n", "n_b") * percent
    matched = short.join(other, (F.col("key") == F.col("key_b")) & (F.col("id") < F.col("b")) & near & (agreed >= agree))
    pairs = stored(matched.select(F.col("id").alias("a"), "b", agreed.alias("agreement")).distinct(), "pairs")

    heads = _heads(posted.where(F.col("size") > SMALL).select("key", "id", "copies"))
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("agreement", -F.col("a"))).alias("a"))

    wanted = pairs.select("a").union(pairs.select("b")).union(heads.select("a")).union(heads.select("b")).distinct()
    texts = stored(only(bare, wanted.select(F.col("a").alias("id")), "id").dropDuplicates(["id"]), "texts")

    linked = F.expr(f"100 * common >= {percent} * (n_a + n_b - common)")
    first = _compared(best.select("a", "b"), texts, shingle, differences=False)
    links = [stored(first.where(linked).select("a", "b"), "links")]
    level = heads
    while not level.isEmpty():
        against = stored(_compared(level.select("a", "b").distinct(), texts, shingle, differences=True), "heads")
        links.append(against.where(linked).select("a", "b"))
        more, level = _by_difference(against.withColumn("linked", linked), classes, percent, agree)
        links.append(more)
    known = links[0]
    for x in links[1:]:
        known = known.union(x)
    found = stored(components(known), "components")
    at = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"in_{c}"))
    rest = pairs.join(best, ["a", "b"], "left_anti").select("a", "b").join(at("a"), "a", "left").join(at("b"), "b", "left")
    rest = rest.where("in_a IS NULL OR in_b IS NULL OR in_a != in_b").select("a", "b")
    last = _compared(rest, texts, shingle, differences=False).where(linked).select("a", "b")
    tied = found.select(F.col("component").alias("a"), F.col("node").alias("b"))
    return tied.union(last)


def _heads(members: DataFrame) -> DataFrame:
    """``a`` (head) and ``b`` (member): what each member of a long list is compared with.

    A list proposes its class with most copies, then the smallest id; of the proposals it meets, a member prefers the one
    that stands for most members; a list's head is what most of its members prefer. So the many lists of one
    group of near copies have one head, and each member is compared once.
    """
    lists = members.groupBy("key").agg(F.max_by("id", F.struct("copies", -F.col("id"))).alias("head"), F.count(F.lit(1)).alias("size"))
    weight = lists.groupBy("head").agg(F.sum("size").alias("weight"))
    met = members.join(lists.select("key", "head"), "key").join(weight, "head")
    preferred = met.groupBy("id").agg(F.max_by("head", F.struct("weight", -F.col("head"))).alias("head"))
    votes = members.select("key", "id").join(preferred, "id").groupBy("key", "head").agg(F.count(F.lit(1)).alias("votes"))
    heads = votes.groupBy("key").agg(F.max_by("head", F.struct("votes", -F.col("head"))).alias("a"))
    return stored(members.join(heads, "key").where("a != id").select("a", F.col("id").alias("b")).distinct(), "heads")


def _by_difference(against: DataFrame, classes: DataFrame, percent: int, agree: int) -> tuple[DataFrame, DataFrame]:
    """Links among members that share a rare difference from their head; heads of the lists that are still long."""
    s, d = percent / 100, F.size("differences")
    union = (F.col("n_a") + F.col("n_b") + d) / 2
    # least overlap of the differences with those of any partner that the head does not already tie to this one
    overlap = F.when(F.col("linked"), s / 2 * d).otherwise((d - (1 - s) * union + s) / 2)
    rows = against.where(d > 0).select("a", "b", "n_b", "linked", "differences", d.alias("d"), F.greatest(F.ceil(overlap - 1e-9), F.lit(1)).alias("overlap"))
    tokens = rows.select("a", "b", F.explode("differences").alias("token"))
    shared = tokens.groupBy("a", "token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = tokens.join(shared, ["a", "token"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))  # one document's
    posted = rows.drop("differences").join(ranked, ["a", "b"]).where("size(tokens) >= overlap")
    posted = posted.select("a", "b", "n_b", "linked", "d", F.explode(F.expr("slice(tokens, 1, size(tokens) - cast(overlap as int) + 1)")).alias("x"))
    posted = posted.withColumn("token", F.col("x.token")).drop("x")
    sizes = posted.groupBy("a", "token").agg(F.count(F.lit(1)).alias("size"), F.bool_and("linked").alias("tied")).where("size > 1 AND NOT tied")
    posted = stored(posted.join(sizes, ["a", "token"]).join(classes.select(F.col("id").alias("b"), "bits", "copies"), "b"), "differences")

    short = posted.where(F.col("size") <= SMALL_DIFFERENCE)
    one = short.select("a", "token", "b", "n_b", "linked", "d", "bits")
    two = short.select(F.col("a").alias("a2"), F.col("token").alias("token2"), F.col("b").alias("c"), F.col("n_b").alias("n_c"), F.col("linked").alias("linked_c"), F.col("d").alias("d_c"), F.col("bits").alias("other"))
    condition = (
        (F.col("a") == F.col("a2")) & (F.col("token") == F.col("token2")) & (F.col("b") < F.col("c")) & ~(F.col("linked") & F.col("linked_c"))
        & (F.abs(F.col("d") - F.col("d_c")) * (100 + percent) <= (F.col("n_b") + F.col("n_c")) * (100 - percent))
        & (agreement("bits", "other") >= agree)
    )
    pairs = one.join(two, condition).select("a", "b", "c").distinct()
    sets = rows.select("a", "b", "n_b", "differences")
    pairs = pairs.join(sets, ["a", "b"]).join(sets.select("a", F.col("b").alias("c"), F.col("n_b").alias("n_c"), F.col("differences").alias("differences_c")), ["a", "c"])
    apart = F.size("differences") + F.size("differences_c") - 2 * F.size(F.array_intersect("differences", "differences_c"))
    both = F.col("n_b") + F.col("n_c")
    links = stored(pairs.where((both - apart) * 100 >= (both + apart) * percent).select(F.col("b").alias("a"), F.col("c").alias("b")).distinct(), "links")
    return links, _heads(posted.where(F.col("size") > SMALL_DIFFERENCE).select(F.xxhash64("a", "token").alias("key"), F.col("b").alias("id"), "copies"))
