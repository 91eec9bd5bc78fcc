import pytest

from facetide.llm import decontaminate as D

ITEMS = [
    (1, "Anna Keller buys 12 apples and 30 pears for 4 euros each. How much does Anna Keller pay in all at the shop?"),
    (2, "the quick grey wolf runs over seven hills and then rests beside the old stone bridge until morning"),
    (3, "one two"),
    (4, None),
    (5, ""),
]


def found(docs, items, **options):
    return {(r.id, r.item_id): r.slots for r in D.contaminated(docs, items, **options).collect()}


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("probed", [D.PROBED_WINDOWS, 0])
def test_copies_and_reparameterised_questions(documents, items, probed):
    """Alike with the benchmark sent to the scans and joined by shuffle."""
    first, second = ITEMS[0][1], ITEMS[1][1]
    filler = "some words before that mean nothing at all "
    renamed = first.replace("Anna Keller", "Mary Brown").replace("12", "77").replace("30", "5").replace("4 euros", "9 euros")
    mixed = first.replace("Anna Keller", "Mary Brown", 1).replace("Anna Keller", "John Smith").replace("12", "9").replace("30", "9").replace("4 euros", "8 euros")
    rows = [
        (10, filler + first),
        (11, filler + second.upper() + "."),
        (12, filler + renamed + " and more after it"),
        (13, filler + mixed),
        (14, " ".join(second.split()[:9])),
        (15, "one two"),
        (16, filler * 30),
        (17, None),
        (18, ""),
        (None, first),
    ]
    got = found(documents(rows), items, probed=probed)
    assert got == {(10, 1): "equal", (11, 2): "none", (12, 1): "renamed", (15, 3): "none"}


def test_a_passage_inside_a_long_text_and_repeated_rows(documents, items, words_of):
    long = " ".join(words_of(1, 30_000))
    rows = [(1, f"{long} {ITEMS[1][1]} {long}"), (2, ITEMS[1][1]), (2, ITEMS[1][1])]
    got = D.contaminated(documents(rows), items).collect()
    assert sorted((r.id, r.item_id, r.n_found, r.n_windows) for r in got) == [(1, 2, 14, 14), (2, 2, 14, 14), (2, 2, 14, 14)]
    assert {r.start for r in got if r.id == 1} == {30_000}


@pytest.mark.parametrize("probed", [D.PROBED_WINDOWS, 0])
def test_several_versions_in_one_text(spark, documents, items, probed):
    """Each occurrence alone decides, beside other versions and passages that share windows."""
    first = ITEMS[0][1]
    one = first.replace("Anna Keller", "Mary Brown").replace("12", "77").replace("30", "5").replace("4 euros", "9 euros")
    two = first.replace("Anna Keller", "John Smith").replace("12", "8").replace("30", "61").replace("4 euros", "3 euros")
    table = " ".join(str(k) for k in range(3000))
    counted = "the rows of the list hold 17 23 42 56 61 78 80 94 and 99 in all and no more of them"
    some = spark.createDataFrame([*ITEMS, (6, counted)], "item_id long, text string")
    mixed = first.replace("Anna Keller", "Mary Brown", 1).replace("Anna Keller", "John Smith").replace("12", "9").replace("30", "9").replace("4 euros", "8 euros")
    rows = [(1, f"{one} and then {two}"), (2, f"{first} and then {one} {two}"), (3, f"{table} {counted} {table}"), (4, f"{mixed} and {mixed}"), (5, table)]
    got = found(documents(rows), some, probed=probed)
    assert set(got) == {(1, 1), (2, 1), (3, 6)} and got[(3, 6)] == "equal"


@pytest.mark.parametrize("probed", [D.PROBED_WINDOWS, 0])
def test_copies_with_other_capitals_and_lines(documents, items, probed):
    """Names in the item, or capitals in the copy only."""
    first, second = ITEMS[0][1], ITEMS[1][1]
    wrapped = first.replace(" Anna Keller pay", "\nAnna Keller pay").replace("Keller", "\nKeller")
    rows = [(1, first.lower()), (2, first.upper()), (3, first.title()), (4, wrapped), (5, second.title()), (6, second.replace("wolf", "Wolf")), (7, first.lower().replace("apples", "plums").replace("shop", "market").replace("buys", "eats"))]
    got = found(documents(rows), items, probed=probed)
    assert got == {(1, 1): "equal", (2, 1): "equal", (3, 1): "equal", (4, 1): "equal", (5, 2): "none", (6, 2): "none"}


def test_empty_tables(spark, documents, items):
    assert found(documents([]), items) == {}
    assert found(documents([(1, "a b c")]), spark.createDataFrame([], "item_id long, text string")) == {}


def test_given_benchmark(spark, folder):
    """Every document that holds an item's words in order is found."""
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = set(found(docs, items))
    expected = {
        (d.doc_id, b.item_id)
        for d in docs.collect()
        for b in items.collect()
        if d.text and b.text in d.text
    }
    assert expected <= got and len(got) <= len(expected) + 2
