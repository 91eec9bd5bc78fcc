"""Every registered query against its SQL, and all of them for a stable shape."""

import sys

import pytest

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0] + "/tools")

import check_oracles  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from facetide.plans.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def duck(folder):
    return check_oracles.connect(folder)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["minute", "emotion", "count"]
    assert not frame.isEmpty()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, folder, name):
    outcome = check_oracles.compare(spark, duck, folder, name)
    assert not outcome.startswith("FAIL"), outcome


ORDERED = [
    "face_position", "frame_counter", "held_boxes", "track_assign", "ema_probs", "vote_label", "hysteresis_label",
    "smooth_tracks", "throttle_events", "throttle_faces", "bbox_clamp",
]


@pytest.mark.parametrize("name", ORDERED)
def test_ordered_query_on_cut_keys(spark, duck, folder, name, monkeypatch):
    """The same results when the keys of the given tables are cut into many buckets, or into one."""
    from facetide.operators import ordered, tracking

    for width in (0.01, 1e6):
        monkeypatch.setattr(ordered, "SECONDS", 3_600.0 * width)
        monkeypatch.setattr(ordered, "NUMBERS", max(5, int(1_000 * width)))
        monkeypatch.setattr(tracking, "SECONDS", 300.0 * width)
        outcome = check_oracles.compare(spark, duck, folder, name)
        assert not outcome.startswith("FAIL"), outcome
