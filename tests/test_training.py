from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from facetide.operators import evaluation as E
from facetide.operators import scoring
from facetide.plans.queries import QUERIES
from facetide.session import shared_folder
from facetide.sources import labels as L


def test_report_by_hand(spark):
    pairs = [(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2 + [(1, 0)] * 2 + [(2, 0)]
    frame = spark.createDataFrame([(1, t, p) for t, p in pairs] + [(2, 0, 2)], "epoch int, y_true int, y_pred int")
    rows = {r["class"]: r for r in E.classification_report(frame, epoch=1).collect()}
    assert rows["0"].precision == pytest.approx(0.5) and rows["0"].recall == pytest.approx(0.75) and rows["0"].support == 4
    assert rows["2"].precision == rows["2"].recall == rows["2"].f1 == 0.0
    assert rows["accuracy"].f1 == pytest.approx(5 / 9) and rows["accuracy"].precision is None
    f1 = [0.6, 4 / 7, 0.0]
    assert rows["macro avg"].f1 == pytest.approx(sum(f1) / 3)
    assert rows["weighted avg"].f1 == pytest.approx((4 * f1[0] + 4 * f1[1]) / 9)
    assert E.classification_report(frame).where("class = 'accuracy'").first().support == 10


def test_best_epoch_ties_and_improvements(spark):
    frame = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7), (4, 0.6)], "epoch int, accuracy double")
    assert tuple(E.best_epoch(frame).first()) == (2, 0.7)
    assert [r.epoch for r in E.improvements(frame).orderBy("epoch").collect()] == [1, 2]
    assert E.best_epoch(frame, floor=0.9).first().best_epoch is None


def test_class_weights(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",)], "label string")
    index = E.class_index(rows)
    assert [tuple(r) for r in index.orderBy("idx").collect()] == [(0, "a"), (1, "b")]
    assert [tuple(r) for r in E.class_weights(rows, index).collect()] == [(0, "a", 1, 1.0), (1, "b", 2, 0.5)]
    assert {(r.label, r.idx) for r in E.with_class_index(rows).collect()} == {("a", 0), ("b", 1)}
    more = index.unionAll(spark.createDataFrame([(2, "c")], "idx int, label string"))
    with pytest.raises(PySparkException, match="DIVIDE_BY_ZERO"):
        E.class_weights(rows, more).collect()


def test_shuffle_keeps_all_rows(spark):
    rows = spark.range(100)
    mixed = [r.id for r in E.shuffled(rows, 3).collect()]
    assert sorted(mixed) == list(range(100)) and mixed != list(range(100))


def test_label_files(spark, tmp_path):
    (tmp_path / "labels.txt").write_bytes("﻿anger\r\n\n fear \n".encode())
    assert [tuple(r) for r in L.read_labels(spark, str(tmp_path / "labels.txt")).collect()] == [(0, "anger"), (1, "fear")]
    (tmp_path / "none.txt").write_text(" \n")
    with pytest.raises(ValueError):
        L.read_labels(spark, str(tmp_path / "none.txt"))


def test_labelled_folder(spark, tmp_path):
    for split, label, name in [("train", "sad", "1.png"), ("train", "joy", "2.png"), ("val", "joy", "3.png")]:
        place = tmp_path / split / label
        place.mkdir(parents=True, exist_ok=True)
        (place / name).write_bytes(b"xy")
    train, val = (L.read_labelled_folder(spark, str(tmp_path / s)) for s in ("train", "val"))
    assert sorted(r.label for r in train.collect()) == ["joy", "sad"] and "content" not in train.columns
    assert L.read_labelled_folder(spark, str(tmp_path / "val"), content=True).first().content == b"xy"
    assert {tuple(r) for r in L.rows_per_split({"train": train, "val": val}).collect()} == {("train", 2), ("val", 1)}


def test_a_labels_documents_are_not_put_into_one_task(spark, tmp_path):
    texts = spark.range(0, 400, 1, 4).select("id", F.lit("en").alias("lang"), F.lit("text").alias("text"))
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert [tuple(r) for r in QUERIES["labelled_folder"](spark, str(tmp_path)).collect()] == [("en",)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    folders = sorted(Path(shared_folder(spark)).glob("labelled-*"), key=lambda p: p.stat().st_mtime)
    assert len(list(folders[-1].rglob("*.parquet"))) > 1


def test_scoring_skips_only_the_bad_face(spark):
    def picky():
        def score(faces: np.ndarray) -> np.ndarray:
            if (faces < 0).any():
                raise RuntimeError("bad face")
            return faces * 2

        return score

    faces = spark.createDataFrame([(1, [1.0, 3.0]), (2, [-1.0, 0.0]), (3, [5.0, 0.0]), (4, None)], "n int, features array<double>").coalesce(1)
    scored = scoring.score_faces(faces, picky).persist()
    assert {r.n: r.score_failed for r in scored.collect()} == {1: False, 2: True, 3: False, 4: True}
    assert tuple(scoring.failures(scored).first()) == (2, 4)
    named = scoring.with_labels(scoring.usable(scored), L.label_values(spark, ["calm"]))
    assert {r.n: r.label for r in named.collect()} == {1: "class_1", 3: "calm"}
    assert scored.where("n = 1").select(F.round(F.array_max("probs"), 4)).first()[0] == pytest.approx(0.982)
