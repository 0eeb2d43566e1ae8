"""Files in and out in the order of names and lines, and exact neighbours by pivots."""

import json

import numpy as np
import pytest

from privaudit.operators import labels
from privaudit.sources import matrix


def test_rows_meet_their_labels(spark, tmp_path):
    """Two folders whose files' sizes run in opposite order."""
    for name in ("data", "labels"):
        (tmp_path / name).mkdir()
    sizes, values = {"data": (3, 500), "labels": (3, 500)}, {}
    for part, (name, n) in enumerate((("a", 3), ("b", 500))):
        rows = [(part + 1, i) for i in range(n)]
        values[name] = rows
        (tmp_path / "data" / f"{name}.csv").write_text("G0,G1\n" + "".join(f"{v}.0,{i}\n" for v, i in rows))
        pad = "x" * (2000 if part == 0 else 1)
        (tmp_path / "labels" / f"{name}.csv").write_text("id,label\n" + "".join(f"{pad},L{v}-{i}\n" for v, i in rows))
    assert sizes and (tmp_path / "data/a.csv").stat().st_size < (tmp_path / "data/b.csv").stat().st_size
    for most in ("128m", "700b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        found = matrix.read_labelled(spark, f"file://{tmp_path}/data", f"file://{tmp_path}/labels", ["G0", "G1"]).collect()
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len(found) == 503 and all(r["label"] == f"L{int(r['features'][0])}-{int(r['features'][1])}" for r in found)
        assert [int(r["features"][1]) for r in sorted(found, key=lambda r: r["row_id"])] == [i for n in "ab" for _, i in values[n]]


def test_wide_matrix_is_turned_by_tiles(spark, tmp_path):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(30, 1000)).astype(np.float32)
    text = "gene\t" + "\t".join(f"s{i}" for i in range(1000)) + "\n" + "".join(f"g{j}\t" + "\t".join(map(str, row)) + "\n" for j, row in enumerate(X))
    (tmp_path / "m.tsv").write_text(text)
    for tile in (8 << 20, 4 * 30 * 64):
        samples, genes = matrix.read_matrix(spark, f"file://{tmp_path}/m.tsv", tile)
        rows = samples.orderBy("ordinal").collect()
        assert genes == [f"g{j}" for j in range(30)] and [r["sample_id"] for r in rows] == [f"s{i}" for i in range(1000)]
        assert np.array_equal(np.array([r["features"] for r in rows], np.float32), X.T)
    (tmp_path / "bad.tsv").write_text("gene\ta\tb\ng0\t1\t2\ng1\t3\n")
    with pytest.raises(Exception, match="different lengths"):
        matrix.read_matrix(spark, f"file://{tmp_path}/bad.tsv")[0].collect()


def test_predictions_in_parts(spark, tmp_path):
    rows = [(f'id,"{i}', i, i / 4) for i in range(4000)]
    df = spark.createDataFrame(rows, "sample_id string, ordinal long, score double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    matrix.write_predictions(df, f"file://{tmp_path}/out")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert len(parts) > 1
    whole = "".join(p.read_text() for p in parts)
    (tmp_path / "whole.csv").write_text(whole)
    assert whole.splitlines()[0] == "sample_id,score" and len(whole.splitlines()) == 4001
    back = spark.read.csv(f"file://{tmp_path}/whole.csv", header=True, escape="\\").collect()
    assert [(r["sample_id"], float(r["score"])) for r in back] == [(i, s) for i, _, s in rows]
    manifest = [json.loads(x) for x in next((tmp_path / "out/_manifest").glob("part-*")).read_text().splitlines()]
    assert [m["part"] for m in manifest] == [p.name for p in parts] and sum(m["lines"] for m in manifest) == 4001


@pytest.mark.parametrize("kind", ["clusters", "gauss", "ties", "same"])
def test_neighbours_are_exact(spark, kind):
    rng = np.random.default_rng(1)
    if kind == "clusters":
        Y = (rng.normal(size=(60, 8)) * 10)[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 8))
        X = Y[:200] + 0.01
    elif kind == "gauss":
        Y, X = 1e4 + rng.normal(size=(2000, 5)), 1e4 + rng.normal(size=(100, 5))
    elif kind == "ties":
        Y, X = rng.integers(0, 3, (1500, 3)).astype(float), rng.integers(0, 3, (40, 3)).astype(float)
    else:
        Y, X = np.ones((900, 4)), np.ones((9, 4))
    reference = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(Y)], "ref_id long, features array<double>").repartition(4)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(X)], "sample_id long, features array<double>")
    met: dict = {}
    found: dict = {}
    for r in labels.nearest(asked, reference, 5, block_rows=100, query_rows=50, compared=met).orderBy("sample_id", "rank").collect():
        found.setdefault(r["sample_id"], []).append((r["ref_id"], r["distance"]))
    for i, x in enumerate(X):
        d = np.sqrt(((Y - x) ** 2).sum(axis=1))
        best = np.lexsort([np.arange(len(Y)), d])[:5]
        assert [a for a, _ in found[i]] == best.tolist() and [b for _, b in found[i]] == pytest.approx(d[best].tolist(), abs=1e-9)
    if kind == "clusters":
        assert met["met"] < 0.2 * met["all"]
    assert labels.nearest(asked, reference.limit(0), 5).collect() == []
    assert len(labels.nearest(asked.limit(1), reference.limit(3), 5).collect()) == 3
