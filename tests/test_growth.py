"""Steps whose tasks must not grow with a table when its groups are few."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.operators import curves, density, structure
from cellframe.plans import adapters, queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_atoms_are_not_shuffled_by_structure(spark, sf_dir):
    cells = adapters.cells(spark)
    for df in (adapters.points(spark, sf_dir), adapters.in_slab(spark, sf_dir), structure.fold_reduced(adapters.atoms(spark, sf_dir), cells), structure.frac_table(adapters.atoms(spark, sf_dir), cells)):
        assert "SortMergeJoin" not in plan(df) and "Exchange hashpartitioning" not in plan(df)


def test_no_frame_of_nearest_point_starts_at_its_row(spark):
    points = spark.createDataFrame([("p", 1, "a", 1.0, 2.0)], "path string, point_no int, label string, x double, y double")
    got = curves.nearest_point(points, spark.createDataFrame([("p", 0.0)], "path string, probe double"))
    assert "currentrow$(), unboundedfollowing$()" not in plan(got)


def test_fit_sample_shuffles_only_near_atoms(spark):
    df = spark.createDataFrame([(1, "A", 0, f"k{i}") for i in range(200)] + [(None, "A", 0, "n")], "structure_id int, element string, slab_id int, seq_key string")
    got = density.fit_sample(df, 20, 1)
    assert "SortMergeJoin" not in plan(got) and got.count() == 21


def test_z_histogram_shuffles_no_atoms(spark):
    rows = [(k, float(z)) for k in (0, 1) for z in range(11)] + [(0, float("nan")), (None, 1.0), (2, float("inf"))]
    got = density.z_histogram(spark.createDataFrame(rows, "structure_id int, pz double"), 5)
    assert plan(got).count("SortMergeJoin") < 2  # the counts, not the atoms
    assert sorted((r.structure_id, r.bin, r.n, r.n_odd) for r in got.collect()) == [(k, b, 3 if b == 4 else 2, 1 - k) for k in (0, 1) for b in range(5)]


def test_kernel_sums_shuffle_cells_not_atoms(spark):
    r = np.random.default_rng(5)
    rows = [(0, "Ga", 0, float(x), float(y)) for x, y in r.normal(0.5, 0.1, (300, 2))]
    schema = "structure_id int, element string, slab_id int, px double, py double"
    one = spark.createDataFrame(rows, schema)
    got = density.kde_slice(one, 0.25, 30)
    assert plan(got).count("Generate explode") == 1  # the empty nodes, not those that an atom reaches
    x, y = (np.array([row[i] for row in rows]) for i in (3, 4))
    inverse = np.linalg.inv(np.cov(x, y) * 0.25**2)
    at = np.linspace(0, 1, 30)
    for row in got.collect():
        d = np.stack([at[row.ix] - x, at[row.iy] - y], axis=1)
        want = np.exp(-0.5 * np.einsum("ni,ij,nj->n", d, inverse, d)).mean() * math.sqrt(np.linalg.det(inverse)) / (2 * math.pi)
        assert row.density == pytest.approx(want, abs=1e-13 * math.sqrt(np.linalg.det(inverse)))


def test_groups_meet_their_points_without_a_shuffle_by_group(spark):
    r = np.random.default_rng(6)
    rows = [(0, "Ga", i, *map(float, x)) for i, x in enumerate(r.normal(size=(60, 3)))]
    points = spark.createDataFrame(rows, "structure_id int, element string, point_id int, px double, py double, pz double")
    pts, _ = density.whitened(points)
    assert "SortMergeJoin" not in plan(pts)
    got = density.kde_self_grid(points, 0.2, 4.0)
    assert "SortMergeJoin" not in plan(got) and "Exchange hashpartitioning" not in plan(got) and got.count() == 60


def test_a_place_of_several_atoms_has_one_density(spark):
    """Places are points: copies of an atom count in the sum once each, and do not multiply the density at their place."""
    r = np.random.default_rng(7)
    p = np.vstack([r.normal(size=(40, 3)), [[0.5, 0.5, 0.5]] * 3])
    points = spark.createDataFrame([(0, "Ga", 40 if i >= 40 else i, *map(float, x)) for i, x in enumerate(p)], "structure_id int, element string, point_id int, px double, py double, pz double")
    got = {x.point_id: x.density for x in density.kde_self_grid(points, step=0.1, reach=5.0).collect()}
    s = np.cov(p.T) * len(p) ** (-2 / 7)
    want = np.exp(-0.5 * np.einsum("ni,ij,nj->n", p - p[40], np.linalg.inv(s), p - p[40])).mean() / np.sqrt(np.linalg.det(s) * (2 * np.pi) ** 3)
    assert got[40] == pytest.approx(want, rel=0.02)


def test_files_of_chi_history_do_not_grow_with_its_runs(spark, tmp_path, monkeypatch):
    made = "select range as event_id, timestamp '2024-01-01' + to_seconds(range * 7919 % 600) as ts, case when range % 40 < 39 then range % 40 end as user_id, range / 8 as value from range(600)"
    duckdb.execute(f"copy ({made}) to '{tmp_path}/events.parquet' (format parquet)")
    monkeypatch.setattr(adapters, "shared_folder", lambda spark: str(tmp_path / "shared"))
    got = queries.chi_history(spark, str(tmp_path)).select("run_id", "step", "file_no", "chi_r").collect()
    want = duckdb.execute(queries.SQL["chi_history"].replace("from events", f"from '{tmp_path}/events.parquet'")).fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert len(list((tmp_path / "shared").rglob("*.txt"))) < 10  # of 120 logs
