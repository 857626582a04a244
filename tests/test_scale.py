"""The mechanisms that let operators work on large files, series, slabs and groups, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.functions.storage import ranked, remove
from cellframe.operators import contours, curves, density, selfdensity, structure
from cellframe.sources import archive, catalog, export, ingest
from cellframe.streaming import monitor


def test_lines_are_numbered_across_blocks_and_files(spark, tmp_path):
    r, texts = random.Random(4), {}
    for k, end in enumerate(["\n", "\r\n", "\r"]):
        lines = ["".join(r.choice("ab ,é1") for _ in range(r.randrange(0, 40))) for _ in range(500 + k)]
        texts[f"t{k}.txt"] = lines
        (tmp_path / f"t{k}.txt").write_bytes((end.join(lines) + end * (k != 1)).encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    for size in (None, 97, 1000):
        got = {}
        for row in ingest.raw_lines(spark, str(tmp_path), split_bytes=size).collect():
            got.setdefault(row.path.rsplit("/", 1)[1], {})[row.line_no] = row.line
        assert set(got) == set(texts)
        for name, lines in texts.items():
            want = lines if lines[-1] or name != "t1.txt" else lines[:-1]
            assert [got[name][i] for i in range(len(got[name]))] == want
    assert spark.conf.get(ingest.SPLIT) != "97"


def test_texts_of_many_parts_read_as_one(spark, tmp_path):
    rows = [(f"n{k % 3}", i, f"{k % 3}:{i}") for k in range(3) for i in range(2000)]
    df = spark.createDataFrame(rows, "name string, place int, line string").repartition(9)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as many parts as there are partitions
    try:
        export.write_texts(df, str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    got = ingest.raw_lines(spark, str(tmp_path / "t"), folders=True, split_bytes=500).withColumn("path", export.text_name(F.col("path"))).collect()
    assert sorted((x.path, x.line_no, x.line) for x in got) == sorted(rows)
    assert len(list((tmp_path / "t").glob("name=n1/*.txt"))) > 1


def test_packs_hold_texts_of_any_number_and_size(spark, tmp_path):
    names = ["a b/ü\t%", "plain", "p+q", None, *(f"s{k}" for k in range(300))]
    rows = [(n, i, f"\t{n}: {i} é" if i % 5 else "") for n in names for i in range(3)] + [("long", i, f"x{i}") for i in range(5000)]
    rows += [("breaks", 0, "a\rb\r\nc\n"), ("breaks", 1, None), ("breaks", 2, "d\r"), ("breaks", 3, "e")]
    df = spark.createDataFrame(rows, "name string, place int, line string").repartition(9)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as many packs as there are partitions
    try:
        export.write_packs(df, str(tmp_path / "p"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = {(n, i, x) for n, i, x in rows if n != "breaks"} | {("breaks", i, x) for i, x in enumerate(["a", "b", "c", "", "", "d", "e"])}
    packs = list((tmp_path / "p").glob("*.txt"))
    assert 1 < len(packs) < 10 and sum(b"long\t" in p.read_bytes() for p in packs) > 1
    for size in (None, 97, 1000):
        got = ingest.packed_lines(spark, str(tmp_path / "p"), split_bytes=size).collect()
        assert len(got) == len(want) and {(x.path, x.line_no, x.line) for x in got} == want


def test_logs_of_a_run_follow_by_name(spark):
    rows = spark.createDataFrame([("a/r1/x-10.log", 2, 1.0, 3.0), ("a/r1/x-02.log", 2, 1.0, 1.0), ("a/r1/x-02.log", 3, 1.0, 2.0), ("b/r2/y.log", 5, 1.0, 9.0)], "path string, line_no long, chi_q double, chi_r double")
    got = curves.chi_steps(ingest.run_logs(rows)).orderBy("run_id", "step").collect()
    assert [(x.run_id, x.step, x.chi_r) for x in got] == [("r1", 0, 1.0), ("r1", 1, 2.0), ("r1", 2, 3.0), ("r2", 0, 9.0)]


def test_catalogue_differences(spark, tmp_path):
    for name, text in (("a/x.log", "1"), ("a/y.csv", "12"), ("a/b/z.log", "123"), ("a/notes.txt", "n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    now = catalog.scan_files(spark, str(tmp_path))
    before = spark.createDataFrame(now.collect(), now.schema)
    (tmp_path / "a/x.log").write_text("longer")
    (tmp_path / "a/new.csv").write_text("1")
    assert remove(spark, str(tmp_path / "a/y.csv")) and not remove(spark, str(tmp_path / "a/y.csv"))
    found = catalog.changes(before, catalog.scan_files(spark, str(tmp_path)))
    assert {r.path.rsplit("/", 1)[1]: r.status for r in found.collect()} == {"x.log": "changed", "new.csv": "new", "y.csv": "gone", "z.log": "same"}
    assert sorted(p.rsplit("/", 1)[1] for p in catalog.to_read(found)) == ["new.csv", "x.log"]
    assert sorted((r.run_id, r.name) for r in catalog.scan_folders(spark, str(tmp_path)).collect()) == [("a", "b"), (tmp_path.name, "a")]


def test_nearest_point_equals_brute_force(spark):
    r = random.Random(3)
    points = [(f"p{k}", i, 1 + c, "ab"[c], r.choice([float(r.randrange(30)), r.random() * 30]), float(i)) for k in range(3) for c in range(2) for i in range(400)]
    points += [("p0", 900, 1, "a", float("nan"), 0.0), ("p0", 901, 1, "a", None, 0.0), ("lone", 0, 1, "a", 5.0, 1.0)]
    probes = [(f"p{k}", r.choice([float(r.randrange(-5, 35)), r.random() * 40 - 5])) for k in range(3) for _ in range(300)] + [("lone", -1.0), ("lone", 9.0), ("none", 1.0)]
    df = spark.createDataFrame(points, "path string, point_no int, col_no int, label string, x double, y double").repartition(5)
    got = curves.nearest_point(df, spark.createDataFrame(probes, "path string, probe double"))
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    want = set()
    for path, q in set(probes):
        for label in "ab":
            own = [(abs(x - q), i, x, y) for p, i, _, c, x, y in points if p == path and c == label and x is not None and not math.isnan(x)]
            if own:
                _, i, x, y = min(own)
                want.add((path, label, q, i, x, y))
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)


def test_ranks_keep_rows_with_null_keys(spark):
    rows = [(None if i % 3 else 1, i) for i in range(50)]
    got = ranked(spark.createDataFrame(rows, "g int, i int").repartition(4), ["g"], ["i"], k=["g"]).collect()
    want = {i: n for g in (None, 1) for n, i in enumerate(i for h, i in rows if h == g)}
    assert len(got) == 50 and all(x.k == want[x.i] for x in got)


def test_ranks_of_runs_share_places(spark):
    metrics = spark.createDataFrame([("a", "k", 2.0), ("b", "k", 1.0), ("c", "k", 2.0), ("d", "k", 3.0), ("e", None, 1.0), ("f", "k", None)], "path string, plot_kind string, rwp double")
    assert {r.path: r.place for r in curves.run_comparison(metrics).collect()} == {"b": 1, "a": 2, "c": 2, "d": 4, "e": 1}


def test_quantiles_with_outliers_and_odd_values(spark):
    r = np.random.default_rng(7)
    x = np.concatenate([r.random(20_000), [1e12, -1e300, 1e-320]])
    y = np.exp(r.normal(size=len(x)) * 60)  # magnitudes from 1e-100 to 1e100
    rows = [(0, float(a), float(b), 3.0) for a, b in zip(x, y)] + [(0, float("nan"), float("inf"), None), (1, float("nan"), float("nan"), float("-inf"))]
    got = {g.structure_id: g for g in density.quantile_limits(spark.createDataFrame(rows, "structure_id int, px double, py double, pz double"), bins=64, small=50).collect()}
    for a, v in (("x", x), ("y", y)):
        assert (got[0][f"{a}_lo"], got[0][f"{a}_hi"]) == pytest.approx(tuple(np.quantile(v, [0.01, 0.99])), rel=1e-12)
    assert (got[0].z_lo, got[0].z_hi, got[0].n_odd) == (3.0, 3.0, 2)
    assert got[1].n_odd == 3 and got[1].x_lo is None


def test_histogram_and_ranges_leave_odd_values_out(spark):
    rows = [(0, 1.0, 1.0, float(z)) for z in range(11)] + [(0, float("nan"), float("inf"), float("inf")), (0, 2.0, 2.0, float("nan"))]
    points = spark.createDataFrame(rows, "structure_id int, px double, py double, pz double")
    h = density.z_histogram(points, 5).orderBy("bin").collect()
    assert [x.n for x in h] == [2, 2, 2, 2, 3] and {x.n_odd for x in h} == {2}
    assert tuple(structure.axis_ranges(points).first())[1:] == (1.0, 2.0, 1.0, 2.0, 0.0, 10.0)


def test_slabs_hold_their_own_structure_and_any_thickness(spark):
    r = random.Random(5)
    points = [(s, i, r.choice([r.random() * 10, 5.0, -r.random()])) for s in (1, 2) for i in range(300)]
    df = spark.createDataFrame(points, "structure_id int, seq int, pz double").union(spark.createDataFrame([(1, 900, float("nan")), (1, 901, None)], "structure_id int, seq int, pz double"))
    slabs = [(1, 0, 5.0, 0.0), (1, 1, 5.0, 1e10), (2, 2, 5.0, 3.3), (2, 3, 0.0, 0.4), (2, 4, 2.0, 1e-9), (3, 5, 5.0, 50.0), (1, 6, 4.0, 2.0)]
    got = density.slab_filter(df, spark.createDataFrame(slabs, "structure_id int, slab_id int, z_center double, dz double"))
    want = sorted((s, i, slab) for s, i, z in points for t, slab, c, d in slabs if s == t and c - max(d, 1e-12) * 0.5 <= z <= c + max(d, 1e-12) * 0.5)
    assert sorted((x.structure_id, x.seq, x.slab_id) for x in got.collect()) == want
    shared = density.slab_filter(df, spark.createDataFrame([x[1:] for x in slabs], "slab_id int, z_center double, dz double"))
    assert shared.count() == sum(c - max(d, 1e-12) * 0.5 <= z <= c + max(d, 1e-12) * 0.5 for _, _, z in points for _, _, c, d in slabs)
    assert density.slab_filter(df, spark.createDataFrame([], "slab_id int, z_center double, dz double")).count() == 0


def test_slabs_in_length_go_into_the_filter(spark):
    cells = spark.createDataFrame([(1, [1.0] * 3, [[4.0, 0.0, 0.0], [0.0, 4.0, 0.0], [0.0, 0.0, 4.0]]), (2, [1.0] * 3, [[9.0, 0.0, 0.0], [0.0, 9.0, 0.0], [0.0, 0.0, 9.0]])], "structure_id int, supercell array<double>, lattice array<array<double>>")
    slabs = structure.slabs_in_length(spark.createDataFrame([(0, 0.5, 0.5)], "slab_id int, z_center double, dz double"), cells)
    points = spark.createDataFrame([(s, i, float(i)) for s in (1, 2) for i in range(10)], "structure_id int, seq int, pz double")
    assert sorted((x.structure_id, x.seq) for x in density.slab_filter(points, slabs).collect()) == [(1, 1), (1, 2), (1, 3)] + [(2, i) for i in (3, 4, 5, 6)]


def test_capped_fit_is_the_density_of_the_sample(spark):
    r = random.Random(9)
    rows = [(0, "Ga", 0, f"k{i}", r.random(), r.random()) for i in range(400)] + [(0, "Nb", 0, f"k{i}", r.random(), r.random()) for i in range(30)]
    inside = spark.createDataFrame(rows, "structure_id int, element string, slab_id int, seq_key string, px double, py double")
    capped = {(x.element, x.ix, x.iy): x.density for x in density.kde_slice(inside, 0.2, 16, fit_cap=50, seed=3).collect()}
    sample = density.fit_sample(inside, 50, 3).drop("fit_no")
    assert capped == pytest.approx({(x.element, x.ix, x.iy): x.density for x in density.kde_slice(sample, 0.2, 16).collect()})
    stats = {x.element: (x.slab_count, x.fit_count) for x in density.kde_slice_stats(density.kde_slice(inside, 0.2, 16, fit_cap=50, seed=3), density.slab_cov(inside, 0.2), 50).collect()}
    assert stats == {"Ga": (400, 50), "Nb": (30, 30)}


def brute(p):
    s = np.cov(p.T) * len(p) ** (-2 / 7)
    inverse, peak = np.linalg.inv(s), 1 / (len(p) * np.sqrt(np.linalg.det(s) * (2 * np.pi) ** 3))
    return np.array([np.exp(-0.5 * np.einsum("ij,jk,ik->i", p - x, inverse, p - x)).sum() * peak for x in p]), peak


def test_self_densities_equal_sums_over_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(selfdensity, "PART", 100)  # the cells of the large group are read in parts
    r = np.random.default_rng(2)
    a = r.multivariate_normal([1, 2, 3], [[2, 0.8, 0.1], [0.8, 1, 0.2], [0.1, 0.2, 3]], 3000)
    b = np.vstack([r.normal(size=(40, 3)), r.normal(size=(20, 3)) + 50, [[1e4, -1e4, 3.0]]])  # groups far apart and an outlier
    rows = [(0, "Ga", i, *map(float, x)) for i, x in enumerate(a)] + [(7, "Nb", i, *map(float, x)) for i, x in enumerate(b)]
    rows += [(0, "Se", i, float(i), 0.0, 0.0) for i in range(9)] + [(0, "P", i, float(i), float(i * i), 1.0 + i**3) for i in range(4)]
    points = spark.createDataFrame(rows, "structure_id int, element string, point_id int, px double, py double, pz double")
    got = {(x.element, x.point_id): x.density for x in selfdensity.kde_self(points).collect()}
    assert {k for k, _ in got} == {"Ga", "Nb"} and len(got) == len(a) + len(b)
    for name, p in (("Ga", a), ("Nb", b)):
        want, peak = brute(p)
        assert max(abs(got[name, i] - w) for i, w in enumerate(want)) < 1e-9 * len(p) * peak
        assert max(abs(got[name, i] / w - 1) for i, w in enumerate(want)) < 1e-6


@pytest.mark.parametrize("d", [0, 1, 3, 8])
def test_one_pair_is_exact_to_the_stated_bound(d):
    worst = 0.0
    for s in (-0.5, -0.2, 0.5):
        for t in (-0.5, 0.3, 0.5):
            series = selfdensity.powers(np.array([s])) @ selfdensity.shift(d) @ selfdensity.powers(np.array([t])).T
            worst = max(worst, abs(series[0, 0] - math.exp(-0.5 * (d + t - s) ** 2)))
    assert worst < 1e-10


def test_steps_are_counted_over_epochs_and_a_restart(spark, tmp_path):
    r = random.Random(1)
    logs = {run: [(f, line, 0.5, r.choice([r.random(), r.random(), float("nan")])) for f in range(6) for line in range(r.randrange(0, 9))] for run in ("a", "b", "c")}
    for half in (range(3), range(3, 6)):
        for f in half:
            rows = [(run, *x) for run, own in logs.items() for x in own if x[0] == f]
            r.shuffle(rows)
            spark.createDataFrame(rows, monitor.ROWS).coalesce(1).write.parquet(f"{tmp_path}/in/{f}")
        monitor.start_steps(monitor.read_chunks(spark, f"{tmp_path}/in", monitor.ROWS, 1), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.select("epoch_no").distinct().count() >= 5
    for run, own in logs.items():
        got = out.where(F.col("run_id") == run).orderBy("step").collect()
        assert [x.step for x in got] == list(range(len(own)))
        best = None
        for x, (_, _, _, chi) in zip(got, own):
            best = chi if best is None and not math.isnan(chi) else best if math.isnan(chi) or best is None else min(best, chi)
            assert (x.chi_r == chi or math.isnan(chi)) and x.best_chi == best


def test_bucketed_tables_need_no_exchange(spark, tmp_path):
    curve = [(f"p{k}", i, c, "of"[c - 1], float(i), float(i * c + k)) for k in range(5) for c in (1, 2) for i in range(20)]
    points = spark.createDataFrame(curve, "path string, point_no int, col_no int, label string, x double, y double")
    stored = archive.store(points, "test_curves", "path", f"{tmp_path}/curves", 4, order=("point_no",))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    got = curves.rwp(stored)
    assert "Exchange" not in plan(got) and "Exchange" in plan(curves.rwp(points))
    assert {r.path: r.rwp for r in got.collect()} == pytest.approx({r.path: r.rwp for r in curves.rwp(points).collect()})
    with pytest.raises(Exception):
        archive.store(points, "test_curves", "path", f"{tmp_path}/curves", 4)
    atoms = spark.createDataFrame([(k % 9, k, 0.1 * (k % 10), 0.2, 0.3) for k in range(200)], "structure_id int, seq int, cx double, cy double, cz double")
    cells = spark.createDataFrame([(k, [10.0] * 3, [[float(k + 1), 0.0, 0.0], [0.0, 2.0, 0.0], [0.0, 0.0, 3.0]]) for k in range(9)], "structure_id int, supercell array<double>, lattice array<array<double>>")
    a, c = archive.store(atoms, "test_atoms", "structure_id", f"{tmp_path}/atoms", 4), archive.store(cells, "test_cells", "structure_id", f"{tmp_path}/cells", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        folded = structure.fold_cartesian(structure.fold_fractional(a, c), c)
        assert "Exchange" not in plan(folded) and folded.count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_of_a_level_stand_in_one_array(spark):
    rows = [(0, "Ga", 0, x, y, math.exp(-((x - 4) ** 2 + (y - 5) ** 2) / 9)) for x in range(12) for y in range(12)]
    segments = contours.contour_segments(spark.createDataFrame(rows, "structure_id int, element string, slab_id int, ix int, iy int, density double"), 3)
    got = {r.level_no: [tuple(s) for s in r.lines] for r in contours.contour_lines(segments).collect()}
    want = {}
    for s in sorted(segments.collect(), key=lambda s: (s.iy, s.ix, s.seg_no)):
        want.setdefault(s.level_no, []).append((s.x0, s.y0, s.x1, s.y1))
    assert got == want and set(got) == {0, 1, 2}


def test_neutron_tag(spark):
    got = spark.createDataFrame([(0,), (1,), (12,)], "i int").select(catalog.neutron_tag(F.col("i"))).collect()
    assert [r[0] for r in got] == ["", "", " #12"]
