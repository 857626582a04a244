"""Known answers, edge cases and properties of the operators."""

import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.operators import contours, curves, density, structure
from cellframe.plans import adapters
from cellframe.sources import catalog, export, ingest
from cellframe.streaming import monitor


def curve(spark, obs, fit, path="a", x=None):
    rows = [(path, i, k, "of"[k - 1], float(x[i] if x else i), float(v)) for k, ys in ((1, obs), (2, fit)) for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "path string, point_no int, col_no int, label string, x double, y double")


def test_rwp_by_hand(spark):
    assert curves.rwp(curve(spark, [2, 4, 4], [1, 5, 6])).first().rwp == pytest.approx(math.sqrt(6 / 36))
    assert curves.rwp(curve(spark, [0, 0], [1, 5])).first().rwp == 0.0
    assert curves.rwp(curve(spark, [1, 2], [])).count() == 0


def test_rwp_is_unchanged_by_scale(spark):
    a = curves.rwp(curve(spark, [2, 4, 4], [1, 5, 6])).first().rwp
    assert curves.rwp(curve(spark, [20, 40, 40], [10, 50, 60])).first().rwp == pytest.approx(a)


def test_rwp_range_of_falling_x_is_zero(spark):
    assert curves.rwp_range(curve(spark, [2, 4, 4], [1, 5, 6], x=[3, 2, 1])).first().rwp == 0.0


def test_nearest_point_takes_first_of_equals(spark):
    probes = spark.createDataFrame([("a", 0.5)], "path string, probe double")
    got = {r.label: r.point_no for r in curves.nearest_point(curve(spark, [1, 2], [3, 4]), probes).collect()}
    assert got == {"o": 0, "f": 0}


def test_y_domain_of_flat_and_outside(spark):
    flat = curves.y_domain(curve(spark, [5, 5], []), 0, 1).first()
    assert (flat.y_lo, flat.y_hi) == (4.0, 6.0)
    outside = curves.y_domain(curve(spark, [0, 10], []), 50, 60).first()
    assert (outside.y_lo, outside.y_hi) == (-0.5, 10.5)


def test_chi_log_unclamped(spark):
    steps = spark.createDataFrame([("r", 0, 0.0), ("r", 1, -1.0), ("r", 2, math.e)], "run_id string, step int, chi_r double")
    got = [r.log_chi for r in curves.chi_log(steps, clamped=False).orderBy("step").collect()]
    assert got[0] == -math.inf and math.isnan(got[1]) and got[2] == pytest.approx(1.0)
    assert curves.chi_log(steps).orderBy("step").first().log_chi == pytest.approx(math.log(1e-12))


@pytest.mark.parametrize(
    "name,kind",
    [("GNSe_FT_XFQ1.csv", "xpdf"), ("GNSe_FQ1.csv", "xray_sq"), ("GNSe_SQ1.csv", "neutron_sq"), ("GNSe_bragg.csv", "bragg"), ("GNSe_PDFpartials.csv", "pdf_partials"), ("GNSe_PDF2.csv", "npdf"), ("GNSe-02.log", "r_value"), ("scale_ft.gr", "stog"), ("notes.txt", None), ("gnse_pdf1.csv", None)],
)
def test_plot_kind(spark, name, kind):
    assert spark.createDataFrame([(name,)], "name string").select(catalog.plot_kind(F.col("name"))).first()[0] == kind


def test_pdf_index(spark):
    got = spark.createDataFrame([("A_PDF12.csv",), ("A.csv",)], "name string").select(catalog.pdf_index(F.col("name"))).collect()
    assert [r[0] for r in got] == [12, 0]


#: Nine atoms along a diagonal of heights 1.0, 1.1 ... 1.8, and one far off.
STAIRS = [(0.1 * i, 0.9 - 0.07 * i * i % 0.8, 1.0 + 0.1 * i) for i in range(9)] + [(0.4, 0.4, 7.0)]


def stairs(spark, n=10):
    return spark.createDataFrame([(0, "Ga", i, *p) for i, p in enumerate(STAIRS[:n])], "structure_id int, element string, seq int, px double, py double, pz double")


def one_slab(spark, z=0.5, dz=0.08):
    return spark.createDataFrame([(0, z, dz)], "slab_id int, z_center double, dz double")


def test_slab_takes_both_faces_and_its_density_says_how_many(spark):
    inside = density.slab_filter(stairs(spark), one_slab(spark, 1.375, 0.75))  # 1.0 and 1.75 are its faces
    assert sorted(r.seq for r in inside.collect()) == list(range(8))
    grid = density.kde_slice(inside, bw=0.2, grid=20)
    stats = density.kde_slice_stats(grid, density.slab_cov(inside, 0.2)).first()
    assert (stats.slab_count, stats.fit_count) == (8, 8) and stats.vmax > stats.vmin
    assert grid.count() == 400


def test_few_and_singular_slabs(spark):
    few = density.kde_slice(density.slab_filter(stairs(spark, 3), one_slab(spark, 1.0, 1.0)), grid=2)
    assert few.count() == 256 and {r.density for r in few.collect()} == {0.0}
    line = spark.createDataFrame([(0, "Ga", 0.1 * i, 0.1 * i, 0.5) for i in range(8)], "structure_id int, element string, px double, py double, pz double")
    got = density.kde_slice(density.slab_filter(line, one_slab(spark)), grid=16)
    assert {r.density for r in got.collect()} <= {None} or density.slab_cov(density.slab_filter(line, one_slab(spark))).first().det >= 0


def test_truncated_kernel_is_near_exact_and_integrates_to_one(spark):
    r = random.Random(2)
    pts = spark.createDataFrame([(0, "Ga", r.gauss(0.5, 0.1), r.gauss(0.5, 0.1), 0.5) for _ in range(200)], "structure_id int, element string, px double, py double, pz double")
    inside = density.slab_filter(pts, one_slab(spark)).cache()
    args = dict(bw=0.3, grid=60, xlim=(-0.5, 1.5), ylim=(-0.5, 1.5))
    a = {(r.ix, r.iy): r.density for r in density.kde_slice(inside, **args).collect()}
    b = {(r.ix, r.iy): r.density for r in density.kde_slice(inside, reach=1e3, **args).collect()}
    assert max(abs(a[k] - b[k]) for k in b) < 1e-6
    assert sum(a.values()) * (2 / 59) ** 2 == pytest.approx(1.0, abs=1e-3)


@pytest.mark.parametrize("tilt", [-0.99, 0.0, 0.9999])
def test_density_of_correlated_atoms_by_force(spark, tilt):
    """Kernels far from round, a view that is not square and cuts through the atoms, and two slabs, of which one is too small."""
    r, lims = np.random.default_rng(4), ((0.2, 0.9), (-1.0, 0.6))
    x = r.normal(0.5, 0.1, 150)
    y = tilt * (x - 0.5) * 3 + math.sqrt(1 - tilt * tilt) * r.normal(0, 0.3, 150)
    rows = [(0, "Ga", float(a), float(b), 0.5, 0) for a, b in zip(x, y)] + [(0, "N", 0.5, 0.1 * i, 0.5, 1) for i in range(4)]
    inside = spark.createDataFrame(rows, "structure_id int, element string, px double, py double, pz double, slab_id int")
    got = density.kde_slice(inside, bw=0.25, grid=40, xlim=lims[0], ylim=lims[1]).toPandas()
    assert len(got) == 2 * 1600 and set(got[got.element == "N"].density) == {0.0} and got.groupby("element").status.first().to_dict() == {"Ga": "ok", "N": "few"}
    inverse = np.linalg.inv(np.cov(x, y) * 0.25**2)
    at = np.stack(np.meshgrid(*[np.linspace(*lim, 40) for lim in lims], indexing="ij"), axis=-1)[:, :, None, :] - np.stack([x, y], axis=-1)
    want = np.exp(-0.5 * np.einsum("xyni,ij,xynj->xyn", at, inverse, at)).mean(axis=2) * math.sqrt(np.linalg.det(inverse)) / (2 * math.pi)
    ga = got[got.element == "Ga"]
    assert np.allclose(ga.density, want[ga.ix, ga.iy], rtol=1e-7, atol=1e-11)


def test_contour_ends_lie_on_the_level(spark):
    rows = [(0, "Ga", 0, x, y, math.exp(-((x - 4) ** 2 + (y - 5) ** 2) / 9)) for x in range(12) for y in range(12)]
    grid = spark.createDataFrame(rows, "structure_id int, element string, slab_id int, ix int, iy int, density double")
    v = {(x, y): d for *_, x, y, d in rows}
    segments = contours.contour_segments(grid, 4).collect()
    assert segments

    def value(x, y):
        x0, y0 = min(int(x), 10), min(int(y), 10)
        fx, fy = x - x0, y - y0
        return (v[x0, y0] * (1 - fx) + v[x0 + 1, y0] * fx) * (1 - fy) + (v[x0, y0 + 1] * (1 - fx) + v[x0 + 1, y0 + 1] * fx) * fy

    for s in segments:
        assert value(s.x0, s.y0) == pytest.approx(s.level, abs=1e-9) and value(s.x1, s.y1) == pytest.approx(s.level, abs=1e-9)
    assert contours.contour_segments(grid.withColumn("density", F.lit(0.0)), 4).count() == 0
    assert contours.contour_segments(grid, 0).count() == 0


def test_fold_is_unchanged_by_whole_cells(spark, sf_dir):
    a, cells = adapters.atoms(spark, sf_dir).limit(300).cache(), adapters.cells(spark)
    one = structure.fold_fractional(a, cells).select("seq", "ux").collect()
    two = {r.seq: r.ux for r in structure.fold_fractional(a.withColumn("cx", F.col("cx") + 3 / 10), cells).select("seq", "ux").collect()}
    for r in one:
        d = abs(r.ux - two[r.seq])
        assert min(d, 1 - d) < 1e-9
    tiny = structure.fold_fractional(a.limit(1).withColumn("cx", F.lit(-1e-20)), cells).first().ux
    assert tiny == 1.0


def test_site_sample_covers_sites_and_keeps_the_cap(spark, sf_dir):
    a = adapters.atoms(spark, sf_dir)
    got = structure.site_sample(a, 300)
    per = {r.structure_id: r for r in got.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("reference_number").alias("s")).collect()}
    want = {r.structure_id: r.s for r in a.groupBy("structure_id").agg(F.count_distinct("reference_number").alias("s")).collect()}
    assert all(per[k].n <= 300 and per[k].s == want[k] for k in want)


CONFIG = """(Version 6)
Supercell dimensions: 1 1 1
Supercell dimensions: 10 10 10
Lattice vectors (Ang):
 104.0 0.0 0.0
 0.0 104.0 0.0
 0.0 0.0 104.0
Atoms:
 1 Ga [1] 0.01 -0.02 0.03 4 0 0 0
 2 Nb [1] 0.11 0.12 0.13 5 1 1 1
 3 Nb [1] 0.11 0.12 0.13 x 1 1 1
 4 Se [1] 0.11 0.12 0.13 6 1 1
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("runs") / "run1"
    d.mkdir()
    files = {
        "A_FQ1.csv": "Q, F(Q)_RMC, F(Q)_Expt\r\n0.5, -1.0, -0.6, \r\n1.0, 2.0, 3.0, \r\n", "B_FQ1.csv": "Q,a,b\n1,2,3\n1,,3\n", "C_FQ1.csv": "", "D_FQ1.csv": "Q,a\n", "E-1.log": "h\nh\nt 1 2 3\n4\nt 5 6\n", "F-1.log": "h\nh\n1 x\n",
        "I_FQ1.csv": "Q,,F\n1,2,3\n4,5,6", "J_FQ1.csv": "Q\n1\n2\n", "scale_ft.sq": "h\nh\n1 2\n3\n4 5\n", "scale_ft_rmc.fq": "h\nh\n1\n2\n", "K.rmc6f": "Supercell 2 2 2\nLattice\n1 0 0\n0 x 0\n0 0 1\nAtoms:\n",
        "L.rmc6f": "Supercell 2 2 2\nLattice\n1 0 0\n0 1 0\n0 0 1\nSupercell 3 3\nAtoms:\n 9 Ga 7 0 0 0\n 9 Ga 3 0 0 0\n 9 Nb x 0 0 0\n1 Nb 2 0\n", "scale_ft.gr": "h\nh\n 1 2 9\n 3 4 9\n", "stog_input.dat": "title\n scale_ft.gr raw\n", "G.rmc6f": CONFIG, "H.rmc6f": "no atoms\n", "Frac_x.txt": "h\n" * 5 + "  4    0.07507    0.07511    0.07275  0  0  0\nbad\n", "notes.txt": "x",
    }
    for name, text in files.items():
        (d / name).write_bytes(text.encode())
    return str(d.parent)


def name_of(df):
    return df.withColumn("path", F.element_at(F.split("path", "/"), -1))


def test_ingest(spark, folder):
    lines = name_of(ingest.raw_lines(spark, folder)).cache()
    blank = ingest.csv_points(lines.where("path = 'I_FQ1.csv'")).orderBy("point_no", "col_no").collect()
    assert [(r.label, r.y) for r in blank] == [("Series 1", 2.0), ("F", 3.0), ("Series 1", 5.0), ("F", 6.0)]
    assert ingest.stog_points(lines.where("path in ('scale_ft.sq', 'scale_ft_rmc.fq')")).count() == 0
    assert [(r.element, r.sites) for r in ingest.site_index(lines.where("path = 'L.rmc6f'")).collect()] == [("Ga", [3, 7])]
    csv = ingest.csv_points(lines.where("path like '%.csv' and path <> 'I_FQ1.csv'"))
    assert sorted((r.path, r.point_no, r.col_no, r.label, r.x, r.y) for r in csv.collect()) == [
        ("A_FQ1.csv", 0, 1, "F(Q)_RMC", 0.5, -1.0), ("A_FQ1.csv", 0, 2, "F(Q)_Expt", 0.5, -0.6), ("A_FQ1.csv", 1, 1, "F(Q)_RMC", 1.0, 2.0), ("A_FQ1.csv", 1, 2, "F(Q)_Expt", 1.0, 3.0),
    ]
    assert sorted((r.path, r.chi_q, r.chi_r) for r in ingest.chi_rows(lines.where("path like '%.log'")).collect()) == [("E-1.log", 2.0, 3.0), ("E-1.log", 5.0, 6.0)]
    assert [(r.x, r.y) for r in ingest.stog_points(lines.where("path = 'scale_ft.gr'")).orderBy("point_no").collect()] == [(1.0, 2.0), (3.0, 4.0)]
    atoms = ingest.atoms(lines.where("path like '%.rmc6f'")).orderBy("seq").collect()
    assert [(a.atom_number, a.element, a.reference_number, a.cy) for a in atoms] == [(1, "Ga", 4, -0.02), (2, "Nb", 5, 0.12)]
    cell = ingest.cell_metadata(lines.where("path like '%.rmc6f'")).collect()
    assert len(cell) == 1 and list(cell[0].supercell) == [10.0] * 3 and cell[0].lattice[1][1] == 104.0
    assert [(r.rn, r.fx) for r in ingest.frac_rows(lines.where("path = 'Frac_x.txt'")).collect()] == [(4, 0.07507)]
    kinds = spark.createDataFrame([(f"{c}_FQ1.csv", "csv") for c in "ABCDIJ"] + [("E-1.log", "chi"), ("F-1.log", "chi"), ("H.rmc6f", "atoms"), ("scale_ft.sq", "stog"), ("scale_ft_rmc.fq", "stog")], "path string, kind string")
    assert sorted(tuple(r) for r in ingest.ingest_errors(lines, kinds).collect()) == [
        ("B_FQ1.csv", "rows of different length"), ("C_FQ1.csv", "empty file"), ("D_FQ1.csv", "no numeric rows"), ("F-1.log", "not a number"), ("H.rmc6f", "no Atoms section"), ("J_FQ1.csv", "fewer than two numeric columns"),
        ("scale_ft.sq", "rows of different length"), ("scale_ft_rmc.fq", "fewer than two numeric columns"),
    ]
    cell = spark.createDataFrame([(f"{c}.rmc6f", "cell") for c in "GHKL"], "path string, kind string")
    assert sorted(tuple(r) for r in ingest.ingest_errors(lines, cell).collect()) == [("H.rmc6f", "no lattice or supercell"), ("K.rmc6f", "lattice or supercell is not numeric"), ("L.rmc6f", "lattice or supercell is not numeric")]


def test_titles_and_labels(spark):
    names = ["G_FT_XFQ1.csv", "G_PDF2.csv", "G_PDFpartials.csv", "G_FQ1.csv", "G_SQ1.csv", "G_bragg.csv", "G-02.log", "scale_ft.gr", "scale_ft.sq"]
    files = catalog.with_kind(spark.createDataFrame([(n, " Q " if "FQ1" in n else " x (A^-1)") for n in names], "name string, first_label string"))
    got = {r.name: (r.title, r.x_label, r.y_label) for r in catalog.labelled(files).collect()}
    assert [got[n] for n in names] == [
        ("xPDF", "r (Å)", "data"), ("PDF2", "r (Å)", "data"), ("PDFpartials", "r (Å)", "data"), ("S(Q) (x-ray)", "Q (Å^{-1})", "data"), ("S(Q) (neutron)", "x (Å^{-1})", "data"),
        ("BRAGG", "Q (Å^{-1})", "data"), ("R-value", "Time steps", "log(χ)"), ("scale_ft.gr", "r (Å)", "G(r)"), ("scale_ft.sq", "Q (Å^{-1})", "S(Q)"),
    ]


def test_payload_of_a_log(spark):
    import json

    steps = spark.createDataFrame([("a.log", 0, 1.0), ("a.log", 1, 0.0)], "run_id string, step long, chi_r double")
    files = catalog.labelled(catalog.with_kind(spark.createDataFrame([("a.log", "a.log")], "path string, name string"))).withColumn("metrics", F.create_map(F.lit("final_chi_r"), F.lit(0.0)))
    payloads = curves.plot_payload(files, curves.chi_series(steps))
    got = json.loads(payloads.first().payload)
    assert got["kind"] == "r_value" and got["metrics"] == {"final_chi_r": 0.0} and got["xLabel"] == "Time steps"
    assert [s["label"] for s in got["series"]] == ["R"] and got["series"][0]["x"] == [0.0, 1.0] and got["series"][0]["y"] == pytest.approx([0.0, -27.631021])
    assert curves.read_payload(payloads).first().r.title == "R-value"


def test_quantiles_with_ties_and_one_value(spark):
    import numpy as np

    r = np.random.default_rng(1)
    rows = [(0, float(x), 1.0, float(round(y, 1))) for x, y in zip(r.normal(size=500), r.normal(size=500))] + [(1, 5.0, 5.0, 5.0)]
    got = {x.structure_id: x for x in density.quantile_limits(spark.createDataFrame(rows, "structure_id int, px double, py double, pz double"), bins=16).collect()}
    own = np.array([x[1:] for x in rows[:-1]])
    for k, a in enumerate("xyz"):
        assert (got[0][f"{a}_lo"], got[0][f"{a}_hi"]) == pytest.approx(tuple(np.quantile(own[:, k], [0.01, 0.99])))
        assert got[1][f"{a}_lo"] == got[1][f"{a}_hi"] == 5.0


def test_scan_files(spark, folder):
    files = catalog.scan_files(spark, folder)
    got = {r.name: r.plot_kind for r in files.collect()}
    assert got["A_FQ1.csv"] == "xray_sq" and got["E-1.log"] == "r_value" and "notes.txt" not in got
    lines = ingest.raw_lines(spark, folder, "stog_input.dat").withColumn("run_id", F.lit("run1")).withColumn("name", F.lit("stog_input.dat"))
    assert [r.name for r in ingest.stog_inputs(lines, files).collect()] == ["scale_ft.gr"]


def test_frac_lines_and_write(spark, tmp_path):
    a = spark.createDataFrame([(0, 1, "Ga", 4, 0, 0, 0, 0.07507, 0.07511, 0.07275)], "structure_id int, seq int, element string, reference_number int, nx int, ny int, nz int, cx double, cy double, cz double")
    t = structure.frac_table(a, adapters.cells(spark))
    assert structure.frac_lines(t).first().line == "  4    0.07507    0.07511    0.07275  0  0  0"
    out = str(tmp_path / "f")
    export.write_frac(t, out)
    got = ingest.raw_lines(spark, out, folders=True).orderBy("line_no").collect()
    assert [r.line_no for r in got] == list(range(6)) and [r.line for r in got[:5]] == list(export.FRAC_HEADER) and got[5].line == "  4    0.07507    0.07511    0.07275  0  0  0"
    assert got[0].path.endswith("name=Frac_coord_0.txt")
    with pytest.raises(Exception):
        export.write_frac(t, out)
    export.write_frac(t, out, overwrite=True)


def test_monitor_stream_equals_batch(spark, tmp_path):
    rows = [("a", 0, 1.0, 3.0), ("b", 0, 1.0, 9.0), ("a", 1, 1.0, 2.0), ("a", 2, 1.0, 2.5)]
    for i in range(2):
        spark.createDataFrame(rows[2 * i : 2 * i + 2], monitor.SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    got = {}

    def sink(frame, epoch):
        got.update({r.run_id: tuple(r) for r in frame.collect()})

    q = monitor.start(monitor.read_chunks(spark, str(tmp_path / "in")), sink, str(tmp_path / "cp"))
    q.awaitTermination(60)
    want = {r.run_id: tuple(r) for r in monitor.monitor(spark.createDataFrame(rows, monitor.SCHEMA)).collect()}
    assert got == want and want["a"] == ("a", 2.5, 2.0, 3)


def test_histograms_and_quantiles(spark):
    pts = spark.createDataFrame([(0, float(i), 0.0, float(i)) for i in range(101)], "structure_id int, px double, py double, pz double")
    h = density.z_histogram(pts, 10).orderBy("bin").collect()
    assert [r.n for r in h] == [10] * 9 + [11] and sum(r.density * 10 for r in h) == pytest.approx(1.0)
    assert density.xz_histogram(pts, 5, (0, 50), (0, 50)).agg(F.sum("n")).first()[0] == 51
    assert density.quantile_limits(pts).first().x_lo == pytest.approx(1.0)


def test_entry_imports():
    import __spark_entry__ as e

    assert {"rwp", "kde_slice"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert os.path.exists(e.__file__)


def test_self_density_on_a_grid_comes_near_the_exact_one(spark, sf_dir):
    import numpy as np

    r = np.random.default_rng(2)
    rows = [(0, "Ga", i, *map(float, x)) for i, x in enumerate(r.multivariate_normal([1, 2, 3], [[2, 0.8, 0.1], [0.8, 1, 0.2], [0.1, 0.2, 3]], 150))] + [(0, "Nb", i, 1.0, 1.0, 1.0) for i in range(9)]
    points = spark.createDataFrame(rows, "structure_id int, element string, point_id int, px double, py double, pz double")
    got = {x.point_id: x.density for x in density.kde_self_grid(points, step=0.125, reach=5.0).collect()}
    want = {x.point_id: x.density for x in density.kde_self_3d(points).collect()}
    assert len(got) == len(want) == 150
    p = np.array([x[3:] for x in rows[:150]])
    s = np.cov(p.T) * 150 ** (-2 / 7)
    peak = 1 / (150 * np.sqrt(np.linalg.det(s) * (2 * np.pi) ** 3))
    assert all(abs(got[k] - want[k]) < 0.0125 * max(want.values()) + 0.012 * peak for k in want)
    brute = [np.sum(np.exp(-0.5 * np.einsum("ij,jk,ik->i", p - x, np.linalg.inv(s), p - x))) * peak for x in p]
    assert [want[k] for k in range(150)] == pytest.approx(brute)
    everything = adapters.points(spark, sf_dir).groupBy("structure_id", "element").count().count()
    from cellframe.plans import queries

    assert queries.kde_self_grid(spark, sf_dir).select("structure_id", "element").distinct().count() == everything


def test_row_numbers_without_a_window(spark):
    from cellframe.functions.storage import ranked

    r = random.Random(1)
    rows = [(int(r.random() < 0.9), r.randrange(5), i) for i in range(3000)]
    r.shuffle(rows)
    got = ranked(spark.createDataFrame(rows, "g int, s int, i int").repartition(7), ["g", "s"], ["i"], k=["g", "s"], of_g=["g"]).collect()
    want, seen = {}, {}
    for g, s, i in sorted(rows):
        want[i] = (seen.setdefault((g, s), 0), seen.setdefault(g, 0))
        seen[g, s] += 1
        seen[g] += 1
    assert len(got) == 3000 and all((x.k, x.of_g) == want[x.i] for x in got)


def test_cell_edges_and_extents_by_hand(spark):
    cells = spark.createDataFrame([(1, [2.0, 10.0, 5.0], [[6.0, 8.0, 0.0], [-30.0, 40.0, 0.0], [0.0, 0.0, 60.0]])], "structure_id int, supercell array<double>, lattice array<array<double>>")
    got = structure.cell_lengths(cells).first()
    assert got.cell_lengths == pytest.approx([5.0, 5.0, 12.0]) and got.relative == pytest.approx([5 / 12, 5 / 12, 1.0]) and got.aspect == pytest.approx(1.0)
    assert tuple(structure.extents(cells).first()) == pytest.approx((1, 5.0, 5.0, 4.0, 4.0))
    slab = structure.slabs_in_length(spark.createDataFrame([(7, 0.5, 0.25)], "slab_id int, z_center double, dz double"), cells).first()
    assert tuple(slab) == pytest.approx((1, 7, 6.0, 3.0))


@pytest.mark.parametrize("cap", [0, 1, 40, 5000])
def test_fit_sample_takes_the_smallest_digests(spark, cap):
    rows = [(k % 3 or None, "Nb", k % 2, None if k % 97 == 0 else f"a{k % 700}") for k in range(2000)]
    df = spark.createDataFrame(rows, "structure_id int, element string, slab_id int, seq_key string")
    groups = {}
    for s, _, slab, key in rows:
        groups.setdefault((s, slab), []).append((key is not None, key and hashlib.md5(f"5:{key}".encode()).hexdigest(), key))
    want = sorted((repr(g), n + 1, repr(x[2])) for g, v in groups.items() for n, x in enumerate(sorted(v, key=lambda x: (x[0], x[1] or "", x[2] or ""))[:cap]))
    got = density.fit_sample(df, cap, 5)
    assert got.columns == [*df.columns, "fit_no"]
    assert sorted((repr((r.structure_id, r.slab_id)), r.fit_no, repr(r.seq_key)) for r in got.collect()) == want
