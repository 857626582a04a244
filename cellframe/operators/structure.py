"""Analytics of atom configurations.

atoms: structure_id, seq (orderable), element, reference_number, cx, cy, cz (fractions of the box), nx, ny, nz.
cells: structure_id, supercell array<double>, lattice array<array<double>>; one row per structure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import finite, floor_mod
from ..functions.storage import ranked, small_side, staged

AXES = ("x", "y", "z")


def is_element(element: str | None) -> Column:
    """Filter on one element; none, empty, `all`, `None` and `0` let everything through."""
    return F.lit(True) if not element or element.lower() in ("all", "none", "0") else F.col("element") == element


def _vector(i: int) -> Column:
    """Unit-cell vector i: the box vector divided by the number of cells along it."""
    return F.transform(F.get("lattice", F.lit(i)), lambda v: v / F.get("supercell", F.lit(i)))


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def cell_lengths(cells: DataFrame) -> DataFrame:
    """Edges of the unit cell, their share of the longest, and the ratio of the first two."""
    lengths = F.array(*[_norm(_vector(i)) for i in range(3)])
    got = cells.select("structure_id", lengths.alias("cell_lengths"))
    longest = F.greatest(F.array_max("cell_lengths"), F.lit(1e-9))
    return got.select("structure_id", "cell_lengths", F.transform("cell_lengths", lambda v: v / longest).alias("relative"), (F.get("cell_lengths", F.lit(0)) / F.get("cell_lengths", F.lit(1))).alias("aspect"))


def with_cells(atoms: DataFrame, cells: DataFrame) -> DataFrame:
    """Joins each structure's constants; Spark broadcasts them while they are under its size limit, or by a hint on cells.

    Give the hint with cells that are not read from a table: their size is not known, and a join by few structures has few large tasks.
    """
    return atoms.join(cells, "structure_id")


def reduce_coords(atoms: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds rx, ry, rz: box fractions less the cell's index; not folded."""
    got = with_cells(atoms, cells)
    return got.withColumns({f"r{a}": F.col(f"c{a}") - F.col(f"n{a}") / F.get("supercell", F.lit(i)) for i, a in enumerate(AXES)}).drop("supercell", "lattice")


def fold_fractional(atoms: DataFrame, cells: DataFrame, prefix: str = "c") -> DataFrame:
    """Adds ux, uy, uz: fractions of one unit cell, from box fractions (`c`) or reduced ones (`r`)."""
    got = with_cells(atoms, cells)
    return got.withColumns({f"u{a}": floor_mod(F.col(f"{prefix}{a}") * F.get("supercell", F.lit(i))) for i, a in enumerate(AXES)}).drop("supercell", "lattice")


def fold_reduced(atoms: DataFrame, cells: DataFrame) -> DataFrame:
    return fold_fractional(reduce_coords(atoms, cells), cells, "r")


def fold_cartesian(folded: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds px, py, pz: u0 a + u1 b + u2 c, for any cell."""
    got = with_cells(folded, cells.select("structure_id", *[_vector(i).alias(f"v{i}") for i in range(3)]))
    parts = {f"p{a}": sum((F.col(f"u{b}") * F.get(f"v{j}", F.lit(i)) for j, b in enumerate(AXES)), F.lit(0.0)) for i, a in enumerate(AXES)}
    return got.withColumns(parts).drop("v0", "v1", "v2")


def positions(atoms: DataFrame, cells: DataFrame, element: str | None = None, mode: str = "cartesian") -> DataFrame:
    """Folded atoms of one element or all, in Cartesian or fractional coordinates (px, py, pz)."""
    folded = fold_fractional(atoms.where(is_element(element)), cells)
    if mode == "fractional":
        return folded.withColumns({f"p{a}": F.col(f"u{a}") for a in AXES})
    return fold_cartesian(folded, cells)


def element_counts(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("structure_id", "element").agg(F.count(F.lit(1)).alias("n_atoms"))


def sites(atoms: DataFrame) -> DataFrame:
    """(structure_id, element, reference_number), each once."""
    return atoms.select("structure_id", "element", "reference_number").distinct()


def site_lists(atoms: DataFrame) -> DataFrame:
    """Sorted sites of each element."""
    return sites(atoms).groupBy("structure_id", "element").agg(F.sort_array(F.collect_list("reference_number")).alias("sites"))


def element_semi(frac: DataFrame, site_table: DataFrame, element: str) -> DataFrame:
    """Rows of a fractional table (structure_id, rn, ...) at the sites of one element; none if there is no such element."""
    own = site_table.where(F.col("element") == element).select("structure_id", F.col("reference_number").alias("rn"))
    return frac.join(small_side(staged(own)), ["structure_id", "rn"], "left_semi")  # a row a site


def element_errors(frac: DataFrame, site_table: DataFrame, element: str) -> DataFrame:
    """(structure_id, reason) of the structures of a fractional table that have no such element."""
    own = site_table.where(F.col("element") == element).select("structure_id")
    return frac.select("structure_id").distinct().join(own, "structure_id", "left_anti").select("structure_id", F.lit(f"no element {element}").alias("reason"))


def site_sample(atoms: DataFrame, max_points: int = 12_000) -> DataFrame:
    """A sample of at most max_points atoms a structure, even over its sites.

    Each site gives every stride-th of its atoms, up to its quota; structures within max_points give all.
    Adds sample_no and stride (total // max_points, 1 at least).
    """
    max_points = min(75_000, max(100, max_points))
    by_site = atoms.groupBy("structure_id", "reference_number").agg(F.count(F.lit(1)).alias("c"))
    # over sites, not atoms
    of_all = by_site.groupBy("structure_id").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("n_sites"))
    quota = F.greatest(F.lit(1), F.expr(f"{max_points} div n_sites"))
    site = by_site.join(of_all, "structure_id").withColumn("quota", quota).withColumn("step", F.greatest(F.lit(1), F.expr("c div quota")))
    got = ranked(atoms, ["structure_id", "reference_number"], ["seq"], k=["structure_id", "reference_number"]).join(site, ["structure_id", "reference_number"])
    small = F.col("total") <= max_points
    got = got.where(small | ((F.col("k") % F.col("step") == 0) & (F.expr("k div step") < F.col("quota"))))
    # at most max_points and a site's quota more of a structure
    order = Window.partitionBy("structure_id").orderBy("reference_number", "seq")
    got = got.withColumn("sample_no", F.row_number().over(order)).where(small | (F.col("sample_no") <= max_points))
    return got.withColumn("stride", F.greatest(F.lit(1), F.expr(f"total div {max_points}"))).drop("k", "c", "quota", "step", "total", "n_sites")


def stride_sample(atoms: DataFrame, target: int = 9_000) -> DataFrame:
    """Every stride-th atom of a structure; stride = max(1, n // min(n, target))."""
    counts = atoms.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n"))
    got = ranked(atoms, ["structure_id"], ["seq"], k=["structure_id"]).join(counts, "structure_id")
    return got.where(F.col("k") % F.greatest(F.lit(1), F.expr(f"n div least(n, {target})")) == 0).drop("n", "k")


def structure_summary(atoms: DataFrame, cells: DataFrame, max_points: int = 12_000) -> DataFrame:
    """Totals, sampled atoms, stride, elements, counts and sites by element, supercell and lattice of each structure."""
    counts = element_counts(atoms).join(site_lists(atoms), ["structure_id", "element"])
    by_name = F.sort_array(F.collect_list(F.struct("element", "n_atoms", "sites")))
    got = counts.groupBy("structure_id").agg(F.sum("n_atoms").alias("total_atoms"), by_name.alias("e"))
    sampled = site_sample(atoms, max_points).groupBy("structure_id").agg(F.count(F.lit(1)).alias("sampled_atoms"), F.first("stride").alias("sample_stride"))
    pair = lambda f: F.map_from_entries(F.transform("e", lambda x: F.struct(x["element"], x[f])))
    got = got.select("structure_id", "total_atoms", F.transform("e", lambda x: x["element"]).alias("elements"), pair("n_atoms").alias("element_counts"), pair("sites").alias("atom_indices"))
    return got.join(sampled, "structure_id").join(cells, "structure_id")


def frac_table(atoms: DataFrame, cells: DataFrame) -> DataFrame:
    """The reduced-coordinate table: structure_id, seq, rn, fx, fy, fz, nx, ny, nz."""
    got = reduce_coords(atoms, cells)
    return got.select("structure_id", "seq", F.col("reference_number").alias("rn"), *[F.col(f"r{a}").alias(f"f{a}") for a in AXES], "nx", "ny", "nz")


def frac_lines(table: DataFrame) -> DataFrame:
    """The table's lines of text: number, three fractions of five digits, three cell indices."""
    line = F.format_string("%3d    %.5f    %.5f    %.5f  %d  %d  %d", "rn", "fx", "fy", "fz", "nx", "ny", "nz")
    return table.select("structure_id", "seq", line.alias("line"))


def axis_ranges(folded: DataFrame) -> DataFrame:
    """Least and greatest finite coordinate along each axis; 0 and 1 where there is none."""
    ends = [f(F.when(finite(F.col(f"p{a}")), F.col(f"p{a}"))).alias(f"{a}_{n}") for a in AXES for f, n in ((F.min, "min"), (F.max, "max"))]
    got = folded.groupBy("structure_id").agg(*ends)
    return got.select("structure_id", *[F.coalesce(f"{a}_{n}", F.lit(d)).alias(f"{a}_{n}") for a in AXES for n, d in (("min", 0.0), ("max", 1.0))])


def extents(cells: DataFrame) -> DataFrame:
    """Plot limits along x and y: by the cell's edges, and by the largest component of each of its vectors."""
    edge = lambda i: _norm(_vector(i))
    largest = lambda i: F.array_max(_vector(i))
    return cells.select("structure_id", edge(0).alias("x_edge"), edge(1).alias("y_edge"), largest(0).alias("x_largest"), largest(1).alias("y_largest"))


def slabs_in_length(slabs: DataFrame, cells: DataFrame) -> DataFrame:
    """Slabs given as fractions of the cell (slab_id, z_center, dz), in each structure's unit of length."""
    c = cell_lengths(cells).select("structure_id", F.get("cell_lengths", F.lit(2)).alias("_c"))
    # a few slabs for each structure: exploded, not joined
    packed = slabs.agg(F.collect_list(F.struct("slab_id", "z_center", "dz")).alias("s"))
    got = c.withColumn("s", packed.scalar()).select("structure_id", "_c", F.explode("s").alias("s"))
    return got.select("structure_id", "s.slab_id", (F.col("s.z_center") * F.col("_c")).alias("z_center"), (F.col("s.dz") * F.col("_c")).alias("dz"))
