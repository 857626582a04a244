"""Readers of run files: labelled curves, convergence logs, plain tables, configurations, fractional tables.

Each reader takes raw_lines (path, line_no, line) and returns typed rows.  A file that breaks its format gives no
rows and one row in ingest_errors instead of an exception, so that one bad file cannot fail a batch.  Files are cut
into blocks wherever their size asks for it: no reader needs a file's lines in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import cells, header_cells, to_double, to_int, tokens
from ..functions.storage import ranked, small_side, staged

SPLIT = "spark.sql.files.maxPartitionBytes"


def raw_lines(spark: SparkSession, paths, glob: str | None = None, folders: bool = False, split_bytes: int | None = None) -> DataFrame:
    """(path, line_no, line) of text files of any size; line ends may be LF, CRLF or CR.

    A file is read in byte blocks (`split_bytes`, else the session's setting), each by a task of its own.  The lines are
    written once with their block and their place in it; a line's number is its place plus the running total of the
    lines in the blocks before.  folders: the files of one folder are one text, in the order of their names, as
    `export.write_texts` leaves them; path is the folder then.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    held = _blocks(reader.text(paths), split_bytes, F.col("value").alias("line"))
    path = F.regexp_replace("file", "/[^/]*$", "") if folders else F.col("file")
    return _numbered(held, path, ["file", "block"])


def packed_lines(spark: SparkSession, root: str, split_bytes: int | None = None) -> DataFrame:
    """(path, line_no, line) of the texts in packs, as `export.write_packs` leaves them; path is the text's name.

    Packs are read in byte blocks like the files of raw_lines, and a text may begin and end anywhere in them.
    """
    value, tab = F.col("value"), F.locate("\t", F.col("value"))
    text = spark.read.option("recursiveFileLookup", True).text(root)
    held = _blocks(text, split_bytes, F.substring(value, F.lit(1), tab - 1).alias("name"), F.substring(value, tab + 1, F.length(value)).alias("line"))
    return _numbered(held, F.nullif(F.url_decode("name"), F.lit("")), ["name", "file", "block"])


def _blocks(text: DataFrame, split_bytes: int | None, *columns: Column) -> DataFrame:
    """Columns of the lines of text, with their file, their block of split_bytes (else of the session's setting) and `at`, which rises within a block; written once."""
    spark = text.sparkSession
    placed = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), *columns)
    before = spark.conf.get(SPLIT)
    try:
        spark.conf.set(SPLIT, split_bytes or before)
        return staged(placed)
    finally:
        spark.conf.set(SPLIT, before)


def _numbered(held: DataFrame, path: Column, keys: list[str]) -> DataFrame:
    """(path, line_no, line): a line's place among those with its keys, a text's in one block, plus the lines of the text's blocks before."""
    counts = held.groupBy(*keys).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("path", path)
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = small_side(staged(counts.select(*keys, "path", (earlier - F.col("first")).alias("shift"))))  # a row per text and block
    return held.join(counts, keys).select("path", (F.col("at") + F.col("shift")).alias("line_no"), "line")


def even(rows: DataFrame, values: str, least: int = 2) -> DataFrame:
    """The rows of files all of whose rows have equally many numbers, `least` at least, and nothing else."""
    v = F.col(values)
    good = rows.groupBy("path").agg(F.min(F.size(v)).alias("lo"), F.max(F.size(v)).alias("hi"), F.max(F.exists(v, lambda x: x.isNull())).alias("odd"))
    return rows.join(good.where((F.col("lo") == F.col("hi")) & ~F.col("odd") & (F.col("lo") >= least)).select("path"), "path", "left_semi")


def csv_points(lines: DataFrame) -> DataFrame:
    """(path, point_no, col_no, label, x, y) of labelled comma-separated curves.

    Line 0 has the labels, which keep their places: a blank one becomes `Series` and its column's number.  In data
    lines blank cells are left out, which moves later values to the left; column 0 is x.  Files with a cell that is no
    number, with rows of different length or with fewer than two columns give no rows.
    """
    heads = lines.where("line_no = 0").select("path", header_cells(F.col("line")).alias("labels"))
    data = lines.where("line_no > 0").select("path", "line_no", F.transform(cells(F.col("line")), to_double).alias("v")).where(F.size("v") > 0)
    data = ranked(even(data, "v"), ["path"], ["line_no"], point_no=["path"]).join(heads, "path")
    out = data.select("path", F.col("point_no").cast("int").alias("point_no"), "labels", F.get("v", F.lit(0)).alias("x"), F.posexplode("v").alias("col_no", "y")).where("col_no > 0")
    label = F.coalesce(F.nullif(F.get("labels", F.col("col_no")), F.lit("")), F.concat(F.lit("Series "), F.col("col_no").cast("string")))
    return out.select("path", "point_no", "col_no", label.alias("label"), "x", "y")


def log_place(path: Column) -> tuple[Column, Column]:
    """(run_id, name) of a log file by its path: the folder and the file's name."""
    parts = F.split(path, "/")
    return F.element_at(parts, -2), F.element_at(parts, -1)


def chi_rows(lines: DataFrame) -> DataFrame:
    """(path, line_no, chi_q, chi_r): the last two tokens of each line from the third; a bad number drops the file."""
    rows = lines.where("line_no >= 2").withColumn("t", tokens(F.col("line"))).where(F.size("t") >= 2)
    rows = rows.select("path", "line_no", to_double(F.element_at("t", -2)).alias("chi_q"), to_double(F.element_at("t", -1)).alias("chi_r"))
    bad = rows.where("chi_q is null or chi_r is null").select("path").distinct()
    return rows.join(bad, "path", "left_anti")


def run_logs(rows: DataFrame, place=log_place) -> DataFrame:
    """(run_id, file_no, line_no, chi_q, chi_r) of chi_rows: the logs of a run follow one another by name.

    place: run_id and the name that orders a run's files, from the path; numbers are given over files, not lines.
    """
    run, name = place(F.col("path"))
    files = rows.select("path").distinct().select("path", run.alias("run_id"), name.alias("name"))
    files = files.withColumn("file_no", F.row_number().over(Window.partitionBy("run_id").orderBy("name", "path")) - 1)
    return rows.join(small_side(staged(files)), "path").select("run_id", "file_no", "line_no", "chi_q", "chi_r")


def stog_points(lines: DataFrame) -> DataFrame:
    """(path, point_no, x, y, cols): white-space separated numbers from the third line.

    Every line with a token counts: files with rows of different length, of one column, or with a token that is no number give no rows.
    """
    rows = lines.where("line_no >= 2").select("path", "line_no", F.transform(tokens(F.col("line")), to_double).alias("cols")).where(F.size("cols") >= 1)
    rows = ranked(even(rows, "cols"), ["path"], ["line_no"], point_no=["path"])
    return rows.select("path", F.col("point_no").cast("int").alias("point_no"), F.get("cols", F.lit(0)).alias("x"), F.get("cols", F.lit(1)).alias("y"), "cols")


def atoms(lines: DataFrame) -> DataFrame:
    """Atoms of configuration files: lines of ten tokens and more after the line that begins with `Atoms:`.

    Lines with a token that does not parse are left out.
    """
    rows = atom_lines(lines).where(F.size("t") >= 10)
    at = lambda i: F.get("t", F.lit(i))
    rows = rows.select(
        "path", F.col("line_no").cast("long").alias("seq"), to_int(at(0)).alias("atom_number"), at(1).alias("element"), at(2).alias("type_label"),
        *[to_double(at(3 + i)).alias(c) for i, c in enumerate(("cx", "cy", "cz"))], to_int(at(6)).alias("reference_number"),
        *[to_int(at(7 + i)).alias(c) for i, c in enumerate(("nx", "ny", "nz"))],
    )
    return rows.dropna()


def atom_lines(lines: DataFrame) -> DataFrame:
    """(path, line_no, t): the tokens of the lines after the one that begins with `Atoms:`."""
    t = lines.withColumn("t", tokens(F.col("line")))
    start = t.where(F.get("t", F.lit(0)) == "Atoms:").groupBy("path").agg(F.min("line_no").alias("start"))
    return t.join(start, "path").where(F.col("line_no") > F.col("start")).select("path", "line_no", "t")


def site_index(lines: DataFrame) -> DataFrame:
    """(path, element, sites) of configuration files: the sorted sites of each element.

    The site is the fourth token from the end of a line of five tokens and more, the element the second; unlike `atoms` this asks for nothing else of the
    line.  Lines whose site is no whole number are left out.
    """
    rows = atom_lines(lines).where(F.size("t") >= 5).select("path", F.get("t", F.lit(1)).alias("element"), to_int(F.element_at("t", -4)).alias("site")).where("site is not null")
    return rows.distinct().groupBy("path", "element").agg(F.sort_array(F.collect_list("site")).alias("sites"))


def cell_metadata(lines: DataFrame) -> DataFrame:
    """(path, supercell, lattice): of the last `Supercell` and `Lattice` lines.

    Files without either, or whose last ones do not give three and nine numbers, are left out.
    """
    head = F.regexp_extract("line", r"^\s*(\S+)", 1)
    heads = lines.where(head.isin("Supercell", "Lattice")).select("path", "line_no", head.alias("head"), tokens(F.col("line")).alias("t"))
    three = F.transform(F.slice("t", -3, 3), to_double)
    sizes = heads.where("head = 'Supercell'").groupBy("path").agg(F.max_by(three, "line_no").alias("supercell"))
    # only the three lines after the last `Lattice` line are fetched, wherever they stand
    last = heads.where("head = 'Lattice'").groupBy("path").agg(F.max("line_no").alias("from"))
    wanted = last.select("path", F.posexplode(F.array(*[F.col("from") + i for i in (1, 2, 3)])).alias("row", "line_no"))
    numbers = F.transform(F.slice(tokens(F.col("line")), 1, 3), to_double)
    lattice = lines.join(wanted, ["path", "line_no"]).groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", numbers.alias("v")))), lambda r: r["v"]).alias("lattice"))
    whole = lambda a, n: (F.size(a) == n) & ~F.exists(a, lambda x: x.isNull())
    return sizes.join(lattice, "path").where(whole(F.col("supercell"), 3) & whole(F.flatten("lattice"), 9) & (F.size("lattice") == 3))


def frac_rows(lines: DataFrame) -> DataFrame:
    """(path, seq, rn, fx, fy, fz): lines of four tokens and more from the sixth; unreadable lines are left out."""
    rows = lines.where("line_no >= 5").withColumn("t", tokens(F.col("line"))).where(F.size("t") >= 4)
    at = lambda i: F.get("t", F.lit(i))
    rows = rows.select("path", F.col("line_no").cast("long").alias("seq"), to_int(at(0)).alias("rn"), *[to_double(at(1 + i)).alias(c) for i, c in enumerate(("fx", "fy", "fz"))])
    return rows.dropna()


def stog_inputs(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(run_id, path): the file that line 1 of a run's stog_input.dat names. lines: (run_id, name, line_no, line)."""
    named = lines.where("name = 'stog_input.dat' and line_no = 1").select("run_id", F.get(tokens(F.col("line")), F.lit(0)).alias("name"))
    return named.join(files.select("run_id", "name", "path"), ["run_id", "name"])


#: First data line of a kind of file.
FIRST_LINE = {"csv": 1, "chi": 2, "stog": 2, "atoms": 0, "cell": 0, "frac": 5}


def ingest_errors(lines: DataFrame, kinds: DataFrame) -> DataFrame:
    """(path, reason) of files that break the format of their kind. kinds: (path, kind).

    All lines are read once, and every fault is counted in one aggregate over the files; the numbers of a cell come from
    its own reader.  Logs and tables that merely hold no rows are no errors, except for curves and plain tables, which need one.
    """
    kind = F.col("kind")
    first = F.coalesce(*[F.when(kind == k, n) for k, n in FIRST_LINE.items()])
    own = lines.join(kinds, "path").withColumn("t", F.when(kind == "csv", cells(F.col("line"))).otherwise(tokens(F.col("line"))))
    data = (F.col("line_no") >= first) & (F.size("t") > F.when(kind == "chi", 1).otherwise(0))
    # of a log only the last two tokens are numbers
    numbers = F.when(kind == "chi", F.slice("t", -2, 2)).otherwise(F.col("t"))
    odd = kind.isin("csv", "chi", "stog") & data & F.exists(numbers, lambda x: to_double(x).isNull())
    head, width = F.get("t", F.lit(0)), F.when(data & kind.isin("csv", "stog"), F.size("t"))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    got = own.groupBy("path", "kind").agg(
        any_(data).alias("rows"), any_(odd).alias("odd"), F.min(width).alias("lo"), F.max(width).alias("hi"), any_(F.trim("line") != "").alias("text"),
        any_(head == "Atoms:").alias("atoms"), any_(head == "Supercell").alias("supercell"), any_(head == "Lattice").alias("lattice"),
    )
    read = cell_metadata(lines.join(kinds.where("kind = 'cell'"), "path", "left_semi")).select("path", F.lit(True).alias("read"))
    got = got.join(read, "path", "left")
    table = kind.isin("csv", "stog")
    reason = (
        F.when(table & ~F.col("text"), "empty file").when(table & ~F.col("rows"), "no numeric rows").when(F.col("odd"), "not a number")
        .when(F.col("lo") < F.col("hi"), "rows of different length").when(F.col("hi") < 2, "fewer than two numeric columns").when((kind == "atoms") & ~F.col("atoms"), "no Atoms section")
        .when((kind == "cell") & ~(F.col("supercell") & F.col("lattice")), "no lattice or supercell").when((kind == "cell") & F.col("read").isNull(), "lattice or supercell is not numeric")
    )
    missing = kinds.join(lines.select("path").distinct(), "path", "left_anti").select("path", F.lit("empty file").alias("reason"))
    return got.select("path", reason.alias("reason")).where("reason is not null").unionAll(missing)
