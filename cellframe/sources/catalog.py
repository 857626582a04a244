"""Catalogue of run files: what lies where, and what each file plots."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import axis_label

#: Names of run files, order of kinds on a dashboard, kinds whose curves are compared by Rwp.
PATTERNS = ("*.csv", "*.log", "*.rmc6f", "Frac*.txt", "scale_ft.*", "stog_input.dat")
KIND_ORDER = ("r_value", "bragg", "xray_sq", "neutron_sq", "xpdf", "npdf", "pdf_partials", "stog")
COMPARED = ("xpdf", "npdf", "xray_sq", "neutron_sq", "bragg")


def _matches(name: Column, patterns) -> Column:
    return name.rlike("^(" + "|".join(re.escape(p).replace(r"\*", ".*") for p in patterns) + ")$")


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark names it, with its store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def scan_files(spark: SparkSession, root: str, patterns=PATTERNS, folders: bool = False) -> DataFrame:
    """(run_id, path, name, ext, size, mtime, plot_kind) of all matching files below root; contents are not read.

    folders: a text is a folder of parts, as `export.write_texts` leaves it: sizes add up, the newest part dates it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    if folders:
        files = files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("path")).agg(F.sum("length").alias("length"), F.max("modificationTime").alias("modificationTime"))
    parts = F.split("path", "/")
    name = F.regexp_replace(F.element_at(parts, -1), "^name=", "") if folders else F.element_at(parts, -1)
    files = files.select(F.element_at(parts, -2).alias("run_id"), "path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return with_kind(files.where(_matches(F.col("name"), patterns))).dropDuplicates(["path"])


def scan_folders(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, path, name) of the folders below root that hold a file at some depth; run_id is the folder around."""
    base = qualified(spark, root).rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    steps = F.slice(F.split(F.expr(f"substring(path, {len(base) + 2})"), "/"), 1, F.size(F.split(F.expr(f"substring(path, {len(base) + 2})"), "/")) - 1)
    above = F.explode(F.transform(steps, lambda _, i: F.concat_ws("/", F.lit(base), F.slice(steps, F.lit(1), i + 1))))
    found = files.select(above.alias("path")).distinct()
    parts = F.split("path", "/")
    return found.select(F.element_at(parts, -2).alias("run_id"), "path", F.element_at(parts, -1).alias("name"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status) of two snapshots (path, size, mtime): new, gone, changed or same."""
    old = before.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.lit(1).alias("_was"))
    both = after.select("path", "size", "mtime", F.lit(1).alias("_is")).join(old, "path", "full")
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime"))
    return both.select("path", F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "gone").when(same, "same").otherwise("changed").alias("status"))


def to_read(changed: DataFrame) -> list[str]:
    """Paths of the new and changed files, for a reader.  Spark's own listing of a scan holds as many on the driver."""
    return [r.path for r in changed.where(F.col("status").isin("new", "changed")).select("path").collect()]


def plot_kind(name: Column) -> Column:
    """Kind of plot by file name; the first rule that fits decides, and case matters."""
    pdf = name.contains("PDF") & name.endswith(".csv")
    # fixed values, in order
    return (
        F.when(name.endswith("_FT_XFQ1.csv"), "xpdf")
        .when(pdf & name.contains("PDFpartials"), "pdf_partials")
        .when(pdf, "npdf")
        .when(name.endswith("_FQ1.csv"), "xray_sq")
        .when(name.endswith("_SQ1.csv"), "neutron_sq")
        .when(name.endswith("_bragg.csv"), "bragg")
        .when(name.endswith(".log"), "r_value")
        .when(name.isin("scale_ft.gr", "scale_ft.sq", "scale_ft_rmc.fq"), "stog")
    )


def pdf_index(name: Column) -> Column:
    """The number before the ending of a pair-distribution file, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"PDF(\d+)\.csv$", 1), F.lit("")).try_cast("int"), F.lit(0))


def neutron_tag(index: Column) -> Column:
    """What tells several neutron data sets apart in a title: nothing for numbers 0 and 1, else ` #` and the number."""
    return F.when(index.isin(0, 1), "").otherwise(F.concat(F.lit(" #"), index.cast("string")))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def with_kind(files: DataFrame) -> DataFrame:
    """Adds ext and plot_kind."""
    return files.withColumns({"ext": F.regexp_extract("name", r"(\.[^.]*)$", 1), "plot_kind": plot_kind(F.col("name"))})


def plottable(files: DataFrame) -> DataFrame:
    return files.where(F.col("plot_kind").isNotNull())


def labelled(files: DataFrame) -> DataFrame:
    """Adds title, x_label and y_label of each plottable file; first_label, if there is such a column, is the first label of its curve table."""
    kind, name = F.col("plot_kind"), F.col("name")
    last, gr = F.element_at(F.split(stem(name), "_"), -1), name.endswith(".gr")
    first = F.col("first_label") if "first_label" in files.columns else F.lit(None).cast("string")
    # fixed values
    title = (
        F.when(kind == "xpdf", "xPDF").when(kind.isin("npdf", "pdf_partials"), last).when(kind == "xray_sq", "S(Q) (x-ray)")
        .when(kind == "neutron_sq", "S(Q) (neutron)").when(kind == "bragg", "BRAGG").when(kind == "r_value", "R-value").otherwise(name)
    )
    x = (
        F.when(kind == "r_value", "Time steps").when(kind.isin("xpdf", "npdf", "pdf_partials") | ((kind == "stog") & gr), "r (Å)")
        .when(kind.isin("bragg", "stog"), "Q (Å^{-1})").otherwise(F.coalesce(axis_label(first), F.lit("x")))
    )
    y = F.when(kind == "r_value", "log(χ)").when((kind == "stog") & gr, "G(r)").when(kind == "stog", "S(Q)").otherwise("data")
    return files.where(kind.isNotNull()).withColumns({"title": title, "x_label": x, "y_label": y})


def union_distinct(*matches: DataFrame) -> DataFrame:
    """The files that any of the pattern matches found, each path once."""
    return reduce(DataFrame.unionByName, matches).dropDuplicates(["path"])


def first_fraction_file(files: DataFrame) -> DataFrame:
    """The first fractional table of each run, by name."""
    return files.where(F.col("name").startswith("Frac") & F.col("name").endswith(".txt")).groupBy("run_id").agg(F.min("name").alias("name"))


def first_structure_file(files: DataFrame) -> DataFrame:
    """The first configuration file of each run, by name."""
    return files.where(F.col("name").endswith(".rmc6f")).groupBy("run_id").agg(F.min("name").alias("name"))


def listing(files: DataFrame) -> DataFrame:
    """Adds position: directories first, then names without regard to case."""
    order = Window.partitionBy("run_id").orderBy(F.col("is_directory").desc(), F.lower("name"), "name", "path")
    return files.withColumn("position", F.row_number().over(order))
