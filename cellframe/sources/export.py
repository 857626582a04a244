"""Texts written by many tasks: ordered lines of any number of texts, each a folder of parts that read as one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.structure import frac_lines

#: The lines above a fractional table.
FRAC_HEADER = (
    " RN - reference number (a column in rmc6f file indicating an atom type",
    " in the unit cell)",
    " XYZ - fractional coordinates of the atom reduced to unit cell",
    " Nx,Ny,Nz - unit cell indices in the box",
    " RN    X    Y     Z    Nx    Ny    Nz",
)


def write_texts(lines: DataFrame, root: str, mode: str = "errorifexists") -> None:
    """Write lines (name, place, line) as one text per name, in the order of place; by default this fails if root exists.

    Lines are dealt by ranges of (name, place): a large text lies in many parts, whose names follow their order, and
    small ones share a task.  `ingest.raw_lines(root, folders=True)` reads a text's parts as one file.  Spark commits
    all texts of a call together: readers see none of them before _SUCCESS.  Each text costs a file at least; where their
    number grows with the input, write_packs is the way.
    """
    dealt = lines.select("name", "place", "line").repartitionByRange("name", "place").sortWithinPartitions("name", "place")
    dealt.select("name", "line").write.mode(mode).partitionBy("name").text(root)


def write_packs(lines: DataFrame, root: str) -> None:
    """Write lines (name, place, line) as packs, files that hold many texts one after another; fails if root exists.

    There are as many files as tasks, however many texts.  Each line stands behind the encoded name of its text and a tab.
    Texts lie in the order of name, their lines in the order of place, and a large text may go on in the next packs.  A line
    break inside a line starts a line, as it does in a file of its own.  `ingest.packed_lines` reads them.
    """
    dealt = lines.select("name", "place", "line").repartitionByRange("name", "place").sortWithinPartitions("name", "place")
    own = F.explode(F.split(F.regexp_replace(F.coalesce("line", F.lit("")), r"\r\z", ""), r"\r\n|\r|\n"))
    own = dealt.select(F.url_encode(F.coalesce("name", F.lit(""))).alias("name"), own.alias("line"))
    own.select(F.concat("name", F.lit("\t"), "line")).write.text(root)


def text_name(path: Column) -> Column:
    """The name under which write_texts wrote the text that lies in this folder."""
    return F.regexp_extract(path, r"name=([^/]*)$", 1)


def frac_texts(table: DataFrame, stem: Column | None = None) -> DataFrame:
    """(name, place, line) of the fractional table of each structure: Frac_coord_<stem>.txt, its header once, atoms in order of seq."""
    named = lambda df: df.withColumn("name", F.concat(F.lit("Frac_coord_"), F.col("structure_id").cast("string") if stem is None else stem, F.lit(".txt")))
    rows = named(frac_lines(table)).select("name", F.struct(F.lit(len(FRAC_HEADER)).alias("part"), "seq").alias("place"), "line")
    heads = named(table.select("structure_id").distinct()).select("name", F.posexplode(F.array(*[F.lit(x) for x in FRAC_HEADER])).alias("part", "line"))
    none = F.lit(None).cast(table.schema["seq"].dataType)
    return rows.unionAll(heads.select("name", F.struct("part", none.alias("seq")).alias("place"), "line"))


def write_frac(table: DataFrame, root: str, overwrite: bool = False, stem: Column | None = None) -> None:
    """Write the fractional tables of all structures below root; fails if root exists, unless overwrite."""
    write_texts(frac_texts(table, stem), root, "overwrite" if overwrite else "errorifexists")
