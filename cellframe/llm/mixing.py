"""Mixing sources to target weights.

Each source's size is aggregated, a target is derived from its weight, and a document of a source with
repetition rate r = target / size is emitted floor(r) times plus once more with probability r - floor(r).
That coin is an MD5 hash of seed and doc_id, so reruns and retried tasks toss it alike.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a source of size 0
has target 0 and rate 1 (its documents have no words); an empty table gives an empty mix; rows that repeat a
doc_id share its coin, whatever their texts; columns of the input are kept whatever their names; texts of any length
count whole.  Over D documents of mean size m a source's taken words deviate from its target by about
m * sqrt(D * p * (1 - p)), p the fraction of its rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, n_words_of, small_side, staged, text_of, unboxed

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size); the targets add up to all sizes.

    A target stops at cap times its source's size.  With the sources ordered by cap * size / weight, those
    stopped are a prefix: one is stopped if the level that the sources before it leave still exceeds its own
    ratio.  The windows run over one row per source, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    ranked = sizes.select(
        "source",
        F.col("source_size").cast("decimal(20,0)").alias("size_"),
        F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int")).cast("decimal(8,0)").alias("w_"),
    )
    by_ratio = Window.orderBy((F.col("size_").cast("double") * cap / F.col("w_").cast("double")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("decimal(30,0)")
    filled = ranked.select(
        "*",
        (F.sum("size_").over(every) - F.coalesce(F.sum(F.col("size_") * cap).over(by_ratio), zero)).cast("double").alias("left_"),
        (F.sum("w_").over(every) - F.coalesce(F.sum("w_").over(by_ratio), zero)).cast("double").alias("weight_left_"),
    ).withColumn("stopped_", F.col("left_") * F.col("w_").cast("double") > F.col("size_").cast("double") * cap * F.col("weight_left_"))
    level = filled.select(
        "*",
        (F.sum("size_").over(every) - F.coalesce(F.sum(F.when(F.col("stopped_"), F.col("size_") * cap)).over(every), zero)).cast("double").alias("rest_"),
        F.sum(F.when(~F.col("stopped_"), F.col("w_"))).over(every).cast("double").alias("rest_weight_"),
    )
    target = F.when(F.col("stopped_"), F.col("size_").cast("double") * cap).otherwise(F.col("w_").cast("double") * F.col("rest_") / F.col("rest_weight_"))
    return level.select("source", F.col("size_").cast("long").alias("source_size"), target.alias("target"))


def _mixed(docs: DataFrame, weights: tuple[int, ...], cap: int, seed: str) -> DataFrame:
    """_row (all columns of docs) and _mix (size, source_size, target, copies) of every row."""
    sized = docs.select(boxed(docs), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), n_words_of(text_of()).alias("_size"))
    per_source = docs.select("source", n_words_of(text_of()).alias("_size")).groupBy("source").agg(F.sum("_size").alias("source_size"))
    targets = small_side(staged(source_targets(per_source, weights, cap), "targets")).withColumnRenamed("source", "_of")
    rate = F.when(F.col("source_size") == 0, F.lit(1.0)).otherwise(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)).cast("double"))
    coin = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") / float(2**48)
    joined = sized.join(targets, F.col("_source").eqNullSafe(F.col("_of")))
    copies = (F.floor(rate) + F.when(coin < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    return joined.select("_row", F.struct(F.col("_size").alias("size"), "source_size", "target", copies.alias("copies")).alias("_mix"))


def mix_to_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """All columns of docs (but for a `_mix` of its own) and struct `_mix` (size, source_size, target, copies)."""
    return _mixed(docs, weights, cap, seed).select(*unboxed(docs, ["_mix"]), "_mix")


def emit_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of docs, with its own columns only, as many times as the mix takes it."""
    copies = F.explode(F.array_repeat(F.lit(1), F.col("_mix.copies").cast("int"))).alias("_copy")
    return _mixed(docs, weights, cap, seed).where("_mix.copies > 0").select("_row", copies).select(*unboxed(docs))


def query(spark, sf_dir):
    from .common import table

    mixed = mix_to_targets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", (F.col("_mix.size") * F.col("_mix.copies")).alias("taken"))


SQL = f"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents
), s as (
  select source, sum(size)::hugeint as ssize from d group by source
), r as (
  select *, ([5, 2, 1])[((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int]::hugeint as w from s
), f as (
  select *, sum(ssize) over () - coalesce(sum({CAP} * ssize) over o, 0) as lefts, sum(w) over () - coalesce(sum(w) over o, 0) as wleft
  from r window o as (order by ssize::double * {CAP} / w::double, source asc nulls last rows between unbounded preceding and 1 preceding)
), g as (
  select *, lefts::double * w::double > ssize::double * {CAP} * wleft::double as stopped from f
), l as (
  select *, (sum(ssize) over () - coalesce(sum(case when stopped then {CAP} * ssize end) over (), 0))::double as rest,
    (sum(case when not stopped then w end) over ())::double as rest_w from g
), t as (
  select source, ssize::bigint as source_size, case when stopped then ssize::double * {CAP} else w::double * rest / rest_w end as target from l
), c as (
  select d.doc_id, d.size, t.source_size, t.target,
    case when t.source_size = 0 then 1.0::double else t.target / t.source_size::double end as rate,
    ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::varchar, 'null')), 1, 12))::bigint::double / 281474976710656.0::double as coin
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target, (size * (floor(rate) + case when coin < rate - floor(rate) then 1 else 0 end))::bigint as taken from c
"""
