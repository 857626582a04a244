"""Prefix trie of conversations: every distinct sequence of first turns is a node with its counts.

1. Turns are numbered in their conversation by ranges of (conv_id, turn), so that a conversation of any length lies
   in many tasks (`functions.storage.ranked`); a turn's id is a 128-bit digest of role and text.
2. Conversations become rows of WIDTH positional turn-id columns, a row per block of turns.  A row is keyed by the node
   in which its prior block ends: an exclusive-or of hashes of (position, turn id), which running windows carry along.
3. One ROLLUP over the columns aggregates all prefixes of all blocks together; grouping_id tells a prefix's length.
   Grouping sets that reach beyond a conversation's end are dropped: they have a null column within their length.
4. Subtree sums without a walk through the tree: a conversation is the first member of the nodes from some depth on
   only.  So the leaves below a node are its members that are first in a leaf, and (members - 1) * words summed over
   a subtree is, over the node's members, the words of the turns in whose nodes a member is not the first.  The first
   ROLLUP finds first members; the second sums both, a column for each length, picked by grouping_id.

Defined cases: rows without conv_id belong to no conversation; null turns come first, turns of equal number are ordered by role,
then text (code points), and repeated rows are turns of their own; null roles and texts are empty.  An empty table has no nodes.  A conversation of
any length and a text of any length count whole.  Other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import ranked
from .common import n_words_of, staged, table, text_of

#: Turn-id columns of a block; blocks of a conversation that one window sums; ids that are hashed together at most.
WIDTH, CHAIN, PIECE = 8, 4096, 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, tid, words) of every turn: its number in the conversation from 0, the id of role and text."""
    plain = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text")).where("conv_id is not null")
    plain = plain.withColumn("tid", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))
    turns = staged(plain.select("conv_id", "turn", "tid", n_words_of(F.col("text")).alias("words"), F.lit(0).alias("tie")), "turns")
    ties = staged(turns.groupBy("conv_id", "turn").agg((F.min("tid") != F.max("tid")).alias("tied")).where("tied").select(F.col("conv_id").alias("c"), F.col("turn").alias("t")), "ties")
    if ties.head(1):
        same = (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
        tied = plain.join(ties, same, "left_semi").select("conv_id", "turn", "role", "text", "tid").distinct()
        tied = tied.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("tid").alias("d"), F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")).alias("place"))
        turns = turns.join(tied, same & (F.col("tid") == F.col("d")), "left").select("conv_id", "turn", "tid", "words", F.coalesce("place", F.lit(0)).alias("tie"))
    return staged(ranked(turns, ["conv_id"], ["turn", "tie"], rank=["conv_id"]).select("conv_id", "rank", "tid", "words"), "ranked")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings: (conv_id, length) and (conv_id, length, pos, tid, words).

    Conversation c takes the first h turns of conversation c - c % every, then its own turns after its first h; h is
    the crc32 of its decimal id, modulo `most`.
    """
    counts = turns.groupBy("conv_id").agg((F.max("rank") + 1).alias("n"))
    counts = staged(counts.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most, "base": F.col("conv_id") - F.col("conv_id") % every}), "counts")
    bases = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    frame = counts.join(bases, "base", "left").withColumn("take", F.least("h", F.coalesce("n_base", F.lit(0))))
    frame = staged(frame.select("conv_id", "base", "h", "take", (F.col("take") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "frame")
    heads = turns.where((F.col("rank") < most - 1) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    shared = frame.where("take > 0").join(heads, "base").where("rank < take").select("conv_id", "length", F.col("rank").alias("pos"), "tid", "words")
    own = turns.join(frame.select("conv_id", "h", "take", "length"), "conv_id").where("rank >= h")
    own = own.select("conv_id", "length", (F.col("rank") - F.col("h") + F.col("take")).alias("pos"), "tid", "words")
    return frame.select("conv_id", "length"), shared.unionAll(own)


def earlier(blocks: DataFrame, values: dict, total, longest: int, reverse: bool = False) -> DataFrame:
    """blocks with running totals (name -> column) over the earlier blocks of the conversation, later ones if reverse.

    The window of one task holds CHAIN blocks; where conversations are longer, totals of such stretches are added.
    """
    stretch, order = F.expr(f"blk div {CHAIN}"), (lambda c: F.col(c).desc() if reverse else F.col(c))
    rows = blocks.withColumn("_stretch", stretch)
    near = Window.partitionBy("conv_id", "_stretch").orderBy(order("blk")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({n: F.coalesce(total(c).over(near), F.lit(0)) for n, c in values.items()})
    if longest > WIDTH * CHAIN:
        sums = rows.groupBy("conv_id", "_stretch").agg(*[total(c).alias(f"_{n}") for n, c in values.items()])
        far = Window.partitionBy("conv_id").orderBy(order("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("conv_id", "_stretch", *[F.coalesce(total(F.col(f"_{n}")).over(far), F.lit(0)).alias(f"_{n}") for n in values])
        both = lambda n: F.col(n).bitwiseXOR(F.col(f"_{n}")) if total is F.bit_xor else F.col(n) + F.col(f"_{n}")
        out = out.join(sums, ["conv_id", "_stretch"]).withColumns({n: both(n) for n in values}).drop(*[f"_{n}" for n in values])
    return out.drop("_stretch")


def hashed(seed: int, upto: int | None = None):
    """Exclusive-or of the hashes of (position, turn id) of a block's first turns, all by default."""
    upto = WIDTH if upto is None else upto
    one = [F.when(F.col(f"t{i}").isNotNull(), F.xxhash64(F.lit(seed), F.col("blk") * WIDTH + i, F.col(f"t{i}"))).otherwise(F.lit(0)) for i in range(upto)]
    return reduce(lambda a, b: a.bitwiseXOR(b), one, F.lit(0).cast("long"))


def blocks_of(lengths: DataFrame, turns: DataFrame, longest: int) -> DataFrame:
    """(conv_id, length, blk, t0.., w0.., p1, p2): WIDTH turns a row; p1, p2: the node in which the prior block ends."""
    at = F.col("pos") % WIDTH
    cells = [c for i in range(WIDTH) for c in (F.max(F.when(at == i, F.col("tid"))).alias(f"t{i}"), F.max(F.when(at == i, F.col("words"))).alias(f"w{i}"))]
    rows = turns.groupBy("conv_id", F.expr(f"pos div {WIDTH}").alias("blk")).agg(F.max("length").alias("length"), *cells)
    none = [c for i in range(WIDTH) for c in (F.lit(None).cast("binary").alias(f"t{i}"), F.lit(None).cast("long").alias(f"w{i}"))]
    rows = rows.unionAll(lengths.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("blk"), "length", *none))
    return staged(earlier(rows, {"p1": hashed(1), "p2": hashed(2)}, F.bit_xor, longest), "blocks")


def rolled(blocks: DataFrame, *sums: str) -> DataFrame:
    """(depth, k1, k2, u1, u2, conv_id, n_convs, ...) of every node: its key, its parent's, and the sums asked for."""
    columns = [f"t{i}" for i in range(WIDTH)]
    text = f"select blk, p1, p2, {', '.join(columns)}, {WIDTH} - bit_count(grouping_id()) as level, min(conv_id) as conv_id, count(*) as n_convs, max(length) as longest{''.join(', ' + s for s in sums)} from {{blocks}} group by blk, p1, p2, rollup({', '.join(columns)})"
    groups = blocks.sparkSession.sql(text, blocks=blocks)
    full = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    groups = groups.where((full == F.col("level")) & ((F.col("level") > 0) | (F.col("blk") == 0)))
    parent = lambda seed: F.coalesce(*[F.when(F.col("level") == i + 1, hashed(seed, i)) for i in range(WIDTH)])
    keys = {"depth": F.col("blk") * WIDTH + F.col("level")} | {f"k{s}": F.col(f"p{s}").bitwiseXOR(hashed(s)) for s in (1, 2)} | {f"u{s}": F.col(f"p{s}").bitwiseXOR(parent(s)) for s in (1, 2)}
    return groups.withColumns(keys).drop("blk", "p1", "p2", *columns)


def ends_of(blocks: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes in which conversations end; ids are hashed in order, a piece at a time."""
    last = blocks.where(F.col("blk") == F.greatest(F.expr(f"(length - 1) div {WIDTH}"), F.lit(0)))
    ends = last.select("length", F.col("p1").bitwiseXOR(hashed(1)).alias("k1"), F.col("p2").bitwiseXOR(hashed(2)).alias("k2"), "conv_id")

    def pieces(batches):
        import pyarrow as pa

        node, ids = None, []

        def piece():
            return pa.RecordBatch.from_pylist([{"length": node[0], "k1": node[1], "k2": node[2], "first": ids[0], "ids": ",".join(map(str, ids))}])

        for batch in batches:
            for *own, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (own != node or len(ids) == PIECE):
                    yield piece()
                    ids = []
                node = own
                ids.append(conv)
        if ids:
            yield piece()

    def digests(batches):
        import pyarrow as pa

        node, sha = None, None

        def row():
            return pa.RecordBatch.from_pylist([{"length": node[0], "k1": node[1], "k2": node[2], "ends_sha256": sha.hexdigest()}])

        for batch in batches:
            for *own, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if own != node:
                    if node:
                        yield row()
                    node, sha = own, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if node:
            yield row()

    key = ["length", "k1", "k2"]
    cut = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(pieces, "length long, k1 long, k2 long, first long, ids string")
    return cut.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digests, "length long, k1 long, k2 long, ends_sha256 string").withColumnRenamed("length", "depth")


def trie(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, length) with turns (conv_id, length, pos, tid, words)."""
    longest = lengths.agg(F.max("length")).first()[0] or 0
    blocks = blocks_of(lengths, turns, longest)
    first = rolled(blocks).groupBy("conv_id").agg(F.min("depth").alias("since"), F.max((F.col("longest") == F.col("depth")).cast("int")).alias("leaf"))
    # words of the turns in whose nodes the conversation is not the first member
    saved = [F.when(F.col("blk") * WIDTH + i + 1 < F.coalesce("since", F.lit(1 << 62)), F.coalesce(f"w{i}", F.lit(0))).otherwise(F.lit(0)) for i in range(WIDTH)]
    marked = blocks.join(first, "conv_id", "left").withColumns({f"v{i}": c for i, c in enumerate(saved)})
    marked = earlier(marked, {"later": sum((F.col(f"v{i}") for i in range(1, WIDTH)), F.col("v0"))}, F.sum, longest, reverse=True)
    tail = lambda i: sum((F.col(f"v{k}") for k in range(i, WIDTH)), F.col("later")).alias(f"s{i}")
    marked = marked.select("conv_id", "length", "blk", "p1", "p2", *[f"t{i}" for i in range(WIDTH)], F.coalesce("leaf", F.lit(0)).alias("leaf"), *[tail(i) for i in range(WIDTH)])
    nodes = rolled(marked, "sum(leaf) as n_leaves", *[f"sum(s{i}) as s{i}" for i in range(WIDTH)])
    saved_tokens = F.coalesce(*[F.when(F.greatest(F.col("level"), F.lit(1)) == i + 1, F.col(f"s{i}")) for i in range(WIDTH)])
    nodes = staged(nodes.select("depth", "k1", "k2", "u1", "u2", "conv_id", "n_convs", "n_leaves", saved_tokens.alias("saved_tokens")), "nodes")
    below = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2"))
    children = below.groupBy("depth", "k1", "k2").agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id"))
    key = ["depth", "k1", "k2"]
    out = nodes.join(children, key, "left").join(ends_of(blocks), key, "left").join(above, ["depth", "u1", "u2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def query(spark, sf_dir):
    return trie(*rebuilt(turns_of(table(spark, sf_dir, "conversations"))))


SQL = r"""
with crc as (
  select list_transform(range(256), lambda i: list_reduce(list_concat([i::bigint], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end)) as t
), original as (
  select conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as own
  from conversations where conv_id is not null group by conv_id
), cut as (
  select conv_id, own, xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]))) % 4 as h from original, crc
), rebuilt as (
  select c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) as turns from cut c left join original b on b.conv_id = c.conv_id - c.conv_id % 20
), prefixes as (
  select conv_id, len(turns) as length, unnest(range(0, len(turns) + 1)) as depth, turns from rebuilt
), nodes as (
  select depth, turns[1:depth] as node, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(case when length = depth then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256
  from prefixes group by 1, 2
), counted as (
  select *, case when depth = 0 then 0 else (n_convs - 1) * len(regexp_extract_all(node[depth].t, '[^\x20\x09-\x0D]+')) end as saved,
    (select count(*) from nodes k where k.depth = n.depth + 1 and k.node[1:n.depth] = n.node) as n_children from nodes n
), sums as (
  select v.depth, v.node, sum(u.saved) as saved_tokens, sum((u.n_children = 0)::bigint) as n_leaves from counted v join counted u on u.depth >= v.depth and u.node[1:v.depth] = v.node group by 1, 2
)
select c.conv_id, c.depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, c.ends_sha256
from counted c join sums s on s.depth = c.depth and s.node = c.node left join nodes p on p.depth = c.depth - 1 and p.node = c.node[1:c.depth - 1]
"""
