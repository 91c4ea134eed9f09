"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations.

1. Each document gets a pseudo-random key (MD5 of seed and doc_id). The key's first bits name its block, so
   the blocks of a source, in order of their number, are a random permutation cut into pieces.
2. Targets: sources share ``share`` times all words by weight; none exceeds ``most`` times its own size
   and the excess goes to the others by weight (water filling, in one window over the sources).
3. A source's blocks are drawn in whole passes and then in order until the target would be passed; the
   block at the edge gives its documents in key order, the last one if that comes nearer to the target.
4. The draws of all sources are dealt to output shards by a binary tree: each node holds a number of draws
   of each source, rows of a table, and splits them exactly in halves by a multivariate-hypergeometric
   draw. The draws of a source go to the shards as disjoint runs of its permuted blocks.
5. A shard's order is a hash of document, copy and shard.

Documents are read once for their sizes; after that only (source, block) rows matter, of which there
are at most ``2**block_bits`` for each source, and the block at each source's edge. Sources may be many: they are rows
everywhere.

Defined results: a null or empty text has size 0 (it is drawn with its block, but never decides where a source
stops); a very long text is counted by one expression, whole; null is a source of its own and comes last;
repeated rows share a key and so are drawn together; an empty table gives no rows; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import packed, saved, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_BITS = 10
#: Bits of the key that cut a source's edge block into pieces, and bits of a draw's hash that name its range.
_PIECE_BITS = 10
_RANGE_BITS = 14
#: Levels of the splitting tree: 2**levels output shards.
LEVELS = 6
#: Rows of (source, block) up to which the draws are broadcast; with more, documents are joined by a shuffle.
BROADCAST_ROWS = 200_000

_BLANK = r"\x20\x09-\x0D"


def word_count(text) -> F.Column:
    """Number of runs of other than ASCII white space; null: 0. Needs no array of the words."""
    inner = F.expr(f"trim(BOTH ' \\t\\n\\u000B\\f\\r' FROM {text})")
    return F.when(F.coalesce(F.length(inner), F.lit(0)) == 0, F.lit(0)).otherwise(F.length(F.regexp_replace(inner, f"[^{_BLANK}]+[{_BLANK}]*", "x"))).cast("long")


def _keyed(docs: DataFrame, bits: int, seed: int = 1) -> DataFrame:
    hexes = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    key = F.conv(F.substring(hexes, 1, 13), 16, 10).cast("long")  # 52 bits
    return docs.withColumn("__size", word_count("text")).withColumn("__key", key).withColumn("__block", F.expr(f"shiftright(__key, {52 - bits})").cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, rank, target) from (source, words) rows; one row a source."""
    sources = sizes.groupBy("source").agg(F.sum("words").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("source_size") / F.col("_weight"), "_rank")
    done, rest = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    ranked = sources.withColumn("_rank", F.row_number().over(by_name))
    ranked = ranked.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_spent", F.coalesce(F.sum("source_size").over(done), F.lit(0)) * most).withColumn("_open", F.sum("_weight").over(rest))
    ranked = ranked.withColumn("_level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.col("_spent")) / F.col("_open"))
    # The first source, by room, that its share doesn't fill sets the level for all from it on.
    ranked = ranked.withColumn("_level", F.max(F.when(F.col("_level") * F.col("_weight") <= F.col("source_size") * F.lit(float(most)), F.col("_level"))).over(every))
    target = F.when(F.col("_level").isNull(), F.col("source_size") * F.lit(float(most))).otherwise(F.least(F.col("source_size") * F.lit(float(most)), F.col("_level") * F.col("_weight")))
    return ranked.select("source", "source_size", F.col("_rank").alias("rank"), target.cast("double").alias("target"))


def _split(seed: int, levels: int, quotas: DataFrame) -> DataFrame:
    """(shard, rank, n): the leaves of the splitting tree over (rank, n) rows, the draws of each source.

    All draws stand in one random order (by a hash). The root holds them all; a node's first half goes to its left child, the
    rest to its right one, ``levels`` times. So each node holds an exact number of draws, and how many of these are of
    each source is a multivariate-hypergeometric draw from its parent. A draw's place in the order is the draws in
    the hash ranges before its own and its rank within that; then the way down is arithmetic on its row."""
    draws = quotas.where("n > 0").select("rank", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("d"))
    draws = draws.withColumn("u", F.xxhash64(F.lit(seed), "rank", "d")).withColumn("range", F.shiftrightunsigned("u", 64 - _RANGE_BITS))
    # A row for each range of hashes: at most 2**_RANGE_BITS.
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = draws.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("size"))
    nth = F.row_number().over(Window.partitionBy("range").orderBy("u", "rank", "d"))
    at = draws.withColumn("nth", nth).join(F.broadcast(ranges), "range").select("rank", "size", (F.col("before") + F.col("nth") - 1).alias("place"), F.lit(1).cast("long").alias("node"))
    for _ in range(levels):
        left = F.expr("size div 2")
        right = F.col("place") >= left
        at = at.select("rank", F.when(right, F.col("size") - left).otherwise(left).alias("size"), F.when(right, F.col("place") - left).otherwise(F.col("place")).alias("place"), (2 * F.col("node") + right.cast("int")).alias("node"))
    return at.groupBy((F.col("node") - 2**levels).cast("int").alias("shard"), "rank").agg(F.count("*").alias("n"))


def _stops(keyed: DataFrame, laid: DataFrame, block_bits: int) -> DataFrame:
    """(source, edge_key): the key of the last document that each source's edge block gives. The block is cut again by the next
    bits of the key, so that only documents of one such part are put in order."""
    edges = laid.where("_edge").select(F.col("source").alias("_s"), F.col("__block").alias("_b"), (F.col("_rest") - (F.col("_upto") - F.col("words"))).alias("_room"))
    # A row for each source; the size of the sources' table is Spark's to weigh.
    inside = keyed.where("__size > 0").join(edges, keyed["source"].eqNullSafe(F.col("_s")) & (keyed["__block"] == F.col("_b")))
    keys = inside.groupBy("source", "__key").agg(F.sum("__size").alias("__size"), F.first("_room").alias("_room"))
    # The next bits of a hash of 52: pieces within a block, in the order of keys.
    keys = saved(keys.withColumn("_piece", F.expr(f"shiftright(__key, {52 - block_bits - _PIECE_BITS}) % {1 << _PIECE_BITS}")), "edge-keys")
    run = lambda by: Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = keys.groupBy("source", "_piece").agg(F.sum("__size").alias("n"), F.max("__key").alias("_last"), F.first("_room").alias("_room")).withColumn("_sum", F.sum("n").over(run("_piece")))
    # Pieces that fit as a whole, up to their last key; then the piece that passes the room.
    whole = pieces.where("_sum <= _room").groupBy("source").agg(F.max("_last").alias("edge_key"))
    passing = pieces.where("_sum > _room and _sum - n < _room").select(F.col("source").alias("_s"), F.col("_piece").alias("_p"), (F.col("_sum") - F.col("n")).alias("_before"))
    last = keys.join(passing, keys["source"].eqNullSafe(F.col("_s")) & (keys["_piece"] == F.col("_p"))).withColumn("_sum", F.col("_before") + F.sum("__size").over(run("__key")))
    nearer = F.abs(F.col("_sum") - F.col("_room")) <= F.abs(F.col("_sum") - F.col("__size") - F.col("_room"))
    last = last.where(nearer).groupBy("source").agg(F.max("__key").alias("edge_key"))
    return whole.unionByName(last).groupBy("source").agg(F.max("edge_key").alias("edge_key"))


def draw_blocks(keyed: DataFrame, seed: int = 1, weights=WEIGHTS, share: float = SHARE, most: int = MOST, levels: int = LEVELS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(source, block) rows with ``shards`` (the shard of each pass over the whole block), ``edge_shard`` and ``edge_key``
    (documents up to this key are drawn once more), source_size and target. ``keyed``: doc_id, source, __size, __key, __block
    (the key's first ``block_bits``), stored."""
    blocks = saved(keyed.groupBy("source", "__block").agg(F.sum("__size").alias("words")), "blocks")
    targets = source_targets(blocks, weights, share, most)
    run = Window.partitionBy("source").orderBy("__block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nth = Window.partitionBy("source").orderBy("__block")
    laid = blocks.join(targets.withColumnRenamed("source", "_s"), blocks["source"].eqNullSafe(F.col("_s"))).drop("_s")
    laid = laid.withColumn("_nth", F.row_number().over(nth)).withColumn("_upto", F.sum("words").over(run))
    laid = laid.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("long"))
    laid = laid.withColumn("_rest", F.col("target") - F.col("passes") * F.col("source_size"))
    laid = laid.withColumn("_whole", F.col("_upto") <= F.col("_rest"))
    laid = laid.withColumn("_edge", (~F.col("_whole")) & (F.col("_upto") - F.col("words") < F.col("_rest")))
    laid = saved(laid, "laid")
    stops = _stops(keyed, laid, block_bits).withColumnRenamed("source", "_s")
    quotas = laid.groupBy("rank").agg((F.first("passes") * F.count("*") + F.count_if(F.col("_whole") | F.col("_edge"))).alias("n"))
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = _split(seed, levels, quotas).withColumn("_from", F.coalesce(F.sum("n").over(before), F.lit(0)))
    dealt = runs.select(F.col("rank").alias("_rank"), "shard", F.explode(F.sequence(F.col("_from") + 1, F.col("_from") + F.col("n"))).alias("_draw"))
    # Draws of a source in order: pass after pass over all its blocks, then once more from its first block.
    in_source = F.count("*").over(Window.partitionBy("source"))
    laid = laid.withColumn("_blocks", in_source)
    extra = F.when(F.col("_whole") | F.col("_edge"), F.col("passes")).otherwise(F.col("passes") - 1)
    drawn = laid.select("rank", "__block", F.explode_outer(F.when(extra >= 0, F.sequence(F.lit(0).cast("long"), extra))).alias("_pass"), "_nth", "_blocks", "_whole", "passes")
    drawn = drawn.where("_pass is not null").withColumn("_draw", F.col("_pass") * F.col("_blocks") + F.col("_nth"))
    dealt = drawn.join(dealt, (drawn["rank"] == dealt["_rank"]) & (drawn["_draw"] == dealt["_draw"])).select("rank", "__block", "_pass", "shard", ((F.col("_pass") < F.col("passes")) | F.col("_whole")).alias("_all"))
    shards = dealt.groupBy("rank", "__block").agg(F.array_sort(F.collect_list(F.when(F.col("_all"), F.struct("_pass", "shard")))).alias("_got"), F.max(F.when(~F.col("_all"), F.col("shard"))).alias("edge_shard"))
    out = laid.select("source", "__block", "rank", "source_size", "target").join(shards, ["rank", "__block"], "left").join(stops, F.col("source").eqNullSafe(F.col("_s")), "left")
    got = F.coalesce(F.transform("_got", lambda g: g["shard"]), F.array().cast("array<int>"))
    return saved(out.select(F.col("source").alias("__s"), F.col("__block").alias("__b"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), got.alias("__shards"), F.col("edge_shard").alias("__edge_shard"), F.col("edge_key").alias("__edge_key")), "draws")


def with_draws(keyed: DataFrame, draws: DataFrame) -> DataFrame:
    """Adds __source_size, __target and ``__copies`` (the shard of each copy that the mix takes) to keyed documents."""
    if draws.count() <= BROADCAST_ROWS:
        draws = F.broadcast(draws)
    joined = keyed.join(draws, keyed["source"].eqNullSafe(F.col("__s")) & (keyed["__block"] == F.col("__b")), "left")
    more = F.when(F.col("__edge_shard").isNotNull() & (F.col("__key") <= F.col("__edge_key")), F.array("__edge_shard")).otherwise(F.array().cast("array<int>"))
    return joined.withColumn("__copies", F.concat("__shards", more)).drop("__s", "__b", "__shards", "__edge_shard", "__edge_key")


def mix(docs: DataFrame, seed: int = 1, **how) -> DataFrame:
    """The mixed rows: the columns of ``docs`` with ``mix_shard``, ``mix_copy`` and ``mix_order`` (the place in the shard is
    the rank of this number), which take the place of columns of these names. A document appears once for each copy."""
    columns = [c for c in docs.columns if c not in ("mix_shard", "mix_copy", "mix_order")]
    own = ("doc_id", "source", "text")
    keyed = _keyed(packed(docs.select(*columns), *own), how.get("block_bits", BLOCK_BITS), seed)
    small = saved(keyed.select("doc_id", "source", "__size", "__key", "__block"), "sizes")
    taken = with_draws(keyed, draw_blocks(small, seed, **how)).select("*", F.posexplode("__copies").alias("mix_copy", "mix_shard"))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), "mix_copy", "mix_shard").alias("mix_order")
    return taken.select(*(F.col(c) if c in own else F.col("row").getField(c).alias(c) for c in columns), "mix_copy", "mix_shard", order)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    small = saved(_keyed(docs, BLOCK_BITS).select("doc_id", "source", "__size", "__key", "__block"), "sizes")
    taken = with_draws(small, draw_blocks(small))
    return taken.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.size("__copies")).alias("taken"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS k
  FROM documents),
b AS (SELECT source, k >> {52 - BLOCK_BITS} AS blk, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY ALL),
s AS (SELECT source, CAST(sum(words) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM b GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((rank - 1) % 3 + 1 AS INT)] AS weight FROM s),
v AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, CAST(least(source_size * 2.0::DOUBLE, coalesce(max(CASE WHEN level * weight <= source_size * 2.0::DOUBLE THEN level END) OVER (), 1e300) * weight) AS DOUBLE) AS target FROM v),
l AS (
  SELECT b.source, blk, words, source_size, target, sum(words) OVER (PARTITION BY b.source ORDER BY blk) AS upto,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 1 END AS passes,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 1 END * source_size AS rest
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT d.source, d.k, sum(d.size) AS size, any_value(rest - (upto - words)) AS room
  FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source AND d.k >> {52 - BLOCK_BITS} = l.blk
  WHERE NOT upto <= rest AND upto - words < rest AND d.size > 0 GROUP BY d.source, d.k),
f AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k) AS so_far FROM e),
g AS (SELECT source, max(k) AS stop FROM f WHERE abs(so_far - room) <= abs(so_far - size - room) GROUP BY source)
SELECT d.doc_id, d.size, l.source_size, l.target,
       CAST(d.size * (passes + CASE WHEN upto <= rest OR (upto - words < rest AND d.k <= g.stop) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source AND d.k >> {52 - BLOCK_BITS} = l.blk
LEFT JOIN g ON d.source IS NOT DISTINCT FROM g.source
"""
