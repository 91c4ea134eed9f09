"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations.

Loggers often store a conversation after each turn, so that one conversation is a prefix of a longer
one. Each turn gets two 64-bit hashes of its number, role and text; XOR-ing them over the turns so far
gives a rolling prefix hash. A conversation whose full hash occurs as a proper prefix of another one is
dropped by an anti-join; of equal ones that with the smallest conv_id stays. What remains is rendered.

The rolling hashes are summed in two levels (spans of ``SPAN`` turn numbers, then turns), and texts are
rendered a span at a time, so a very long conversation is never gathered in one task.

Defined results: repeated rows count once; several rows of one turn are ordered by role and text; a null
turn comes first (as -1), a null role is ``unknown``, a null text empty; a null conv_id is a conversation
of its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import saved, table

SPAN = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _cleaned(turns: DataFrame) -> DataFrame:
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.lower(F.trim("role")), F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, n, h1, h2, last): rows and hash of each prefix that ends with a whole turn."""
    hashed = turns.select("conv_id", "turn", F.xxhash64("turn", "role", "text").alias("a"), F.xxhash64(F.lit(11), "text", "turn", "role").alias("b")).distinct()
    by_turn = hashed.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    by_turn = saved(by_turn.withColumn("span", F.expr(f"turn div {SPAN}L")), "turns")
    spans = by_turn.groupBy("conv_id", "span").agg(F.sum("n").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.max("turn").alias("t"))
    earlier = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    spans = spans.select(
        F.col("conv_id").alias("_c"), F.col("span").alias("_s"),
        F.coalesce(F.sum("n").over(earlier), zero).alias("_n"), F.coalesce(F.bit_xor("a").over(earlier), zero).alias("_a"), F.coalesce(F.bit_xor("b").over(earlier), zero).alias("_b"),
        F.max("t").over(Window.partitionBy("conv_id")).alias("_last"),
    )
    so_far = Window.partitionBy("conv_id", "span").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = by_turn.select("conv_id", "span", "turn", F.sum("n").over(so_far).alias("n"), F.bit_xor("a").over(so_far).alias("a"), F.bit_xor("b").over(so_far).alias("b"))
    both = inner.join(spans, inner["conv_id"].eqNullSafe(spans["_c"]) & (inner["span"] == spans["_s"]))
    return both.select("conv_id", "turn", (F.col("n") + F.col("_n")).alias("n"), F.col("a").bitwiseXOR(F.col("_a")).alias("h1"), F.col("b").bitwiseXOR(F.col("_b")).alias("h2"), (F.col("turn") == F.col("_last")).alias("last"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n) of the conversations that no other one continues; ``prefixes`` must be stored."""
    # Of equal conversations the smallest id stays; null is larger than any. Copies are merged before the join, in part before
    # their shuffle, so that thousands of copies of one conversation are a row a task.
    full = prefixes.where("last").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    within = prefixes.where("not last").select("n", "h1", "h2").distinct()
    return full.join(within, ["n", "h1", "h2"], "left_anti").select("conv_id", "n")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, part, first_turn, last_turn, n_turns, chat): one row for each span of turns."""
    parts = turns.groupBy("conv_id", F.expr(f"turn div {SPAN}L").alias("part")).agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("rows"))
    chat = F.array_join(F.transform("rows", lambda r: F.concat(F.lit(OPEN), r["role"], F.lit("\n"), r["text"], F.lit(CLOSE + "\n"))), "")
    return parts.select("conv_id", "part", F.col("rows")[0]["turn"].alias("first_turn"), F.element_at("rows", -1)["turn"].alias("last_turn"), F.size("rows").cast("long").alias("n_turns"), chat.alias("chat"))


def formatted(conversations: DataFrame) -> DataFrame:
    """Rendered maximal conversations."""
    turns = _cleaned(conversations)
    kept = maximal(saved(prefix_hashes(turns), "prefixes")).select(F.col("conv_id").alias("_c"))
    return render(turns.join(kept, turns["conv_id"].eqNullSafe(F.col("_c")), "left_semi"))


def op9_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations"))


ORACLE = f"""
WITH c AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(lower(trim(role)), 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
r AS (SELECT *, '{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10) AS line FROM c),
t AS (SELECT conv_id, turn, count(*) AS n, string_agg(turn || ':' || line, '' ORDER BY role, text) AS lines FROM r GROUP BY ALL),
p AS (SELECT conv_id, turn, sum(n) OVER w AS n, md5(array_to_string(list(md5(lines)) OVER w, '')) AS h, turn = max(turn) OVER (PARTITION BY conv_id) AS last
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT * FROM p WHERE last AND NOT EXISTS (SELECT 1 FROM p q WHERE NOT q.last AND q.n = p.n AND q.h = p.h)),
k AS (SELECT n, h, min(conv_id) AS conv_id FROM f GROUP BY n, h)
SELECT r.conv_id, r.turn // {SPAN} AS part, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n_turns, string_agg(line, '' ORDER BY turn, role, text) AS chat
FROM r JOIN k ON r.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL
"""
