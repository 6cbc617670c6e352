"""Mixing sources to target weights by temperature. DataFrame operations only.

Source token shares are raised to an exponent between 0 (even weights) and 1 (as found), bisected until the mix meets a
target: no source repeated more often than a limit, or an entropy of the weights. The weights become token budgets of
the sources; a budget is whole passes over the source and a part of one more. Documents are dealt to blocks by hash,
each pass visits the blocks in an order of its own, and the last pass takes blocks in that order until the budget is
spent, splitting the block it ends in. The budget is the least that gives every source a whole pass, so no document is
ever dropped.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, numbered, row_numbers

#: Least number of blocks of a source, and rows (of all sources) a block beyond that.
BLOCKS, ROWS_A_BLOCK = 256, 50_000
STEPS = 60


def word_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hashed(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts as a positive long, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def bisect(met: Callable[[float], bool]) -> float:
    """The largest exponent in [0, 1] found not to break `met`, which holds at 0 and fails beyond some point; 1 if it
    holds there."""
    if met(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if met(mid) else (low, mid)
    return low


def exponent_for_repeats(most: float, least: float, limit: float) -> float:
    """The least exponent that repeats the rarest source (`least` tokens) at most `limit` times while the commonest
    (`most`) is passed once: repeats are (most / least) ** (1 - exponent)."""
    ratio = most / least if least else 1.0
    if ratio <= limit:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (low, mid) if ratio ** (1 - mid) <= limit else (mid, high)
    return high


def exponent_for_entropy(totals: DataFrame, target: float) -> float:
    """The largest exponent at which the weights of totals(tokens) have at least `target` nats of entropy. Each step is
    a sum over the sources; no list of them comes to the driver."""
    shares = totals.where("tokens > 0").select(F.log(F.col("tokens").cast("double")).alias("t"))

    def enough(e: float) -> bool:
        r = shares.select(F.exp(F.col("t") * e).alias("w"), (F.col("t") * e).alias("lw")).agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("lw")).alias("s")).first()
        return r.z is None or math.log(r.z) - r.s / r.z >= target

    return bisect(enough)


def source_plan(totals: DataFrame, max_repeats: float, entropy: float | None) -> DataFrame:
    """source, weight, passes (whole ones) and rest (tokens of the part pass) for totals(source, tokens)."""
    ends = totals.where("tokens > 0").agg(F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    most = float(ends.most or 1)
    if entropy is not None:
        e = exponent_for_entropy(totals, entropy)
    else:
        e = exponent_for_repeats(most, float(ends.least or 1), max_repeats)
    tokens = F.col("tokens").cast("double")
    z = totals.where("tokens > 0").agg(F.sum(F.pow(tokens / F.lit(most), F.lit(e))).alias("z")).first().z or 1.0
    budget = F.greatest(F.col("tokens"), F.round(F.lit(most) * F.pow(tokens / F.lit(most), F.lit(e))).cast("long"))
    share = F.pow(tokens / F.lit(most), F.lit(e))
    return totals.select(
        "source",
        F.when(F.col("tokens") > 0, share / F.lit(z)).otherwise(0.0).alias("weight"),
        F.when(F.col("tokens") > 0, F.floor(budget / F.col("tokens"))).otherwise(1).cast("long").alias("passes"),
        F.when(F.col("tokens") > 0, budget % F.col("tokens")).otherwise(0).cast("long").alias("rest"),
    )


def mix(
    docs: DataFrame,
    doc_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_repeats: float = 2.0,
    entropy: float | None = None,
    row_col: str | None = None,
) -> DataFrame:
    """One row per row of docs: row_id (row_col, if given), doc_id, source, n_tokens, weight (of its source), copies (1
    or more), block, last_block_turn and last_turn (the row's place in the pass that its last copy is drawn in).

    Tokens are words. The exponent is the least that repeats no source over max_repeats times, or, if `entropy` is
    given, the largest whose weights have that many nats. A null source is a source, shared with ''. Null and empty
    texts have no tokens and one copy; a source without tokens has weight 0 and one pass. Repeated rows are drawn each.
    Extra columns are ignored. An empty table gives no rows. `mixed` repeats the rows and gives each pass its order."""
    rows = docs.select(
        row_numbers(row_col).alias("row_id"),
        F.col(doc_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        word_tokens(F.col(text_col)).alias("n_tokens"),
        hashed(F.coalesce(F.col(doc_col).cast("long"), F.lit(-1))).alias("u"),
    )
    rows = materialise(rows, "mix-rows")
    n_blocks = max(BLOCKS, rows.count() // ROWS_A_BLOCK)
    rows = rows.withColumn("block", F.col("u") % n_blocks)
    blocks = materialise(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")), "mix-blocks")
    plan = source_plan(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")), max_repeats, entropy)
    in_turn = Window.partitionBy("source").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        blocks.join(plan, "source")
        .withColumn("turn", block_turn(F.col("passes") + 1))
        .withColumn("before", F.coalesce(F.sum("tokens").over(in_turn), F.lit(0)))
        .select("source", "block", "weight", "passes", "rest", "before")
    )
    # keys are blocks of a source, so a hot source is spread over its blocks
    in_block = Window.partitionBy("source", "block").orderBy("doc_turn", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    drawn = rows.join(placed, ["source", "block"]).withColumn("doc_turn", doc_turn(F.col("passes") + 1))
    extra = (F.col("n_tokens") > 0) & (F.col("before") + F.sum("n_tokens").over(in_block) <= F.col("rest"))
    copies = F.col("passes") + extra.cast("long")
    return drawn.select("row_id", "doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), copies.alias("copies"), "block", block_turn(copies).alias("last_block_turn"), doc_turn(copies).alias("last_turn"))


def block_turn(pass_: Column) -> Column:
    return hashed(F.col("source"), pass_, F.col("block"))


def doc_turn(pass_: Column) -> Column:
    return hashed(F.col("u"), pass_)


def mixed(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: docs with each row repeated as often as `mix` says, its own columns and mix_pass
    (from 1), mix_block, mix_block_turn and mix_turn. Sorting a source by (mix_pass, mix_block_turn, mix_turn) gives its
    budgeted block permutations. Rows that share a doc_id are drawn each. A column of docs with one of those names, or
    mix_row, raises ValueError."""
    clashing = {"mix_row", "mix_pass", "mix_block", "mix_block_turn", "mix_turn"} & {c.lower() for c in docs.columns}
    if clashing:
        raise ValueError(f"columns are in the way: {sorted(clashing)}")
    rows = numbered(docs, "mix_row", "mix-docs")
    drawn = mix(rows, doc_col, text_col, source_col, row_col="mix_row", **options)
    drawn = drawn.select(F.col("row_id").alias("mix_row"), F.col("doc_id").alias("mix_doc"), F.col("source").alias("mix_source"), F.col("copies").alias("mix_copies"), F.col("block").alias("mix_block"))
    out = rows.join(drawn, "mix_row").withColumn("mix_pass", F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies")))
    u = hashed(F.coalesce("mix_doc", F.lit(-1)))
    turns = {"mix_block_turn": hashed(F.col("mix_source"), F.col("mix_pass"), F.col("mix_block")), "mix_turn": hashed(u, F.col("mix_pass"))}
    return out.withColumns(turns).select(*[F.col(f"`{c}`") for c in docs.columns], "mix_pass", "mix_block", "mix_block_turn", "mix_turn")


def mixing_query(docs: DataFrame) -> DataFrame:
    """op7: every document with the copies it gets when no source is repeated more than twice, and its place in the last
    pass that draws it."""
    return mix(docs).drop("row_id")


MIXING_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
         ('0x' || md5(doc_id::VARCHAR)[:15])::BIGINT AS u
  FROM documents
), r AS (SELECT *, u % greatest(256, (SELECT count(*) FROM d) // 50000) AS block FROM d),
t AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM r GROUP BY source),
m AS (SELECT max(tokens)::DOUBLE AS most, min(tokens)::DOUBLE AS least FROM t WHERE tokens > 0),
b(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN pow(most / least, 1 - (low + high) / 2) <= 2 THEN low ELSE (low + high) / 2 END,
         CASE WHEN pow(most / least, 1 - (low + high) / 2) <= 2 THEN (low + high) / 2 ELSE high END
  FROM b, m WHERE i < 60
), e AS (SELECT CASE WHEN most / least <= 2 THEN 0 ELSE high END AS e, most FROM b, m WHERE i = 60),
p AS (
  SELECT source, tokens, pow(tokens / most, e) AS w,
         greatest(tokens, round(most * pow(tokens / most, e))::BIGINT) AS budget
  FROM t, e WHERE tokens > 0
), q AS (
  SELECT t.source, coalesce(w / (SELECT sum(w) FROM p), 0) AS weight,
         coalesce(budget // t.tokens, 1) AS passes, coalesce(budget % t.tokens, 0) AS rest
  FROM t LEFT JOIN p USING (source)
), o AS (
  SELECT r.*, weight, passes, rest,
         sum(n_tokens) OVER (
           PARTITION BY r.source
           ORDER BY ('0x' || md5(concat_ws('|', r.source, passes + 1, block))[:15])::BIGINT, block, ('0x' || md5(concat_ws('|', u, passes + 1))[:15])::BIGINT
           ROWS UNBOUNDED PRECEDING) AS up_to
  FROM r JOIN q USING (source)
)
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight,
       copies, block, ('0x' || md5(concat_ws('|', source, copies, block))[:15])::BIGINT AS last_block_turn,
       ('0x' || md5(concat_ws('|', u, copies))[:15])::BIGINT AS last_turn
FROM (SELECT *, passes + (n_tokens > 0 AND up_to <= rest)::BIGINT AS copies FROM o)
"""
