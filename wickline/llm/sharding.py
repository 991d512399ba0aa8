"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickline.llm.scratch import written

BLOCK_ROWS = 20_000
MAX_BLOCKS = 65_536


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` out of ``good + bad`` are good: inversion over the window
    around the mode that holds all but a vanishing mass, from ratios of neighbours."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    share = good / total
    sd = math.sqrt(max(draws * share * (1 - share) * (total - draws) / max(total - 1, 1), 1.0))
    reach = int(40 * sd) + 40
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    ratio = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], side="right").clip(0, high - low))


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Rows that each block sends to each shard, as a uniform permutation would
    send them: row sums are the block sizes, column sums the shard sizes."""
    rng = np.random.default_rng(seed)
    left = list(shard_rows)
    out = []
    for rows in block_rows:
        line, draws, rest = [], rows, sum(left)
        for s, size in enumerate(left):
            rest -= size
            got = hypergeometric(rng, size, rest, draws)
            line.append(got)
            draws -= got
        left = [a - b for a, b in zip(left, line)]
        out.append(line)
    return out


def _matrix_table(spark: SparkSession, blocks: list[int], matrix: list[list[int]]) -> DataFrame:
    """(block, bounds): the running sums of a block's line of the matrix. At most
    ``MAX_BLOCKS`` lines, so the broadcast has a fixed bound."""
    lines = json.dumps([{"of_block": b, "bounds": np.cumsum(line).tolist()} for b, line in zip(blocks, matrix)])
    parsed = F.from_json(F.lit(lines), "array<struct<of_block: int, bounds: array<bigint>>>")
    return spark.range(1).select(F.inline(parsed))


def uniform_shards(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in its shard).

    Shard sizes differ by one row at most, the first ones being the larger. Each row
    gets a seeded random key from its position in the input, written once, so that
    every later stage can be repeated. The key's hash puts rows into blocks; the
    sizes of the blocks (at most ``MAX_BLOCKS`` numbers) fix the matrix; a block is
    permuted by a second hash and dealt out by its line of the matrix; each shard is
    permuted again by a third, bin by bin, with running counts of the bins as offsets.
    No task holds more than a block or a bin.

    Values aren't looked at: nulls, empty texts and repeated rows are rows like
    others, and copies of a row are spread. An empty table gives an empty result.
    Columns named ``shard`` or ``slot`` are replaced.
    """
    spark = df.sparkSession
    passed = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")]
    place = F.monotonically_increasing_id()
    keyed = written(df.select(F.struct(*passed).alias("row"), F.xxhash64(F.lit(seed), place).alias("key"), place.alias("place")), "shards")
    total = keyed.count()

    def mixed(step: int) -> Column:
        return F.xxhash64(F.lit(f"{seed}:{step}"), "key", "place")

    n_blocks = max(1, min(MAX_BLOCKS, -(-total // BLOCK_ROWS)))
    blocked = keyed.withColumn("block", F.pmod(mixed(0), F.lit(n_blocks)).cast("int"))
    sizes = sorted(tuple(r) for r in blocked.groupBy("block").count().collect())
    shard_rows = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([n for _, n in sizes], shard_rows, seed)
    lines = F.broadcast(_matrix_table(spark, [b for b, _ in sizes], matrix))

    local = Window.partitionBy("block").orderBy(mixed(1), "place")
    ranked = blocked.withColumn("rank", F.row_number().over(local).cast("long"))
    shard = F.size(F.filter("bounds", lambda bound: bound < F.col("rank"))).cast("int")
    # The second permutation: rows of a shard in the order of their bins, and of a hash within.
    n_bins = max(1, -(-total // (shards * BLOCK_ROWS)))
    dealt = ranked.join(lines, F.col("block") == F.col("of_block")).select(
        "row", "key", "place", shard.alias("shard"), F.pmod(mixed(2), F.lit(n_bins)).cast("int").alias("bin")
    )
    dealt = written(dealt, "dealt")
    running = F.sum("count").over(Window.partitionBy("shard").orderBy("bin"))
    before = dealt.groupBy("shard", "bin").count().select("shard", "bin", (running - F.col("count")).alias("from"))
    inner = Window.partitionBy("shard", "bin").orderBy(mixed(3), "place")
    return (
        dealt.withColumn("at", F.row_number().over(inner).cast("long"))
        .join(before, ["shard", "bin"])
        .select("row.*", "shard", (F.col("from") + F.col("at") - 1).alias("slot"))
    )
