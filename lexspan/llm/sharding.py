"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows of each block of the input go to each shard is drawn first, from the multivariate
hypergeometric law that a uniform permutation of all rows would give. Then each block permutes its
own rows by a random key and deals them out by these counts, rows are exchanged, and each cell of
a shard is permuted again. Shards are cut into cells of bounded size, so the second permutation is
never one task for a shard. Counts differ by one row at most between shards ("rows" law).

DataFrame functions only; the matrix is drawn at the driver and bounded by MAX_BLOCKS x shards and
MAX_BLOCKS x cells, whatever the number of rows. Blocks hash a row number of the written slim
table, so a group of equal rows or null ids spreads evenly too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexspan.llm._shared import materialize

MAX_BLOCKS, MAX_CELLS = 1024, 64
#: Rows of a block, and of a cell, below the maxima.
BLOCK_ROWS, CELL_ROWS = 100, 2_000_000


def even(total: int, parts: int) -> np.ndarray:
    """Sizes at most one apart."""
    return total // parts + (np.arange(parts) < total % parts)


def draw_matrix(rows: np.ndarray, columns: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A matrix of counts with these row and column sums, as a uniform permutation would give them."""
    left, out = columns.astype(np.int64).copy(), np.zeros((len(rows), len(columns)), np.int64)
    for i, n in enumerate(rows):
        out[i] = rng.multivariate_hypergeometric(left, int(n), method="marginals")
        left -= out[i]
    return out


def shard_rows(rows: DataFrame, shards: int, seed: int = 7, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """``rows`` with a shard (0 to ``shards`` - 1) and a slot (gapless from 0 in each shard).

    ``rows`` should be slim, an id with what the caller needs beside it; it is written once, so
    that counting and dealing see the same rows if executors are lost. Equal rows are dealt like
    different ones. An empty input gives an empty output; columns of the input with the names of the results give way to
    them, and other columns, nulls and long values pass untouched.
    """
    number = "lexspan_row"
    rows = rows.drop(shard_col, slot_col)
    kept = materialize(rows.withColumn(number, F.monotonically_increasing_id()), "shard-rows")
    total = kept.count()
    blocks = max(1, min(MAX_BLOCKS, -(-total // BLOCK_ROWS)))
    block = F.pmod(F.xxhash64(F.lit(seed), number), F.lit(blocks)).cast("int")
    counts = np.zeros(blocks, np.int64)
    for b, n in kept.groupBy(block.alias("b")).count().collect():
        counts[b] = n
    rng = np.random.default_rng(seed)
    sizes = even(total, shards)
    matrix = draw_matrix(counts, sizes, rng)
    cells = int(max(1, min(MAX_CELLS, -(-int(sizes.max()) // CELL_ROWS))))
    cell_sizes = np.stack([even(int(n), cells) for n in sizes])
    # of each shard's column, how many rows of each block go to each of its cells
    fine = np.stack([draw_matrix(matrix[:, s], cell_sizes[s], rng) for s in range(shards)], axis=1)
    flat = np.cumsum(fine.reshape(blocks, shards, cells), axis=2)
    upto = np.cumsum(matrix, axis=1)
    schema = T.StructType([T.StructField("lexspan_block", T.IntegerType()), T.StructField("lexspan_upto", T.ArrayType(T.LongType())), T.StructField("lexspan_inner", T.ArrayType(T.ArrayType(T.LongType())))])
    deal = kept.sparkSession.createDataFrame([(b, upto[b].tolist(), flat[b].tolist()) for b in range(blocks)], schema)
    starts = F.array(*[F.array(*[F.lit(int(x)) for x in np.cumsum(row) - row]) for row in cell_sizes])

    first = Window.partitionBy("lexspan_block").orderBy("lexspan_key", number)
    own = kept.withColumns({"lexspan_block": block, "lexspan_key": F.xxhash64(F.lit(seed + 1), number)})
    placed = (
        own.withColumn("lexspan_at", (F.row_number().over(first) - 1).cast("long"))
        .join(F.broadcast(deal), "lexspan_block")
        .withColumn(shard_col, F.size(F.filter("lexspan_upto", lambda x: x <= F.col("lexspan_at"))))
        .withColumn("lexspan_in", F.col("lexspan_at") - F.when(F.col(shard_col) > 0, F.expr(f"lexspan_upto[`{shard_col}` - 1]")).otherwise(0))
        .withColumn("lexspan_cell", F.size(F.filter(F.expr(f"lexspan_inner[`{shard_col}`]"), lambda x: x <= F.col("lexspan_in"))))
        .withColumn("lexspan_key", F.xxhash64(F.lit(seed + 2), number))
    )
    second = Window.partitionBy(shard_col, "lexspan_cell").orderBy("lexspan_key", number)
    slot = F.row_number().over(second) - 1 + starts[F.col(shard_col)][F.col("lexspan_cell")]
    return placed.select(*rows.columns, F.col(shard_col), slot.cast("long").alias(slot_col))


def slim(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 16; null: 16), text_crc32 (null: of no bytes)."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"))
