"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts form a group and stay together as long as a shard has room for the group. Every unit has the vector
(bytes, tokens, rows) and goes where the dot product of its vector and the shard's residual capacity is highest, among
the shards that have room for its bytes (where none has, to the one with most room).
The groups larger than a two-hundredth of a shard, fewer than SHARDS * 200, are placed first, on the driver, the
largest first and only where they fit; a group that fits nowhere is split into PARTS units by row number. All smaller
units are dealt by a hash to packing tasks, each of which fills its share of the capacity that is left.

Tokens are runs of characters other than white space, unless the caller names a column that counts them.
Nulls: a null text has no bytes and no tokens (size 8) and forms a group with other null texts; null
ids are ordinary ids. Empty and very long texts, ties and repeated rows, also of one id, are ordinary rows: rows are told
apart by a number that is written with them. An empty table gives no rows. Only the named columns are read, so other
columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mwspark.llm.common import cut, table

SHARDS = 24
PARTS = 256
UNITS_PER_TASK = 4000
SLOT_ROWS = 20000
TOKEN = r"[^\x20\x09-\x0D]+"


def place(units: np.ndarray, residual: np.ndarray, first: int = 0) -> np.ndarray:
    """Shard of each unit vector; residual (shards x 3) is lowered in place. Larger units first."""
    scale = np.maximum(residual.sum(0), 1e-9) / len(residual)
    units, left = units / scale, residual / scale
    order = np.lexsort((np.arange(len(units)), -units.max(1)))
    where = np.zeros(len(units), np.int64)
    turn = np.roll(np.arange(len(left)), -first)
    left = left[turn]
    for i in order:
        room = left[:, 0] >= units[i, 0]  # bytes decide whether a unit fits: that law holds
        s = int(np.argmax(np.where(room, left @ units[i], -np.inf))) if room.any() else int(np.argmax(left[:, 0]))
        left[s] -= units[i]
        where[i] = turn[s]
    residual[turn] = left * scale
    return where


def place_groups(units: np.ndarray, residual: np.ndarray, slack: float) -> np.ndarray:
    """Shard of each group, -1 where none has room (up to slack bytes); residual (shards x 3) is lowered in place."""
    scale = np.maximum(residual.sum(0), 1e-9) / len(residual)
    where = np.full(len(units), -1)
    for i in np.lexsort((np.arange(len(units)), -units[:, 0])):
        room = residual[:, 0] + slack >= units[i, 0]
        if room.any():
            s = int(np.argmax(np.where(room, residual / scale @ (units[i] / scale), -np.inf)))
            residual[s] -= units[i]
            where[i] = s
    return where


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: rows dealt into shards of near equal bytes (and tokens, and rows)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.coalesce(F.col(tokens_col), F.lit(0)) if tokens_col else F.regexp_count(text, F.lit(TOKEN))).cast("long").alias("tokens"),
        F.xxhash64(F.col(text_col), F.lit(1)).alias("g"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = cut(rows)  # from here on a row keeps its number
    part = F.pmod(F.xxhash64("row", F.lit(2)), F.lit(PARTS)).cast("int")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    if not total[2]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    names = ["bytes", "tokens", "rows"]
    capacity = np.array([[x / shards for x in total]] * shards, float)
    groups = cut(rows.groupBy("g").agg(*sums))
    large_from = total[0] / shards / 200
    large = groups.where(F.col("bytes") > large_from).orderBy("g").toPandas()
    large["shard"] = place_groups(large[names].to_numpy(float), capacity, total[0] / shards / 100) if len(large) else []
    large["shard"] = large["shard"].astype("int32")
    placed = F.broadcast(spark.createDataFrame(large[["g", "shard"]], "g long, shard int"))
    rest = rows.join(placed, "g", "left").withColumn("unit", F.when(F.col("shard") == -1, part).otherwise(-1))
    split = rest.where("shard = -1").groupBy("g", "unit").agg(*sums)
    small = groups.where(F.col("bytes") <= large_from).select("g", F.lit(-1).alias("unit"), *names)
    units = cut(small.unionByName(split))
    tasks = 1 + units.count() // UNITS_PER_TASK
    left = np.maximum(capacity, 0)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["g", "unit"])
        v = pdf[names].to_numpy(float)
        own = left * (v.sum(0) / np.maximum(left.sum(0), 1e-9))
        return pd.DataFrame({"g": pdf.g, "unit": pdf.unit, "to": place(v, own, int(key[0])).astype("int32")})

    where = units.groupBy(F.pmod(F.xxhash64("g", "unit"), F.lit(tasks)).alias("task")).applyInPandas(pack, "g long, unit int, to int")
    out = ["doc_id", "size", "text_crc32", "row", "shard"]
    settled = rest.where("shard >= 0").select(*out)
    dealt = rest.where("shard IS NULL OR shard = -1").drop("shard").join(where.withColumnRenamed("to", "shard"), ["g", "unit"]).select(*out)
    return slots(settled.unionByName(dealt), 1 + int(total[2]) // (shards * SLOT_ROWS)).select("doc_id", "size", "text_crc32", "shard", "slot")


def slots(rows: DataFrame, lanes: int) -> DataFrame:
    """Adds slot, gapless from 0 in each shard: numbered in lanes by a hash of the row number, each after the lanes before it."""
    rows = cut(rows.withColumn("lane", F.pmod(F.xxhash64("row"), F.lit(lanes)).cast("int")))
    counts = rows.groupBy("shard", "lane").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("shard", "lane", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("shard", "lane").orderBy("row")) - 1
    return rows.withColumn("inside", inside).join(base, ["shard", "lane"]).withColumn("slot", F.col("base") + F.col("inside"))


def op7_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
