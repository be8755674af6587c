"""Sharding by weighted rendezvous hashing: DataFrame expressions only.

Each (record key, shard) pair gets a uniform number u from md5, and a record goes to the shard with the
largest -weight / ln(u). A record's choice among the old shards doesn't change when shards are added or
weights of others grow, so one more shard takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, materialize, stable_salt

#: Slots are numbered in so many slices of a shard, so that no task sorts a whole shard.
SALTS = 1024
#: 15 hex digits of md5 are 60 bits.
DIGITS, SCALE = 15, float(1 << 60)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Index of the shard that wins the record; ties (equal digests) go to the lower shard. A null key counts as an empty one."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a positive weight")
    text = F.coalesce(key.cast("string"), F.lit(""))

    def bid(shard: int, weight: float) -> Column:
        digest = F.substring(F.md5(F.concat(text, F.lit(f":{shard}")).cast("binary")), 1, DIGITS)
        u = (F.conv(digest, 16, 10).cast("double") + F.lit(0.5)) / F.lit(SCALE)
        return F.lit(-float(weight)) / F.ln(u)

    bids = [F.struct(bid(i, w).alias("bid"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)]
    return (-(F.greatest(*bids) if len(bids) > 1 else bids[0])["shard"]).cast("int")


def shard(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", added_weight: float | None = None, salts: int = SALTS) -> DataFrame:
    """Shard and gapless slot of every document row, with its size and text checksum.

    The key is id_col alone. Size is the UTF-8 length plus 1, so 1 for a null or empty text; a null text has the
    checksum of an empty one. Repeated rows share a shard and get slots of their own; null ids are kept as one
    key. Slots follow (slice of md5 of the key, key). Other columns play no part. An empty table gives none.
    """
    key = F.col(id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    grown = [*weights, added_weight if added_weight is not None else sum(weights) / len(weights)]
    rows = docs.select(
        key.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"), rendezvous(key, grown).alias("grown_shard"),
    )
    rows = materialize(rows, "shards")  # texts are read once
    rows = gapless_rank(rows, ["shard"], ["doc_id", "text_crc32"], "slot", F.coalesce(stable_salt(F.col("doc_id"), salts), F.lit(0)))
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
