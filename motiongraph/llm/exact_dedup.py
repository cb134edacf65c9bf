"""Exact deduplication with an extendible-hash index on shared files.

The index holds one entry per row: its number, the 64-bit hash of the normalised
text, and the row itself. A directory over the leading hash bits starts with one
bucket and doubles: a bucket with more than ``capacity`` entries splits by the
next bit, until it fits or the bits are used up; what is still overfull then
(copies of one text have one hash) is spread over several owners. Each owner task
gets the entries of whole buckets, that is of key ranges, in one shuffle. It
walks their chains in the order of hash and normalised text; texts that collide
in the hash are told apart there by comparing them, byte by byte. Owners of one
spread bucket merge their groups afterwards, one entry for each owner and text.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, read, sweep, without_blanks

#: Entries a bucket holds, and bits a directory has at most (2**20 rows of 24 bytes).
CAPACITY, MOST_BITS = 4096, 20


def build_index(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Entries (rid, h, row) as files in the shared folder."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    return cut(docs.select(F.monotonically_increasing_id().alias("rid"), F.xxhash64(without_blanks(docs[text_col])).alias("h"), row.alias("row")), "dedup-index")


def directory(index: DataFrame, bits: int, capacity: int) -> DataFrame:
    """(cell, bucket, owners) for each of the at most 2**bits leading hash patterns.

    A pattern's depth is one more than the deepest overfull bucket above it.
    Buckets are numbered like a heap: 1 is the whole key space, 2b and 2b+1
    are the halves of b. A bucket at the last depth that holds more than
    ``capacity`` entries has several owners.
    """
    cells = index.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("cell")).agg(F.count("*").alias("n"))
    above = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn("node", F.expr(f"shiftright(cell, {bits} - depth)"))
    overfull = above.groupBy("depth", "node").agg(F.sum("n").alias("held")).filter(F.col("held") > capacity)
    split = above.join(overfull, ["depth", "node"]).groupBy("cell").agg(F.least(F.max("depth") + 1, F.lit(bits)).alias("depth"), F.max(F.when(F.col("depth") == bits, F.col("held"))).alias("held"))
    return cells.select("cell").join(split, "cell", "left").select(
        "cell",
        (F.expr("shiftleft(1L, coalesce(depth, 0))") + F.expr(f"shiftright(cell, {bits} - coalesce(depth, 0))")).alias("bucket"),
        F.coalesce(F.ceil(F.col("held") / capacity), F.lit(1)).cast("long").alias("owners"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: keep_id, group_size, kept, text_sha256, bucket and the row.

    Texts are equal when identical after deleting ASCII white space; null counts
    as empty. Of equal texts the row with the most code points stays, then the
    smallest id (null ids last), then the first as stored, so that of repeated
    rows exactly one stays. Columns of ``docs`` come back in the struct ``row``
    and cannot clash. An empty table gives an empty result.

    An owner holds about ``capacity`` entries of a hot text at most; very long
    texts take the memory of a few texts, as rows go by one at a time.
    """
    index = build_index(docs, text_col)
    if bits is None:
        bits = min(max(math.ceil(math.log2(max(index.count() / capacity, 1))) + 3, 4), MOST_BITS)
    # at most 2**bits rows, whatever the size of the table
    buckets = F.broadcast(directory(index, bits, capacity))
    text = F.col(f"row.{text_col}")
    entries = (
        index.withColumn("cell", F.shiftrightunsigned("h", 64 - bits))
        .join(buckets, "cell")
        .select("bucket", "owners", F.pmod(F.xxhash64("rid"), F.col("owners")).alias("owner"), "h", without_blanks(text).alias("norm"), "rid", F.length(F.coalesce(text, F.lit(""))).alias("n_points"), F.col(f"row.{id_col}").alias("id"))
        .repartition("bucket", "owner")
    )
    key = F.struct((-F.col("n_points")).alias("shorter"), F.col("id").isNull().alias("no_id"), "id", "rid")
    chains = (
        entries.groupBy("bucket", "owner", "owners", "h", "norm")
        .agg(F.min(key).alias("best"), F.count("*").alias("group_size"), F.collect_list("rid").alias("rids"))
        .select("bucket", F.when(F.col("owners") > 1, F.struct("h", "norm")).alias("spread"), F.sha2("norm", 256).alias("sha"), "best", "group_size", "rids")
    )
    chains = cut(chains, "dedup-chains")
    sweep(docs.sparkSession)
    apart = chains.filter("spread IS NOT NULL")
    merged = apart.groupBy("spread").agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
    whole = chains.filter("spread IS NULL").drop("spread").unionByName(apart.drop("best", "group_size").join(merged, "spread").drop("spread"))
    found = whole.select("bucket", "sha", "best", "group_size", F.explode("rids").alias("rid"))
    return index.join(found, "rid").select(
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "bucket",
        "row",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they were.

    Nulls, ties, repeated rows, long texts and empty tables are as in exact_dedup();
    other columns pass through and may have any name.
    """
    return exact_dedup(docs, id_col, text_col).filter("kept").select("row.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


OP2_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
