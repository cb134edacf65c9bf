"""Near-duplicate vectors by quantised tile products.

Equal vectors form one class. The unit vector u of a class is stored as s q + r:
whole numbers q of eight bits, a scale s, and what rounding left, of which only
the norm is kept. Then

    |<u, w> - s_u s_w <q_u, q_w>| <= |s_u q_u| |r_w| + |r_u|

holds for every pair, so the eight-bit products of a tile (a pair of blocks) tell
which pairs are links, which are not, and which few are too close to call. Only
rows of the last kind travel on with their full vectors, and their pairs are
computed in double precision. A tile gives each class its number of links and its
root in the tile's own spanning forest, never its pairs, so a group of copies
costs no more than any other rows.

Blocks hold classes that lie near the same pivot. The angles from a block to the
pivots lie in intervals; two blocks whose intervals at some pivot are further
apart than the threshold's angle have no link (triangle inequality on the sphere),
and their tile is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import cut, discard, read
from .vectors import from_bytes, matrices, usable

THRESHOLD = 0.95
#: Classes of a block, on average, and pivots at most.
ROWS, PIVOTS = 8192, 64
#: Rows of a tile multiplied at once, and doubles gathered at once for pairs too close to call.
STRIP, GATHERED = 128, 1 << 22
#: Slack for rounding in double precision.
SLACK = 1e-9


def units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Eight-bit components, scales, norms of the quantised vectors and of what is left."""
    scale = np.abs(u).max(1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    near = scale[:, None] * q
    return q, scale, np.linalg.norm(near, axis=1), np.linalg.norm(u - near, axis=1)


def _coded(pivots: dict[int, np.ndarray]):
    """Each class with its quantised unit vector, its nearest pivot and its angles to the pivots of its length."""
    names = ["cid", "m", "dim", "cell", "angles", "q", "scale", "size", "left"]

    def run(batches):
        for b in batches:
            for at, v in matrices(b.column(2)):
                u, some = units(v), pa.array(at)
                q, scale, size, left = quantised(u)
                cos = u @ pivots[v.shape[1]].T if v.shape[1] in pivots else np.ones((len(u), 1))
                angles = np.arccos(np.clip(cos, -1, 1)).astype(np.float32)
                cols = [b.column(0).take(some), b.column(1).take(some), pa.array(np.full(len(u), v.shape[1], np.int32)), pa.array(np.argmax(cos, 1).astype(np.int32)), pa.array(list(angles), pa.list_(pa.float32()))]
                cols += [pa.array([x.tobytes() for x in q], pa.binary()), *(pa.array(x) for x in (scale, size, left))]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


CODED = "cid long, m long, dim int, cell int, angles array<float>, q binary, scale double, size double, left double"
FIELDS = ("cid", "m", "q", "scale", "size", "left")
BLOCK = "dim int, n int, low array<double>, high array<double>, " + ", ".join(f"{c} binary" for c in FIELDS)


def _joined(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def _block(table: pa.Table) -> pa.Table:
    """One row for the classes of one block."""
    angles = np.stack(table["angles"].to_pylist()).astype(np.float64)
    held = [_joined(table[c]) if c == "q" else table[c].to_numpy().tobytes() for c in FIELDS]
    cols = [pa.array([table["dim"][0].as_py()], pa.int32()), pa.array([table.num_rows], pa.int32()), pa.array([angles.min(0).tolist()]), pa.array([angles.max(0).tolist()]), *(pa.array([x], pa.binary()) for x in held)]
    return pa.Table.from_arrays(cols, ["dim", "n", "low", "high", *FIELDS])


def merged(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Roots, the first node of each tree, after the pairs (u, v) are joined: hooking and pointer jumping."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        root[np.maximum(a, b)] = np.minimum(a, b)
        while not np.array_equal(up := root[root], root):
            root = up


def _cosines(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    step = max(1, GATHERED // max(1, x.shape[1]))
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[i[k : k + step]], y[j[k : k + step]]) for k in range(0, len(i), step))])


def tile(a: dict, b: dict | None, threshold: float):
    """(links, root, unsure) of the rows of block a and then b; b is None for a block with itself.

    With vectors (key v) the pairs too close to call are decided and counted, and
    only they; without, the sure ones are, and the rows of the others are marked.
    """
    other = a if b is None else b
    n = len(a["cid"])
    cid_count = n + (0 if b is None else len(b["cid"]))
    links, unsure, root = np.zeros(cid_count, np.int64), np.zeros(cid_count, bool), np.arange(cid_count)
    kind = np.float32 if 127 * 127 * a["q"].shape[1] < 1 << 24 else np.float64  # whole numbers stay exact
    right = other["q"].astype(kind).T
    most_left, most_scale = other["left"].max(initial=0), other["scale"].max(initial=0)
    shift = 0 if b is None else n
    for lo in range(0, n, STRIP):
        strip = slice(lo, min(lo + STRIP, n))
        product = a["q"][strip].astype(kind) @ right
        need = threshold - SLACK - a["size"][strip] * most_left - a["left"][strip]
        floor = np.where(need > 0, need / (a["scale"][strip] * most_scale), -np.inf)
        floor = np.nextafter(floor.astype(kind), kind(-np.inf))
        i, j = np.nonzero(product >= floor[:, None])
        if b is None:
            upper = j > i + lo
            i, j = i[upper], j[upper]
        near = product[i, j].astype(np.float64) * a["scale"][i + lo] * other["scale"][j]
        i += lo
        off = a["size"][i] * other["left"][j] + a["left"][i] + SLACK
        sure, open_ = near - off >= threshold, (near + off >= threshold) & (near - off < threshold)
        if "v" in a:
            i, j = i[open_], j[open_]
            right_side = _cosines(a["v"], other["v"], i, j) >= threshold
            i, j = i[right_side], j[right_side]
        else:
            unsure[i[open_]] = True
            unsure[j[open_] + shift] = True
            i, j = i[sure], j[sure]
        links += np.bincount(i, other["m"][j], cid_count).astype(np.int64) + np.bincount(j + shift, a["m"][i], cid_count).astype(np.int64)
        root = merged(root, i, j + shift)
    return links, root, unsure


def _told(i: int, j: int, cid: np.ndarray, second: np.ndarray, links, root, unsure) -> dict:
    """Columns of the rows of a tile that have links or are unsure."""
    at = np.flatnonzero((links > 0) | unsure)
    return {"i": np.full(len(at), i), "j": np.full(len(at), j), "second": second[at], "cid": cid[at], "links": links[at], "root": cid[root[at]], "unsure": unsure[at]}


TOLD = "i long, j long, second boolean, cid long, links long, root long, unsure boolean"


def _side(b: pa.RecordBatch, x: int, prefix: str) -> dict:
    get = lambda c: b.column(b.schema.get_field_index(c))[x]
    n, dim = get(f"{prefix}n").as_py(), get("dim").as_py()
    kinds = {"cid": "i8", "m": "i8", "q": "i1", "scale": "f8", "size": "f8", "left": "f8"}
    return {c: from_bytes(get(prefix + c), k, *((n, dim) if c == "q" else (n,))) for c, k in kinds.items()}


def _products(threshold: float):
    def run(batches):
        for batch in batches:
            for x in range(batch.num_rows):
                i, j = batch.column(0)[x].as_py(), batch.column(1)[x].as_py()
                a, b = _side(batch, x, "a_"), None if i == j else _side(batch, x, "b_")
                cid = a["cid"] if b is None else np.concatenate((a["cid"], b["cid"]))
                yield pa.RecordBatch.from_pydict(_told(i, j, cid, np.arange(len(cid)) >= len(a["cid"]), *tile(a, b, threshold)))

    return run


def _decided(threshold: float):
    """The unsure rows of one tile, with their vectors."""

    def run(table: pa.Table) -> pa.Table:
        second = table["second"].to_numpy()
        sides = []
        for rows in (table.filter(pa.array(~second)), table.filter(pa.array(second))):
            s = {c: rows[c].to_numpy() for c in FIELDS if c != "q"}
            v = rows["v"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1 if rows.num_rows else 0)
            sides.append(s | {"q": np.frombuffer(_joined(rows["q"]), np.int8).reshape(rows.num_rows, v.shape[1]), "v": units(v) if rows.num_rows else v})
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        a, b = sides[0], None if i == j else sides[1]
        cid = a["cid"] if b is None else np.concatenate((a["cid"], b["cid"]))
        return pa.table(_told(i, j, cid, np.arange(len(cid)) >= len(a["cid"]), *tile(a, b, threshold)))

    return run


def _pivots(classes: DataFrame, blocks: int) -> dict[int, np.ndarray]:
    """Unit vectors of the classes with the smallest hashes, one for a block, PIVOTS at most, by length."""
    rows = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(min(blocks, PIVOTS)).toArrow()
    return {v.shape[1]: units(v) for _, v in matrices(rows["v"].combine_chunks())} if rows.num_rows else {}


def _tiles(blocks: DataFrame, threshold: float) -> DataFrame:
    """Pairs (i, j) of blocks of one length, i <= j, whose angles to every pivot overlap within the threshold's."""
    deals = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = blocks.select("block", "dim", "low", "high")
    left = short.select(F.col("block").alias("i"), "dim", F.pmod(F.xxhash64("block"), F.lit(deals)).cast("int").alias("deal"), F.col("low").alias("la"), F.col("high").alias("ha"))
    right = short.select(F.col("block").alias("j"), "dim", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    angle = F.lit(math.acos(max(-1.0, min(1.0, threshold))) + 1e-5)
    apart = F.exists(F.arrays_zip("la", "ha", "lb", "hb"), lambda x: (x["la"] > x["hb"] + angle) | (x["lb"] > x["ha"] + angle))
    return left.join(right, ["dim", "deal"]).filter((F.col("i") <= F.col("j")) & ~apart).select("i", "j")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Two rows link when the cosine of their vectors is at least ``threshold`` (more than 0), in double precision;
    n_links counts the other rows linked, component_id is the smallest id reachable, kept is vec_id = component_id.

    Vectors that are null, without components, zero, or hold a null or non-finite component link with nothing, nor do
    vectors of different lengths. Equal vectors link, whatever their ids; repeated rows count one by one and share
    their fate. Null ids are never the smallest: a component of such rows only has a null id, and its rows are kept.
    Ties at the threshold are links. Very long vectors are quantised like others; an empty table gives an empty
    result. Only id and vector are read, so other columns cannot clash.
    """
    if not threshold > 0:
        raise ValueError("the threshold must be positive")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    good = usable(F.col("v")) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    classes = cut(rows.filter(good).groupBy("v").agg(F.count("*").alias("m"), F.min("vec_id").alias("least")).withColumn("cid", F.monotonically_increasing_id()), "vectors-classes")
    n = classes.count()
    coded = cut(classes.select("cid", "m", "v").mapInArrow(_coded(_pivots(classes, -(-n // ROWS))), CODED), "vectors-coded")
    parts = coded.groupBy("dim", "cell").agg(F.ceil(F.count("*") / ROWS).alias("parts"))
    dealt = coded.join(parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("cid"), "parts"))
    blocks = cut(dealt.groupBy("dim", "cell", "part").applyInArrow(_block, BLOCK).withColumn("block", F.monotonically_increasing_id()), "vectors-blocks")
    tiles = cut(_tiles(blocks, threshold), "vectors-tiles")
    side = lambda name, c: blocks.select(F.col("block").alias(name), *(["dim"] if c == "a_" else []), *[F.col(x).alias(c + x) for x in ("n", *FIELDS)])
    paired = tiles.join(side("i", "a_"), "i").join(side("j", "b_"), "j").select("i", "j", "dim", *[c + x for c in ("a_", "b_") for x in ("n", *FIELDS)])
    told = cut(paired.mapInArrow(_products(threshold), TOLD), "vectors-told")

    close = told.filter("unsure").select("i", "j", "second", "cid").join(coded.drop("dim", "cell", "angles"), "cid").join(classes.select("cid", "v"), "cid")
    decided = cut(close.groupBy("i", "j").applyInArrow(_decided(threshold), TOLD), "vectors-decided")
    found = told.union(decided).filter("links > 0").select("cid", "links", "root")
    labels = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = cut(
        classes.select("cid", "m", "least").join(counts, "cid", "left").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
        .select("cid", "least", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("label", "cid").alias("label")),
        "vectors-named",
    )
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = named.join(smallest, "label").select("cid", "n_links", "component_id").join(classes.select("cid", "v"), "cid")
    linked = rows.filter(good).join(of_class, "v").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = cut(linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "vectors-near")
    discard(classes, coded, blocks, tiles, told, decided, named)
    return out


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


OP11_SQL = f"""
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false)
    AND coalesce(list_bool_or(list_transform(embedding, lambda x: x <> 0)), false)
), u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS size FROM e),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_dot_product(a.v, b.v) / (a.size * b.size) >= {THRESHOLD} ELSE false END
), r AS (SELECT vec_id, vec_id AS seen FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT vec_id, min(seen) AS component_id FROM r GROUP BY 1),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""
