"""Centroid clustering over zone maps along a space-filling curve.

Vectors of integers are put in Hilbert order and written once as blocks of BLOCK neighbours, each with the smallest and
largest value per component: its box. In a round, the squared distance from a centroid to the nearest and the farthest
point of the box bounds its distance to every vector of the block. Centroids whose nearest point lies farther than the
farthest point of some other centroid cannot win there; only the others are compared with the block's vectors, exactly.

Blocks never leave their place after the first shuffle: a round reads them, and a task sends at most one row per cluster
and component. Sums are exact integers, sent as two limbs; only the centroids, whose number is a parameter, come to the
driver. Of the curve the bounds need nothing: another order would only make boxes wider.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import discard, save

DIMS = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
#: Vectors of a block, all of one task.
BLOCK = 256
#: Bits per component on the curve.
CURVE_BITS = 4
#: Up to this size of a component, squared distances of DIMS components fit into 63 bits.
EXACT = 1 << 27
LIMB = 1 << 60
LONGEST = (1 << 63) - 1

BLOCKS = "ids array<{id}>, vectors binary, low binary, high binary"


def quantise(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python integers where one of them is too large for exact distances."""
    with np.errstate(over="ignore"):
        q = np.floor(x * float(scale))
    if not q.size or np.abs(q).max() <= EXACT:
        return q.astype(np.int64)
    whole = [int(v) * scale if abs(v) >= 2.0**52 else int(np.floor(v * scale)) for v in x.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(x.shape)


def hilbert_keys(cells: np.ndarray, bits: int = CURVE_BITS) -> list[bytes]:
    """Place of each row of cell numbers under 2^bits along the Hilbert curve, as bytes that sort in curve order."""
    x = cells.astype(np.uint16).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = np.uint16(q - 1)
        for i in range(n):
            turned = (x[i] & q).astype(bool)
            swap = np.where(turned, 0, (x[0] ^ x[i]) & p).astype(np.uint16)
            x[0] ^= np.where(turned, p, swap).astype(np.uint16)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], dtype=np.uint16)
    q = top
    while q > 1:
        flip ^= np.where(x[n - 1] & q, q - 1, 0).astype(np.uint16)
        q >>= 1
    x ^= flip
    planes = [(x >> np.uint16(b)) & np.uint16(1) for b in range(bits - 1, -1, -1)]
    stream = np.concatenate(planes, axis=0).T.astype(np.uint8)
    return [row.tobytes() for row in np.packbits(stream, axis=1)]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def usable(vectors: DataFrame, id: str, vector: str, dims: int) -> DataFrame:
    """(id, x): the vectors with exactly ``dims`` components, none null or non-finite, as doubles."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(F.col(id).alias("id"), x.alias("x")).filter((F.size("x") == dims) & ~bad)


def first_centroids(vectors: DataFrame, k: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of ``1:<id>``, in that order; a null id counts as empty, ties go by value."""
    sha = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(sha.alias("sha"), "x").orderBy("sha", "x").limit(k).collect()
    return [quantise(np.array(r["x"])).tolist() for r in rows]


def blocks(vectors: DataFrame, dims: int, size: int = BLOCK) -> DataFrame:
    """The vectors (id, x) as blocks of at most ``size`` neighbours in Hilbert order, with their boxes.

    Equal vectors have one place on the curve; the number of their row parts them, so no task gets them all.
    """
    span = vectors.agg(
        F.array(*[F.min(F.get("x", F.lit(i))) for i in range(dims)]).alias("low"),
        F.array(*[F.max(F.get("x", F.lit(i))) for i in range(dims)]).alias("high"),
    ).first()
    low = np.array([v if v is not None else 0.0 for v in span["low"]])
    high = np.array([v if v is not None else 0.0 for v in span["high"]])
    kind = vectors.schema["id"].dataType
    id_type = to_arrow_type(kind)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = np.maximum(high / 2 - low / 2, np.finfo(np.float64).tiny)
        for batch in batches:
            x = _matrix(batch.column(2), dims)
            cells = np.clip(np.floor((x / 2 - low / 2) / half * (1 << CURVE_BITS)), 0, (1 << CURVE_BITS) - 1)
            keys = pa.array(hilbert_keys(cells) if len(x) else [], pa.binary())
            raw = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys, raw], names=["id", "row", "place", "x"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        raw: list[bytes] = []

        def block(n: int) -> pa.RecordBatch:
            x = np.frombuffer(b"".join(raw[:n]), dtype="<f8").reshape(n, dims)
            data = [
                pa.array([ids[:n]], pa.list_(id_type)),
                pa.array([x.tobytes()], pa.binary()),
                pa.array([x.min(axis=0).tobytes()], pa.binary()),
                pa.array([x.max(axis=0).tobytes()], pa.binary()),
            ]
            del ids[:n], raw[:n]
            return pa.RecordBatch.from_arrays(data, names=["ids", "vectors", "low", "high"])

        for batch in batches:
            ids.extend(batch.column(0).to_pylist())
            raw.extend(batch.column(1).to_pylist())
            while len(ids) >= size:
                yield block(size)
        if ids:
            yield block(len(ids))

    name = kind.simpleString()
    numbered = vectors.select("id", F.monotonically_increasing_id().alias("row"), "x")
    placed = numbered.mapInArrow(keyed, f"id {name}, row long, place binary, x binary")
    ordered = placed.repartitionByRange("place", "row").sortWithinPartitions("place", "row").select("id", "x")
    return ordered.mapInArrow(cut, BLOCKS.format(id=name))


def candidates(low: np.ndarray, high: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some point of the box."""
    under, over = low - centres, centres - high
    gap = np.maximum(np.maximum(under, over), 0)
    reach = np.maximum(np.abs(under), np.abs(over))
    nearest, farthest = (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)
    return np.flatnonzero(nearest <= farthest.min())


def nearest(q: np.ndarray, low: np.ndarray, high: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row of ``q``, which lies within the box; ties go to the smaller number."""
    of = candidates(low, high, centres)
    gaps = [q - centres[c] for c in of]
    squares = np.stack([(g * g).sum(axis=1) for g in gaps], axis=1)
    best = squares.argmin(axis=1)
    return of[best], squares[np.arange(len(q)), best]


def _opened(batch: pa.RecordBatch, dims: int, centres: list[list[int]]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, integers, cluster, distance) of each block of a batch."""
    largest = max(abs(v) for c in centres for v in c)
    for i in range(batch.num_rows):
        x, low, high = (np.frombuffer(batch.column(k)[i].as_py(), dtype="<f8") for k in (1, 2, 3))
        q, a, b = quantise(x.reshape(-1, dims)), quantise(low), quantise(high)
        kind = np.int64 if q.dtype == np.int64 and largest <= EXACT else object
        cluster, distance = nearest(q.astype(kind), a.astype(kind), b.astype(kind), np.array(centres, dtype=kind))
        yield batch.column(0)[i].as_py(), q, cluster, distance


def next_centroids(zones: DataFrame, centres: list[list[int]], dims: int) -> list[list[int]]:
    """Floor of the mean of each cluster's vectors; a cluster without vectors keeps its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0] * dims for _ in centres]
        counts = [0] * len(centres)
        for batch in batches:
            for _, q, cluster, _ in _opened(batch, dims, centres):
                for c in np.unique(cluster).tolist():
                    of = q[cluster == c]
                    counts[c] += len(of)
                    sums[c] = [s + t for s, t in zip(sums[c], of.sum(axis=0).tolist(), strict=True)]
        rows = [(c, i, *divmod(s, LIMB), counts[c]) for c, row in enumerate(sums) if counts[c] for i, s in enumerate(row)]
        if rows:
            c, i, high, low, n = zip(*rows, strict=True)
            wide = pa.decimal128(38, 0)
            data = [pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(map(Decimal, high), wide),
                    pa.array(map(Decimal, low), wide), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(data, names=["cluster", "component", "high", "low", "n"])

    parts = zones.mapInArrow(run, "cluster int, component int, high decimal(38,0), low decimal(38,0), n long")
    out = [list(c) for c in centres]
    # One row per cluster and component.
    for r in parts.groupBy("cluster", "component").agg(F.sum("high").alias("h"), F.sum("low").alias("l"), F.sum("n").alias("n")).collect():
        out[r["cluster"]][r["component"]] = (int(r["h"]) * LIMB + int(r["l"])) // r["n"]
    return out


def assigned(zones: DataFrame, centres: list[list[int]], dims: int) -> DataFrame:
    """(id, cluster, distance); a distance that no 64-bit integer holds is given as the largest one."""
    id_type = zones.schema["ids"].dataType.elementType
    arrow = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, cluster, distance in _opened(batch, dims, centres):
                long = [min(d, LONGEST) for d in distance.tolist()]
                data = [pa.array(ids, arrow), pa.array(cluster, pa.int32()), pa.array(long, pa.int64())]
                yield pa.RecordBatch.from_arrays(data, names=["id", "cluster", "distance"])

    return zones.mapInArrow(run, f"id {id_type.simpleString()}, cluster int, distance long")


def cluster(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, id: str = "vec_id", vector: str = "embedding", dims: int = DIMS
) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every usable vector, and the final centroids.

    Vectors of another length, null ones and those with a null or non-finite component are left out. Rows that repeat
    an id or a vector count each; ids may be null. With fewer than ``k`` vectors there are fewer clusters, and none of an
    empty table. Other columns are not read. Components of any finite size are compared exactly.
    """
    rows = usable(vectors, id, vector, dims)
    centres = first_centroids(rows, k)
    if not centres:
        kind = rows.schema["id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"{id} {kind}, cluster int, distance long"), []
    zones = save(blocks(rows, dims), "zones")
    for _ in range(rounds):
        centres = next_centroids(zones, centres, dims)
    out = save(assigned(zones, centres, dims).withColumnRenamed("id", id), "assigned")
    discard(zones)
    return out, centres


def centroid_clusters(vectors: DataFrame) -> DataFrame:
    """op12: cluster and squared distance of every vector, with the sums of distances and a digest of the centroid."""
    found, centres = cluster(vectors)
    wide = F.col("distance").cast("decimal(38,0)")
    # At most one row per cluster.
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(wide).alias("s")).collect()}
    whole = min(sum(sums.values()), LONGEST)
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    facts = found.sparkSession.createDataFrame(
        [(c, min(s, LONGEST), whole, shas[c]) for c, s in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def clusters_sql() -> str:
    """The same in SQL: three rounds written out."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT vec_id, rid, min(struct_pack(d := d, c := c)) AS b FROM (
    SELECT x.vec_id, x.rid, k.c, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x.v, k.m)])::BIGINT AS d
    FROM kept x, means{r} k)
  GROUP BY vec_id, rid)""")
        if r < ROUNDS:
            steps.append(f"""
means{r + 1} AS MATERIALIZED (
  SELECT k.c, coalesce(s.m, k.m) AS m FROM means{r} k LEFT JOIN (
    SELECT c, list((t - ((t % n) + n) % n) // n ORDER BY i) AS m FROM (
      SELECT b.c AS c, i, sum(v[i])::BIGINT AS t, count(*) AS n
      FROM (SELECT n.b, x.v, unnest(range(1, {DIMS + 1})) AS i FROM near{r} n JOIN kept x USING (rid)) GROUP BY ALL)
    GROUP BY c) s USING (c))""")
    last = ROUNDS
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
means0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v AS m FROM kept
  QUALIFY c < {CLUSTERS}),
{",".join(steps).strip()},
sums AS (SELECT b.c AS c, sum(b.d)::BIGINT AS s FROM near{last} GROUP BY ALL)
SELECT vec_id, b.c::INT AS cluster, b.d AS distance, s.s AS cluster_inertia, (SELECT sum(s)::BIGINT FROM sums) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM near{last} n JOIN sums s ON n.b.c = s.c JOIN means{last} k ON n.b.c = k.c"""
