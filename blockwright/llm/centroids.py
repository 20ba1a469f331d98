"""Centroid clustering (Lloyd's rounds in exact integers) by annulus search.

A vector x whose distance to some centroid is u can only be as near to a centroid c if ``|x| - u <= |c| <= |x| + u``
(triangle inequality). Centroids are sorted by norm; the one of the nearest norm gives u, the annulus' two ends are
found by binary search, and the candidates between them are compared exactly, those on the boundary included. Norms
are doubles widened by a slack well above their rounding, so the search leaves no centroid out; distances are integers.

A round is one scan: tasks assign their rows in Arrow batches and hand out one row of sums for each centroid, the sums
meet by centroid, and the driver holds the centroids alone (``k`` times the components).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Components of a vector, factor before rounding down, centroids, rounds and seed of the start.
DIM, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Components from here on (2 to the 27th) are beyond what squared distances in 64 bits allow.
MOST = 1 << 27
#: Candidate pairs that are compared at once.
PAIRS = 1 << 15


def quantised(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v): integer vectors ``floor(scale * x)`` of the rows that can be clustered."""
    x = F.col(embedding).cast("array<double>")
    fit = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(F.floor(e * scale).cast("double")) < MOST) & (F.abs(e) < MOST)
    kept = vectors.select(F.col(id).alias("id"), x.alias("x")).where((F.size("x") == dim) & F.forall("x", fit))
    return kept.select("id", F.transform("x", lambda e: F.floor(e * scale).cast("bigint")).alias("v"))


def start(points: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors of the smallest hashes of ``seed:id``; equal hashes (repeated ids) by their components."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = points.select(named.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in first], dtype=np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; the smaller number of equals."""
    norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(norms, kind="stable")
    by_norm, sorted_c = norms[order], centroids[order]
    own = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    at = np.searchsorted(by_norm, own).clip(0, len(order) - 1)
    left = np.maximum(at - 1, 0)
    guess = np.where(np.abs(by_norm[left] - own) < np.abs(by_norm[at] - own), left, at)
    bound = np.sqrt(((x - sorted_c[guess]) ** 2).sum(axis=1).astype(np.float64))
    slack = 1e-9 * (own + bound + by_norm[-1]) + 1e-6
    lo = np.searchsorted(by_norm, own - bound - slack, side="left")
    hi = np.searchsorted(by_norm, own + bound + slack, side="right")
    number, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    counts, begin = hi - lo, 0
    ends = np.cumsum(counts)
    while begin < len(x):  # runs of rows of about PAIRS candidates
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        n = counts[begin:end]
        first = np.cumsum(n) - n
        which = np.arange(n.sum()) - np.repeat(first - lo[begin:end], n)
        gap = x[np.repeat(np.arange(begin, end), n)] - sorted_c[which]
        d = np.einsum("ij,ij->i", gap, gap)
        least = np.minimum.reduceat(d, first)
        names = np.where(d == np.repeat(least, n), order[which], len(order))
        number[begin:end], distance[begin:end] = np.minimum.reduceat(names, first), least
        begin = end
    return number, distance


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _sums_of(centroids: np.ndarray):
    """Rows of one centroid each: how many vectors a task gave it, and their sums."""

    def run(batches):
        total = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                number, _ = nearest(x, centroids)
                order = np.argsort(number, kind="stable")
                there, first = np.unique(number[order], return_index=True)
                total[there, 1:] += np.add.reduceat(x[order], first, axis=0)
                total[there, 0] += np.diff(np.append(first, len(order)))
        there = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there].tolist(), pa.list_(pa.int64()))], ["c", "s"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            number, distance = nearest(_matrix(batch.column(1)), centroids) if batch.num_rows else (np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pa.array(number), pa.int32()), pc.cast(pa.array(distance), pa.int64())], ["id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for each vector that can be clustered.

    Left out: null vectors, those of another length, with null, NaN or infinite components, or with components whose
    integers reach 2**27 in size (their squared distances have no 64-bit value). A null id is clustered like any other
    and hashes as an empty one. Repeated ids and repeated vectors are rows of their own; of equally near centroids the
    smaller number wins, and a centroid that gets no vector stays where it was. Fewer than ``k`` vectors make fewer
    centroids; an empty table gives no rows. Other columns are not looked at, whatever their names.
    """
    points = quantised(vectors, dim, scale, id, embedding)
    centroids = start(points, k, seed)
    out = "cluster int, distance bigint"
    if not len(centroids):
        return points.select("id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))]).where("false")
    for _ in range(rounds):
        parts = points.select("v").mapInArrow(_sums_of(centroids), "c bigint, s array<bigint>")
        sums = parts.groupBy("c").agg(*[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(dim + 1)]).collect()
        for row in sums:
            centroids[row["c"]] = [int(row[j + 2]) // int(row[1]) for j in range(dim)]
    kind = dict(points.dtypes)["id"]
    assigned = cut(points.mapInArrow(_assign(centroids), f"id {kind}, {out}"))
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    each = {r["cluster"]: r["cluster_inertia"] for r in inertia.collect()}  # a row a centroid
    facts = F.create_map(*[x for c, s in each.items() for x in (F.lit(c), F.struct(F.lit(s).cast("bigint").alias("s"), F.lit(digests[c]).alias("h")))])[F.col("cluster")]
    return assigned.select("id", "cluster", "distance", facts["s"].alias("cluster_inertia"), F.lit(sum(each.values())).cast("bigint").alias("inertia"), facts["h"].alias("centroid_sha256"))


def oracle(table: str = "embeddings", dim: int = DIM, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same by comparing every vector with every centroid, in hugeints."""
    square = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS HUGEINT)) AS v FROM {table} "
        f"WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(floor(CAST(x AS DOUBLE) * {scale})) < {MOST})) = {dim})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT r, min(d) AS d, arg_min(c, (d, c)) AS c FROM (SELECT kept.r, c{r}.c, {square('kept.v', f'c{r}.v')} AS d FROM kept, c{r}) GROUP BY r)"
        )
        if r < rounds:
            steps.append(
                f"m{r} AS (SELECT c, list(s ORDER BY j) AS v FROM (SELECT c, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS s FROM "
                f"(SELECT a{r}.c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{r} JOIN kept USING (r)) GROUP BY c, j) GROUP BY c)"
            )
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))")
    end = f"a{rounds}"
    return (
        "WITH " + ", ".join(steps) + f" SELECT vec_id, CAST({end}.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY {end}.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM {end} JOIN kept USING (r) JOIN c{rounds} ON c{rounds}.c = {end}.c"
    )
