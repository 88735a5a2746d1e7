"""Near-duplicate vectors: cross-polytope hashing, multiprobe buckets, exact confirmation.

Hashing.  A unit vector is turned by three rounds of random signs and a fast Hadamard transform; the
axis it lies nearest to (with its sign) is its cross-polytope hash.  A table joins as many such hashes
as the row count needs (the last one over fewer axes), so a bucket holds few unrelated vectors at
any size.  Each vector is stored in its own bucket of each table and also looks into the buckets
that change one hash to the next nearest axis.

Work is kept linear in groups of copies:

* equal vectors are one class;
* a class within 9 degrees of a smaller class of its bucket joins that class's *core*, if that one
  leads a core.  Any two members of a core are within 18 degrees, so cosine 0.95 (18.19 degrees) is
  certain and needs no comparison;
* cores, once per bucket, are compared by eight-bit sketches with an error bound; pairs of cores that
  may hold a link are compared block against block in double precision, and only counts per vector
  and one edge per pair of cores leave a task.

Links found this way have a cosine of at least the threshold; a linked pair is missed only if none
of its core mates ever meet in a bucket.

Rules.  Vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
vectors of different lengths neither.  Rows that repeat a vec_id count as vectors of their own with a
common id.  A null vec_id has a null component and is kept.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import U64, mix, written
from proxima.llm.components import connected_components

TABLES = 16
PROBES = 3                       # further buckets a vector looks into, per table
ROWS_PER_BUCKET = 2              # buckets are made for about so many rows each
MEMBERS = 128                    # vectors of a block of a core
SMALL_BUCKET = 64                # cores of a bucket up to which many buckets share a group
SHARD_ROWS = 8192                # rows of such a group, about
BUCKET_BLOCK = 2048              # cores of a larger bucket that are compared in one piece
SLACK = 1e-9


# ----------------------------------------------------------------- hashing
def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two), up to scale."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def _axes(dim: int, bits: int) -> list[int]:
    """How many axes each hash of a table uses: whole ones, and a last one for the bits that are left."""
    full = dim.bit_length()                              # log2(dim) + 1 for the sign
    whole, rest = divmod(bits, full)
    return [dim] * whole + ([1 << (rest - 1)] if rest else [])


def codes(x: np.ndarray, bits: int, table: int) -> np.ndarray:
    """Bucket of every row of ``x`` in a table, and the buckets it looks into: (rows, 1 + PROBES)."""
    dim = 1 << max(0, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), dim))
    padded[:, : x.shape[1]] = x
    first, second, loss = [], [], []
    axes = _axes(dim, bits)
    rows = np.arange(len(x))
    for part, used in enumerate(axes):
        rng = np.random.default_rng([table, part, dim])
        y = padded
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], dim)) / math.sqrt(dim)
        y = y[:, :used]
        a = np.abs(y)
        best = a.argmax(axis=1)
        top = a[rows, best]
        first.append(best * 2 + (y[rows, best] < 0))
        if used > 1:
            a[rows, best] = -1
            nxt = a.argmax(axis=1)
            second.append(nxt * 2 + (y[rows, nxt] < 0))
            loss.append(top - a[rows, nxt])
        else:
            second.append(1 - first[-1])
            loss.append(2 * top)
    first, second, loss = np.stack(first, 1), np.stack(second, 1), np.stack(loss, 1)
    weights = np.cumprod([1, *[2 * u for u in axes[:-1]]]).astype(np.int64)
    base = (first * weights).sum(axis=1)
    change = (second - first) * weights
    # probes: the cheapest sets of changed hashes, of up to two changes
    k = len(axes)
    options = [(i,) for i in range(k)] + [(i, j) for i in range(k) for j in range(i + 1, k)]
    cost = np.stack([sum(loss[:, i] ** 2 for i in o) for o in options], 1)
    move = np.stack([sum(change[:, i] for i in o) for o in options], 1)
    take = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
    out = np.concatenate([base[:, None], base[:, None] + np.take_along_axis(move, take, 1)], axis=1)
    # one number for table, length and bucket
    salt = mix(np.array([table << 32 | x.shape[1]], U64))
    return mix(out.astype(U64) + salt).view(np.int64)


def sketch(x: np.ndarray) -> np.ndarray:
    """Eight-bit form of unit vectors: a scale (float32) and int8 components, as bytes."""
    scale = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300) / 127
    q = np.rint(x / scale).astype(np.int8)
    return np.concatenate([scale.astype(np.float32).view(np.uint8).reshape(len(x), 4), q.view(np.uint8)], axis=1)


def unsketch(blobs) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
    return raw[:, 4:].view(np.int8).astype(np.float32) * raw[:, :4].copy().view(np.float32)


def sketch_error(dim: int) -> float:
    """Bound on the error of a cosine from two sketches: each component is off by half a step of at
    most 1/127, so each vector by sqrt(dim) / 254 at most."""
    e = math.sqrt(dim) / 254
    return 2 * e + e * e + 1e-5


# ----------------------------------------------------------------- steps
def _matrix(col: pa.Array) -> np.ndarray:
    """Vectors of one length (bytes of doubles) as rows."""
    return np.frombuffer(b"".join(x.as_buffer() for x in col), np.float64).reshape(len(col), -1)


def _by_length(batch: pa.RecordBatch, column: int):
    """A batch's rows in groups of equal vector length."""
    sizes = np.array([len(x.as_buffer()) for x in batch.column(column)])
    for s in np.unique(sizes):
        yield batch.take(pa.array(np.flatnonzero(sizes == s)))


def _clean(batches):
    """``vec_id, x``: unit vectors as bytes of doubles, null for those that cannot link."""
    for batch in batches:
        ids, out = batch.column(0), []
        for v in batch.column(1):
            x = None
            if v.is_valid and len(v.values) and v.values.null_count == 0:
                a = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(a).all():
                    big = np.abs(a).max()
                    if big > 0:
                        a = a / big                      # no overflow or underflow in the norm
                        x = (a / math.sqrt(float(a @ a))).tobytes()
            out.append(x)
        yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], names=["vec_id", "x"])


def _bucket_rows(bits: int, probes: int):
    def run(batches):
        for batch in batches:
            for b in _by_length(batch, 1):
                x = _matrix(b.column(1))
                s = [r.tobytes() for r in sketch(x)]
                for t in range(TABLES):
                    c = codes(x, bits, t)[:, : 1 + probes]
                    n = c.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(c.ravel()),
                         pa.array(np.tile(np.arange(n) == 0, len(x))),
                         pa.array([v for v in s for _ in range(n)] if not probes else [None] * (n * len(x)), pa.binary())],
                        names=["rep", "bucket", "own", "sketch"])
    return run


_BUCKETS = "rep bigint, bucket bigint, own boolean, sketch binary"


def _close(least: float):
    """Pairs whose sketches allow a cosine of ``least``."""
    def run(batches):
        for batch in batches:
            for b in _by_length(batch, 2):
                x, y = unsketch(b.column(2).to_pylist()), unsketch(b.column(3).to_pylist())
                ok = pa.array(np.einsum("ij,ij->i", x, y) >= least - sketch_error(x.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])
    return run


def _angles(batches):
    """``a, b, angle`` for rows ``a, b, x, y``."""
    for batch in batches:
        for b in _by_length(batch, 2):
            cos = np.einsum("ij,ij->i", _matrix(b.column(2)), _matrix(b.column(3)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.arccos(np.clip(cos, -1, 1)))],
                                             names=["a", "b", "angle"])


def _with_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    x = vectors.select(F.col("rep").alias("a"), F.col("x"))
    y = vectors.select(F.col("rep").alias("b"), F.col("x").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")


def _shard_pairs(theta: float):
    """Pairs of cores that share one of the small buckets of a group and may hold a link."""
    def run(tbl):
        out = [np.empty((0, 2), np.int64)]
        sizes = np.array([len(x.as_buffer()) for x in tbl.column("sketch")])
        for size in np.unique(sizes):
            t = tbl.take(pa.array(np.flatnonzero(sizes == size))).sort_by("bucket")
            bucket, core, own, radius = (t.column(c).to_numpy() for c in ("bucket", "core", "own", "radius"))
            x = unsketch(t.column("sketch").to_pylist())
            err = sketch_error(x.shape[1])
            for step in range(1, SMALL_BUCKET):
                i = np.flatnonzero(bucket[:-step] == bucket[step:])
                if not len(i):
                    break
                j = i + step
                ok = (own[i] | own[j]) & (core[i] != core[j])
                i, j = i[ok], j[ok]
                reach = np.minimum(np.pi, theta + radius[i] + radius[j])
                near = np.einsum("ij,ij->i", x[i], x[j]) >= np.cos(reach) - err
                i, j = i[near], j[near]
                out.append(np.stack([np.minimum(core[i], core[j]), np.maximum(core[i], core[j])], axis=1))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
    return run


def _core_pairs(theta: float):
    """Pairs of cores of one piece of a bucket that may hold a link, judged by their leaders."""
    def run(key, tbl):
        left = tbl.filter(tbl.column("side").to_numpy() < 2)
        right = tbl.filter(tbl.column("side").to_numpy() > 0)
        out = [np.empty((0, 2), np.int64)]
        if len(left) and len(right):
            (p, po, pr), (q, qo, qr) = (tuple(t.column(c).to_numpy() for c in ("core", "own", "radius")) for t in (left, right))
            x, y = unsketch(left.column("sketch").to_pylist()), unsketch(right.column("sketch").to_pylist())
            err = sketch_error(x.shape[1])
            for i in range(0, len(p), 256):
                reach = np.minimum(np.pi, theta + pr[i: i + 256, None] + qr[None, :])
                ok = (x[i: i + 256] @ y.T >= np.cos(reach) - err) & (po[i: i + 256, None] | qo[None, :]) & (p[i: i + 256, None] != q[None, :])
                a, b = np.nonzero(ok)
                out.append(np.stack([np.minimum(p[i + a], q[b]), np.maximum(p[i + a], q[b])], axis=1))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
    return run


def _block(key, tbl):
    """The members of a block of a core as one row."""
    x = b"".join(v.as_buffer() for v in tbl.column("x"))
    return pa.table([tbl.column("core")[:1], tbl.column("blk")[:1], pa.array([tbl.column("rep").to_numpy().tobytes()], pa.binary()),
                     pa.array([tbl.column("n").to_numpy().tobytes()], pa.binary()), pa.array([x], pa.binary())],
                    names=["core", "blk", "ids", "counts", "x"])


def _compare(threshold: float):
    """Links between two blocks: per vector, how many rows of the other block it links with, and one
    edge for the pair of cores."""
    def run(batches):
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(("a", "b", "ids", "counts", "x", "ids2", "counts2", "x2"))}
            for r in range(batch.num_rows):
                ids, n, ids2, n2 = (np.frombuffer(c[k][r].as_buffer(), np.int64) for k in ("ids", "counts", "ids2", "counts2"))
                x = np.frombuffer(c["x"][r].as_buffer(), np.float64).reshape(len(ids), -1)
                y = np.frombuffer(c["x2"][r].as_buffer(), np.float64).reshape(len(ids2), -1)
                link = x @ y.T >= threshold
                if not link.any():
                    continue
                left, right = link @ n2, n @ link
                i, j = np.flatnonzero(left), np.flatnonzero(right)
                rep = np.concatenate([ids[i], ids2[j]])
                more = np.concatenate([left[i], right[j]])
                a, b = c["a"][r].as_py(), c["b"][r].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep), pa.array(more), pa.array([a] + [None] * (len(rep) - 1), pa.int64()),
                     pa.array([b] + [None] * (len(rep) - 1), pa.int64())], names=["rep", "links", "a", "b"])
    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id",
                           vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    c = F.col
    theta = math.acos(threshold)
    half = theta / 2 - math.radians(0.05)                # two members of a core are surely linked
    rows = written(vectors.select(c(id_col).cast("bigint").alias("vec_id"), c(vector_col).cast("array<double>"))
                   .mapInArrow(_clean, "vec_id bigint, x binary"), "vectors")
    keyed = rows.where("x is not null").select("vec_id", "x", F.sha2("x", 256).alias("key"))
    # rep numbers a class: its smallest id (classes can share one only if a vec_id repeats)
    classes = written(keyed.groupBy("key").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("x").alias("x"))
        .withColumn("rep", F.monotonically_increasing_id()), "classes")
    count = classes.count()
    bits = max(4, math.ceil(math.log2(max(1, count / ROWS_PER_BUCKET))))

    # cores: a class near the least class of one of its buckets
    own = written(classes.select("rep", "x").mapInArrow(_bucket_rows(bits, 0), _BUCKETS), "own-buckets")
    least = own.groupBy("bucket").agg(F.min(F.struct("rep", "sketch")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    star = own.join(least.select("bucket", c("m.rep").alias("centre"), c("m.sketch").alias("y")), "bucket").where("rep <> centre")
    maybe = star.select("rep", "centre", "sketch", "y").mapInArrow(_close(math.cos(half)), "a bigint, b bigint").distinct()
    near = written(_with_vectors(maybe, classes).mapInArrow(_angles, "a bigint, b bigint, angle double")
                   .where(c("angle") <= half), "near")
    follows = near.select(c("a").alias("b")).distinct()
    joins = (near.join(follows, "b", "left_anti").groupBy("a").agg(F.min(F.struct("b", "angle")).alias("m"))
             .select(c("a").alias("rep"), c("m.b").alias("core"), c("m.angle").alias("angle")))
    placed = written(classes.join(joins, "rep", "left").select(
        "rep", "first", "n", "x", "key", F.coalesce("core", "rep").alias("core"), F.coalesce("angle", F.lit(0.0)).alias("angle")), "placed")
    cores = written(placed.groupBy("core").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"), (F.max("angle") + SLACK).alias("radius"),
        F.min("first").alias("first")), "cores")

    # buckets of cores, each core once per bucket; large buckets are cut into pieces that meet pairwise
    found = (placed.select("rep", "x").mapInArrow(_bucket_rows(bits, PROBES), _BUCKETS).select("rep", "bucket", "own")
             .join(placed.select("rep", "core"), "rep").groupBy("bucket", "core").agg(F.max("own").alias("own")))
    found = written(found, "core-buckets")
    sizes = written(found.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "bucket-sizes")
    own_sketch = own.groupBy("rep").agg(F.first("sketch").alias("sketch")).withColumnRenamed("rep", "core")
    facts = cores.select("core", "radius").join(own_sketch, "core")
    full = found.join(sizes, "bucket").join(facts, "core")
    few = c("m") <= SMALL_BUCKET
    shards = 1 + (sizes.where(few).agg(F.sum("m")).first()[0] or 0) // SHARD_ROWS
    small = (full.where(few).select(F.pmod(F.xxhash64("bucket"), F.lit(shards)).alias("shard"), "bucket", "core", "own", "radius", "sketch")
             .groupBy("shard").applyInArrow(_shard_pairs(theta), "a bigint, b bigint"))
    blocks = F.ceil(c("m") / F.lit(BUCKET_BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("core"), blocks).cast("int")
    # piece (i, j), i <= j: block i on the left, block j on the right; both on a piece (i, i)
    large = full.where(~few).select("bucket", "core", "own", "radius", "sketch", mine.alias("i"),
                                    F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"))
    pieces = large.select("bucket", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "core", "own", "radius", "sketch",
                          F.when(c("i") == c("j"), 1).when(c("i") < c("j"), 0).otherwise(2).alias("side"))
    met_in = pieces.groupBy("bucket", "lo", "hi").applyInArrow(_core_pairs(theta), "a bigint, b bigint")
    pairs = written(small.union(met_in).distinct(), "core-pairs")

    # members of the cores on a pair, in blocks; block against block
    on_pair = pairs.select(F.explode(F.array("a", "b")).alias("core")).distinct()
    parts = placed.join(on_pair, "core", "left_semi").join(cores.select("core", "classes"), "core").select(
        "core", F.pmod(F.xxhash64("rep"), F.ceil(c("classes") / F.lit(MEMBERS))).cast("int").alias("blk"), "rep", "n", "x")
    packed = written(parts.groupBy("core", "blk").applyInArrow(
        _block, "core bigint, blk int, ids binary, counts binary, x binary"), "blocks")
    right = packed.select(c("core").alias("b"), c("ids").alias("ids2"), c("counts").alias("counts2"), c("x").alias("x2"))
    met = pairs.join(right, "b").join(packed.select(c("core").alias("a"), "ids", "counts", "x"), "a")
    links = written(met.select("a", "b", "ids", "counts", "x", "ids2", "counts2", "x2").mapInArrow(
        _compare(threshold), "rep bigint, links bigint, a bigint, b bigint"), "links")
    more = links.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = connected_components(links.where("a is not null").select("a", "b").distinct())
    firsts = cores.select("core", "first").join(comp.withColumnRenamed("id", "core"), "core", "left").select(
        "core", "first", F.coalesce("component_id", "core").alias("comp"))
    named = firsts.join(firsts.groupBy("comp").agg(F.min("first").alias("component_id")), "comp").select("core", "component_id")
    result = (placed.select("rep", "key", "core").join(more, "rep", "left").join(named, "core").join(cores.select("core", "total"), "core")
              .select("key", (c("total") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    out = rows.select("vec_id", F.sha2("x", 256).alias("key")).join(result, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(c("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.select("*", F.coalesce(c("vec_id") == c("component_id"), F.lit(True)).alias("kept"))
