"""The public kNN API: neighbours and class predictions for a test frame against a train frame.

One function replaces the three argument orders of the original programs; the plan shape is a
parameter.  Every shape returns the same rows, because every one orders neighbours by
``(distance, train_id)``.

Shape choice (``strategy='auto'``) counts both sides first, ids only -- one job, which also
checks that ids are unique and not NULL; the counts bound the bytes a broadcast would ship, so
nothing is broadcast without a checked size:

1. train fits under ``broadcast_limit`` -> train broadcast, test read in place (map-only);
2. else test fits, and its partial output (k rows per test row from every train task) stays
   below the train side               -> test broadcast, train read in place, one merge window;
3. else                                 -> pivot-partitioned join with triangle-inequality
   pruning (``operators/pivot.py``); ``strategy='block'`` is the block nested-loop join, which the
   pivot join hands over to when a sample shows that nothing would be pruned.

No shape forms pairs as rows: a task computes a block of distances with NumPy and emits at most k
winners per test row.  ``kernel='numpy'`` also votes in the task where it can; ``kernel='sql'``
always leaves the last cut to the window of ``top_k`` and the vote to SQL.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxima.operators import candidates as C
from proxima.operators.annuli import pair_stats_annuli
from proxima.operators import vectorized as V
from proxima.operators.entries import GROUP_LIMIT, entries, entry_counts
from proxima.operators.pivot import neighbours_pivot
from proxima.operators.topk import check_k, top_k
from proxima.operators.vote import check_vote, vote as vote_op

STRATEGIES = ("auto", "broadcast_train", "broadcast_test", "pivot", "block")
KERNELS = ("numpy", "sql")

DEFAULT_BROADCAST_LIMIT = 128 << 20  # bytes of feature data a broadcast side may hold
DEFAULT_BLOCK_BYTES = 64 << 20       # bytes of feature data per block of the block join
ROW_OVERHEAD = 32                    # id, label and array header per row, in bytes
MEMBER_BYTES = 24                    # id, label and place of a row that shares its vector with others
REPEAT_DIM = 16                      # up to this width the count job also estimates the distinct vectors
REPEAT_SHARE = 0.5                   # of the train rows: with fewer distinct vectors the search runs over entries


@dataclass(frozen=True)
class Plan:
    """The shape chosen for one kNN query, with the numbers it was chosen from."""
    strategy: str
    kernel: str
    dim: int
    train_rows: int
    test_rows: int
    partitions: int
    test_blocks: int = 1
    train_blocks: int = 1
    spread_test: bool = False
    spread_train: bool = False
    block_bytes: int = DEFAULT_BLOCK_BYTES
    cores: int = 1
    member_bytes: int = 0     # of the rows that entries of equal vectors hold
    test_slices: int = 1      # broadcasts of the test side, each within the limit

    @property
    def test_spread(self) -> int | None:
        """Partition count to spread the test side over, or None to read it in place."""
        return self.partitions if self.spread_test else None

    @property
    def train_spread(self) -> int | None:
        return self.partitions if self.spread_train else None

    @property
    def block_bytes_moved(self) -> int:
        """Bytes the block join ships: each side once per block of the other."""
        return self.test_bytes * self.train_blocks + self.train_bytes * self.test_blocks

    @property
    def block_partitions(self) -> int:
        """Tasks of the block join: enough that a task reads about two blocks, several groups each,
        so that hashing the groups to tasks comes out even."""
        want = max(self.partitions, math.ceil(self.block_bytes_moved / (2 * self.block_bytes)))
        return max(1, min(self.test_blocks * self.train_blocks, want))

    @property
    def train_bytes(self) -> int:
        return side_bytes(self.train_rows, self.dim) + self.member_bytes

    @property
    def test_bytes(self) -> int:
        return side_bytes(self.test_rows, self.dim)


def side_bytes(rows: int, dim: int) -> int:
    return rows * (8 * dim + ROW_OVERHEAD)


def _conf_int(spark, key: str, default: int) -> int:
    v = spark.conf.get(key, None)
    return int(v) if v else default


def _bytes_conf(spark, key: str, default: int) -> int:
    """A size conf such as ``134217728``, ``128m`` or ``128MB``, in bytes."""
    try:
        raw = spark.conf.get(key)  # the effective value, Spark's own default included
    except Exception:  # an unregistered key that was never set
        raw = None
    v = (raw or "").strip().lower().rstrip("b")
    if not v:
        return default
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    if v[-1] in scale:
        return int(float(v[:-1]) * scale[v[-1]])
    return int(v)


def infer_dim(df: DataFrame, features: str) -> int:
    """Width of the first vector (one row is read); every row is then checked against it."""
    row = df.select(F.size(F.col(features)).alias("n")).where(F.col("n") >= 0).first()
    if row is None:
        raise ValueError(f"cannot infer the vector width: no non-null '{features}'")
    return int(row["n"])


def partial_rows(n_test: int, train_bytes: int, block: int, k: int) -> int:
    """Rows a test broadcast ships to its merge: k per test row from each train task."""
    return max(1, math.ceil(train_bytes / block)) * n_test * k


@dataclass(frozen=True)
class Sides:
    """Rows of both sides, and roughly how many distinct vectors the train side has (None: not asked)."""
    train: int
    test: int
    vectors: int | None = None
    member_bytes: int = 0


def count_sides(train: DataFrame, test: DataFrame, unique_ids: bool = False, vectors: bool = False) -> Sides:
    """Both sides counted in one job that reads only the ids (and with ``vectors`` the train vectors).

    An id that is NULL or repeated on its side raises, whatever shape follows: ids break distance
    ties and key the vote, so the shapes would disagree about repeated ones.  With ``unique_ids`` the caller
    vouches for them (ordinals of ``read_vectors``), and no id is shuffled.
    """
    def ids(df, side, col, feat):
        h = F.xxhash64(feat) if feat else F.lit(0).cast("bigint")
        rows = df.select(F.col(col).alias("id"), h.alias("h"), F.lit(1).cast("bigint").alias("c"))
        if not unique_ids:
            rows = rows.groupBy("id").agg(F.sum("c").alias("c"), F.min("h").alias("h"))
        distinct = F.approx_count_distinct("h", 0.02) if feat else F.lit(0).cast("bigint")
        return rows.agg(F.lit(side).alias("side"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
                        F.count("id").alias("d"), distinct.alias("v"))
    both = ids(train, "train", C.TRAIN_ID, C.TRAIN_F if vectors else None).unionByName(ids(test, "test", C.TEST_ID, None))
    rows = {r["side"]: r for r in both.collect()}
    for side, r in rows.items():
        if r["n"] != r["d"]:
            raise ValueError(f"{r['n'] - r['d']} {side} rows repeat a row id; row ids must be unique")
    return Sides(int(rows["train"]["n"]), int(rows["test"]["n"]), int(rows["train"]["v"]) if vectors else None)


def planned(train: DataFrame, test: DataFrame, dim: int, k: int, strategy: str = "auto", kernel: str = "numpy",
            broadcast_limit: int | None = None, block_bytes: int | None = None,
            collapse: bool | None = None, unique_ids: bool = False) -> tuple[DataFrame, Plan]:
    """The train side to search, and the plan.

    ``collapse`` turns train rows of equal vectors into entries first (``operators/entries.py``); None does so where
    the vectors are narrow and the estimate says that at least half of the rows repeat one.
    """
    ask = collapse is None and dim <= REPEAT_DIM and k <= GROUP_LIMIT
    sides = count_sides(train, test, unique_ids, ask)
    if collapse or (ask and sides.vectors <= REPEAT_SHARE * sides.train and sides.train):
        train = entries(train, k)
        n, rows = entry_counts(train)
        sides = Sides(n, sides.test, n, rows * MEMBER_BYTES)
    return train, choose_plan(train, test, dim, strategy, kernel, broadcast_limit, block_bytes, k, sides)


def choose_plan(train: DataFrame, test: DataFrame, dim: int, strategy: str = "auto",
                kernel: str = "numpy", broadcast_limit: int | None = None,
                block_bytes: int | None = None, k: int | None = None, sides: Sides | None = None) -> Plan:
    """Count both sides (prepared frames) and pick the plan shape and its partitioning.

    With ``k``, a test broadcast is only chosen while its partial output -- up to k rows per
    test row from every train task -- stays below the train side itself; past that (a large
    test side against low-dimensional rows) the pruned pivot join moves less.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, got {strategy!r}")
    if kernel not in KERNELS:
        raise ValueError(f"kernel must be one of {KERNELS}, got {kernel!r}")
    spark = train.sparkSession
    limit = (_conf_int(spark, "proxima.broadcastLimitBytes", DEFAULT_BROADCAST_LIMIT)
             if broadcast_limit is None else broadcast_limit)        # 0 turns broadcasts off
    block = _conf_int(spark, "proxima.blockBytes", DEFAULT_BLOCK_BYTES) if block_bytes is None else block_bytes
    if limit < 0 or block < 1:
        raise ValueError(f"broadcast_limit must be at least 0 and block_bytes at least 1, got {limit} and {block}")
    sides = sides or count_sides(train, test)
    n_train, n_test = sides.train, sides.test
    b_train, b_test = side_bytes(n_train, dim) + sides.member_bytes, side_bytes(n_test, dim)
    parallelism = spark.sparkContext.defaultParallelism
    if strategy == "auto":
        if limit and b_train <= limit:
            strategy = "broadcast_train"
        elif limit and b_test <= limit and (k is None or partial_rows(n_test, b_train, block, k) <= n_train):
            strategy = "broadcast_test"
        else:
            strategy = "pivot"
    if strategy == "broadcast_train" and b_train > limit:
        raise ValueError(f"train side is about {b_train} bytes, over the broadcast limit {limit}")
    if strategy == "broadcast_test" and not limit and b_test:
        raise ValueError(f"test side is about {b_test} bytes, and broadcasts are off")
    # one task per block of test data, at least two per core
    partitions = max(2 * parallelism, math.ceil(b_test / block))
    # kNN is CPU-bound: a side read in place should bring at least two input splits per core.
    # One whose estimated split count (bytes / maxPartitionBytes) falls short is spread over
    # ``partitions`` tasks -- each of its rows costs a pass over the other side, which dwarfs
    # moving the row; a side with enough splits is read where it lies
    split = _bytes_conf(spark, "spark.sql.files.maxPartitionBytes", 128 << 20)
    spread_test = math.ceil(b_test / split) < 2 * parallelism
    spread_train = math.ceil(b_train / split) < 2 * parallelism
    plan = Plan(strategy, kernel, dim, n_train, n_test, partitions, 1, 1,
                spread_test, spread_train, block, parallelism, sides.member_bytes,
                max(1, math.ceil(b_test / limit)) if strategy == "broadcast_test" else 1)
    return block_grid(plan) if strategy == "block" else plan


def block_grid(plan: Plan) -> Plan:
    """The plan with the grid of the block join: blocks of at most ``block_bytes`` of features, then
    split further, each time where it adds fewer bytes to move, until there are four groups for
    each task that the cores call for."""
    tb = max(1, math.ceil(plan.test_bytes / plan.block_bytes))
    rb = max(1, math.ceil(plan.train_bytes / plan.block_bytes))
    parallel = 4 * plan.cores
    while tb * rb < parallel and (tb < plan.test_rows or rb < plan.train_rows):
        cheap_test = tb * plan.train_bytes <= rb * plan.test_bytes
        if rb >= plan.train_rows or (cheap_test and tb < plan.test_rows):
            tb *= 2
        else:
            rb *= 2
    return replace(plan, test_blocks=tb, train_blocks=rb)


def _prepare(train, test, features, label, train_id, test_id, test_features, dim):
    if dim is None:
        dim = infer_dim(train, features)
    tr = C.prepare_train(train, features, label, train_id, dim)
    te = C.prepare_test(test, test_features or features, test_id, dim)
    return tr, te, dim


def neighbours_for(tr: DataFrame, te: DataFrame, k: int, plan: Plan,
                   max_distance: float | None = None) -> DataFrame:
    """Neighbours (``test_id, rank, train_id, distance, label``) of prepared frames under a plan."""
    dim = plan.dim
    if plan.strategy == "broadcast_train":
        out = V.neighbours_broadcast_train(te, tr, k, dim, max_distance, partitions=plan.test_spread, n_test=plan.test_rows)
    elif plan.strategy == "broadcast_test":
        return V.neighbours_broadcast_test(te, tr, k, dim, max_distance, plan.train_spread, plan.test_slices, plan.train_rows)
    else:
        blocks = block_grid(plan)

        def by_blocks():
            return V.neighbours_blocks(te, tr, k, dim, blocks.test_blocks, blocks.train_blocks,
                                       max_distance, blocks.block_partitions)
        if plan.strategy == "pivot":
            return neighbours_pivot(te, tr, k, dim, plan.train_rows, plan.test_rows, plan.block_bytes,
                                    plan.partitions, max_distance, fallback=by_blocks)
        out = by_blocks()
    # the window is planned for the sql kernel also where one task already holds all winners of a row
    return top_k(out.drop("rank"), k) if plan.kernel == "sql" else out


def pair_stats_for(tr: DataFrame, te: DataFrame, plan: Plan, max_distance: float | None = None) -> DataFrame:
    """Statistics of every test row's distances: train broadcast if it fits, else test if it fits (the plan says
    so only while the tasks' partial rows stay below the train side), else by rings around pivots, or block by
    block where a sample says that the rings leave most pairs over."""
    if plan.strategy == "broadcast_train":
        return V.pair_stats_broadcast_train(te, tr, plan.dim, max_distance, plan.test_spread)
    if plan.strategy == "broadcast_test":
        return V.pair_stats_broadcast_test(te, tr, plan.dim, max_distance, plan.train_spread)
    if plan.strategy == "pivot":
        return pair_stats_annuli(te, tr, plan.dim, plan.train_rows, plan.block_bytes, plan.partitions, max_distance, fallback=True)
    grid = block_grid(plan)
    return V.pair_stats(te, tr, plan.dim, grid.test_blocks, grid.train_blocks, max_distance, grid.block_partitions)


def knn_neighbors(train: DataFrame, test: DataFrame, k: int, *, features: str = "features",
                  label: str = "label", train_id: str = "row_id", test_id: str = "row_id",
                  test_features: str | None = None, dim: int | None = None,
                  strategy: str = "auto", kernel: str = "numpy",
                  max_distance: float | None = None, broadcast_limit: int | None = None,
                  block_bytes: int | None = None, collapse: bool | None = None,
                  unique_ids: bool = False) -> DataFrame:
    """The k nearest train rows of every test row, nearest first, ties to the lower train id.

    Returns ``test_id, rank, train_id, distance, label``; a test row without an admissible
    neighbour (all distances NaN or over ``max_distance``) has no rows here.
    """
    check_k(k)
    tr, te, dim = _prepare(train, test, features, label, train_id, test_id, test_features, dim)
    tr, plan = planned(tr, te, dim, k, strategy, kernel, broadcast_limit, block_bytes, collapse, unique_ids)
    return neighbours_for(tr, te, k, plan, max_distance)


def knn_classify(train: DataFrame, test: DataFrame, k: int, *, features: str = "features",
                 label: str = "label", train_id: str = "row_id", test_id: str = "row_id",
                 test_features: str | None = None, dim: int | None = None,
                 strategy: str = "auto", kernel: str = "numpy",
                 vote: str = "nonzero_majority", max_distance: float | None = None,
                 broadcast_limit: int | None = None, block_bytes: int | None = None,
                 collapse: bool | None = None, unique_ids: bool = False) -> DataFrame:
    """``test_id, prediction`` for every test row (NULL when it has no admissible neighbour).

    ``vote='nonzero_majority'`` predicts 1 when non-zero labels are at least half (ties -> 1);
    ``vote='label_sum'`` predicts 1 when twice the label sum exceeds the neighbour count
    (ties -> 0).
    """
    check_k(k)
    check_vote(vote)
    tr, te, dim = _prepare(train, test, features, label, train_id, test_id, test_features, dim)
    tr, plan = planned(tr, te, dim, k, strategy, kernel, broadcast_limit, block_bytes, collapse, unique_ids)
    return classify_for(tr, te, k, plan, vote, max_distance)


def classify_for(tr: DataFrame, te: DataFrame, k: int, plan: Plan, vote: str,
                 max_distance: float | None = None) -> DataFrame:
    if plan.kernel == "numpy" and plan.strategy == "broadcast_train":
        # map-only: the task that finds a row's neighbours also votes
        return V.neighbours_broadcast_train(te, tr, k, plan.dim, max_distance, vote=vote,
                                            partitions=plan.test_spread, n_test=plan.test_rows)
    neigh = neighbours_for(tr, te, k, plan, max_distance)
    return vote_op(neigh, vote, te.select("test_id"))
