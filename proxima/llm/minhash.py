"""Near-duplicate documents: circulant MinHash, banding, exact confirmation on full shingle sets.

Method.  A text is the set of its distinct word shingles (64-bit hashes).  One permutation
``sigma`` places every shingle among D = 2^20 positions, a second one ``pi`` orders positions;
coordinate k of the signature is the least ``pi`` value after turning ``pi`` by k places.  All K
coordinates of a shingle are therefore K neighbouring entries of one array.  Forty bands of five
coordinates propose candidates: a pair of similarity 0.8 shares no band with probability
(1 - 0.8^5)^40, about 1.3e-7.

Work is kept linear in hot groups:

* documents with equal sets form one class (128-bit set hash) and only the smallest id goes on;
* round 1 compares each class with one centre, the best connected member of the buckets it is in,
  and confirms that single link; components of these links are computed;
* round 2 takes, inside each bucket, pairs of *different* trees only and drops those that cannot
  reach the threshold: by their sizes, by 128 one-bit coordinates, or because two sets with the same
  centre share no more than the smaller of what each has in common with it, plus what they share
  besides (bounded by a bitmap of the shingles the centre lacks).  The rest is confirmed.

Every confirmed link has ``100 * |A & B| >= 100 * threshold * |A | B|`` on the full sets.

Rules.  Null and empty texts have no shingles and link with nothing.  Texts shorter than a shingle
are one shingle.  Rows that repeat a doc_id belong to one component, and each gets a row.  A null
doc_id gets ``component_id`` null and is kept.  Extra columns are ignored here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proxima.llm.common import (U64, binary_array, grams, joined_if_small, mix, process_cache, text_blocks, words,
                                written, written_and_seen)
from proxima.llm.components import connected_components

POSITIONS = 1 << 20
BANDS, ROWS = 40, 5
SKETCH_BITS = 128
#: One-bit coordinates that may differ: at similarity s a bit differs with probability (1-s)/2,
#: so 128 bits at s = 0.8 differ in 12.8 on average (deviation 3.4); 40 lies eight deviations off.
SKETCH_SLACK_SIGMAS = 8.0
EXTRA_BITS = 1024

_SIG_SCHEMA = ("doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, s1 bigint, s2 bigint, bands array<bigint>")


def _permutations():
    def build():
        rng = np.random.default_rng(7)
        sigma = rng.permutation(POSITIONS).astype(np.uint32)
        pi = rng.permutation(POSITIONS).astype(np.uint32)
        turned = np.concatenate([pi, pi[: BANDS * ROWS]])
        return sigma, np.lib.stride_tricks.sliding_window_view(turned, BANDS * ROWS)
    return process_cache("circulant", build, "minhash")


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates of one non-empty set, in slices of bounded memory."""
    sigma, turns = _permutations()
    at = sigma[(shingles & U64(POSITIONS - 1)).astype(np.int64)]
    sig = turns[at[:2048]].min(axis=0)
    for i in range(2048, len(at), 2048):
        np.minimum(sig, turns[at[i: i + 2048]].min(axis=0), out=sig)
    return sig


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """The sorted distinct shingle hashes of every text of a block."""
    h, doc, _, _ = words(data, offsets, lower=True)
    n = len(offsets) - 1
    edge = np.searchsorted(doc, np.arange(n + 1))
    g = grams(h, size)
    for i in range(n):
        a, b = int(edge[i]), int(edge[i + 1])
        if b - a >= size:
            yield np.unique(g[a: b - size + 1])
        elif b > a:                                  # fewer words: the whole sequence as one
            yield mix(grams(h[a:b], b - a) + U64(b - a))
        else:
            yield np.empty(0, U64)


def _signatures(size: int):
    def run(batches):
        mult = np.random.default_rng(11).integers(1, 2**63, (BANDS, ROWS), dtype=U64) | U64(1)
        salt = mix(np.arange(1, BANDS + 1, dtype=U64))
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, off in text_blocks(batch.column(1)):
                n, num, bands = b - a, np.zeros((b - a, 5), np.int64), []
                for i, s in enumerate(shingle_sets(data, off, size)):
                    num[i, 0] = len(s)
                    if not len(s):
                        bands.append(None)
                        continue
                    sig = signature(s)
                    m = mix(s)
                    num[i, 1], num[i, 2] = np.array([m.sum(), np.bitwise_xor.reduce(mix(m))], U64).view(np.int64)
                    num[i, 3:5] = np.packbits((sig[:SKETCH_BITS] & 1).astype(np.uint8)).view(np.int64)
                    bands.append(mix((sig.reshape(BANDS, ROWS).astype(U64) * mult).sum(axis=1) ^ salt).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, n).cast(pa.int64()), *(pa.array(num[:, k]) for k in range(5)),
                     pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "h1", "h2", "s1", "s2", "bands"])
    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for a, b, data, off in text_blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()),
                     binary_array([s.tobytes() for s in shingle_sets(data, off, size)])], names=["id", "shingles"])
    return run


def _common(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.intersect1d(p, q, assume_unique=True)


def _linked(same, n, m, percent: int):
    """100 * |A & B| >= percent * |A | B|, from the sizes; for numbers or columns."""
    return same * (100 + percent) >= percent * (n + m)


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            keep = []
            for p, q in zip(x, y):
                p, q = np.frombuffer(p.as_buffer(), U64), np.frombuffer(q.as_buffer(), U64)
                keep.append(_linked(len(_common(p, q)), len(p), len(q), percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])
    return run


_FACTS = "a bigint, b bigint, linked boolean, common bigint, spare bigint, extra array<bigint>"


def _against_centre(percent: int):
    """What a set (b) has in common with its centre (a), and a bitmap of what it has besides; ``spare``
    is how many of those the bitmap hides by putting two in one place."""
    def run(batches):
        for batch in batches:
            cols = [batch.column(0), batch.column(1), [], [], [], []]
            for p, q in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(p.as_buffer(), U64), np.frombuffer(q.as_buffer(), U64)
                same = len(_common(p, q))
                own = np.setdiff1d(q, p, assume_unique=True)
                bits = np.zeros(EXTRA_BITS, np.uint8)
                bits[(mix(own) % U64(EXTRA_BITS)).astype(np.int64)] = 1
                cols[2].append(_linked(same, len(p), len(q), percent))
                cols[3].append(same)
                cols[4].append(len(own) - int(bits.sum()))
                cols[5].append(np.packbits(bits).view(np.int64))
            types = [None, None, pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([c if t is None else pa.array(c, t) for c, t in zip(cols, types)],
                                             names=[x.split()[0] for x in _FACTS.split(", ")])
    return run


def _with_sets(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``a, b`` and their full shingle sets.  Sets are made only for documents on a pair and travel
    once per pair."""
    pairs = written(pairs, "pairs")
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids")
    sets = written(joined_if_small(docs, ids, "doc_id", "left_semi").mapInArrow(_sets(size), "id bigint, shingles binary"), "sets")
    both = pairs.join(sets, F.col("b") == F.col("id")).select("a", "b", F.col("shingles").alias("y"))
    return both.join(sets, F.col("a") == F.col("id")).select("a", "b", F.col("shingles").alias("x"), "y")


def _followed(parents: DataFrame, rounds: int = 3) -> DataFrame:
    """``rep, parent`` with every parent replaced by its own, again and again: chains of up to
    2 ** rounds links end at their last member (longer ones further up than they began)."""
    out, seen = written_and_seen(parents, "parents", "rep", "parent")
    for _ in range(rounds):
        up = out.select(F.col("rep").alias("parent"), F.col("parent").alias("above"))
        before = seen
        out, seen = written_and_seen(joined_if_small(out, up, "parent", "left", seen[0]).select(
            "rep", F.coalesce("above", "parent").alias("parent")), "parents", "rep", "parent")
        if seen == before:
            break
    return out


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = written(docs.mapInArrow(_signatures(shingle_words), _SIG_SCHEMA), "signatures")
    known = sig.where("doc_id is not null and n_shingles > 0")
    classes = written(known.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("rep"),
        F.min_by(F.struct("n_shingles", "s1", "s2", "bands"), "doc_id").alias("x")
    ).select("h1", "h2", "rep", "x.*"), "classes")

    # bucket members, only of buckets with company; the centre of a bucket is its member that meets
    # the most others over all its buckets, the smallest id among equals
    rows = classes.select("rep", F.explode("bands").alias("key"))
    crowd = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = F.sum("n").over(Window.partitionBy("rep"))            # at most one row per band
    members = written(rows.join(crowd, "key").select("key", "rep", met.alias("met")), "members")
    centres = members.groupBy("key").agg(F.max(F.struct("met", (-F.col("rep")).alias("c"))).alias("m")).select(
        "key", (-F.col("m.c")).alias("centre"))

    # round 1: each class against one centre, the one it shares most buckets with
    best = (members.join(centres, "key").where("rep <> centre").groupBy("rep")
            .agg(F.mode("centre", True).alias("a")).select("a", F.col("rep").alias("b")))
    facts = written(_with_sets(best, docs, shingle_words).mapInArrow(_against_centre(percent), _FACTS).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.max("linked").alias("linked"), F.first("common").alias("common"),
        F.first("spare").alias("spare"), F.first("extra").alias("extra")), "facts")
    # a centre comes before its members in the order of (meetings, id), so the links are trees
    links = facts.where("linked").select("a", "b")
    trees = _followed(links.select(F.col("b").alias("rep"), F.col("a").alias("parent")))

    # round 2: pairs of different trees inside a bucket
    c = F.col
    placed = (joined_if_small(members.select("key", "rep"), trees, "rep", "left")
              .select("key", "rep", F.coalesce("parent", "rep").alias("comp")))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    # a repeated id has more than one set: no bound is used for it
    told = facts.where("n = 1").select(c("b").alias("rep"), c("a").alias("centre"), "common", "spare",
                        *(c("extra")[i].alias(f"e{i}") for i in range(EXTRA_BITS // 64)))
    known = classes.select("rep", "n_shingles", "s1", "s2").join(told, "rep", "left")
    m = written(placed.join(mixed, "key").join(known, "rep"), "mixed-members")
    share = percent / 100
    bits = SKETCH_BITS * (1 - share) / 2
    slack = int(bits + SKETCH_SLACK_SIGMAS * (bits * (1 + share) / 2) ** 0.5)
    x, y = m.alias("x"), m.alias("y")

    def both(name, f):
        return f(c(f"x.{name}"), c(f"y.{name}"))

    def shared_bits(names):
        return sum((F.bit_count(c(f"x.{n}").bitwiseAND(c(f"y.{n}"))) for n in names), F.lit(0))
    n, k = c("x.n_shingles"), c("y.n_shingles")
    differ = both("s1", lambda a, b: F.bit_count(a.bitwiseXOR(b))) + both("s2", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    # the intersection is at most what both share with their common centre and what the bitmaps allow
    most = both("common", F.least) + shared_bits([f"e{i}" for i in range(EXTRA_BITS // 64)]) + both("spare", F.least)
    one_centre = F.coalesce(c("x.centre") == c("y.centre"), F.lit(False))
    tested = F.coalesce(c("x.centre") == c("y.rep"), F.lit(False)) | F.coalesce(c("y.centre") == c("x.rep"), F.lit(False))
    pairs = (x.join(y, (c("x.key") == c("y.key")) & (c("x.comp") < c("y.comp"))
                    & (100 * F.least(n, k) >= percent * F.greatest(n, k)) & (differ <= slack)
                    & ~tested & (~one_centre | _linked(most, n, k, percent)))
             .select(c("x.rep").alias("a"), c("y.rep").alias("b")).distinct())
    more = _with_sets(pairs, docs, shingle_words).mapInArrow(_confirm(percent), "a bigint, b bigint")
    # the trees stand for the links of round 1: their roots are joined by what is left of both
    name = trees.select(c("rep").alias("id"), c("parent").alias("root"))
    edges = links.union(more)
    for end in ("a", "b"):
        edges = joined_if_small(edges, name.withColumnRenamed("id", end), end, "left").withColumn(
            end, F.coalesce("root", end)).drop("root")
    over = written(connected_components(edges).select(c("id").alias("root"), "component_id"), "components")
    # a root is not the least of its tree: the least doc_id of all that hang together
    whole = classes.select("h1", "h2", "rep").join(name.withColumnRenamed("id", "rep"), "rep", "left").select(
        "h1", "h2", "rep", F.coalesce("root", "rep").alias("root"))
    whole = joined_if_small(whole, over, "root", "left").select("h1", "h2", "rep", F.coalesce("component_id", "root").alias("comp"))
    # the rows of a repeated doc_id belong together, whatever their texts
    repeated = written(sig.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    n_repeated = repeated.count()
    if n_repeated:
        again = joined_if_small(sig.where("n_shingles > 0").select("doc_id", "h1", "h2"), repeated, "doc_id", "left_semi", n_repeated)
        again = written(again.join(whole, ["h1", "h2"]).select("doc_id", "comp").distinct(), "repeated-classes")
        first = again.groupBy("doc_id").agg(F.min("comp").alias("a"))
        joined = written(connected_components(again.join(first, "doc_id").select("a", c("comp").alias("b"))).select(
            c("id").alias("comp"), c("component_id").alias("one")), "joined-components")
        whole = joined_if_small(whole, joined, "comp", "left").select("h1", "h2", "rep", F.coalesce("one", "comp").alias("comp"))
        again = joined_if_small(again, joined, "comp", "left").select("doc_id", F.coalesce("one", "comp").alias("comp")).distinct()
    # most components are named by their least doc_id already
    least = written(whole.groupBy("comp").agg(F.min("rep").alias("least")).where("least <> comp"), "least")

    def named(rows):
        return joined_if_small(rows, least, "comp", "left").withColumn("component_id", F.coalesce("least", "comp"))
    by_class = named(whole).select("h1", "h2", "component_id")
    out = sig.select("doc_id", "n_shingles", "h1", "h2").join(
        by_class, (sig["h1"] == by_class["h1"]) & (sig["h2"] == by_class["h2"]) & (sig["n_shingles"] > 0), "left")
    if n_repeated:                                      # a row without shingles follows the others of its doc_id
        by_id = written(named(again).select("doc_id", c("component_id").alias("of_id")), "repeated-components")
        out = joined_if_small(out, by_id, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "of_id"))
    out = out.select("doc_id", "n_shingles", F.when(c("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(c("doc_id") == c("component_id"), F.lit(True)).alias("kept"))
