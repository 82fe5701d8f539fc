"""SimHash near-duplicates by the generalised pigeonhole principle.

If two 64-bit fingerprints differ in at most R bits, the bits are cut into m
parts and part i gets a threshold t_i with sum(t_i) = R - m + 1, then in some
part i the two differ in at most t_i bits.  Correlated bits go to the same
part; the thresholds (and m) come from a dynamic program over the estimated
number of probes and candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, materialize, releasing, small_batches

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: A bucket with more fingerprints than this is split into chunks, and each pair of chunks is a group of its own.
CHUNK = 2048


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles, as an unsigned integer; 0 without a word."""
    words = text.lower().split()  # on bytes: A-Z only, and white space is 9 to 13 and 32
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ones, total = np.zeros(BITS, dtype=np.int64), len(words) - size + 1
    for at in range(0, total, 1 << 16):
        part = words[at : at + (1 << 16) + size - 1]
        grams = map(b" ".join, zip(*(part[k : len(part) - size + 1 + k] for k in range(size)), strict=True))
        h = np.array(list(map(xxhash.xxh64_intdigest, grams, repeat(SEED))), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).cast(pa.large_binary()) if b.num_rows else []
        fps = np.fromiter((fingerprint(x.as_py() or b"") for x in texts), dtype="<u8", count=b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view("<i8"))], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the fingerprint's 64 bits as a signed long) per row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(
        releasing(_fingerprint_batches), "id long, fp long"
    )


# --- the plan: parts and thresholds -----------------------------------------------------------


def _bit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS), dtype=np.int64)
    for b in batches:
        x = b.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        for at in range(0, len(x), 1 << 16):
            bits = np.unpackbits(np.ascontiguousarray(x[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], names=["k", "n"])


def bit_counts(nodes: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j both set: always BITS * BITS numbers."""
    rows = nodes.select("fp").mapInArrow(_bit_batches, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS)
    for r in rows:
        out[r["k"]] = r["n"]
    return out.reshape(BITS, BITS)


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The bits in m parts of nearly equal size, each grown by the bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    var = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(var, var)
    np.fill_diagonal(corr, 0)
    left, parts = set(range(BITS)), []
    for k in range(m):
        want = len(left) // (m - k)
        part = [max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))]
        left.discard(part[0])
        while len(part) < want:
            best = max(left, key=lambda b: (corr[b, part].mean(), -b))
            part.append(best)
            left.discard(best)
        parts.append(sorted(part))
    return parts


#: Fingerprints, those with the least hash, whose pairs are counted for the estimate.
SAMPLE = 2048


def estimated_cost(part: list[int], t: int, p: np.ndarray, n: int, sample: np.ndarray | None = None) -> float:
    """Probes and candidate pairs of one part at threshold t.

    The share of candidates is counted over the sample's pairs, as the bits of a
    part belong together; without a sample they are taken as independent.
    """
    if t < 0:
        return 0.0
    probes = sum(comb(len(part), k) for k in range(t + 1))
    if sample is not None and len(sample) > 1:
        x = sample & np.uint64(sum(1 << b for b in part))
        near = sum(int((np.bitwise_count(x[k + 1 :] ^ x[k]) <= t).sum()) for k in range(len(x) - 1))
        return 40.0 * n * probes + n * (n - 1) * (near + 1) / (len(x) * (len(x) - 1) + 2)
    at_most = np.zeros(t + 1)
    at_most[0] = 1.0
    for b in part:
        q = 2 * p[b] * (1 - p[b])
        at_most[1:] = at_most[1:] * (1 - q) + at_most[:-1] * q
        at_most[0] *= 1 - q
    return 40.0 * n * probes + n * (n - 1) / 2 * at_most.sum()


def allocate(parts: list[list[int]], p: np.ndarray, n: int, radius: int = RADIUS, sample: np.ndarray | None = None) -> tuple[float, list[int]]:
    """The thresholds >= -1 with sum radius - m + 1 at the least estimated cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in parts:
        cost = {t: estimated_cost(part, t, p, n, sample) for t in range(-1, radius + 1)}
        now: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t in range(-1, radius + 1):
                x = (c + cost[t], [*ts, t])
                if s + t not in now or x[0] < now[s + t][0]:
                    now[s + t] = x
        best = now
    return best[radius - len(parts) + 1]


def plan_parts(both: np.ndarray, n: int, radius: int = RADIUS, sample: np.ndarray | None = None) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the cheapest partitioning into 2 to radius + 2 parts, parts at -1 left out."""
    p = np.diag(both) / max(n, 1)
    found = []
    for m in range(2, radius + 3):
        parts = group_bits(both, n, m)
        cost, ts = allocate(parts, p, n, radius, sample)
        found.append((cost, m, [(a, t) for a, t in zip(parts, ts, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[:2])[2]


# --- probe and verify -------------------------------------------------------------------------


def _probe_batches(parts: list[tuple[list[int], int]]):
    def values(x: np.ndarray, bits: list[int]) -> np.ndarray:
        out = np.zeros(len(x), dtype="<u8")
        for k, b in enumerate(bits):
            out |= ((x >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(1).to_numpy(zero_copy_only=False).astype("<i8").view("<u8")
            for i, (bits, t) in enumerate(parts):
                v = values(fps, bits)

                def rows(value, pick, index, i=i, b=b):
                    n = len(value)
                    return pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, i, dtype=np.int32)), pa.array(value.view("<i8")), b.column(0).take(pa.array(pick)), b.column(1).take(pa.array(pick)), pa.array(np.full(n, index))],
                        names=["part", "value", "id", "fp", "is_index"],
                    )

                everyone = np.arange(len(v))
                yield rows(v, everyone, True)
                for k in range(1, t + 1):
                    for flips in combinations(range(len(bits)), k):
                        other = v ^ np.uint64(sum(1 << f for f in flips))
                        # of two values the smaller one probes: each pair is met once
                        up = np.flatnonzero(other > v)
                        if len(up):
                            yield rows(other[up], up, False)

    return run


def _forest(ids: np.ndarray, fps: np.ndarray, index: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect the fingerprints of one bucket, at most one less than there are."""
    n, out = len(ids), []
    if n <= 12:
        f, at = fps.tolist(), list(range(n))

        def root(a: int) -> int:
            while at[a] != a:
                a = at[a]
            return a

        for a, b in combinations(range(n), 2):
            if (index[a] or index[b]) and (f[a] ^ f[b]).bit_count() <= radius and (ra := root(a)) != (rb := root(b)):
                at[rb] = ra
                out.append((int(ids[a]), int(ids[b])))
        return out
    left = np.ones(n, dtype=bool)
    for start in range(n):
        if not left[start]:
            continue
        left[start], todo = False, [start]
        while todo:
            a = todo.pop()
            near = left & (np.bitwise_count(fps ^ fps[a]) <= radius)
            if not index[a]:
                near &= index
            hit = np.flatnonzero(near)
            left[hit] = False
            out += [(int(ids[a]), int(ids[b])) for b in hit]
            todo += hit.tolist()
    return out


def _verify_batches(radius: int):
    def bucket_links(cols: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links of whole buckets: cols are part, value, sub, id, fp, is_index, in order."""
        same = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1]) & (cols[2][1:] == cols[2][:-1])
        cuts = np.flatnonzero(np.concatenate(([True], ~same, [True])))
        out: list[tuple[int, int]] = []
        for k in np.flatnonzero(np.diff(cuts) > 1):
            a, b = cuts[k], cuts[k + 1]
            out += _forest(cols[3][a:b], cols[4][a:b], cols[5][a:b], radius)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            cols[4] = cols[4].astype("<i8").view("<u8")
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            cut = int(np.argmax(last))  # the last bucket may go on in the next batch
            held = [x[cut:].copy() for x in cols]
            if cut:
                yield as_batch(bucket_links([x[:cut] for x in cols]))
        if held is not None:
            yield as_batch(bucket_links(held))

    def as_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
        x = np.array(links, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(x.max(axis=1)), pa.array(x.min(axis=1))], names=["u", "v"])

    return run


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u > v: links between distinct fingerprints (nodes: id, fp) that connect all that are within radius.

    A bucket gives a spanning forest of its links, not all of its pairs.
    """
    n = nodes.count()
    some = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    parts = plan_parts(bit_counts(nodes), n, radius, np.array([r["fp"] for r in some], dtype="<i8").view("<u8"))
    rows = nodes.select("id", "fp").mapInArrow(_probe_batches(parts), "part int, value long, id long, fp long, is_index boolean")
    rows = rows.withColumn("sub", F.lit(0))
    hot = materialize(
        rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_index"), 1)).alias("own")).filter((F.col("n") > CHUNK) & (F.col("own") > 0)),
        "simhash-hot",
    )
    if not hot.isEmpty():
        h = hot.select(F.col("part").alias("hp"), F.col("value").alias("hv"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
        mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        pair = lambda j: F.least(mine, j) * F.col("chunks") + F.greatest(mine, j)
        every = F.sequence(F.lit(0), F.col("chunks") - 1)
        subs = (
            F.when(F.col("chunks").isNull(), F.array(F.lit(0)))
            .when(F.col("is_index"), F.transform(every, pair))
            .otherwise(F.transform(every, lambda j: j * F.col("chunks") + j))
        )
        rows = rows.join(h, (F.col("part") == F.col("hp")) & (F.col("value") == F.col("hv")), "left").withColumn("sub", F.explode(subs))
    dealt = rows.select("part", "value", "sub", "id", "fp", "is_index").repartition("part", "value", "sub").sortWithinPartitions("part", "value", "sub")
    return dealt.mapInArrow(_verify_batches(radius), "u long, v long").distinct()


# --- components -------------------------------------------------------------------------------

SALTS = 8


def _with_least(pairs: DataFrame) -> DataFrame:
    """a, b, m for each directed pair: m is the least of a and all its b."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("ka"), F.least("a", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("ks"))
    salted = pairs.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    return salted.join(least, (F.col("a") == F.col("ka")) & (F.col("s") == F.col("ks"))).select("a", "b", "m")


def components(edges: DataFrame) -> DataFrame:
    """member, component (the least id reachable) of all linked ids, by alternating large and small stars.

    Each round is written to the shared folder; only a count and a checksum reach the driver.
    """
    now, mark = materialize(edges.select("u", "v"), "components"), None
    while True:
        got = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if got["n"] == 0 or (got["n"], got["s"]) == mark:
            return now.select(F.col("u").alias("member"), F.col("v").alias("component"))
        mark = (got["n"], got["s"])
        both = now.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(now.select(F.col("v").alias("a"), F.col("u").alias("b")))
        large = _with_least(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _with_least(large)
        stars = small.select(F.col("b").alias("u"), F.col("m").alias("v")).unionByName(small.select(F.col("a").alias("u"), F.col("m").alias("v")))
        now = materialize(stars.filter("u <> v").distinct(), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """id_col, fp and component_id, one row per input row.

    Equal fingerprints are one node, so exact copies never meet in pairs.  Null
    texts count as empty: fingerprint zero, linked like any other.  A row
    without an id links nothing and gets a null component; repeated ids share
    theirs.  Ids must be integers.  An empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "simhash-fp")
    nodes = materialize(fps.filter("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("id")).select("id", "fp"), "simhash-nodes")
    found = components(links(nodes, radius))
    known = nodes.join(found, nodes["id"] == found["member"], "left").select(
        F.col("fp").alias("node_fp"), F.coalesce("component", "id").alias("component_id")
    )
    return fps.join(known, fps["fp"] == known["node_fp"], "left").select(
        F.col("id").alias(id_col), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group of near-duplicates, that with the least id; columns unchanged.

    Rows without an id stay.  Of rows that repeat the kept id one stays, that
    with the least hash of its text (equal texts: any).  Null and empty texts
    are duplicates of each other; an empty table stays empty.
    """
    found = materialize(near_duplicates(docs, id_col, text_col, radius).select(F.col(id_col).cast("long").alias("id"), "component_id"), "near-dup")
    gone = fresh(docs, "gone")
    drop = materialize(found.filter("id <> component_id").select(F.col("id").alias(gone)).distinct(), "near-dup-gone")
    out = docs.join(broadcast_if_small(drop), docs[id_col] == F.col(gone), "left_anti")
    again = found.filter("id = component_id").groupBy("id").count().filter("count > 1").select(F.col("id").alias(gone))
    if again.isEmpty():
        return out
    # rows that repeat an id: one of each stays
    n = fresh(docs, "n")
    from pyspark.sql import Window

    repeated = out.join(again, out[id_col] == F.col(gone), "left_semi")
    first = repeated.withColumn(n, F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col), text_col))).filter(F.col(n) == 1).drop(n)
    return out.join(again, out[id_col] == F.col(gone), "left_anti").unionByName(first)
