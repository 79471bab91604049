"""SimHash near-duplicate classes by a binary trie self-join.

Fingerprints that are equal are one leaf.  Two 64-bit fingerprints within three bits of
each other agree on one of their four 16-bit blocks at least, so the leaves are dealt by
(block, its value) and each task holds, for every value dealt to it, the trie of the
leaves below that path, with the block's bits first.  Node pairs are traversed together:
a pair starts as (root, root) with no errors, descends to its child pairs, adds one error
where the branches differ and is dropped when the errors exceed the budget.  Node pairs
whose leaves are already known to be one class are dropped too, so a large group of near
copies costs little more than the links that join it.  A task returns the links of a
spanning forest only, never all pairs; classes then come from distributed components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import documents, fresh, lean, map_slices, raw
from weftgraph.plans.components import star_components
from weftgraph.plans.scratch import Scratch

#: Fingerprint rows that one trie task takes on average.
LEAVES_PER_TASK = 200_000
#: Node pairs expanded at a time; bounds a task's memory.
PAIRS_AT_ONCE = 400_000
#: Node pairs of at most so many leaf pairs are compared leaf by leaf.
SMALL = 16


def simhash(data: bytes, words_per_shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text in UTF-8, as unsigned int; 0 without words."""
    words = data.lower().split()  # on bytes: A-Z only, and \x09-\x0D and space only
    n = len(words) - words_per_shingle + 1
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if n < 2:
        return xxhash.xxh64_intdigest(joined, seed)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps[: n - 1] + 1)).tolist()
    ends = np.concatenate((gaps[words_per_shingle - 1 :], [len(joined)])).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """One row for each row of df: (doc_id, fp), fp being the fingerprint as a signed long."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = np.array([simhash(x, words_per_shingle) for x in raw(batch, "text")], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "fp"])

        return f

    return map_slices(documents(df, id_col, text_col), make, "doc_id long, fp long")


class Classes:
    """Classes of array positions; position classes are merged by links in bulk."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.steps = np.arange(n)

    def merge(self, u: np.ndarray, v: np.ndarray) -> None:
        of = self.of
        while True:
            a, b = of[u], of[v]
            apart = a != b
            if not apart.any():
                break
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(of, high, low)
            while True:
                nxt = of[of]
                if np.array_equal(nxt, of):
                    break
                of = nxt
        self.of = of
        self.steps = np.concatenate(([0], np.cumsum(of[1:] != of[:-1])))

    def joined(self, lo1, hi1, lo2, hi2) -> np.ndarray:
        """Which node pairs have all their leaves in one class."""
        s, of = self.steps, self.of
        return (s[hi1 - 1] == s[lo1]) & (s[hi2 - 1] == s[lo2]) & (of[lo1] == of[lo2])


def leaf_pairs(lo1, hi1, lo2, hi2):
    """All leaf pairs of small node pairs; those of a node with itself count once."""
    n2 = hi2 - lo2
    sizes = (hi1 - lo1) * n2
    which = np.repeat(np.arange(len(sizes)), sizes)
    k = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    i, j = lo1[which] + k // n2[which], lo2[which] + k % n2[which]
    keep = i < j
    return i[keep], j[keep]


def trie_self_join(keys: np.ndarray, start: int, budget: int) -> np.ndarray:
    """keys: sorted distinct uint64.  Links keys that agree on their first ``start`` bits
    and differ in at most ``budget`` of the rest; returns for each key the first position
    of its class."""
    n = len(keys)
    classes = Classes(n)
    if n < 2:
        return classes.of
    top = keys >> np.uint64(64 - start) if start else np.zeros(n, np.uint64)
    heads = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
    tails = np.concatenate((heads[1:], [n]))
    many = tails - heads > 1
    roots = (heads[many], tails[many], heads[many], tails[many], np.zeros(many.sum(), np.int8))
    ones: dict[int, np.ndarray] = {}
    for allowed in range(1, budget + 1):  # near links first: they let later rounds skip what is joined
        stack = [(start, roots)]
        while stack:
            depth, (lo1, hi1, lo2, hi2, err) = stack.pop()
            if len(lo1) > PAIRS_AT_ONCE:
                half = len(lo1) // 2
                stack += [(depth, tuple(x[half:] for x in (lo1, hi1, lo2, hi2, err))), (depth, tuple(x[:half] for x in (lo1, hi1, lo2, hi2, err)))]
                continue
            on = ~classes.joined(lo1, hi1, lo2, hi2)
            lo1, hi1, lo2, hi2, err = (x[on] for x in (lo1, hi1, lo2, hi2, err))
            small = ((hi1 - lo1) * (hi2 - lo2) <= SMALL) | (depth == 64)
            if small.any():
                i, j = leaf_pairs(lo1[small], hi1[small], lo2[small], hi2[small])
                near = np.bitwise_count(keys[i] ^ keys[j]) <= allowed
                classes.merge(i[near], j[near])
            lo1, hi1, lo2, hi2, err = (x[~small] for x in (lo1, hi1, lo2, hi2, err))
            if not len(lo1):
                continue
            if depth not in ones:
                ones[depth] = np.concatenate(([0], np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)))
            c = ones[depth]
            mid1, mid2 = hi1 - (c[hi1] - c[lo1]), hi2 - (c[hi2] - c[lo2])
            own = lo1 == lo2
            children = [(lo1, mid1, lo2, mid2, err), (mid1, hi1, mid2, hi2, err), (lo1, mid1, mid2, hi2, err + 1)]
            children.append(tuple(x[~own] for x in (mid1, hi1, lo2, mid2, err + 1)))
            lo1, hi1, lo2, hi2, err = (np.concatenate(x) for x in zip(*children))
            live = (hi1 > lo1) & (hi2 > lo2) & (err <= allowed)
            stack.append((depth + 1, tuple(x[live] for x in (lo1, hi1, lo2, hi2, err))))
    return classes.of


def trie_links(leaves: DataFrame, budget: int = 3, leaves_per_task: int = LEAVES_PER_TASK) -> DataFrame:
    """leaves(fp, id), fp distinct -> links (src, dst) between ids, enough to join every
    two fingerprints that differ in at most ``budget`` bits."""
    blocks = budget + 1
    cuts = [64 * b // blocks for b in range(blocks + 1)]
    dealt = leaves.withColumn("block", F.explode(F.array(*[F.lit(b) for b in range(blocks)])))
    value = F.lit(0).cast("long")
    for b in range(blocks):
        width = cuts[b + 1] - cuts[b]
        value = F.when(F.col("block") == b, F.shiftrightunsigned("fp", 64 - cuts[b + 1]).bitwiseAND((1 << width) - 1)).otherwise(value)
    count = leaves.count()
    tasks = max(int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks * count // leaves_per_task + 1)

    def run(batches):
        fps, ids, which = [], [], []
        for b in batches:
            fps.append(b.column(0).to_numpy())
            ids.append(b.column(1).to_numpy())
            which.append(b.column(2).to_numpy())
        if not fps:
            return
        fps, ids, which = np.concatenate(fps).view(np.uint64), np.concatenate(ids), np.concatenate(which)
        for b in range(blocks):
            at, turn = which == b, np.uint64(cuts[b])
            own, name = fps[at], ids[at]
            keys = (own << turn) | (own >> np.uint64(64 - cuts[b])) if cuts[b] else own
            order = np.argsort(keys)
            keys, name = keys[order], name[order]
            of = trie_self_join(keys, cuts[b + 1] - cuts[b], budget)
            linked = np.flatnonzero(of != np.arange(len(of)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(name[linked]), pa.array(name[of[linked]])], ["src", "dst"])

    return dealt.select("fp", "id", "block", value.alias("value")).repartition(tasks, "block", "value").select("fp", "id", "block").mapInArrow(lean(run), "src long, dst long")


def near_duplicates(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, budget: int = 3) -> DataFrame:
    """SimHash classes: one row (doc_id, fingerprint, component_id) for each row of df.

    component_id is the smallest doc_id that links of at most ``budget`` differing bits
    can reach.  Texts without words (empty or null) have fingerprint 0 and link like any
    other.  A row with a null id links too and gets its class, or null where no row of the
    class has an id.  Rows that share an id are one document to the links: the classes of their
    fingerprints are one.  Repeated rows come back repeated; an empty table gives no rows.
    """
    fps = scratch.write(fingerprints(df, id_col, text_col, words_per_shingle), "fingerprints")
    leaves = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "leaves")
    links = trie_links(leaves.select("fp", F.col("fp").alias("id")), budget)
    named = leaves.where("id is not null")
    shared = named.groupBy("id").agg(F.min("fp").alias("dst"), F.count("*").alias("n")).where("n > 1")
    joined = star_components(links.unionAll(named.join(shared, "id").select("fp", "dst")), scratch)
    linked = leaves.join(joined.withColumnRenamed("id", "__fp"), F.col("fp") == F.col("__fp"), "left").select("fp", "id", F.coalesce("component", "fp").alias("class"))
    classes = linked.join(linked.groupBy("class").agg(F.min("id").alias("component_id")), "class").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(classes, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", **how) -> DataFrame:
    """df without the rows whose class has a row of a smaller id; columns as they were.

    A row without an id stays.  Rows that repeat the kept id stay as they are.
    """
    found = near_duplicates(df, scratch, id_col, **how)
    (name,) = fresh(df, "gone")
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct()
    return df.join(gone, df[id_col] == gone[name], "left_anti")
