"""SimHash near-dedup at a Jaccard similarity: the trie's links, and an exact way for the rest.

The trie self-join of fingerprints (simhash.py) joins what differs in a few bits.  At a
similarity of 0.8 two texts differ in about ten bits of 64, up to eighteen or so, and so many
bits no trie can carry.  So the trie's links, each checked by the texts' own shingles, only
begin the classes, and a prefix filter finds what they miss.  Two sets of at least ``p/q``
similarity share a shingle among the first ``n - ceil(n p/q) + 1`` of each, in any order
that all sets follow; rare shingles come first, so that what many texts quote brings few
together.  Pairs that share one are held against three bounds that no similar pair breaks
(sizes, what is left behind the shared shingle, bits that differ in a parity sketch), and
what is left is compared by the texts' own shingles.

Only shingles whose documents are not yet of one class are looked at.  A task takes one
shingle's documents, or a tile of two blocks of them where they are many, and sends the
pairs of a spanning forest, as if each were similar: never all pairs of a group.  Some turns
of that, the first over some of the shingles (similar texts share many), leave few classes
apart; the last turn sends every pair that is left between classes, so no link is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import batches_of, fresh, lean, map_slices, raw
from weftgraph.llm.simhash import Classes, leaf_pairs, trie_links
from weftgraph.plans.components import star_components
from weftgraph.plans.scratch import Scratch

#: Documents in the sample that the order of shingles comes from, about; a shingle is
#: frequent with so many of them, and so many shingles are told from the rare at most.
SAMPLE_DOCS, FREQUENT_DOCS, FREQUENT_MOST = 20_000, 4, 200_000
#: Turns that send forests, before the one that sends all pairs left: each looks at one in
#: so many of the shingles.
TURNS = (8, 1)
#: Documents of a block of a shingle; a task holds two blocks.
BLOCK = 2048
#: Rows of a block that are compared with all others at a time; shingles of up to so many
#: documents are taken together, up to so many pairs and rows at a time.
STRIP, PAIRS_AT_ONCE, ROWS_AT_ONCE = 64, 400_000, 60_000
#: Up to so many keys (16 bytes each) are broadcast.
BROADCAST_KEYS = 500_000
#: Longs of a parity sketch.
SKETCH = 16


def shingles(data: bytes, words: int) -> list[bytes]:
    """All runs of ``words`` words, in lower case (A-Z only); a shorter text is one."""
    w = data.lower().split()
    return [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] * bool(w)


def shingle_hashes(data: bytes, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles(data, words))), ">u8").astype(np.uint64))


def similar(a: bytes, b: bytes, words: int, share: tuple[int, int]) -> bool:
    x, y = set(shingles(a, words)), set(shingles(b, words))
    return share[1] * len(x & y) >= share[0] * len(x | y)


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingle hashes: the bits that over half of them have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _frequent(df: DataFrame, id_col: str, text_col: str, words: int) -> pa.Table:
    """(token, docs): the shingles that a sample has most often; decides the order only."""
    share = min(1 << 20, (SAMPLE_DOCS << 20) // max(1, df.count()) + 1)
    drawn = df.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 20)) < share).select(F.col(text_col).alias("text"))

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_hashes(x, words) for x in raw(batch, "text")] or [np.zeros(0, np.uint64)]).view(np.int64))], ["token"])

        return f

    counted = map_slices(drawn, make, "token long").groupBy("token").agg(F.count("*").alias("docs"))
    return counted.where(F.col("docs") >= FREQUENT_DOCS).orderBy(F.desc("docs"), "token").limit(FREQUENT_MOST).toArrow()


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, text): mark tells the texts of rows that share an id apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _keyed(named: DataFrame, frequent: pa.Table, words: int, share: tuple[int, int]) -> DataFrame:
    """A row for each row: id, mark, key (one for each set of shingles), n (its size), fp,
    prefix, common (how many of the prefix, its last, are frequent) and bits, a parity sketch."""
    token, docs = frequent["token"].to_numpy().view(np.uint64), frequent["docs"].to_numpy()
    order = np.argsort(token)
    sent = named.sparkSession.sparkContext.broadcast((token[order], docs[order]))
    p, q = share

    def make():
        often, docs = sent.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, sizes, prints, prefixes, common, bits = [], [], [], [], [], []
            for x in raw(batch, "text"):
                h = shingle_hashes(x, words)
                n = len(h)
                keys.append(xxhash.xxh64_intdigest(h.tobytes(), 1) if n else 0)
                sizes.append(n)
                prints.append(fingerprint(h))
                rank = np.zeros(n, np.int64)
                if len(often) and n:
                    at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                    rank = np.where(often[at] == h, docs[at], 0)
                first = np.lexsort((h, rank))[: n + (-p * n // q) + 1 if n else 0]
                prefixes.append(h[first].view(np.int64))
                common.append(int((rank[first] > 0).sum()))
                places = np.bincount((h % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
                bits.append(np.packbits(places.astype(np.uint8)).view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in prefixes]))).astype(np.int32)
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array(np.array(keys, np.uint64).view(np.int64)),
                pa.array(sizes, pa.int32()),
                pa.array(np.array(prints, np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*prefixes, np.zeros(0, np.int64)]))),
                pa.array(common, pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * SKETCH), pa.array(np.concatenate([*bits, np.zeros(0, np.int64)]))),
            ]
            return pa.RecordBatch.from_arrays(columns, ["id", "mark", "key", "n", "fp", "prefix", "common", "bits"])

        return f

    made = map_slices(named, make, "id long, mark long, key long, n int, fp long, prefix array<long>, common int, bits array<long>")
    return made.withColumn("row", F.monotonically_increasing_id())


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if it has so few rows that it may be."""
    return F.broadcast(df) if rows <= BROADCAST_KEYS else df


def _leaves(keyed: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """One row of each key that has words, and the keys that have several rows."""
    many = scratch.write(keyed.groupBy("key").agg(F.min("row").alias("chosen"), F.count("*").alias("rows")).where("rows > 1").select("key", "chosen"), "copies")
    return keyed.where("n > 0").join(_few(many, many.count()), "key", "left").where("chosen IS NULL OR chosen = row").drop("chosen"), many


def _shared(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """(token, key, n, at, bits): prefix shingles that several keys have."""
    tokens = leaves.select("key", "n", (F.size("prefix") - F.col("common")).alias("rare"), F.posexplode("prefix").alias("at", "token"))
    tokens = tokens.select("token", "key", "n", "at", (F.col("at") >= F.col("rare")).alias("frequent"))
    # a shingle that is not frequent is of few documents, so a window may hold its rows
    counted = tokens.where("not frequent").withColumn("docs", F.count("*").over(Window.partitionBy("token"))).where("docs > 1")
    columns = ["token", "key", "n", "at"]
    shared = scratch.write(counted.select(*columns).unionAll(tokens.where("frequent").select(*columns)), "shared")
    scratch.release()
    keys = scratch.write(shared.select("key").distinct(), "keys")
    wanted = leaves.select("key", "bits").join(_few(keys, keys.count()), "key", "left_semi")
    out = scratch.write(shared.join(wanted, "key").select("token", "key", "n", "at", "bits"), "rows")
    scratch.drop(shared)
    scratch.drop(keys)
    return out


def _candidates(starts: np.ndarray, side: np.ndarray, cls: np.ndarray, n: np.ndarray, at: np.ndarray, bits: np.ndarray, share: tuple[int, int], forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of one shingle (starts: where the shingles' rows begin) and different
    classes that the bounds let through; with ``forest`` enough of them to join what they
    all would.  Where a shingle has rows of two sides, only pairs across them are asked for."""
    p, q = share
    _, first, own = np.unique(cls, return_index=True, return_inverse=True)
    of = Classes(0)
    of.of = first[own]
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def take(i: np.ndarray, j: np.ndarray) -> None:
        size = n[i] + n[j]
        on = (of.of[i] != of.of[j]) & (q * np.minimum(n[i], n[j]) >= p * np.maximum(n[i], n[j])) & ((p + q) * np.minimum((n - at)[i], (n - at)[j]) >= p * size)
        i, j = i[on], j[on]
        apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        near = (p + q) * apart <= (q - p) * size[on]
        i, j = i[near], j[near]
        while forest and len(i):
            # of each class on the far side the first pair; then only what is still apart
            _, one = np.unique(of.of[j], return_index=True)
            found.append((i[one], j[one]))
            of.merge(i[one], j[one])
            on = of.of[i] != of.of[j]
            i, j = i[on], j[on]
        if len(i):
            found.append((i, j))

    ends = np.append(starts[1:], len(n))
    few = ends - starts <= STRIP
    lo, hi = starts[few], ends[few]
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum((hi - lo) ** 2) // PAIRS_AT_ONCE)) + 1).tolist(), len(lo)]
    for s, e in zip(cuts, cuts[1:]):
        if s < e:
            take(*leaf_pairs(lo[s:e], hi[s:e], lo[s:e], hi[s:e]))
    for lo, hi in zip(starts[~few].tolist(), ends[~few].tolist()):
        two = side[lo] != side[hi - 1] or (side[lo:hi] != side[lo]).any()
        for a in range(lo, hi, STRIP):
            b = min(a + STRIP, hi)
            ok = of.of[a:b, None] != of.of[None, a:hi]
            ok &= q * np.minimum(n[a:b, None], n[None, a:hi]) >= p * np.maximum(n[a:b, None], n[None, a:hi])
            if two:
                ok &= side[a:b, None] != side[None, a:hi]
            i, j = np.nonzero(ok)
            on = i < j
            take(i[on] + a, j[on] + a)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _pairs(rows: DataFrame, turn: int, share: tuple[int, int], forest: bool) -> DataFrame:
    """(src, dst), src < dst, between keys of different classes that the bounds let through;
    shingles whose rows are all of one class have none."""
    blocks = rows.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("cls").alias("low"), F.max("cls").alias("high"))
    rows = rows.join(blocks.where("low <> high").select("token", "blocks"), "token").withColumn("mix", F.xxhash64("key", F.lit(turn)))
    rows = rows.withColumn("own", F.pmod("mix", "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("token", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "mix", "key", "cls", "n", "at", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def tiles(c: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
            _, _, _, own, key, cls, n, at, bits = c
            i, j = _candidates(starts, own, cls, n, at, bits, share, forest)
            src, dst = np.minimum(key[i], key[j]), np.maximum(key[i], key[j])
            order = np.lexsort((dst, src))  # a pair of long texts shares many shingles
            src, dst = src[order], dst[order]
            new = np.ones(len(src), bool)
            new[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
            return pa.RecordBatch.from_arrays([pa.array(src[new]), pa.array(dst[new])], ["src", "dst"])

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            """What the tiles that are held whole send; the last one may go on."""
            nonlocal held
            c = [np.concatenate(x) for x in zip(*held)]
            new = np.ones(len(c[0]), bool)
            new[1:] = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])
            starts = np.flatnonzero(new)
            end = len(c[0]) if last else int(starts[-1])
            if end:
                yield tiles([x[:end] for x in c], starts[starts < end])
            held = [[x[end:].copy() for x in c]]

        rows = 0
        for batch in batches:
            c = [batch.column(i).to_numpy() for i in range(6)] + [batch.column(i).to_numpy().astype(np.int64) for i in (6, 7)]
            # as unsigned: the bits of a negative number are counted otherwise
            held.append([*c, batch.column(8).flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH)])
            rows += batch.num_rows
            if rows >= ROWS_AT_ONCE:
                yield from whole(False)
                rows = len(held[0][0])
        if held:
            yield from whole(True)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "token", "a", "b").sortWithinPartitions("token", "a", "b", "mix", "key")
    return dealt.select("token", "a", "b", "own", "key", "cls", "n", "at", "bits").mapInArrow(lean(run), "src long, dst long").distinct()


def links(keyed: DataFrame, scratch: Scratch, texts_of: Callable[[DataFrame], DataFrame], words: int, share: tuple[int, int], budget: int = 3) -> DataFrame:
    """(src, dst) between keys, all of similar sets and enough to join every two.

    texts_of(keys) gives (key, text) for a table of keys.
    """
    leaves, _ = _leaves(keyed, scratch)
    tested: DataFrame | None = None

    def checked(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar, by the shingles themselves; none is compared twice."""
        nonlocal tested
        new = pairs if tested is None else pairs.join(tested, ["src", "dst"], "left_anti")
        new = scratch.write(new, "pairs")
        if new.isEmpty():
            return new
        tested = new if tested is None else tested.unionAll(new)
        texts = texts_of(scratch.write(new.select(F.col("src").alias("key")).unionAll(new.select("dst")).distinct(), "wanted"))
        both = new.join(texts.select(F.col("key").alias("src"), F.col("text").alias("a")), "src").join(texts.select(F.col("key").alias("dst"), F.col("text").alias("b")), "dst")

        def make():
            def f(batch: pa.RecordBatch) -> pa.RecordBatch:
                on = [similar(a, b, words, share) for a, b in zip(raw(batch, "a"), raw(batch, "b"))]
                return batch.select(["src", "dst"]).filter(pa.array(on, pa.bool_()))

            return f

        out = scratch.write(map_slices(both.select("src", "dst", "a", "b"), make, "src long, dst long"), "links")
        scratch.release()
        return out

    prints = leaves.groupBy("fp").agg(F.min("key").alias("head"))
    near = trie_links(scratch.write(prints.select("fp", F.col("head").alias("id")), "prints"), budget)
    equal = leaves.join(prints, "fp").where("key <> head").select(F.col("head").alias("src"), F.col("key").alias("dst"))
    near = near.unionAll(equal).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    found = checked(near)
    rows = _shared(leaves, scratch)
    for turn, one_in in enumerate((*TURNS, 1)):
        classes = scratch.write(star_components(found, scratch).select(F.col("id").alias("key"), F.col("component")), "classes")
        some = rows.where(F.pmod(F.xxhash64("token", F.lit(turn)), F.lit(one_in)) == 0) if one_in > 1 else rows
        dealt = some.join(_few(classes, classes.count()), "key", "left").withColumn("cls", F.coalesce("component", "key")).drop("component")
        sent = scratch.write(_pairs(dealt, turn, share, turn < len(TURNS)), "sent")
        scratch.release()
        found = scratch.write(found.unionAll(checked(sent)), "links")
    return found


def keep_first(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """df without the rows whose class has a row of a smaller id; columns as they were.

    Two texts are linked if the Jaccard similarity of their sets of shingles of ``words``
    words is share[0]/share[1] or more; a class is what links can reach.  Texts without
    words (null, empty, blank) are one class.  Rows without an id stay, and link like any
    other.  Rows that share the kept id and text all stay; those that share its id only
    are judged by their own texts.  An empty table stays empty.  Texts count as one if a
    64-bit hash of their shingles' hashes is the same; all other links are exact.
    """
    named = _named(df, id_col, text_col)
    with batches_of(df.sparkSession, 500, "4m"):
        keyed = scratch.write(_keyed(named, _frequent(df, id_col, text_col, words), words, share), "keyed")
        marks = keyed.select("key", "id", "mark")

        def texts_of(keys: DataFrame) -> DataFrame:
            n = keys.count()
            rows = marks.join(_few(keys, n), "key", "left_semi").groupBy("key").agg(F.min(F.struct("mark", "id")).alias("x")).select("key", "x.mark", "x.id")
            return named.join(_few(rows, n), (named["mark"] == rows["mark"]) & named["id"].eqNullSafe(rows["id"])).select("key", "text").groupBy("key").agg(F.min("text").alias("text"))

        classes = star_components(links(keyed, scratch, texts_of, words, share), scratch)
    classes = scratch.write(classes, "classes")
    gone_id, gone_mark = fresh(df, "gone_id", "gone_mark")
    own = marks.distinct()
    dealt = own.join(_few(classes, classes.count()), own["key"] == classes["id"], "left").select("key", own["id"], "mark", F.coalesce("component", "key").alias("class"))
    first = scratch.write(dealt.groupBy("class").agg(F.min("id").alias("first"), F.count("*").alias("members")).where("members > 1"), "first")
    # rows of a class of many meet its first where they are, and are not dealt by class
    many = first.where(F.col("members") > BLOCK).select("class", F.col("first").alias("of_many"))
    found = dealt.join(_few(many, many.count()), "class", "left")
    few = found.where("of_many IS NULL").join(first.where(F.col("members") <= BLOCK).select("class", "first"), "class")
    columns = [F.col("id").alias(gone_id), F.col("mark").alias(gone_mark)]
    gone = scratch.write(found.where("of_many < id").select(*columns).unionAll(few.where("first < id").select(*columns)).distinct(), "gone")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = df.join(_few(gone, gone.count()), (F.col(id_col).cast("long") == F.col(gone_id)) & (F.xxhash64(text) == F.col(gone_mark)), "left_anti")
    scratch.keep_only(gone)
    return out
