"""Exact n-gram Jaccard join over metric regions.

Documents become sets of word n-grams. The Jaccard distance d = 1 - J is a metric and two documents
link when d <= r (r = 0.2). Equal sets (d = 0) collapse to one set first. The rest is solved region by
region:

1. *Cells.* With the n-grams in one global order (frequent ones last, ties by hash), two linked sets
   of sizes m <= n share one of the first floor(r * size) + 1 n-grams of both. Each such n-gram is a
   cell, so every link lies inside a cell.
2. *Pivots.* The smallest set id of a cell is its pivot. A set belongs to the Voronoi region of its
   nearest pivot (the one it shares most cells with) and gets its exact distance to it. All sets within
   r of one pivot are one component, without a look at their pairs: a large group of near copies
   costs one comparison a member.
3. *Windows.* Families of sets that are close to common pivots (similarity ``FAMILY`` or more, chained)
   form one region each; the other pairs are met in their cells. A pair of one component is done, and
   any other needs an exact check only if the triangle inequality lets it: the sizes (distance to the
   empty set) differ by at most r, the distances to a common pivot differ by at most r, and the
   parities of hash classes (two or more for each n-gram in cells, 16 or more in regions) differ in no
   more places than the symmetric difference that r allows.
4. *Recursion.* Regions and large cells are cut into blocks and the block pairs are joined alike. In a
   region each set meets its closest partner of another component, components merge, and the region
   is joined again until no partner is left; then the cells are joined once for pairs across regions.

5. *Counts.* Links of two sets of one component already known are not listed one by one. They are counted
   at the end: every link lies inside a component, so the sets of a component are cut into blocks bounded by
   sets and n-grams, and the sizes of all intersections of a block pair come from one product of their
   incidence matrices. Copies count with their set. This is quadratic in the different sets of a component.

The order only steers the work; any order gives the same links. The frequent n-grams come from counts
over all documents; the list is cut to ``HOT`` entries, which bounds what is broadcast and loses
nothing.

Defined results: a document without words (null, empty, blank text) has an empty set and links with
nothing, not even with its like; fewer than n words form one n-gram; repeated rows link with each
other; a row with a null id links like any other, and a null id is a component id only where there is
no other; empty tables give empty results; only the id and the text column are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanlytics.llm.common import BROADCAST_BYTES, query, read, released, shuffle_partitions, written
from spanlytics.llm.components import components

N = 5
PERCENT = 80
#: Entries of the list of frequent n-grams.
HOT = 1 << 16
#: An n-gram that a batch of rows holds this often is reported to that list.
REPORT = 3
#: Bits of hash beyond one class for each n-gram: in cells, and in regions.
COARSE, FINE = 1, 4
#: Sets of a cell that one task compares with each other.
BLOCK = 2000
#: N-grams of the sets of a block when links are counted, and holders from which one is a column of the matrix.
BLOCK_GRAMS, DENSE = 1 << 20, 16
#: Stands for a null id where texts are looked up; the hash of the text tells it from an equal id.
NO_ID = (1 << 63) - 1
#: Sets compared with one pivot in one group of rows.
STAR = 500
#: Sets this similar (percent) to a common pivot are joined in one region.
FAMILY = 30
#: Sets that share this part (percent) of their cells with a pivot are compared with it for that.
SHARED = 15
#: Pairs of holders that are counted at once.
PAIRS = 1 << 22
#: Words whose hashes a worker keeps.
_MEMORY = 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Hashes of the distinct word n-grams of a text, with a bounded memory of word hashes."""

    def __init__(self, n: int = N):
        self.n = n
        self.seen: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.empty(0, np.uint64)
        if len(self.seen) > _MEMORY:
            self.seen.clear()
        seen = self.seen
        for w in words:
            if w not in seen:
                seen[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter((seen[w] for w in words), np.uint64, len(words))
        k = min(self.n, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - k + 1, np.uint64(k))
            for i in range(k):
                out = (out ^ h[i : len(h) - k + 1 + i]) * _MIX
                out ^= out >> np.uint64(29)
        return np.unique(out)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lowered, cut at ASCII white space (0x20, 0x09-0x0D)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def grams_of(text: str | None, n: int) -> frozenset:
    w = words_of(text)
    if not w:
        return frozenset()
    if len(w) < n:
        return frozenset([tuple(w)])
    return frozenset(zip(*[w[i:] for i in range(n)]))


def parities(grams: np.ndarray, extra: int) -> bytes:
    """Parities of the sizes of hash classes as bits, 2**extra to 2**(extra + 1) classes for each n-gram.

    Sets that differ in d n-grams differ in at most d parities.
    """
    k = max(6, (len(grams) - 1).bit_length() + extra)
    return np.packbits(np.bincount((grams >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k) & 1).tobytes()


def _half(data: bytes) -> bytes:
    """The parities of half as many classes."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    return np.packbits(bits[0::2] ^ bits[1::2]).tobytes()


def parity_gap(a: bytes, b: bytes) -> int:
    while len(a) != len(b):
        a, b = (_half(a), b) if len(a) > len(b) else (a, _half(b))
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def _set_id(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def prefix_size(n, percent: int = PERCENT):
    """How many n-grams of a set of n are cells: n - ceil(n * percent / 100) + 1."""
    return n - -(-(n * percent) // 100) + 1


_FIRST = "kind byte, id long, th long, n long, sid long, classes binary, gram long, count long"


def _first_pass(n: int):
    """Document rows (kind 0) and frequent n-grams of each batch with their smallest set (kind 1)."""

    def run(batches):
        shingle = Shingler(n)
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sets = [shingle(t) for t in batch.column(2).to_pylist()]
            sids = [_set_id(s) if len(s) else None for s in sets]
            classes = [parities(s, COARSE) if len(s) else None for s in sets]
            rows = len(ids)
            yield _batch(_FIRST, kind=[0] * rows, id=ids, th=hashes, n=[len(s) for s in sets], sid=sids, classes=classes, gram=[None] * rows, count=[None] * rows)
            # equal sets of a batch count once
            own = {s: g for s, g in zip(sids, sets) if s is not None}
            if not own:
                continue
            grams = np.concatenate(list(own.values()))
            holder = np.repeat(np.fromiter(own.keys(), np.int64, len(own)), [len(g) for g in own.values()])
            order = np.lexsort((holder, grams))
            grams, holder = grams[order], holder[order]
            start = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            count = np.diff(np.append(start, len(grams)))
            often = count >= REPORT
            k = int(often.sum())
            yield _batch(_FIRST, kind=[1] * k, id=[None] * k, th=[None] * k, n=[None] * k, sid=holder[start[often]], classes=[None] * k, gram=grams[start[often]].view(np.int64), count=count[often])

    return released(run)


_TYPES = {"byte": pa.int8(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string()}


def _batch(schema: str, **columns) -> pa.RecordBatch:
    kinds = [part.strip().split(" ") for part in schema.split(",")]
    arrays = [pa.array(columns[name], _TYPES[kind]) for name, kind in kinds]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in kinds])


def _cells(n: int, percent: int, hot, buckets: int):
    """Cells of every set, packed: one row a bucket and batch with the n-grams and the sets' ids."""

    def run(batches):
        shingle = Shingler(n)
        table, rank = hot.value
        for batch in batches:
            own = {}
            for text in batch.column(0).to_pylist():
                s = shingle(text)
                if len(s):
                    own[_set_id(s)] = s
            if not own:
                continue
            picked, holder = [], []
            for sid, s in own.items():
                p = prefix_size(len(s), percent)
                at = np.minimum(np.searchsorted(table, s), max(len(table) - 1, 0))
                is_hot = table[at] == s if len(table) else np.zeros(len(s), bool)
                cold = s[~is_hot]
                if len(cold) < p:
                    h = s[is_hot][np.argsort(rank[at[is_hot]])]
                    cold = np.concatenate([cold, h[: p - len(cold)]])
                picked.append(cold[:p])
                holder.append(sid)
            grams = np.concatenate(picked)
            sids = np.repeat(np.array(holder, np.int64), [len(p) for p in picked])
            at = np.minimum(np.searchsorted(table, grams), max(len(table) - 1, 0))
            is_hot = table[at] == grams if len(table) else np.zeros(len(grams), bool)
            # a frequent n-gram has its pivot already, so its rows may go anywhere
            bucket = np.where(is_hot, sids.view(np.uint64), grams * _MIX >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cut))
            yield _batch(
                "bucket int, grams binary, sids binary",
                bucket=full,
                grams=[grams[order[cut[b] : cut[b + 1]]].tobytes() for b in full],
                sids=[sids[order[cut[b] : cut[b + 1]]].tobytes() for b in full],
            )

    return released(run)


def _share(hot):
    """Rows ``gram, sid, pivot`` of the cells of a bucket that hold at least two sets."""

    def run(batches):
        table, _ = hot.value
        low = hot.pivots.value
        parts = [(g, s) for b in batches for g, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        if not parts:
            return
        grams = np.frombuffer(b"".join(g for g, _ in parts), np.uint64)
        sids = np.frombuffer(b"".join(s for _, s in parts), np.int64)
        del parts
        order = np.lexsort((sids, grams))
        grams, sids = grams[order], sids[order]
        new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (sids[1:] != sids[:-1])])
        grams, sids = grams[new], sids[new]
        start = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        size = np.diff(np.append(start, len(grams)))
        pivot = np.repeat(sids[start], size)
        shared = np.repeat(size > 1, size)
        if len(table):
            at = np.minimum(np.searchsorted(table, grams), len(table) - 1)
            is_hot = table[at] == grams
            pivot = np.where(is_hot, low[at], pivot)
            shared |= is_hot
        for i in range(0, len(grams), 1 << 20):
            cut = slice(i, i + (1 << 20))
            m = shared[cut]
            yield _batch("gram long, sid long, pivot long", gram=grams[cut][m].view(np.int64), sid=sids[cut][m], pivot=pivot[cut][m])

    return released(run)


class _Hot:
    """Broadcast list of frequent n-grams: sorted, with a rank (least frequent first) and a pivot."""

    def __init__(self, spark: SparkSession, rows):
        gram = np.array([r["gram"] for r in rows], np.int64).view(np.uint64)
        count = np.array([r["count"] for r in rows], np.int64)
        low = np.array([r["low"] for r in rows], np.int64)
        order = np.argsort(gram)
        gram, count, low = gram[order], count[order], low[order]
        rank = np.empty(len(gram), np.int64)
        rank[np.lexsort((gram, count))] = np.arange(len(gram))
        self._rank = spark.sparkContext.broadcast((gram, rank))
        self.pivots = spark.sparkContext.broadcast(low)

    @property
    def value(self):
        return self._rank.value


_COMPARED = "a long, b long, both long, all long, n long, fine binary"


def _compare(n: int, fine: bool):
    """Exact sizes of a pivot's set and the sets of its rows; rows come sorted, the pivot first.

    The pivot gives a row with itself. ``fine`` adds the size and the fine classes of ``a``.
    """

    def run(batches):
        key, base, shingle = None, frozenset(), Shingler(n)
        for batch in batches:
            pivots, salts, sids = (batch.column(i).to_pylist() for i in range(3))
            a, b, both, union, size, classes = [], [], [], [], [], []
            for pivot, salt, sid, text in zip(pivots, salts, sids, batch.column(3).to_pylist()):
                grams = grams_of(text, n)
                if sid == pivot:
                    key, base = (pivot, salt), grams
                assert key == (pivot, salt), "a pivot's text must come first"
                k = len(base & grams)
                a.append(sid), b.append(pivot), both.append(k), union.append(len(base) + len(grams) - k), size.append(len(grams))
                classes.append(parities(shingle(text), FINE) if fine else None)
            yield _batch(_COMPARED, a=a, b=b, both=both, all=union, n=size, fine=classes)

    return run


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` rows with the texts of their ``row`` and ``th``; the other texts stay where they are."""
    rows = wanted.select("row", "th").distinct()
    if rows.count() * 24 <= BROADCAST_BYTES:
        rows = F.broadcast(rows)
    return docs.select("row", "th", "text").join(rows, ["row", "th"], "left_semi").join(wanted, ["row", "th"])


def compared(docs: DataFrame, where: DataFrame, pairs: DataFrame, n: int, fine: bool = False) -> DataFrame:
    """Pairs ``a, b`` of set ids with ``both`` and ``all``, the exact sizes of their sets; each ``b`` with itself, too.

    ``where`` maps a set id to the one document (id and hash of the text) whose text stands for it. The rows of a pivot are
    dealt out in groups of ``STAR``, each with its own copy of the pivot's text.
    """
    salted = pairs.join(pairs.groupBy("b").agg(F.count("*").alias("size")), "b")
    salted = salted.select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("size") / STAR)).alias("salt"))
    wanted = salted.select(F.col("a").alias("sid"), F.col("b").alias("pivot"), "salt").union(salted.select(F.col("b"), F.col("b"), "salt").distinct())
    wanted = written(wanted.join(where, "sid").select("row", "th", "sid", "pivot", "salt"), "wanted")
    groups = _with_texts(docs, wanted).select("pivot", "salt", "sid", "text")
    first = F.when(F.col("sid") == F.col("pivot"), 0).otherwise(1)
    dealt = groups.repartition(shuffle_partitions(docs.sparkSession), "pivot", "salt").sortWithinPartitions("pivot", "salt", first)
    return dealt.mapInArrow(_compare(n, fine), _COMPARED)


def _worth_comparing(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and class distances allow a link, or that share many cells, as families do."""

    def allowed(batches):
        for batch in batches:
            cells, n, m = (batch.column(i).to_numpy() for i in (2, 3, 5))
            ok = (n * 100 >= m * percent) & (m * 100 >= n * percent)
            one, two = batch.column(4).to_pylist(), batch.column(6).to_pylist()
            gap = np.fromiter((parity_gap(x, y) if near else 0 for x, y, near in zip(one, two, ok)), np.int64, len(ok))
            ok &= gap * (100 + percent) <= (n + m) * (100 - percent)
            ok |= cells * 100 >= prefix_size(n, percent) * SHARED
            yield batch.select(["a", "b", "cells"]).filter(pa.array(ok))

    one = sets.select(F.col("sid").alias("a"), F.col("n").alias("n1"), F.col("classes").alias("c1"))
    two = sets.select(F.col("sid").alias("b"), F.col("n").alias("n2"), F.col("classes").alias("c2"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "cells", "n1", "c1", "n2", "c2")
    return rows.mapInArrow(allowed, "a long, b long, cells long")


def _folded(rows: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """By level (row numbers, classes, rows of that level): the rows of the next finer level follow, folded."""
    size = np.array([len(r) for r in rows])
    out = []
    for k in np.unique(size):
        own, finer = np.flatnonzero(size == k), np.flatnonzero(size == 2 * k)
        parts = [np.frombuffer(b"".join([rows[i] for i in own]), np.uint64).reshape(len(own), -1)]
        if len(finer):
            bits = np.unpackbits(np.frombuffer(b"".join([rows[i] for i in finer]), np.uint8).reshape(len(finer), -1), axis=1)
            parts.append(np.packbits(bits[:, 0::2] ^ bits[:, 1::2], axis=1).view(np.uint64))
        out.append((np.concatenate([own, finer]), np.concatenate(parts), len(own)))
    return out


def _screen(percent: int, fine: bool, closest: bool):
    """Pairs ``a, b, gap`` of a block pair that the windows let through; the rows of a block pair follow each other.

    Cells leave pairs of one region to that region; both skip pairs of one component. ``closest``
    gives each set outside the main component of its block its closest partner only.
    """
    r = 1 - percent / 100

    def passed(part: pa.Table) -> pa.RecordBatch:
        group, i, j, side, sid, comp, size, region, pivot = (part[c].to_numpy() for c in ("grp", "i", "j", "side", "sid", "component", "n", "region", "pivot"))
        far = part["far"].to_numpy(zero_copy_only=False).astype(float)
        classes = part["classes"].to_pylist()
        starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        found = [np.empty((3, 0), np.int64)]
        for lo, hi in zip(starts, np.append(starts[1:], len(group))):
            if (comp[lo:hi] == comp[lo]).all() or (not fine and (region[lo:hi] == region[lo]).all()):
                continue
            same = side[lo] == 2
            names, many = np.unique(comp[lo:hi], return_counts=True)
            main = names[many.argmax()]
            for rows, table, n_own in _folded(classes[lo:hi]):
                rows = rows + lo
                for x in np.flatnonzero(comp[rows] != main) if same else np.flatnonzero(side[rows] == 0):
                    me = rows[x]
                    ok = (comp[rows] != comp[me]) & (size[rows] * 100 >= size[me] * percent) & (size[me] * 100 >= size[rows] * percent)
                    if not same:
                        ok &= side[rows] == 1
                    elif not closest:  # pairs of two sets outside the main component come once
                        ok &= (comp[rows] == main) | (rows > me)
                    if not fine:
                        ok &= region[rows] != region[me]
                    if x >= n_own:  # two finer rows meet at their own level
                        ok[n_own:] = False
                    ok &= ~((pivot[rows] == pivot[me]) & (np.abs(far[rows] - far[me]) > r + 1e-9))
                    y = np.flatnonzero(ok)
                    if not len(y):
                        continue
                    # |x delta y| <= (|x| + |y|) (1 - t) / (1 + t)
                    gap = np.bitwise_count(table[y] ^ table[x]).sum(axis=1, dtype=np.int64)
                    near = gap * (100 + percent) <= (size[rows[y]] + size[me]) * (100 - percent)
                    y, gap = rows[y[near]], gap[near]
                    if closest and len(y) > 1:
                        best = np.lexsort((sid[y], gap))[:1]
                        y, gap = y[best], gap[best]
                    if len(y):
                        found.append(np.stack([np.maximum(sid[y], sid[me]), np.minimum(sid[y], sid[me]), gap]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return _batch("a long, b long, gap long", a=pairs[0], b=pairs[1], gap=pairs[2])

    def run(batches):
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([kept, table]) if kept is not None else table
            key = [table[c].to_numpy() for c in ("grp", "i", "j")]
            last = len(table) - int(np.argmin(np.append(np.logical_and.reduce([k == k[-1] for k in key])[::-1], False)))
            if last > 0:
                yield passed(table.slice(0, last))
            kept = table.slice(last)
        if kept is not None and len(kept):
            yield passed(kept)

    return run


def _met(rows: DataFrame, percent: int, fine: bool, closest: bool) -> DataFrame:
    """Screened pairs for rows ``grp, rows, sid, component, region, pivot, far, n, classes``."""
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    rows = rows.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("sid"), blocks).cast("int")})

    # block i meets every block j >= i; side 2 marks a block that meets itself
    def meet(j):
        me = F.col("block")
        return F.struct(F.least(me, j).alias("i"), F.greatest(me, j).alias("j"), F.when(j == me, 2).when(me < j, 0).otherwise(1).alias("side"))

    dealt = rows.withColumn("m", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), meet)))
    dealt = dealt.select("grp", "m.*", "sid", "component", "region", "pivot", "far", "n", "classes")
    dealt = dealt.repartition(shuffle_partitions(dealt.sparkSession), "grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    return dealt.mapInArrow(_screen(percent, fine, closest), "a long, b long, gap long")


def _mixed(rows: DataFrame, *keys: str) -> DataFrame:
    """Size of the groups ``grp`` that differ in each of the keys."""
    differ = [f(k).alias(f"{name}_{k}") for k in keys for name, f in (("lo", F.min), ("hi", F.max))]
    out = rows.groupBy("grp").agg(F.count("*").alias("rows"), *differ)
    for k in keys:
        out = out.filter(f"lo_{k} <> hi_{k}")
    return out.select("grp", "rows")


def _labelled(sets: DataFrame, labels: DataFrame) -> DataFrame:
    return sets.join(labels, sets["sid"] == labels["node"], "left").withColumn("component", F.coalesce("component", "sid")).drop("node")


def _inside(sets: DataFrame, labels: DataFrame, percent: int, closest: bool) -> DataFrame:
    """Open pairs of the regions; ``sets`` has ``sid, n, region, pivot, far, fine``."""
    state = written(_labelled(sets, labels).withColumn("grp", F.col("region")), "state")
    rows = state.join(_mixed(state, "component"), "grp").withColumnRenamed("fine", "classes")
    pairs = _met(rows, percent, True, closest)
    if not closest:
        return pairs.select("a", "b").distinct()
    both = pairs.union(pairs.select("b", "a", "gap"))
    return both.groupBy("a").agg(F.min_by("b", F.struct("gap", "b")).alias("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _across(shared: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Open pairs of two regions in the cells; ``sets`` has ``sid, n, classes, region, pivot, far``."""
    state = written(_labelled(sets, labels), "state")
    cells = shared.select(F.col("gram").alias("grp"), "sid").join(state.select("sid", "component", "region"), "sid")
    cells = written(cells, "cells")
    rows = cells.join(_mixed(cells, "component", "region"), "grp").select("grp", "rows", "sid").join(state, "sid")
    return _met(rows, percent, False, False).select("a", "b").distinct()


def _shared_grams(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of the first ``left`` sets (rows) and the others (columns); of all sets if there are no others."""
    rows, cols = left, len(sets) - left or left
    first = left if len(sets) > left else 0
    both = np.zeros((rows, cols), np.float32)
    grams, holder = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, holder = grams[order], holder[order]
    start = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    size = np.diff(np.append(start, len(grams)))
    for few in np.unique(size[(size > 1) & (size < DENSE)]):
        held = holder[start[size == few][:, None] + np.arange(few)]
        for part in np.array_split(held, 1 + held.size * few // PAIRS):
            x, y = np.repeat(part, few, axis=1).reshape(-1), np.tile(part, few).reshape(-1) - first
            ok = (x < rows) & (y >= 0)
            both += np.bincount(x[ok] * cols + y[ok], minlength=rows * cols).reshape(rows, cols).astype(np.float32)
    many = np.flatnonzero(size >= DENSE)
    for part in np.array_split(many, 1 + len(many) // 1024):
        table = np.zeros((len(sets), len(part)), np.float32)
        for k, m in enumerate(part):
            table[holder[start[m] : start[m] + size[m]], k] = 1
        both += table[:rows] @ table[first:].T
    return both


def _count_links(n: int, percent: int):
    """Rows ``sid, n_links`` of block pairs; the rows of one follow each other. Each set counts with its copies."""

    def counted(held: dict) -> pa.RecordBatch:
        rows = sorted(held.values(), key=lambda x: x[0] == 1)
        left = sum(side != 1 for side, *_ in rows)
        same = rows[0][0] == 2
        sids, copies = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
        size = np.array([len(r[3]) for r in rows])
        total = np.zeros(len(rows), np.int64)
        if same or 0 < left < len(rows):
            both = _shared_grams([r[3] for r in rows], left).astype(np.int64)
            other = slice(0, None) if same else slice(left, None)
            link = both * 100 >= percent * (size[:left, None] + size[None, other] - both)
            if same:
                np.fill_diagonal(link, False)
            total[:left] = link @ copies[other]
            if not same:
                total[left:] = copies[:left] @ link
        return _batch("sid long, n_links long", sid=sids, n_links=total)

    def run(batches):
        shingle, key, held = Shingler(n), None, {}
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for new, side, sid, copies, text in zip(keys, *(batch.column(i).to_pylist() for i in range(3, 6)), batch.column(6)):
                if new != key and held:
                    yield counted(held)
                    held = {}
                key = new
                if sid not in held:  # rows of one id and text may be repeated
                    held[sid] = side, sid, copies, shingle(text.as_py())
        if held:
            yield counted(held)

    return released(run)


def link_counts(docs: DataFrame, sets: DataFrame, labels: DataFrame, copies: DataFrame, n: int, percent: int) -> DataFrame:
    """``sid, n_links``: rows of other sets that each set of a component links with.

    ``sets`` has ``sid, row, th, n``, ``labels`` ``node, component`` and ``copies`` ``sid, copies``.
    """
    own = written(labels.join(sets.select(F.col("sid").alias("node"), "row", "th", "n"), "node").withColumnRenamed("node", "sid").join(copies, "sid"), "linked")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_GRAMS)).cast("int")
    groups = own.groupBy("component").agg(F.count("*").alias("sets"), F.sum("copies").alias("rows"), blocks.alias("blocks"))
    rows = own.join(groups, "component")
    # two sets of a component are linked with each other
    pairs = rows.filter("sets = 2").select("sid", (F.col("rows") - F.col("copies")).alias("n_links"))
    me = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    wanted = written(rows.filter("sets > 2").select("row", "th", "component", "sid", "copies", "blocks", me.alias("me")), "counted")

    def meet(j):
        i = F.col("me")
        return F.struct(F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), F.when(j == i, 2).when(i < j, 0).otherwise(1).alias("side"))

    dealt = _with_texts(docs, wanted).withColumn("m", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), meet)))
    dealt = dealt.select("component", "m.i", "m.j", "m.side", "sid", "copies", "text")
    dealt = dealt.repartition(shuffle_partitions(docs.sparkSession), "component", "i", "j").sortWithinPartitions("component", "i", "j")
    found = dealt.mapInArrow(_count_links(n, percent), "sid long, n_links long")
    return pairs.union(found).groupBy("sid").agg(F.sum("n_links").alias("n_links"))


def _members(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, count: bool = False) -> DataFrame:
    """``id, th, n, component`` of every row; ``th`` is a hash of the text, ``component`` the id of a set. ``count`` adds ``n_links``."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    own_id = F.col(id_col).cast("long")
    base = docs.select(own_id.alias("id"), F.coalesce(own_id, F.lit(NO_ID)).alias("row"), F.xxhash64(text).alias("th"), text.alias("text"))
    first = written(base.select("id", "th", "text").mapInArrow(_first_pass(n), _FIRST), "sets")
    members = first.filter("kind = 0").select("id", "th", "n", "sid")
    place = F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "th")
    sets = first.filter("kind = 0 and sid is not null").groupBy("sid").agg(F.min(place).alias("own"), F.first("n").alias("n"), F.first("classes").alias("classes"))
    sets = sets.select("sid", F.col("own.id").alias("row"), "own.th", "n", "classes")
    often = first.filter("kind = 1").groupBy("gram").agg(F.sum("count").alias("count"), F.min("sid").alias("low"))
    hot = _Hot(spark, often.orderBy(F.desc("count"), "gram").limit(HOT).collect())  # bounded, see above

    buckets = max(8, shuffle_partitions(spark))
    packed = base.select("text").mapInArrow(_cells(n, percent, hot, buckets), "bucket int, grams binary, sids binary")
    shared = packed.repartition(buckets, "bucket").mapInArrow(_share(hot), "gram long, sid long, pivot long")
    shared = written(shared, "shared")
    sets = written(sets.join(shared.select("sid").union(shared.select("pivot")).distinct(), "sid"), "shared-sets")
    where = sets.select("sid", "row", "th")

    # the nearest pivot of a set is the one it shares most cells with, among those the windows allow
    stars = shared.filter("sid <> pivot").groupBy(F.col("sid").alias("a"), F.col("pivot").alias("b")).agg(F.count("*").alias("cells"))
    stars = _worth_comparing(stars, sets, percent).groupBy("a").agg(F.max_by("b", F.struct("cells", -F.col("b"))).alias("b"))
    near = written(compared(base, where, stars, n, fine=True), "stars")
    linked = lambda pairs: pairs.filter((F.col("both") * 100 >= F.col("all") * percent) & (F.col("a") != F.col("b"))).select("a", "b")
    links = linked(near)
    # what a pivot joins is one component; chains of pivots are closed later
    labels = links.select(F.col("a").alias("node"), F.col("b").alias("component"))

    # regions: sets chained by a fair similarity to their pivots
    families = components(near.filter(F.col("both") * 100 >= F.col("all") * FAMILY).select("a", "b"))
    own = near.groupBy(F.col("a").alias("near_sid")).agg(F.max_by(F.struct("b", (1 - F.col("both") / F.col("all")).alias("far")), "b").alias("p"), F.first("fine").alias("fine"))
    state = sets.select("sid", "n", "classes").join(own, F.col("sid") == F.col("near_sid"), "left")
    state = state.join(families.select("node", F.col("component").alias("region")), F.col("sid") == F.col("node"), "left")
    fine = F.when(F.col("region").isNotNull(), F.col("fine"))
    state = state.select("sid", "n", "classes", F.coalesce("region", "sid").alias("region"), F.coalesce("p.b", "sid").alias("pivot"), F.coalesce("p.far", F.lit(0.0)).alias("far"), fine.alias("fine"))
    state = written(state, "regions")

    tried = near.select("a", "b")

    def check(pairs):
        nonlocal links, tried
        rest = written(pairs.join(tried, ["a", "b"], "left_anti"), "open")
        if rest.isEmpty():
            return False
        links = links.union(linked(written(compared(base, where, rest, n), "checked")))
        tried = tried.union(rest)
        return True

    family = state.filter("fine is not null").drop("classes")
    while check(_inside(family, labels, percent, closest=True)):
        labels = components(links)
    check(_inside(family, labels, percent, closest=False).union(_across(shared, state.drop("fine"), labels, percent)).distinct())
    labels = components(links)

    named = members.join(labels, members["sid"] == labels["node"], "left").withColumn("component", F.coalesce("component", "sid")).drop("node")
    if count:
        copies = members.filter("sid is not null").groupBy("sid").agg(F.count("*").alias("copies"))
        counts = copies.join(link_counts(base, sets, labels, copies, n, percent), "sid", "left")
        counts = counts.select("sid", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
        named = named.join(counts, "sid", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return written(named.drop("sid"), "named")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``, and ``n_links``, the number of other rows it links with.

    Sets are counted and named by 64-bit hashes, and so are the links; those that join components are checked
    on the n-grams themselves.
    """
    named = _members(docs, id_col, text_col, n, percent, count=True)
    lowest = named.filter("component is not null").groupBy("component").agg(F.min("id").alias("lowest"))
    return named.join(lowest, "component", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("lowest", "id").alias("component_id"), "n_links"
    )


@query("op4_ngram_jaccard")
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document at a Jaccard similarity of 0.8."""
    return jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one with the smallest id; equal rows of id and text stay once.

    A document is its id and its text, so an id that stands on several texts loses only those that belong
    to a component with a smaller one. Documents without words or without an id stay.
    """
    named = _members(docs, "doc_id", "text", N, PERCENT).filter("component is not null and id is not null")
    kept = named.groupBy("component").agg(F.min(F.struct("id", "th")).alias("low"))
    gone = named.join(kept, "component").filter(F.struct("id", "th") != F.col("low")).select(F.col("id").alias("gone_id"), F.col("th").alias("gone_th")).distinct()
    own = docs["doc_id"].cast("long")
    left = docs.join(gone, (own == gone["gone_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["gone_th"]), "left_anti")
    known = left.filter("doc_id is not null and text is not null")
    return known.dropDuplicates(["doc_id", "text"]).select(*docs.columns).union(left.filter("doc_id is null or text is null"))
