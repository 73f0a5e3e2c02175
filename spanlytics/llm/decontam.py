"""Benchmark decontamination by latent semantic retrieval.

1. *Counts.* Document frequencies of hashed words over all documents give the idf weights.
2. *Latent space.* A randomised SVD of TF-IDF passages: each task turns its passages into a sparse
   matrix A and returns its part of A'A X for a random test matrix X; the parts are added on the
   cluster and a small factorisation on the driver gives the leading right singular vectors (sizes
   fixed by ``FEATURES`` and ``RANK``). The passages are those of all documents and all items, in the
   partitions of the input.
3. *Search.* Sliding windows of every document, of the length class of each item, are projected and
   compared by cosine with the items. Every item part has a bar of its own: the cosine that all but
   ``MISSED`` of the windows reach which hold just the share of its words that step 4 asks for (``LOOSE``
   with an answer, else ``STRICT``) among running words. The running words are those of all documents,
   cut into windows; the cosines of each part are counted in ``BINS`` bins, summed over the cluster.
4. *Check.* Candidates with enough words of the item (a bound that loses nothing) are accepted by the
   longest common subsequence of window and item words: a share of ``STRICT`` of the item, or
   ``LOOSE`` if the item has an answer and the window holds it.

Items are taken in blocks of ``ITEM_BLOCK``, so the side sent to the tasks stays bounded.

Defined results: a null or empty text leaks nothing; items without words match nothing; repeated rows
and repeated items give their own rows; empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spanlytics.llm.common import fresh, query, read, released

FEATURES = 1 << 14
RANK = 64
OVERSAMPLE = 16
ITEM_BLOCK = 4096
PASSAGE = 64
STRICT = 0.75
LOOSE = 0.5
#: Choices of the words of an item part that a window still holds, the share of windows below the bar, bins of a cosine.
DRAWS = 64
MISSED = 0.03
BINS = 512
#: Length classes of item parts; a window has five quarters of that length and moves by one.
CLASSES = (8, 12, 16, 24, 32, 48, 64)
LONGEST = CLASSES[-1]
#: Texts are laid out in rows of so many words, a common multiple of all steps.
STRIP = 96
CHUNK_WORDS = 1 << 14
#: Cells of words, for an upper bound of the words a window shares with an item.
CELLS = 1 << 10
PAIRS = 1 << 16
#: A bar is at least this cosine.
LOWEST_BAR = np.float32(0.01)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MARKS = ".,;:!?()[]\"'#*$%&|<>"
LEAK = "array<struct<item_id: long, cosine: double, lcs_ratio: double, from_word: long, to_word: long>>"


def _string_hashes(strings: pa.LargeStringArray) -> np.ndarray:
    """A 64-bit hash of each string, 0 for the empty one."""
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    size = np.diff(ends)
    out = np.zeros(len(strings), np.uint64)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    starts = (ends[:-1] - ends[0])[some]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(size.max()), _BASE))
        h = np.add.reduceat(raw * powers[np.arange(len(raw)) - np.repeat(starts, size[some])], starts)
        for shift, factor in ((32, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB), (32, 0xFF51AFD7ED558CCD)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    out[some] = h | np.uint64(1)
    return out


def words_of(texts: pa.Array) -> list[np.ndarray]:
    """Hashes of the words of each text: cut at white space, lower case, marks at both ends left out.

    Every distinct piece of a batch is looked at once.
    """
    pieces = pc.utf8_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    coded = pc.dictionary_encode(pieces.flatten())
    known = _string_hashes(pc.utf8_lower(pc.utf8_trim(coded.dictionary, characters=_MARKS)))
    h = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.empty(0, np.uint64)
    ends = np.cumsum(np.concatenate([[0], h != 0]))[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]
    h = h[h != 0]
    return [h[x:y] for x, y in zip(ends[:-1], ends[1:])]


def words_in(text: str | None) -> np.ndarray:
    return words_of(pa.array([text], pa.string()))[0]


def feature_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64)


def _document_frequency(batches):
    total, docs, last = np.zeros(FEATURES, np.int64), 0, np.empty(FEATURES, np.int64)
    for batch in batches:
        for w in words_of(batch.column(0)):
            docs += 1
            f = feature_of(w)
            at = np.arange(len(f))
            last[f] = at
            total[f[last[f] == at]] += 1  # each feature of a text once
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"f": pa.array(np.append(used, -1), pa.int32()), "n": pa.array(np.append(total[used], docs), pa.int64())})


def idf_weights(docs: DataFrame, text: str = "text") -> np.ndarray:
    counts = docs.select(text).mapInArrow(_document_frequency, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()  # FEATURES rows at most
    df = np.zeros(FEATURES)
    total = float(counts.loc[counts.f < 0, "n"].sum())
    known = counts[counts.f >= 0]
    df[known.f] = known.n
    return np.log((1.0 + total) / (1.0 + df)) + 1.0


def _add_gram(texts: list[np.ndarray], x: np.ndarray, weights: np.ndarray, out: np.ndarray) -> None:
    """Adds the passages of ``texts`` to ``out``; ``x`` has the idf in it, ``out`` has still to get it.

    A passage is two neighbouring halves of ``PASSAGE`` words, or the one half of a short text.
    """
    step = PASSAGE // 2
    halves = np.array([-(-len(w) // step) for w in texts])
    first = np.cumsum(halves) - halves
    layout = np.full((int(halves.sum()), step), FEATURES, np.int64)
    for w, at in zip(texts, first):
        layout.reshape(-1)[at * step : at * step + len(w)] = feature_of(w)
    z = x[layout].sum(axis=1)
    starts = np.ones(len(layout), bool)
    starts[(first + halves - 1)[halves > 1]] = False  # the last half of a text starts no passage, if it is not its only one
    starts = np.flatnonzero(starts)
    ends = np.minimum(starts + 1, len(layout) - 1)
    alone = np.zeros(len(layout), bool)
    alone[first[halves == 1]] = True
    single = alone[starts]
    # squared norms: each occurrence of a feature counts its weight times how often the passage has it
    words = np.sort(np.hstack([layout[starts], np.where(single[:, None], FEATURES, layout[ends])]), axis=1).reshape(-1)
    at = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (np.arange(1, len(words)) % PASSAGE == 0)])
    times = np.diff(np.append(at, len(words)))
    norm = np.bincount(at // PASSAGE, (weights[words[at]] * times) ** 2, minlength=len(starts))
    sums = (z[starts] + np.where(single[:, None], 0, z[ends])) / np.maximum(norm, 1e-12)[:, None].astype(np.float32)
    back = np.zeros_like(z)
    back[starts] = sums  # each half starts one passage at most
    back[ends[~single]] += sums[~single]
    order = np.argsort(layout, axis=None, kind="stable")
    features = layout.reshape(-1)[order]
    at = np.flatnonzero(np.r_[True, features[1:] != features[:-1]])
    # along rows of a direction, as sums over columns are several times slower
    out[features[at]] += np.add.reduceat(np.take(np.ascontiguousarray(back.T), order // step, axis=1), at, axis=1).T


def _gram_part(idf: np.ndarray, test):
    """A'A X of the passages of a task, as rows of feature blocks."""

    def run(batches):
        x = test.value * idf[:, None].astype(np.float32)
        x = np.vstack([x, np.zeros((1, x.shape[1]), np.float32)])  # the word of empty places
        out, weights = np.zeros_like(x), np.append(idf, 0.0)
        for batch in batches:
            held, size = [], 0
            for w in words_of(batch.column(0)):
                held.append(w)
                size += len(w)
                if size >= CHUNK_WORDS:
                    _add_gram(held, x, weights, out)
                    held, size = [], 0
            if size:
                _add_gram(held, x, weights, out)
        out = out[:-1] * idf[:, None].astype(np.float32)
        size = FEATURES // 64
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(64), pa.int32()), "part": [out[i * size : (i + 1) * size].tobytes() for i in range(64)]})

    return released(run)


def _add_parts(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(p, np.float32).astype(np.float64) for p in table["part"].to_pylist())
    return pa.table({"block": table["block"][:1], "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _times_gram(passages: DataFrame, idf: np.ndarray, x: np.ndarray) -> np.ndarray:
    test = passages.sparkSession.sparkContext.broadcast(np.ascontiguousarray(x, np.float32))
    parts = passages.mapInArrow(_gram_part(idf, test), "block int, part binary")
    rows = parts.groupBy("block").applyInArrow(_add_parts, "block int, part binary").collect()  # 64 blocks of fixed size
    out = np.zeros(x.shape)
    for r in rows:
        piece = np.frombuffer(r["part"], np.float32).reshape(-1, x.shape[1])
        out[r["block"] * len(piece) : (r["block"] + 1) * len(piece)] = piece
    return out


def latent_space(passages: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Word vectors: idf times leading right singular vectors, each direction scaled to unit variance."""
    width = rank + OVERSAMPLE
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((FEATURES, width)))[0]
    x = np.linalg.qr(_times_gram(passages, idf, x))[0]  # a power step
    y = _times_gram(passages, idf, x)
    values, vectors = np.linalg.eigh((x.T @ y + y.T @ x) / 2)
    lead = np.argsort(values)[::-1][:rank]
    lead = lead[values[lead] > 1e-6 * max(values.max(), 1e-12)]
    basis = x @ vectors[:, lead]
    return (idf[:, None] * basis / np.sqrt(values[lead])).astype(np.float32)


@dataclass
class Index:
    """Parts of benchmark items by length class, with their latent vectors; the last word vector is zero."""

    vectors: np.ndarray
    ids: list
    parts: list[np.ndarray]
    answers: list[np.ndarray]
    places: list[dict[int, int]]
    by_class: dict[int, np.ndarray]
    latent: dict[int, np.ndarray]
    bars: dict[int, np.ndarray]
    members: np.ndarray


def class_of(length: int) -> int:
    return next((m for m in CLASSES if length <= m), LONGEST)


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def _draws(part: np.ndarray, kept: int, m: int, vectors: np.ndarray) -> np.ndarray:
    """Sums of word vectors for ``DRAWS`` choices of ``kept`` words of a part."""
    held = np.random.default_rng([m, *part[:4].tolist()]).random((DRAWS, len(part))).argsort(axis=1) < kept
    return held.astype(np.float32) @ vectors[feature_of(part)]


def _cosines(index: Index, shares: list[float], texts):
    """Numbers of parts and the cosines of windows with them. Each of ``texts`` (lists of features of whole documents) is cut
    by itself, its last windows go on at its beginning; a window of a part is filled up with one of the choices of its words."""
    by_size = defaultdict(list)
    for m, ks in index.by_class.items():
        for at, k in enumerate(ks):
            kept = int(np.ceil(shares[k] * len(index.parts[k])))
            by_size[m, m + m // 4 - kept].append((k, index.latent[m][at], _draws(index.parts[k], kept, m, index.vectors)))
    sides = {key: ([k for k, _, _ in rows], np.stack([x for _, x, _ in rows]), np.stack([d for _, _, d in rows], axis=1)) for key, rows in by_size.items()}
    for docs in texts:
        sizes = np.array([len(w) for w in docs])
        z = index.vectors[np.concatenate([np.resize(w, len(w) + LONGEST) for w in docs])]
        begin = np.cumsum(sizes + LONGEST) - sizes - LONGEST
        first = np.array([w.sum() for w in docs])  # of the choices, so that short texts do not all meet the same ones
        sums = np.concatenate([np.zeros((1, z.shape[1])), np.cumsum(z, axis=0, dtype=np.float64)])
        for (m, size), (ks, latent, drawn) in sides.items():
            step = m + m // 4
            many = -(-sizes // step)
            number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            choice = (np.repeat(first, many) + number) % DRAWS
            order = np.argsort(choice, kind="stable")
            at, cut = (np.repeat(begin, many) + number * step)[order], np.searchsorted(choice[order], np.arange(DRAWS + 1))
            run = (sums[at + size] - sums[at]).astype(np.float32)
            both = np.empty((len(at), len(ks)), np.float32)
            for own, lo, hi in zip(drawn, cut[:-1], cut[1:]):
                both[lo:hi] = run[lo:hi] @ own.T
            which = choice[order]
            square = np.einsum("dij,dij->di", drawn, drawn)[which] + 2 * both + np.einsum("ij,ij->i", run, run)[:, None]
            yield ks, (run @ latent.T + np.einsum("dij,ij->di", drawn, latent)[which]) / np.sqrt(np.maximum(square, 1e-12))


def _running(batches):
    """Lists of the features of the words of documents, of about four times ``CHUNK_WORDS`` words."""
    held, size = [], 0
    for batch in batches:
        for w in filter(len, words_of(batch.column(0))):
            held.append(feature_of(w))
            size += len(w)
            if size >= 4 * CHUNK_WORDS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _cosine_counts(held, shares: list[float]):
    def run(batches):
        index = held.value
        counts = np.zeros((len(index.parts), BINS), np.int64)
        for ks, cosine in _cosines(index, shares, _running(batches)):
            bins = np.clip(((cosine + 1) * (BINS / 2)).astype(np.int64), 0, BINS - 1) + np.arange(len(ks)) * BINS
            counts[ks] += np.bincount(bins.reshape(-1), minlength=len(ks) * BINS).reshape(len(ks), BINS)
        part, bins = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "bin": pa.array(bins, pa.int32()), "n": pa.array(counts[part, bins], pa.int64())})

    return released(run)


def with_bars(docs: DataFrame, text: str, index: Index, strict: float = STRICT, loose: float = LOOSE) -> Index:
    """``index`` with the bars of its parts from the running words of all documents; without any word the bars are the lowest."""
    shares = [loose if len(a) else strict for a in index.answers]
    held = docs.sparkSession.sparkContext.broadcast(index)
    counts = docs.select(text).mapInArrow(_cosine_counts(held, shares), "part int, bin int, n long").groupBy("part", "bin").agg(F.sum("n").alias("n"))
    one = Window.partitionBy("part")
    so_far = F.sum("n").over(one.orderBy("bin"))
    counts = counts.select("part", "bin", so_far.alias("so_far"), F.sum("n").over(one).alias("total"))
    rows = counts.filter(F.col("so_far") > MISSED * F.col("total")).groupBy("part").agg(F.min("bin").alias("bin")).collect()  # a row for each part
    low = np.zeros(len(index.parts), np.float32)
    low[[r["part"] for r in rows]] = [r["bin"] * 2 / BINS - 1 for r in rows]
    return replace(index, bars={m: np.maximum(low[ks], LOWEST_BAR) for m, ks in index.by_class.items()})


def _cell_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) & (CELLS - 1)


def _bits(rows: np.ndarray, cells: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows the bits of its cells."""
    held = np.zeros((n, CELLS), bool)
    held[rows, cells] = True
    return np.packbits(held, axis=1).view(np.uint64)


def _members(parts: list[np.ndarray]) -> np.ndarray:
    """For each part the bits of the cells of its words."""
    bits = [_bits(np.zeros(len(p), np.int64), _cell_of(p), 1) for p in parts]
    return np.concatenate([np.empty((0, CELLS // 64), np.uint64), *bits])


def build_index(items: list, vectors: np.ndarray) -> Index:
    """``items``: (item_id, text, answer or None); texts longer than ``LONGEST`` words are cut in parts. The bars are the lowest."""
    ids, parts, answers = [], [], []
    for item_id, text, answer in items:
        w = words_in(text)
        for i in range(0, len(w), LONGEST):
            piece = w[i : i + LONGEST] if len(w) - i >= LONGEST // 2 or i == 0 else w[-LONGEST:]
            ids.append(item_id), parts.append(piece), answers.append(words_in(answer))
    group = defaultdict(list)
    for k, p in enumerate(parts):
        group[class_of(len(p))].append(k)
    by_class = {m: np.array(ks) for m, ks in group.items()}
    latent = {m: _unit(np.stack([vectors[feature_of(parts[k])].sum(axis=0) for k in ks])) for m, ks in by_class.items()}
    bars = {m: np.full(len(ks), LOWEST_BAR) for m, ks in by_class.items()}
    vectors = np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)])  # the word of empty places
    return Index(vectors, ids, parts, answers, [_places(p) for p in parts], by_class, latent, bars, _members(parts))


def _places(part: np.ndarray) -> dict[int, int]:
    """Each word of ``part`` with the bits of its places."""
    at: dict[int, int] = defaultdict(int)
    for i, w in enumerate(part.tolist()):
        at[w] |= 1 << i
    return dict(at)


def lcs_length(places: dict[int, int], length: int, window: np.ndarray) -> int:
    """Longest common subsequence with a part of ``length`` words, one bit row for each shared word."""
    full = row = (1 << length) - 1
    for m in filter(None, map(places.get, window.tolist())):
        hit = row & m
        row = ((row + hit) | (row - hit)) & full
    return length - row.bit_count()


def _holds(window: np.ndarray, run: np.ndarray) -> bool:
    if not len(run) or len(run) > len(window):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(window, len(run)) == run).all(axis=1).any())


def _blocks(z: np.ndarray, classes) -> dict[int, np.ndarray]:
    """Sums over steps of words for each length class, the coarse ones from the fine ones."""
    eight, twelve = z[0::2] + z[1::2], z[0::3] + z[1::3]
    twelve += z[2::3]
    out = {8: eight, 12: twelve}
    for m in (16, 24, 32, 48, 64):
        out[m] = out[m // 2][0::2] + out[m // 2][1::2]
    return {m: out[m] for m in classes}


def leaks_of(texts: pa.Array, index: Index, cosine: float | None = None, strict: float = STRICT, loose: float = LOOSE) -> list[list[dict]]:
    """For each text the best window of every item it leaks; ``cosine`` stands for the bars of the index."""
    # words of a part in one cell may all be in a window that holds this cell
    needed = np.array([((loose if len(a) else strict) - 1) * len(p) for a, p in zip(index.answers, index.parts)]) + np.bitwise_count(index.members).sum(axis=1)
    out: list[dict] = []
    held: list[np.ndarray] = []
    size = 0

    def search():
        strips = [-(-len(w) // STRIP) for w in held]
        first = np.concatenate([[0], np.cumsum(strips)]) * STRIP
        layout = np.full(max(int(first[-1]), STRIP), FEATURES, np.int64)
        cells = np.full(len(layout), -1, np.int64)
        for w, at in zip(held, first):
            layout[at : at + len(w)] = feature_of(w)
            cells[at : at + len(w)] = _cell_of(w)
        word = np.flatnonzero(cells >= 0)
        sums = _blocks(index.vectors[layout], index.by_class)
        for m, ks in index.by_class.items():
            z, step = sums[m], m // 4
            z = z[:-4] + z[1:-3] + z[2:-2] + z[3:-1] + z[4:]
            bars = index.bars[m] if cosine is None else np.full(len(ks), cosine, np.float32)
            near = z @ (index.latent[m] / bars[:, None]).T
            norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z)), 1e-12)
            rows, cols = np.divmod(np.flatnonzero(near >= norm[:, None]), len(ks))
            bits = _bits(word // step, cells[word], len(layout) // step)
            bits = bits[:-4] | bits[1:-3] | bits[2:-2] | bits[3:-1] | bits[4:]
            enough = np.zeros(len(rows), bool)
            for x in range(0, len(rows), PAIRS):
                c = ks[cols[x : x + PAIRS]]
                shared = np.bitwise_count(bits[rows[x : x + PAIRS]] & index.members[c]).sum(axis=1, dtype=np.int64)
                enough[x : x + PAIRS] = shared >= needed[c]
            for i, j in zip(rows[enough], cols[enough]):
                # a window may reach into the next text; only the words of its own text count
                doc = int(np.searchsorted(first, i * step, side="right")) - 1
                start = int(i * step - first[doc])
                window = held[doc][start : start + m + step]
                k = ks[j]
                part = index.parts[k]
                if len(window) < loose * len(part):
                    continue
                share = lcs_length(index.places[k], len(part), window) / len(part)
                if share >= strict or (share >= loose and _holds(window, index.answers[k])):
                    item, best = index.ids[k], out[len(out) - len(held) + doc]
                    found = {"item_id": item, "cosine": float(near[i, j] * bars[j] / norm[i]), "lcs_ratio": share, "from_word": start, "to_word": start + len(window)}
                    if item not in best or (share, found["cosine"]) > (best[item]["lcs_ratio"], best[item]["cosine"]):
                        best[item] = found

    for w in words_of(texts):
        out.append({})
        held.append(w)
        size += len(w)
        if size >= CHUNK_WORDS:
            search()
            held, size = [], 0
    if size:
        search()
    return [[found[k] for k in sorted(found, key=lambda x: (x is None, x))] for found in out]


_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs_ratio", pa.float64()), ("from_word", pa.int64()), ("to_word", pa.int64())]))


def _leaks_udf(held):
    @F.arrow_udf(LEAK)
    def run(text: pa.Array) -> pa.Array:
        return pa.array(leaks_of(text, held.value), _LEAK)

    return run


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "leaks") -> DataFrame:
    """``docs`` with an array of leaked items; ``benchmark`` has ``item_id, text`` and may have ``answer``."""
    spark = docs.sparkSession
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text"), answer.alias("answer"))
    n_items, n_docs = items.count(), docs.count()
    if not n_items or not n_docs:
        return docs.withColumn(out, F.array().cast(LEAK))
    idf = idf_weights(docs, text)

    fit = docs.select(F.col(text).alias("passage")).union(items.select("item_text"))
    vectors = latent_space(fit, idf)
    blocks = -(-n_items // ITEM_BLOCK)
    columns = []
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == b)
        rows = [(r["item_id"], r["item_text"], r["answer"]) for r in part.collect()]  # about ITEM_BLOCK rows
        index = with_bars(docs, text, build_index(rows, vectors))
        columns.append(_leaks_udf(spark.sparkContext.broadcast(index))(F.col(text)))
    return docs.withColumn(out, columns[0] if blocks == 1 else F.concat(*columns))


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked benchmark item of every document, with its best window."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_leaks(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.lcs_ratio", "leak.cosine", "leak.from_word", "leak.to_word")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with their own columns."""
    (name,) = fresh(docs, "leaks")
    return with_leaks(docs, benchmark, out=name).filter(F.size(name) == 0).drop(name)
