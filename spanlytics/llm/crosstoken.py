"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how common each pair is.

A byte-level BPE (A) and a piece BPE (B) encode the same text. Places where tokens of both end cut the
tokens into groups; all pairs of tokens inside a group are linked.

1. *Tokens.* Rows are taken in units (at most ``UNIT_TOKENS`` tokens of A, or one row). Texts are cut
   before every space that follows something other than white space: no pre-token of A and no piece of
   B crosses such a place (the vocabulary of B is checked for it), so each distinct chunk of a unit is
   encoded once and the tokens of a text are put together from its chunks.
2. *Diagonal run skipping.* The ends of both token lists are compared at the current index shift. Where
   they agree, the stretch compared doubles until it differs, then halves; so a one-to-one stretch of n
   groups costs about 2 log n comparisons of slices. An irregular group is resolved by stepping the side
   that lags behind until the ends meet, which gives the next shift.
3. *Counts.* A unit lists its distinct linked pairs with the number of its documents that hold them.
   Built-in aggregates add them up over all units and find the best count of each A token; the counts
   go back to the units by an equi-join on the pair, and every document adds up its own links.

A unit sends a pair once, however often it stands there, so very common pairs are no hot keys; a unit is
named by task and number, and is written once before both branches read it.

Defined results: a null or empty text, and a text that either tokenizer doesn't give back byte for byte
behind one space (such as one with U+2581), has no tokens: zeros and an empty ``groups_sha256``. Special
tokens are ordinary text. Null and repeated ids are carried through, one output row for each input row,
and every row counts as a document of its own; ties for the best count all count; an empty table gives an
empty result. Only the id and the text column are read. A very long text is one unit.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spanlytics.llm.common import query, read, written

#: Tokens of A after which a unit ends.
UNIT_TOKENS = 2_000_000
#: Chunks that are encoded in one string.
TOGETHER = 500
#: Groups with more links than this are counted by distinct tokens instead of link by link.
WIDE = 64

_BREAK = re.compile(r"(?<=\S) ")
_UNIT = (
    "unit string, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>,"
    " digests array<string>, sizes array<int>, links binary, a array<int>, b array<int>, docs array<int>"
)
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class TokenizerPair:
    """Paths of the two vocabularies, and what each process builds from them once."""

    def __init__(self, byte_level: str, pieces: str):
        self.byte_level, self.pieces = byte_level, pieces
        self._open: tuple | None = None

    def __getstate__(self):
        return {"byte_level": self.byte_level, "pieces": self.pieces, "_open": None}

    def _opened(self):
        if self._open is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            import sentencepiece
            from tokenizers import Tokenizer

            a = Tokenizer.from_file(self.byte_level)
            a.encode_special_tokens = True
            b = sentencepiece.SentencePieceProcessor(model_file=self.pieces)
            self._open = a, b, _bytes_of_a(a), _bytes_of_b(b)
            # a piece with a space behind other characters would cross the places where texts are cut
            self.whole = any(b" " in t.lstrip(b" ") for t in self._open[3])
        return self._open

    @property
    def token_bytes(self) -> tuple[list[bytes], list[bytes]]:
        return self._opened()[2:]

    def chunks_of(self, text: str) -> list[str]:
        """Parts of the text; each stands behind one space of ``" " + text``."""
        self._opened()
        return [text] if self.whole else _BREAK.split(text)

    def encode(self, chunks: list[str]) -> tuple[_Side, _Side, np.ndarray]:
        """Ids of A and of B of every chunk behind one space, and whether both give these bytes back."""
        # a chunk that ends with white space ends its text, and stays alone
        joined = [k for k, c in enumerate(chunks) if c and not c[-1].isspace() and not self.whole]
        alone = sorted(set(range(len(chunks))) - set(joined))
        groups = [joined[i : i + TOGETHER] for i in range(0, len(joined), TOGETHER)] + [[k] for k in alone]
        side_a, side_b, fine, again = _Side(len(chunks)), _Side(len(chunks)), np.ones(len(chunks), bool), []
        for own, a, b, same in self._encoded(groups, chunks):
            if same and side_a.put(own, a[0], a[1], chunks) and side_b.put(own, b[0], b[1], chunks):
                continue
            again += [[k] for k in own]
        # in a group that was not given back every chunk is looked at by itself
        for own, a, b, same in self._encoded(again, chunks):
            side_a.put_one(own[0], a[0])
            side_b.put_one(own[0], b[0])
            fine[own[0]] = same
        return side_a.done(), side_b.done(), fine

    def _encoded(self, groups: list[list[int]], chunks: list[str]):
        a, b, bytes_a, bytes_b = self._opened()
        texts = ["".join([" " + chunks[k] for k in own]) for own in groups]
        first = a.encode_batch(texts, add_special_tokens=False)
        # B puts the first space by itself, but not before nothing
        second = b.encode([t[1:] for t in texts], num_threads=1)
        for own, text, x, y in zip(groups, texts, first, second):
            x, y = x.ids, y or [b.piece_to_id("▁")]
            parts = [bytes_a[i] for i in x], [bytes_b[i] for i in y]
            want = text.encode("utf-8", "surrogatepass")
            yield own, (x, parts[0]), (y, parts[1]), b"".join(parts[0]) == want == b"".join(parts[1])


def _bytes_of_a(tokenizer) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary, whose entries write each byte as a printable character."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)) - set(printable))
    byte = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(others)}
    names = tokenizer.get_vocab(with_added_tokens=False)
    table = [b""] * (max(names.values(), default=-1) + 1)
    for name, i in names.items():
        table[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
    return table


def _bytes_of_b(model) -> list[bytes]:
    out = []
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        out.append(bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode())
    return out


def irregular_groups(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """Groups of the ends ``a`` and ``b`` that are not one to one: (first a, first b, count of a, count of b).

    Both lists rise and end with the same number. All other groups hold one token of each side.
    """
    out, i, j, n = [], 0, 0, len(a)
    while i < n:
        if a[i] == b[j]:
            i, j, width = i + 1, j + 1, 1
            while i < n and a[i : i + width] == b[j : j + width]:
                i, j, width = i + width, j + width, 2 * width
            while width > 1 and i < n:
                width //= 2
                if a[i : i + width] == b[j : j + width]:
                    i, j = i + width, j + width
            continue
        i0, j0, x, y = i, j, a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
        out.append((i0, j0, i - i0, j - j0))
    return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + count - 1`` of every pair, one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def _packed(*parts: np.ndarray) -> bytes:
    planes = np.concatenate(parts).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class _Side:
    """Ids of the distinct chunks of one tokenizer, one after the other."""

    def __init__(self, n: int):
        self.count, self.start = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.parts: list[np.ndarray] = []
        self.size = 0

    def put(self, own: list[int], ids: list[int], parts: list[bytes], chunks: list[str]) -> bool:
        """Ids of several chunks encoded together; false if a token crosses from one to the next."""
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        stops = np.cumsum([len(chunks[k].encode("utf-8", "surrogatepass")) + 1 for k in own])
        at = np.searchsorted(ends, stops)
        if not (ends[np.minimum(at, len(ends) - 1)] == stops).all():
            return False
        counts = np.diff(at, prepend=-1)
        self.count[own], self.start[own] = counts, self.size + np.cumsum(counts) - counts
        self._add(ids)
        return True

    def put_one(self, chunk: int, ids: list[int]) -> None:
        self.count[chunk], self.start[chunk] = len(ids), self.size
        self._add(ids)

    def _add(self, ids: list[int]) -> None:
        self.parts.append(np.array(ids, np.int64))
        self.size += len(ids)

    def done(self) -> _Side:
        self.ids = np.concatenate(self.parts or [np.empty(0, np.int64)])
        return self

    def of(self, chunks: np.ndarray) -> np.ndarray:
        return self.ids[_ranges(self.start[chunks], self.count[chunks])]


class _Names:
    """Decimal ids with the separators of the digest."""

    def __init__(self, size_a: int, size_b: int):
        self.a = np.array([f"{i}{s}" for s in ",|" for i in range(size_a)], object)
        self.b = np.array([f"{i}{s}" for s in ",;" for i in range(size_b)], object)
        self.size_a, self.size_b = size_a, size_b

    def digest(self, a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> str:
        end_a, end_b = np.cumsum(p), np.cumsum(q)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[end_a - 1] = last_b[end_b - 1] = 1
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + np.repeat(end_b - q, p)] = self.a[a + last_a * self.size_a]
        out[np.arange(len(b)) + np.repeat(end_a, q)] = self.b[b + last_b * self.size_b]
        return hashlib.sha256("".join(out.tolist())[:-1].encode()).hexdigest()


def _links(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, size_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs ``a * size_b + b`` and how often each is meant (pairs may repeat)."""
    start_a, start_b = np.cumsum(p) - p, np.cumsum(q) - q
    wide = p * q > WIDE
    use = np.where(wide, 0, p)
    at_a = _ranges(start_a, use)
    times = np.repeat(q, use)
    keys = np.repeat(a[at_a], times) * size_b + b[_ranges(np.repeat(start_b, use), times)]
    parts, weights = [keys], [np.ones(len(keys), np.int64)]
    for g in np.flatnonzero(wide).tolist():
        x, m = np.unique(a[start_a[g] : start_a[g] + p[g]], return_counts=True)
        y, n = np.unique(b[start_b[g] : start_b[g] + q[g]], return_counts=True)
        parts.append((x[:, None] * size_b + y).ravel())
        weights.append((m[:, None] * n).ravel())
    return np.concatenate(parts), np.concatenate(weights)


class _Unit:
    def __init__(self, pair: TokenizerPair):
        self.pair = pair
        self.chunks: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.size = 0

    def take(self, row_id, text: str | None) -> None:
        number = self.chunks
        parts = self.pair.chunks_of(text) if text else []
        self.rows.append((row_id, text, np.array([number.setdefault(c, len(number)) for c in parts], np.int64)))
        self.size += len(text or "") // 3 + 1

    def row(self, name: str, names: _Names) -> dict:
        """One row for the unit: figures and links of its documents, and its distinct pairs."""
        bytes_a, bytes_b = self.pair.token_bytes
        side_a, side_b, fine = self.pair.encode(list(self.chunks))
        long_a, long_b = np.array(list(map(len, bytes_a))), np.array(list(map(len, bytes_b)))
        n_a, n_b, n_groups, n_links, digests = [], [], [], [], []
        owner, keys, weights = [], [], []
        for k, (_, text, chunks) in enumerate(self.rows):
            a, b = side_a.of(chunks), side_b.of(chunks)
            if not fine[chunks].all():
                want = b" " + text.encode("utf-8", "surrogatepass")
                if b"".join([bytes_a[i] for i in a]) != want or b"".join([bytes_b[i] for i in b]) != want:
                    a = b = a[:0]
            if len(a):
                odd = np.array(irregular_groups(np.cumsum(long_a[a]).tolist(), np.cumsum(long_b[b]).tolist()), np.int64).reshape(-1, 4)
                p = np.ones(len(a) - int((odd[:, 2] - 1).sum()), np.int64)
                q = p.copy()
                at = odd[:, 0] - (np.cumsum(odd[:, 2] - 1) - (odd[:, 2] - 1))
                p[at], q[at] = odd[:, 2], odd[:, 3]
                own, weight = _links(a, b, p, q, len(bytes_b))
                owner.append(np.full(len(own), k))
                keys.append(own)
                weights.append(weight)
                digests.append(names.digest(a, b, p, q))
                n_groups.append(len(p))
                n_links.append(int((p * q).sum()))
            else:
                digests.append("")
                n_groups.append(0)
                n_links.append(0)
            n_a.append(len(a))
            n_b.append(len(b))
        empty = [np.empty(0, np.int64)]
        listed = pa.array(np.concatenate(keys or empty)).dictionary_encode()
        pairs, number = listed.dictionary.to_numpy(), listed.indices.to_numpy().astype(np.int64)
        n = max(len(pairs), 1)
        held, place = np.unique(np.concatenate(owner or empty) * n + number, return_inverse=True)
        times = np.bincount(place, np.concatenate(weights or empty), len(held)).astype(np.int64)
        doc, mine = held // n, held % n
        steps = np.diff(mine, prepend=0)
        steps[np.flatnonzero(np.diff(doc, prepend=-1))] = mine[np.flatnonzero(np.diff(doc, prepend=-1))]
        return {
            "unit": name, "ids": [r[0] for r in self.rows], "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "digests": digests,
            "sizes": np.bincount(doc, minlength=len(self.rows)), "links": _packed(steps, times),
            "a": pairs // len(bytes_b), "b": pairs % len(bytes_b), "docs": np.bincount(mine, minlength=len(pairs)),
        }


_ARROW = {
    "unit": pa.string(), "ids": pa.list_(pa.int64()), "n_a": pa.list_(pa.int64()), "n_b": pa.list_(pa.int64()), "n_groups": pa.list_(pa.int64()),
    "n_links": pa.list_(pa.int64()), "digests": pa.list_(pa.string()), "sizes": pa.list_(pa.int32()), "links": pa.binary(), "a": pa.list_(pa.int32()),
    "b": pa.list_(pa.int32()), "docs": pa.list_(pa.int32()),
}


def _units(held):
    def run(batches):
        pair: TokenizerPair = held.value
        names = _Names(*map(len, pair.token_bytes))
        task, n = TaskContext.get().partitionId(), 0

        def batch(unit):
            row = unit.row(f"{task}-{n}", names)
            return pa.RecordBatch.from_arrays([pa.array([row[k]], kind) for k, kind in _ARROW.items()], names=list(_ARROW))

        unit = _Unit(pair)
        for rows in batches:
            for row_id, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                unit.take(row_id, text.as_py())
                if unit.size >= UNIT_TOKENS:
                    yield batch(unit)
                    unit, n = _Unit(pair), n + 1
        if unit.rows:
            yield batch(unit)

    return run


def _finish(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Counts of the unit's pairs in the order of its list, added up by document."""
    (row,) = docs.to_pylist()
    order = np.argsort(answers["at"].to_numpy())
    count, top = answers["n"].to_numpy()[order], answers["top"].to_numpy(zero_copy_only=False)[order]
    sizes = np.array(row["sizes"], np.int64)
    steps, times = np.split(_unpacked(row["links"]), 2)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    total = np.cumsum(steps)
    first = np.cumsum(sizes) - sizes
    before = np.concatenate([[0], total])[first]
    mine = total - np.repeat(before, sizes)
    # whole numbers, added exactly
    best, sums = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    np.add.at(best, doc, np.where(top[mine], times, 0) if len(mine) else times)
    np.add.at(sums, doc, times * count[mine] if len(mine) else times)
    return pa.table(
        {
            "doc_id": pa.array(row["ids"], pa.int64()),
            **{k: pa.array(row[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")},
            "n_best": pa.array(best), "count_sum": pa.array(sums), "groups_sha256": pa.array(row["digests"], pa.string()),
        }
    )


def align(docs: DataFrame, pair: TokenizerPair, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per document the figures of its alignment, and the linked pairs of the corpus (``a, b, n, top``)."""
    held = docs.sparkSession.sparkContext.broadcast(pair)  # two paths
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    units = written(base.mapInArrow(_units(held), _UNIT), "aligned")
    pairs = units.select("unit", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("at", "p")).select("unit", "at", "p.a", "p.b", "p.docs")
    # at most one row for each id of B stands behind an id of A
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("n"))
    counts = written(counts.withColumn("top", F.col("n") == F.max("n").over(Window.partitionBy("a"))), "pairs")
    answers = pairs.join(counts, ["a", "b"]).select(F.col("unit").alias("home"), "at", "n", "top")
    rows = units.select("unit", "ids", "n_a", "n_b", "n_groups", "n_links", "digests", "sizes", "links")
    return rows.groupBy("unit").cogroup(answers.groupBy("home")).applyInArrow(_finish, _OUT), counts


def public_pair(byte_level: str = "byte_bpe_50k.json", pieces: str = "piece_bpe_32k.model") -> TokenizerPair:
    import public_tokenizers

    return TokenizerPair(public_tokenizers.path(byte_level), public_tokenizers.path(pieces))


@query("op13_crosstoken")
def op13_crosstoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and corpus-wide link counts of every document."""
    return align(read(spark, sf_dir, "documents").select("doc_id", "text"), public_pair())[0]
