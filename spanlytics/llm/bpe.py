"""Byte-level BPE encoding and decoding through a global table of distinct words.

1. *Pre-tokens with positions.* Rows are taken in units (rows of one batch, at most ``UNIT_TOKENS``
   pre-tokens). A unit writes every text as the positions of its pre-tokens in the unit's own word
   list. A word that is itself an entry of the vocabulary is its rank; only the others travel.
2. *Distinct words.* The word lists are dealt out by the hash of the word, so equal words of all units
   meet; each distinct word is merged once. A unit sends a word once, however often it stands there,
   so very frequent words are no hot keys.
3. *Join back.* The ids return to their unit, where they replace the positions in order.
4. *Decoding* joins ids with the token-byte table (its size is that of the vocabulary, fixed), which
   is sent to all tasks and looked up there; ``decode`` does the same for any frame of ids.

Words and positions travel packed, since they are as large as the corpus. The units of the two
branches are recognised by a digest of their word list; should a lost executor bring rows back in other
batches, the job fails instead of mixing words.

Defined results: a null text counts as empty (no ids, digests of the empty string); special tokens are
ordinary text; null and repeated ids are carried through, one output row for each input row; an empty
table gives an empty result; only the id and the text column are read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanlytics.llm.common import query, read, released, shuffle_partitions

UNIT_TOKENS = 4_000_000
CHUNK = 256
_UNIT = "unit string, ids array<long>, nulls array<boolean>, sizes array<int>, codes binary"
_WORDS = "unit string, bucket int, words binary"
_MERGED = "unit string, bucket int, merged binary"


class Vocabulary:
    """Ranks of byte strings, the split pattern, and what each process builds from them once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.size = max(ranks.values()) + 1
        self._made: dict = {}

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern, "size": self.size, "_made": {}}

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def _once(self, name, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def splitter(self):
        return self._once("splitter", lambda: regex.compile(self.pattern))

    @property
    def encoding(self):
        return self._once("encoding", lambda: tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={}))

    @property
    def token_bytes(self) -> list[bytes]:
        def table():
            out = [b""] * self.size
            for token, rank in self.ranks.items():
                out[rank] = token
            return out

        return self._once("bytes", table)

    @property
    def token_text(self) -> list[str]:
        return self._once("text", lambda: [str(i) for i in range(self.size)])


# A space after a non-space always starts a pre-token; only white space before a space needs the whole text.
_ODD = regex.compile(r"\s ")


class _Pieces(dict):
    """Piece of text -> its number; a new piece is split when it is first met."""

    def __init__(self, unit: _Unit, lead: str):
        self.unit, self.lead = unit, lead

    def __missing__(self, piece: str) -> int:
        number = self[piece] = self.unit.add(self.lead + piece)
        return number


class _Unit:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.tokens: dict[str, int] = {}
        self.flat: list[int] = []
        self.offsets = [0]
        self.first, self.rest = _Pieces(self, ""), _Pieces(self, " ")
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, piece: str) -> int:
        tokens = self.tokens
        for t in self.vocabulary.splitter.findall(piece):
            self.flat.append(tokens.setdefault(t, len(tokens)))
        self.offsets.append(len(self.flat))
        return len(self.offsets) - 2

    def take(self, row_id, text: str | None) -> None:
        if not text:
            pieces = np.empty(0, np.int64)
        elif _ODD.search(text):
            pieces = np.array([self.first[text]], np.int64)
        else:
            parts = text.split(" ")
            pieces = np.empty(len(parts), np.int64)
            pieces[0] = self.first[parts[0]]
            pieces[1:] = np.fromiter(map(self.rest.__getitem__, parts[1:]), np.int64, len(parts) - 1)
        self.rows.append((row_id, pieces))
        self.size += len(pieces)

    def words(self, buckets: int) -> tuple[str, np.ndarray, list[list[bytes]]]:
        """Digest, code of each token, and the words to merge by bucket."""
        ranks, base = self.vocabulary.ranks, self.vocabulary.size
        code = np.empty(len(self.tokens), np.int64)
        lists: list[list[tuple[bytes, int]]] = [[] for _ in range(buckets)]
        for text, number in self.tokens.items():
            word = text.encode("utf-8", "surrogatepass")
            rank = ranks.get(word)
            if rank is None:
                lists[xxhash.xxh3_64_intdigest(word) % buckets].append((word, number))
            else:
                code[number] = rank
        digest, at = xxhash.xxh3_128(), base
        for group in lists:
            for word, number in group:
                code[number] = at
                at += 1
                digest.update(len(word).to_bytes(8, "little") + word)
        for row_id, pieces in self.rows:
            digest.update(f"{row_id}:{len(pieces)};".encode())
        return digest.hexdigest(), code, [[w for w, _ in g] for g in lists]

    def codes(self, code: np.ndarray) -> list[np.ndarray]:
        """Codes of each row."""
        flat = code[np.array(self.flat, np.int64)] if self.flat else np.empty(0, np.int64)
        offsets = np.array(self.offsets)
        out = []
        for _, pieces in self.rows:
            start, count = offsets[pieces], offsets[pieces + 1] - offsets[pieces]
            ends = np.cumsum(count)
            total = int(ends[-1]) if len(ends) else 0
            out.append(flat[np.arange(total) + np.repeat(start - (ends - count), count)] if total else np.empty(0, np.int64))
        return out


def _units(batches, vocabulary: Vocabulary):
    for batch in batches:
        unit = _Unit(vocabulary)
        for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            unit.take(row_id, text)
            if unit.size >= UNIT_TOKENS:
                yield unit
                unit = _Unit(vocabulary)
        if unit.rows:
            yield unit


def _packed(codes: np.ndarray) -> bytes:
    """The bytes of 32-bit numbers plane by plane, compressed."""
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _positions(held, buckets: int):
    def run(batches):
        for unit in _units(batches, held.value):
            name, code, _ = unit.words(buckets)
            codes = unit.codes(code)
            for i in range(0, len(codes), CHUNK):
                rows, part = unit.rows[i : i + CHUNK], codes[i : i + CHUNK]
                yield pa.RecordBatch.from_pydict(
                    {
                        "unit": pa.array([name], pa.string()),
                        "ids": pa.array([[r if r is not None else 0 for r, _ in rows]], pa.list_(pa.int64())),
                        "nulls": pa.array([[r is None for r, _ in rows]], pa.list_(pa.bool_())),
                        "sizes": pa.array([[len(c) for c in part]], pa.list_(pa.int32())),
                        "codes": pa.array([_packed(np.concatenate(part))], pa.binary()),
                    }
                )

    return released(run)


def _word_lists(held, buckets: int):
    def run(batches):
        for unit in _units(batches, held.value):
            name, _, lists = unit.words(buckets)
            full = [b for b in range(buckets) if lists[b]] or [0]
            pack = zstandard.ZstdCompressor(level=3).compress
            words = [pack(np.array([len(lists[b]), *map(len, lists[b])], "<u4").tobytes() + b"".join(lists[b])) for b in full]
            yield pa.RecordBatch.from_pydict({"unit": pa.array([name] * len(full)), "bucket": pa.array(full, pa.int32()), "words": pa.array(words, pa.binary())})

    return released(run)


def _merge(held):
    """Encode each distinct word of a bucket once; answer every word list with the ids of its words."""

    def run(batches):
        encoding, known = held.value.encoding, {}
        for batch in batches:
            merged = []
            for data in batch.column(2).to_pylist():
                raw = zstandard.ZstdDecompressor().decompress(data)
                n = int(np.frombuffer(raw, "<u4", 1)[0])
                sizes = np.frombuffer(raw, "<u4", n, 4)
                at, out, counts = 4 + 4 * n, [], []
                for size in sizes.tolist():
                    word = raw[at : at + size]
                    at += size
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = encoding._encode_single_piece(word)
                    counts.append(len(ids))
                    out.extend(ids)
                merged.append(_packed(np.array([n, *counts, *out])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(merged, pa.binary())], names=["unit", "bucket", "merged"])

    return released(run)


def _id_lists(merged: pa.Table, size: int) -> list[list[int]]:
    """Ids of every code: the vocabulary first, then the words of the unit in the order of the buckets."""
    out = [[i] for i in range(size)]
    done = set()
    for bucket, data in sorted(zip(merged["bucket"].to_pylist(), merged["merged"].to_pylist()), key=lambda x: x[0]):
        if bucket in done:  # two equal units share a name and have equal lists
            continue
        done.add(bucket)
        a = _unpacked(data).tolist()
        n, at = a[0], 1 + a[0]
        for count in a[1 : 1 + n]:
            out.append(a[at : at + count])
            at += count
    return out


def _rows(docs: pa.Table):
    for row in docs.to_pylist():
        codes, at = _unpacked(row["codes"]), 0
        for row_id, null, size in zip(row["ids"], row["nulls"], row["sizes"]):
            yield None if null else row_id, codes[at : at + size].tolist()
            at += size


def _finish_ids(held):
    def run(docs: pa.Table, merged: pa.Table) -> pa.Table:
        lists = _id_lists(merged, held.value.size)
        got = [(i, [x for c in codes for x in lists[c]]) for i, codes in _rows(docs)]
        return pa.table({"doc_id": pa.array([i for i, _ in got], pa.int64()), "ids": pa.array([x for _, x in got], pa.list_(pa.int32()))})

    return run


def _finish_digests(held):
    def run(docs: pa.Table, merged: pa.Table) -> pa.Table:
        vocabulary = held.value
        lists = _id_lists(merged, vocabulary.size)
        own = lists[vocabulary.size :]
        names, table = vocabulary.token_text, vocabulary.token_bytes
        text = names + [" ".join([names[i] for i in ids]) for ids in own]
        data = table + [b"".join([table[i] for i in ids]) for ids in own]
        count = [1] * vocabulary.size + [len(ids) for ids in own]
        ids, n, sha_ids, sha_bytes = [], [], [], []
        for row_id, codes in _rows(docs):
            ids.append(row_id)
            n.append(sum(map(count.__getitem__, codes)))
            sha_ids.append(hashlib.sha256(" ".join(map(text.__getitem__, codes)).encode()).hexdigest())
            sha_bytes.append(hashlib.sha256(b"".join(map(data.__getitem__, codes))).hexdigest())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha_ids, pa.string()), "decoded_sha256": pa.array(sha_bytes, pa.string())})

    return run


def _encoded(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str, finish, schema: str) -> DataFrame:
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(vocabulary)  # fixed size
    buckets = shuffle_partitions(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    positions = base.mapInArrow(_positions(held, buckets), _UNIT)
    lists = base.mapInArrow(_word_lists(held, buckets), _WORDS)
    merged = lists.repartition(buckets, "bucket").mapInArrow(_merge(held), _MERGED)
    return positions.groupBy("unit").cogroup(merged.groupBy("unit")).applyInArrow(_checked(finish(held)), schema)


def _checked(run):
    def checked(docs: pa.Table, merged: pa.Table) -> pa.Table:
        if not len(docs) or not len(merged):
            raise RuntimeError("the rows came in other batches than before: run the job again")
        return run(docs, merged)

    return checked


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every row."""
    return _encoded(docs, vocabulary, id_col, text_col, _finish_ids, "doc_id long, ids array<int>")


def encoded_digests(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, without materialising the ids."""
    return _encoded(docs, vocabulary, id_col, text_col, _finish_digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its ids: each id is looked up in the token-byte table; null ids give null."""
    held = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("binary")
    def run(lists: pa.Array) -> pa.Array:
        table = held.value.token_bytes
        return pa.array([None if x is None else b"".join([table[i] for i in x]) for x in lists.to_pylist()], pa.binary())

    return df.withColumn(out, run(F.col(ids)))


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> Vocabulary:
    import public_tokenizers

    return Vocabulary.load(public_tokenizers.path(name), public_tokenizers.PATTERN)


@query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of the ids and of the decoded bytes of every document."""
    return encoded_digests(read(spark, sf_dir, "documents").select("doc_id", "text"), public_vocabulary())
