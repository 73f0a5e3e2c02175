import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanlytics.llm import crosstoken as X
from spanlytics.llm.common import read

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def plain_bytes(models):
    """Bytes of the ids, by another way than the operator: the public byte list and the piece names."""
    shown = {}
    extra = 256
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255:
            shown[chr(x)] = x
        else:
            shown[chr(extra)], extra = x, extra + 1
    a = {i: bytes(shown[c] for c in n) for n, i in models[0].get_vocab(with_added_tokens=False).items() if all(c in shown for c in n)}
    b = {i: bytes([int(n[3:5], 16)]) if models[1].is_byte(i) else n.replace("▁", " ").encode() for i, n in ((i, models[1].id_to_piece(i)) for i in range(32000))}
    return a, b


def plain_groups(a, b, bytes_a, bytes_b):
    at, ends_a, ends_b = 0, [], []
    for i in a:
        ends_a.append(at := at + len(bytes_a[i]))
    at = 0
    for i in b:
        ends_b.append(at := at + len(bytes_b[i]))
    cuts = sorted(set(ends_a) & set(ends_b))
    out, i, j = [], 0, 0
    for c in cuts:
        x, y = i, j
        while i < len(a) and ends_a[i] <= c:
            i += 1
        while j < len(b) and ends_b[j] <= c:
            j += 1
        out.append((a[x:i], b[y:j]))
    return out


def plain_align(docs, models):
    bytes_a, bytes_b = plain_bytes(models)
    figures, links = [], []
    for doc_id, text in docs:
        a = models[0].encode(" " + text, add_special_tokens=False).ids if text else []
        b = models[1].encode(text) if text else []
        want = b" " + (text or "").encode()
        if b"".join(bytes_a[i] for i in a) != want or b"".join(bytes_b[i] for i in b) != want:
            a = b = []
        groups = plain_groups(a, b, bytes_a, bytes_b)
        own = Counter((x, y) for p, q in groups for x in p for y in q)
        name = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        figures.append((doc_id, len(a), len(b), len(groups), sum(own.values()), hashlib.sha256(name.encode()).hexdigest() if a else ""))
        links.append(own)
    count = Counter(k for own in links for k in own)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted(((*f[:5], sum(n for k, n in own.items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in own.items()), f[5]) for f, own in zip(figures, links)), key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()), key=str)


def test_whole_query_against_the_libraries(spark, models):
    docs = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect()]
    assert rows_of(X.op13_crosstoken(spark, SF)) == plain_align(docs, models)


def odd_texts(seed=3, n=150):
    rng = random.Random(seed)
    parts = ["a", "the", " ", "  ", "\n", "\n ", "\t", " \n  ", "’s", "'ll", "日本語", "é", "é", "🙂", " ", "​", "  ", "<s>", "</s>", "<|endoftext|>", "<0x41>", "12345", "###$$$", "Übergrößen", "\x00", "\x1c ", "�", "x" * 40, "ﬁ", "▁"]
    weights = [4] * (len(parts) - 1) + [0.2]
    return ["".join(rng.choices(parts, weights, k=rng.randrange(1, 40))) for _ in range(n)]


def test_odd_texts_nulls_and_repeated_rows(spark, models, monkeypatch):
    docs = list(enumerate(odd_texts()))
    docs += [(5, "other text for id 5"), (5, "other text for id 5"), (None, "no id here"), (None, None), (900, None), (901, ""), (902, " "), (903, "   "), (904, "end "), (905, "a▁b"), (906, "long words " * 4000), (907, "z" * 3000), (908, "€" * 700)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"unit": F.lit("mine"), "n": F.lit(1)}).repartition(3)
    want = plain_align(docs, models)
    assert rows_of(X.align(frame, X.public_pair())[0]) == want
    assert sum(r[1] for r in want) > 10000
    small, counts = X.align(frame.repartition(2), X.public_pair())
    assert small.count() == len(docs)
    assert counts.groupBy("a", "b").count().filter("count > 1").count() == 0


def test_small_units_and_wide_groups(spark, models, monkeypatch):
    rng = random.Random(1)
    a, b = [rng.randrange(7) for _ in range(400)], [rng.randrange(5) for _ in range(300)]
    import numpy as np

    for wide in (0, 10_000_000):
        monkeypatch.setattr(X, "WIDE", wide)
        keys, n = X._links(np.array(a), np.array(b), np.array([100, 1, 299]), np.array([50, 200, 50]), 32000)
        got = Counter()
        for k, m in zip(keys.tolist(), n.tolist()):
            got[divmod(k, 32000)] += m
        want = Counter((x, y) for p, q in ((a[:100], b[:50]), (a[100:101], b[50:250]), (a[101:], b[250:])) for x in p for y in q)
        assert got == want
    pair = X.public_pair()
    names = X._Names(*map(len, pair.token_bytes))
    unit = X._Unit(pair)
    for i, t in enumerate(odd_texts(8, 30)):
        unit.take(i, t)
    assert len(unit.row("u", names)["ids"]) == 30
    empty = X._Unit(pair)
    empty.take(1, None)
    assert empty.row("u", names)["n_links"] == [0]


def test_irregular_groups_by_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        n = rng.randrange(1, 60)
        dense = rng.random()
        a = sorted({x for x in range(1, n) if rng.random() < dense} | {n})
        b = sorted({x for x in range(1, n) if rng.random() < dense or x in a and rng.random() < 0.9} | {n})
        cuts, want, i, j = sorted(set(a) & set(b)), [], 0, 0
        for c in cuts:
            p, q = a.index(c) + 1 - i, b.index(c) + 1 - j
            if (p, q) != (1, 1):
                want.append((i, j, p, q))
            i, j = i + p, j + q
        assert X.irregular_groups(a, b) == want


def test_empty_table(spark):
    assert X.align(spark.createDataFrame([], "doc_id long, text string"), X.public_pair())[0].count() == 0
