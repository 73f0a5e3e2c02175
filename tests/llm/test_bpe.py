import hashlib

import pytest
import tiktoken

from spanlytics.llm import bpe as B


@pytest.fixture(scope="module")
def vocabulary():
    return B.public_vocabulary()


TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "  a  b", "it's  don't\n\n x", "tab\t tab", "line\r\nline \n", "a\x1cb \x1c c", "　x ​", "<|endoftext|> is text",
    "éà ß 漢字 😀👍🏽", "repeat " * 50, "x" * 5000, " 's 're", "123 456,789.0", "a \n b", "é e", "\x00 \x00",
]


def reference(vocabulary, text):
    enc = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
    return enc.encode_ordinary(text or "")


def test_digests_and_ids_match_the_library(make_docs, vocabulary, monkeypatch):
    monkeypatch.setattr(B, "UNIT_TOKENS", 40)
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (3, "again"), (3, "again")]
    docs = make_docs(rows).repartition(3)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in B.encoded_digests(docs, vocabulary).collect())
    want = []
    for i, t in rows:
        ids = reference(vocabulary, t)
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    encoded = B.encode(docs, vocabulary)
    assert {r["doc_id"]: r["ids"] for r in encoded.filter("doc_id < 3 or doc_id > 3").collect()} == {i: reference(vocabulary, t) for i, t in enumerate(TEXTS) if i != 3}
    back = B.decode(encoded, vocabulary).filter("doc_id = 14").first()
    assert bytes(back["decoded"]).decode() == TEXTS[14]


def test_empty_table_and_clashing_names(make_docs, vocabulary):
    assert B.encoded_digests(make_docs([]), vocabulary).count() == 0
    docs = make_docs([(1, "a b")]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "unit")
    assert B.encoded_digests(docs, vocabulary).first()["n_tokens"] == 2
