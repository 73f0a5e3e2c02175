import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from spanlytics.llm import sharding as S
from tests.llm.conftest import invented


def bits(value):
    return bin(int(hashlib.md5(str(value).encode()).hexdigest()[:16], 16))[2:].zfill(64)


def test_matches_the_directory_by_hand(make_docs):
    rows = [(i, "x" * (i % 97 * 10)) for i in range(500)]
    limit = 3000
    got = {r["doc_id"]: (r["shard"], r["shard_bytes"]) for r in S.with_shards(make_docs(rows), "doc_id", "text", limit).collect()}
    size = defaultdict(int)
    for i, t in rows:
        for d in range(65):
            size[bits(i)[:d]] += len(t)
    for i, _ in rows:
        want = next(bits(i)[:d] for d in range(65) if size[bits(i)[:d]] <= limit)
        assert got[i] == (want, size[want])


def test_hot_key_large_texts_and_nulls(spark, make_docs):
    rows = [(7, f"text {i} " * 20) for i in range(200)] + [(8, "same " * 50)] * 300 + [(9, "y" * 5000), (None, None), (None, "n"), (10, "")]
    docs = make_docs(rows).repartition(4).withColumns({"row_part": F.lit("mine"), "dir_p": F.lit(1)})
    out = S.with_shards(docs, "doc_id", "text", 2000)
    assert out.columns == docs.columns + ["shard", "shard_bytes"]
    got = out.collect()
    assert len(got) == len(rows) and all(r["shard"] is not None for r in got)
    total = defaultdict(int)
    for r in got:
        total[r["shard"]] += len((r["text"] or "").encode())
    assert all(total[r["shard"]] == r["shard_bytes"] for r in got)
    assert {s for s, n in total.items() if n > 2000} == {r["shard"] for r in got if r["doc_id"] == 9}
    # shards hold whole prefixes: no shard lies under another one
    plain = sorted({r["shard"] for r in got if "-" not in r["shard"]})
    assert not any(b.startswith(a) for a, b in zip(plain, plain[1:]))


def test_one_shard_and_empty_table(make_docs):
    assert {r["shard"] for r in S.with_shards(make_docs([(1, "a"), (2, "b")]), "doc_id", "text", 100).collect()} == {""}
    assert S.with_shards(make_docs([]), "doc_id", "text", 100).count() == 0


def test_written_shards(spark, make_docs, tmp_path):
    docs = make_docs([(i, " ".join(invented(i, 30))) for i in range(100)])
    S.write_shards(docs, str(tmp_path / "shards"), "doc_id", "text", 2000)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 100
