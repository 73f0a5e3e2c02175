"""Sharding by extendible hashing.

A document falls into the bucket of the first bits of its key's hash. A bucket above the byte limit
splits on its next bit, and only such buckets do, until every shard fits. The directory maps the
prefixes of a depth to their shards; it has a few entries for each shard.

Sizes are summed for each prefix of the deepest level that a step needs, with partial sums before the
shuffle; the levels above are sums of these. A further step looks only at the buckets that are still
too large. The hash has 64 bits of the key and then 64 bits of the text, so rows of one very frequent
key split on. Rows equal in key and text cannot split by any bit: they are numbered in their input
partitions and cut into pieces that fit (shard ``prefix-piece``). One text above the limit is a shard
of its own.

Defined results: a null key counts as the empty key, a null text as no bytes; an empty table gives an
empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from spanlytics.llm.common import BROADCAST_BYTES, fresh, query, read, written

LIMIT = 64 << 20
#: Limit of the registered query, small enough that every table size splits.
QUERY_LIMIT = 1 << 20
BITS = 128


def hash_bits(value: Column) -> Column:
    """64 bits of md5 as a string of 0 and 1, the same in any SQL engine."""
    return F.lpad(F.conv(F.substring(F.md5(F.coalesce(value, F.lit(""))), 1, 16), 16, 2), 64, "0")


def row_bits(key: Column, text: Column, depth: int) -> Column:
    bits = hash_bits(key.cast("string")) if depth <= 64 else F.concat(hash_bits(key.cast("string")), hash_bits(text))
    return F.substring(bits, 1, depth)


def directory(sums: DataFrame, depth: int, deep: int, limit: int) -> DataFrame:
    """``p, shard, bytes``: for each prefix of ``deep`` bits the largest bucket above it that fits.

    ``shard`` is null where the prefix itself is still too large. ``sums`` has ``p, bytes``.
    """
    steps = sums.select("p", "bytes", F.explode(F.sequence(F.lit(depth), F.lit(deep))).alias("d"))
    steps = steps.withColumn("prefix", F.substring("p", F.lit(1), F.col("d")))
    levels = steps.groupBy("prefix", "d").agg(F.sum("bytes").alias("total")).filter(F.col("total") <= limit)
    best = steps.select("p", "prefix", "d").join(levels, ["prefix", "d"]).groupBy("p").agg(F.min_by(F.struct("prefix", "total"), "d").alias("s"))
    return sums.select("p").join(best, "p", "left").select("p", F.col("s.prefix").alias("shard"), F.col("s.total").alias("bytes"))


def _checked(small: DataFrame, row_bytes: int = 256) -> DataFrame:
    return F.broadcast(small) if small.count() * row_bytes <= BROADCAST_BYTES else small


def with_shards(df: DataFrame, key: str, text: str, limit: int = LIMIT, shard: str = "shard", size: str = "shard_bytes") -> DataFrame:
    """``df`` with the shard of each row and the bytes in that shard."""
    own, held, part, number, piece, before, p, s, b = fresh(df, "row_bytes", "open_bits", "row_part", "row_number", "row_piece", "rows_before", "dir_p", "dir_shard", "dir_bytes")
    row_size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), row_size.alias("bytes"))
    largest = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    depth, extra, found = 0, 3, []
    while True:
        deep = min(BITS, depth + max(0, math.ceil(math.log2(max(1, largest / limit)))) + extra)
        sums = written(rows.groupBy(row_bits(F.col("k"), F.col("t"), deep).alias("p")).agg(F.sum("bytes").alias("bytes")), "bucket-sizes")
        entry = written(directory(sums, depth, deep, limit), "directory")
        found.append((deep, entry))
        left = entry.filter("shard is null").select("p").join(sums, "p")
        largest = left.agg(F.max("bytes")).first()[0]
        if largest is None or deep == BITS:
            break
        rows = rows.join(_checked(left.select("p")), row_bits(F.col("k"), F.col("t"), deep) == F.col("p"), "left_semi")
        depth, extra = deep, 2

    out = df.withColumns({s: F.lit(None).cast("string"), b: F.lit(None).cast("long")})
    for deep, entry in found:
        here = _checked(entry.filter("shard is not null").select(F.col("p").alias(p), F.col("shard").alias(shard_new := f"{s}_new"), F.col("bytes").alias(bytes_new := f"{b}_new")))
        out = out.withColumn(held, row_bits(F.col(key), F.col(text), deep)).join(here, F.col(held) == F.col(p), "left")
        out = out.withColumns({s: F.coalesce(s, shard_new), b: F.coalesce(b, bytes_new)}).drop(p, shard_new, bytes_new, held)
    named = [*[F.col(c) for c in df.columns], F.col(s).alias(shard), F.col(b).alias(size)]
    if largest is None:
        return out.select(*named)

    # rows equal in key and text: numbered by input partition, then cut
    equal = out.filter(F.col(s).isNull()).withColumns({own: row_size, held: row_bits(F.col(key), F.col(text), BITS), part: F.spark_partition_id()})
    equal = written(equal, "equal-rows")
    counts = equal.groupBy(held, part).agg(F.count("*").alias("rows"))
    upto = Window.partitionBy(held).orderBy(part)
    counts = counts.select(F.col(held).alias(f"{held}_c"), F.col(part).alias(f"{part}_c"), (F.sum("rows").over(upto) - F.col("rows")).alias(before))
    numbered = equal.withColumn(number, F.row_number().over(Window.partitionBy(held, part).orderBy(held)) - 1)
    numbered = numbered.join(counts, (F.col(held) == F.col(f"{held}_c")) & (F.col(part) == F.col(f"{part}_c")))
    fit = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col(own)))
    numbered = numbered.withColumn(piece, F.concat_ws("-", held, F.floor((F.col(number) + F.col(before)) / fit).cast("string")))
    sizes = numbered.groupBy(F.col(piece).alias(p)).agg(F.sum(own).alias(f"{b}_new"))
    numbered = numbered.join(sizes, F.col(piece) == F.col(p)).withColumns({s: F.col(piece), b: F.col(f"{b}_new")})
    return out.filter(F.col(s).isNotNull()).select(*named).union(numbered.select(*named))


def write_shards(df: DataFrame, path: str, key: str, text: str, limit: int = LIMIT) -> None:
    """One folder for each shard under ``path``."""
    with_shards(df, key, text, limit).drop("shard_bytes").write.partitionBy("shard").parquet(path)


_SQL = f"""with d as (select doc_id, strlen(coalesce(text, ''))::bigint b,
  lpad(bin(('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint), 32, '0') h from documents),
l as (select doc_id, k, substr(h, 1, k) p, sum(b) over (partition by k, substr(h, 1, k)) total from d, range(0, 31) r(k)),
f as (select *, row_number() over (partition by doc_id order by k) n from l where total <= {QUERY_LIMIT})
select doc_id, p shard, length(p)::integer depth, total::bigint shard_bytes from f where n = 1"""


@query("op9_sharding", _SQL)
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document with its local depth and its bytes."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_shards(docs, "doc_id", "text", QUERY_LIMIT)
    return out.select("doc_id", "shard", F.length("shard").alias("depth"), "shard_bytes")
