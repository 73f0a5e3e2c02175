"""Run outputs on disk: partitioned layout, discovery, master tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PARTITIONS = ["dataset", "backend_slug", "config_id", "run", "round"]
# Serialised spans and manifests of a run folder.
PREDICTIONS = """review_id string, error string, final_xml string,
spans array<struct<ord:int, text:string, label:string, status:string, original_start:int, original_end:int, similarity:double>>"""
MANIFEST = """dataset string, backend_spec string, config_id string, run_index int, round int, n_errors int,
dataset_hash string, prompt_hash string, spec_hash string, models_returned array<string>, n_llm_calls long,
total_retries long, n_flagged long"""


def backend_slug(name) -> Column:
    return F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"[^A-Za-z0-9_.-]+", "_")


def write_run(df: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by the run key, so reading one run or dataset prunes folders."""
    out = df.withColumn("backend_slug", backend_slug("backend"))
    out.write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def read_runs(spark: SparkSession, path: str, datasets: list[str] | None = None) -> DataFrame:
    runs = spark.read.parquet(path)
    return runs.filter(F.col("dataset").isin(datasets)) if datasets else runs


def discover_runs(spark: SparkSession, root: str) -> DataFrame:
    """Predictions of every run folder that also has a manifest, with the manifest's fields.

    Folders without a manifest drop out of the inner join; their rows can be listed with
    ``runs_without_manifest``.
    """
    preds, manifests = _listing(spark, root)
    return preds.join(manifests, "run_dir")


def runs_without_manifest(spark: SparkSession, root: str) -> DataFrame:
    preds, manifests = _listing(spark, root)
    return preds.select("run_dir").distinct().join(manifests, "run_dir", "left_anti")


def _listing(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    folder = F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*$", "").alias("run_dir")

    def read(schema, pattern, **options):
        reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        return reader.options(**options).json(root).select("*", folder)

    return read(PREDICTIONS, "predictions.jsonl"), read(MANIFEST, "manifest.json", multiLine=True)


def prediction_rows(runs: DataFrame) -> DataFrame:
    """Span rows of discovered runs in original-text coordinates."""
    rows = runs.select(
        "dataset",
        F.col("backend_spec").alias("backend"),
        "config_id",
        F.col("run_index").alias("run"),
        "round",
        "review_id",
        F.posexplode("spans").alias("p_idx", "s"),
    )
    return rows.select(
        *rows.columns[:-1],
        F.col("s.original_start").alias("start"),
        F.col("s.original_end").alias("end"),
        "s.label",
        "s.status",
        "s.similarity",
    )


def write_master(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """One folder per master table."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(form).option("header", True).save(f"{path}/{name}")
