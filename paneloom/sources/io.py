"""Readers and writers: typed Parquet, CSV and JSON lines, raw artifacts with a status, manifests and configurations."""

from __future__ import annotations

import csv
import glob
import json
import os
import tomllib
from collections.abc import Callable, Iterable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.functions.text import safe_name, truthy
from paneloom.operators.keys import require_columns
from paneloom.sources import xlsx


def read_parquet(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and a declared schema; quoted line breaks are kept."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def read_csv_text(spark: SparkSession, path: str, required: Iterable[str] = ()) -> DataFrame:
    """CSV with all columns as text, missing values empty."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"').na.fill("")
    return require_columns(df, list(required))


def read_workbook(spark: SparkSession, path: str, sheet: str | None, renames: dict[str, str]) -> DataFrame:
    """A workbook's sheet as text under canonical names: an .xlsx file that the driver reads, or its Parquet or CSV export."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path).select(*(F.col(f"`{c}`").cast("string").alias(c) for c in renames))
    elif path.endswith(".csv"):
        df = read_csv_text(spark, path)
    else:
        head, *body = [*xlsx.rows(path, sheet)] or [[]]
        names = [h if h is not None else f"column_{i}" for i, h in enumerate(head, 1)]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
        df = spark.createDataFrame([(*r, *[None] * len(names))[: len(names)] for r in body if any(v is not None for v in r)], schema)
    return require_columns(df, list(renames)).select(*(F.col(f"`{a}`").alias(b) for a, b in renames.items()))


def promote_header(df: DataFrame, order: str) -> DataFrame:
    """df with the values of its first row (by the order column) as column names, and without that row and the order column."""
    columns = [c for c in df.columns if c != order]
    first = df.orderBy(order).first()
    if first is None:
        return df.drop(order)
    names = [first[c] if first[c] is not None and str(first[c]).strip() else c for c in columns]
    return df.where(F.col(order) > F.lit(first[order])).select(*(F.col(f"`{c}`").alias(str(n).strip()) for c, n in zip(columns, names, strict=True)))


def parquet_layout(path: str) -> dict:
    """Rows, row groups and their sizes of a local Parquet file, from its footer."""
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(path).metadata
    return {"rows": meta.num_rows, "columns": meta.num_columns, "groups": [{"rows": meta.row_group(i).num_rows, "bytes": meta.row_group(i).total_byte_size} for i in range(meta.num_row_groups)]}


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank lines are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, body, artifact_status) of raw JSON files: one that doesn't parse is a row with its status."""
    from paneloom.operators.crawl import payload_status

    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    return payload_status(files, "body")


def cached_pages(wanted: DataFrame, url: str, files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Wanted URLs with the file that holds them, found by safe name of the URL or of its https form; a null URL has none.

    by names columns of both tables that must agree, for caches that don't share their files: equal URLs, or such with
    equal safe names, then find only what was kept for their own key.
    """
    named = files.select(*by, F.regexp_extract("path", r"([^/]+)\.html?$", 1).alias("_name"), "path")
    safe = lambda c: F.when(F.col(url).isNotNull(), safe_name(c))
    out = wanted.withColumn("_n", safe(url)).withColumn("_s", safe(F.regexp_replace(url, "^http:", "https:")))
    for name, path in (("_n", "_p1"), ("_s", "_p2")):
        out = out.join(named.withColumnsRenamed({"_name": name, "path": path}), [*by, name], "left")
    return out.select(*(F.col(c) for c in wanted.columns), F.coalesce("_p1", "_p2").alias("path"))


def page_path(folder: str, source: str, batch: str, page: int) -> str:
    """Where the raw list payload of a page is kept."""
    return f"{folder.rstrip('/')}/{source}_{batch}_page_{page:03d}.json"


def exists_in(spark: SparkSession) -> Callable[[str], bool]:
    """Whether a path is there, in any file system that Spark reaches."""

    def there(path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    return there


def cached_payload(folder: str, source: str, batch: str, page: int, older: str | None = None, exists: Callable[[str], bool] = os.path.exists) -> str | None:
    """The kept payload of a page; for page 1 an older file may stand in; None if there is neither."""
    options = [page_path(folder, source, batch, page), *([older] if older and page == 1 else [])]
    return next((p for p in options if exists(p)), None)


def write_artifact(path: str | Path, value: object) -> None:
    """A raw JSON artifact, folders made as needed."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for small results at the edge."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """A folder of JSON lines for each split."""
    df.write.mode("overwrite").partitionBy(split).json(path)


def write_partitioned(df: DataFrame, path: str, *columns: str) -> None:
    """Parquet partitioned by columns; rows of a partition value meet first, so files stay few."""
    df.repartition(*columns).write.mode("overwrite").partitionBy(*columns).parquet(path)


def load_toml(path: str | Path) -> dict:
    return tomllib.loads(Path(path).read_text(encoding="utf-8"))


def load_batches(path: str | Path, enabled: str = "enabled") -> list[dict[str, str]]:
    """Rows of a CSV whose enabled column says yes."""
    with open(path, encoding="utf-8-sig", newline="") as f:
        return [r for r in csv.DictReader(f) if str(r.get(enabled, "")).strip().lower() in ("true", "1", "yes", "y")]


def resolve_globs(root: str | Path, patterns: str) -> list[str]:
    """Files of several patterns separated by semicolons, each once, sorted."""
    found = {p for one in patterns.split(";") if one.strip() for p in glob.glob(str(Path(root) / one.strip()))}
    return sorted(str(Path(p).relative_to(root)) for p in found)


MANIFEST = "source_id string, kind string, pattern string, files int, bytes bigint, status string"


def manifest(spark: SparkSession, root: str | Path, sources: Iterable[tuple[str, str, str]]) -> DataFrame:
    """A row for each source (id, kind, patterns): how many files its patterns find below root, their size, and whether any is there."""
    rows = []
    for name, kind, patterns in sources:
        found = [Path(root) / p for p in resolve_globs(root, patterns)]
        rows.append((name, kind, patterns, len(found), sum(p.stat().st_size for p in found), "found" if found else "missing"))
    return spark.createDataFrame(rows, MANIFEST)


def flag(c: str) -> Column:
    """A flag that came as text."""
    return truthy(c)


def serialized_list(c: str) -> Column:
    """A list written as text in Python's or JSON's way; any other text is a list of that one item."""
    text = F.trim(F.coalesce(F.col(c), F.lit("")))
    listed = F.from_json(F.when(F.startswith(text, F.lit("[")), F.regexp_replace(F.regexp_replace(text, r"'((?:[^'\\]|\\.)*)'", '"$1"'), r"\bNone\b", "null")), "array<string>")
    return F.when((text == "") | (text == "[]"), F.array().cast("array<string>")).otherwise(F.filter(F.coalesce(listed, F.array(text)), lambda x: x.isNotNull() & (F.trim(x) != "")))
