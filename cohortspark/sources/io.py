"""Readers and writers. Paths go to Spark's readers, so any store that Spark knows will do."""

from __future__ import annotations

import io
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clean_numbers


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("header", True).option("mode", "PERMISSIVE")
    return clean_numbers(r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n).select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns))


def is_ready(df: DataFrame, required: Sequence[str]) -> bool:
    return set(required) <= set(df.columns)


def read_xport(spark: SparkSession, path: str, key: str, columns: Sequence[str]) -> DataFrame:
    """A directory of transport files as one job: one row per record with the key and the wanted numeric columns."""
    schema = f"{key} long, " + ", ".join(f"{c} double" for c in columns)

    def parse(batches):
        import pandas as pd

        for b in batches:
            for raw in b["content"]:
                d = pd.read_sas(io.BytesIO(raw), format="xport")
                d.columns = [c.decode() if isinstance(c, bytes) else str(c) for c in d.columns]
                if key not in d:
                    raise ValueError(f"no column {key}")
                d = d[d[key].notna()]
                yield pd.DataFrame({key: d[key].astype("int64"), **{c: d[c].astype(float) if c in d else None for c in columns}})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)


def first_readable(spark: SparkSession, candidates: Sequence[str], required: bool = False) -> tuple[DataFrame | None, DataFrame]:
    """The first candidate that can be read (``.csv`` with a header, else Parquet), and one status row per candidate tried; the rows of the one found are counted."""
    status, found = [], None
    for path in candidates:
        try:
            found = spark.read.option("header", True).csv(path) if path.lower().endswith(".csv") else spark.read.parquet(path)
            status.append((path, "loaded", found.count(), len(found.columns), None))
            break
        except Exception as e:  # noqa: BLE001  the reader's reason is the status
            found = None
            status.append((path, "missing", 0, 0, type(e).__name__))
    if found is None and required:
        raise FileNotFoundError(f"none of {list(candidates)}")
    return found, spark.createDataFrame(status, "path string, status string, rows long, columns int, error string")


def read_batches(spark: SparkSession, manifests: str) -> DataFrame:
    """Batches listed by JSON sidecars (path, batch, seed, status); only complete ones are read, stamped by batch and seed."""
    rows = spark.read.json(manifests).filter("status = 'complete'").select("path", "batch", "seed").collect()  # one row a batch
    frames = [clean_numbers(spark.read.parquet(r.path)).withColumn("source_batch", F.lit(r.batch)).withColumn("source_seed", F.lit(r.seed)) for r in rows]
    if not frames:
        raise FileNotFoundError("no complete batch")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_catalogue(spark: SparkSession, path: str, required: Sequence[str] = ("version", "entries")) -> DataFrame:
    d = spark.read.option("multiLine", True).json(path)
    if missing := set(required) - set(d.columns):
        raise ValueError(f"catalogue lacks {sorted(missing)}")
    return d.select(F.explode("entries").alias("e")).select("e.*")


def guarded_csv(spark: SparkSession, path: str, most_bytes: int = 15_000_000, most_rows: int = 20_000) -> DataFrame:
    """A CSV upload within limits; raises on a wrong extension, an empty or too large file or too many rows."""
    if not path.lower().endswith(".csv"):
        raise ValueError("only .csv is accepted")
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    if not 0 < size <= most_bytes:
        raise ValueError(f"{size} bytes")
    d = spark.read.option("header", True).option("mode", "PERMISSIVE").option("encoding", "UTF-8").csv(path)
    if d.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"over {most_rows} rows")
    return d


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The names in the first line; raises where there is none, where names repeat or are empty, and on another extension."""
    if not path.lower().endswith(".csv"):
        raise ValueError("only .csv is accepted")
    first = spark.read.option("header", False).option("inferSchema", False).option("encoding", "UTF-8").csv(path).limit(1).collect()
    names = [(x or "").strip().lstrip("\ufeff") for x in first[0]] if first else []
    if not any(names):
        raise ValueError("no header")
    if "" in names or len({n.lower() for n in names}) < len(names):
        raise ValueError("empty or repeated names in the header")
    return names


def permissive_csv(spark: SparkSession, path: str, columns: Sequence[tuple[str, str]], corrupt: str = "_corrupt_record") -> DataFrame:
    """A CSV with the header ``columns`` (name, type). A line that does not fit its types or length keeps what could be read and is whole in ``corrupt``; bytes that are no UTF-8 become U+FFFD."""
    schema = ", ".join(f"`{c}` {kind}" for c, kind in (*columns, (corrupt, "string")))
    r = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).option("encoding", "UTF-8").option("enforceSchema", True)
    return r.schema(schema).csv(path)


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def frame_fingerprint(df: DataFrame) -> DataFrame:
    """Independent of row and column order: xor, sum and count of row hashes."""
    h = df.select(F.xxhash64(*sorted(df.columns)).alias("h"))
    return h.agg(F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).select(F.sha2(F.concat_ws("|", "x", "s", "n"), 256).alias("fingerprint"))


def is_stale(current: DataFrame, stored: DataFrame) -> bool:
    return current.exceptAll(stored).limit(1).count() > 0


def rebuilt(source: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], settings: str = "") -> DataFrame:
    """What ``build`` makes of the source, kept under ``path`` with the source's fingerprint and the settings; made anew only if one of these has changed."""
    spark = source.sparkSession
    now = frame_fingerprint(source).withColumn("settings", F.lit(settings))
    try:
        stale = is_stale(now, spark.read.parquet(f"{path}/fingerprint"))
    except AnalysisException:  # nothing kept yet
        stale = True
    if stale:
        write_table(build(source), f"{path}/data")
        write_table(now, f"{path}/fingerprint")  # last: a lost build stays stale
    return spark.read.parquet(f"{path}/data")


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.format(kind).save(path)


def write_report(findings: DataFrame, path: str, fail: bool = True) -> None:
    """Write the findings first, then fail if one is blocking."""
    findings.write.mode("overwrite").json(path)
    if fail and findings.filter("level IN ('blocking', 'error')").limit(1).count():
        raise ValueError("blocking findings; see the report")


def flat_results(df: DataFrame, arr: str, n: int, tags: dict[str, str]) -> DataFrame:
    return df.select(*(c for c in df.columns if c != arr), *(F.get(F.col(arr), F.lit(i)).alias(f"{arr}_{i + 1}") for i in range(n)), *(F.lit(v).alias(k) for k, v in tags.items()))


def fixture_extract(df: DataFrame, entity: str, n: int) -> DataFrame:
    return df.join(df.select(entity).distinct().orderBy(entity).limit(n), entity, "left_semi")


def export_tables(spark: SparkSession, path: str, tables: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """The tables of a generator's export (``<path>/<name>.csv``), the wanted columns only, as text."""
    return {name: spark.read.option("header", True).csv(f"{path}/{name}.csv").select(*cols) for name, cols in tables.items()}


def code_filter(df: DataFrame, code: str, wanted: Sequence[str]) -> DataFrame:
    """Rows whose code is on the list, exactly."""
    return df.filter(F.col(code).isin(*wanted))
