"""Sources (S1-S5) and sinks (K1-K8).

Readers always take an explicit schema (no inference per file); writers
emit JSON lines / CSV / parquet with Spark's own writers, so output is
split across tasks and written where the session's shared folder is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

PAGE_SCHEMA = "page_id long, url string, html string"


# ------------------------------------------------------------------ sources

def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed pages (page_id, url, html) - the re-aimed page fetch."""
    return spark.read.schema(PAGE_SCHEMA).format(fmt).load(path)


def read_json_records(spark: SparkSession, path: str, schema: str, multiline: bool = False,
                      mode: str = "FAILFAST") -> DataFrame:
    """JSON records with a fixed schema (``multiline`` for one array per
    file, as the reference's link / raw files are). A record that can't be
    parsed is an error, not a row of NULLs, unless ``mode`` says otherwise."""
    return spark.read.schema(schema).json(path, multiLine=multiline, mode=mode)


def parse_json_column(df: DataFrame, col: str, schema: str, name: str | None = None) -> DataFrame:
    """S3: a JSON payload column parsed with a fixed schema, fields inlined."""
    parsed = F.from_json(F.col(col), schema)
    if name:
        return df.withColumn(name, parsed)
    return df.select("*", parsed.alias("_j")).select(*df.columns, "_j.*")


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files -> (path, line_no, line), order kept.

    ``wholetext`` must be passed to ``text()`` itself (an option set before
    is overridden by the method's default)."""
    t = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return t.select("path", F.posexplode(F.split("value", "\n", -1)).alias("line_no", "line"))


#: CSV as RFC 4180 has it: a quote inside a value is doubled, white space is part of
#: the value, and a value may run over lines.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """K6 read back: empty fields are "" (the flat columns have no NULL)."""
    df = spark.read.schema(schema).csv(path, multiLine=True, nullValue="\u0000", emptyValue="", **CSV)
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) if c in text else F.col(c) for c in df.columns])


def land_bucketed(df: DataFrame, name: str, key: str = "page_id", buckets: int | None = None,
                  path: str | None = None, keep: bool = True) -> DataFrame:
    """Land pages (or documents) once as a table bucketed and sorted by
    ``key`` in the shared folder, and return its scan.

    Every per-page (per-document) window downstream then runs without any
    shuffle: the scan reports the hash partitioning on ``key``. Without ``keep`` the catalogue forgets the table at
    once (its files stay, and the scan that is returned knows them).
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    where = path or scratch_path(spark, f"table-{name}")
    (df.write.mode("overwrite").bucketBy(n, key).sortBy(key)
     .option("path", where).saveAsTable(name))
    scan = spark.table(name)
    if not keep:
        spark.sql(f"DROP TABLE {name}")
    return scan


# -------------------------------------------------------------------- sinks

def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _emptied(df: DataFrame, cols: list[str]) -> list[Column]:
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    return [F.nullif(F.col(c), F.lit("")).alias(c) if c in text else F.col(c) for c in cols]


def omit_empty(df: DataFrame) -> DataFrame:
    """K8: ``""`` -> NULL for every string column, so the JSON writer omits
    the field (``omitempty``)."""
    return df.select(*_emptied(df, df.columns))


#: Folders (sources) whose sizes may be sent to every task.
FOLDERS = 10_000


def write_json(df: DataFrame, path: str, omit_empty: bool = True, partition_by: list[str] = (),
               mode: str = "overwrite") -> None:
    """K1-K5: JSON lines (raw rows, subjects, courses, terms, links)."""
    out = globals()["omit_empty"](df) if omit_empty else df
    w = out.write.mode(mode).option("ignoreNullFields", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def write_json_by(df: DataFrame, path: str, by: list[str], rows_per_file: int = 100_000, omit_empty: bool = True) -> None:
    """K3 by source: JSON lines in a folder for each value of ``by``, in files of at most ``rows_per_file`` rows.

    The rows of each folder are counted, dealt over as many parts as they need and shuffled by (folder, part): a folder
    with few rows is one file, and one with most rows is written by many tasks, instead of a small file for each task and folder.
    """
    rest = [c for c in df.columns if c not in by]
    # parts are filled to four fifths on average, so chance seldom makes one run over
    sizes = staged(df.groupBy(*by).agg(F.ceil(F.count("*") / (0.8 * rows_per_file)).cast("long").alias("_parts")), "sizes")
    files, folders = sizes.agg(F.sum("_parts"), F.count("*")).first()
    sizes = sizes.select(F.struct(*by).alias("_k"), "_parts")
    keyed = df.select(*by, F.struct(*rest).alias("_r"))
    dealt = keyed.join(F.broadcast(sizes) if folders <= FOLDERS else sizes, [F.col(f"_k.{c}").eqNullSafe(F.col(c)) for c in by])
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("_r"), F.col("_parts"))).repartition(int(files or 1), *by, "_part")
    out = dealt.select(*by, "_r.*")
    if omit_empty:
        out = out.select(*by, *_emptied(out, rest))
    out.write.mode("overwrite").option("ignoreNullFields", "true").option("maxRecordsPerFile", rows_per_file).partitionBy(*by).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """K6/K7: flat columns as CSV with a header row of the field names."""
    out = df.select(*columns) if columns else df
    out.write.mode(mode).csv(path, emptyValue="", quoteAll=False, **CSV)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: the
    lineage ends there, and the size of what was written is known."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
