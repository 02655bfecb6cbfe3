"""Dimensions, stable ids and keyed dedup.

Every "first seen" result is defined by an explicit order column (``ord``),
never by task scheduling. Group-wise work uses partial aggregates
(``min``/``min_by`` on structs), so a hot key - one subject holding a third
of all rows, one group of copies - is pre-reduced on every mapper before
the shuffle. Dense ids are numbered with a range partitioning, not one
global window, so no single task holds a whole dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from ..sources.io import staged


def row_key(cols: list[str]) -> Column:
    """A 256-bit digest that is equal for equal values of ``cols`` (NULL
    differs from every text; lengths keep the columns apart)."""
    parts = []
    for c in cols:
        t = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def first_per_key(df: DataFrame, keys: list[str], order: list[str], count: str = "n_copies",
                  keep: list[str] | None = None) -> DataFrame:
    """Keep the first row of each key by ``order`` (plus the number of
    rows), with the columns ``keep`` (all by default). Unlike ``dropDuplicates``
    the survivor is defined.

    Rows are grouped by a digest of the key, and while they are reduced only
    the order and, with it, the whole row travel: one buffer a key and task.
    """
    g = df.groupBy(row_key(keys).alias("_key")).agg(
        F.min_by(F.struct(*(keep or df.columns)), F.struct(*order)).alias("_f"), F.count("*").alias(count))
    return g.select("_f.*", count)


def dense_ids(df: DataFrame, order: list[str], name: str = "id", partition: list[str] = (),
              base: int = 0, partitions: int | None = None) -> DataFrame:
    """A3: dense ids ``base, base+1, ...`` by ``order`` within ``partition``.

    Rows are range-partitioned on (partition, order) and sorted inside each
    task; a row's id is its rank inside the task plus the number of rows of
    the same ``partition`` key in earlier tasks. The offsets table has one
    row per (task, partition key), so it stays small whatever the skew.
    ``order`` must be unique within ``partition`` (ties make ids depend on
    sort stability). The numbered frame is written once, so the counts and the
    rows come from the same task assignment.
    """
    partition = list(partition)
    n = partitions or shuffle_partitions(df.sparkSession)
    keys = partition + list(order)
    r = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
         .withColumn("_tid", F.spark_partition_id())
         .withColumn("_local", F.monotonically_increasing_id()))
    # monotonically_increasing_id = (task << 33) + row index inside the task
    r = r.withColumn("_local", F.col("_local") - F.shiftleft(F.col("_tid").cast("long"), 33))
    # The numbered rows feed two branches (the rows and the per-task
    # counts): both must see the same task assignment, so the frame is
    # written once to the shared folder (which also keeps ids stable when an
    # executor is lost and a stage runs again).
    r = staged(r, "ids")
    cnt = r.groupBy("_tid", *partition).agg(F.count("*").alias("_n"), F.min("_local").alias("_lo"))
    w = Window.partitionBy(*partition).orderBy("_tid") if partition else Window.orderBy("_tid")
    cnt = cnt.withColumn("_off", F.coalesce(
        F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = r.join(cnt.select("_tid", *partition, "_off", "_lo"), ["_tid", *partition])
    return out.withColumn(name, (F.col("_off") + F.col("_local") - F.col("_lo") + base).cast("long")) \
              .drop("_tid", "_local", "_off", "_lo")


def ordered_distinct(df: DataFrame, keys: list[str], value: str, order: str, name: str) -> DataFrame:
    """A2: distinct values per key in first-seen order (as an array).

    Step one is a partial aggregate on (key, value); step two orders the
    already distinct values by first position.
    """
    first = df.groupBy(*keys, value).agg(F.min(order).alias("_o"))
    g = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_o", value))).alias("_l"))
    return g.select(*keys, F.col(f"_l.{value}").alias(name))


def ordered_parts(df: DataFrame, keys: list[str], value: str, order: str, name: str, size: int = 1000) -> DataFrame:
    """A2 for keys of any size: the distinct values of a key in first-seen order, in parts of ``size``: (*keys, part, name).

    Positions come from ``dense_ids`` within the key, so a key that holds most values is ranked by many tasks, and no
    array is longer than ``size``; the parts one after the other are the array of ``ordered_distinct``.
    """
    first = df.groupBy(*keys, value).agg(F.min(order).alias("_o"))
    at = dense_ids(first, ["_o", value], name="_at", partition=keys)
    g = at.groupBy(*keys, F.floor(F.col("_at") / size).cast("long").alias("part")).agg(F.sort_array(F.collect_list(F.struct("_at", value))).alias("_l"))
    return g.select(*keys, "part", F.col(f"_l.{value}").alias(name))


def land_firsts(path: str, landing: int, df: DataFrame, keys: list[str], order: list[str], count: str = "n_copies") -> None:
    """D1 / L8 over landings: keep the first row of each key of one landing (a micro-batch) under ``path``. Each landing
    overwrites its own folder only, so a replay changes nothing, and a key that was seen before costs one row."""
    first_per_key(df, keys, order, count).write.mode("overwrite").parquet(f"{path.rstrip('/')}/landing={landing}")


def merged_firsts(spark: SparkSession, path: str, keys: list[str], order: list[str], count: str = "n_copies") -> DataFrame:
    """The survivors of all landings under ``path``: the same rows, and numbers of copies, as one batch run gives, whatever the
    split into landings and whatever their order."""
    rows = spark.read.parquet(path).drop("landing")
    whole = [c for c in rows.columns if c != count]
    g = rows.groupBy(row_key(keys).alias("_key")).agg(F.min_by(F.struct(*whole), F.struct(*order)).alias("_f"), F.sum(count).alias(count))
    return g.select("_f.*", count)


def subject_dim(courses: DataFrame, name_col: str = "SubjectName", code_col: str = "courseCode",
                desc_col: str = "SubjectDescription", order: str = "ord",
                partition: list[str] = (), base: int = 0) -> DataFrame:
    """A1-A3: one row per subject name: description of its first course,
    its course codes distinct in first-seen order, and a dense id by first
    appearance. Subjects named ``""`` form one subject, and ``""`` can be
    a code.

    The courses are read once: one aggregate by (name, code) holds the first
    position and the description there; it is rolled up to the names.
    """
    keys = [*partition, name_col]
    pairs = courses.groupBy(*keys, code_col).agg(F.min(order).alias("_o"), F.min_by(desc_col, order).alias("_desc"))
    d = pairs.groupBy(*keys).agg(
        F.min("_o").alias("_first"), F.min_by("_desc", "_o").alias("description"),
        F.sort_array(F.collect_list(F.struct("_o", code_col))).alias("_l"))
    d = dense_ids(d.withColumn("codes", F.col(f"_l.{code_col}")).drop("_l"), ["_first"], name="subjectId", partition=partition, base=base)
    return d.select(*partition, "subjectId", F.col(name_col).alias("name"), "codes", "description", "_first")


def extend_ids(registry: DataFrame | None, df: DataFrame, keys: list[str], order: list[str], name: str = "id", base: int = 0) -> DataFrame:
    """A3 over landings: ids for the keys of ``df`` that ``registry(*keys, name)`` doesn't know yet, dense after its greatest one, in
    first-seen order. Ids that were given out never change: the result holds the new keys only.

    Keys are compared by a digest (NULL is a key). The new keys are found by an anti join of the distinct keys,
    which one partial aggregate makes, so a key that holds most rows is reduced on each mapper.
    """
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_o")).withColumn("_key", row_key(keys))
    if registry is not None:
        first = first.join(registry.select(row_key(keys).alias("_key")), "_key", "left_anti")
        base = max(base, (registry.agg(F.max(name)).first()[0] or base - 1) + 1) if registry.limit(1).count() else base
    return dense_ids(first.drop("_key"), ["_o", *keys], name=name, base=base).select(*keys, name)


def register_landing(path: str, landing: int, df: DataFrame, keys: list[str], order: list[str], name: str = "id", base: int = 0) -> DataFrame:
    """Give ids to the new keys of a landing and keep them under ``path``, one folder a landing; returns the registry up to it.

    A landing sees the ids of the landings before it only and writes its own folder, so running it again gives the
    same ids and doesn't touch later ones' rows twice. Landings are run in their order.
    """
    spark = df.sparkSession
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)
    schema = f"{types}, `{name}` long"
    folder = lambda k: f"{path.rstrip('/')}/landing-{k:06d}"
    known = spark.read.schema(schema).parquet(*map(folder, range(landing))) if landing else None
    extend_ids(known, df, keys, order, name, base).select(*[f.name for f in df.schema.fields if f.name in keys], name).write.mode("overwrite").parquet(folder(landing))
    return spark.read.schema(schema).parquet(*map(folder, range(landing + 1)))


#: A dimension of at most this many rows is sent to every task for a lookup.
LOOKUP_ROWS = 100_000
#: Parts that the rows of one key are dealt into where the dimension is larger.
SALT = 32


def attach_ids(rows: DataFrame, dim: DataFrame, on: list[str], id_col: str) -> DataFrame:
    """Look up a dimension id per row (equi N:1 join).

    A dimension of at most ``LOOKUP_ROWS`` rows, which is counted, is broadcast:
    the rows don't move, however many share a key. A larger one is joined on the
    keys and a salt, so the rows of one key go to ``SALT`` tasks.
    """
    d = dim.select(*on, id_col)
    if d.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS:
        return rows.join(F.broadcast(d), on, "left")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALT)).cast("int"))  # the same on every run
    every = d.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(every, [*on, "_salt"], "left").drop("_salt")


def stage_counts(df: DataFrame, *by: str) -> DataFrame:
    """Rows per source (what the reference prints per stage)."""
    return df.groupBy(*(by or ["source"])).agg(F.count("*").alias("n_rows"))
