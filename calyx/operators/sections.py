"""Section records from JSON payloads (P1 pieces: S3, S4, O1, J2, T19, A4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The schema of the course-search payload. Members without a
# type in the source are kept as JSON text.
MEETING_TIME = (
    "struct<beginTime string, building string, buildingDescription string, campus string, campusDescription string, "
    "category string, class string, courseReferenceNumber string, creditHourSession double, endDate string, "
    "endTime string, friday boolean, hoursWeek double, meetingScheduleType string, meetingType string, "
    "meetingTypeDescription string, monday boolean, room string, saturday boolean, startDate string, sunday boolean, "
    "term string, thursday boolean, tuesday boolean, wednesday boolean>")
SECTION = (
    "struct<id int, term string, termDesc string, courseReferenceNumber string, partOfTerm string, "
    "courseNumber string, subject string, subjectDescription string, sequenceNumber string, "
    "campusDescription string, scheduleTypeDescription string, courseTitle string, creditHours double, "
    "maximumEnrollment int, enrollment int, seatsAvailable int, waitCapacity int, waitCount int, waitAvailable int, "
    "crossList string, crossListCapacity string, crossListCount string, crossListAvailable string, "
    "creditHourHigh double, creditHourLow int, creditHourIndicator string, openSection boolean, linkIdentifier string, "
    "isSectionLinked boolean, subjectCourse string, faculty array<string>, meetingsFaculty array<struct<"
    "category string, class string, courseReferenceNumber string, faculty array<string>, "
    f"meetingTime {MEETING_TIME}, term string>>, reservedSeatSummary string, sectionAttributes array<struct<"
    "class string, code string, courseReferenceNumber string, description string, isZTCAttribute boolean, "
    "termCode string>>>")
SEARCH_RESPONSE = f"success boolean, totalCount int, pageOffset int, pageMaxSize int, data array<{SECTION}>"
PAIRS = "array<struct<code string, description string>>"


def search_sections(df: DataFrame, body_col: str = "body", keep: list[str] = (), order: str = "s_ord") -> DataFrame:
    """S3 + X3: search response JSON -> one row per ``data[]`` section, with its
    place ``order`` in the response."""
    p = df.select(*keep, F.from_json(F.col(body_col), SEARCH_RESPONSE).alias("_r"))
    return p.select(*keep, F.posexplode("_r.data").alias(order, "_d")).select(*keep, order, "_d.*")


def code_pairs(df: DataFrame, body_col: str = "body", keep: list[str] = (), order: str = "o") -> DataFrame:
    """``[{code, description}, ...]`` JSON -> rows, with their place ``order``."""
    p = df.select(*keep, F.posexplode(F.from_json(F.col(body_col), PAIRS)).alias(order, "_p"))
    return p.select(*keep, order, "_p.code", "_p.description")


def enrollment(df: DataFrame, actual: Column, max_: Column, wait_actual: Column,
               wait_max: Column, name: str = "Enrollment") -> DataFrame:
    """Nested enrollment struct, Available = Max - Actual (a source's
    own "available" columns are not used)."""
    st = F.struct(
        F.struct(actual.alias("Actual"), max_.alias("Max"), (max_ - actual).alias("Available")).alias("Enrolled"),
        F.struct(wait_actual.alias("Actual"), wait_max.alias("Max"),
                 (wait_max - wait_actual).alias("Available")).alias("Waitlist"))
    return df.withColumn(name, st)


def enrich(base: DataFrame, lookups: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """1:1 enrichment by left joins on keys, in order. Spark picks the
    join strategy; AQE demotes to broadcast only when a side is measured
    small at runtime."""
    out = base
    for df, keys in lookups:
        out = out.join(df, keys, "left")
    return out


def two_level_join(df: DataFrame, keys: list[str], order: str, cells: list[str],
                   cell_sep: str = " ", row_sep: str = ";", chunk: int = 4096) -> DataFrame:
    """A4: cells of a row joined by ``cell_sep``, rows of a group by
    ``row_sep`` in ``order``; as in the reference's loop the separator is
    written before every row and the single leading one trimmed.

    A group may hold a large share of all rows, so the rows are first
    joined in ordered chunks of ``chunk`` consecutive order values (a
    shuffle on (group, chunk) spreads one hot group over many tasks); the
    second step only joins the chunk strings in order. ``order`` must be
    integral.
    """
    r = df.withColumn("_row", F.concat(F.lit(row_sep), F.concat_ws(cell_sep, *[F.col(c) for c in cells])))
    r = r.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)))
    c = r.groupBy(*keys, "_chunk").agg(
        F.count("*").alias("_n"),
        F.expr(f"listagg(_row, '') WITHIN GROUP (ORDER BY {order})").alias("_part"))
    g = c.groupBy(*keys).agg(
        F.sum("_n").alias("n_turns"),
        F.expr("listagg(_part, '') WITHIN GROUP (ORDER BY _chunk)").alias("_j"))
    return g.withColumn("joined", F.when(F.col("_j").startswith(row_sep),
                                         F.substr("_j", F.lit(len(row_sep) + 1)))
                        .otherwise(F.col("_j"))).drop("_j")


def cap_per_group(df: DataFrame, keys: list[str], order: list[str], n: int | None) -> DataFrame:
    """O2: at most ``n`` rows per group in ``order`` (the reference asks its
    source for 100 sections per subject). ``None`` (the default everywhere)
    keeps every row."""
    if n is None:
        return df
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def first_terms(terms: DataFrame, order: str | list[str], n: int = 3) -> DataFrame:
    """O1: the first ``n`` terms in source order (top-k: partial per task)."""
    return terms.orderBy(order).limit(n)


ColumnOrName = Column | str


def variant_payload(df: DataFrame, col: str, name: str = "payload") -> DataFrame:
    """S3 without a schema: a JSON text as a VARIANT; NULL where it isn't JSON."""
    return df.withColumn(name, F.try_parse_json(col))


def member(payload: str, path: str, kind: str) -> Column:
    """A member of a VARIANT as ``kind``; NULL where it is missing or can't be one, whatever its type in other rows."""
    return F.try_variant_get(payload, path, kind)


def variant_kind(v: ColumnOrName) -> Column:
    """The JSON type of a VARIANT: object, array, string, number, boolean or null."""
    t = F.schema_of_variant(v)
    return (F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string")
            .when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").otherwise("number"))


def payload_members(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """The members of object payloads, a row each: ``keep``, ``key``, ``kind`` and ``value`` as JSON text. Members may change
    their type from row to row; nothing is read by a schema."""
    spark = df.sparkSession
    m = df.where(variant_kind(payload) == "object").lateralJoin(spark.tvf.variant_explode(F.col(payload).outer()))
    return m.select(*keep, "key", variant_kind("value").alias("kind"), F.to_json("value").alias("value"))


def payload_report(df: DataFrame, payload: str) -> DataFrame:
    """One row: the number of payloads and the schema that all of them fit, members of changing type as VARIANT."""
    return df.agg(F.count(payload).alias("n_payloads"), F.schema_of_variant_agg(payload).alias("schema"))
