"""Ad-hoc SQL, table descriptions and column profiles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import top_k
from ..session import stored

# Words a read-only query may not hold, and its two messages.
FORBIDDEN_WORDS = ["DROP", "DELETE", "TRUNCATE", "ALTER", "CREATE", "INSERT", "UPDATE",
                   "GRANT", "REVOKE", "ATTACH", "DETACH"]


def check_read_only(sql: str) -> str | None:
    """Why the text is not an allowed read query; None if it is."""
    text = sql.upper().strip()
    for word in FORBIDDEN_WORDS:
        if re.search(rf"\b{word}\b", text):
            return f"Query contains disallowed keyword: {word}"
    if not text.startswith(("SELECT", "WITH")):
        return "Read queries must start with SELECT or WITH"
    return None


# Functions that run code of the JVM.
CODE_CALLS = re.compile(r"\b(?:try_)?(?:reflect|java_method)\(", re.IGNORECASE)
ON_FILES = "spark.sql.runSQLOnFiles"


def run_query(
    spark: SparkSession, sql: str, params: dict | None = None, read_only: bool = True,
    tables: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """SQL over registered tables; `:name` parameters are bound, not pasted in.

    A read-only query may not name files as tables, and its analysed plan may
    not hold functions that run JVM code.
    """
    if read_only:
        error = check_read_only(sql)
        if error:
            raise ValueError(error)
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    if not read_only:
        return spark.sql(sql, args=params or {})
    before = spark.conf.get(ON_FILES)
    spark.conf.set(ON_FILES, "false")
    try:
        df = spark.sql(sql, args=params or {})
    finally:
        spark.conf.set(ON_FILES, before)
    if CODE_CALLS.search(df._jdf.queryExecution().analyzed().toString()):
        raise ValueError("Query calls a function that is not allowed")
    return df


def describe_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column: table, position, column, type, rows and bytes of the table.

    Row counts are one aggregate per table; sizes come from the scanned files.
    """
    out = None
    for name, df in sorted(tables.items()):
        fields = F.array(*[
            F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                     F.lit(f.dataType.simpleString()).alias("type"))
            for i, f in enumerate(df.schema.fields)
        ])
        size = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"))
        totals = size.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("s")).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum("s"), F.lit(0)).alias("size_bytes"),
        )
        rows = totals.select(F.lit(name).alias("table"), F.inline(fields), "row_count", "size_bytes")
        out = rows if out is None else out.unionByName(rows)
    return out


def table_stats(df: DataFrame, ts: str = "ts", tenant: str = "tenant_id", exact: bool = False) -> DataFrame:
    """Rows, first and last time, number of tenants."""
    tenants = F.count_distinct(tenant) if exact else F.approx_count_distinct(tenant)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"),
        tenants.alias("tenant_count"),
    )


def profile_column(df: DataFrame, column: str, exact: bool = False) -> DataFrame:
    """One row: different values, rows, nulls, null share."""
    c = F.col(column)
    distinct = F.count_distinct(c) if exact else F.approx_count_distinct(c)
    return df.agg(
        distinct.alias("cardinality"), F.count(F.lit(1)).alias("total_count"),
        F.count_if(c.isNull()).alias("null_count"),
    ).withColumn(
        "null_percent",
        F.when(F.col("total_count") > 0, F.col("null_count") / F.col("total_count") * 100).otherwise(0.0),
    ).select(F.lit(column).alias("column"), "*")


def top_values(df: DataFrame, column: str, k: int = 100) -> DataFrame:
    """Most frequent values of a column."""
    return (
        df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "value").limit(k)
    )


TRACKED = 10_000


def frequent_values(df: DataFrame, columns: list[str] | None = None, k: int = 100, tracked: int = TRACKED) -> DataFrame:
    """Most frequent values of columns, exact, with `rank`: the rows of `profile_table_top`.

    A first pass keeps a summary of at most `tracked` values per column, which
    combine on the map side; a second one counts those candidates.  A value
    that is no candidate has at most `2 * error` rows, where `error` is the
    summary's bound: so the result is proven where the k-th candidate has
    more, and also where the candidates are all there is.  Only the columns for
    which neither holds are counted in full.  Shuffled rows of
    the others are bounded by the summaries, not by the different values.
    """
    names = columns or df.columns
    texts = df.select([F.col(f"`{c}`").cast("string").alias(f"_{i}") for i, c in enumerate(names)])
    summaries = texts.agg(*[x for i in range(len(names)) for x in (
        F.count(f"_{i}").alias(f"_n{i}"), F.expr(f"approx_top_k(_{i}, {tracked}, {tracked})").alias(f"_t{i}"),
    )])
    found = stored(summaries.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("rows"), F.transform(f"_t{i}", lambda x: x["item"]).alias("values"))
        for i, c in enumerate(names)
    ]))), "summaries")
    candidates = found.select("column", F.explode("values").alias("value")).where(F.col("value").isNotNull())
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("value")) for i, c in enumerate(names)])
    rows = texts.select(F.inline(cells)).where(F.col("value").isNotNull())
    counts = stored(
        rows.join(candidates, ["column", "value"], "left_semi").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")), "counts"
    )
    top = top_k(counts, ["column"], [F.desc("count"), F.asc("value")], k)
    # The summary's table has a power of two of places and is off by 3.5 rows a place at most.
    places = 1 << (-(-4 * tracked // 3) - 1).bit_length()
    error = 2 * 3.5 / places * F.col("rows")
    all_ = counts.groupBy("column").agg(F.sum("count").alias("counted"))
    least = top.where(F.col("rank") == k).select("column", F.col("count").alias("least"))
    proven = (F.coalesce("counted", F.lit(0)) == F.col("rows")) | (F.coalesce("least", F.lit(0)) > error) | (error < 1)
    bound = found.join(all_, "column", "left").join(least, "column", "left").select("column", proven.alias("proven"))
    unproven = [r.column for r in bound.where("NOT proven").collect()]  # one row per column
    if not unproven:
        return top
    return top.where(~F.col("column").isin(unproven)).unionByName(_top_of(rows.where(F.col("column").isin(unproven)), k))


def _top_of(rows: DataFrame, k: int) -> DataFrame:
    """Most frequent values of (column, value) rows, all values counted."""
    counts = rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    return top_k(counts, ["column"], [F.desc("count"), F.asc("value")], k)


def _value_counts(df: DataFrame, columns: list[str] | None) -> DataFrame:
    names = columns or df.columns
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names
    ])
    return df.select(F.inline(cells)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def profile_table(df: DataFrame, columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    """Profile of every column in one aggregate; an empty table gives rows of zeros.

    Different values are estimated from sketches that combine on the map side;
    `exact` counts them, which shuffles every different value.
    """
    names = columns or df.columns
    count = F.count_distinct if exact else F.approx_count_distinct
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[count(F.col(c)).alias(f"_d{i}") for i, c in enumerate(names)],
        *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(names)],
    )
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.col(f"_d{i}").alias("cardinality"), F.col("_rows").alias("total_count"),
            F.col(f"_n{i}").alias("null_count"),
            F.when(F.col("_rows") > 0, F.col(f"_n{i}") / F.col("_rows") * 100).otherwise(0.0).alias("null_percent"),
        ) for i, c in enumerate(names)
    ])
    return one.select(F.inline(rows))


def profile_table_top(df: DataFrame, k: int = 100, columns: list[str] | None = None) -> DataFrame:
    """Most frequent values of every column."""
    counts = _value_counts(df, columns).where(F.col("value").isNotNull())
    return top_k(counts, ["column"], [F.desc("count"), F.asc("value")], k)
