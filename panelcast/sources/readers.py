"""Sources: the raw measurement table from CSV, parquet or a catalog table.

The raw table has one row per measurement: a date, a site, a node and a load.
Every reader returns a plain DataFrame so the panel builder downstream stays
lazy; Catalyst prunes columns and pushes the not-null filters into the scan.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.scalar import parse_date

# The raw sample's header and the date pattern of its first column.
RAW_COLUMNS = ("time_key", "sites", "node_desc", "ds_load")
RAW_DATE_FORMAT = "M/d/yyyy"

RAW_SCHEMA = T.StructType([
    T.StructField("time_key", T.StringType(), True),
    T.StructField("sites", T.StringType(), True),
    T.StructField("node_desc", T.StringType(), True),
    T.StructField("ds_load", T.DoubleType(), True),
])

ORDINAL = "_ord"
CORRUPT = "_corrupt_record"


def with_input_ordinal(df: DataFrame, name: str = ORDINAL) -> DataFrame:
    """Tag the rows of a file scan with their place in the input.

    Spark packs file splits into tasks by size, so a task number says nothing
    about the order of files. The tag is (file, start of the split, row within
    the task), which sorts by file name and then by place in the file, and does
    not change when a task is run again. Anything but a fresh scan has no input
    order and is refused: give such rows a tie-break column instead.
    """
    try:
        place = F.struct(F.col("_metadata.file_path").alias("file"),
                         F.col("_metadata.file_block_start").alias("split"),
                         F.monotonically_increasing_id().alias("row"))
        return df.select("*", place.alias(name))
    except AnalysisException as e:
        raise ValueError("rows that do not come straight from files have no input order; "
                         "pass a tie-break column") from e


def scan_lines(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """The fields of every line as text, and ``CORRUPT``: the line itself if it has
    another number of fields (else null).

    Fields are converted by expressions afterwards: what the parser converts, and
    so what it finds wrong, would depend on the columns that a query reads.
    """
    texts = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    return (spark.read.option("header", header).option("mode", "PERMISSIVE").option("columnPruning", False)
            .option("columnNameOfCorruptRecord", CORRUPT)
            .schema(texts.add(CORRUPT, T.StringType(), True)).csv(path))


def field_problems(schema: T.StructType, dates: dict[str, str] | None = None) -> Column:
    """Array of (column, reason) over a frame of :func:`scan_lines`; empty for a line that fits.

    ``dates`` maps text columns to the date pattern that their values must match.
    """
    def problem(bad: Column, column: str | None, reason: Column) -> Column:
        return F.when(bad, F.struct(F.lit(column).cast("string").alias("column"), reason.alias("reason")))

    found = [problem(F.col(CORRUPT).isNotNull(), None, F.lit(f"not a line of {len(schema.fields)} fields"))]
    fits = F.col(CORRUPT).isNull()
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, T.StringType):
            found.append(problem(fits & c.isNotNull() & c.try_cast(f.dataType).isNull(), f.name,
                                 F.concat(F.lit(f"not a {f.dataType.simpleString()}: "), c)))
    for name, fmt in (dates or {}).items():
        c = F.col(f"`{name}`")
        found.append(problem(fits & c.isNotNull() & parse_date(c, fmt, "null").isNull(), name,
                             F.concat(F.lit("not a date: "), c)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def typed_fields(schema: T.StructType) -> list[Column]:
    return [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields]


def read_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA,
             header: bool = True, ordinal: bool = False) -> DataFrame:
    """CSV source with an explicit schema (no inference pass over the data).

    A line that does not fit the schema is an error, whichever columns are read
    (:func:`panelcast.sources.reject_ledger.load_csv` keeps such lines in a
    ledger instead). A UTF-8 byte-order mark at the start of the file is
    stripped by Spark's CSV reader. ``sites`` is read as a string so codes keep
    leading zeros.
    """
    lines = scan_lines(spark, path, schema, header)
    if ordinal:
        lines = with_input_ordinal(lines)
    problem = F.get(field_problems(schema), 0)
    text = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*[F.col(f"`{f.name}`") for f in schema.fields])))
    error = F.raise_error(F.concat(F.lit("malformed line ("), problem["reason"], F.lit("): "), text)).cast("boolean")
    fits = lines.where(F.when(problem.isNull(), F.lit(True)).otherwise(error))
    return fits.select(*typed_fields(schema), *([ORDINAL] if ordinal else []))


def read_parquet(spark: SparkSession, path: str, ordinal: bool = False) -> DataFrame:
    """Default-format source (``spark.read.load`` reads parquet)."""
    df = spark.read.load(path)
    return with_input_ordinal(df) if ordinal else df


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Catalog table or temp view source."""
    return spark.table(name)


def register_view(df: DataFrame, name: str) -> str:
    """Register ``df`` as a session temp view and return the name."""
    df.createOrReplaceTempView(name)
    return name


def warehouse_panel_sql(spark: SparkSession, view: str,
                        date_col: str = "dt", site_col: str = "site_id",
                        node_col: str = "node_desc",
                        load_col: str = "us_load") -> DataFrame:
    """The warehouse path in SQL: clean, sum per (date, site, node), key.

    Casts the site id to a string, replaces a missing node by the text
    ``'null'``, keeps only rows whose load is present, sums the load per
    (date, site, node) and builds ``market = site || node``. Returns
    ``(date, market, value)``.
    """
    cleaned = f"{view}__clean"
    spark.sql(f"""
        SELECT {date_col} AS dt,
               CAST({site_col} AS STRING) AS site_id,
               COALESCE({node_col}, 'null') AS node_desc,
               {load_col} AS us_load
        FROM {view}
        WHERE {load_col} IS NOT NULL
    """).createOrReplaceTempView(cleaned)
    summed = f"{view}__sum"
    spark.sql(f"""
        SELECT dt, site_id, node_desc, SUM(us_load) AS value
        FROM {cleaned}
        GROUP BY dt, site_id, node_desc
    """).createOrReplaceTempView(summed)
    return spark.sql(f"""
        SELECT dt AS date, CONCAT(site_id, node_desc) AS market, value
        FROM {summed}
    """)
