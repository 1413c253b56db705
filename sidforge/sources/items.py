"""Item tables: partition scan, projection, cleaning."""

from __future__ import annotations

import logging

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sidforge.functions.geo import with_geohash
from sidforge.functions.text import field_text, is_blank_sql
from sidforge.operators.identity import take_first

log = logging.getLogger(__name__)

# Column names of the item table. i_lag is the latitude.
LNG, LAT, GEOHASH = "i_lng", "i_lag", "geohash"
ITEM_FIELDS = [
    "item_id", "sence_id", "title", "description", "brand", "shop_id", "i_lng", "i_lag", "geohash",
]
DATA_FILES = "part-*"


def scan_items(
    spark: SparkSession, root: str, table: str, dt: str, country: str, located: bool = False
) -> DataFrame:
    """Data files of one ``dt`` / ``country_code`` partition.

    Only that folder is listed, so the cost does not depend on how many other
    partitions exist. The partition values are added as the labels they are.

    Every file counts with its own columns: a column that a file lacks is null in its rows.
    Whole numbers of different widths become the widest, ``float`` and ``double`` become
    ``double``, any other mix of types becomes text. ``located`` keeps the readers'
    ``_metadata``, from which rows are numbered.
    """
    folder = f"{root.rstrip('/')}/{table}/dt={dt}/country_code={country}"
    reader = spark.read.option("pathGlobFilter", DATA_FILES)
    try:
        # One job over all footers.
        schema = reader.option("mergeSchema", True).parquet(folder).schema
    except (PySparkException, Py4JJavaError) as problem:
        if _is_missing(problem):
            raise FileNotFoundError(f"no {DATA_FILES} files in {folder}") from problem
        if not _is_conflict(problem):
            raise
        listing = spark.read.format("binaryFile").option("pathGlobFilter", DATA_FILES).load(folder)
        paths = sorted(r.path for r in listing.select("path").collect())
        files = _union(spark, _readable_groups(spark, paths), located)
    else:
        files = spark.read.option("pathGlobFilter", DATA_FILES).schema(schema).parquet(folder)
        if located:
            files = files.select("*", "_metadata")
    return files.withColumns({"dt": F.lit(dt), "country_code": F.lit(country)})


def _is_missing(problem: Exception) -> bool:
    return isinstance(problem, AnalysisException) and problem.getCondition() in (
        "PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA",
    )


def _is_conflict(problem: Exception) -> bool:
    """Whether footers disagree on a type. Spark's job reports it in its own text."""
    return "CANNOT_MERGE" in str(problem)


def _readable_groups(spark: SparkSession, paths: list[str]) -> list[tuple[dict[str, T.DataType], list[str]]]:
    """Columns and files of groups in which each column has one type.

    Files whose footers agree are read as they are; others are halved until they do, and parts
    that agree after all meet again. There are as many groups as mixes of types.
    """

    def parts(paths):
        try:
            schema = spark.read.option("mergeSchema", True).parquet(*paths).schema
        except (PySparkException, Py4JJavaError) as problem:
            if not _is_conflict(problem) or len(paths) == 1:
                raise
            half = len(paths) // 2
            return parts(paths[:half]) + parts(paths[half:])
        return [({f.name: f.dataType for f in schema}, paths)]

    groups: list[tuple[dict[str, T.DataType], list[str]]] = []
    for columns, own in parts(paths):
        for known, members in groups:
            if all(known.get(name, kind) == kind for name, kind in columns.items()):
                known.update(columns)
                members.extend(own)
                break
        else:
            groups.append((dict(columns), list(own)))
    return groups


def _common_type(kinds: list[T.DataType]) -> T.DataType:
    """The type that holds a column of several types without changing its text."""
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    for family, widest in (
        ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), T.LongType()),
        ((T.FloatType, T.DoubleType), T.DoubleType()),
    ):
        if all(isinstance(k, family) for k in kinds):
            return widest
    return T.StringType()


def _union(spark: SparkSession, groups: list[tuple[dict[str, T.DataType], list[str]]], located: bool) -> DataFrame:
    names = list(dict.fromkeys(n for columns, _ in groups for n in columns))
    wanted = {n: _common_type([columns[n] for columns, _ in groups if n in columns]) for n in names}

    def read(columns, paths):
        schema = T.StructType([T.StructField(n, k) for n, k in columns.items()])
        rows = spark.read.schema(schema).parquet(*paths)

        def column(name):
            if name not in columns:
                return F.lit(None).cast(wanted[name]).alias(name)
            value, kind = F.col(f"`{name}`"), columns[name]
            if kind == wanted[name]:
                return value
            text = isinstance(wanted[name], T.StringType)
            return (field_text(value, kind) if text else value.cast(wanted[name])).alias(name)

        return rows.select(*map(column, names), *(["_metadata"] if located else []))

    return reduce(DataFrame.unionByName, (read(*g) for g in groups))


def extract_items(
    spark: SparkSession,
    root: str,
    table: str,
    dt: str,
    country: str,
    fields: list[str] | None = None,
    n: int = -1,
    precision: int = 6,
    idx: str = "idx",
) -> DataFrame:
    """The item table of one raw partition: its first ``n`` rows (-1: all) in file order, all
    fields as text, rows without coordinates dropped, with the row number in ``idx``."""
    fields = list(fields or ITEM_FIELDS)
    located = scan_items(spark, root, table, dt, country, located=True)
    rows = take_first(located.drop("dt", "country_code"), n, idx)
    picked = select_fields(rows, [idx, *fields], precision)
    return drop_blank_geo(stringify(picked, fields))


def select_fields(df: DataFrame, fields: list[str] | None = None, precision: int = 6) -> DataFrame:
    """The configured fields; absent ones are null, the geohash is computed.

    A geohash column in the data is never read.
    """
    fields = list(fields or ITEM_FIELDS)
    wanted = [f for f in fields if f != GEOHASH]
    wanted += [c for c in (LNG, LAT) if GEOHASH in fields and c not in wanted]
    missing = [f for f in wanted if f not in df.columns]
    if missing:
        log.warning("fields not in the table, left empty: %s", missing)

    def source(name: str) -> str:
        return "cast(null as string)" if name in missing else f"`{name}`"

    picked = df.selectExpr(*[f"{source(f)} as `{f}`" for f in wanted])
    if GEOHASH in fields:
        picked = with_geohash(picked, GEOHASH, LNG, LAT, precision)
    return picked.select(*fields)


def stringify(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Every field as text, null as the empty string."""
    names = set(df.columns if fields is None else fields)

    def text(field: T.StructField):
        value = F.col(f"`{field.name}`")
        return F.coalesce(field_text(value, field.dataType), F.lit("")).alias(field.name)

    return df.select(*[text(f) if f.name in names else F.col(f"`{f.name}`") for f in df.schema])


# True where either coordinate is empty or white space.
BLANK_GEO = f"({is_blank_sql(LNG)} or {is_blank_sql(LAT)})"


def drop_blank_geo(df: DataFrame) -> DataFrame:
    """Rows with both coordinates filled in; text that is no number stays."""
    return df.where(f"not {BLANK_GEO}")


def geo_drop_stats(df: DataFrame) -> DataFrame:
    """One row: rows before, dropped, kept, and the dropped share in percent."""
    counts = df.selectExpr(f"{BLANK_GEO} as blank").agg(
        F.count("*").alias("total"), F.count_if("blank").alias("dropped")
    )
    return counts.selectExpr(
        "total",
        "dropped",
        "total - dropped as kept",
        "try_divide(dropped * 100D, total) as dropped_pct",
    )
