"""Sinks: versioned tables whose state changes in one step, JSON publication, and a guard before either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltline.functions.paths import path_kinds
from siltline.functions.secrets import holds_secret

HOME = r"(?:^|[^\w/.])/(?:home|Users)/[^/\s]+/"  # a home folder, which redaction leaves but no publication may hold


def string_leaves(value: Column, kind: T.DataType, name: str) -> Column | None:
    """array<struct<column, value>> of all strings below a column: in structs, arrays, maps and the keys of maps."""
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return F.array(F.struct(F.lit(name).alias("column"), value.cast("string").alias("value")))
    if isinstance(kind, T.StructType):
        parts = [p for f in kind.fields if (p := string_leaves(value[f.name], f.dataType, f"{name}.{f.name}")) is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, T.ArrayType):
        below = lambda x: string_leaves(x, kind.elementType, name)
        if below(F.lit(None).cast(kind.elementType)) is None:
            return None
        return F.coalesce(F.flatten(F.transform(value, below)), F.array().cast("array<struct<column:string,value:string>>"))
    if isinstance(kind, T.MapType):
        parts = [string_leaves(F.map_keys(value), T.ArrayType(kind.keyType), f"{name}.<key>"), string_leaves(F.map_values(value), T.ArrayType(kind.valueType), name)]
        parts = [p for p in parts if p is not None]
        return F.concat(*parts) if parts else None
    return None


def leaks(df: DataFrame) -> DataFrame:
    """column, n: strings that hold a local path or a credential, at any depth; names of columns are looked at too."""
    parts = [p for f in df.schema.fields if (p := string_leaves(F.col(f"`{f.name}`"), f.dataType, f.name)) is not None]
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, n long")
    leaves = df.select(F.explode(F.concat(*parts)).alias("x")).select("x.*").filter("value <> ''")
    bad = F.col("value").rlike(HOME) | (F.size(path_kinds(F.col("value"))) > 0) | holds_secret(F.col("value"))
    return leaves.filter(bad).groupBy("column").agg(F.count("*").alias("n"))


def assert_public(df: DataFrame) -> DataFrame:
    """``df`` itself, or an error that names the columns with local paths or credentials."""
    found = {r["column"]: r.n for r in leaks(df).collect()}
    if found:
        raise ValueError(f"not fit for publication: {found}")
    return df


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The table in force at a place, or None."""
    version = _version(spark, path)
    return spark.read.parquet(f"{path}/v{version}") if version else None


def _version(spark: SparkSession, path: str) -> int:
    fs, at = _file_system(spark, f"{path}/current")
    if not fs.exists(at):
        return 0
    return int(spark.read.text(f"{path}/current").first().value)


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None, keep: int = 2) -> int:
    """Write a table as a new version and name it as the one in force; gives its number.

    The name is swapped last, in one small file: whoever reads before sees the old version, which stays whole. The last ``keep``
    versions are kept.
    """
    spark = df.sparkSession
    version = _version(spark, path) + 1
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{path}/v{version}")
    spark.createDataFrame([(str(version),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/next")
    fs, current = _file_system(spark, f"{path}/current")
    _, new = _file_system(spark, f"{path}/next")
    fs.delete(current, True)
    fs.rename(new, current)
    for old in range(max(1, version - keep - 2), version - keep + 1):
        fs.delete(_file_system(spark, f"{path}/v{old}")[1], True)
    return version


def publish_changed(df: DataFrame, path: str, digest: str) -> int:
    """Publish only if a row's ``digest`` is new or gone; gives the number of changed rows."""
    stored = published(df.sparkSession, path)
    if stored is None:
        changed = df.count()
    else:
        stored = stored.select(digest)
        changed = df.join(stored, digest, "left_anti").count() + stored.join(df.select(digest), digest, "left_anti").count()
    if changed:
        publish(df, path)
    return changed


def knowledge_base(stats: DataFrame, tables: dict[str, DataFrame], path: str) -> None:
    """One folder of published tables with their statistics, behind the guard against leaks."""
    for name, df in {"stats": stats, **tables}.items():
        publish(assert_public(df), f"{path}/{name}")


def write_list(df: DataFrame, path: str) -> None:
    """A saved list back as CSV, quoted so that texts with line breaks and quotes come back as they were."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").option("nullValue", "\\N").csv(path)


def prepare(records: DataFrame, stored: DataFrame | None, key: str = "id", fingerprint: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """(to write, manifest) of records: those whose fingerprint isn't stored are written, all but duplicates are listed with what happens."""
    unique = records.filter("duplicate_of is null")
    if stored is None:
        return unique, unique.select(key, fingerprint, F.lit("written").alias("action"))
    known = stored.select(key, fingerprint).distinct().withColumn("known", F.lit(True))
    j = unique.join(known, [key, fingerprint], "left")
    return j.filter("known is null").select(*records.columns), j.select(key, fingerprint, F.when(F.col("known"), "unchanged").otherwise("written").alias("action"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, with null fields written."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
