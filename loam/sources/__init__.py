"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_tsv(spark: SparkSession, path: str, schema: StructType, rejects: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Tab-separated text with a header and no quoting, by a declared schema: the rows, and with
    `rejects` the lines that do not parse (else they are left out)."""
    reader = spark.read.option("sep", "\t").option("quote", "").option("header", "true")
    if not rejects:
        return reader.option("mode", "DROPMALFORMED").schema(schema).csv(path), None
    full = StructType([*schema.fields, StructField("_corrupt", StringType())])
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(full).csv(path)
    return rows.where("_corrupt is null").drop("_corrupt"), rows.where("_corrupt is not null").select("_corrupt", schema.fieldNames()[0])


def staged(df_of, spark: SparkSession, path: str, fresh: bool = False) -> DataFrame:
    """The table at path, made by df_of() if it is not there or `fresh`."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if fresh or not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        df_of().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside the table and renames, so that a reader sees the old or the new one."""
    df.write.mode("overwrite").parquet(path + ".part")
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(path + ".part"), jvm.org.apache.hadoop.fs.Path(path)
    fs = old.getFileSystem(conf)
    fs.delete(old, True)
    fs.rename(new, old)


def json_document(df: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """One compact JSON document a group: rows as arrays in a fixed order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*[c for c in df.columns if c not in order and c not in keys]).alias("_rest")))), lambda r: r)
    return df.groupBy(*keys).agg(F.to_json(rows).alias("json"))


def geojson_lines(df: DataFrame, geometry: str, id_: str) -> DataFrame:
    """A GeoJSON feature a line; geometry: struct of type and coordinates."""
    props = F.struct(*[c for c in df.columns if c not in (geometry, id_)])
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(id_).alias("id"), F.col(geometry).alias("geometry"), props.alias("properties"))).alias("value"))


def pages_complete(pages: DataFrame, page: str, n: str, size: int, least: int) -> DataFrame:
    """Checks on a paged pull, one row: all pages but the last full, none missing, enough rows. pages: page, n."""
    a = pages.agg(F.max(page).alias("last"), F.count(F.lit(1)).alias("pages"), F.sum(n).alias("rows"), F.count_if(F.col(n) > size).alias("over"))
    short = pages.join(F.broadcast(a.select("last")), F.col(page) < F.col("last")).agg(F.count_if(F.col(n) < size).alias("short"))  # one row
    ok = (F.col("pages") == F.col("last") + 1) & (F.col("short") == 0) & (F.col("over") == 0) & (F.col("rows") >= least)
    return a.crossJoin(short).select("pages", "rows", "short", ok.alias("ok"))


def drift(before: Column, after: Column, most: float = 0.01) -> Column:
    """Whether a count moved by more than a share between two pulls."""
    return F.abs(after - before) / F.greatest(before, F.lit(1)) > most


def upsert(tiles: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT OR REPLACE: rows of new win over rows with the same key."""
    return tiles.join(new.select(*keys), keys, "left_anti").unionByName(new)


def valid_prefix(records: DataFrame, journal: str, order: str) -> DataFrame:
    """Journal recovery: records up to the first whose content does not match its digest. records: blob, digest."""
    from pyspark.sql import Window

    bad = (F.sha2("blob", 256) != F.col("digest")) | F.col("blob").isNull()
    w = Window.partitionBy(journal).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("_bad", F.sum(bad.cast("int")).over(w)).where("_bad = 0").drop("_bad")


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value of text files."""
    t = spark.read.option("wholetext", "true").text(path).withColumn("file", F.input_file_name())
    return t.select("file", F.posexplode(F.split("value", "\n")).alias("line", "value"))


def headings(lines: DataFrame) -> DataFrame:
    """Numbered headings of text lines. lines: file, line, value."""
    p = r"^\s*(\d+(?:\.\d+)*)\s+([A-Z].*?)\s*$"
    return lines.where(F.col("value").rlike(p)).select("file", "line", F.regexp_extract("value", p, 1).alias("number"), F.regexp_extract("value", p, 2).alias("title"))
