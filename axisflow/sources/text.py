"""Line, CSV and JSONL sources and sinks. Schemas are explicit and order is a column, never assumed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisflow.functions.host import ustrip
from axisflow.operators.storage import cut

#: Line ends besides those the text reader knows: VT, FF, FS, GS, RS, NEL, LS, PS.
MORE_LINE_ENDS = "[\x0b\x0c\x1c\x1d\x1e\x85  ]"


def read_lines(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    """ord, value: stripped lines in order of file name and place in the file, blank ones left out."""
    raw = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("_at"))
    parts = raw.select("_at", F.posexplode(F.split("value", MORE_LINE_ENDS, -1)).alias("_i", "value"))
    lines = parts.select(F.struct("_at", "_i").alias("ord"), ustrip(F.col("value")).alias("value"))
    return lines if keep_blank else lines.filter("value <> ''")


def numbered(df: DataFrame) -> DataFrame:
    """Adds `n`, 0, 1, 2... in the order of `ord`: sorted by range partitions into a table, numbered within each, plus the sizes of those before."""
    ranged = cut(df.repartitionByRange("ord").sortWithinPartitions("ord").withColumn("_row", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_row", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))  # a row a partition
    out = ranged.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.select(*df.columns, (F.col("_before") + F.col("_row") - F.shiftleft("_part", 33)).alias("n"))


def read_parallel(spark: SparkSession, path: str, groups: str, name: str = "calibration_group") -> DataFrame:
    """value and its line of a second file. Empty group lines and different lengths are errors."""
    a = numbered(read_lines(spark, path)).select("n", "value")
    b = numbered(read_lines(spark, groups, keep_blank=True)).select("n", F.col("value").alias(name))
    blank = [r["n"] + 1 for r in b.filter(F.col(name) == "").orderBy("n").limit(5).collect()]
    if blank:
        raise ValueError(f"{groups} has empty lines: {blank}")
    if (n := a.count()) != (m := b.count()):
        raise ValueError(f"{path} has {n} lines and {groups} has {m}")
    return a.join(b, "n").select("n", "value", name)


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """hostname, family: rows of at least two cells; a header row and rows with a blank cell are left out."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("hostname", "family")])
    df = spark.read.schema(schema).option("header", False).option("ignoreLeadingWhiteSpace", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    df = df.filter("hostname is not null and family is not null").withColumn("family", ustrip(F.col("family")))
    header = (F.lower(ustrip(F.col("hostname"))) == "hostname") & (F.lower("family") == "family")
    return df.filter((ustrip(F.col("hostname")) != "") & (F.col("family") != "") & ~header)


def read_csv_column(spark: SparkSession, path: str, column: str = "Hostname") -> DataFrame:
    """value: one named column; none of it if the file lacks it."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("recursiveFileLookup", True).csv(path)
    return df.select(F.col(column).alias("value")) if column in df.columns else df.select(F.lit(None).cast("string").alias("value")).limit(0)


def read_jsonl_key(spark: SparkSession, path: str, key: str = "hostname") -> DataFrame:
    """value: one key of each JSON object; malformed lines and objects without it are left out, a JSON null is the text None."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
    v = raw.select(F.try_parse_json("value").alias("v")).filter("v is not null")
    got = v.select(F.variant_get("v", f"$.{key}", "variant").alias("x")).filter("x is not null")
    return got.select(F.when(F.is_variant_null("x"), "None").otherwise(F.try_variant_get("x", "$", "string")).alias("value"))


def read_text_folder(spark: SparkSession, path: str) -> DataFrame:
    """file, value: the stripped non-blank lines of all .txt files below a folder; one that is not there has none."""
    try:
        raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, value string")
    return raw.select(F.col("_metadata.file_path").alias("file"), ustrip(F.col("value")).alias("value")).filter("value <> ''")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> list[str]:
    """Paths of all files below a folder whose names match, in order; they are a listing, so the driver has them anyway."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return sorted(df.inputFiles())


def read_corpus(spark: SparkSession, path: str, csv_column: str | None = "Hostname") -> DataFrame:
    """value: the lines of all .txt files below a folder, and a column of its .csv files. Blank lines stay."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path).select(ustrip(F.col("value")).alias("value"))
    if csv_column is None:
        return text
    csv = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("enforceSchema", False).csv(path)
    return text.unionByName(csv.select(F.col(csv_column).alias("value"))) if csv_column in csv.columns else text


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed rows; the first line that is no JSON object of these types is an error that tells its number. Blank lines count but give no row."""
    lines = numbered(read_lines(spark, path, keep_blank=True)).filter("value <> ''")
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = lines.select("n", F.from_json("value", wide, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"), F.col("value").startswith("{").alias("object"))
    wrong = rows.filter("not object or r is null or r._bad is not null").agg(F.min("n")).first()[0]
    if wrong is not None:
        raise ValueError(f"{path}, line {wrong + 1}: no JSON object of the schema")
    return rows.select(*(F.col("r")[f.name].alias(f.name) for f in schema.fields))


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys; nulls are written."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def score_rows(df: DataFrame, host: str = "hostname", group: str | None = None, threshold: bool = False) -> DataFrame:
    """hostname, [calibration_group,] [threshold,] score, prediction, with six decimals."""
    six = lambda c: F.format_string("%.6f", F.col(c).cast("double")).alias(c)
    return df.select(F.col(host).alias("hostname"), *([F.col(group).alias("calibration_group")] if group else []), *([six("threshold")] if threshold or group else []), six("score"), F.col("prediction").cast("int").alias("prediction"))


def write_scores(df: DataFrame, path: str, **options) -> None:
    score_rows(df, **options).write.option("header", True).csv(path)


def unique_longer(df: DataFrame, column: str = "value", order: str = "ord", least: int = 5) -> DataFrame:
    """Rows of over `least` characters, of equal ones the first in order."""
    longer = df.filter(F.char_length(column) > least)
    return longer.groupBy(column).agg(F.min(order).alias(order))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
