"""File readers and writers. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namesmith.functions.order import first_per_key
from namesmith.functions.text import extract, nfkc, strip

DOCUMENT_SCHEMA = "id STRING, document STRING, metadata MAP<STRING,STRING>"
NUMBER_FIELDS = ("num", "gyeok", "fortune", "grade", "description")
SURNAME_FIELDS = "MAP<STRING,STRUCT<hangul:STRING,resource_ohaeng:STRING>>"
SURNAME_CSV = T.StructType(
    [T.StructField("성씨 한글명", T.StringType()), T.StructField("성씨 한자명", T.StringType())]
)


def without_comment_lines(text: Column) -> Column:
    """Drop the lines of a whole file that start with ``//`` after blanks."""
    lines = F.filter(F.split(text, "\n"), lambda line: ~strip(line).startswith("//"))
    return F.array_join(lines, "\n")


def read_commented_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per file: its JSON value parsed after the comment lines are gone.

    Each file is one value, so a file must fit a task; the files themselves spread out.
    """
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.input_file_name().alias("file"), F.from_json(without_comment_lines(F.col("value")), schema).alias("value")
    )


def positional_fields(cells: Column, names: tuple[str, ...]) -> list[Column]:
    """Named fields of a positional array; a missing tail reads as ''."""
    return [F.coalesce(F.get(cells, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]


def positional_rows(df: DataFrame, raw: str, names: tuple[str, ...], seq: str) -> DataFrame:
    """JSON arrays to rows keyed by the first cell; a later duplicate key wins."""
    cells = F.from_json(F.col(raw), "ARRAY<STRING>")
    rows = df.select(seq, *positional_fields(cells, names))
    return first_per_key(rows, [names[0]], [seq], last=True)


def document_records(df: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """Records of JSON files whose top level is a list; other files give one error row."""
    is_list = strip(F.col(raw)).startswith("[")
    records = F.from_json(F.when(is_list, F.col(raw)).otherwise(F.lit("[]")), f"ARRAY<STRUCT<{_struct(DOCUMENT_SCHEMA)}>>")
    return (
        df.select(*keep, F.when(is_list, "ok").otherwise("source_json_must_be_list").alias("status"), records.alias("_r"))
        .select(*keep, "status", F.explode_outer("_r").alias("_e"))
        .select(*keep, "status", "_e.*")
    )


def _struct(ddl: str) -> str:
    return ", ".join(":".join(field.split(" ", 1)) for field in ddl.split(", "))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """List-of-records JSON files."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return document_records(files, "value", ["file"])


def surname_map_rows(df: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """JSON object character -> {hangul, resource_ohaeng} to rows."""
    entries = F.from_json(F.col(raw), SURNAME_FIELDS)
    return df.select(*keep, F.explode(entries).alias("hanja", "_v")).select(*keep, "hanja", "_v.*")


def people_rows(df: DataFrame, raw: str, seq: str) -> DataFrame:
    """Positional people dictionary: short or non-list rows skipped, later key wins."""
    is_list = strip(F.col(raw)).startswith("[")
    cells = F.from_json(F.when(is_list, F.col(raw)), "ARRAY<STRING>")
    meanings = F.coalesce(F.get("_c", F.lit(4)), F.lit(""))
    parts = F.transform(F.split(meanings, ","), strip)
    named = F.filter(parts, lambda p: (p != "") & (p != "姓"))
    strokes = F.get("_c", F.lit(3))
    rows = (
        df.select(seq, cells.alias("_c"))
        .filter(F.size("_c") >= 7)
        .select(
            seq,
            nfkc(F.get("_c", F.lit(0))).alias("hanja"),
            F.when(strokes.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), strokes.cast("double").try_cast("int")).otherwise(0).alias("strokes"),
            F.coalesce(F.get(named, F.lit(0)), F.get(parts, F.lit(0)), F.lit("")).alias("sound_meaning"),
            F.coalesce(F.get("_c", F.lit(2)), F.lit("")).alias("resource_raw"),
            F.coalesce(F.get("_c", F.lit(5)), F.lit("")).alias("radical"),
            F.coalesce(F.get("_c", F.lit(6)), F.lit("")).alias("reading"),
        )
    )
    return first_per_key(rows, ["hanja"], [seq], last=True)


def read_surname_csv(spark: SparkSession, path: str) -> DataFrame:
    """Surname CSV files; the reader drops a byte order mark.

    ``seq`` orders rows by file name and place in the file: a task reads one stretch of a file after another, each
    from its start, so the running number only has to order the rows of one stretch.
    """
    rows = spark.read.csv(path, header=True, schema=SURNAME_CSV, enforceSchema=False)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return rows.select(
        place.alias("seq"), F.col("성씨 한자명").alias("hanja"), F.col("성씨 한글명").alias("hangul")
    )


def first_readings(df: DataFrame, hanja: str, hangul: str, seq: str) -> DataFrame:
    """One-character keys with the first non-empty reading in input order."""
    rows = df.select(seq, nfkc(strip(F.coalesce(hanja, F.lit("")))).alias("hanja"), strip(F.coalesce(hangul, F.lit(""))).alias("hangul"))
    usable = rows.filter((F.length("hanja") == 1) & (F.col("hangul") != ""))
    return first_per_key(usable, ["hanja"], [seq])


def page_lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Lines of page-delimited text with page number and section.

    The text is cut at its page marks inside the row, so no window carries the page on.
    Lines before the first mark have page 0 and no section.
    """
    mark = r"^=== PAGE (\d+) \[([^\]\n]*)\] ===$"
    blocks = F.split(F.col(text), r"(?m)(?=^=== PAGE \d+ \[[^\]\n]*\] ===$)")
    heads = F.transform(blocks, lambda b: F.struct(b.alias("b"), F.substring_index(b, "\n", 1).alias("head")))
    headed = F.transform(
        heads,
        lambda x: F.struct(
            F.coalesce(extract(x["head"], mark, 1), F.lit("0")).try_cast("int").alias("page"), F.coalesce(extract(x["head"], mark, 2), F.lit("")).alias("section"),
            F.split(F.regexp_replace(x["b"], "\n$", ""), "\n").alias("lines"),
        ),
    )
    lines = F.flatten(
        F.transform(
            headed,
            lambda b: F.transform(b["lines"], lambda line: F.struct(b["page"].alias("page"), b["section"].alias("section"), line.alias("line"))),
        )
    )
    return (
        df.select(*keep, F.posexplode(lines).alias("line_no", "_l"))
        .select(*keep, (F.col("line_no") + 1).alias("line_no"), "_l.*")
        .filter(~F.col("line").rlike(mark))
    )


def name_table(df: DataFrame) -> DataFrame:
    """Name frequency table: the name is the second column, whatever it is called."""
    name = df.columns[1]
    return df.withColumn("_name", strip(F.col(f"`{name}`").cast("string")))


def write_documents(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Document records as JSON lines, one file per partition."""
    df.select("id", "document", "metadata").write.mode(mode).json(path)


def write_report(report: DataFrame, path: str) -> None:
    """One-row validation report as JSON."""
    report.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report written before."""
    return spark.read.schema(schema).json(path)
