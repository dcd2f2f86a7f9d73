"""Delimited text files as all-text frames with a row number, and safe CSV export."""

from __future__ import annotations

import codecs
import csv
import io

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assayline.errors import ImportRejected
from assayline.functions.text import column, spreadsheet_safe

DELIMITERS = ",;\t|"
FALLBACK_DELIMITER = ";"
HEAD_BYTES = 65536
CORRUPT = "_broken_line"
BOM = "\ufeff"


def _first_file(spark: SparkSession, path: str):
    files = spark.read.format("binaryFile").load(path).select("path").orderBy("path").limit(1).collect()
    if not files:
        raise ImportRejected("No file was found.")
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]["path"])


def _head(spark: SparkSession, place, size: int) -> bytes:
    """The first bytes of a file."""
    jvm = spark.sparkContext._jvm
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(
            jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)
        ))
    finally:
        stream.close()


def _header(spark: SparkSession, path: str, encoding: str, delimiter: str | None) -> tuple[list[str] | None, str]:
    """The header record of the first file, however long, and the delimiter.

    The delimiter is guessed from the first HEAD_BYTES; reading goes on until the record has ended.
    """
    place, size = _first_file(spark, path), HEAD_BYTES
    while True:
        raw = _head(spark, place, size)
        text = codecs.decode(raw, "utf-8-sig" if encoding == "utf-8" else encoding, errors="ignore")
        delimiter = delimiter or sniff_delimiter(text)
        lines = io.StringIO(text, newline="")
        limit = csv.field_size_limit(max(csv.field_size_limit(), size))
        try:
            header = next(csv.reader(lines, delimiter=delimiter), None)
        finally:
            csv.field_size_limit(limit)
        if len(raw) < size or lines.read(1):  # the file, or at least this record, has ended
            return header, delimiter
        size *= 4


def _line_facts(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """(all UTF-8, some quoted cell goes over a line break), tested line by line on the executors.

    A cell that goes on in the next line leaves an odd number of quotes in its line.
    """
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    facts = spark.read.format("text").load(path).agg(
        F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True)).alias("utf8"),
        F.coalesce(F.bool_or(odd), F.lit(False)).alias("broken"),
    ).first()
    return facts["utf8"], facts["broken"]


def sniff_delimiter(head: str) -> str:
    try:
        return csv.Sniffer().sniff(head, delimiters=DELIMITERS).delimiter
    except csv.Error:
        return FALLBACK_DELIMITER


def _single_byte_tables() -> tuple[str, str]:
    """Latin-1 and Central European readings of the upper 128 bytes, in byte order."""
    pairs = [(chr(b), bytes([b]).decode("cp1250", errors="ignore")) for b in range(0x80, 0x100)]
    return "".join(a for a, b in pairs if b), "".join(b for _, b in pairs if b)


def read_delimited(spark: SparkSession, path: str, *, delimiter: str | None = None, encoding: str | None = None) -> DataFrame:
    """All cells as text, plus ``_row`` and ``_file``; a bad line refuses the file.

    Only the head of one file reaches the driver; the cells are parsed by Spark's CSV source.
    Files without line breaks inside cells are read in splits; one with such cells as a whole.
    Every file must have the header of the first.
    """
    utf8, broken = _line_facts(spark, path)
    if encoding is None:
        encoding = "utf-8" if utf8 else "cp1250"
    header, delimiter = _header(spark, path, encoding, delimiter)
    if not header:
        raise ImportRejected("The file has no header.")
    names = [name.strip() for name in header]
    if not all(names) or len({name.casefold() for name in names}) != len(names):
        raise ImportRejected("Header names must be present and unique.")
    _same_headers(spark, path, names, delimiter, encoding, broken)
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*names, CORRUPT]])
    frame = (
        spark.read.schema(schema)
        .option("header", True).option("enforceSchema", True)  # headers are compared above, trimmed
        .option("sep", delimiter)
        # Spark reads no cp1250: take its bytes as Latin-1 and translate the cells.
        .option("encoding", "iso-8859-1" if encoding == "cp1250" else encoding)
        .option("quote", '"').option("escape", '"').option("multiLine", broken)
        .option("maxColumns", max(20480, len(names) + 1)).option("maxCharsPerColumn", -1)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )
    tables = _single_byte_tables()
    cells = [F.translate(column(n), *tables).alias(n) if encoding == "cp1250" else column(n) for n in names]
    return frame.select(
        *cells,
        column(CORRUPT),
        F.monotonically_increasing_id().alias("_row"),
        F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("_file"),
    )


def _same_headers(spark: SparkSession, path: str, names: list[str], delimiter: str, encoding: str, broken: bool) -> None:
    """Refuse files whose header has other names or another order: cells are taken by position."""
    first = (
        spark.read.option("header", False).option("sep", delimiter).option("multiLine", broken)
        .option("encoding", "iso-8859-1" if encoding == "cp1250" else encoding).option("quote", '"').option("escape", '"')
        .option("maxColumns", max(20480, len(names) + 1)).option("maxCharsPerColumn", -1)
        .schema(T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]))
        .csv(path)
    )
    tables = _single_byte_tables()
    cells = [F.translate(F.col(c), *tables) if encoding == "cp1250" else F.col(c) for c in first.columns]
    cells = [F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), "^\ufeff", "")) for cell in cells]
    # The first record of a file is the one at the file's start.
    starts = first.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
                          F.monotonically_increasing_id().alias("_at")).where("_start = 0")
    heads = starts.groupBy("_path").agg(F.min_by(F.array(*cells), "_at").alias("head"))
    other = heads.where(F.col("head") != F.array(*map(F.lit, names))).limit(1).collect()
    if other:
        raise ImportRejected(f"The header of {other[0]['_path']} differs from that of the first file.")


def check_lines(frame: DataFrame) -> DataFrame:
    """Refuse a file with a line of the wrong field count, naming the first such line of its file."""
    bad = frame.where(column(CORRUPT).isNotNull()).orderBy("_file", "_row").limit(1).collect()  # whole rows: every field must be parsed
    if bad:
        before = frame.where((F.col("_file") == bad[0]["_file"]) & (F.col("_row") < bad[0]["_row"])).count()
        raise ImportRejected(f"Record {before + 2} of {bad[0]['_file']} has a different number of fields: {bad[0][CORRUPT]}")
    return frame.drop(CORRUPT)


def safe_columns(frame: DataFrame) -> DataFrame:
    """Text columns with spreadsheet formulas defused; other columns unchanged."""
    return frame.select(
        *[
            spreadsheet_safe(column(field.name)).alias(field.name)
            if isinstance(field.dataType, T.StringType) else column(field.name)
            for field in frame.schema
        ]
    )


def write_delimited(frame: DataFrame, path: str, *, spreadsheet: bool = True) -> int:
    """Export to a new folder of ;-separated files; the number of rows is returned.

    The count is observed during the write, so the frame is evaluated once.
    """
    from pyspark.sql import Observation

    seen = Observation()
    output = safe_columns(frame) if spreadsheet else frame
    if output.columns:  # spreadsheets know UTF-8 by the mark at the file's start, here before the first name
        output = output.withColumnRenamed(output.columns[0], BOM + output.columns[0])
    output.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").csv(
        path, sep=";", header=True, encoding="UTF-8", escape='"', emptyValue=""
    )
    return seen.get["rows"]


def export_failures(evidence: DataFrame, run_id: str, path: str, *, spreadsheet: bool = True) -> int:
    """Failed records of one run, in the export layout."""
    failed = evidence.where((F.col("run_id") == run_id) & (F.col("test_result") == 1))
    return write_delimited(
        failed.select("run_id", "rule_id", "rule_version", "record_id", "field_name", "field_value", "error_message"),
        path, spreadsheet=spreadsheet,
    )
