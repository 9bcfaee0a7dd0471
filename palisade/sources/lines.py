"""Log files: numbered lines, identity of files, what is new, and the tables' sinks."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palisade.functions.text import source_name
from palisade.sources.scratch import stored

MAX_LINE = 8192
LINE_SCHEMA = "source_file string, line_no long, raw string"
MAGIC = {b"\x1f\x8b": gzip.open, b"BZh": bz2.open, b"\xfd7zXZ\x00": lzma.open}


def clean_line(raw: Column) -> Column:
    """Valid UTF-8 (else U+FFFD), no line end, no NUL, at most 8192 characters."""
    valid = F.make_valid_utf8(raw)
    return F.left(F.replace(F.regexp_replace(valid, r"[\r\n]+\z", ""), F.lit("\0"), F.lit("")), F.lit(MAX_LINE))


def read_log_lines(spark: SparkSession, path: str | list[str], sniff: bool = False, with_path: bool = False, modified_after: str | None = None) -> DataFrame:
    """(source_file, line_no, raw) of text files: lines end at LF only and are numbered from 1 per file.

    ``with_path`` adds the whole path, which tells files of one name apart;
    ``modified_after`` leaves out files that have not changed since.

    Blank lines count but are left out. Lines are read once, in order within each block that Spark
    reads, and stored with their places; the blocks' counts are summed up. With ``sniff`` files are told by their
    first bytes, and compressed ones unpacked whatever their name.
    """
    if sniff:
        return unpack(spark.read.format("binaryFile").load(path).select("path", "content"))
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True)
    text = (reader if modified_after is None else reader.option("modifiedAfter", modified_after)).text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), clean_line(F.col("value")).alias("raw"))
    rows = stored(rows, "lines")
    blocks = stored(rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first")), "blocks")
    base = blocks.select("file", "block", "first", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("base"))
    numbered = rows.join(base, ["file", "block"])
    named = source_name(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))).alias("source_file")
    path_of = [F.col("file").alias("path")] if with_path else []
    return numbered.select(*path_of, named, (F.col("base") + F.col("at") - F.col("first") + 1).alias("line_no"), "raw").where("trim(raw) <> ''")


def unpack(files: DataFrame) -> DataFrame:
    """Files (path, content) to numbered lines; a damaged archive gives the lines before the damage."""

    def lines_of(content: bytes) -> Iterator[bytes]:
        opener = next((f for magic, f in MAGIC.items() if content.startswith(magic)), None)
        stream = io.BytesIO(content) if opener is None else opener(io.BytesIO(content))
        try:
            yield from stream
        except (OSError, EOFError, lzma.LZMAError):
            return

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                name = path.rsplit("/", 1)[-1][:255] or "upload"
                rows: list[tuple[str, int, str]] = []
                for number, line in enumerate(lines_of(content), 1):
                    text = line.decode("utf-8", "replace").rstrip("\r\n").replace("\0", "")[:MAX_LINE]
                    if text.strip():
                        rows.append((name, number, text))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=["source_file", "line_no", "raw"])
                        rows = []
                yield pd.DataFrame(rows, columns=["source_file", "line_no", "raw"])

    return files.mapInPandas(run, LINE_SCHEMA)


def file_fingerprints(lines: DataFrame) -> DataFrame:
    """(source_file, fingerprint): SHA-256 of each file's first line that is not blank."""
    return lines.groupBy("source_file").agg(F.sha2(F.min_by("raw", "line_no"), 256).alias("fingerprint"))


def resolve_sources(lines: DataFrame, sources: DataFrame, day: str | None = None) -> DataFrame:
    """(source_file, fingerprint, name, is_new) of each file; with its path where lines have one.

    A known file, told by its first line, keeps its stored name whatever it is called
    now, and of several new files with one first line all get the first one's. A new
    file under a taken name gets the day (or that of its first event), then a number.
    """
    file = ["path"] if "path" in lines.columns else ["source_file"]
    first_day = F.lit(day) if day is not None else F.date_format(F.min("ts"), "yyyy-MM-dd")
    found = lines.groupBy(*dict.fromkeys([*file, "source_file"])).agg(F.sha2(F.min_by("raw", "line_no"), 256).alias("fingerprint"), first_day.alias("day"))
    known = sources.select("fingerprint", F.col("name").alias("stored"))
    new = found.join(known, "fingerprint", "left_anti").groupBy("fingerprint").agg(F.min_by(F.struct("source_file", "day"), F.struct(*file)).alias("of"))
    new = new.select("fingerprint", "of.source_file", "of.day")
    taken = sources.select(F.col("name").alias("source_file"), F.lit(1).alias("taken")).distinct()
    # How many names with a day are given out already for each file name and day.
    dated = sources.select(F.regexp_extract("name", r"^(.*) \((\d{4}-\d\d-\d\d)(?:, \d+)?\)$", 1).alias("source_file"), F.regexp_extract("name", r"^(.*) \((\d{4}-\d\d-\d\d)(?:, \d+)?\)$", 2).alias("day"))
    given = dated.where("source_file <> ''").groupBy("source_file", "day").agg(F.count("*").alias("given"))
    place = F.row_number().over(Window.partitionBy("source_file").orderBy("fingerprint"))
    new = new.join(taken, "source_file", "left").withColumn("extra", place - 1 + F.coalesce("taken", F.lit(0)))
    among = F.count_if(F.col("extra") > 0).over(Window.partitionBy("source_file", "day").orderBy("fingerprint"))
    new = new.join(given, ["source_file", "day"], "left").withColumn("number", F.coalesce("given", F.lit(0)) + among)
    said = F.concat("source_file", F.lit(" ("), "day")
    fresh = F.when(F.col("extra") == 0, F.col("source_file")).when(F.col("number") == 1, F.concat(said, F.lit(")"))).otherwise(F.concat(said, F.lit(", "), F.col("number").cast("string"), F.lit(")")))
    named = found.join(known, "fingerprint", "left").join(new.select("fingerprint", fresh.alias("fresh")), "fingerprint", "left")
    return named.select(*dict.fromkeys([*file, "source_file"]), "fingerprint", F.coalesce("stored", "fresh").alias("name"), F.col("stored").isNull().alias("is_new"))


def classify_lines(new: DataFrame, stored: DataFrame) -> DataFrame:
    """new with ``status``: fresh, duplicate (same text stored) or conflict (other text stored, which wins)."""
    held = stored.select("source_file", "line_no", F.col("raw").alias("stored_raw"))
    status = F.when(F.col("stored_raw").isNull(), "fresh").when(F.col("stored_raw") == F.col("raw"), "duplicate").otherwise("conflict")
    return new.join(held, ["source_file", "line_no"], "left").withColumn("status", status).drop("stored_raw")


def ingest_report(classified: DataFrame) -> DataFrame:
    """Per file: lines = parsed + unparsed + duplicates + conflicts."""
    fresh = F.col("status") == "fresh"
    return classified.groupBy("source_file").agg(
        F.count("*").alias("lines"), F.count_if(fresh & F.col("parsed")).alias("parsed"), F.count_if(fresh & ~F.col("parsed")).alias("unparsed"), F.count_if(F.col("status") == "duplicate").alias("duplicates"), F.count_if(F.col("status") == "conflict").alias("conflicts")
    )


def lines_after(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Lines of each file after the last one stored."""
    last = stored.groupBy("source_file").agg(F.max("line_no").alias("last_line"))
    return new.join(last, "source_file", "left").where(F.col("last_line").isNull() | (F.col("line_no") > F.col("last_line"))).drop("last_line")


def read_if_there(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A table that may not have been written yet: then without rows."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def write_alerts(alerts: DataFrame, evidence: DataFrame, path: str) -> None:
    """Replace the alerts and evidence of the rules that are in these frames."""
    for name, frame in (("alerts", alerts), ("evidence", evidence)):
        frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rule_id").parquet(f"{path}/{name}")
