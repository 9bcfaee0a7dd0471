"""Content-addressed web archive: each payload once by strong digest, record headers apart, records rebuilt by joins.

An archive is two tables. ``headers`` has the exact bytes of every WARC record up to
its payload (record header and, inside the block, the HTTP header), with the payload's
SHA-256 address. ``payloads`` has every distinct payload once. A response is rebuilt as
header + payload + CRLF CRLF; a revisit has no payload of its own, but its response has
to be there and to have the digest that it states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import written

#: Payloads of so many bytes and more are stored as revisits of one response.
LEAST_REVISIT = 1000
#: Payloads below that are many pages' own responses; their rows are dealt to so many parts of an address.
SALTS = 16
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page: Column, digest: Column) -> Column:
    """A UUID that follows from the page and its payload."""
    h = F.md5(F.concat_ws("/", F.coalesce(page.cast("string"), F.lit("null")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def archive_pages(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> tuple[DataFrame, DataFrame]:
    """Pages (page_id, url, html) to the written archive's tables (headers, payloads).

    A null html is an empty payload, a null url an empty target. Of pages with one
    payload of at least ``least_revisit`` bytes those with the largest page_id are
    responses, others revisits; a null page_id counts as the smallest. Repeated rows
    give repeated records.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("address", F.sha2("payload", 256))
    payloads = written(rows.groupBy("address").agg(F.max_by("payload", F.coalesce("page_id", F.lit(-(2**63)))).alias("payload")), "warc-payloads")
    named = rows.select("page_id", "url", "address", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    owners = named.where(F.col("size") >= least_revisit).groupBy("address").agg(F.max("page_id").alias("owner"))
    told = named.join(owners, "address", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("page_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    url = F.regexp_replace("url", r"[\r\n]", "")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("address"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("owner"), F.col("address"))))).otherwise(F.lit("")),
        line("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(revisit, line("X-Refers-To-Page-Id", F.col("owner").cast("string"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF),
        http,
    )
    headers = written(told.select("page_id", "address", "size", F.encode(header, "UTF-8").alias("header")), "warc-headers")
    return headers, payloads


def _field(text: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(text, rf"(?dm)^{name}: ([^\r\n]*)\r$", 1), F.lit(""))


def _sound(value: Column, *faults: tuple[Column, str]) -> Column:
    """value, or an error that names the page where one of the faults holds."""
    out = value
    for fault, what in reversed(faults):
        said = F.concat(F.lit(f"{what}: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
        out = F.when(fault, F.raise_error(said).cast("binary")).otherwise(out)
    return out


def rebuild_records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page_id, record): the original record bytes, payloads joined back to responses and revisits held against theirs.

    No record is left out: reading fails, naming the page, where a response's payload is
    missing or does not have the SHA-256 it is stored under, and where a revisit's response is
    missing or states another digest. A payload below LEAST_REVISIT bytes may belong to any
    number of responses, so these meet it by address and salt; larger ones have one each.
    """
    text = headers["header"].cast("string")
    said = headers.withColumns({"type": _field(text, "WARC-Type"), "record_id": _field(text, "WARC-Record-ID"), "digest": _field(text, "WARC-Payload-Digest"), "of": _field(text, "WARC-Refers-To")})
    small = F.col("size") < LEAST_REVISIT
    salted = said.where("type IS NULL OR type <> 'revisit'").withColumn("salt", F.when(small, F.pmod(F.xxhash64("page_id", "record_id"), F.lit(SALTS))).otherwise(F.lit(0)))
    salts = F.when(F.octet_length("payload") < LEAST_REVISIT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    kept = payloads.withColumn("salt", F.explode(salts.cast("array<bigint>"))).withColumn("true_address", F.sha2("payload", 256))
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    whole = _sound(F.concat("header", "payload", end), (~F.coalesce(F.col("type") == "response", F.lit(False)), "neither response nor revisit"), (F.col("payload").isNull(), "no payload is stored"), (F.col("true_address") != F.col("address"), "payload and header differ, it has another SHA-256"))
    responses = salted.join(kept, ["address", "salt"], "left").select("page_id", whole.alias("record"))
    # Any number of responses may have one id only if they are repeated rows, alike in all.
    stated = said.where("type = 'response'").groupBy(F.col("record_id").alias("of")).agg(F.max("digest").alias("stated"))
    alone = _sound(F.concat("header", end), (F.col("stated").isNull(), "the response of a revisit is missing"), (F.col("stated") != F.col("digest"), "revisit and response differ"))
    revisits = said.where("type = 'revisit'").join(stated, "of", "left").select("page_id", alone.alias("record"))
    return responses.unionByName(revisits)


def read_records(records: DataFrame) -> DataFrame:
    """Parse record bytes: header fields by name, the block by its stated length, the payload after the HTTP header."""
    # ISO-8859-1 makes one character of each byte, so offsets in the text are offsets in bytes.
    text = F.decode("record", "ISO-8859-1")
    at = F.locate(CRLF * 2, text)
    cut = records.withColumn("head", F.substr(text, F.lit(1), at + 1)).withColumn("at", at)
    block_length = _field(F.col("head"), "Content-Length").cast("long")
    cut = cut.withColumn("block", F.substring(F.col("record"), F.col("at") + 4, block_length.cast("int")))
    http_at = F.locate(CRLF * 2, F.decode("block", "ISO-8859-1"))
    cut = cut.withColumn("http", F.decode(F.substring(F.col("block"), F.lit(1), http_at + 1), "ISO-8859-1")).withColumn("payload", F.substring(F.col("block"), http_at + 4, F.octet_length("block")))
    return cut.select(
        _field(F.col("head"), "X-Page-Id").cast("long").alias("page_id"),
        _field(F.col("head"), "WARC-Type").alias("record_type"),
        _field(F.col("head"), "WARC-Target-URI").alias("url"),
        F.regexp_replace(_field(F.col("head"), "WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        _field(F.col("head"), "X-Refers-To-Page-Id").cast("long").alias("refers_to"),
        _field(F.col("http"), "Content-Length").cast("long").alias("payload_bytes"),
        "payload",
    )


def verified(read: DataFrame) -> DataFrame:
    """Raise where a response's payload does not have the length or digest that its header states."""
    sound = (F.col("record_type") != "response") | ((F.sha1("payload") == F.col("payload_digest")) & (F.octet_length("payload") == F.col("payload_bytes")))
    good = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("payload and header differ in page "), F.col("page_id").cast("string"))).cast("string"))
    return read.withColumn("payload_digest", good)


def export_warc(headers: DataFrame, payloads: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write the archive as WARC files; the text writer's line end is the record's."""
    records = rebuild_records(headers, payloads)
    body = F.decode(F.substring(F.col("record"), F.lit(1), F.octet_length("record") - 4), "UTF-8")
    records.select(body.alias("value")).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)
