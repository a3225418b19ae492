"""WARC archives: written and read by tasks, revisits resolved, deduplicated copies written with fresh headers.

An archive is a folder of gzip files, each a sequence of WARC 1.1 records.  Since every record ends in an empty line after a line
end, Spark's text writer makes them as they are, with those four bytes for its line separator; the reader takes the pieces between them back and
cuts records by their Content-Length, so payloads may hold those bytes too.  A task reads whole gzip files as streams and holds one record at a time.

Deduplication shuffles headers, not payloads: they meet by (payload digest, salt), where the salts of a digest are first folded into its one
original, so a digest that holds a third of all records is dealt to many tasks.  Record ids of what becomes a revisit then meet the
records, which are shuffled once by their ids and written anew.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BATCH_BYTES, Scratch, freeing_shuffles, pick, prepare

#: What ends a header and a record.
END = "\r\n\r\n"
#: Pieces that the records of one digest are dealt into.
SALTS = 64
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Columns of records and the header fields that they come from; other fields are kept as they are in `fields`.
NAMED = {"record_id": "warc-record-id", "record_type": "warc-type", "date": "warc-date", "uri": "warc-target-uri", "row_id": "x-row-id", "refers_to": "warc-refers-to", "refers_to_uri": "warc-refers-to-target-uri", "refers_to_date": "warc-refers-to-date", "content_type": "content-type"}
#: Fields that are computed for each record that is written.
FRESH = ("content-length", "warc-payload-digest", "warc-block-digest", "warc-profile")
SCHEMA = "record_id string, record_type string, date string, uri string, row_id long, refers_to string, refers_to_uri string, refers_to_date string, content_type string, fields array<string>, http binary, payload binary, payload_bytes long, digest string"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of binary or text in bare upper-case base32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def from_rows(rows: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """A response record for each row, with an id of its own: rows that repeat stay apart.

    A null payload is an empty one; a null id or address is left out of the header.  White space and control characters of an address become %20.
    """
    row = pick(rows, id_col, uri_col, payload_col).toDF("row_id", "uri", "payload")
    body = F.coalesce(F.col("payload"), F.lit("")).cast("binary")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string")).cast("binary")
    columns = {"record_id": F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")), "record_type": F.lit("response"), "date": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    columns |= {"uri": F.regexp_replace("uri", r"[\x00-\x20\x7F]", "%20"), "row_id": F.col("row_id").cast("long")}
    columns |= {c: F.lit(None).cast("string") for c in ("refers_to", "refers_to_uri", "refers_to_date")} | {"content_type": F.lit("application/http; msgtype=response"), "fields": F.array().cast("array<string>")}
    columns |= {"http": http, "payload": body, "payload_bytes": F.octet_length(body).cast("long"), "digest": base32_sha1(body)}
    return row.select(*[c.alias(n) for n, c in columns.items()])


def write(records: DataFrame, path: str) -> None:
    """Records as an archive.  Revisits are written without payload; lengths, digests and the profile are made anew."""
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit | F.col("payload").isNull(), F.lit(b"")).otherwise(F.col("payload"))
    block = F.concat(F.when(F.col("http").isNotNull(), F.concat("http", F.lit(END.encode()))).otherwise(F.lit(b"")), body)
    field = lambda name, c: F.concat(F.lit(f"{name}: "), c.cast("string"))
    head = F.concat_ws(
        "\r\n",
        F.lit(VERSION),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Date", F.col("date")),
        field("WARC-Target-URI", F.col("uri")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("block")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        *[F.when(revisit, field(name, F.col(c))) for name, c in (("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "refers_to_uri"), ("WARC-Refers-To-Date", "refers_to_date"))],
        field("Content-Type", F.col("content_type")),
        field("X-Row-Id", F.col("row_id")),
        F.col("fields"),
        field("Content-Length", F.octet_length("block")),
    )
    value = F.concat(head, F.lit(END), F.col("block").cast("string"))
    with freeing_shuffles(records.sparkSession):
        records.withColumn("block", block).select(value.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], list[str], bytes]]:
    """(fields by lower-case name, header lines, block) of each record in a stream that is given in chunks."""
    end, buffer, at = END.encode(), bytearray(), 0
    for chunk in chunks:
        del buffer[:at]
        buffer += chunk
        at = 0
        while True:
            while buffer[at : at + 2] == b"\r\n":  # what the last piece of a file leaves
                at += 2
            stop = buffer.find(end, at)
            if stop < 0:
                break
            lines = buffer[at:stop].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record begins with {lines[0][:80]!r}: archives must be gzip files")
            named = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
            first = stop + len(end)
            last = first + int(named["content-length"])
            if len(buffer) < last + len(end):
                break
            yield named, lines[1:], bytes(buffer[first:last])
            at = last + len(end)
    if bytes(buffer[at:]).strip():
        raise ValueError("the last record of an archive is cut off")


def _record(named: dict[str, str], lines: list[str], block: bytes, payloads: bool) -> tuple:
    http, payload = None, block
    if named.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(END.encode())
    row = [named.get(f) for f in NAMED.values()]
    at = list(NAMED).index("row_id")
    row[at] = int(row[at]) if re.fullmatch(r"-?[0-9]{1,18}", row[at] or "") else None
    row.append([x for x in lines if x.partition(":")[0].strip().lower() not in (*NAMED.values(), *FRESH)])
    if named.get("warc-type") == "revisit":
        return (*row, http, None, None, named.get("warc-payload-digest", "").rpartition(":")[2] or None)
    held = (http, payload) if payloads else (None, None)
    return (*row, *held, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of an archive; without ``payloads`` only what headers need is handed on.

    Digests and lengths of payloads are computed from what was read; of a revisit, which has no payload, the digest is that of its header and
    the length is null.  Files must be gzip, of one member or many; a cut-off or foreign file raises an error.
    """
    prepare(spark)
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("date", pa.string()), ("uri", pa.string()), ("row_id", pa.int64()), ("refers_to", pa.string()), ("refers_to_uri", pa.string()), ("refers_to_date", pa.string()), ("content_type", pa.string()), ("fields", pa.list_(pa.string())), ("http", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string())])

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = (END.encode().join([*b.column(0).to_pylist(), b""]) for b in batches if len(b))
        rows, held = [], 0
        for named, lines, block in parse(chunks):
            rows.append(_record(named, lines, block, payloads))
            held += 500 + (len(block) if payloads else 0)
            if held > BATCH_BYTES:
                yield pack(rows)
                rows, held = [], 0
        if rows:
            yield pack(rows)

    return spark.read.schema("value string").option("lineSep", END).text(path).select(F.col("value").cast("binary").alias("value")).mapInArrow(run, SCHEMA)


def with_originals(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Headers with `original`, a struct of the record that holds their payload: the one with the least row id (nulls last), then record id.

    It is null where no record with a payload of at least ``min_bytes`` has the digest.
    """
    kind, size = F.col("record_type"), F.col("payload_bytes")
    holder = F.when(kind.isin("response", "resource") & (size >= min_bytes), F.struct(F.col("row_id").isNull().alias("last"), "row_id", "record_id", "uri", "date", "payload_bytes"))
    salted = heads.withColumn("meet", F.coalesce("digest", "record_id")).withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    folded = salted.groupBy("meet", "salt").agg(F.min(holder).alias("first"))
    firsts = folded.groupBy("meet").agg(F.min("first").alias("original"), F.collect_list("salt").alias("salts")).where("original is not null")
    return salted.join(firsts.select("meet", "original", F.explode("salts").alias("salt")), ["meet", "salt"], "left").drop("meet", "salt")


def deduplicate(spark: SparkSession, source: str, target: str, min_bytes: int = 0, scratch: Scratch | None = None) -> None:
    """The archive ``source`` written as ``target``, where one response holds each payload of at least ``min_bytes`` and the others revisit it.

    Revisits of the source refer to the holder of their payload, or keep their own reference where the source lacks it.  Records of other types
    stay.  Several records of one id are copies of one record and share its fate.
    """
    scratch = scratch or Scratch(spark)
    heads = scratch.write(read(spark, source, payloads=False).drop("fields", "http", "payload", "content_type"), "warc-heads")
    kind, original = F.col("record_type"), F.col("original")
    found = with_originals(heads, min_bytes).where(original.isNotNull() & (original.record_id != F.col("record_id")))
    again = found.where((kind == "revisit") | (kind.isin("response", "resource") & (F.col("payload_bytes") >= min_bytes)))
    again = again.groupBy("record_id").agg(F.min(F.struct(original.record_id.alias("id"), original.uri.alias("uri"), original.date.alias("date"))).alias("of"))
    records = read(spark, source).join(again, "record_id", "left")
    now = lambda new, old: F.when(F.col("of").isNotNull(), new).otherwise(F.col(old))
    fresh = {"record_type": now(F.lit("revisit"), "record_type"), "payload": now(F.lit(None).cast("binary"), "payload")}
    fresh |= {"refers_to": now(F.col("of.id"), "refers_to"), "refers_to_uri": now(F.col("of.uri"), "refers_to_uri"), "refers_to_date": now(F.col("of.date"), "refers_to_date")}
    write(records.withColumns(fresh), target)
    scratch.free("warc-heads")


def resolve(heads: DataFrame) -> DataFrame:
    """Headers as read, where revisits have the length of their original's payload and `original_row_id`; both are null where it is missing."""
    got = with_originals(heads)
    revisit = F.col("record_type") == "revisit"
    return got.withColumns({"original_row_id": F.when(revisit, F.col("original.row_id")), "payload_bytes": F.when(revisit, F.col("original.payload_bytes")).otherwise(F.col("payload_bytes"))}).drop("original")


def round_trip(rows: DataFrame, min_bytes: int = 0, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of rows that went through an archive and its deduplicated copy.

    Of equal payloads of at least ``min_bytes`` the one with the smallest id (nulls last) is a response, of rows that repeat that id any one; the others revisit it.
    Null payloads count as empty ones, which are equal to each other.  Empty tables give no rows; other columns are not read.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    first, second = scratch.fresh("warc-all"), scratch.fresh("warc-deduplicated")
    scratch.keep("warc-all", first)
    scratch.keep("warc-deduplicated", second)
    write(from_rows(rows, id_col, uri_col, payload_col), first)
    deduplicate(spark, first, second, min_bytes, scratch)
    scratch.free("warc-all")
    heads = scratch.write(read(spark, second, payloads=False).drop("fields", "http", "payload"), "warc-records")
    scratch.free("warc-deduplicated")
    return resolve(heads).select(F.col("row_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("original_row_id").alias("refers_to"))
