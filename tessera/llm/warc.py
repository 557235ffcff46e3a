"""WARC archives: write, read back, reassemble segments, decode chunked framing.

Writing is one scan: a record is a text built by SQL functions, and Spark's text
writer puts the two line ends after each record that the format asks for, so a
folder of standard ``.warc.gz`` files results on any store that Spark reaches.
A response is an HTTP message in chunked transfer framing; messages of more than
``segment_chars`` characters become a first record and continuation records
with origin, number and, in the last, total length. Of equal payloads of at
least ``least`` bytes the smallest id is the response and the others are
revisits that name it; several rows that hold that smallest id are all
responses, and so is every row without an id. Null payloads are empty, a message of any
length is written whole, extra columns are ignored, and an empty table gives no records.
Equal payloads meet by digest as ids alone; the payloads themselves stay where they
are, or cross one shuffle by id if the revisits are too many to broadcast.

Reading: ``binaryFile`` gives a file to a task, which unpacks and parses it record by
record (one gzip member or many). A record has at most ``segment_chars`` characters and a
head, and a file ``records_a_file`` records, which bounds a file (by default at 132 MB
before packing) and so a task's memory. Messages in one record are decoded there; only
continuation records and their first records are shuffled, by origin, ordered by
number and verified against the total length. Digests are computed again from the
payloads, and revisits have to name a response of the same digest and length.
"""

from __future__ import annotations

import atexit
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import drop_quietly, scratch_path, ship, stored

SEGMENT_CHARS, CHUNK_CHARS, LEAST = 16_384, 4_096, 100
END = "\r\n"
#: Revisits (id, digest, id) are broadcast up to this number, some 100 bytes each, else joined by shuffle.
MOST_BROADCAST = 200_000


def _octets(c):
    return F.octet_length(c)


def plan(pages: DataFrame, id_col: str, payload_col: str, least: int = LEAST) -> DataFrame:
    """id, payload, digest, and for each row the id that it refers to (null for a response)."""
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = pages.select(q(id_col).alias("id"), F.coalesce(q(payload_col), F.lit("")).alias("payload"))
    rows = rows.select("id", "payload", F.sha2("payload", 256).alias("digest"))
    ids = stored(rows.where(_octets("payload") >= least).where("id is not null").select("id", "digest"), "digests")
    # only payloads that occur twice need their first id; sums for each digest are formed before the
    # shuffle, and the table is stored, so that Spark can split a digest that very many ids have
    first = stored(ids.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "firsts")
    later = stored(ids.distinct().join(first, "digest").where("first <> id"), "revisits")
    if later.count() <= MOST_BROADCAST:
        later = F.broadcast(later)
    out = rows.join(later, ["id", "digest"], "left")
    return out.select("id", "payload", "digest", F.col("first").alias("refers_to"))


def records(planned: DataFrame, segment_chars: int = SEGMENT_CHARS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One text column: records without the two line ends that close them."""
    body = F.col("payload")
    n = F.ceil(F.char_length(body) / chunk_chars).cast("int")
    pieces = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substr(body, i * chunk_chars + 1, F.lit(chunk_chars))))
    chunked = F.concat(
        F.coalesce(F.concat_ws("", F.transform(pieces, lambda p: F.concat(F.lower(F.hex(_octets(p))), F.lit(END), p, F.lit(END)))), F.lit("")),
        F.lit("0" + END + END),
    )
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}X-Payload-Bytes: "), _octets(body).cast("string"), F.lit(END))
    uid = F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    message = F.when(F.col("refers_to").isNull(), F.concat(head, F.lit(f"Transfer-Encoding: chunked{END}{END}"), chunked)).otherwise(F.concat(head, F.lit(END)))
    # row: a number within the write, so that rows of one id are still records of their own
    rows = planned.select(uid.alias("uid"), "digest", "refers_to", message.alias("message"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("segments", F.greatest(F.ceil(F.char_length("message") / segment_chars).cast("int"), F.lit(1)))
    rows = rows.withColumn("number", F.explode(F.sequence(F.lit(1), "segments")))
    block = F.substr("message", (F.col("number") - 1) * segment_chars + 1, F.lit(segment_chars))
    rows = rows.withColumn("block", F.when(F.col("segments") == 1, F.col("message")).otherwise(block))
    ident = lambda k: F.concat(F.lit("<urn:record:"), F.col("row").cast("string"), F.lit(":"), k.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    kind = F.when(F.col("number") > 1, "continuation").when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    header = F.concat(
        F.lit("WARC/1.1" + END),
        line("WARC-Type", kind),
        line("WARC-Record-ID", ident(F.col("number"))),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.col("uid")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.coalesce(line("WARC-Refers-To-Target-URI", F.concat(F.lit("urn:page:"), F.col("refers_to").cast("string"))), F.lit("")),
        F.when(F.col("refers_to").isNotNull(), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.when(F.col("segments") > 1, line("WARC-Segment-Number", F.col("number").cast("string"))).otherwise(F.lit("")),
        F.when(F.col("number") > 1, line("WARC-Segment-Origin-ID", ident(F.lit(1)))).otherwise(F.lit("")),
        F.when((F.col("number") > 1) & (F.col("number") == F.col("segments")), line("WARC-Segment-Total-Length", _octets("message").cast("string"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", _octets("block").cast("string")),
        F.lit(END),
    )
    return rows.select(F.concat(header, "block").alias("value"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", least: int = LEAST, records_a_file: int = 2_000, segment_chars: int = SEGMENT_CHARS) -> None:
    out = records(plan(pages, id_col, payload_col, least), segment_chars)
    out.write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", records_a_file).text(path)


class Malformed(ValueError):
    pass


def unpacked(data: bytes, step: int = 1 << 16):
    """The bytes of a gzip file of any number of members, a piece at a time."""
    view, at = memoryview(data), 0
    while at < len(data):
        member = zlib.decompressobj(31)
        while at < len(data) and not member.eof:
            piece = member.decompress(view[at : at + step])
            at = min(at + step, len(data)) - len(member.unused_data)
            if piece:
                yield piece
        if not member.eof:
            raise Malformed("the file ends within a gzip member")


def parse(pieces):
    """(headers by lower-case name, block) of each record, from bytes or pieces of them; what is held is a record and a piece."""
    pieces = iter([pieces] if isinstance(pieces, bytes) else pieces)
    data, number = bytearray(), 0

    def more() -> bool:
        piece = next(pieces, b"")
        data.extend(piece)
        return bool(piece)

    while data or more():
        while (stop := data.find(b"\r\n\r\n")) < 0 and more():
            pass
        if stop < 0 or not data.startswith(b"WARC/1."):
            raise Malformed(f"record {number} has no head")
        lines = data[:stop].decode().split(END)[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n, a = int(head["content-length"]), stop + 4
        while len(data) < a + n + 4 and more():
            pass
        if data[a + n : a + n + 4] != b"\r\n\r\n":
            raise Malformed(f"record {number} does not end with two line ends")
        yield head, bytes(data[a : a + n])
        del data[: a + n + 4]
        number += 1


def dechunk(data: bytes) -> bytes:
    """The body of chunked transfer framing: sizes in hex, extensions after ``;`` and trailers allowed."""
    out, at = [], 0
    while True:
        stop = data.find(b"\r\n", at)
        if stop < 0:
            raise Malformed("no chunk size")
        n = int(data[at:stop].split(b";")[0], 16)
        at = stop + 2
        if not n:
            return b"".join(out)
        if data[at + n : at + n + 2] != b"\r\n":
            raise Malformed("a chunk does not end where its size says")
        out.append(data[at : at + n])
        at += n + 2


def payload(message: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP headers by lower-case name, and the decoded body."""
    head, sep, body = message.partition(b"\r\n\r\n")
    if not sep:
        raise Malformed("no end of the HTTP head")
    names = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split(END)[1:])}
    if names.get("transfer-encoding", "").lower() == "chunked":
        body = dechunk(body)
    elif "content-length" in names:
        body = body[: int(names["content-length"])]
    return names, body


RESULT = [("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("verified", pa.bool_())]
SCHEMA = "uri string, payload_bytes long, payload_digest string, record_type string, refers_to string, verified boolean"
PARTS = [("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("type", pa.string()), ("stated", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("block", pa.binary()), ("payload_bytes", pa.int64()), ("verified", pa.bool_())]
PART_SCHEMA = "origin string, number int, total long, type string, stated string, refers_to string, uri string, block binary, payload_bytes long, verified boolean"


def _decoded(kind: str, stated: str, message: bytes, total: int | None) -> tuple[int, str, bool]:
    """Bytes and digest of the payload, and whether they are as the record says."""
    names, body = payload(message)
    if kind == "revisit":
        return int(names["x-payload-bytes"]), stated, True
    digest = hashlib.sha256(body).hexdigest()
    return len(body), digest, digest == stated and total in (None, len(message))


def _parse_files(batches):
    """A row for each record; records of one segment are decoded here and carry no block."""
    schema = pa.schema(PARTS)
    for batch in batches:
        for blob in batch.column(0):
            rows: list[dict] = []
            held = 0
            for head, block in parse(unpacked(blob.as_py())):
                number, total = head.get("warc-segment-number"), head.get("warc-segment-total-length")
                row = dict(origin=head.get("warc-segment-origin-id", head["warc-record-id"]), number=int(number or 0), total=int(total) if total else None)
                row |= dict(type=head["warc-type"], stated=head["warc-payload-digest"].removeprefix("sha256:"), refers_to=head.get("warc-refers-to-target-uri"), uri=head["warc-target-uri"])
                if number:
                    row["block"] = block
                else:
                    row["payload_bytes"], row["stated"], row["verified"] = _decoded(row["type"], row["stated"], block, None)
                rows.append(row)
                held += len(block)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def _reassemble(batches):
    """Rows sorted by origin and number: each run of one origin becomes one result."""
    schema = pa.schema(RESULT)
    group: list[dict] = []

    def close() -> dict:
        first = group[0]
        if first["number"] == 0:
            return dict(uri=first["uri"], payload_bytes=first["payload_bytes"], payload_digest=first["stated"], record_type=first["type"], refers_to=first["refers_to"], verified=first["verified"])
        if [p["number"] for p in group] != list(range(1, len(group) + 1)) or group[-1]["total"] is None:
            raise Malformed(f"segments of {first['origin']}: {[p['number'] for p in group]}, total {group[-1]['total']}")
        n, digest, good = _decoded(first["type"], first["stated"], b"".join(p["block"] for p in group), group[-1]["total"])
        return dict(uri=first["uri"], payload_bytes=n, payload_digest=digest, record_type=first["type"], refers_to=first["refers_to"], verified=good)

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if group and row["origin"] != group[0]["origin"]:
                out.append(close())
                group = []
            group.append(row)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if group:
        yield pa.RecordBatch.from_pylist([close()], schema)


def read(spark, path: str, strict: bool = True) -> DataFrame:
    """One row for each response and revisit (see SCHEMA).

    verified: total length and digest of a response agree, and a revisit names a
    response of its digest and length. With ``strict`` anything else is an error.
    Records of one segment cross the shuffle without their block.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    rows = files.mapInArrow(_parse_files, PART_SCHEMA).repartition("origin").sortWithinPartitions("origin", "number")
    rows = stored(rows.mapInArrow(_reassemble, SCHEMA), "records")
    # sums before the shuffle: a response that very many name is one row for each task
    named = rows.where("record_type = 'revisit'").groupBy("refers_to", "payload_digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n"))
    held = rows.where("record_type = 'response'").select(F.col("uri").alias("refers_to"), "payload_digest", "payload_bytes")
    lost = stored(named.join(held, ["refers_to", "payload_digest", "payload_bytes"], "left_anti"), "lost")
    wrong = rows.where("not verified").count()
    lonely = lost.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if strict and (wrong or lonely):
        raise Malformed(f"{wrong} messages differ from their digest or total length, and {lonely} revisits from the response they name")
    if lonely:
        lost = lost.select("refers_to", "payload_digest", "payload_bytes", F.lit(False).alias("found"))
        rows = rows.join(lost, ["refers_to", "payload_digest", "payload_bytes"], "left")
        rows = rows.withColumn("verified", F.col("verified") & F.coalesce("found", F.lit(True)))
    return rows.select([n for n, _ in RESULT])


def op4(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    atexit.register(drop_quietly, spark, path)
    number = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("long")
    return read(spark, path).select(number("uri").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
