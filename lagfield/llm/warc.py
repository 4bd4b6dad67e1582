"""Web archives: records written by Spark's text writer, and read back by putting segments together again.

A record ends with two line breaks, which is the writer's line separator, so an archive is written by any store's own
commit protocol.  A block longer than ``segment_bytes`` goes out as a first record and continuations.  Bodies use chunked
transfer framing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagfield.llm.common import materialize

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
FILE_RECORDS = 1000
BITMAP_ROWS = 1 << 20
DATE = "2024-01-01T00:00:00Z"

#: Fixed value: profile of a record whose payload is that of another.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _chunked(body: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def _header(fields) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode()


def _uri(url):
    """A URL that keeps to one header line: blanks and control characters are percent-encoded."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record_id(page, digest, place=""):
    """The identifier of a record, known before it is written; ``place`` tells apart records that nothing refers to."""
    return f"<urn:lagfield:page:{page}:{digest}{place}>"


def _to_records(segment_bytes, chunk_bytes):
    def run(batches):
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for page, url, html, keeper, keeper_url, copy in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                body = (html or "").encode("utf-8", "surrogatepass")
                digest = base32_sha1(body)
                revisit = keeper is not None and page is not None and page != keeper
                own = _record_id(page, digest, f":{part}-{nth}" if page is None or revisit or copy else "")
                nth += 1
                common = [
                    ("WARC-Date", DATE),
                    ("WARC-Target-URI", _uri(url)),
                    ("X-Page-ID", page),
                    ("X-Payload-Length", len(body)),
                    ("WARC-Payload-Digest", "sha1:" + digest),
                ]
                if revisit:
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                    fields = [
                        ("WARC-Type", "revisit"),
                        ("WARC-Record-ID", own),
                        *common,
                        ("WARC-Profile", SAME_PAYLOAD),
                        ("WARC-Refers-To", _record_id(keeper, digest)),
                        ("WARC-Refers-To-Target-URI", _uri(keeper_url)),
                        ("WARC-Refers-To-Date", DATE),
                        ("Content-Type", "application/http; msgtype=response"),
                        ("Content-Length", len(block)),
                    ]
                    out.append(_header(fields) + block)
                    continue
                block = (
                    b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                    + _chunked(body, chunk_bytes)
                )
                pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
                for k, piece in enumerate(pieces, 1):
                    first, last = k == 1, k == len(pieces)
                    fields = [
                        ("WARC-Type", "response" if first else "continuation"),
                        ("WARC-Record-ID", own if first else own.replace(">", f":{k}>")),
                        *(common if first else common[:2]),
                        ("WARC-Segment-Number", k if len(pieces) > 1 else None),
                        ("WARC-Segment-Origin-ID", None if first else own),
                        ("WARC-Segment-Total-Length", len(block) if last and not first else None),
                        ("Content-Type", "application/http; msgtype=response" if first else None),
                        ("Content-Length", len(piece)),
                    ]
                    out.append(_header(fields) + piece)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return run


def _flagged(rows: DataFrame, again: DataFrame) -> DataFrame:
    """``rows`` with ``flag``: true where ``key`` is in ``again``, and by chance for some others.

    A bitmap of hashed keys goes to all tasks: at most ``BITMAP_ROWS`` rows of 64 bits, however many keys there are.
    """

    def placed(df):
        h = F.xxhash64("key")
        return df.withColumns(
            {"__row__": F.pmod(h, F.lit(BITMAP_ROWS)), "__bit__": F.shiftrightunsigned(h, 58).cast("int")}
        )

    bit = F.expr("shiftleft(1L, __bit__)")
    bits = placed(again).groupBy("__row__").agg(F.bit_or(bit).alias("__bits__"))
    found = placed(rows).join(F.broadcast(bits), "__row__", "left")
    flag = F.coalesce(F.col("__bits__").bitwiseAND(bit) != 0, F.lit(False))
    return found.withColumn("flag", flag).drop("__row__", "__bit__", "__bits__")


def write_warc(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    revisit_bytes: int = 0,
    segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
    file_records: int = FILE_RECORDS,
) -> None:
    """Write one record for each row of ``pages`` below ``folder``, long ones in segments.

    Of equal payloads of ``revisit_bytes`` or more the row with the largest id is the response, the others are revisits
    of it and name its record.  A null page is empty.  A row without an id is a response; so is each row that repeats the
    largest id, of which one has the record that revisits name.  Payloads are told apart by SHA-256; rows of one digest
    are counted where they are read, and pages whose digest is outside a bitmap of those that occur again are written
    where they are read.  File sizes are bounded by ``file_records`` segments.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page"),
        F.col(url).alias("url"),
        F.col(html).alias("html"),
        F.sha2(F.coalesce(F.col(html), F.lit("")).cast("binary"), 256).alias("key"),
        (F.coalesce(F.octet_length(html), F.lit(0)) >= revisit_bytes).alias("counts"),
    )
    spark = pages.sparkSession
    again = (
        rows.groupBy("key", "page", "counts")
        .agg(F.count(F.lit(1)).alias("n"), F.max("url").alias("url"))
        .groupBy("key", "counts")
        .agg(
            F.max(F.struct("page", F.col("n").alias("tops"), F.col("url").alias("keeper_url"))).alias("top"),
            F.sum("n").alias("n"),
        )
        .where("n > 1")
        .select("key", "counts", F.col("top.page").alias("keeper"), "top.tops", "top.keeper_url")
    )
    again = materialize(again, "warc-again")
    met = _flagged(rows, again).withColumn("counts", F.col("counts").cast("int"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("keeper", "long"), ("keeper_url", "string"))]
    alone = met.where("NOT flag").select("page", "url", "html", *none, F.lit(False).alias("copy"))
    twin = F.col("page").eqNullSafe(F.col("keeper")) & (F.col("tops") > 1)
    linked = (
        met.where("flag")
        .join(again.drop("counts"), "key", "left")
        .select("page", "url", "html", "key", "counts", "keeper", "keeper_url", F.coalesce(twin, F.lit(False)).alias("twin"))
    )
    # below the size for revisits nothing refers to a record, and rows may repeat an id and a payload
    others = linked.where("NOT twin OR counts = 0").select(
        "page",
        "url",
        "html",
        *[F.when(F.col("counts") == 1, F.col(c)).alias(c) for c in ("keeper", "keeper_url")],
        (F.col("counts") == 0).alias("copy"),
    )
    # rows that repeat the largest id: written once, so that their places stay, and the first place is the one to name
    twins = linked.where("twin AND counts = 1").select("page", "url", "html", "keeper", "keeper_url", "key")
    twins = materialize(twins.withColumn("place", F.monotonically_increasing_id()), "warc-twins")
    first = twins.groupBy(F.col("key").alias("of")).agg(F.min("place").alias("least"))
    twins = twins.join(first, F.col("key") == F.col("of")).select(
        "page", "url", "html", "keeper", "keeper_url", (F.col("place") > F.col("least")).alias("copy")
    )
    linked = alone.unionByName(others).unionByName(twins)
    records = linked.mapInArrow(_to_records(segment_bytes, chunk_bytes), "value binary")
    (
        records.select(F.col("value").cast("string"))
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", file_records)
        .text(folder)
    )


_RECORD = (
    "type string, id string, origin string, segment int, total bigint, page_id bigint, refers_to bigint,"
    " digest string, length bigint, block binary"
)
_KINDS = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
_NAMES = [x.split()[0] for x in _RECORD.split(", ")]


def _number(value):
    return None if value in (None, "None") else int(value)


def _parse(data: bytes, path: str):
    """Records of an archive: fields up to the empty line, then as many bytes as the length says."""
    place = 0
    while place < len(data):
        stop = data.index(b"\r\n\r\n", place)
        version, *lines = data[place:stop].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {place} of {path}")
        fields = dict(line.split(": ", 1) for line in lines)
        begin = stop + 4
        end = begin + int(fields["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"length of the record at {place} of {path} is wrong")
        refers = fields.get("WARC-Refers-To")
        yield (
            fields["WARC-Type"],
            fields["WARC-Record-ID"],
            fields.get("WARC-Segment-Origin-ID"),
            _number(fields.get("WARC-Segment-Number")),
            _number(fields.get("WARC-Segment-Total-Length")),
            _number(fields.get("X-Page-ID")),
            None if refers is None else int(refers.strip("<>").split(":")[3]),
            fields.get("WARC-Payload-Digest", ":").split(":", 1)[1],
            _number(fields.get("X-Payload-Length")),
            data[begin:end],
        )
        place = end + 4


def _read(batches):
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = data.as_py()
            if data[:2] == b"\x1f\x8b":
                data = _inflate(data)
            held, size = [], 0
            for record in _parse(data, path):
                held.append(record)
                size += len(record[-1])
                if size > 4 << 20:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)


def _inflate(data: bytes) -> bytes:
    """All members of a gzip file, one or one for each record."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out)


def _batch(records):
    columns = zip(*records, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives below ``folder`` as it stands there."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(_read, _RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: ``type, id, page_id, refers_to, digest, length, block, whole``.

    Records without a segment number are whole already and are not moved.  Segments are grouped by the identifier of
    their first record and put in the order of their numbers; ``whole`` is false where a number is missing or doubled
    or the total length differs.  A group is as large as one page.
    """
    alone = records.where("segment IS NULL")
    parts = records.where("segment IS NOT NULL").withColumn("origin", F.coalesce("origin", "id"))
    joined = (
        parts.groupBy("origin")
        .agg(
            F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("s"),
            F.max("total").alias("total"),
            *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("type", "page_id", "refers_to", "digest", "length")],
        )
        .withColumn("block", F.aggregate("s", F.lit(b""), lambda acc, x: F.concat(acc, x["block"])))
    )
    numbers = F.transform("s", lambda x: x["segment"])
    right = (numbers == F.sequence(F.lit(1), F.size("s"))) & (F.octet_length("block") == F.col("total"))
    columns = ["type", "id", "page_id", "refers_to", "digest", "length", "block", "whole"]
    joined = joined.select(F.col("origin").alias("id"), *[c for c in columns if c not in ("id", "whole")], F.coalesce(right, F.lit(False)).alias("whole"))
    return alone.withColumn("whole", F.lit(True)).select(*columns).unionByName(joined.select(*columns))


def unchunk(data: bytes) -> bytes:
    """Body without its chunked transfer framing; chunk extensions and trailers are skipped."""
    out, place = [], 0
    while True:
        stop = data.index(b"\r\n", place)
        size = int(data[place:stop].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(data[stop + 2 : stop + 2 + size])
        if len(out[-1]) != size or data[stop + 2 + size : stop + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        place = stop + 4 + size


def _payloads(batches):
    for batch in batches:
        payloads, digests, fine = [], [], []
        for kind, digest, block, whole in zip(*(batch.column(c).to_pylist() for c in ("type", "digest", "block", "whole")), strict=True):
            head, _, body = block.partition(b"\r\n\r\n")
            payload = None
            if kind == "response" and whole:
                payload = unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body
            payloads.append(payload)
            digests.append(digest if payload is None else base32_sha1(payload))
            fine.append(whole and digests[-1] == digest)
        keep = ["page_id", "type", "refers_to", "length", "digest"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(payloads, pa.binary()), pa.array(digests, pa.string()), pa.array(fine, pa.bool_())],
            names=[*keep, "payload", "found_digest", "sound"],
        )


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page: ``page_id, type, refers_to, length, digest, payload, found_digest, sound``.

    ``payload`` is the decoded body of a response; a revisit has none and takes it from the page it refers to.
    ``sound`` is false where segments or the digest do not agree with the record.
    """
    return reassemble(read_records(spark, folder)).mapInArrow(
        _payloads,
        "page_id bigint, type string, refers_to bigint, length bigint, digest string, payload binary,"
        " found_digest string, sound boolean",
    )


def archive_table(pages: DataFrame, folder: str, **options) -> DataFrame:
    """Write ``pages`` to archives and read them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to, sound``.

    Length and digest of a response come from its decoded payload, those of a revisit from its header.  An empty table
    gives no rows; further columns are not looked at.
    """
    write_warc(pages, folder, **options)
    back = read_warc(pages.sparkSession, folder)
    return back.select(
        "page_id",
        F.coalesce(F.octet_length("payload"), F.col("length")).cast("long").alias("payload_bytes"),
        F.col("found_digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
        "sound",
    )
