"""WARC archives: written with an index, read by the index.

Every record is a gzip member of its own, so a byte range of the file is a record. Writing
gives the index: file, offset, length, URL, digest and kind of each record. Reading takes
any rows of the index, sorts them by file and offset, joins neighbouring ranges into one read
and cuts the records out of it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.llm.files import opened
from fleetwatch.plans.cut import cut, shared_path

INDEX = "page_id long, url string, file string, offset long, length long, record_type string, refers_to long, payload_bytes long, payload_digest string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: Payloads below this many bytes are always written out.
LEAST = 1000
#: An archive ends at about so many bytes; ranges of a task stay within as many bytes of a file.
ARCHIVE, SPAN = 1 << 30, 16 << 20
#: Bytes of records that one reading task takes.
TASK = 32 << 20
#: Ranges no further apart than GAP are read at once, READ bytes at most.
GAP, READ = 64 << 10, 8 << 20
_PLAIN = re.compile(r"[\x00-\x20\x7f]")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _member(row) -> bytes:
    """A record as a gzip member. row: page_id, url, html, record_type, refers_to, payload_digest, payload_bytes."""
    payload = b"" if row.record_type == "revisit" or row.html is None else row.html.encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.payload_bytes}\r\n\r\n".encode()
    page = None if pd.isna(row.page_id) else int(row.page_id)
    head = ["WARC/1.1", f"WARC-Type: {row.record_type}", f"WARC-Record-ID: {_record_id(page, row.payload_digest)}"]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if row.url is not None:
        head.append("WARC-Target-URI: " + _PLAIN.sub(lambda m: f"%{ord(m[0]):02X}", row.url))
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row.payload_digest)).decode()}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row.record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(int(row.refers_to), row.payload_digest)}", f"X-Refers-To-Page: {int(row.refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n") + squeeze.flush()


def _writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = opened(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                files, offsets, lengths = [], [], []
                for row in batch.itertuples(index=False):
                    if out is None or at >= ARCHIVE:
                        if out is not None:
                            out.close()
                        # A new name for each attempt: what a failed one leaves is in no index.
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                    member = _member(row)
                    out.write(member)
                    files.append(f"{folder}/{name}")
                    offsets.append(at)
                    lengths.append(len(member))
                    at += len(member)
                yield batch.drop(columns="html").assign(file=files, offset=offsets, length=lengths)[["page_id", "url", "file", "offset", "length", "record_type", "refers_to", "payload_bytes", "payload_digest"]]
        finally:
            if out is not None:
                out.close()

    return write


def plan_records(pages: DataFrame) -> DataFrame:
    """What to write for each page: page_id, payload_digest, record_type, refers_to, payload_bytes.

    Of records with equal payloads of at least LEAST bytes the largest page_id is the response
    (rows that repeat that id with that payload too), the others are revisits of it.
    Equal means equal SHA-1 and length. Null html is an empty payload. Rows with a null page_id
    are responses and nobody's target.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    seen = cut(pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes")))
    groups = seen.where(F.col("payload_bytes") >= LEAST).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("target"), F.count("page_id").alias("n")).where("n > 1").drop("n")
    again = F.col("target").isNotNull() & (F.col("page_id") < F.col("target"))
    return seen.join(groups, ["payload_digest", "payload_bytes"], "left").select(
        "page_id", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("target")).alias("refers_to"), "payload_bytes")


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record for each of `pages` (page_id, url, html) into archives; gives the index.

    `folder`: a shared folder, by default a new one under the checkpoint folder. Other columns
    aren't used. The index is written too, so reading it doesn't write again. An empty table
    gives an empty index.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    system_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(system_path)
    plan = plan_records(pages).where("record_type = 'revisit'").distinct()
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    rows = rows.join(plan.select("page_id", "payload_digest", "refers_to"), ["page_id", "payload_digest"], "left")
    rows = rows.select("page_id", "url", "html", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to", "payload_bytes", "payload_digest")
    return cut(rows.mapInPandas(_writer(folder), INDEX))


def _parse(data: bytes) -> dict:
    raw = zlib.decompress(data, 31)
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    http, _, body = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page, target = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
    return {"page_id": page and int(page), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": target and int(target),
            "payload_bytes": size, "payload_digest": digest, "payload": body if kind == "response" else None}


def ranges(offsets: list[int], lengths: list[int]) -> list[tuple[int, int]]:
    """Slices [i, j) of ranges in order of offset, such that each slice is one read."""
    out, first = [], 0
    for i in range(1, len(offsets) + 1):
        if i == len(offsets) or offsets[i] - (offsets[i - 1] + lengths[i - 1]) > GAP or offsets[i] + lengths[i] - offsets[first] > READ:
            out.append((first, i))
            first = i
    return out if offsets else []


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    for batch in batches:
        for file, part in batch.groupby("file", sort=False):
            system, path = opened(file)
            with system.open_input_file(path) as f:
                offsets, lengths = part["offset"].tolist(), part["length"].tolist()
                for i, j in ranges(offsets, lengths):
                    f.seek(offsets[i])
                    data = f.read(offsets[j - 1] + lengths[j - 1] - offsets[i])
                    found = [_parse(data[o - offsets[i] : o - offsets[i] + n]) for o, n in zip(offsets[i:j], lengths[i:j])]
                    out = pd.DataFrame(found, columns=names)
                    yield out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})


def read_records(index: DataFrame) -> DataFrame:
    """The records of the chosen rows of an index, payload included (null for revisits); repeated rows are read again.

    A record whose payload doesn't fit its digest raises an error.
    """
    places = cut(index.select("file", "offset", "length"))
    total = places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    # As many tasks as the bytes behind the index need: by the index's own size all would be one.
    tasks = max(places.sparkSession.sparkContext.defaultParallelism, -(-total // TASK))
    places = places.repartition(tasks, "file", F.floor(F.col("offset") / SPAN)).sortWithinPartitions("file", "offset")
    return places.mapInPandas(_read, RECORD)


def payloads(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """page_id, url and full payload of the wanted rows of the index, revisits filled from their response.

    Responses are read once, however many revisits they have.
    """
    target = F.coalesce("refers_to", "page_id")
    chosen = wanted.select("page_id", "url", "payload_digest", target.alias("target"))
    need = chosen.select("target", "payload_digest").distinct()
    found = index.where("record_type = 'response'").withColumnRenamed("page_id", "target").dropDuplicates(["target", "payload_digest"])
    bodies = read_records(found.join(need, ["target", "payload_digest"], "left_semi").withColumnRenamed("target", "page_id"))
    bodies = bodies.select(F.col("page_id").alias("target"), "payload_digest", "payload")
    return chosen.join(bodies, ["target", "payload_digest"], "left").select("page_id", "url", "payload")
