"""WARC archives: write the index first, then read selected records by coalesced, sorted byte ranges.

One archive per task, every record its own gzip member.  Equal payloads are found by digest and size before anything is
written: the record with the largest id is the response, the others revisit it and carry no payload.  The index names
archive, offset and length of each record; readers get places sorted by offset and join near ones into one read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel import storage
from tidewheel.llm import shared_files

SALTS = 16
REGION = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def _name(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, key)}>"


def record(key: str, url: str | None, payload: bytes, size: int, sha1_hex: str, refers_to: str | None) -> bytes:
    """One record as a gzip member; a revisit has the HTTP head only, which still tells the payload's size."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(key)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode())
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}", f"X-Page-Refers-To: {refers_to}"]
    lines += [f"X-Page-ID: {key}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def parse(data: bytes) -> dict[str, str | bytes]:
    """Header fields in lower case, ``http`` fields of the block and the ``payload`` of one decompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields: dict[str, str | bytes] = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    for line in http.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields["http " + name.strip().lower()] = value.strip()
    fields["payload"] = payload
    return fields


def write(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", broadcast_groups: int = 100_000) -> DataFrame:
    """Write all rows as archives and return the index: id, url, digest, file, offset, length, record_type.

    Null payloads are empty.  Rows that repeat the largest id of a group are all responses; a null id counts as the
    smallest, and a group of null ids alone has only responses.  An empty table writes nothing.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("sha", F.sha1("body")).withColumn("size", F.octet_length("body"))
    groups = rows.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = storage.materialize(groups, "payloads")
    if groups.limit(broadcast_groups + 1).count() <= broadcast_groups:
        planned = rows.join(F.broadcast(groups), ["sha", "size"], "left")
    else:  # a payload that a third of the pages share is spread over the salts
        spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        planned = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(spread, ["sha", "size", "salt"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("id"))
    planned = planned.select("id", F.col("id").cast("string").alias("key"), "url", "sha", "size", F.when(~revisit, F.col("body")).alias("body"), F.when(revisit, F.col("keeper").cast("string")).alias("refers"))
    kind = pages.schema[id_col].dataType.simpleString()

    def archive(batches):
        out, at, uri = None, 0, ""
        for batch in batches:
            places = []
            for key, url, sha, size, text, refers in zip(batch["key"], batch["url"], batch["sha"], batch["size"], batch["body"], batch["refers"], strict=True):
                if out is None:
                    uri, out = shared_files.create(folder, f"pages-{TaskContext.get().partitionId():06d}")
                data = record(key if key is not None else "null", url, (text or "").encode("utf-8", "surrogatepass"), int(size), sha, refers)
                out.write(data)
                places.append((uri, at, len(data), "response" if refers is None else "revisit"))
                at += len(data)
            index = pd.DataFrame(places, columns=["file", "offset", "length", "record_type"])
            for i, name in enumerate(("id", "url")):
                index.insert(i, name, batch[name].to_numpy())
            index.insert(2, "digest", batch["sha"].to_numpy())
            yield index
        if out is not None:
            out.close()

    schema = f"id {kind}, url string, digest string, file string, offset long, length long, record_type string"
    return storage.materialize(planned.mapInPandas(archive, schema), "archive-index")


def read(index: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Read the records that ``index`` names: id, payload_bytes, payload_digest, record_type, refers_to.

    A response is checked against its digest; a damaged archive raises.
    """
    kind = index.schema["id"].dataType.simpleString()

    def task(batches):
        for batch in batches:
            for uri, part in batch.groupby("file", sort=False):
                out = []
                for data in shared_files.read_places(uri, list(zip(part["offset"].tolist(), part["length"].tolist(), strict=True))):
                    got = parse(zlib.decompress(data, 31))
                    digest = got["warc-payload-digest"].removeprefix("sha1:")
                    if got["warc-type"] == "response" and base64.b32encode(hashlib.sha1(got["payload"]).digest()).decode() != digest:
                        raise ValueError(f"damaged record in {uri}")
                    out.append((got["x-page-id"], int(got["http content-length"]), digest, got["warc-type"], got.get("x-page-refers-to")))
                yield pd.DataFrame(out, columns=["key", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    places = index.select("file", "offset", "length").withColumn("region", F.floor(F.col("offset") / REGION))
    # rows of the index are small and what they stand for is not: the number of tasks follows the bytes to read
    tasks = shared_files.tasks(index.sparkSession, index.agg(F.sum("length")).head()[0], REGION)
    places = places.repartition(tasks, "file", "region").sortWithinPartitions("file", "offset").drop("region")
    found = places.mapInPandas(task, "key string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    key = F.when(F.col("key") != "null", F.col("key")).cast(kind)
    return found.select(key.alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))
