"""Deterministic sharded WARC writer and its reader.

Payload digests are computed in the JVM; the first record of each payload is found by a pre-aggregated minimum, so a
payload that very many records share is no burden. Notes on which records revisit which are merged with the records in
one range partitioning by id. Each task writes its range in id order, one gzip member a record, and starts a further file
when the compressed size reaches a limit. Files are written under temporary names and renamed; the manifest lists the
files of the tasks that counted, with sizes and SHA-256 digests. Headers, record ids and digests are generated anew from
the rows alone, so the same rows in the same ranges give the same bytes.

Defined results: a null payload is an empty one. Of equal payloads (of revisit_from bytes or more) the record with the
smallest id is the response; the others revisit it. Rows that share an id and a payload: the first by url is the response.
A row with a null id is written, sorted first, as a response that nothing refers to. Empty tables give an empty manifest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.shared import file_system, partitions_for, quoted, scratch

ROLL_BYTES = 256 << 20
DATE = "2000-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, for URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(record: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, record)}>"


def one_line(value: str | None) -> str:
    """A header's value: line ends and other control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def record_bytes(page_id, copy: int, url: str | None, payload: bytes, refers_to) -> bytes:
    """One record with all its headers; a revisit has the payload's digest and length, but not the payload."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_uri(f'{page_id}#{copy}')}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_uri(f'{refers_to}#0')}", f"X-Refers-To-Page: {refers_to}", f"WARC-Profile: {PROFILE}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if refers_to is None else b"")
    head += [
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_archive(stream):
    """(headers, payload) of each record of an open .warc.gz stream; fails where lengths or digests differ."""
    with gzip.open(stream) as f:
        while first := f.readline():
            if first != b"WARC/1.1\r\n":
                raise ValueError(f"no record starts here: {first[:40]!r}")
            head = {}
            while (line := f.readline()) != b"\r\n":
                if not line.endswith(b"\r\n"):
                    raise ValueError("the archive ends within a record's headers")
                key, _, value = line[:-2].decode("utf-8", "surrogatepass").partition(": ")
                head[key] = value
            block = f.read(int(head["Content-Length"]))
            if f.read(4) != b"\r\n\r\n" or f"sha1:{base32_sha1(block)}" != head["WARC-Block-Digest"]:
                raise ValueError(f"damaged record {head['WARC-Record-ID']}")
            payload = block.partition(b"\r\n\r\n")[2]
            if head["WARC-Type"] == "response" and f"sha1:{base32_sha1(payload)}" != head["WARC-Payload-Digest"]:
                raise ValueError(f"payload and digest differ in {head['WARC-Record-ID']}")
            yield head, payload


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_from: int = 0,
    roll_bytes: int = ROLL_BYTES,
    shards: int | None = None,
) -> str:
    """Writes pages to path as .warc.gz files in ascending id order, and returns the path of the manifest."""
    spark = pages.sparkSession
    fs, folder = file_system(path)
    fs.create_dir(folder, recursive=True)
    rows = pages.select(
        F.col(quoted(id_col)).cast("long").alias("page"),
        F.col(quoted(url_col)).cast("string").alias("url"),
        F.coalesce(F.encode(F.col(quoted(payload_col)), "UTF-8"), F.lit(b"")).alias("payload"),
    )
    digests = rows.where(F.col("page").isNotNull() & (F.octet_length("payload") >= revisit_from)).select("page", F.unhex(F.sha1("payload")).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    none = F.lit(None)
    notes = digests.join(first.drop("n"), "digest").select(
        "page", none.cast("string").alias("url"), none.cast("binary").alias("payload"), F.lit(0).alias("kind"), "digest", "first"
    )
    records = rows.select("page", "url", "payload", F.lit(1).alias("kind"), none.cast("binary").alias("digest"), none.cast("long").alias("first"))
    sorted_rows = (
        records.unionByName(notes)
        .repartitionByRange(shards or partitions_for(spark), F.col("page").asc_nulls_first())
        .sortWithinPartitions(F.col("page").asc_nulls_first(), "kind", F.col("url").asc_nulls_first(), "payload")
        .withColumn("shard", F.spark_partition_id())
        .select("shard", "page", "url", "payload", "kind", "digest", "first")
    )

    def write(batches):
        import pyarrow as pa

        fs, folder = file_system(path)
        out, name, size, sha, held = None, "", 0, None, 0
        done, page, copy, known, used = [], object(), 0, {}, set()

        def close():
            out.close()
            fs.move(f"{folder}/.{name}.tmp", f"{folder}/{name}")
            done.append((shard, rolled, name, held, size, sha.hexdigest()))

        shard, rolled = 0, 0
        for batch in batches:
            columns = [batch.column(i) for i in range(7)]
            for i in range(batch.num_rows):
                part, number, url, payload, kind, digest, first = (c[i].as_py() for c in columns)
                shard = part
                if number != page or (number is None and page is not None):
                    page, copy, known, used = number, 0, {}, set()
                if kind == 0:
                    known[digest] = first
                    continue
                key = hashlib.sha1(payload).digest()
                refers = known.get(key)
                if refers == number and key not in used:  # the first of its payload
                    refers = None
                used.add(key)
                if out is not None and size >= roll_bytes:
                    close()
                    out, rolled = None, rolled + 1
                if out is None:
                    name = f"part-{shard:06d}-{rolled:05d}-{uuid.uuid4().hex[:12]}.warc.gz"
                    out, size, sha, held = fs.open_output_stream(f"{folder}/.{name}.tmp", compression=None), 0, hashlib.sha256(), 0
                member = gzip.compress(record_bytes(number, copy, url, payload, refers), 6, mtime=0)
                out.write(member)
                sha.update(member)
                size, held, copy = size + len(member), held + 1, copy + 1
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], schema=pa.schema(fields))

    import pyarrow as pa

    fields = [("shard", pa.int32()), ("roll", pa.int32()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]
    fields = [pa.field(*f) for f in fields]
    schema = "shard int, roll int, name string, records long, bytes long, sha256 string"
    files = sorted(sorted_rows.mapInArrow(write, schema).collect(), key=lambda r: (r.shard, r.roll))  # a row for each file
    with fs.open_output_stream(f"{folder}/.manifest.json.tmp") as f:
        f.write(json.dumps({"files": [r.asDict() for r in files]}).encode())
    fs.move(f"{folder}/.manifest.json.tmp", f"{folder}/manifest.json")
    return f"{path}/manifest.json"


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row a record of the files in the manifest: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    fs, folder = file_system(path)
    with fs.open_input_stream(f"{folder}/manifest.json") as f:
        names = [(x["name"],) for x in json.loads(f.read())["files"]]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema += ", payload binary" if with_payload else ""
    if not names:
        return spark.createDataFrame([], schema)

    def read(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]
        fields = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: len(kinds)]
        fs, folder = file_system(path)
        held, weight = [], 0
        number = lambda x: int(x) if x is not None else None
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as f:
                    for head, payload in read_archive(f):
                        row = (
                            number(head.get("X-Page-ID")), head["WARC-Target-URI"], int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"),
                            head["WARC-Type"], number(head.get("X-Refers-To-Page")),
                        )
                        held.append((*row, payload if row[4] == "response" else None) if with_payload else row)
                        weight += 100 + (len(payload) if with_payload else 0)
                        if weight > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=fields)
                            held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=fields)

    return spark.createDataFrame(names, "name string").repartition(len(names), "name").mapInArrow(read, schema)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = scratch(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path, with_payload=False).drop("url")


OP2_SQL = r"""
with p as (select page_id, encode(coalesce(html, '')) as body, sha1(coalesce(html, '')) as h from pages),
bits as (
  select page_id, octet_length(body) as payload_bytes, h, min(page_id) over (partition by h) as first from p
),
groups as (
  select page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(v as int), 1), '' order by k) as d
  from (
    select page_id, k, ((cast('0x' || substr(h, 1 + 10 * (k // 8), 10) as bigint) >> (35 - 5 * (k % 8))) & 31) as v
    from (select page_id, h, unnest(range(32)) as k from bits)
  ) group by page_id
)
select bits.page_id, cast(payload_bytes as bigint) as payload_bytes, d as payload_digest,
       case when first = bits.page_id then 'response' else 'revisit' end as record_type,
       case when first = bits.page_id then null else first end as refers_to
from bits join groups on bits.page_id = groups.page_id
"""
