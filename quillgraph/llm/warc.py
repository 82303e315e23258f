"""WARC archives compressed record by record with a Zstandard dictionary.

Every partition becomes one archive: a skippable frame that holds the dictionary (built from records
of that archive), then one Zstandard frame for each record, so that any record can be read alone.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.runtime import materialise, scratch_path

#: Fixed values of the archive format: magic numbers of the dictionary frame and of a Zstandard frame.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
DICTIONARY_BYTES = 64 << 10
#: Records are held back until so many bytes are there to build the dictionary from.
SAMPLE_BYTES = 4 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "archive string, records long, bytes long"
RECORD = "record_id long, record_type string, target_uri string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _header(lines: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode()


def _urn(number: int | None) -> str:
    return f"<urn:x-row:{'null' if number is None else number}>"


def _number(urn: str | None) -> int | None:
    last = (urn or "").rstrip(">").rpartition(":")[2]
    return int(last) if last.lstrip("-").isdigit() else None


def record_bytes(number: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, size: int) -> bytes:
    """One record: a response with its payload, or a revisit that names the response instead."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    lines = [("WARC-Type", kind), ("WARC-Record-ID", _urn(number)), ("WARC-Date", DATE)]
    if uri:
        lines.append(("WARC-Target-URI", uri.replace("\r", "%0D").replace("\n", "%0A")))
    lines.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        lines += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", PROFILE)]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(lines) + block + b"\r\n\r\n"


def _parse(record: bytes, with_payload: bool) -> tuple:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")).split(b":")[1])
    stated = fields["WARC-Payload-Digest"].partition(":")[2]
    if fields["WARC-Type"] == "response":
        found = hashlib.sha1(payload).hexdigest()
        if found != stated or len(payload) != size:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return _number(fields["WARC-Record-ID"]), fields["WARC-Type"], fields.get("WARC-Target-URI"), _number(fields.get("WARC-Refers-To")), size, stated, payload if with_payload and fields["WARC-Type"] == "response" else None


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained where there are enough records for it, else the beginning of the records themselves."""
    if not records:
        return None
    if len(records) >= 16:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, records)) // 8)), records)
        except zstandard.ZstdError:
            pass
    raw = b"".join(records)[:DICTIONARY_BYTES]
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None


def write_archives(pages: DataFrame, out_dir: str) -> DataFrame:
    """Write (record_id, uri, payload, digest, size, refers_to) as one archive for each partition.

    Returns the manifest: archive, records, bytes. An archive gets its final name only when it is whole,
    and only archives in the manifest count, so a task may be run again. A partition holds back at most
    about ``SAMPLE_BYTES`` of records; the rest streams through. No rows give no archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(out_dir) if "://" in out_dir or out_dir.startswith("file:") else (fs.LocalFileSystem(), out_dir)
        store.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}"
        out, held, held_bytes, packer, count = None, [], 0, None, 0

        def flush():
            nonlocal out, packer, held, held_bytes
            if out is None:
                words = _dictionary(held)
                data = words.as_bytes() if words else b""
                out = store.open_output_stream(name + ".open", compression=None)
                out.write(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data)
                packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=True) if words else zstandard.ZstdCompressor(level=LEVEL)
            for record in held:
                out.write(packer.compress(record))
            held, held_bytes = [], 0

        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(6)), strict=True):
                number, uri, payload, digest, size, refers = (v.as_py() for v in row)
                record = record_bytes(number, uri, payload or b"", digest, refers, size)
                held.append(record)
                held_bytes += len(record)
                count += 1
                if out is not None or held_bytes >= SAMPLE_BYTES:
                    flush()
        if count:
            flush()
            length = out.tell()
            out.close()
            store.move(name + ".open", name + ".warc.zst")
            yield pa.RecordBatch.from_pydict({"archive": [f"{out_dir}/{name.rpartition('/')[2]}.warc.zst"], "records": [count], "bytes": [length]})

    columns = pages.select("record_id", "uri", "payload", "digest", "size", "refers_to")
    return columns.mapInArrow(write, MANIFEST)


def iter_records(stream, chunk: int = 256 << 10) -> Iterator[bytes]:
    """The records of one archive, in order; memory holds one record and one chunk."""
    head = stream.read(8)
    magic, length = struct.unpack("<II", head)
    if magic != DICTIONARY_FRAME:
        raise ValueError("an archive begins with its dictionary")
    data = stream.read(length)
    words = None
    if data:
        trained = data[:4] == struct.pack("<I", 0xEC30A437)
        words = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    unpacker = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
    rest = b""
    while True:
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            rest = rest or stream.read(chunk)
            if not rest:
                if parts:
                    raise ValueError("the archive ends within a record")
                return
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the archives in ``manifest``, checked against its stated digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [n for n in RECORD.replace(",", "").split()[::2]]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        schema = pa.schema(list(zip(names, types, strict=True)))
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
                rows, size = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for record in iter_records(stream):
                        rows.append(_parse(record, with_payload))
                        size += len(record) if with_payload else 100
                        if size > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], schema=schema)

    return manifest.select("archive").mapInArrow(read, RECORD)


def plan_records(df: DataFrame, id_col: str, uri_col: str, text_col: str, least: int = REVISIT_BYTES) -> DataFrame:
    """One row for each record to write, with the record that it revisits.

    Of rows with equal payloads of at least ``least`` bytes, the one with the largest id is the response
    and the others refer to it. Keepers are found by an aggregation with map-side combination, so a payload that
    a third of all rows share is no burden; the join back has one row for each repeated payload, and a large side
    that adaptive execution can split. Null texts are empty payloads. A row without an id refers to the
    keeper of its payload; if no row of a group has an id, all of them are responses. With repeated ids, the rows
    of the largest id are all responses.
    """
    rows = df.select(F.col(id_col).cast("long").alias("record_id"), F.col(uri_col).alias("uri"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    kept = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("record_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").select("digest", "keeper")
    refers = F.when(F.col("record_id").eqNullSafe(F.col("keeper")), None).otherwise(F.col("keeper"))
    joined = rows.join(kept, "digest", "left").withColumn("refers_to", refers)
    return joined.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))


def archive(df: DataFrame, id_col: str, uri_col: str, text_col: str, out_dir: str | None = None) -> DataFrame:
    """Write ``df`` into archives under ``out_dir`` (default: the shared folder) and return the manifest."""
    spark = df.sparkSession
    planned = plan_records(df, id_col, uri_col, text_col)
    return materialise(write_archives(planned, out_dir or scratch_path(spark, "warc")), "warc-manifest")
