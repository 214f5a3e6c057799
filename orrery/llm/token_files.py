"""Token-id files: one zstandard frame per document, a shared dictionary and an offset index.

A file is: magic, dictionary id (SHA-256 of the dictionary), frames, doc_ids (signed 64-bit), a byte per
document that is 1 where its doc_id is null, index (per document: offset, compressed length, number of
ids as unsigned 64-bit little-endian), then the doc_ids' offset and the number of documents. A frame holds the ids as unsigned 16-bit values where the vocabulary
allows it and as 32-bit values otherwise; a byte in the header says which.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filesystem, fresh_path, materialize, write_once
from .tokens import encoder

MAGIC = b"TOKZDIC1"
END = 2
#: Bounds of the sample that trains the compression dictionary (documents, bytes of each); it changes
#: sizes, never contents.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY = 400, 10_000, 64 << 10
LEVEL = 3
#: Ids that are looked at first for the sample, so that texts are read once; it changes no result.
CANDIDATES = 4 * SAMPLE_DOCS


def train_dictionary(docs: DataFrame, tokenizer: str, end: int = END) -> bytes:
    """A zstandard dictionary from the serialized ids of SAMPLE_DOCS documents of up to SAMPLE_BYTES bytes.

    They are the first by hash of doc_id. Empty (no dictionary) if there are too few to train on.
    """
    import zstandard

    size = F.octet_length("text")
    usable = docs.where(F.col("doc_id").isNotNull() & (size > 0) & (size <= SAMPLE_BYTES)).select("doc_id", "text")
    for some, n in ((docs.where("doc_id is not null"), CANDIDATES), (usable, SAMPLE_DOCS)):
        picked = [r[0] for r in some.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
        found = usable.where(F.col("doc_id").isin(picked)).groupBy("doc_id").agg(F.min("text").alias("text"))
        texts = sorted(r["text"] for r in found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()) if picked else []
        if len(texts) == SAMPLE_DOCS or len(picked) < n:  # as many as wanted, or no other ids
            break
    ids = [np.frombuffer(x, "<u4").astype(_width(tokenizer)).tobytes() for x in encoder(tokenizer).ids(texts)]
    try:
        return zstandard.train_dictionary(DICTIONARY, [x[i : i + 2048] for x in ids for i in range(0, len(x), 2048)]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _width(tokenizer: str) -> str:
    return "<u4" if encoder(tokenizer).tokenizer.get_vocab_size() > 1 << 16 else "<u2"


def _codec(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True), zstandard.ZstdDecompressor(dict_data=shared)


def write_files(docs: DataFrame, tokenizer: str, folder: str, end: int = END) -> DataFrame:
    """Write all rows in ascending doc_id order to files in ``folder``; returns the manifest.

    Rows are range-partitioned by doc_id (nulls first, equal ids by text), one file per partition.
    A file has the name of the attempt that wrote it, and the manifest names the attempt that was
    committed, so a repeated task does no harm. Manifest: (file, first, last, docs, ids) per file, in
    file order; first and last are doc_ids. Null texts are empty, null doc_ids come first; texts of
    any length are encoded whole, rows with equal ids all stay; an empty table gives no file. Other
    columns play no part.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer, end)
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)
    write_once(files, f"{root}/dictionary", iter([dictionary]))
    digest = hashlib.sha256(dictionary).digest()
    shared = spark.sparkContext.broadcast(dictionary)
    mark = np.array([end], "<u4").tobytes()
    kind = pa.schema([("file", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())])

    def write(batches):
        from pyspark import TaskContext

        store, base = filesystem(folder)
        press, _ = _codec(shared.value)
        wide = _width(tokenizer) == "<u4"
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok"
        index: list[tuple[int, int, int]] = []
        doc_ids: list = []

        def chunks():
            yield (head := MAGIC + digest + bytes([4 if wide else 2]))
            at = len(head)
            for b in batches:
                for i in range(0, b.num_rows, 1024):
                    part = b.slice(i, 1024)
                    doc_ids.extend(part.column(0).to_pylist())
                    for x in encoder(tokenizer).ids([t or "" for t in part.column(1).to_pylist()]):
                        ids = np.frombuffer(x + mark, "<u4")
                        frame = press.compress(ids.tobytes() if wide else ids.astype("<u2").tobytes())
                        index.append((at, len(frame), len(ids)))
                        at += len(frame)
                        yield frame
            yield np.array([d or 0 for d in doc_ids], "<i8").tobytes()
            yield bytes(d is None for d in doc_ids)
            yield np.array(index, "<u8").tobytes()
            yield struct.pack("<QQ", at, len(index))

        write_once(store, f"{base}/{name}", chunks())
        if index:
            known = [d for d in doc_ids if d is not None] or [None]
            yield pa.RecordBatch.from_pydict({"file": [name], "first": [known[0]], "last": [known[-1]], "docs": [len(index)], "ids": [sum(n for _, _, n in index)]}, schema=kind)

    rows = docs.select("doc_id", "text")
    n = max(2, rows.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialize(ordered.mapInArrow(write, "file string, first long, last long, docs long, ids long"), "token-manifest")


def _open(f, name: str, dictionary: bytes) -> tuple[list, np.ndarray, np.dtype]:
    """(doc_ids, index rows, id type) of an open file; its dictionary hash is checked."""
    f.seek(0)
    head = f.read(len(MAGIC) + 33)
    if head[:8] != MAGIC or head[8:40] != hashlib.sha256(dictionary).digest():
        raise ValueError(f"{name}: not written with this dictionary")
    f.seek(f.size() - 16)
    at, n = struct.unpack("<QQ", f.read(16))
    f.seek(at)
    ids = np.frombuffer(f.read(8 * n), "<i8").tolist()
    none = f.read(n)
    index = np.frombuffer(f.read(24 * n), "<u8").reshape(n, 3).astype(np.int64)
    return [None if z else d for d, z in zip(ids, none, strict=True)], index, np.dtype(f"<u{head[40]}")


def read_document(folder: str, manifest: DataFrame, doc_id: int) -> list[np.ndarray]:
    """The ids of every row of one document, by the offset index: its frames are all that is decompressed."""
    store, base = filesystem(folder)
    with store.open_input_file(f"{base}/dictionary") as f:
        dictionary = f.read()
    _, press = _codec(dictionary)
    out = []
    for r in manifest.where((F.col("first") <= doc_id) & (F.col("last") >= doc_id)).orderBy("file").collect():
        with store.open_input_file(f"{base}/{r['file']}") as f:
            doc_ids, index, width = _open(f, r["file"], dictionary)
            for i in (i for i, d in enumerate(doc_ids) if d == doc_id):
                f.seek(int(index[i, 0]))
                out.append(np.frombuffer(press.decompress(f.read(int(index[i, 1]))), width).astype("<u4"))
    return out


def read_files(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    ``start`` counts the ids of all earlier documents: per-file totals from the manifest (one row a
    file) plus a running sum within the file. The dictionary is checked against the file's hash.
    """
    rows = sorted((r["file"], r["ids"]) for r in manifest.collect())
    starts, total = [], 0
    for name, ids in rows:
        starts.append((name, total))
        total += ids
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        store, base = filesystem(folder)
        with store.open_input_file(f"{base}/dictionary") as f:
            dictionary = f.read()
        _, press = _codec(dictionary)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{name}") as f:
                    doc_ids, index, width = _open(f, name, dictionary)
                    n = len(doc_ids)
                    for i in range(0, n, 512):
                        part = index[i : i + 512]
                        f.seek(int(part[0, 0]))
                        data = f.read(int(part[-1, 0] + part[-1, 1] - part[0, 0]))
                        counts, sums = [], []
                        for o, size, count in part.tolist():
                            o -= int(part[0, 0])
                            ids = np.frombuffer(press.decompress(data[o : o + size]), width).astype("<u4")
                            if len(ids) != count:
                                raise ValueError(f"{name}: a frame has {len(ids)} ids, the index says {count}")
                            counts.append(len(ids))
                            sums.append(zlib.crc32(ids.tobytes()))
                        ends = np.cumsum(counts)
                        yield pa.RecordBatch.from_pydict({"doc_id": doc_ids[i : i + 512], "start": (start + ends - counts).tolist(), "n_tokens": counts, "ids_crc32": sums}, schema=kind)
                        start += int(ends[-1])

    parts = spark.createDataFrame(starts, "file string, start long").repartition(max(1, len(starts)), "file")
    return parts.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(spark, "token-files")
    manifest = write_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_files(spark, folder, manifest)
