"""Token-ID / binary output.

Every document becomes one framed record of a binary file: length of the payload (unsigned 64-bit little-endian), a
masked checksum of these eight bytes, the payload, a masked checksum of the payload. Masking (rotate right by 15 bits,
add a constant) keeps a checksum of data that holds checksums sound, as in TFRecord files; the checksum itself is CRC-32.
The payload is doc_id (signed 64-bit; the smallest value stands for null) and the ids, 2 bytes each where the vocabulary
allows it. Beside each file a Parquet index holds doc_id, file, byte offset, record length and first token, so that a
shuffled reader seeks straight to any record.

Cases: a null or empty text gives the end id alone; a null doc_id sorts first; rows that repeat a doc_id are all written;
an empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._base import Scratch, batch, text_chunks
from lodestone.llm.word_ids import LowerWords, word_ids

#: Bytes of text that a worker turns into ids at once.
CHUNK_BYTES = 4 << 20
_MASK_DELTA = 0xA282EAD8
_NULL_ID = -(1 << 63)


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(record: bytes) -> bytes:
    (size, head_crc) = struct.unpack_from("<QI", record)
    payload = record[12 : 12 + size]
    if head_crc != masked_crc(record[:8]) or len(payload) != size or struct.unpack_from("<I", record, 12 + size)[0] != masked_crc(payload):
        raise ValueError("a record's checksum is wrong")
    return payload


def open_out(path: str):
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return where, inner


def uri(path: str) -> str:
    """Hadoop writes file:/x where others write file:///x."""
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


INDEX = pa.schema([("doc_id", pa.int64()), ("file", pa.string()), ("part", pa.int32()), ("offset", pa.int64()), ("record_bytes", pa.int64()), ("n_tokens", pa.int64()), ("start_in_file", pa.int64())])


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, partitions: int | None = None) -> DataFrame:
    """Writes the files under folder/data in ascending doc_id order (part number, then offset) and returns their index.

    A task that runs again writes a file under a new name; only files that the index names count."""
    n = partitions or max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    folder = uri(folder)

    def write(batches):
        from pyspark import TaskContext

        ids, part = word_ids(LowerWords, tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], ids.dtype).tobytes()
        where, inner = open_out(folder)
        where.create_dir(f"{inner}/data", recursive=True)
        name, out, offset, start = f"data/part-{part:05d}-{uuid.uuid4().hex}.bin", None, 0, 0
        for rows, texts in text_chunks(batches, CHUNK_BYTES):
            index = []
            for doc_id, own in zip(rows.column("doc_id").to_pylist(), ids.encode(texts), strict=True):
                tokens = own.tobytes() + end
                record = frame(struct.pack("<q", _NULL_ID if doc_id is None else doc_id) + tokens)
                out = out or where.open_output_stream(f"{inner}/{name}")
                out.write(record)
                count = len(tokens) // ids.dtype.itemsize
                index.append((doc_id, name, part, offset, len(record), count, start))
                offset, start = offset + len(record), start + count
            yield batch(INDEX, list(zip(*index, strict=True)))
        if out:
            out.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first()).mapInArrow(write, "doc_id long, file string, part int, offset long, record_bytes long, n_tokens long, start_in_file long")


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_records(index: DataFrame, folder: str, dtype: str, before: dict[int, int]) -> DataFrame:
    """Reads each record that the index names; before: tokens ahead of each part, one entry a file."""
    folder = uri(folder)

    def read(batches):
        where, inner = open_out(folder)
        name, source = None, None
        for rows in batches:
            out = []
            for x in rows.to_pylist():
                if x["file"] != name:
                    name, source = x["file"], where.open_input_file(f"{inner}/{x['file']}")
                payload = unframe(source.read_at(x["record_bytes"], x["offset"]))
                (doc_id,) = struct.unpack_from("<q", payload)
                ids = np.frombuffer(payload, dtype, offset=8).astype("<u4")
                out.append((None if doc_id == _NULL_ID else doc_id, before[x["part"]] + x["start_in_file"], len(ids), zlib.crc32(ids.tobytes())))
            if out:
                yield batch(READ, list(zip(*out, strict=True)))

    return index.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_binary(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes the documents' records and their index, reads the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-binary")
    folder = folder or scratch.root
    write_records(docs, tokenizer_path, end_id, folder).write.parquet(f"{folder}/index")
    index = spark.read.schema("doc_id long, file string, part int, offset long, record_bytes long, n_tokens long, start_in_file long").parquet(f"{folder}/index")
    before, total = {}, 0
    for part, n in sorted(tuple(r) for r in index.groupBy("part").agg(F.sum("n_tokens")).collect()):  # a row a file
        before[part], total = total, total + n
    return read_records(index, folder, word_ids(LowerWords, tokenizer_path).dtype.str, before)


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_binary(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2)
