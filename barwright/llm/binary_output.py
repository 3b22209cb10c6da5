"""Token ids in files: a shared zstandard dictionary, a frame for each document, an offset index.

A dictionary is trained on the serialized ids of a bounded sample of documents (the ``sample`` documents with the least
hashes of their ids). Documents go to even ranges of ids in ascending order; each range is written as files of at most
``file_bytes``, a frame of its own for each document. A file is

    magic (8 bytes), bytes an id (1), dictionary hash (8), number of documents (8), index offset (8),
    frames, index: doc_id (i64, with a null mask), frame offset (u64), number of ids (u32)

and the folder has the dictionary, a manifest, and a Parquet table of the files (``files``: bucket, part, file, documents,
ids), of which running sums give each file's first document and id. A document is read by its index entry alone. Files are written under an attempt's own name and renamed, so that repeated tasks do no harm.

Nulls: a null text is empty (its end id alone is written); a null id comes first. Repeated ids are in order of their
texts. An empty table writes a manifest without files. Extra columns are ignored.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.llm.common import bucket_of, id_order, new_folder, range_bounds, ship, shuffle_partitions, sliced, string_list
from barwright.llm.tokens import encode, tokenizer, tokenizer_path

MAGIC = b"IDSZSTD1"
HEAD = struct.Struct("<8sBQQQ")
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("n", "<u4")])
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, file string"


def _open(folder: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pfs.LocalFileSystem(), folder)


def _put(folder: str, name: str, data: bytes) -> None:
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    own = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(data)
    fs.move(own, f"{base}/{name}")


def _get(folder: str, name: str) -> bytes:
    fs, base = _open(folder)
    with fs.open_input_stream(f"{base}/{name}") as f:
        return f.read()


def train(docs: DataFrame, name: str, end_id: int, width: int, sample: int, size: int) -> bytes:
    """A dictionary from the serialized ids of a bounded sample; b'' if there's too little to learn from."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path(name)
        for b in sliced(batches, "text"):
            texts = string_list(b.column("text"))
            ids, n = encode(path, texts, end_id, False)
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([pa.array([ids[e - k : e].astype(f"<u{width}").tobytes() for e, k in zip(ends, n, strict=True)], pa.binary())], names=["raw"])

    # ids first, so that only texts that are drawn are read into Python
    drawn = docs.select(F.xxhash64(key).alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if drawn is None:
        return b""
    picked = docs.where(F.xxhash64(key) <= drawn).select("doc_id", "text")
    rows = [bytes(r["raw"]) for r in picked.mapInArrow(ids_of, "raw binary").limit(sample).collect()]
    try:
        return zstandard.train_dictionary(size, rows).as_bytes()
    except zstandard.ZstdError:
        return b""


@lru_cache(maxsize=2)
def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


class Writer:
    """One file."""

    def __init__(self, raw_dict: bytes, width: int, level: int):
        self.raw_dict, self.width, self.body, self.index = raw_dict, width, io.BytesIO(), []
        d = _dictionary(raw_dict)
        self.z = zstandard.ZstdCompressor(level=level, dict_data=d) if d else zstandard.ZstdCompressor(level=level)
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id or 0, doc_id is None, HEAD.size + self.body.tell(), len(ids)))
        self.body.write(self.z.compress(ids.astype(f"<u{self.width}").tobytes()))
        self.n_ids += len(ids)

    def content(self) -> bytes:
        body = self.body.getvalue()
        head = HEAD.pack(MAGIC, self.width, xxhash.xxh64_intdigest(self.raw_dict), len(self.index), HEAD.size + len(body))
        return head + body + np.array(self.index, ENTRY).tobytes()


class Reader:
    """One file's bytes; the dictionary must be the one that the file was written with."""

    def __init__(self, content: bytes, raw_dict: bytes):
        magic, self.width, hashed, n, at = HEAD.unpack_from(content)
        if magic != MAGIC or hashed != xxhash.xxh64_intdigest(raw_dict):
            raise ValueError("not such a file, or another dictionary")
        self.content, self.index, self.body_end = content, np.frombuffer(content, ENTRY, n, at), at
        d = _dictionary(raw_dict)
        self.z = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document, read by its index entry."""
        begin = int(self.index["offset"][k])
        end = int(self.index["offset"][k + 1]) if k + 1 < len(self.index) else self.body_end
        raw = self.z.decompress(self.content[begin:end], max_output_size=int(self.index["n"][k]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype(np.uint32)


def write(docs: DataFrame, folder: str, name: str = "byte_bpe_50k.json", end_id: int = 0, sample: int = 1000, dict_bytes: int = 112_640, level: int = 3, file_bytes: int = 32 << 20) -> dict:
    """Writes the files and their table and gives the manifest. sample, dict_bytes: bounds of the dictionary's training set and size."""
    spark = docs.sparkSession
    ship(spark)
    width = 2 if max(tokenizer(tokenizer_path(name)).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
    raw_dict = train(docs, name, end_id, width, sample, dict_bytes)
    _put(folder, "dictionary.zstd", raw_dict)
    key = id_order(F.col("doc_id").cast("long"))
    bounds = range_bounds(docs, key, shuffle_partitions(spark))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), bucket_of(key, bounds).alias("bucket"))
    dealt = rows.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, raw = tokenizer_path(name), _get(folder, "dictionary.zstd")
        w, k, bucket = Writer(raw, width, level), 0, 0

        def done() -> pa.RecordBatch:
            file = f"ids-{bucket:06d}-{k:05d}.bin"
            _put(folder, file, w.content())
            return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "part": pa.array([k], pa.int32()), "file": [file], "documents": pa.array([len(w.index)], pa.int64()), "ids": pa.array([w.n_ids], pa.int64())})

        for part in sliced(batches, "text", 8_000_000, 8192):
            bucket = part.column("bucket")[0].as_py()
            ids, n = encode(path, string_list(part.column("text")), end_id, False)
            ends = np.cumsum(n)
            for i, e, c in zip(part.column("doc_id").to_pylist(), ends.tolist(), n.tolist(), strict=True):
                w.add(i, ids[e - c : e])
                if w.body.tell() >= file_bytes:
                    yield done()
                    w, k = Writer(raw, width, level), k + 1
        if w.index:
            yield done()

    dealt.mapInArrow(files, FILES).write.mode("overwrite").parquet(f"{folder}/files")
    manifest = {"tokenizer": name, "end_id": end_id, "width": width, "dictionary": f"{xxhash.xxh64_intdigest(raw_dict):016x}"}
    _put(folder, "manifest.json", json.dumps(manifest).encode())
    return manifest


FILES = "bucket int, part int, file string, documents long, ids long"


def file_table(spark: SparkSession, folder: str) -> DataFrame:
    """The folder's files with first_document and first_id: sums over buckets (one an id range) and then within each."""
    files = spark.read.schema(FILES).parquet(f"{folder}/files")
    totals = files.groupBy("bucket").agg(F.sum("documents").alias("documents"), F.sum("ids").alias("ids"))
    # a row for each id range, as many as shuffle partitions
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("bucket"), F.coalesce(F.sum("documents").over(upto), F.lit(0)).alias("base_document"), F.coalesce(F.sum("ids").over(upto), F.lit(0)).alias("base_id"))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = files.select("*", F.coalesce(F.sum("documents").over(before), F.lit(0)).alias("d"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("i"))
    return within.join(base, "bucket").select(*files.columns, (F.col("base_document") + F.col("d")).alias("first_document"), (F.col("base_id") + F.col("i")).alias("first_id"))


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32, file."""
    rows = file_table(spark, folder).select("file", "first_id")
    n = max(rows.count(), 1)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = _get(folder, "dictionary.zstd")
        for b in batches:
            for file, base in zip(b.column("file").to_pylist(), b.column("first_id").to_pylist(), strict=True):
                r = Reader(_get(folder, file), raw)
                n = r.index["n"].astype(np.int64)
                crc = [zlib.crc32(r.ids(k).astype("<u4").tobytes()) for k in range(len(n))]
                ids = pa.array(r.index["doc_id"].astype(np.int64), mask=r.index["null"].astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(base + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64()), pa.array([file] * len(n))], names=["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    return rows.repartition(n).mapInArrow(documents, SCHEMA)


def round_trip(docs: DataFrame) -> DataFrame:
    """Writes docs' ids to a new folder beside the checkpoints and reads the files back."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-files")
    write(docs, folder)
    return read_back(spark, folder)
