"""Token ids in compressed shard files with a shared zstandard dictionary.

One dictionary is trained on the serialized ids of a bounded sample of
documents. A shard file holds consecutive documents in ascending id order,
each a frame of its own, with an index of ids, token counts and offsets, and
the hash of the dictionary it needs: one document is read by one frame.

    8 bytes "LSIDS01\\n" | 32 bytes SHA-256 of the dictionary | uint32 bytes an id
    | uint64 documents | uint64 tokens | int64[documents] doc ids (null: least)
    | uint32[documents] tokens | uint64[documents + 1] offsets | frames

All numbers are little-endian. Files are written under a name of the attempt
and renamed, so a task that runs again leaves one file.

Nulls: a null text is an empty one; a null id is written as the least 64-bit
integer, comes first and is read back as null. Repeated ids are in order of a
hash of their texts and may be spread over shards. Texts of any length are one
frame each. A vocabulary of more ids than fit two bytes takes four. Empty tables give no files and an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as X
from .encode import Encoder, encoded, tokenizer_path
from .scratch import shared_dir

MAGIC = b"LSIDS01\n"
HEAD = struct.Struct("<8s32sIQQ")
#: Text bytes a shard holds about; documents and bytes of the dictionary's sample.
SHARD_BYTES, SAMPLE, DICTIONARY = 8 << 20, 1000, 64 << 10
NULL_ID = -(1 << 63)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def train(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary of the samples; empty where they are too few to train one."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 10)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def id_width(path: str) -> int:
    """Bytes that hold any id of a vocabulary."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab().values(), default=0) < 1 << 16 else 4


class Codec:
    def __init__(self, dictionary: bytes, width: int = 2, level: int = 3):
        self.hash, self.width = hashlib.sha256(dictionary).digest(), width
        data = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True, **data).compress
        self.unpack = zstandard.ZstdDecompressor(**data).decompress

    @classmethod
    def of(cls, dictionary: bytes, shard: bytes) -> Codec:
        """The codec of a shard, by its width."""
        return cls(dictionary, HEAD.unpack_from(shard)[2])

    def write(self, rows: list[tuple[int | None, np.ndarray]]) -> bytes:
        frames = [self.pack(ids.astype(f"<u{self.width}").tobytes()) for _, ids in rows]
        tokens = np.array([len(ids) for _, ids in rows], "<u4")
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
        keys = np.array([NULL_ID if i is None else i for i, _ in rows], "<i8")
        head = HEAD.pack(MAGIC, self.hash, self.width, len(rows), int(tokens.sum()))
        return b"".join([head, keys.tobytes(), tokens.tobytes(), offsets.tobytes(), *frames])

    def index(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Ids, token counts and frame offsets of a shard, and where its frames begin."""
        magic, key, width, n, _ = HEAD.unpack_from(data)
        if magic != MAGIC or width != self.width:
            raise ValueError("not a shard of token ids of this width")
        if key != self.hash:
            raise ValueError("the shard was written with another dictionary")
        at = HEAD.size
        keys = np.frombuffer(data, "<i8", n, at)
        tokens = np.frombuffer(data, "<u4", n, at + 8 * n)
        offsets = np.frombuffer(data, "<u8", n + 1, at + 12 * n)
        return keys, tokens, offsets, at + 12 * n + 8 * (n + 1)

    def document(self, data: bytes, i: int) -> np.ndarray:
        """The ids of the i-th document of a shard, from its frame alone."""
        _, _, offsets, base = self.index(data)
        return np.frombuffer(self.unpack(data[base + int(offsets[i]) : base + int(offsets[i + 1])]), f"<u{self.width}").astype(np.uint32)


def write(docs: DataFrame, path: str, out: str, *, id_col: str = "doc_id", text_col: str = "text", end: int = 1) -> list[tuple[str, int, int]]:
    """Write ``docs`` as shards under ``out``; returns (file, documents, tokens) in order of the ids."""
    spark, width = docs.sparkSession, id_width(path)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(n, 1)))

    def ids(e: Encoder, block: pa.RecordBatch):
        flat, first = e.encode(block.column("text"))
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield np.append(flat[a:b], end).astype(np.uint32)

    def sample(batches):
        for e, block in encoded(path, batches):
            yield pa.RecordBatch.from_pydict({"ids": pa.array([x.astype(f"<u{width}").tobytes() for x in ids(e, block)], pa.binary())})

    found = docs.where(chance).limit(2 * SAMPLE).mapInArrow(sample, "ids binary").collect()
    dictionary = train(sorted(bytes(r[0]) for r in found))
    fs, at = _open(out)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/dictionary") as f:
        f.write(dictionary)

    def save(batches):
        codec, rows = Codec(dictionary, width), []
        for e, block in encoded(path, batches):
            rows += zip(block.column("doc_id").to_pylist(), (x.astype(f"<u{width}") for x in ids(e, block)), strict=True)
        if not rows:
            return
        part = TaskContext.get().partitionId()
        fs, at = _open(out)
        name = f"part-{part:06d}.ids"
        temporary = f"{at}/.{name}-{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary) as f:
            f.write(codec.write(rows))
        if fs.get_file_info(f"{at}/{name}").type != pafs.FileType.NotFound:
            fs.delete_file(f"{at}/{name}")
        fs.move(temporary, f"{at}/{name}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "docs": pa.array([len(rows)], pa.int64()), "tokens": pa.array([sum(len(x) for _, x in rows)], pa.int64())})

    parts = max(1, -(-int(size or 0) // SHARD_BYTES))
    spread = F.xxhash64("text")
    ordered = docs.repartitionByRange(parts, "doc_id", spread).sortWithinPartitions("doc_id", spread, "text")
    return [(r["name"], r["docs"], r["tokens"]) for r in sorted(ordered.mapInArrow(save, "part int, name string, docs long, tokens long").collect())]


def read(spark: SparkSession, out: str, manifest: list[tuple[str, int, int]]) -> DataFrame:
    """The documents of the shards: doc_id, start (ids of all before it), n_tokens, ids_crc32, ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    if not manifest:
        return spark.createDataFrame([], schema)
    base, total = {}, 0
    for name, _, tokens in manifest:
        base[name], total = total, total + tokens

    def run(batches):
        fs, at = _open(out)
        with fs.open_input_stream(f"{at}/dictionary") as f:
            dictionary = f.read()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_buffer().to_pybytes()
                codec = Codec.of(dictionary, data)
                keys, tokens, offsets, begin = codec.index(data)
                before = np.cumsum(tokens.astype(np.int64)) - tokens + base[path.rsplit("/", 1)[-1]]
                step = 4096
                for i in range(0, len(keys), step):
                    ids = [np.frombuffer(codec.unpack(data[begin + int(a) : begin + int(b)]), f"<u{codec.width}").astype("<u4").tobytes() for a, b in zip(offsets[i : i + step], offsets[i + 1 : i + step + 1], strict=False)]
                    if [len(x) // 4 for x in ids] != tokens[i : i + step].tolist():
                        raise ValueError(f"{path}: token counts differ from the index")
                    key = pa.array(keys[i : i + step], mask=keys[i : i + step] == NULL_ID)
                    yield pa.RecordBatch.from_arrays([key, pa.array(before[i : i + step]), pa.array(tokens[i : i + step].astype(np.int64)), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").load(out).select("path", "content")
    return files.mapInArrow(run, schema)


def op10_token_output(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` written as token ids and read back from the files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    return read(spark, out, write(docs, tokenizer_path("word_bpe_49k.json"), out)).drop("ids")
