"""Token-id files: each document one zstandard frame, with a dictionary trained on serialized id arrays.

A segment file holds, little-endian: the magic TIDS and the version (u32); the SHA-256 of the dictionary; the
frames; the index, as arrays of doc_id (i64), has_id (u8), offset of the frame (u64; one more, the end of the last)
and ids (u32); the footer: offset of the index and documents (u64, u64), magic. Ids are u16 if the vocabulary fits,
else u32. A document is read by the footer, the index and one frame. Segments follow each other in doc_id order.
The manifest, a table, lists the segments of successful task attempts; files of lost attempts aren't in it.

Defined results: a null text is empty and has the end id alone; documents without id come first; rows that share
an id lie side by side, ordered by the checksum of their frames; an empty table gives no segment and an empty manifest.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import dropped, saved, scratch, table
from tidemark.llm.encode import encoder, strings

MAGIC, VERSION, LEVEL = b"TIDS", 1, 3
#: The dictionary: its size, and the documents and characters in each that it is trained on at most.
DICT_BYTES, SAMPLE_DOCS, SAMPLE_CHARS = 65_536, 1_000, 20_000
#: Documents in a segment at most, and bytes of its frames from which it is closed.
SEGMENT_DOCS, SEGMENT_BYTES = 1 << 20, 1 << 30


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def file_system(folder: str):
    """(file system, path) of a URI; Hadoop's names of object stores are brought to those that Arrow knows."""
    from pyarrow import fs

    scheme, mark, rest = folder.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "wasbs": "abfs"}.get(scheme, scheme) + mark + rest)


def trained(docs: DataFrame, path: str, end: int, doc_id: str, text: str) -> bytes:
    """A dictionary from SAMPLE_DOCS documents in the order of their ids' hashes, none over SAMPLE_CHARS."""
    import zstandard

    share = min(1.0, 1.5 * SAMPLE_DOCS / max(1, docs.count()))  # only about as many rows as are needed leave their tasks
    sampled = docs.select(F.xxhash64(doc_id).alias("h"), F.col(text).alias("t")).where(F.col("h") <= F.lit(min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64)))))
    rows = sampled.where(F.length("t") <= SAMPLE_CHARS).orderBy("h", "t").limit(SAMPLE_DOCS).collect()
    if not rows:
        return b""
    ids, count = encoder(path, False, end).encode(pa.array([r.t for r in rows], pa.large_string()))
    samples = [x.tobytes() for x in np.split(ids.astype("<u2" if ids.max() < 65_536 else "<u4"), np.cumsum(count)[:-1])]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: their own bytes serve
        return b"".join(samples)[:DICT_BYTES]


def compression(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def frames(docs: DataFrame, dictionary: bytes, path: str, end: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, frame), tokenized and compressed where the text is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc = encoder(path, False, end)
        wide = enc.tokenizer.get_vocab_size(with_added_tokens=True) > 65_536
        zip_ = zstandard.ZstdCompressor(level=LEVEL, dict_data=compression(dictionary), write_content_size=True)
        for batch in batches:
            ids_of = batch.column(0)
            for at, ids, count in enc.chunks(strings(batch.column(1))):
                narrow, upto = ids.astype("<u4" if wide else "<u2"), np.cumsum(count)
                made = [zip_.compress(narrow[b - n : b].tobytes()) for b, n in zip(upto.tolist(), count.tolist(), strict=True)]
                crc = [zlib.crc32(m) for m in made]
                yield pa.RecordBatch.from_arrays([ids_of.slice(at, len(count)), pa.array(count, pa.int64()), pa.array(crc, pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "n_tokens", "crc", "frame"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, crc long, frame binary")


class NewSegment:
    """A file being written: frames go out at once, ids, ends and counts are held until it is closed, for ``most``
    documents. The file is made with its first document."""

    def __init__(self, folder: str, number: int, digest: bytes, most: int):
        self.folder, self.number, self.digest, self.most = folder, number, digest, most
        self.out, self.docs, self.ids, self.ends, self.count = None, 0, [], [len(MAGIC) + 4 + 32], []

    def full(self) -> bool:
        return self.docs >= self.most or self.ends[-1] >= SEGMENT_BYTES

    def add(self, batch: pa.RecordBatch) -> int:
        """Rows (doc_id, n_tokens, crc, frame) from the start of a batch, until the segment is full; returns how many."""
        if self.out is None:
            self.name = f"segment-{self.number >> 32:06d}-{self.number & 0xFFFFFFFF:06d}-{uuid.uuid4().hex}.tids"
            system, top = file_system(self.folder)
            system.create_dir(top, recursive=True)
            self.out = system.open_output_stream(f"{top}/{self.name}")
            self.out.write(MAGIC + struct.pack("<I", VERSION) + self.digest)
        n = 0
        for frame in batch.column(3).to_pylist():
            self.out.write(frame)
            self.ends.append(self.ends[-1] + len(frame))
            self.docs, n = self.docs + 1, n + 1
            if self.full():
                break
        self.ids.append(batch.column(0).slice(0, n))
        self.count.append(batch.column(1).slice(0, n).to_numpy(zero_copy_only=False))
        return n

    def closed(self) -> pa.RecordBatch:
        keys, count = pa.concat_arrays(self.ids), np.concatenate(self.count)
        self.out.write(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + keys.is_valid().to_numpy(zero_copy_only=False).astype("u1").tobytes() + np.array(self.ends, "<u8").tobytes() + count.astype("<u4").tobytes())
        self.out.write(struct.pack("<QQ", self.ends[-1], len(keys)) + MAGIC)
        self.out.close()
        return pa.RecordBatch.from_arrays([pa.array([self.number], pa.int64()), pa.array([self.name]), pa.array([len(keys)], pa.int64()), pa.array([int(count.sum())], pa.int64())], names=["segment", "file", "n_docs", "n_tokens"])


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = 2, doc_id: str = "doc_id", text: str = "text", most: int = SEGMENT_DOCS) -> DataFrame:
    """Writes the files to ``folder``, a URI that driver and executors share; returns the manifest (segment, file,
    n_docs, n_tokens, start), start: ids in the segments before."""
    path = path or vocabulary()
    dictionary = trained(docs, path, end, doc_id, text)
    digest = hashlib.sha256(dictionary).digest()
    encoded = saved(frames(docs, dictionary, path, end, doc_id, text), "frames")
    # the range bounds are sampled from the saved table, so texts are tokenized once
    ordered = encoded.repartitionByRange("doc_id", "crc").sortWithinPartitions("doc_id", "crc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        segment = None
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                if segment is None:
                    segment = NewSegment(folder, part << 32, digest, most)
                at += segment.add(batch.slice(at))
                if segment.full():
                    yield segment.closed()
                    segment = NewSegment(folder, segment.number + 1, digest, most)
        if segment is not None and segment.docs:
            yield segment.closed()

    made = saved(ordered.mapInArrow(run, "segment long, file string, n_docs long, n_tokens long"), "segments")
    dropped(encoded)
    saved_dictionary(folder, dictionary)
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)  # a row for each segment
    return made.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def saved_dictionary(folder: str, dictionary: bytes) -> None:
    system, top = file_system(folder)
    system.create_dir(top, recursive=True)
    with system.open_output_stream(f"{top}/dictionary-{hashlib.sha256(dictionary).hexdigest()}") as f:
        f.write(dictionary)


class Segment:
    """One file, read by parts: ``len()``, ``keys``, ``count`` and ``ids(i)``."""

    def __init__(self, system, top: str, name: str):
        import zstandard

        self.file = system.open_input_file(f"{top}/{name}")
        size = self.file.size()
        at, n, magic = struct.unpack("<QQ4s", self.file.read_at(20, size - 20))
        head = self.file.read_at(len(MAGIC) + 36, 0)
        if magic != MAGIC or head[:4] != MAGIC or struct.unpack("<I", head[4:8])[0] != VERSION:
            raise ValueError(f"not a segment: {name}")
        with system.open_input_stream(f"{top}/dictionary-{head[8:40].hex()}") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != head[8:40]:
            raise ValueError("the dictionary is not the one that the segment was written with")
        index = self.file.read_at(size - 20 - at, at)
        self.keys = pa.array(np.frombuffer(index, "<i8", n), mask=np.frombuffer(index, "u1", n, 8 * n) == 0)
        self.ends = np.frombuffer(index, "<u8", n + 1, 9 * n).astype(np.int64)
        self.count = np.frombuffer(index, "<u4", n, 17 * n + 8).astype(np.int64)
        self.unzip = zstandard.ZstdDecompressor(dict_data=compression(dictionary))

    def __len__(self) -> int:
        return len(self.count)

    def decoded(self, frame: bytes, n: int) -> np.ndarray:
        raw = self.unzip.decompress(frame)
        return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")

    def ids(self, i: int) -> np.ndarray:
        return self.decoded(self.file.read_at(int(self.ends[i + 1] - self.ends[i]), int(self.ends[i])), int(self.count[i]))

    def each(self, block: int = 4 << 20) -> Iterator[np.ndarray]:
        """All documents in order, some MB of the file at a time."""
        at = 0
        while at < len(self):
            upto = max(at + 1, int(np.searchsorted(self.ends, self.ends[at] + block, "right")) - 1)
            raw = self.file.read_at(int(self.ends[upto] - self.ends[at]), int(self.ends[at]))
            for i in range(at, upto):
                yield self.decoded(raw[self.ends[i] - self.ends[at] : self.ends[i + 1] - self.ends[at]], int(self.count[i]))
            at = upto


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                segment = Segment(system, top, name)
                crc = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for ids in segment.each()), np.int64, len(segment))
                yield pa.RecordBatch.from_arrays([segment.keys, pa.array(start + np.cumsum(segment.count) - segment.count), pa.array(segment.count), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("file", "start").repartition(max(1, manifest.count()))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    manifest = saved(write(table(spark, sf_dir, "documents"), folder), "manifest")
    return read(manifest, folder)
