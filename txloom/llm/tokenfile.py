"""Token-id files: independent zstandard frames with a trailing seek table and per-frame checksums, as a Spark data source.

A file holds the ids of consecutive documents, little-endian unsigned, `width` bytes each, `FRAME_IDS` to a frame, so the
frame of an id follows from its place. After the data frames come a skippable frame with the index of documents (an Arrow
stream of doc_id and n_ids, compressed) and a skippable frame with the seek table of zstandard's seekable format: sizes and
checksum of each frame, the index among them as one without content. Plain zstandard tools decompress a file to its ids.

`spark.read.format("token_frames").load(path)` gives a row a document (doc_id, file, start, n_tokens, ids), `start` being the
ids of all documents before it. `lookup` reads wanted documents only: the index tells their frames, and no other frame is
decompressed. A write is committed by its manifest: files of tasks that failed, were lost or ran twice are in none. Tasks
stream: a frame and the index of one file (at most `FILE_IDS` ids or `FILE_DOCS` documents) are held at a time.

`write_tokens` deals documents by ranges of (doc_id, hash of the text), sorts and encodes each range, and so writes files
in ascending order of doc_id.

Edge cases: a null text is an empty one and has only its end id; null ids come first; equal ids stay in the order of
their texts' hashes; repeated rows are written one by one; an empty table gives a manifest without files, and no rows; further
input columns are dropped. Paths are those of pyarrow's file systems (a plain path, file:, hdfs:, s3:, gs:).
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from txloom.llm import wordcodes
from txloom.llm.bpe import read_spec
from txloom.llm.common import parts_for, shared_dir, table

FRAME_IDS = 1 << 16
FILE_IDS = 1 << 26
FILE_DOCS = 1 << 20
#: Ids and documents in one batch that a reader gives out.
BATCH_IDS, BATCH_DOCS = 1 << 20, 2_000
#: Fixed values of the zstandard seekable format.
SKIPPABLE, SEEK_TABLE, SEEKABLE, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
LEVEL = 1
INDEX = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64())])


class Damaged(ValueError):
    """A file is cut off, or a frame is not what its checksum says."""


def digest(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs, inner.rstrip("/")


class FrameWriter:
    """Writes one file, frame by frame."""

    def __init__(self, out, width: int):
        self.out, self.width, self.press = out, width, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.held: list[memoryview] = []
        self.size, self.ids, self.docs, self.table, self.index = 0, 0, 0, [], []

    def _frame(self, data: bytes) -> None:
        made = self.press.compress(data)
        self.out.write(made)
        self.table.append((len(made), len(data), digest(data)))

    def add(self, doc_ids: pa.Array, sizes: np.ndarray, data: memoryview) -> None:
        """Documents: their ids, how many token ids each has, and all token ids."""
        self.index.append(pa.record_batch([doc_ids, pa.array(sizes, pa.int64())], schema=INDEX))
        self.docs, self.ids = self.docs + len(sizes), self.ids + int(sizes.sum())
        whole = FRAME_IDS * self.width
        while len(data):
            part = data[: whole - self.size]
            self.held.append(part)
            self.size, data = self.size + len(part), data[len(part) :]
            if self.size == whole:
                self._frame(b"".join(self.held))
                self.held, self.size = [], 0
        if self.held:
            self.held = [memoryview(b"".join(self.held))]  # of its own, so the batch can go

    def close(self) -> dict:
        if self.size:
            self._frame(b"".join(self.held))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, INDEX.with_metadata({"width": str(self.width), "frame_ids": str(FRAME_IDS)})) as stream:
            for b in self.index:
                stream.write_batch(b)
        body = self.press.compress(sink.getvalue().to_pybytes())
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.table.append((8 + len(body), 0, digest(b"")))
        seek = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(seek)) + seek)
        self.out.close()
        return {"docs": self.docs, "ids": self.ids}


class FrameReader:
    """Reads one file; decompresses only the frames that are asked for."""

    def __init__(self, source):
        self.source, size = source, source.size()
        if size < 17:
            raise Damaged("the file is too short")
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != CHECKSUMS or not n or 17 + 12 * n > size:
            raise Damaged("the file does not end in a seek table")
        seek = self._at(size - 17 - 12 * n, 8 + 12 * n)
        if struct.unpack("<II", seek[:8]) != (SEEK_TABLE, 12 * n + 9):
            raise Damaged("the seek table is cut off")
        self.table = np.frombuffer(seek[8:], "<u4").reshape(n, 3)
        self.begins = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        if self.begins[-1] != size - 17 - 12 * n:
            raise Damaged("the seek table does not fit the file")
        self.unpress = zstandard.ZstdDecompressor()
        body = self._at(int(self.begins[-2]), int(self.table[-1, 0]))
        if struct.unpack("<II", body[:8]) != (SKIPPABLE, len(body) - 8):
            raise Damaged("the index of documents is missing")
        with pa.ipc.open_stream(self.unpress.decompress(body[8:], max_output_size=1 << 31)) as stream:
            self.index = stream.read_all().combine_chunks()
            self.width, self.frame_ids = (int(stream.schema.metadata[k]) for k in (b"width", b"frame_ids"))
        self.sizes = self.index["n_ids"].to_numpy()
        self.ends = np.cumsum(self.sizes)
        self.frames_read = 0

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        data = self.source.read(n)
        if len(data) != n:
            raise Damaged("the file is cut off")
        return data

    def frame(self, k: int) -> bytes:
        made, size, want = (int(x) for x in self.table[k])
        try:
            data = self.unpress.decompress(self._at(int(self.begins[k]), made), max_output_size=size)
        except zstandard.ZstdError as e:
            raise Damaged(f"frame {k}: {e}") from e
        if len(data) != size or digest(data) != want:
            raise Damaged(f"frame {k} is not what its checksum says")
        self.frames_read += 1
        return data

    def span(self, begin: int, end: int) -> bytes:
        """The bytes of ids begin..end of the file."""
        if begin >= end:
            return b""
        first = begin // self.frame_ids
        data = b"".join([self.frame(k) for k in range(first, (end - 1) // self.frame_ids + 1)])
        return data[(begin - first * self.frame_ids) * self.width : (end - first * self.frame_ids) * self.width]


@dataclass
class Written(WriterCommitMessage):
    files: list


class Writer(DataSourceArrowWriter):
    """Columns doc_id (long) and ids (binary, little-endian unsigned, of the option width's bytes)."""

    def __init__(self, path: str, width: int, overwrite: bool):
        self.path, self.width, self.overwrite = path, width, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = opened(self.path)
        fs.create_dir(path, recursive=True)
        task, files, out, name = TaskContext.get().partitionId(), [], None, ""
        try:
            for batch in iterator:
                held = batch.column(batch.schema.get_field_index("ids")).cast(pa.large_binary())
                keys = batch.column(batch.schema.get_field_index("doc_id"))
                at = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
                if not len(held):
                    continue
                if held.null_count or ((at - at[0]) % self.width).any():
                    raise ValueError("ids are null or no whole number of token ids")
                if out is None:
                    name = f"part-{task:06d}-{len(files):04d}-{uuid.uuid4().hex}.tok"
                    out = FrameWriter(fs.open_output_stream(f"{path}/{name}", compression=None), self.width)
                data = memoryview(held.buffers()[2])[at[0] : at[-1]] if held.buffers()[2] is not None else memoryview(b"")
                out.add(keys, np.diff(at) // self.width, data)
                if out.ids >= FILE_IDS or out.docs >= FILE_DOCS:
                    files.append({"file": name, "task": task} | out.close())
                    out = None
            if out is not None:
                files.append({"file": name, "task": task} | out.close())
        except BaseException:
            self._drop([*[f["file"] for f in files], *([name] if out is not None else [])])
            raise
        return Written(files)

    def _drop(self, names: list[str]) -> None:
        fs, path = opened(self.path)
        for n in names:
            if fs.get_file_info(f"{path}/{n}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{path}/{n}")

    def commit(self, messages: list) -> None:
        fs, path = opened(self.path)
        old = manifests(self.path)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["file"])
        fs.create_dir(f"{path}/_manifest", recursive=True)
        with fs.open_output_stream(f"{path}/_manifest/{len(old):06d}.json") as out:
            out.write(json.dumps({"width": self.width, "replaces": self.overwrite, "files": files}).encode())
        if self.overwrite:
            self._drop([f["file"] for _, m in old for f in m["files"]])

    def abort(self, messages: list) -> None:
        self._drop([f["file"] for m in messages if m for f in m.files])


def manifests(path: str) -> list[tuple[str, dict]]:
    """(name, content) of the commits, in order, from the last that replaced all before it on."""
    fs, inner = opened(path)
    found = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(f"{inner}/_manifest", allow_not_found=True)) if i.path.endswith(".json"))
    out: list[tuple[str, dict]] = []
    for p in found:
        with fs.open_input_stream(p) as f:
            out.append((p, json.loads(f.read())))
    return out


def files_of(path: str) -> list[dict]:
    """file, docs, ids, base (the ids of all files before it) of each committed file, in order."""
    out: list[dict] = []
    found = manifests(path)
    if not found:
        raise FileNotFoundError(f"{path} has no committed token files")
    for _, m in found:
        out = m["files"] if m["replaces"] else [*out, *m["files"]]
    base = 0
    for f in out:
        f["base"] = base
        base += f["ids"]
    return out


class Part(InputPartition):
    def __init__(self, file: str, base: int):
        self.file, self.base = file, base


class Reader(DataSourceReader):
    def __init__(self, path: str, form: str):
        self.path, self.form = path, form

    def partitions(self) -> list[Part]:
        return [Part(f["file"], f["base"]) for f in files_of(self.path)]

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(part, Part):
            return
        fs, path = opened(self.path)
        with fs.open_input_file(f"{path}/{part.file}") as source:
            r = FrameReader(source)
            begins, i, n = r.ends - r.sizes, 0, len(r.sizes)
            while i < n:
                j = max(i + 1, min(i + BATCH_DOCS, int(np.searchsorted(r.ends, begins[i] + BATCH_IDS, "right"))))
                sizes = r.sizes[i:j]
                cols = [r.index["doc_id"].slice(i, j - i).combine_chunks(), pa.array([part.file] * (j - i)), pa.array(part.base + begins[i:j]), pa.array(sizes)]
                if self.form != "none":
                    ids = np.frombuffer(r.span(int(begins[i]), int(r.ends[j - 1])), f"<u{r.width}")
                    cols.append(as_column(ids, sizes, self.form))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "file", "start", "n_tokens", *(["ids"] if self.form != "none" else [])])
                i = j


def as_column(ids: np.ndarray, sizes: np.ndarray, form: str) -> pa.Array:
    """ids of documents as arrays of int, or as little-endian unsigned 32-bit bytes."""
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    if form == "array":
        return pa.ListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int32)))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at * 4), pa.py_buffer(ids.astype("<u4"))])


class TokenFrames(DataSource):
    """Options: path; width (2 or 4 bytes an id, for writing); ids (array, bytes or none: the form when read)."""

    @classmethod
    def name(cls) -> str:
        return "token_frames"

    def schema(self) -> str:
        kinds = {"array": ", ids array<int>", "bytes": ", ids binary", "none": ""}
        return f"doc_id long, file string, start long, n_tokens long{kinds[self.options.get('ids', 'array')]}"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options.get("ids", "array"))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if [f"{f.name} {f.dataType.simpleString()}" for f in schema] != ["doc_id bigint", "ids binary"]:
            raise ValueError("token_frames takes the columns doc_id (long) and ids (binary)")
        return Writer(self.options["path"], int(self.options.get("width", 4)), overwrite)


def read(spark: SparkSession, path: str, ids: str = "array") -> DataFrame:
    """doc_id, file, start, n_tokens, ids of all documents of a folder of token files."""
    spark.dataSource.register(TokenFrames)
    return spark.read.format("token_frames").option("ids", ids).load(path)


def lookup(spark: SparkSession, path: str, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens, ids (array) of the documents whose ids are in wanted; repeated wishes count once. Only the
    frames that hold a wanted document are decompressed, in a task for each run of files."""
    places = read(spark, path, "none").join(wanted.select(F.col(key).cast("long").alias("doc_id")).distinct(), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = opened(path)
        name, r, source, base = None, None, None, 0
        bases = {f["file"]: f["base"] for f in files_of(path)} if (first := next(batches, None)) is not None else {}
        for batch in [] if first is None else [first, *batches]:
            for doc, file, start, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source, base = file, fs.open_input_file(f"{inner}/{file}"), bases[file]
                    r = FrameReader(source)
                ids = np.frombuffer(r.span(start - base, start - base + n), f"<u{r.width}")
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([start], pa.int64()), pa.array([n], pa.int64()), as_column(ids, np.array([n]), "array")], ["doc_id", "start", "n_tokens", "ids"])
        if source is not None:
            source.close()

    rows = places.select("doc_id", "file", "start", "n_tokens").repartition("file").sortWithinPartitions("file", "start")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, spec: str, path: str, end: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Encode the texts by the tokenizer file spec (lower-cased words with an end-of-word suffix), append the end id to each
    document, and write token files in ascending order of key to path, in place of what is there."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenFrames)
    wordcodes.check(spec)
    shared = spark.sparkContext.broadcast(spec)  # a few MB, the same file for all tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = wordcodes.loaded(shared.value)
        for batch in batches:
            ids, at = coder.encode(batch.column(1))
            held = np.insert(ids, at[1:], np.array(end, coder.kind)) if batch.num_rows else ids
            size = coder.codes.itemsize
            at = pa.py_buffer(((at + np.arange(len(at))) * size).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, at, pa.py_buffer(held)])], ["doc_id", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(parts_for(rows), *order).sortWithinPartitions(*order)
    width = 2 if wordcodes.loaded(spec).kind == "<u2" and end < 1 << 16 else 4
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before) if int(before) > 0 else BATCH_DOCS, BATCH_DOCS))  # a few MB of text at a time
    try:
        rows.mapInArrow(run, "doc_id long, ids binary").write.format("token_frames").option("width", width).mode("overwrite").save(path)
    finally:
        spark.conf.set(name, before)


def op11_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back: place, length and checksum of each one's ids."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), read_spec(public_tokenizers.path("word_bpe_49k.json")), path)
    return read(spark, path, "bytes").select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
