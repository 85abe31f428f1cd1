"""Token-id files: one independent zstandard frame for each document, a trailing seek table, a checksum for each frame.

A file is valid zstandard. Layout: the frames; a skippable frame with the document index (element size, then for each
document id and number of ids); the seek table of the public seekable format as the last skippable frame (compressed size, size and
low 32 bits of XXH64 for each frame, then the number of frames, a descriptor byte and the magic number). A reader
takes the tail, then only the bytes of the frames it wants; every frame is checked after decompression.

Plan. Frames are made where the texts are read, so the one shuffle moves compressed ids, not texts. Ranges of
document ids come from quantiles of the id column alone; each range is sorted within its task and becomes one file,
written under a temporary name and then renamed, so a repeated task only replaces the same bytes.

Defined cases: null text is empty and gives just the end id; rows that share a doc_id are all written, next to each
other; null doc_ids come first; extra columns are not written; an empty table gives no file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import PieceEncoder, default_vocabulary
from .common import documents, fresh_path, map_rows, releasing, small_batches

#: Fixed values of the zstandard formats.
SEEK_MAGIC, SKIPPABLE, SKIPPABLE_INDEX = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
NULL_ID = -(2**63)
#: More than the default: a call of the library costs more than a look-up.
KEPT_PIECES = 800_000


@lru_cache(maxsize=1)
def library_encoder(path: str) -> PieceEncoder:
    """The tokenizers library encodes; the table of pieces only spares repeated calls for equal pieces."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    added = {a.content: i for i, a in tok.get_added_tokens_decoder().items()}
    # In a byte-level vocabulary each character of a token stands for one byte.
    length = np.zeros(tok.get_vocab_size(), dtype=np.int64)
    for t, i in tok.get_vocab().items():
        length[i] = len(t)
    batch = getattr(tok, "encode_batch_fast", tok.encode_batch)

    def fill(pieces: list[str]) -> list[bytes]:
        # New pieces are encoded as one text, which is cut where the pieces end.
        ids = np.array(batch(["".join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.cumsum([len(p.encode()) for p in pieces])
        cuts = np.searchsorted(np.cumsum(length[ids]), ends).tolist()
        data = ids.tobytes()
        return [data[4 * i : 4 * j + 4] for i, j in zip([0, *[c + 1 for c in cuts[:-1]]], cuts)]

    return PieceEncoder(fill, added, lambda t: tok.encode(t, add_special_tokens=False).ids, KEPT_PIECES)


def frame(ids: np.ndarray, dtype: str, packer: zstandard.ZstdCompressor) -> tuple[bytes, int, int]:
    raw = ids.astype(dtype).tobytes()
    return packer.compress(raw), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


def tail(index: list[tuple[int, int]], frames: list[tuple[int, int, int]], dtype: str) -> bytes:
    body = struct.pack("<4sI", dtype.encode().ljust(4, b"\0"), len(index)) + np.array(index, dtype="<i8").reshape(-1, 2).tobytes()
    seek = np.array(frames, dtype="<u4").reshape(-1, 3).tobytes() + struct.pack("<IBI", len(frames), 0x80, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body + struct.pack("<II", SKIPPABLE, len(seek)) + seek


class TokenFile:
    """Random access to one file: ids, sizes, and the ids of single documents."""

    def __init__(self, uri: str):
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        self.frames = np.frombuffer(self.at(size - 9 - 12 * n, 12 * n), dtype="<u4").reshape(-1, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        head = int(self.offsets[-1])
        kind, count = struct.unpack("<4sI", self.at(head + 8, 8))
        self.dtype = kind.rstrip(b"\0").decode()
        self.index = np.frombuffer(self.at(head + 16, 16 * count), dtype="<i8").reshape(-1, 2)
        self.unpacker = zstandard.ZstdDecompressor()

    def at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def unpack(self, k: int, packed: bytes) -> np.ndarray:
        raw = self.unpacker.decompress(packed, max_output_size=int(self.frames[k, 1]))
        if len(raw) != self.frames[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k}: checksum")
        return np.frombuffer(raw, dtype=self.dtype)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document; only its frame is read."""
        return self.unpack(k, self.at(int(self.offsets[k]), int(self.frames[k, 0])))

    def all(self, block: int = 4 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) in order; frames are read in blocks."""
        k, n = 0, len(self.frames)
        while k < n:
            end = max(k + 1, int(np.searchsorted(self.offsets, self.offsets[k] + block, side="right")) - 1)
            data = self.at(int(self.offsets[k]), int(self.offsets[end] - self.offsets[k]))
            for j in range(k, end):
                a = int(self.offsets[j] - self.offsets[k])
                yield int(self.index[j, 0]), self.unpack(j, data[a : a + int(self.frames[j, 0])])
            k = end


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 2, dtype: str = "<u2", files: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write `folder`/part-NNNNN.ids in ascending order of document ids; returns the manifest (file_no, path, n_docs, n_tokens)."""
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.percentile_approx(id_col, F.array(*[F.lit(i / files) for i in range(1, files)]), 10_000)).first()[0] if files > 1 else []
    cuts = sorted(set(cuts or []))

    def setup(path=vocabulary):
        return library_encoder(path or default_vocabulary()), zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)

    def rows(state, batch):
        enc, packer = state
        out = []
        for (i, _), ids in zip(batch, enc.encode_batch([t or "" for _, t in batch])):
            if dtype == "<u2" and len(ids) and ids.max() > 65535:
                raise ValueError("ids over 65535 need dtype '<u4'")
            out.append((i, len(ids) + 1, *frame(np.append(ids, np.uint32(end_id)), dtype, packer)))
        return out

    made = map_rows(docs.select(F.col(id_col).cast("long"), text_col), rows, "doc_id long, n_tokens long, frame binary, size long, sum long", setup)
    array = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    made = made.withColumn("file_no", F.coalesce(F.size(F.filter(array, lambda c: c < F.col("doc_id"))), F.lit(0)))
    ranged = made.repartitionById(len(cuts) + 1, F.col("file_no")).sortWithinPartitions(F.col("file_no"), F.col("doc_id").asc_nulls_first())
    kind = pa.schema([("file_no", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        now, out, index, frames, tmp = None, None, [], [], ""

        def close():
            out.write(tail(index, frames, dtype))
            out.close()
            fs.move(tmp, f"{base}/part-{now:05d}.ids")
            return pa.RecordBatch.from_pylist([{"file_no": now, "path": f"{folder}/part-{now:05d}.ids", "n_docs": len(index), "n_tokens": sum(n for _, n in index)}], schema=kind)

        for b in batches:
            for i, n, packed, size, total, no in zip(*(c.to_pylist() for c in b.columns)):
                if no != now:
                    if out:
                        yield close()
                    now, index, frames = no, [], []
                    tmp = f"{base}/.{no:05d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(tmp)
                out.write(packed)
                index.append((NULL_ID if i is None else i, n))
                frames.append((len(packed), size, total))
        if out:
            yield close()

    return ranged.mapInArrow(releasing(write), "file_no int, path string, n_docs long, n_tokens long")


def read_digests(manifest: DataFrame) -> DataFrame:
    """Read every frame of the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    n = max(1, manifest.count())
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.select("path", "base", "file_no").repartitionById(n, F.col("file_no"))
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, _ in zip(*(c.to_pylist() for c in b.columns)):
                rows = []
                for i, ids in TokenFile(path).all():
                    rows.append((None if i == NULL_ID else i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), kind)], schema=kind)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    return placed.mapInArrow(releasing(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import materialise

    small_batches(spark)
    manifest = materialise(write_token_files(documents(spark, sf_dir), fresh_path(spark, "token-files")), "token-manifest")
    return read_digests(manifest)
