r"""Token ids in binary files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file holds zstandard frames, each with the ids (little-endian unsigned 32-bit) of some whole documents in ascending
doc_id order; then a skippable frame with the document index; then a skippable frame with the seek table: for each
frame its compressed size, its size and the CRC-32 of its content. A reader takes the footer, the tables, and only the
frames that hold the documents it was asked for; every frame's checksum is verified.

Files are written to the shared folder by tasks over ranges of doc_id; each attempt writes a file of its own name, and
the manifest, made of what succeeded, says which files count, so lost executors and repeated attempts do no harm.

Defined results: a null or empty text is its end id alone; rows that repeat a doc_id follow each other, by text; null
doc_ids come first; an empty table gives no documents; further columns aren't read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnum
from .common import cut, fresh_path, text_batches

END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Ids after which a frame is closed; a longer document has a frame of its own.
FRAME_IDS = 1 << 16
LEVEL = 1
#: Distinct words whose ids a worker remembers; the memory is emptied when it is full.
CACHE = 1_000_000

SKIPPABLE = 0x184D2A5E
MAGIC = b"DWTOKEN1"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


# A pre-token of the byte-level vocabulary never goes on from a non-blank to a blank, so a text's ids are those of its
# chunks in a row, a chunk being the blanks before a word and the word. Texts whose words are parted by single ASCII
# blanks are encoded by distinct chunk, told apart by its bytes; any other text is encoded whole.
_WIDE_BLANK = re.compile("[\x85\xa0  -     　]")
_SIMPLE = re.compile(r"( ?[^\W\d_]+)([!-/:-@\[-`{-~]*)").fullmatch
_CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")
#: Longer texts are cut between words before they are encoded, so that memory doesn't follow the longest text.
LONG = 1 << 21


class Encoder:
    """The vocabulary's ids of texts, through the tokenizers library; ids of words that come again are remembered."""

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_words = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        self.end = struct.pack("<I", end_id)
        self.known: dict[bytes, bytes] = {}
        if self.by_words:
            self.model = self.tokenizer.model
            self.model._resize_cache(0)
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            hidden = [b for b in range(256) if b not in shown]
            #: The byte-level alphabet: a visible character for each byte.
            self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _learn(self, keys: list[bytes]) -> None:
        """Letters with a space before them are one pre-token, as are the ASCII signs after them: these go to the model directly."""
        model, alphabet, known, others = self.model.tokenize, self.alphabet, self.known, []
        for key in keys:
            chunk = key.decode("utf-8", "replace")
            parts = _SIMPLE(chunk)
            if parts is None or not parts[1].strip(" ").isalpha():
                others.append((key, chunk))
                continue
            ids = [t.id for t in model(parts[1].encode().decode("latin-1").translate(alphabet))]
            if parts[2]:
                ids += [t.id for t in model(parts[2])]
            known[key] = struct.pack(f"<{len(ids)}I", *ids)
        if others:
            known.update(zip([k for k, _ in others], self._ids([c for _, c in others]), strict=True))

    @staticmethod
    def _distinct(data: bytes, begins: np.ndarray, ends: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """(of each chunk the place of its bytes in the list, the list): told apart by their bytes, not by a hash. last: each text's last chunk."""
        if not len(begins):
            return begins, []
        # Chunks follow each other but for what lies between two texts, which is a tile of its own.
        at = np.arange(len(begins)) + np.searchsorted(last, np.arange(len(begins)))
        offsets = np.empty(len(begins) + len(last), np.int32)
        offsets[at], offsets[at[last] + 1] = begins, ends[last]
        tiles = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        found = tiles.dictionary_encode()
        return found.indices.to_numpy()[at].astype(np.int64), found.dictionary.to_pylist()

    def _by_chunks(self, group: list[bytes]) -> list[bytes | None]:
        """Ids of each text; None where words aren't parted by single blanks."""
        lengths = np.fromiter((len(x) + 1 for x in group), np.int64, len(group))
        data = b" ".join(group) + b" "
        starts, ends = textnum.word_bounds(data, textnum.PLAIN)
        stops = np.cumsum(lengths)
        heads = stops - lengths
        bounds = np.concatenate(([0], np.searchsorted(starts, stops)))
        first, last, some = bounds[:-1], bounds[1:] - 1, np.diff(bounds) > 0
        begins = np.maximum(starts - 1, 0)
        begins[first[some]] = np.maximum(begins[first[some]], heads[some])
        gap = np.zeros(len(starts) + 1, np.int64)
        gap[1:-1] = starts[1:] - ends[:-1]
        gap[first[some]] = starts[first[some]] - heads[some]
        odd = np.add.reduceat(np.append(gap > 1, False), np.minimum(bounds[:-1], len(starts))) > 0
        tail = np.where(some, stops - 1 - ends[np.maximum(last, 0)] if len(ends) else 0, lengths - 1)
        odd = (odd & some) | (tail > 1) | (~some & (lengths > 1))
        place, names = self._distinct(data, begins, ends, last[some])
        if len(self.known) > CACHE:
            self.known.clear()
        found = list(map(self.known.get, names))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            # What stands between the chunks of two texts is blank and has no ids of its own.
            self._learn([names[i] for i in new if names[i].strip()])
            for i in new:
                found[i] = self.known.get(names[i], b"")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        offset = np.concatenate(([0], np.cumsum(size)))
        many = size[place]
        out = np.concatenate(([0], np.cumsum(many)))
        ids = flat[np.repeat(offset[place] - out[:-1], many) + np.arange(out[-1])].tobytes()
        cuts = (4 * out[bounds]).tolist()
        result = [None if o else ids[a:b] for a, b, o in zip(cuts[:-1], cuts[1:], odd.tolist(), strict=True)]
        for i in np.flatnonzero((tail == 1) & ~odd):
            result[i] += self._ids([chr(group[i][-1])])[0]
        return result

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids, the end id last, as bytes."""
        result: list[bytes | None] = [None] * len(texts)
        if self.by_words:
            parts, owner = [], []
            for i, text in enumerate(texts):
                if any(s in text for s in self.special) or not (text.isascii() or not _WIDE_BLANK.search(text)):
                    continue
                while len(text) > LONG and (gap := _CUT.search(text, LONG)):
                    parts.append(text[: gap.start()])
                    owner.append(i)
                    text = text[gap.start() :]
                parts.append(text)
                owner.append(i)
            done, at = [], 0
            for group in textnum.batches(parts, LONG):
                done += [self._ids([p])[0] if ids is None else ids for ids, p in zip(self._by_chunks(group), parts[at : at + len(group)], strict=True)]
                at += len(group)
            for i, ids in zip(owner, done, strict=True):
                result[i] = ids if result[i] is None else result[i] + ids
        rest = [i for i, ids in enumerate(result) if ids is None]
        for i, ids in zip(rest, self._ids([texts[i] for i in rest]), strict=True):
            result[i] = ids
        return [ids + self.end for ids in result]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _location(uri: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """Writes documents, given in order, to one file."""

    def __init__(self, uri: str, frame_ids: int = FRAME_IDS) -> None:
        import zstandard

        system, path = _location(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path)
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.frame_ids, self.frames, self.index, self.waiting, self.size = frame_ids, [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit, the end id included."""
        if self.waiting and self.size + len(ids) > 4 * self.frame_ids:
            self._close_frame()
        self.index.append((doc_id or 0, doc_id is None, len(self.frames), self.size // 4, len(ids) // 4))
        self.waiting.append(ids)
        self.size += len(ids)

    def _close_frame(self) -> None:
        data = b"".join(self.waiting)
        packed = self.pack.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), zlib.crc32(data)))
        self.waiting, self.size = [], 0

    def close(self) -> None:
        if self.waiting:
            self._close_frame()
        columns = list(zip(*self.index, strict=True)) or [()] * 5
        kinds = ("<i8", "u1", "<u4", "<u8", "<u8")
        index = self.pack.compress(b"".join(np.array(c, k).tobytes() for c, k in zip(columns, kinds, strict=True)))
        table = np.array(self.frames, "<u8").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        footer = struct.pack("<QQQ", len(self.index), len(index), len(self.frames)) + MAGIC
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.out.close()


class Reader:
    """Reads documents of one file, whole or by doc_id."""

    def __init__(self, uri: str) -> None:
        import zstandard

        system, path = _location(uri)
        self.file = system.open_input_file(path)
        self.unpack = zstandard.ZstdDecompressor()
        size = self.file.size()
        docs, index_size, frames, magic = struct.unpack("<QQQ8s", self.file.read_at(32, size - 32))
        if magic != MAGIC:
            raise ValueError(f"{uri} has no seek table")
        table_at = size - 32 - 24 * frames
        self.frames = np.frombuffer(self.file.read_at(24 * frames, table_at), "<u8").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.frames[:, 0]))).astype(np.int64)
        data = self.unpack.decompress(self.file.read_at(index_size, table_at - 8 - index_size), max_output_size=29 * docs + 1)
        widths = np.cumsum([0, 8, 1, 4, 8, 8]) * docs
        kinds = ("<i8", "u1", "<u4", "<u8", "<u8")
        self.doc_id, null, self.frame, self.offset, self.count = (np.frombuffer(data[a:b], k) for a, b, k in zip(widths[:-1], widths[1:], kinds, strict=True))
        self.null = null.astype(bool)

    def content(self, frame: int) -> bytes:
        packed, size, checksum = (int(x) for x in self.frames[frame])
        data = self.unpack.decompress(self.file.read_at(packed, int(self.starts[frame])), max_output_size=size)
        if len(data) != size or zlib.crc32(data) != checksum:
            raise ValueError(f"frame {frame} is damaged")
        return data

    def _documents(self, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
        held, data = -1, b""
        for row in rows:
            if self.frame[row] != held:
                held = int(self.frame[row])
                data = self.content(held)
            at = 4 * int(self.offset[row])
            yield int(row), data[at : at + 4 * int(self.count[row])]

    def documents(self, doc_ids: Iterable[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(row of the index, ids as bytes), of all documents or of those asked for."""
        rows = np.arange(len(self.doc_id)) if doc_ids is None else np.flatnonzero(np.isin(self.doc_id, list(doc_ids)) & ~self.null)
        return self._documents(rows)

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Write the ids of docs (doc_id, text) to files under path; returns the manifest (file, part, docs, n_tokens, start)."""
    spark = docs.sparkSession
    text_batches(spark)
    path, vocabulary = path or fresh_path(spark, "tokens"), vocabulary or default_vocabulary()
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, out, total, uri = encoder(vocabulary, end_id).encode, None, 0, f"{path}/part-{part:06d}-{uuid.uuid4().hex}.dwt"
        for batch in parts:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            out = out or (Writer(uri) if ids else None)
            for a in range(0, len(ids), 512):
                for doc_id, data in zip(ids[a : a + 512], encode(texts[a : a + 512]), strict=True):
                    out.add(doc_id, data)
                    total += len(data) // 4
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [uri], "part": pa.array([part], pa.int32()), "docs": pa.array([len(out.index)], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = cut(rows.mapInArrow(run, "file string, part int, docs long, n_tokens long"))
    # One row per file: the window runs over the manifest only.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of all documents of the files, or of those asked for."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = Reader(uri)
                starts = start + np.concatenate(([0], np.cumsum(file.count.astype(np.int64))))
                rows, found, size = [], [], 0
                for row, ids in file.documents(doc_ids):
                    rows.append(row)
                    found.append(ids)
                    size += len(ids)
                    if size > 1 << 22:
                        yield _batch(file, starts, rows, found)
                        rows, found, size = [], [], 0
                if rows:
                    yield _batch(file, starts, rows, found)
                file.close()

    spread = manifest.select("file", "start").repartitionByRange(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _batch(file: Reader, starts: np.ndarray, rows: list[int], found: list[bytes]) -> pa.RecordBatch:
    at = np.array(rows)
    columns = [pa.array(file.doc_id[at], mask=file.null[at]), pa.array(starts[at]), pa.array(file.count[at].astype(np.int64)), pa.array([zlib.crc32(x) for x in found], pa.int64()), pa.array(found, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def digest(docs: DataFrame, **options: object) -> DataFrame:
    """Write docs and read the files back: (doc_id, start, n_tokens, ids_crc32)."""
    return read(write(docs, **options)).drop("ids")
