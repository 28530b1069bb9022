"""Token ids in files of independent zstandard frames.

A file holds the ids of documents in ascending order of their id, one frame per document, a
frame with the documents' own ids, and, as a skippable frame, a seek table: compressed and
decompressed size and checksum of every frame, then their number and a magic number, as in
the public seekable format. A reader loads the table from the end, and then only the frames
it is asked for; each is checked against its checksum (lower half of XXH64 of its content).

Documents are ordered by a range shuffle, so each partition becomes one file and the files
follow each other. A task writes under a name of its own and reports it; the reports, stored
once the job has ended, are the manifest. Files of lost or repeated attempts are in no
manifest and are never read. From the manifest come the offsets of the files.

Ids are stored in two bytes where the vocabulary allows it, else in four. A null or empty
text has the end id only. Rows with equal ids follow each other in the order of a hash of
their text. A null id comes first. An empty table gives no file and no rows.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from civiltext.llm.common import (
    BLANK, CHUNK, LETTER, NUMBER, bound_batches, buffers, character_classes, chunks, documents, edges, gather, stored, text_windows,
)
from civiltext.session import scratch_path

END_ID = 1
LEVEL = 3
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the seekable format
MANIFEST = "file string, part int, n_docs bigint, n_tokens bigint"


# --- ids of texts ------------------------------------------------------------------------

# Characters for which the steps below equal the tokenizer's own normalisation and splitting:
# no combining marks, no white space but the ASCII one, one-to-one lower case.
_PLAIN = r"\A[\t-\r\x20-\x7e\x{a1}-\x{ac}\x{ae}-\x{12f}\x{131}-\x{148}\x{14a}-\x{17e}]*\z"
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")  # fixed values: after an apostrophe they are pieces
TOGETHER = 256  # pieces in a text given to the library


class Encoder:
    """Ids of whole texts, equal to `Tokenizer.encode`, by encoding each different piece of a batch once.

    Texts are lower-cased and cut into pieces (letters, single digits, other signs) as arrays of characters. The
    vocabulary marks the end of a piece, and pieces never cross white space. So the different pieces of a batch are given
    to the library's model in texts of some hundred, whose ids the marks cut apart again, and the ids of all texts are
    gathered by the numbers of their pieces. Nothing is kept from batch to batch. Texts with other than plain characters,
    or with a special token, go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        vocabulary = self.whole.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Pieces of the plain texts between the bounds, and how many lie before each bound."""
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4")
        byte_at = np.flatnonzero((data & 0xC0) != 0x80)
        n = len(points)
        kind = character_classes()[points]
        first = np.zeros(n + 1, dtype=bool)
        first[np.searchsorted(byte_at, bounds)] = True  # also after the last text
        starts = first[:n].copy()
        starts[1:] |= kind[1:] != kind[:-1]
        starts |= kind == NUMBER
        starts &= kind != BLANK
        # an apostrophe at the begin of a piece, then letters
        alone = (points[:-1] == 0x27) & starts[:-1] & (kind[1:] == LETTER) & ~first[1:n]
        for i in np.flatnonzero(alone).tolist():
            ahead = 1 + int(not first[i + 2] and kind[i + 2] == LETTER) if i + 2 < n else 1
            letters = "".join(map(chr, points[i + 1 : i + 1 + ahead]))
            hit = next((s for s in _SUFFIXES if letters.startswith(s)), None)
            if hit:
                starts[i + 1] = False
                after = i + 1 + len(hit)
                if after < n and kind[after] == LETTER:
                    starts[after] = True
        visible = data > 0x20
        begins = byte_at[starts]
        offsets = np.append((np.cumsum(visible) - 1)[begins], visible.sum()).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data[visible].tobytes())])
        return pieces.dictionary_encode(), np.searchsorted(begins, bounds)

    def _model_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces one after another, and where each piece's begin and the last one's end."""
        firsts = np.arange(0, len(pieces) + TOGETHER, TOGETHER).clip(max=len(pieces)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(firsts), pieces.cast(pa.large_string()).cast(pa.string()))
        encoded = self.model.encode_batch_fast(pc.binary_join(lists, " ").to_pylist(), add_special_tokens=False)
        ids = np.concatenate([np.asarray(e.ids, dtype=self.dtype) for e in encoded] or [np.zeros(0, self.dtype)])
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(pieces):
            raise ValueError("the vocabulary has no mark at the end of each piece")
        return ids, np.concatenate(([0], stops))

    def _flat(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the plain texts between the bounds, and the number of ids before each bound."""
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(bounds), dtype=np.int64)
        pieces, piece_bounds = self._pieces(data, bounds)
        ids, places = self._model_ids(pieces.dictionary)
        codes = pieces.indices.to_numpy()
        sizes = np.diff(places)[codes]
        return gather(ids, places[:-1][codes], sizes), edges(sizes)[piece_bounds]

    def encode(self, texts: pa.Array, window: int = CHUNK) -> Iterator[bytes]:
        """The ids of each text, without an end id, as little-endian numbers of `dtype`."""
        texts = texts.cast(pa.large_string())
        plain = pc.and_not(pc.match_substring_regex(texts, _PLAIN), pc.match_substring(texts, "<|"))
        data, bounds = buffers(pc.utf8_lower(pc.if_else(plain, texts, "")))
        if len(texts) == 1 and len(data) > window and plain[0].as_py():
            yield b"".join(self._flat(w, np.array([0, len(w)]))[0].tobytes() for w in text_windows(data, window))
            return
        ids, places = self._flat(data, bounds)
        for i, is_plain in enumerate(plain.to_pylist()):
            if is_plain:
                yield ids[places[i] : places[i + 1]].tobytes()
            else:
                yield np.asarray(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype=self.dtype).tobytes()


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One encoder per Python worker, in the worker's own thread: Spark's tasks are the parallel ones, and each thread of the
    library keeps memory of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


# --- files -------------------------------------------------------------------------------


class FrameWriter:
    """Writes frames and, on closing, the seek table."""

    def __init__(self, sink, level: int = LEVEL):
        self.sink, self.table = sink, []
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=False)

    def add(self, content: bytes) -> None:
        frame = self.compressor.compress(content)
        self.sink.write(frame)
        self.table.append(struct.pack("<III", len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> None:
        entries = b"".join(self.table)
        footer = struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)  # 0x80: with checksums
        self.sink.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.sink.close()


class FrameReader:
    """Reads single frames of a file by number."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        self.table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), dtype="<u4").reshape(n, 3)
        self.starts = np.concatenate(([0], np.cumsum(self.table[:, 0], dtype=np.int64)))
        self.decompressor = zstandard.ZstdDecompressor()

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def frame(self, i: int) -> bytes:
        packed, size, checksum = self.table[i].tolist()
        content = self.decompressor.decompress(self._at(int(self.starts[i]), packed), max_output_size=size)
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {i} is damaged")
        return content


class DocumentReader:
    """The documents of one file. The last two frames hold their ids, with a byte each that is 0 for a null, and the type of the token ids."""

    def __init__(self, source):
        self.frames = FrameReader(source)
        n = len(self.frames.table)
        self.dtype = np.dtype(self.frames.frame(n - 1).decode())
        content, n_docs = self.frames.frame(n - 2), n - 2
        self.ids = np.frombuffer(content, dtype="<i8", count=n_docs)
        self.known = np.frombuffer(content, dtype="u1", offset=8 * n_docs).astype(bool)

    def tokens(self, i: int) -> np.ndarray:
        return np.frombuffer(self.frames.frame(i), dtype=self.dtype)

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Tokens of all documents with that id, reading no others."""
        nulls = len(self.ids) - int(self.known.sum())  # they come first
        low, high = (nulls + int(np.searchsorted(self.ids[nulls:], doc_id, side)) for side in ("left", "right"))
        return [self.tokens(i) for i in range(low, high)]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, id_column: str, folder: str, tokenizer: str, end_id: int = END_ID, level: int = LEVEL) -> DataFrame:
    """Encode `docs (id, text)` into files in `folder`, which all executors share; returns the stored manifest, a row per file."""
    bound_batches(docs.sparkSession)
    ordered = docs.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, ids, known, tokens, encoder = None, [], [], 0, _encoder(tokenizer)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        for batch in batches:
            if batch.num_rows and writer is None:
                part = TaskContext.get().partitionId()
                file = f"{folder.rstrip('/')}/tokens-{part:06d}-{uuid.uuid4().hex}.zst"
                system, place = _opened(file)
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                writer = FrameWriter(system.open_output_stream(place, compression=None), level)
            ids.append(batch.column("id").fill_null(0).to_numpy())
            known.append(batch.column("id").is_valid().to_numpy(zero_copy_only=False))
            for raw in (x for part in chunks(batch.column("text")) for x in encoder.encode(part)):
                writer.add(raw + end)
                tokens += len(raw) // encoder.dtype.itemsize + 1
        if writer is not None:
            numbers = np.concatenate(ids).astype("<i8")
            writer.add(numbers.tobytes() + np.concatenate(known).astype("u1").tobytes())
            writer.add(encoder.dtype.str.encode())
            writer.close()
            row = {"file": [file], "part": [part], "n_docs": [len(numbers)], "n_tokens": [tokens]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("file", "string"), ("part", "int32"), ("n_docs", "int64"), ("n_tokens", "int64")]))

    return stored(ordered.select("id", "text").mapInArrow(write, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """`(doc_id, start, n_tokens, ids_crc32)` of every document, from the files of the manifest."""
    # a window over one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = stored(manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "token-offsets")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, start in zip(batch["file"], batch["start"]):
                system, place = _opened(file)
                with system.open_input_file(place) as source:
                    reader = DocumentReader(source)
                    n = len(reader.ids)
                    counts, sums = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
                    for i in range(n):
                        tokens = reader.tokens(i)
                        counts[i], sums[i] = len(tokens), zlib.crc32(tokens.astype("<u4").tobytes())
                ids = pd.Series(reader.ids).astype("Int64").mask(~reader.known)
                starts = start + np.concatenate(([0], np.cumsum(counts)[:-1]))
                yield pd.DataFrame({"doc_id": ids, "start": starts, "n_tokens": counts, "ids_crc32": sums})

    # by number of partitions, which AQE leaves alone: a few rows of names stand for much work
    spread = files.repartition(max(1, files.count()), "file")
    return spread.mapInPandas(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return read_tokens(write_tokens(docs, "doc_id", scratch_path(spark, "tokens"), tokenizer_path()))


QUERIES = {"op6_token_files": op6_token_files}
SQL: dict[str, str] = {}
