"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds one frame for each document (its ids as little-endian unsigned 32-bit integers, the end id
included), then a skippable frame with the documents' ids, then the seek table of the public zstandard
seekable format: for each frame its compressed size, decompressed size and a checksum (the low 32 bits
of XXH64 of the content), then the number of frames, a descriptor and a magic number. A reader takes the
table from the file's end and decompresses only the frames it wants; any zstandard decoder can read a
whole file.

Documents are dealt out by ranges of doc_id, one file a range, so files in order hold ascending ids.
A task writes under a name of its own and renames at the end; a task that is run again writes the
same bytes under the same final name.
"""

from __future__ import annotations

import os
import string
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import keep
from .common import map_batches, worker_cache

# Fixed values of the public seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
MANIFEST = "first_id long, path string, n_docs long, n_tokens long, n_bytes long"
_PUNCTUATION = string.punctuation.replace("'", "").encode()
_OTHER = "\0"
#: Texts whose ids show whether a tokenizer encodes words apart: white space of all kinds, marks, capitals, accents, digits, joins.
PROBES = (
    "", " ", "  two  spaces\tand\nlines \r\n", "Hello, World! it's DON'T stop.", "ÉTÉ naïve straße İstanbul e\u0301té ﬁ ſ ŉ", "a.b.c! ... 9'99 3.14 1,000 _a_ x-y", "中文。 日本語 한국어 русский ελληνικά",
    "\u3000wide\u00a0space\x1c\x85", "end... (so)] {x}*** a$$$ b,%%% c.\" d-- e+=~ f_ g\\/@^`|> h<&", "emoji 😀👍🏽 (brackets) [x] {y} <z>", "the the The THE thE", "aaaaaaaaaaaaaaaaaaaaaaaa " * 3,
)


class WordIds(dict):
    """Bytes of the ids of each word, kept for up to fixed numbers of words and of their stems.

    A stem is a run of plain letters, folded as the tokenizer folds them, and may have marks behind it; other words go whole to the library."""

    def __init__(self, library, most_words: int, most_stems: int):
        self.library, self.most_words, self.most_stems = library, most_words, most_stems
        self.tokenize, self.letters = library.model.tokenize, PlainLetters(library)
        self.stems: dict[str, bytes] = {}
        self.marks: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most_words:
            self.clear()
        stem, mark = word.decode().translate(self.letters), b""
        if _OTHER in stem:
            letters = stem.rstrip(_OTHER)
            end = word[len(letters) - len(stem) :]
            if not letters or letters == stem or _OTHER in letters or end.strip(_PUNCTUATION):
                ids = self[word] = encoded(self.library, word.decode())
                return ids
            stem, mark = letters, self._marks(end)
        ids = self.stems.get(stem)
        if ids is None:
            if len(self.stems) >= self.most_stems:
                self.stems.clear()
            tokens = [t.id for t in self.tokenize(stem)]
            ids = self.stems[stem] = struct.pack(f"<{len(tokens)}I", *tokens)
        ids = self[word] = ids + mark if mark else ids
        return ids

    def _marks(self, end: bytes) -> bytes:
        ids = self.marks.get(end)
        if ids is None:
            if len(self.marks) >= self.most_stems:
                self.marks.clear()
            ids = self.marks[end] = encoded(self.library, end.decode())
        return ids


def encoded(library, text: str) -> bytes:
    return np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class PlainLetters(dict):
    """For str.translate: letters below U+0180, by code point, in the form that normaliser and pre-tokenizer give them, if each
    is one letter on its own; all else is _OTHER. A tokenizer without such letters gets an empty table."""

    def __init__(self, library):
        normal, parts = library.normalizer, library.pre_tokenizer
        if normal is None or parts is None:
            return
        for c in filter(str.isalpha, map(chr, range(0x180))):
            folded = normal.normalize_str(c)
            if len(folded) == 1 and folded.isalpha() and normal.normalize_str(folded) == folded:
                form = parts.pre_tokenize_str(folded)
                if len(form) == 1:
                    self[ord(c)] = form[0][0]

    def __missing__(self, code: int) -> str:
        return _OTHER


class WordTokenizer:
    """Encodes whole texts with a tokenizers file, each distinct word once.

    That is right for tokenizers that normalise character by character, drop white space before merging and keep runs of
    letters together, as then a text's ids are its words' ids in turn. Whether a file is of that kind is checked with PROBES
    when it is loaded; others encode whole texts, as do texts with the special tokens' bracket. Texts go one by one, so that
    a text's words stay in the CPU's caches.
    """

    def __init__(self, path: str, most_words: int = 300_000, most_stems: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words = WordIds(self.library, most_words, most_stems)
        self.by_words = all(b"".join(map(self.words.__getitem__, t.encode().split())) == encoded(self.library, t) for t in PROBES)

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text the bytes of its ids."""
        ids = self.words.__getitem__
        if not self.by_words:
            return [encoded(self.library, t) for t in texts]
        return [encoded(self.library, t) if "<|" in t else b"".join(map(ids, t.encode().split())) for t in texts]


@worker_cache("tokens")
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Writes one file; documents must come in order."""

    def __init__(self, path: str, level: int = 3):
        self.final, self.temporary = path, f"{path}.{uuid.uuid4().hex}"
        self.fs, where = open_fs(self.temporary)
        self.fs.create_dir(os.path.dirname(where))
        self.out = self.fs.open_output_stream(where)
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.tokens = self.bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        packed = self.zstd.compress(ids)
        self.out.write(packed)
        self.entries.append((len(packed), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.tokens += len(ids) // 4

    def close(self) -> tuple:
        index = np.array([i or 0 for i in self.ids], "<i8").tobytes() + bytes(i is None for i in self.ids)
        head = struct.pack("<II", SKIPPABLE_INDEX, len(index))
        table = np.array([*self.entries, (len(head) + len(index), 0, 0)], ENTRY).tobytes()
        foot = struct.pack("<IBI", len(self.entries) + 1, CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(head + index + struct.pack("<II", SKIPPABLE_SEEK, len(table) + len(foot)) + table + foot)
        self.bytes = self.out.tell()
        self.out.close()
        self.fs.move(open_fs(self.temporary)[1], open_fs(self.final)[1])
        return self.ids[0], self.final, len(self.ids), self.tokens, self.bytes


class ShardReader:
    """Reads documents of one file; only their frames are read and decompressed."""

    def __init__(self, path: str):
        f, where = open_fs(path)
        self.file = f.open_input_file(where)
        size = self.file.size()
        frames, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or descriptor != CHECKSUMS:
            raise ValueError(f"{path}: no seek table")
        table = size - 9 - frames * ENTRY.itemsize
        self.entries = np.frombuffer(self.file.read_at(frames * ENTRY.itemsize, table), ENTRY)
        self.at = np.concatenate(([0], np.cumsum(self.entries["packed"], dtype=np.int64)))
        n = frames - 1
        index = self.file.read_at(9 * n, int(self.at[n]) + 8)
        nulls = np.frombuffer(index, np.uint8, offset=8 * n)
        self.doc_ids = [None if gone else int(i) for i, gone in zip(np.frombuffer(index, "<i8", n), nulls, strict=True)]
        self.zstd = zstandard.ZstdDecompressor()

    def document(self, k: int) -> bytes:
        """Bytes of the k-th document's ids; raises if the checksum differs."""
        packed, size, check = self.entries[k]
        ids = self.zstd.decompress(self.file.read_at(int(packed), int(self.at[k])), max_output_size=int(size)) if size else b""
        if xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k}: wrong checksum")
        return ids

    def lengths(self) -> np.ndarray:
        return self.entries["size"][:-1] // 4


def write_documents(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, files: int | None = None) -> DataFrame:
    """Encodes docs (doc_id, text), writes files under path and returns their manifest.

    Null texts are empty and get the end id alone; rows with null or repeated ids are all written, nulls
    first, repeats ordered by a hash of the text, so that they may fill several files; an empty table gives an empty manifest; other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.xxhash64("text"))
    order = ["doc_id", "place"]
    rows = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = tokenizer(tokenizer_path), None
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = part.column("doc_id").to_pylist()
                for i, x in zip(ids, encoder.encode(part.column("text").to_pylist()), strict=True):
                    if out is None:
                        first = f"{'null' if i is None else f'{i + 2**63:020d}'}-{part.column('place')[0].as_py() + 2**63:020d}"
                        out = ShardWriter(f"{path}/tokens-{first}.zst")
                    out.add(i, x + end)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) if k else pa.array([x], pa.int64()) for k, x in enumerate(out.close())], names=["first_id", "path", "n_docs", "n_tokens", "n_bytes"])

    return keep(map_batches(rows.sortWithinPartitions(*order), write, MANIFEST, "tokens"), "manifest")


def as_list(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def read_documents(manifest: DataFrame, value: Callable[[bytes], object] = as_list, name: str = "ids", kind: T.DataType | None = None, batch: int = 1024) -> DataFrame:
    """Rows (doc_id, start, n_tokens, name) of all files; start counts the ids of all documents before.

    value: what to make of a document's ids, by default the list of them, of the type kind."""
    spark = manifest.sparkSession
    kind = kind or T.ArrayType(T.LongType())
    ahead = Window.partitionBy(F.lit(0)).orderBy(F.col("first_id").asc_nulls_first(), "path").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.select("path", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)).alias("ahead"))
    files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField(name, kind)])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, ahead in zip(b.column("path").to_pylist(), b.column("ahead").to_pylist(), strict=True):
                shard = ShardReader(path)
                n = shard.lengths().astype(np.int64)
                start = ahead + np.cumsum(n) - n
                for lo in range(0, len(n), batch):
                    hi = min(lo + batch, len(n))
                    got = [value(shard.document(k)) for k in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[lo:hi], pa.int64()), pa.array(start[lo:hi]), pa.array(n[lo:hi]), pa.array(got, arrow)], names=["doc_id", "start", "n_tokens", name])

    return map_batches(files, read, schema)


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
