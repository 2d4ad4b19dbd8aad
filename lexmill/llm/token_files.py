"""Token files: independent zstandard frames, one per document, and a trailing seek table.

Layout of a file, all integers little-endian:

* one zstandard frame per document, its content the ids as unsigned 16-bit
  integers (32-bit where the vocabulary needs it);
* a skippable frame with the document ids as an Arrow stream (column ``id``);
* a skippable frame with the seek table of the zstandard seekable format: per frame
  compressed size, content size and the low 32 bits of the content's xxHash64, then
  the number of frames, a descriptor byte and the format's magic number.

A reader takes the tail, then only the frames of the documents it wants.
"""

from __future__ import annotations

import os
import re
import struct as pack
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import WordCache, byte_alphabet
from .common import arrow_batch, fresh_path, slices, store, struct, texts_of
from .files import new_file, open_file
from .ordering import bounds_of, parts_of, range_of

# Fixed values of the zstandard formats.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80

LEVEL = 3


# Letters, numbers and white space below U+0250, for the fast split.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
#: Words that a worker keeps encoded.
KEPT_WORDS = 750_000


class ByteLevelEncoder:
    """Ids of a byte-level tokenizers file; the library encodes each distinct word once per worker."""

    LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
    BEYOND = re.compile(r"[^\x00-\u024f]").search
    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.width = 2 if max([self.library.get_vocab_size(), *self.special.values()]) <= 0xFFFF else 4
        self.code = "H" if self.width == 2 else "I"
        if self.library.normalizer is not None:
            raise ValueError("texts are normalized first; words can't be merged as they stand")
        self.merge = self.library.model.tokenize
        self.letters = dict(enumerate(byte_alphabet()))
        self.words = WordCache(self._word, KEPT_WORDS)

    def _word(self, word: str) -> bytes:
        """The ids of a word, merged by the library's model, to which the byte alphabet is spelled out here."""
        if word in self.special:
            ids = [self.special[word]]
        else:
            ids = [t.id for t in self.merge(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters))]
        return array(self.code, ids).tobytes()

    def _parts(self, text: str) -> list[str]:
        """Words and special strings, in order."""
        split = self.LATIN if text.isascii() or self.BEYOND(text) is None else self.WORDS
        if not (self.specials and any(s in text for s in self.special)):
            return split(text)
        return [w for part in self.specials.split(text) for w in ([part] if part in self.special else split(part))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; the library merges each word that isn't kept."""
        return [b"".join(map(self.words.__getitem__, self._parts(t))) for t in texts]


@lru_cache(maxsize=2)
def encoder(file: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(file)


class Writer:
    """Appends document frames to a stream and closes it with the index and the seek table."""

    def __init__(self, out):
        self.out, self.sizes, self.ids = out, bytearray(), []

    def add(self, doc_id, frame: bytes, length: int, checksum: int) -> None:
        self.out.write(frame)
        self.sizes += pack.pack("<III", len(frame), length, checksum)
        self.ids.append(doc_id)

    def close(self, id_type: pa.DataType, width: int) -> None:
        sink = pa.BufferOutputStream()
        table = pa.table({"id": pa.array(self.ids, id_type)}).replace_schema_metadata({"width": str(width)})
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        index = sink.getvalue().to_pybytes()
        self.out.write(pack.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        tail = bytes(self.sizes) + pack.pack("<IBI", len(self.ids), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(pack.pack("<II", SKIPPABLE_SEEK_TABLE, len(tail)) + tail)


class Reader:
    """Random access to a token file: the tail is read once, frames only when asked for."""

    def __init__(self, f):
        self.f = f
        size = f.size()
        f.seek(size - 9)
        frames, _, magic = pack.unpack("<IBI", f.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("not a token file: no seek table at its end")
        tail = 8 + 12 * frames + 9
        f.seek(size - tail + 8)
        flat = array("I")
        flat.frombytes(f.read(12 * frames))
        self.sizes = list(zip(flat[0::3], flat[1::3], flat[2::3]))
        self.starts = [0]
        for n, _, _ in self.sizes:
            self.starts.append(self.starts[-1] + n)
        f.seek(self.starts[-1] + 8)
        table = pa.ipc.open_stream(f.read(size - tail - self.starts[-1] - 8)).read_all()
        self.ids = table["id"].combine_chunks() if table.num_rows else pa.array([], table.schema.field("id").type)
        self.width = int(table.schema.metadata[b"width"])
        self.unpack = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        """The packed ids of the i-th document, checked against the seek table."""
        size, length, checksum = self.sizes[i]
        self.f.seek(self.starts[i])
        ids = self.unpack.decompress(self.f.read(size), max_output_size=max(1, length))
        if len(ids) != length or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {i} doesn't match its checksum")
        return ids

    def find(self, wanted) -> Iterator[tuple[object, list[int]]]:
        """(id, ids) of the wanted documents; other frames are not read."""
        wanted = set(wanted)
        for i, doc_id in enumerate(self.ids.to_pylist()):
            if doc_id in wanted:
                yield doc_id, list(array("H" if self.width == 2 else "I", self.frame(i)))


def write(docs: DataFrame, vocab_file: str, end_id: int, text_col: str = "text", id_col: str = "doc_id", folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode every whole text, append ``end_id``, and write token files in ascending id order.

    Returns the folder and the manifest (part, name, n_docs, n_ids), one row per file;
    parts ascend with the ids. Frames are compressed where texts are read, so one
    shuffle moves compressed frames; each task writes one file, and only files named in
    the manifest count, so a task that runs again does no harm. A null text is empty
    (just ``end_id``); a null id sorts first; rows with equal ids stand together,
    ordered by their frames, and are in one task; ids must be numeric, as ranges of them are
    dealt out; long texts are one frame; other columns aren't read; an empty table gives no files.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-files")
    parts = parts_of(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType
    bounds = bounds_of(rows, F.col("id"), parts)
    framed = struct(id=id_type, frame="binary", length="long", checksum="long", width="int")

    def frames(batches):
        coder, packer = encoder(vocab_file), zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        end = array(coder.code, [end_id]).tobytes()
        for whole in batches:
            for batch in slices(whole):
                ids = [x + end for x in coder.encode(texts_of(batch, "text"))]
                yield arrow_batch(framed, {"id": batch.column("id"), "frame": [packer.compress(x) for x in ids], "length": [len(x) for x in ids], "checksum": [xxhash.xxh64_intdigest(x) & 0xFFFFFFFF for x in ids], "width": [coder.width] * len(ids)})

    dealt = (
        rows.mapInArrow(frames, framed)
        .withColumn("part", range_of(F.col("id"), bounds))
        .repartitionById(parts, F.col("part"))
        .sortWithinPartitions("id", "frame")
    )
    listed = struct(part="int", name="string", n_docs="long", n_ids="long")

    def files(batches):
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part, width, total = first.column("part")[0].as_py(), first.column("width")[0].as_py(), 0
        with new_file(folder, f"part-{part:05d}", ".ids.zst") as (name, out):
            writer = Writer(out)
            batch = first
            while batch is not None:
                for doc_id, frame, length, checksum in zip(*[batch.column(c).to_pylist() for c in ("id", "frame", "length", "checksum")]):
                    writer.add(doc_id, frame, length, checksum)
                    total += length // width
                batch = next(batches, None)
            writer.close(first.schema.field("id").type, width)
        yield arrow_batch(listed, {"part": [part], "name": [name], "n_docs": [len(writer.ids)], "n_ids": [total]})

    return folder, store(dealt.mapInArrow(files, listed), "token-manifest")


def read(folder: str, manifest: DataFrame, id_type, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document in the files.

    ``start`` counts the ids of all documents before it, across files in part order;
    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers. Every
    frame is checked against its checksum. Files that are empty give no rows.
    """
    offsets = manifest.select("part", "name", (F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")).alias("before"))
    got = struct(**{"id": id_type, "start": "long", "n_tokens": "long", "ids_crc32": "long"} | ({"ids": "binary"} if with_ids else {}))

    def documents(batches):
        for batch in batches:
            for name, at in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist()):
                with open_file(folder, name) as f:
                    reader = Reader(f)
                    for lo in range(0, len(reader.ids), 1000):
                        out = {k: [] for k in got.fieldNames() if k != "id"}
                        for i in range(lo, min(lo + 1000, len(reader.ids))):
                            ids = array("H" if reader.width == 2 else "I", reader.frame(i))
                            full = array("I", ids).tobytes()
                            row = {"start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(full), "ids": full}
                            for k in out:
                                out[k].append(row[k])
                            at += len(ids)
                        yield arrow_batch(got, out | {"id": reader.ids[lo : lo + 1000]})

    parts = parts_of(manifest)
    out = offsets.repartitionById(parts, F.col("part")).mapInArrow(documents, got)
    return out.withColumnRenamed("id", id_col)
