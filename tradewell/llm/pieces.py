"""SentencePiece ids by a table of distinct chunks, each segmented once, and decoding."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tradewell.llm.common import bucketed, prepare

#: What the library writes for a space.
MARK = "▁"
#: Letters of text in a block of documents, which shares one list of chunks.
BLOCK_LETTERS = 8 << 20
#: Bytes of all texts per part of the table of distinct chunks.
PART_BYTES = 64 << 20
#: Chunks that are numbered or segmented at once.
TOGETHER = 200_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Segmenter:
    """A model, and whether its texts may be cut before each run of marks.

    They may if no piece has a mark behind another letter, so that no merge reaches over such a
    cut, and if the model puts one mark before a text and else keeps marks as they are, so that a chunk
    without its first mark is a text whose marked form is the chunk. For other models a whole text is one chunk.
    """

    def __init__(self, model: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        normalize = self.processor.normalize
        pieces = (self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size()))
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces) and all(
            normalize(x) == MARK + x.replace(" ", MARK) for x in ("ab", " ab  c ", f"a{MARK}{MARK}b"))
        self.end = self.processor.eos_id()
        self.dtype = np.dtype("<u2" if self.processor.get_piece_size() <= 1 << 16 else "<i4")

    def chunks(self, text: str) -> Iterator[list[str]]:
        """The chunks of a text in order, in lists of at most ``TOGETHER``."""
        if not text:
            return
        if not self.cuts:
            yield [text]
            return
        marked = self.processor.normalize(text)
        if len(marked) <= TOGETHER:
            yield _CHUNK.findall(marked)
            return
        found = (m[0] for m in _CHUNK.finditer(marked))
        while some := list(itertools.islice(found, TOGETHER)):
            yield some

    def segment(self, chunks: list[str]) -> list[list[int]]:
        if not self.cuts:
            return self.processor.encode(chunks, num_threads=1)
        texts = [c[1:] for c in chunks]
        for text, chunk in zip(texts, chunks, strict=True):
            if text and self.processor.normalize(text) != chunk:
                raise ValueError(f"the model changes a chunk that stands alone: {chunk[:40]!r}")
        made = self.processor.encode(texts, num_threads=1)
        if MARK in chunks:
            # An empty text gets no mark; a space behind another chunk is a chunk of its own.
            made[chunks.index(MARK)] = self.processor.encode("a ")[len(self.processor.encode("a")):]
        return made


def _pack(numbers: np.ndarray) -> bytes:
    """Small numbers byte plane by byte plane, compressed: the high bytes of frequent chunks are 0."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_chunks(chunks: list[bytes]) -> tuple[bytes, bytes]:
    """(lengths, text) of sorted chunks."""
    return _pack(np.array([len(c) for c in chunks], "<u4")), zstandard.ZstdCompressor(level=3).compress(b"".join(chunks))


def _unpack_chunks(lengths: bytes, text: bytes) -> list[bytes]:
    ends = np.cumsum(_unpack(lengths).astype(np.int64)).tolist()
    data = zstandard.ZstdDecompressor().decompress(text)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


#: A block's documents (part -1: ids, numbers of chunks, chunk numbers), or its chunks of one part (numbers, lengths, text).
_BLOCK = pa.schema([
    ("block", pa.int64()), ("part", pa.int64()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
    ("numbers", pa.binary()), ("lengths", pa.binary()), ("text", pa.binary())])
_BLOCK_SQL = "block long, part long, ids array<long>, counts array<long>, numbers binary, lengths binary, text binary"


def _numbered(model: str, block_letters: int, parts: int):
    """Documents to blocks. Chunks are numbered by falling frequency in the block, so that common ones have small numbers."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(model)
        task = TaskContext.get().partitionId() << 32
        done, ids, counts, places, letters = 0, [], [], [], 0
        numbers: defaultdict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done, letters
            block = task + done
            seen = np.concatenate([*places, np.zeros(0, np.uint32)])
            chunks = [c.encode() for c in numbers]
            often = np.bincount(seen, minlength=len(chunks))
            part = np.fromiter((zlib.crc32(c) % parts for c in chunks), np.int64, len(chunks))
            by_text = np.empty(len(chunks), np.int64)
            by_text[sorted(range(len(chunks)), key=chunks.__getitem__)] = np.arange(len(chunks))
            order = np.lexsort((by_text, part, -often))
            rank = np.empty(len(chunks), np.uint32)
            rank[order] = np.arange(len(chunks), dtype=np.uint32)
            row = {"block": block, "part": -1, "ids": ids, "counts": counts, "numbers": _pack(rank[seen])}
            yield pa.RecordBatch.from_pylist([row], _BLOCK)
            # Within a part the numbers rise, so their differences are small.
            dealt = order[np.argsort(part[order], kind="stable")]
            cuts = np.flatnonzero(np.diff(part[dealt])) + 1
            for own in np.split(dealt, cuts):
                if len(own):
                    lengths, text = _pack_chunks([chunks[i] for i in own.tolist()])
                    yield pa.RecordBatch.from_pylist([{
                        "block": block, "part": int(part[own[0]]), "numbers": _pack(np.diff(rank[own].astype(np.int64), prepend=0)),
                        "lengths": lengths, "text": text}], _BLOCK)
            done, letters = done + 1, 0
            numbers.clear()
            for x in (ids, counts, places):
                x.clear()

        for batch in batches:
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                count = 0
                for chunks in segmenter.chunks(text or ""):
                    places.append(np.fromiter(map(numbers.__getitem__, chunks), np.uint32, len(chunks)))
                    count += len(chunks)
                ids.append(id_)
                counts.append(count)
                letters += len(text or "")
                if letters >= block_letters:
                    yield from flush()
        if ids:
            yield from flush()

    return number


def segmented(lists: DataFrame, model: str) -> DataFrame:
    """(block, numbers, sizes, pieces) from (block, part, numbers, lengths, text): the distinct-chunk table, part by part.

    A part holds all blocks' chunks with some checksums, so every distinct chunk is in one part, where it is
    segmented once; its ids then go into the row of each block that asked for it.
    """

    def segment(rows: pa.Table) -> pa.Table:
        segmenter = Segmenter(model)
        asked = [_unpack_chunks(*x) for x in zip(rows.column("lengths").to_pylist(), rows.column("text").to_pylist(), strict=True)]
        distinct = list({c for chunks in asked for c in chunks})
        known: dict[bytes, bytes] = {}
        for at in range(0, len(distinct), TOGETHER):
            some = distinct[at : at + TOGETHER]
            for chunk, ids in zip(some, segmenter.segment([c.decode() for c in some]), strict=True):
                known[chunk] = np.array(ids, segmenter.dtype).tobytes()
        width, sizes, pieces = segmenter.dtype.itemsize, [], []
        for chunks in asked:
            found = [known[c] for c in chunks]
            sizes.append(_pack(np.array([len(x) // width for x in found], "<u4")))
            pieces.append(zstandard.ZstdCompressor(level=3).compress(b"".join(found)))
        return pa.table({
            "block": rows.column("block"), "numbers": rows.column("numbers"),
            "sizes": pa.array(sizes, pa.binary()), "pieces": pa.array(pieces, pa.binary())})

    return lists.select("block", "part", "numbers", "lengths", "text").groupBy("part").applyInArrow(
        segment, "block long, numbers binary, sizes binary, pieces binary")


def encode_pieces(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text",
    block_letters: int = BLOCK_LETTERS, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """(``id_col``, ids): the ids that the sentencepiece library gives each text, and its end id.

    Texts are cut before each run of space marks. A block of documents (8 M letters, one document at
    least) holds the list of its distinct chunks and, per document, the chunks' numbers. Blocks are
    written once, bucketed, so numbers never change and documents are not shuffled. The blocks' lists are
    dealt by checksum into parts, which make the table of distinct chunks; each is segmented once
    (``segmented``), its ids return to the lists, and every block puts its documents' ids together by
    position. So what is shuffled is blocks' distinct chunks and their ids, compressed, never a row for each
    word; a word in every text is one entry a block. A part is a share of ``part_bytes`` of the input's text.

    Null and empty texts have the end id only. Rows are kept as they are: null and repeated ids too.
    A text without spaces is one chunk, however long.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-size // part_bytes))
    blocks = bucketed(
        rows.mapInArrow(_numbered(model, block_letters, parts), _BLOCK_SQL), "blocks", "block", max(least, parts // 4))
    known = segmented(blocks.filter("part >= 0"), model).withColumnRenamed("block", "of")
    segmenter = Segmenter(model)
    end, dtype = segmenter.end, segmenter.dtype

    def together(documents: pa.Table, lists: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor()
        numbers = [np.cumsum(_unpack(x).astype(np.int64)) for x in lists.column("numbers").to_pylist()]
        order = np.argsort(np.concatenate([*numbers, np.zeros(0, np.int64)]))
        sizes = np.concatenate([*map(_unpack, lists.column("sizes").to_pylist()), np.zeros(0, "<u4")]).astype(np.int64)
        ids = np.frombuffer(b"".join(map(open_.decompress, lists.column("pieces").to_pylist())), dtype)
        starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        own, made = [], []
        for row in documents.to_pylist():
            at, every = 0, _unpack(row["numbers"])
            for id_, count in zip(row["ids"], row["counts"], strict=True):
                place = every[at : at + count]
                at += count
                size = sizes[place]
                # The k-th id of a chunk stands k behind the chunk's start.
                from_ = np.repeat(starts[place] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                own.append(id_)
                made.append(np.append(ids[from_], dtype.type(end)).astype(np.int32))
        offsets = np.cumsum([0, *map(len, made)])
        if offsets[-1] >= 1 << 31:
            raise ValueError("a block holds more than 2^31 ids")
        values = pa.array(np.concatenate([*made, np.zeros(0, np.int32)]))
        return pa.table({"id": pa.array(own, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)})

    documents = blocks.filter("part < 0").select("block", "ids", "counts", "numbers")
    encoded = documents.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(together, "id long, ids array<int>")
    return encoded.select(F.col("id").alias(id_col), "ids")


def decode_pieces(rows: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text that the library decodes from each row's ids; null ids give null."""
    prepare(rows.sparkSession)
    form = StructType([*rows.schema.fields, StructField(out_col, StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = Segmenter(model).processor
        for batch in batches:
            column = batch.column(ids_col)
            # One copy of all numbers: a list array's own conversion makes an object of each.
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
            lists = [values[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            known = column.is_valid().to_pylist()
            texts = [x if there else None for x, there in zip(processor.decode(lists, num_threads=1), known, strict=True)] if lists else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out_col])

    return rows.mapInArrow(decode, form)
