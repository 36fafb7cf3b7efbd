"""Token ids in flat binary files: a file of ids and one of document offsets per partition."""

from __future__ import annotations

import math
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewell.llm.common import prepare, release_memory, returning, saved, shared_folder

#: Bytes of text per file.
FILE_BYTES = 256 << 20
#: Bytes that a task spends on words whose ids it remembers, and letters of the longest such word.
MEMORY, LONGEST = 256 << 20, 64
#: New words that are encoded at once.
TOGETHER = 2000
#: Letters that a tokenizer is asked about, and marks that may stand behind a word.
LETTERS, TRAILING = "abcdefghijklmnopqrstuvwxyz", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_NO_ID = np.iinfo(np.int64).min
#: Bytes of texts up to U+00FF: A-Z lowered, tabs and line ends as spaces.
_LOWER = bytes(range(256)).lower().translate(bytes.maketrans(b"\t\n\r", b"   "))


class Encoder:
    """Ids of whole texts as packed unsigned integers.

    The tokenizer splits at white space before anything else, so the ids of a text are those of
    its pieces between spaces, tabs and line ends; pieces that have been seen are not encoded
    again. What is remembered is bounded in bytes (``memory``, by default ``MEMORY``) and holds no long piece (``LONGEST``):
    there are two generations of half that size, and a piece that is not seen for a whole one is forgotten.
    ``whole`` encodes texts at once, for tokenizers of another kind.

    What the tokenizer does to letters is asked of it once: if it lowers case, A-Z are lowered
    first; if it parts a word from the marks behind it (asked for each run of marks that occurs), the two are encoded
    apart; if it leaves words of a-z as they are, those go to its model without its normalizer and patterns.
    """

    def __init__(self, path: str, dtype: np.dtype, whole: bool = False, memory: int | None = None):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer, self.dtype, self.whole = Tokenizer.from_file(path), dtype, whole
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held, self.memory = 0, MEMORY if memory is None else memory
        # A special token cuts a text before anything else looks at it, so it can stand between pieces.
        self.mark = next(((t.content, i) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items())
                          if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)), None)
        normal, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer

        def parts(text: str) -> list[str]:
            text = normal.normalize_str(text) if normal else text
            return [x for x, _ in split.pre_tokenize_str(text)] if split else [text]

        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lowers = parts(LETTERS.upper()) == [LETTERS] and not any(x.isalpha() for x in added)
        self.parts, self.apart = parts, {"": True}
        self.added = [x.lower() for x in added]
        # An added token of letters and marks could reach across the cut between them.
        self.trims = not any((x.rstrip(TRAILING) or "a").isalpha() for x in added)
        self.plain = None
        if parts(f"{LETTERS} ab") == [LETTERS, "ab"] and not any("".join(x.split()).isalpha() for x in added):
            self.plain = Tokenizer(self.tokenizer.model)  # the same model: no second vocabulary in memory
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def _pack(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _between(self, texts: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        packed, width = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        self.known.update(zip(texts, [
            packed[a:b] for a, b in zip((starts * width).tolist(), (ends * width).tolist(), strict=True)], strict=True))

    def _learn_words(self, words: list[str], tokenizer) -> list[str]:
        """Encodes words of letters with spaces between; returns those that are not one part each."""
        odd: list[str] = []
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            made = tokenizer.encode(" ".join(some), add_special_tokens=False)
            owner = np.array([-1 if x is None else x for x in made.word_ids], np.int64)
            first = np.flatnonzero(np.diff(owner, prepend=-2))
            # Each word makes one part at least, so as many parts as words is one for each.
            if len(first) == len(some) and (owner >= 0).all():
                self._between(some, np.array(made.ids, np.int64), first, np.append(first[1:], len(owner)))
            else:
                odd += some
        return odd

    def _learn_pieces(self, pieces: list[str]) -> None:
        """Encodes pieces of any kind, many at once with the mark between them."""
        content, mark = self.mark or (None, None)
        alone = pieces if content is None else [x for x in pieces if content in x]
        self.known.update(zip(alone, self._pack(alone), strict=True))
        rest = [] if content is None else [x for x in pieces if content not in x]
        for at in range(0, len(rest), TOGETHER):
            some = rest[at : at + TOGETHER]
            ids = np.array(self.tokenizer.encode(content.join(some), add_special_tokens=False).ids, np.int64)
            cuts = np.flatnonzero(ids == mark)
            self._between(some, ids, np.append(0, cuts + 1), np.append(cuts, len(ids)))

    def _trims(self, marks: str) -> bool:
        """Whether the tokenizer parts a word from these marks, and these from the word, as it parts the marks alone."""
        apart = self.apart.get(marks)
        if apart is None:
            alone = self.parts(marks)
            apart = self.trims and self.parts(f"ab{marks} ab") == ["ab", *alone, "ab"]
            if len(self.apart) < TOGETHER:
                self.apart[marks] = apart
        return apart

    def _stem(self, piece: str) -> tuple[str, str]:
        """A word of letters, lowered, and the marks behind it; any other piece as it is."""
        if len(piece) > LONGEST:
            return piece, ""
        word = piece.rstrip(TRAILING)
        if not word.isalpha():
            return piece, ""
        behind = piece[len(word) :]
        # Letters up to U+00FF end in a letter still when they are lowered and composed.
        if behind and (word[-1] > "\xff" or not self._trims(behind)):
            return piece, ""
        return word.encode().lower().decode() if self.lowers else word, behind

    def _hold(self, pieces: Iterable[str]) -> None:
        """Counts what pieces take: two objects and a place in the table for each, and up to four bytes a letter."""
        kept = [x for x in pieces if len(x) <= LONGEST]
        self.held += 240 * len(kept) + 4 * sum(map(len, kept)) + sum(map(len, map(self.known.__getitem__, kept)))

    def _missing(self, pieces: set[str]) -> list[str]:
        """The pieces that neither generation knows; those of the old one move to the new one."""
        known, before = self.known, self.before
        unknown = pieces.difference(known)  # looks up the pieces; "-" with its keys would go through all that is known
        again = unknown.intersection(before.keys()) if len(before) < len(unknown) else {x for x in unknown if x in before}
        known.update([(x, before[x]) for x in again])
        self._hold(again)
        return list(unknown - again)

    def learn(self, pieces: set[str]) -> None:
        """Encodes the pieces that are not known yet."""
        if self.held > self.memory // 2:
            self.known, self.before, self.held = {}, self.known, 0
        new = self._missing(pieces)
        whole = {x for x in new if x.islower() and x.isascii() and x.isalpha()}
        cut = [(x, *self._stem(x)) for x in new if x not in whole]
        need = [*whole, *self._missing({y for _, *pair in cut for y in pair} - whole)]
        words = [x for x in need if x.isalpha()]
        plain = [] if self.plain is None else [x for x in words if x.isascii() and (self.lowers or x.islower())]
        easy = set(plain)
        odd = self._learn_words(plain, self.plain)
        odd += self._learn_words([x for x in words if x not in easy], self.tokenizer)
        self._learn_pieces(odd + [x for x in need if not x.isalpha()])
        known = self.known
        known.update([(x, known[a] + known[b]) for x, a, b in cut])
        self._hold({x for x, *_ in cut}.union(need))

    def pieces(self, text: str) -> list[str]:
        """What stands between spaces, tabs and line ends; lowered at once where no letter can be composed."""
        if self.lowers:
            try:
                low = text.encode("latin-1").translate(_LOWER).decode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                if not any(x in low for x in self.added):
                    return low.split(" ")
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of several texts; their new pieces are encoded together."""
        if self.whole:
            return self._pack(texts)
        out: list[bytes] = []
        parts = [self.pieces(x) for x in texts]
        every = set().union(*parts)
        self.learn(every)
        known = self.known
        for part in parts:
            out.append(b"".join(map(known.__getitem__, part)))
        for x in every:
            if len(x) > LONGEST:
                del known[x]
        return out


def write_tokens(
    docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, width: int = 4,
    id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, whole: bool = False,
    memory: int | None = None,
) -> DataFrame:
    """Encodes all texts and writes them in ascending id order; returns the manifest.

    For part ``p`` of the order there are three flat little-endian files: ``p-*.tok`` with the
    ids of all its documents, ``width`` bytes each (2 or 4, unsigned), every document followed by
    ``end_id``; ``p-*.idx`` with the 64-bit offsets of its documents in ids, and the total at
    the end; ``p-*.doc`` with the 64-bit document ids. Manifest rows are (part, path, n_docs,
    n_tokens, first_doc, base): ``base`` is the number of ids in all earlier parts, so that a
    document's place in the whole is base + offset. The driver only sees the manifest.

    A task writes under a name of its own attempt and the manifest names the files of the
    attempt that ended well, so lost executors and repeated tasks do no harm. The folder is on
    the shared file system, by default below ``spark.checkpoint.dir``, and mounted where tasks run,
    since readers map the files into memory. ``memory`` bounds the bytes that a task spends on words it remembers;
    fewer cost time, not results.

    Null texts count as empty: only the end id. Null ids come first. Rows that repeat an id are
    each written, ordered by a hash of their text, and dealt out by that hash too.
    """
    spark = prepare(docs.sparkSession)
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    place = urlparse(folder)
    if place.scheme not in ("", "file"):
        raise ValueError("token files are mapped into memory: give a folder that is mounted as a file system")
    target, dtype = place.path, np.dtype(f"<u{width}")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(math.ceil(size / file_bytes), spark.sparkContext.defaultParallelism)
    rows = rows.withColumn("tie", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    dealt = rows.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie", "text")

    @returning
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{target}/{task.partitionId():08d}-{task.taskAttemptId()}"
        os.makedirs(target, exist_ok=True)
        release_memory()
        encode = Encoder(tokenizer, dtype, whole, memory)
        end = np.array([end_id], dtype).tobytes()
        offset, n_docs = 0, 0
        with open(f"{path}.tok", "wb") as tok, open(f"{path}.idx", "wb") as idx, open(f"{path}.doc", "wb") as doc:
            for batch in batches:
                offsets = []
                for at in range(0, len(batch), 200):
                    texts = [x or "" for x in batch.column("text").slice(at, 200).to_pylist()]
                    for ids in encode.batch(texts):
                        tok.write(ids)
                        tok.write(end)
                        offsets.append(offset)
                        offset += len(ids) // width + 1
                idx.write(np.array(offsets, "<i8").tobytes())
                doc.write(np.array([_NO_ID if x is None else x for x in batch.column("id").to_pylist()], "<i8").tobytes())
                n_docs += len(batch)
            idx.write(np.array([offset], "<i8").tobytes())
            for f in (tok, idx, doc):
                f.flush()
                os.fsync(f.fileno())
        yield pa.RecordBatch.from_pylist(
            [{"part": task.partitionId(), "path": path, "n_docs": n_docs, "n_tokens": offset}],
            pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    written = saved(dealt.mapInArrow(write, "part long, path string, n_docs long, n_tokens long"), "token-parts")
    rows, base, first = [], 0, 0
    for part, path, n_docs, n_tokens in sorted(tuple(r) for r in written.collect()):
        if n_docs:
            rows.append((part, path, n_docs, n_tokens, first, base))
        base, first = base + n_tokens, first + n_docs
    form = "part long, path string, n_docs long, n_tokens long, first_doc long, base long"
    return spark.createDataFrame(rows, form).repartition(max(1, len(rows)), "part")


def read_tokens(manifest: DataFrame, width: int = 4, block: int = 2000, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the mapped files.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers. A file is read in
    blocks of documents, never as a whole.
    """
    dtype = np.dtype(f"<u{width}")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    @returning
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.memmap(f"{r['path']}.tok", dtype, "r", shape=(r["n_tokens"],))
                offsets = np.memmap(f"{r['path']}.idx", "<i8", "r", shape=(r["n_docs"] + 1,))
                docs = np.memmap(f"{r['path']}.doc", "<i8", "r", shape=(r["n_docs"],))
                for at in range(0, r["n_docs"], block):
                    edges = np.array(offsets[at : at + block + 1])
                    own = np.array(docs[at : at + block])
                    spans = [np.ascontiguousarray(ids[a:b], "<u4") for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                    columns = [pa.array(own, mask=own == _NO_ID), pa.array(edges[:-1] + r["base"]), pa.array(np.diff(edges)),
                               pa.array([zlib.crc32(x) for x in spans], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in spans], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names)

    form = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return manifest.mapInArrow(read, form)
