"""Token ids in independent zstandard frames with a seek table.

A file holds one frame for each run of documents, each compressed on its own with a checksum; then a skippable frame
with the index, for each frame the first id and the number of its documents; then the seek table in the public seekable
layout, for each frame its compressed and plain size and a checksum. Tasks write the files to the shared folder. A reader
fetches table and index from a file's end and then reads and decompresses only the frames that hold the documents it wants.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonority.llm.common import few, new_path, table, text_or_empty, written

#: Fixed values of the zstandard formats: magic numbers of skippable frames (the index's and the seek table's), the descriptor
#: of a seek table with checksums, and the number that ends it.
INDEX, SKIPPABLE, CHECKSUMS, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x80, 0x8F92EAB1
#: Plain bytes after which a frame is closed, and after which a file is.
FRAME_BYTES, FILE_BYTES = 1 << 18, 1 << 24
#: Text bytes that a task encodes, about, and tasks at most: beyond, each has more files.
PART_BYTES, MAX_PARTS = 1 << 25, 20_000
END_ID = 0
#: Distinct words, and distinct words with marks, whose ids a worker keeps; texts that are encoded at once; words in one call.
MEMORY, MARKED, TEXTS, WORDS = 450_000, 100_000, 512, 2_000
#: Marks that the vocabulary's pre-tokeniser parts from a word before them.
MARKS = ".,;:!?%&$*#)|\""
#: Letters that every edition of Unicode counts as letters: a word of these, after a space, is one pre-token.
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+")
#: The character by which byte-level vocabularies write each byte.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_NAMES = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    Pieces between single spaces and before line feeds are encoded on their own and remembered: the vocabulary's
    pre-tokeniser breaks there in any case. Texts with other runs of white space are encoded in one go. Once the memory
    is full, pieces that are not in it are encoded anew for each batch of texts.
    """

    def __init__(self, path: str) -> None:
        # one thread: tasks already fill the cores, and each thread would keep buffers of its own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.of = Tokenizer.from_file(path)
        self.piece: dict[str, bytes | None] = {}
        self.words = self.marked = 0
        nul = self.of.encode("\0", add_special_tokens=False).ids
        self.nul = nul[0] if len(nul) == 1 else None
        # nothing but the merges works on a word of letters: no normaliser, and no added token that could stand in one
        added = self.of.get_added_tokens_decoder().values()
        self.merges_alone = isinstance(self.of.model, models.BPE) and isinstance(self.of.pre_tokenizer, pre_tokenizers.ByteLevel) and self.of.normalizer is None and not any(LATIN.fullmatch(t.content.strip()) for t in added)

    def whole(self, text: str) -> bytes:
        return np.array(self.of.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, words: list[str]) -> Iterator[bytes]:
        """As :meth:`_words`, for words of ``LATIN`` letters: the library's merges are applied to each, without the steps that part texts."""
        tokens = self.of.model.tokenize
        for i in range(0, len(words), WORDS):
            named = (" " + "\0 ".join(words[i : i + WORDS])).encode().decode("latin-1").translate(BYTE_NAMES)
            for w in named.split(BYTE_NAMES[0]):
                yield array("I", [t.id for t in tokens(w)]).tobytes()

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of letters, each with a space before it.

        Many go into one call, with a NUL after each: a pre-token of its own between a letter and a space.
        """
        for i in range(0, len(words), WORDS):
            some = words[i : i + WORDS]
            if self.nul is None:
                yield from (self.whole(" " + w) for w in some)
                continue
            ids = np.array(self.of.encode_batch_fast([" " + "\0 ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts, raw, at = (np.flatnonzero(ids == self.nul) * 4).tolist(), ids.tobytes(), 0
            for cut in [*cuts, len(raw)]:
                yield raw[at:cut]
                at = cut + 4

    def _learn(self, new: set[str]) -> dict[str, bytes | None]:
        """Ids of pieces; None for those with more white space than one line feed before them, whose texts are encoded whole.

        A word and the marks after it are apart for the pre-tokeniser too, so words are encoded without marks.
        """
        known = self.piece
        words, others, marked, out = set(), set(), [], {}
        for p in new:
            if p.isalpha():
                words.add(p)
                continue
            stem = p.rstrip(MARKS)
            if stem != p and stem.isalpha():
                tail = "\0" + p[len(stem) :]
                marked.append((p, stem, tail))
                if stem not in known:
                    words.add(stem)
                if tail not in known:
                    others.add(tail)
                continue
            body = p[1:] if p[0] in "\0\n" else p
            if body.split() == [body]:
                others.add(p)
            else:
                out[p] = None
        latin = [w for w in words if LATIN.fullmatch(w)] if self.merges_alone else []
        plain, rest = list(words.difference(latin)), list(others)
        if latin:
            out.update(zip(latin, self._merged(latin)))
        out.update(zip(plain, self._words(plain)))
        found = self.of.encode_batch_fast([p[1:] if p[0] == "\0" else p if p[0] == "\n" else " " + p for p in rest], add_special_tokens=False)
        out.update((p, array("I", e.ids).tobytes()) for p, e in zip(rest, found))
        if self.words < MEMORY:
            known.update(out)
            self.words += len(out)
        more = {p: (out.get(stem) or known[stem]) + (out.get(tail) or known[tail]) for p, stem, tail in marked}
        if self.marked < MARKED:
            known.update(more)
            self.marked += len(more)
        out.update(more)
        return out

    def many(self, texts: list[str]) -> list[bytes]:
        get, held, new = self.piece.get, [], set()
        for text in texts:
            pieces = text.replace("\n", " \n").split(" ")
            # a text's first piece has no space before it; it is told by a leading NUL, which no other piece may have
            if "" in pieces or "\0" in text:
                held.append(None)
                continue
            pieces[0] = "\0" + pieces[0]
            ids = list(map(get, pieces, (MISSING,) * len(pieces)))
            gaps = [i for i, x in enumerate(ids) if x is MISSING] if MISSING in ids else ()
            wanted = [pieces[i] for i in gaps]
            new.update(wanted)
            held.append((ids, gaps, wanted))
        fresh, out = self._learn(new) if new else {}, []
        for text, found in zip(texts, held):
            if found is None:
                out.append(self.whole(text) if text else b"")
                continue
            ids, gaps, wanted = found
            for i, p in zip(gaps, wanted):
                ids[i] = fresh[p]
            try:
                out.append(b"".join(ids))
            except TypeError:  # a piece with other white space
                out.append(self.whole(text))
        return out

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


#: What stands for a piece that is not in memory.
MISSING = b"\0missing"

_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder: what it remembers serves all tasks of a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _checksum(plain: bytes) -> int:
    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


def pack(frames: list[list[tuple[int | None, bytes]]]) -> bytes:
    """A file of frames, each a list of documents: id (null: none) and ids of tokens."""
    squeeze = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
    out, seek, index = [], [], []
    for docs in frames:
        n, first = len(docs), docs[0][0]
        ids = struct.pack(f"<I{n}q{n}?{n}I", n, *(i or 0 for i, _ in docs), *(i is not None for i, _ in docs), *(len(d) // 4 for _, d in docs))
        plain = ids + b"".join([d for _, d in docs])
        out.append(squeeze.compress(plain))
        seek.append(struct.pack("<III", len(out[-1]), len(plain), _checksum(plain)))
        index.append(struct.pack("<q?I", first or 0, first is not None, n))
    out.append(struct.pack("<II", INDEX, 13 * len(index)) + b"".join(index))
    seek.append(struct.pack("<III", len(out[-1]), 0, _checksum(b"")))
    body = b"".join(seek) + struct.pack("<IBI", len(seek), CHECKSUMS, SEEKABLE)
    return b"".join(out) + struct.pack("<II", SKIPPABLE, len(body)) + body


class Reader:
    """Reads chosen documents of a file that can be seeked in: the table first, then one frame at a time."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.seek(0, os.SEEK_END) if hasattr(file, "seek") else file.size()
        size = file.tell() if size is None else size
        count, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the file")
        entry = 12 if descriptor & CHECKSUMS else 8
        table = self._at(size - 9 - entry * count, entry * count)
        self.frames, self.offsets = [], [0]
        for i in range(count):
            packed, plain, *crc = struct.unpack_from("<III" if entry == 12 else "<II", table, entry * i)
            self.frames.append((plain, *crc))
            self.offsets.append(self.offsets[-1] + packed)
        index = self._at(self.offsets[-2] + 8, self.offsets[-1] - self.offsets[-2] - 8)
        self.frames.pop()
        self.first_ids, self.first = [], [0]
        for i in range(len(self.frames)):
            first, known, docs = struct.unpack_from("<q?I", index, 13 * i)
            self.first_ids.append(first if known else -(1 << 63))
            self.first.append(self.first[-1] + docs)

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def __len__(self) -> int:
        return self.first[-1]

    def frame(self, k: int) -> list[tuple[int | None, memoryview]]:
        """The documents of a frame: id, and ids of tokens as bytes."""
        plain, crc = self.frames[k]
        got = zstandard.ZstdDecompressor().decompress(self._at(self.offsets[k], self.offsets[k + 1] - self.offsets[k]), max_output_size=plain)
        if len(got) != plain or _checksum(got) != crc:
            raise ValueError(f"frame {k} is damaged")
        n = struct.unpack_from("<I", got)[0]
        head = struct.unpack_from(f"<{n}q{n}?{n}I", got, 4)
        view, at, out = memoryview(got), 4 + 13 * n, []
        for i, known, size in zip(head[:n], head[n : 2 * n], head[2 * n :]):
            out.append((i if known else None, view[at : at + 4 * size]))
            at += 4 * size
        return out

    def document(self, position: int) -> np.ndarray:
        k = bisect_right(self.first, position) - 1
        return np.frombuffer(self.frame(k)[position - self.first[k]][1], "<u4")

    def of(self, doc_id: int) -> list[np.ndarray]:
        """All documents of an id; reads only the frames that may hold it."""
        out, k = [], max(bisect_right(self.first_ids, doc_id) - 1, 0)
        while k >= 0:
            out = [np.frombuffer(d, "<u4") for i, d in self.frame(k) if i == doc_id] + out
            if self.first_ids[k] < doc_id:
                break
            k -= 1
        return out


def write_files(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Encode documents in ascending ``doc_id`` and write them to files in ``folder``.

    Documents are dealt into ranges of ``doc_id``, sorted, and packed as they pass, so a task holds one file at most. A file
    gets its name when it is complete; a task that runs again writes the same files.

    :param docs: ``doc_id, text`` and any other columns, which are ignored. Null and empty texts are one end id. Rows
        with a null ``doc_id`` come first; repeated rows are all packed, and many rows of one id are dealt over several tasks.
    :param folder: any that pyarrow's file systems reach, shared by all executors.
    :return: one row for each file: ``part, file, path, first_id, last_id, n_docs, n_tokens, n_bytes``; files in the order
        of ``part, file`` hold all documents in order.
    """
    total = docs.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    parts = min(max(1, -(-total // PART_BYTES)), MAX_PARTS)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, end = encoder(tokenizer), TaskContext.get().partitionId(), struct.pack("<I", END_ID)
        store, root = fs.FileSystem.from_uri(folder)
        file, frames, now, size, held = 0, [], [], 0, 0

        def put() -> pa.RecordBatch:
            docs, data, path, draft = [d for f in frames for d in f], pack(frames), f"{root}/part-{part:05d}-{file:05d}.zst", f"{root}/.{uuid.uuid4().hex}"
            store.create_dir(root)
            with store.open_output_stream(draft) as out:
                out.write(data)
            store.move(draft, path)
            row = [part, file, path, docs[0][0], docs[-1][0], len(docs), sum(len(d) // 4 for _, d in docs), len(data)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)

        for b in batches:
            for k in range(0, b.num_rows, TEXTS):
                some = b.slice(k, TEXTS)
                for i, got in zip(some.column("doc_id").to_pylist(), encode.many(some.column("text").to_pylist())):
                    now.append((i, got + end))
                    size += len(got) + 4
                    if size >= FRAME_BYTES:
                        frames.append(now)
                        now, held, size = [], held + size, 0
                    if held >= FILE_BYTES:
                        yield put()
                        file, frames, held = file + 1, [], 0
        if now:
            frames.append(now)
        if frames:
            yield put()

    kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 5]
    names = ["part", "file", "path", "first_id", "last_id", "n_docs", "n_tokens", "n_bytes"]
    # the number only spreads rows of one id over tasks
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("int").alias("spread")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), spread).repartitionByRange(parts, "doc_id", "spread").sortWithinPartitions("doc_id", "spread")
    return ordered.select("doc_id", "text").mapInArrow(each, "part int, file int, path string, first_id long, last_id long, n_docs long, n_tokens long, n_bytes long")


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """``part, file, doc_id, before, n_tokens, ids_crc32`` of every document, from the files' frames.

    ``before`` is the number of ids in the file before the document. A task reads one frame of a file at a time.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for part, file, path in zip(*(b.column(c).to_pylist() for c in ("part", "file", "path"))):
                with store.open_input_file(path) as source:
                    reader, at = Reader(source), 0
                    for k in range(len(reader.frames)):
                        got = reader.frame(k)
                        n, sizes = len(got), np.array([len(d) // 4 for _, d in got], np.int64)
                        before = at + np.cumsum(sizes) - sizes
                        at += int(sizes.sum())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([part] * n, pa.int32()), pa.array([file] * n, pa.int32()), pa.array([i for i, _ in got], pa.int64()), pa.array(before), pa.array(sizes), pa.array([zlib.crc32(d) for _, d in got], pa.int64())],
                            ["part", "file", "doc_id", "before", "n_tokens", "ids_crc32"],
                        )

    return files.select("part", "file", "path").mapInArrow(each, "part int, file int, doc_id long, before long, n_tokens long, ids_crc32 long")


def encoded(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write the files, read them back, and number the tokens.

    A document's start is the ids of all files before its file, from a window over one row a task (``MAX_PARTS`` at most), and
    of the documents before it in the file.

    :param folder: where the files go; None: a new folder of the shared one.
    :return: ``doc_id, start, n_tokens, ids_crc32``; none for an empty table.
    """
    folder = folder or new_path(docs.sparkSession, "token-files")
    files = written(write_files(docs, tokenizer, folder), "tokens")
    sizes = files.select("part", "file", "n_tokens")
    # a prefix sum in two steps: over the parts, then within a part
    by_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("file")) - F.col("n_tokens")
    starts = sizes.select("part", "file", inside.alias("file_start")).join(before, "part").select("part", "file", (F.col("part_start") + F.col("file_start")).alias("base"))
    found = read_files(files.repartition(max(1, files.count()), "part", "file"), folder).join(few(starts), ["part", "file"])
    return found.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(docs, public_tokenizers.path("byte_bpe_50k.json"))
