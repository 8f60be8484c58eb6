"""Token ids in files of canonical length-limited Huffman codes: independent blocks with bit-offset checkpoints.

A file holds the ids of whole documents, end to end:

    magic, u32 sizes of the two tables | zlib of the code length of each id (u8) | blocks | zlib of the document table | footer
    block: u32 ids, u32 bytes of code, u16 bits of each lane, code
    footer: u64 place, u64 first id of each block, then u64 blocks, u64 documents, u64 ids, u64 place of the document table, magic

All blocks but the last hold ``BLOCK`` ids, and a lane is ``LANE`` ids of a block, so a reader starts at any lane with what the
sums of the lanes' bits say. Lanes are decoded side by side: one table look-up gives the next id of each of them.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docqa.llm.common import table
from docqa.llm.units import Units, byte_letters, portions, ragged
from docqa.workspace import new_folder, settle

MAGIC = b"IDSHUFF1"
LIMIT = 16  # longest code; longer only if that many ids can't be told apart
BLOCK, LANE = 1 << 16, 1 << 8
AT_ONCE = 16  # blocks that are decoded side by side
PORTION = 4 << 20
END_ID = 2


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- ids ---


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def vocabulary_size(path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1)


class Words:
    """Ids of words without blanks, as ``tokenizers`` gives them for the vocabulary file.

    Words of ASCII and Latin-1 letters are cut as the file's pattern cuts them and merged by the same merges, given as ranks to
    ``tiktoken``, which takes a fifth of the time: a piece ends in a mark whose join with the last byte comes before all merges, and
    since the merges were learnt in their order, an entry is only ever met as the two parts it was made of. Other words go to
    ``tokenizers``.
    """

    END = "\n"  # no word holds a line end
    MARK = "\0"
    FAST = re.compile(r"(?!.*<\|)[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str, end_id: int):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole, self.end_id = Tokenizer.from_file(path), end_id
        with open(path) as file:
            model = json.load(file)["model"]
        letters, last = byte_letters(), model["end_of_word_suffix"]

        def raw(entry: str) -> bytes:
            ends = entry.endswith(last)
            return bytes(letters[c] for c in (entry.removesuffix(last) if ends else entry)) + self.MARK.encode() * ends

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + self.MARK.encode(): 256 + b for b in range(256)}
        of = {raw(entry): i for entry, i in model["vocab"].items()}
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks.setdefault(raw(a) + raw(b), len(ranks))
        self.ids = np.array([of.get(entry, 0) for entry in ranks], np.int32)
        self.ends = np.array([entry.endswith(self.MARK.encode()) for entry in ranks])
        self.part = tiktoken.Encoding("ranks", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        fast = np.fromiter((self.FAST.fullmatch(w) is not None for w in words), bool, len(words))
        pieces = [self.PIECE.findall(words[i].lower()) for i in np.nonzero(fast)[0].tolist()]
        made = np.array(self.part("".join([self.MARK.join(p) + self.MARK for p in pieces])), np.int64)
        last = np.nonzero(self.ends[made])[0] + 1  # where each piece ends
        last = np.concatenate([[0], last])[np.cumsum([0, *map(len, pieces)])]
        slow = [self.END if w == self.END else w for w, x in zip(words, fast.tolist()) if not x]
        other = [[self.end_id] if w == self.END else e.ids for w, e in zip(slow, self.whole.encode_batch(slow, add_special_tokens=False))]
        if not other:
            return [(self.ids[made], np.diff(last))]
        sizes = np.zeros(len(words), np.int64)
        sizes[fast], sizes[~fast] = np.diff(last), [len(x) for x in other]
        of = np.repeat(fast, sizes)
        flat = np.zeros(len(of), np.int32)
        flat[of], flat[~of] = self.ids[made], ragged(other)[0]
        return [(flat, sizes)]


def encoded(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text and the end id, as little-endian integers of ``id_type`` of the vocabulary.

    White space never is part of a token of this vocabulary, so texts are cut at blanks and line ends and each word is encoded
    once a task, as far as memory allows. A null text is empty; repeated rows and null ids stay; an empty table gives none.
    """
    path = path or vocabulary()
    kind = id_type(vocabulary_size(path, end_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(Words(path, end_id), 1)

        def words(text: str | None) -> list[str]:
            text = (text or "").replace("\n", " ")
            if text.isascii() and "<|" not in text:
                text = text.lower()  # as the vocabulary does, so that fewer words are unlike
            return [*text.split(" "), Words.END]

        for own in portions(batches, "text", PORTION):
            at, sizes = units.numbers([words(x) for x in own.column("text").to_pylist()])
            flat, n = units.rows[0].take(at)
            ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(sizes)] * np.dtype(kind).itemsize
            raw = flat.astype(kind).tobytes()
            rows = [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def id_counts(rows: DataFrame, kind: str) -> DataFrame:
    """``id, n`` over all rows of ``ids``; at most as many rows as the vocabulary has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                own = np.bincount(np.frombuffer(x.as_py(), kind))
                if len(own) > len(seen):
                    seen, own = own, seen
                seen[: len(own)] += own
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["id", "n"])

    return rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# --- codes ---


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (more if the ids need it) by package-merge; 0 without a count."""
    used = np.nonzero(counts)[0]
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    weights, packages, levels = counts[used].astype(np.int64), np.zeros(0, np.int64), []
    for _ in range(max(limit, int(len(used) - 1).bit_length())):
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(weights))
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(used) - 2
    for single in reversed(levels):
        n = int(single[:take].sum())
        lengths[used[:n]] += 1
        take = 2 * (take - n)
    return lengths


class Code:
    """The canonical code of given lengths: shorter codes first, then smaller ids."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        used = np.nonzero(lengths)[0]
        order = used[np.argsort(lengths[used], kind="stable")]
        self.bits = int(lengths.max()) if len(used) else 1
        wide = np.left_shift(1, self.bits - lengths[order].astype(np.int64))
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (np.cumsum(wide) - wide) >> (self.bits - lengths[order].astype(np.int64))
        free = (1 << self.bits) - int(wide.sum())  # only a single id leaves codes free
        self.ids = np.concatenate([np.repeat(order, wide), np.zeros(free, np.int64)]).astype(np.uint32)
        self.sizes = np.concatenate([np.repeat(lengths[order], wide), np.ones(free, np.uint8)]).astype(np.int64)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The codes end to end, most significant bit first, and the bits of each lane."""
        size = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(size)
        at = ends - size
        word = at >> 5
        # a code of at most 32 bits lies in the 64 bits that begin at its word; codes of one word are disjoint, so sums are unions
        value = self.codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
        first = np.concatenate([[0], np.nonzero(np.diff(word))[0] + 1])
        joint = np.add.reduceat(value, first)
        out = np.zeros(int(word[-1]) + 2, np.uint32)
        out[word[first]] = joint >> np.uint64(32)
        out[word[first] + 1] |= (joint & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        lanes = np.diff(np.concatenate([[0], ends[LANE - 1 :: LANE], ends[-1:] if len(ids) % LANE else []]))
        return out.astype(">u4").tobytes()[: int(-(-ends[-1] // 8))], lanes.astype("<u2")

    def decode(self, parts: list[tuple[bytes, np.ndarray, int]]) -> np.ndarray:
        """The ids of several stretches of lanes (code, first bit of each lane, ids), end to end."""
        pad = bytes(LANE * self.bits // 8 + 8)
        raw = np.frombuffer(b"".join([*(p[0] for p in parts), pad]), np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        base = np.cumsum([0, *(len(p[0]) for p in parts[:-1])]) * 8
        at = np.concatenate([p[1] + b for p, b in zip(parts, base)])
        out = np.empty((LANE, len(at)), np.uint32)
        shift, last = 32 - self.bits, (1 << self.bits) - 1
        for step in range(min(LANE, max(p[2] for p in parts))):
            seen = (window[at >> 3] >> (shift - (at & 7)).astype(np.uint32)) & np.uint32(last)
            out[step] = self.ids[seen]
            at = at + self.sizes[seen]
        whole = out.T.ravel()
        keep = np.ones(len(whole), dtype=bool)
        lane = 0
        for _, starts, n in parts:
            keep[lane * LANE + n : (lane + len(starts)) * LANE] = False
            lane += len(starts)
        return whole[keep]


# --- files ---


def file_system(folder: str):
    """The file system of a shared folder and the folder's path in it; tasks write files there, under names of their own."""
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


class Writer:
    """Writes one file; holds at most a block of ids and the document table."""

    def __init__(self, out, lengths: np.ndarray):
        self.out, self.code, self.at = out, Code(lengths), 0
        table = zlib.compress(lengths.tobytes())
        self._put(MAGIC + struct.pack("<II", len(lengths), len(table)) + table)
        self.held, self.n_held, self.n, self.blocks, self.docs = [], 0, 0, [], []

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def _block(self, ids: np.ndarray) -> None:
        raw, lanes = self.code.encode(ids)
        self.blocks += [self.at, self.n]
        self.n += len(ids)
        self._put(struct.pack("<II", len(ids), len(raw)) + lanes.tobytes() + raw)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            whole = np.concatenate(self.held)
            for k in range(0, len(whole) - BLOCK + 1, BLOCK):
                self._block(whole[k : k + BLOCK])
            rest = whole[len(whole) // BLOCK * BLOCK :].copy()
            self.held, self.n_held = [rest], len(rest)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        names, sizes = zip(*self.docs) if self.docs else ((), ())
        null = np.array([x is None for x in names], np.uint8)
        docs = zlib.compress(np.array([x or 0 for x in names], "<i8").tobytes() + np.array(sizes, "<i8").tobytes() + null.tobytes())
        place = self.at
        self._put(docs)
        self._put(np.array([*self.blocks, len(self.blocks) // 2, len(self.docs), self.n, place], "<u8").tobytes() + MAGIC)


class Reader:
    """Reads a file through its footer; ``ids`` decodes any stretch from the blocks and lanes that hold it."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail = self._get(size - 40, 40)
        if tail[32:] != MAGIC or self._get(0, 8) != MAGIC:
            raise ValueError("not a whole file of coded ids")
        blocks, self.n_docs, self.n, self.place = struct.unpack("<4Q", tail[:32])
        index = np.frombuffer(self._get(size - 40 - 16 * blocks, 16 * blocks), "<u8").astype(np.int64).reshape(-1, 2)
        self.table_end = size - 40 - 16 * blocks
        self.at, self.first = np.append(index[:, 0], self.place), index[:, 1]
        n, packed = struct.unpack("<II", self._get(8, 8))
        self.code = Code(np.frombuffer(zlib.decompress(self._get(16, packed)), np.uint8)[:n])

    def _get(self, at: int, n: int) -> bytes:
        self.file.seek(int(at))
        return self.file.read(int(n))

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        raw = zlib.decompress(self._get(self.place, self.table_end - self.place))
        n = self.n_docs
        names, sizes, null = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, np.uint8, n, 16 * n)
        return [None if z else x for x, z in zip(names.tolist(), null.tolist())], sizes

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the file."""
        end = min(start + n, self.n)
        if start >= end:
            return np.zeros(0, np.uint32)
        low, high = start // BLOCK, (end - 1) // BLOCK + 1
        raw = self._get(self.at[low], self.at[high] - self.at[low])
        parts, skip = [], start % BLOCK // LANE
        for k in range(low, high):
            at = int(self.at[k] - self.at[low])
            ids, size = struct.unpack_from("<II", raw, at)
            lanes = np.frombuffer(raw, "<u2", -(-ids // LANE), at + 8).astype(np.int64)
            at += 8 + 2 * len(lanes)
            starts = np.cumsum(lanes) - lanes
            a, b = (skip if k == low else 0), (-(-(end - k * BLOCK) // LANE) if k == high - 1 else len(lanes))
            stop = size if b >= len(lanes) else int(starts[b] + 7) // 8
            parts.append((raw[at + int(starts[a]) // 8 : at + stop], starts[a:b] - int(starts[a]) // 8 * 8, min(ids, b * LANE) - a * LANE))
        first = low * BLOCK + skip * LANE
        return self.code.decode(parts)[start - first : end - first]


def write_ids(rows: DataFrame, folder: str, size: int) -> DataFrame:
    """Writes ``rows`` (doc_id, ids as ``encoded`` gives them for a vocabulary of ``size`` ids) to files below ``folder``, by
    ascending doc_id (nulls first, rows of one id by a hash of their ids); gives and keeps the table of files.

    ``rows`` is read three times, so it should be a written table. The global counts that the code is built from go to the
    driver, at most one a vocabulary entry. Each task writes a file under a name of its own, and only files that the table lists
    count: what a lost or repeated task leaves behind is never read. Rows of one doc_id may span tasks.
    """
    kind = id_type(size)
    counts = id_counts(rows, kind).toArrow()
    total = np.zeros(size, np.int64)
    total[counts["id"].to_numpy()] = counts["n"].to_numpy()
    lengths = code_lengths(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, part = None, TaskContext.get().partitionId()
        system, path = file_system(folder)
        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                if writer is None:
                    system.create_dir(path, recursive=True)
                    name = f"{part:06d}-{uuid.uuid4().hex}.ids"
                    writer = Writer(system.open_output_stream(f"{path}/{name}"), lengths)
                writer.add(doc, np.frombuffer(raw.as_py(), kind))
        if writer is not None:
            writer.close()
            writer.out.close()
            row = {"part": part, "name": name, "n_docs": len(writer.docs), "n_ids": writer.n, "n_bytes": writer.at}
            yield pa.RecordBatch.from_pylist([row])

    order = [F.col("doc_id"), F.xxhash64("ids"), F.col("row")]
    placed = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    made = placed.select("doc_id", "ids").mapInArrow(run, "part long, name string, n_docs long, n_ids long, n_bytes long")
    made.write.parquet(f"{folder}/files")
    return rows.sparkSession.read.parquet(f"{folder}/files")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files below ``folder``, decoded from them.

    ``start`` counts the ids of all documents before it. The table of files, one row a file, is read by the driver, which lays
    out the tasks: one a file. A file is decoded ``AT_ONCE`` blocks at a time. No files give no rows.
    """
    files = sorted(spark.read.parquet(f"{folder}/files").collect(), key=lambda r: r["part"])
    starts = np.cumsum([0, *(r["n_ids"] for r in files)]).tolist()
    rows = spark.createDataFrame([(r["name"], s) for r, s in zip(files, starts)], "name string, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                with system.open_input_file(f"{path}/{name}") as file:
                    yield _digests(Reader(file), start)

    return rows.repartition(max(1, len(files))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digests(reader: Reader, start: int) -> pa.RecordBatch:
    names, sizes = reader.documents()
    ends = np.cumsum(sizes)
    crc, doc, low = np.zeros(len(sizes), np.int64), 0, 0
    while low < reader.n:
        raw = memoryview(reader.ids(low, AT_ONCE * BLOCK).astype("<u4").tobytes())
        high = low + len(raw) // 4
        at = low
        while at < high:
            stop = min(high, int(ends[doc]))
            crc[doc] = zlib.crc32(raw[4 * (at - low) : 4 * (stop - low)], int(crc[doc]))
            at = stop
            doc += stop == ends[doc]
        low = high
    cols = [pa.array(names, pa.int64()), pa.array(ends - sizes + start, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op13_huffman(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "ids")
    rows = settle(encoded(table(spark, sf_dir, "documents")), "encoded")
    write_ids(rows, folder, vocabulary_size(vocabulary(), END_ID))
    return read_documents(spark, folder)


QUERIES = {"op13_huffman": op13_huffman}
