"""Packing token pieces into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docqa.llm.common import table
from docqa.workspace import settle

CAPACITY = 2048
END_ID = 1
END = END_ID.to_bytes(4, "little")
PIECE = 512  # longest piece of what is left of a document after its full windows
GROUP = 256  # pieces that are differenced together, on average


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Coder:
    """Ids as ``tokenizers`` gives them for the vocabulary file, with the words of a task remembered.

    A space between two visible characters always begins a new unit of byte-level BPE, so a text may be cut there and each
    part encoded by itself. Parts not seen before are encoded from the same vocabulary as ranks, which takes a fifth of the
    time; texts with the special token's string go to ``tokenizers`` whole. ``KEEP`` bounds what is remembered.
    """

    KEEP = 300_000
    SPECIAL = "<|endoftext|>"
    CUT = re.compile(r" (?<=\S )(?=\S)")
    WIDE = re.compile(r"\s\s")

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path.removesuffix("json") + "tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.part = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, list[int]] = {}

    def _new(self, word: str) -> bytes:
        got = array("I", self.part(" " + word)).tobytes()
        if len(word) <= 32:
            self.known[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit integers."""
        if self.SPECIAL in text:
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        plain = not self.WIDE.search(text) and text[:1] != " " and text[-1:] != " "
        parts = text.split(" ") if plain else self.CUT.split(text)
        if len(self.known) > self.KEEP:
            self.known.clear()
        first = array("I", self.part(parts[0])).tobytes()
        have, new = self.known.get, self._new
        return first + b"".join([have(w) or new(w) for w in parts[1:]])

    def ids(self, text: str) -> list[int]:
        return array("I", self.encode(text)).tolist()


def pieces(docs: DataFrame, vocabulary_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``): each document's ids and the end id, cut at multiples of
    ``capacity`` and what is left at multiples of ``PIECE``, since small pieces balance well. A null text is empty: its piece is the end id. Repeated rows give repeated pieces."""
    path = vocabulary_path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own, rows = batch.slice(at, 256), []
                texts = [x or "" for x in own.column("text").to_pylist()]
                for doc, text in zip(own.column("doc_id").to_pylist(), texts):
                    ids = np.frombuffer(coder.encode(text) + END, dtype="<u4")
                    whole = len(ids) // capacity * capacity
                    for start in [*range(0, whole, capacity), *range(whole, len(ids), PIECE)]:
                        part = ids[start : start + (capacity if start < whole else PIECE)]
                        rows.append((doc, start, len(part), zlib.crc32(part), len(ids), *([part.astype("i4")] if with_ids else [])))
                cols = [pa.array(x, pa.int64()) for x in list(zip(*rows))[:5]]
                cols += [pa.array([r[5] for r in rows], pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(cols)])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Parts of near-equal sums: the two partial partitions of greatest spread are merged, largest sums onto smallest.

    A partial partition lists its parts that hold something, largest sum first; all its other parts are empty.
    """
    heap = [(-n, i, [(n, [i])]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) + len(b) <= ways:
            new = a + b
        else:
            # positions of b counted from the end meet the positions of a
            gap = ways - len(b)
            new = a[:gap] + [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[gap:], reversed(b[ways - len(a) :]))] + b[: ways - len(a)]
        new.sort(key=lambda x: -x[0])
        low = new[-1][0] if len(new) == ways else 0
        heapq.heappush(heap, (low - new[0][0], tick, new))
        tick += 1
    return [x[1] for x in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Index lists whose sums fit; the number of windows rises while any is over capacity."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, ways)
        if all(sum(sizes[i] for i in part) <= capacity for part in found):
            return found
        ways += 1


def pack(made: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``made`` (rows with ``length`` of at most ``capacity``) with ``sequence_id`` and ``offset``.

    A full piece is a window. The others are dealt into groups of about ``group`` by their place in the written table, not by
    content, so copies don't meet in one group; each group is differenced by itself. An empty table gives none.
    """
    made = settle(made, "pieces")
    names = made.columns
    rows = made.withColumn("__row", F.monotonically_increasing_id())
    full = rows.filter(F.col("length") >= capacity).select(*names, (F.col("__row") + (1 << 60)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = rows.filter(F.col("length") < capacity)
    groups = max(1, round(rest.count() / group))
    rest = rest.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)))

    def work(frame):
        frame = frame.sort_values("__row", ignore_index=True)
        sizes = frame["length"].tolist()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for w, part in enumerate(windows(sizes, capacity)):
            at = 0
            for i in part:
                sequence[i], offset[i] = (int(frame["__group"][0]) << 24) + w, at
                at += sizes[i]
        return frame.assign(sequence_id=sequence, offset=offset)[[*names, "sequence_id", "offset"]]

    schema = full.schema
    return full.unionByName(rest.groupBy("__group").applyInPandas(work, schema))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))


QUERIES = {"op6_packing": op6_packing}
