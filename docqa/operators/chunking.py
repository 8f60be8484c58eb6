"""Documents to numbered chunks, in one narrow stage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docqa.functions.text import BLANK_CHARS, document_chunks


def chunk_key(doc: Column, chunk_id: Column) -> Column:
    return F.concat_ws(":", doc.cast("string"), chunk_id.cast("string"))


def chunk_documents(
    df: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    file_name: str | None = None,
    collapse: bool = True,
) -> DataFrame:
    """Chunk rows ``(chunk_key, doc, chunk_id, chunked_text[, file_name])``.

    Chunks without content are dropped inside the array, so ``posexplode`` numbers the rest 0, 1, 2, ...
    and no window or shuffle is needed. The key is unique over all documents.
    """
    carried = [F.col(doc)] + ([F.col(file_name).alias("file_name")] if file_name else [])
    rows = df.select(*carried, F.posexplode(document_chunks(F.col(text), collapse)).alias("pos", "chunked_text"))
    return rows.select(
        chunk_key(F.col(doc), F.col("pos")).alias("chunk_key"),
        doc,
        F.col("pos").cast("bigint").alias("chunk_id"),
        "chunked_text",
        *(["file_name"] if file_name else []),
    )


def chunk_count(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Number of chunks of each document, 0 included."""
    return df.select(doc, F.size(document_chunks(F.col(text))).cast("bigint").alias("chunks"))


def chunk_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text", collapse: bool = True) -> DataFrame:
    """Chunk rows ``(chunk_key, doc, chunk_id, chunked_text)`` straight from pages: what ``chunk_documents`` makes of the assembled
    document, without ever assembling it.

    Pages are dealt by document and sorted by document and page; one pass carries the open section over page and batch ends, so a
    task holds one section and one Arrow batch, however many pages a document has. Pages of one number are taken in text
    order. Documents without any text give no chunks. A null document is a document.
    """
    order = [F.col(doc), F.col(page), F.col(text)]
    rows = pages.select(doc, page, text).repartition(doc).sortWithinPartitions(*order).select(doc, text)
    schema = T.StructType([pages.schema[doc], T.StructField("chunk_id", T.LongType()), T.StructField("chunked_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sections, now = None, None
        for batch in batches:
            names, numbers, texts = [], [], []

            def put(chunks) -> None:
                for number, chunk in chunks:
                    names.append(now)
                    numbers.append(number)
                    texts.append(chunk)

            for name, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if sections is None or name != now:
                    if sections is not None:
                        put(sections.end())
                    sections, now = Sections(collapse), name
                put(sections.add(x.as_py() or ""))
            yield _chunk_batch(names, numbers, texts, batch)
        if sections is not None:
            made = list(sections.end())
            if made:
                yield _chunk_batch([now], [made[0][0]], [made[0][1]], batch)

    made = rows.mapInArrow(run, schema)
    return made.select(chunk_key(F.col(doc), F.col("chunk_id")).alias("chunk_key"), doc, "chunk_id", "chunked_text")


def _chunk_batch(names: list, numbers: list, texts: list, like: pa.RecordBatch) -> pa.RecordBatch:
    cols = [pa.array(names, like.schema.field(0).type), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays(cols, names=[like.schema.field(0).name, "chunk_id", "chunked_text"])


class Sections:
    """The sections of one document, line by line; numbers those that have content from 0."""

    TITLE = re.compile(r"第[\s\x1c-\x1f]*\d+[\s\x1c-\x1f]*条[^\n]*")

    def __init__(self, collapse: bool):
        self.collapse, self.lines, self.number, self.first = collapse, [], 0, True

    def add(self, page: str) -> Iterator[tuple[int, str]]:
        """Chunks that a page closes; a blank page does not count."""
        if not page.strip(BLANK_CHARS):
            return
        for line in page.split("\n"):
            if line.strip(BLANK_CHARS):
                self.lines.append(line)
            elif (line or not self.collapse) and self.lines:
                yield from self.end()

    def end(self) -> Iterator[tuple[int, str]]:
        section, self.lines = "\n".join(self.lines), []
        if self.first:  # the document is stripped before it is cut
            section, self.first = section.lstrip(BLANK_CHARS), False
        found = self.TITLE.match(section)
        title = found.group().rstrip(BLANK_CHARS) if found else ""
        content = section[len(title) :].strip(BLANK_CHARS)
        if content:
            yield self.number, f"{title}:\n{content}" if title else content
            self.number += 1
