"""Overlapping text chunks that end at sentences where possible."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTENCE_END = re.compile(r"[.!?]\s+")
REACH = 100


def chunk_spans(text: str, size: int = 500, overlap: int = 100):
    """(start, end, index, text). Each chunk starts after the one before; ends are never past the text."""
    at, number, n = 0, 0, len(text)
    while at < n:
        end = at + size
        if end < n:
            low = max(at, end - REACH)
            if m := SENTENCE_END.search(text[low : end + REACH]):
                end = low + m.end()
        piece = text[at:end].strip()
        if piece:
            yield at, min(end, n), number, piece
            number += 1
        # A sentence that ends within the overlap would start the same chunk again.
        at = max(end - overlap, at + 1) if overlap < end - at else end


def chunk(docs: DataFrame, size: int = 500, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    @F.udtf(returnType=f"doc_id {kind}, start_pos int, end_pos int, chunk_index int, chunk_text string")
    class Chunks:
        def eval(self, ident, text: str):
            for start, end, number, piece in chunk_spans(text or "", size, overlap):
                yield ident, start, end, number, piece

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.lateralJoin(Chunks(F.col("_id").outer(), F.col("_text").outer())).drop("_id", "_text")
