"""Terms counted inside each row by Arrow and numpy: the texts of a batch become flat arrays of words, pairs and counts.

Interpreted array functions take some microseconds for each token."""

from __future__ import annotations

import ctypes
import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions.stemmer import stem_flat

#: Bytes of words that are worked on at once (a longer row is a block of its own), and rows of one batch handed back.
BLOCK_BYTES, OUT_ROWS = 1 << 20, 1 << 16
#: MD5: terms hashed side by side, start values, and the constant and rotation of each step (RFC 1321).
MD5_CHUNK = 16384
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MD5_ROUNDS = [(np.uint32(int(abs(math.sin(i + 1)) * 2**32)), np.uint32(((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[i // 16][i % 4])) for i in range(64)]


#: Rows of one Arrow batch of whole texts.
IN_ROWS = 512


def mapped(df: DataFrame, run: Callable, kind: str, *args) -> DataFrame:
    """df.mapInArrow of run(schema of `kind`, *args), in batches of few rows: a worker holds a whole batch of texts."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= IN_ROWS:
        conf.set(key, str(IN_ROWS))
    return df.mapInArrow(run(to_arrow_schema(_parse_datatype_string(kind)), *args), kind)


def blocks(batches: Iterator[pa.RecordBatch], texts: list[int]) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows; texts: the columns of words or texts whose bytes count."""
    for b in batches:
        if b.num_rows:
            size = np.zeros(b.num_rows, dtype=np.int64)
            for i in texts:
                size += pc.fill_null(pc.binary_length(b.column(i)), 0).to_numpy(zero_copy_only=False)
            start, total = 0, 0
            for k, n in enumerate(size.tolist()):
                if total and total + n > BLOCK_BYTES:
                    yield b.slice(start, k - start)
                    start, total = k, 0
                total += n
            yield b.slice(start)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words between single spaces, and the row of each."""
    parts = pc.split_pattern(pc.fill_null(texts, ""), " ")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), row[full.to_numpy(zero_copy_only=False)]


def pairs_of(words: pa.Array, row: np.ndarray, joiner: str) -> tuple[pa.Array, np.ndarray]:
    """Each word joined with the next one of its row."""
    if len(words) < 2:
        return words[:0], row[:0]
    same = row[1:] == row[:-1]
    return pc.binary_join_element_wise(words[:-1], words[1:], joiner).filter(pa.array(same)), row[1:][same]


def runs(row: np.ndarray, code: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, code, n: the distinct codes (below `codes`) of each row, and how often each occurs."""
    key = np.sort(row * codes + code)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
    return key[first] // codes, key[first] % codes, np.diff(np.r_[first, len(key)])


def md5_heads(terms: pa.Array) -> np.ndarray:
    """The first four bytes of each term's MD5 digest as a little-endian number. Terms of one MD5 block (55 bytes) are hashed side by
    side, a step of the algorithm for all of a chunk at once; longer ones by hashlib."""
    heads = np.zeros(len(terms), dtype=np.uint32)
    if not len(terms):
        return heads
    offsets = np.frombuffer(terms.buffers()[1], dtype=np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    data = np.frombuffer(terms.buffers()[2], dtype=np.uint8)
    size = np.diff(offsets)
    for start in range(0, len(terms), MD5_CHUNK):
        n = np.minimum(size[start : start + MD5_CHUNK], 56)  # a longer term gets room here, and its digest below
        first, k = offsets[start : start + len(n)], np.arange(len(n))
        to = np.repeat(64 * k - np.cumsum(n) + n, n) + np.arange(n.sum())
        block = np.zeros(64 * len(n), dtype=np.uint8)
        block[to] = data[to + np.repeat(first - 64 * k, n)]
        block[64 * k + n] = 0x80
        w = np.ascontiguousarray(block.view("<u4").reshape(-1, 16).T)
        w[14] = 8 * n
        heads[start : start + len(n)] = md5_step(w)
    for i in np.flatnonzero(size > 55):
        heads[i] = int.from_bytes(hashlib.md5(data[offsets[i] : offsets[i + 1]].tobytes(), usedforsecurity=False).digest()[:4], "little")
    return heads


def md5_step(w: np.ndarray) -> np.ndarray:
    """The first word of the digests of the blocks w (16 words x blocks)."""
    a, b, c, d = (np.full(w.shape[1], x, dtype=np.uint32) for x in MD5_START)
    for i, (k, left) in enumerate(MD5_ROUNDS):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += w[g]
        f += k
        high = f >> (np.uint32(32) - left)
        f <<= left
        f |= high
        f += b
        a, d, c, b = d, c, b, f
    return a + np.uint32(MD5_START[0])


def buckets_of(terms: pa.Array, buckets: int) -> np.ndarray:
    return md5_heads(terms).astype(np.int64) % buckets


def batches_of(columns: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    got = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    yield from (got.slice(k, OUT_ROWS) for k in range(0, got.num_rows, OUT_ROWS))


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`run` for mapInArrow; at the end a task gives back to the system what it has freed, since idle workers stay in the executor."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task


def hashed(schema: pa.Schema, buckets: int):
    """For mapInArrow over (id, text of words between single spaces): id, bucket, tf, weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, [1]):
            words, at = words_of(b.column(1))
            pairs, pair_at = pairs_of(words, at, " ")
            row, bucket, n = runs(np.r_[at, pair_at], np.r_[buckets_of(words, buckets), buckets_of(pairs, buckets)], buckets)
            norm = np.sqrt(np.bincount(row, n * n, b.num_rows))
            yield from batches_of([b.column(0).take(pa.array(row)), bucket, n, n / norm[row]], schema)

    return releasing(run)


# ---- terms of the lexical index


@dataclass(frozen=True)
class Rules:
    """How the texts of one field become terms; texts come lower-case, with words between single spaces."""

    name: str
    stopwords: tuple[str, ...]
    stem: bool
    bigrams: bool
    synonyms: dict[str, list[str]] | None


@dataclass
class Counts:
    """names: the distinct terms of a block; row, code, n: how often each row has each of its terms; size: the terms of each row."""

    names: pa.Array
    row: np.ndarray
    code: np.ndarray
    n: np.ndarray
    size: np.ndarray


def tokens_of(texts: pa.Array, rules: Rules) -> tuple[pa.Array, np.ndarray]:
    words, row = words_of(texts)
    words = pc.utf8_trim(words, "'")
    keep = pc.greater(pc.binary_length(words), 0)
    if rules.stopwords:
        keep = pc.and_(keep, pc.invert(pc.is_in(words, value_set=pa.array(rules.stopwords, pa.string()))))
    words, row = words.filter(keep), row[keep.to_numpy(zero_copy_only=False)]
    words = stem_flat(words) if rules.stem else words
    if rules.bigrams:
        pairs, at = pairs_of(words, row, "_")
        words, row = pa.concat_arrays([words, pairs]), np.r_[row, at]
    return words, row


def counts_of(texts: pa.Array, rules: Rules) -> Counts:
    tokens, row = tokens_of(texts, rules)
    coded = tokens.dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if rules.synonyms:
        names, row, code = with_synonyms(names, row, code, rules.synonyms)
    row, code, n = runs(row, code, max(1, len(names)))
    n = np.ones_like(n) if rules.synonyms else n  # with synonyms a text is a set of terms
    return Counts(names, row, code, n, np.bincount(row, n, len(texts)).astype(np.int64))


def with_synonyms(names: pa.Array, row: np.ndarray, code: np.ndarray, synonyms: dict[str, list[str]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The terms, and for each term of the table what it adds."""
    keys = pa.array(list(synonyms), pa.string())
    more = pa.array(sorted({v for vs in synonyms.values() for v in vs}), pa.string())
    new = more.filter(pc.invert(pc.is_in(more, value_set=names)))
    names = pa.concat_arrays([names, new])
    at = dict(zip(more.to_pylist(), pc.index_in(more, value_set=names).to_pylist()))
    found = {i: k for k, i in zip(synonyms, pc.index_in(keys, value_set=names).to_pylist()) if i is not None}
    adds = np.zeros(len(names), dtype=bool)
    adds[list(found)] = True
    hit = adds[code]
    rows, codes, hit_row, hit_code = [row], [code], row[hit], code[hit]
    for i in np.unique(hit_code).tolist():
        who = hit_row[hit_code == i]
        for v in synonyms[found[i]]:
            rows.append(who)
            codes.append(np.full(len(who), at[v]))
    return names, np.concatenate(rows), np.concatenate(codes)


def indexed(schema: pa.Schema, fields: list[Rules], what: str, wanted: list[str] | None = None):
    """For mapInArrow over (id, the text of each field, null where the row has none): rows of `what`, of the wanted terms only.

    postings: term, id, tf, field, length; marks: term, d (ids of a block that have it), p (their postings); lengths: id, n_fields, length."""

    def kept(names: pa.Array) -> np.ndarray:
        return np.ones(len(names), dtype=bool) if wanted is None else pc.is_in(names, value_set=pa.array(wanted, pa.string())).to_numpy(zero_copy_only=False)

    def length_of(b: pa.RecordBatch, size: list[np.ndarray]) -> np.ndarray:
        """That of the last field that a row has."""
        length = np.zeros(b.num_rows, dtype=np.int64)
        for k, s in enumerate(size):
            length = np.where(b.column(k + 1).is_valid().to_numpy(zero_copy_only=False), s, length)
        return length

    def postings(b: pa.RecordBatch):
        of = [counts_of(b.column(k + 1), r) for k, r in enumerate(fields)]
        length = length_of(b, [c.size for c in of])
        for c, rules in zip(of, fields):
            if len(c.row):
                first = np.flatnonzero(np.r_[True, c.row[1:] != c.row[:-1]])
                top = np.zeros(b.num_rows, dtype=np.int64)
                top[c.row[first]] = np.maximum.reduceat(c.n, first)
                own = kept(c.names)[c.code]
                row, code, n = c.row[own], c.code[own], c.n[own]
                yield [c.names.take(pa.array(code)), b.column(0).take(pa.array(row)), 0.5 + 0.5 * n / top[row], pa.repeat(rules.name, len(row)), length[row]]

    def marks(b: pa.RecordBatch):
        of = [counts_of(b.column(k + 1), r) for k, r in enumerate(fields)]
        coded = pa.concat_arrays([c.names for c in of]).dictionary_encode()
        at, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        base = np.cumsum([0, *[len(c.names) for c in of]])
        row, code = np.concatenate([c.row for c in of]), np.concatenate([at[c.code + k] for c, k in zip(of, base)])
        p = np.bincount(code, minlength=len(names))
        d = np.bincount(runs(row, code, max(1, len(names)))[1], minlength=len(names)) if len(of) > 1 else p
        own = kept(names) & (p > 0)
        yield [names.filter(pa.array(own)), d[own], p[own]]

    def lengths(b: pa.RecordBatch):
        size = [counts_of(b.column(k + 1), r).size if r.synonyms else np.bincount(tokens_of(b.column(k + 1), r)[1], minlength=b.num_rows) for k, r in enumerate(fields)]
        n = sum(b.column(k + 1).is_valid().to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(fields)))
        yield [b.column(0), n, length_of(b, size)]

    made = {"postings": postings, "marks": marks, "lengths": lengths}[what]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, list(range(1, len(fields) + 1))):
            for columns in made(b):
                yield from batches_of(columns, schema)

    return releasing(run)
