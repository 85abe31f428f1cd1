"""BPE encoding and decoding by speculation: greedy longest match, vectorised pair checks, exact merging of failures.

Within a word, the merges give tokens t1..tn exactly if every adjacent pair is compatible: merging the bytes of
a pair alone gives that pair again. A pair is checked by undoing its merges from the latest to the earliest: at
each moment the fragments next to the border (a suffix of the left token, a prefix of the right one) must not have
a merge of their own that would have come first. `Merges.compatible` does that for arrays of pairs.

Whole texts are cut at single spaces between non-space characters: the word pattern can't match across such a cut
(a word takes at most one space, and only in front), so the ids of each piece are independent of its neighbours
and are kept in a bounded table. Texts with other spacing go through the word pattern as a whole.

Defined cases: null text is empty and gives no ids; the added token's string in a text gives its id, as the
tokenizers library does; texts of any length are encoded whole; rows with equal ids are separate rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_rows

#: Fixed value: the word pattern of the byte-level pre-tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept in one worker, also from task to task; the table is emptied when full, so memory stays bounded.
CACHE_PIECES = 250_000
#: White space other than the space and the line end.
OTHER_SPACE = regex.compile(r"[^\S \n]")


def byte_chars() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merges as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        as_bytes = {t: bytes(chars[c] for c in t) for t in vocab}
        self.ids = {as_bytes[t]: i for t, i in vocab.items()}
        size = 1 + max(max(vocab.values()), *self.added.values(), 0)
        self.bytes = [b""] * size
        for t, i in vocab.items():
            self.bytes[i] = as_bytes[t]
        for t, i in self.added.items():
            self.bytes[i] = t.encode()
        self.size = size
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        rank = np.arange(len(pairs), dtype=np.int64)
        self.rank = np.full(size, -1, dtype=np.int64)  # when a token is made; -1: a byte
        self.left, self.right = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        self.rank[made[::-1]], self.left[made[::-1]], self.right[made[::-1]] = rank[::-1], left[::-1], right[::-1]
        key = left * size + right
        order = np.argsort(key)
        self.key, self.key_rank = key[order], rank[order]
        self.merge = {(int(a), int(b)): (int(r), int(m)) for a, b, r, m in zip(left, right, rank, made)}
        self.quick = {int(a) << 32 | int(b): int(r) << 32 | int(m) for a, b, r, m in zip(left, right, rank, made)}
        self.longest: dict[bytes, int] = {}  # by the next three bytes
        for b in self.ids:
            self.longest[b[:3]] = max(self.longest.get(b[:3], 0), len(b))
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.single_array = np.array(self.single, dtype=np.int64)
        self.made = made
        # Hashes of byte ranges, alike at every position: sums of byte values times powers, scaled back by the inverse power.
        seeds = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
        self.byte_value = seeds * np.uint64(2) + np.uint64(1)
        self.base, self.inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
        self.powers = self.unpowers = np.ones(1, dtype=np.uint64)
        whole = sorted(self.ids)
        flat = np.frombuffer(b"".join(whole), dtype=np.uint8)
        ends = np.cumsum([len(b) for b in whole])
        starts = ends - [len(b) for b in whole]
        sums = self.prefix(flat)
        h = (sums[ends] - sums[starts]) * self.unpowers[starts]
        order = np.argsort(h)
        self.vocab_hash, self.vocab_id = h[order], np.array([self.ids[b] for b in whole], dtype=np.int64)[order]
        self.reach = np.full(1 << 24, 2, dtype=np.uint8)
        for b, n in self.longest.items():
            if len(b) == 3:
                self.reach[b[0] | b[1] << 8 | b[2] << 16] = min(n, 255)
        self.verified = 0
        self.failed = 0

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a * self.size + b
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, self.key_rank[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does merging their joined bytes give the pair itself?"""
        never = np.iinfo(np.int64).max - 1
        good = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        until_a, until_b = np.full(len(a), never), np.full(len(a), never)
        while len(live):
            r = self.pair_rank(a, b)
            # Of equal merges the one further left is first: left of the border wins over it, right of it loses.
            clash = (r < until_a) & (r <= until_b)
            good[live[clash]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~clash & ((ra >= 0) | (rb >= 0))
            live, a, b, until_a, until_b, ra, rb = (x[go] for x in (live, a, b, until_a, until_b, ra, rb))
            undo_b = rb >= ra  # the latest merge is undone first; of equal ones the right one
            until_b = np.where(undo_b, rb, until_b)
            b = np.where(undo_b, self.left[b], b)
            until_a = np.where(undo_b, until_a, ra)
            a = np.where(undo_b, a, self.right[a])
        return good

    def greedy(self, word: bytes) -> list[int]:
        out, at, n, ids, longest = [], 0, len(word), self.ids, self.longest
        while at < n:
            end = at + longest.get(word[at : at + 3], 2)
            while (t := ids.get(word[at:end])) is None:
                end = min(end, n) - 1
            out.append(t)
            at = min(end, n)
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merge by rank, leftmost first; long words with a heap over a linked list."""
        parts = list(map(self.single.__getitem__, word))
        if len(parts) <= 40:
            get, never = self.quick.get, 1 << 62
            found = [get(a << 32 | b, never) for a, b in zip(parts, parts[1:])]
            while found and (best := min(found)) != never:
                i = found.index(best)
                parts[i : i + 2] = [made := best & 0xFFFFFFFF]
                del found[i]
                if i < len(found):
                    found[i] = get(made << 32 | parts[i + 1], never)
                if i:
                    found[i - 1] = get(parts[i - 1] << 32 | made, never)
            return parts
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := self.merge.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i] if parts[i] == x else n
            if j >= n or parts[j] != y:
                continue
            parts[i], parts[j] = self.merge[x, y][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merge.get((parts[i], parts[k])):
                    heapq.heappush(heap, (m[0], i, parts[i], parts[k]))
            h = before[i]
            if h >= 0 and (m := self.merge.get((parts[h], parts[i]))):
                heapq.heappush(heap, (m[0], h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def prefix(self, flat: np.ndarray) -> np.ndarray:
        n = len(flat) + 1
        if len(self.powers) < n:
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.r_[np.uint64(1), np.full(n, self.base)])
                self.unpowers = np.cumprod(np.r_[np.uint64(1), np.full(n, self.inverse)])
        sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(self.byte_value[flat] * self.powers[: n - 1], out=sums[1:])
        return sums

    def greedy_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches of all words at once: token ids and, for each, the number of its word."""
        joined = b"".join(words)
        flat = np.frombuffer(joined + b"\0\0", dtype=np.uint8)
        sums = self.prefix(flat)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        word, at = np.arange(len(words)), np.r_[0, ends[:-1]]
        got_id, got_word = [], []
        go = at < ends
        word, at = word[go], at[go]
        last = len(self.vocab_hash) - 1
        while len(word):
            key = flat[at].astype(np.int64) | flat[at + 1].astype(np.int64) << 8 | flat[at + 2].astype(np.int64) << 16
            rest = ends[word] - at
            size = np.where(rest < 3, rest, np.minimum(self.reach[key], rest))
            token = np.full(len(word), -1, dtype=np.int64)
            todo = np.arange(len(word))
            while len(todo):
                s = at[todo]
                h = (sums[s + size[todo]] - sums[s]) * self.unpowers[s]
                k = np.minimum(np.searchsorted(self.vocab_hash, h), last)
                hit = self.vocab_hash[k] == h
                token[todo[hit]] = self.vocab_id[k[hit]]
                todo = todo[~hit]
                size[todo] -= 1
            got_id.append(token)
            got_word.append(word)
            at = at + size
            go = at < ends[word]
            word, at = word[go], at[go]
        if not got_id:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        order = np.argsort(np.concatenate(got_word), kind="stable")
        ids, word = np.concatenate(got_id)[order], np.concatenate(got_word)[order]
        if b"".join(map(self.bytes.__getitem__, ids.tolist())) != joined:  # two byte strings of one hash
            guess = [self.greedy(w) for w in words]
            return np.array(list(chain.from_iterable(guess))), np.repeat(np.arange(len(words)), list(map(len, guess)))
        return ids, word

    def exact_many(self, words: list[bytes]) -> list[list[int]]:
        """The merges of many short words, one for each word and round: always its leftmost pair of lowest rank."""
        never = np.iinfo(np.int64).max
        width = max(map(len, words))
        tokens = np.zeros((len(words), width + 1), dtype=np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        inside = np.arange(width + 1) < sizes[:, None]
        tokens[inside] = self.single_array[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ranks = np.full((len(words), width + 1), never, dtype=np.int64)
        pair = inside[:, 1:]
        ranks[:, :-1][pair] = self.pair_rank(tokens[:, :-1][pair], tokens[:, 1:][pair])
        out: list[list[int]] = [[]] * len(words)
        live, cols = np.arange(len(words)), np.arange(width + 1)
        while len(live):
            best = ranks.argmin(1)
            rank = ranks[np.arange(len(live)), best]
            done = rank == never
            if done.any():
                for i, n, t in zip(live[done].tolist(), sizes[done].tolist(), tokens[done].tolist()):
                    out[i] = t[:n]
                live, tokens, ranks, sizes, best, rank = (x[~done] for x in (live, tokens, ranks, sizes, best, rank))
            row = np.arange(len(live))
            tokens[row, best] = self.made[rank]
            # Take out the right token of the pair and the pair's own rank.
            after = np.minimum(cols + (cols > best[:, None]), width)
            tokens = np.take_along_axis(tokens, after, 1)
            ranks = np.take_along_axis(ranks, np.minimum(cols + (cols >= best[:, None]), width), 1)
            sizes = sizes - 1
            has = best + 1 < sizes
            r, c = row[has], best[has]
            ranks[r, c] = self.pair_rank(tokens[r, c], tokens[r, c + 1])
            has = best > 0
            r, c = row[has], best[has]
            ranks[r, c - 1] = self.pair_rank(tokens[r, c - 1], tokens[r, c])
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Speculate on all words, verify all adjacent pairs at once, merge only the words that fail."""
        flat, word = self.greedy_many(words)
        bounds = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        ids = flat.tolist()
        guess = [ids[i:j] for i, j in zip(bounds, bounds[1:])]
        at = np.flatnonzero(word[1:] == word[:-1])
        if len(at):
            bad = np.unique(word[at[~self.compatible(flat[at], flat[at + 1])]]).tolist()
            self.verified, self.failed = self.verified + len(words), self.failed + len(bad)
            for low, high in ((0, 10), (10, 20), (20, 40)):
                some = [w for w in bad if low < len(words[w]) <= high]
                for w, t in zip(some, self.exact_many([words[w] for w in some]) if some else ()):
                    guess[w] = t
            for w in bad:
                if len(words[w]) > 40:
                    guess[w] = self.exact(words[w])
        return guess

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class PieceEncoder:
    """Encodes whole texts through a bounded table of pieces.

    fill: the packed ids of each of some pieces, which begin with their only white space; whole: the ids of any text."""

    def __init__(self, fill, added: dict[str, int], whole, most: int = CACHE_PIECES):
        self.fill, self.whole, self.kept, self.most = fill, whole, {}, most
        self.added = added
        self.mark = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None

    @staticmethod
    def pieces(text: str) -> list[str] | None:
        """Cut at single spaces and single line ends between non-space characters; None if other spacing makes that unsafe.

        A piece stands for a space and its characters, or, if it starts with a line end, for just its characters.
        The first piece gets a line end in front, whose one id `encode_batch` takes off again.
        """
        if OTHER_SPACE.search(text) or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
            return None
        return f" \n{text.replace('\n', ' \n')}".split(" ")[1:]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The missing pieces of all texts are filled at once, so that checks run on long arrays."""
        runs: list[tuple[int, list[str] | None, str | int]] = []  # text, pieces, plain text or id of an added token
        for n, text in enumerate(texts):
            at = 0
            for m in self.mark.finditer(text) if self.mark and any(a in text for a in self.added) else ():
                if m.start() > at:
                    runs.append((n, self.pieces(part := text[at : m.start()]), part))
                runs.append((n, None, self.added[m[0]]))
                at = m.end()
            if at < len(text):
                runs.append((n, self.pieces(part := text[at:] if at else text), part))
        kept = self.kept
        if len(kept) > self.most:
            kept.clear()
        new = list(set().union(*[p for _, p, _ in runs if p]).difference(kept))
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            kept.update(zip(some, self.fill([p if p[0] == "\n" else " " + p for p in some])))
        out: list[list[bytes]] = [[] for _ in texts]
        for n, p, plain in runs:
            if isinstance(plain, int):
                out[n].append(packed([plain]))
            elif p is None:
                out[n].append(packed(list(self.whole(plain))))
            else:
                out[n].append(b"".join(map(kept.__getitem__, p))[4:])
        return [np.frombuffer(b"".join(x), dtype="<u4") for x in out]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]


@lru_cache(maxsize=1)
def own_encoder(path: str) -> tuple[Merges, PieceEncoder]:
    merges, words = Merges(path), regex.compile(WORDS)

    def fill(pieces: list[str]) -> list[bytes]:
        # Each piece begins with its only white space, so a word with white space in front begins a piece.
        text = words.findall("".join(pieces))
        distinct = list(dict.fromkeys(text))
        ids = dict(zip(distinct, map(packed, merges.encode_words([w.encode() for w in distinct]))))
        out: list[bytes] = []
        for w in text:
            if w[0] in " \n":
                out.append(ids[w])
            else:
                out[-1] += ids[w]
        return out

    def whole(text: str) -> list[int]:
        return list(chain.from_iterable(merges.encode_words([w.encode() for w in words.findall(text)])))

    return merges, PieceEncoder(fill, merges.added, whole)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array<int>), decoded (string)."""

    def setup(path=vocabulary):
        return own_encoder(path or default_vocabulary())

    def rows(state, batch):
        merges, enc = state
        coded = [ids.tolist() for ids in enc.encode_batch([t or "" for _, t in batch])]
        return [(i, ids, merges.decode(ids)) for (i, _), ids in zip(batch, coded)]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), rows, f"doc_id {kind}, ids array<int>, decoded string", setup)


def encode_digests(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_decode, with digests in place of ids and texts, taken in the same worker so that ids need not travel."""

    def setup(path=vocabulary):
        return own_encoder(path or default_vocabulary())

    def rows(state, batch):
        merges, enc = state
        out = []
        for (i, _), ids in zip(batch, enc.encode_batch([t or "" for _, t in batch])):
            text = merges.decode(ids.tolist())
            out.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), rows, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", setup)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir)).select("doc_id", F.col("n_tokens").cast("long"), "ids_sha256", "decoded_sha256")
