"""Single-process logic against brute force, exact round trips and the tokenizers library."""

import collections
import random
import re

import numpy as np
import pytest

from wellspring.llm import binary_output, bpe, near_dedup, quality_crf, quality_rules, secrets


@pytest.fixture(scope="module")
def own():
    return bpe.own_encoder(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_padding()
    t.no_truncation()
    return t


PARTS = ["a", "b", " ", "  ", "\n", "\n\n", "'s", "é", "the", "ing", "中", "!", "12", "<|endoftext|>", "\t", " '", "ab", " ", "\U0001f600", "x" * 9, "ſ", "\x85", "  \n"]


def some_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_encoding_equals_the_library(own, library):
    merges, enc = own
    texts = some_texts(4000, 1) + ["", "a" * 5000 + "bcd" * 3000, " ".join(["word"] * 3000)]
    for t, ids in zip(texts, enc.encode_batch(texts)):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
        assert merges.decode(ids.tolist()) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_pairs_of_tokens_and_failures(own):
    merges, _ = own
    r = random.Random(2)
    known = [b for b in merges.bytes if b and len(b) < 12 and b != b"<|endoftext|>"]
    pairs = [(r.choice(known), r.choice(known)) for _ in range(3000)]
    a, b = (np.array([merges.ids[p[k]] for p in pairs]) for k in (0, 1))
    for (x, y), ok, i, j in zip(pairs, merges.compatible(a, b), a.tolist(), b.tolist()):
        assert ok == (merges.exact(x + y) == [i, j])
    words = [x + y for x, y in pairs]
    assert merges.exact_many(words) == [merges.exact(w) for w in words]
    assert merges.encode_words(words) == [merges.exact(w) for w in words]
    assert merges.failed


def test_cached_library_encoder(library):
    enc = binary_output.library_encoder(bpe.default_vocabulary())
    texts = some_texts(1000, 5)
    for t, ids in zip(texts, enc.encode_batch(texts)):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def brute_repetition(t, least=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(w)
    long = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and w[i + k] == w[j + k]:
                k += 1
            long[i] = max(long[i], k)
    covered = set().union(*[range(i, i + x) for i, x in enumerate(long) if x >= least])
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    triples = set().union(*[range(i, i + 3) for i in range(n - 2) if seen[tuple(w[i : i + 3])] > 1])
    lines = t.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(triples), len(covered), max(long, default=0)


def test_repetition_against_brute_force():
    r = random.Random(3)
    texts = ["".join(r.choice(["a ", "b ", "c\n", "é ", "| ", " x y ", "\n"]) for _ in range(r.randint(0, 50))) for _ in range(250)]
    texts += ["", " \n", "one", "same " * 40, "a b c d e f g h " * 7]
    assert quality_rules.measure(texts) == [brute_repetition(t) for t in texts]
    assert quality_rules.measure([]) == []


def test_secret_spans_against_plain_patterns():
    scan = secrets.Scanner()
    r = random.Random(4)
    parts = ["password", "=", ": ", "token", '"', "abcdef0123456789", "AKIA", "ABCDEF0123456789", "AB", " ", "é", "api_key", "secret", "x1y2z3w4v5u6", "deadbeef", "ſecret", "\n"]
    for _ in range(2000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 15)))
        want = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        base, found = scan.spans(t)
        assert base == sorted(want) and set(base) <= set(found)


def test_formats_are_told_from_words():
    scan = secrets.Scanner()
    for kind, strings in secrets.labelled_credentials(200, seed=77).items():
        share = sum(map(scan.is_credential, strings)) / len(strings)
        assert share < 0.03 if kind == "none" else share > 0.9, (kind, share)
    text = "the key is sk_live_Ab3dE6gH1jK2mN4pQ5rS7t and a-plain-hyphen-word2 follows"
    _, found = scan.spans(text)
    assert [text[a:b] for a, _, b in found] == ["sk_live_Ab3dE6gH1jK2mN4pQ5rS7t"]
    assert secrets.redact(text, found).count("[SECRET]") == 1


def test_keys_without_digits_are_found():
    scan, r = secrets.Scanner(), random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    keys = ["".join(r.choice(letters) for _ in range(r.randint(20, 48))) for _ in range(200)]
    for k in keys:
        base, found = scan.spans(f"left {k} right")
        assert base == [] and found == [(5, 3, 5 + len(k))]
    for word in ("internationalization", "some-hyphenated-long-name", "snake_case_identifier", "INTERNATIONALIZATION", "=" * 40, "-" * 40, "+/" * 20):
        assert scan.spans(f"left {word} right") == ([], [])


def test_forward_backward_against_enumeration():
    r = np.random.default_rng(0)
    sizes = np.array([1, 4, 3, 6, 1])
    e, trans, start = r.normal(size=sizes.sum()), r.normal(size=(2, 2)), r.normal(size=2)
    got, moves, _ = quality_crf.marginals(e, sizes, trans, start)
    at, want, want_moves = 0, [], np.zeros((2, 2))
    for n in sizes:
        total, m, mv = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
        for code in range(2**n):
            s = [(code >> i) & 1 for i in range(n)]
            w = np.exp(start[s[0]] + sum(e[at + i] * s[i] for i in range(n)) + sum(trans[s[i], s[i + 1]] for i in range(n - 1)))
            total += w
            for i in range(n):
                m[i, s[i]] += w
            for i in range(n - 1):
                mv[s[i], s[i + 1]] += w
        want.append(m / total)
        want_moves += mv / total
        at += n
    assert np.allclose(got, np.vstack(want)) and np.allclose(moves, want_moves)


def test_classifier_learns_and_scores_any_text():
    r = random.Random(1)
    good = ["\n".join(" ".join(r.choice(["the", "on", "and", "tion", "her"]) + r.choice("abcde") for _ in range(12)) + "." for _ in range(r.randint(1, 6))) for _ in range(60)]
    bad = ["\n".join(" ".join(r.choice(["THE", "ON", "AND"]) + "!!" for _ in range(12)) for _ in range(r.randint(1, 6))) for _ in range(30)]
    model = quality_crf.fit(good[:40] + bad[:20], [1] * 40 + [0] * 20)
    s = model.score(good[40:] + bad[20:])
    assert (s[:20] > 0.5).all() and (s[20:] < 0.3).all()
    odd = model.score(["", "\n\n", "x" * 50_000, "\ud800 lone"])
    assert np.isfinite(odd).all() and ((0 <= odd) & (odd <= 1)).all()
    assert (quality_crf.fit(["a"], [1]).score(["b"]) == 0.5).all()
    assert len(model.score([])) == 0


def test_signatures_estimate_similarity():
    table, signer = near_dedup.WordHashes(), near_dedup.Signer(43, 5)
    words = [f"w{i}" for i in range(400)]
    a = near_dedup.shingles(" ".join(words), table)
    b = near_dedup.shingles(" ".join(words[40:]), table)
    same = (signer.sign(a) == signer.sign(b)).mean()
    assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.12
    assert near_dedup.shingles("One TWO three", table).tolist() == near_dedup.shingles("one\ttwo\x0bthree", table).tolist()
    assert len(near_dedup.shingles(" \n", table)) == 0 and len(near_dedup.shingles("É a", table)) == 1
    for n, worst in near_dedup.prune_table(215, 32, 0.75, 1e-7):
        assert worst < 0.75 * n


def test_links_in_blocks_against_all_pairs():
    r = random.Random(6)
    table, signer = near_dedup.WordHashes(), near_dedup.Signer(43, 5)
    prune = near_dedup.prune_table(215, 32, 0.75, 1e-7)
    base = [f"w{i}" for i in range(60)]
    sets, sigs = [], []
    for _ in range(40):
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(60)] = r.choice("abcdefgh")
        s = near_dedup.shingles(" ".join(words), table)
        sets.append(s)
        sigs.append(signer.sign(s).astype(np.uint8))
    ids, sides = np.arange(40), np.array([0] * 25 + [1] * 15)
    for side, pairs in ((sides, [(a, b) for a in range(25) for b in range(25, 40)]), (np.zeros(40, dtype=int), [(a, b) for a in range(40) for b in range(40)])):
        got, want = near_dedup.Forest(), near_dedup.Forest()
        for forest, links in ((got, near_dedup.block_links(ids, ids, side, np.stack(sigs), sets, prune)), (want, pairs)):
            for a, b in links:
                both = len(np.intersect1d(sets[a], sets[b]))
                if a != b and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = forest.find(a), forest.find(b)
                    forest[max(x, y)] = min(x, y)
        assert [got.find(i) for i in range(40)] == [want.find(i) for i in range(40)]
