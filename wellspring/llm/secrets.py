"""Secret scans: base patterns, and formats inferred from labelled credentials.

Inference. Labelled credentials (by kind; here generated by rule, or any list of one's own) are abstracted to character
classes and form a prefix tree with counts. States are visited in breadth-first order and merged when their outgoing and
ending frequencies agree within a Hoeffding bound, recursively (the ALERGIA test); what remains is one probabilistic
automaton for each kind. Every candidate run of credential characters in every text is scored by the mean
log-likelihood of its format under the best automaton against a background automaton of the same shape learned from
words; those above the threshold are added as spans of kind "format". Spans that lie within a base span are not repeated.

The automata are fitted on the labelled credentials given, a bounded list (`examples` for each kind), never on the corpus.

Defined cases: null and empty texts have no spans; long texts are scanned whole; rows that share an id are reported
one by one; extra columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_rows

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
KEYWORD = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A candidate has 16 characters or more of which one is a letter or digit (a ruler holds no key).
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALNUM = re.compile(r"[A-Za-z0-9]")
CLASSES = {**dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdef", "x"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"), **dict.fromkeys("ABCDEF", "X"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "U"), "_": "_", "-": "-", "+": "+", "/": "/", "=": "=", ".": "."}
TABLE = str.maketrans(CLASSES)


def labelled_credentials(examples: int = 400, seed: int = 11) -> dict[str, list[str]]:
    """Credentials by kind, made by rule, and words as the background kind "none"."""
    r = random.Random(seed)
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    kinds = {
        "access_key": lambda: "AKIA" + pick(up + dig, 16),
        "hex_digest": lambda: pick(hexa, r.choice((18, 20, 32, 40, 64))),
        "mixed_key": lambda: pick(up + low + dig, r.randint(20, 48)),
        "base64_key": lambda: pick(up + low + dig + "+/", r.choice((24, 32, 40, 44))) + "=" * r.randint(0, 2),
        "prefixed_key": lambda: pick(low, 2) + "_" + pick(low, 4) + "_" + pick(up + low + dig, r.randint(20, 36)),
        "none": lambda: r.choice((lambda: pick(low, r.randint(16, 30)), lambda: "-".join(pick(low, r.randint(2, 8)) for _ in range(r.randint(3, 6))), lambda: pick(dig, r.randint(16, 20)), lambda: "_".join(pick(low, r.randint(3, 8)) for _ in range(3)) + pick(dig, 2), lambda: pick(up, r.randint(16, 24)), lambda: "/".join(pick(low, r.randint(2, 7)) for _ in range(4)) + pick(dig, r.randint(0, 2)), lambda: pick(low, r.randint(14, 20)) + pick(dig, r.randint(1, 4))))(),
    }
    return {k: [f() for _ in range(examples)] for k, f in kinds.items()}


class Automaton:
    """A probabilistic automaton from a prefix tree by merging statistically compatible states."""

    def __init__(self, strings: list[str], alpha: float = 0.05, depth: int = 80):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.total, self.end = [0], [0]
        for s in strings:
            q = 0
            for c in s.translate(TABLE)[:depth]:
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.total.append(0)
                    self.end.append(0)
                self.total[q] += 1
                self.count[q][c] = self.count[q].get(c, 0) + 1
                q = self.next[q][c]
            self.total[q] += 1
            self.end[q] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.fold()
        self.logs = [
            {c: math.log((self.count[q].get(c, 0) + 0.1) / (self.total[q] + 1.5)) for c in set(CLASSES.values())} if self.total[q] else {} for q in range(len(self.next))
        ]

    def differ(self, n1: int, f1: int, n2: int, f2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def alike(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            if self.differ(self.total[p], self.end[p], self.total[q], self.end[q]):
                return False
            for c in self.count[q]:
                if self.differ(self.total[p], self.count[p].get(c, 0), self.total[q], self.count[q][c]):
                    return False
                if c in self.next[p] and c in self.next[q]:
                    todo.append((self.next[p][c], self.next[q][c]))
            if any(self.differ(self.total[p], n, self.total[q], 0) for c, n in self.count[p].items() if c not in self.count[q]):
                return False
        return True

    def merge(self, p: int, q: int) -> None:
        """Fold the subtree of q into p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.total[p] += self.total[q]
            self.end[p] += self.end[q]
            for c, n in self.count[q].items():
                self.count[p][c] = self.count[p].get(c, 0) + n
                if c in self.next[p]:
                    todo.append((self.next[p][c], self.next[q][c]))
                else:
                    self.next[p][c] = self.next[q][c]

    def fold(self) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            p, c = blue.pop(0)
            q = self.next[p][c]
            if q in red:
                continue
            for r in red:
                if self.alike(r, q):
                    self.next[p][c] = r
                    self.merge(r, q)
                    break
            else:
                red.append(q)
            blue = [(r, c) for r in red for c in sorted(self.next[r]) if self.next[r][c] not in red]
        self.states = red

    def score(self, symbols: str) -> float:
        """Mean log-likelihood of a symbol; steps the automaton lacks restart it at a cost."""
        q, total = 0, 0.0
        for c in symbols:
            total += self.logs[q].get(c, -6.0) if self.logs[q] else -6.0
            q = self.next[q].get(c, 0)
        return total / max(1, len(symbols))


class Scanner:
    def __init__(self, examples: int = 400, threshold: float = 0.35, credentials: dict[str, list[str]] | None = None):
        labelled = credentials or labelled_credentials(examples)
        self.automata = {k: Automaton(v) for k, v in labelled.items()}
        self.threshold = threshold
        self.seen: dict[str, bool] = {}

    def is_credential(self, s: str) -> bool:
        symbols = s.translate(TABLE)
        if symbols not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            none = self.automata["none"].score(symbols)
            self.seen[symbols] = max(a.score(symbols) for k, a in self.automata.items() if k != "none") - none > self.threshold
        return self.seen[symbols]

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans and all spans as (start, kind number, end)."""
        base = []
        if KEYWORD.search(text) and (":" in text or "=" in text):
            base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        if "AKIA" in text:
            base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
        base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        base.sort()
        more = [
            (m.start(), 3, m.end())
            for m in CANDIDATE.finditer(text)
            if ALNUM.search(m[0]) and not any(a <= m.start() and m.end() <= b for a, _, b in base) and self.is_credential(m[0])
        ]
        return base, sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, examples: int = 400, threshold: float = 0.35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, base and found (arrays of kind, start, end, secret)."""

    def rows(scanner, batch):
        out = []
        for i, t in batch:
            base, found = scanner.spans(t or "")
            out.append((i, *([{"kind": KINDS[k], "start": a, "end": b, "secret": t[a:b]} for a, k, b in x] for x in (base, found))))
        return out

    span = "array<struct<kind:string,start:int,end:int,secret:string>>"
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), rows, f"doc_id {kind}, base {span}, found {span}", lambda: Scanner(examples, threshold))


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    digest = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(digest("base").cast("binary"), 256).alias("base_sha256"),
        digest("found").alias("spans"),
    )
