"""MinHash near-de-duplication with sequential Bayesian verification.

1. Every whole text becomes its set of hashed word shingles, a MinHash signature of `bands` x `rows` values (kept as
   one byte each) and one key for each band. Equal sets are collapsed to their smallest id at once (128-bit hash of the set).
2. Stars: in every bucket of a band each member is paired with the bucket's smallest id only, so a bucket costs as
   many pairs as it has members. A pair's signatures are compared batch by batch; it is pruned as soon as the posterior
   probability of a similarity at or over the threshold falls below `miss`.
3. For each text the best surviving candidate is verified exactly on the full sets; the links give first components.
4. What can still add a link: surviving star pairs between different components, and pairs of members of buckets that
   still hold several components. The latter are tested inside tasks of two bounded blocks, never as rows: the sequential test on
   signatures, then exact counts on the full sets; a task returns only links, one for each two components it joins.
   All of these are verified exactly.
5. Components of all verified links by least label and pointer jumping over tables; labels never come to the driver.

At the threshold itself a pair is no candidate in any band with probability (1 - t^r)^b, under 2e-5 for the defaults;
every link reported is exact.

Defined cases: null, empty and blank texts have no shingles, link with nothing and are their own component; with fewer
than five words the whole sequence is one shingle; rows that share an id and text are one document, and each row takes the component
of its own set; rows with a null id get a null component and stay; extra columns pass through `deduplicate`.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_salted, map_rows, materialise, maybe_broadcast, releasing, small_batches

SHINGLE, THRESHOLD = 5, (75, 100)
BANDS, ROWS = 43, 5
#: Members of one block, and about the most shingles; a task compares two blocks.
BLOCK, BLOCK_SHINGLES = 512, 400_000
_MIX = np.random.default_rng(2024).integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, table: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; A-Z in lower case, words cut at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(table.__getitem__, words), dtype=np.uint64, count=n)
    k = min(size, n)
    s = w[: n - k + 1] * _MIX[0]
    for i in range(1, k):
        s = s + w[i : n - k + 1 + i] * _MIX[i]
    return np.unique(mixed(s + np.uint64(k) * _MIX[SHINGLE]))


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = 99):
        r = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = r.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = r.integers(0, 2**32, bands * rows, dtype=np.uint32)
        self.mix = r.integers(0, 2**63, rows + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(self, s: np.ndarray) -> np.ndarray:
        x = s.astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(x), 4096):  # blocks that stay in the cache
            part = x[i : i + 4096]
            for k in range(0, len(self.a), 16):
                h = self.a[k : k + 16, None] * part[None, :] + self.b[k : k + 16, None]
                np.minimum(out[k : k + 16], h.min(1), out=out[k : k + 16])
        return out

    def keys(self, signature: np.ndarray) -> np.ndarray:
        v = signature.reshape(self.bands, self.rows).astype(np.uint64)
        s = (v * self.mix[: self.rows]).sum(1, dtype=np.uint64) + np.arange(1, self.bands + 1, dtype=np.uint64) * self.mix[self.rows]
        return mixed(s).view(np.int64)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_hi, set_lo (128-bit hash of the set), sig (one byte a value), band_keys; empty sets have no sig."""
    small_batches(docs.sparkSession)
    kind = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hi", pa.int64()), ("set_lo", pa.int64()), ("sig", pa.binary()), ("band_keys", pa.list_(pa.int64()))])

    def run(batches):
        table, signer = WordHashes(), Signer(bands, rows)
        for b in batches:
            n, hi, lo, sig, keys = [], [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, table)
                d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=">i8")
                n.append(len(s))
                hi.append(int(d[0]))
                lo.append(int(d[1]))
                if len(s):
                    v = signer.sign(s)
                    sig.append(v.astype(np.uint8).tobytes())
                    keys.append(signer.keys(v))
                else:
                    sig.append(None)
                    keys.append(np.zeros(0, dtype=np.int64))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, pa.binary()), lists], schema=kind)

    return docs.mapInArrow(releasing(run), "doc_id long, n_shingles long, set_hi long, set_lo long, sig binary, band_keys array<long>")


def prune_table(total: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(values compared, most matches at which a pair is pruned), from the posterior under a uniform prior.

    A byte of two different minima is equal once in 256 times, so values match with probability J + (1 - J) / 256."""
    j = (np.arange(4000) + 0.5) / 4000
    p = j + (1 - j) / 256
    out = []
    for n in [*range(batch, total, batch), total]:
        worst = -1
        for m in range(n + 1):
            like = m * np.log(p) + (n - m) * np.log1p(-p)
            like = np.exp(like - like.max())
            if like[j >= threshold].sum() / like.sum() >= miss:
                break
            worst = m
        out.append((n, worst))
    return out


def bayes_survivors(pairs: DataFrame, sets: DataFrame, total: int, batch: int = 32, miss: float = 1e-7) -> DataFrame:
    """pairs (a, b): those that the sequential test doesn't prune, with the matches counted."""
    one = sets.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"))
    two = sets.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))
    joined = join_salted(pairs.select("a", "b"), one, "a", "b").join(two, "b").select("a", "b", "sig_a", "sig_b")
    table = prune_table(total, batch, THRESHOLD[0] / THRESHOLD[1], miss)
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("matches", pa.int32())])

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(-1, total) for c in (2, 3))
            live, seen, done = np.arange(len(x)), np.zeros(len(x), dtype=np.int32), 0
            for n, worst in table:
                seen[live] += (x[live, done:n] == y[live, done:n]).sum(1, dtype=np.int32)
                live, done = live[seen[live] > worst], n
            if len(live):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(live)), b.column(1).take(pa.array(live)), pa.array(seen[live], pa.int32())], schema=kind)

    return joined.mapInArrow(releasing(run), "a long, b long, matches int")


def exact_links(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs (a, b) whose full shingle sets meet the threshold. Only the texts of these pairs are moved."""
    ids = pairs.select(F.col("a").alias("text_id")).unionByName(pairs.select(F.col("b").alias("text_id"))).distinct()
    texts = docs.join(maybe_broadcast(ids), docs["doc_id"] == F.col("text_id"), "left_semi").select("doc_id", "text").dropDuplicates()
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    class Sets(OrderedDict):
        table = WordHashes()

        def of(self, text):
            s = self.get(text)
            if s is None:
                if len(self) >= 64:
                    self.popitem(last=False)
                s = self[text] = shingles(text, self.table)
            return s

    def rows(sets, batch):
        out = []
        for a, b, x, y in batch:
            x, y = sets.of(x), sets.of(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both and THRESHOLD[1] * both >= THRESHOLD[0] * (len(x) + len(y) - both):
                out.append((a, b))
        return out

    joined = join_salted(pairs.select("a", "b").join(two, "b"), one, "a", "b", pairs).select("a", "b", "text_a", "text_b")
    return map_rows(joined, rows, "a long, b long", Sets)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable), for nodes with a link."""
    links = links.filter("a <> b")
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    for _ in range(most_rounds):
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = label.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        above = label.select(F.col("node").alias("low"), F.col("component").alias("higher"))
        new = low.join(above, "low", "left").select("node", "was", F.least("low", F.coalesce("higher", "low")).alias("component"))
        new = materialise(new, "labels")
        label = new.select("node", "component")
        if not new.filter("component <> was").limit(1).count():
            return label
    raise RuntimeError("components did not settle")


def fits(x, y):
    """Sizes of two sets must be within the threshold of each other for a link to be possible."""
    return F.lit(THRESHOLD[1]) * F.least(x, y) >= F.lit(THRESHOLD[0]) * F.greatest(x, y)


def block_keys(members: DataFrame) -> DataFrame:
    """members: head, rep, comp, n (shingles). Adds the tasks (kind, i, j) in which a member takes part, and its side there.

    Of each head's members those of the most frequent component are never compared with each other. The others are cut into
    blocks of BLOCK members or BLOCK_SHINGLES shingles, and so are those; each block of others meets every block of both kinds
    once. So a group that is one component but for a few texts costs its size, and no task holds more than two blocks."""
    by_comp = members.groupBy("head", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    sizes = by_comp.groupBy("head").agg(
        F.max_by(F.struct("comp", "k", "s"), F.struct("k", "comp")).alias("most"), F.sum("k").alias("k"), F.sum("s").alias("s")
    )
    parts = lambda k, s: F.ceil(F.greatest(k / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.filter(F.col("k") > F.col("most.k")).select(
        "head",
        F.col("most.comp").alias("main"),
        parts(F.col("most.k"), F.col("most.s")).alias("n_main"),
        parts(F.col("k") - F.col("most.k"), F.col("s") - F.col("most.s")).alias("n_other"),
    )
    # Read back, so that the rows of a large head are split by Spark where the sizes are too many to be broadcast.
    rows = members.join(maybe_broadcast(materialise(sizes, "open-sizes")), "head").withColumn("in_main", F.col("comp") == F.col("main"))
    at = F.pmod(F.xxhash64("rep"), F.when(F.col("in_main"), F.col("n_main")).otherwise(F.col("n_other"))).cast("int")
    rows = rows.withColumn("at", at)
    task = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda x: x < n)
    me = F.col("at")
    mine = F.concat(
        F.transform(upto(F.col("n_main")), lambda j: task(0, me, j, 0)),
        F.transform(F.filter(upto(F.col("n_other")), lambda j: j >= me), lambda j: task(1, me, j, 0)),
        F.transform(F.filter(upto(F.col("n_other")), lambda j: j < me), lambda j: task(1, j, me, 1)),
    )
    theirs = F.transform(upto(F.col("n_other")), lambda i: task(0, i, me, 1))
    return rows.withColumn("t", F.explode(F.when(F.col("in_main"), theirs).otherwise(mine))).select("head", "rep", "comp", "t.kind", "t.i", "t.j", "t.side")


class Forest(dict):
    def find(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x


def block_links(reps, comps, sides, sigs, sets, table) -> list[tuple[int, int]]:
    """Links between different components inside one task: sequential test on the signatures, then counts on the full sets."""
    first, second = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    if not len(second):
        second = first  # a block against itself
    sizes = np.array([len(s) for s in sets])
    own = np.repeat(np.arange(len(second)), sizes[second])
    values = np.concatenate([np.zeros(0, dtype=np.uint64), *[sets[k] for k in second]])
    order = np.argsort(values, kind="stable")
    values, own = values[order], own[order]
    forest, out = Forest(), []
    roots = np.array([forest.find(int(comps[k])) for k in second])
    for x in first:
        big, small = np.maximum(sizes[second], sizes[x]), np.minimum(sizes[second], sizes[x])
        live = np.flatnonzero((roots != forest.find(int(comps[x]))) & (THRESHOLD[1] * small >= THRESHOLD[0] * big))
        seen, done = np.zeros(len(live), dtype=np.int32), 0
        for n, worst in table:
            if not len(live):
                break
            seen += (sigs[second[live], done:n] == sigs[x, done:n]).sum(1, dtype=np.int32)
            keep = seen > worst
            live, seen, done = live[keep], seen[keep], n
        if not len(live):
            continue
        low, high = np.searchsorted(values, sets[x], "left"), np.searchsorted(values, sets[x], "right")
        count = high - low
        at = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        both = np.bincount(own[at], minlength=len(second))[live]
        for k in live[THRESHOLD[1] * both >= THRESHOLD[0] * (sizes[x] + sizes[second[live]] - both)]:
            a, b = forest.find(int(comps[x])), forest.find(int(comps[second[k]]))
            if a != b:
                out.append((int(reps[x]), int(reps[second[k]])))
                forest[max(a, b)] = min(a, b)
        roots = np.array([forest.find(int(c)) for c in comps[second]]) if out else roots
    return out


def links_in_blocks(members: DataFrame, sets: DataFrame, docs: DataFrame, total: int, miss: float = 1e-7) -> DataFrame:
    """Pairs (a, b) of different components among members (head, rep, comp, n) of one head that meet the threshold."""
    small_batches(docs.sparkSession)
    ids = members.select("rep").distinct()
    texts = docs.join(maybe_broadcast(ids), docs["doc_id"] == ids["rep"]).select("rep", "text").dropDuplicates(["rep"])

    def compact(batches):
        table = WordHashes()
        for b in batches:
            short = [shingles(t, table).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(short, pa.binary())], names=["rep", "words"])

    own = materialise(texts.mapInArrow(releasing(compact), "rep long, words binary").join(sets.select("rep", "sig"), "rep"), "open-sets")
    tasks = block_keys(members).join(own, "rep")
    table = prune_table(total, 32, THRESHOLD[0] / THRESHOLD[1], miss)
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        column = lambda c: group.column(c).to_numpy()
        sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, total)
        words = [np.frombuffer(w, dtype=np.uint64) for w in group.column("words").to_pylist()]
        found = block_links(column("rep"), column("comp"), column("side"), sigs, words, table)
        return pa.Table.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], schema=kind)

    return tasks.groupBy("head", "kind", "i", "j").applyInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    total = bands * rows
    signed = materialise(signatures(docs, bands, rows), "signatures")
    sets = signed.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("set_hi", "set_lo")
    sets = materialise(
        sets.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("band_keys").alias("band_keys")), "distinct-sets"
    )
    banded = sets.select("rep", "n", F.explode("band_keys").alias("key"))
    heads = banded.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("head"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", "head")
    stars = banded.join(heads, "key").filter((F.col("rep") != F.col("head.rep")) & fits(F.col("n"), F.col("head.n")))
    stars = stars.select(F.col("head.rep").alias("a"), F.col("rep").alias("b")).distinct()
    survivors = materialise(bayes_survivors(materialise(stars, "star-pairs"), sets, total), "star-survivors")
    best = materialise(survivors.groupBy("b").agg(F.max_by("a", F.struct("matches", -F.col("a"))).alias("a")), "best-pairs")
    links = materialise(exact_links(best.select("a", "b"), docs), "links-first")
    label = components(links)

    named = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_comp"))
    placed = survivors.join(named("a"), "a", "left").join(named("b"), "b", "left")
    apart = placed.filter(F.coalesce("a_comp", "a") != F.coalesce("b_comp", "b")).select("a", "b").join(best.select("a", "b"), ["a", "b"], "left_anti")

    known = sets.join(label, F.col("rep") == F.col("node"), "left").select("rep", "n", "sig", "band_keys", F.coalesce("component", "rep").alias("comp"))
    known = materialise(known, "sets-with-components")
    slim = known.select("rep", "comp", "n", F.explode("band_keys").alias("key"))
    open_buckets = slim.groupBy("key").agg(F.min("rep").alias("head"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("c"))
    open_buckets = materialise(open_buckets.filter("c > 2 AND low <> high").select("key", "head"), "open-buckets")
    members = slim.join(maybe_broadcast(open_buckets), "key").filter("rep <> head").select("head", "rep", "comp", "n").distinct()
    more = links_in_blocks(materialise(members, "open-members"), known, docs, total)
    rest = materialise(apart.unionByName(more).distinct(), "pairs-rest")
    late = materialise(exact_links(rest, docs), "links-late")
    if late.limit(1).count():
        label = components(links.unionByName(late))

    final = sets.select("set_hi", "set_lo", "rep").join(label, F.col("rep") == F.col("node"), "left")
    final = final.select("set_hi", "set_lo", F.coalesce("component", "rep").alias("component_id"))
    full = signed.filter("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "n_shingles", "set_hi", "set_lo")
    full = full.join(final, ["set_hi", "set_lo"]).select("doc_id", "n_shingles", "component_id")
    none = signed.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = full.unionByName(none)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, **params) -> DataFrame:
    """The documents that stay, one of each component, with the input's columns."""
    gone = near_groups(docs, **params).filter("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    gone = materialise(gone, "near-copies")
    return docs.join(maybe_broadcast(gone), docs["doc_id"] == F.col("gone_id"), "left_anti")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
