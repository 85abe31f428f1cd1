"""The operators on small tables: brute force, planted cases and odd rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from wellspring.llm import binary_output, bpe, common, exact_dedup, line_dedup, mixing, near_dedup, quality_crf, quality_rules, secrets, token_rollup

KIND = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (None, "a b c", "en", None, 5), (4, "word " * 4000, "fr", "s", 1), (5, "a  b c", "en", "s", 6)]


def prose(r, n):
    return " ".join("".join(r.choice("aeioutnshr") for _ in range(r.randint(2, 8))) for _ in range(n))


def corpus(seed=1):
    r = random.Random(seed)
    rows = list(ODD)
    for i in range(10, 60):
        rows.append((i, "\n".join(prose(r, r.randint(3, 30)) for _ in range(r.randint(1, 8))), r.choice(["en", "fr"]), r.choice(["s", "t"]), 0))
    for i in range(60, 90):
        words = rows[r.randint(7, 50)][1].split(" ")
        for _ in range(r.randint(0, max(1, len(words) // 25))):
            words[r.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "en", "s", 0))
    return rows


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, KIND)
    for name in ("row", "id", "h", "key", "text_key", "weight", "gone", "component") if extra else ():
        df = df.withColumn(name, F.lit("clash"))
    return df


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def test_exact_groups(docs, empty):
    rows = corpus()
    want = {}
    for i, t, *_ in rows:
        want.setdefault(normal(t), []).append(i)
    got = exact_dedup.exact_groups(docs).select("id", "keep_id", "group_size", "kept", "norm_text").collect()
    assert len(got) == len(rows)
    for r in got:
        group = want[r.norm_text]
        keep = min((x for x in group if x is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(group), r.id == keep)
    assert exact_dedup.deduplicate(docs).columns == docs.columns
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_groups_split_collisions(docs, monkeypatch):
    md5 = F.md5
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: md5(F.lit("all the same").cast("binary")))
    got = exact_dedup.exact_groups(docs).select("norm_text", "group_size").collect()
    assert {r.norm_text: r.group_size for r in got} == {t: sum(normal(x[1]) == t for x in corpus()) for t in {normal(x[1]) for x in corpus()}}


def test_bpe_and_digests(docs, empty):
    merges, enc = bpe.own_encoder(bpe.default_vocabulary())
    for r in bpe.encode_decode(docs).collect():
        assert merges.decode(r.ids) == r.decoded
    got = bpe.encode_digests(docs).collect()
    want = sorted((hashlib.sha256(enc.encode(t or "").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for _, t, *_ in corpus())
    assert sorted((r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.encode_digests(empty).count() == 0


def test_token_files(docs, empty, tmp_path):
    enc = binary_output.library_encoder(bpe.default_vocabulary())
    manifest = binary_output.write_token_files(docs, f"file://{tmp_path}/a", files=3).cache()
    got = binary_output.read_digests(manifest).collect()
    assert len(got) == len(corpus()) and sorted(p.name for p in (tmp_path / "a").iterdir()) == sorted(r.path.split("/")[-1] for r in manifest.collect())
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted((x[0] for x in corpus()), key=lambda i: (i is not None, i))
    want = sorted((zlib.crc32(enc.encode(t or "").tobytes() + b"\2\0\0\0")) for _, t, *_ in corpus())
    assert sorted(r.ids_crc32 for r in got) == want
    path = manifest.orderBy("file_no").first().path
    one = binary_output.TokenFile(path)
    everything = list(one.all())
    assert all((one.document(k) == ids).all() for k, (_, ids) in enumerate(everything))
    assert one.document(0)[-1] == 2
    import zstandard

    whole = open(path[len("file://") :], "rb").read()
    assert zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read() == b"".join(i.tobytes() for _, i in everything)
    bad = bytearray(whole)
    bad[6] ^= 255
    (tmp_path / "bad.ids").write_bytes(bytes(bad))
    with pytest.raises(Exception):
        list(binary_output.TokenFile(f"file://{tmp_path}/bad.ids").all())
    assert binary_output.read_digests(binary_output.write_token_files(empty, f"file://{tmp_path}/b")).count() == 0


def test_secrets(docs, empty):
    got = secrets.scan(docs.withColumn("text", F.concat(F.lit("password = abcdefghijkl é "), F.coalesce("text", F.lit(""))))).collect()
    assert len(got) == len(corpus()) and all(r.base[0].secret == "password = abcdefghijkl" for r in got)
    assert secrets.scan(empty).count() == 0


def test_quality_rules(docs, empty):
    got = {r.doc_id: r for r in quality_rules.judged(quality_rules.repetition(docs)).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[4].n_words == 4000 and got[4].n_repeat_words == 4000 and not got[4].kept
    assert all(r.kept for i, r in got.items() if i and 10 <= i < 60 and r.n_words >= 50)
    assert quality_rules.repetition(empty).count() == 0


def test_longest_repeat_decides_alone(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
    block, short, own = [[word() for _ in range(n)] for n in (1700, 50, 6600)]
    texts = {1: block + own + block, 2: own, 3: short + own[:400] + short}
    got = {x.doc_id: x for x in quality_rules.judged(quality_rules.repetition(frame(spark, [(i, " ".join(t), "en", "s", 0) for i, t in texts.items()]))).collect()}
    assert got[1].longest_repeat == 1700 and got[1].n_covered_words == 3400 and not got[1].base_failed
    assert {i: x.kept for i, x in got.items()} == {1: False, 2: True, 3: True}


def test_classifier_stage(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i != 4), 0) for i in range(1, 60)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    texts, marks = quality_crf.training_rows(docs, labels)
    assert len(texts) == len(marks) <= 1200
    model = quality_crf.fit(texts, marks)
    got = quality_crf.scores(docs, model)
    assert got.count() == len(corpus()) and got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    kept = quality_crf.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == got.filter("score >= 0.3").count()
    assert quality_crf.keep_good(empty, model).count() == 0
    assert quality_crf.training_rows(empty, labels) == ([], [])


def test_line_chunks(spark, docs, empty):
    r = random.Random(8)
    passage = [prose(r, 60), *[prose(r, 9) for _ in range(12)]]
    own = {i: [prose(r, 8) for _ in range(6)] for i in range(6)}
    rows = [(i, "\n".join(own[i][: i % 4] + passage + own[i][i % 4 :]), "en", "s", 0) for i in range(6)] + [(9, "\n".join(prose(r, 8) for _ in range(9)), "en", "s", 0)]
    got = {x.id: x for x in line_dedup.without_repeats(frame(spark, rows)).collect()}
    assert got[0].text == rows[0][1] and got[9].n_removed == 0
    for i in range(1, 6):
        left = got[i].text.split("\n")
        assert passage[0] not in left and sum(x in left for x in passage) <= 8 and all(x in left for x in own[i])
    whole = frame(spark, corpus())
    out = line_dedup.deduplicate(whole)
    assert out.columns == whole.columns
    again = {x.id: x.n_removed for x in line_dedup.without_repeats(whole).collect()}
    assert again[1] == 0 and again[2] == 0 and again[4] == 0
    assert {1, 2, 3, 4, None} <= {x.doc_id for x in out.collect()}
    assert line_dedup.without_repeats(empty).count() == 0


def test_line_chunks_against_brute_force(spark):
    rows = corpus(5)[7:]
    spans = line_dedup.keyed(frame(spark, rows), "doc_id", "text", 2, 25).select("id", "lines", "chunks").collect()
    seen, want = {}, {}
    for x in sorted(spans, key=lambda x: x.id):
        assert [n for c in x.chunks for n in range(c.first, c.last + 1)] == list(range(1, len(x.lines) + 1))
        left = []
        for c in x.chunks:
            t = "\n".join(x.lines[c["first"] - 1 : c["last"]])
            words = len(re.findall(r"[^\x20\x09-\x0D]+", t))
            assert words == c.words
            able = words >= 25 or (c["last"] > c["first"] and words >= 10)
            if not (able and t in seen):
                left.append(t)
            if able:
                seen.setdefault(t, x.id)
        want[x.id] = "\n".join(left)
    assert {x.id: x.text for x in line_dedup.without_repeats(frame(spark, rows)).collect()} == want


def runs_left(rows, run_words):
    """By brute force: what each document keeps where every run of run_words words that an earlier document has is removed."""
    out, before = {}, []
    for i, t, *_ in sorted(rows):
        lines, gone = t.split("\n"), set()
        size = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        for old in before:
            for a in range(len(lines)):
                for b in range(len(old)):
                    n = 0
                    while a + n < len(lines) and b + n < len(old) and lines[a + n] == old[b + n]:
                        n += 1
                    if sum(size[a : a + n]) >= run_words:
                        gone |= set(range(a, a + n))
        out[i] = "\n".join(x for n, x in enumerate(lines) if n not in gone)
        before.append(lines)
    return out


def test_line_runs_leave_no_line_untested(spark):
    r = random.Random(21)
    # No two lines meet in one chunk, or all do: the runs are removed wherever chunks end.
    passages = [[prose(r, n) for n in sizes] for sizes in ((4, 8, 17, 23), (9,) * 12, (24, 24, 3, 3), (3, 3, 60, 3, 3), (1,) * 60)]
    rows = []
    for i in range(40):
        lines = [prose(r, r.randint(1, 20)) for _ in range(3)] + passages[i % 5] + [prose(r, r.randint(1, 20)) for _ in range(3)]
        rows.append((i, "\n".join(lines), "en", "s", 0))
    rows.append((90, "\n".join(passages[1][:5]), "en", "s", 0))  # 45 words: below the bound
    want = runs_left(rows, 50)
    # Chunks alone: with modulus 1 each line is one, none of 25 words is compared.
    got = {x.id: x for x in line_dedup.without_repeats(frame(spark, rows), modulus=1, long_words=1000, run_words=50).collect()}
    assert {i: x.text for i, x in got.items()} == want and got[90].text == rows[-1][1]
    assert all(x.n_removed_lines == x.n_removed == len(passages[i % 5]) for i, x in got.items() if 5 <= i < 40)
    # The defaults and a join in place of each broadcast leave nothing of a passage either.
    for limit in (10**6, 0):
        got = {x.id: x.text.split("\n") for x in line_dedup.without_repeats(frame(spark, rows), run_words=50, limit=limit).collect()}
        for i in range(5, 40):
            assert not set(got[i]) & set(passages[i % 5]) and len(got[i]) == 6
    kept = {x.doc_id: x.text for x in line_dedup.deduplicate(frame(spark, rows)).collect()}
    assert all(not set(kept[i].split("\n")) & set(passages[i % 5]) for i in range(5, 40))


def test_mixing_meets_targets(spark, docs, empty):
    got = mixing.mixed(docs.filter("source IS NOT NULL"), {"source": 0.0, "lang": 1.0, "topic": 1.0}, budget=0.3, sweeps=30).collect()
    total, by = sum(r.n_tokens for r in got), {}
    for r in got:
        by[r.source] = by.get(r.source, 0) + r.n_tokens * r.weight
    assert all(0 <= r.weight < 1 for r in got) and by.keys() == {"s", "t"}
    assert all(abs(x - total * 0.3 / 2) < 0.01 * total for x in by.values())
    every = mixing.mixed(docs, mixing.POWERS).collect()
    assert len(every) == len(corpus()) and all(0 <= r.weight <= 1 for r in every)
    assert mixing.mix(docs).columns == docs.columns
    few = mixing.mixed(docs, mixing.POWERS, single_task_cells=0).select("id", F.round("weight", 9).alias("w"), "selected")
    many = mixing.mixed(docs, mixing.POWERS).select("id", F.round("weight", 9).alias("w"), "selected")
    assert few.exceptAll(many).count() == 0
    assert mixing.mixed(empty, mixing.POWERS).count() == 0


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]) and comp[a] > comp[b]:
                    comp[a], changed = comp[b], True
    return sets, comp


@pytest.mark.parametrize("salt_rows", [4, 256])
def test_near_components(spark, docs, empty, monkeypatch, salt_rows):
    monkeypatch.setattr(common, "SALT_ROWS", salt_rows)
    r = random.Random(12)
    base = [prose(r, 120).split() for _ in range(4)]
    rows = [x for x in corpus() if x[0] is not None]
    for i in range(200, 300):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(["x1", "x2", "x3"])
        rows.append((i, r.choice([" ", "\n"]).join(w).title() if i % 3 else " ".join(w), "en", "s", 0))
    sets, comp = brute_components(rows)
    got = near_dedup.near_groups(frame(spark, [*rows, (None, "a b c d e f", "en", "s", 1)])).collect()
    assert len(got) == len(rows) + 1
    for x in got:
        if x.doc_id is None:
            assert x.component_id is None and x.kept
        else:
            assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), comp[x.doc_id], comp[x.doc_id] == x.doc_id)
    assert near_dedup.deduplicate(docs).columns == docs.columns
    assert near_dedup.near_groups(empty).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.node: r.component for r in near_dedup.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90}


def test_rollup_deltas(spark, docs, empty, tmp_path):
    store = token_rollup.Rollup(spark, f"file://{tmp_path}/store")
    assert store.totals().count() == 0
    counts = token_rollup.word_counts(docs)
    assert store.commit("one", token_rollup.inserted(counts)) and not store.commit("one", token_rollup.inserted(counts))
    want = {}
    for i, t, g, s, _ in corpus():
        k = (s or "(none)", g or "(none)")
        n, m = want.get(k, (0, 0))
        want[k] = (n + 1, m + len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    read = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in store.totals().collect()}
    assert read() == want
    again = token_rollup.Rollup(spark, f"file://{tmp_path}/store")
    assert not again.commit("one", token_rollup.inserted(counts))
    bpe_counts = token_rollup.bpe_counts(docs).cache()
    store.commit("two", token_rollup.revised(counts, bpe_counts))
    total = sum(len(r.ids) for r in bpe.encode_decode(docs).collect())
    assert {r.tokenizer_version for r in store.totals().collect()} == {"byte_bpe_50k"} and sum(n for _, n in read().values()) == total
    before = read()
    store.compact()
    assert read() == before and not store.commit("two", token_rollup.inserted(counts))
    store.commit("three", token_rollup.deleted(bpe_counts))
    store.commit("four", token_rollup.inserted(token_rollup.word_counts(empty)))
    assert read() == {}


def test_compaction_that_ends_early_counts_nothing_twice(spark, docs, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    store, counts = token_rollup.Rollup(spark, path), token_rollup.word_counts(docs)
    read = lambda: sorted(map(tuple, token_rollup.Rollup(spark, path).totals().collect()))
    store.commit("one", token_rollup.inserted(counts))
    store.commit("two", token_rollup.inserted(counts))
    want, publish = read(), token_rollup.Rollup._publish
    monkeypatch.setattr(token_rollup.Rollup, "_publish", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.compact()
    assert read() == want
    monkeypatch.setattr(token_rollup.Rollup, "_publish", publish)
    assert store.compact() and not store.compact() and read() == want
    assert store.batches() == ["one", "two"] and not store.commit("one", token_rollup.inserted(counts))
    store.commit("three", token_rollup.deleted(counts))
    assert store.compact() and [(k, n // 2, m // 2) for *k, n, m in want] == [(k, n, m) for *k, n, m in read()]
    for n in ("one", "two", "three"):
        assert not store.commit(n, token_rollup.inserted(counts))


def test_a_batch_renamed_onto_another_is_taken_back(spark, docs, tmp_path):
    store, counts = token_rollup.Rollup(spark, f"file://{tmp_path}/store"), token_rollup.word_counts(docs)
    store.commit("one", token_rollup.inserted(counts))
    want = sorted(map(tuple, store.totals().collect()))
    staging = store._staging()
    counts.limit(1).write.parquet(staging)
    assert not store._publish(staging, f"{store.path}/batches/one") and sorted(map(tuple, store.totals().collect())) == want


def test_salted_join_keeps_all_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(k, b) for k, n in ((1, 50), (2, 3), (3, 1), (4, 9)) for b in range(n)], "a long, b long")
    one = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z"), (4, "second"), (9, "none")], "a long, wide string")
    want = sorted(map(tuple, rows.join(one, "a").select("a", "b", "wide").collect()))
    for size in (2, 4, 256):
        monkeypatch.setattr(common, "SALT_ROWS", size)
        assert sorted(map(tuple, common.join_salted(rows, one, "a", "b").select("a", "b", "wide").collect())) == want
    assert common.join_salted(rows.limit(0), one, "a", "b").count() == 0


def test_rollup_query_applies_all_deltas(spark, tmp_path, monkeypatch):
    spark.createDataFrame(corpus(), KIND).write.parquet(str(tmp_path / "documents.parquet"))
    docs, signs, commit = spark.read.parquet(str(tmp_path / "documents.parquet")), {}, token_rollup.Rollup.commit

    def noted(self, batch_id, signed):
        done = commit(self, batch_id, signed)
        if done:
            signs[batch_id] = {r.sign: r["count"] for r in signed.groupBy("sign").count().collect()}
        return done

    monkeypatch.setattr(token_rollup.Rollup, "commit", noted)
    got = sorted(map(tuple, token_rollup.op9_token_counts(spark, str(tmp_path)).select(*token_rollup.KEYS, "n_docs", "n_tokens").collect()))
    n = len(corpus())
    assert {-1: n, 1: n} in signs.values() and {-1: n} in signs.values()
    want = {}
    for r in token_rollup.word_counts(docs).unionByName(token_rollup.bpe_counts(docs)).collect():
        k = (r.source or "(none)", r.lang or "(none)", r.tokenizer_version)
        a, b = want.get(k, (0, 0))
        want[k] = (a + 1, b + (r.n_tokens or 0))
    assert got == sorted((*k, *v) for k, v in want.items())


def test_block_keys_meet_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    r = random.Random(4)
    rows = [(h, i, r.choice([0, 0, 0, i, 100 + i]), 10 + 90_000 * (h == 2)) for h in (1, 2) for i in range(20)]
    got = near_dedup.block_keys(spark.createDataFrame(rows, "head long, rep long, comp long, n long")).collect()
    tasks = {}
    for x in got:
        tasks.setdefault((x["head"], x["kind"], x["i"], x["j"]), ([], []))[x["side"]].append(x)
    met = {}
    for (h, *_), (a, b) in tasks.items():
        pairs = {frozenset((x.rep, y.rep)) for x in a for y in (b or a) if x.rep != y.rep and x.comp != y.comp}
        for p in pairs:
            met[h, p] = met.get((h, p), 0) + 1
    want = {(h, frozenset((i, j))) for h, i, c, _ in rows for g, j, d, _ in rows if h == g and i != j and c != d}
    assert set(met) == want and set(met.values()) == {1}


def test_pipeline_stages(spark, tmp_path):
    """Each stage against what its operator is defined to keep, on a small corpus; the last against the library."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(21)
    good = [(i, "\n".join(prose(r, r.randint(8, 30)) + "." for _ in range(r.randint(1, 6))), "en", r.choice(["s", "t"]), 0) for i in range(60)]
    bad = [(i, " ".join(w.upper() + "!!" for w in prose(r, 60).split()), "en", "s", 0) for i in range(60, 90)]
    copies = [(i + 200, good[i][1], "en", "t", 0) for i in range(5)]
    rows = [(i, t, g, s, len(t)) for i, t, g, s, _ in good + bad + copies]
    spark.createDataFrame(rows, KIND).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {x.doc_id: x for x in docs.collect()}
        docs = stage(spark, docs, str(tmp_path)).cache()
        kept[name] = {x.doc_id: x for x in docs.collect()}
        assert set(kept[name]) <= set(before)
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(kept["quality classifier"]) == {i for i, *_ in good + copies}
    assert all(kept["line dedup"][i].text == t for i, t, *_ in good) and all(x.n_chars == len(x.text) for x in kept["line dedup"].values())
    _, comp = brute_components([(i, x.text) for i, x in kept["line dedup"].items()])
    assert set(kept["near dedup"]) == {i for i, c in comp.items() if i == c}
    _, enc = bpe.own_encoder(bpe.default_vocabulary())
    for i, x in kept["bpe"].items():
        assert x.ids_sha256 == hashlib.sha256(enc.encode(kept["mixing"][i].text).tobytes()).hexdigest()
    assert sorted(x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(kept["bpe"])
