"""Line de-duplication with content-defined chunks of lines and windows of lines, in DataFrame functions only.

Chunks. Every line is hashed; a rolling hash over each line and the one before it ends a chunk where it is 0 modulo
`modulus`, so boundaries depend on nearby lines alone and survive insertions elsewhere. A line of `long_words` words or
more is a chunk by itself. Chunks of two lines or more (with `min_words` words), and long lines, are compared over all
documents; of equal chunks the first by (id, line) stays and the others are removed.

Windows. With `run_words`, so are the shortest windows of two lines or more that start, or end, at each line with words
and have `run_words` words. A run of lines with so many words that an earlier place has too is exactly covered by the
windows in it, wherever chunks end: of a line and the run's lines after it, or up to it, one side has enough words, or else
the window from the run's first line reaches beyond the line. Whether a span is a window depends on its own lines alone.

Plan. Only (hash of the lines' hashes, place) is aggregated, with map-side combination, so a span that a third of all
documents share costs one row for each task. The texts of repeated hashes alone are grouped and joined by (hash, text),
which compares all bytes; the rows of a hash that many spans share are salted in that join (`SALT_ROWS` to a salt). The lines to remove go back to the documents by a broadcast when they are few, else by a join on the row key.

Defined cases: null text counts as empty and stays null; a document that loses all its words is dropped by `deduplicate`
(one that had none stays); rows equal in id and text are one document, so they do not remove each other's lines; a null
id sorts first; extra columns pass through, whatever their names. A line is removed only where an equal line stays earlier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, documents, let, materialise, maybe_broadcast, salts

#: Words of a repeated run of lines that is removed wherever chunks end (op2_line_dedup and the pipeline).
RUN_WORDS = 50
SPAN, STEP = 1 << 32, 1 << 20


def chunks(measured: Column, modulus: int, long_words: int) -> Column:
    """array<struct<pos, first, last, words>>, lines counted from 1."""

    def ends(info: Column) -> Column:
        word = lambda i: F.coalesce(F.get(info, i)["w"], F.lit(0))
        hash_ = lambda i: F.coalesce(F.get(info, i)["h"], F.lit(0).cast("long"))
        return F.filter(
            F.sequence(F.lit(1), F.size(info)),
            lambda i: (i == F.size(info))
            | (word(i - 1) >= long_words)
            | (word(i) >= long_words)
            | (F.pmod(F.xxhash64(hash_(i - 2), hash_(i - 1)), F.lit(modulus)) == 0),
        )

    def spans(info: Column, end: Column) -> Column:
        def one(e: Column, j: Column) -> Column:
            first = F.coalesce(F.get(end, j - 1), F.lit(0)) + 1
            words = F.aggregate(F.slice(info, first, e - first + 1), F.lit(0), lambda n, x: n + x["w"])
            return F.struct(j.alias("pos"), first.alias("first"), e.alias("last"), words.alias("words"))

        return F.transform(end, one)

    return let(measured, lambda info: let(ends(info), lambda end: spans(info, end)))


def span(first: Column, last: Column) -> Column:
    """A span of lines as one long: arrays of longs are made distinct by hashing, arrays of structs by comparing all pairs."""
    return first.cast("long") * SPAN + last


def windows(measured: Column, run_words: int, near: int = 8) -> Column:
    """array<long> (see span): the shortest windows of run_words words from, and up to, each line with words.

    A window has run_words lines with words at most, so each line costs a bounded look ahead and back; most windows end
    within `near` lines, so those are tried first. The state of a look is words * STEP + lines."""
    enough = run_words * STEP

    def look(part: Callable[[int], Column]) -> Column:
        reach = lambda k: F.aggregate(part(k), F.lit(0).cast("long"), lambda a, w: F.when(a >= enough, a).otherwise(a + w * STEP + 1))
        return let(reach(min(near, run_words)), lambda a: F.when(a >= enough, a).otherwise(reach(run_words)))

    def both(pos: Column, words: Column) -> Column:
        ahead = lambda i: look(lambda k: F.slice(words, i + 1, k))
        back = lambda i: look(lambda k: F.reverse(F.slice(words, F.greatest(i + 2 - k, F.lit(1)), F.least(i + 1, F.lit(k)))))
        lines = lambda a: (a % STEP).cast("int")
        none = F.lit(0).cast("long")
        after = F.transform(pos, lambda p, i: let(ahead(i), lambda a: F.when((a >= enough) & (lines(a) > 1), span(p, F.get(pos, i + lines(a) - 1))).otherwise(none)))
        before = F.transform(pos, lambda p, i: let(back(i), lambda a: F.when((a >= enough) & (lines(a) > 1), span(F.get(pos, i + 1 - lines(a)), p)).otherwise(none)))
        return F.filter(F.array_union(after, before), lambda s: s > 0)

    counted = F.transform(measured, lambda x: x["w"].cast("long"))
    filled = F.filter(F.transform(measured, lambda x, i: F.when(x["w"] > 0, i + 1).otherwise(0)), lambda p: p > 0)
    return let(counted, lambda c: let(filled, lambda pos: let(F.filter(c, lambda w: w > 0), lambda words: both(pos, words))))


def part(lines: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines, first, last - first + 1), "\n")


def keyed(docs: DataFrame, id_col: str, text_col: str, modulus: int, long_words: int) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    lines = F.split(text, "\n", -1)
    measured = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    base = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), F.xxhash64(text).alias("text_key"), lines.alias("lines")
    )
    return base.withColumn("measured", measured).withColumn("chunks", chunks(F.col("measured"), modulus, long_words))


def spans(base: DataFrame, long_words: int, min_words: int, run_words: int | None) -> DataFrame:
    """id, text_key, lines, first, last, h: one row for each chunk and window that is compared.

    Spans are hashed inside the document's row, so that what is exploded and shuffled has no array of the whole text."""
    able = F.filter("chunks", lambda c: (c["words"] >= long_words) | ((c["last"] > c["first"]) & (c["words"] >= min_words)))
    every = F.transform(able, lambda c: span(c["first"], c["last"]))
    if run_words is not None:
        every = F.array_union(every, windows(F.col("measured"), run_words))

    def hashed(hashes: Column) -> Column:
        h = lambda first, last: F.xxhash64(F.slice(hashes, first, last - first + 1))
        one = lambda first, last: F.struct(first.alias("first"), last.alias("last"), h(first, last).alias("h"))
        return F.transform(every, lambda s: one(F.shiftright(s, 32).cast("int"), s.bitwiseAND(F.lit(SPAN - 1)).cast("int")))

    found = base.select("id", "text_key", "lines", let(F.transform("measured", lambda x: x["h"]), hashed).alias("spans"))
    # The plain explode would have its whole array computed once more, in a filter on the array's size below it.
    return found.select("id", "text_key", "lines", F.explode_outer("spans").alias("s")).filter("s IS NOT NULL").select("id", "text_key", "lines", "s.first", "s.last", "s.h")


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 2, long_words: int = 25, min_words: int = 10, run_words: int | None = None, limit: int = BROADCAST_ROWS
) -> DataFrame:
    """The lines to remove: id, text_key, gone (array of line numbers from 1)."""
    base = keyed(docs, id_col, text_col, modulus, long_words)
    found = spans(base, long_words, min_words, run_words)
    seen = materialise(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "span-hashes")
    if seen.count() <= limit:
        again = found.join(F.broadcast(seen), "h")
    else:
        # Narrow rows are shuffled, and each document once: not the text of every span.
        hit = found.select("id", "text_key", "first", "last", "h").join(seen, "h")
        hit = hit.groupBy(F.col("id").alias("hit_id"), F.col("text_key").alias("hit_key")).agg(F.collect_set(F.struct("first", "last", "h", "n")).alias("hits"))
        own = base.select("id", "text_key", "lines").join(hit, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")))
        again = own.select("id", "text_key", "lines", F.explode("hits").alias("x")).select("id", "text_key", "lines", "x.first", "x.last", "x.h", "x.n")
    place = F.struct("id", "first", "text_key", "last")
    # Written once, since both sides of the join below read it.
    again = again.select("h", place.alias("place"), salts(F.col("n")).alias("salts"), part(F.col("lines"), F.col("first"), F.col("last")).alias("chunk"))
    again = materialise(again, "repeated-spans").withColumn("salt", F.pmod(F.xxhash64("place"), F.col("salts")))
    first = again.groupBy("h", "chunk").agg(F.min("place").alias("stays"), F.max("salts").alias("salts"))
    first = first.select("h", "chunk", "stays", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    gone = again.join(first, ["h", "salt", "chunk"]).filter(~F.col("place").eqNullSafe(F.col("stays")))
    by_doc = gone.groupBy(F.col("place.id").alias("id"), F.col("place.text_key").alias("text_key")).agg(F.collect_set(F.struct("place.first", "place.last")).alias("s"))
    return by_doc.select("id", "text_key", F.array_distinct(F.flatten(F.transform("s", lambda x: F.sequence(x["first"], x["last"])))).alias("gone"))


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 2, long_words: int = 25, min_words: int = 10, run_words: int | None = None, limit: int = BROADCAST_ROWS
) -> DataFrame:
    """One row per input row: row (the input as a struct), id, text (what remains), n_chunks, n_removed (chunks that lost all lines),
    n_removed_lines, emptied. Without run_words only chunks are compared."""
    gone = materialise(repeated_lines(docs, id_col, text_col, modulus, long_words, min_words, run_words, limit), "lines-to-remove")
    size = gone.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("places")).first()
    gone = gone.select(F.col("id").alias("gone_id"), F.col("text_key").alias("gone_key"), "gone")
    gone = maybe_broadcast(gone, rows=size["n"] + size["places"], limit=limit)
    base = keyed(docs, id_col, text_col, modulus, long_words)
    joined = base.join(gone, base["id"].eqNullSafe(gone["gone_id"]) & (base["text_key"] == gone["gone_key"]), "left")
    stays = F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(1), F.size("lines")), F.col("gone")))
    joined = joined.withColumn("stays", stays)
    left = F.array_join(F.transform("stays", lambda i: F.get("lines", i - 1)), "\n")
    owner = F.flatten(F.transform("chunks", lambda c: F.array_repeat(c["pos"], c["last"] - c["first"] + 1)))
    whole = let(owner, lambda o: F.size(F.array_distinct(F.transform("stays", lambda i: F.get(o, i - 1)))))
    text = F.col("row").getField(text_col)
    out = joined.select(
        "row",
        "id",
        F.when(F.col("gone").isNull(), text).otherwise(left).alias("text"),
        F.size("chunks").cast("long").alias("n_chunks"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("chunks") - whole).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("lines") - F.size("stays")).cast("long").alias("n_removed_lines"),
    )
    return out.withColumn("emptied", (F.col("n_removed_lines") > 0) & ~F.col("text").rlike(WORD))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents without repeated chunks and runs, with the input's columns; emptied documents go."""
    got = without_repeats(docs, id_col, text_col, **({"run_words": RUN_WORDS} | params)).filter("NOT emptied")
    return got.select(*[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = without_repeats(documents(spark, sf_dir).select("doc_id", "text"), run_words=RUN_WORDS)
    return got.select(F.col("id").alias("doc_id"), "n_chunks", "n_removed", "n_removed_lines", "emptied", "text")
