"""A suffix stemmer in the manner of Porter, as a table of rules; applied once for each distinct word.

It differs from the published algorithm on purpose: every doubled final letter but l, s, z is shortened; a final y turns
into i only after a vowel letter; in the middle steps the measure is that of the word after replacement, and the first
suffix that fits ends the step; "ion" needs no s or t before it.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Suffixes and what they become, in order.
SECOND = (
    "ational ate|tional tion|enci ence|anci ance|izer ize|abli able|alli al|entli ent|eli e|ousli ous|ization ize|ation ate|ator ate|"
    "alism al|iveness ive|fulness ful|ousness ous|aliti al|iviti ive|biliti ble"
)
THIRD = "icate ic|ative |alize al|iciti ic|ical ic|ful |ness "
FOURTH = "al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|ion|ou|ism|ate|iti|ous|ive|ize"

RULES2 = [tuple(r.split(" ")) for r in SECOND.split("|")]
RULES3 = [tuple(r.split(" ")) for r in THIRD.split("|")]
RULES4 = [(s, "") for s in FOURTH.split("|")]


def shape(word: str) -> str:
    """The word as v and c: y is a vowel after a consonant, and a consonant at the start or after a vowel."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def measure(word: str) -> int:
    return len(re.findall("v+c+", shape(word)))


def closed_syllable(word: str) -> bool:
    """Consonant, vowel letter, consonant at the end; here y never counts as a vowel."""
    return bool(re.search("[^aeiou][aeiou][^aeiou]$", word))


def replace_first(word: str, rules, least: int) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):
            changed = word[: len(word) - len(suffix)] + new
            return changed if measure(changed) > least else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    w = word.lower()
    if len(w) < 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) else w
    elif m := re.fullmatch("(.*?)(ed|ing)", w, re.DOTALL):
        if "v" in shape(m[1]):
            w = m[1]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "lsz":
                w = w[:-1]
            elif measure(w) == 1 and closed_syllable(w):
                w += "e"
    if len(w) > 2 and w[-1] == "y" and w[-2] in "aeiou":
        w = w[:-1] + "i"
    w = replace_first(w, RULES2, 0)
    w = replace_first(w, RULES3, 0)
    w = replace_first(w, RULES4, 1)
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not closed_syllable(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stem_words(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


@F.arrow_udf(ArrayType(StringType()))
def stem_arrays(words: pa.Array) -> pa.Array:
    """Each word of a batch is stemmed once; texts never become lists of Python strings."""
    n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, n.cumsum()], pa.int32()), stem_flat(words.flatten()), mask=words.is_null())


def stem_flat(words: pa.Array) -> pa.Array:
    """The stem of each word; equal words are stemmed once."""
    coded = words.dictionary_encode()
    return pa.array([w if w is None else stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def stemmed_vocabulary(words: DataFrame, word: str = "word") -> DataFrame:
    """word, stem for the distinct words only: the stemmer runs once for each word, whatever the number of rows."""
    return words.select(F.col(word).alias("word")).distinct().withColumn("stem", stem_words("word"))


def stemmed(words: Column) -> Column:
    return stem_arrays(words)
