"""Comparable keys of free-entered names.

``match_key`` makes names equal that differ in layout, case, accents, look-alike letters, brackets, word order after a
comma, plural, spelling variant or a qualifier ("patients with", "levels"). It leaves typing errors to the similarity join.
Null gives null; a name with nothing but white space, marks and qualifiers gives its remaining words, at worst ''.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like Latin ones, spelling variants, and words around a name.
LOOKALIKES = str.maketrans("аеорсхуіАЕОРСХУІΑΒ", "aeopcxyiAEOPCXYIαβ")
VARIANTS = {"goiter": "goitre", "anemia": "anaemia", "edema": "oedema", "tumor": "tumour", "signaling": "signalling", "ab": "antibody", "α": "alpha", "β": "beta", "γ": "gamma"}
NUMERALS = {"i": "1", "l": "1", "ii": "2", "ll": "2", "iii": "3", "lll": "3", "iv": "4", "v": "5"}
LEADING = {"known", "the", "a", "an", "this", "suspected"}
TRAILING = {"level", "levels", "status"}
GENERIC_WORDS = [
    "agent", "antigen", "case", "condition", "definition", "disease", "disorder", "drug", "entity", "exposure", "factor", "finding", "index", "intervention",
    "main", "marker", "outcome", "primary", "secondary", "study", "target", "treatment", "variable",
]

_dashes = re.compile(r"[‐-―−_/-]")
_brackets = re.compile(r"\[sic\]|\(sic\)|\(human\)|[\[\](){}<>'\"“”‘’`*;:…|]")
_inverted = re.compile(r"([^,]+), *(.+)")


def _singular(word: str) -> str:
    if len(word) < 5 or word.endswith(("ss", "us", "is")) or not word.endswith("s"):
        return word
    if word.endswith("ises"):
        return word[:-2]
    return word[:-3] + "y" if word.endswith("ies") else word[:-1]


def match_key(name: str | None) -> str | None:
    """The comparable form of one name."""
    if name is None:
        return None
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", name))
    text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").translate(LOOKALIKES).lower()
    text = " ".join(_brackets.sub(" ", _dashes.sub(" ", text)).split()).strip(" .,")
    if turned := _inverted.fullmatch(text):
        text = f"{turned[2]} {turned[1]}"
    words = text.replace(",", " ").split()
    if words[:2] == ["patients", "with"] and len(words) > 2:
        words = words[2:]
    while len(words) > 1 and words[0] in LEADING:
        words = words[1:]
    while len(words) > 1 and words[-1] in TRAILING:
        words = words[:-1]
    words = [_singular(VARIANTS.get(w, w)) for w in words]
    return " ".join(NUMERALS.get(w, w) if i and words[i - 1] == "type" else VARIANTS.get(w, w) for i, w in enumerate(words))


@F.pandas_udf(T.StringType())
def match_keys(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``match_key`` over batches."""
    for batch in names:
        yield batch.map(match_key, na_action="ignore")


def is_generic(key: Column) -> Column:
    """Whether the words of a key name no entity: "study drug", "marker b"."""
    word = lambda w: w.isin(GENERIC_WORDS) | w.rlike("^[a-z0-9]$")
    return F.forall(F.split(key, " "), word)


def grams(key: Column, n: int = 3) -> Column:
    """The set of character n-grams of a key's words, each word between marks; '' and null give the empty set."""
    parts = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, n))
    words = F.filter(F.split(F.coalesce(key, F.lit("")), " "), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: parts(F.concat(F.lit("^"), w, F.lit("$"))))))


def gram_set(key: Column, n: int = 3) -> Column:
    """The set of character n-grams of a whole key between marks, white space included; '' and null give the empty set."""
    whole = F.concat(F.lit("^"), key, F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - n + 1, F.lit(1))), lambda i: F.substring(whole, i, n))
    return F.when(key.isNull() | (key == ""), F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def same_variant(a: Column, b: Column) -> Column:
    """Whether two keys agree in what tells near-alike entities apart: numbers, antibody classes, number of a code, hypo/hyper/sub."""
    both = lambda pattern, group: F.array_sort(F.regexp_extract_all(a, F.lit(pattern), group)) == F.array_sort(F.regexp_extract_all(b, F.lit(pattern), group))
    code = lambda k: F.regexp_extract(k, "^[a-z]{2,6}([0-9]+)$", 1)
    head = lambda k: F.regexp_extract(k, "(?:^| )(hypo|hyper|sub)", 1)
    return both(r"(?<![^ ])[0-9]+(?![^ ])", F.lit(0)) & both(r"\big[adegm]\b", F.lit(0)) & (code(a) == code(b)) & ((head(a) == head(b)) | (head(a) == "") | (head(b) == ""))


def letters(key: Column) -> Column:
    """How often each letter from a to z occurs in a key, as two bits each of a number (a Gray code of the count modulo 4, so one more of a letter changes one bit). Null gives null."""
    bits = F.lit(0).cast("bigint")
    for i in range(26):
        n = F.pmod(F.length(key) - F.length(F.replace(key, F.lit(chr(97 + i)), F.lit(""))), F.lit(4))
        bits = bits.bitwiseOR(F.when(n == 1, 1 << 2 * i).when(n == 2, 3 << 2 * i).when(n == 3, 2 << 2 * i).otherwise(0).cast("bigint"))
    return F.when(key.isNotNull(), bits)


def few_letters_differ(a: Column, b: Column, edits: int) -> Column:
    """Whether ``letters`` of two keys leave it open that ``edits`` edits lead from one to the other: an edit changes two bits at most."""
    return F.bit_count(a.bitwiseXOR(b)) <= 2 * edits


def same_but_for_typing(a: Column, b: Column, edits: int = 2, least: int = 8) -> Column:
    """Whether two keys differ by at most ``edits`` edits or a cut-off end. Keys under ``least`` characters must be equal."""
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    cut = F.startswith(b, a) | F.startswith(a, b)
    close = ((longer - shorter <= edits) & (F.levenshtein(a, b, edits) >= 0)) | cut
    return (a == b) | ((shorter >= least) & close & same_variant(a, b))
