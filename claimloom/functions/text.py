"""Text functions as column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom import config


def stripped(text: Column | str) -> Column:
    """A text without Unicode white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """The words of a text, split at Unicode white space; null for null."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """The number of words; null for null."""
    return F.when(text.isNotNull(), F.size(words(text)))


def line_count(text: Column) -> Column:
    """Line feeds plus one."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def window_starts(n: Column, size: int = config.WINDOW_WORDS, stride: int = config.STRIDE_WORDS) -> Column:
    """The first word of each window over ``n`` words: at least one window, none after the end is covered."""
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(stride)).cast("int")) * stride
    return F.sequence(F.lit(0), last, F.lit(stride))


def windows(text: Column, size: int = config.WINDOW_WORDS, stride: int = config.STRIDE_WORDS) -> Column:
    """The sliding word windows of a text, words joined by single spaces; one empty window for a text without words."""
    w = words(F.coalesce(text, F.lit("")))
    return F.transform(window_starts(F.size(w), size, stride), lambda s: F.array_join(F.slice(w, s + 1, size), " "))


def tokens(text: Column) -> Column:
    """The runs of Latin letters, digits and apostrophes."""
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9']+)"), F.lit(1))


def ngrams(text: Column, longest: int = config.NGRAM_WORDS, letters: int = config.UNIGRAM_LETTERS, stopwords: list[str] | None = None) -> Column:
    """``array<struct<n,at,span>>``: the token n-grams of a text, short ones first, without stopword-only and too short single ones; repeats stay."""
    stop = F.array(*(F.lit(w) for w in (config.STOPWORDS if stopwords is None else stopwords)))
    t = tokens(text)
    at = lambda n: F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(at(n), lambda i: F.struct(n.alias("n"), i.alias("at"), F.slice(t, i, n).alias("w")))))
    content = lambda g: ~F.forall(g["w"], lambda w: F.array_contains(stop, F.lower(w))) & ((g["n"] > 1) | (F.length(g["w"][0]) >= letters))
    return F.transform(F.filter(grams, content), lambda g: F.struct(g["n"].alias("n"), g["at"].alias("at"), F.array_join(g["w"], " ").alias("span")))


def registry_section(stem: Column) -> Column:
    """The section type of a file stem such as "3-2._materials_and_methods_entities"."""
    s = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, r"_(entities|relations)$", ""), r"^\d+-", ""), r"^[\d.]+_?", ""))
    out = F.lit("OTHER")
    for word, label in reversed(config.REGISTRY_SECTIONS):
        out = F.when(F.contains(s, F.lit(word)), label).otherwise(out)
    return out


def rich_section(header: Column) -> Column:
    """The section type of a header, by the longer list of words."""
    s = F.lower(F.trim(F.regexp_replace(header, r"^[\d.\s]+", "")))
    out = F.lit("OTHER")
    for label, keys in reversed(config.RICH_SECTIONS):
        hit = F.lit(False)
        for key in keys:
            hit = hit | F.contains(s, F.lit(key))
        out = F.when(hit, label).otherwise(out)
    return out


def section_display(stem: Column) -> Column:
    """The readable section name of a file stem."""
    s = F.regexp_replace(F.regexp_replace(stem, r"_(entities|relations)$", ""), r"^\d+-", "")
    return F.regexp_replace(F.replace(s, F.lit("_"), F.lit(" ")), r"^[ .]+|[ .]+$", "")


def section_plain(stem: Column) -> Column:
    """A section name in lower case without its numbering."""
    return F.lower(F.regexp_replace(F.regexp_replace(stem, r"^\d+-", ""), r"^[\d._\s]+", ""))


def is_skipped_section(file: Column) -> Column:
    """Whether a chunk file holds references or an appendix."""
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    name = F.regexp_replace(F.lower(F.regexp_replace(stem, r"^[^-]*-", "")), r"^[\d._\s]+", "")
    return name.rlike("^(" + "|".join(config.SKIPPED_SECTIONS) + ")(_.*)?$")


def is_content_section(header: Column) -> Column:
    """Whether a header starts content: not references, bibliography or works cited."""
    return ~F.lower(F.trim(header)).isin(config.NO_CONTENT_SECTIONS)


def safe_filename(name: Column) -> Column:
    """A name in which characters that file systems refuse are underscores."""
    return F.regexp_replace(name, r'[\\/*?:"<>|]', "_")


def natural_key(name: Column) -> Column:
    """The digit runs of a name as numbers, for natural order; [0] without digits."""
    runs = F.transform(F.regexp_extract_all(name, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("decimal(38,0)"))
    return F.when(F.size(runs) > 0, runs).otherwise(F.array(F.lit(0).cast("decimal(38,0)")))


def chunk_header(text: Column) -> Column:
    """The header in a chunk's first line; '' without one."""
    return F.trim(F.regexp_extract(text, r"^[ \t]*Header:([^\n]*)", 1))


def chunk_body(text: Column) -> Column:
    """The text after the rule of equal signs; the whole text without one."""
    return stripped(F.regexp_replace(text, r"(?s)^.*?={10,}\s*", ""))


def without_thoughts(text: Column) -> Column:
    """A model's response without its think sections."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"^\s+|\s+$", "")


def response_json(text: Column) -> Column:
    """The JSON text of a response: the first fenced json block, else the response; null if there is none or it doesn't parse."""
    s = without_thoughts(text)
    fenced = F.regexp_extract(s, r"(?s)```json\s*(.*?)\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(s)
    return F.when((body != "") & F.try_parse_json(body).isNotNull(), body)


def metadata_json(text: Column) -> Column:
    """The JSON object of a metadata response: thoughts and fences removed, from the first brace on, a wrapping "metadata" taken off."""
    s = F.regexp_replace(text, r"(?is)<thinking>.*? </thinking>", "")
    s = F.trim(F.regexp_replace(F.trim(s), r"(?im)^```(?:json)?|```$", ""))
    body = F.when(F.instr(s, "{") > 0, F.substring(s, F.instr(s, "{"), F.length(s)))
    good = F.when(F.try_parse_json(body).isNotNull(), body)
    inner = F.get_json_object(good, "$.metadata")
    return F.when(inner.startswith("{"), inner).otherwise(good)


def or_default(value: Column, default: Column | str) -> Column:
    """``value``, or the default where it is null or ''."""
    return F.coalesce(F.nullif(value, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def model_file(model: Column) -> Column:
    """The output file of a model."""
    return F.concat(F.replace(F.replace(model, F.lit(":"), F.lit("_")), F.lit("/"), F.lit("_")), F.lit(".json"))


def weight(value: Column, weights: dict[str, float], default: float) -> Column:
    """A literal lookup; unknown and null values take the default."""
    out = F.lit(default)
    for key, w in weights.items():
        out = F.when(value == key, F.lit(w)).otherwise(out)
    return out
