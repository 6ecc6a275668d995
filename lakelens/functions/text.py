"""Sanitizing, tokenizers, sentence and citation functions as columns (TK1-TK11, CH1, CH2, CH8).

Every pattern carries (?U): word characters and boundaries are Unicode-aware. Only NFKC and the sentence splitter need
Python, as Arrow-batched pandas UDFs; all else stays in the JVM.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# ---- fixed values: they decide results and are given by the engine's contract ----
ZERO_WIDTH = "[\\u200B-\\u200D\\uFEFF\\u200E\\u200F\\u202A-\\u202E]"
LLM_DELIMITERS = ["<|im_start|>", "<|im_end|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|system|>", "<|user|>", "<|assistant|>"]
STOPWORDS = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can "
    "can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't "
    "have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is "
    "isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves "
    "out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves "
    "then there there's these they they'd they'll they're they've this those through to too under until up very was wasn't we we'd "
    "we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's with won't would "
    "wouldn't you you'd you'll you're you've your yours yourself yourselves according stated provides mentioned per based"
).split()
EVAL_STOPWORDS = (
    "a an the and or but if then in on at to for of with by is are was were be been being have has had do does did this that these "
    "those it its what which who whom whose when where why how all any both each few more most other some such no nor not only own "
    "same so than too very can will just should now"
).split()
ABBREVIATIONS = frozenset("mr mrs ms dr prof inc ltd corp dept sec no fig e.g i.e vs hrs min jan feb mar apr jun jul aug sep sept oct nov dec p.m a.m al etc".split())
SUFFIXES = ["ation", "tion", "ing", "ies", "es", "ed", "s"]
CITATION = r"(?i)\[(?:Source|Doc)s?\s*(?::\s*)?([0-9\s,]+(?:and\s*\d+)?)\]"
BM25_TOKEN = r"(?U)\$?\w+(?:-\w+)*"
GROUNDING_TOKEN = r"(?U)\b[a-zA-Z0-9_\$]+\b"
EVAL_TOKEN = r"(?U)\b\w+\b"
GROUNDING_NUMBER = r"(?U)\b\d+(?:\.\d+)?\b|\$\d+"
EVAL_NUMBER = r"(?U)\b\d+(?:\.\d+)?\b"
# ---- end of fixed values ----


def words_array(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def sanitize(text: Column, normalize: bool = True) -> Column:
    """Normalised, de-fanged text: no NUL or zero-width characters, model delimiters escaped, at most one blank line."""
    out = F.coalesce(nfkc(text) if normalize else text, F.lit(""))
    out = F.regexp_replace(F.regexp_replace(out, "\\x00", ""), ZERO_WIDTH, "")
    for mark in LLM_DELIMITERS:
        safe = mark.replace("<", "&lt;").replace(">", "&gt;").replace("[", "&#91;").replace("]", "&#93;")
        out = F.replace(out, F.lit(mark), F.lit(safe))
    out = F.replace(F.replace(out, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(out, "\\n{3,}", "\n\n"), "(?U)^\\s+|\\s+$", "")


def checksum(text: Column) -> Column:
    return F.sha2(text, 256)


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4.0)).cast("long")


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def bm25_tokens(text: Column) -> Column:
    return F.transform(found(text, BM25_TOKEN), F.lower)


def grounding_tokens(text: Column) -> Column:
    return found(F.lower(text), GROUNDING_TOKEN)


def content_words(tokens: Column, stopwords: list[str]) -> Column:
    return F.filter(F.array_except(tokens, words_array(stopwords)), lambda w: F.length(w) > 1)


def grounding_words(text: Column) -> Column:
    return content_words(grounding_tokens(text), STOPWORDS)


def grounding_numbers(text: Column) -> Column:
    return F.array_distinct(found(F.lower(text), GROUNDING_NUMBER))


def eval_tokens(text: Column) -> Column:
    return F.transform(found(text, EVAL_TOKEN), F.lower)


def eval_words(text: Column) -> Column:
    return content_words(eval_tokens(text), EVAL_STOPWORDS)


def eval_numbers(text: Column) -> Column:
    return F.array_distinct(found(text, EVAL_NUMBER))


def stem(word: Column) -> Column:
    """Without the first suffix that fits and leaves more than two letters."""
    out = F.when(F.lit(False), word)
    for suffix in SUFFIXES:
        out = out.when(word.endswith(suffix) & (F.length(word) > len(suffix) + 2), F.substring(word, 1, F.length(word) - len(suffix)))
    return out.otherwise(word)


def rerank_words(text: Column) -> Column:
    return F.array_distinct(found(F.lower(text), r"(?U)\w+"))


def word_count_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.size(found(text, r"\S+")))


def bigrams(tokens: Column) -> Column:
    n = F.size(tokens)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.get(tokens, i - 1), F.lit("_"), F.get(tokens, i)))
    return F.when(n > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def source_indices(text: Column) -> Column:
    """Ascending distinct numbers inside citation tags."""
    inside = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    numbers = F.flatten(F.transform(inside, lambda t: F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0))))
    return F.array_sort(F.array_distinct(F.transform(numbers, lambda n: n.cast("int"))))


def strip_citations(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, CITATION, ""), r"(?U)\s+([.,!?;:])", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", " "), "^ | $", "")


_BULLET, _BREAK = re.compile(r"^[-*•]\s+|\d+\.\s+"), re.compile(r"[.!?]+(?:\s+|$)")


def split_sentences(text: str | None) -> list[str]:
    """Sentences of over five characters; a break needs no abbreviation before it and no lower-case letter after it."""
    out: list[str] = []
    for line in (text or "").splitlines():
        line = _BULLET.sub("", line.strip()).strip()
        start = piece = 0
        for mark in _BREAK.finditer(line):
            before = line[start : mark.start()].split()
            word = re.sub(r"[^\w.]", "", before[-1].lower()) if before else ""
            following = _BREAK.split(line[mark.end() :], maxsplit=1)[0].strip()
            piece = mark.end()
            if word in ABBREVIATIONS or word.rstrip(".") in ABBREVIATIONS or following[:1].islower():
                continue
            out.append(line[start:piece].strip())
            start = piece
        out.append(line[start:].strip())
    return [s for s in out if len(s) > 5]


@F.pandas_udf(ArrayType(StringType()))
def sentences(text: pd.Series) -> pd.Series:
    return text.map(split_sentences)


def python_title(stem_name: str) -> str:
    """A file stem as a title: underscores to spaces, upper case after every non-letter."""
    return stem_name.replace("_", " ").title()
