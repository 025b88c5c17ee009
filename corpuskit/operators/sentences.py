"""Sentences of a text with their offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that never end a sentence, and those that do unless it runs on.
ALWAYS = {
    "dr.", "mr.", "mrs.", "ms.", "st.", "prof.", "sr.", "jr.", "mt.", "vs.", "cf.", "fig.", "no.", "e.g.", "i.e.",
}
SOMETIMES = {
    "a.m.", "p.m.", "etc.", "approx.", "jan.", "feb.", "mar.", "apr.", "jun.", "jul.", "aug.", "sep.", "sept.",
    "oct.", "nov.", "dec.",
}
# Where a long sentence may be cut, what may open a word, and what ends a sentence.
SOFT = ",;:，、；：،؛"
OPENERS = "(\"'“‘["
_PIECE = re.compile(r"[^.!?。！？]+(?:[.!?。！？]+|$)")
_LOOSE = re.compile(r"[0-9]+\.|(?:[^\W\d_]\.){2,}")


def _joins(word: str, following: str) -> bool:
    """Whether a sentence that ends in ``word`` goes on with the character ``following``."""
    word = word.lstrip(OPENERS)
    if word.lower() in ALWAYS or len(word) == 2 and word[0].isupper() and word[1] == ".":
        return True
    goes_on = following.islower() or following in tuple("0123456789")
    return goes_on and (word.lower() in SOMETIMES or _LOOSE.fullmatch(word) is not None)


@lru_cache(maxsize=8)
def _cuts(limit: int) -> re.Pattern:
    """The longest part up to ``limit``, from its half on: behind a soft break, before a blank, or anywhere."""
    half = limit // 2
    return re.compile(
        rf".{{{half},{limit - 1}}}[{SOFT}](?![0-9])|.{{{half + 1},{limit}}}(?=\s)|.{{{limit}}}", re.S
    )


def _spans(text: str, limit: int | None) -> Iterator[tuple[int, int]]:
    """Sentences with the blanks at their ends, parts of at most ``limit`` characters if given."""
    begin = stop = None
    for piece in [*_PIECE.finditer(text), None]:
        first = None if piece is None else piece.group().lstrip()[:1]
        if first == "":
            continue
        if begin is not None:
            words = text[begin:stop].split()
            if first is not None and _joins(words[-1], first):
                stop = piece.end()
                continue
            if limit is not None:
                begin += len(text[begin:stop]) - len(text[begin:stop].lstrip())
                while len(text[begin:stop].rstrip()) > limit:
                    cut = _cuts(limit).match(text, begin).end()
                    yield begin, cut
                    begin = cut
            yield begin, stop
        if piece is not None:
            begin, stop = piece.span()


def sentence_ranges(text: str, limit: int | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence, without the blanks around it.

    ``limit`` cuts longer sentences into parts, as speech or subtitles need it.
    """
    out = []
    for a, b in _spans(text, limit):
        body = text[a:b]
        inner = body.strip()
        if inner:
            a += len(body) - len(body.lstrip())
            out.append((a, a + len(inner)))
    return out


def sentences(pages: DataFrame, text: str = "text", limit: int | None = None) -> DataFrame:
    """One row per sentence: sentence_no, start, end, sentence. Whole texts, Arrow batches."""
    keep = [c for c in pages.columns if c != text]

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, nos, starts, ends, texts = [], [], [], [], []
            for i, body in enumerate(pdf[text]):
                for n, (a, b) in enumerate(sentence_ranges(body or "", limit)):
                    rows.append(i)
                    nos.append(n)
                    starts.append(a)
                    ends.append(b)
                    texts.append(body[a:b])
            out = pdf[keep].take(rows).reset_index(drop=True)
            yield out.assign(
                sentence_no=pd.array(nos, dtype="int64"), start=pd.array(starts, dtype="int64"),
                end=pd.array(ends, dtype="int64"), sentence=pd.array(texts, dtype=object),
            )

    schema = pages.select(*keep).schema
    for name, kind in (("sentence_no", "long"), ("start", "long"), ("end", "long"), ("sentence", "string")):
        schema = schema.add(name, kind)
    return pages.select(*keep, F.col(text)).mapInPandas(kernel, schema)
