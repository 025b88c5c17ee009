"""Token counts that follow edits without encoding the whole text again.

A document's pre-tokens are kept in a segment tree whose leaves are short runs of pre-tokens and
whose nodes hold the characters and tokens below them. An edit finds its leaves by descending on
characters; the pre-tokenizer runs again from a little before the edit until a new pre-token ends
where an old one ended behind the edit. Only these pre-tokens are encoded, and only the sums on the
way to the root change.

Why this is exact: the pattern looks at most three characters beyond a pre-token's start of
decision, so a pre-token that ends four or more characters before the edit stays; and it never looks
back, so from a common end on both texts go on alike.
"""

from __future__ import annotations

from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpuskit.llm.common import map_batches, quoted
from corpuskit.llm.packing import encoding

LEAF = 32
LOOK = 4
CACHE = 300_000


class Counter:
    """Tokens per pre-token, remembered for common ones."""

    def __init__(self, path: str | None = None):
        import public_tokenizers

        self.encode = encoding(path).encode_ordinary
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}
        self.encoded = 0

    def tokens(self, piece: str) -> int:
        self.encoded += len(piece)
        n = self.known.get(piece)
        if n is None:
            if len(self.known) > CACHE:
                self.known.clear()
            n = self.known[piece] = len(self.encode(piece))
        return n


@lru_cache(maxsize=2)
def counter(path: str | None = None) -> Counter:
    return Counter(path)


class CountTree:
    """One document's text, its pre-tokens' sizes and counts, and sums over them."""

    def __init__(self, text: str, count: Counter):
        self.count = count
        self.text = text
        pieces = count.words.findall(text)
        self.build([[len(p) for p in pieces[i:i + LEAF]] for i in range(0, len(pieces), LEAF)],
                   [[count.tokens(p) for p in pieces[i:i + LEAF]] for i in range(0, len(pieces), LEAF)])

    def build(self, sizes: list[list[int]], counts: list[list[int]]) -> None:
        self.sizes = sizes or [[]]
        self.counts = counts or [[]]
        self.half = 1 << (len(self.sizes) - 1).bit_length()
        self.chars = [0] * (2 * self.half)
        self.sums = [0] * (2 * self.half)
        for i, (s, c) in enumerate(zip(self.sizes, self.counts, strict=True)):
            self.chars[self.half + i], self.sums[self.half + i] = sum(s), sum(c)
        for at in range(self.half - 1, 0, -1):
            self.chars[at] = self.chars[2 * at] + self.chars[2 * at + 1]
            self.sums[at] = self.sums[2 * at] + self.sums[2 * at + 1]

    @property
    def n_tokens(self) -> int:
        return self.sums[1]

    def renew(self, leaf: int) -> None:
        at = self.half + leaf
        self.chars[at], self.sums[at] = sum(self.sizes[leaf]), sum(self.counts[leaf])
        at >>= 1
        while at:
            self.chars[at] = self.chars[2 * at] + self.chars[2 * at + 1]
            self.sums[at] = self.sums[2 * at] + self.sums[2 * at + 1]
            at >>= 1

    def find(self, char: int) -> tuple[int, int, int]:
        """(leaf, pre-token in it, where it starts) of the pre-token that holds ``char``."""
        at, left = 1, 0
        while at < self.half:
            at *= 2
            if left + self.chars[at] <= char:
                left += self.chars[at]
                at += 1
        leaf = min(at - self.half, len(self.sizes) - 1)
        if at - self.half > leaf:
            left -= self.chars[self.half + leaf]
        for k, size in enumerate(self.sizes[leaf]):
            if left + size > char:
                return leaf, k, left
            left += size
        return leaf, len(self.sizes[leaf]), left

    def old_ends(self, leaf: int, k: int, start: int):
        """(leaf, place behind the pre-token, its end), from one pre-token on."""
        end = start
        while leaf < len(self.sizes):
            for j in range(k, len(self.sizes[leaf])):
                end += self.sizes[leaf][j]
                yield leaf, j + 1, end
            leaf, k = leaf + 1, 0

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters start .. end by ``new``; the document's tokens afterwards."""
        start = max(0, min(start, len(self.text)))
        end = max(start, min(end, len(self.text)))
        first, k, begin = self.find(max(0, start - LOOK))
        self.text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        ends = self.old_ends(first, k, begin)
        old = (first, k, begin)
        sizes, counts = [], []
        for m in self.count.words.finditer(self.text, begin):
            sizes.append(m.end() - m.start())
            counts.append(self.count.tokens(m.group()))
            while old is not None and (old[2] < end or old[2] + shift < m.end()):
                old = next(ends, None)
            if old is not None and old[2] >= end and old[2] + shift == m.end():
                break
        else:
            # the text ended first: whatever is left of the old pre-tokens goes
            old = None
        if old is None:
            last, behind = len(self.sizes) - 1, len(self.sizes[-1])
        else:
            last, behind = old[0], old[1]
        tail = self.sizes[last][behind:], self.counts[last][behind:]
        self.sizes[first][k:] = sizes
        self.counts[first][k:] = counts
        if last == first:
            self.sizes[first] += tail[0]
            self.counts[first] += tail[1]
        else:
            for leaf in range(first + 1, last):
                self.sizes[leaf], self.counts[leaf] = [], []
                self.renew(leaf)
            self.sizes[last], self.counts[last] = tail
            self.renew(last)
        if len(self.sizes[first]) > 8 * LEAF:
            flat = [x for s in self.sizes for x in s], [x for c in self.counts for x in c]
            self.build([flat[0][i:i + LEAF] for i in range(0, len(flat[0]), LEAF)],
                       [flat[1][i:i + LEAF] for i in range(0, len(flat[1]), LEAF)])
        else:
            self.renew(first)
        return self.n_tokens


EDITS = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("new", T.StringType()),
]))


def recount(docs: DataFrame, text: str = "text", edits: str = "edits", path: str | None = None,
            keep: list[str] | None = None) -> DataFrame:
    """Add ``n_tokens`` before, ``n_tokens_after`` all edits, ``n_chars_after`` and ``n_chars_encoded``.

    ``edits`` is an array of (start, stop, new): code points of the text as the edits before left
    it, clipped to it; a null replacement deletes. ``n_chars_encoded`` counts what the edits made
    the encoder see again. Null texts are empty, null edits none; each text is held in one task;
    repeated rows are counted on their own and no rows give none.
    """

    def run(data):
        count = counter(path)
        out = {"n_tokens": [], "n_tokens_after": [], "n_chars_after": [], "n_chars_encoded": []}
        for t, changes in zip(data[text], data[edits], strict=True):
            tree = CountTree(t or "", count)
            out["n_tokens"].append(tree.n_tokens)
            seen = count.encoded
            for e in changes or []:
                tree.edit(e["start"] or 0, e["stop"] or 0, e["new"] or "")
            out["n_tokens_after"].append(tree.n_tokens)
            out["n_chars_after"].append(len(tree.text))
            out["n_chars_encoded"].append(count.encoded - seen)
        return out

    fields = [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_tokens_after", "n_chars_after", "n_chars_encoded")]
    return map_batches(docs, [text, edits], run, fields, keep)


LONG_NUMBER = regex.compile("[0-9]{4,}")


def cleaning_edits(text: str | None) -> list[dict]:
    """What a cleaning step changes: long numbers become 0, and the first line gets a mark.

    Last place first, so that the places of the edits still to come stay true.
    """
    text = text or ""
    line = text.find("\n") if "\n" in text else len(text)
    edits = [(m.start(), m.end(), "0") for m in LONG_NUMBER.finditer(text)] + [(line, line, " [checked]")]
    return [{"start": a, "stop": b, "new": new} for a, b, new in sorted(edits, reverse=True)]


def with_cleaning_edits(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``edits`` and ``n_edits`` of the cleaning step."""

    def run(data):
        made = [cleaning_edits(t) for t in data[text]]
        return {"edits": made, "n_edits": [len(m) for m in made]}

    return map_batches(docs, [text], run, [T.StructField("edits", EDITS), T.StructField("n_edits", T.LongType())], keep)


def edited_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_edits and the counts of every document before and after the cleaning edits."""
    slim = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    return recount(with_cleaning_edits(slim), "text", "edits", path, ["doc_id", "n_edits"])
