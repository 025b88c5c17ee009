"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

The encoder looks at one word of the pre-tokenizer at a time. An Aho-Corasick automaton gives the
longest token from each place, and a table the next shorter one. A token may follow another only if
merging the two tokens' text would give exactly these two, which a table of merges decides; if no
token fits, the last one is taken back and its end never tried again. Each place is so left at most
once, and the result is exactly what merging by rank gives.

The vocabulary file marks a word's last character with a suffix, so the automaton's alphabet has two
forms of every byte: inside a word, and at its end.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.llm.common import fresh, map_batches, quoted

#: Words, and pairs of tokens, that each of the two generations of a memory holds.
WORDS, PAIRS = 100_000, 150_000
NEVER = 1 << 62


class Memory:
    """A bounded memory in two generations: what is used in time moves on, the rest is forgotten."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        got = self.new.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def _plain_pattern(pattern: str) -> re.Pattern:
    """The pre-tokenizer's pattern for texts of one-byte characters, where every class can be listed."""
    one_byte = [chr(c) for c in range(256)]
    kinds = {
        r"\p{L}": [c for c in one_byte if unicodedata.category(c)[0] == "L"],
        r"\p{N}": [c for c in one_byte if unicodedata.category(c)[0] == "N"],
        r"\s": [c for c in one_byte if regex.match(r"\s", c)],
    }
    for name, members in kinds.items():
        pattern = pattern.replace(name, "".join(map(re.escape, members)))
    return re.compile(pattern)


class WordBpe:
    """Encoder and decoder of a tokenizer file with word ends, as the tokenizers library reads it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(steps[0]["pattern"]["Regex"])
        self.plain_words = _plain_pattern(self.words.pattern)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile(
            "(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")"
        )
        self.letters = byte_letters()
        # second form of each letter: the end of a word
        self.ends = {c: chr(0xE000 + b) for b, c in enumerate(self.letters)}
        self.inner = str.maketrans({chr(b): c for b, c in enumerate(self.letters)})

        def form(token: str) -> str:
            if token.endswith(suffix) and token != suffix:
                body = token[: -len(suffix)]
                return body[:-1] + self.ends[body[-1]]
            return token

        forms = {form(token): i for token, i in vocab.items()}
        self.automaton = ahocorasick.Automaton()
        for f, i in forms.items():
            self.automaton.add_word(f, i)
        self.automaton.make_automaton()
        self.by_form = forms
        self.most = max(map(len, forms))
        # each token's length, and the next shorter token that it begins with
        self.size = [0] * (max(vocab.values()) + 1)
        self.shorter = [-1] * len(self.size)
        for f, i in forms.items():
            self.size[i] = len(f)
            self.shorter[i] = next((forms[f[:k]] for k in range(len(f) - 1, 0, -1) if f[:k] in forms), -1)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab[left + right]
            self.rank[vocab[left], vocab[right]] = (r, whole)
            self.parts.setdefault(whole, (r, vocab[left], vocab[right]))
        self.compatible = Memory(PAIRS)
        # decoding: all tokens in one string, with the offset of each
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        texts = [names.get(i, "") for i in range(max(names) + 1)]
        self.offsets = [0, *accumulate(map(len, texts))]
        self.letters_of_all = "".join(texts)
        self.known = Memory(WORDS)

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the text of both tokens by rank ends in exactly these two.

        Undoes the merges at the seam from the last to the first. The seam breaks if, at some
        moment, the pieces then at both its sides form a merge that comes before the merge that
        took one of them away. Of equal ranks, the one further left comes first.
        """
        known = self.compatible.get((left, right))
        if known is not None:
            return known
        a, b = left, right
        limit = (NEVER, 0)
        good = True
        while True:
            merge = self.rank.get((a, b))
            if merge is not None and (merge[0], 1) < limit:
                good = False
                break
            pa, pb = self.parts.get(a), self.parts.get(b)
            if pa is None and pb is None:
                break
            # the later of the two last merges is undone: by rank, then the right one
            if pb is None or pa is not None and pa[0] > pb[0]:
                limit, a = (pa[0], 0), pa[2]
            else:
                limit, b = (pb[0], 2), pb[1]
        self.compatible.put((left, right), good)
        return good

    def longest(self, letters: str, at: int) -> int:
        """The longest token that begins at a place."""
        near = letters[at:at + self.most]
        k = self.automaton.longest_prefix(near)
        while (token := self.by_form.get(near[:k])) is None:
            k -= 1
        return token

    def encode_word(self, letters: str) -> list[int]:
        """Token ids of one word, given in byte letters with the last in its end form."""
        allowed = self.compatible.new.get

        def fits(left: int, right: int) -> bool:
            good = allowed((left, right))
            return self.may_follow(left, right) if good is None else good

        # the longest matches one after the other are most often the answer
        out = [token for _, token in self.automaton.iter_long(letters)]
        if all(map(fits, out, out[1:])):
            return out
        n = len(letters)
        dead = bytearray(n + 1)
        size, shorter = self.size, self.shorter
        out = []
        at, token = 0, self.longest(letters, 0)
        while at < n:
            while token >= 0:
                end = at + size[token]
                if not dead[end] and (not out or fits(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at < n:
                    token = self.longest(letters, at)
            else:
                # no token fits here after the last one: take that back, never end one here again
                dead[at] = 1
                token = out.pop()
                at -= size[token]
        return out

    def pieces(self, text: str) -> list[str]:
        """Special tokens and plain stretches, in turn; plain first."""
        return self.special_at.split(text)

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # character by character: the library has no rule for a final sigma
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))

    def split(self, text: str) -> list[str]:
        """The pre-tokenizer's words; one-byte texts go the faster way to the same words."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.words.findall(text)
        return self.plain_words.findall(text)

    def entry(self, word: str) -> tuple[str, int, str]:
        """Ids as text, their number, and the decoded text of a word."""
        got = self.known.get(word)
        if got is None:
            letters = word.encode().decode("latin-1").translate(self.inner)
            ids = self.encode_word(letters[:-1] + self.ends[letters[-1]])
            got = (" ".join(map(str, ids)), len(ids), self.decode(ids))
            self.known.put(word, got)
        return got

    def entries(self, text: str | None) -> list[tuple[str, int, str]]:
        """One entry per word or special token of a text."""
        out = []
        for k, piece in enumerate(self.pieces(text or "")):
            if k % 2:
                out.append((str(self.special[piece]), 1, piece))
            else:
                recent = self.known.new.get
                out += [recent(w) or self.entry(w) for w in self.split(self.normal(piece))]
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _, _ in self.entries(text) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens as the vocabulary writes them, joined by a space: the file names no decoder."""
        at = self.offsets
        return " ".join([self.letters_of_all[at[i]:at[i + 1]] for i in ids])


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def with_digests(docs: DataFrame, text: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; null counts as the empty text.

    ``path`` is the tokenizer file, found on every worker (by default the public package's).
    """

    def run(data):
        bpe = loaded(path or default_path())
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in data[text]:
            got = bpe.entries(t)
            out["n_tokens"].append(sum([e[1] for e in got]))
            out["ids_sha256"].append(_sha(" ".join([e[0] for e in got])))
            out["decoded_sha256"].append(_sha(" ".join([e[2] for e in got])))
        return out

    fields = [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    return map_batches(docs, [text], run, fields, keep)


def encoded(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Add ``token_ids`` (array of int); all other columns stay."""

    def run(data):
        bpe = loaded(path or default_path())
        return {"token_ids": [bpe.encode(t) for t in data[text]]}

    return map_batches(docs, [text], run, [T.StructField("token_ids", T.ArrayType(T.IntegerType()))])


def decoded(docs: DataFrame, ids: str = "token_ids", path: str | None = None) -> DataFrame:
    """Add ``decoded`` from an array of ids; a null array decodes to the empty text."""

    def run(data):
        bpe = loaded(path or default_path())
        return {"decoded": [bpe.decode(x or []) for x in data[ids]]}

    return map_batches(docs, [ids], run, [T.StructField("decoded", T.StringType())])


def token_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens and the hashes of its ids and of their decoded text.

    Null and empty texts have no tokens; repeated rows give repeated rows; no rows give none.
    """
    slim = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    return with_digests(slim, "text", path, ["doc_id"])
