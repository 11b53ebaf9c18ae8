"""Byte-pair encoding by dynamic programming over prefixes.

A word is a string of base symbols: its UTF-8 bytes, the last one marked as a
word end where the vocabulary has ends.  Every prefix of that string has exactly
one last token in its merge result, and a token can follow another exactly when
merging the two alone would leave them apart.  So one pass with an automaton of
all tokens suffices: at each position, of the tokens that are suffixes of the
prefix, the one compatible with the last token before it is stored, and
following these back from the end spells the encoding.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .batches import by_parts

END = "</w>"
#: The white space, letters and digits that the vocabulary's word pattern names.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
#: Words whose encodings a worker remembers, and as many of those before.
CACHE_WORDS = 200_000
#: Pairs of tokens whose compatibility it remembers.
CACHE_PAIRS = 1_000_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files, by the published rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def _unassigned() -> np.ndarray:
    """Code points that this Python's tables do not know; younger tables, as the word pattern's, may call them letters."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)


class PrefixBPE:
    """Encoder and decoder of one vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.path, self.library = path, None
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.word = regex.compile(WORD)
        self.byte = byte_symbols()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.product: dict[tuple[int, int], int] = {}
        for r, (x, y) in enumerate(merges):
            pair = (self.vocab[x], self.vocab[y])
            self.rank[pair], self.product[pair] = r, self.vocab[x + y]
        self.base = {self._symbols(t): i for t, i in self.vocab.items() if len(self._symbols(t)) == 1}
        self.made: dict[int, int] = {}  # rank of a token's last merge, -1 of a base symbol
        self.parts: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            s = self._symbols(token)
            if len(s) == 1:
                self.made[i] = -1
            elif (last := self._last_merge(s)) and self.product[last] == i:
                self.made[i], self.parts[i] = self.rank[last], last
            else:
                continue  # merging its own symbols never yields it
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.known: dict[int, bool] = {}  # compatibility of token pairs

    def _symbols(self, token: str) -> str:
        body = token.removesuffix(END)
        s = [chr(self.byte[c]) for c in body]
        if token != body and s:
            s[-1] = chr(ord(s[-1]) + 256)
        return "".join(s)

    def _last_merge(self, s: str) -> tuple[int, int] | None:
        """The merge that leaves a single token of ``s``; None if several tokens are left."""
        ids, after = [self.base[c] for c in s], [*range(1, len(s)), -1]
        before = [*range(-1, len(s) - 1)]
        queue = [(self.rank[p], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank]
        heapq.heapify(queue)
        left, last = len(s), None
        while queue:
            r, k = heapq.heappop(queue)
            j = after[k]
            if ids[k] < 0 or j < 0 or self.rank.get((ids[k], ids[j])) != r:
                continue
            last = (ids[k], ids[j])
            ids[k], ids[j], after[k] = self.product[last], -1, after[j]
            if after[k] >= 0:
                before[after[k]] = k
            left -= 1
            for p, q in ((before[k], k), (k, after[k])):
                if p >= 0 and q >= 0 and (ids[p], ids[q]) in self.rank:
                    heapq.heappush(queue, (self.rank[ids[p], ids[q]], p))
        return last if left == 1 else None

    def compatible(self, x: int, y: int) -> bool:
        """Merging x and y side by side leaves them as they are.

        Undoes the later of the two merges at the border again and again: what
        then touches there was adjacent up to that merge and must not have
        merged before it.  Of equal merges the left one came first.
        """
        limit = len(self.rank)
        while True:
            if self.rank.get((x, y), limit) < limit:
                return False
            rx, ry = self.made[x], self.made[y]
            if rx > ry:
                limit, x = rx, self.parts[x][1]
            elif ry >= 0:
                limit, y = ry + 1, self.parts[y][0]
            else:
                return True

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        s = raw[:-1].decode("latin-1") + chr(raw[-1] + 256)
        last, start, known = [-1] * (len(s) + 1), [0] * (len(s) + 1), self.known
        if len(known) > CACHE_PAIRS:
            known.clear()
        for end, (token, size) in self.automaton.iter(s):
            end += 1
            if last[end] < 0:
                k = end - size
                if k:
                    pair = last[k] << 32 | token
                    fits = known.get(pair)
                    if fits is None:
                        fits = known[pair] = last[k] >= 0 and self.compatible(last[k], token)
                    if not fits:
                        continue
                last[end], start[end] = token, k
        out, k = [], len(s)
        while k:
            out.append(last[k])
            k = start[k]
        return out[::-1]

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens."""
        if not text.isascii():
            if _unassigned()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
                return self._library_words(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letters are lowered one by one
        return self.word.findall(text.lower())

    def _library_words(self, text: str) -> list[str]:
        """The same by the library's own normaliser and splitter, which decide on characters of any age."""
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte.__getitem__, w)).decode("utf-8") for w, _ in found]

    def _coded(self, word: str) -> tuple[bytes, str]:
        if len(self.cache) >= CACHE_WORDS:
            self.older, self.cache = self.cache, {}
        value = self.older.get(word)
        if value is None:
            ids = self.encode_word(word)
            value = (np.array(ids, "<u4").tobytes(), " ".join(map(self.names.__getitem__, ids)))
        self.cache[word] = value
        return value

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and what they decode to."""
        text, cache, ids, shown = text or "", self.cache, [], []
        for part in self.split.split(text) if any(t in text for t in self.special) else (text,):
            if part in self.special:
                found = [(np.array([self.special[part]], "<u4").tobytes(), part)]
            else:
                found = [cache.get(w) or self._coded(w) for w in self.words(part)]
            ids += [x for x, _ in found]
            shown += [y for _, y in found]
        return b"".join(ids), " ".join(shown)

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by a space; the vocabulary has no decoder."""
        return " ".join(self.names[i] for i in ids)


@lru_cache(2)
def load(path: str) -> PrefixBPE:
    return PrefixBPE(path)


def encode_and_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers), ``decoded``.

    Whole texts are encoded as the vocabulary's library does without special
    tokens added; strings of special tokens inside a text become those tokens.
    Null and empty texts give no ids and the empty string; texts may be of any
    length.  Rows of any id, null or repeated, are kept, each with its own text;
    an empty table gives no rows; other columns are ignored.  There are no ties:
    every text has one encoding.  ``path`` must exist on the executors.
    """

    def make():
        bpe = load(path)

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            coded = [bpe.encode(x.as_py()) for x in part.column(1)]
            ids = [x for x, _ in coded]
            return pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([y for _, y in coded], pa.string())], [id_col, "n_tokens", "ids", "decoded"])

        return one

    source = df.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(by_parts(make, 1), f"`{id_col}` {source.dtypes[0][1]}, n_tokens long, ids binary, decoded string")
