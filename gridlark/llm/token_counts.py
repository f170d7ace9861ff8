"""Token counts of a byte-level BPE vocabulary by finite-state transducers.

The word rules of the vocabulary are one deterministic transducer over character classes whose output says where a
word begins. Texts are joined, cut into chunks of equal length, and every chunk is run from all states at once; the
chunks' state maps compose by a parallel prefix scan, which gives each chunk's true first state, and a second run
writes the word starts.

Within a word a second transducer reads bytes. Each transition carries the change in the number of emitted tokens.
It is compiled as words need it: the token that ends a prefix is the one that stands after the token before it in
the encoding of both. So a state need only know, for each suffix that may yet grow into a token, which token stands
before it and how many tokens that is; words with the same such suffixes share their transitions. Counts of short
words are remembered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import read_table
from .unicode_fit import LATER_LETTERS

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024
#: Characters run at a time and in a chunk; words, states and pairs that a worker remembers; longest such word.
BLOCK, CHUNK = 2_000_000, 256
REMEMBERED, STATES, PAIRS, SHORT = 500_000, 150_000, 500_000, 48

# ---------------------------------------------------------------- words
#: Character classes. The pattern of the vocabulary tells apart blanks, other white space, letters, numbers, the rest,
#: the apostrophe and the letters of the English endings after one; END closes a text.
BLANK, SPACE, LETTER, NUMBER, OTHER, APOSTROPHE, STMD, R, V, L, E, END = range(12)
_LETTERS = {LETTER, STMD, R, V, L, E}
#: States: what the word at hand is so far. FRESH: a new word begins with the next character.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, APO, APO_R, APO_V, APO_L, ONE_BLANK, ONE_SPACE, BLANK_LAST, SPACE_LAST = range(12)
#: Output bits: a word begins at this character; a word began at the character before.
HERE, BEFORE = 1, 2


def _begin(c: int) -> int:
    if c in _LETTERS:
        return IN_LETTERS
    return {BLANK: ONE_BLANK, SPACE: ONE_SPACE, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, APOSTROPHE: APO, END: FRESH}[c]


def _step(s: int, c: int) -> tuple[int, int]:
    """Next state and output. White space before a word leaves its last blank to the word; at the end of a text it is one word."""
    other = c in (OTHER, APOSTROPHE)
    if c == END:
        return FRESH, HERE | (BEFORE if s in (APO_R, APO_V, APO_L) else 0)
    if s == FRESH:
        return _begin(c), HERE
    if s in (ONE_BLANK, ONE_SPACE, BLANK_LAST, SPACE_LAST):
        if c in (BLANK, SPACE):
            return (BLANK_LAST if c == BLANK else SPACE_LAST), 0
        cut = BEFORE if s in (BLANK_LAST, SPACE_LAST) else 0
        if s in (ONE_BLANK, BLANK_LAST):
            return (IN_OTHER if other else _begin(c)), cut
        return _begin(c), cut | HERE
    if (s == IN_LETTERS and c in _LETTERS) or (s == IN_NUMBERS and c == NUMBER) or (s == IN_OTHER and other):
        return s, 0
    if s == APO:
        if other:
            return IN_OTHER, 0
        if c in (STMD, R, V, L):
            return {STMD: FRESH, R: APO_R, V: APO_V, L: APO_L}[c], 0
    if s in (APO_R, APO_V, APO_L):
        if c == (L if s == APO_L else E):
            return FRESH, 0
        after, out = _step(IN_LETTERS, c)
        return after, out | BEFORE
    return _begin(c), HERE


_NEXT = np.array([[_step(s, c)[0] for c in range(12)] for s in range(12)], np.uint8).ravel()
_OUT = np.array([[_step(s, c)[1] for c in range(12)] for s in range(12)], np.uint8).ravel()


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for pattern, c in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        table[[ord(x) for x in regex.findall(pattern, every)]] = c
    for a, b in LATER_LETTERS:
        table[a : b + 1] = OTHER
    for letters, c in ((" ", BLANK), ("'", APOSTROPHE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[[ord(x) for x in letters]] = c
    return table


def word_starts(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Positions at which words begin, and the positions of END, for a stream that begins with a new word."""
    n = len(classes)
    k = max(1, -(-n // chunk))
    padded = np.full(k * chunk, END, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(k, chunk).T)
    maps = np.repeat(np.arange(12, dtype=np.uint8)[None, :], k, axis=0)
    for row in columns:  # all chunks and all states side by side
        maps = _NEXT.take(maps * np.uint8(12) + row[:, None])
    d = 1
    while d < k:  # prefix scan: after it a map leads from the stream's start to its chunk's end
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d].astype(np.intp), axis=1)
        d *= 2
    state = np.concatenate([[FRESH], maps[:-1, FRESH]]).astype(np.uint8)
    out = np.empty((chunk, k), np.uint8)
    for i, row in enumerate(columns):
        at = state * np.uint8(12) + row
        out[i] = _OUT.take(at)
        state = _NEXT.take(at)
    out = out.T.ravel()[:n]
    begins = (out & HERE) > 0
    begins[:-1] |= (out[1:] & BEFORE) > 0
    return np.flatnonzero(begins)


# ---------------------------------------------------------------- tokens of a word
# What a vocabulary file must say for the word rules above and merges by rank to be the library's.
_WORDS = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_PLAIN = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
_ADDED = ("single_word", "lstrip", "rstrip", "normalized")


def check_vocabulary(spec: dict) -> None:
    """An error for a vocabulary file that other rules would be needed for, instead of wrong counts."""
    words, model = spec.get("pre_tokenizer") or {}, spec["model"]
    wrong = [f"pre_tokenizer.{k}" for k, v in _WORDS.items() if words.get(k, v if k == "use_regex" else None) != v]
    wrong += ["normalizer"] if spec.get("normalizer") else []
    wrong += ["model.type"] if model.get("type", "BPE") != "BPE" else []
    wrong += [f"model.{k}" for k in _PLAIN if model.get(k)]
    wrong += [f"added_tokens.{k}" for t in spec["added_tokens"] for k in _ADDED if t.get(k)]
    if wrong:
        raise ValueError(f"not a plain byte-level vocabulary: {', '.join(sorted(set(wrong)))}")


class MergeTransducer:
    """Bytes of a word to its number of tokens; transitions are compiled when they are first taken."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_vocabulary(spec)
        self.special = [t["content"] for t in spec["added_tokens"]]
        back = {x: b for b, x in enumerate(byte_letters())}
        raw = {t: bytes(map(back.__getitem__, t)) for t in spec["model"]["vocab"]}
        self.tokens = set(raw.values())
        self.ranks = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks.setdefault((raw[a], raw[b]), rank)
        #: Bytes that may grow into a longer token.
        self.growing = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.whole: dict[bytes, bool] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self._forget()

    def _forget(self) -> None:
        #: A state: for each suffix that may grow, from the longest to the empty one, the suffix, the token before it
        #: (at a word's start: no bytes) and that prefix's token count relative to the whole.
        self.states: list[tuple[tuple[bytes, bytes, int], ...]] = [((b"", b"", 0),)]
        self.numbers = {self.states[0]: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def merged(self, word: bytes) -> list[bytes]:
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _stands(self, token: bytes) -> bool:
        """Whether the token's own encoding is the token."""
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = len(token) == 1 or self.merged(token) == [token]
        return known

    def _follow(self, a: bytes, b: bytes) -> bool:
        """Whether the encoding of the two tokens' bytes is the two tokens."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        one = bytes([byte])
        grown = [(suffix + one, before, count) for suffix, before, count in self.states[state]]
        for token, before, count in grown:
            if token in self.tokens and self._stands(token) and (not before or self._follow(before, token)):
                break
        else:
            raise ValueError("no token ends here: the vocabulary lacks a byte")
        change = count + 1
        new = (*((s, b, c - change) for s, b, c in grown if s in self.growing), (b"", token, 0))
        number = self.numbers.get(new)
        if number is None:
            number = self.numbers[new] = len(self.states)
            self.states.append(new)
            self.moves.append({})
        self.moves[state][byte] = (number, change)
        return number, change

    def count(self, word: bytes) -> int:
        if len(self.states) > STATES:
            self._forget()
        state = total = 0
        for byte in word:
            move = self.moves[state].get(byte)
            if move is None:
                move = self.compile(state, byte)
            state = move[0]
            total += move[1]
        return total


class TokenCounter:
    """Token counts of whole texts, added tokens inside them included."""

    def __init__(self, path: str, block: int = BLOCK, chunk: int = CHUNK):
        self.transducer, self.block, self.chunk = MergeTransducer(path), block, chunk
        self.known: dict[str, int] = {}

    def _words(self, words: list[str]) -> list[int]:
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > REMEMBERED:
                self.known = {}
            for k, (w, n) in enumerate(zip(words, found, strict=True)):
                if n is None:
                    n = self.known.get(w)
                    if n is None:
                        n = self.transducer.count(w.encode("utf-8", "surrogatepass"))
                        if len(w) <= SHORT:
                            self.known[w] = n
                    found[k] = n
        return found

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Counts of many texts: they are run as one stream, block by block, each block from the last sure word start."""
        total = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for k, text in enumerate(texts):
            segments = [text or ""]
            for t in self.transducer.special:  # an added token ends the text before it, and is one token
                segments = [x for s in segments for x in s.split(t)]
            total[k] += len(segments) - 1
            parts += segments
            owner += [k] * len(segments)
        table, end = class_table(), np.cumsum([len(p) + 1 for p in parts], dtype=np.int64) - 1
        stream, owner_of = "\0".join([*parts, ""]), np.array(owner, np.int64)
        begin, size = 0, self.block
        while begin < len(stream):
            stop = min(len(stream), begin + size)
            classes = table[np.frombuffer(stream[begin:stop].encode("utf-32-le", "surrogatepass"), np.uint32)]
            ends = end[np.searchsorted(end, begin) : np.searchsorted(end, stop)] - begin
            classes[ends] = END
            starts = word_starts(classes, self.chunk)
            if stop < len(stream):
                # what begins last may go on in the next block, and the last character may still be cut off
                starts = starts[starts < stop - begin - 1]
                if len(starts) < 2:
                    size *= 2  # a word longer than the block
                    continue
                limit = int(starts[-1])
            else:
                limit = stop - begin
            stops = np.append(starts[1:], limit)
            words_only = starts < limit
            words_only &= classes[np.minimum(starts, len(classes) - 1)] != END
            starts, stops = starts[words_only], stops[words_only]
            text = stream[begin:stop]
            n = self._words([text[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)])
            at = np.searchsorted(end, begin + starts)
            total += np.bincount(owner_of[at], weights=n, minlength=len(total)).astype(np.int64)
            begin, size = begin + limit, self.block
        return total


@lru_cache(maxsize=4)
def counter(path: str) -> TokenCounter:
    """One counter for each vocabulary and Python worker."""
    return TokenCounter(path)


def token_count_column(path: str, text: F.Column) -> F.Column:
    """Number of tokens of a text (null: empty)."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for texts in batches:
            parts, group, size = [], [], 0
            for t in texts:
                group.append(t)
                size += len(t or "") + 1
                if size >= BLOCK:
                    parts.append(c.counts(group))
                    group, size = [], 0
            parts.append(c.counts(group))
            yield pd.Series(np.concatenate(parts))

    return count(text)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """``<id_col>, n_bytes, n_tokens, over_limit`` of every row.

    Null and empty texts have no bytes and no tokens. Rows with null or repeated ids come back as they are. An empty
    table gives an empty result. Other columns are not carried. ``path``: vocabulary file; one whose word rules,
    normalizer or model differ from those compiled here is an error.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    counted = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), token_count_column(path, F.col(text_col)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: token count of every document."""
    return count_tokens(read_table(spark, sf_dir, "documents"))
