"""BPE encoding and decoding with a pair occurrence index over each batch of a partition.

Texts are cut into words as the vocabulary file says (added tokens first, then normalisation and the word pattern).
The words of a batch that were not met before are laid out in one symbol array; an index maps every adjacent pair to
all its positions. Pairs are taken by ascending rank; a pair's occurrences are merged from left to right and only the
lists of the neighbouring pairs change. Encoded words are remembered within a worker up to a fixed number.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import paused_collector, read_table, release_memory
from .unicode_fit import find_words, lower

#: Words that a worker remembers; beyond that it keeps those of the last round that are met again.
REMEMBERED = 250_000
#: Words that are looked up at a time, which bounds what a very long text takes.
SLICE = 200_000
VOCABULARY = "word_bpe_49k.json"
#: A pair of symbols is one number: the left one above so many bits.
PAIR_BITS = 24


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = (b for b in range(256) if b not in set(plain))
    return [x for _, x in sorted([(b, chr(b)) for b in plain] + [(b, chr(256 + k)) for k, b in enumerate(other)])]


def merge_by_pair_index(words: list[list[int]], ranks: dict[int, int], merges: list[tuple[int, int, int]]) -> list[list[int]]:
    """Merge each word's symbols. ``ranks``: pair, as :func:`pair_code`, -> rank; ``merges``: left, right and merged symbol by rank.

    Within a word this is the usual order, lowest rank first and leftmost first: a merge that opens a pair of lower
    rank interrupts the list at hand, and the rest of the list waits for its turn. Words lie in one array with -1
    behind each, which is in no pair; merged-away symbols become -1 as well.
    """
    sym: list[int] = []
    starts = []
    for w in words:
        starts.append(len(sym))
        sym += w
        sym.append(-1)
    before, after, rank_of = list(range(-1, len(sym) - 1)), list(range(1, len(sym) + 1)), ranks.get
    shift, push, pop = PAIR_BITS, heapq.heappush, heapq.heappop
    index: dict[int, list[int]] = {}
    codes = np.array(sym, np.int64)
    for i, rank in enumerate(map(rank_of, (codes[:-1] << PAIR_BITS | codes[1:]).tolist())):
        if rank is not None:
            if (places := index.get(rank)) is None:
                index[rank] = [i]
            else:
                places.append(i)
    active = list(index)
    heapq.heapify(active)
    while active:
        rank = pop(active)
        places = index.pop(rank, None)
        if places is None:
            continue
        left, right, merged = merges[rank]
        if len(places) > 1:
            places.sort()
        for n, i in enumerate(places):
            j = after[i]
            if sym[i] != left or sym[j] != right:
                continue  # the occurrence is gone
            sym[i], sym[j] = merged, -1
            k, h = after[j], before[i]
            after[i] = k
            before[k] = i
            lower = False
            new = rank_of(sym[h] << shift | merged)
            if new is not None:
                if new in index:
                    index[new].append(h)
                else:
                    index[new] = [h]
                    push(active, new)
                lower = new < rank
            new = rank_of(merged << shift | sym[k])
            if new is not None:
                if new in index:
                    index[new].append(i)
                else:
                    index[new] = [i]
                    push(active, new)
                lower |= new < rank
            if lower and n + 1 < len(places):
                index.setdefault(rank, []).extend(places[n + 1 :])
                push(active, rank)
                break
    out = []
    for i in starts:
        ids = []
        while (s := sym[i]) >= 0:
            ids.append(s)
            i = after[i]
        out.append(ids)
    return out


def pair_code(left: int, right: int) -> int:
    return left << PAIR_BITS | right


class WordBpe:
    """Encoder and decoder of a byte-level BPE vocabulary whose words end in a suffix, from its JSON file.

    Understands what the public word vocabulary uses: added tokens matched in the raw text, NFC, white space to one
    space, lower case, a word pattern whose gaps are dropped, byte letters, an end-of-word suffix, and decoding by
    joining tokens with spaces.
    """

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.cut_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.word = regex.compile(split["pattern"]["Regex"])
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.final = [vocab[x + model["end_of_word_suffix"]] for x in letters]
        self.ranks, self.merges = {}, []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks.setdefault(pair_code(vocab[a], vocab[b]), rank)
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
        self.decimal = {i: str(i) for i in self.tokens}
        # the same pattern for texts in ASCII, where the standard module is faster
        self.ascii_word = re.compile(split["pattern"]["Regex"].replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(r"\s", r" \t-\r"))
        #: word -> number of ids, the ids in decimal, the decoded text
        self.known: dict[str, tuple[int, str, str]] = {}
        self.last: dict[str, tuple[int, str, str]] = {}

    def pieces(self, text: str) -> list[str]:
        """Words in the order of the text; added tokens come as they are."""
        parts = self.cut_special.split(text) if self.cut_special and any(t in text for t in self.special) else [text]
        out: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(part)
            elif part.isascii():
                out += self.ascii_word.findall(part.lower())
            else:
                out += find_words(self.word, lower(unicodedata.normalize("NFC", part)))
        return out

    def learn(self, words: list[str]) -> None:
        """Make all of ``words`` known; those that aren't yet are encoded together."""
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.last, new = {}, self.known, set(words)
        self.known |= {w: self.last[w] for w in new if w in self.last}
        new = list(new.difference(self.known))
        symbols, inner = [], self.inner.__getitem__
        for w in new:
            b = w.encode("utf-8", "surrogatepass")
            symbols.append([*map(inner, b[:-1]), self.final[b[-1]]])
        known, decimal, token = self.known, self.decimal.__getitem__, self.tokens.__getitem__
        for w, ids in zip(new, merge_by_pair_index(symbols, self.ranks, self.merges), strict=True):
            known[w] = (1, decimal(ids[0]), token(ids[0])) if len(ids) == 1 else (len(ids), " ".join(map(decimal, ids)), " ".join(map(token, ids)))
        self.known |= {t: (1, str(i), t) for t, i in self.special.items()}

    def encoded(self, texts: Iterable[str | None]) -> Iterator[tuple[int, list[tuple[int, str, str]], bool]]:
        """The texts' words, as known: ``(number of the text, a slice of its words, whether it is the last slice)``.

        The words of many short texts, or of a slice of a long one, are encoded together.
        """
        waiting: list[tuple[int, list[str], bool]] = []
        size = 0

        def flush():
            try:
                found = [list(map(self.known.__getitem__, part)) for _, part, _ in waiting]
            except KeyError:
                self.learn([w for _, part, _ in waiting for w in part])
                found = [list(map(self.known.__getitem__, part)) for _, part, _ in waiting]
            yield from ((k, f, last) for (k, _, last), f in zip(waiting, found, strict=True))

        for k, text in enumerate(texts):
            words = self.pieces(text or "")
            for i in range(0, len(words) or 1, SLICE):
                waiting.append((k, words[i : i + SLICE], i + SLICE >= len(words)))
                size += len(waiting[-1][1])
                if size >= SLICE:
                    yield from flush()
                    waiting, size = [], 0
        yield from flush()

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        ids: list[int] = []
        for _, part, last in self.encoded(texts):
            ids += [int(i) for w in part for i in w[1].split()]
            if last:
                yield ids
                ids = []

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_batch([text]))

    def digest_batch(self, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the ids in decimal and of the decoded text; both strings are hashed slice by slice."""
        n, ids, decoded, gap = 0, hashlib.sha256(), hashlib.sha256(), ""
        for _, part, last in self.encoded(texts):
            if part:
                sizes, decimals, tokens = zip(*part, strict=True)
                n += sum(sizes)
                ids.update((gap + " ".join(decimals)).encode())
                decoded.update((gap + " ".join(tokens)).encode())
                gap = " "
            if last:
                yield n, ids.hexdigest(), decoded.hexdigest()
                n, ids, decoded, gap = 0, hashlib.sha256(), hashlib.sha256(), ""

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str) -> WordBpe:
    """One encoder for each vocabulary and Python worker."""
    return WordBpe(path)


def digests(path: str, text: F.Column) -> F.Column:
    """``n_tokens, ids_sha256, decoded_sha256`` of a text (null: empty)."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = codec(path)
        for texts in batches:
            with paused_collector():
                rows = list(bpe.digest_batch(texts))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.last = {}
        release_memory()

    return of(text)


def encode_column(path: str, text: F.Column) -> F.Column:
    """Token ids of a text as an array (null: empty)."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        bpe = codec(path)
        return pd.Series(list(bpe.encode_batch(texts)), dtype=object)

    return ids(text)


def decode_column(path: str, ids: F.Column) -> F.Column:
    """Text of an id array, added tokens included (null: null)."""

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        bpe = codec(path)
        return pd.Series([None if r is None else bpe.decode(list(r)) for r in rows], dtype=object)

    return text(ids)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``<id_col>, n_tokens, ids_sha256, decoded_sha256`` of every row.

    Null and empty texts have 0 tokens and the digests of the empty string. Rows with null or repeated ids come back
    as they are. An empty table gives an empty result. Other columns are not carried. ``path``: vocabulary file.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return docs.select(F.col(id_col), digests(path, F.col(text_col)).alias("d")).select(id_col, "d.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: token count and digests of every document."""
    return encode_documents(read_table(spark, sf_dir, "documents"))
