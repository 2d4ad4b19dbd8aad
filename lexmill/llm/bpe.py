"""Byte-pair merging with a heap of merge ranks over a doubly linked symbol list.

The merge loop is shared by the token counter (which needs only how many merges
happen) and by the encoder (which needs the surviving symbols). Words repeat, so
results are kept per word in bounded caches; a worker process keeps its caches
between tasks.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import regex

#: Words kept per cache (their counts; their encoded bytes), and the longest word that is kept.
CACHE_WORDS, CACHE_CHUNKS = 500_000, 300_000
CACHE_LENGTH = 64


def merge(symbols: list[str], ranks: dict[str, float], sep: str = "") -> int:
    """Merge ``symbols`` in place, lowest rank and then leftmost first; the number of merges.

    ``ranks`` maps ``left + sep + right`` to a rank. Merged-away slots become "".
    A popped entry is stale if the pair that now starts at its place has another rank.
    """
    n = len(symbols)
    get = ranks.get
    rank_at = [get(symbols[i] + sep + symbols[i + 1]) for i in range(n - 1)]
    rank_at.append(None)
    heap = [(r, i) for i, r in enumerate(rank_at) if r is not None]
    if not heap:
        return 0
    heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    merges = 0
    while heap:
        rank, i = heappop(heap)
        if rank_at[i] != rank:
            continue
        j = after[i]
        joined = symbols[i] = symbols[i] + symbols[j]
        symbols[j] = ""
        rank_at[j] = None
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            r = rank_at[i] = get(joined + sep + symbols[k])
            if r is not None:
                heappush(heap, (r, i))
        else:
            rank_at[i] = None
        h = before[i]
        if h >= 0:
            r = rank_at[h] = get(symbols[h] + sep + joined)
            if r is not None:
                heappush(heap, (r, h))
    return merges


class WordCache(dict):
    """word -> value, computed on a miss; emptied when full, long words are not kept."""

    def __init__(self, compute, limit: int = CACHE_WORDS):
        super().__init__()
        self._compute, self._limit = compute, limit

    def __missing__(self, word):
        value = self._compute(word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= self._limit:
                self.clear()
            self[word] = value
        return value


class PieceCounter:
    """Token counts of a sentencepiece BPE model with byte fallback, without emitting ids.

    A text's count is its initial symbols (characters, those without a piece
    weighing their UTF-8 bytes) minus the merges. Text is cut where no piece of the
    vocabulary can span: before a run of spaces, and around line feeds.
    """

    SPACE = "▁"

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        kinds = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        ids = [i for i in range(model.get_piece_size()) if not any(f(i) for f in kinds)]
        pieces = {model.id_to_piece(i): -model.get_score(i) for i in ids}
        self.single = {p for p in pieces if len(p) == 1}
        self.ranks = {p: r for p, r in pieces.items() if len(p) > 1}
        if any(self.SPACE in p.lstrip(self.SPACE) for p in pieces):
            raise ValueError("a piece holds a space after other characters; texts can't be cut at spaces")
        alone = "" if any("\n" in p for p in self.ranks) else "\n"
        self.cut = re.compile(f" *[^ {alone}]+|{alone or '(?!)'}| +")
        self.counts = WordCache(self._count)

    def _count(self, word: str) -> int:
        symbols = list(word.replace(" ", self.SPACE))
        count = len(symbols) - merge(symbols, self.ranks)
        for s in symbols:
            if len(s) == 1 and s not in self.single:
                count += len(s.encode()) - 1
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.counts.__getitem__, self.cut.findall(" " + text.replace(self.SPACE, " "))))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a word-level BPE file: lower case, white space dropped, word-end suffix."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in (self.vocab | self.special).items()}
        self.tokens = [names.get(i) for i in range(max(names) + 1)]
        self.ranks = {f"{a} {b}": r for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern).findall
        self.file = file
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = byte_alphabet()
        self.bytes = {c: b for b, c in enumerate(self.letters)}
        self.words = WordCache(self._word, CACHE_CHUNKS // 5)
        self.chunks = WordCache(self._chunk, CACHE_CHUNKS)

    def _word(self, word: str) -> bytes:
        symbols = [self.letters[b] for b in word.encode()]
        symbols[-1] += self.suffix
        merge(symbols, self.ranks, " ")
        return array("I", [i for s in symbols if s and (i := self.vocab.get(s)) is not None]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self.words[w] for w in self.split(chunk)])

    @cached_property
    def library(self):
        import tokenizers

        return tokenizers.Tokenizer.from_file(self.file)

    def _newer(self, text: str) -> bytes:
        """A text with characters that the installed Unicode tables don't have yet: case and classes as the library's have them."""
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return b"".join([self.words[w] for w in (bytes(map(self.bytes.__getitem__, part)).decode() for part, _ in parts)])

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            if _BEYOND.search(text) and unassigned().search(text):
                return self._newer(text)
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # each character is lower-cased by itself: no final sigma
        text = text.lower()
        chunks = text.split() if _ODD_SPACE.search(text) is None else regex.split(r"\s+", text)
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if "<|" not in text:
            return self._plain(text)
        return b"".join([array("I", [self.special[part]]).tobytes() if part in self.special else self._plain(part) for part in self.specials.split(text)])

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of packed ids, one space between; ids outside the vocabulary are left out."""
        got = array("I")
        got.frombytes(ids)
        try:
            return " ".join(map(self.tokens.__getitem__, got))
        except (IndexError, TypeError):
            return " ".join([t for i in got if i < len(self.tokens) and (t := self.tokens[i]) is not None])


@lru_cache(maxsize=1)
def unassigned() -> re.Pattern:
    """The code points that the installed Unicode tables leave unassigned, private and other uses aside."""
    ranges, start = [], None
    for i in range(0x80, 0x110001):
        free = i < 0x110000 and unicodedata.category(chr(i)) == "Cn"
        if free and start is None:
            start = i
        elif not free and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{i - 1:08x}")
            start = None
    return re.compile(f"[{''.join(ranges)}]")


#: From the first code point on that is unassigned: a quick test that most texts don't pass.
_BEYOND = re.compile("[\u0378-\U0010ffff]")
#: Separators that str.split() takes for white space and the tokenizers' patterns don't.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


@lru_cache(maxsize=4)
def piece_counter(file: str) -> PieceCounter:
    return PieceCounter(file)


@lru_cache(maxsize=4)
def word_bpe(file: str) -> WordBpe:
    return WordBpe(file)
