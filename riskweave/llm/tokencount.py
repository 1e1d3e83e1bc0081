"""Operator 13, token counts by rank-synchronous merging of arrays.

A text is cut into pre-tokens by array operations on its character classes: the
byte-level pattern (contractions, an optional space with a run of letters, of
digits or of other marks, white space) never looks further than the
neighbouring runs. The distinct pre-tokens of a batch are held as ragged
arrays of symbols, first one symbol a byte. In every round each sequence finds
its pair of lowest rank, and all sequences apply theirs at once, at every
place where it stands; sequences without a known pair are done, and the symbols
they have left are their tokens. One very long pre-token would need a round for
each of its merges over its whole length, so those are merged rank by rank on
linked arrays, which touches only the places that change.

The vocabulary file (``tokenizers`` JSON, byte-level BPE) is a parameter: it is
read on the driver, its size is fixed, and the executors get its arrays by
broadcast. Special strings inside a text count as the library's default has it:
one token each, and the text around is cut on its own. No special tokens are
added, nothing is truncated or padded.

Edge cases: null text has no bytes and no tokens; bytes that are no UTF-8 count
as the replacement character's tokens; very long texts are cut at a boundary of
pre-tokens, so memory is bounded by a window or by the longest pre-token;
repeated rows are each counted; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lookup, map_texts, prepare, texts_of

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024     # tokens beyond which a document is over the limit
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
WHITE, LETTER, DIGIT, OTHER = range(4)
_NO = np.int32(1 << 30)    # rank of a pair that never merges
_CHARS = 1 << 18           # characters cut at once
_LONG = 512                # bytes from which a sequence is merged on linked arrays
_CACHED = 200_000          # distinct pre-tokens a task remembers
_CACHED_CHARS = 48         # of at most so many characters each


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a vocabulary file of the installed public tokenizers (driver only)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable
    Latin-1 stands for itself, the others are numbered from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def char_classes() -> np.ndarray:
    """For each code point whether the pattern takes it as white space, letter,
    digit or other. Where the Unicode versions of Python and ``regex`` differ,
    the tokenizer library's own pre-tokenizer decides."""
    from tokenizers import pre_tokenizers

    kinds = {"L": LETTER, "N": DIGIT}
    chars = [chr(cp) if not 0xD800 <= cp < 0xE000 else "�" for cp in range(0x110000)]
    table = np.fromiter((kinds.get(unicodedata.category(c)[0], OTHER) for c in chars), np.uint8, len(chars))
    other = np.full(len(chars), OTHER, np.uint8)
    everything = "".join(chars)
    for kind, pattern in ((WHITE, r"\s+"), (LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
        for m in regex.finditer(pattern, everything):
            other[m.start():m.end()] = kind
    table[other == WHITE] = WHITE
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False)
    for cp in np.flatnonzero(table != other).tolist():
        joins = [k for k, mate in ((LETTER, "a"), (DIGIT, "1"), (OTHER, "!")) if len(cut.pre_tokenize_str(mate + chr(cp))) == 1]
        table[cp] = joins[0] if joins else WHITE
    return table


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places first[i], first[i] + 1, ... (size[i] of them) for every i, in order."""
    at = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(first - at, size)


class Vocabulary:
    """A byte-level BPE vocabulary as arrays, and the cutting and merging by it."""

    def __init__(self, path: str, specials: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        self.size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.byte_id = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.byte_id[b] = ids[c]
        self.bytes_of = [b""] * self.size
        for piece, i in ids.items():
            self.bytes_of[i] = bytes(letters[c] for c in piece)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.pair = np.array([(ids[a], ids[b]) for a, b in merges], np.int64).reshape(-1, 2)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        self.pairs = Lookup(self.pair[:, 0] << 32 | self.pair[:, 1])
        # A symbol made at a rank is only used by later ranks: else merging rank
        # by rank at all places at once would not be the left-to-right order.
        born = np.full(self.size, -1)
        born[self.made] = np.arange(len(merges))
        if len(set(self.made.tolist())) < len(merges) or (born[self.pair] >= np.arange(len(merges))[:, None]).any():
            raise ValueError(f"{path}: merges are not in order of their symbols")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: special strings that strip or normalise are not supported")
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True) if specials else []
        self.classes = char_classes()

    # -- cutting ---------------------------------------------------------

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and the number of these."""
        if not any(s in text for s in self.special):
            return [text], 0
        parts = regex.split("|".join(map(regex.escape, self.special)), text)
        return parts, len(parts) - 1

    def windows(self, text: str) -> Iterator[str]:
        """The text in parts that are cut as they would be within the whole:
        a run of letters always ends a pre-token."""
        a, width = 0, _CHARS
        while len(text) - a > width:
            letter = self.classes[_codes(text[a:a + width])] == LETTER
            ends = np.flatnonzero(letter[:-1] & ~letter[1:])
            if len(ends):
                yield text[a:a + int(ends[-1]) + 1]
                a, width = a + int(ends[-1]) + 1, _CHARS
            else:
                width *= 2
        yield text[a:]

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Pre-tokens of the texts, in order, and how many each text has."""
        whole = "".join(texts)
        if not whole:
            return [], np.zeros(len(texts), np.int64)
        cp = _codes(whole)
        n, size = len(cp), np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(size) - size
        first = np.zeros(n, bool)
        first[begin[size > 0]] = True
        kind = self.classes[cp]
        white, space = kind == WHITE, cp == 0x20
        new = first.copy()
        new[1:] |= kind[1:] != kind[:-1]
        after_space = np.zeros(n, bool)
        after_space[1:] = space[:-1] & ~first[1:]
        start = new & (white | ~after_space)   # a run takes the one space before it
        start[:-1] |= white[:-1] & ~white[1:] & ~first[1:]  # which stands apart from white space before it
        mark = np.flatnonzero(new & (cp == 0x27) & ~after_space)
        for tail in CONTRACTIONS:
            end = mark + 1 + len(tail)
            here = end <= n
            for i, c in enumerate(tail):
                at = np.minimum(mark + 1 + i, n - 1)
                here &= (cp[at] == ord(c)) & ~first[at]
            start[mark[here] + 1] = False
            start[end[here & (end < n)]] = True
            mark = mark[~here]
        at = np.flatnonzero(start)
        edge = np.append(at, n).tolist()
        return [whole[a:b] for a, b in zip(edge, edge[1:])], np.diff(np.searchsorted(at, np.append(begin, n)))

    # -- merging ---------------------------------------------------------

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols."""
        found = self.pairs.find(a.astype(np.int64) << 32 | b)
        return np.where(found >= 0, found, _NO).astype(np.int32)

    def merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the byte strings after all merges, end to end, and the number of each."""
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        count, out = np.zeros(len(tokens), np.int64), [None] * len(tokens)
        for i in np.flatnonzero(size > _LONG).tolist():
            out[i] = self.merge_long(self.byte_id[np.frombuffer(tokens[i], np.uint8)])
            count[i] = len(out[i])
        live = np.flatnonzero((size > 0) & (size <= _LONG))
        sym = self.byte_id[np.frombuffer(b"".join([tokens[i] for i in live.tolist()]), np.uint8)]
        size = size[live]
        done_id, done_sym, done_size = [], [], []
        while len(live):
            last = np.cumsum(size) - 1
            rank = np.full(len(sym), _NO, np.int32)
            rank[:-1] = self.ranks(sym[:-1], sym[1:])
            rank[last] = _NO
            low = np.minimum.reduceat(rank, last - size + 1)
            busy = low < _NO
            keep = np.repeat(busy, size)
            done_id.append(live[~busy])
            done_sym.append(sym[~keep])
            done_size.append(size[~busy])
            sym, rank, live, size, low = sym[keep], rank[keep], live[busy], size[busy], low[busy]
            hit = _apart(np.flatnonzero(rank == np.repeat(low, size)))
            sym[hit] = self.made[rank[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            size = np.add.reduceat(stay, np.cumsum(size) - size, dtype=np.int64) if len(size) else size
            sym = sym[stay]
        if done_id:
            who, part, each = np.concatenate(done_id), np.concatenate(done_sym), np.concatenate(done_size)
            count[who] = each
            order = np.argsort(who, kind="stable")
            at = np.cumsum(each) - each
            short = part[ragged(at[order], each[order])]
        else:
            short = np.zeros(0, np.int32)
        if all(x is None for x in out):
            return short, count
        pieces, a = [], 0
        for x, k in zip(out, count.tolist()):
            pieces.append(short[a:a + k] if x is None else x)
            a += k if x is None else 0
        return np.concatenate(pieces), count

    def merge_long(self, sym: np.ndarray) -> np.ndarray:
        """The same for one long sequence: rank by rank on linked arrays."""
        n = len(sym)
        sym, after, before = sym.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[after[at] < n]
            r = self.ranks(sym[at], sym[after[at]])
            at, r = at[r < _NO], r[r < _NO]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(np.diff(r)) + 1
            for k, part in zip(r[np.append(0, cuts)].tolist() if len(r) else [], np.split(at, cuts)):
                if k not in waiting:
                    heapq.heappush(heap, k)
                waiting.setdefault(k, []).append(part)

        put(np.arange(n))
        while heap:
            k = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(k)))
            at = at[alive[at] & (sym[at] == self.pair[k, 0])]
            at = at[after[at] < n]
            at = at[sym[after[at]] == self.pair[k, 1]]
            if self.pair[k, 0] == self.pair[k, 1] and len(at):  # runs of one symbol: every other place
                joined = np.r_[False, after[at[:-1]] == at[1:]]
                at = at[_odd_even(joined)]
            gone = after[at]
            sym[at] = self.made[k]
            alive[gone] = False
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            left = before[at]
            put(np.unique(np.concatenate([left[left >= 0], at])))
        return sym[alive]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _odd_even(joined: np.ndarray) -> np.ndarray:
    """Of places in runs (joined: to the one before), the first, third, ... of each run."""
    i = np.arange(len(joined))
    return (i - np.maximum.accumulate(np.where(joined, 0, i))) % 2 == 0


def _apart(hit: np.ndarray) -> np.ndarray:
    """Places of pairs that don't overlap, leftmost first."""
    return hit[_odd_even(np.r_[False, np.diff(hit) == 1])] if len(hit) else hit


class Counter:
    """Tokens of whole texts, with the counts of frequent pre-tokens kept."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.known = vocabulary, {}

    def counts(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        got = list(map(self.known.get, tokens))
        if None in got:
            new = list({t for t, k in zip(tokens, got) if k is None})
            _, count = self.v.merge([t.encode("utf-8", "surrogatepass") for t in new])
            here = dict(zip(new, count.tolist()))
            got = [here[t] if k is None else k for t, k in zip(tokens, got)]
            if len(self.known) + len(here) > _CACHED:
                self.known = {}
            self.known |= {t: k for t, k in here.items() if len(t) <= _CACHED_CHARS}
        return np.array(got, np.int64)

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        held, whose, chars = [], [], 0
        for i, raw in enumerate(texts):
            parts, special = self.v.segments(raw.decode("utf-8", "replace"))
            out[i] += special
            for part in parts:
                for w in self.v.windows(part):
                    held.append(w)
                    whose.append(i)
                    chars += len(w)
                    if chars >= _CHARS:
                        self._add(out, held, whose)
                        chars = 0
        self._add(out, held, whose)
        return out

    def _add(self, out: np.ndarray, held: list[str], whose: list[int]) -> None:
        tokens, each = self.v.cut(held)
        total = np.append(0, np.cumsum(self.counts(tokens)))
        edge = np.append(0, np.cumsum(each))
        np.add.at(out, whose, total[edge[1:]] - total[edge[:-1]])
        held.clear(), whose.clear()


def count_tokens(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text: str = "text",
                 limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(Vocabulary(tokenizer or tokenizer_path()))

    def run(batches: Iterator[pa.RecordBatch]):
        counter = Counter(shared.value)
        for rb in batches:
            texts = texts_of(rb)
            yield rb, pa.StructArray.from_arrays([pa.array(list(map(len, texts)), pa.int64()),
                                                  pa.array(counter.texts(texts), pa.int64())], names=["b", "t"])

    out = map_texts(docs, run, "struct<b:bigint,t:bigint>", [id_col], text)
    return out.select(F.col(f"_row.`{id_col}`").alias("doc_id"), F.col("_out.b").alias("n_bytes"),
                      F.col("_out.t").alias("n_tokens"), (F.col("_out.t") > limit).alias("over_limit"))
