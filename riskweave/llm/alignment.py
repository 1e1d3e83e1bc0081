"""Operator 11, alignment of the tokens of two tokenizers by incidence products.

Both tokenizers encode space + text. A token covers a range of its bytes, so
each encoding is a 0/1 matrix tokens x bytes, kept in compressed rows (CSR) that
are built here. The product A . B^T, row by row after Gustavson (the rows of B^T
that a row of A names are gathered and summed by column), holds the overlap of
every pair of tokens in bytes: its entries are the overlap links. Byte offsets
where a token of A and one of B both end cut the tokens into groups; the product
of the two tokens x groups matrices holds the shared-group links. Overlap links
whose two tokens end together are what the counts of id pairs are taken from.

Counts over the corpus: the texts are encoded block by block (``BLOCK_BYTES``,
or one longer text) into a written table, a row per block with its distinct id
pairs. The pairs are summed by Spark, the highest count of each B id joined, and
every block gets back the figures of its own pairs, so that no task holds more
than a block's pairs, nothing is broadcast that grows with the corpus, and a
frequent pair has one row per block, in a join that adaptive execution splits.

A is a byte-level BPE file (``tokenizers`` JSON), cut and merged as in operator
13 with special strings as plain text; B is a ``sentencepiece`` model, which adds
the space itself and encodes run by run of spaces and what follows, as no piece of
it crosses into a space (a model that has such pieces gets whole texts). A task
keeps the ids of units it has met. Both files have a fixed size and go to the
executors by broadcast.

Edge cases: null or empty texts, texts whose joined tokens don't give back
space + text (by either tokenizer), and bytes that are no UTF-8 have no tokens:
zeros and an empty digest; they count in no pair. Repeated rows are each encoded
and counted. Products run over windows of bytes, so a very long text costs
memory in proportion to its tokens. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, prepare, step, texts_of
from .tokencount import Vocabulary, ragged, tokenizer_path

FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_BYTES = 1 << 20    # text of a block, unless one text is longer
_WINDOW = 1 << 19        # bytes multiplied at once
_CACHED = 100_000        # distinct units of each tokenizer a task remembers
_JOIN = 1 << 18          # tokens written to a digest at once
_WORDS = re.compile(r" +[^ ]*|[^ ]+")
SPACE = "▁"         # how pieces write a space


class Csr(NamedTuple):
    """A 0/1 matrix by compressed rows: the columns of row i are
    ``cols[start[i]:start[i + 1]]``, in ascending order."""

    start: np.ndarray
    cols: np.ndarray
    width: int

    @classmethod
    def of_ranges(cls, first: np.ndarray, size: np.ndarray, width: int) -> Csr:
        """Row i has the columns first[i], ..., first[i] + size[i] - 1."""
        return cls(np.append(0, np.cumsum(size)), ragged(first, size), width)

    @classmethod
    def of_owners(cls, owner: np.ndarray, width: int) -> Csr:
        """Row i has the one column owner[i]."""
        return cls(np.arange(len(owner) + 1), owner, width)

    def transpose(self) -> Csr:
        rows = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        count = np.bincount(self.cols, minlength=self.width)
        if (self.cols[1:] < self.cols[:-1]).any():
            rows = rows[np.argsort(self.cols, kind="stable")]
        return Csr(np.append(0, np.cumsum(count)), rows, len(self.start) - 1)


def product_sizes(a: Csr, b: Csr) -> np.ndarray:
    """Terms of each row of the product a . b (Gustavson's symbolic pass)."""
    terms = np.append(0, np.cumsum(np.diff(b.start)[a.cols]))
    return terms[a.start[1:]] - terms[a.start[:-1]]


def product(a: Csr, b: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of the entries of a . b, by row and column.

    Row i gathers the rows of ``b`` that its columns name and sums equal columns.
    """
    size = np.diff(b.start)[a.cols]
    cols = b.cols[ragged(b.start[a.cols], size)]
    rows = np.repeat(np.repeat(np.arange(len(a.start) - 1), np.diff(a.start)), size)
    key = rows.astype(np.int64) * b.width + cols
    if len(key) and (key[1:] < key[:-1]).any():
        key = np.sort(key, kind="stable")
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    value = np.diff(np.append(new, len(key)))
    return key[new] // b.width, key[new] % b.width, value


class Known(dict):
    """Numbers of the units met so far; units asked for the first time are listed in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = at = len(self)
        self.new.append(unit)
        return at


class Units:
    """Ids of whole texts from those of their units, which are kept between texts.

    A unit is a stretch of text whose ids don't depend on what stands around it.
    ``encode`` gives ids of new units (end to end, and the number of each).
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], bytes_of: list[bytes]):
        self.encode, self.bytes_of = encode, bytes_of
        self.forget()

    def forget(self) -> None:
        self.known = Known()
        self.ids, self.count, self.whole = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)

    def texts(self, units: list[str], each: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts of ``each`` units, end to end; the number of each text, and
        whether its ids give back its bytes."""
        if len(self.known) > _CACHED:
            self.forget()
        at = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        if self.known.new:
            ids, count = self.encode(self.known.new)
            pieces = list(map(self.bytes_of.__getitem__, ids.tolist()))
            edge = np.append(0, np.cumsum(count)).tolist()
            same = [b"".join(pieces[x:y]) == u.encode("utf-8", "surrogatepass") for x, y, u in zip(edge, edge[1:], self.known.new)]
            self.ids, self.count = np.append(self.ids, ids), np.append(self.count, count.astype(np.int32))
            self.whole = np.append(self.whole, same)
            self.known.new = []
        first = np.cumsum(self.count, dtype=np.int64) - self.count
        edge = np.append(0, np.cumsum(each))
        size = self.count[at]
        total = np.append(0, np.cumsum(size, dtype=np.int64))[edge]
        bad = np.append(0, np.cumsum(~self.whole[at]))[edge]
        return self.ids[ragged(first[at], size)], np.diff(total), np.diff(bad) == 0


class Pieces:
    """Tokenizer B: ids of units, and the bytes of its pieces."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace(SPACE, " ").encode()
                         for i, p in enumerate(names)]
        # Where pieces have spaces only at their start, no merge joins a space to
        # what stands before it: a text can be cut there.
        self.space = self.sp.piece_to_id(SPACE)
        self.cuts = self.space != self.sp.unk_id() and not any(
            SPACE in p.lstrip(SPACE) for i, p in enumerate(names) if not self.sp.is_control(i))

    def units(self, text: str) -> list[str]:
        """The text (from its first space on) in units, each a run of spaces and what follows."""
        return _WORDS.findall(text) if self.cuts else [text]

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units, end to end, and the number of each."""
        # It adds the first space, but gives nothing for the empty text.
        ids = [x or [self.space] for x in self.sp.encode([u[1:] for u in units], num_threads=1)]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))


class Encoder:
    """Both tokenizers, with the ids of units kept."""

    def __init__(self, a: Vocabulary, b_model: bytes):
        self.a, self.b = a, Pieces(b_model)
        self.len_a = np.fromiter(map(len, a.bytes_of), np.int64, len(a.bytes_of))
        self.len_b = np.fromiter(map(len, self.b.bytes_of), np.int64, len(self.b.bytes_of))
        self.units_a = Units(lambda new: a.merge([u.encode("utf-8", "surrogatepass") for u in new]), a.bytes_of)
        self.units_b = Units(self.b.encode, self.b.bytes_of)
        # What digests write for an id that goes on with its side, and for the last of it.
        words = [b"%d" % i + end for n, ends in ((len(self.len_a), b",|"), (len(self.len_b), b",;"))
                 for i in range(n) for end in (ends[:1], ends[1:])]
        self.word_size = np.fromiter(map(len, words), np.int64, len(words))
        self.word_first = np.cumsum(self.word_size) - self.word_size
        self.word_bytes = np.frombuffer(b"".join(words), np.uint8)

    def align(self, texts: list[bytes]) -> Aligned:
        """Encode the texts of a block."""
        strings = [(b" " + t).decode("utf-8", "replace") if t else "" for t in texts]
        parts = [list(self.a.windows(t)) for t in strings]
        tokens, each = self.a.cut([p for ps in parts for p in ps])
        edge = np.append(0, np.cumsum(each))[np.append(0, np.cumsum([len(ps) for ps in parts]))]
        a, size_a, good_a = self.units_a.texts(tokens, np.diff(edge))
        units = [self.b.units(t) for t in strings]
        b, size_b, good_b = self.units_b.texts(list(chain.from_iterable(units)), np.fromiter(map(len, units), np.int64, len(units)))
        good = good_a & good_b & np.fromiter((s.encode("utf-8", "surrogatepass")[1:] == t for s, t in zip(strings, texts)), bool, len(texts))
        if not good.all():
            a, b = a[np.repeat(good, size_a)], b[np.repeat(good, size_b)]
            size_a, size_b = size_a * good, size_b * good
        return Aligned(a, b, size_a, size_b, self)


class Aligned:
    """Tokens of a block of texts on one line of bytes, with their products."""

    def __init__(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, encoder: Encoder):
        self.a, self.b, self.encoder = a, b, encoder
        self.off_a, self.off_b = np.append(0, np.cumsum(size_a)), np.append(0, np.cumsum(size_b))
        self.end_a, self.end_b = np.cumsum(encoder.len_a[a]), np.cumsum(encoder.len_b[b])
        # Groups end where a token of each ends, and are numbered in order.
        line = np.zeros(int(self.end_a[-1]) + 1 if len(a) else 1, np.uint8)
        line[self.end_a] = 1
        line[self.end_b] += 1
        self.last_a, self.last_b = line[self.end_a] == 2, line[self.end_b] == 2
        self.group_a = np.cumsum(self.last_a) - self.last_a
        self.group_b = np.cumsum(self.last_b) - self.last_b

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Overlap links (token of A, token of B, bytes), in windows of bytes."""
        i, n = 0, len(self.a)
        while i < n:
            begin = int(self.end_a[i - 1]) if i else 0
            stop = max(i + 1, int(np.searchsorted(self.end_a, begin + _WINDOW, "right")))
            end = int(self.end_a[stop - 1])
            size = np.diff(np.append(begin, self.end_a[i:stop]))
            rows = Csr.of_ranges(np.cumsum(size) - size, size, end - begin)
            j, k = np.searchsorted(self.end_b, begin, "right"), np.searchsorted(self.end_b, end, "left") + 1
            edge = np.append(begin, np.minimum(self.end_b[j:k], end))
            owner = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
            r, c, v = product(rows, Csr.of_owners(owner, len(edge) - 1))
            yield r + i, c + j, v
            i = stop

    def digests(self) -> list[str]:
        """For each text the SHA-256 of its groups (ids of A ``|`` ids of B, groups cut by ``;``)."""
        e, n = self.encoder, int(self.last_a.sum())
        before_b = np.append(0, np.cumsum(np.bincount(self.group_b, minlength=n)))
        upto_a = np.cumsum(np.bincount(self.group_a, minlength=n))
        line = np.empty(len(self.a) + len(self.b), np.int32)
        line[np.arange(len(self.a)) + before_b[self.group_a]] = self.a * 2 + self.last_a
        line[np.arange(len(self.b)) + upto_a[self.group_b]] = 2 * len(e.len_a) + self.b * 2 + self.last_b
        out, at = [], (self.off_a + self.off_b).tolist()
        for x, y in zip(at, at[1:]):
            h = hashlib.sha256()
            for p in range(x, y, _JOIN):
                word = line[p:min(p + _JOIN, y)]
                part = e.word_bytes[ragged(e.word_first[word], e.word_size[word])]
                h.update(part if p + _JOIN < y else part[:-1])
            out.append(h.hexdigest() if y > x else "")
        return out


def _shared(docs: DataFrame, path_a: str | None, path_b: str | None):
    with open(path_b or tokenizer_path(FILE_B), "rb") as f:
        model = f.read()
    return docs.sparkSession.sparkContext.broadcast((Vocabulary(path_a or tokenizer_path(FILE_A), specials=False), model))


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts make a block."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > BLOCK_BYTES:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


_DOC = "n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,n_overlaps:bigint,n_shared:bigint,groups_sha256:string"


def _encode(docs: DataFrame, shared, keep: list[str], text: str) -> DataFrame:
    """A row per block: its rows with their figures (``docs``), its distinct id
    pairs of links (``pairs``, with the number ``n`` of links) and the place in
    ``pairs`` of every link, in the order of the rows (``links``: the lower, then the
    upper 16 bits of all, packed)."""
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col(f"`{text}`").cast("binary").alias("_text"))
    row_type = src.schema["_row"].dataType.simpleString()
    schema = f"block bigint, docs array<struct<_row:{row_type},{_DOC}>>, pairs array<bigint>, n array<bigint>, links binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, encoder = TaskContext.get().partitionId() << 32, Encoder(*shared.value)
        for rb in batches:
            texts = texts_of(rb)
            for x, y in _blocks(texts):
                al = encoder.align(texts[x:y])
                per_doc = [np.zeros(y - x, np.int64) for _ in range(2)]
                keys, whose = [], []
                for r, c, _ in al.overlaps():
                    both = al.end_a[r] == al.end_b[c]
                    doc = np.searchsorted(al.off_a, r, "right") - 1
                    per_doc[0] += np.bincount(doc[both], minlength=y - x)
                    per_doc[1] += np.bincount(doc, minlength=y - x)
                    keys.append(al.a[r[both]].astype(np.int64) << 32 | al.b[c[both]])
                n_groups = int(al.last_a.sum())
                shared_links = np.append(0, np.cumsum(product_sizes(
                    Csr.of_owners(al.group_a, n_groups), Csr.of_owners(al.group_b, n_groups).transpose())))
                first = np.append(al.group_a, n_groups)
                pairs, at, n = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True, return_counts=True)
                figures = [np.diff(al.off_a), np.diff(al.off_b), np.diff(first[al.off_a]), *per_doc, np.diff(shared_links[al.off_a])]
                names = [f.split(":")[0] for f in _DOC.split(",")]
                out = pa.StructArray.from_arrays(
                    [rb.column(0).slice(x, y - x), *[pa.array(f, pa.int64()) for f in figures],
                     pa.array(al.digests(), pa.string())], names=["_row", *names])
                one = lambda v: pa.ListArray.from_arrays([0, len(v)], v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), one(out), one(pa.array(pairs, pa.int64())), one(pa.array(n, pa.int64())),
                     pa.array([zlib.compress(at.astype("<u4").view("<u2").reshape(-1, 2).T.tobytes(), 1)], pa.binary())], names=["block", "docs", "pairs", "n", "links"])
                block += 1

    return src.mapInArrow(run, schema)


def pair_counts(encoded: DataFrame) -> DataFrame:
    """One row per linked id pair: pair (A's id in the upper 32 bits), n (links
    over the corpus) and best (no pair of the same B id has more)."""
    pairs = (encoded.select(F.explode(F.arrays_zip("pairs", "n")).alias("p"))
                    .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.n").alias("n")))
    pairs = step(pairs.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "pair-counts")
    top = pairs.groupBy("b").agg(F.max("n").alias("top"))
    return pairs.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id",
          text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, n_overlaps, n_shared (links of the two products) and groups_sha256."""
    prepare(docs.sparkSession)
    encoded = step(_encode(docs, _shared(docs, path_a, path_b), [id_col], text), "aligned")
    figures = (encoded.select("block", F.posexplode("pairs").alias("at", "pair")).join(pair_counts(encoded), "pair")
                      .groupBy("block").agg(F.collect_list(F.struct("at", "n", "best")).alias("figures")))
    both = encoded.select("block", "docs", "links").join(figures, "block", "left").select("docs", "links", "figures")
    row_type = encoded.schema["docs"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i in range(rb.num_rows):
                found = rb.column(0).slice(i, 1).flatten()
                halves = np.frombuffer(zlib.decompress(rb.column(1)[i].as_py()), "<u2").reshape(2, -1)
                link = halves[0] | halves[1].astype(np.uint32) << 16
                fig = rb.column(2).slice(i, 1).flatten()
                at, n, best = (np.asarray(fig.field(k).to_numpy(zero_copy_only=False)) for k in range(3))
                count, top = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                count[at], top[at] = n, best
                edge = np.append(0, np.cumsum(found.field(found.type.get_field_index("n_links")).to_numpy()))
                sums = [np.diff(np.append(0, np.cumsum(v[link]))[edge]) for v in (count, top)]
                yield pa.RecordBatch.from_arrays([found, *[pa.array(s, pa.int64()) for s in sums]], names=["d", "count_sum", "n_best"])

    out = both.mapInArrow(run, f"d {row_type}, count_sum bigint, n_best bigint")
    return out.select(F.col(f"d._row.`{id_col}`").alias("doc_id"), *[F.col(f"d.{c}").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")],
                      "n_best", "count_sum", "d.n_overlaps", "d.n_shared", "d.groups_sha256")


def _per_text(docs: DataFrame, shared, id_col: str, text: str, parts, out_type: str, names: list[str]) -> DataFrame:
    """Rows of arrays that ``parts`` yields for the tokens of one text, in bounded pieces."""
    src = docs.select(F.struct(F.col(f"`{id_col}`")).alias("_row"), F.col(f"`{text}`").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for rb in batches:
            for i, t in enumerate(texts_of(rb)):
                for arrays in parts(encoder.align([t])):
                    if len(arrays[0]):
                        row = rb.column(0).take(pa.array(np.full(len(arrays[0]), i)))
                        yield pa.RecordBatch.from_arrays([row, *[pa.array(x, pa.int64()) for x in arrays]], names=["_row", *names])

    out = src.mapInArrow(run, f"_row {src.schema['_row'].dataType.simpleString()}, {out_type}")
    return out.select(F.col(f"_row.`{id_col}`").alias("doc_id"), *names)


def overlap_links(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per overlap link: doc_id, the tokens' places and ids, overlap in bytes and end_together (0 / 1)."""
    prepare(docs.sparkSession)

    def parts(al: Aligned):
        for r, c, v in al.overlaps():
            yield r, c, al.a[r], al.b[c], v, al.end_a[r] == al.end_b[c]

    names = ["a_at", "b_at", "a_id", "b_id", "n_bytes", "end_together"]
    return _per_text(docs, _shared(docs, path_a, path_b), id_col, text, parts, ", ".join(f"{n} bigint" for n in names), names)


def shared_group_links(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """One row per shared-group link: doc_id, the tokens' places and ids and their group."""
    prepare(docs.sparkSession)

    def parts(al: Aligned):
        n, ga = int(al.last_a.sum()), al.group_a
        right = Csr.of_owners(al.group_b, n).transpose()
        done = np.append(0, np.cumsum(product_sizes(Csr.of_owners(ga, n), right)))
        i = 0
        while i < len(ga):  # rows whose products together are bounded (a row is bounded by its group)
            stop = max(i + 1, int(np.searchsorted(done, done[i] + _WINDOW, "right")) - 1)
            r, c, _ = product(Csr.of_owners(ga[i:stop], n), right)
            yield r + i, c, al.a[r + i], al.b[c], ga[r + i]
            i = stop

    names = ["a_at", "b_at", "a_id", "b_id", "group_at"]
    return _per_text(docs, _shared(docs, path_a, path_b), id_col, text, parts, ", ".join(f"{n} bigint" for n in names), names)
