"""Language-model scoring by word n-grams: Elias-Fano tries of all counts, one per part of the contexts.

Every word has a number of its own.  The most frequent ones (``VOCABULARY`` at most, the one bounded table that is
broadcast) have it where texts are read; all others get it, with their exact count, from the bucket of their hash: buckets
number the training words they hold, and words that no training text has share one number.  Every word, pair and
triple counts, however rare, so what is gathered grows with the texts.  A caller who names a `size` gets a closed
vocabulary instead: its rarer words are one class, and a rarer word costs its class in context and its own share of the class.

Texts are read in chunks.  A chunk keeps its tokens and asks each bucket for the numbers of its rarer words, once per
word.  Then it sends each token with the two words before it, u and v, to the part of its context: one part per v, and,
where v has more than ``PART_TOKENS`` training tokens, one per v and class of u, as many classes as v has that many
tokens.  (The middle level of such a context is counted per class, so that no part needs another's counts; u and v
together are not split further.)  Equal texts of a chunk travel once.  Each part builds its trie from its training tokens,
scores all its tokens by it, and answers each chunk with a sum per text; chunks add their answers up.

A trie's levels are flat arrays in one anonymous mapping: contexts, under each its words w (pairs) and
its words u, and under each u again its words w (triples).  Children are word numbers made one
increasing sequence by adding the last value of the context before; monotone pointers lead from a node
to its children; both are Elias-Fano coded and stay packed to the bit, with a count of ones per 64 bits
to select by.  Probabilities are 16-bit codes.  A child is found by a successor search for its word number plus
the context's base, within the context's range.

Smoothing is absolute discounting: every count gives up ``DISCOUNT``, and what a context's children
give up goes to the next lower order.  Among rarer words the discounts of single words go to unseen words, as
many as the seen ones.  A context's probabilities sum to one.

Defined results: null, empty and blank texts hold the end token alone; repeated rows repeat in the
result; ids may be null; without training text all counts are zero and scores are those of unseen
words; further columns are not carried.
"""

from __future__ import annotations

import mmap
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_words, materialize

DISCOUNT = 0.75
#: Word numbers: before a text, after it (as u: nothing), an unseen word (with a closed vocabulary any rarer one), the vocabulary, then the rarer words.
START, END, RARE, FIRST_WORD = 0, 1, 2, 3
VOCABULARY = 131_072
PART_TOKENS = 1 << 19
#: Words of a bucket.
BUCKET_WORDS = 100_000
CHUNK_TOKENS = 1 << 20
#: Words that a trie scores at once.
SLICE = 65_536
FLUSH = 300_000


# ---- Elias-Fano sequences ----------------------------------------------------------------------

#: Place of the k-th one within a byte.
_PLACE = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], dtype=np.uint8)


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of `width` bits, at most 56, one after another; eight more bytes let every one be read as part of a 64-bit word."""
    size = -(-len(values) * width // 8) + 8
    out = np.zeros(size, dtype=np.uint8)
    for k in range(0, len(values) if width else 0, 1 << 16):  # a multiple of 8 numbers ends at a byte
        bits = (values[k : k + (1 << 16), None] >> np.arange(width)) & 1
        some = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        out[k * width // 8 : k * width // 8 + len(some)] = some
    return out


class Sequence:
    """A non-decreasing sequence: low bits packed to their width, high bits in unary, and the ones before every 64 bits."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, unary: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bits, self.low, self.unary, self.ranks = n, low_bits, low, unary, ranks

    def _low(self, at: np.ndarray) -> np.ndarray:
        """Low bits of the values at the places `at`."""
        if not self.low_bits:
            return np.zeros(len(at), dtype=np.int64)
        words = np.ndarray(len(self.low) - 7, dtype="<i8", buffer=self.low, strides=(1,))  # one at every byte
        bit = at * self.low_bits
        return (words[bit >> 3] >> (bit & 7)) & ((1 << self.low_bits) - 1)

    @classmethod
    def of(cls, values: np.ndarray) -> Sequence:
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        if low_bits > 56:
            raise ValueError("values too far apart to pack")
        low = _pack_bits(values & ((1 << low_bits) - 1), low_bits)
        high = values >> low_bits
        size = n + (int(high[-1]) + 1 if n else 0) + 1
        bits = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
        bits[high + np.arange(n)] = 1
        ones = bits.reshape(-1, 64).sum(axis=1, dtype=np.int64)
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), (np.cumsum(ones) - ones).astype(np.uint32))

    def _select(self, k: np.ndarray, ranks: np.ndarray, flip: int) -> np.ndarray:
        """Place of the k-th one (flip 0) or zero (flip 255)."""
        word = np.searchsorted(ranks, k, side="right") - 1
        rest = k - ranks[word]
        own = self.unary.view("<u8")[word]
        own = ~own if flip else own
        place = word * 64
        for step in (32, 16, 8):  # down to the byte that holds it
            ones = np.bitwise_count(own & np.uint64((1 << step) - 1))
            up = rest >= ones
            rest -= ones * up
            own >>= up * np.uint64(step)
            place += up * step
        return place + _PLACE[own & np.uint64(255), rest]

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self._select(at, self.ranks, 0) - at) << self.low_bits) | self._low(at)

    def _begin(self, high: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part."""
        zeros, before = np.maximum(high, 1) - 1, np.arange(len(self.ranks)) * 64 - self.ranks
        return np.where(high > 0, self._select(zeros, before, 255) - zeros, 0)

    def find(self, value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of each value within [begin, end), or -1: the successor within the run of its high part."""
        begin, end = np.broadcast_to(begin, value.shape), np.broadcast_to(end, value.shape)
        out = np.full(len(value), -1, dtype=np.int64)
        if not self.n:
            return out
        last = int(self._select(np.array([self.n - 1]), self.ranks, 0)[0]) - (self.n - 1)
        high = value >> self.low_bits
        ok = np.flatnonzero(high <= last)
        high, want = high[ok], value[ok] & ((1 << self.low_bits) - 1)
        at, stop = np.maximum(begin[ok], self._begin(high)), np.minimum(end[ok], np.where(high < last, self._begin(high + 1), self.n))
        low, high = at, stop.copy()
        left = np.flatnonzero(low < high)
        while len(left):  # by halves: the words of a context may stand close together
            mid = (low[left] + high[left]) >> 1
            less = self._low(mid) < want[left]
            low[left], high[left] = np.where(less, mid + 1, low[left]), np.where(less, high[left], mid)
            left = left[low[left] < high[left]]
        hit = np.flatnonzero(low < stop)
        hit = hit[self._low(low[hit]) == want[hit]]
        out[ok[hit]] = low[hit]
        return out


class Codes:
    """log10 probabilities as 16-bit codes between the smallest and the largest."""

    def __init__(self, codes: np.ndarray, low: float, step: float):
        self.codes, self.low, self.step = codes, low, step

    @classmethod
    def of(cls, values: np.ndarray) -> Codes:
        low, high = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
        step = (high - low) / 65535 or 1.0
        return cls(np.rint((values - low) / step).astype(np.uint16), low, step)

    def get(self, at: np.ndarray) -> np.ndarray:
        return self.low + self.step * self.codes[at]


class Level:
    """Children of the nodes of the level above."""

    def __init__(self, words: Sequence, pointers: Sequence, score: Codes, back: Codes):
        self.words, self.pointers, self.score, self.back = words, pointers, score, back

    @classmethod
    def of(cls, n_parents: int, parent: np.ndarray, word: np.ndarray, score: np.ndarray, back: np.ndarray) -> Level:
        """parent and word sorted by (parent, word)."""
        pointers = np.searchsorted(parent, np.arange(n_parents + 1))
        last = word[pointers[1:][np.diff(pointers) > 0] - 1] if len(word) else np.zeros(0, dtype=np.int64)
        base = np.zeros(n_parents + 1, dtype=np.int64)  # sum of the last words of the contexts before
        base[1:][np.diff(pointers) > 0] = last + 1
        base = np.cumsum(base)
        return cls(Sequence.of(word + base[parent] if len(word) else word), Sequence.of(pointers.astype(np.int64)), Codes.of(score), Codes.of(back))

    def find(self, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Node of each word among the children of parent (-1: no such parent), or -1."""
        out = np.full(len(parent), -1, dtype=np.int64)
        ok = np.flatnonzero(parent >= 0)
        if not self.words.n or not len(ok):
            return out
        begin, end = self.pointers.get(parent[ok]), self.pointers.get(parent[ok] + 1)
        base = np.where(begin > 0, self.words.get(np.maximum(begin, 1) - 1) + 1, 0)
        out[ok] = self.words.find(word[ok] + base, begin, end)
        return out


def _smooth(context: np.ndarray, n: np.ndarray, size: int, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each n-gram given the next lower order's, and the weight that each of `size` contexts leaves to it."""
    total, kinds = (np.bincount(context, weights=w, minlength=size) for w in (n, np.ones(len(n))))
    back = DISCOUNT * kinds / np.maximum(total, 1)
    return (n - DISCOUNT) / total[context] + back[context] * lower, back


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted numbers, and the place of each number's value among them."""
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return ordered[new], np.cumsum(new) - 1


class Trie:
    """Contexts (increasing numbers), the pairs and triples under them, and what each leaves to the lower order."""

    def __init__(self, context: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray, unigram: np.ndarray):
        """Triples with their counts, sorted by context, u and w; unigram: log10 probability of each word."""
        self.unigram = unigram
        names, at = _runs(context)
        wide = len(unigram)
        pair, of_pair = np.unique(at * wide + w, return_inverse=True)
        c2 = np.bincount(of_pair, weights=n, minlength=len(pair))
        p2, back1 = _smooth(pair // wide, c2, len(names), 10 ** unigram[pair % wide])
        side, of_side = _runs(at * wide + u)
        p3, back2 = _smooth(of_side, n.astype(float), len(side), p2[of_pair])
        log = lambda x: np.log10(np.maximum(x, 1e-12))
        none = np.zeros(0)
        self.contexts, self.back1 = Sequence.of(names), Codes.of(log(back1))
        self.pairs = Level.of(len(names), pair // wide, pair % wide, log(p2), none)
        self.sides = Level.of(len(names), side // wide, side % wide, none, log(back2))
        self.triples = Level.of(len(side), of_side, w, log(p3), none)
        self._map()

    def _map(self) -> None:
        """Moves all arrays into one anonymous mapping."""
        spots = [(self.contexts, k) for k in ("low", "unary", "ranks")] + [(self.back1, "codes")]
        for level in (self.pairs, self.sides, self.triples):
            spots += [(s, k) for s in (level.words, level.pointers) for k in ("low", "unary", "ranks")] + [(level.score, "codes"), (level.back, "codes")]
        sizes = [-(-getattr(o, k).nbytes // 8) * 8 for o, k in spots]
        data, at = mmap.mmap(-1, sum(sizes) + 8), 0
        for (o, k), size in zip(spots, sizes, strict=True):
            a = getattr(o, k)
            view = np.frombuffer(data, dtype=a.dtype, count=len(a), offset=at)
            view[:] = a
            setattr(o, k, view)
            at += size

    def score(self, context: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 probability of each word w after u in a context."""
        slices = [slice(k, k + SLICE) for k in range(0, max(1, len(w)), SLICE)]
        return np.concatenate([self._score(context[s], u[s], w[s]) for s in slices])

    def _score(self, context: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        node = self.contexts.find(context, np.zeros_like(context), np.full_like(context, self.contexts.n))
        side, pair = self.sides.find(node, u), self.pairs.find(node, w)
        triple = self.triples.find(side, w)
        pick = lambda codes, at, other: np.where(at >= 0, codes.get(np.maximum(at, 0)), other) if len(codes.codes) else np.zeros(len(at)) + other
        low = pick(self.pairs.score, pair, self.unigram[w] + pick(self.back1, node, 0.0))
        return pick(self.triples.score, triple, low + pick(self.sides.back, side, 0.0))


# ---- counting words ----------------------------------------------------------------------------


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n over all texts; each task adds up its own words first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(held)
            for k in range(0, len(words), 20_000):
                part = words[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([held[w] for w in part], pa.int64())], names=["word", "n"])
            held.clear()

        for b in batches:
            for text in b.column(0):
                held.update(lower_words(text.as_py()))
                if len(held) > FLUSH:
                    yield from flush()
        yield from flush()

    return docs.select(text_col).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The most frequent words, numbered by falling count, and what is known of the others."""

    #: Whether the others have numbers of their own, from len(counts) on.
    open = False

    def __init__(self, words: list[bytes], counts: list[int], n_docs: int, rare: int, rare_kinds: int):
        self.ids = {w: k + FIRST_WORD for k, w in enumerate(words)}
        self.counts = np.array([0, n_docs, rare, *counts], dtype=np.int64)
        self.n_tokens, self.n_words, self.rare, self.rare_kinds = int(self.counts.sum()), len(words) + rare_kinds + (n_docs > 0), rare, rare_kinds
        follows = np.array([n_docs, 0, rare, *counts], dtype=np.int64)  # START is a context once a text, END never
        self.classes = np.maximum(1, -(-follows // PART_TOKENS))
        share = self.counts + 0.0
        share[RARE] += 1
        self.unigram = np.log10(np.maximum(share, 0.5) / (self.n_tokens + 1))
        self.places = np.cumsum(self.classes) - self.classes  # contexts of the words before

    def contexts(self, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Number of each context: v and, where it is split, the class of u."""
        return v * (1 << 32) + self._class(v, u)

    def dense(self, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The contexts in the same order, numbered without gaps over all words."""
        known = len(self.counts) - 1
        return np.where(v > known, self.classes.sum() + v - known - 1, self.places[np.minimum(v, known)]) + self._class(v, u)

    def _class(self, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        known = len(self.counts) - 1
        return _mix(u.astype(np.uint64) + np.uint64(1)).astype(np.int64) % np.where(v > known, 1, self.classes[np.minimum(v, known)])

    def alone(self, n: np.ndarray) -> np.ndarray:
        """log10 share that a rarer word of count n has among the rarer and unseen words."""
        return np.log10(np.where(n > 0, n - DISCOUNT, DISCOUNT * (self.rare_kinds + 1) / max(1, self.rare_kinds)) / (self.rare + DISCOUNT))

    def unigrams(self, n: np.ndarray) -> np.ndarray:
        """log10 probability of each word of the vocabulary, then of rarer words of counts n."""
        own = self.unigram.copy()
        if self.open:
            own[RARE] += self.alone(np.zeros(1))[0]
        return np.concatenate([own, self.unigram[RARE] + self.alone(n)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return (x ^ (x >> np.uint64(33))) >> np.uint64(1)


def vocabulary(counts: DataFrame, n_docs: int, size: int | None = None) -> Vocabulary:
    """The most frequent words of word_counts(), at most `size`, beyond which they are one class; without one, VOCABULARY at most, beyond which words are open.

    Counts are cut into eighths of an octave, and the highest classes that fit together are taken, so the
    driver gets a row per class and the words taken, whatever the number of words and partitions.
    """
    grade = F.floor(F.log2("n") * 8)
    grades = sorted(((r["g"], r["kinds"], r["n"]) for r in counts.groupBy(grade.alias("g")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).collect()), reverse=True)
    kinds = np.cumsum([k for _, k, _ in grades])
    fit = int(np.searchsorted(kinds, VOCABULARY if size is None else size, side="right"))
    top = counts.where(grade >= grades[fit - 1][0]).collect() if fit else []
    top = sorted(((r["n"], bytes(r["word"])) for r in top), key=lambda x: (-x[0], x[1]))
    words = Vocabulary([w for _, w in top], [n for n, _ in top], n_docs, sum(n for _, _, n in grades) - sum(n for n, _ in top), sum(k for _, k, _ in grades) - len(top))
    words.open = size is None
    if words.rare_kinds > 1 << 31:
        raise ValueError("too many words for numbers of 32 bits")
    return words


# ---- scoring -----------------------------------------------------------------------------------


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers below 2**32 by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.stack(columns).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(raw: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(columns, -1)


_HEAD = ("tokens", "lengths", "learn", "texts")


def _arrow(names: str, **columns) -> pa.Table:
    """A table of the named columns; those not given are null."""
    rows = max(len(c) for c in columns.values())
    return pa.table([columns.get(x, pa.nulls(rows)) for x in names.split()], names=names.split())


def _ids(df: DataFrame) -> str:
    return f"ids array<{df.schema['doc_id'].dataType.simpleString()}>"


def _chunks(docs: DataFrame, shared, n_buckets: int) -> DataFrame:
    """Per chunk a row for each bucket with the rarer words it is asked for, and one with the chunk's texts as tokens; rarer words count on from the vocabulary."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, seq = shared.value, TaskContext.get().partitionId(), 0
        get, top = words.ids.get, len(words.counts)
        texts: dict[str, int] = {}
        odd: dict[bytes, int] = {}
        rows: list[tuple] = []
        streams: list[np.ndarray] = []
        held, kind = 0, pa.int64()

        def chunk() -> pa.RecordBatch:
            number, asked, bucket = (task << 32) + seq, list(odd), _buckets(odd, n_buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=n_buckets))
            groups = [order[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
            no = len(groups)
            text = np.array([r[1] for r in rows], dtype=np.int64)
            learn = np.bincount(text, weights=[r[2] for r in rows], minlength=len(streams)).astype(np.int64)
            head = {"tokens": _pack(np.concatenate(streams)), "lengths": _pack(np.array([len(x) for x in streams])), "learn": _pack(learn), "texts": _pack(text)}
            return pa.RecordBatch.from_arrays(
                [pa.array([*bucket[order][cuts[:-1]].tolist(), number % n_buckets], pa.int64()), pa.array([number] * (no + 1), pa.int64()), pa.array([*(_join(asked[i] for i in g) for g in groups), None], pa.binary()), pa.array([*(_pack(np.diff(g, prepend=0)) for g in groups), None], pa.binary()),
                 pa.array([None] * no + [[r[0] for r in rows]], pa.list_(kind)), *(pa.array([None] * no + [head[k]], pa.binary()) for k in _HEAD)],
                names=["bucket", "chunk", "words", "at", "ids", *_HEAD],
            )

        for b in batches:
            kind = b.schema.field(0).type
            for d, t, learn in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = t or ""
                if key not in texts:
                    texts[key] = len(streams)
                    own = [get(x) or odd.setdefault(x, top + len(odd)) for x in lower_words(t)]
                    streams.append(np.array([START, *own, END], dtype=np.int64))
                    held += len(own) + 2
                rows.append((d, texts[key], int(learn)))
                if held > CHUNK_TOKENS or len(rows) > FLUSH:
                    yield chunk()
                    texts, odd, rows, streams, held, seq = {}, {}, [], [], 0, seq + 1
        if rows:
            yield chunk()

    return docs.mapInArrow(blocks, f"bucket bigint, chunk bigint, words binary, at binary, {_ids(docs)}, {', '.join(f'{k} binary' for k in _HEAD)}")


def _join(words) -> bytes:
    """Words as bytes; a word holds no blank."""
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def _split(raw: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(raw).split(b" ")


def _buckets(words, n_buckets: int) -> np.ndarray:
    return np.array([zlib.crc32(x) % n_buckets for x in words], dtype=np.int64)


def _rarer(counts: DataFrame, shared, n_buckets: int) -> DataFrame:
    """Rows of each bucket with training words beyond the vocabulary and their counts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value.ids
        for b in batches:
            own = [(w, n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if w not in ids]
            bucket = _buckets((w for w, _ in own), n_buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=n_buckets))
            groups = [order[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
            blobs = [_join(own[i][0] for i in g) for g in groups], [np.array([own[i][1] for i in g], dtype="<i8").tobytes() for g in groups]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts[:-1]]), *(pa.array(x, pa.binary()) for x in blobs)], names=["bucket", "words", "n"])

    return counts.select("word", "n").mapInArrow(pack, "bucket bigint, words binary, n binary")


def _numbers(shared, n_buckets: int):
    names = " ".join(["chunk at numbers n ids", *_HEAD])

    def numbers(table: pa.Table) -> pa.Table:
        """For each chunk the numbers and counts of the words it asked a bucket for; a chunk's own row goes through."""
        top, known = len(shared.value.counts), {}
        for raw, n in zip(*(table.filter(table.column("n").is_valid()).column(k).to_pylist() for k in ("words", "n")), strict=True):
            for w, k in zip(_split(raw), np.frombuffer(n, dtype="<i8").tolist(), strict=True):
                known[w] = (len(known), k)
        asked = table.filter(table.column("at").is_valid())
        if asked.num_rows and known:
            bucket = zlib.crc32(next(iter(known))) % n_buckets
        numbers, counts = [], []
        for raw in asked.column("words").to_pylist():
            found = [known.get(w) for w in _split(raw)]
            numbers.append(_pack(np.array([RARE if x is None else top + x[0] * n_buckets + bucket for x in found])))
            counts.append(_pack(np.array([0 if x is None else x[1] for x in found])))
        heads = table.filter(table.column("tokens").is_valid())
        mine = _arrow(names, chunk=asked.column("chunk"), at=asked.column("at"), numbers=pa.array(numbers, pa.binary()), n=pa.array(counts, pa.binary()))
        return pa.concat_tables([mine.cast(s := _schema(table, names)), _arrow(names, chunk=heads.column("chunk"), ids=heads.column("ids"), **{k: heads.column(k) for k in _HEAD}).cast(s)])

    return numbers


def _schema(table: pa.Table, names: str) -> pa.Schema:
    """Columns as they come in; new ones are bytes."""
    return pa.schema([(x, pa.int64() if x in ("chunk", "part") else table.schema.field("ids").type if x == "ids" else pa.binary()) for x in names.split()])


def _contexts(shared, n_parts: int):
    names = "chunk part blob ids texts told"

    def contexts(table: pa.Table) -> pa.Table:
        """Of a chunk a row for each part with its tokens, and one with what is known of its texts without contexts."""
        words = shared.value
        top = len(words.counts)
        head = table.filter(table.column("tokens").is_valid())
        tokens, length, learn = (_unpack(head.column(k)[0].as_py(), 1)[0].astype(np.int64) for k in _HEAD[:3])
        answers = [[_unpack(x, 1)[0].astype(np.int64) for x in r] for r in zip(*(table.column(k).to_pylist() for k in ("at", "numbers", "n")), strict=True) if r[0] is not None]
        number, n = (np.zeros(sum(len(x[0]) for x in answers), dtype=np.int64) for _ in range(2))
        for at, own, k in answers:
            number[np.cumsum(at)], n[np.cumsum(at)] = own, k
        ids, count, odd = tokens.copy(), words.counts[np.minimum(tokens, top - 1)], np.flatnonzero(tokens >= top)
        which = tokens[odd] - top
        ids[odd], count[odd] = number[which] if words.open else RARE, n[which]
        first = np.cumsum(length) - length
        text, at = np.repeat(np.arange(len(length)), length), np.delete(np.arange(len(ids)), first)
        share = np.zeros(len(ids))
        if not words.open:
            share[odd] = words.alone(n[which])
        sums = lambda x: np.bincount(text[at], weights=x[at], minlength=len(length))
        told = np.stack([length - 1, sums(count > 0), sums(np.log10(count + 1.0)), sums(share)]).tobytes()
        v, w, u = ids[at - 1], ids[at], np.where(at - 2 >= first[text[at]], ids[np.maximum(at - 2, 0)], END)
        rarer = np.where(w >= top, count[at], 0)
        part = _mix(words.contexts(v, u).astype(np.uint64)).astype(np.int64) % n_parts
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=n_parts))
        blobs = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = order[a:b]
            t = text[at[own]]
            blobs.append(_pack(u[own], v[own], w[own], np.diff(t, prepend=0), learn[t], rarer[own]))
        chunk, schema = head.column("chunk")[0].as_py(), _schema(table, names)
        mine = _arrow(names, chunk=pa.array([chunk] * len(blobs), pa.int64()), part=pa.array(part[order][cuts[:-1]]), blob=pa.array(blobs, pa.binary()))
        own = _arrow(names, chunk=head.column("chunk"), part=pa.array([chunk % n_parts], pa.int64()), ids=head.column("ids"), texts=head.column("texts"), told=pa.array([told], pa.binary()))
        return pa.concat_tables([mine.cast(schema), own.cast(schema)])

    return contexts


def _part_scores(shared):
    names = "chunk at sums ids texts told"

    def scores(table: pa.Table) -> pa.Table:
        """The sums of each chunk's texts for one part of the contexts; a chunk's own row goes through."""
        words = shared.value
        full, schema = table.filter(table.column("blob").is_valid()), _schema(table, names)
        blobs = [_unpack(b, 6) for b in full.column("blob").to_pylist()]
        answers = []
        if blobs:
            column, top = (lambda k: np.concatenate([b[k] for b in blobs]).astype(np.int64)), len(words.counts)
            u, v, w = column(0), column(1), column(2)
            odd = np.unique(np.concatenate([x[x >= top] for x in (u, v, w)]))
            # Rarer words are numbered anew within the part.
            place = lambda x: np.where(x >= top, top + np.searchsorted(odd, x), x) if len(odd) else x
            context, u, w = words.dense(place(v), u), place(u), place(w)
            del v
            n = np.zeros(len(odd), dtype=np.int64)
            n[w[w >= top] - top] = column(5)[w >= top]
            unigram = words.unigrams(n)
            wide = len(unigram)
            if int(words.classes.sum() + len(odd)) * wide * wide < 1 << 62:
                triple, which = np.unique((context * wide + u) * wide + w, return_inverse=True)
                side, y = np.divmod(triple, wide)
            else:
                names_, of = np.unique(context * wide + u, return_inverse=True)
                triple, which = np.unique(of * wide + w, return_inverse=True)
                side, y = names_[triple // wide], triple % wide
            c, x = np.divmod(side, wide)
            del context, u, w, side
            count = np.bincount(which, weights=column(4), minlength=len(triple)).astype(np.int64)
            seen = count > 0
            score = Trie(c[seen], x[seen], y[seen], count[seen], unigram).score(c, x, y)[which]
            ends = np.cumsum([b.shape[1] for b in blobs])
            for b, end in zip(blobs, ends, strict=True):
                text, own = np.unique(np.cumsum(b[3], dtype=np.int64), return_inverse=True)
                answers.append((_pack(np.diff(text, prepend=0)), np.bincount(own, weights=score[end - b.shape[1] : end]).astype("<f4").tobytes()))
        heads = table.filter(table.column("blob").is_null())
        mine = _arrow(names, chunk=full.column("chunk"), at=pa.array([a for a, _ in answers], pa.binary()), sums=pa.array([s for _, s in answers], pa.binary()))
        return pa.concat_tables([mine.cast(schema), _arrow(names, chunk=heads.column("chunk"), **{k: heads.column(k) for k in ("ids", "texts", "told")}).cast(schema)])

    return scores


def _chunk_sums(table: pa.Table) -> pa.Table:
    """doc_id, n_tokens, known, base, score of a chunk's rows."""
    head = table.filter(table.column("told").is_valid())
    told = np.frombuffer(head.column("told")[0].as_py()).reshape(4, -1)
    sums = told[3].copy()
    for at, own in zip(table.column("at").to_pylist(), table.column("sums").to_pylist(), strict=True):
        if own is not None:
            sums[np.cumsum(_unpack(at, 1)[0], dtype=np.int64)] += np.frombuffer(own, "<f4")
    row = _unpack(head.column("texts")[0].as_py(), 1)[0]
    ids = head.column("ids").combine_chunks().flatten()
    return pa.table([ids, pa.array(told[0].astype(np.int64)[row]), pa.array(told[1].astype(np.int64)[row]), pa.array(told[2][row]), pa.array(sums[row])], names=["doc_id", "n_tokens", "known", "base", "score"])


def score_all(docs: DataFrame, learn_col: str, id_col: str = "doc_id", text_col: str = "text", size: int | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs, by a model of the rows where learn_col holds.

    With a size the vocabulary is closed: the rarer words are one class in pairs and triples.
    """
    spark = docs.sparkSession
    learnt = F.coalesce(F.col(f"`{learn_col}`").cast("boolean"), F.lit(False))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), learnt.alias("learn"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = materialize(word_counts(rows.where("learn")), "words")
    words = vocabulary(counts, rows.where("learn").count(), size)
    shared = spark.sparkContext.broadcast(words)
    n_tokens, n_words, n_parts = words.n_tokens, words.n_words, words.n_tokens // PART_TOKENS + 1
    n_buckets = max(n_parts, words.rare_kinds // BUCKET_WORDS + 1)
    head = f"ids array<{kind}>, " + ", ".join(f"{k} binary" for k in _HEAD)
    asked = _chunks(rows, shared, n_buckets).unionByName(_rarer(counts, shared, n_buckets), allowMissingColumns=True)
    numbered = asked.groupBy("bucket").applyInArrow(_numbers(shared, n_buckets), f"chunk bigint, at binary, numbers binary, n binary, {head}")
    told = numbered.groupBy("chunk").applyInArrow(_contexts(shared, n_parts), f"chunk bigint, part bigint, blob binary, ids array<{kind}>, texts binary, told binary")
    parts = told.groupBy("part").applyInArrow(_part_scores(shared), f"chunk bigint, at binary, sums binary, ids array<{kind}>, texts binary, told binary")
    out = parts.groupBy("chunk").applyInArrow(_chunk_sums, f"doc_id {kind}, n_tokens bigint, known bigint, base double, score double")
    base = F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(n_tokens + n_words + 1)))
    return out.select("doc_id", "n_tokens", F.col("known").alias("n_known"), F.lit(n_tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")
