"""BPE encoding and decoding by tree concatenation.

Texts up to ``leaf_chars`` characters are encoded where they are scanned.  A longer text is halved
until no part is longer than ``leaf_chars``; the parts (leaves) become rows, so that executors
encode them in parallel, and are joined again pairwise up the tree.  Around each join a window of
the text is encoded anew and grows until, on either side, it holds a run of tokens that the side
holds too, at the same place; the tokens between the two runs replace those around the join.

Why that is exact: a sequence is the encoding of its text if each neighbouring pair of tokens is
the encoding of its own text.  Left of the first run every pair stands in the left part, between
the runs in the window, right of the second in the right part; so all pairs are sound.  Where no
runs agree, the window grows to the two parts whole and is the answer by itself.

Defined results: null text counts as empty; empty texts give no ids and an empty decoded text;
special-token strings inside a text are encoded as the tokenizer itself does; repeated rows each
give a row; ids may be null or repeat; further columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back
from .wordmemo import PieceEncoder, encode_with_spans, encode_words, piece_encoder

#: Tokens that must agree on either side of a join.
RUN = 3
#: Characters of the first window on either side of a join.
WINDOW = 96
#: Pieces that a process keeps: its workers hold texts, ids and decoded texts beside them.
KEEP = 300_000
OUT = "doc_id bigint, n_tokens bigint, ids binary, decoded string"


def load_spec(path: str) -> str:
    """A tokenizer file as text; executors get this text, not the path."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class Tokens:
    """Ids with the character span that each covers in the text."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.ids, self.start, self.end = ids, start, end

    @classmethod
    def of(cls, enc: PieceEncoder, text: str, at: int = 0) -> Tokens:
        e = enc.tokenizer.encode(text, add_special_tokens=False)
        spans = np.array(e.offsets, dtype=np.int64).reshape(-1, 2) + at
        return cls(np.array(e.ids, dtype=np.int64), spans[:, 0], spans[:, 1])

    def cut(self, a: int | None, b: int | None) -> Tokens:
        return Tokens(self.ids[a:b], self.start[a:b], self.end[a:b])

    def then(self, *more: Tokens) -> Tokens:
        parts = [self, *more]
        return Tokens(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("ids", "start", "end")))


def _runs(side: Tokens, window: Tokens) -> list[tuple[int, int]]:
    """Places (in side, in window) where RUN tokens agree in id and span, on whole characters."""
    if len(side.ids) < RUN or len(window.ids) < RUN:
        return []
    where = {(int(i), int(s), int(e)): k for k, (i, s, e) in enumerate(zip(window.ids, window.start, window.end, strict=True))}
    first = np.searchsorted(side.start, window.start[0])
    last = np.searchsorted(side.start, window.end[-1], side="right")
    at = [where.get((int(side.ids[k]), int(side.start[k]), int(side.end[k])), -1) for k in range(first, last)]
    found = []
    for k in range(len(at) - RUN + 1):
        w = at[k]
        if w < 0 or any(at[k + j] != w + j for j in range(1, RUN)):
            continue
        own = side.start[first + k : first + k + RUN + 1]
        if (np.diff(own) > 0).all() and (first + k == 0 or side.end[first + k - 1] <= own[0]) and (w == 0 or window.end[w - 1] <= own[0]):
            found.append((first + k, w))
    return found


def join_halves(enc: PieceEncoder, text: str, left: Tokens, right: Tokens, lo: int, mid: int, hi: int) -> Tokens:
    """Encoding of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
    reach = WINDOW
    while True:
        a, b = max(lo, mid - reach), min(hi, mid + reach)
        window = Tokens.of(enc, text[a:b], a)
        if a == lo and b == hi:
            return window
        head = [(0, 0)] if a == lo else _runs(left, window)
        tail = [(len(right.ids), len(window.ids))] if b == hi else _runs(right, window)
        for p, w in reversed(head):
            end = next(((q, v) for q, v in tail if v >= w), None)
            if end and (w > 0 or a == lo):
                return left.cut(None, p).then(window.cut(w, end[1]), right.cut(end[0], None))
        reach *= 2


def borders(n: int, leaf: int, lo: int = 0) -> list[int]:
    """Where a text of n characters is cut: halves of halves until none is longer than leaf."""
    if n <= leaf:
        return [lo]
    half = n // 2
    return borders(half, leaf, lo) + borders(n - half, leaf, lo + half)


def join_tree(enc: PieceEncoder, text: str, leaves: list[Tokens], leaf: int, lo: int = 0, n: int | None = None) -> Tokens:
    """Join leaves in the order and shape in which borders() cut them.  Takes leaves from the front of the list."""
    n = len(text) if n is None else n
    if n <= leaf:
        return leaves.pop(0)
    half = n // 2
    left = join_tree(enc, text, leaves, leaf, lo, half)
    right = join_tree(enc, text, leaves, leaf, lo + half, n - half)
    return join_halves(enc, text, left, right, lo, lo + half, lo + n)


def encode_long(enc: PieceEncoder, text: str, leaf: int) -> np.ndarray:
    """The whole tree in one place (for tests and small use)."""
    cuts = [*borders(len(text), leaf), len(text)]
    leaves = [Tokens.of(enc, text[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return join_tree(enc, text, leaves, leaf).ids


def _finish(enc: PieceEncoder, doc_ids: list, packed: list[bytes]) -> pa.RecordBatch:
    ids = [np.frombuffer(p, dtype=enc.dtype) for p in packed]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()), enc.decode(ids)],
        names=["doc_id", "n_tokens", "ids", "decoded"],
    )


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers by byte plane: small ones leave runs of zeros that a shuffle's compression takes away."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def encode_decode(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = 16384) -> DataFrame:
    """Ids (little-endian unsigned 32-bit, packed) and decoded text of every row of docs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    leaf_cols = "doc_id bigint, digest string, copies bigint, at bigint, part string, ids binary, gap binary, width binary"

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = piece_encoder(shared.value, keep=KEEP)
        for b in batches:
            for k in range(0, b.num_rows, 2500):
                part = b.slice(k, 2500)
                yield _finish(enc, part.column(0).to_pylist(), encode_words(enc, part.column(1)))
        b = part = None
        enc.rest()
        give_back()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "digest", "at", "part"]
        for b in batches:
            for k in range(b.num_rows):
                d, digest, text = (c[k].as_py() for c in b.columns)
                at = borders(len(text), leaf_chars)
                for m in range(0, len(at), 256):
                    own, ends = at[m : m + 256], [*at[m + 1 : m + 257], len(text)]
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(own), pa.int64()), pa.array([digest] * len(own)), pa.array(own, pa.int64()), pa.array([text[x:y] for x, y in zip(own, ends, strict=False)])], names=names)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = piece_encoder(shared.value, spans=True, keep=KEEP)
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64).to_pydict()
                got = [encode_with_spans(enc, t) for t in part["part"]]
                part["ids"] = [i.tobytes() for i, _, _ in got]
                part["gap"] = [_planes(np.diff(s, prepend=0)) for _, s, _ in got]
                part["width"] = [_planes(e - s) for _, s, e in got]
                yield pa.RecordBatch.from_pydict(part, schema=leaf_schema)
        b = part = got = None
        enc.rest()
        give_back()

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        enc = piece_encoder(shared.value, keep=KEEP)
        pdf = pdf.sort_values("at")
        text, tokens = "".join(pdf["part"]), []
        for at, ids, gap, width in zip(pdf["at"], pdf["ids"], pdf["gap"], pdf["width"], strict=True):
            start = np.cumsum(_from_planes(gap)) + at
            tokens.append(Tokens(np.frombuffer(ids, enc.dtype).astype(np.int64), start, start + _from_planes(width)))
        whole = join_tree(enc, text, tokens, leaf_chars)
        done = _finish(enc, [None], [whole.ids.astype(enc.dtype).tobytes()]).to_pandas()
        done["doc_id"] = pd.array([None if pd.isna(key[0]) else int(key[0])], dtype="Int64")
        return done.loc[done.index.repeat(int(pdf["copies"].iloc[0]))]

    leaf_schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("copies", pa.int64()), ("at", pa.int64()), ("part", pa.string()), ("ids", pa.binary()), ("gap", pa.binary()), ("width", pa.binary())])
    n_chars = F.length("text")
    direct = rows.where(n_chars <= leaf_chars).mapInArrow(short, OUT)
    # Equal rows are joined once: the text itself is the same, so any of their leaves serves.
    parts = rows.where(n_chars > leaf_chars).select("doc_id", F.sha2("text", 256).alias("digest"), "text").mapInArrow(cut, "doc_id bigint, digest string, at bigint, part string")
    once = parts.groupBy("doc_id", "digest", "at").agg(F.count("*").alias("copies"), F.first("part").alias("part")).select("doc_id", "digest", "copies", "at", "part")
    joined = once.mapInArrow(leaves, leaf_cols).groupBy("doc_id", "digest").applyInPandas(join, OUT)
    return direct.unionByName(joined)
