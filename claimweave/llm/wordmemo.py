"""Tokenisation with the tokenizers library where each distinct piece of text is encoded once per process.

Both tokenizers here cut a text into pre-tokens before they merge, and no merge crosses a pre-token.
A text may therefore be cut at any place that is a pre-token border in every context, its pieces
encoded one by one, and the ids joined: the ids are those of the whole text.  The pieces repeat a
great deal, so a batch of texts is cut by Arrow, only its distinct pieces are looked up in the memo,
only those that it lacks go through the library, many in one call, and numpy lays the ids out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

#: Pieces longer than this are encoded but not kept.
KEEP_CHARS = 48
#: Pieces that one process keeps: those used among the last half of as many.
KEEP_PIECES = 600_000
#: Pieces that go through the library as one text.
JOINED = 200
#: Bytes of texts that are laid out at once, by words and by a byte-level tokenizer.
BATCH_BYTES, SPACED_BYTES = 4_000_000, 8_000_000
_LOADED: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """ids (packed) of pieces, by one tokenizer; with their spans if asked for.

    Pieces of a byte-level tokenizer carry the blank before them, others are parted by one.
    """

    def __init__(self, spec: str, spans: bool = False, keep: int = KEEP_PIECES):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 65536 else "<u4")
        self.spans = spans
        self.keep = keep // 4 if spans else keep
        self.ids: dict[str, bytes | tuple[bytes, bytes]] = {}
        self.older: dict[str, bytes | tuple[bytes, bytes]] = {}
        # Of a byte-level tokenizer each character of a token stands for one byte, so tokens tell their places without offsets.
        plain = isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and self.tokenizer.normalizer is None and not spans
        self.n_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64) if plain else None
        self.names = pa.array([self.tokenizer.id_to_token(i) or "" for i in range(size)]) if self.tokenizer.decoder is None else None

    def whole(self, text: str) -> bytes:
        """ids of one text straight from the library."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _library(self, texts: list[list[str]]) -> list:
        """ids (and spans) of the pieces of each text, where a text is its pieces one after another."""
        if self.n_bytes is not None:
            return self._by_bytes(texts)
        gap, wide, out = " ", self.dtype.itemsize, []
        for pieces, e in zip(texts, self.tokenizer.encode_batch([gap.join(p) for p in texts], add_special_tokens=False), strict=True):
            length = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) + len(gap)
            first = np.cumsum(length) - length
            ids, spans = e.ids, e.offsets
            at = np.fromiter(map(itemgetter(0), spans), dtype=np.int64, count=len(ids))
            ends = np.searchsorted(at, np.append(first[1:], np.iinfo(np.int64).max))
            packed, cuts = np.array(ids, dtype=self.dtype).tobytes(), [0, *ends.tolist()]
            own = [packed[a * wide : b * wide] for a, b in zip(cuts, cuts[1:], strict=False)]
            if self.spans:
                stop = np.fromiter(map(itemgetter(1), spans), dtype=np.int64, count=len(ids))
                rel = (np.stack([at, stop], axis=1) - np.repeat(first, np.diff(cuts))[:, None]).astype("<u4").tobytes()
                own = [(i, rel[a * 8 : b * 8]) for i, a, b in zip(own, cuts, cuts[1:], strict=False)]
            out += own
        return out

    def _by_bytes(self, texts: list[list[str]]) -> list[bytes]:
        """_library() for byte-level tokenizers: a token belongs to the piece in which its first byte lies."""
        wide, out = self.dtype.itemsize, []
        for pieces, e in zip(texts, self.tokenizer.encode_batch_fast(list(map("".join, texts)), add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=self.dtype)
            if len(pieces) == 1:
                out.append(ids.tobytes())
                continue
            stop = np.cumsum(self.n_bytes[ids])
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, pieces)), dtype=np.int64, count=len(pieces)))
            # The first token that starts at or behind a piece's end; before the last piece's end all have started.
            cuts = [0, *(np.searchsorted(stop[:-1], ends[:-1]) + 1).tolist(), len(ids)]
            packed = ids.tobytes()
            out += [packed[a * wide : b * wide] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def of(self, pieces: list[str]) -> list:
        """What the memo has of each (distinct) piece; what it lacks goes through the library."""
        if len(self.ids) > self.keep // 2:
            self.older, self.ids = self.ids, {}
        got = list(map(self.ids.get, pieces))
        gaps = []
        for k in [k for k, g in enumerate(got) if g is None]:
            p = pieces[k]
            if p in self.older:
                got[k] = self.ids[p] = self.older[p]
            else:
                gaps.append(k)
        # White space at a piece's border (but for one blank before it), or a very long piece, must not meet its neighbours.
        if self.n_bytes is None:
            odd = [k for k in gaps if (p := pieces[k]).strip() != p or not p or len(p) > KEEP_CHARS]
        else:
            odd = [k for k in gaps if (p := pieces[k])[:1] != " " or p.strip() != p[1:] or not 1 < len(p) <= KEEP_CHARS]
        alone = set(odd)
        plain = [k for k in gaps if k not in alone] if odd else gaps
        groups = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)] + [[k] for k in odd]
        for at in range(0, len(groups), 16):
            some = groups[at : at + 16]
            for k, entry in zip([k for g in some for k in g], self._library([[pieces[k] for k in g] for g in some]), strict=True):
                got[k] = entry
        for k in gaps:
            if len(pieces[k]) <= KEEP_CHARS:
                self.ids[pieces[k]] = got[k]
        return got

    def rest(self) -> None:
        """Between tasks only the newer half of the memo stays: the process may go on to other work."""
        self.older = {}

    def decode(self, ids: list[np.ndarray]) -> pa.Array:
        """The texts of several sequences of ids, special tokens included."""
        if self.names is None:
            return pa.array(self.tokenizer.decode_batch([i.tolist() for i in ids], skip_special_tokens=False), pa.string())
        # A tokenizer without a decoder joins its tokens by blanks.
        flat = np.concatenate(ids) if ids else np.zeros(0, dtype=self.dtype)
        offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), self.names.take(pa.array(flat))), " ")


def piece_encoder(spec: str, spans: bool = False, keep: int = KEEP_PIECES) -> PieceEncoder:
    """The process's encoder for a tokenizer given as its JSON text."""
    key = f"{len(spec)}:{hash(spec)}:{spans}:{keep}"
    if key not in _LOADED:
        _LOADED[key] = PieceEncoder(spec, spans, keep)
    return _LOADED[key]


def _gather(values: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[first[k] : first[k] + length[k]] for all k, one after another."""
    end = np.cumsum(length)
    return values[np.repeat(first - (end - length), length) + np.arange(end[-1] if len(end) else 0)]


def _lay_out(enc: PieceEncoder, entries: list[bytes], which: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """ids of texts whose pieces are entries[which[cuts[k] : cuts[k + 1]]]."""
    length = np.fromiter(map(len, entries), dtype=np.int64, count=len(entries)) // enc.dtype.itemsize
    flat, n = np.frombuffer(b"".join(entries), dtype=enc.dtype), length[which]
    ids = _gather(flat, (np.cumsum(length) - length)[which], n).tobytes()
    ends = (np.concatenate([[0], np.cumsum(n)])[cuts] * enc.dtype.itemsize).tolist()
    return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _batches(texts: list[str] | pa.Array, n_bytes: int):
    """Slices of texts of about n_bytes, as Arrow arrays."""
    rows = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    size = np.cumsum(pc.binary_length(rows).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(rows):
        stop = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + n_bytes, side="right")))
        yield rows.slice(first, stop - first)
        first = stop


#: A blank that may not start a pre-token of its own: white space on its left, none but white space or the end right.
_UNSAFE = r"[\s\v\x{1c}-\x{1f}\x{85}\pZ] (?:[\s\v\x{1c}-\x{1f}\x{85}\pZ]|\z)"


#: A letter and what ends its run: the border between them is a pre-token border in every context.
_WORD_END = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([\t-\r!-@\[-`{-~])"
#: Marks borders; texts that hold it go through the library whole.
_CUT = "\x00"


def _encode(enc: PieceEncoder, rows: pa.Array, odd: np.ndarray, pieces: pa.ListArray) -> Iterator[bytes]:
    """ids of each text: those marked odd straight from the library, the others from their pieces."""
    coded = pieces.flatten().dictionary_encode()
    cuts, which = pieces.offsets.to_numpy().astype(np.int64), coded.indices.to_numpy().astype(np.int64)
    cuts -= cuts[0] if len(cuts) else 0
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    full = [k for k, w in enumerate(words) if w]  # splitting leaves empty pieces
    entries: list[bytes] = [b""] * len(words)
    for k, e in zip(full, enc.of([words[k] for k in full]), strict=True):
        entries[k] = e
    done = iter(_lay_out(enc, entries, which, cuts))
    for k, o in enumerate(odd.tolist()):
        yield enc.whole(rows[k].as_py()) if o else next(done)


def encode_spaced(enc: PieceEncoder, texts: list[str] | pa.Array, special: str | None = None) -> list[bytes]:
    """ids of whole texts by a byte-level tokenizer whose pre-tokens take one leading blank.

    A blank starts a pre-token if what follows is no white space (the blank joins it) or if what
    precedes is none (a white-space run starts), and a run of letters ends where no letter follows,
    so that a word and the mark behind it are pieces of their own.  Texts with another kind of
    blank, or that hold the special token's string, go through the library whole.
    """
    out: list[bytes] = []
    for rows in _batches(texts, SPACED_BYTES):
        odd = pc.match_substring_regex(rows, _UNSAFE).to_numpy(zero_copy_only=False)
        for s in (_CUT, special) if special else (_CUT,):
            odd = odd | pc.match_substring(rows, s).to_numpy(zero_copy_only=False)
        words = pc.replace_substring_regex(rows.filter(pa.array(~odd)), _WORD_END, rf"\1{_CUT}\2")
        out += _encode(enc, rows, odd, pc.split_pattern(pc.replace_substring(words, " ", f"{_CUT} "), _CUT))
    return out


#: White space that Arrow and str.split() know and the tokenizer's pattern does not.
_ODD_BLANK = re.compile("[\x1c-\x1f]")


def encode_words(enc: PieceEncoder, texts: list[str] | pa.Array) -> list[bytes]:
    """ids of whole texts by a tokenizer that drops white space and never joins across it."""
    out: list[bytes] = []
    for rows in _batches(texts, BATCH_BYTES):
        odd = pc.match_substring_regex(rows, r"[\x{1c}-\x{1f}]").to_numpy(zero_copy_only=False)
        out += _encode(enc, rows, odd, pc.utf8_split_whitespace(rows.filter(pa.array(~odd))))
    return out


_WORD = re.compile(r"\S+")


def encode_with_spans(enc: PieceEncoder, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, first and last character (exclusive) of each token of one text, for a tokenizer as in encode_words (enc.spans set)."""
    if _ODD_BLANK.search(text):
        e = enc.tokenizer.encode(text, add_special_tokens=False)
        at = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
        return np.array(e.ids, dtype=enc.dtype), at[:, 0], at[:, 1]
    found = [(m.group(), m.start()) for m in _WORD.finditer(text)]
    index: dict[str, int] = {}
    which = np.fromiter((index.setdefault(w, len(index)) for w, _ in found), dtype=np.int64, count=len(found))
    entries = enc.of(list(index))
    ids, spans = (np.frombuffer(b"".join(e[k] for e in entries), dtype=t) for k, t in ((0, enc.dtype), (1, "<u4")))
    length = np.fromiter((len(e[0]) for e in entries), dtype=np.int64, count=len(entries)) // enc.dtype.itemsize
    first, n = (np.cumsum(length) - length)[which], length[which]
    rel, at = _gather(spans.reshape(-1, 2), first, n), np.repeat(np.fromiter((s for _, s in found), dtype=np.int64, count=len(found)), n)
    return _gather(ids, first, n), rel[:, 0] + at, rel[:, 1] + at
