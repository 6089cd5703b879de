"""Batches of texts to token ids with the ``tokenizers`` library, in bounded memory.

A tokenizer's own pre-tokenisation ends a token at certain white space whatever
stands around it, so a text's ids are those of its chunks in order. Each
distinct chunk of a batch is encoded by the library once, and known chunks of
earlier batches are kept in the worker up to ``KEEP`` of them. Where a chunk
may be cut is a property of the tokenizer (``CUTS``):

``drop``    white space never reaches a token: chunks are what stands between
            ASCII white space.
``before``  a lone space belongs to the word after it, and any other lone
            ASCII white-space character is a token of its own. Runs of white
            space are not cut, and a text with white space beyond ASCII is
            one chunk.
            ``drop`` and ``before`` also cut between an ASCII letter and the
            ASCII punctuation after it, which no token of theirs spans.
``whole``   every text is one chunk (any other tokenizer).

Chunks are told apart by a 64-bit hash (below one collision in 10^5 runs over
10^7 distinct chunks).
"""

from __future__ import annotations

import re
import sys

import numpy as np

CUTS = {"byte_bpe_50k.json": "before", "word_bpe_49k.json": "drop"}
KEEP = 1_000_000
STEP = 1 << 20           # bytes of texts encoded at a time, or one text
PIECE = 1 << 18          # bytes hashed at a time
JOINED = 1 << 14         # characters the library encodes at a time

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_ODD = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]")
_ODD_BYTES = [b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e",
              b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\xef\xbb\xbf"]


def default_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encode(texts)`` gives (ids of all texts, number of ids of each)."""

    def __init__(self, path: str, cut: str | None = None):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.cut = cut or CUTS.get(path.rsplit("/", 1)[-1], "whole")
        added = self.lib.get_added_tokens_decoder()
        self.added = [t.content.encode() for t in added.values()]
        sep = next((k for k, t in sorted(added.items()) if not (t.lstrip or t.rstrip or t.single_word or t.normalized)), None)
        self.sep, self.sep_id = (None, None) if sep is None else (added[sep].content, sep)
        rng = np.random.default_rng(20240607)
        self.byte = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
        self._forget()

    def _forget(self):
        self.h, self.at, self.n = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.flat = np.empty(0, np.uint32)

    def _chunks(self, b: np.ndarray, raw: bytes, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all chunks of the documents at [first, last) in the buffer, in order."""
        full = last > first
        if self.cut == "drop":
            s = _SPACE[b]
            edge = np.flatnonzero(s[1:] != s[:-1]) + 1  # the buffer begins and ends with a newline
            more = self._marks(b, raw)
            starts, ends = np.sort(np.concatenate([edge[0::2], more])), np.sort(np.concatenate([edge[1::2], more]))
            return starts, ends
        heads, tails = first[full], last[full]
        if self.cut == "whole":
            return heads, tails
        s = _SPACE[b]
        lone = s.copy()
        lone[1:] &= ~s[:-1]
        lone[:-1] &= ~s[1:]
        at = np.flatnonzero(lone)
        other = at[b[at] != 32]
        starts = np.concatenate([at, other + 1, self._marks(b, raw)])
        if any(x in raw for x in _ODD_BYTES):
            odd = np.array([_ODD.search(raw[i:j].decode()) is not None for i, j in zip(heads, tails)], bool)
            if odd.any():
                starts = starts[~odd[np.clip(np.searchsorted(heads, starts, "right") - 1, 0, None)]]
        # the buffer's first and last bytes and the newlines between documents are no starts
        inside = np.searchsorted(heads, starts, "right") - 1
        starts = starts[(inside >= 0) & (starts < tails[np.clip(inside, 0, None)])] if len(heads) else starts[:0]
        starts = np.unique(np.concatenate([heads, starts]))
        return starts, np.minimum(np.append(starts[1:], len(b)), tails[np.searchsorted(heads, starts, "right") - 1])

    def _marks(self, b: np.ndarray, raw: bytes) -> np.ndarray:
        """Places of ASCII punctuation right after an ASCII letter; none where a special token occurs."""
        if any(x in raw for x in self.added):
            return np.empty(0, np.int64)
        return np.flatnonzero(_LETTER[b[:-1]] & _MARK[b[1:]]) + 1

    def _hash(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        out = size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        total = np.cumsum(size)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PIECE, "right")))
            n = size[i:j]
            if n.max(initial=0) > len(self.power):
                self.power = np.cumprod(np.full(int(n.max()), 0x9E3779B97F4A7C15, np.uint64))
            before = np.cumsum(n) - n
            within = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(before, n)
            out[i:j] += np.add.reduceat(self.byte[b[np.repeat(starts[i:j], n) + within]] * self.power[within], before)
            i = j
        return out ^ (out >> np.uint64(31))

    def _learn(self, raw: bytes, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode new distinct chunks and add them to what is known."""
        ids, counts = [], np.zeros(len(h), np.int64)
        todo, size = [], 0

        def flush():
            nonlocal todo, size
            if not todo:
                return
            got = np.array(self.lib.encode(self.sep.join(t for _, t in todo), add_special_tokens=False).ids, np.uint32)
            cut = np.flatnonzero(got == self.sep_id)
            k = [x for x, _ in todo]
            counts[k] = np.diff(np.concatenate([[-1], cut, [len(got)]])) - 1
            ids.append(np.delete(got, cut))
            todo, size = [], 0

        for k in range(len(h)):
            chunk = raw[starts[k]:ends[k]]
            if self.sep is None or any(x in chunk for x in self.added):
                flush()
                got = np.array(self.lib.encode(chunk.decode(), add_special_tokens=False).ids, np.uint32)
                counts[k] = len(got)
                ids.append(got)
                continue
            todo.append((k, chunk.decode()))
            size += len(chunk) + 1
            if size > JOINED:
                flush()
        flush()
        at = (np.cumsum(counts) - counts + len(self.flat)).astype(np.int32)
        self.flat = np.concatenate([self.flat, *ids])
        h = np.concatenate([self.h, h])
        order = np.argsort(h, kind="stable")  # two sorted runs: merged in linear time
        self.h = h[order]
        self.at = np.concatenate([self.at, at])[order]
        self.n = np.concatenate([self.n, counts.astype(np.int32)])[order]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.cumsum([len(t) + 1 for t in texts])
        cuts = np.searchsorted(size, np.arange(STEP, size[-1] if len(texts) else 0, STEP), "right").tolist()
        cuts = sorted({0, *cuts, len(texts)})
        got = [self._encode(texts[i:j]) for i, j in zip(cuts, cuts[1:])]
        return np.concatenate([np.empty(0, np.uint32), *[ids for ids, _ in got]]), np.concatenate([np.empty(0, np.int64), *[n for _, n in got]])

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b"\n" + b"\n".join(texts) + b"\n"
        b = np.frombuffer(raw, np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        first = 1 + np.cumsum(size + 1) - (size + 1)
        starts, ends = self._chunks(b, raw, first, first + size)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        h = self._hash(b, starts, ends)
        distinct, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.h, distinct)
        new = np.ones(len(distinct), bool) if not len(self.h) else self.h[np.clip(place, 0, len(self.h) - 1)] != distinct
        if new.any():
            if len(self.h) + int(new.sum()) > KEEP and len(self.h):
                self._forget()
                new[:] = True
            self._learn(raw, distinct[new], starts[where[new]], ends[where[new]])
            place = np.searchsorted(self.h, distinct)
        n = self.n[place][inverse]
        upto = np.cumsum(n)
        ids = self.flat[np.repeat(self.at[place][inverse] - (upto - n), n) + np.arange(int(upto[-1]))]
        ends_at = np.concatenate([[0], upto])[np.searchsorted(starts, np.append(first, len(b)), "left")]
        return ids, np.diff(ends_at)


def encoder(path: str, cut: str | None = None) -> Encoder:
    """This worker's encoder for a tokenizer file; it outlives a task, as workers do."""
    kept = sys.__dict__.setdefault("_kept_encoders", {})
    if (path, cut) not in kept:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        kept[path, cut] = Encoder(path, cut)
    return kept[path, cut]


def batches(column, limit: int = 1 << 22):
    """An Arrow string column as lists of UTF-8 texts (null: empty) of about ``limit`` bytes; yields (offset, texts)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + limit, "right")))
        yield i, [t or b"" for t in column.slice(i, j - i).cast(pa.large_binary()).to_pylist()]
        i = j
