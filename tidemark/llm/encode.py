"""Token ids of Arrow batches of texts, through a cache of pieces of text.

Both tokenizers end a token before a single blank or line feed between two other characters, and before full stops
and commas after a Latin letter or digit, and read nothing across; so a text's ids are those of its pieces. A text with
any other run of white space is encoded as a whole.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space at an end or beside other white space, or the separator that the split uses.
ODD = f"^{_WHITE}|{_WHITE}$|{_WHITE}{_WHITE}|\x1f"
#: Pieces that the cache holds before it starts anew, and bytes of text encoded at a time.
CACHE, CHUNK = 1_500_000, 4 << 20


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1 ... start[i] + count[i] - 1, for each i in turn."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - count), count)


def relax() -> None:
    """Gives memory that is free again back to the system: workers are reused, and two share an executor's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Encoder:
    """keep_space: a piece after the first begins with its space."""

    def __init__(self, path: str, keep_space: bool, end: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.keep_space, self.end = keep_space, end
        self.clear()

    def clear(self) -> None:
        """The cache: 128-bit hashes of pieces, sorted by their first half, and the place of each piece's ids."""
        self.key, self.check, self.row = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.start, self.count = np.zeros(0, np.uint16 if self.tokenizer.get_vocab_size() <= 65_536 else np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def known(self, pieces: list[bytes]) -> np.ndarray:
        """Row of each piece in the cache, which learns those it lacks. Pieces may repeat."""
        from xxhash import xxh3_128_digest

        if len(self.key) + len(pieces) > CACHE:
            self.clear()
        both = np.frombuffer(b"".join(map(xxh3_128_digest, pieces)), np.uint64).reshape(-1, 2)
        key, check = both[:, 0].copy(), both[:, 1].copy()
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        found = (self.key[at] == key) & (self.check[at] == check) if len(self.key) else np.zeros(len(key), bool)
        rows = np.full(len(key), -1, np.int64)
        rows[found] = self.row[at[found]]
        new = np.flatnonzero(~found)
        if len(new):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i].decode() for i in new], add_special_tokens=False)]
            count = np.fromiter(map(len, ids), np.int32, len(ids))
            rows[new] = len(self.count) + np.arange(len(new))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count, dtype=np.int64) - count])
            self.count = np.concatenate([self.count, count])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), self.flat.dtype, int(count.sum()))])
            keys = np.concatenate([self.key, key[new]])
            order = np.argsort(keys, kind="stable")
            self.key, self.check, self.row = keys[order], np.concatenate([self.check, check[new]])[order], np.concatenate([self.row, rows[new].astype(np.int32)])[order]
        return rows

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids in each text); each text ends with the end id."""
        odd = pc.match_substring_regex(texts, ODD)
        cut = pc.replace_substring_regex(texts, r"([0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([.,]+)([ \n])", "\\1\x1f\\2\\3")
        if self.keep_space:
            cut = pc.replace_substring(pc.replace_substring(cut, "\n", "\x1f\n\x1f"), " ", "\x1f ")
        else:  # drops white space and case
            cut = pc.replace_substring(pc.replace_substring(pc.ascii_lower(cut), "\n", "\x1f"), " ", "\x1f")
        # an odd text may hold the separator itself: it stays whole
        lists = pc.split_pattern(pc.if_else(odd, pa.scalar("x"), cut), "\x1f")
        flat, per_text = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = np.cumsum(per_text) - per_text
        coded = flat.dictionary_encode()
        pieces, index = coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy().copy()
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        index[firsts[whole]] = len(pieces) + np.arange(len(whole))
        rows = self.known(pieces + texts.take(pa.array(whole, pa.int64())).cast(pa.large_binary()).to_pylist())[index]
        count = self.count[rows]
        ids = self.flat[ragged(self.start[rows], count)]
        sums = np.concatenate([[0], np.cumsum(count)])
        ends = sums[firsts + per_text]
        return np.insert(ids, ends, self.end), np.diff(np.concatenate([[0], ends])) + 1

    def chunks(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, ids in each text) over slices of about CHUNK bytes."""
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right")))
            yield at, *self.encode(texts.slice(at, upto - at))
            relax()
            at = upto


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, keep_space: bool, end: int) -> Encoder:
    """One for each Python worker."""
    key = (path, keep_space, end)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The texts of a batch, null as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.large_string()), "")
