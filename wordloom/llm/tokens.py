"""Token ids of whole text columns under a byte-level BPE vocabulary.

A text is cut into the vocabulary's pieces (a run of letters, digits or other signs
with the space before it, or white space) with whole-array operations on code points.
Pieces repeat, so each Python worker keeps the ids of the pieces it has met, by their
bytes and up to a bounded number, and calls the tokenizer for the others only.  The ids are those that
the tokenizer file gives for the whole text; tests hold them against it.
"""

from __future__ import annotations

import json
import sys
import unicodedata

import numpy as np

from . import words

VOCABULARY = "byte_bpe_50k.json"
#: Pieces of which a worker keeps the ids; beyond it, the kept ones are forgotten.
KEPT_PIECES = 200_000
#: A piece of more bytes goes to the tokenizer each time.
LONGEST_KEPT = 128
#: Ids beyond which the kept ones are forgotten.
LARGEST_POOL = 8_000_000

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
#: Code points of Unicode's property White_Space.
_WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_table: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of each code point: letter, number, white space, other."""
    if not _table:
        kinds = {"L": _LETTER, "N": _NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        table[list(_WHITE)] = _SPACE
        _table.append(table)
    return _table[0]


def pieces(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts; offsets are where the texts start and end."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    turn = first[:n].copy()
    turn[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    last = np.zeros(n, bool)  # the last of a run of white space that a text goes on after
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    joins = last & (points == 32)  # belongs to the piece after it
    start = turn & ~space
    start[1:] &= ~joins[:-1]
    start |= last
    start |= turn & space
    # 's 't 're 've 'm 'll 'd where a piece begins with the sign.
    for i in np.flatnonzero((points == 39) & start).tolist():
        tail = points[i + 1 : i + 3]
        end = int(offsets[np.searchsorted(offsets, i, "right")])
        tail = "".join(map(chr, tail[: max(0, end - i - 1)].tolist()))
        size = 2 if tail[:1] in ("s", "t", "m", "d") else 3 if tail in ("re", "ve", "ll") else 0
        if size and not (i + 1 < n and kind[i + 1] == _OTHER):
            start[i + 1 : i + size] = False
            if i + size < n:
                start[i + size] = not joins[i + size - 1]
    return np.flatnonzero(start)


class Encoder:
    """The ids of texts; made once for each Python worker and vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.whole = Tokenizer.from_file(path)
        self.part = self._piecewise(spec)
        self.forget()

    def _piecewise(self, spec: dict):
        """ids of one piece, by the file's merges; None if the file cuts or changes texts in another way than pieces() does."""
        before = spec.get("pre_tokenizer") or {}
        parts = before.get("pretokenizers", [before])
        plain_cut = len(parts) == 1 and parts[0].get("type") == "ByteLevel" and not parts[0].get("add_prefix_space") and parts[0].get("use_regex", True)
        if spec.get("normalizer") or not plain_cut or spec["model"].get("type") != "BPE" or spec["model"].get("ignore_merges") or spec["model"].get("dropout"):
            return None
        vocabulary = spec["model"]["vocab"]
        # The file's alphabet: printable bytes stand for themselves, the others follow from 256 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        try:
            ranks = {bytes(sign[c] for c in token): i for token, i in vocabulary.items() if token not in self.special}
            import tiktoken

            # Ranks are ids without gaps up to the special tokens in this family of files.
            bpe = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
            ordered = all(vocabulary[a + b] == i + 256 for i, (a, b) in enumerate(merges))
            if ordered:
                return bpe._encode_single_piece
        except (ImportError, KeyError, ValueError):
            pass
        return None

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at: list[int] = []
        self.size: list[int] = []
        self.pool = np.zeros(1 << 16, np.uint16 if self.whole.get_vocab_size() < 1 << 16 else np.uint32)
        self.used = 0

    def sentence_ends(self) -> np.ndarray:
        """For each id, whether a sentence or line may end with it."""
        if not hasattr(self, "_ends"):
            n = self.whole.get_vocab_size()
            self._ends = np.array([t.endswith((".", "!", "?")) or "\n" in t for t in (self.whole.decode([i], skip_special_tokens=False) for i in range(n))], bool)
        return self._ends

    def _add(self, ids: list[int]) -> tuple[int, int]:
        """Puts ids in the pool; where they are."""
        size, at = len(ids), self.used
        if at + size > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(at + 2 * size, self.pool.dtype)])
        self.pool[at : at + size] = ids
        self.used += size
        return at, size

    def _places(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of different pieces are in the pool, and how many each has."""
        if len(self.known) + len(pieces) > KEPT_PIECES:
            self.forget()
        at, size = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        known, own_at, own_size = self.known, self.at, self.size
        for i, piece in enumerate(pieces):
            k = known.get(piece)
            if k is None:
                at[i], size[i] = found = self._add(self.part(piece))
                if len(piece) <= LONGEST_KEPT:
                    known[piece] = len(own_at)
                    own_at.append(found[0])
                    own_size.append(found[1])
            else:
                at[i], size[i] = own_at[k], own_size[k]
        return at, size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids start and end) for UTF-8 texts."""
        text = data.tobytes().decode("utf-8", "surrogatepass")
        if self.part is None or any(s in text for s in self.special):
            return self._by_tokenizer([data[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # byte of each code point
        edges = np.searchsorted(begins, offsets)  # texts in code points
        start = pieces(points, edges)
        found = words.segments(data, np.append(begins[start], len(data))).dictionary_encode() if len(start) else None
        if found is None:
            return np.zeros(0, self.pool.dtype), np.zeros(len(offsets), np.int64)
        at, size = self._places(found.dictionary.to_pylist())
        which = found.indices.to_numpy(zero_copy_only=False)
        size, at = size[which], at[which]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]))]
        before = np.concatenate([[0], ends])
        if self.used > LARGEST_POOL:
            self.forget()
        return ids, before[np.searchsorted(start, edges)]

    def _by_tokenizer(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.whole.encode(t, add_special_tokens=False).ids for t in texts]
        ends = np.cumsum([0, *map(len, found)])
        return np.fromiter((i for x in found for i in x), self.pool.dtype, int(ends[-1])), ends.astype(np.int64)


_encoders: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file; by default the public byte-level one."""
    path = path or default_path()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(column, path: str | None = None, most: int = words.CHUNK_BYTES):
    """(first row, ids, where each row's ids start and end) for runs of rows of a string column."""
    made = encoder(path)
    data, offsets = words.string_buffers(column)
    for a, b in words.row_groups(offsets, most):
        ids, edges = made.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, ids, edges
        del ids, edges
    words.give_back()
