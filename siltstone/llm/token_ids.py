"""Token ids of texts, made by the tokenizers library from a public vocabulary file whose path is a parameter.

A byte-level vocabulary never joins a token across the start of a run of white space, so a text falls into chunks (white
space, then other characters) whose ids do not depend on their neighbours. A worker encodes each chunk that it has not seen and
looks the others up, short ones as arrays of 64-bit words; the memory of that table is bounded. Chunks of ASCII and Latin-1 letters are cut into pieces here, which the
library's model encodes; all others, and those that hold an added token such as an end mark, are encoded by the library as a whole.
"""

from __future__ import annotations

import array
import os
import re
from collections.abc import Iterator

import numpy as np

#: Unicode's white space.
_WHITE = " \t\n\x0b\x0c\r\x85\xa0  -     　"
_CHUNK = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
#: What is letters and what is not in any version of Unicode: a space and letters, and text that pieces are cut from here.
_WORD = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+")
_PROVEN = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ]+")
#: Bounds of a worker's table, in chunks, in pieces of chunks and in characters, and of the texts that are looked up at once.
TABLE_CHUNKS, TABLE_PIECES, TABLE_CHARS = 500_000, 100_000, 12_000_000
_AT_ONCE = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")



def _shown() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it prints, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SHOWN = _shown()
#: Marks that are a piece of their own after a letter, at the end of a chunk.
_MARKS = frozenset(".,;:!?")


#: Whether a code point is white space, up to the first after the last that is.
_IS_WHITE = np.array([bool(re.fullmatch(f"[{_WHITE}]", chr(i))) for i in range(max(map(ord, _WHITE)) + 2)])
#: Latin-1's letters as in _WORD, and the marks.
_IS_LETTER = np.array([bool(re.fullmatch("[A-Za-zÀ-ÖØ-öø-ÿ]", chr(i))) for i in range(256)] + [False])
_IS_MARK = np.array([chr(i) in ".,;:!?" for i in range(256)] + [False])
#: Chunks of so many code points under 256, none of them 0, are looked up as three 64-bit words, all at once.
_SHORT = 24
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Odd factors of a hash.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mixed(words: np.ndarray) -> np.ndarray:
    h = words[:, 0] * _MIX[0]
    for k in (1, 2):
        h ^= h >> np.uint64(32)
        h = (h + words[:, k]) * _MIX[k]
    return h ^ (h >> np.uint64(29))


def _grown(a: np.ndarray, need: int) -> np.ndarray:
    if len(a) >= need:
        return a
    return np.concatenate([a, np.zeros((max(need - len(a), len(a), 1024), *a.shape[1:]), a.dtype)])


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # an added token that holds white space can span chunks: texts that hold one are encoded by the library
        self._added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._spanning = [t for t in self._added if not _CHUNK.fullmatch(t) or t[:1] in _WHITE]
        import public_tokenizers
        import regex

        self._pieces = regex.compile(public_tokenizers.PATTERN).findall
        self._reset()

    def _reset(self) -> None:
        # entries of long chunks by text; of short ones by ascending hash, with the words that the hash is of
        self.index, self.chars, self.pieces = {}, 0, {}
        self.hashes, self.entries, self.words = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, 3), np.uint64)
        self.starts, self.lengths, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.n_starts = self.n_pool = 0

    def _learn(self, words: list[str], new: list[str]) -> None:
        """Makes an entry of each word after a space, and of each other chunk, in order."""
        tokenize, flat, sizes = self.tokenizer.model.tokenize, [], []
        for word in words:
            shown = "Ġ" + word[1:] if word.isascii() else word.encode("utf-8").decode("latin-1").translate(_SHOWN)
            ids = [t.id for t in tokenize(shown)]
            sizes.append(len(ids))
            flat += ids
        made, known, learn = [], self.pieces, self._piece
        for chunk in new:
            # most chunks are a word after a space, with or without a mark at its end: one piece or two
            word, mark = (chunk, "") if chunk[-1] not in _MARKS else (chunk[:-1], chunk[-1])
            if _WORD.fullmatch(word):
                ids = known.get(word) or learn(word)
                made.append(ids + (known.get(mark) or learn(mark)) if mark else ids)
            elif _PROVEN.fullmatch(chunk) and not any(t in chunk for t in self._added):
                made.append(b"".join([known.get(piece) or learn(piece) for piece in self._pieces(chunk)]))
            else:
                made.append(np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, np.uint32).tobytes())
        lengths = np.concatenate([np.array(sizes, np.int64), np.fromiter(map(len, made), np.int64, len(made)) // 4])
        total, n = int(lengths.sum()), len(lengths)
        self.starts, self.lengths = _grown(self.starts, self.n_starts + n), _grown(self.lengths, self.n_starts + n)
        self.pool = _grown(self.pool, self.n_pool + total)
        self.starts[self.n_starts : self.n_starts + n] = self.n_pool + np.cumsum(lengths) - lengths
        self.lengths[self.n_starts : self.n_starts + n] = lengths
        self.pool[self.n_pool : self.n_pool + total] = np.concatenate([np.array(flat, np.uint32), np.frombuffer(b"".join(made), np.uint32)])
        self.n_starts, self.n_pool = self.n_starts + n, self.n_pool + total

    def _piece(self, piece: str) -> bytes:
        """A piece's ids as bytes, which Python's garbage collector passes over; a table of lists costs it as much as encoding."""
        shown = "Ġ" + piece[1:] if piece[0] == " " and piece.isascii() and piece[1:].isalpha() else piece.encode("utf-8").decode("latin-1").translate(_SHOWN)
        self.pieces[piece] = ids = array.array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
        return ids

    def _short_words(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        padded = np.zeros(len(points) + _SHORT + 8, np.uint8)
        padded[: len(points)] = points.astype(np.uint8)
        at = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
        return np.stack([at[starts + 8 * k] & _FIRST_BYTES[np.clip(lengths - 8 * k, 0, 8)] for k in range(3)], axis=1)

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        text_ends = np.cumsum([len(t) for t in texts])
        white = _IS_WHITE[np.minimum(points, len(_IS_WHITE) - 1)]
        begins = white.copy()
        begins[1:] &= ~white[:-1]
        begins[(text_ends - [len(t) for t in texts])[[bool(t) for t in texts]]] = True
        starts = np.flatnonzero(begins)
        # a word after a space is a piece of its own, and so is a mark at the end of its chunk
        narrow = np.minimum(points, 256)
        letters = _IS_LETTER[narrow]
        if len(starts):
            counts, sizes = np.add.reduceat(letters, starts, dtype=np.int64), np.diff(starts, append=len(points))
            marked = (points[starts] == 32) & (sizes > 2) & (counts == sizes - 2) & _IS_MARK[narrow[starts + sizes - 1]]
            begins[(starts + sizes - 1)[marked]] = True
            starts = np.flatnonzero(begins)
        n_chunks, lengths = len(starts), np.diff(starts, append=len(points))
        if not n_chunks:
            return [np.zeros(0, np.uint32) for _ in texts]
        wide = np.logical_or.reduceat((points > 255) | (points == 0), starts)
        short = (lengths <= _SHORT) & ~wide
        words = self._short_words(points, starts[short], lengths[short])
        hashes, first, back = np.unique(_mixed(words), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        known[place < len(self.hashes)] = self.hashes[place[place < len(self.hashes)]] == hashes[place < len(self.hashes)]
        entry = np.full(len(hashes), -1, np.int64)
        entry[known] = self.entries[place[known]]
        # other words of an equal hash are looked up as text
        clash = (words[first][back] != words).any(axis=1)
        clash |= (known & (self.words[entry] != words[first]).any(axis=1))[back] if len(self.words) else False
        rows = np.flatnonzero(short)
        texts_of = np.concatenate([np.flatnonzero(~short), rows[clash]])
        others = [joined[a : a + n] for a, n in zip(starts[texts_of].tolist(), lengths[texts_of].tolist())]
        is_word = (points[starts] == 32) & (lengths > 1) & (np.add.reduceat(letters, starts, dtype=np.int64) == lengths - 1)
        fresh = np.flatnonzero(~known)
        fresh = fresh[np.argsort(~is_word[rows[first[fresh]]], kind="stable")]
        from_short = rows[first[fresh]]
        n_words = int(is_word[from_short].sum())
        new = [joined[a : a + n] for a, n in zip(starts[from_short].tolist(), lengths[from_short].tolist())]
        new_others = [c for c in dict.fromkeys(others) if c not in self.index]
        kept = self.n_starts, self.n_pool
        if new or new_others:
            self._learn(new[:n_words], new[n_words:] + new_others)
        entry[fresh] = kept[0] + np.arange(len(new))
        self.index.update(zip(new_others, range(kept[0] + len(new), self.n_starts)))
        at = np.empty(n_chunks, np.int64)
        at[rows] = entry[back]
        at[texts_of] = [self.index[c] for c in others]
        sizes = self.lengths[at]
        after = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.starts[at] - (after - sizes), sizes) + np.arange(int(after[-1]))]
        cuts = np.concatenate(([0], after))[np.searchsorted(starts, text_ends)]
        if 4 * (self.n_starts - kept[0]) > n_chunks and self.n_starts > TABLE_CHUNKS:
            self._reset()  # other texts than those the table was made from
        elif kept[0] > TABLE_CHUNKS or self.chars > TABLE_CHARS:
            for chunk in new_others:  # the table is full: what came first, so most that is frequent, stays
                del self.index[chunk]
            self.n_starts, self.n_pool = kept
            if len(self.pieces) > TABLE_PIECES:
                self.pieces = {}
        else:
            self.hashes, self.entries = np.insert(self.hashes, place[~known], hashes[~known]), np.insert(self.entries, place[~known], entry[~known])
            self.words = _grown(self.words, self.n_starts)
            self.words[kept[0] : kept[0] + len(new)] = words[first[fresh]]
            self.chars += sum(map(len, new)) + sum(map(len, new_others))
        return np.split(ids, cuts[:-1])

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers; none for null and empty texts."""
        group: list[str] = []
        size = 0
        for t in texts:
            if t and any(x in t for x in self._spanning):
                yield from self._group(group) if group else ()
                group, size = [], 0
                yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
                continue
            group.append(t or "")
            size += len(group[-1])
            if size >= _AT_ONCE:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; Spark's workers serve many tasks, so its table is used again."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
