"""Token ids of whole texts with a public byte-pair vocabulary, by distinct pieces.

The vocabulary lower-cases, drops white space and cuts text by a pattern into runs of letters, single digits and runs of
other signs before it merges bytes, so a text's ids are the ids of its pieces one after the other. For plain words (ASCII
and the Latin letters that have one composed form) the cut is a change of character class, which numpy finds for a whole
block of texts at once; every distinct piece is merged once by the tokenizer and kept in a bounded cache. Words with
anything else (other scripts, apostrophes, control characters, the start of a special token) are given to the tokenizer whole.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa

CACHE_ENTRIES = 400_000
BATCH = 1024

_BYTE = np.arange(256)
_SPACE = np.isin(_BYTE, [0x20, *range(0x09, 0x0E)])
_UPPER = (_BYTE >= 0x41) & (_BYTE <= 0x5A)
_LETTER = _UPPER | ((_BYTE >= 0x61) & (_BYTE <= 0x7A))
_DIGIT = (_BYTE >= 0x30) & (_BYTE <= 0x39)
_ODD = ((_BYTE < 0x20) & ~_SPACE) | (_BYTE == 0x7F) | (_BYTE == 0x27)
_SOLID = ~_SPACE
_KIND = _LETTER.astype(np.uint8) + 2 * _DIGIT.astype(np.uint8)
_LOWER = (_BYTE + 0x20 * _UPPER).astype(np.uint8)
#: Second bytes, after 0xC3, of the letters from U+00C0 to U+00FF (two of these code points are signs).
_LATIN = (_BYTE >= 0x80) & (_BYTE <= 0xBF) & (_BYTE != 0x97) & (_BYTE != 0xB7)


def _after(mask: np.ndarray) -> np.ndarray:
    out = np.zeros_like(mask)
    out[1:] = mask[:-1]
    return out


def _before(mask: np.ndarray) -> np.ndarray:
    out = np.zeros_like(mask)
    out[:-1] = mask[1:]
    return out


def cut_pieces(raw: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Start of each piece in ``raw``, the pieces (lower case if plain), and which of them are words kept whole."""
    solid, kind, lowered, odd = _SOLID[raw], _KIND[raw], _LOWER[raw], _ODD[raw]
    high = raw >= 0x80
    odd |= (raw == 0x3C) & _before(raw == 0x7C)
    if high.any():
        second = _after(raw == 0xC3) & _LATIN[raw]
        latin = second | _before(second)
        kind[latin] = 1
        odd |= high & ~latin
        lowered[second & (raw <= 0x9E)] += 0x20
    word = solid & ~_after(solid)
    begin = (kind != np.concatenate([[3], kind[:-1]])) | (kind == 2) | word
    begin &= solid
    whole = np.zeros(0, bool)
    if odd.any():
        number = np.cumsum(word) - 1
        odd_word = np.zeros(number[-1] + 1, bool)
        odd_word[number[odd]] = True
        inside = odd_word[number] & solid
        begin &= ~inside | word
        lowered = np.where(inside, raw, lowered)
        whole = inside
    at = np.flatnonzero(begin)
    offsets = np.append(np.cumsum(solid, dtype=np.int32)[at] - 1, np.count_nonzero(solid)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(lowered[solid])])
    return at, pieces, whole[at] if len(whole) else np.zeros(len(at), bool)


class PieceIds:
    """Ids of texts, little-endian uint32; holds at most ``CACHE_ENTRIES`` pieces besides those of the block at hand.

    A block looks each of its distinct pieces up once, in a table of places; the ids themselves lie in one array.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        # One tokenizer, of which only the front changes: its own for whole words, and for pieces that are already
        # normalised and cut one that maps bytes to their letters. The vocabulary is held once.
        self.tokenizer = Tokenizer.from_file(path)
        bare = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.fronts = {True: (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer), False: (normalizers.Sequence([]), bare)}
        self.front = True
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a piece
        for token, i in vocab.items():
            self.last[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool = np.zeros(0, "<u4")  # ids of the known pieces
        self.first = self.count = np.zeros(0, np.int64)  # place and number of each one's

    def _encode(self, texts: list[str], whole: bool) -> list[np.ndarray]:
        if whole != self.front:
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.fronts[whole]
            self.front = whole
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end, and the number of each one's."""
        ids = self._encode([w.decode("utf-8", "replace") for w in words], True)
        return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """One call for many pieces: each gives ids of which only the last ends a piece."""
        ids = self._encode([b" ".join(pieces).decode("utf-8", "replace")], False)[0]
        ends = np.flatnonzero(self.last[ids]) + 1 if len(ids) else np.zeros(0, int)
        if len(ends) != len(pieces) or ends[-1] != len(ids):
            return self._whole(pieces)
        return ids, np.diff(ends, prepend=0)

    def _learn(self, names: np.ndarray, whole: np.ndarray) -> None:
        """Append the ids of new pieces."""
        pools, base = [self.pool], len(self.pool)
        first, count = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for at, ids_of in ((np.flatnonzero(~whole), self._merged), (np.flatnonzero(whole), self._whole)):
            for begin in range(0, len(at), BATCH):
                part = at[begin : begin + BATCH]
                ids, own = ids_of(names[part].tolist())
                first[part], count[part] = base + np.cumsum(own) - own, own
                pools.append(ids)
                base += len(ids)
        self.known.update(zip(names.tolist(), range(len(self.first), len(self.first) + len(names))))
        self.pool = np.concatenate(pools)
        self.first, self.count = np.append(self.first, first), np.append(self.count, count)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each text's begin (one more entry at the end). Call it with a few MB at a time."""
        parts = [t.encode("utf-8", "replace") for t in texts]
        raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        at, pieces, whole = cut_pieces(raw)
        coded = pieces.dictionary_encode()
        names, codes = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        if len(self.known) > CACHE_ENTRIES:
            self._forget()
        place = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(place < 0)
        if len(new):
            is_whole = np.zeros(len(names), bool)
            is_whole[codes[whole]] = True
            place[new] = len(self.first) + np.arange(len(new))
            self._learn(names[new], is_whole[new])
        own = self.count[place]
        count = own[codes]
        end = np.cumsum(count)
        ids = self.pool[np.repeat(self.first[place][codes] - (end - count), count) + np.arange(end[-1] if len(end) else 0)]
        first = np.searchsorted(at, np.cumsum(lengths) - lengths)
        begins = np.append(np.concatenate([[0], end])[first], len(ids))
        return ids, begins
