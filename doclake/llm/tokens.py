"""Token ids of many texts by a given tokenizer, each distinct word encoded once per worker.

For tokenizers whose tokens never reach over white space and which drop it: a text's ids are
the ids of its words in order (:class:`Coder` refuses others). Words are found and hashed by
:mod:`doclake.llm.words`; an open-addressing table of word hashes leads to the word's bytes and its ids.
Words not in the table, and words whose bytes are not those kept under their hash, go to the tokenizer.
The table is emptied when it is full, so memory is bounded and results do not change.
"""

from __future__ import annotations

import os
import re

import numpy as np

from doclake.llm import words

MAX_WORDS = 1 << 20
MAX_KEPT = 1 << 10  # bytes of a word that is kept; longer ones are encoded each time
MAX_POOL = 1 << 26  # bytes of all words that are kept
MAX_PIECES = 1 << 18
RUN = 64  # pieces that go to the model at once
# Words of ASCII and composed Latin-1 letters: their normal form is themselves in lower case.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Coder:
    """Texts to ids. ``split`` names the tokenizer's own pieces of a plain word, if it is known."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        _check_spaces(self.tokenizer, path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self._pieces = _piece_pattern(self.tokenizer)
        self._letters = _byte_letters()
        self._model = Tokenizer(self.tokenizer.model)  # for pieces, with spaces between them
        self._model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._clear_pieces()
        self._clear()

    def _clear(self) -> None:
        self.bits = 16
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.zeros(1 << self.bits, np.int32)
        self.start = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int32)
        self.pool = np.zeros(1 << 14, np.int32)
        self.word_start = np.zeros(1 << 12, np.int64)
        self.word_length = np.zeros(1 << 12, np.int64)
        self.letters = np.zeros(1 << 16, np.uint8)  # seven bytes more than are used, for reads of eight
        self.n_words = self.n_ids = self.n_letters = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        mask = np.uint64((1 << self.bits) - 1)
        place = h & mask
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        while len(todo):
            key = self.keys[place[todo]]
            hit = key == h[todo]
            out[todo[hit]] = self.at[place[todo[hit]]]
            todo = todo[~hit & (key != 0)]
            place[todo] = (place[todo] + np.uint64(1)) & mask
        return out

    def _put(self, h: np.ndarray, entry: np.ndarray) -> None:
        """Insert hashes that are not in the table and differ from each other."""
        mask = np.uint64((1 << self.bits) - 1)
        place = h & mask
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.keys[place[todo]] == 0]
            self.keys[place[free]] = h[free]  # of several for one place the last stays
            won = self.keys[place[todo]] == h[todo]
            self.at[place[todo[won]]] = entry[todo[won]]
            todo = todo[~won]
            place[todo] = (place[todo] + np.uint64(1)) & mask

    def _add(self, h: np.ndarray, found: list[bytes], flat: np.ndarray, length: np.ndarray) -> None:
        n, m = self.n_words + len(h), self.n_ids + len(flat)
        own = np.fromiter(map(len, found), np.int64, len(found))
        k = self.n_letters + int(own.sum())
        while len(self.start) < n:
            more = 2 * len(self.start)
            for name in ("start", "length", "word_start", "word_length"):
                setattr(self, name, np.resize(getattr(self, name), more))
        while len(self.pool) < m:
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        while len(self.letters) < k + 8:
            self.letters = np.resize(self.letters, 2 * len(self.letters))
        self.word_start[self.n_words : n] = self.n_letters + np.cumsum(own) - own
        self.word_length[self.n_words : n] = own
        self.letters[self.n_letters : k] = np.frombuffer(b"".join(found), np.uint8)
        self.start[self.n_words : n] = self.n_ids + np.cumsum(length) - length
        self.length[self.n_words : n] = length
        self.pool[self.n_ids : m] = flat
        while n > 1 << (self.bits - 1):
            old, at = self.keys[self.keys != 0], self.at[self.keys != 0]
            self.bits += 1
            self.keys, self.at = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(old, at)
        self._put(h, np.arange(self.n_words, n))
        self.n_words, self.n_ids, self.n_letters = n, m, k

    def _encode_words(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has."""
        plain = np.array([self._pieces is not None and "<|" not in w and _PLAIN.fullmatch(w) is not None for w in found], bool)
        ids, length = self._plain([w for w, p in zip(found, plain.tolist(), strict=True) if p])
        if plain.all():
            return ids, length
        rest = [w for w, p in zip(found, plain.tolist(), strict=True) if not p]
        other = [e.ids for e in self.tokenizer.encode_batch(rest, add_special_tokens=False)]
        count = np.zeros(len(found), np.int64)
        count[plain], count[~plain] = length, [len(i) for i in other]
        out, mine = np.zeros(int(count.sum()), np.int32), np.repeat(plain, count)
        out[mine], out[~mine] = ids, [i for one in other for i in one]
        return out, count

    def _plain(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of plain words, by the vocabulary's model alone, each distinct piece once."""
        if not found:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        pieces = self._pieces.findall("\n".join(found).lower())
        distinct = dict.fromkeys(pieces)
        new = [p for p in distinct if p not in self._known]
        if len(self._known) + len(new) > MAX_PIECES:
            self._clear_pieces()
            new = [p for p in distinct if p != "\n"]
        if new:
            letters = [p if p.isascii() else "".join([self._letters[b] for b in p.encode()]) for p in new]
            runs = [letters[i : i + RUN] for i in range(0, len(letters), RUN)]
            coded = self._model.encode_batch([" ".join(r) for r in runs], add_special_tokens=False)
            size = np.concatenate([np.bincount(np.array(e.word_ids, np.int64), minlength=len(r)) for e, r in zip(coded, runs, strict=True)])
            start = len(self._piece_ids) + np.cumsum(size) - size
            self._known.update(zip(new, range(len(self._piece_start), len(self._piece_start) + len(new)), strict=True))
            self._piece_start = np.concatenate([self._piece_start, start])
            self._piece_length = np.concatenate([self._piece_length, size])
            self._piece_ids = np.concatenate([self._piece_ids, *[np.array(e.ids, np.int32) for e in coded]])
        at = np.fromiter(map(self._known.__getitem__, pieces), np.int64, len(pieces))
        many = self._piece_length[at]
        within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        ids = self._piece_ids[np.repeat(self._piece_start[at], many) + within]
        return ids, np.bincount(np.cumsum(at == 0), weights=many, minlength=len(found)).astype(np.int64)

    def _clear_pieces(self) -> None:
        self._known: dict[str, int] = {"\n": 0}  # the line feed between words has no ids
        self._piece_start, self._piece_length = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self._piece_ids = np.zeros(0, np.int32)

    def _known_words(self, data: bytes, w: words.Words, h: np.ndarray) -> np.ndarray:
        """Entry of each word, or -1 if the table has not this word."""
        entry = self._find(h)
        at = np.flatnonzero(entry >= 0)
        kept = words.same(data, w.start[at], w.end[at], self.letters, self.word_start[entry[at]], self.word_length[entry[at]])
        entry[at[~kept]] = -1
        return entry

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin (one more entry than texts)."""
        parts, count = [], np.zeros(len(texts), np.int64)
        for w in words.scan([t.encode("utf-8", "replace") for t in texts]):
            h, size = np.maximum(w.hash, np.uint64(1)), w.end - w.start  # 0 marks a free place
            data = w.raw.tobytes()
            if self.n_words + len(h) > MAX_WORDS or self.n_letters + len(data) > MAX_POOL:
                self._clear()  # so that all words of this buffer have a place
            entry = self._known_words(data, w, h)
            if ((entry < 0) & (size <= MAX_KEPT)).any():
                fresh = np.flatnonzero((entry < 0) & (size <= MAX_KEPT))
                fresh = fresh[self._find(h[fresh]) < 0]  # else another word has the place
                new = fresh[np.unique(h[fresh], return_index=True)[1]]
                found = [data[a:b] for a, b in zip(w.start[new].tolist(), w.end[new].tolist(), strict=True)]
                self._add(h[new], found, *self._encode_words([f.decode() for f in found]))
                entry = self._known_words(data, w, h)
            length = np.where(entry >= 0, self.length[entry], 0).astype(np.int64)
            alone = np.flatnonzero(entry < 0)  # very long words, and words that share a hash with another
            own_ids, length[alone] = self._encode_words([data[w.start[i] : w.end[i]].decode() for i in alone])
            before = np.cumsum(length) - length
            out = np.zeros(int(length.sum()), np.int32)
            at = np.flatnonzero(entry >= 0) if len(alone) else slice(None)
            many, first = length[at], before[at]
            place = np.repeat(first, many) + (within := np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many))
            out[place] = self.pool[np.repeat(self.start[entry[at]], many) + within]
            if len(alone):
                out[np.repeat(entry < 0, length)] = own_ids
            parts.append(out)
            count += np.bincount(w.doc, weights=length, minlength=len(texts)).astype(np.int64)
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(count)])


def _check_spaces(tokenizer, path: str) -> None:
    """Refuse a tokenizer that keeps white space or whose tokens reach over it."""
    apart = [i for word in ("of", "the", "end.") for i in tokenizer.encode(word, add_special_tokens=False).ids]
    for text in ("of the end.", " of\t the\n\nend. ", "of\r\nthe\x0b\x0cend."):
        if tokenizer.encode(text, add_special_tokens=False).ids != apart:
            raise ValueError(f"{path}: tokens depend on the white space between words")


def _piece_pattern(tokenizer) -> re.Pattern | None:
    """How the tokenizer splits a plain word, if it is of the kind known here: NFC and lower
    case, then contractions, letters, single digits, other signs."""
    import json

    spec = json.loads(tokenizer.to_str())
    kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    known = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    if kinds != ["NFC", "Replace", "Lowercase"] or [s.get("type") for s in splits] != ["Split", "ByteLevel"]:
        return None
    if splits[0]["pattern"].get("Regex") != known or not splits[0]["invert"]:
        return None
    return re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+|\n")


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The worker's coder for a vocabulary file."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by ``end_id``."""
    n = len(bounds) - 1
    return np.insert(ids, bounds[1:], end_id), bounds + np.arange(n + 1)
