"""Token ids of whole texts by a public tokenizer, exactly as the library gives them, at the speed of a lookup.

Both kinds of tokenizer used here never merge across the start of a run of white space, so a text is the
concatenation of pieces that can be encoded on their own. Pieces repeat: each worker lets the library encode a
piece once and numbers it. Arrow cuts a batch of texts and finds its different pieces, and only these are looked up one by one. The
batch then becomes an array of piece numbers, and its ids are gathered from one array of all pieces' ids. The store of pieces is bounded: when it is full, those that came up in one batch only are dropped. What is not in it
is encoded anew, so its size changes the time only.
"""

from __future__ import annotations

import re
from itertools import chain, compress, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyfold.llm.common import single_thread

_PIECES = re.compile(r"\s*\S+|\s+")
# Python takes the first four for white space, the tokenizers do not: such texts are encoded whole.
_DIFFERENT = "\x1c\x1d\x1e\x1f"
# What else Python takes for white space, but for the space and the line feed.
_RARE = [chr(c) for c in (9, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_LATIN = [c for c in map(chr, range(0x250)) if c.isalpha()]  # letters in every version of Unicode
_KEEP = 48  # longer pieces are not kept
# How a byte-level vocabulary writes bytes: printable ones as they are, others as characters from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_WHOLE = "\x1c"  # before a piece that is to be encoded as it stands; no other piece begins so
_CODES = np.array([b if b in (10, ord(_WHOLE)) else ord(_SHOWN.get(b, chr(b))) for b in range(256)], "<u2")
_STEP = 1 << 14  # pieces whose tokens are held at a time


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    single_thread()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids. ``words``: the tokenizer drops white space.

    A piece of a byte-level text is a space and what follows up to the next space or line feed; texts with other runs of
    white space are cut by a pattern instead. New pieces are encoded many at a time, with a special token of the
    vocabulary between them, at which the library cuts before all else.
    """

    def __init__(self, path: str, words: bool = False, most: int = 250_000):
        self.tokenizer = load_tokenizer(path)
        self.words, self.most = words, most
        special = sorted((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items())
        self.marks = [t for _, t in special]
        self.first = self.marks[0][:1] if len({m[:1] for m in self.marks}) == 1 else ""  # in any text, if marks differ
        self.mark_id, self.mark = special[-1] if special else (None, None)
        kept = [c for c in _LATIN if not words or c == c.lower()]
        self.is_word = re.compile(f"{_WHOLE}?[{''.join(kept)}]+").fullmatch
        self.signs = dict(zip(("", ",", "."), self._whole(["", ",", "."]), strict=True))
        self._empty()

    def _empty(self) -> None:
        self.store: dict[str, int] = {}  # numbers pieces in the order in which they come up
        self.ids = np.zeros(1 << 16, "<u4")
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int32)
        self.uses = np.zeros(1 << 14, np.uint8)
        self.filled = 0

    def _batch(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self._batch(texts)]

    def _new(self, pieces: list[str]) -> tuple[list[int], np.ndarray]:
        """How many ids each of these pieces without special tokens in them has, and all their ids."""
        if self.mark is None:
            return _joined(self._whole(pieces))
        sizes: list[int] = []
        out = [np.zeros(0, "<u4")]
        for i in range(0, len(pieces), 512):
            ids = np.array(self._batch([self.mark.join(pieces[i : i + 512])])[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            sizes += (np.diff(cuts, prepend=-1, append=len(ids)) - 1).tolist()
            out.append(np.delete(ids, cuts))
        return sizes, np.concatenate(out)

    def _spaced(self, text: str) -> str | None:
        """The text with a space between any two pieces, or None if it must be cut by ``_odd``.

        Pieces are what the library encodes one by one to the same ids. Those of a byte-level text lack the space before them;
        one without it is marked: the first, and a line feed and what follows it. A words tokenizer gives no ids for empty ones.
        """
        if any(c in text for c in _DIFFERENT) or any(c in text for c in _RARE):
            return None
        if self.words:
            return (text if "\u03a3" in text or "<" in text else text.lower()).replace("\n", " ")
        # A run of white space is more than one space or line feed, or two line feeds within the text.
        runs = "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text.endswith("\n\n")
        return None if runs or self._marked(text) else _WHOLE + text.replace("\n", f" {_WHOLE}\n {_WHOLE}")

    def _odd(self, text: str) -> list[str]:
        """The pieces of a text with white space or marks that need care."""
        if any(c in text for c in _DIFFERENT):
            return [_WHOLE + text]
        return text.split() if self.words else [_WHOLE + x for x in _PIECES.findall(text)]

    def _cut(self, texts: list[str]) -> tuple[pa.Array, list[int]]:
        """The pieces of all texts in a row, and how many each has."""
        parts, counts, held = [pa.array([], pa.large_string())], [], []

        def close() -> None:
            if held:
                parts.append(pc.split_pattern(pa.array([" ".join(held)], pa.large_string()), " ").flatten())
                held.clear()

        for text in texts:
            if (spaced := self._spaced(text)) is not None:
                held.append(spaced)
                counts.append(spaced.count(" ") + 1)
            else:
                close()
                parts.append(pa.array(self._odd(text), pa.large_string()))
                counts.append(len(parts[-1]))
        close()
        return pa.concat_arrays(parts), counts

    def _marked(self, text: str) -> bool:
        return self.first in text and any(m in text for m in self.marks)

    def key(self, split: str) -> str:
        """The piece that stands for what the scanner of a byte-level tokenizer splits off."""
        return split[1:] if split[0] == " " and split[1:2] != _WHOLE else _WHOLE + split

    def _text(self, piece: str) -> str:
        if piece.startswith(_WHOLE):
            return piece[1:]
        return piece if self.words else " " + piece

    def _core(self, piece: str) -> tuple[str, str]:
        """The piece in the form it shares with others, and a comma or full stop that ends it.

        The scanner splits such a sign off a letter. A words tokenizer lowers letters one by one, as Python does but for
        the capital sigma; the dotted capital I becomes two signs. What may become a special token stays as it is.
        """
        if self.words and not piece.islower() and "\u03a3" not in piece and "<" not in piece:
            lowered = piece.lower()
            piece = piece if lowered == piece else lowered
        ends = piece[-1:] in (",", ".") and piece[-2:-1].isalpha() and piece[-2] != "\u0130"
        return (piece[:-1], piece[-1]) if ends else (piece, "")

    def _model_texts(self, words: list[str]) -> list[str]:
        """Words as the model takes them: for byte-level vocabularies with the sign for a space before them, if there is one."""
        shown = _CODES[np.frombuffer("\n".join(["", *words]).encode(), np.uint8)].tobytes().decode("utf-16-le")
        if not self.words:
            shown = shown.replace("\n", "\n\u0120").replace(f"\n\u0120{_WHOLE}", "\n")
        return shown.replace(_WHOLE, "").split("\n")[1:]

    def _learn(self, fresh: list[str]) -> None:
        """Give the pieces that have just got a number, the last ones of the store, their ids."""
        letters, others, derived = [], [], []
        numbers, signs = [np.zeros(0, np.int64)], []
        while fresh:  # and then the forms that these share
            first, cores = len(self.store) - len(fresh), []
            # Only letters, which the scanner leaves together and the normaliser as they are.
            word = np.fromiter(map(self.is_word, fresh), bool, len(fresh))
            letters += compress(fresh, word)
            numbers.append(first + np.flatnonzero(word))
            for at in np.flatnonzero(~word).tolist():
                core, sign = self._core(fresh[at])
                if core is not fresh[at]:
                    derived.append(first + at)
                    cores.append(core)
                    signs.append(sign)
                else:
                    others.append(core)
            own, fresh = self._number(cores)
            derived[len(derived) - len(cores) :] = zip(derived[len(derived) - len(cores) :], own.tolist(), strict=True)
        self.starts, self.sizes, self.uses = (_grown(x, len(self.store)) for x in (self.starts, self.sizes, self.uses))
        # The model by itself takes words without the scanner's and the normaliser's work, which leave them as they are.
        texts, places = self._model_texts(letters), np.concatenate(numbers)
        for i in range(0, len(texts), _STEP):
            found = list(map(self.tokenizer.model.tokenize, texts[i : i + _STEP]))
            ids = np.fromiter(map(attrgetter("id"), chain.from_iterable(found)), "<u4")
            self._place(places[i : i + _STEP], np.array(list(map(len, found)), np.int64), ids)
        marked = [c for c in others if self._marked(c)]
        easy = [c for c in others if not self._marked(c)] if marked else others
        self._add(easy, *self._new([self._text(c) for c in easy]))
        self._add(marked, *_joined(self._whole([self._text(c) for c in marked])))
        for sign, ids in self.signs.items():
            own = np.array([x for x, s in zip(derived, signs, strict=True) if s == sign], np.int64).reshape(-1, 2)
            self._derive(*own.T, ids)

    def _add(self, pieces: list[str], sizes: list[int], ids: np.ndarray) -> None:
        self._place(np.fromiter(map(self.store.__getitem__, pieces), np.int64, len(pieces)), np.array(sizes, np.int64), ids)

    def _place(self, numbers: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.ids = _grown(self.ids, self.filled + len(ids))
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.sizes[numbers] = sizes
        self.starts[numbers] = self.filled + np.cumsum(sizes) - sizes
        self.filled += len(ids)

    def _derive(self, numbers: np.ndarray, cores: np.ndarray, sign: np.ndarray) -> None:
        """Pieces with the ids of their cores, which have theirs by now, and those of a sign."""
        held = self.sizes[cores].astype(np.int64)
        sizes = held + len(sign)
        at = np.cumsum(sizes) - sizes
        ids = np.zeros(int(sizes.sum()), "<u4")
        ids[spans(at, held)] = self.ids[spans(self.starts[cores], held)]
        for i, value in enumerate(sign.tolist()):
            ids[at + held + i] = value
        self._place(numbers, sizes, ids)

    def _forget(self) -> None:
        """Keep the pieces that came up in two batches or more and are short, half of the store at most."""
        kept = [p for p, n in self.store.items() if self.uses[n] > 1 and len(p) <= _KEEP][: self.most // 2]
        at = np.fromiter((self.store[p] for p in kept), np.int64, len(kept))
        sizes = self.sizes[at]
        ids = self.ids[spans(self.starts[at], sizes)]
        self._empty()
        self.store.update((p, n) for n, p in enumerate(kept))
        self.starts, self.sizes, self.uses = (_grown(x, len(kept)) for x in (self.starts, self.sizes, self.uses))
        self.sizes[: len(kept)] = sizes
        self.starts[: len(kept)] = np.cumsum(sizes) - sizes
        self.ids, self.filled = _grown(self.ids, len(ids)), len(ids)
        self.ids[: len(ids)] = ids

    def _number(self, pieces: list[str]) -> tuple[np.ndarray, list[str]]:
        """The pieces' numbers in the store, and those that it did not hold, each once."""
        store = self.store
        numbers = np.fromiter(map(store.get, pieces, repeat(-1)), np.int64, len(pieces))
        at = np.flatnonzero(numbers < 0).tolist()
        missing = [pieces[i] for i in at]
        fresh = list(dict.fromkeys(missing))
        store.update(zip(fresh, range(len(store), len(store) + len(fresh)), strict=True))
        numbers[at] = np.fromiter(map(store.__getitem__, missing), np.int64, len(at))
        return numbers, fresh

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        if len(self.store) > self.most:
            self._forget()
        numbers, fresh = self._number(pieces)
        if fresh:
            self._learn(fresh)
        self.uses[numbers] = np.minimum(self.uses[numbers], 254) + 1
        return numbers

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[numbers]
        return self.ids[spans(self.starts[numbers], sizes)], sizes

    def lookup(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has."""
        return self._gather(self._numbers(pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text."""
        pieces, counts = self._cut(texts)
        coded = pieces.dictionary_encode()
        numbers = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, sizes = self._gather(numbers[coded.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[np.cumsum([0, *counts])] * 4
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


def _joined(found: list[np.ndarray]) -> tuple[list[int], np.ndarray]:
    return list(map(len, found)), np.concatenate([np.zeros(0, "<u4"), *found])


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of every span, one span after the other."""
    before = np.cumsum(sizes, dtype=np.int64) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _grown(column: np.ndarray, size: int) -> np.ndarray:
    if size <= len(column):
        return column
    out = np.zeros(max(size, len(column) * 3 // 2), column.dtype)
    out[: len(column)] = column
    return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, words: bool = False, most: int = 600_000) -> Encoder:
    """This worker's encoder: one for all tasks that it runs."""
    if (path, words) not in _ENCODERS:
        _ENCODERS[path, words] = Encoder(path, words, most)
    return _ENCODERS[path, words]
