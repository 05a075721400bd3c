"""Exact, fast use of the tokenizers library: each distinct word of a batch is encoded once and remembered by its worker.

Both vocabularies split texts before merging, and no merge crosses a space that follows a visible character.  A batch of
texts is therefore cut there by Arrow, which also finds the distinct pieces; pieces that the worker doesn't remember are
encoded by the library, and numpy joins the ids.  Pieces of plain Latin letters and ASCII punctuation go straight to the
library's BPE model, since normaliser and splitter are the identity (or lower-casing) on them; every other piece goes
through the library's whole encode().  Texts with irregular white space go through encode() in long stretches.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers at most (about 40 bytes each); beyond that the half that was asked for last stays.  Results
#: don't depend on it.
MOST_WORDS = 1_000_000
#: Stems of missed pieces that a worker holds besides.
MOST_STEMS = 100_000
#: Characters of texts that are encoded at once.
BATCH_CHARS = 4 << 20

#: Latin letters that are single code points, are lower-cased one to one and are stable under NFC; then ASCII punctuation but the apostrophe.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
#: White space other than a space or a line end.
ODD_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else 256 and up in order."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


BYTE_CHARS = _byte_chars()
BYTE_TABLE = dict(enumerate(BYTE_CHARS))


def irregular(text: str) -> bool:
    """Whether white space stands at an end of the text, or in runs, or is other than a space or a line end."""
    if text[:1] in " \n" or text[-1:] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return True
    return ODD_SPACE.search(text) is not None


class Words:
    """Pieces with their ids, held as Arrow and numpy arrays."""

    def __init__(self):
        self.words = pa.array([], pa.large_string())
        self.lens = np.zeros(0, np.int32)
        self.flat = np.zeros(0, "<u4")
        self.used = np.zeros(0, np.int64)
        self.clock = 0

    def __len__(self) -> int:
        return len(self.words)

    def places(self, words: pa.Array) -> np.ndarray:
        """The place of each word, or -1."""
        self.clock += 1
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.used[at[at >= 0]] = self.clock
        return at

    def add(self, words: pa.Array, ids: list[bytes]) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.lens = np.concatenate([self.lens, np.fromiter(map(len, ids), np.int32, len(ids)) // 4])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
        self.used = np.concatenate([self.used, np.full(len(ids), self.clock)])

    def shrink(self, most: int) -> None:
        if len(self) > most:
            keep = np.sort(np.argsort(self.used, kind="stable")[-(most // 2) :])
            self.flat = taken(self.flat, self.lens, keep)
            self.words, self.lens, self.used = self.words.take(pa.array(keep)), self.lens[keep], self.used[keep]


def taken(flat: np.ndarray, lens: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The runs numbered pick of consecutive runs of the lengths lens in flat, joined."""
    starts = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])[:-1]
    n = lens[pick].astype(np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[pick] - (ends - n), n) + np.arange(total)]


class Codec:
    """A public vocabulary.  A piece starts with \\n, or stands for a space and itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.lower = self.tok.normalizer is not None
        self.stems: dict[str, bytes] = {}
        self.words = Words()
        self.tables: list[str] | None = None

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _model(self, piece: str) -> bytes:
        """The ids of one piece that the library's splitter leaves whole; a space before it is part of it."""
        got = self.stems.get(piece)
        if got is None:
            if len(self.stems) >= MOST_STEMS:
                self.stems.clear()
            mapped = piece.encode().decode("latin-1").translate(BYTE_TABLE)
            got = self.stems[piece] = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return got

    def piece(self, piece: str) -> bytes:
        m = PLAIN.fullmatch(piece)
        if m:
            letters = m[1].lower() if self.lower else " " + m[1]
            return self._model(letters) + (self._model(m[2]) if m[2] else b"")
        if self.lower or piece[:1] == "\n":
            return self.whole(piece)
        return self.whole(" " + piece)

    def ids(self, text: str) -> bytes:
        """The ids of a whole text, as the library's encode(text, add_special_tokens=False) gives them."""
        return self.batch([text])[0].tobytes()

    def each(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers; BATCH_CHARS of text are encoded at once."""
        held: list[str] = []
        size = 0
        for text in texts:
            if held and size + len(text) > BATCH_CHARS:
                yield from self._some(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        yield from self._some(held)

    def batch(self, texts: Iterable[str]) -> list[np.ndarray]:
        return list(self.each(texts))

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        own: list[bytes] = []  # ids of first pieces and of texts with irregular white space, which are not remembered
        if self.lower:  # white space only separates here
            cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        else:
            odd = [irregular(t) for t in texts]
            regular = pa.array(["" if x else t for t, x in zip(texts, odd, strict=True)], pa.large_string())
            cut = pc.split_pattern(pc.replace_substring(regular, "\n", " \n"), " ")
            own = [self._irregular(t) if x else self.whole(t.replace("\n", " \n").split(" ", 1)[0]) for t, x in zip(texts, odd, strict=True)]
        bounds = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary
        at = self.words.places(words)
        if len(missed := np.flatnonzero(at < 0)):
            new = words.take(pa.array(missed))
            at[missed] = len(self.words) + np.arange(len(missed))
            self.words.add(new, [self.piece(w) for w in new.to_pylist()])
        known = len(self.words)
        codes = at[codes]
        lens, flat = self.words.lens, self.words.flat
        if own:
            codes[bounds[:-1] - bounds[0]] = known + np.arange(len(own))
            lens = np.concatenate([lens, np.fromiter(map(len, own), np.int32, len(own)) // 4])
            flat = np.concatenate([flat, np.frombuffer(b"".join(own), "<u4")])
        ids = taken(flat, lens, codes)
        ends = np.concatenate([[0], np.cumsum(lens[codes], dtype=np.int64)])[bounds - bounds[0]]
        self.words.shrink(MOST_WORDS)
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _irregular(self, text: str) -> bytes:
        """Cut only before a space that follows a Latin letter and precedes one; each stretch is encoded whole or by words."""
        out = []
        at = 0
        for m in re.finditer("(?<=[A-Za-zÀ-ÖØ-öø-ÿ]) (?=[A-Za-zÀ-ÖØ-öø-ÿ])", text):
            if m.start() - at >= 512:
                out.append(self._stretch(text[at : m.start()]))
                at = m.start()
        out.append(self._stretch(text[at:]))
        return b"".join(out)

    def _stretch(self, text: str) -> bytes:
        if text[:1] == " " and text[1:] and not irregular(text[1:]):
            return b"".join(map(self.piece, text[1:].replace("\n", " \n").split(" ")))
        return self.whole(text)

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False); a vocabulary without a decoder joins its tokens by spaces."""
        if self.tok.decoder is not None:
            return self.tok.decode(ids.tolist(), skip_special_tokens=False)
        if self.tables is None:
            self.tables = [self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size())]
        return " ".join(map(self.tables.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One per Python worker, kept between tasks."""
    return Codec(path)


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file, resolved on the machine that uses it."""
    import public_tokenizers

    return public_tokenizers.path(name)
