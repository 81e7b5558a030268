"""Vocabulary pieces of texts, each distinct pre-token encoded once.

A text is cut where a white space follows anything else, and after letters before a comma or full stop. No match of the
vocabularies' patterns crosses such a place and none looks back over it, so the pieces of a text are those of its chunks,
one after the other. Words repeat far more often than texts, so a worker encodes a chunk when it first meets it and looks
it up afterwards; what it has met only once is forgotten first.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np

from .tables import remembered

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The characters with Unicode's White_Space property, which is what \\s means to the vocabularies.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
CHUNK = re.compile(f"[{WHITE}]*[{LETTERS}]+(?=[{WHITE},.]|$)|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
CUT = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
ONE_WORD = re.compile(f" ?[{LETTERS}]+")
#: Characters taken at once, and what a worker remembers at most.
SLICE_CHARS, KEEP_CHUNKS, KEEP_CHARS = 1 << 19, 400_000, 12_000_000


def vocabulary_path(name: str) -> str:
    """A vocabulary file's place: the name itself if it is a path, else among the installed public vocabularies."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(text: str, chars: int = SLICE_CHARS, cut: re.Pattern = CUT) -> Iterator[str]:
    """The whole text in parts of about ``chars`` characters, cut only where chunks are cut, or where ``cut`` matches."""
    start = 0
    while len(text) - start > chars and (m := cut.search(text, start + chars)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


class Pieces:
    """Ids of chunks, in flat arrays. ``encode`` maps a list of strings to their lists of ids."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], keep: int = KEEP_CHUNKS, keep_chars: int = KEEP_CHARS):
        self.encode, self.keep, self.keep_chars = encode, keep, keep_chars
        self._empty()

    def _empty(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = self.used = 0
        self.starts, self.sizes, self.again, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, bool), np.zeros(4096, np.int32)

    def _add(self, new: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        first = len(self.at)
        while len(self.starts) < first + len(new):
            self.starts, self.sizes, self.again = (np.resize(x, 2 * len(x)) for x in (self.starts, self.sizes, self.again))
        while len(self.flat) < self.used + len(ids):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[first : first + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + len(new)] = sizes
        self.again[first : first + len(new)] = False
        self.at.update(zip(new, range(first, first + len(new))))
        self.used += len(ids)
        self.chars += sum(map(len, new))

    def _shrink(self) -> None:
        """Keeps the chunks that were met again, unless they alone fill half of the room."""
        names = [x for x, i in self.at.items() if self.again[i] and len(x) < 256]
        if len(names) > self.keep // 2:
            names = []
        rows = np.fromiter(map(self.at.__getitem__, names), np.int64, len(names))
        sizes, ids = self.sizes[rows], self.gather(rows)
        self._empty()
        self._add(names, sizes, ids)

    def rows(self, chunks: list[str]) -> np.ndarray:
        """Each chunk's row in ``starts`` and ``sizes``, valid until the next call."""
        if len(self.at) > self.keep or self.chars > self.keep_chars:
            self._shrink()
        out = np.fromiter(map(self.at.get, chunks, repeat(-1)), np.int64, len(chunks))
        known = out >= 0
        self.again[out[known]] = True
        if not known.all():
            new = list(dict.fromkeys(chunks[i] for i in np.flatnonzero(~known)))
            ids = self.encode(new)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self._add(new, sizes, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())))
            out[~known] = np.fromiter((self.at[chunks[i]] for i in np.flatnonzero(~known)), np.int64)
        return out

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of these chunks, one after the other."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[rows] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each whole text; texts of ordinary length are looked up together, long ones slice by slice."""
        waiting: list[list[str]] = []
        held = 0

        def flush() -> Iterator[np.ndarray]:
            rows = self.rows(list(chain.from_iterable(waiting)))
            ends = np.cumsum([0, *map(len, waiting)])
            upto = np.concatenate(([0], np.cumsum(self.sizes[rows])))[ends]
            ids = self.gather(rows)
            yield from (ids[a:b] for a, b in zip(upto[:-1], upto[1:]))

        for text in texts:
            if len(text) > SLICE_CHARS:
                yield from flush()
                waiting, held = [], 0
                yield np.concatenate([self.gather(self.rows(CHUNK.findall(x))) for x in slices(text)])
                continue
            waiting.append(CHUNK.findall(text))
            held += len(text)
            if held > SLICE_CHARS:
                yield from flush()
                waiting, held = [], 0
        yield from flush()


def with_single_words(model, prepare: Callable[[str], str], encode: Callable[[list[str]], list[list[int]]]) -> Callable[[list[str]], list[list[int]]]:
    """A chunk that is one word needs no splitting: the vocabulary's merges are asked directly. Others go the whole way."""
    one, tokenize = ONE_WORD.fullmatch, model.tokenize

    def ids(chunks: list[str]) -> list[list[int]]:
        rest = [x for x in chunks if not one(x)]
        whole = dict(zip(rest, encode(rest))) if rest else {}
        return [whole[x] if x in whole else [t.id for t in tokenize(prepare(x))] for x in chunks]

    return ids


def json_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """The tokenizers library's, without added begin, end, padding or truncation; special strings in texts as it does by default."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    encode = lambda texts: [x.ids for x in t.encode_batch_fast(texts, add_special_tokens=False)]
    return with_single_words(t.model, prepared(t), encode) if type(t.model).__name__ == "BPE" and prepared(t) else encode


def prepared(t) -> Callable[[str], str] | None:
    """How one word reaches the merges of a byte-level vocabulary, found by asking for it; None if by no way known here."""
    chars = byte_characters()
    written = str.maketrans({chr(b): chars[b] for b in range(256)})
    kept = lambda x: x.encode().decode("latin-1").translate(written)
    lowered = lambda x: kept(x.strip().lower())
    probe = ["Ab", " Ab", "Éa", " éA", "ÿÀ", " ß"]
    told = [x.ids for x in t.encode_batch(probe, add_special_tokens=False)]
    return next((f for f in (kept, lowered) if [[y.id for y in t.model.tokenize(f(x))] for x in probe] == told), None)


def model_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    import sentencepiece

    t = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: t.encode(texts, num_threads=1)


def byte_characters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if it prints, else one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, n = [""] * 256, 0
    for b in range(256):
        out[b] = chr(b if b in plain else 256 + n)
        n += b not in plain
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def ranks_encoder(path: str, pattern: str) -> Callable[[list[str]], list[list[int]]]:
    """The tokenizers library's byte-level BPE over a file of ranks.

    Ranks name what a merge makes, not what it joins, so every pair of pieces that joins to a piece is a merge, in the
    order of the ranks; a match that is a piece itself is taken whole.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_characters()
    name = {x: "".join(chars[b] for b in x) for x in ranks}
    merges = [(name[x[:i]], name[x[i:]]) for x, _ in sorted(ranks.items(), key=lambda kv: kv[1]) for i in range(1, len(x)) if x[:i] in ranks and x[i:] in ranks]
    t = Tokenizer(models.BPE(vocab={name[x]: i for x, i in ranks.items()}, merges=merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return with_single_words(t.model, prepared(t), lambda texts: [x.ids for x in t.encode_batch_fast(texts, add_special_tokens=False)])


def pieces(path: str, pattern: str | None = None) -> Pieces:
    """This worker's pieces of a vocabulary file: .json, .model, or ranks with the pattern that splits before the merges."""
    made = lambda: json_encoder(path) if path.endswith(".json") else model_encoder(path) if path.endswith(".model") else ranks_encoder(path, pattern)
    return remembered(("pieces", path, pattern), lambda: Pieces(made()))
