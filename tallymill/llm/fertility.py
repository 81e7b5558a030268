"""Quality rules: base rules on words, lines and repeats, then tokeniser fertility against bands by language or script.

A public vocabulary with byte fallback takes natural text of its languages in long pieces, few of them bytes and well
spread. Three measures of the text's words show it: characters per token, the share of byte-fallback tokens, and the
entropy of the tokens (bits, over the text's own tokens, divided by the most that so many tokens could have). A text is kept
if it passes the base rules and each measure lies in the band of its language; a language without a band, or none, is judged
by the band of the script that most of its letters have.

Words are runs of anything but ASCII white space. Null text is empty text: no words, which fails the base rules. A language
of null is judged by script. Repeated rows are judged each. An empty table gives an empty table. ``measure`` keeps the
columns it is asked for; columns of other names that the input has are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Pieces, model_encoder, slices, vocabulary_path
from .tables import map_parts, remembered

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_END = re.compile(r"(?<=[^\x20\x09-\x0D])[\x20\x09-\x0D]")
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "n_tokens": "long", "chars_per_token": "double", "byte_share": "double", "entropy": "double", "script": "string"}


@dataclass(frozen=True)
class Band:
    """What a text of a language may have: characters per token, share of bytes, and token entropy as a share of its most."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float


#: Bands of the 32,000-piece vocabulary for long texts. Few tokens scatter: a text's mean may lie SCATTER / sqrt(tokens) lower.
LANGUAGES = {"en": Band(2.10, 8.0, 0.05, 0.44), "de": Band(2.13, 8.0, 0.05, 0.44), "fr": Band(1.87, 8.0, 0.05, 0.44), "es": Band(1.84, 8.0, 0.05, 0.44)}
SCATTER = 2.5
SCRIPTS = {"latin": Band(1.4, 9.0, 0.15, 0.40), "greek": Band(0.7, 6.0, 0.50, 0.35), "cyrillic": Band(0.9, 8.0, 0.30, 0.40), "cjk": Band(0.4, 3.0, 0.75, 0.35), "other": Band(0.25, 9.0, 0.95, 0.30)}
#: Unicode blocks of the scripts, first and last code point.
BLOCKS = {"latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)], "greek": [(0x370, 0x3FF)], "cyrillic": [(0x400, 0x52F)], "cjk": [(0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF), (0x20000, 0x2FA1F)]}


def script_of(text: str) -> str:
    """The script of most letters; texts without any are latin."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = {k: int(sum(((points >= a) & (points <= b)).sum() for a, b in v)) for k, v in BLOCKS.items()}
    found["other"] = int((points >= 0x250).sum()) - found["greek"] - found["cyrillic"] - found["cjk"]
    return max(found, key=found.get)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of so many words which the text has twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    ids = ids.astype(np.uint64) + np.uint64(1)
    for i in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n]
        h ^= h >> np.uint64(29)
    _, at, count = np.unique(h, return_inverse=True, return_counts=True)
    if len(count) == n:
        return 0
    starts = np.flatnonzero(count[at] > 1)
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == 1 or len(set(lines)) == len(lines):
        return 0
    seen: set[str] = set()
    found = 0
    for line in lines:
        found += line in seen and WORD.search(line) is not None
        seen.add(line)
    return found


class Measurer:
    def __init__(self, path: str):
        import sentencepiece

        vocabulary = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = Pieces(model_encoder(path))
        self.is_byte = np.array([vocabulary.is_byte(i) for i in range(vocabulary.get_piece_size())])

    def tokens(self, histogram: np.ndarray) -> tuple[int, float, float]:
        """Number, share of bytes and relative entropy."""
        total = int(histogram.sum())
        if not total:
            return 0, 0.0, 0.0
        bytes_ = int(histogram[self.is_byte[: len(histogram)]].sum())
        p = histogram[histogram > 0] / total
        most = np.log2(min(total, len(self.is_byte)))
        return total, bytes_ / total, float(-(p * np.log2(p)).sum() / most) if most else 1.0

    def of(self, texts: list[str], judged_by_script: list[bool]) -> list[tuple]:
        short = [i for i, t in enumerate(texts) if len(t) <= 1 << 17]
        found = {i: WORD.findall(texts[i]) for i in short}
        rows, at, out = self.pieces.rows(list(chain.from_iterable(found.values()))), 0, []
        looked = {}
        for i, words in found.items():
            own = rows[at : at + len(words)]
            at += len(words)
            looked[i] = len(words), sum(map(len, words)), repeated_words(own), np.bincount(self.pieces.gather(own))
        for i, text in enumerate(texts):
            if i not in looked:
                looked[i] = self.long(text)
            n, chars, repeats, histogram = looked[i]
            tokens, share, entropy = self.tokens(histogram)
            out.append((n, chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats, tokens, chars / tokens if tokens else 0.0, share, entropy, script_of(text) if judged_by_script[i] else None))
        return out

    def long(self, text: str) -> tuple[int, int, int, np.ndarray]:
        """A long text slice by slice; its words are told apart by 64-bit hashes."""
        n, chars, hashes, histogram = 0, 0, [], np.zeros(len(self.is_byte), np.int64)
        for part in slices(text, 1 << 17, WORD_END):
            words = WORD.findall(part)
            n, chars = n + len(words), chars + sum(map(len, words))
            hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
            histogram += np.bincount(self.pieces.gather(self.pieces.rows(words)), minlength=len(histogram))
        return n, chars, repeated_words(np.concatenate(hashes)), histogram


def measurer(path: str) -> Measurer:
    return remembered(("measurer", path), lambda: Measurer(path))


def measure(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, the language and all measures. The script is found only where no language's band applies."""
    path = vocabulary_path(vocabulary)
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    names = [f"__k{i}" for i in range(len(keep))]
    base = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], lang.alias("__lang"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def make():
        m = measurer(path)

        def part(b: pa.RecordBatch) -> pa.RecordBatch:
            *_, langs, texts = (b.column(i) for i in range(b.num_columns))
            made = zip(*m.of(texts.to_pylist(), [x not in LANGUAGES for x in langs.to_pylist()]))
            columns = [pa.array(x, {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[k]) for x, k in zip(made, MEASURES.values())]
            return pa.record_batch([*b.columns[:-1], *columns], [*names, "__lang", *MEASURES])

        return part

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "__text"] + [f"{c} {k}" for c, k in MEASURES.items()])
    out = map_parts(base, make, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], F.col("__lang").alias("judged_lang"), *MEASURES)


def judge(measured: DataFrame) -> DataFrame:
    """Adds base_failed and kept."""
    cpt, share, entropy = F.col("chars_per_token"), F.col("byte_share"), F.col("entropy")
    slack = F.lit(SCATTER) / F.sqrt(F.greatest("n_tokens", F.lit(1)))
    inside = lambda b: cpt.between(F.lit(b.least_chars) - slack, F.lit(b.most_chars)) & (share <= b.most_bytes) & (entropy >= b.least_entropy)
    fits = inside(SCRIPTS["other"])
    for name, band in SCRIPTS.items():
        fits = F.when(F.col("script") == name, inside(band)).otherwise(fits)
    for name, band in LANGUAGES.items():
        fits = F.when(F.col("judged_lang") == name, inside(band)).otherwise(fits)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & fits)


def reject(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with their own columns."""
    judged = judge(measure(docs, text_col=text_col, keep=tuple(docs.columns)))
    return judged.where("kept").select(*[F.col(f"`{c}`") for c in docs.columns])
