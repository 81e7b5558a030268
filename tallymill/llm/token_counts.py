"""Token counts without ids: each distinct pre-token is counted once and joined to the documents' frequencies.

The join runs where the text is: a task counts the pieces of a pre-token when it first meets it, each document's pre-token
frequencies look them up, and only the sums leave the task. A table of all documents' pre-tokens would be larger than the
texts and would be shuffled twice; here nothing is shuffled.

Null text counts as empty: no tokens. Repeated rows are counted each. An empty table gives an empty table. Other columns,
whatever their names, are ignored; the result has the id column and the counts.
"""

from __future__ import annotations

from collections import Counter
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import CHUNK, KEEP_CHARS, KEEP_CHUNKS, json_encoder, model_encoder, slices, vocabulary_path
from .tables import map_parts, remembered

class PieceCounts:
    """How many pieces each chunk has; of many chunks, those met again are remembered."""

    def __init__(self, path: str):
        self.encode = (model_encoder if path.endswith(".model") else json_encoder)(path)
        self.counts: dict[str, int] = {}
        self.again: set[str] = set()
        self.chars = 0

    def learn(self, freqs: list[Counter]) -> None:
        met = set().union(*freqs)
        new = list(met.difference(self.counts))
        self.again |= met.difference(new)
        if len(self.counts) + len(new) > KEEP_CHUNKS or self.chars > KEEP_CHARS:
            keep = self.again if len(self.again) < KEEP_CHUNKS // 2 else set()
            self.counts = {x: n for x, n in self.counts.items() if x in keep or x in met}
            self.again, self.chars = set(), sum(map(len, self.counts))
        self.counts.update(zip(new, map(len, self.encode(new))))
        self.chars += sum(map(len, new))

    def totals(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        waiting: list[tuple[int, Counter]] = []
        held = 0

        def flush() -> None:
            self.learn([f for _, f in waiting])
            for i, f in waiting:
                out[i] += sum(map(mul, map(self.counts.__getitem__, f), f.values()))
            waiting.clear()

        for i, text in enumerate(texts):
            for part in slices(text):
                waiting.append((i, Counter(CHUNK.findall(part))))
                held += len(part)
                if held > 1 << 19:
                    flush()
                    held = 0
        flush()
        return out


def piece_counts(path: str) -> PieceCounts:
    """This worker's counts for a vocabulary file."""
    return remembered(("counts", path), lambda: PieceCounts(path))


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit of each document; ``vocabulary`` is a file's path or public name."""
    path = vocabulary_path(vocabulary)

    def make():
        counts = piece_counts(path)
        return lambda b: pa.record_batch([b.column(0), b.column(1), pa.array(counts.totals(b.column(2).to_pylist()), pa.int64())], ["__id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    out = map_parts(docs.select(F.col(id_col).alias("__id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")), make, f"__id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("__id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
