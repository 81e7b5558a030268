"""Token operators, quality rules, packing and toxicity against the libraries and brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.llm import bpe, fertility, packing, queries, token_counts, toxicity
from tallymill.llm.pieces import CHUNK, Pieces, pieces, read_ranks, slices, vocabulary_path

P = pytest.importorskip("public_tokenizers")
ODD = [None, "", "  ", "a  b\n\n c <|endoftext|> x", " ! x\x1c!\x1f y \x85z", "é" * 50 + "'s 're ", "don't  I'll\t\tgo", "日本語 テスト 😀😀 ﷽ a\u0301\u0327b", "a" * 3000 + " " * 5000 + "b", "Σίσυφος ΑΣ. ÿÀ,b.c", "same", "same"]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = [(i, t) for i, t in enumerate([*ODD, *[r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(120).collect()]])]
    return rows, spark.createDataFrame([(i, t, "extra", None) for i, t in rows], "doc_id long, text string, n_tokens string, size long")


def test_chunks_join_to_the_text():
    for t in ODD[1:]:
        assert "".join(CHUNK.findall(t)) == t
        assert "".join(slices(t, 7)) == t


def test_small_memory_changes_nothing(texts):
    from tallymill.llm.pieces import json_encoder

    small = Pieces(json_encoder(vocabulary_path("byte_bpe_50k.json")), keep=50)
    some = [t or "" for _, t in texts[0]]
    for _ in range(2):
        for a, b in zip(small.of(some), pieces(vocabulary_path("byte_bpe_50k.json")).of(some)):
            assert a.tolist() == b.tolist()


def test_words_of_long_texts_end_only_at_ascii_white_space():
    m = fertility.measurer(vocabulary_path("piece_bpe_32k.model"))
    for odd in "\u00a0\u3000\x85":
        text = "a bc " * 26_214 + f"100{odd}km{odd}" * 40 + " the end" * 30
        assert len(text) > 1 << 17
        words = fertility.WORD.findall(text)
        assert m.of([text], [False])[0][:2] == (len(words), sum(map(len, words)))
    assert m.of(["x\u3000" * 70_000], [False])[0][0] == 1


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})


def test_bpe_round_trip(spark, texts):
    rows, df = texts
    own = tiktoken_encoding()
    ranks = "byte_bpe_multi_50k.tiktoken"
    got = bpe.decode(bpe.encode(df, ranks, P.PATTERN), ranks, text=True)
    assert {"n_tokens", "size"} <= set(got.columns)
    for r in got.collect():
        t = rows[r["doc_id"]][1] or ""
        assert r["ids"] == own.encode_ordinary(t) and r["decoded"] == t
        data = t.encode()
        for k, (end, a, b) in enumerate(zip(r["byte_ends"], r["char_starts"], r["char_ends"])):
            start = r["byte_ends"][k - 1] if k else 0
            assert data[start:end] in t[a:b].encode() and b > a
    stream = bpe.StreamDecoder(ranks)
    ids = own.encode_ordinary("😀é日")
    assert "".join(stream.feed([i]) for i in ids) + stream.feed([], last=True) == "😀é日"
    assert bpe.decode(bpe.encode(df.limit(0), ranks, P.PATTERN), ranks).count() == 0


def test_op2(spark, sf_dir):
    own = tiktoken_encoding()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op2_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = own.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest())


def test_token_counts(spark, texts, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows, df = texts
    for r in token_counts.count_tokens(df, "byte_bpe_50k.json").collect():
        text = rows[r["doc_id"]][1] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 1024)
    assert token_counts.count_tokens(df.limit(0), "byte_bpe_50k.json").count() == 0
    assert queries.op4_token_counts(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def check_packing(got, docs, length=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(docs)
    for i, own in by_doc.items():
        ids = np.array([*t.encode(docs[i] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= length
    return sum(r["length"] for r in got), len(by_sequence)


def test_packing(spark, texts, sf_dir):
    rows, df = texts
    check_packing(packing.pack(df, "word_bpe_49k.json", 2).collect(), dict(rows))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    total, sequences = check_packing(queries.op9_packing(spark, sf_dir).collect(), docs)
    assert sequences <= total / 4096 * 1.03 + 1
    assert packing.pack(df.limit(0), "word_bpe_49k.json", 2).count() == 0
    twice = packing.pack(df.union(df), "word_bpe_49k.json", 2, group_pieces=16)
    assert twice.count() == 2 * packing.pack(df, "word_bpe_49k.json", 2).count()


def test_first_fit():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes, bins = rng.integers(1, 100, rng.integers(0, 60)).tolist(), []
        wanted = []
        for s in sizes:
            k = next((k for k, used in enumerate(bins) if used + s <= 100), len(bins))
            if k == len(bins):
                bins.append(0)
            wanted.append((k, bins[k]))
            bins[k] += s
        assert list(zip(*packing.first_fit(sizes, 100))) == wanted


def plain_measures(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_rules(spark, texts, sf_dir):
    rows, df = texts
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in fertility.measure(df).collect():
        assert tuple(r[n] for n in names) == plain_measures(rows[r["doc_id"]][1] or "")
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    lost = 0
    for r in queries.op3_quality_rules(spark, sf_dir).collect():
        assert tuple(r[n] for n in names) == plain_measures(docs[r["doc_id"]])
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
        lost += r["doc_id"] in clean and not failed and not r["kept"]
    assert lost <= 0.02 * len(clean)


def test_long_text_is_measured_whole():
    m = fertility.measurer(vocabulary_path("piece_bpe_32k.model"))
    text = " ".join(f"word{i % 977} and{i % 13}" for i in range(40_000)) + "\nx\nx"
    (got,) = m.of([text], [True])
    assert got[:5] == plain_measures(text)
    assert fertility.script_of("Привет мир") == "cyrillic" and fertility.script_of("") == "latin"


def test_toxicity(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op10_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(got[i]["score"], y) for i, y in labels.items() if got[i]["held_out"]]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in bad for b in good]) > 0.85
    assert np.mean([s >= 0.7 for s in good]) < 0.03


def test_toxicity_edges(spark, texts):
    _, df = texts
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(df, empty)
    assert not model.fitted and {r["score"] for r in toxicity.score(df, model).collect()} == {0.0}
    words = toxicity.WordFeatures()
    toxic = ["you idiot scum " + "good words here " * k for k in range(1, 21)]
    fine = ["some good words here " * k for k in range(1, 41)]
    m = toxicity.fit(toxic + fine, np.array([1] * 20 + [0] * 40), ["en"] * 60)
    long = "good words here " * 60_000 + "idiot scum " + "good words " * 60_000
    a, b = toxicity.score_texts(m, ["good words here", long], words)
    assert a < 0.5 < b
    assert toxicity.score(df, m).count() == df.count() and toxicity.score(df.limit(0), m).count() == 0
    assert toxicity.reject(df, m).columns == df.columns


def test_names_of_columns_may_clash(spark):
    """Columns of any name are kept, those of the operators' own making included."""
    from tallymill.llm import near_join

    rows = [(k, f"some words of text {k} that follow each other", "en", k, 0.5, k, k) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, __text int, score double, __at1 int, __score int")
    model = toxicity.train(df, spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, toxic int"))
    scored = toxicity.score(df, model)
    assert scored.columns == [c for c in df.columns if c != "score"] + ["score"] and scored.count() == 6
    assert {tuple(r) for r in toxicity.reject(df, model).collect()} <= set(rows) and toxicity.reject(df, model).columns == df.columns
    assert sorted(map(tuple, near_join.reject(df).collect())) == sorted(rows)
    coded = bpe.encode(df, "byte_bpe_multi_50k.tiktoken", P.PATTERN)
    assert {(r["doc_id"], r["__text"], r["text"]) for r in coded.collect()} == {(r[0], r[3], r[1]) for r in rows}


def naive_score(m, text, words):
    """One window after another, with empty positions behind the text."""
    x = [m.embeddings[row].sum(axis=0) for row in words.rows(toxicity.split_words(text))] if text else []
    at = lambda i: x[i] if i < len(x) else np.zeros(toxicity.DIM)
    top = []
    for k, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            made = [sum(at(i + o) @ m.filters[k][o][:, f] for o in range(w)) + m.shifts[k][f] for i in range(len(x) + toxicity.PAD)]
            top.append(max(0.0, *made))
    return 1 / (1 + np.exp(-(np.array(top) @ m.out + m.bias)))


def test_convolution_is_the_naive_one():
    """Scores equal those of plain loops over every window of every width, for short texts, long ones and ties at padding."""
    rng = np.random.default_rng(4)
    docs = [[f"w{k}" for k in rng.integers(0, 50, n)] for n in (1, 2, 3, 7, 40)] + [[]]
    texts = [" ".join(d) for d in docs] * 4
    labels = np.array([k % 2 for k in range(len(texts))])
    model = toxicity.fit(texts, labels, [None] * len(texts))
    words = toxicity.WordFeatures()
    got = toxicity.score_texts(model, texts, words)
    assert np.allclose(got, toxicity.score_texts(model, texts[::-1], toxicity.WordFeatures())[::-1], atol=1e-5)
    assert np.allclose(got[: len(docs)], [naive_score(model, t, words) for t in texts[: len(docs)]], atol=1e-4)
