"""Token files, packing and the pipeline."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from endloom.llm import packing, token_codec, tokens  # noqa: E402

TEXTS = ["", None, " ", "a  b", "\n", "x\n\ny", " lead", "trail ", "it's 12 ok!! \t x", "a\x1cb c", "é ́x", "<|endoftext|> a", "İstanbul ΑΣ", "a0b 0 x10", "日本語 テキスト", "The end.\nNew line here", "a\n b", "a \nb", "word " * 3000]


@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300))
@settings(deadline=None, max_examples=60)
def test_block_round_trip_wide(values):
    values = [v % 100_000 for v in values]
    table, control, data = token_codec.encode_block(np.array(values, "<u4"))
    assert token_codec.decode_block(table, control, data, len(values)).tolist() == values


def test_block_uses_one_byte_for_frequent_ids():
    ids = np.concatenate([np.zeros(1000, int), np.arange(1, 70_001)])
    table, control, data = token_codec.encode_block(ids)
    assert (token_codec.decode_block(table, control, data, len(ids)) == ids).all()
    assert len(control) == -(-len(ids) // 4) and len(data) == (1000 + 255) + 2 * (65536 - 256) + 3 * (70_001 - 65536)


@pytest.mark.parametrize("special_as_text", [False, True])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("cache", [10, 1000])
def test_cached_pieces_give_the_librarys_ids(name, cache, special_as_text):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = special_as_text
    ids, bounds = tokens.Encoder(path, cache, special_as_text).encode(pa.array(TEXTS + TEXTS[::-1]))
    want = [e.ids for e in plain.encode_batch([t or "" for t in TEXTS + TEXTS[::-1]], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want


BITS = ["a", "B", "word", "it's", "İ", "ß", "é", "\u0301", "日本", "Ω", "Σ", "Йо", "0", "10 0", " ", "  ", "\n", "\n\n", "\t", "\x1c", ".", ",", "...", "<|endoftext|>", "<|STARTOFTEXT|>", "<|", "'s", "’", "😀", "\u200d", "ͺ", "ʹ", "ŉ", "K", "ﬁ", "\x85", "\u0345", "x."]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_random_texts_in_several_calls_give_the_librarys_ids(name):
    rng, path = random.Random(11), public_tokenizers.path(name)
    texts = ["".join(rng.choice(BITS) + rng.choice(["", " ", "", " ", "."]) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for cache in (20, 1_000_000):
        enc, got = tokens.Encoder(path, cache), []
        for at in range(0, len(texts), 600):
            ids, bounds = enc.encode(pa.array(texts[at : at + 600]))
            got += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        assert got == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_long_texts_are_encoded_in_parts(name):
    rng, path = random.Random(12), public_tokenizers.path(name)
    texts = [" ".join(rng.choice(BITS) for _ in range(9000)), "", "日本" * 3000, None]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids.tolist() for _, ids in tokens.encoded(path, pa.array(texts), size=700)] == want


def _triplets(n, capacity, seed):
    """Pieces that fill n bins exactly, three to a bin."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        a = int(rng.integers(capacity * 38 // 100, capacity * 49 // 100))
        b = int(rng.integers((capacity - a) // 2 - capacity // 12, (capacity - a) // 2))
        out += [a, b, capacity - a - b]
    return np.array(out)


def _first(lengths, capacity):
    bins = np.full(len(lengths), -1, np.int64)
    packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), bins, [], capacity)
    return bins


def test_genetic_algorithm_improves_on_best_fit(monkeypatch):
    lengths = _triplets(20, 1000, 3)
    seed = _first(lengths, 1000)
    pool = packing.evolve(lengths, [seed], 1000, 60, 10, np.random.default_rng(1))
    gained = packing.fitness(pool[0], lengths)
    assert gained[0] < packing.fitness(seed, lengths)[0]
    for child in pool:
        assert (child >= 0).all() and np.bincount(child, lengths).max() <= 1000
    # It is crossover that gains: with children like their parents nothing does.
    monkeypatch.setattr(packing, "crossover", lambda giver, taker, *_: taker.copy())
    still = packing.evolve(lengths, [seed], 1000, 60, 10, np.random.default_rng(1))
    assert packing.fitness(still[0], lengths) > gained


def test_crossover_hands_on_whole_bins():
    lengths = _triplets(20, 1000, 5)
    perfect = np.repeat(np.arange(20), 3)
    child = packing.crossover(perfect, _first(lengths, 1000), lengths, 1000, np.random.default_rng(0))
    fill = np.bincount(child, lengths)
    assert fill.max() <= 1000 and lengths.sum() == fill.sum()
    same = {frozenset(np.flatnonzero(perfect == b).tolist()) for b in range(20)} & {frozenset(np.flatnonzero(child == b).tolist()) for b in np.unique(child)}
    assert len(same) >= 20 // 2 // 3  # a third of the better half


def test_elites_migrate_round_the_ring(spark):
    rows = [(0, i, 10 * i + u, 5, i, [i]) for i in range(3) for u in range(2)] + [(1, i, u, 5, i, [i]) for i in range(3) for u in range(2)]
    state = spark.createDataFrame(rows, "shard long, island int, uid long, length long, source int, elites array<int>")
    got = {}
    for r in packing.migrated(state, 3).collect():
        got.setdefault((r["shard"], r["island"]), set()).add(r["source"])
    assert got == {(s, i): {i, (i - 1) % 3} for s in (0, 1) for i in range(3)}
    assert packing.migrated(state.where("island = 0"), 1).count() == 4


def test_packing_is_gapless_and_tight(spark):
    rng = random.Random(1)
    rows = [(i, 0, 0, rng.choice([1, 7, 40, 64, 100, rng.randint(1, 100)]), i) for i in range(900)] + [(5, 0, 0, 3, 5), (None, 0, 0, 9, 1)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(df, capacity=100, shard_pieces=120).toPandas()
    assert len(out) == len(rows)
    out = out.sort_values(["sequence_id", "offset"])
    assert ((out.groupby("sequence_id").length.cumsum() - out.length) == out.offset).all()
    total = out.groupby("sequence_id").length.sum()
    assert total.max() <= 100
    # Shards of 120 pieces may cost little against one best fit of all pieces together.
    lengths = np.array([r[3] for r in rows])
    bins = np.full(len(rows), -1, np.int64)
    packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), bins, [], 100)
    assert len(total) <= 1.01 * (bins.max() + 1)
    assert packing.pack(df.limit(0), capacity=100).collect() == []


def test_pieces_of_the_query_have_the_librarys_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, t, "x", 9) for i, t in enumerate([*TEXTS, "İ, ok. <|endoftext|> İstanbul. x"])]
    out = packing.pack(packing.pieces(spark.createDataFrame(rows, "doc_id long, text string, uid string, piece long"), path, capacity=64), capacity=64).collect()
    plain, want = Tokenizer.from_file(path), []
    for i, t, *_ in rows:
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)


def test_packing_keeps_the_callers_columns(spark):
    df = spark.createDataFrame([(1, 40, "a", 7), (2, 60, "b", 7), (None, 100, None, 7)], "doc_id long, length long, uid string, sequence_id long")
    out = {r["doc_id"]: r for r in packing.pack(df, capacity=100).collect()}
    assert {k: r["uid"] for k, r in out.items()} == {1: "a", 2: "b", None: None}
    assert out[1]["sequence_id"] == out[2]["sequence_id"] != out[None]["sequence_id"] and sorted([out[1]["offset"], out[2]["offset"]]) in ([0, 40], [0, 60])


def test_pieces_cut_only_long_documents(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "a b c"), (2, "a " * 25), (3, None), (3, "")], "doc_id long, text string")
    out = sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in packing.pieces(df, path, capacity=10).collect())
    assert out == [(1, 0, 0, 4), (2, 0, 0, 10), (2, 1, 10, 10), (2, 2, 20, 6), (3, 0, 0, 1), (3, 0, 0, 1)]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ta", "lo", "mi", "ner", "sol"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    item = text(30)
    docs = [(i, text(60)) for i in range(120)]
    toxic = {i for i in range(0, 120, 4)}
    docs = [(i, t + (" you idiot moron." if i in toxic else "")) for i, t in docs]
    near = docs[1][1].replace(" ", "  ", 3) + " extra"
    docs += [(200, docs[1][1].replace(" ", "\n")), (201, near), (202, text(20) + " " + item), (203, text(300)), (204, None)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        if k < 4:
            assert set(out.columns) == set(frame.columns)
        out.write.parquet(str(tmp_path / f"out{k}"))
        frame = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept[name] = {r["doc_id"] for r in frame.select("doc_id").collect()}
    everything = {i for i, _ in docs}
    assert kept["toxicity"] == everything - toxic
    assert kept["exact dedup"] == kept["toxicity"] - {200}
    assert kept["n-gram Jaccard join"] == kept["exact dedup"] - {201}
    assert kept["benchmark decontamination"] == kept["n-gram Jaccard join"] - {202}
    assert kept["best-fit packing"] == kept["benchmark decontamination"]


def test_pipeline_rejects_rows_not_identifiers(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice(["ta", "lo", "mi", "ner", "sol"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    item, clean, other, shared = text(30), text(50), text(50), text(50)
    rows = [(1, shared), (None, shared + " sita"), (None, clean), (7, other), (7, text(10) + " " + item), (None, text(10) + " " + item)]
    rows += [(100 + i, text(30) + (" you idiot moron" if i % 4 == 0 else "")) for i in range(120)]
    rows += [(None, text(30) + " you idiot moron")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(100 + i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = lambda stage: {r["text"] for r in stage(spark, docs, str(tmp_path)).collect()}
    everything = {t for _, t in rows}
    assert left(corpus_pipeline.drop_toxic) == {t for t in everything if "idiot" not in t}
    assert left(corpus_pipeline.drop_near_copies) == everything - {shared + " sita"}
    assert left(corpus_pipeline.drop_contaminated) == {t for t in everything if item not in t}


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_stages_on_nulls_and_repeats(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, "x y"), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "one two three four five six", None), (1, "one two three four five six", None), (None, None, "x"), (None, "", "x"), (2, None, None), (3, "word " * 40_000, "x"), (4, "solo", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = lambda stage: sorted(((r["doc_id"], r["text"], r["key"]) for r in stage(spark, docs, str(tmp_path)).collect()), key=str)
    everything = sorted(rows, key=str)
    assert kept(corpus_pipeline.drop_toxic) == everything
    assert kept(corpus_pipeline.drop_contaminated) == everything
    assert kept(corpus_pipeline.drop_near_copies) == everything
    once = kept(corpus_pipeline.drop_copies)
    assert [r[0] for r in once if r[1] and r[1] != ""] == [1, 3, 4] and sum(not r[1] for r in once) == 1
    packed = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect()
    assert sum(r["piece"] == 0 for r in packed) == len(rows) and sum(r["doc_id"] == 3 for r in packed) > 1
