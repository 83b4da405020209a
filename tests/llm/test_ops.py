"""Operators on small and odd inputs, against brute force, libraries or round trips."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeline.llm import ann, chat, langid, media, ngramjoin, packing, piecetrie, quality, queries, tokencount, toxicity
from treeline.llm.components import components
from treeline.llm.textbatch import ALNUM, NOT_SPACE, Words, text_slices
from treeline.llm.wordbpe import ChunkEncoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "é", "!!! ???", "日本 語 é😀 \x00", "word " * 30_000, "x" * 20_000, "A b C d", "a B c D", "a b c d", "<|endoftext|> 's don't", "﻿ z​z"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[8], (None, "null id", None, None, None)], DOCS)


@pytest.fixture(scope="module")
def sf(tmp_path_factory, spark, odd):
    """Tables of odd rows, as the queries read them."""
    out = tmp_path_factory.mktemp("sf")
    odd.where("doc_id is not null").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(len(ODD))], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, 0.0]), (6, [1.0, None]), (7, [1.0, 0.0, 0.0]), (100, [0.9, 0.0]), (200, [])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{out}/embeddings.parquet")
    turns = [(1, 0, "system", "be <|im_end|> good"), (1, 1, "user", None), (1, 2, "assistant", "ok <\\|x"), (1, 2, "assistant", "ok <\\|x"), (2, 0, "odd\nrole", "t"), (3, 0, "assistant", "long " * 5000)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{out}/conversations.parquet")
    return str(out)


def test_words_against_regex():
    text = "Ab cD\x0b é  x\nab"
    data = np.frombuffer((text * 2).encode(), np.uint8)
    half = len(data) // 2
    w = Words(data, np.array([0, half, len(data)]), NOT_SPACE)
    found = [data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
    assert found == 2 * re.findall(r"[^\x20\x09-\x0D]+", text)
    h = w.hashes()
    assert h[0] == h[4] == h[5] and len(set(h.tolist())) == 4
    assert len(Words(np.zeros(0, np.uint8), np.array([0, 0]), ALNUM).hashes()) == 0


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k,percent,most,affordable", [(4, 85, 1 << 20, 64), (5, 80, 1 << 20, 0), (4, 80, 3, 0)])
def test_join_against_brute_force(spark, monkeypatch, k, percent, most, affordable):
    """Near copies of a few texts, with frequent shingles counted as such from five documents on, so that pairs are indexed too; and with more of them than go into one list, with all rounds of pivots."""
    monkeypatch.setattr(ngramjoin, "FREQUENT_FROM", 5)
    monkeypatch.setattr(ngramjoin, "MANY", 3)
    monkeypatch.setattr(ngramjoin, "FREQUENT_MOST", most)
    monkeypatch.setattr(ngramjoin, "AFFORDED", affordable)
    monkeypatch.setattr(ngramjoin, "REMEMBERED", 7)
    rng = random.Random(k)
    base = [[f"w{rng.randrange(40)}" for _ in range(n)] for n in (6, 12, 40, 90, 200)]
    rows = []
    for i in range(220):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(["X", f"new{i}", "y"])
        rows.append((i, rng.choice(["", "Common opening passage of many words that all of these share "]) + " ".join(words)))
    rows += [(300, None), (301, ""), (302, " "), (303, "a b"), (304, "A  b"), (305, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.near_duplicates(docs, k, percent).collect()}
    assert found == brute_components(rows, k, percent)


@pytest.mark.parametrize("at_once", [2, 11, 1000])
def test_components(spark, at_once):
    """Links in one task and in many, a long chain among them."""
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 50), (60, 60), (None, 3)]
    random.Random(at_once).shuffle(edges)
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(9), at_once).df.collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, 50: 50, 51: 50}
    assert components(spark.createDataFrame([], "a long, b long"), at_once).df.count() == 0


def test_one_of_each_keeps_rows_and_columns(spark, odd):
    more = ("TOKENS", "_gone", "gone", "component_id", "set_id")
    kept = ngramjoin.one_of_each(odd.withColumns({c: F.lit(1) for c in more}))
    assert kept.columns == [*odd.columns, *more]
    ids = [r.doc_id for r in kept.collect()]
    assert None in ids and 8 in ids and 9 not in ids and 10 not in ids and {0, 1, 2} <= set(ids)


def test_word_encoder_is_exact():
    path = public_tokenizers.path("word_bpe_49k.json")
    enc = ChunkEncoder(path)
    texts = [t or "" for t in ODD] + ["It's 12 o'CLOCK… ½ straße ŉ İ", "a\x1cb\x85c d", "re've'll''s"]
    for text, got in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing(spark, sf):
    rows = queries.op8_packing(spark, sf).toPandas()
    tokenizer = ChunkEncoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    for i, text in enumerate(ODD):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = rows[rows.doc_id == i].drop_duplicates("piece").sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length.iloc[:-1] == 2048).all()
        assert [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own.itertuples()] == own.ids_crc32.tolist()
    for _, seq in rows.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *np.cumsum(seq.length)[:-1]] and seq.length.sum() <= 2048


def test_local_search_empties_bins():
    lengths = np.array([6, 5, 5, 4, 4, 3, 3])
    start = np.array([0, 1, 2, 0, 3, 1, 2])  # fills 10, 8, 8, 4 of 10
    out = packing.local_search(lengths, start, 10)
    fill = np.bincount(out, weights=lengths)
    assert len(fill) == 3 and fill.max() <= 10
    rng = np.random.default_rng(0)
    x = rng.integers(1, 60, 400)
    first = packing.best_fit(x, 100)
    again = packing.local_search(x, first, 100)
    assert again.max() <= first.max() and np.bincount(again, weights=x).max() <= 100 and len(again) == len(x)


def test_pieces_match_the_library(spark, sf):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    enc = piecetrie.PieceEncoder(path)
    texts = [t or "" for t in ODD] + ["  a   b ", "\n\n", "▁x ▁▁", "ab" * 400]
    for text, got in zip(texts, enc.encode(texts), strict=True):
        ids = np.frombuffer(got, "<u4").tolist()
        assert ids == lib.encode(text) and enc.decode(got) == text.replace("▁", " ")
    rows = queries.op2_sentencepiece(spark, sf).toPandas()
    for i, text in enumerate(ODD):
        assert set(rows[rows.doc_id == i].decoded_sha256) == {hashlib.sha256((text or "").encode()).hexdigest()}


def test_chat_read_back(spark, sf):
    found = {r.conv_id: r for r in queries.op3_chat_windows(spark, sf).collect()}
    turns = {}
    for r in queries.conversations(spark, sf).orderBy("conv_id", "turn", "role", "text").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(found) == set(turns)
    for conv, own in turns.items():
        loss = "".join(t for role, t in own if role == "assistant")
        r = found[conv]
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss)) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in own).encode()).hexdigest()


def test_chat_windows_keep_to_the_budget(spark):
    rows = [(1, 0, "system", "rules")] + [(1, i, "user" if i % 2 else "assistant", f"turn {i} " * (i % 7)) for i in range(1, 60)]
    w = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), public_tokenizers.path("byte_bpe_50k.json"), 120, 40).toPandas().sort_values("window")
    assert len(w) > 3 and w.n_tokens.max() <= 120 and w.n_new.sum() == 60
    assert all(text.startswith("<|im_start|>system\n") for text in w.text) and (w.n_repeated.iloc[1:] >= 1).all()


def test_media(spark, sf):
    for r in queries.op4_media(spark, sf).collect():
        raw = (ODD[r.doc_id] or "").encode()
        padded = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        file = media.store(padded)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest()) and r.feature == media.scan(file).feature()
    file = media.store(bytes(192 * 40))
    files = spark.createDataFrame([(1, bytearray(file)), (2, None), (3, bytearray()), (4, bytearray(file[:-30])), (5, bytearray(b"\0\0\0\1mdat"))], "id int, Codec binary")
    out = {r.id: r for r in media.media_columns(files, "Codec").collect()}
    assert out[1].codec_ == "raw " and len(out[1].keyframes) == 3 and out[1].media_error is None
    assert all(out[i].codec_ is None and out[i].media_error for i in (2, 3, 4, 5))


def test_media_counts_are_checked_before_they_cost_memory(spark):
    """Headers that promise more samples than a file can hold are errors, in whatever table."""
    file = media.store(bytes(192 * 40))
    at = file.index(b"stsz") + 4
    for n, same in ((2**32 - 1, 1), (2**32 - 1, 192), (60_000_000, 192), (2**32 - 1, 0)):
        wrong = bytearray(file)
        wrong[at + 4 : at + 12] = same.to_bytes(4, "big") + n.to_bytes(4, "big")
        assert media.scan(bytes(wrong)).error
    for name in (b"stco", b"stsc", b"stss", b"stts"):
        wrong = bytearray(file)
        i = file.index(name) + 8
        wrong[i : i + 4] = b"\xff" * 4
        assert media.scan(bytes(wrong)).error or name == b"stts"


def test_pieces_of_long_and_repeated_words():
    """All words go through the trie, runs of marks and of one sign too."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, enc, rng = sentencepiece.SentencePieceProcessor(model_file=path), piecetrie.PieceEncoder(path), random.Random(1)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(n))) for signs, n in (([" ", "a", "b"], 60), (["in", "the", "==", " ", "    ", "000", "é"], 80), (list("etaoin  \n"), 400)) for _ in range(100)]
    texts += [" " * i + "the" + " " * i for i in range(40)] + ["a" * 5_000, "=" * 3_000, " " * 3_000]
    for text, got in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == lib.encode(text)


def test_slices_are_bounded_in_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["ab"] * 5_000 + [None, "x" * 600_000, ""]})
    sizes = [rows.num_rows for rows, _, _ in text_slices([batch], "text")]
    assert sum(sizes) == 5_003 and max(sizes) <= 1_024


def test_nearest_against_brute_force(spark, sf):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[50:90] = x[50]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = ann.nearest(df, F.col("vec_id") % 20 == 0, 10, curves=8, block=128).toPandas()
    hits = 0
    for q in range(0, 600, 20):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        own = found[found.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and np.array_equal(own.score, d[own.vec_id])
        hits += len(set(best) & set(own.vec_id))
        if 50 <= q < 90:
            assert own.vec_id.tolist() == [int(b) for b in best]
    assert hits >= 0.9 * 300
    odd = {(r.query_id, r.vec_id) for r in queries.op1_nearest_neighbours(spark, sf).collect()}
    assert odd == {(0, 5), (0, 1), (0, 100), (100, 0), (100, 1), (100, 5)}


def recall(found, x, asked, k=10):
    hits = 0
    for q in asked:
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:k]
        hits += len(set(best) & set(found[found.query_id == q].vec_id))
    return hits / k / len(asked)


@pytest.mark.parametrize("copies", [0, 1500])
def test_recall_at_many_blocks_and_near_copies(spark, copies):
    """Independent vectors in far more blocks than the windows hold, and near copies of one vector that crowd a cell of the grid."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    x[rng.permutation(4000)[:copies]] = x[0] + rng.normal(size=(copies, 32)).astype(np.float32) * 1e-3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = ann.nearest(df, F.col("vec_id") % 40 == 0, 10, curves=6, block=32).toPandas()
    assert recall(found, x, range(0, 4000, 40)) >= 0.9


def test_token_counts(spark, odd):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    enc = tokencount.encoder(path, pattern)
    rows = tokencount.section_counts(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), path, pattern).toPandas()
    for i, text in enumerate(ODD):
        own = rows[rows.doc_id == i].sort_values("section")
        assert own.n_tokens.sum() == len(enc.encoding.encode_ordinary(text or "")) and own.end.iloc[-1] == len(text or "")
    ends, bounds = np.array([2, 7, 9]), np.array([0, 3, 6, 9])
    assert tokencount.attribute(ends, bounds, "first")[0].tolist() == [2, 0, 1]
    assert tokencount.attribute(ends, bounds, "last")[0].tolist() == [1, 0, 2]
    assert tokencount.attribute(ends, bounds, "most")[0].tolist() == [1, 1, 1]
    assert np.allclose(tokencount.attribute(ends, bounds, "fraction")[0], [1.2, 0.6, 1.2])
    fields = tokencount.field_counts(spark.createDataFrame([(1, "Hel", None, "lo world")], "doc_id long, a string, b string, c string"), ["a", "b", "c"], path, pattern).orderBy("section").collect()
    assert [r.n_tokens for r in fields] == [1.0, 0.0, 1.0] and fields[0].doc_tokens == 2


def test_classifiers_take_odd_rows_and_no_labels(spark, sf, odd):
    for q in (queries.op5_language, queries.op6_quality, queries.op7_toxicity):
        rows = q(spark, sf).toPandas()
        assert len(rows) == len(ODD) + 1 and rows.score.between(0, 1).all()
    assert set(langid.predict(odd, None).toPandas().lang_pred) == {"und"}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert set(quality.score(odd, quality.fit(odd, none, F.lit(True))).toPandas().score) == {0.5}
    assert toxicity.score(odd, toxicity.fit(odd, none, F.lit(True))).toPandas().score.max() < 1e-6
    empty = odd.limit(0)
    assert langid.fit(empty) is None and ngramjoin.near_duplicates(empty).count() == 0 and packing.pack(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert quality.keep(odd, quality.fit(odd, none, F.lit(True)), 0.3).columns == odd.columns


def test_deobfuscation():
    chars = toxicity.CharModel()
    for w in "idiot stupid moron loser worthless trash clown scum the and thing this are street hello".split():
        chars.add(w, 20)
    r = toxicity.Restorer(chars)
    for seen, meant in (("1d10t", "idiot"), ("$tup1d", "stupid"), ("m0r0n", "moron"), ("l o s e r", "loser"), ("s.c.u.m", "scum"), ("stuuuupid", "stupid"), ("cl*wn", "clown"), ("id​iot", "idiot")):
        assert r.text(seen) == meant
    for plain in ("the thing", "hello street", "2019", "ok!!", "a b"):
        assert r.text(plain) == plain


def test_spaced_runs_keep_word_boundaries():
    chars = toxicity.CharModel()
    for w in "you are a loser what idiot i said go stupid moron the and thing this street hello".split():
        chars.add(w, 20)
    r = toxicity.Restorer(chars)
    for seen, meant in (("you are a l o s e r", "you are a loser"), ("what i d i o t i said", "what idiot i said"), ("y o u i d i o t g o", "you idiot go"), ("a l 0 s 3 r", "a loser"), ('"i.d.i.o.t"', "idiot")):
        assert r.text(seen) == meant
    assert r.text(" ".join("youidiotgo" * 30)) == " ".join(["you idiot go"] * 30)
    assert r.text("st" + "u" * 60 + "pid") == "stupid" and r.text("1d10t" * 20) == "idiot" * 20


def test_character_model_counts_all_texts(spark):
    """A word that only unlabelled texts hold restores a spaced one, and counts are of all texts."""
    texts = [(i, "the zyxwvut goes") for i in range(50)] + [(100, "plain words"), (101, "other words")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(100, 1), (101, 0)], "doc_id long, toxic int")
    chars = toxicity.fit(docs, labels, F.lit(True)).chars
    assert chars.words["zyxwvut"] == 50 and chars.three["^^z"] == 50 and chars.two["zy"] == 50 and chars.one["z"] == 50
    assert toxicity.Restorer(chars).text("the z y x w v u t goes") == "the zyxwvut goes"


def test_local_search_ends_where_no_exchange_improves():
    """On a group too large for a bounded search, and against all exchanges of up to two items on a small one."""
    rng = np.random.default_rng(0)
    x = rng.integers(300, 1101, 4000)
    assert packing.local_search(x, packing.best_fit(x, 2048), 2048).max() + 1 <= 1390  # best fit decreasing leaves 1411
    x = rng.integers(500, 901, 150)
    bins = packing.local_search(x, packing.best_fit(x, 2048), 2048)
    fill = np.bincount(bins, weights=x).astype(int)
    assert fill.max() <= 2048 and fill.sum() == x.sum()
    sets = [[sum(c) for n in (1, 2) for c in itertools.combinations(x[bins == b].tolist(), n)] for b in range(len(fill))]
    assert len(fill) > -(-x.sum() // 2048)  # so the search ended for want of exchanges
    for a, b in itertools.permutations(range(len(fill)), 2):
        gains = [out - back for out in sets[a] for back in [0, *sets[b]] if out > back and fill[b] + out - back <= 2048]
        assert not any(fill[b] + g > fill[a] for g in gains)


def test_join_counts_all_links(spark, monkeypatch):
    """Groups of different texts that all link, with copies of some."""
    monkeypatch.setattr(ngramjoin, "FREQUENT_FROM", 5)
    rng = random.Random(3)
    base = [[f"w{rng.randrange(60)}" for _ in range(n)] for n in (60, 150)]
    rows = []
    for i in range(120):
        words = list(base[i % 2])
        words[rng.randrange(len(words))] = rng.choice(["X", f"new{i}"])
        rows.append((i, " ".join(words)))
    rows += [(200 + i, t) for i, t in rows[:9]] + [(300, ""), (301, "alone here")]
    sets = {i: {tuple(t.lower().split()[j : j + 4]) for j in range(max(1, len(t.split()) - 3))} if t else set() for i, t in rows}
    brute = {a: sum(a != b and bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for b in sets) for a in sets}
    found = ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80, count_links=True).collect()
    assert max(brute.values()) > 20 and {r.doc_id: r.n_links for r in found} == brute


def test_join_pairs_no_more_than_its_index_has_rows(spark, monkeypatch):
    """A chain of texts that link with near neighbours only, and long texts that share hundreds of signatures and do not link: pairs that are left to the last join."""
    monkeypatch.setattr(ngramjoin, "FREQUENT_FROM", 5)
    rng = random.Random(5)
    stream = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(stream[i : i + 120])) for i in range(240)]
    for i in range(3):
        long = [f"l{i}x{j}" for j in range(800)]
        rows += [(300 + 10 * i + j, " ".join(w if rng.random() < 0.98 else f"n{j}x{at}" for at, w in enumerate(long))) for j in range(4)]
    held = {}

    class Seen(ngramjoin.Stored):
        def drop(self):
            if self.name == "mixed":  # pairs of different parts, bucket by bucket
                at = self.df.select("sig", "set_id", "part")
                held["left"] = at.join(at.toDF("sig", "other", "there"), "sig").where("set_id < other and part <> there").count()
            elif self.name == "index":
                held["postings"] = self.df.count()
            super().drop()

        def __init__(self, df, name):
            super().__init__(df, name)
            self.name = name

    monkeypatch.setattr(ngramjoin, "Stored", Seen)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert found == brute_components(rows, 4, 85)
    assert 0 < held["left"] <= held["postings"]


@pytest.mark.parametrize("least_of", [16, 1])
def test_join_meets_frequent_pairs_once(spark, monkeypatch, least_of):
    """Long texts just under and over the similarity, which share a hundred frequent pairs: two sets meet at few of them, and all of them meet."""
    monkeypatch.setattr(ngramjoin, "FREQUENT_FROM", 5)
    monkeypatch.setattr(ngramjoin, "AFFORDED", 1 << 20)
    monkeypatch.setattr(ngramjoin, "LEAST_OF", least_of)
    rng = random.Random(11)
    rows = []
    for i in range(90):
        base = [f"b{i % 2}x{j}" for j in range(400)]
        rows.append((i, " ".join(w if rng.random() < 0.985 else f"n{i}x{at}" for at, w in enumerate(base))))
    meetings, held = ngramjoin._meetings, {}

    def counted(part, may):
        found = meetings(part, may)
        at = found.where("not x.rare").selectExpr("x.set_id as a", "y.set_id as b")
        every = part.alias("x").join(part.alias("y"), F.expr(f"x.sig = y.sig and x.set_id < y.set_id and x.part <> y.part and not x.rare and {may}")).selectExpr("x.set_id as a", "y.set_id as b")
        held.update(made=at.count(), pairs=at.distinct().count(), all_made=every.count(), all_pairs=every.distinct().count())
        return found

    monkeypatch.setattr(ngramjoin, "_meetings", counted)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert found == brute_components(rows, 4, 85)
    assert held["pairs"] == held["all_pairs"] > 100 and held["all_made"] > 30 * held["pairs"]
    assert held["made"] < 1.1 * held["pairs"] if least_of == 16 else held["pairs"] < held["made"] < held["all_made"]


def naive_windows(turns, budget, history):
    """(turns repeated, new turns) of each window, turn by turn: history gives way to the first new turn, new turns follow while they fit."""
    out, at, before = [], 0, []
    system = [0] if turns[0].role == "system" else []
    while at < len(turns):
        keep = system if at else []
        again = list(before)
        size = lambda ids: sum(turns[i].tokens for i in ids)
        while again and size(keep + again) + turns[at].tokens > budget:
            again.pop(0)
        new = [at]
        while new[-1] + 1 < len(turns) and size(keep + again + new) + turns[new[-1] + 1].tokens <= budget:
            new.append(new[-1] + 1)
        out.append((keep + again, new))
        at, before = new[-1] + 1, []
        room = min(history, budget - size(system))
        for i in reversed([i for i in again + new if i not in system]):
            if size(before) + turns[i].tokens > room:
                break
            before.insert(0, i)
    return out


def test_windows_against_a_naive_cutter():
    """Spans by prefix sums, turns given in runs of any length."""
    rng = random.Random(4)
    for _ in range(300):
        budget, history = rng.choice([30, 60, 100]), rng.choice([5, 20, 60])
        turns = [chat.Turn("system" if not i and rng.random() < 0.5 else rng.choice(["user", "assistant"]), f"t{i}", rng.choice([1, 2, 9, 20, 40, 120])) for i in range(rng.randrange(1, 40))]
        w, found, i = chat.Windows(budget, history), [], 0
        while i < len(turns):
            n = rng.randrange(1, 8)
            found += w.extend(turns[i : i + n])
            i += n
        found.append(w.close())
        want = naive_windows(turns, budget, history)
        assert [(x["n_repeated"], x["first_turn"], x["n_new"]) for x in found] == [(len(a), n[0], len(n)) for a, n in want]
        assert [x["text"] for x in found] == ["".join(turns[j].formatted() for j in a + n) for a, n in want]


def test_history_gives_way_to_a_long_turn():
    w = chat.Windows(1024, 256)
    sizes = [20, 200, 700, 240, 900, 100, 1000, 30]
    out = [x for i, n in enumerate(sizes) for x in w.add(chat.Turn("system" if not i else "user", str(i), n))] + [w.close()]
    assert max(x["n_tokens"] for x in out) <= 1024 and sum(x["n_new"] for x in out) == len(sizes)
    assert out[-1]["text"].startswith("<|im_start|>system\n")


def test_rare_languages_are_learned(spark):
    docs = spark.range(60_000).selectExpr("id as doc_id", "if(id % 20000 = 4321, 'kxq zwv jyp qqk', 'the cat sat') as text", "if(id % 20000 = 4321, 'zz', 'en') as lang")
    model = langid.fit(docs, sample=500)
    assert model.langs == ["en", "zz"] and model.scores(presence_of("kxq zwv jyp")).argmax() == 1


def presence_of(text):
    raw = text.encode()
    return langid.presence(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64))
