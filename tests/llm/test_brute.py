"""Operators that SQL cannot express against brute force, and odd tables through all of them and all stages."""

import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from treeline.llm import ann, chat, langid, media, ngramjoin, packing, piecetrie, quality, queries, tokencount, toxicity
from treeline.llm.textbatch import FOLD

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [None, "", " \n", "é", "!!! ???", "word " * 3_000, "x" * 9_000, "A b C d", "a B c D", "a b c d", "You stupid id10t", "fine and calm words here"]


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def test_kernel_against_counted_ngrams():
    """Shared n-grams over the geometric mean of how many each text has, counted one by one."""
    texts = ["the cat sat", "THE Dog", "ein Hund", "é", "", "a", "el perro come", "the cat"]

    def grams(t):
        raw = FOLD[np.frombuffer(t.encode(), np.uint8)].tobytes()
        out = set()
        for n in range(1, langid.NGRAM + 1):
            for i in range(len(raw) - n + 1):
                g = int.from_bytes(raw[i : i + n], "big")
                h = ((g * 0x9E3779B97F4A7C15 + n * 0xD1B54A32D192ED03) * 0xBF58476D1CE4E5B9) % (1 << 64)
                out.add(h >> (64 - langid.BITS))
        return out

    x = langid.presence(*buffers(texts))
    model = langid.fit_arrays(x, ["en", "en", "de", "xx", "xx", "en", "es", "en"], landmarks=4)
    chosen = [3, 6, 2, 0]  # dealt over languages in turn: de, en, es, xx
    sets = [grams(t) for t in texts]
    want = [[len(a & sets[m]) / math.sqrt(max(1, len(a)) * max(1, len(sets[m]))) for m in (2, 0, 6, 3)] for a in sets]
    assert sorted(chosen) == [0, 2, 3, 6] and np.allclose(model.kernel(x), want, atol=1e-5)


def test_equal_languages_tie_by_name():
    x = langid.presence(*buffers(["abc", "abc"]))
    model = langid.fit_arrays(x, ["b", "a"])
    assert model.langs == ["a", "b"] and model.scores(x[:1]).argmax() == 0


def test_factorisation_identity_and_gradient():
    """Pairwise interactions one by one; a step of the fit lowers the loss on separable texts."""
    rng = np.random.default_rng(0)
    texts = ["good words here now", "BAD!!! ### bad", "plain", ""]
    x, stats = quality.features(*buffers(texts))
    width = quality.BUCKETS + quality.N_STATS
    m = quality.FactorisationMachine(0.3, rng.normal(size=width).astype(np.float32), rng.normal(0, 0.3, (width, 4)).astype(np.float32), stats.mean(0), stats.std(0) + 1)
    z = m.inputs(x, stats)
    for row, got in zip(z, m.logits(z), strict=True):
        at = np.flatnonzero(row)
        pairs = sum(float(m.factors[i] @ m.factors[j]) * float(row[i]) * float(row[j]) for i, j in itertools.combinations(at, 2))
        assert abs(m.bias + float(row @ m.weights) + pairs - got) < 1e-3
    many = texts[:2] * 40
    x, stats = quality.features(*buffers(many))
    y = np.array([1.0, 0.0] * 40, np.float32)
    fitted = quality.fit_arrays(np.packbits(x > 0, axis=1), stats, y, steps=60)
    s = fitted.scores(x, stats)
    assert s[0] > 0.8 and s[1] < 0.2


def test_lattice_against_enumeration():
    """All paths of a lattice, each scored sign by sign."""
    chars = toxicity.CharModel()
    for w in "idiot stupid moron loser the thing ill still".split():
        chars.add(w, 7)

    def price(word):
        marked = f"^^{word}$"
        return sum(chars.cost(marked[i - 2 : i], marked[i]) for i in range(2, len(marked)))

    for token in ("1d10t", "st1ll", "m0r0n", "stuupid", "l0seeer", "th1n6", "$7up1d", "aaa1"):
        paths = []
        for way in itertools.product(*toxicity.lattice(token)):
            text = "".join(letters for letters, _ in way)
            paths.append((sum(cost for _, cost in way) + price(text), text))
        best = min(paths)
        found = toxicity.decode(token, chars)
        assert math.isclose(min(c for c, t in paths if t == found), best[0], rel_tol=1e-9), (token, found, best)


def test_best_fit_against_a_naive_packer():
    rng = np.random.default_rng(3)
    for size in (1, 5, 60, 300):
        lengths = rng.integers(1, 101, size)
        rooms: list[int] = []
        for n in sorted(lengths.tolist(), reverse=True):
            open_ = [r for r in rooms if r >= n]
            if open_:
                rooms.remove(min(open_))
                rooms.append(min(open_) - n)
            else:
                rooms.append(100 - n)
        fill = np.bincount(packing.best_fit(lengths, 100), weights=lengths)
        assert sorted(100 - fill.astype(int)) == sorted(rooms)


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_sections_against_a_naive_count(rule):
    """Each token by its own bytes, each section by itself."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    enc, rng = tokencount.encoder(path, pattern), random.Random(2)
    for _ in range(40):
        text = "".join(rng.choice(["the ", "\n", "\n\n", "é", "日本", "  ", "word", "!!"]) for _ in range(rng.randrange(1, 60)))
        raw = text.encode()
        cuts = [i + 1 for i, b in enumerate(raw) if b == 10 and i + 1 < len(raw)]
        bounds = [0, *cuts, len(raw)]
        ends = enc.ends(text)
        counts = [0] * (len(bounds) - 1)
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            part = [max(0, min(b, bounds[k + 1]) - max(a, bounds[k])) for k in range(len(counts))]
            touched = [k for k, p in enumerate(part) if p]
            counts[touched[0] if rule == "first" else touched[-1] if rule == "last" else max(touched, key=lambda k: (part[k], -k))] += 1
        assert tokencount.attribute(ends, np.array(bounds), rule)[0].tolist() == counts


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[7], (None, "null id", None, None, None)], DOCS)


@pytest.fixture(scope="module")
def sf(tmp_path_factory, spark, odd):
    out = tmp_path_factory.mktemp("sf")
    odd.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i == 10)) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(None, 0, "user", "a"), (1, 0, "user", "b"), (None, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{out}/conversations.parquet")
    return str(out)


@pytest.fixture(scope="module")
def empty(tmp_path_factory, spark, odd):
    out = tmp_path_factory.mktemp("empty")
    odd.limit(0).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{out}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{out}/conversations.parquet")
    return str(out)


def test_empty_tables(spark, empty):
    """No rows give no rows; op3 has the conversation that the contract adds."""
    for name, f in queries.queries().items():
        assert f(spark, empty).count() == (1 if name.startswith("op3") else 0), name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, queries.table(spark, empty, "documents"), empty).count() == 0, name


def test_null_ids_and_repeated_rows(spark, sf):
    n = len(TEXTS) + 2
    assert queries.op2_sentencepiece(spark, sf).count() == queries.op4_media(spark, sf).count() == n
    nine = queries.op9_token_counts(spark, sf)
    assert nine.where("doc_id is null").count() == 1 and nine.where("doc_id = 7").count() == 2
    found = {r.conv_id: r.n_turns for r in queries.op3_chat_windows(spark, sf).collect()}
    assert found == {None: 2, 1: 1, -1: 2}
    assert queries.op8_packing(spark, sf).where("doc_id is null").count() == 1
    assert ngramjoin.near_duplicates(queries.table(spark, sf, "documents"), 4, 85).where("doc_id = 7").count() == 1


def test_stages_take_odd_rows_and_other_columns(spark, sf, odd):
    """Each stage keeps the columns, whatever their names, and does what its operator decides on its own input."""
    more = ["TOKENS", "score", "component_id", "set_id", "gone", "label", "kept"]
    docs = odd.withColumns({c: F.lit(1) for c in more})
    for (name, stage), least in zip(corpus_pipeline.STAGES[:-1], (1, 1, 1), strict=True):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and least <= out.count() <= docs.count(), name
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect()}
    assert {0, 1, 2, 7, None} <= kept and not {8, 9} & kept
    packed = corpus_pipeline.packing_stage(spark, docs, sf)
    assert packed.where("length > 2048").count() == 0 and {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    model = quality.fit(docs, queries.table(spark, sf, "labels"), F.lit(True))
    scores = quality.score(docs, model).collect()
    kept = [r.doc_id for r in quality.keep(docs, model, 0.5).collect()]
    assert sorted(kept, key=str) == sorted((r.doc_id for r in scores if r.score >= 0.5), key=str)
    toxic = toxicity.fit(docs, queries.table(spark, sf, "labels"), F.lit(True))
    scores = toxicity.score(docs, toxic).collect()
    kept = [r.doc_id for r in toxicity.keep(docs, toxic, 0.3).collect()]
    assert sorted(kept, key=str) == sorted((r.doc_id for r in scores if r.score < 0.3), key=str)


def test_other_columns_are_not_read(spark, odd):
    docs = odd.withColumns({"DOC_ID_2": F.lit("x"), "ids": F.lit(1), "vec": F.lit(2), "tokens": F.lit(3), "section": F.lit(4)})
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert piecetrie.decode(piecetrie.encode(docs, path), path).columns == ["doc_id", "text", "n_tokens", "ids_crc32"]
    turns = spark.createDataFrame([(1, 0, "user", "a", 5, 6)], "conv_id long, turn long, role string, text string, tokens int, window int")
    assert chat.format_windows(turns, public_tokenizers.path("byte_bpe_50k.json")).count() == 1
    vectors = spark.createDataFrame([(i, [float(i), 1.0], 1, 2, 3) for i in range(5)], "vec_id long, embedding array<float>, point int, rank int, score int")
    assert ann.nearest(vectors, F.col("vec_id") == 0, 2).columns == ["query_id", "rank", "vec_id", "score"]
    files = spark.createDataFrame([(1, bytearray(media.store(bytes(192))), "c", 2)], "id int, file binary, codec string, Handler int")
    assert media.media_columns(files, "file").columns == ["id", "file", "codec", "Handler", "codec_", "handler_", "duration_s", "n_samples", "sample_bytes", "keyframes", "media_error"]
