"""Training-data operators against brute force, the libraries themselves and hand-made corner cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hearthline.llm import common, exact_dedup, induced, licences, minhash, packing, pieces, quality, repeats, token_counts, topk, toxicity

DOC = "doc_id long, text string, lang string, bucket int, row string, key long, kept boolean, z int"
WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def docs_of(spark, texts):
    """Extra columns carry names that operators use inside; some ids repeat with their text, one is null."""
    return spark.createDataFrame([(i, t, "en", 1, "r", 2, True, 3) for i, t in texts], DOC)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 120))) for _ in range(40)]
    texts = list(base)
    for t in base[:15]:
        w = t.split()
        w[rng.randrange(len(w))] = "edited"
        texts += [t, t.upper(), " ".join(w), t.replace(" ", "\n\t")]
    shared = " ".join(rng.choice(words) for _ in range(60))
    texts += [f"{a} {shared} {b}" for a, b in zip(base[:5], base[5:10])]
    texts += [None, "", " \n ", "one", "ONE", "a " * 400, "日本語 🎉 " * 40, "x" * 5000, "Copyright 2020 me", "Released under the MIT Licence", "é" * 150 + "b", "word " * 6000]
    rows = list(enumerate(texts)) + [(7, texts[7])]
    return rows, docs_of(spark, rows)


def empty(spark):
    return docs_of(spark, [])


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = empty(spark)
    for got in (exact_dedup.exact_groups(none), licences.scan(none), token_counts.count_tokens(none, WORD), pieces.encode_decode(none, PIECE), minhash.near_components(none), repeats.remove_repeats(none), packing.pack(none, WORD), quality.score(none, labels), toxicity.score(none, labels)):
        assert got.count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_exact_dedup(corpus):
    rows, docs = corpus
    import re

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = norm(dict(rows)[r["doc_id"]])
        same = [i for i, t in rows if norm(t) == mine]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(same), len(same), r["doc_id"] == min(same)) and r["text_sha256"] == hashlib.sha256(mine.encode()).hexdigest()


def test_licences(corpus):
    got = {r["doc_id"]: r for r in licences.scan(corpus[1]).collect()}
    said = {i: t for i, t in corpus[0]}
    mit = next(i for i, t in said.items() if t and "MIT" in t)
    assert (got[mit]["text_license"], got[mit]["licenses"], got[mit]["n_license_lines"]) == ("MIT", "MIT", 1)
    assert all(r["text_license"] is None and r["n_license_lines"] == 0 for i, r in got.items() if i != mit)


def test_token_counts_and_cache(spark, corpus, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = {r["doc_id"]: r for r in token_counts.count_tokens(corpus[1], WORD, cache).collect()}
    assert all(got[i]["n_tokens"] == len(t.encode(x or "", add_special_tokens=False).ids) and got[i]["n_bytes"] == len((x or "").encode()) for i, x in corpus[0])
    assert spark.read.parquet(cache).count() == len({x or "" for _, x in corpus[0]})  # every text was encoded once


def test_pieces(corpus):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = {r["doc_id"]: r for r in pieces.encode_decode(corpus[1], PIECE, texts=True).collect()}
    for i, x in corpus[0]:
        ids = sp.encode(x or "")
        assert got[i]["ids"] == ids and got[i]["decoded"] == sp.decode(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    m = pieces.PieceModel(PIECE)
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(9)]
        assert m.decode(ids) == sp.decode(ids)
    odd = ["a" * 80, " ▁ x", "\x00\x1c", "  \n  def f(x):", "ﬁ½Ⅳ é"]
    assert [x.tolist() for x in m.encode(odd)] == sp.encode(odd)


def test_token_ids_of_odd_signs():
    """Random strings of marks, stops and letters whose lower case is longer, against the library."""
    from tokenizers import Tokenizer

    t, encoder, rng = Tokenizer.from_file(WORD), token_counts.WordEncoder(WORD), random.Random(2)
    pool = [*"abXY.,!?'’- 09", "İ", "ı", "ß", "ŉ", "ﬁ", "e\u0301", "\u0307", "Σ", "я", "Ї", "日", "ª", "ΐ", "K", "'s", "<|endoftext|>", " ", "\x1c", "\x85", "🎉", "ſ"]
    texts = ["İ,", "ISTANBUL İ, x", *("".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(3000))]
    for x, chunks in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(b"".join(chunks), dtype="<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_hot_texts_are_counted(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    docs = spark.createDataFrame([(i, "same words" if i % 2 else f"text {i}") for i in range(40)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, WORD).collect()}
    assert len(got) == 40 and {got[i] for i in range(1, 40, 2)} == {2}


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize("blocks", [False, True])
def test_minhash_components(corpus, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(minhash, "SMALL", 1)
        monkeypatch.setattr(minhash, "BLOCK", 2)
    rows = dict(corpus[0])
    sets = {i: shingles(t, 4) for i, t in rows.items()}
    comp = {i: i for i in rows}
    for a in rows:
        for b in rows:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((comp[a], comp[b]))
                comp = {k: x if v == y else v for k, v in comp.items()}
    for r in minhash.near_components(corpus[1], 4, 80).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"])


def test_sketch_estimates():
    a = np.unique(np.random.default_rng(0).integers(0, 2**63, 3000).astype(np.uint64))
    x, y = minhash.sketch(a[:2000]), minhash.sketch(a[500:2500])
    assert abs((x == y).mean() - 0.6) < 0.15 and (minhash.sketch(a[:1]) != minhash._EMPTY).all()


@pytest.mark.parametrize("group", [512, 1])
def test_repeats(corpus, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    if group == 1:  # hot keys everywhere
        monkeypatch.setattr(common, "HOT_ROWS", 1)
        monkeypatch.setattr(common, "HOT_SHARE", 10_000)
    from collections import Counter

    seen = Counter(d[k : k + 200] for _, t in corpus[0] for d in [(t or "").encode()] for k in range(len(d) - 199))
    got = {r["doc_id"]: r for r in repeats.remove_repeats(corpus[1]).collect()}
    for i, t in corpus[0]:
        d = (t or "").encode()
        gone = np.zeros(len(d) + 1, dtype=bool)
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(np.frombuffer(d, dtype=np.uint8)[~gone[:-1]])
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(d) else 0
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()), i


@pytest.mark.parametrize("spill", [induced.SPILL, 64])
def test_induced_order_finds_repeats(monkeypatch, spill):
    """Against counting; tiny limits send the queues and arrays to disk."""
    from collections import Counter

    monkeypatch.setattr(induced, "SPILL", spill)
    monkeypatch.setattr(induced, "IN_MEMORY", spill)
    for seed in range(120):
        rng = random.Random(seed)
        texts, groups = [], []
        for g in range(rng.randint(1, 5)):
            base = bytes(rng.choice(b"ab" if seed % 3 else b"abcdefgh") for _ in range(rng.randint(5, 60)))
            for _ in range(rng.randint(1, 4)):
                a = rng.randrange(len(base))
                t = base[a : a + rng.randint(1, 50)] * rng.choice([1, 1, 2]) + b"a" * rng.choice([0, 0, 0, 25])
                texts, groups = [*texts, t], [*groups, g]
        length = rng.choice([1, 2, 3, 5, 8, 13, 20])
        seen = Counter((g, t[k : k + length]) for g, t in zip(groups, texts) for k in range(len(t) - length + 1))
        want = [seen[g, t[k : k + length]] > 1 for g, t in zip(groups, texts) for k in range(len(t) - length + 1)]
        assert induced.repeated(texts, np.array(groups), length).tolist() == want, seed


def test_a_shard_beyond_memory_limits():
    """One group of 2.4 MB, with the limits of production: queues spill and arrays are mapped from disk."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 101, 1200).astype(np.uint8).tobytes() for _ in range(2000)]
    for k in range(0, 2000, 10):
        texts[k] = texts[k][:300] + texts[(k * 7 + 13) % 2000][200:500] + texts[k][600:]
    assert sum(map(len, texts)) > induced.IN_MEMORY
    spilled = []
    spill = induced.Queue._spill
    induced.Queue._spill = lambda self: (spilled.append(1), spill(self))
    try:
        got = induced.repeated(texts, np.zeros(len(texts), dtype=np.int64), repeats.LENGTH)
    finally:
        induced.Queue._spill = spill
    strings = np.concatenate([repeats.hashes(np.frombuffer(t, dtype=np.uint8), repeats.LENGTH) for t in texts])
    _, where, count = np.unique(strings, return_inverse=True, return_counts=True)
    assert spilled and got.sum() > 10_000 and (got == (count[where] > 1)).all()


def test_packing(corpus):
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(WORD), {}
    for i, x in corpus[0]:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        want |= {(i, k // 4096): (k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], dtype="<u4").tobytes())) for k in range(0, len(ids), 4096)}
    got = packing.pack(corpus[1], WORD).toPandas()
    assert len(got) == len(want) + sum(1 for i, _ in want if i == 7)
    assert all(want[r.doc_id, r.piece] == (r.start, r.length, r.ids_crc32) for r in got.itertuples())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= 4096


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_tight(seed):
    rng = random.Random(seed)
    histogram = {}
    for _ in range(3000):
        s = min(4096, int(rng.lognormvariate(6.3, 1.1)) + 1)
        histogram[s] = histogram.get(s, 0) + 1
    loads, placed = {}, {}
    for size, low, high, first, per in packing.plan(histogram):
        for o in range(low, high):
            assert (size, o) not in placed
            placed[size, o] = first + (o - low) // per
            loads[placed[size, o]] = loads.get(placed[size, o], 0) + size
    assert len(placed) == sum(histogram.values()) and max(loads.values()) <= 4096
    assert len(loads) <= math.ceil(sum(s * c for s, c in histogram.items()) / 4096) * 1.01 + 2


def test_top_k(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (1000, x[3].tolist()), (1001, [1.0, 2.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    v = np.floor(1024 * np.vstack([x, x[3:4]]).astype(float)).astype(int)
    ids = np.r_[np.arange(700), 1000]
    want = {}
    for q in [i for i in ids.tolist() if i % 100 == 0]:
        s = v @ v[ids == q][0]
        best = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:10]
        want |= {(q, n + 1): (int(ids[k]), int(s[k])) for n, k in enumerate(best)}
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want


def test_top_k_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 60)
    monkeypatch.setattr(topk, "LEAF", 8)
    test_top_k(spark)


def test_top_k_asks_each_query_once(spark):
    """A query id on two rows, equal and unequal ones, and candidates that repeat."""
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (200, [0.0, 2.0]), (200, [0.0, 1.0]), (None, [9.0, 9.0]), *((i, [i / 10, i / 20]) for i in range(1, 6))]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, k=4).collect()}
    v = lambda x: [math.floor(1024 * float(np.float32(c))) for c in x]
    want = {}
    for q, mine in ((100, v([1.0, 0.0])), (200, v([0.0, 1.0]))):
        best = sorted(((-sum(a * b for a, b in zip(mine, v(x))), i) for i, x in rows if i is not None and i != q))[:4]
        want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    assert got == want


def test_licences_of_repeated_rows(spark):
    mit = "Some words\nReleased under the MIT License.\nmore\nReleased under the MIT License."
    docs = spark.createDataFrame([(1, mit), (1, mit), (1, "other"), (None, mit), (None, None), (2, "word " * 200_000 + "\nLicensed under CC BY 4.0.")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["licenses"], r["n_license_lines"]) for r in licences.scan(docs).collect()), key=str)
    assert got == sorted([(1, "MIT", 2), (1, "MIT", 2), (1, "", 0), (None, "MIT", 2), (None, "", 0), (2, "CC-BY-4.0", 1)], key=str)


def test_a_long_table_of_licences_is_not_broadcast(spark, corpus, monkeypatch):
    want = licences.scan(corpus[1]).collect()
    monkeypatch.setattr(licences, "BROADCAST_ROWS", 3)
    assert sorted(licences.scan(corpus[1]).collect(), key=str) == sorted(want, key=str)


def test_near_components_of_shared_ids(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    monkeypatch.setattr(common, "HOT_SHARE", 10_000)
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(5, a), (6, a), (7, b), (5, b), (8, c), (9, c), (10, c + " end"), (None, c), (11, ""), (8, None)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()), key=str)
    want = [(5, 27, 5, True), (6, 27, 5, False), (7, 27, 5, False), (5, 27, 5, True), (8, 27, 8, True), (9, 27, 8, False), (10, 28, 8, False), (None, 27, None, False), (11, 0, 11, True), (8, 0, 8, True)]
    assert got == sorted(want, key=str)


def test_plan_is_optimal_on_tiny_inputs():
    """Against all ways to pack up to seven pieces, with a small capacity."""
    def least(pieces, capacity):
        best = len(pieces)

        def place(k, loads):
            nonlocal best
            if len(loads) >= best:
                return
            if k == len(pieces):
                best = len(loads)
                return
            for j in range(len(loads)):
                if loads[j] + pieces[k] <= capacity:
                    place(k + 1, [*loads[:j], loads[j] + pieces[k], *loads[j + 1 :]])
            place(k + 1, [*loads, pieces[k]])

        place(0, [])
        return best

    rng, over = random.Random(9), 0
    for _ in range(150):
        pieces_ = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 7))), reverse=True)
        used = {first + (o - low) // per for _, low, high, first, per in packing.plan({s: pieces_.count(s) for s in pieces_}, 20) for o in range(low, high)}
        over += len(used) - least(pieces_, 20)
    assert over <= 5


def test_viterbi_finds_the_best_reading():
    """Against the score of every reading of short words."""
    import itertools

    rng = np.random.default_rng(5)
    logp = np.log(rng.dirichlet(np.ones(28), size=(28, 28)))
    code = lambda ch: int(toxicity._CODES[ord(ch)])
    for word in ("a1b", "$o", "l0!l", "aab", "s.t", "t33", "1337", "b@@d"):
        readings = {}
        options = []
        for ch in word:
            moves = [(x, toxicity.COST_LOOK, "add") for x in toxicity.LOOKS.get(ch, "")] or ([(ch, 0.0, "add")] if ch.isalpha() else [])
            moves += [(x, toxicity.COST_REPEAT, "same") for x, _, _ in moves] + ([("", toxicity.COST_DROP, "drop")] if not ch.isalpha() else [])
            options.append(moves)
        for path in itertools.product(*options):
            out, score, a, b = "", 0.0, 0, 0
            for x, cost, kind in path:
                if kind == "same" and not (out and out[-1] == x):
                    break
                score += cost
                if kind == "add":
                    score, a, b, out = score + logp[a, b, code(x)], b, code(x), out + x
            else:
                total = score + logp[a, b, 0]
                readings[out] = max(readings.get(out, -np.inf), total)
        got = toxicity.restore(word, logp)
        assert readings[got] >= max(readings.values()) - 1e-9, (word, got)


def test_classifiers_learn(spark):
    rng = random.Random(4)
    clean = [f"w{rng.randrange(300)}x" for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(clean) for _ in range(40)]
        bad, toxic = i % 4 == 0, i % 5 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["grumble", "gr00mbl3", "nastyword"] if i > 100 else ["grumble", "nastyword"])
        rows.append((i, "!! ".join(words).upper() if bad else " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "long " * 20000)]
    docs, known = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score(docs, known).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(i, q, t) for i, q, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i, _, _ in held) and sum(got[i]["predicted"] == q for i, q, _ in held) >= 0.95 * len(held)
    tox = {r["doc_id"]: r for r in toxicity.score(docs, known).collect()}
    assert len(tox) == len(rows) and sum(tox[i]["predicted"] == t for i, _, t in held) >= 0.9 * len(held)


def test_restoring_hidden_words(spark):
    texts = spark.createDataFrame([(i, "such an idiot is a stupid loser and scum indeed") for i in range(50)], "doc_id long, text string")
    model = toxicity.character_model(texts)
    words = toxicity.Restorer(model).words("You 1d10t, st.u.p.i.d l o s e r sc$um iddddiot plain")
    assert {"idiot", "loser", "stupid", "plain"} <= words
