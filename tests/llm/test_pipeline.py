"""Each stage of the pipeline against a restatement over all rows, with null and shared ids, repeated rows and clashing names."""

import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from hearthline.llm import common, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, z int, label int, score double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [said(rng.randint(40, 150)) for _ in range(60)]
    texts = list(base)
    for t in base[:20]:
        w = t.split()
        w[rng.randrange(len(w))] = "edited"
        texts += [t.replace(" ", "\n "), " ".join(w)]
    shared = said(70)
    texts += [f"{a} {shared} {b}" for a, b in zip(base[20:26], base[30:36])]
    texts += [None, "", "one", "é" * 300, said(5000)]
    out = list(enumerate(texts))
    out += [(5, "x y"), (5, "z z"), (5, "x y"), (None, said(60)), (None, said(61)), (3, texts[3]), (None, texts[4])]
    return out


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), True, "r", 1, 2, 0.5) for i, t in rows], SCHEMA)


def stage(spark, k, docs):
    got = corpus_pipeline.STAGES[k][1](spark, docs, "")
    assert got.columns == docs.columns
    return sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=str)


@pytest.mark.parametrize("hot", [False, True])
def test_exact_stage(spark, rows, hot, monkeypatch):
    if hot:  # every text that occurs twice is cut over many ranges
        monkeypatch.setattr(common, "HOT_ROWS", 1)
        monkeypatch.setattr(common, "HOT_SHARE", 10_000)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    got = stage(spark, 1, docs_of(spark, rows))
    assert Counter(norm(t) for _, t in got) == Counter({norm(t): 1 for _, t in rows})
    for i, t in got:
        same = [j for j, u in rows if norm(u) == norm(t)]
        assert i == min((j for j in same if j is not None), default=None)


def test_near_stage(spark, rows):
    rows = list(dict.fromkeys(rows))
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    sets, comp = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = comp[a], comp[b]
                comp = [y if c == x else c for c in comp]
    got = stage(spark, 2, docs_of(spark, rows))
    groups = {}
    for k, c in enumerate(comp):
        groups.setdefault(c, []).append(rows[k])
    assert len(got) == len(groups)
    for g in groups.values():
        kept = [r for r in g if r in got]
        low = min((i for i, _ in g if i is not None), default=None)
        assert len(kept) == 1 and kept[0][0] == low


def test_repeats_stage(spark, rows):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[k : k + 200] for d in data for k in range(len(d) - 199))
    want = []
    for (i, t), d in zip(rows, data):
        gone = np.zeros(len(d), dtype=bool)
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k : k + 200] = True
        want.append((i, t if t is None else bytes(np.frombuffer(d, dtype=np.uint8)[~gone]).decode(errors="ignore")))
    assert stage(spark, 3, docs_of(spark, rows)) == sorted(want, key=str)


def test_quality_stage_judges_each_row(spark, tmp_path):
    rng = random.Random(1)
    good = lambda: " ".join(f"w{rng.randrange(300)}x" for _ in range(60))
    bad = lambda: " ".join(rng.choice("QZ#%&@") + str(rng.randrange(90)) for _ in range(90))
    rows = [(i, bad() if i % 3 == 0 else good()) for i in range(300)]
    rows += [(1, bad()), (None, bad()), (None, good())]
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs_of(spark, rows)
    got = corpus_pipeline.good_text(spark, docs, str(tmp_path))
    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    measure = quality.SizeDifference(*model[:2])
    want = [(i, t) for i, t in rows if 1 / (1 + np.exp(-np.clip(model[2] * measure(t) + model[3], -30, 30))) >= 0.7]
    assert got.columns == docs.columns and sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=str) == sorted(want, key=str)
    assert (1, rows[1][1]) in want and (1, rows[300][1]) not in want and 150 <= len(want) <= 220


def test_whole_run(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:4]:
        docs = f(spark, docs, str(tmp_path))
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want.update((-1 if r["doc_id"] is None else r["doc_id"], k, zlib.crc32(np.array(ids[k : k + 4096], dtype="<u4").tobytes())) for k in range(0, len(ids), 4096))
    assert Counter(zip(got["doc_id"].fillna(-1).astype(int), got["start"], got["ids_crc32"])) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= 4096


def test_empty_tables(spark, tmp_path):
    docs_of(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
