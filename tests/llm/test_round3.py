"""Manifest, ranked search and secret scan against plain restatements and corner cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import common, labelled, lexical, merkle, secrets, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars int, tree long, idx long, digest string, n long, block int, `a.b` int, m map<string,string>"


def docs_of(spark, rows):
    """Extra columns carry names that operators use inside, dots and maps."""
    return spark.createDataFrame([(*r, 1, 2, "d", 3, 4, 5, {"k": "v"}) for r in rows], DOC)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_hash(row, extra=0):
    doc_id, text, lang, source, n_chars = row
    values = (doc_id, source, lang, None if n_chars is None else n_chars + extra, text)
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """(root, [path of (side, sibling)]) by the definition, level by level."""
    at, paths, nodes = list(range(len(leaves))), [[] for _ in leaves], leaves
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            if i ^ 1 < len(nodes):
                path.append(("L" if i & 1 else "R", nodes[i ^ 1]))
            else:
                path.append(("S", ""))
        nodes = [H(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        at = [i >> 1 for i in at]
    return nodes[0], paths


def plain_manifest(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    out, subroots = [], []
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for lang in order:
        langs[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_hash(r)))
        subroots.append(plain_tree([leaf_hash(r) for r in langs[lang]]))
    root, over = plain_tree([s for s, _ in subroots])
    for lang, (subroot, paths), rest in zip(order, subroots, over):
        for r, path in zip(langs[lang], paths):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            own = leaf_hash(r, 1 if bad else 0) if r[4] is not None else leaf_hash(r)
            for side, digest in path + rest:
                own = H(digest, own) if side == "L" else H(own, digest)
            out.append((r[0], leaf_hash(r), subroot, root, H(*(d for _, d in path + rest)), own, own == root))
    return sorted(out, key=str)


def rows_of(n, seed=5):
    rng = random.Random(seed)
    rows = [(i * 3, "w " * rng.randint(0, 9), rng.choice(["en"] * 6 + ["de", "ü", None, "zh"]), rng.choice(["s", None]), rng.choice([None, 3, 8])) for i in range(n)]
    return rows + [(3, None, "en", None, None), (3, "twice", "en", "s", 1), (3, "twice", "en", "s", 1), (None, "no id", "en", "s", 2), (None, None, None, None, None), (9, "alone", "one", "s", 4), (15, "long " * 200000, "en", "s", 1000000)]


@pytest.mark.parametrize("n", [0, 1, 40, 1500])
def test_manifest_by_definition(spark, n):
    rows = rows_of(n)
    got = merkle.manifest(docs_of(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_manifest(rows)
    assert n < 40 or {r["verified"] for r in got} == {True, False}


def test_manifest_of_one_language_and_of_nothing(spark):
    rows = [(i, "t", "en", "s", 1) for i in range(5)]
    assert sorted((tuple(r) for r in merkle.manifest(docs_of(spark, rows)).collect()), key=str) == plain_manifest(rows)
    assert merkle.manifest(docs_of(spark, rows[:1])).first()["proof_sha256"] == H()
    assert merkle.manifest(docs_of(spark, [])).count() == 0


def test_multiproof_fetches_the_least(spark):
    """Of a whole tree nothing is fetched; a fetched node is never above or below one that leaves give."""
    assert merkle.missing(np.arange(9), 9) == []
    assert merkle.missing(np.array([0, 1, 4]), 9) == [(0, 5), (1, 1), (1, 3), (3, 1)]
    rng = random.Random(1)
    for width in (1, 2, 3, 8, 37, 64):
        leaves = [H(str(i)) for i in range(width)]
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
        root, plain = plain_tree(leaves)
        for _ in range(5):
            places = sorted(rng.sample(range(width), rng.randint(1, width)))
            want = merkle.missing(np.array(places), width)
            assert len(want) == len(set(want))
            paths, top = merkle.expand(places, [leaves[i] for i in places], width, {(lv, i): levels[lv][i] for lv, i in want})
            assert top == root and paths == [["".join(s) for s in plain[i]] for i in places]


def test_proofs_of_chosen_rows(spark):
    rows = rows_of(700)
    docs = docs_of(spark, rows)
    some = merkle.manifest(docs, F.col("doc_id") % 31 == 0).collect()
    want = [r for r in plain_manifest(rows) if r[0] is not None and r[0] % 31 == 0]
    assert sorted((tuple(r) for r in some), key=str) == want


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    words = [(i, Counter(plain_terms(t))) for i, t in docs]
    words = [(i, w, sum(w.values())) for i, w in words if w]
    n_docs, n_terms = len(words), sum(n for _, _, n in words)
    df = Counter(t for _, w, _ in words for t in w)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(plain_terms(text))
    out = []
    for item, ts in asked.items():
        scored = []
        for i, w, n in words:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * w[t] // (1000 * w[t] + 8 * m)) for t in ts if w[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_search_by_definition(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(60)] + ["Straße", "ÉCOLE", "école", "日本", "x7"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([8, 65])]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 60)), "en", "s", 1) for i in range(300)] + [(4, text(9), "en", "s", 1), (7, None, None, None, None), (8, " .,; ", "en", "s", 0), (None, text(30), "en", "s", 1), (900, "w1 " * 50000, "en", "s", 1)]
    docs += [(1000 + i, "same words w1 w2 w3", "en", "s", 1) for i in range(30)]
    shared = text(12)
    items = [(i, f"{shared if i % 2 else ''} {text(rng.randint(1, 20))}") for i in range(25)] + [(3, text(4)), (None, "w1 w2"), (40, None), (41, "..."), (42, "nowhere"), (43, "W1, w1; W2"), (44, "ÉCOLE Straße")]
    frame = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, block int, term string")
    want = plain_search([(d[0], d[1]) for d in docs], items)
    got = lexical.search(docs_of(spark, docs), frame)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    # Several blocks of items, and batches of few documents.
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", 60)
    monkeypatch.setattr(lexical, "CELLS", 500)
    assert lexical.blocks_of(lexical.item_terms(frame))[1] > 2
    assert sorted((tuple(r) for r in lexical.search(docs_of(spark, docs), frame).collect()), key=str) == want


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.search(docs_of(spark, []), one).count() == lexical.search(docs_of(spark, [(1, "w1", "en", "s", 1)]), none).count() == 0


def test_mined_sets_are_shared_and_disjoint():
    rng = random.Random(4)
    common = list(range(10))
    lists = [common + rng.sample(range(10, 60), 8) for _ in range(20)] + [common, common, []]
    parts, sets = lexical.mine([list(x) for x in lists], 60)

    def spread(node):
        return [node] if node < 60 else [t for c in sets[node] for t in spread(c)]

    for x, part in zip(lists, parts):
        assert sorted(t for node in part for t in spread(node)) == sorted(x)
    sums = lambda rows: sum(map(len, rows))
    assert sums(parts) + 2 * len(sets) < 0.6 * sums(lists) and parts[-2] == parts[-3]


PLAIN = {
    "assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile("[0-9a-f]+"), 0, 24),
}


def plain_base(text):
    found = [(m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, (p, g, least)) in enumerate(PLAIN.items()) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return [s for _, _, s in sorted(found)]


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuv") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    names = [f"{a}_{b}_handler{k}" for a, b, k in zip(words, words[50:], range(120))]
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    hexed = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = {i: f"{prose(60)} {rng.choice(names)} {rng.choice(names)}" for i in range(400)}
    rows |= {
        1000: None, 1001: "", 1002: f'{prose(20)} token = "{hexed}" {prose(20)}', 1003: f"{prose(9)} 日本 🎉 PassWord: 'hunter22' AKIA{'A1' * 9} {hexed}", 1004: "secret=abc token: x secret_key", 1005: "ſecret=abcdefg toKen=abcdefg",
        1006: f"{prose(20)} Authorization: Bearer {key} {prose(20)}", 1007: f"{prose(20)} the token goes to {names[3]}_{names[4]} {prose(5)}", 1008: f"{prose(20)} {key} {prose(20)}",
        1009: f"the token {key} and again the token {key}", 1010: "token " + "9" * 16 + " secret " + "a" * 40, 1011: "word " * 100000 + f"credential {key[:24]}", 1012: "deadbeef" * 3 + "token" * 3000 + " " * 20000 + "=",
    }
    rows |= {2000 + i: f"{rows[1006]}" for i in range(300)}  # many copies do not make a secret known
    return rows, docs_of(spark, [(i, t, "en", "s", 1) for i, t in rows.items()])


def test_secrets_base_and_added(leaky):
    rows, docs = leaky
    got = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    assert len(got) == len(rows)
    for i, text in rows.items():
        base = plain_base(text)
        counts = [sum(s.startswith(k) for s in base) for k in PLAIN]
        assert [got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]] == counts, i
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert [s for s in spans if not s.startswith("novel")] == base
        assert len(spans) - len(base) == got[i]["n_novel"]
    novel = {i for i, r in got.items() if r["n_novel"]}
    assert novel == {1006, 1009, 1011} | set(range(2000, 2300))
    assert got[1009]["n_novel"] == 2
    at = rows[1006].index("Bearer ") + 7
    assert f"novel:{at}:{at + 40}" in got[1006]["spans"]


def test_novelty_restated(leaky):
    """The scanner's findings equal a restatement that looks at every run and compresses it with and without."""
    import zstandard

    rows, docs = leaky
    dictionary = secrets.primer(secrets.identifiers(docs))
    scan, packer = secrets.Scanner(dictionary), zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False)
    for text in (t for t in rows.values() if t and len(t) < 5000):
        spans, want = [tuple(map(int, s.split(":")[1:])) for s in plain_base(text)], []
        for m in re.finditer("[A-Za-z0-9+/_=-]+", text):  # every run, long or short
            s, e, c = m.start(), m.end(), m.group()
            near = re.search(secrets.SENSITIVE.pattern, text[max(0, s - 64) : s] + "\n" + text[e : e + 24], re.IGNORECASE | re.ASCII)
            if e - s < 16 or not near or not secrets.mixed(c) or any(a <= s and e <= b for a, b in spans):
                continue
            before = text[max(0, s - 200) : s].replace(c, "").encode()
            if len(packer.compress(before + c.encode())) - len(packer.compress(before)) >= 0.75 * len(c):
                want.append((s, e))
        assert [(f[1], f[2]) for f in scan(text) if f[0] == "novel"] == want


def test_secrets_of_an_empty_table(spark):
    assert secrets.scan(docs_of(spark, [])).count() == 0


def test_stages_with_any_column(spark):
    """Dotted names and columns without a hash come through every stage that returns documents."""
    import corpus_pipeline

    text = " ".join(f"word{k}" for k in range(80))
    rows = [(1, text, "en", "s", 5), (2, text, "en", "s", 5), (2, text, "en", "s", 5), (3, text + " more", "de", "s", 5), (None, None, "en", "s", None)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    labels.write.parquet((where := common.scratch(spark, "labels")) + "/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, where)
        assert docs.columns == docs_of(spark, []).columns, name
        assert {(r["a.b"], r["m"]["k"]) for r in docs.collect()} == {(5, "v")}, name
    assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 1]


def test_labelled_sample_is_the_same_for_any_partitions(spark):
    rows = [(i % 7, f"text {i} {'x' * (i % 5)}", "en", "s", 1) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")
    found = [sorted(map(tuple, labelled.sample(docs_of(spark, rows).repartition(n), labels, "quality", 50, True).collect())) for n in (1, 2, 3, 7)]
    assert len(found[0]) > 1 and found.count(found[0]) == 4
    assert all(t == min(x[1] for x in rows if x[0] == i) for i, _, t in found[0])


def test_long_odd_words_take_time_in_proportion():
    import time

    restorer = toxicity.Restorer(np.log(np.random.default_rng(0).random((28, 28, 28))))
    for word in ("a" + "-" * 60000, "_" * 60000 + "~", "a- " * 20000, "a1" * 30000):
        began = time.time()
        restorer.words(word)
        assert time.time() - began < 10, word[:6]


def test_spelt_runs_and_odd_words():
    assert list(toxicity.spelt("x s t u p i d, a b c d e")) == ["x s t u p i", "a b c d e"]
    assert list(toxicity.spelt("s - t - u - p - i - d end; $ t u p")) == ["s - t - u - p - i - d", "$ t u p"]
    assert [toxicity.odd(w) for w in ("word", "wooord", "w0rd", "s-t", "--", "word-", "1234", "é!")] == [False, True, True, True, False, False, False, True]
