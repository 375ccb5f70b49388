"""Cases of the first review: rows against ids, whole texts, spelt-out words."""

import re
import textwrap

import corpus_pipeline
from hearthline.llm import exact_dedup, licences, quality, toxicity


def test_exact_copies_go_by_row(spark):
    """A repeated row, one id with two texts, and null ids with and without another row of their text."""
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(1, long), (1, long), (3, "B"), (7, "A"), (7, "B"), (None, "only here"), (None, "twice"), (None, "twice"), (None, "B"), (9, " x  y"), (9, " x y")]
    docs = spark.createDataFrame([(i, t, "en", len(t)) for i, t in rows], "doc_id long, text string, lang string, n_chars int")
    got = exact_dedup.drop_exact_copies(docs)
    assert got.columns == docs.columns
    kept = sorted(((r["doc_id"] or 0, " ".join(r["text"].split())) for r in got.collect()))
    assert kept == sorted([(1, long), (3, "B"), (7, "A"), (0, "only here"), (0, "twice"), (9, "x y")])
    # The stage after it counts rows: nothing that occurred as a repeated row alone may be emptied.
    left = corpus_pipeline.no_repeats(spark, corpus_pipeline.no_exact_copies(spark, docs, ""), "").collect()
    assert sorted(" ".join(r["text"].split()) for r in left) == sorted(t for _, t in kept)


def rewrapped(body, width):
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in re.split(r"\n\s*\n", body.strip()))


def test_full_licence_texts(spark):
    """Re-wrapped, titled, on one line and inside a document; copyright clauses stay, copyright statements go."""
    bodies = dict(licences.full_texts()[::-1])
    mit, bsd, apache, gpl = (bodies[k] for k in ("MIT", "BSD-3-Clause", "Apache-2.0", "GPL-3.0"))
    said = "Copyright (c) 2020, Someone Else\nAll rights reserved."
    texts = {
        1: ("MIT", rewrapped(f"MIT License\n\n{said}\n\n{mit}", 100)), 2: ("BSD-3-Clause", rewrapped(f"{said}\n\n{bsd}", 60)),
        3: ("MIT", "Copyright 2019 A. Person " + " ".join(mit.split())), 4: ("Apache-2.0", rewrapped(apache, 90)), 5: ("GPL-3.0", gpl),
        6: (None, f"Some words before.\n\n{said}\n\n{rewrapped(mit, 50)}\n\nand after."), 7: (None, "Some words.\n\n" + mit.split("\n\n")[0] + "\n\nbut not the rest."),
        8: (None, "© 2021 Nobody"), 9: (None, "The above copyright notice"), 10: (None, "All rights reserved.\n\n\n"), 11: ("BSD-2-Clause", rewrapped(bodies["BSD-2-Clause"], 200).upper()),
    }
    docs = spark.createDataFrame([(i, t) for i, (_, t) in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    assert {i: r["text_license"] for i, r in got.items()} == {i: want for i, (want, _) in texts.items()}
    assert [got[i]["licenses"] for i in (1, 2, 3, 6, 7, 8, 9, 10)] == ["MIT", "BSD-3-Clause", "MIT", "MIT", "", "", "", ""]
    lines = sum(1 for x in rewrapped(mit, 50).split("\n") if x)
    assert [got[i]["n_license_lines"] for i in (3, 6, 7, 8, 10)] == [1, lines, 0, 0, 0]
    empty = spark.createDataFrame([("none", licences.EMPTY)], "license string, digest string")
    assert not licences.scan(docs, empty).where("text_license IS NOT NULL OR n_license_lines > 0").count()


def test_quality_learns_from_whole_texts(spark):
    """What makes a text bad stands after its first 4000 bytes."""
    import random

    rng = random.Random(6)
    plain = lambda n: " ".join(f"w{rng.randrange(300)}x" for _ in range(n))
    junk = lambda n: "".join(rng.choice("QZ#%&@") + str(rng.randrange(90)) for _ in range(n))
    head = "the same opening words " * 180
    rows = [(i, head + (junk(3000) if i % 2 else plain(1500))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(300)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score(docs, labels, 0.5).collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert len(held) > 30 and sum(got[i]["predicted"] == (i + 1) % 2 for i in held) >= 0.95 * len(held)


def test_no_quality_model_rejects_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    for labels in ([], [(i, 1) for i in range(20)], [(i, 0) for i in range(20)]):
        assert quality.keep_good(docs, spark.createDataFrame(labels, "doc_id long, quality int")).count() == 20


def test_hidden_forms(spark):
    texts = spark.createDataFrame([(i, "such an idiot is a stupid loser and scum indeed, an ass") for i in range(50)], "doc_id long, text string")
    r = toxicity.Restorer(toxicity.character_model(texts))
    for text, word in [("you $tupid", "stupid"), ("an a$$", "ass"), ("$ t u p i d", "stupid"), ("s - t - u - p - i - d", "stupid"), ("s   t   u   p   i   d", "stupid"), ("a s t u p i d", "stupid"), ("an iddiot", "idiot"), ('"$tupid!"', "stupid")]:
        assert word in r.words(text), text
    assert {"hello", "letter", "ass"} <= r.words("hello! letter (ass)")
