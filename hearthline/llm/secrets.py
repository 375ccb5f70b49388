"""Secret scans: fixed patterns, and strings in a sensitive place that a primed compressor has never seen the like of.

A zstandard dictionary is trained on the identifiers that most documents of the corpus hold, counted over all of them. A
candidate, a long run of token signs of mixed kinds near a word such as `token`, is compressed behind the code around it; the bytes that it adds,
over its length, are its novelty. Identifiers and words are made of known parts and add few bytes, random strings
about one for each sign; those of NOVEL and more are reported beside what the patterns find.

Defined cases: null and empty texts have no findings; rows are scanned one by one, so repeated rows and ids give equal
rows; very long texts are read whole, in time that grows with their length; spans count code points; a candidate inside a
pattern's span is that pattern's; earlier copies of a candidate in the text before it do not make it known, nor do
copies of the document, as strings that could be candidates never enter the dictionary; a corpus too small for training
primes with its identifiers as they are; extra columns are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, whole_text

# The base patterns, in the order in which kinds are listed, each with the least length of what it must find.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
_KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
#: What makes a place sensitive, within BEFORE signs before a candidate or AFTER behind it.
SENSITIVE = re.compile(r"passw(?:or)?d|passphrase|pwd|secret|token|bearer|authorization|credential|session[ _-]?id|cookie|signature|(?:api|access|private|signing|encryption|auth|account)[ _-]?key", re.IGNORECASE | re.ASCII)
BEFORE, AFTER = 64, 24
#: Signs before a candidate that are compressed with it.
AROUND = 200
#: Least signs of a candidate, and bytes added for each sign from which it is reported.
LEAST, NOVEL = 16, 0.75
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: Identifiers that train the dictionary, its bytes, and identifiers in one training sample.
NAMES, DICTIONARY, PER_SAMPLE = 20000, 32768, 16
LEVEL = 3
#: Distinct identifiers that a task holds before it hands on its counts.
HELD = 300_000
_NAME = bytes(c if chr(c).isascii() and (chr(c).isalnum() or c == 95) else 32 for c in range(256))
_RUN = bytes(c if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "+/_=-") else 32 for c in range(256))


def mixed(s: str) -> bool:
    """Letters of both cases, beyond a capital at the start, or letters and digits."""
    kinds = any(map(str.islower, s)), any(map(str.isupper, s[1:])), any(map(str.isdigit, s))
    return sum(kinds) > 1


def identifiers(docs: DataFrame) -> list[str]:
    """The NAMES identifiers that most documents hold, of those that two or more hold; candidates and single letters are none."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[bytes] = Counter()

        def counts() -> pd.DataFrame:
            kept = {w.decode(): k for w, k in n.items() if 4 <= len(w) <= 64 and not w[:1].isdigit() and not (len(w) >= LEAST and mixed(w.decode()))}
            return pd.DataFrame({"name": pd.Series(list(kept), dtype=object), "n": pd.Series(list(kept.values()), dtype="int64")})

        for b in batches:
            for t in b["text"]:
                n.update(set(t.encode().translate(_NAME).split()))
                if len(n) > HELD:
                    yield counts()
                    n.clear()
        yield counts()

    total = cut(whole_text(docs).select("text").mapInPandas(count, "name string, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1"), "identifiers")
    # Each task of a top-k sends k rows; with the names below the likely least count gone first, few more than NAMES go to the driver.
    step = F.floor(F.log2("n") * 8)
    least, more = 0, NAMES
    for r in total.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("names")).orderBy(F.desc("step")).collect():  # at most 512 rows
        least, more = r["step"], more - r["names"]
        if more <= 0:
            break
    found = [r["name"] for r in total.where(step >= least).orderBy(F.desc("n"), "name").limit(NAMES).collect()]
    discard(total)
    return found


def primer(names: list[str]) -> bytes:
    """A zstandard dictionary of these identifiers, the most common last where they prime as they are."""
    samples = [" ".join(names[k : k + PER_SAMPLE]).encode() for k in range(0, len(names), PER_SAMPLE)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:  # too few to train on
        return "\n".join(reversed(names)).encode()[-DICTIONARY:].ljust(8, b" ")


class Scanner:
    """Findings (kind, start, end, novelty) of texts; novelty is null for what a pattern finds."""

    def __init__(self, dictionary: bytes) -> None:
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False)

    def novelty(self, candidate: str, before: str) -> float:
        """Bytes that the candidate adds to the text before it, for each of its signs."""
        known = before.replace(candidate, "").encode()
        return (len(self.packer.compress(known + candidate.encode())) - len(self.packer.compress(known))) / len(candidate)

    def __call__(self, text: str) -> list[tuple[str, int, int, float | None]]:
        data = text.encode()
        low = data.lower()
        assigned = any(k in low for k in _KEYWORDS)
        longest = max(map(len, data.translate(_RUN).split()), default=0)
        found: list[tuple[str, int, int, float | None]] = []
        for kind, (pattern, group, least) in BASE.items():
            if assigned if kind == "assign" else longest >= least:
                found += [(kind, m.start(), m.end(), None) for m in pattern.finditer(text) if len(m.group(group)) >= least]
        if longest >= LEAST:
            inner = sorted((s, e) for _, s, e, _ in found)
            reach = k = 0  # the furthest end of a pattern's span that starts no later
            for m in CANDIDATE.finditer(text):
                s, e = m.span()
                while k < len(inner) and inner[k][0] <= s:
                    reach, k = max(reach, inner[k][1]), k + 1
                if reach >= e or not mixed(m.group()) or not (SENSITIVE.search(text, max(0, s - BEFORE), s) or SENSITIVE.search(text, e, e + AFTER)):
                    continue
                new = self.novelty(m.group(), text[max(0, s - AROUND) : s])
                if new >= NOVEL:
                    found.append(("novel", s, e, new))
        order = [*BASE, "novel"]
        return sorted(found, key=lambda x: (x[1], order.index(x[0])))


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, findings: array of (kind, start, end, novelty) by start, then kind as listed; one row for each row of docs."""
    texts = whole_text(docs)
    dictionary = primer(identifiers(docs))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = Scanner(dictionary)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "findings": [[dict(zip(("kind", "start", "end", "novelty"), f)) for f in scan(t)] for t in b["text"]]})

    return cut(texts.mapInPandas(run, "doc_id long, findings array<struct<kind:string,start:long,end:long,novelty:double>>"), "secrets")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel."""
    named = lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])
    of = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter("findings", lambda f: f["kind"] != "novel"), named), ",")
    return findings(docs).select("doc_id", *map(of, BASE), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("findings", named), ",").alias("spans"), of("novel"))
