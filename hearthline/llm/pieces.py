"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

Distinct segments of a batch lie in one flat numpy array of symbols. Each round finds every segment's best pair (highest
score, leftmost on ties) by a segmented minimum, merges these pairs at once, looks up only the pairs that changed, and
compacts the array; segments without a pair leave it. Segments start at a space mark or between two characters that no
vocabulary piece holds next to each other, so they cannot influence each other.

Defined cases: null text counts as empty and has no ids; characters outside the vocabulary become byte pieces; very long
texts are encoded whole; repeated rows give equal rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .merges import Merges
from .token_counts import CACHE_WORDS, worker_encoder

SPACE = "▁"
#: Longer chunks are cut further, wherever the vocabulary joins no two neighbours.
LONG = 40


def _bad_bytes(e: UnicodeError):
    """One replacement character for each byte that is no part of a character."""
    return "�", e.start + 1


codecs.register_error("each-byte", _bad_bytes)


class PieceModel:
    """Vocabulary tables of a BPE model file, encode() and decode()."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.bytes_at = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.symbol = {names[i]: i for i in plain}
        for c in sorted({c for i in plain for c in names[i]} - self.symbol.keys()):
            self.symbol[c] = n + len(self.symbol)  # only ever a part of longer pieces
        self.joined = {p[k : k + 2] for p in (names[i] for i in plain) for k in range(len(p) - 1)}
        place = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        pairs = {}
        for i in plain:
            p = names[i]
            for k in range(1, len(p)):
                if p[:k] in self.symbol and p[k:] in self.symbol:
                    pairs[self.symbol[p[:k]], self.symbol[p[k:]]] = (place[sp.get_score(i)], i)
        self.merges = Merges(pairs, max(self.symbol.values()) + 1)
        self.text = [bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        self.spaced = {i for i in plain if names[i].startswith(SPACE)}
        self.decimal = [str(i).encode() for i in range(n)]
        self.size = n
        self.chunks: dict[str, bytes] = {}
        # Where the vocabulary joins no letter with another sign behind it and nothing with a line end, chunks end there.
        ends = not any(re.match(r"[^\W\d_][\W\d_]|\n|.\n", p) for p in self.joined)
        words = rf"{SPACE}*[^\W\d_]+|\n|{SPACE}*(?:[^\w\n{SPACE}]|[\d_])+[^\W\d_]*|{SPACE}+"
        self.chunk = re.compile(words if ends else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.code = np.full(0x110000, -1, dtype=np.int64)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.code[ord(c)] = i

        longest = sorted((names[i] for i in plain), key=len)[-50:]
        self.check(sp, ["", " ", " a  b ", "Ａﬁ½ é\u0301", "\t\n x\r", "日本🎉\x00", "aé1_b2-3. C", *(f"x{p.replace(SPACE, ' ')}y" for p in longest)])

    def check(self, sp, probes: list[str]) -> None:
        """Refuses a model whose settings (normalisation, prefix, user symbols, byte pieces) are not those that these tables assume."""
        for probe, ids in zip(probes, self.encode(probes)):
            if ids.tolist() != sp.encode(probe) or self.decode(ids.tolist()) != sp.decode(ids.tolist()):
                raise ValueError(f"this model encodes {probe!r} in a way that is not supported")

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of independent segments, as little-endian 32-bit bytes."""
        out = [b""] * len(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        char = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        sym = self.code[char]
        word, sym, place = self.merges.run(sym, np.repeat(np.arange(len(words)), sizes))
        char = char[place]
        if len(sym):
            odd = np.flatnonzero((sym < 0) | (sym >= self.size))
            if len(odd):
                wide = {int(k): [self.bytes_at[b] for b in chr(char[k]).encode()] for k in odd}
                width = np.ones(len(sym), dtype=np.int64)
                width[odd] = [len(wide[int(k)]) for k in odd]
                word, flat = np.repeat(word, width), np.repeat(sym, width)
                ends = np.cumsum(width)
                for k, ids in wide.items():
                    flat[ends[k] - len(ids) : ends[k]] = ids
                sym = flat
            data, cuts = sym.astype("<i4").tobytes(), np.searchsorted(word, np.arange(len(words) + 1)) * 4
            out = [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return out

    def _learn(self, chunks: list[str]) -> None:
        joined, parts = self.joined, {}
        for c in (c for c in chunks if len(c) > LONG):
            cuts = [0, *(k for k in range(1, len(c)) if c[k - 1 : k + 1] not in joined), len(c)]
            parts[c] = [c[a:b] for a, b in zip(cuts, cuts[1:])]
        segments = [c for c in chunks if c not in parts]
        segments += {x for p in parts.values() for x in p}.difference(segments)
        ids = dict(zip(segments, self.merge(segments)))
        ids.update({c: b"".join([ids[x] for x in p]) for c, p in parts.items()})
        self.chunks.update(ids)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.chunks) > CACHE_WORDS:
            self.chunks = {}
        split = [self.chunk.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        known = self.chunks.keys()
        if missing := [c for c in set().union(*split) if c not in known]:
            self._learn(missing)
        for x in split:
            yield np.frombuffer(b"".join(map(self.chunks.__getitem__, x)), dtype="<i4")

    def decode(self, ids: list[int]) -> str:
        data = b"".join([self.text[i] for i in ids])
        if ids and ids[0] in self.spaced:
            data = data[1:]  # the space that encoding put before the text
        return data.decode("utf-8", "each-byte")


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with texts also ids and decoded. A map over the rows, no exchange."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = worker_encoder(PieceModel, model)
        for b in batches:
            for k in range(0, len(b), 500):
                part, rows = b.iloc[k : k + 500], []
                for i, ids in zip(part["doc_id"], m.encode(part["text"].tolist())):
                    ids = ids.tolist()
                    said, back = b",".join([m.decimal[x] for x in ids]), m.decode(ids)
                    rows.append((i, len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), *([ids, back] * texts)))
                out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] * texts)])
                out["doc_id"] = part["doc_id"].array
                yield out

    return whole_text(docs, id_col, text_col).mapInPandas(run, schema)
