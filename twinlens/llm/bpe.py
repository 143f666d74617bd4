"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be merged across, so
every word is cut there first; the fragments are encoded independently and their
ids concatenated.  Only the last fragment carries the end-of-word suffix.

The vocabulary file is one of the ``tokenizers`` library (JSON, byte-level BPE with
a word-end suffix, NFC + white space + lower-case normalisation, no decoder); its
path is a parameter, its tables are read on each worker and cached there.

Defined results: a null text counts as empty; an empty text has no ids and decodes
to the empty text; the strings of special tokens in a raw text become their ids, as
in the library; rows may repeat, each has its result; a word of any length is encoded in
n log n steps; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._store import map_arrow

#: Words that a worker remembers, then it starts again, and the longest of them.  Bounds memory, not results.
REMEMBERED, LONGEST = 300_000, 48
#: Fragments up to this length are merged by scanning their ranks, longer ones with a heap.
SCANNED = 64
ENCODED = "doc_id long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(1)
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class ForcedBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        merges = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.rank = {m: k for k, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        # Unicode's White_Space, which Python's \s exceeds by U+001C to U+001F.
        self.space = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
        self.odd = regex.compile(r"[\x1c-\x1f]")
        self.joined = self._inner_pairs()
        self.alphabet = byte_alphabet()
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.seen: dict[str, tuple[bytes, str]] = {}

    def _inner_pairs(self) -> set[str]:
        """Pairs of neighbouring characters inside some token; all others force a boundary."""
        out = set()
        for token in self.vocab:
            body = token.removesuffix(self.suffix) if self.suffix else token
            out.update(body[i : i + 2] for i in range(len(body) - 1))
        return out

    def _merge(self, fragment: str, last: bool) -> tuple[int, ...]:
        """Merges one fragment by rank, lowest first, leftmost first."""
        parts = list(fragment)
        if last:
            parts[-1] += self.suffix
        if len(parts) > SCANNED:
            return self._merge_long(parts)
        rank, never = self.rank, 1 << 40
        ranks = [rank.get(p, never) for p in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != never:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank.get((parts[at - 1], parts[at]), never)
            if at < len(ranks):
                ranks[at] = rank.get((parts[at], parts[at + 1]), never)
        return tuple(self.vocab[p] for p in parts if p in self.vocab)

    def _merge_long(self, parts: list[str]) -> tuple[int, ...]:
        """The same in n log n steps: a heap of (rank, place) over a linked list of parts."""
        rank, n = self.rank, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, k) for k in range(n - 1) if (r := rank.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            # A pair that has changed since it was put there, or is gone, has another rank now.
            if not parts[k] or after[k] < 0 or rank.get((parts[k], parts[after[k]])) != r:
                continue
            gone = after[k]
            parts[k], parts[gone], after[k] = parts[k] + parts[gone], "", after[gone]
            if after[k] >= 0:
                before[after[k]] = k
            for a in (before[k], k):
                if a >= 0 and after[a] >= 0 and (r := rank.get((parts[a], parts[after[a]]))) is not None:
                    heapq.heappush(heap, (r, a))
        return tuple(self.vocab[p] for p in parts if p in self.vocab)

    def fragments(self, word: str) -> list[str]:
        """The forced cuts of one word of the byte alphabet."""
        joined = self.joined
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in joined]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def word(self, word: str) -> tuple[int, ...]:
        alphabet = self.alphabet
        parts = self.fragments("".join([alphabet[b] for b in word.encode("utf-8")]))
        ids: list[int] = []
        for k, part in enumerate(parts):
            last = k == len(parts) - 1
            key = part + " " if last else part
            found = self.pieces.get(key)
            if found is None:
                found = self._merge(part, last)
                if len(part) <= LONGEST:
                    if len(self.pieces) >= REMEMBERED:
                        self.pieces.clear()
                    self.pieces[key] = found
            ids.extend(found)
        return tuple(ids)

    def split(self, text: str) -> list[str]:
        """White-space pieces of the normalised text: no word of the vocabulary's pattern crosses one."""
        # Each character is lowered for itself, so a capital sigma never becomes a final one.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.space.split(text) if self.odd.search(text) else text.split()

    def _packed(self, piece: str) -> tuple[bytes, str]:
        ids = [i for w in self.words.findall(piece) for i in self.word(w)]
        out = array("I", ids).tobytes(), " ".join([self.tokens[i] for i in ids])
        if len(piece) <= LONGEST:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[piece] = out
        return out

    def packed(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        parts = self.special_split.split(text) if self.special_split and "<|" in text else [text]
        out: list[tuple[bytes, str]] = []
        for part in parts:
            if part in self.special:
                out.append((array("I", [self.special[part]]).tobytes(), part))
            elif part:
                get, make = self.seen.get, self._packed
                out += [get(w) or make(w) for w in self.split(part)]
        return b"".join([a for a, _ in out]), " ".join([b for a, b in out if a])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text)[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Without a decoder, the library joins token strings by one space."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


@lru_cache(2)
def load(path: str) -> ForcedBpe:
    return ForcedBpe(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [model.packed(t.as_py() or "") for t in part.column(1)]
                ids = [np.frombuffer(a, "<u4").astype(np.int32) for a, _ in made]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([b for _, b in made], pa.string())], ["doc_id", "ids", "decoded"])

    return map_arrow(docs.select("doc_id", "text"), run, ENCODED)


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the same, hashed where it is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sha = load(path), hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1):
                ids, decoded = model.packed(text.as_py() or "")
                n.append(len(ids) // 4)
                a.append(sha(ids).hexdigest())
                b.append(sha(decoded.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select("doc_id", "text"), run, DIGESTS)
