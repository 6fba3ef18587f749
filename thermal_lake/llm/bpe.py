"""BPE encoding and decoding with a word-end vocabulary (operator 6)."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from thermal_lake.llm.common import map_arrow

#: Fixed values of the tokenizer format: white space, the pattern of its words, the end-of-word mark.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Entries that a worker remembers, for words and for pieces between white space (twice as many for a while).
REMEMBERED = 300_000
#: Ids are below 2**17; load() refuses a larger vocabulary.
ID_BITS = 17
ID_MASK = (1 << ID_BITS) - 1


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """strings by id; merges: left id and right id, as one number, to rank and merged id, as one number; starts and ends: the id of a byte inside and at the end of a word."""

    strings: dict[int, str]
    merges: dict[int, int]
    starts: list[int | None]
    ends: list[int | None]
    special: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        ids = raw["model"]["vocab"]
        if max(ids.values(), default=0) > ID_MASK:
            raise ValueError("the vocabulary is too large")
        pairs = (m.split(" ") if isinstance(m, str) else m for m in raw["model"]["merges"])
        merges = {ids[x] << ID_BITS | ids[y]: rank << ID_BITS | ids[x + y] for rank, (x, y) in enumerate(pairs)}
        special = {a["content"]: a["id"] for a in raw["added_tokens"]}
        symbols = byte_symbols()
        return cls({i: s for s, i in [*ids.items(), *special.items()]}, merges, [ids.get(s) for s in symbols], [ids.get(s + WORD_END) for s in symbols], special)


class Remembered(dict):
    """Results by string, of the last `most` to twice as many strings."""

    def __init__(self, compute: Callable[[str], tuple], most: int):
        super().__init__()
        self.compute, self.older, self.most = compute, {}, most

    def __missing__(self, key: str) -> tuple:
        if (found := self.older.get(key)) is None:
            found = self.compute(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Codec:
    """Encodes and decodes with one vocabulary. A result is the ids as text, their number, the decoded text."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.v = vocabulary
        self.words, self.pieces = Remembered(self.word, remembered), Remembered(self.piece, remembered)
        self.pattern = regex.compile(WORDS)
        self.space = regex.compile(f"[{SPACE}]+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.shortest = min((s[:2] for s in vocabulary.special), default=None)

    def merge(self, word: str) -> list[int]:
        """One word's ids: a heap of merge ranks over a doubly linked list of symbols.

        An entry is the merge (rank and merged id) and its place, as one number. now[k] is the merge that the symbol
        at k and the next one have at present; entries that differ from it are stale and skipped.
        """
        data = word.encode("utf-8")
        starts, find = self.v.starts, self.v.merges.get
        at = [starts[b] for b in data]
        at[-1] = self.v.ends[data[-1]]
        if None in at:
            at = [x for x in at if x is not None]  # a byte that the vocabulary lacks has no id
        n = len(at)
        if n < 2:
            return at
        shift = n.bit_length()
        mask = (1 << shift) - 1
        now = [find(x << ID_BITS | y) for x, y in zip(at, at[1:])]
        now.append(None)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [m << shift | k for k, m in enumerate(now) if m is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            k = entry & mask
            m = entry >> shift
            if now[k] != m:
                continue  # stale
            merged = m & ID_MASK
            j = after[k]
            at[k], at[j], now[j] = merged, None, None
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                now[k] = m = find(merged << ID_BITS | at[j])
                if m is not None:
                    heappush(heap, m << shift | k)
            else:
                now[k] = None
            i = before[k]
            if i >= 0:
                now[i] = m = find(at[i] << ID_BITS | merged)
                if m is not None:
                    heappush(heap, m << shift | i)
        return [x for x in at if x is not None]

    def result(self, ids: list[int]) -> tuple[str, int, str]:
        return (" ".join(map(str, ids)), len(ids), self.decode(ids))

    def word(self, word: str) -> tuple[str, int, str]:
        return self.result(self.merge(word))

    def normalized(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # no final sigma

    def piece(self, piece: str) -> tuple[str, int, str]:
        """A piece without white space."""
        text = self.normalized(piece)
        if text.isalpha():
            return self.words[text]
        found = [x for w in self.pattern.findall(text) if (x := self.words[w])[1]]
        return (" ".join([x[0] for x in found]), sum([x[1] for x in found]), " ".join([x[2] for x in found]))

    def split(self, text: str) -> list[str]:
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return [p for p in self.space.split(text) if p]  # str.split() would also split at these
        return text.split()

    def encoded(self, text: str) -> list[tuple[str, int, str]]:
        known, out = self.pieces, []
        parts = self.specials.split(text) if self.specials and self.shortest in text else [text]
        for part in parts:
            if part in self.v.special:
                out.append((str(self.v.special[part]), 1, part))
            else:
                out += [known[p] for p in self.split(part)]
        return [x for x in out if x[1]]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for x in self.encoded(text or "") for i in x[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings in turn, with a space between (this tokenizer names no decoder of its own)."""
        strings = self.v.strings
        return " ".join([strings[i] for i in ids])


def encode_decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """Ids and decoded text of every whole text, and digests of both; one row for each row of df.

    df may have any further columns; they are not read. Null text counts as empty: no ids, empty decoded text. A null
    id stays null; repeated rows each give a row. An empty table gives an empty table. vocabulary is a path on the
    driver; executors get its content by a broadcast (its size is that of the file). ids=False and decoded=False leave these columns out.
    remembered bounds a worker's caches, and so its memory.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.load(vocabulary))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded

    def kernel(batches) -> Iterator[dict]:
        codec = Codec(shared.value, remembered)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            out: dict = {"id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "decoded": []}
            values = []
            for text in batch.column(1).to_pylist():
                found = codec.encoded(text or "")
                numbers, strings = " ".join([x[0] for x in found]), " ".join([x[2] for x in found])
                out["n_tokens"].append(sum([x[1] for x in found]))
                out["ids_sha256"].append(sha(numbers))
                out["decoded_sha256"].append(sha(strings))
                if ids:
                    values.append(np.array(numbers.split(), dtype=np.int32))
                if decoded:
                    out["decoded"].append(strings)
            if ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *out["n_tokens"]]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *values])))
            yield out

    return map_arrow(df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text")), schema, kernel, 128, 1 << 20).withColumnRenamed("id", id_col)
