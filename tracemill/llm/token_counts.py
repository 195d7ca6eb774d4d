"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens; the distinct pre-tokens of a slice are laid out as one ragged array of byte symbols, and in
every round each sequence merges all places of its own lowest-ranked pair at once, until no sequence has a pair left. The
surviving symbols are counted. In this vocabulary each merge makes another symbol, so a pair that a merge creates always
ranks above it, and merging all places of one rank together gives what merging them one by one gives.

Defined results: null and empty texts have no tokens; repeated rows each get their row; a special string inside a text is one
token, as the library has it by default.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

LIMIT = 512
#: Pre-tokens whose counts a worker remembers; the memory is emptied when it is full.
REMEMBERED = 400_000
_NONE = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Merges:
    """A byte-level BPE vocabulary as arrays: sorted pair codes with their ranks and products."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.first = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        code = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(code)
        self.code, self.rank = code[order], order.astype(np.int32)
        self.product = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a << 20 | b
        at = np.searchsorted(self.code, code)
        at[at == len(self.code)] = 0
        return np.where(self.code[at] == code, self.rank[at], _NONE)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each piece after all merges."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = lens.copy()
        live = np.flatnonzero(lens > 1)
        if not len(live):
            return out
        sym = self.first[np.frombuffer(b"".join([pieces[i] for i in live]), np.uint8)]
        lens = lens[live]
        ends = np.cumsum(lens)
        rank = np.full(len(sym), _NONE, np.int32)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[ends - 1] = _NONE  # the last symbol of a sequence starts no pair
        while len(live):
            starts = np.cumsum(lens) - lens
            low = np.minimum.reduceat(rank, starts)
            going = low != _NONE
            out[live] = lens
            if not going.all():
                mask = np.repeat(going, lens)
                sym, rank, live, lens, low = sym[mask], rank[mask], live[going], lens[going], low[going]
                if not len(live):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, lens))
            # In a run of overlapping places (one symbol repeated) every second one merges, from the left.
            run = np.concatenate(([True], np.diff(hit) != 1))
            first = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            made = self.product[rank[hit]]
            last = np.zeros(len(sym), bool)
            last[np.cumsum(lens) - 1] = True
            last[hit] = last[hit + 1]
            sym[hit] = made
            stays = np.ones(len(sym), bool)
            stays[hit + 1] = False
            gone = np.add.reduceat(~stays, np.cumsum(lens) - lens)
            where = hit - np.arange(len(hit))
            sym, rank, last, lens = sym[stays], rank[stays], last[stays], lens - gone
            for at in (where, where[where > 0] - 1):
                nxt = np.minimum(at + 1, len(sym) - 1)
                rank[at] = np.where(last[at], _NONE, self.ranks(sym[at], sym[nxt]))
        return out


@functools.lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


class Counter:
    def __init__(self, path: str, pattern: str):
        import regex

        self.merges = merges(path)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, int] = {}
        self.special = regex.compile("|".join(map(regex.escape, self.merges.special))) if self.merges.special else None

    def counts(self, texts: list[str]) -> list[int]:
        parts = [[p for s in (self.special.split(t) if self.special else [t]) for p in self.find(s)] for t in texts]
        extra = [len(self.special.findall(t)) if self.special else 0 for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({p for ps in parts for p in ps} - self.known.keys())
        if new:
            self.known.update(zip(new, self.merges.counts([p.encode() for p in new]).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, ps)) + n for ps, n in zip(parts, extra, strict=True)]


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, *, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text. One narrow pass over all rows, no shuffle."""

    def run(batches):
        counter = Counter(vocabulary, pattern)
        for batch in slices(batches):
            raw = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            n = counter.counts([x.decode() for x in raw])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(map(len, raw), pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    df = docs.select("doc_id", "text")
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
