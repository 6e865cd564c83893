"""Byte-level BPE: encoding by batched numpy merge rounds, decoding by byte gathers."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import map_text, small_batches

#: Fixed value: the public pre-tokenizer pattern of byte-level BPE.
WORD = r"""'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a task keeps; the table starts anew when it is full.
CACHE_WORDS = 150_000
#: Longer words are encoded each time they occur.
CACHE_CHARS = 64
_NONE = np.iinfo(np.int32).max


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """A tokenizer file's vocabulary as arrays, with a bounded table of encoded words."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        names = {i: bytes(letters[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        table = [names.get(i, b"") for i in range(max(names) + 1)]
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.token_size = np.array([len(t) for t in table], np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank, self.rank_made = key[order], order.astype(np.int32), made
        self.word = regex.compile(WORD)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.count, self.flat, self.at, self.size = 0, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair by binary search over the sorted pair keys."""
        key = left << 32 | right
        i = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[i] == key, self.pair_rank[i], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and each word's number of ids.

        All symbols lie in one flat array. A round finds the lowest rank among each word's
        pairs and merges that pair wherever it stands in the word, left to right; words
        without a known pair leave. A merge only makes pairs of higher rank, so rounds give
        what merging one pair at a time gives. Only pairs beside a merge are looked up again.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), size)
        done_sym, done_owner = [], []
        rank = np.full(len(sym), _NONE, np.int32)  # of the pair that starts here
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = self._rank(sym[inside], sym[inside + 1])
        while len(sym):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            length = np.diff(np.r_[start, len(sym)])
            low = np.minimum.reduceat(rank, start)
            over = np.repeat(low == _NONE, length)
            if over.any():
                done_sym.append(sym[over])
                done_owner.append(owner[over])
                sym, owner, rank, low, length = sym[~over], owner[~over], rank[~over], low[low != _NONE], length[low != _NONE]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(low, length))
            if len(at) > 1 and (np.diff(at) == 1).any():  # aaa: every other one of a run of overlapping pairs
                run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            sym[at] = self.rank_made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            again = np.unique(np.r_[place[at], place[at] - 1])
            again = again[again >= 0]
            rank[again] = _NONE
            again = again[again + 1 < len(sym)]
            again = again[owner[again] == owner[again + 1]]
            rank[again] = self._rank(sym[again], sym[again + 1])
        if not done_sym:
            return np.zeros(0, np.int32), size
        sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
        return sym[np.argsort(owner, kind="stable")].astype(np.int32), np.bincount(owner, minlength=len(words))

    def _add(self, words: list[str]) -> None:
        ids, size = self.merge([w.encode("utf-8", "surrogatepass") for w in words])
        self.index.update(zip(words, range(self.count, self.count + len(words))))
        self.at = np.r_[self.at, np.cumsum(size) - size + len(self.flat)]
        self.size, self.flat = np.r_[self.size, size], np.r_[self.flat, ids]
        self.count += len(words)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and each text's number of ids."""
        find, pieces, owner, n = self.word.findall, [], [], len(texts)
        for t in texts:
            got: list = []
            if t:
                if self.cut is None or not any(s in t for s in self.special):
                    got = find(t)
                else:
                    for x in self.cut.split(t):
                        got += [self.special[x]] if x in self.special else find(x)
            pieces += got
            owner.append(len(got))
        if self.count > CACHE_WORDS:
            self.clear()
        for s in {p for p in pieces if p.__class__ is int} if self.special and any(s in t for t in texts if t for s in self.special) else ():
            if s not in self.index:
                self.index[s] = self.count
                self.at, self.size, self.flat = np.r_[self.at, len(self.flat)], np.r_[self.size, 1], np.r_[self.flat, np.int32(s)]
                self.count += 1
        new = [w for w in set(pieces) if w not in self.index]
        if new:
            self._add(new)
        index = self.index
        w = np.fromiter([index[p] for p in pieces], np.int64, len(pieces))
        for p in new:
            if len(p) > CACHE_CHARS:
                del index[p]
        size = self.size[w]
        ids = self.flat[np.repeat(self.at[w] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        ends = np.r_[0, np.cumsum(size)][np.cumsum(np.array(owner, np.int64))] if n else np.zeros(0, np.int64)
        return ids, np.diff(np.r_[0, ends])

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """Texts of runs of ids: the tokens' bytes in one gather, then UTF-8 with replacement."""
        ids = ids.astype(np.int64)
        size = self.token_size[ids]
        total = np.cumsum(size)
        raw = self.token_bytes[np.repeat(self.token_at[ids] - (total - size), size) + np.arange(size.sum())].tobytes()
        end = np.r_[0, total][np.cumsum(count)].tolist() if len(count) else []
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *end[:-1]], end)]


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per Python process and file: workers that are used again keep their words."""
    return Codec(path)


def _lists(ids: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(ids.astype(np.int32)))


def bpe_encode(df: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``ids_col``: the token ids of each whole text (array of int).

    Equal to the tokenizers library on the file without added special tokens; strings of
    special tokens inside a text become those tokens. Null and empty texts give an empty
    array. Rows keep their order and number; columns of ``keep`` (default: all) pass
    through, and a column named as the output is replaced. ``tokenizer`` is a file that each
    executor can open.
    """

    def start():
        own = codec(tokenizer)
        return lambda texts: [_lists(*own.encode(texts))]

    return map_text(df, text_col, [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))], start, keep)


def bpe_decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with ``text_col``: the text of each id array. Null gives an empty text; bytes that
    are no UTF-8 become U+FFFD; an id outside the vocabulary raises an error."""
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != text_col]
    sent = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*sent.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches):
        own = codec(tokenizer)
        for whole in batches:
            step = max(1, int(1_000_000 * whole.num_rows / max(1, len(pc.list_flatten(whole.column(ids_col))))))
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                lists = b.column(ids_col)
                count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                texts = own.decode(pc.list_flatten(lists).to_numpy(zero_copy_only=False), count)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, text_col])

    return sent.mapInArrow(run, schema)
