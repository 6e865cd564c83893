"""SentencePiece encoding by backtracking, and decoding, for models of merge type."""

from __future__ import annotations

import codecs
import re
from array import array
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import map_text, small_batches

SPACE = "▁"
#: Words after which a process starts a new table of them, with the one before still at hand, and
#: pairs of tokens after which it forgets all.
CACHE_WORDS, CACHE_PAIRS = 250_000, 1_000_000
#: Longer words are encoded each time they occur.
CACHE_CHARS = 64
#: Characters of a text whose words are held at once.
SEGMENT = 1_000_000
_NONE = 1 << 31
_MARK = b"\xff" * 4


class Pieces:
    """A model's vocabulary. A token is a piece's id, or -1 - c for a character c that is no piece
    and is written as its bytes."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            model = proto.ModelProto.FromString(f.read())
        norm, kind = model.normalizer_spec, proto.ModelProto.SentencePiece
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or not model.trainer_spec.byte_fallback:
            raise ValueError(f"{path}: only merge-type models with byte fallback and without normalisation")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: only plain pieces")
        self.dummy, self.begin, self.end = norm.add_dummy_prefix, model.trainer_spec.bos_id, model.trainer_spec.eos_id
        self.text = [p.piece for p in model.pieces]
        self.length = [len(x) for x in self.text]
        self.size, self.width = np.array(self.length), max(self.length)
        plain = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        scores = sorted({model.pieces[i].score for i in plain.values()}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        self.rank = {x: order[model.pieces[i].score] for x, i in plain.items()}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        # A piece that its own merges do not give never stands in a result.
        self.id = {x: i for x, i in plain.items() if len(x) == 1 or self.merge(x) == [x]}
        self.find = ahocorasick.Automaton()
        for x, i in self.id.items():
            self.find.add_word(x, i)
        self.find.make_automaton()
        self.shorter = {i: self._prefix(x) for x, i in self.id.items()}
        letters = set().union(*self.id)
        self.apart = next(chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in letters)
        # No merge reaches from a word over the space that follows it, unless a piece does.
        self.word = None if any(SPACE in x.lstrip(SPACE) for x in self.id) else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.border = re.compile(f"(?<!{SPACE}){SPACE}")
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

        def shown(i: int, p) -> bytes:
            if p.type == kind.CONTROL:
                return b""
            if p.type == kind.UNKNOWN:
                return model.trainer_spec.unk_surface.encode()
            return bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else p.piece.replace(SPACE, " ").encode()

        table = [shown(i, p) for i, p in enumerate(model.pieces)]
        self.raw = np.frombuffer(b"".join(table), np.uint8)
        self.raw_size = np.array([len(x) for x in table], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.silent = np.array([p.type == kind.CONTROL for p in model.pieces])
        self.spaced = np.array([p.type == kind.NORMAL and p.piece.startswith(SPACE) for p in model.pieces])
        codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))

    def merge(self, text: str) -> list[str]:
        """Merge two neighbours again and again: the best score first, the leftmost of equal ones."""
        parts, get = list(text), self.rank.get
        ranks = [get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) < _NONE:
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], _NONE)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], _NONE)
        return parts

    def _prefix(self, x: str) -> int | None:
        """The longest token that is a proper prefix of a piece, at least its first character."""
        if len(x) == 1:
            return None
        return next((self.id[x[:n]] for n in range(len(x) - 1, 0, -1) if x[:n] in self.id), -1 - ord(x[0]))

    def _shown(self, token: int) -> str:
        return self.text[token] if token >= 0 else chr(-1 - token)

    def fits(self, a: int, b: int) -> bool:
        """Whether two tokens can stand side by side: merging their characters anew gives them back."""
        known = self.pairs.get((a << 32) + b)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            x, y = self._shown(a), self._shown(b)
            known = self.pairs[(a << 32) + b] = self.merge(x + y) == [x, y]
        return known

    def longest(self, text: str, at: int) -> int:
        """The longest token that starts at a place, by the automaton's own tree."""
        part, get = text[at : at + self.width], self.id.get
        for n in range(self.find.longest_prefix(part), 0, -1):
            if (token := get(part[:n])) is not None:
                return token
        return -1 - ord(part[0])

    def _walk(self, text: str, begun: tuple[int, ...] | list[int] = ()) -> list[int]:
        """Tokens of a text, after the longest matches ``begun`` that fit so far, by the longest token at each place. A place from which no way leads on
        is marked as failed, once, and the walk goes back by one token and tries a shorter one: a
        sequence in which all neighbours fit is what merging gives, and there is only one."""
        longest, sizes, shorter, known, fits = self.longest, self.length, self.shorter, self.pairs.get, self.fits
        out, failed, n = list(begun), bytearray(len(text) // 8 + 1), len(text)
        at = sum(map(sizes.__getitem__, out))
        token, last = longest(text, at), out[-1] if out else None
        while at < n:
            end = at + (sizes[token] if token >= 0 else 1)
            if not failed[end >> 3] >> (end & 7) & 1:
                fit = last is None or known((last << 32) + token)
                if fit or fit is None and fits(last, token):
                    out.append(token)
                    at, last = end, token
                    if at < n:
                        token = longest(text, at)
                    continue
            less = shorter.get(token)
            if less is None:
                if not out and begun:
                    return self._walk(text)
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()  # its end is marked, so a shorter one comes next
                at -= sizes[token] if token >= 0 else 1
                last = out[-1] if out else None
            else:
                token = less
        return out

    def _ids(self, tokens: list[int]) -> list[int]:
        return [i for t in tokens for i in ((t,) if t >= 0 else [self.byte[b] for b in chr(-1 - t).encode()])]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, four bytes each. The longest matches one after another are tried first, for all words
        in one pass: where all neighbours fit, they are the answer. The other words are walked."""
        joined = self.apart.join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        at = np.r_[0, np.cumsum(size + 1)]
        hits = np.fromiter(chain.from_iterable(self.find.iter_long(joined)), np.int64).reshape(-1, 2)
        token, long = hits[:, 1], self.size[hits[:, 1]]
        owner = np.searchsorted(at, hits[:, 0], "right") - 1
        good = np.bincount(owner, long, len(words)) == size  # no character is without a piece
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        left, right = token[pair], token[pair + 1]
        key, back = np.unique(left << 32 | right, return_inverse=True)
        known = list(map(self.pairs.get, key.tolist()))
        for i, (k, fit) in enumerate(zip(key.tolist(), known)):
            if fit is None:
                known[i] = self.fits(k >> 32, k & 0xFFFFFFFF)
        misfit = pair[~np.array(known, bool)[back]]
        whole, reach = good.copy(), np.searchsorted(owner, np.arange(len(words) + 1))
        good[owner[misfit]] = False
        bad, at = np.unique(owner[misfit], return_index=True)
        fit = dict(zip(bad.tolist(), (misfit[at] + 1).tolist()))  # up to where all neighbours fit
        raw, first, flat = token.astype(np.uint32).tobytes(), reach.tolist(), token.tolist()
        out = [raw[4 * a : 4 * b] for a, b in zip(first, first[1:])]
        for i in np.flatnonzero(~good).tolist():
            begun = flat[first[i] : fit[i]] if whole[i] else ()
            out[i] = array("I", self._ids(self._walk(words[i], begun))).tobytes()
        return out

    def _segments(self, text: str):
        """A text in runs of whole words."""
        at = 0
        while self.word is not None and len(text) - at > 2 * SEGMENT and (cut := self.border.search(text, at + SEGMENT)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and each text's number of ids."""
        flat, count, held = [], [], []

        def put() -> None:
            words = list(chain.from_iterable(held))
            held.clear()
            if len(self.words) > CACHE_WORDS:
                self.older, self.words = self.words, {}
            known, older = self.words, self.older
            known[""] = _MARK
            new = []
            for w in set(words):
                if w not in known:
                    if w in older:
                        known[w] = older[w]
                    else:
                        new.append(w)
            known.update(zip(new, self.encode_words(new)))
            flat.append(np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32))
            for w in new:
                if len(w) > CACHE_CHARS:
                    del known[w]

        n = 0
        for t in texts:
            for part in self._segments((SPACE if self.dummy else "") + t.replace(" ", SPACE)) if t else ():
                held.append([part] if self.word is None else self.word.findall(part))
                n += len(part)
                if n > SEGMENT:
                    put()
                    n = 0
            held.append([""])  # stands between texts; no word is empty
        put()
        ids = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        ends = np.flatnonzero(ids == -1)  # the marks
        count = np.diff(np.r_[-1, ends]) + 1
        ids = np.insert(ids, np.r_[0, ends + 1][: len(ends)], self.begin)
        ids[np.cumsum(count) - 1] = self.end
        return ids, count.astype(np.int64)

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """Texts of runs of ids. Control ids say nothing; the first piece of a text loses its space."""
        ids = ids.astype(np.int64)
        size, at = self.raw_size[ids], self.raw_at[ids]
        start = np.cumsum(count) - count
        if self.dummy and len(ids):
            told = np.r_[np.flatnonzero(~self.silent[ids]), len(ids)]
            first = told[np.searchsorted(told, start)]
            first = first[(first < start + count) & (count > 0)]
            first = first[self.spaced[ids[first]]]
            size[first] -= 1
            at[first] += 1
        total = np.cumsum(size)
        raw = self.raw[np.repeat(at - (total - size), size) + np.arange(size.sum())].tobytes()
        ends = np.r_[0, total][np.cumsum(count)].tolist() if len(count) else []
        return [raw[a:b].decode("utf-8", "each_byte") for a, b in zip([0, *ends[:-1]], ends)]


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    """One vocabulary per Python process and file: workers that are used again keep their words."""
    return Pieces(path)


def piece_encode(df: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids", packed_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``ids_col``: the ids of each whole text (array of int), begin and end ids included,
    as the sentencepiece library gives them. ``packed_col`` adds them as little-endian unsigned
    32-bit integers in one binary value.

    Null and empty texts give the begin and end ids alone. Rows keep their order and number;
    columns of ``keep`` (default: all) pass through, and one named as an output is replaced.
    ``model`` is a file that each executor can open. A text is cut into words where no piece of
    the vocabulary reaches across; a word is walked in time in proportion to its length.
    """
    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))] + ([T.StructField(packed_col, T.BinaryType())] if packed_col else [])

    def start():
        own = pieces(model)

        def kernel(texts):
            ids, count = own.encode(texts)
            ends = np.r_[0, np.cumsum(count)]
            out = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
            if packed_col:
                raw = ids.astype("<u4").tobytes()
                out.append(pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer((4 * ends).astype(np.int32).tobytes()), pa.py_buffer(raw)]))
            return out

        return kernel

    return map_text(df, text_col, fields, start, keep)


def piece_decode(df: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with ``text_col``: the text of each id array, as the sentencepiece library gives it.
    Null and empty arrays give an empty text; bytes that are no UTF-8 become U+FFFD each; an id
    outside the vocabulary raises an error. Unlike the library, byte ids on both sides of a control
    id are one run of bytes; encoding never gives such ids."""
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c != text_col]
    sent = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*sent.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches):
        own = pieces(model)
        for whole in batches:
            step = max(1, int(1_000_000 * whole.num_rows / max(1, len(pc.list_flatten(whole.column(ids_col))))))
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                lists = b.column(ids_col)
                count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                texts = own.decode(pc.list_flatten(lists).to_numpy(zero_copy_only=False), count)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, text_col])

    return sent.mapInArrow(run, schema)
