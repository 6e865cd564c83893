"""Language identification: a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvane.llm.common import map_text

#: Bounds of the training sample: documents of a language, of all languages, characters of each.
SAMPLE_DOCS, SAMPLE_TOTAL, SAMPLE_CHARS = 1500, 20_000, 300
#: More label values than this are no languages: fitting refuses them.
MOST_LANGS = 10_000
#: Units of the recurrent state; positions of a window, and bytes of context read on each side.
HIDDEN, WINDOW, CONTEXT = 16, 192, 24
#: Windows that are run together.
BATCH = 1024
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    """``side[d]``: (input table 256 x 2H with bias, recurrent H x 2H) for forward and backward;
    ``out``, ``bias``: from both states to the languages."""

    langs: list[str]
    side: list[tuple[np.ndarray, np.ndarray]]
    out: np.ndarray
    bias: np.ndarray


def _states(codes: np.ndarray, mask: np.ndarray, table: np.ndarray, rec: np.ndarray, trace: list | None = None) -> np.ndarray:
    """Hidden states (steps, rows, H): ``h + u * (c - h)`` with the update gate u, a piecewise
    linear sigmoid, and the candidate c, a tangent, both from the byte and the last state. A
    masked step carries the state on unchanged."""
    n, h = codes.shape[1], np.zeros((codes.shape[1], HIDDEN), np.float32)
    out = np.empty((len(codes), n, HIDDEN), np.float32)
    for t in range(len(codes)):
        g = table[codes[t]] + h @ rec
        u = np.clip(0.25 * g[:, :HIDDEN] + 0.5, 0, 1)
        c = np.tanh(g[:, HIDDEN:])
        if trace is not None:
            trace.append((h, u, c))
        h = out[t] = h + u * (c - h) * mask[t][:, None]
    return out


def _grads(codes: np.ndarray, mask: np.ndarray, rec: np.ndarray, trace: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backpropagation through time: gradients of the input table and the recurrent weights."""
    d_table, d_rec = np.zeros((256, 2 * HIDDEN), np.float32), np.zeros_like(rec)
    carry = np.zeros_like(d_states[0])
    for t in range(len(codes) - 1, -1, -1):
        h, u, c = trace[t]
        m = mask[t][:, None]
        d = d_states[t] + carry
        dg = np.concatenate([d * (c - h) * m * 0.25 * ((u > 0) & (u < 1)), d * u * m * (1 - c * c)], axis=1)
        np.add.at(d_table, codes[t], dg)
        d_rec += h.T @ dg
        carry = d * (1 - u * m) + dg @ rec.T
    return d_table, d_rec


def _run(codes: np.ndarray, mask: np.ndarray | None, table: np.ndarray, rec: np.ndarray, skip: int) -> np.ndarray:
    """The states of ``_states`` as (steps - skip, H, rows), without the first ``skip`` steps: each
    unit's values lie together and arrays are used again. ``table`` and ``rec`` are transposed."""
    n = codes.shape[1]
    h, g, x = np.zeros((HIDDEN, n), np.float32), np.empty((2 * HIDDEN, n), np.float32), np.empty((2 * HIDDEN, n), np.float32)
    out = np.empty((len(codes) - skip, HIDDEN, n), np.float32)
    u, c = g[:HIDDEN], g[HIDDEN:]
    for t in range(len(codes)):
        np.matmul(rec, h, out=g)
        np.take(table, codes[t], axis=1, out=x, mode="clip")
        g += x
        np.tanh(c, out=c)
        u *= 0.25
        u += 0.5
        np.clip(u, 0, 1, out=u)
        if mask is not None:
            u *= mask[t]
        c -= h
        c *= u
        h += c
        if t >= skip:
            out[t - skip] = h
    return out


def _read(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)


def train(rows: list[tuple[str, str]], epochs: int = 4, windows: int = 8_000, batch: int = 256, rate: float = 0.01, seed: int = 1) -> Model | None:
    """Fit on (text, language) rows; every position of a window is a case of its language."""
    langs = sorted({lang for _, lang in rows})
    texts = [(_read(text), langs.index(lang)) for text, lang in rows if text]
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    steps = 2 * CONTEXT
    by = [[x for x, k in texts if k == i] for i in range(len(langs))]
    draw = [(i, int(j)) for i, own in enumerate(by) if own for j in rng.integers(0, len(own), max(1, windows // len(langs)))]
    n, h = len(langs), HIDDEN
    par = {"f_in": rng.normal(0, 0.3, (256, 2 * h)), "f_rec": rng.normal(0, h**-0.5, (h, 2 * h)), "b_in": rng.normal(0, 0.3, (256, 2 * h)), "b_rec": rng.normal(0, h**-0.5, (h, 2 * h)), "out": rng.normal(0, 0.1, (2 * h, n)), "bias": np.zeros(n)}
    par = {k: v.astype(np.float32) for k, v in par.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in par.items()}, {k: np.zeros_like(v) for k, v in par.items()}, 0
    total = epochs * -(-len(draw) // batch)
    for _ in range(epochs):
        rng.shuffle(draw)
        for at in range(0, len(draw), batch):
            own = draw[at : at + batch]
            codes, mask = np.zeros((len(own), steps), np.uint8), np.zeros((len(own), steps), np.float32)
            for k, (i, j) in enumerate(own):
                x = by[i][j]
                lo = int(rng.integers(0, max(1, len(x) - steps + 1)))
                cut = x[lo : lo + steps]
                codes[k, : len(cut)], mask[k, : len(cut)] = cut, 1
            codes, mask, y = codes.T.copy(), mask.T.copy(), np.array([i for i, _ in own])
            tf, tb = [], []
            sf = _states(codes, mask, par["f_in"], par["f_rec"], tf)
            sb = _states(codes[::-1], mask[::-1], par["b_in"], par["b_rec"], tb)[::-1]
            s = np.concatenate([sf, sb], axis=2)
            p = _softmax(s @ par["out"] + par["bias"])
            p[:, np.arange(len(y)), y] -= 1
            d = p * (mask / mask.sum())[:, :, None]
            ds = d @ par["out"].T
            grad = {"out": np.einsum("tnh,tnl->hl", s, d), "bias": d.sum((0, 1))}
            grad["f_in"], grad["f_rec"] = _grads(codes, mask, par["f_rec"], tf, ds[:, :, :h])
            grad["b_in"], grad["b_rec"] = _grads(codes[::-1], mask[::-1], par["b_rec"], tb, ds[::-1, :, h:])
            step += 1
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                now = rate * min(1.0, 2 * (1 - (step - 1) / total))
                par[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(langs, [(par["f_in"], par["f_rec"]), (par["b_in"], par["b_rec"])], par["out"], par["bias"])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Labeller:
    """Applies a model. Texts are cut into windows of positions to label; in each direction the
    state is warmed up on the bytes before the window, so that it runs on across windows."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.side = [(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)) for a, b in model.side]
        self.out = [np.ascontiguousarray(model.out[k : k + HIDDEN].T) for k in (0, HIDDEN)]
        self.bias = model.bias[:, None]

    def pooled(self, own: list[np.ndarray]) -> np.ndarray:
        """Per text: the sum over its byte positions of the languages' probabilities."""
        size = np.array([len(x) for x in own], np.int64)
        out = np.zeros((len(own), len(self.model.langs)))
        # One array with a margin of context, so that every window can be gathered at once.
        flat = np.concatenate([np.zeros(CONTEXT, np.uint8), *own, np.zeros(WINDOW + CONTEXT, np.uint8)])
        begin = np.cumsum(size) - size + CONTEXT
        count = -(-size // WINDOW)
        of = np.repeat(np.arange(len(own)), count)
        at = begin[of] + WINDOW * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
        whole = (at - CONTEXT >= begin[of]) & (at + WINDOW + CONTEXT <= (begin + size)[of])
        for full in (True, False):
            pick = np.flatnonzero(whole == full)
            for lo in range(0, len(pick), BATCH):
                k = pick[lo : lo + BATCH]
                place = at[k] + np.arange(-CONTEXT, WINDOW + CONTEXT)[:, None]
                mask = None if full else ((place >= begin[of[k]]) & (place < (begin + size)[of[k]])).astype(np.float32)
                np.add.at(out, of[k], self._window(flat[place], mask))
        return out

    def _window(self, codes: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Summed probabilities over the windows' own positions. ``codes``: (steps, windows)."""
        end, turn = CONTEXT + WINDOW, slice(None, CONTEXT - 1, -1)
        forth = _run(codes[:end], None if mask is None else mask[:end], *self.side[0], CONTEXT)
        back = _run(codes[turn], None if mask is None else mask[turn], *self.side[1], CONTEXT)[::-1]
        total = np.zeros((len(self.bias), codes.shape[1]), np.float32)
        for lo in range(0, WINDOW, 32):
            e = self.out[0] @ forth[lo : lo + 32]
            e += self.out[1] @ back[lo : lo + 32]
            e += self.bias
            e -= e.max(axis=1, keepdims=True)
            np.exp(e, out=e)
            e /= e.sum(axis=1, keepdims=True)
            if mask is not None:
                e *= mask[CONTEXT + lo : CONTEXT + min(lo + 32, WINDOW), None]
            total += e.sum(axis=0)
        return total.T

    def __call__(self, texts: list[str | None]) -> list[pa.Array]:
        known = np.array([bool(t and _LETTER.search(t)) for t in texts], bool)
        own = [_read(t) if ok else np.zeros(0, np.uint8) for t, ok in zip(texts, known)]
        share = self.pooled(own) / np.maximum([len(x) for x in own], 1)[:, None]
        pick = share.argmax(axis=1)
        langs = [self.model.langs[k] if ok else UNKNOWN for k, ok in zip(pick, known)]
        score = np.where(known, np.minimum(share[np.arange(len(pick)), pick], 1.0), 0.0)
        return [pa.array(langs, pa.string()), pa.array(np.round(score, 6))]


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document may not be learnt from: crc32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, sample_total: int = SAMPLE_TOTAL) -> Model | None:
    """Train on a bounded sample of the documents that are not held out.

    Of each language the documents with the least hash give ``sample_chars`` characters each,
    from a place set by the hash: ``sample_docs`` of them, or an equal share of ``sample_total``
    where there are many languages; that is all that reaches the driver. Every language is
    learnt; a label column of over ``MOST_LANGS`` values is refused. Rows without id, text or
    language are not learnt from. No such rows: None.
    """
    open_rows = docs.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = open_rows.groupBy(F.col(lang_col).cast("string").alias("lang")).count().limit(MOST_LANGS + 1).collect()
    if not counts:
        return None
    if len(counts) > MOST_LANGS:
        raise ValueError(f"{lang_col} holds over {MOST_LANGS} values")
    most = max(1, min(sample_docs, sample_total // len(counts)))
    bound = docs.sparkSession.createDataFrame([(r.lang, sampled_share(most, r["count"])) for r in counts], "lang string, share double")
    h = F.xxhash64(F.col(id_col), F.lit("sample"))
    place = F.pmod(h, F.greatest(F.length(text_col) - sample_chars, F.lit(1)).cast("long")).cast("int") + 1
    rows = open_rows.select(h.alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), place.alias("place"))
    # Counts tell which hashes can be among the least: about twice the sample is sorted.
    unit = F.shiftrightunsigned(F.col("h"), 11) * F.lit(2.0**-53)
    rows = rows.join(F.broadcast(bound), "lang").where(unit < F.col("share"))
    rows = rows.select("lang", unit.alias("u"), F.substring(F.col("text"), F.col("place"), F.lit(sample_chars)).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "text"))
    got = rows.withColumn("k", rank).where(F.col("k") <= most).select("text", "lang").collect()
    return train(sorted((r.text, r.lang) for r in got))


def sampled_share(most: int, count: int) -> float:
    """The share of a language's documents that are sorted to find the ``most`` of the sample."""
    return min(1.0, (2 * most + 20) / count)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the whole text alone.

    The network labels every byte position of the lower-cased text; ``score`` is the mean
    probability of the best language over all positions. Null, empty and letterless texts, and all texts if there is no model,
    are ``und`` with score 0. Rows and columns pass through; columns named as outputs are
    replaced.
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def start():
        if model is None:
            return lambda texts: [pa.array([UNKNOWN] * len(texts), pa.string()), pa.array(np.zeros(len(texts)))]
        return Labeller(model)

    return map_text(docs, text_col, fields, start, keep)
