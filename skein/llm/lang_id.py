"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the lower-cased bytes of a whole text in both directions, across words, and gives every position a
distribution over the learned languages and one more class, ``none``: text in no language. A document's probabilities are
the mean over all its positions. Training is backpropagation through time in numpy on the driver, on a bounded sample of
labelled rows (``TrainingBounds``) and on noise made of it; prediction is one pass over the table without a shuffle.

The state is carried from a text's first byte to its last, and back. To run a text's windows side by side, each but the
first starts from a state that has read the WARM bytes before it; where that state turns out to be more than CLOSE from
the one that the window before ended in, the window is run again from the carried state until it meets its earlier states (seen every
CHECK bytes), and so on until all agree. Texts of more
than LONG bytes are read piece by piece, with the states carried between the pieces, so that memory does not grow with
them.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if no row is labelled. Ties of
probability fall to the alphabetically first language. A null id is never held out and never trained on. Repeated rows
get equal answers; other columns are ignored; an empty table gives an empty result. Own columns that bear a result's name
(in any case) are kept with ``own_`` before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.memory import released
from skein.llm.names import numbered, with_results
from skein.llm.sampling import hash_sample
from skein.llm.words import blocks, text_buffers

HIDDEN = 8
#: Bytes of a window, of its warm-up and between checks; windows run side by side; how far states may be apart.
WINDOW, WARM, CHECK, BESIDE, CLOSE = 1024, 16, 32, 1024, 0.02
BLOCK, LONG = 1 << 20, 1 << 20
#: How often training meets the class ``none``, as a multiple of one language.
NONE_ODDS = 0.5
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
FOUND = "lang string, score double, share double"


@dataclass(frozen=True)
class TrainingBounds:
    """What a fit may take from the labelled rows: rows, then stretches of ``span`` bytes of them, both by hash."""

    rows: int = 4000
    spans: int = 60_000
    span: int = 64
    steps: int = 400
    batch: int = 128


@dataclass(frozen=True)
class Direction:
    """Input weights (3H, 256), recurrent weights (3H, H), bias of the candidate's recurrent part (H, 1)."""

    x: np.ndarray
    h: np.ndarray
    b: np.ndarray


@dataclass(frozen=True)
class Model:
    """Output weights are (classes, H) for each direction; the last class is ``none``."""

    languages: tuple[str, ...]
    forward: Direction
    backward: Direction
    out: tuple[np.ndarray, np.ndarray]
    bias: np.ndarray


def _step(d: Direction, byte: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next state (H, k), and the gates z and r, the candidate's recurrent part and the candidate."""
    size = len(state)
    x, u = d.x.take(byte, axis=1), d.h @ state
    gates = x[: 2 * size]
    gates += u[: 2 * size]
    gates *= np.float32(0.5)
    np.tanh(gates, out=gates)
    gates *= np.float32(0.5)
    gates += np.float32(0.5)
    z, r = gates[:size], gates[size:]
    inner = u[2 * size :]
    inner += d.b
    new = r * inner
    new += x[2 * size :]
    np.tanh(new, out=new)
    state = state - new
    state *= z
    state += new
    return state, z, r, inner, new


def _unroll(d: Direction, byte: np.ndarray, saved: list, grad: np.ndarray) -> list[np.ndarray]:
    """Gradients of x, h, b by backpropagation through time; saved: (state before, z, r, inner, candidate) of each step."""
    steps, size, k = grad.shape
    into = np.empty((steps, 3 * size, k), grad.dtype)
    gh, gb = np.zeros_like(d.h), np.zeros_like(d.b)
    carry = np.zeros_like(grad[0])
    for t in range(steps - 1, -1, -1):
        state, z, r, inner, new = saved[t]
        g = grad[t] + carry
        g_new = g * (1 - z) * (1 - new * new)
        into[t, :size] = g * (state - new) * z * (1 - z)
        into[t, size : 2 * size] = g_new * inner * r * (1 - r)
        into[t, 2 * size :] = g_new
        back = into[t].copy()
        back[2 * size :] *= r
        gh += back @ state.T
        gb += back[2 * size :].sum(axis=1, keepdims=True)
        carry = g * z + d.h.T @ back
    # Gradients of one byte's weights are added up in runs of equal bytes.
    flat = byte.ravel()
    order = np.argsort(flat, kind="stable")
    seen, at = np.unique(flat[order], return_index=True)
    gx = np.zeros_like(d.x)
    gx[:, seen] = np.add.reduceat(into.transpose(1, 0, 2).reshape(3 * size, -1)[:, order], at, axis=1)
    return [gx, gh, gb]


def noise(rng: np.random.Generator, spans: np.ndarray) -> np.ndarray:
    """Text in no language, as wide as ``spans``: their letters in another order, random letters, marks, or other scripts."""
    n, width = spans.shape
    out = spans.copy()
    for i in range(n):
        kind = i % 4
        if kind == 0:
            solid = np.flatnonzero(out[i] > 32)
            out[i, solid] = rng.permutation(out[i, solid])
            continue
        if kind == 1:
            row = rng.integers(97, 123, width)
        elif kind == 2:
            row = _FOLD[rng.integers(33, 127, width)]
        else:
            row = rng.integers(0x80, 0xC0, width)
            step = int(rng.integers(2, 4))
            low, high = (0xC4, 0xE0) if step == 2 else (0xE0, 0xEE)
            # A text of one script has few lead bytes.
            row[::step] = rng.integers(low, high, 3)[rng.integers(0, 3, len(row[::step]))]
        row[rng.random(width) < rng.choice([0.0, 0.1, 0.2])] = 32
        out[i] = row
    return out


def train(spans: list[tuple[str, bytes]], bounds: TrainingBounds = TrainingBounds(), hidden: int = HIDDEN, seed: int = 7) -> Model:
    """spans: (language, lower-cased bytes). Every class is drawn equally often; Adam on mean cross entropy."""
    rng = np.random.default_rng(seed)
    languages = tuple(sorted({lang for lang, _ in spans}))
    classes = len(languages) + 1

    def matrix(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    params = [p for _ in range(2) for p in (matrix(3 * hidden, 256, scale=0.3), matrix(3 * hidden, hidden, scale=hidden**-0.5), np.zeros((hidden, 1), np.float32))]
    params += [matrix(classes, hidden, scale=0.3), matrix(classes, hidden, scale=0.3), np.zeros((classes, 1), np.float32)]

    def model() -> Model:
        return Model(languages, Direction(*params[0:3]), Direction(*params[3:6]), (params[6], params[7]), params[8])

    byte = np.full((len(spans), bounds.span), 32, np.uint8)
    size = np.array([min(len(text), bounds.span) for _, text in spans])
    for i, (_, text) in enumerate(spans):
        byte[i, : size[i]] = np.frombuffer(text[: bounds.span], np.uint8)
    own = np.array([languages.index(lang) for lang, _ in spans])
    made = rng.choice(len(spans), min(len(spans), 4096), replace=False)
    byte = np.concatenate([byte, noise(rng, byte[made])])
    size = np.concatenate([size, size[made]])
    own = np.concatenate([own, np.full(len(made), classes - 1)])
    odds = np.append(np.ones(classes - 1), NONE_ODDS) / (classes - 1 + NONE_ODDS)
    by_class = [np.flatnonzero(own == c) for c in range(classes)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, bounds.steps + 1):
        label = rng.choice(classes, bounds.batch, p=odds)
        pick = np.array([by_class[c][rng.integers(len(by_class[c]))] for c in label])
        width = int(size[pick].max())
        now = np.ascontiguousarray(byte[pick, :width].T).astype(np.intp)
        there = np.arange(width)[:, None] < size[pick]
        m = model()
        scores, sides = None, []
        for d, out, read in ((m.forward, m.out[0], now), (m.backward, m.out[1], now[::-1])):
            state, saved, states = np.zeros((hidden, bounds.batch), np.float32), [], np.empty((width, hidden, bounds.batch), np.float32)
            for t in range(width):
                before = state
                state, *rest = _step(d, read[t], state)
                saved.append((before, *rest))
                states[t] = state
            part = out @ states
            scores = part if scores is None else scores + part[::-1] + m.bias
            sides.append((read, saved, states))
        scores -= scores.max(axis=1, keepdims=True)
        p = np.exp(scores)
        p /= p.sum(axis=1, keepdims=True)
        p[:, label, np.arange(bounds.batch)] -= 1
        p *= (there / max(there.sum(), 1))[:, None, :].astype(np.float32)
        grads, ends = [], []
        for (read, saved, states), d, out, g in zip(sides, (m.forward, m.backward), m.out, (p, p[::-1]), strict=True):
            grads += _unroll(d, read, saved, out.T @ g)
            ends.append(np.tensordot(g, states, ([0, 2], [0, 2])))
        grads += [*ends, p.sum(axis=(0, 2))[:, None]]
        rate = 0.012 * (1 - step / (bounds.steps + 1)) ** 0.5
        for k, g in enumerate(grads):
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            params[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model()


class _Reader:
    """A direction at work: ``_step`` without what training needs, in buffers of its own.

    The gates' weights are negated, so that a gate is the reciprocal of 1 + exp, and the bias has a column of its own.
    """

    def __init__(self, d: Direction, out: np.ndarray):
        size = self.size = d.h.shape[1]
        self.h = np.concatenate([d.h, np.concatenate([np.zeros((2 * size, 1), np.float32), d.b])], axis=1)
        self.x, self.out = d.x.copy(), out
        self.h[: 2 * size] *= -1
        self.x[: 2 * size] *= -1

    def run(self, byte: np.ndarray, state: np.ndarray, scores: np.ndarray | None = None) -> np.ndarray:
        """The state (H, k) after reading ``byte`` (T, k); ``scores`` (T, classes, k) is filled."""
        size, k = self.size, byte.shape[1]
        x, u = np.empty((3 * size, k), np.float32), np.empty((3 * size, k), np.float32)
        full = np.ones((size + 1, k), np.float32)
        full[:size] = state
        state, gates, inner, new = full[:size], u[: 2 * size], u[2 * size :], x[2 * size :]
        for t in range(len(byte)):
            np.take(self.x, byte[t], axis=1, out=x, mode="clip")
            np.matmul(self.h, full, out=u)
            gates += x[: 2 * size]
            np.minimum(gates, 80, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            inner *= gates[size:]
            new += inner
            np.tanh(new, out=new)
            state -= new
            state *= gates[:size]
            state += new
            if scores is not None:
                np.matmul(self.out, state, out=scores[t])
        return state


def read(d: Direction, out: np.ndarray, data: np.ndarray, bounds: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One direction's part of the scores (classes, bytes) of texts laid end to end, and the state after the last byte.

    bounds: places of the texts, with none empty; ``start``: the state before the first text (zero if not given).
    """
    reader, n = _Reader(d, out), len(data)
    pieces = -(-np.diff(bounds) // WINDOW)
    text = np.repeat(np.arange(len(pieces)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = bounds[:-1][text] + nth * WINDOW
    size = np.minimum(bounds[1:][text] - at, WINDOW)
    # The state before each window's stretches of CHECK bytes; the last is the one after the window.
    marks = -(-size // CHECK)
    states = np.zeros((WINDOW // CHECK + 1, reader.size, len(at)), np.float32)
    if start is not None:
        states[0, :, 0] = start
    part = np.empty((len(out), n + 1), np.float32)  # what is read past a text's end goes to the last place

    def forward(own: np.ndarray, mark: int) -> None:
        """Reads stretch ``mark`` of these windows; the state after a stretch that ends early is of no use."""
        for cut in range(0, len(own), BESIDE):
            some = own[cut : cut + BESIDE]
            place, left = at[some] + mark * CHECK, size[some] - mark * CHECK
            place = place[:, None] + np.arange(min(int(left.max()), CHECK))
            scores = np.empty((place.shape[1], len(out), len(some)), np.float32)
            byte = data[np.minimum(place.T, n - 1)].astype(np.intp)
            states[mark + 1][:, some] = reader.run(byte, states[mark][:, some], scores)
            if left.min() < place.shape[1]:
                place[np.arange(place.shape[1]) >= left[:, None]] = n
            part[:, place] = scores.transpose(1, 2, 0)

    later = np.flatnonzero(nth > 0)
    for cut in range(0, len(later), BESIDE):
        own = later[cut : cut + BESIDE]
        byte = data[at[own] - WARM + np.arange(WARM)[:, None]].astype(np.intp)
        states[0][:, own] = reader.run(byte, np.zeros((reader.size, len(own)), np.float32))
    for mark in range(WINDOW // CHECK):
        forward(np.flatnonzero(size > mark * CHECK), mark)
    last = states[marks, :, np.arange(len(at))].T
    while True:
        off = later[np.abs(states[0][:, later] - last[:, later - 1]).max(axis=0, initial=0) > CLOSE]
        if not len(off):
            break
        states[0][:, off] = last[:, off - 1]
        mark = 0
        while len(off):
            before = states[mark + 1][:, off]
            forward(off, mark)
            # What follows stands where the state is again the one that it was read from.
            moved = np.abs(states[mark + 1][:, off] - before).max(axis=0) > CLOSE
            ended = marks[off] == mark + 1
            last[:, off[ended]] = states[mark + 1][:, off[ended]]
            off = off[moved & ~ended]
            mark += 1
    rest = int(size[-1]) % CHECK
    end = last[:, -1]
    if rest:
        end = reader.run(data[n - rest :, None].astype(np.intp), states[marks[-1] - 1][:, -1:])[:, 0]
    return part[:, :n], end


def _summed(m: Model, ahead: np.ndarray, back: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Probabilities of all positions, added up from each start to the next: (classes, starts)."""
    score = ahead + back
    score += m.bias
    score -= score.max(axis=0)
    np.exp(score, out=score)
    score /= score.sum(axis=0)
    return np.add.reduceat(score, starts, axis=1, dtype=np.float64)


def pooled(m: Model, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, classes): each text's mean distribution over its bytes; of empty texts zero."""
    data = _FOLD[data]
    size = np.diff(bounds)
    total = np.zeros((len(size), len(m.bias)))
    full = np.flatnonzero(size)
    if len(full) == 1 and len(data) > LONG:
        total[full[0]] = _of_long(m, data)
    elif len(full):
        cut = np.append(bounds[:-1][full], len(data))
        ahead, _ = read(m.forward, m.out[0], data, cut)
        back, _ = read(m.backward, m.out[1], data[::-1], len(data) - cut[::-1])
        total[full] = _summed(m, ahead, back[:, ::-1], cut[:-1]).T
    return total / np.maximum(size, 1)[:, None]


def _of_long(m: Model, data: np.ndarray) -> np.ndarray:
    """The sum over one long text, piece by piece: the states from behind first, then forward along the pieces."""
    pieces = [(a, min(a + LONG, len(data))) for a in range(0, len(data), LONG)]
    behind: list[np.ndarray | None] = [None]
    for a, b in reversed(pieces[1:]):
        behind.append(read(m.backward, m.out[1], data[a:b][::-1], np.array([0, b - a]), behind[-1])[1])
    total, state = np.zeros(len(m.bias)), None
    for (a, b), after in zip(pieces, reversed(behind), strict=True):
        whole = np.array([0, b - a])
        ahead, state = read(m.forward, m.out[0], data[a:b], whole, state)
        back, _ = read(m.backward, m.out[1], data[a:b][::-1], whole, after)
        total += _summed(m, ahead, back[:, ::-1], whole[:1])[:, 0]
    return total


def predict(m: Model | None, texts: pa.Array) -> pa.Array:
    """struct<lang, score, share> of every text with a byte; else nulls. share: of all languages together."""
    offs, raw = text_buffers(texts)
    names, scores, shares = [], [], []
    for at, to in blocks(offs, BLOCK):
        if m is None:
            mean = np.zeros((to - at, 1))
        else:
            # What stands beside a text in its block moves its last digits.
            mean = pooled(m, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]).round(6)
        for n, row in zip(np.diff(offs[at : to + 1]), mean, strict=True):
            best = int(row[:-1].argmax()) if n and m is not None else None
            names.append(None if best is None else m.languages[best])
            scores.append(None if best is None else min(1.0, float(row[best])))
            shares.append(None if best is None else min(1.0, float(row[:-1].sum())))
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())], ["lang", "score", "share"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, bounds: TrainingBounds = TrainingBounds()) -> Model | None:
    """A model from labelled rows that are not held out; only the bounded sample's stretches reach the driver."""
    plain, of = numbered(docs)
    known = plain.select(F.col(of("doc_id")).alias("doc_id"), F.col(of("text")).alias("text"), F.col(of("lang")).alias("lang"))
    known = known.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = hash_sample(known, F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), bounds.rows)
    raw = rows.select("doc_id", "lang", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary").alias("raw"))
    places = F.sequence(F.lit(1), F.octet_length("raw"), F.lit(bounds.span))
    cut = raw.filter(F.octet_length("raw") > 0).select("doc_id", "lang", F.posexplode(F.transform(places, lambda p: F.substring(F.col("raw"), p, F.lit(bounds.span)))).alias("nth", "part"))
    # Of each language as many stretches as of any other, so that a rare one is not crowded out.
    counts = {r["lang"]: r["count"] for r in cut.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = bounds.spans // len(counts)
    spans: list[tuple[str, bytes]] = []
    for lang in sorted(counts):
        taken = cut.filter(F.col("lang") == lang).orderBy(F.xxhash64("part", "doc_id", "nth"), "part").limit(share)
        spans += [(lang, bytes(r["part"])) for r in taken.select("part").collect()]
    return train(spans, bounds)


def found(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``df`` (whose columns cannot clash) with ``_lang``, ``_score`` and ``_share``: what all languages together have."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(FOUND)
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return released(predict(sent.value, texts) for texts in batches)

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    out = df.withColumn("_found", label(F.col(text_col)))
    told = letters & F.col("_found.lang").isNotNull()
    return out.withColumns(
        {
            "_lang": F.when(told, F.col("_found.lang")).otherwise(F.lit("und")),
            "_score": F.when(told, F.col("_found.score")).otherwise(F.lit(0.0)),
            "_share": F.when(told, F.col("_found.share")).otherwise(F.lit(0.0)),
        }
    ).drop("_found")


def identify(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (that language's probability) and ``language_share`` (all languages')."""
    plain, of = numbered(df)
    out = found(plain, model, of(text_col))
    return with_results(out.toDF(*df.columns, "_lang_", "_score_", "_share_"), ["lang_pred", "score", "language_share"], ["_lang_", "_score_", "_share_"])


def language_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, language_share of every row."""
    model = fit(docs)
    plain, of = numbered(docs)
    narrow = plain.select(F.col(of("doc_id")).cast("long").alias("doc_id"), F.col(of("text")).alias("text"))
    return found(narrow, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_share").alias("language_share"))


def keep_identified(docs: DataFrame, least: float) -> DataFrame:
    """``docs`` without those that are in no language: ``und``, or with a mean probability under ``least`` for all learned
    languages together. Text that mixes learned languages stays. Columns of any name are returned as they came."""
    plain, of = numbered(docs)
    kept = found(plain, fit(docs), of("text")).filter((F.col("_share") >= least) & (F.col("_lang") != "und"))
    return kept.select(*plain.columns).toDF(*docs.columns)
