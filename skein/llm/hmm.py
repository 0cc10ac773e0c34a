"""A hidden Markov language model over the words of whole documents.

A token is a lower-cased word or a document's end. The corpus is counted in full: every training token's count lives in a
table keyed by the word. The HOT most frequent words are symbols of their own; every other word is emitted in two steps,
first its class (its last bytes), by the state, then the word by its count within the class, plus one, so that a word
never seen has a probability too. The second step does not depend on the state; it is added by a join on the count
table, and the chain itself works on a bounded alphabet.

Training is Baum-Welch over all training documents, from the corpus's counts, each state's drawn a little apart at random.
In a pass each task adds up the expected counts of its documents and sends those of the symbols it saw; their sums, which
do not grow with the data, make the next parameters. Passes end when one gains less than ``Size.settled`` on the
likelihood of a token. Documents are never cut: to run the pieces of a long one side by side, a piece starts from messages
that have read WARM tokens beyond its ends, and it is run again from its neighbours' messages where these differ by more
than CLOSE, until all agree. Scoring is the scaled forward recursion over whole documents, token by token.

Cases: a null text counts as empty; an empty text is its end alone. A null id is not held out. With nothing to learn from
(an empty table, or all rows held out) all counts are 0 and every symbol is equally likely. Words that tie for the last
hot places are taken by key. Repeated rows are counted and scored one by one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.memory import released
from skein.llm.names import chosen
from skein.llm.words import Words, blocks, text_buffers
from skein.scratch import written

#: Tokens of a piece, of its warm-up on either side and between checks; how far messages may be apart where pieces meet.
PIECE, WARM, CHECK, CLOSE = 512, 48, 16, 1e-4
#: Tokens a partition counts before it sends them on; tokens of a block in training and in scoring.
COUNT_BLOCK, TRAIN_BLOCK, SCORE_BLOCK = 1 << 21, 1 << 19, 1 << 22
#: Expected counts travel in this many parts, so that as many tasks add them up. A pass has at most PASS_TASKS tasks (and
#: three for every core), so that what they send does not grow with the number of partitions.
PARTS, PASS_TASKS = 32, 4096


@dataclass(frozen=True)
class Size:
    states: int = 8
    hot: int = 60_000
    classes: int = 2048
    least_hot: int = 4
    #: Training ends when a pass raises the log10 likelihood of a token by less.
    settled: float = 0.002
    prior: float = 500.0

    @property
    def symbols(self) -> int:
        return self.hot + self.classes + 1

    @property
    def end(self) -> int:
        return self.hot + self.classes


@dataclass(frozen=True)
class Lexicon:
    """Hot keys ascending with their symbols and counts; per class the tokens and types that are not hot; totals."""

    keys: np.ndarray
    symbols: np.ndarray
    counts: np.ndarray
    class_tokens: np.ndarray
    class_types: np.ndarray
    ends: int
    tokens: int
    types: int

    def frequency(self, size: Size) -> np.ndarray:
        """Each symbol's training count."""
        out = np.zeros(size.symbols)
        out[self.symbols] = self.counts
        out[size.hot : size.end] = self.class_tokens
        out[size.end] = self.ends
        return out


@dataclass(frozen=True)
class Chain:
    """Start of a document (K), transitions (K, K), emissions (symbols, K)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_classes(words: Words, classes: int) -> np.ndarray:
    """A class from the last three bytes of each word, lower-cased."""
    fold = np.arange(256, dtype=np.int64)
    fold[65:91] += 32
    code = np.zeros(len(words.start), np.int64)
    for back in (1, 2, 3):
        at = words.end - back
        code = code * 257 + np.where(at >= words.start, fold[words.data[np.maximum(at, 0)]] + 1, 0) if len(words.data) else code
    return (code * 2654435761 >> 7) % classes


def _counted(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[pa.RecordBatch]:
    """(held_out, text) to (key, class, n) of the tokens of training rows, counted by block."""
    keys: list[np.ndarray] = []
    groups: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if keys:
            key, at, n = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
            group = np.concatenate(groups)[at]
            keys.clear()
            groups.clear()
            for a in range(0, len(key), 1 << 16):
                cut = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(key[cut].view(np.int64)), pa.array(group[cut].astype(np.int16)), pa.array(n[cut])], ["key", "class", "n"])

    for batch in batches:
        offs, raw = text_buffers(batch.column(1).filter(pc.invert(batch.column(0))))
        for at, to in blocks(offs):
            words = Words(offs, raw, at, to)
            keys.append(words.key)
            groups.append(word_classes(words, classes))
            if sum(map(len, keys)) >= COUNT_BLOCK:
                yield from flush()
    yield from flush()


def count_words(docs: DataFrame, size: Size) -> DataFrame:
    """key, class, n: every training word with its count."""
    rows = docs.select(held_out(F.col("doc_id")).alias("held_out"), "text")
    parts = rows.mapInArrow(partial(_counted, classes=size.classes), "key long, class short, n long")
    return written(parts.groupBy("key").agg(F.first("class").alias("class"), F.sum("n").alias("n")), "counts")


def lexicon(counts: DataFrame, ends: int, size: Size) -> Lexicon:
    # The least count that may be hot, from a histogram in steps of a 64th of a doubling: no partition then sends more
    # than its part of the hot words.
    step = F.floor(F.log2("n") * 64).alias("step")
    above, least = 0, 0
    for r in counts.filter(F.col("n") >= size.least_hot).groupBy(step).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        above, least = above + r["words"], r["least"]
        if above >= size.hot:
            break
    hot = counts.filter(F.col("n") >= max(least, size.least_hot)).orderBy(F.desc("n"), "key").limit(size.hot).collect()
    by_class = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()
    tokens, types = np.zeros(size.classes, np.int64), np.zeros(size.classes, np.int64)
    for r in by_class:
        tokens[r["class"]], types[r["class"]] = r["n"], r["types"]
    total, kinds = int(tokens.sum()) + ends, int(types.sum()) + (ends > 0)
    for r in hot:
        tokens[r["class"]] -= r["n"]
        types[r["class"]] -= 1
    keys = np.array([r["key"] for r in hot], np.int64).view(np.uint64)
    order = np.argsort(keys)
    n = np.array([r["n"] for r in hot], np.int64)
    return Lexicon(keys[order], order.astype(np.int64), n[order], tokens, types, ends, total, kinds)


def _coded(batches: Iterator[pa.RecordBatch], sent, size: Size) -> Iterator[pa.RecordBatch]:
    """(doc_id, held_out, text) to symbols and what of the base score needs no join."""
    lex: Lexicon = sent.value
    log_end = np.log10(lex.ends + 1)
    for batch in batches:
        offs, raw = text_buffers(batch.column(2))
        for at, to in blocks(offs):
            words = Words(offs, raw, at, to)
            place = np.searchsorted(lex.keys, words.key)
            place[place == len(lex.keys)] = 0
            hot = lex.keys[place] == words.key if len(lex.keys) else np.zeros(len(words.key), bool)
            symbol = size.hot + word_classes(words, size.classes)
            symbol[hot] = lex.symbols[place[hot]]
            rows = words.rows
            full = np.full(len(symbol) + rows, size.end, np.uint16)
            full[np.arange(len(symbol)) + words.row] = symbol
            cut = np.concatenate([[0], np.cumsum(words.counts + 1)])
            part = np.bincount(words.row[hot], np.log10(lex.counts[place[hot]] + 1), rows) + log_end
            known = np.bincount(words.row[hot], minlength=rows) + (lex.ends > 0)
            rare = words.key[~hot].view(np.int64)
            rare_cut = np.concatenate([[0], np.cumsum(np.bincount(words.row[~hot], minlength=rows))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, to - at),
                    batch.column(1).slice(at, to - at),
                    pa.array((words.counts + 1).astype(np.int64)),
                    pa.array(known.astype(np.int64)),
                    pa.array(part),
                    pa.array([full[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(rare_cut, pa.int32()), pa.array(rare)),
                ],
                ["doc_id", "held_out", "n_tokens", "known", "part", "symbols", "rare"],
            )


CODED = "doc_id long, held_out boolean, n_tokens long, known long, part double, symbols binary, rare array<long>"


class Ragged:
    """Sequences laid one after another in ``data``; ``order`` sorts them by length, the longest first."""

    def __init__(self, sequences: list[np.ndarray]):
        self.length = np.array([len(s) for s in sequences])
        self.order = np.argsort(-self.length, kind="stable")
        self.data = np.concatenate(sequences).astype(np.int64)
        starts = np.cumsum(self.length) - self.length
        self.start, self.length = starts[self.order], self.length[self.order]
        steps = int(self.length[0])
        # How many sequences reach step t.
        self.active = np.searchsorted(-self.length, -np.arange(steps), "left")

    def symbols(self, t: int) -> np.ndarray:
        return self.data[self.start[: self.active[t]] + t]


def log_likelihoods(chain: Chain, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of each sequence's probability: the forward recursion, scaled at every step."""
    ragged = Ragged(sequences)
    total = np.zeros(len(sequences))
    emit, move = np.ascontiguousarray(chain.emit.T), np.ascontiguousarray(chain.move.T)
    ahead = np.tile(chain.start[:, None], (1, len(sequences)))
    for t, n in enumerate(ragged.active):
        seen = emit.take(ragged.symbols(t), axis=1)
        seen *= ahead[:, :n]
        scale = seen.sum(axis=0)
        seen /= scale
        total[:n] += np.log10(scale)
        ahead = move @ seen
    out = np.empty(len(sequences))
    out[ragged.order] = total
    return out


@dataclass(frozen=True)
class Expected:
    """Expected starts (K) and moves (K, K), the symbols seen with their expected emissions (seen, K), log10 likelihood."""

    starts: np.ndarray
    moves: np.ndarray
    symbols: np.ndarray
    emissions: np.ndarray
    likelihood: float


def expected_counts(chain: Chain, sequences: list[np.ndarray]) -> Expected:
    """The expectation step over whole sequences, whose pieces are run side by side.

    Tables are (states, tokens), the tokens of one step of all pieces together and the longest pieces first, so that a step
    works on one stretch of every table.
    """
    size = np.array([len(s) for s in sequences])
    data = np.concatenate(sequences).astype(np.intp)
    begin = np.cumsum(size) - size
    start, move, emit = chain.start.astype(np.float32), chain.move.astype(np.float32), np.ascontiguousarray(chain.emit.T, np.float32)
    ahead_move, states = np.ascontiguousarray(move.T), len(start)
    pieces = -(-size // PIECE)
    of = np.repeat(np.arange(len(size)), pieces)
    at = begin[of] + (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
    length = np.minimum(at + PIECE, (begin + size)[of]) - at
    order = np.argsort(-length, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    steps = int(length.max())
    active = np.searchsorted(-length[order], -np.arange(steps), "left")
    first = np.concatenate([[0], np.cumsum(active)])
    later = np.flatnonzero(at > begin[of])
    symbol, sorted_at = np.empty(len(data), np.intp), at[order]
    for t, n in enumerate(active):
        symbol[first[t] : first[t + 1]] = data[sorted_at[:n] + t]
    seen_as = emit.take(symbol, axis=1)
    filtered, scales, behind = np.empty_like(seen_as), np.empty(len(data), np.float32), np.empty_like(seen_as)

    def forward(predicted: np.ndarray, ranks: np.ndarray | None = None) -> None:
        """Filters all pieces, or some (ascending ranks) until their states are again those that are there."""
        for t in range(steps):
            n = int(active[t] if ranks is None else np.searchsorted(ranks, active[t]))
            if not n:
                break
            now = slice(first[t], first[t] + n) if ranks is None else first[t] + ranks[:n]
            ahead = seen_as[:, now] * predicted[:, :n]
            scale = ahead.sum(axis=0)
            ahead /= scale
            moved = None
            if ranks is not None and t % CHECK == CHECK - 1:
                moved = np.abs(ahead - filtered[:, now]).max(axis=0) > CLOSE
            filtered[:, now], scales[now] = ahead, scale
            if moved is not None:
                ranks, ahead = ranks[:n][moved], ahead[:, moved]
            predicted = ahead_move @ ahead

    def backward(after: np.ndarray, ranks: np.ndarray | None = None) -> None:
        """What follows each token says of its states, from what is known behind the pieces; as in ``forward``."""
        known = after[:, :0]
        for t in range(steps - 1, -1, -1):
            n = int(active[t] if ranks is None else np.searchsorted(ranks, active[t]))
            if not n:
                continue
            now = slice(first[t], first[t] + n) if ranks is None else first[t] + ranks[:n]
            if n > known.shape[1]:
                known = np.concatenate([known, after[:, known.shape[1] : n]], axis=1)
            moved = None
            if ranks is not None and t % CHECK == 0:
                moved = (np.abs(known - behind[:, now]) > CLOSE * np.maximum(1, np.abs(known))).any(axis=0)
            behind[:, now] = known
            if moved is not None:
                stay = np.concatenate([moved, np.ones(len(ranks) - n, bool)])
                ranks, after, known, now = ranks[stay], after[:, stay], known[:, moved], now[moved]
            into = seen_as[:, now] * known
            into /= scales[now]
            known = move @ into

    predicted = np.tile(start[:, None], (1, len(at)))
    if len(later):
        warm = np.full((states, len(later)), 1 / states, np.float32)
        for t in range(WARM):
            warm *= emit.take(data[at[later] - WARM + t], axis=1)
            warm /= warm.sum(axis=0)
            warm = ahead_move @ warm
        predicted[:, rank[later]] = warm
    forward(predicted)
    before, opening = first[PIECE - 1] + rank[later - 1] if len(later) else later, rank[later]
    while len(later):
        carried = ahead_move @ filtered[:, before]
        off = np.abs(carried - predicted[:, opening]).max(axis=0) > CLOSE
        if not off.any():
            break
        predicted[:, opening[off]] = carried[:, off]
        again = np.sort(opening[off])
        forward(predicted[:, again], again)

    def passed(known: np.ndarray) -> np.ndarray:
        """From what is known at the openings of later pieces to what is known behind the pieces before them, such that the
        products with their states add up to 1."""
        known = move @ (seen_as[:, opening] * known / scales[opening])
        return known / (known * filtered[:, before]).sum(axis=0)

    after = np.ones((states, len(at)), np.float32)
    if len(later):
        reach, known = np.minimum(WARM, length[later]), np.ones((states, len(later)), np.float32)
        for t in range(int(reach.max()) - 1, 0, -1):
            own = np.flatnonzero(reach > t)
            now = first[t] + opening[own]
            known[:, own] = move @ (seen_as[:, now] * known[:, own] / scales[now])
        after[:, rank[later - 1]] = passed(known)
    backward(after)
    while len(later):
        carried, had = passed(behind[:, opening]), after[:, rank[later - 1]]
        off = (np.abs(carried - had) > CLOSE * np.maximum(1, np.abs(carried))).any(axis=0)
        if not off.any():
            break
        again = rank[later - 1][off]
        after[:, again] = carried[:, off]
        again = np.sort(again)
        backward(after[:, again], again)
    seen_as *= behind
    seen_as /= scales
    moves = np.zeros((states, states))
    for t in range(1, steps):
        moves += filtered[:, first[t - 1] : first[t - 1] + active[t]] @ seen_as[:, first[t] : first[t + 1]].T
    if len(later):
        moves += filtered[:, before] @ seen_as[:, opening].T
    behind *= filtered
    seen = np.flatnonzero(np.bincount(symbol))
    emissions = np.stack([np.bincount(symbol, of_state)[seen] for of_state in behind], axis=1)
    starts = behind[:, rank[np.flatnonzero(at == begin[of])]].sum(axis=1, dtype=np.float64)
    return Expected(starts, moves * chain.move, seen, emissions, float(np.log10(scales).sum(dtype=np.float64)))


def renewed(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, frequency: np.ndarray, prior: float) -> Chain:
    """The chain that best fits the expected counts, drawn to the corpus by ``prior`` tokens a state."""
    usual = (frequency + 0.5) / (frequency + 0.5).sum()
    emit = (emissions + prior * usual[:, None]) / (emissions.sum(axis=0) + prior)
    return Chain((starts + 1) / (starts + 1).sum(), (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), emit)


def first_chain(frequency: np.ndarray, size: Size, seed: int = 11) -> Chain:
    """States that tend to stay, with the corpus's frequencies, each drawn a little apart at random."""
    usual = (frequency + 0.5) / (frequency + 0.5).sum()
    k = size.states
    move = np.full((k, k), 0.1 / max(k - 1, 1))
    np.fill_diagonal(move, 0.9 if k > 1 else 1.0)
    emit = usual[:, None] * np.exp(np.random.default_rng(seed).normal(0, 0.7, (len(usual), k)))
    return Chain(np.full(k, 1 / k), move, emit / emit.sum(axis=0))


SUMS = "part int, symbols binary, sums binary"


def _sums(part: int, symbols: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([symbols.astype(np.int32).tobytes()], pa.binary()), pa.array([sums.astype(np.float64).tobytes()], pa.binary())], ["part", "symbols", "sums"])


def _expected(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """(symbols) to the task's expected counts: (part, symbols, sums), each symbol in the part that its number names; part -1
    has the starts, the moves, the likelihood and the number of tokens."""
    chain: Chain = sent.value
    emissions, seen = np.zeros_like(chain.emit), np.zeros(len(chain.emit), bool)
    rest = np.zeros(chain.start.size + chain.move.size + 2)
    waiting: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        got = expected_counts(chain, waiting)
        emissions[got.symbols] += got.emissions
        seen[got.symbols] = True
        rest[:] += np.concatenate([got.starts, got.moves.ravel(), [got.likelihood, held]])
        waiting.clear()

    for batch in batches:
        for blob in batch.column(0):
            waiting.append(np.frombuffer(blob.as_buffer(), np.uint16))
            held += len(waiting[-1])
            if held >= TRAIN_BLOCK:
                flush()
                held = 0
    if waiting:
        flush()
    if rest[-1]:
        found = np.flatnonzero(seen)
        for part in range(PARTS):
            own = found[found % PARTS == part]
            yield _sums(part, own, emissions[own])
        yield _sums(-1, np.zeros(0), rest)


def _added(batches: Iterator[pa.RecordBatch], symbols: int, states: int) -> Iterator[pa.RecordBatch]:
    """Adds up what was sent of each part."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, which, sums in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            values = np.frombuffer(sums, np.float64)
            if part < 0:
                total[part] = total.get(part, 0) + values
            else:
                into = total.setdefault(part, np.zeros((-(-symbols // PARTS), states)))
                into[np.frombuffer(which, np.int32) // PARTS] += values.reshape(-1, states)
    for part, values in total.items():
        own = np.flatnonzero(values.any(axis=1)) if part >= 0 else np.zeros(0)
        yield _sums(part, own * PARTS + part, values[own] if part >= 0 else values)


def baum_welch_pass(coded: DataFrame, chain: Chain, frequency: np.ndarray, size: Size) -> tuple[Chain, float]:
    """One pass over all training documents: the next chain, and the log10 likelihood of a token under this one."""
    context = coded.sparkSession.sparkContext
    sent = context.broadcast(chain)
    tasks = min(PASS_TASKS, 3 * context.defaultParallelism)
    parts = coded.filter("NOT held_out").select("symbols").coalesce(tasks).mapInArrow(lambda b: released(_expected(b, sent)), SUMS)
    rows = parts.repartition(PARTS, "part").mapInArrow(partial(_added, symbols=size.symbols, states=size.states), SUMS).collect()
    sent.unpersist()
    emissions, rest = np.zeros((size.symbols, size.states)), None
    for r in rows:
        values = np.frombuffer(r["sums"], np.float64)
        if r["part"] < 0:
            rest = values
        else:
            emissions[np.frombuffer(r["symbols"], np.int32)] = values.reshape(-1, size.states)
    if rest is None:
        return chain, 0.0
    starts, moves, (likelihood, tokens) = np.split(rest, [size.states, size.states * (size.states + 1)])
    return renewed(starts, moves.reshape(size.states, -1), emissions, frequency, size.prior), likelihood / tokens


def trained(coded: DataFrame, frequency: np.ndarray, size: Size) -> Chain:
    """Passes until one gains less than ``size.settled`` on the likelihood of a token. What a pass can gain is bounded by
    the likelihood itself, so they end."""
    chain, before = first_chain(frequency, size), -np.inf
    while True:
        after, likelihood = baum_welch_pass(coded, chain, frequency, size)
        if likelihood - before < size.settled:
            return after
        chain, before = after, likelihood


def _scored(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """(uid, symbols) to (uid, chain), the log10 likelihood of the symbols (and of classes' words but for their counts)."""
    chain: Chain = sent.value
    ids: list[int] = []
    waiting: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(log_likelihoods(chain, waiting))], ["uid", "chain"])
        ids.clear()
        waiting.clear()
        return out

    for batch in batches:
        for uid, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(uid)
            waiting.append(np.frombuffer(blob, np.uint16))
            held += len(waiting[-1])
            if held >= SCORE_BLOCK:
                yield flush()
                held = 0
    if waiting:
        yield flush()


def score_documents(docs: DataFrame, size: Size = Size()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    if size.symbols > 1 << 16:
        raise ValueError("symbols must fit 16 bits")
    spark = docs.sparkSession
    narrow = chosen(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = count_words(narrow, size)
    ends = narrow.filter(~held_out(F.col("doc_id"))).count()
    lex = lexicon(counts, ends, size)
    frequency = lex.frequency(size)
    sent = spark.sparkContext.broadcast(lex)
    rows = narrow.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    coded = rows.mapInArrow(partial(_coded, sent=sent, size=size), CODED).withColumn("uid", F.monotonically_increasing_id())
    coded = written(coded, "coded")
    chain = trained(coded, frequency, size)
    emit = chain.emit.copy()
    emit[size.hot : size.end] /= (lex.class_tokens + lex.class_types + 1)[:, None]
    final = spark.sparkContext.broadcast(Chain(chain.start, chain.move, emit))
    scored = coded.select("uid", "symbols").mapInArrow(partial(_scored, sent=final), "uid long, chain double")
    # Words outside the hot ones: a word that was never counted adds nothing, so the join is inner.
    rare = coded.select("uid", F.explode("rare").alias("key")).join(counts.select("key", "n"), "key")
    rare = rare.groupBy("uid").agg(F.sum(F.log10(F.col("n") + 1)).alias("rare_part"), F.count("*").alias("rare_known"))
    out = coded.select("uid", "doc_id", "held_out", "n_tokens", "known", "part").join(scored, "uid").join(rare, "uid", "left")
    rare_part = F.coalesce("rare_part", F.lit(0.0))
    usual = F.lit(float(np.log10(lex.tokens + lex.types + 1)))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("part") + rare_part - F.col("n_tokens") * usual).alias("base_score"),
        (F.col("chain") + rare_part).alias("score"),
    )
