"""Language-model scoring with a hidden Markov model over word classes.

Tokens are a text's words, A-Z in lower case, and one end. Word counts of all training documents are
gathered by a Spark exchange (see sluice.llm.exchange). The most frequent words are classes of their
own; every other word is in the class of its last three bytes, hashed. Latent states emit classes,
and a class emits its words by their smoothed share, an unknown word included, so the model is a
distribution over all token sequences that end.

States are trained by Baum-Welch from a seeded random model over the corpus's class shares, in `rounds`
rounds over all training documents: their classes are written once, every task sums expected counts
over its chunks, and Spark adds the tasks' sums in two levels. Training and scoring take whole texts:
one start for each, every move counted, scaled recursions from its first token to its last. A text of
more than SEGMENT tokens is cut for speed alone: the inner cuts' transfer matrices are made side by side,
multiplied along the text forwards and backwards, and give every cut the vectors that the recursions
would have brought there; of a first or last cut one vector is enough.

Results in special cases: null and empty texts are the end token alone; without training documents
all classes are as likely, and words' shares are those of an unknown word; repeated rows count as
often as they occur; a null doc_id stays null. A text is one value of a chunk, so it may have 2 GB at
most. Words count as equal if 86 bits of their hash and their endings are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.exchange import Chunk, ChunkTable, Keys, totals
from sluice.llm.shared import keep_written, scratch, written
from sluice.llm.words import words_of

STATES = 8
#: Words that are classes of their own, and classes of the rest (a power of two).
FREQUENT, REST_BITS = 4096, 10
ROUNDS = 6
#: Tokens of a cut of a long text, and tokens that go through a recursion side by side.
SEGMENT, TOKENS = 1024, 1 << 17
#: Bytes of classes, of several chunks, that a training round takes at a time.
TOGETHER = 2 << 20
#: Groups in which tasks' sums are added first.
GROUPS = 64
NO_ID = -(1 << 63)
END = np.uint64(0x8F1BBCDC5A827999)
_LOW = np.uint64((1 << REST_BITS) - 1)


def token_keys(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token a hash and more bits of it, the lowest of which are the class of its ending; texts end to end; and the n + 1 places where texts begin."""
    w = words_of(c.offsets, c.raw, lower=True, lanes=2)
    tail = np.zeros(len(w.start), np.uint64)
    for k in (1, 2, 3):
        at = w.end - k
        byte = c.raw[np.maximum(at, 0)].astype(np.uint64)
        byte = np.where((byte >= 65) & (byte <= 90), byte + np.uint64(32), byte)
        tail = tail * np.uint64(257) + np.where(at >= w.start, byte, np.uint64(0))
    tail = (tail * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - REST_BITS)
    more = ((w.other >> np.uint64(32 + REST_BITS)) << np.uint64(REST_BITS) | tail).astype(np.uint32)
    first = w.first + np.arange(len(w.first))
    out, low = np.full(int(first[-1]), END, np.uint64), np.full(int(first[-1]), END & np.uint64(0xFFFFFFFF), np.uint32)
    spot = np.ones(len(out), bool)
    spot[first[1:] - 1] = False
    out[spot], low[spot] = w.hash, more
    return out, low, first


class Vocabulary:
    """Sizes of the training text, its frequent keys (sorted), and the number of keys and tokens of each class."""

    def __init__(self, tokens: int, distinct: int, frequent: np.ndarray, frequent_counts: np.ndarray, frequent_low: np.ndarray, low_keys: np.ndarray, low_tokens: np.ndarray):
        self.tokens, self.distinct = tokens, distinct
        order = np.argsort(frequent)
        self.frequent = frequent[order]
        own = frequent_counts[order]
        low = frequent_low[order] & int(_LOW)
        self.class_keys = np.concatenate([np.ones(len(own), np.int64), low_keys - np.bincount(low, minlength=len(low_keys))])
        self.class_tokens = np.concatenate([own, low_tokens - np.bincount(low, own, minlength=len(low_tokens)).astype(np.int64)])
        self.classes = len(self.class_tokens)

    def class_of(self, keys: np.ndarray, low: np.ndarray) -> np.ndarray:
        out = len(self.frequent) + (low & np.uint32(_LOW)).astype(np.int64)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, keys), len(self.frequent) - 1)
            known = self.frequent[at] == keys
            out[known] = at[known]
        return out.astype(np.int32)

    def log_share(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its class; a frequent word is all of its class."""
        n, v = self.class_tokens[classes], self.class_keys[classes]
        share = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))
        return np.where(classes < len(self.frequent), 0.0, share)

    def prior(self) -> np.ndarray:
        p = self.class_tokens + 0.5
        return p / p.sum()


class Hmm:
    """start (states), move (states x states), emit (classes x states: each column sums to 1)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, states: int, prior: np.ndarray, seed: int = 3) -> Hmm:
        rng = np.random.Generator(np.random.PCG64(seed))
        emit = prior[:, None] * rng.uniform(0.3, 1.7, (len(prior), states))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    def expected(self, tokens: np.ndarray, first: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions over whole texts."""
        states = len(self.start)
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((len(self.emit), states))
        room = _room(segment, states)
        for cuts in self._cuts(tokens, first, segment):
            run = _Run(self, tokens, cuts, room)
            run.forward()
            gamma = run.backward(move)
            start += gamma[: len(cuts.begin)][cuts.opens].sum(axis=0)
            if cuts.inner.any():
                move += cuts.left[cuts.inner].T @ cuts.right[cuts.inner]
            for s in range(states):
                emit[:, s] += np.bincount(run.tokens, gamma[:, s], minlength=len(emit))
        move *= self.move
        return start, move, emit

    def _cuts(self, tokens: np.ndarray, first: np.ndarray, segment: int) -> Iterator[Cuts]:
        """The texts in cuts of at most `segment` tokens, some at a time, longest first, with the vectors at their ends."""
        size = np.diff(first)
        per = np.maximum(-(-size // segment), 1)
        text = np.repeat(np.arange(len(size)), per)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        begin = first[:-1][text] + nth * segment
        length = np.minimum(segment, first[1:][text] - begin)
        entry = np.broadcast_to(self.start, (len(text), len(self.start))).copy()
        leave = np.ones_like(entry)
        left, right = np.zeros_like(entry), np.zeros_like(entry)
        cut = np.flatnonzero(per[text] > 1)
        if len(cut):
            self._carry(tokens, cut, begin, length, nth, text, entry, leave, left, right)
        order = np.argsort(-length, kind="stable")
        ends = np.cumsum(length[order])
        at = 0
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS, "right")))
            some = order[at:to]
            yield Cuts(begin[some], length[some], text[some], entry[some], leave[some], nth[some] == 0, (nth[some] > 0), left[some], right[some])
            at = to

    def _carry(self, tokens, cut, begin, length, nth, text, entry, leave, left, right) -> None:
        """Fills in, for the cuts of long texts: entry (the state distribution before its first token is seen), leave (what comes after its last one says of the state there), and left, right (of the move into it)."""
        turned, emit = np.ascontiguousarray(self.move.T), np.ascontiguousarray(self.emit.T)
        last = np.append(nth[1:] == 0, True)
        opens, ends, inner = cut[nth[cut] == 0], cut[last[cut]], cut[(nth[cut] > 0) & ~last[cut]]
        # What a text's first and last cut do is asked of one vector each; the cuts between need their matrices.
        after = self._through(tokens, begin[opens], length[opens], 1, turned, emit, self.start[:, None])[:, 0]
        before = self._through(tokens, begin[ends] + length[ends] - 1, length[ends], -1, self.move, emit, np.ones((len(self.start), 1)))[:, 0]
        through = self._through(tokens, begin[inner], length[inner], 1, turned, emit, np.eye(len(self.start)))
        place = np.empty(len(length), np.int64)
        for some in (opens, ends, inner):
            place[some] = np.arange(len(some))
        for i in cut.tolist():  # in the order of the texts
            if nth[i]:
                left[i] = entry[i - 1] @ through[place[i - 1]] if nth[i - 1] else after[place[i - 1]]
                left[i] /= left[i].sum()
                entry[i] = left[i] @ self.move
        for i in cut[::-1].tolist():
            if nth[i]:
                seen = before[place[i]] if last[i] else through[place[i]] @ leave[i]
                ahead = self.move @ seen
                scale = 1 / float(left[i] @ ahead)  # so that a state's share is left * leave
                leave[i - 1], right[i] = ahead * scale, seen * scale
            # The last cut's own vector is one everywhere: its shares add up to one as they are.

    @staticmethod
    def _through(tokens, at, length, way: int, move, emit, first) -> np.ndarray:
        """What each cut makes of `first` (states x vectors) from its token at `at` on, forwards or backwards, up to a factor: cuts x vectors x states."""
        states = len(first)
        out = np.empty((len(at), *first.shape[::-1]))
        order = np.argsort(-length, kind="stable")
        for i in range(0, len(order), 4096):
            some = order[i : i + 4096]
            spot, k = at[some], len(some)
            # Cuts lie side by side, so that every step runs along them.
            now = first[:, :, None] * emit.take(tokens[spot], axis=1)[:, None, :]
            room = np.empty_like(now)
            live = np.searchsorted(-length[some], -np.arange(int(length[some[0]])), "left").tolist()
            for t in range(1, len(live)):
                if live[t] < k:
                    out[some[live[t] : k]] = now[:, :, live[t] :].transpose(2, 1, 0)
                    k = live[t]
                    now = np.ascontiguousarray(now[:, :, :k])
                    room = np.empty_like(now)
                np.matmul(move, now.reshape(states, -1), out=room.reshape(states, -1))
                np.multiply(room, emit.take(tokens[spot[:k] + way * t], axis=1)[:, None, :], out=room)
                now, room = room, now
                if t % 8 == 0:
                    now /= now.max(axis=(0, 1))
            out[some[:k]] = now.transpose(2, 1, 0)
        return out / out.max(axis=(1, 2), keepdims=True)

    def updated(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Hmm:
        """The model of expected counts, each smoothed by a little of what it would be without any."""
        states = len(start)
        start = start + 1e-3
        move = move + 1e-2
        emit = emit + prior[:, None] * np.maximum(1.0, 0.01 * emit.sum(axis=0))
        return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)) if states else self

    def log10(self, tokens: np.ndarray, first: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
        """log10 probability of each whole text's classes."""
        out = np.zeros(len(first) - 1)
        room = _room(segment, len(self.start))
        for cuts in self._cuts(tokens, first, segment):
            run = _Run(self, tokens, cuts, room)
            run.forward()
            np.add.at(out, cuts.text, np.bincount(run.lane, np.log10(run.scale), minlength=len(cuts.text)))
        return out


@dataclass
class Cuts:
    """Some cuts of texts, longest first: where they begin, their sizes, their texts, the vectors at their ends, whether they begin a text or go on with one, and the vectors of the move into those that go on."""

    begin: np.ndarray
    size: np.ndarray
    text: np.ndarray
    entry: np.ndarray
    leave: np.ndarray
    opens: np.ndarray
    inner: np.ndarray
    left: np.ndarray
    right: np.ndarray


@cache
def _room(segment: int, states: int) -> np.ndarray:
    """A worker's memory for one batch of cuts after the other: fresh pages for each would cost more than the arithmetic."""
    return np.empty((4, max(segment, TOKENS), states))


class _Run:
    """The recursions over some cuts side by side. Its rows are tokens, all cuts' first ones, then all second ones and so on; lane is a token's cut."""

    def __init__(self, model: Hmm, tokens: np.ndarray, cuts: Cuts, room: np.ndarray):
        self.model, self.cuts = model, cuts
        live = np.searchsorted(-cuts.size, -np.arange(int(cuts.size[0])), "left")
        at = np.concatenate([[0], np.cumsum(live)])
        n = int(at[-1])
        self.lane = np.arange(n) - np.repeat(at[:-1], live)
        self.tokens = tokens[cuts.begin[self.lane] + np.repeat(np.arange(len(live)), live)]
        self.live, self.at = live.tolist(), at.tolist()
        self.seen, self.alpha, self.back, self.ahead = (r[:n] for r in room)
        np.take(model.emit, self.tokens, axis=0, out=self.seen, mode="clip")
        self.scale = np.empty(n)

    def forward(self) -> None:
        alpha, seen, scale, move = self.alpha, self.seen, self.scale, self.model.move
        ones = np.ones(len(move))
        for t, k in enumerate(self.live):
            i, j = self.at[t], self.at[t + 1]
            now = alpha[i:j]
            if t:
                np.matmul(alpha[self.at[t - 1] : self.at[t - 1] + k], move, out=now)
                now *= seen[i:j]
            else:
                np.multiply(self.cuts.entry, seen[i:j], out=now)
            sums = np.dot(now, ones, out=scale[i:j])
            now /= sums[:, None]

    def backward(self, counts: np.ndarray) -> np.ndarray:
        """Each token's shares of the states; counts of moves, but for the moves' own probabilities, are added to `counts`."""
        now = self.cuts.leave.copy()
        alpha, seen, back, ahead = self.alpha, self.seen, self.back, self.ahead
        seen /= self.scale[:, None]
        turned = np.ascontiguousarray(self.model.move.T)
        for t in range(len(self.live) - 1, -1, -1):
            i, j, k = self.at[t], self.at[t + 1], self.live[t]
            back[i:j] = now[:k]
            if t:
                row = ahead[i:j]
                np.multiply(now[:k], seen[i:j], out=row)
                counts += alpha[self.at[t - 1] : self.at[t - 1] + k].T @ row
                np.matmul(row, turned, out=now[:k])
        back *= alpha
        return back


def _packed(arrays: tuple[np.ndarray, ...]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays])


def _learnt(table: ChunkTable, vocabulary: Vocabulary) -> DataFrame:
    """(classes, lens): for each chunk the classes of the texts to learn from, end to end, and the texts' sizes."""
    shared = table.spark.sparkContext.broadcast(vocabulary)
    kind = _kind(vocabulary.classes)

    def pick(c: Chunk) -> Iterator[pa.RecordBatch]:
        keys, low, first = token_keys(c)
        size, learn = np.diff(first), c.flags == 1
        if learn.any():
            chosen = np.repeat(learn, size)
            known = Keys.of(keys[chosen], low[chosen])
            yield pa.RecordBatch.from_arrays([pa.array([shared.value.class_of(known.high, known.low).astype(kind)[known.place].tobytes()], pa.binary()), pa.array([size[learn].astype(np.int64).tobytes()], pa.binary())], names=["classes", "lens"])

    out = written(table.map(pick, "classes binary, lens binary"), "learnt")
    shared.unpersist()
    return out


def _kind(classes: int) -> type:
    return np.uint16 if classes <= 1 << 16 else np.int32


def _together(rows: Iterator[tuple[bytes, bytes]]) -> Iterator[tuple[bytes, bytes]]:
    """Rows of _learnt, some chunks' as one: a step of the recursions costs nearly as much for few texts as for many."""
    some: list[tuple[bytes, bytes]] = []
    for row in rows:
        some.append(row)
        if sum(len(tokens) for tokens, _ in some) >= TOGETHER:
            yield b"".join(t for t, _ in some), b"".join(n for _, n in some)
            some = []
    if some:
        yield b"".join(t for t, _ in some), b"".join(n for _, n in some)


def _counts_round(learnt: DataFrame, model: Hmm, vocabulary: Vocabulary) -> Hmm:
    """One Baum-Welch round over the training documents of all chunks."""
    spark = learnt.sparkSession
    states, classes = len(model.start), len(model.emit)
    shared = spark.sparkContext.broadcast(model)
    width, kind = 1 << 13, _kind(classes)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        total = None
        for tokens, lens in _together(row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True)):
            first = np.concatenate([[0], np.cumsum(np.frombuffer(lens, np.int64))])
            got = _packed(model.expected(np.frombuffer(tokens, kind).astype(np.int32), first))
            total = got if total is None else total + got
        if total is not None:
            parts = [total[i : i + width].tobytes() for i in range(0, len(total), width)]
            group = TaskContext.get().partitionId() % GROUPS
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([group] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names=["part", "group", "sums"])

    def add(key, rows):
        sums = sum(np.frombuffer(x) for x in rows.column("sums").to_pylist())
        return pa.table({"part": rows.column("part").slice(0, 1), "group": rows.column("group").slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})

    schema = "part int, group int, sums binary"
    # Tasks' sums are added by group, then the groups'. The model's size is fixed, so is what comes to the driver.
    added = learnt.mapInArrow(expect, schema).groupBy("part", "group").applyInArrow(add, schema).groupBy("part").applyInArrow(add, schema)
    rows = added.collect()
    shared.unpersist()
    if not rows:
        return model
    flat = np.concatenate([np.frombuffer(r["sums"]) for r in sorted(rows, key=lambda r: r["part"])])
    start, move, emit = flat[:states], flat[states : states + states**2].reshape(states, states), flat[states + states**2 :].reshape(classes, states)
    return model.updated(start, move, emit, vocabulary.prior())


_SCORE = "doc_id long, learnt byte, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, learn: Column, states: int = STATES, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """Per row of docs: doc_id, learnt (whether `learn` held), n_tokens, n_known, train_tokens, base_score, score."""
    with scratch(docs.sparkSession):
        return _score(docs, learn, states, rounds, frequent)


def _score(docs: DataFrame, learn: Column, states: int, rounds: int, frequent: int) -> DataFrame:
    spark = docs.sparkSession
    marked = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(learn, F.lit(False)).cast("int").alias("flag"), "text")
    table = ChunkTable(marked, flag=F.col("flag"), chunk_bytes=2 << 20)

    def send(c: Chunk) -> Keys:
        keys, low, first = token_keys(c)
        return Keys.of(keys, low, np.repeat(c.flags == 1, np.diff(first)))

    # As many keys of each range as are certain to hold the most frequent of all: hashes deal them evenly.
    per_range = min(frequent, max(64, 16 * frequent // table.ranges))
    answers = written(totals(table, send, kind=np.int64, top=per_range, low_bits=REST_BITS, low=np.uint32), "counts")
    vocabulary = _vocabulary(answers, frequent)
    prior = vocabulary.prior()
    model = Hmm.first(states, prior)
    learnt = _learnt(table, vocabulary)
    for _ in range(rounds if vocabulary.tokens else 0):
        model = _counts_round(learnt, model, vocabulary)
    shared = spark.sparkContext.broadcast((model, vocabulary))

    def judge(c: Chunk, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        model, v = shared.value
        keys, low, first = token_keys(c)
        known = Keys.of(keys, low)
        each = total.astype(np.float64)
        kinds = v.class_of(known.high, known.low)
        count, classes = each[known.place], kinds[known.place]
        base = np.log10((each + 0.5) / (v.tokens + 0.5 * (v.distinct + 1)))[known.place]
        share = v.log_share(kinds, each)[known.place]
        sums = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else np.zeros(0)
        score = model.log10(classes, first) + sums(share)
        n = np.diff(first)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c.ids), pa.array(c.flags), pa.array(n, pa.int64()), pa.array(sums((count > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(n), v.tokens)), pa.array(sums(base)), pa.array(score)],
            names=["doc_id", "learnt", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return keep_written(table.map_with(answers, judge, _SCORE, kind=np.int64).withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID))), "scores")


def _folded(stats: list[bytes], low: int, frequent: int) -> np.ndarray:
    """Ranges' statistics as one: sums, and the `frequent` most frequent keys of all (a range's keys are its own)."""
    parts = [np.frombuffer(b, np.int64) for b in stats]
    fixed = 2 + 2 * low
    sums = np.sum([p[:fixed] for p in parts], axis=0) if parts else np.zeros(fixed, np.int64)
    columns = [p[fixed:].reshape(3, -1) for p in parts]
    found = np.concatenate(columns, axis=1) if columns else np.zeros((3, 0), np.int64)
    most = np.lexsort((found[0], -found[1]))[:frequent]
    most = most[found[1][most] > 0]
    return np.concatenate([sums, found[:, most].ravel()])


def _vocabulary(answers: DataFrame, frequent: int) -> Vocabulary:
    """Ranges' statistics, folded in groups of ranges, then in groups of those, and then on the driver."""
    low = 1 << REST_BITS

    def fold(key, part):
        return pa.table({"part": part.column("part").slice(0, 1), "stats": pa.array([_folded(part.column("stats").to_pylist(), low, frequent).tobytes()], pa.binary())})

    schema = "part int, stats binary"
    dealt = answers.filter("stats is not null").select((F.col("bucket") % (16 * GROUPS)).alias("part"), "stats")
    once = dealt.groupBy("part").applyInArrow(fold, schema).withColumn("part", F.col("part") % 16)
    rows = once.groupBy("part").applyInArrow(fold, schema).collect()
    s = _folded([r["stats"] for r in rows], low, frequent)
    keys, counts, more = s[2 + 2 * low :].reshape(3, -1)
    return Vocabulary(int(s[1]), int(s[0]), keys.view(np.uint64), counts, more, s[2 : 2 + low], s[2 + low : 2 + 2 * low])
