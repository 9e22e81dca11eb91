"""A hidden Markov language model of words.

Emissions are over word classes.  Every word that makes up ``SHARE`` of the training tokens or more is a
class of its own; the others are dealt by their hash to shared classes of about that mass each, within
which a word has its smoothed share.  How many classes there are thus follows from the counted corpus, and
by that rule it stays below 2 / ``SHARE``.  The word counts behind them cover the whole corpus and are never
gathered in one place: the most frequent words are looked up in the task, the rest by a join.

Baum-Welch runs over all training texts, whole.  Each task adds up the expected counts of its rows, the
sums over tasks are one aggregation, and only the model's parameters reach the driver.  Long texts are
worked on in blocks side by side, exactly: the transfer matrices of the blocks give the forward vector with
which each block begins and the backward vector with which it ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from palimpsest.llm.words import NOT_SPACE, Shared, Texts, U, Words, batches, slices
from palimpsest.scratch import stage

STATES = 8
SHARE = 2.0**-16  # of the training tokens: from here on a word is a class of its own
LOOKUP = 1 << 18  # most frequent words whose counts every task holds: 4 MB
BLOCK = 1024  # tokens of a text worked on in one go
REST = 4  # places between two scalings; a place costs a factor of some 1e-7 at worst
SYMBOLS = 4 << 20  # bytes of symbols in a task at once
BATCH = 2 << 20  # bytes of text in a task at once
END = U(1)  # hash of the end mark
ADD = 0.1
FLUSH = 1 << 22


def runs(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often (or with what weight) they occur."""
    if weights is not None:
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
    else:
        values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    if weights is None:
        return values[first], np.diff(np.append(first, len(values)))
    return values[first], np.add.reduceat(weights, first) if len(first) else weights


def count_words(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        words, n = runs(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    for batch in batches(found, "body", BATCH):
        hashes = Words(Texts(batch.column("body"), lower=True), NOT_SPACE).hashes()
        held += [hashes, np.full(batch.num_rows, END)]
        size += len(hashes) + batch.num_rows
        if size >= FLUSH:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


class Lexicon:
    """Counts of the most frequent words, their classes, and sizes of the shared classes."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, own: int, tokens: int, kinds: int,
                 class_tokens: np.ndarray, class_kinds: np.ndarray):
        rank = np.full(len(words), -1)
        rank[:own] = np.arange(own)
        order = np.argsort(words)
        self.words, self.counts, self.rank = words[order], counts[order], rank[order]
        self.own, self.shared = own, len(class_tokens)
        self.floor = np.log10(tokens + ADD * (kinds + 1))
        self.class_floor = np.log10(class_tokens + ADD * (class_kinds + 1))

    def read(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, and its count (-1: not among those held)."""
        classes = self.own + (hashes % U(self.shared)).astype(np.int64)
        counts = np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        same = self.words[at] == hashes
        counts[same] = self.counts[at[same]]
        own = same & (self.rank[at] >= 0)
        classes[own] = self.rank[at[own]]
        return classes, counts


READ = ("rid bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, share double, within double,"
        " symbols binary, rare array<struct<word: bigint, n: bigint>>")


def read_texts(found: Iterator[pa.RecordBatch], lexicon: Shared) -> Iterator[pa.RecordBatch]:
    """Symbols of each text, the parts of its scores that need no other counts, and its rare words."""
    lex: Lexicon = lexicon.value
    for batch in batches(found, "body", BATCH):
        words = Words(Texts(batch.column("body"), lower=True), NOT_SPACE)
        n = words.count + 1
        first = np.concatenate([[0], np.cumsum(n)])
        hashes = np.full(first[-1], END)
        inside = np.ones(first[-1], bool)
        inside[first[1:] - 1] = False
        hashes[inside] = words.hashes()
        classes, counts = lex.read(hashes)
        held = counts >= 0
        own = classes < lex.own
        gain = np.where(held, np.log10(counts + ADD, where=held, out=np.zeros(len(counts))), 0.0)
        # a word of a shared class has its share of the class; that of an own class is certain
        floor = np.where(own, 0.0, lex.class_floor[np.where(own, 0, classes - lex.own)])
        within = np.where(own, 0.0, gain - floor)
        offsets = pa.py_buffer((first * 4).astype("<i4"))
        symbols = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(classes.astype("<u4"))])
        # rare words, each once a text
        text = np.repeat(np.arange(len(n)), n)[~held]
        word = hashes[~held].view(np.int64)
        order = np.lexsort((word, text))
        text, word = text[order], word[order]
        begin = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (word[1:] != word[:-1])])) if len(word) else np.zeros(0, int)
        times = np.diff(np.append(begin, len(word)))
        pairs = pa.StructArray.from_arrays([pa.array(word[begin]), pa.array(times.astype(np.int64))], ["word", "n"])
        rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[begin], np.arange(len(n) + 1)).astype(np.int32)), pairs)
        add = lambda x: np.add.reduceat(x, first[:-1]) if len(n) else x
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), batch.column("doc_id"), batch.column("held_out"), pa.array(n.astype(np.int64)),
             pa.array(add((counts > 0).astype(np.int64))), pa.array(add(gain - lex.floor)), pa.array(add(within)),
             symbols, rare], names=[x.split()[0] for x in READ.split(", ")[:8]] + ["rare"])


class Blocks:
    """Texts in blocks of at most ``BLOCK`` symbols, the long ones first."""

    def __init__(self, texts: list[np.ndarray]):
        lengths = np.array([len(x) for x in texts], int)
        begin = np.concatenate([[0], np.cumsum(lengths)])
        self.symbols = np.concatenate([*texts, np.zeros(0, "<u4")])
        count = -(-lengths // BLOCK)
        text = np.repeat(np.arange(len(texts)), count)
        at = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * BLOCK
        size = np.minimum(lengths[text] - at, BLOCK)
        order = np.argsort(-size, kind="stable")
        self.text, self.at, self.size = text[order], at[order], size[order]
        self.start, self.first = begin[self.text] + self.at, self.at == 0

    def groups(self) -> Iterator[np.ndarray]:
        """Blocks of like size together, so that tables by place and block are hardly padded."""
        done = 0
        while done < len(self.size):
            end = int(np.searchsorted(-self.size, -(self.size[done] // 2), side="right")) if self.size[done] > 1 else len(self.size)
            yield np.arange(done, max(end, done + 1))
            done = max(end, done + 1)

    def steps(self, which: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """For each place: it, how many of these blocks reach it, and their symbols."""
        size, start = self.size[which], self.start[which]
        live = len(which)
        for t in range(int(size.max(initial=0))):
            while size[live - 1] <= t:
                live -= 1
            yield t, live, self.symbols[start[:live] + t]

    def chains(self) -> list[list[int]]:
        """The blocks of each text that has several, in order."""
        count = np.bincount(self.text) if len(self.text) else np.zeros(0, int)
        many = np.flatnonzero(count[self.text] > 1) if len(count) else np.zeros(0, int)
        many = many[np.lexsort((self.at[many], self.text[many]))]
        cuts = np.flatnonzero(np.diff(self.text[many])) + 1
        return [x.tolist() for x in np.split(many, cuts)] if len(many) else []


class Chain:
    """Parameters: ``start`` (K), ``move`` (K, K) and ``emit`` (classes, K)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit
        self.peak = emit.max(axis=1)
        self.relative = emit / self.peak[:, None]  # so that vectors shrink little from place to place

    def single(self) -> Chain:
        """In single precision: enough for expected counts, not for scores."""
        return Chain(*(x.astype(np.float32) for x in (self.start, self.move, self.emit)))

    @classmethod
    def initial(cls, shares: np.ndarray, states: int, seed: int) -> Chain:
        noise = np.random.default_rng(seed)
        emit = shares[:, None] * noise.uniform(0.2, 1.8, (len(shares), states))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @classmethod
    def estimated(cls, flat: np.ndarray, shares: np.ndarray, states: int) -> Chain:
        """From expected starts, moves and emissions, smoothed by one start and move each and 20 tokens of the shares."""
        start = flat[:states] + 1
        move = flat[states : states + states * states].reshape(states, states) + 1
        emit = flat[states + states * states :].reshape(-1, states) + 20 * shares[:, None]
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def transfers(self, blocks: Blocks, which: np.ndarray) -> np.ndarray:
        """Transfer matrix of each of these blocks up to a factor: from the state before it to the last one, or,
        where a text begins, from the first state."""
        k = len(self.start)
        out = np.repeat(np.eye(k, dtype=self.emit.dtype)[None], len(which), axis=0)
        logs = np.zeros(out.shape[:2])
        begins = blocks.first[which][:, None, None]
        for t, live, symbols in blocks.steps(which):
            now = (out[:live].reshape(-1, k) @ self.move).reshape(-1, k, k)
            if t == 0:
                now = np.where(begins, out, now)
            now *= self.relative[symbols][:, None]
            if t % REST == 0:
                total = now.sum(axis=2)
                now /= total[:, :, None]
                logs[:live] += np.log(total)
            out[:live] = now
        return out * np.exp(logs - logs.max(axis=1, keepdims=True))[:, :, None]

    def edges(self, blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
        """For each block the forward vector before it (where a text begins, unused) and the backward vector at its end."""
        k, n = len(self.start), len(blocks.text)
        entry, exit_ = np.full((n, k), 1 / k, self.emit.dtype), np.ones((n, k), self.emit.dtype)
        chains = blocks.chains()
        which = np.array(sorted(i for chain in chains for i in chain), int)  # long ones first
        place = {i: j for j, i in enumerate(which.tolist())}
        matrices = self.transfers(blocks, which) if len(which) else None
        for chain in chains:
            held = self.start
            for before, i in zip(chain, chain[1:]):
                held = held @ matrices[place[before]]
                entry[i] = held = held / held.sum()
            held = np.ones(k)
            for before, i in zip(chain[-2::-1], chain[:0:-1]):
                held = matrices[place[i]] @ held
                exit_[before] = held = held / held.sum()
        return entry, exit_

    def forward(self, blocks: Blocks, which: np.ndarray, entry: np.ndarray, keep: bool) -> tuple[np.ndarray, ...]:
        """Forward vectors of all places and their scales (with ``keep``), those of the last places, and logs of their sums.

        Vectors are scaled at every ``REST``-th place; the highest emission of each symbol is left out of all.
        """
        (n, k), width = entry.shape, int(blocks.size[which].max(initial=0)) if keep else 0
        alpha, scales, logs = np.zeros((width, n, k), self.emit.dtype), np.ones((width, n), self.emit.dtype), np.zeros(n)
        now = np.where(blocks.first[which][:, None], self.start, entry @ self.move)
        for t, live, symbols in blocks.steps(which):
            new = (now[:live] @ self.move if t else now[:live]) * self.relative[symbols]
            if t % REST == 0:
                total = new.sum(axis=1)
                new /= total[:, None]
                logs[:live] += np.log(total)
                if keep:
                    scales[t, :live] = total
            now[:live] = new
            if keep:
                alpha[t, :live] = new
        return alpha, scales, now, logs + np.log(now.sum(axis=1))

    def log_likelihoods(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log-probability of each whole sequence."""
        blocks = Blocks(texts)
        peaks = np.concatenate([[0.0], np.cumsum(np.log(self.peak)[blocks.symbols])])
        ends = np.cumsum([len(x) for x in texts], dtype=int)
        out = np.diff(peaks[np.concatenate([[0], ends])]) if len(texts) else np.zeros(0)
        entry, _ = self.edges(blocks)
        for which in blocks.groups():
            np.add.at(out, blocks.text[which], self.forward(blocks, which, entry[which], False)[3])
        return out

    def expected(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions of whole texts, all of at least one symbol."""
        blocks, k = Blocks(texts), len(self.start)
        starts, moves, emitted = np.zeros(k), np.zeros((k, k)), np.zeros(self.emit.shape)
        entries, exits = self.edges(blocks)
        for which in blocks.groups():
            entry, first, size = entries[which], blocks.first[which], blocks.size[which]
            alpha, scales, last, _ = self.forward(blocks, which, entry, True)
            beta = exits[which]
            beta = beta / (last * beta).sum(axis=1, keepdims=True)
            for t, live, symbols in reversed(list(blocks.steps(which))):
                ahead = self.relative[symbols] * beta[:live]
                if t % REST == 0:
                    ahead /= scales[t, :live, None]
                alpha[t, :live] *= beta[:live]  # from here on the probability of each state
                if t:
                    moves += alpha[t - 1, :live].T @ ahead
                    beta[:live] = ahead @ self.move.T
                else:
                    moves += entry.T @ (ahead * ~first[:, None])
            starts += alpha[0, first].sum(axis=0)
            real = np.arange(len(alpha))[:, None] < size[None]
            cells = blocks.symbols[(blocks.start[which][None] + np.arange(len(alpha))[:, None])[real]]
            for state in range(k):
                emitted[:, state] += np.bincount(cells, alpha[:, :, state][real], len(emitted))
        return starts, moves * self.move, emitted


def sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4") for x in column.to_pylist()]


def expectations(found: Iterator[pa.RecordBatch], chain: Shared) -> Iterator[pa.RecordBatch]:
    own: Chain = chain.value.single()
    total = [np.zeros(own.start.shape), np.zeros(own.move.shape), np.zeros(own.emit.shape)]
    for batch in found:
        for part in slices(batch.column("symbols"), SYMBOLS):
            for a, b in zip(total, own.expected(sequences(part))):
                a += b
    # rows: the starts, the moves from each state, and the emissions of each class
    table = np.concatenate([total[0][None], total[1], total[2]])
    some = np.flatnonzero(table.any(axis=1))
    for at in range(0, len(some), 1 << 14):
        rows = some[at : at + (1 << 14)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows.astype(np.int32)), *(pa.array(x) for x in table[rows].T)],
            names=["row", *(f"state{i}" for i in range(table.shape[1]))])


def baum_welch(texts: DataFrame, shares: np.ndarray, states: int, rounds: int, seed: int) -> Chain:
    chain = Chain.initial(shares, states, seed)
    names = [f"state{i}" for i in range(states)]
    for _ in range(rounds):
        shared = Shared(texts.sparkSession, chain)
        parts = texts.select("symbols").mapInArrow(
            lambda found, s=shared: expectations(found, s), "row int, " + ", ".join(f"{x} double" for x in names))
        sums = parts.groupBy("row").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
        table = np.zeros((1 + states + len(shares), states))
        table[sums.column("row").to_numpy()] = np.stack([sums.column(x).to_numpy() for x in names], axis=1)
        chain = Chain.estimated(table.ravel(), shares, states)
    return chain


def likelihood(chain: Shared):
    @F.arrow_udf(DoubleType())
    def score(column: pa.Array) -> pa.Array:
        parts = [chain.value.log_likelihoods(sequences(part)) for part in slices(column, SYMBOLS)]
        return pa.array(np.concatenate([*parts, np.zeros(0)]) / np.log(10))

    return score


def score_texts(docs: DataFrame, states: int = STATES, rounds: int = 5, share: float = SHARE, seed: int = 5,
                held_mod: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Scores are log10 probabilities of the whole text, of any length.  A null or empty text is its end mark
    alone.  Training rows are those whose id has a checksum other than 0 modulo ``held_mod``; without any,
    all counts are 0.  Repeated rows count as often as they occur; other columns are ignored; an empty
    table gives no row.  Of words equally frequent the smaller hash comes first, which decides nothing but
    numbers of classes.  Words are told apart by 64-bit hashes.
    """
    if share < 1 / LOOKUP:
        raise ValueError(f"share must be at least 1/{LOOKUP}, as every word with a class of its own is held by tasks")
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("body"),
        (F.crc32(key) % held_mod == 0).alias("held_out"))
    counts = rows.filter("NOT held_out").select("body").mapInArrow(count_words, "word bigint, n bigint")
    counts = stage(counts.groupBy("word").agg(F.sum("n").alias("c")), "hmm-counts")
    tokens, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(LOOKUP).toArrow()
    words, held = top.column("word").to_numpy().view(U), top.column("c").to_numpy()
    if not len(words):  # the end mark always has a place
        words, held = np.array([END]), np.zeros(1, np.int64)
    own = max(1, int((held >= share * tokens).sum()))
    rest = int(tokens - held[:own].sum())
    buckets = 1 << max(4, int(rest / max(1.0, share * tokens)).bit_length())
    # what is left of each shared class without the words that have their own
    sizes = counts.groupBy(F.expr(f"word & {buckets - 1}L").alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).toArrow()
    class_tokens, class_kinds = np.zeros(buckets), np.zeros(buckets)
    at = sizes.column("k").to_numpy()
    class_tokens[at], class_kinds[at] = sizes.column("c").to_numpy(), sizes.column("n").to_numpy()
    taken = (words[:own] & U(buckets - 1)).astype(np.int64)
    np.subtract.at(class_tokens, taken, held[:own])
    np.subtract.at(class_kinds, taken, (held[:own] > 0).astype(float))
    lexicon = Lexicon(words, held, own, tokens, kinds, class_tokens, class_kinds)

    shared = Shared(docs.sparkSession, lexicon)
    read = rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "held_out", "body")
    read = stage(read.mapInArrow(lambda found: read_texts(found, shared), READ), "hmm-read")

    shares = np.concatenate([held[:own], class_tokens]) + ADD
    chain = baum_welch(read.filter("NOT held_out"), shares / shares.sum(), states, rounds, seed)

    rare = read.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.n")
    rare = rare.join(counts, "word", "left").select(
        "rid", (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).alias("gain"),
        F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"))
    rare = rare.groupBy("rid").agg(F.sum("gain").alias("rare_gain"), F.sum("known").alias("rare_known"))
    none = F.lit(0.0)
    within = F.col("within") + F.coalesce("rare_gain", none)
    return read.select(
        "rid", "doc_id", "held_out", "n_tokens", "n_known", "share", "within",
        likelihood(Shared(docs.sparkSession, chain))("symbols").alias("classes"),
    ).join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("bigint").alias("train_tokens"),
        (F.col("share") + F.coalesce("rare_gain", none)).alias("base_score"),
        (F.col("classes") + within).alias("score"))


def op4(docs: DataFrame) -> DataFrame:
    return score_texts(docs)
