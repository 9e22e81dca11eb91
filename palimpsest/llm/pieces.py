"""Language identification by segmentation-marginalised unigrams.

The pieces come from the fixed vocabulary of a public tokenizer; only their probabilities per language
are learned, by expectation-maximisation over all segmentations of the words of a labelled sample.  A
word's probability is the sum over all its segmentations, by the forward algorithm; a text's is the
product over its words.  The forward pass runs over many words at once, and each distinct word of a
task's batch is scored once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.words import Shared, U, mix, slices
from palimpsest.scratch import stage

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"
BASE = U(0x9E3779B97F4A7C15)
CACHE = 200_000
UNKNOWN = "und"
#: Natural log of the probability of a letter below which a text is in no learned language: that of letters drawn
#: evenly from an alphabet of 26.  Texts of the learned languages lie near -1.5; shorter ones than ENOUGH stay.
FLOOR = -3.26
ENOUGH = 50


def words_of(text: str, step: int = 1 << 20) -> Iterator[list[str]]:
    """Lower-case runs of letters, in lists of bounded length."""
    at = 0
    while at < len(text):
        end = min(len(text), at + step)
        while end < len(text) and text[end].isalnum():
            end += 1
        yield LETTERS.findall(text[at:end].lower())
        at = end


class Lattice:
    """Pieces of a vocabulary, found in many words at once.  The last piece number stands for any
    single character that is no piece itself."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.size = len(pieces) + 1
        by_length: dict[int, list[int]] = {}
        for number, piece in enumerate(pieces):
            by_length.setdefault(len(piece), []).append(number)
        self.longest = max(by_length, default=1)
        self.tables = {}
        for length, numbers in by_length.items():
            codes = np.array([[ord(c) for c in pieces[n]] for n in numbers], U)
            key = np.zeros(len(numbers), U)
            for j in range(length):
                key = key * BASE + codes[:, j]
            order = np.argsort(mix(key))
            self.tables[length] = (mix(key)[order], np.array(numbers)[order])

    def find(self, length: int, keys: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        if length not in self.tables:
            found = np.full(len(keys), -1)
        else:
            known, numbers = self.tables[length]
            keys = mix(keys)
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            found = np.where(known[at] == keys, numbers[at], -1)
        return np.where(found < 0, self.size - 1, found) if length == 1 else found

    def arcs(self, codes: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end position the pieces that end there: (length, rows, piece numbers)."""
        n, width = codes.shape
        ends: list[list] = [[] for _ in range(width + 1)]
        keys = np.zeros((n, width), U)
        for length in range(1, min(self.longest, width) + 1):
            keys = keys[:, : width - length + 1] * BASE + codes[:, length - 1 :]
            found = self.find(length, keys.ravel()).reshape(keys.shape)
            for start in range(width - length + 1):
                rows = np.flatnonzero(found[:, start] >= 0)
                if len(rows):
                    ends[start + length].append((length, rows, found[rows, start]))
        return ends


def equal_lengths(words: list[str], most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words by length, as (places in the list, code points with the mark before), bounded in cells."""
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    for size in np.unique(sizes).tolist():
        own = order[np.searchsorted(sizes[order], size) : np.searchsorted(sizes[order], size, side="right")]
        step = max(1, most // (size + 1))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            joined = "".join(MARK + words[i] for i in part.tolist())
            yield part, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(part), size + 1).astype(U)


def forward(arcs: list, n: int, chances: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Scaled forward values of each position and the logarithms of their scales."""
    alpha, scale = [np.ones((n, chances.shape[1]))], [np.zeros(n)]
    for end in range(1, len(arcs)):
        new = np.zeros_like(alpha[0])
        for length, rows, pieces in arcs[end]:
            back = alpha[end - length][rows] * chances[pieces]
            if length > 1:
                back *= np.exp(scale[end - length][rows] - scale[end - 1][rows])[:, None]
            new[rows] += back
        top = new.max(axis=1)
        alpha.append(new / top[:, None])
        scale.append(scale[-1] + np.log(top))
    return alpha, scale


def log_chances(words: list[str], lattice: Lattice, chances: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language, over all segmentations."""
    out = np.zeros((len(words), chances.shape[1]))
    for part, codes in equal_lengths(words):
        alpha, scale = forward(lattice.arcs(codes), len(part), chances)
        out[part] = np.log(np.maximum(alpha[-1], 1e-300)) + scale[-1][:, None]
    return out


def expected_counts(words: list[str], weights: np.ndarray, lattice: Lattice, chances: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language; ``weights``: occurrences of each word in each."""
    counts = np.zeros_like(chances)
    for part, codes in equal_lengths(words, 1 << 14):
        n, arcs = len(part), lattice.arcs(codes)
        alpha, scale = forward(arcs, n, chances)
        beta = [np.zeros((n, chances.shape[1])) for _ in arcs]
        beta[-1] = weights[part] / np.maximum(alpha[-1], 1e-300)  # relative to the scale of the end
        for end in range(len(arcs) - 1, 0, -1):
            for length, rows, pieces in arcs[end]:
                # beta is held relative to the scale of its own position
                through = beta[end][rows] * chances[pieces] * np.exp(
                    scale[end - length][rows] - scale[end][rows])[:, None]
                beta[end - length][rows] += through
                used = through * alpha[end - length][rows]
                for language in range(chances.shape[1]):
                    counts[:, language] += np.bincount(pieces, used[:, language], len(counts))
    return counts


class Model:
    def __init__(self, languages: list[str], lattice: Lattice, chances: np.ndarray):
        self.languages, self.lattice, self.chances = languages, lattice, chances
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)))

    def score(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            if len(self.known) + len(new) > CACHE:
                self.known, self.scores = {}, np.zeros((0, len(self.languages)))
                new = list(dict.fromkeys(words))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.scores = np.concatenate([self.scores, log_chances(new, self.lattice, self.chances)])
        return self.scores[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        total = np.zeros(len(self.languages))
        for words in words_of(text):
            if words:
                total += self.score(words)
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())

    def spoken(self, text: str | None, floor: float, enough: int) -> bool:
        """Whether the text has letters that some learned language makes likely enough."""
        total, letters = np.zeros(len(self.languages)), 0
        for words in words_of(text or ""):
            if words:
                total += self.score(words)
                letters += sum(map(len, words)) + len(words)
        return letters > 0 and (letters < enough or float(total.max()) >= floor * letters)

    def warm(self, texts: list[str | None]) -> None:
        """Score the words of several short texts at once."""
        if not self.languages:
            return
        self.score([w for t in texts if t and len(t) < 1 << 18 for words in words_of(t) for w in words])


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The ordinary pieces of a tokenizer, without control and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return sorted({model.id_to_piece(i) for i in range(model.get_piece_size())
                   if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})


def count_words(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in found:
        for lang, rows in batch.groupby("lang"):
            counts = Counter(w for text in rows["text"] for words in words_of(text) for w in words)
            if counts:
                yield pd.DataFrame({"lang": lang, "word": list(counts), "n": list(counts.values())})


def training_rows(docs: DataFrame, doc_id: str, text: str, lang: str, seed_mod: int = 5) -> DataFrame:
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return docs.select(
        key.alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"),
        (F.crc32(key.cast("binary")) % seed_mod == 0).alias("held_out"))


def train(docs: DataFrame, per_language: int = 2000, rounds: int = 4, path: str = VOCABULARY,
          doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Piece probabilities from a bounded sample: about ``per_language`` labelled rows of each language.

    Rows are taken by a hash of their id, at a rate that follows from the number of rows of the
    language, so nothing is shuffled but counts of words.  Held-out rows, null texts and rows without
    a language are not used.  What reaches the driver is bounded by vocabulary times languages.
    """
    spark = docs.sparkSession
    rows = training_rows(docs, doc_id, text, lang).filter("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL")
    held = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(held)
    lattice = Lattice(vocabulary(path))
    if not languages:
        return Model([], lattice, np.zeros((lattice.size, 0)))
    rates = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(int(2**32 * min(1, per_language / held[name]))))])
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(2**32)) < F.element_at(rates, F.col("lang")))
    counted = sample.select("lang", "text").mapInPandas(count_words, "lang string, word string, n bigint")
    counted = stage(counted.groupBy("word", "lang").agg(F.sum("n").alias("n")).groupBy("word").agg(
        F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n")), "langid-words")

    chances = np.full((lattice.size, len(languages)), 1 / lattice.size)
    for _ in range(rounds):
        shared = Shared(spark, (lattice, chances, languages))

        def uses(found: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, chances, languages = shared.value
            total = np.zeros_like(chances)
            for batch in found:
                weights = np.zeros((batch.num_rows, len(languages)))
                for i, row in enumerate(batch.column("n").to_pylist()):
                    for name, n in row:
                        weights[i, languages.index(name)] = n
                total += expected_counts(batch.column("word").to_pylist(), weights, lattice, chances)
            piece, language = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece.astype(np.int32)), pa.array(language.astype(np.int32)), pa.array(total[piece, language])],
                names=["piece", "language", "used"])

        used = counted.mapInArrow(uses, "piece int, language int, used double")
        used = used.groupBy("piece", "language").agg(F.sum("used").alias("used")).toPandas()
        counts = np.zeros_like(chances)
        counts[used["piece"].to_numpy(), used["language"].to_numpy()] = used["used"].to_numpy()
        chances = (counts + 0.01) / (counts + 0.01).sum(axis=0)
    return Model(languages, lattice, chances)


PREDICTED = "struct<lang: string, score: double>"


def predictor(model: Shared):
    @F.arrow_udf(PREDICTED)
    def predict(column: pa.Array) -> pa.Array:
        rows = []
        for part in slices(column, 2 << 20):
            texts = [None if v is None else v.decode("utf-8", "replace") for v in part.to_pylist()]
            model.value.warm(texts)
            rows.extend({"lang": a, "score": b} for a, b in map(model.value.predict, texts))
        return pa.array(rows, pa.struct([("lang", pa.string()), ("score", pa.float64())]))

    return predict


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row.  A null text and one without a letter are ``und``
    with score 0, as is everything when nothing was learned; ties go to the first language by name.
    Other columns are ignored."""
    found = predictor(Shared(docs.sparkSession, model))(F.col(text).cast("string").cast("binary"))
    return docs.select(F.col(doc_id).alias("doc_id"), found.alias("p")).select(
        "doc_id", F.col("p.lang").alias("lang_pred"), "p.score")


def speaking(docs: DataFrame, model: Model, text: str = "text", floor: float = FLOOR, enough: int = ENOUGH) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are in one of the learned languages.

    Out go null texts, those without a letter, and those of ``enough`` letters or more (a word counts one
    more than it has) whose log-probability in the language that suits them best is below ``floor`` a letter:
    other scripts, and letters without an order.  When nothing was learned, every text with a letter stays:
    that no row has a label says nothing of it.  A text is scored whole, however long; repeated rows share
    their fate; an empty table stays empty.
    """
    if not model.languages:
        return docs.filter(F.col(text).cast("string").rlike(r"\p{L}"))
    shared = Shared(docs.sparkSession, model)

    @F.arrow_udf("boolean")
    def spoken(column: pa.Array) -> pa.Array:
        rows = []
        for part in slices(column, 2 << 20):
            texts = [None if v is None else v.decode("utf-8", "replace") for v in part.to_pylist()]
            shared.value.warm(texts)
            rows.extend(shared.value.spoken(t, floor, enough) for t in texts)
        return pa.array(rows, pa.bool_())

    marked = docs.select(F.struct("*").alias("row"), spoken(F.col(text).cast("string").cast("binary")).alias("stays"))
    return marked.filter("stays").select("row.*")


def op6(docs: DataFrame) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return identify(docs, train(docs)).withColumn("held_out", F.crc32(key) % 5 == 0).select(
        "doc_id", "held_out", "lang_pred", "score")
