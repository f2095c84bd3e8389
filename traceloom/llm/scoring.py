"""Log-probabilities of texts by a log-bilinear model trained with noise-contrastive estimation (operator 3).

The model predicts units: the most frequent words (the text end among them), and classes of all other words by their
last two bytes. Two context units are looked up, weighted per position and added; the product with a unit's vector plus
its bias is the unit's logarithmic weight, normalised over all units. A word of a class has the class's probability
times its smoothed share of the class, so probabilities of all words, and of an unseen word per class, add up to one.

Every training text is used: each task trains on its texts from the same start, and the parameters are averaged by
tokens. Counts of all words are a distributed table; tasks get units and frequent words (bounded numbers) only, counts of
rarer words are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import Words, crc32_of_id, mix, prepare, slices
from traceloom.session import materialise

UNIT_WORDS = 768
CLASSES = 256
SIZE = 16
NOISE = 32
BATCH = 1024
RATE = 0.1
#: At most so many frequent words are known to every task; their counts need no join.
FREQUENT = 1 << 18
SMOOTH = 0.1
END = np.uint64(0)  # the text end's hash
#: Distinct words a counting task holds before it passes its counts on.
HELD_WORDS = 1 << 20


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and classes of all tokens with an end after each text, and where each text's tokens begin."""
    words = Words(texts)
    last = words.bytes[words.ends - 1].astype(np.uint64)
    before = np.where(words.ends - words.starts > 1, words.bytes[words.ends - 2], 0).astype(np.uint64)
    kind = (mix(last * np.uint64(256) + before) % np.uint64(CLASSES)).astype(np.int64)
    n = len(words.at) - 1
    bounds = words.at + np.arange(n + 1)
    hashes, classes = np.full(bounds[-1], END), np.zeros(bounds[-1], np.int64)
    inside = np.ones(bounds[-1], bool)
    inside[bounds[1:] - 1] = False
    hashes[inside], classes[inside] = words.hashes, kind
    return hashes, classes, bounds


def count_tokens(docs: DataFrame) -> DataFrame:
    """(h, cls, c): the count of each token; partial sums are made in the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        size = 0

        def merged() -> pd.DataFrame:
            return pd.concat(held).groupby("h", sort=False).agg({"cls": "first", "c": "sum"}).reset_index()

        for batch in batches:
            for _, part in slices(batch.column("text")):
                hashes, classes, _ = token_hashes(part)
                codes, distinct = pd.factorize(hashes)
                kinds = np.zeros(len(distinct), np.int64)
                kinds[codes] = classes
                held.append(pd.DataFrame({"h": distinct.view(np.int64), "cls": kinds, "c": np.bincount(codes)}))
                size += len(distinct)
                if size > HELD_WORDS:
                    held = [merged()]
                    size = len(held[0])
                    if size > HELD_WORDS // 2:
                        yield pa.RecordBatch.from_pandas(held.pop(), preserve_index=False)
                        size = 0
        if held:
            yield pa.RecordBatch.from_pandas(merged(), preserve_index=False)

    parts = docs.select("text").mapInArrow(count, "h long, cls long, c long")
    return parts.groupBy("h").agg(F.min("cls").alias("cls"), F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> pd.DataFrame:
    """Words over the lowest bound of counts that at most ``most`` words reach: h, cls, c."""
    level = F.floor(F.log2("c") * 16)
    sizes = sorted(counts.groupBy(level.alias("level")).agg(F.count("*")).collect(), reverse=True)  # about a thousand rows
    least, total = None, 0
    for row in sizes:
        total += row[1]
        if total > most:
            break
        least = row[0]
    if least is None:
        return pd.DataFrame({"h": np.zeros(0, np.int64), "cls": np.zeros(0, np.int64), "c": np.zeros(0, np.int64)})
    return counts.where(level >= least).select("h", "cls", "c").toArrow().to_pandas()


class Lexicon:
    """Units, frequent words and totals, as arrays that every task gets."""

    def __init__(self, frequent: pd.DataFrame, total: int, distinct: int, by_class: dict[int, tuple[int, int]]):
        end = np.int64(END)
        ranked = frequent.sort_values(["c", "h"], ascending=[False, True])
        words = ranked[ranked.h != end].head(UNIT_WORDS - 1)
        ends = int(ranked.c[ranked.h == end].sum())
        self.unit_words = np.append(words.h.to_numpy().view(np.uint64), END)
        self.order = np.argsort(self.unit_words)
        self.sorted_units = self.unit_words[self.order]
        self.units = len(self.unit_words) + CLASSES
        tokens = np.zeros(CLASSES)
        kinds = np.zeros(CLASSES)
        for k, (c, v) in by_class.items():
            tokens[k], kinds[k] = c, v
        np.subtract.at(tokens, words.cls.to_numpy(), words.c.to_numpy())
        np.subtract.at(kinds, words.cls.to_numpy(), 1)
        self.share = np.log10(tokens + SMOOTH * (kinds + 1))  # of a class's words: the divisor
        weights = np.concatenate((words.c.to_numpy(), [ends], tokens)) + 1.0
        self.noise = weights / weights.sum()
        known = frequent.sort_values("h", key=lambda h: h.to_numpy().view(np.uint64))
        self.frequent = known.h.to_numpy().view(np.uint64)
        self.counts = known.c.to_numpy()
        self.total = total
        self.divisor = float(np.log10(total + SMOOTH * (distinct + 1)))

    def find(self, hashes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of tokens, and their counts (-1 if not frequent)."""
        codes, distinct = pd.factorize(hashes)
        kinds = np.zeros(len(distinct), np.int64)
        kinds[codes] = classes
        at = np.minimum(np.searchsorted(self.sorted_units, distinct), len(self.sorted_units) - 1)
        unit = np.where(self.sorted_units[at] == distinct, self.order[at], len(self.unit_words) + kinds)
        count = np.full(len(distinct), -1, np.int64)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, distinct), len(self.frequent) - 1)
            count = np.where(self.frequent[at] == distinct, self.counts[at], -1)
        return unit[codes], count[codes]

    def contexts(self, units: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units one and two places before each; the number of units stands for the start of the text."""
        first, second = np.full(len(units), self.units), np.full(len(units), self.units)
        first[1:], second[2:] = units[:-1], units[:-2]
        starts = bounds[:-1]
        first[starts] = self.units
        second[starts] = self.units
        after = starts[np.diff(bounds) > 1] + 1
        second[after] = self.units
        return first, second


class Bilinear:
    """Context vectors r, position weights p, unit vectors q and biases b."""

    def __init__(self, noise: np.ndarray, size: int = SIZE):
        rng = np.random.default_rng(3)
        units = len(noise)
        self.noise = noise
        self.log_noise = np.log(noise).astype(np.float32)
        self.r = (rng.normal(size=(units + 1, size)) * 0.3).astype(np.float32)
        self.p = np.array([[1.0] * size, [0.5] * size], np.float32)
        self.q = (rng.normal(size=(units, size)) * 0.03).astype(np.float32)
        self.b = self.log_noise.copy()
        self.squares = [np.full_like(x, 1e-2) for x in self.parameters()]

    def parameters(self) -> list[np.ndarray]:
        return [self.r, self.p, self.q, self.b]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parameters()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for x in self.parameters():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size

    def step(self, first: np.ndarray, second: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> None:
        """One minibatch: tell the target from NOISE units that the whole batch shares, drawn by frequency."""
        drawn = np.searchsorted(self.cumulated, rng.random(NOISE)).clip(0, len(self.noise) - 1)
        shift = np.float32(np.log(NOISE))
        r1, r2 = self.r[first], self.r[second]
        h = r1 * self.p[0] + r2 * self.p[1]
        qt, qn = self.q[target], self.q[drawn]
        real = (h * qt).sum(axis=1) + self.b[target] - self.log_noise[target] - shift
        false = h @ qn.T + (self.b[drawn] - self.log_noise[drawn] - shift)
        up = 1 / (1 + np.exp(np.clip(real, -30, 30)))
        down = -1 / (1 + np.exp(np.clip(-false, -30, 30)))
        dh = up[:, None] * qt + down @ qn
        gq, gb, gr = np.zeros_like(self.q), np.zeros_like(self.b), np.zeros_like(self.r)
        rows = np.arange(len(target))
        add_rows(gq, target, up[:, None] * h, rows)
        np.add.at(gq, drawn, down.T @ h)
        gb += np.bincount(target, up, len(gb)).astype(np.float32)
        np.add.at(gb, drawn, down.sum(axis=0))
        add_rows(gr, first, dh * self.p[0], rows)
        add_rows(gr, second, dh * self.p[1], rows)
        gp = np.stack(((dh * r1).sum(axis=0), (dh * r2).sum(axis=0)))
        for value, gradient, square in zip(self.parameters(), (gr, gp, gq, gb), self.squares):
            gradient /= len(target)
            square += gradient * gradient
            value += np.float32(RATE) * gradient / np.sqrt(square)

    def train(self, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> int:
        rng = np.random.default_rng(33)
        self.cumulated = np.cumsum(self.noise)
        total = 0
        for first, second, target in batches:
            order = rng.permutation(len(target))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                self.step(first[rows], second[rows], target[rows], rng)
            total += len(target)
        return total

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Products of every context unit with every unit, by position."""
        return (self.r * self.p[0]) @ self.q.T, (self.r * self.p[1]) @ self.q.T + self.b


def add_rows(out: np.ndarray, at: np.ndarray, values: np.ndarray, rows: np.ndarray) -> None:
    """out[at] += values, equal places added up."""
    order = np.argsort(at, kind="stable")
    places = at[order]
    starts = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
    out[places[starts]] += np.add.reduceat(values[order], starts, axis=0)


class Scorer:
    """Normalised log10 probabilities of units in context; normalisers are kept per pair of context units."""

    def __init__(self, model: Bilinear):
        self.one, self.two = model.tables()
        self.norm = np.full(self.one.shape[0] ** 2, np.nan, np.float32)

    def log10(self, first: np.ndarray, second: np.ndarray, units: np.ndarray) -> np.ndarray:
        code = first * self.one.shape[0] + second
        missing = np.unique(code[np.isnan(self.norm[code])])
        for at in range(0, len(missing), 2048):
            part = missing[at : at + 2048]
            s = self.one[part // self.one.shape[0]] + self.two[part % self.one.shape[0]]
            top = s.max(axis=1)
            self.norm[part] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        weight = self.one[first, units] + self.two[second, units]
        return (weight - self.norm[code]).astype(np.float64) / np.log(10)


def train(docs: DataFrame, lexicon) -> Bilinear:
    """Average, weighted by tokens, of the parameters that each task reaches on its part of ``docs``."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        model = Bilinear(known.noise)

        def examples():
            for batch in batches:
                for _, part in slices(batch.column("text")):
                    hashes, classes, bounds = token_hashes(part)
                    units = known.find(hashes, classes)[0]
                    yield *known.contexts(units, bounds), units

        tokens = model.train(examples())
        if tokens:
            flat = model.flat().astype(np.float64) * tokens
            chunks = np.array_split(flat, 64)
            yield pa.RecordBatch.from_pydict({"i": np.arange(64), "tokens": np.full(64, tokens), "v": list(chunks)})

    parts = docs.select("text").mapInArrow(fit, "i long, tokens long, v array<double>")
    parts = parts.select("i", "tokens", F.posexplode("v").alias("j", "x"))
    sums = parts.groupBy("i", "j").agg((F.sum("x") / F.sum("tokens")).alias("x")).toArrow().to_pandas()
    model = Bilinear(lexicon.value.noise)
    if len(sums):
        model.load(sums.sort_values(["i", "j"]).x.to_numpy())
    return model


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text).

    Learns from rows whose crc32(doc_id as text) mod 10 is not 0 (``held_out`` marks the others). Tokens are words
    lower-cased in A-Z, and an end for each text; a null or empty text is its end alone. ``base_score`` adds
    log10((c + 0.1) / (N + 0.1 (V + 1))) over tokens; ``score`` is the model's log10 probability of the text. Repeated
    rows are texts of their own, without training rows all words are unseen; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id"), "text", (crc32_of_id(F.col("doc_id")) % 10 == 0).alias("held_out"))
    training = docs.where("not held_out")
    counts = materialise(count_tokens(training), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    by_class = counts.where(F.col("h") != 0).groupBy("cls").agg(F.sum("c"), F.count("*")).collect()  # CLASSES rows
    frequent = frequent_words(counts, FREQUENT)
    lexicon = spark.sparkContext.broadcast(Lexicon(frequent, total, distinct, {r[0]: (r[1], r[2]) for r in by_class}))
    model = spark.sparkContext.broadcast(train(training, lexicon))
    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, model double, rare array<long>"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scorer = lexicon.value, Scorer(model.value)
        words = len(known.unit_words)
        for batch in batches:
            for at, part in slices(batch.column("text")):
                hashes, classes, bounds = token_hashes(part)
                units, count = known.find(hashes, classes)
                value = np.zeros(len(units))
                first, second = known.contexts(units, bounds)
                for a in range(0, len(units), 1 << 18):
                    b = a + (1 << 18)
                    value[a:b] = scorer.log10(first[a:b], second[a:b], units[a:b])
                rare = count < 0
                # The logarithm of a rare word's count is added after the join.
                own = np.where(rare, 0.0, np.log10(np.maximum(count, 0) + SMOOTH))
                inside = units >= words
                value[inside] += own[inside] - known.share[units[inside] - words]
                sums = lambda x: np.diff(np.append(0, np.cumsum(x))[bounds])
                offsets = np.append(0, np.cumsum(rare))[bounds]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(part)).cast(pa.int64()),
                        batch.column("held_out").slice(at, len(part)),
                        pa.array(np.diff(bounds)),
                        pa.array(sums((~rare).astype(np.int64))),
                        pa.array(np.add.reduceat(own - known.divisor, bounds[:-1])),
                        pa.array(np.add.reduceat(value, bounds[:-1])),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes[rare].view(np.int64))),
                    ],
                    names=[f.split()[0] for f in schema.split(", ")],
                )

    rows = docs.select("doc_id", "held_out", "text").mapInArrow(score, schema)
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = rows.select("row", F.explode("rare").alias("h")).join(counts.select("h", "c"), "h", "left")
    count = F.coalesce("c", F.lit(0))
    rare = rare.groupBy("row").agg(
        F.sum(F.log10(count + SMOOTH)).alias("logs"), F.sum((count > 0).cast("long")).alias("more")
    )
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return rows.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + more).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )
