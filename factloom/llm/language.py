"""Language ID: averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient descent in numpy.

Subwords are the 2- to 4-byte strings of the text with A-Z and the Latin-1 capitals lower-cased and all ASCII but letters made blank. Training reads a bounded sample
(``per_language`` documents of each language, the smallest hashes of their ids; ``snippets`` pieces each); a fifth of its documents is kept back to fit the
temperature and the score below which a prediction is rejected. A text is rejected by two limits, each at its length in 3-byte strings that hold letters and each at the
``FALSE_REJECTIONS`` quantile of the sample (or one in the number of its texts where that is more): by its score, against whole and cut texts kept back, alone and half and half with
one of another language; and by its share of 3-byte strings that the sample lacks, against the share of each sample text that no other one has, and ``TOLERATED`` at least (where two languages meet there are new strings). So texts in two learned languages stay,
while unlearned scripts, languages and letter noise go, however few languages there are. Below ``LENGTHS[0]`` such strings nothing is said. Because text embeddings are averages and the classifier is linear, each bucket's
contribution to the scores is computed once, and a task only sums those rows: one broadcast table of BUCKETS x languages floats.

Edge cases: null texts and texts without a letter are ``und`` with score 0 and rejected; texts shorter than two bytes get the class priors; rows without a language,
or with null ids, are not learned from, but predicted; no labelled rows: ``fit`` raises ``NothingLabelled``,
``learn`` gives a model without languages, to which every text is ``und`` with score 0 and rejected; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import as_bytes, slices, tidy

BUCKETS = 1 << 14
DIMENSION = 12
ORDERS = (2, 3, 4)
PER_LANGUAGE = 400
SNIPPETS = 4
SNIPPET_BYTES = 300
MAX_LANGUAGES = 500
FALSE_REJECTIONS = 0.001
TOLERATED = 0.1
LENGTHS = np.array([8, 20, 60, 200, 600, 2000])
UNDETERMINED = "und"
GUESS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[:0x80] = 0x20
PLAIN[0x61:0x7B] = PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)


def normal(raw: np.ndarray) -> np.ndarray:
    out = PLAIN[raw]
    capital = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)) + 1
    out[capital] += 0x20
    return out


def buckets(text: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the subword of ``order`` bytes at each position."""
    n = len(text) - order + 1
    h = np.full(max(n, 0), order * 0x9E37, np.uint32)
    for j in range(order):
        h = (h ^ text[j : j + n]) * np.uint32(0x01000193)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(18)


class NothingLabelled(ValueError):
    """No labelled row with letters and an id."""


def triples(text: np.ndarray) -> np.ndarray:
    """The 3-byte string at each position as a number; ``BLANK`` if it has no letter."""
    wide = text.astype(np.int32)
    return wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]


BLANK = 0x202020


def band(length: np.ndarray) -> np.ndarray:
    """Which of ``LENGTHS`` a text reaches; -1: none."""
    return np.searchsorted(LENGTHS, length, side="right") - 1


def limits(length: np.ndarray, value: np.ndarray, rate: float) -> np.ndarray:
    """Per band the value that a share ``rate`` of the texts exceeds. A shorter text's limit is not below a longer one's; bands without texts take the next shorter one's."""
    out = np.full(len(LENGTHS), np.nan)
    at = band(length)
    for b in np.unique(at[at >= 0]):
        out[b] = np.quantile(value[at == b], 1 - rate, method="higher")
    have = np.flatnonzero(~np.isnan(out))
    if not len(have):
        return np.full(len(LENGTHS), np.inf)
    out[have] = np.maximum.accumulate(out[have][::-1])[::-1]
    near = np.searchsorted(have, np.arange(len(LENGTHS)), side="right") - 1
    return np.where(near < 0, np.inf, out[have[np.maximum(near, 0)]])


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # contribution of each bucket to the scores
    bias: np.ndarray
    seen: np.ndarray  # bit for each 3-byte string of the sample
    temperature: float = 1.0
    least_score: np.ndarray = field(default_factory=lambda: np.full(len(LENGTHS), -np.inf))
    most_unseen: np.ndarray = field(default_factory=lambda: np.full(len(LENGTHS), np.inf))

    def unseen(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of 3-byte strings with letters in each text, and the share of them that the sample lacks."""
        codes = triples(normal(raw)) if len(raw) > 2 else np.zeros(0, np.int32)
        lettered = codes != BLANK
        new = lettered & (self.seen[codes >> 3] >> (codes & 7) & 1 == 0)
        first, end = np.minimum(offs[:-1], len(codes)), np.minimum(np.maximum(offs[:-1], offs[1:] - 2), len(codes))
        n, k = (sums[end] - sums[first] for sums in (np.append(0, np.cumsum(x)) for x in (lettered, new)))
        return n, k / np.maximum(n, 1)

    def rejects(self, raw: np.ndarray, offs: np.ndarray, score: np.ndarray) -> np.ndarray:
        n, share = self.unseen(raw, offs)
        at = band(n)
        return (at >= 0) & ((score < self.least_score[at]) | (share > self.most_unseen[at]))

    def scores(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for each text."""
        text, n = normal(raw), len(offs) - 1
        sums, count = np.zeros((n, len(self.languages))), np.zeros(n)
        for order in ORDERS:
            rows = self.table[buckets(text, order)]
            has = np.flatnonzero(np.diff(offs) >= order)
            if not len(has):
                continue
            # Subwords that would run into the next text lie between a text's segment and the next one's.
            cuts = np.stack([offs[has], offs[has + 1] - order + 1], 1).ravel()
            cuts = cuts[:-1] if cuts[-1] == len(rows) else cuts
            sums[has] += np.add.reduceat(rows, cuts)[::2]
            count[has] += offs[has + 1] - offs[has] - order + 1
        logits = (sums / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def sample_triples(texts: list[str], random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the 3-byte strings of all texts; and per band the limit of the share of a text's strings that no other text has."""
    plain = [normal(np.frombuffer(t.encode(), np.uint8)) for t in texts]
    holders = np.zeros(1 << 24, np.uint16)
    for text in plain:
        if len(text) > 2:
            mine = np.unique(triples(text))
            holders[mine] += holders[mine] < 2
    length, share = [], []
    for text in plain:
        for n in (*LENGTHS * 3 // 2, len(text)):
            start = random.integers(0, max(1, len(text) - n + 1))
            codes = triples(text[start : start + n]) if len(text) > 2 else np.zeros(0, np.int32)
            codes = codes[codes != BLANK]
            length.append(len(codes))
            share.append(np.mean(holders[codes] < 2) if len(codes) else 0.0)
    return np.packbits(holders > 0, bitorder="little"), limits(np.array(length), np.array(share), FALSE_REJECTIONS)


def pieces_alone_and_mixed(texts: list[str], target: np.ndarray, random: np.random.Generator) -> list[str]:
    """Each text whole and in pieces, and with each other language's half and half."""
    out = []
    for i, text in enumerate(texts):
        others = [random.choice(np.flatnonzero(target == t)) for t in np.unique(target) if t != target[i]]
        for n in (*(LENGTHS * 3 // 2).tolist(), None):
            out.append(text[:n])
            half = None if n is None else n // 2
            out += [f"{text[:half]} {texts[j][:half]}" if half else f"{text} {texts[j][: len(text)]}" for j in others]
    return out


def train(texts: list[str], labels: list[str], *, epochs: int = 6, rate: float = 0.5, batch: int = 64, seed: int = 7) -> Model:
    languages = sorted(set(labels))
    target, random = np.array([languages.index(x) for x in labels]), np.random.default_rng(seed)
    calibration = random.random(len(texts)) < 0.2
    features, label = [], []
    for i in np.flatnonzero(~calibration):
        text = normal(np.frombuffer(texts[i].encode(), np.uint8))
        for start in random.integers(0, max(1, len(text) - SNIPPET_BYTES), SNIPPETS):
            piece = text[start : start + SNIPPET_BYTES]
            if len(piece) >= 2:
                features.append(np.concatenate([buckets(piece, o) for o in ORDERS]))
                label.append(target[i])
    embedding = random.normal(0, 0.1, (BUCKETS, DIMENSION))
    weights, bias = random.normal(0, 0.1, (DIMENSION, len(languages))), np.zeros(len(languages))
    label = np.array(label)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in np.array_split(random.permutation(len(features)), max(1, len(features) // batch)):
            if not len(at):
                continue
            ids = np.concatenate([features[i] for i in at])
            sizes = np.array([len(features[i]) for i in at])
            mean = np.add.reduceat(embedding[ids], np.append(0, np.cumsum(sizes)[:-1])) / sizes[:, None]
            logits = mean @ weights + bias
            error = np.exp(logits - logits.max(1, keepdims=True))
            error /= error.sum(1, keepdims=True)
            error[np.arange(len(at)), label[at]] -= 1
            back = error @ weights.T / sizes[:, None]
            weights -= step * mean.T @ error / len(at)
            bias -= step * error.sum(0) / len(at)
            # Subwords are few times in many texts, so their step is not divided by the batch.
            hit = np.repeat(back, sizes, axis=0)
            for d in range(DIMENSION):
                embedding[:, d] -= 20 * step * np.bincount(ids, hit[:, d], BUCKETS)
    seen, most_unseen = sample_triples(texts, np.random.default_rng(seed))
    model = Model(languages, (embedding @ weights).astype(np.float32), bias, seen, most_unseen=np.maximum(most_unseen, TOLERATED))
    held = np.flatnonzero(calibration)
    if len(held):
        # Short pieces beside whole texts, so that the temperature knows how little a few letters say.
        whole = [texts[i] for i in held]
        raw, offs = as_bytes(pa.array(whole + [t[:n] for t in whole for n in (8, 20, 60)], pa.large_string()))
        truth, best = np.append(target[held], np.repeat(target[held], 3)), None
        for t in (0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0):
            model.temperature = t
            p = model.scores(raw, offs)
            loss = -np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-9)).mean()
            best = min(best or (loss, t), (loss, t))
        model.temperature = best[1]
        raw, offs = as_bytes(pa.array(pieces_alone_and_mixed(whole, target[held], random), pa.large_string()))
        cut = [(model.unseen(part, at)[0], model.scores(part, at).max(1)) for _, _, part, at in slices(raw, offs)]
        length, score = (np.concatenate(x) for x in zip(*cut))
        model.least_score = -limits(length, -score, FALSE_REJECTIONS)
    return model


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from at most ``per_language`` rows of each non-null language; the ids are chosen first, so only their texts are read to the driver."""
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & F.col(id_col).isNotNull())
    ids = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    # The smallest hashes of each language; all but about four times as many ids as wanted are left out before they move.
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    counts = ids.groupBy("lang").count()
    near = ids.join(counts, "lang").where(draw.cast("decimal(20,0)") * F.col("count") < F.lit(4 * per_language * (1 << 40)).cast("decimal(38,0)"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "id"))
    chosen = [r["id"] for r in near.withColumn("n", rank).where(F.col("n") <= per_language).select("id").limit(per_language * MAX_LANGUAGES).collect()]
    picked = labelled.sparkSession.createDataFrame([(i,) for i in chosen], labelled.select(F.col(id_col).alias("id")).schema)
    rows = usable.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.join(F.broadcast(picked), "id", "left_semi").withColumn("text", F.substring("text", 1, 20 * SNIPPET_BYTES * SNIPPETS)).orderBy("id").collect()
    if not rows:
        raise NothingLabelled("no labelled texts to learn from")
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def learn(labelled: DataFrame, **options) -> Model:
    """``fit``, or a model without languages if there is nothing to learn from."""
    try:
        return fit(labelled, **options)
    except NothingLabelled:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.zeros(1 << 21, np.uint8))
    finally:
        tidy()  # here the driver's: the sample takes over 100 MB


def predictor(documents: DataFrame, model: Model):
    """Column function: whole text to (lang, score, rejected)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(GUESS)
    def guess(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        m = shared.value
        for texts, letters in batches:
            raw, offs = as_bytes(texts)
            top, score, rejected = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), bool)
            for a, b, part, at in slices(raw, offs) if m.languages else ():
                p = m.scores(part, at)
                top[a:b], score[a:b] = p.argmax(1), p.max(1)
                rejected[a:b] = m.rejects(part, at, score[a:b])
            has = letters.fill_null(False).to_numpy(zero_copy_only=False).astype(bool) & bool(m.languages)
            score = np.where(has, score, 0.0)
            names = [m.languages[i] if ok else UNDETERMINED for i, ok in zip(top.tolist(), has.tolist())]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(~has | rejected)], names=GUESS.names)
        tidy()

    return lambda text: guess(text, text.rlike(r"\p{L}"))


def predict(documents: DataFrame, model: Model, *, text_col: str = "text", out: str = "guess") -> DataFrame:
    """``documents`` with a struct ``out`` of lang, score (calibrated probability) and rejected; a column of that name is replaced."""
    return documents.withColumn(out, predictor(documents, model)(F.col(text_col).cast("string")))
