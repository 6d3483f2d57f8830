"""Toxicity scores from a counterfactually regularised classifier.

Features are the words of a text and their first letters, as presence; a logistic model holds those that the
labels tell apart best. For labelled texts that name a group of people, a second text with the name swapped for another of its
row in ``GROUPS`` is made, and the change of the score between the two is penalised, so that naming a group
does not by itself raise the score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolanut.llm.words import WordHash, lower_table, mixed, raw, row_of, separators, slices, spans

# Terms that name groups of people, beside neutral ones, in the languages of the documents (en, fr, de, es). A term is swapped for the others of its row.
GROUPS = (
    ("people", "women", "men", "girls", "boys"),
    ("person", "woman", "man", "girl", "boy"),
    ("people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("person", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("person", "gay", "lesbian", "bisexual", "transgender", "straight"),
    ("person", "black", "white", "asian", "african", "latino", "arab"),
    ("people", "immigrants", "refugees", "foreigners", "natives"),
    ("person", "disabled", "blind", "deaf", "old", "young"),
    ("personnes", "femmes", "hommes", "filles", "garçons"),
    ("personne", "femme", "homme", "fille", "garçon"),
    ("personnes", "musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("personne", "musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("personne", "homosexuel", "lesbienne", "bisexuel", "transgenre", "hétérosexuel"),
    ("personne", "noir", "blanc", "asiatique", "africain", "latino", "arabe"),
    ("personnes", "immigrés", "réfugiés", "étrangers", "autochtones"),
    ("personne", "handicapé", "aveugle", "sourd", "vieux", "jeune"),
    ("menschen", "frauen", "männer", "mädchen", "jungen"),
    ("mensch", "frau", "mann", "mädchen", "junge"),
    ("menschen", "muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("mensch", "muslim", "christ", "jude", "hindu", "buddhist", "atheist"),
    ("mensch", "schwul", "lesbisch", "bisexuell", "transgender", "heterosexuell"),
    ("mensch", "schwarz", "weiß", "asiatisch", "afrikanisch", "latino", "arabisch"),
    ("menschen", "einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("mensch", "behindert", "blind", "taub", "alt", "jung"),
    ("personas", "mujeres", "hombres", "niñas", "niños"),
    ("persona", "mujer", "hombre", "niña", "niño"),
    ("personas", "musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("persona", "musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
    ("persona", "homosexual", "lesbiana", "bisexual", "transgénero", "heterosexual"),
    ("persona", "negro", "blanco", "asiático", "africano", "latino", "árabe"),
    ("personas", "inmigrantes", "refugiados", "extranjeros", "nativos"),
    ("persona", "discapacitado", "ciego", "sordo", "viejo", "joven"),
)
STARTS = (4, 5, 6, 7)
#: Documented bounds of the fit: labelled rows, and features of the model.
SAMPLE, FEATURES = 24_000, 4096
LEAST_ROWS = 4
#: Least likelihood ratio of a feature: below it, chance alone explains the counts.
LEAST_RATIO = 15.0
SWAP_PENALTY, RIDGE, STEPS = 4.0, 2e-4, 400


class Features:
    """64-bit features of words: the word, and its first 4 to 7 bytes."""

    def __init__(self):
        self.table, self.hash = separators(alnum_only=True), WordHash(lower_table())

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Feature and row of each word and word start, with repeats."""
        data, at = raw(texts)
        starts, ends, first = spans(data, at, self.table)
        row = row_of(first)
        out, rows = [self.hash(data, starts, ends)], [row]
        for k in STARTS:
            long = ends - starts > k
            out.append(mixed(self.hash(data, starts[long], starts[long] + k) + np.uint64(k)))
            rows.append(row[long])
        return np.concatenate(out), np.concatenate(rows)

    def word(self, word: str) -> np.ndarray:
        return np.unique(self.of(pa.array([word]))[0])


@dataclass
class Model:
    """Sorted features with their weights, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.features >> np.uint64(48)).astype(np.int64)] = True

    def index(self, found: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``features`` and row of each distinct feature that the model holds."""
        if not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = self.near[(found >> np.uint64(48)).astype(np.int64)]
        found, row = found[maybe], row[maybe]
        place = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        hit = self.features[place] == found
        pairs = np.unique(row[hit].astype(np.int64) * len(self.features) + place[hit])
        return pairs % len(self.features), pairs // len(self.features)

    def scores(self, texts: pa.Array, reader: Features) -> np.ndarray:
        place, row = self.index(*reader.of(texts))
        z = self.bias + np.bincount(row, self.weights[place], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_weights(rows: list[np.ndarray], labels: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]], n: int,
                penalty: float = SWAP_PENALTY, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Logistic regression over presence rows. ``swaps``: for pairs of texts, the features lost and gained by the swap;
    the mean squared change of the score is penalised. Accelerated gradient steps with a step per feature."""
    size = np.array([len(r) for r in rows])
    col = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    m = max(len(rows), 1)
    pair = np.repeat(np.arange(len(swaps)), [len(a) + len(b) for a, b in swaps]).astype(np.int64)
    swap_col = np.concatenate([np.concatenate(s) for s in swaps]).astype(np.int64) if swaps else np.zeros(0, np.int64)
    sign = np.concatenate([np.repeat([-1.0, 1.0], [len(a), len(b)]) for a, b in swaps]) if swaps else np.zeros(0)
    share = max(len(swaps), 1)
    weights, bias = np.zeros(n), float(np.log((labels.mean() + 1e-4) / (1 - labels.mean() + 1e-4))) if len(labels) else 0.0
    base = bias
    seen = np.zeros(n + 1)
    for _ in range(steps):
        z = bias + np.bincount(row, weights[col], len(rows))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        err = (p - labels) / m
        grad = np.bincount(col, err[row], n) + ridge * weights
        if len(swaps):
            change = np.bincount(pair, sign * weights[swap_col], len(swaps))
            grad += penalty * 2 / share * np.bincount(swap_col, sign * change[pair], n)
        seen[:-1] += grad ** 2
        seen[-1] += err.sum() ** 2
        weights -= 0.3 * grad / np.sqrt(seen[:-1] + 1e-12)
        bias -= 0.3 * err.sum() / np.sqrt(seen[-1] + 1e-12)
    return weights, bias if np.isfinite(bias) else base


def _swapped(texts: pa.Array, reader: Features, groups: Sequence[Sequence[str]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, features lost and features gained for each group name in a text and each other name of its row."""
    words = {w: reader.word(w) for g in groups for w in g}
    whole = {int(reader.of(pa.array([w]))[0][0]): w for w in words}
    names = np.array(sorted(whole), np.uint64)
    for i in range(len(texts)):
        found, _ = reader.of(texts.slice(i, 1))
        for h in np.intersect1d(found, names):
            old = whole[int(h)]
            for group in groups:
                for new in group if old in group else ():
                    if new != old:
                        yield i, words[old], words[new]


def train(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic",
          groups: Sequence[Sequence[str]] = GROUPS, sample: int = SAMPLE, features: int = FEATURES,
          penalty: float = SWAP_PENALTY) -> Model:
    """Fit on labelled rows where ``learn`` holds: at most ``sample`` of them by a hash of the key.

    Feature counts are taken by Spark; the ``features`` with the largest likelihood ratios (twice the log), if at least ``LEAST_RATIO``, the features of the group
    terms, and the rows as lists of those come to the driver. Keys labelled both ways and null labels are left out.
    Without both labels every score is the share of label 1 (0.5 with no rows).
    """
    marked = labels.filter(learn & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.min(label).cast("int").alias("_label"), F.max(label).cast("int").alias("_most")).filter("_label = _most")
    chosen = marked.orderBy(F.xxhash64(F.col("_key").cast("string"), F.lit("toxicity")), "_key").limit(sample)
    rows = docs.join(F.broadcast(chosen), docs[key] == F.col("_key")).select("_key", "_label", F.col(text).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Features()
        for batch in batches:
            for piece in slices(batch, "text"):
                toxic = piece.column("_label").to_numpy(zero_copy_only=False).astype(np.int64)
                found, row = reader.of(piece.column("text"))
                order = np.lexsort((row, found))
                found, row = found[order], row[order]
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
                found, row = found[new], row[new]
                if len(found):
                    names, at = np.unique(found, return_index=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(names.view(np.int64)), pa.array(np.add.reduceat(toxic[row], at)),
                        pa.array(np.diff(np.append(at, len(found))).astype(np.int64))], ["feature", "toxic", "n"])

    totals = chosen.agg(F.coalesce(F.sum("_label"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    t, n = int(totals.t), int(totals.n)
    if t == 0 or t == n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((t + 0.5) / (n - t + 0.5))))
    counts = rows.mapInArrow(counted, "feature bigint, toxic bigint, n bigint").groupBy("feature").agg(
        F.sum("toxic").alias("a"), F.sum("n").alias("b")).filter(F.col("b") >= LEAST_ROWS)
    part = lambda k, of: F.when(k > 0, k * F.log(k / of)).otherwise(0.0)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    ratio = (part(a, b * t / n) + part(b - a, b * (n - t) / n) + part(t - a, (n - b) * t / n) + part(n - t - b + a, (n - b) * (n - t) / n))
    best = [r.feature for r in counts.select("feature", (2 * ratio).alias("g")).filter(F.col("g") >= LEAST_RATIO).orderBy(F.desc("g"), "feature").limit(features).collect()]
    reader = Features()
    terms = np.concatenate([reader.word(w) for g in groups for w in g]) if groups else np.zeros(0, np.uint64)
    model = Model(np.unique(np.concatenate((np.array(best, np.int64).view(np.uint64), terms))), np.zeros(0), 0.0)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features()
        for batch in batches:
            for piece in slices(batch, "text"):
                texts = piece.column("text").fill_null("")
                place, row = model.index(*own.of(texts))
                cut = np.searchsorted(row, np.arange(len(piece) + 1))
                swaps: list[list[bytes]] = [[] for _ in range(len(piece))]
                for i, lost, gained in _swapped(texts, own, groups):
                    swaps[i].append(b"".join(np.searchsorted(model.features, x).astype(np.int32).tobytes() + b"||||" for x in (lost, gained)))
                yield pa.RecordBatch.from_arrays([
                    piece.column("_key").cast(pa.string()), piece.column("_label").cast(pa.int32()),
                    pa.array([place[s:e].astype(np.int32).tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    pa.array(swaps, pa.list_(pa.binary()))], ["key", "label", "places", "swaps"])

    held = sorted(rows.mapInArrow(indexed, "key string, label int, places binary, swaps array<binary>").limit(2 * sample).collect(),
                  key=lambda r: (r.key, bytes(r.places)))
    pairs = [tuple(np.frombuffer(x, np.int32) for x in bytes(s).split(b"||||")[:2]) for r in held for s in r.swaps]
    weights, bias = fit_weights([np.frombuffer(r.places, np.int32) for r in held], np.array([r.label for r in held], float), pairs,
                                len(model.features), penalty)
    return Model(model.features, weights, bias)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with ``score`` from 0 to 1; null and empty texts have the bias alone.

    Texts are read whole, rows are judged each, nothing is shuffled.
    """
    kept = docs.drop("score").withColumnRenamed(text, "_text")
    names = [c for c in kept.columns if c != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "_text")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Features()
        for batch in batches:
            for piece in slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(model.scores(piece.column("_text"), reader))],
                                                 [*names, "score"])

    return kept.mapInArrow(judged, f"{schema}{', ' if schema else ''}score double")
