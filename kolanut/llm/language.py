"""Language identification with a blended-spectrum string kernel.

A text is the set of its byte n-grams of 1 to 4 (ASCII lower-cased), held as bits of a hashed table; the kernel of
two texts is the number of shared n-grams over the geometric mean of their numbers. Landmark texts give
the Nyström features, and one ridge regression per language is fitted on them. The kernel is an inner product of
bit rows, so the products with all landmarks fold into one table by language, and a batch of texts is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kolanut.llm.words import lower_table, raw, row_of, slices

UNKNOWN = "und"
BITS = 1 << 14
LONGEST = 4
#: Documented bounds of the fit: labelled rows per language, labelled rows in all, and landmarks.
PER_LANGUAGE, SAMPLE, LANDMARKS = 600, 6000, 192
RIDGE = 1e-3
#: Learned rows that a limit of likeness needs.
LEAST_LEARNED = 50
_ROWS = 128


def bit_rows(texts: pa.Array, bits: int = BITS, longest: int = LONGEST) -> Iterator[np.ndarray]:
    """Presence tables (rows x bits) of at most _ROWS texts each; whole texts, n-grams do not cross texts."""
    lower = lower_table()
    for i in range(0, len(texts), _ROWS):
        data, at = raw(texts.slice(i, _ROWS))
        data = lower[data].astype(np.uint32)
        n = len(at) - 1
        seen = np.zeros(n * bits, bool)
        for begin in range(0, len(data), 1 << 20):  # pieces overlap by an n-gram
            piece = data[begin:begin + (1 << 20) + longest - 1]
            place = np.arange(begin, min(begin + (1 << 20), len(data)))
            row = np.searchsorted(at, place, "right") - 1
            room = at[row + 1] - place
            base = row * bits
            code = np.zeros(len(place), np.uint32)
            for k in range(longest):
                fits = room > k
                if k:
                    place, base, room, code = place[fits], base[fits], room[fits], code[fits]
                code = (code << np.uint32(8)) | piece[place - begin + k]
                mix = (code + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                mix = (mix ^ (mix >> np.uint32(15))) * np.uint32(0xC2B2AE35)
                seen[base + (mix >> np.uint32(32 - bits.bit_length() + 1))] = True
        yield seen.reshape(n, bits)


@dataclass
class Model:
    """``table`` (bits x languages): folded landmarks and weights."""

    languages: list[str]
    table: np.ndarray

    def scores(self, seen: np.ndarray) -> np.ndarray:
        """One regression value per text and language; texts without n-grams get zeros."""
        sizes = np.sqrt(np.maximum(seen.sum(1, dtype=np.int64), 1)).astype(np.float32)
        return (seen.astype(np.float32) @ self.table) / sizes[:, None]


def fit(seen: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström features over the first ``landmarks`` rows, then kernel ridge regression, one language against the rest."""
    languages = sorted(set(langs))
    unit = seen / np.sqrt(np.maximum(seen.sum(1, keepdims=True), 1))
    marks = unit[:landmarks]
    values, vectors = np.linalg.eigh(marks @ marks.T)
    good = values > 1e-8 * max(values.max(), 1e-30)
    root = vectors[:, good] / np.sqrt(values[good])
    features = (unit @ marks.T) @ root
    wanted = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weights = np.linalg.solve(features.T @ features + ridge * len(langs) * np.eye(features.shape[1]), features.T @ wanted)
    return Model(languages, np.ascontiguousarray(marks.T @ (root @ weights), dtype=np.float32))


@dataclass
class Likeness:
    """``table`` (bits x languages): log shares of a language's texts that hold an n-gram. Texts below ``limit`` are like none of them."""

    table: np.ndarray
    limit: float

    def of(self, seen: np.ndarray) -> np.ndarray:
        """The mean of a text's n-grams in the language that gives it most; it falls for texts unlike all, whatever their length."""
        return (seen.astype(np.float32) @ self.table).max(1) / np.maximum(seen.sum(1, dtype=np.int64), 1)


def _shares(seen: np.ndarray, langs: np.ndarray, languages: list[str]) -> np.ndarray:
    """Log shares per language, drawn to those of all texts by the weight of one text, so that a language of few texts is not like everything."""
    least = 0.5 / (len(seen) + 1)
    every = (seen.sum(0) + 0.5) / (len(seen) + 1)
    rows = [langs == x for x in languages]
    return np.log(np.maximum(np.stack([(seen[r].sum(0) + every) / (r.sum() + 1) for r in rows], axis=1), least)).astype(np.float32)


def fit_likeness(seen: np.ndarray, langs: list[str]) -> Likeness:
    """The limit comes from the learned rows, each half judged by the other: as far below their lowest hundredth as that is below their
    median. Below ``LEAST_LEARNED`` rows nothing can be told, and no text is below the limit."""
    names, languages = np.array(langs), sorted(set(langs))
    limit = -np.inf
    if len(seen) >= LEAST_LEARNED:
        odd = np.arange(len(seen)) % 2 == 1
        judged = np.concatenate([Likeness(_shares(seen[~h], names[~h], languages), limit).of(seen[h]) for h in (odd, ~odd)])
        low, middle = np.quantile(judged, [0.01, 0.5])
        limit = float(2 * low - middle)
    return Likeness(_shares(seen, names, languages), limit)


def letters(text: str) -> Column:
    """The text in lower case with one space for all between letters: figures, signs and addresses are in no language."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}]+", " "))


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def _learned(docs: DataFrame, learn: Column, key: str, text: str, lang: str, per_language: int, sample: int) -> tuple[np.ndarray, list[str]] | None:
    """Bit rows and languages of rows where ``learn`` holds and text and language are given; None without such rows.

    At most ``per_language`` rows of a language and ``sample`` rows in all, by a hash of the key; only their bit rows
    (2 KB each) come to the driver, however long the texts are.
    """
    able = docs.filter(learn & F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    order = F.xxhash64(F.col(key).cast("string"), F.lit("language"))
    first = able.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), order.alias("_order")).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_lang").orderBy("_order", "_key"))).filter(F.col("_rank") <= per_language)
    chosen = first.orderBy("_rank", "_order", "_key").limit(sample).select("_key").distinct()
    rows = able.join(F.broadcast(chosen), able[key] == chosen["_key"]).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), order.alias("at"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.packbits(row).tobytes() for seen in bit_rows(batch.column("text")) for row in seen]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("at"), pa.array(found, pa.binary())], ["lang", "at", "bits"])

    held = sorted(((r.at, r.lang, bytes(r.bits)) for r in rows.mapInArrow(bits, "lang string, at bigint, bits binary").limit(2 * sample).collect()))
    if not held:
        return None
    seen = np.stack([np.unpackbits(np.frombuffer(b, np.uint8)) for _, _, b in held]).astype(np.float32)
    return seen, [x for _, x, _ in held]


def train(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
          per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model | None:
    """Fit on the learned rows; None without any."""
    found = _learned(docs, learn, key, text, lang, per_language, sample)
    return fit(*found) if found else None


def train_known(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
                per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> tuple[Model, Likeness] | None:
    """The kernel model and the likeness of the same learned rows, both by their letters; None without any."""
    found = _learned(docs.withColumn(text, letters(text)), learn, key, text, lang, per_language, sample)
    return (fit(*found), fit_likeness(*found)) if found else None


def _judge(seen: np.ndarray, model: Model, known: Likeness | None) -> tuple[np.ndarray, np.ndarray]:
    """Scores per language, and whether a text is like any of them."""
    got = model.scores(seen)
    return got, np.full(len(got), True) if known is None else known.of(seen) >= known.limit


def predict(docs: DataFrame, model: Model | None, text: str = "text", known: Likeness | None = None) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (0 to 1).

    With ``known`` (both of ``train_known``) texts are read by their letters, and one unlike all learned languages is ``und`` too.

    ``und`` with score 0 where the text is null or empty or holds no letter, or nothing was learned. Ties go to the
    language that comes first. Repeated rows are judged each; nothing is shuffled, texts are read whole.
    """
    kept = docs.drop("lang_pred", "score")
    read = kept.withColumn("_text", F.when(F.col(text).rlike(r"\p{L}"), F.col(text) if known is None else letters(text)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "_text"):
                texts = piece.column("_text")
                langs, scores = [UNKNOWN] * len(piece), np.zeros(len(piece))
                if model is not None and texts.null_count < len(texts):
                    got, like = (np.concatenate(x) for x in zip(*(_judge(seen, model, known) for seen in bit_rows(texts)), strict=True))
                    best = got.argmax(1)
                    able = texts.is_valid().to_numpy(zero_copy_only=False) & like
                    langs = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, able, strict=True)]
                    scores = np.where(able, np.clip((got.max(1).astype(float) + 1) / 2, 0, 1), 0)
                names = [c for c in piece.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                                 [*names, "lang_pred", "score"])

    return read.mapInArrow(judged, f"{schema}{', ' if schema else ''}lang_pred string, score double")
