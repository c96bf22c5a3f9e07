"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds one bit slice per language; the slices share their hash positions, so
one probe of an n-gram (the AND of the words at its positions) returns the bitmask of all languages
that may contain it. A text's languages are compared by their popcounts, each corrected for the
slice's false-positive rate.

Training counts character n-grams of a bounded sample of texts (``sample_per_lang`` per language, by a
hash of doc_id) on the executors. An n-gram enters a language's slice if that language's relative
frequency is at least ``exclusive`` of the largest one and its count at least ``min_count``.

Defined cases: a null text, or one without letters, is ``und`` with score 0; a text in which no known
n-gram occurs gets the most frequent training language (ties: the first by name) with score 0; null
languages are never learned; with no training rows everything is ``und``; repeated rows are scored
each; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_share, map_rows, split_bucket

#: Lengths of character n-grams.
GRAMS = (3, 4)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_hashes(text: str, letters: np.ndarray) -> np.ndarray:
    """64-bit hashes of the text's n-grams; everything but letters is one blank, words carry blanks at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letters[codes], codes, np.uint32(32))
    blank = codes == 32
    codes = codes[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.uint64)
    if codes.size < 3:
        return np.empty(0, np.uint64)
    out = []
    for n in GRAMS:
        if codes.size < n:
            continue
        h = np.full(codes.size - n + 1, n, np.uint64)
        for i in range(n):
            h = (h * np.uint64(0x100000001B3)) ^ codes[i : codes.size - n + 1 + i]
        h *= _MIX[0]
        h ^= h >> np.uint64(29)
        out.append(h)
    return np.concatenate(out)


@dataclass
class BitSlicedBloom:
    """``words[slot, w]`` holds the bits of languages 64*w ... 64*w+63; all languages share the positions."""

    langs: list[str]
    log2_slots: int
    hashes: int
    words: np.ndarray
    prior: str

    @classmethod
    def empty(cls, langs: list[str], log2_slots: int, hashes: int, prior: str) -> BitSlicedBloom:
        return cls(langs, log2_slots, hashes, np.zeros((1 << log2_slots, max(1, -(-len(langs) // 64))), np.uint64), prior)

    def positions(self, grams: np.ndarray) -> list[np.ndarray]:
        shift = np.uint64(64 - self.log2_slots)
        step = (grams * _MIX[1]) | np.uint64(1)
        return [((grams + np.uint64(k) * step) * _MIX[0]) >> shift for k in range(self.hashes)]

    def add(self, lang: int, grams: np.ndarray) -> None:
        for at in self.positions(grams):
            self.words[at, lang // 64] |= np.uint64(1 << lang % 64)

    def probe(self, grams: np.ndarray) -> np.ndarray:
        """Bitmasks of the languages that may contain each n-gram."""
        found = None
        for at in self.positions(grams):
            found = self.words[at] if found is None else found & self.words[at]
        return found

    def false_positive_rates(self) -> np.ndarray:
        fill = np.array([np.count_nonzero(self.words[:, i // 64] & np.uint64(1 << i % 64)) for i in range(len(self.langs))])
        return (fill / self.words.shape[0]) ** self.hashes

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """Popcounts per language over the probes, by histograms of the masks' bytes."""
        octets = np.ascontiguousarray(self.probe(grams)).view(np.uint8).reshape(grams.size, -1)
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        per = [np.bincount(octets[:, i], minlength=256) @ bits for i in range(-(-len(self.langs) // 8))]
        return np.concatenate(per)[: len(self.langs)]


def train(docs: DataFrame, sample_per_lang: int = 2000, min_count: int = 3, exclusive: float = 0.5, log2_slots: int = 20, hashes: int = 2) -> BitSlicedBloom | None:
    """Learn the filter from (doc_id, text, lang) rows; the caller has removed the rows held out."""
    rows = docs.select("doc_id", "text", "lang").filter("lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    index = {x: i for i, x in enumerate(langs)}
    chosen = F.lit(False)
    for x in langs:
        chosen = chosen | ((F.col("lang") == x) & hash_share(F.col("doc_id"), 6, min(1.0, sample_per_lang / sizes[x])))

    def make():
        letters, seen = letter_table(), {}

        def step(cols):
            for text, lang in zip(*cols, strict=True):
                grams, n = np.unique(gram_hashes(text or "", letters), return_counts=True)
                mine = seen.setdefault(index[lang], {})
                for g, k in zip(grams.view(np.int64).tolist(), n.tolist(), strict=True):
                    mine[g] = mine.get(g, 0) + k
            return iter(())

        def finish():
            for lang, mine in seen.items():
                for g, k in mine.items():
                    yield g, lang, k

        step.finish = finish
        return step

    counted = map_rows(rows.filter(chosen).select("text", "lang"), "gram long, lang int, n long", make).groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counted.persist()
    try:
        totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        share = F.create_map(*[x for k, v in totals.items() for x in (F.lit(k), F.lit(1.0 / v))]) if totals else F.lit(None)
        kept = (
            counted.withColumn("f", F.col("n") * share[F.col("lang")])
            .groupBy("gram")
            .agg(F.collect_list(F.struct("lang", "f", "n")).alias("all"), F.max("f").alias("most"))
            .select("gram", F.explode(F.filter("all", lambda x: (x["f"] >= F.col("most") * exclusive) & (x["n"] >= min_count))).alias("x"))
            .select("gram", "x.lang")
            .toPandas()
            if totals
            else None
        )
    finally:
        counted.unpersist()
    prior = min(langs, key=lambda x: (-sizes[x], x))
    bloom = BitSlicedBloom.empty(langs, log2_slots, hashes, prior)
    if kept is not None:
        for lang, grams in kept.groupby("lang")["gram"]:
            bloom.add(int(lang), grams.to_numpy(np.int64).view(np.uint64))
    return bloom


def score_text(text: str | None, bloom: BitSlicedBloom | None, rates: np.ndarray | None, letters: np.ndarray) -> tuple[str, float]:
    if bloom is None or not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    grams = gram_hashes(text, letters)
    if not grams.size:
        return bloom.prior, 0.0
    fixed = np.maximum(0.0, (bloom.counts(grams) - grams.size * rates) / np.maximum(1e-9, 1.0 - rates))
    total = float(fixed.sum())
    if total <= 0:
        return bloom.prior, 0.0
    best = int(np.argmax(fixed))
    return bloom.langs[best], float(fixed[best]) / total


def predict(docs: DataFrame, bloom: BitSlicedBloom | None, keep: list[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with lang_pred and score. Only the text decides. The filter's size is fixed (8 MB by default)."""
    keep = list(keep)
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def make():
        bloom, letters = shared.value, letter_table()
        rates = bloom.false_positive_rates() if bloom else None

        def step(cols):
            for *kept, text in zip(*cols, strict=True):
                yield (*kept, *score_text(text, bloom, rates, letters))

        return step

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return map_rows(docs.select(*keep, F.col("text").alias("__text")), schema, make, 1000)


def identify_languages(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learns from rows whose crc32(doc_id) mod 5 is not 0."""
    bloom = train(docs.filter(split_bucket(F.col("doc_id"), 5) != 0), **options)
    out = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), bloom)
    return out.select("doc_id", (split_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
