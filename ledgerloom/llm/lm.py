"""LM scoring with a log-frequency Bloom filter of quantised n-gram counts.

Counting covers every training document and every n-gram: workers hash tokens (XXH64) and token pairs, aggregate
blocks of texts, and one shuffle by filter shard adds up exact counts. A shard's task sees its n-grams in order,
stores for an n-gram of count c the levels 1 ... q, q = 1 + floor(log2 c), in a bit array that it sizes by the
levels it has counted, and sums up the pairs of each first token. A count is read back by probing level after
level until one is missing, so it can only be overestimated, and with a probability that falls by the
false-positive rate (about 0.06) for each level.

score: sum over tokens of log10 of  max(c(v w) - D, 0) / T(v) + D N(v) / T(v) * (c(w) + 1) / Z,  where c are the
filter's counts (the middle of a level), v is the token before (the end token at the start), D = 0.75 the
discount, T(v) the sum and N(v) the number of the counts of v's pairs, and Z the sum of c(w) + 1 over the
vocabulary and one for an unseen token; after an unseen v it is the last factor alone. So the probabilities after
any v add up to 1, but for false positives and hash collisions. T and N are held exactly for tokens seen three
times or more; a token seen once has T = N = 1; one seen twice has T = N = 2 where the filter marks it so, else
T = 2.5 and N = 1.

The filter and the table of tokens are broadcast while they have at most ``broadcast_bytes`` and ``common``
entries (counted). Beyond that texts' distinct n-grams are dealt out to the filter's shards where these lie, and
joined with the tokens' table. One rule holds on both ways: tokens seen three times or more are looked up exactly, all
others and all pairs are read from the filter, so the scores are the same. base_score uses exact counts: those of common
tokens from the table, the rest joined.

Defined cases: a null text is the empty text, whose only token is the end; with no training rows every
count is 0; repeated rows are scored each; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import release, remove, ship, split_bucket, stored, whole_text

#: Stands for the end of a text; no word contains a line break.
END = xxhash.xxh64_intdigest(b"\n", 0)
UNIGRAM, BIGRAM = 0, 1
#: Rows that counting gives.
WORD, CONTEXT, SHARD = 0, 1, 2
#: Tokens of a block, bytes of text for each shard, and the share of all tokens from which a token's pairs are spread over all shards.
BLOCK, SHARD_BYTES, HOT = 1 << 20, 1 << 20, 1 / 2000
HASHES, BITS = 3, 6
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64(0xFFFFFFFF)
_SLICE = 1000


def mix(h: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, text after text with the end token after each, and each text's number of tokens."""
    digest, out, sizes = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        h = np.empty(len(words) + 1, np.uint64)
        h[:-1] = np.fromiter(map(digest, words), np.uint64, len(words))
        h[-1] = END
        out.append(h)
        sizes.append(h.size)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.array(sizes, np.int64)


def before(tokens: np.ndarray) -> np.ndarray:
    """The token before each; texts follow each other, so a text starts after an end token."""
    return np.concatenate((np.array([END], np.uint64), tokens[:-1]))


def context(tokens: np.ndarray) -> np.ndarray:
    """The 32 bits by which a token is known as the first of a pair."""
    return mix(tokens) >> np.uint64(32)


def pair_hashes(first: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The first token's 32 bits, then 32 bits of both."""
    return context(first) << np.uint64(32) | mix(first * _M1 + (tokens ^ _M3)) & _LOW


# ---------------------------------------------------------------- filter
def levels(n: np.ndarray) -> np.ndarray:
    """1 + floor(log2 n) for n of at least 1, else 0."""
    return np.where(n > 0, np.frexp(np.maximum(n, 1).astype(np.float64))[1], 0)


def typical(q: np.ndarray) -> np.ndarray:
    """The middle of a level's counts: 1, 2.5, 5.5, ...; 0 for level 0."""
    return np.where(q > 0, np.exp2(q - 1.0) * 1.5 - 0.5, 0.0)


def shard_of(h: np.ndarray, kind: int, hot: np.ndarray, shard_bits: int) -> np.ndarray:
    """Pairs lie with the others of their first token, but for hot ones; tokens by their hash."""
    if kind == BIGRAM:
        first = h >> np.uint64(32)
        spread = hot[np.minimum(np.searchsorted(hot, first), max(0, hot.size - 1))] == first if hot.size else np.zeros(h.size, bool)
        h = np.where(spread, h, first)
    return (mix(h + _M1) >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(h.size, np.int64)


def keys(h: np.ndarray, kind: int) -> np.ndarray:
    """What the filter stores for an n-gram, before its level."""
    return mix(h ^ _M2) if kind == BIGRAM else mix(h ^ _M3)


def two_keys(contexts: np.ndarray) -> np.ndarray:
    """The mark of a token seen twice and followed by two different ones."""
    return mix((contexts << np.uint64(1)) ^ _M1)


def _step(level: int, k: int) -> np.uint64:
    return np.uint64((2 * (level * 16 + k) + 1) * int(_M1) & 0xFFFFFFFFFFFFFFFF)


def places(key: np.ndarray, level: int, k: int, bits: np.ndarray | int) -> np.ndarray:
    """Bit numbers below ``bits``."""
    return (mix(key + _step(level, k)) >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32) if np.isscalar(bits) else (mix(key + _step(level, k)) >> np.uint64(32)) * bits >> np.uint64(32)


def build(entries: list[tuple[np.ndarray, np.ndarray]], each: int = BITS) -> np.ndarray:
    """Bytes of a shard that stores each (keys, levels); ``each`` bits for every level."""
    bits = min((1 << 32) - 64, max(64, -(-each * sum(int(q.sum()) for _, q in entries) // 64) * 64))
    flags = np.zeros(bits, bool)
    for key, q in entries:
        level = 1
        while key.size:
            for k in range(HASHES):
                flags[places(key, level, k, bits)] = True
            level += 1
            stay = q >= level
            key, q = key[stay], q[stay]
    return np.packbits(flags, bitorder="little")


def probe(data: np.ndarray, start: np.ndarray, bits: np.ndarray, key: np.ndarray, most: int = 63) -> np.ndarray:
    """Each key's level in the shard that starts at byte ``start`` and has ``bits`` bits."""
    out, at = np.zeros(key.size, np.int64), np.flatnonzero(bits)
    level = 1
    while at.size and level <= most:
        here = np.ones(at.size, bool)
        for k in range(HASHES):
            spot = places(key[at], level, k, bits[at])
            here &= (data[start[at] + (spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        at = at[here]
        out[at] = level
        level += 1
    return out


class LogFrequencyBloom:
    """All shards in one array, to be broadcast."""

    def __init__(self, shard_bits: int, hot: np.ndarray, shards: Iterable[tuple[int, bytes]], size: int | None = None):
        """``size`` is the shards' bytes in all; with it each is copied as it comes and none is held twice."""
        if size is None:
            shards = list(shards)
            size = sum(len(d) for _, d in shards)
        self.shard_bits, self.hot = shard_bits, hot
        self.start, self.bits = np.zeros(1 << shard_bits, np.int64), np.zeros(1 << shard_bits, np.uint64)
        self.data, at = np.zeros(size, np.uint8), 0
        for k, d in shards:
            self.start[k], self.bits[k] = at, 8 * len(d)
            self.data[at : at + len(d)] = np.frombuffer(d, np.uint8)
            at += len(d)

    def levels(self, h: np.ndarray, kind: int) -> np.ndarray:
        shard = shard_of(h, kind, self.hot, self.shard_bits)
        return probe(self.data, self.start[shard], self.bits[shard], keys(h, kind))

    def twos(self, contexts: np.ndarray) -> np.ndarray:
        shard = shard_of(contexts << np.uint64(32), BIGRAM, self.hot, self.shard_bits)
        return probe(self.data, self.start[shard], self.bits[shard], two_keys(contexts), 1) > 0


# ---------------------------------------------------------------- counting
def hot_contexts(docs: DataFrame, sample: int = 2000) -> np.ndarray:
    """Contexts of the tokens that hold ``HOT`` of the tokens of the ``sample`` documents first by hash; they decide where pairs are stored, not what is."""
    texts = [r["text"] for r in docs.orderBy(F.xxhash64("doc_id", "text")).limit(sample).select(F.substring("text", 1, 20_000).alias("text")).collect()]
    tokens, _ = token_hashes(texts)
    values, n = np.unique(tokens, return_counts=True)
    return np.unique(np.append(context(values[n >= max(8, HOT * tokens.size)]), context(np.array([END], np.uint64))))


def blocks(batches, column: int):
    """Slices of Arrow batches, as lists of texts with about ``BLOCK`` tokens at most."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            for text in batch.column(column).slice(at, _SLICE).to_pylist():
                held.append(text)
                size += len(text) // 6 + 1
                if size >= BLOCK:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def count(docs: DataFrame, hot: np.ndarray, shard_bits: int, each: int = BITS) -> DataFrame:
    """(what, h, n, total, data): words with their counts; contexts with the number n and sum of their pairs' counts, some in several rows; and shards of the filter."""
    out_names = ["what", "h", "n", "total", "data"]

    def grams(batches):
        for texts in blocks(batches, 0):
            tokens, _ = token_hashes(texts)
            for kind, h in ((UNIGRAM, tokens), (BIGRAM, pair_hashes(before(tokens), tokens))):
                values, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(values, kind, hot, shard_bits).astype(np.int32) * 2 + kind), pa.array(values.view(np.int64)), pa.array(n.astype(np.int32))], names=["place", "h", "n"])

    def rows(what, h, n, total=None, data=None):
        k = len(h)
        return pa.RecordBatch.from_arrays([pa.array(np.full(k, what, np.int8)), pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.nulls(k, pa.float64()) if total is None else pa.array(total, pa.float64()), pa.nulls(k, pa.binary()) if data is None else pa.array(data, pa.binary())], names=out_names)

    def finish(shard, parts):
        """The rows of one shard from its sorted (h, n) of each kind."""
        entries = []
        for kind, (h, n) in sorted(parts.items()):
            first = np.concatenate(([True], h[1:] != h[:-1]))
            values, sums = h[first].view(np.uint64), np.add.reduceat(n, np.flatnonzero(first))
            entries.append((keys(values, kind), levels(sums)))
            if kind == UNIGRAM:
                yield rows(WORD, values.view(np.int64), sums)
            else:
                ctx = values >> np.uint64(32)
                order = np.argsort(ctx, kind="stable")
                start = np.flatnonzero(np.concatenate(([True], ctx[order][1:] != ctx[order][:-1])))
                ctx, number = ctx[order][start], np.diff(np.append(start, ctx.size))
                seen, total = np.add.reduceat(sums[order], start), np.add.reduceat(typical(levels(sums))[order], start)
                entries.append((two_keys(ctx[(seen == 2) & (number == 2)]), np.ones(int(((seen == 2) & (number == 2)).sum()), np.int64)))
                keep = (total > 1) | (hot[np.minimum(np.searchsorted(hot, ctx), hot.size - 1)] == ctx)
                yield rows(CONTEXT, ctx[keep].view(np.int64), number[keep], total[keep])
        yield rows(SHARD, [shard], [0], data=[build(entries, each).tobytes()])

    def add(batches):
        shard, parts = None, {}
        for batch in batches:
            place, h, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for a, b in zip(edges := [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), place.size], edges[1:], strict=False):
                if a == b:
                    continue
                here, kind = divmod(int(place[a]), 2)
                if here != shard and parts:
                    yield from finish(shard, {k: tuple(map(np.concatenate, zip(*v, strict=True))) for k, v in parts.items()})
                    parts = {}
                shard = here
                parts.setdefault(kind, []).append((h[a:b].astype(np.int64), n[a:b].astype(np.int64)))
        if parts:
            yield from finish(shard, {k: tuple(map(np.concatenate, zip(*v, strict=True))) for k, v in parts.items()})

    placed = docs.select("text").mapInArrow(grams, "place int, h long, n int")
    dealt = placed.repartition(F.expr("place div 2")).sortWithinPartitions("place", "h")
    return dealt.mapInArrow(add, "what byte, h long, n long, total double, data binary")


class Model:
    """What scoring reads: the tokens' table sorted by hash (h, n, T, N), the filter, and the sums over the vocabulary."""

    def __init__(self, table: tuple, bloom: LogFrequencyBloom, z: float, discount: float):
        self.table, self.bloom, self.z, self.discount = table, bloom, z, discount

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = self.table[0]
        if not known.size:
            return np.zeros(h.size, np.int64), np.zeros(h.size, bool)
        spot = np.minimum(np.searchsorted(known, h), known.size - 1)
        return spot, known[spot] == h

    def of_tokens(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The counts of distinct tokens by level, and T and N of their pairs."""
        spot, found = self.find(h)
        c, t, n = np.zeros(h.size), np.zeros(h.size), np.zeros(h.size)
        for out, col in ((c, 1), (t, 2), (n, 3)):
            out[found] = self.table[col][spot[found]]
        c[found] = levels(c[found])
        rest = np.flatnonzero(~found)
        c[rest] = self.bloom.levels(h[rest], UNIGRAM)
        t[rest] = n[rest] = c[rest] > 0
        some = rest[c[rest] >= 2]
        two = self.bloom.twos(context(h[some]))
        t[some], n[some] = np.where(two, 2.0, 2.5), np.where(two, 2.0, 1.0)
        return typical(c), t, n

    def logs(self, tokens: np.ndarray) -> np.ndarray:
        """log10 of each token's probability."""
        first = before(tokens)
        values, back = np.unique(np.append(tokens, np.uint64(END)), return_inverse=True)
        c, t, n = self.of_tokens(values)
        one = back[:-1]
        prev = np.append(back[-1], one[:-1])
        pairs, again = np.unique(pair_hashes(first, tokens), return_inverse=True)
        both = typical(self.bloom.levels(pairs, BIGRAM))[again]
        return np.log10(probability(both, t[prev], n[prev], c[one], self.z, self.discount))


def probability(both, t, n, c, z, discount):
    """The module's formula on arrays."""
    known = t > 0
    safe = np.where(known, t, 1.0)
    return np.where(known, np.maximum(both - discount, 0) / safe, 0.0) + np.where(known, discount * n / safe, 1.0) * (c + 1) / z


def train(docs: DataFrame, shard_bits: int | None = None, each: int = BITS) -> tuple[DataFrame, np.ndarray, int]:
    """Counted rows of ``count`` over all of ``docs``, stored; the hot contexts; and the shards' bits, by the bytes of text unless given."""
    ship(docs.sparkSession)
    hot = hot_contexts(docs)
    if shard_bits is None:
        size = int(docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0)
        shard_bits = min(30, max(4, (size // SHARD_BYTES).bit_length()))
    return stored(count(docs, hot, shard_bits, each)), hot, shard_bits


def score_documents(docs: DataFrame, held: int = 2, modulus: int = 7, discount: float = 0.75, common: int = 3_000_000, broadcast_bytes: int = 1 << 28, shard_bits: int | None = None, each: int = BITS, round_bytes: int = 1 << 31) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; ``each`` is the filter's bits for a stored level.

    Without a broadcast, texts are scored in rounds of about ``round_bytes`` of text each (counted), dealt by a hash; a round's
    n-grams and their shuffles are removed before the next, so the disk they need doesn't grow with the texts.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text())
    out_split = split_bucket(F.col("doc_id"), modulus) == held
    counted, hot, shard_bits = train(docs.filter(~out_split), shard_bits, each)
    words = counted.filter(F.col("what") == WORD).select("h", "n")
    mid = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n").cast("double")))) * 1.5 - 0.5
    row = words.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(mid).alias("c"), F.count_if(F.col("n") >= 3).alias("k")).first()
    n_all, vocabulary = int(row["n"] or 0), int(row["v"])
    whole, z = float(n_all + vocabulary + 1), float(row["c"] or 0) + vocabulary + 1
    shards = counted.filter(F.col("what") == SHARD).select(F.col("h").alias("shard"), "data")
    size = int(shards.agg(F.sum(F.octet_length("data")).alias("b")).first()["b"] or 0)
    contexts = counted.filter(F.col("what") == CONTEXT).groupBy(F.col("h").alias("ctx")).agg(F.sum("n").alias("pairs"), F.sum("total").alias("total"))
    small = size <= broadcast_bytes and row["k"] <= common
    if small:
        table = words.filter("n >= 3").toArrow()
        known = np.argsort(h := table["h"].to_numpy().view(np.uint64))
        h, n = h[known], table["n"].to_numpy()[known]
        # The contexts of tokens seen three times or more have a sum of at least 2.5.
        got = contexts.filter("total >= 2.5").toArrow()
        ctx, place = np.unique(got["ctx"].to_numpy().view(np.uint64), return_index=True)
        spot = place[np.searchsorted(ctx, context(h))] if h.size else np.empty(0, np.int64)
        tokens_ = (h, n, got["total"].to_numpy()[spot].astype(np.float32), got["pairs"].to_numpy()[spot].astype(np.int32))
        del table, known, got, ctx, place, spot  # before the filter is gathered
        model = Model(tokens_, LogFrequencyBloom(shard_bits, hot, ((r["shard"], r["data"]) for r in shards.toLocalIterator()), size), z, discount)
    else:
        none = np.empty(0, np.uint64)
        model = Model((none, none.astype(np.int64), none, none), LogFrequencyBloom(0, none, []), z, discount)
    shared = spark.sparkContext.broadcast(model)
    del model  # the driver needs no copy beside the broadcast file

    def run(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                tokens, sizes = token_hashes(part.column(2).to_pylist())
                if not tokens.size:
                    continue
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                rid = part.column(0).to_numpy(zero_copy_only=False)
                text = np.repeat(np.arange(rid.size), sizes)
                values, back = np.unique(tokens, return_inverse=True)
                spot, is_known = model.find(values)
                here = is_known[back]
                # Base: exact counts of the table's tokens; others leave as rows to be joined.
                exact = np.where(is_known, model.table[1][spot], 0) if model.table[0].size else np.zeros(values.size, np.int64)
                base = np.add.reduceat(np.where(here, np.log10(exact[back] + 1.0), 0.0), starts)
                n_known = np.add.reduceat(here.astype(np.int64), starts)
                score = np.add.reduceat(model.logs(tokens), starts) if small else np.zeros(rid.size)
                yield frame(rid, sizes, None, None, part.column(1), n_known, base, score)
                if small:
                    yield from grouped(rid, text[~here], tokens[~here], None)
                else:
                    yield from grouped(rid, text, tokens, before(tokens))

    def grouped(rid, text, tokens, first):
        """A row for each text and distinct token (or pair), with its times."""
        if not text.size:
            return
        cols = [text.astype(np.uint64), tokens, *([] if first is None else [first])]
        order = np.lexsort(cols[::-1])
        cols = [c[order] for c in cols]
        new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cols], axis=0)))
        times = np.diff(np.append(np.flatnonzero(new), new.size))
        cols = [c[new] for c in cols]
        yield frame(rid[cols[0].astype(np.int64)], times, cols[1], None if first is None else cols[2], None, None, None, None)

    def frame(rid, n, h, first, doc_id, known, base, score):
        k, number = len(rid), lambda v, kind: pa.nulls(k, kind) if v is None else pa.array(v, kind)
        signed = lambda v: pa.nulls(k, pa.int64()) if v is None else pa.array(v.view(np.int64))
        ids = pa.nulls(k, pa.int64()) if doc_id is None else doc_id
        return pa.RecordBatch.from_arrays([pa.array(rid), ids, pa.array(n.astype(np.int64)), signed(h), signed(first), number(known, pa.int64()), number(base, pa.float64()), number(score, pa.float64())], names=["rid", "doc_id", "n", "h", "first", "known", "base", "score"])

    def scored(texts_: DataFrame, made: list[str]) -> DataFrame:
        # Rows of texts have no h; the others are the tokens and pairs that must meet a table.
        rows = stored(texts_.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(run, "rid long, doc_id long, n long, h long, first long, known long, base double, score double"), made)
        open_, texts = rows.filter("h is not null").select("rid", "h", "first", F.col("n").alias("times")), rows.filter("h is null").drop("h", "first")
        found = open_.join(words.select("h", F.col("n").alias("c")), "h", "left")
        gain = [F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("gain")]
        if small:
            more = found.groupBy("rid").agg(*gain, F.lit(0.0).alias("model"))
        else:
            more = probed(found, words, contexts, shards, hot, shard_bits, z, discount, made).groupBy("rid").agg(*gain, F.sum("logs").alias("model"))
        joined = texts.join(more, "rid", "left")
        return joined.select(
            "doc_id",
            (split_bucket(F.col("doc_id"), modulus) == held).alias("held_out"),
            F.col("n").alias("n_tokens"),
            (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
            F.lit(n_all).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n") * F.log10(F.lit(whole))).alias("base_score"),
            (F.col("score") + F.coalesce("model", F.lit(0.0))).alias("score"),
        )

    n_rounds = 1 if small else max(1, -(-int(docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0) // round_bytes))
    if n_rounds == 1:
        return scored(docs, [])
    release(spark)  # the counting's shuffle
    path, kind = f"{checkpoint_dir(spark)}/scores-{uuid.uuid4().hex}", None
    for k in range(n_rounds):
        made: list[str] = []
        out = scored(docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_rounds)) == k), made)
        out.write.mode("append").parquet(path)
        kind = out.schema
        del out
        for used in made:
            remove(spark, used)
        release(spark)
    return spark.read.schema(kind).parquet(path)


def probed_levels(rows: DataFrame, shards: DataFrame, most: int = 63) -> DataFrame:
    """Adds level to rows with key and shard: each key is probed in the task to which its shard is dealt."""
    names = [c for c in rows.columns if c not in ("key", "shard")]
    kinds = dict(rows.dtypes)

    def look(batches):
        shard, data = None, None
        for b in batches:
            at = {c: i for i, c in enumerate(b.schema.names)}
            key, places_, held = b.column(at["key"]).to_numpy(zero_copy_only=False), b.column(at["shard"]).to_numpy(zero_copy_only=False), b.column(at["data"])
            edges = [0, *(np.flatnonzero(places_[1:] != places_[:-1]) + 1).tolist(), places_.size] if places_.size else [0]
            level = np.zeros(places_.size, np.int64)
            for a, e in zip(edges, edges[1:], strict=False):
                if places_[a] != shard:
                    shard, data = places_[a], None
                if held[a].is_valid:  # a shard stands before its rows
                    data = np.frombuffer(held[a].as_py(), np.uint8)
                if data is not None:
                    h = key[a:e].astype(np.int64).view(np.uint64)
                    level[a:e] = probe(data, np.zeros(h.size, np.int64), np.full(h.size, 8 * data.size, np.uint64), h, most)
            kept = pa.RecordBatch.from_arrays([*[b.column(at[c]) for c in names], pa.array(level)], names=[*names, "level"])
            yield kept.filter(held.is_null())

    queries = rows.select(*names, "key", "shard", F.lit(None).cast("binary").alias("data"))
    filled = shards.select(*[F.lit(0).cast(kinds[c]).alias(c) for c in names], F.lit(0).cast("long").alias("key"), "shard", "data")
    dealt = queries.union(filled).repartition("shard").sortWithinPartitions("shard", F.col("data").isNull())
    return dealt.mapInArrow(look, ", ".join(f"{c} {kinds[c]}" for c in names) + ", level long")


def token_values(words: DataFrame, asked: DataFrame, contexts: DataFrame, shards: DataFrame, hot: np.ndarray, shard_bits: int, made: list[str] | None = None) -> DataFrame:
    """(h, c, t, k) of the ``asked`` tokens, by the rule of ``Model.of_tokens``: exact for those seen three times or more, others by the filter."""

    def columns(make):
        def run(batches):
            for b in batches:
                h = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x.astype(np.int64) if x.dtype != np.uint64 else x.view(np.int64)) for x in make(h)]], names=[*b.schema.names, *NAMES[make]])

        return run

    def named(h):
        return (context(h),)

    def single(h):
        return keys(h, UNIGRAM), shard_of(h, UNIGRAM, hot, shard_bits)

    def twice(h):
        return two_keys(context(h)), shard_of(context(h) << np.uint64(32), BIGRAM, hot, shard_bits)

    NAMES = {named: ["ctx"], single: ["key", "shard"], twice: ["key", "shard"]}
    mid = lambda level: F.when(level > 0, F.pow(F.lit(2.0), level - 1) * 1.5 - 0.5).otherwise(0.0)
    known = words.filter("n >= 3")
    common = known.select("h", "n").mapInArrow(columns(named), "h long, n long, ctx long").join(contexts, "ctx", "left")
    common = common.select("h", mid(F.floor(F.log2(F.col("n").cast("double"))) + 1).alias("c"), F.col("total").cast("float").cast("double").alias("t"), F.col("pairs").cast("double").alias("k"))
    rest = asked.join(known.select("h"), "h", "left_anti")
    level = stored(probed_levels(rest.mapInArrow(columns(single), "h long, key long, shard long"), shards), made)
    some = level.filter("level >= 2").select("h").mapInArrow(columns(twice), "h long, key long, shard long")
    two = probed_levels(some, shards, 1).select("h", F.col("level").alias("two"))
    rare = level.join(two, "h", "left")
    once = F.when(F.col("level") > 0, 1.0).otherwise(0.0)
    t = F.when(F.col("level") >= 2, F.when(F.col("two") > 0, 2.0).otherwise(2.5)).otherwise(once)
    k = F.when(F.col("level") >= 2, F.when(F.col("two") > 0, 2.0).otherwise(1.0)).otherwise(once)
    return common.union(rare.select("h", mid(F.col("level")).alias("c"), t.alias("t"), k.alias("k")))


def probed(rows: DataFrame, words: DataFrame, contexts: DataFrame, shards: DataFrame, hot: np.ndarray, shard_bits: int, z: float, discount: float, made: list[str] | None = None) -> DataFrame:
    """Adds logs, times the log10 probability, to (rid, h, first, times, c) rows: pairs are probed in the task of their shard, what is known of tokens is joined."""

    def place(batches):
        for b in batches:
            first, h = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in (0, 1))
            pair = pair_hashes(first, h)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(5)], pa.array(keys(pair, BIGRAM).view(np.int64)), pa.array(shard_of(pair, BIGRAM, hot, shard_bits))], names=["first", "h", "rid", "times", "c", "key", "shard"])

    pairs = rows.select("first", "h", "rid", "times", "c").mapInArrow(place, "first long, h long, rid long, times long, c long, key long, shard long")
    got = probed_levels(pairs, shards)
    # Every text ends with the end token, so the tokens that stand before others are among those asked.
    values = stored(token_values(words, rows.select("h").distinct(), contexts, shards, hot, shard_bits, made), made)
    mid = lambda level: F.when(level > 0, F.pow(F.lit(2.0), level - 1) * 1.5 - 0.5).otherwise(0.0)
    got = got.join(values.select("h", F.col("c").alias("w")), "h", "left").join(values.select(F.col("h").alias("first"), "t", "k"), "first", "left")
    t = F.nullif(F.col("t"), F.lit(0.0))
    p = F.coalesce(F.greatest(F.lit(0.0), mid(F.col("level")) - discount) / t, F.lit(0.0)) + F.coalesce(F.lit(discount) * F.col("k") / t, F.lit(1.0)) * (F.coalesce("w", F.lit(0.0)) + 1) / F.lit(z)
    return got.select("rid", "times", "c", (F.col("times") * F.log10(p)).alias("logs"))
