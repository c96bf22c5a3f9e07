"""SimHash near-duplicates through Golay-code fuzzy hashing.

A fingerprint's 64 bits fall into segments of 22, 21 and 21 bits. Two fingerprints that differ in at most
two bits agree in one segment and differ in at most one bit in another (pigeonhole), so three keys
(exact segment, fuzzy segment) suffice: (0, 1), (1, 2), (2, 0). The fuzzy part is the index of a nearby
codeword of the perfect binary Golay code [23, 12, 7]: a padded segment's home is the codeword within
distance 3; its keys are the codewords within distance 4 (one, or six where the home is at distance 3).
If two segments differ in one bit, the home of either is among the keys of the other. Homes are joined
with keys and the pairs verified by their Hamming distance.

Equal fingerprints are merged before the join. Fingerprints are dealt out by their exact segments, three
rows each, and the Golay keys are made and joined inside these spots, so keys are not shuffled. Spots of
more than ``SPOT`` fingerprints (counted), or with a home that more than ``hot`` of them share, go to a
distributed join of the keys. There a key with more than ``hot`` homes is not paired: its members are
linked through their midpoints instead (each emits itself and its 64 one-bit changes; two fingerprints
share one exactly if they differ in at most two bits), which is linear and exact.

``near_duplicates`` links by the three-word shingles' fingerprint alone. ``similar_groups``, for corpora
where copies with a few changed words must be caught, links texts whose sets of five-word shingles have a
Jaccard similarity of at least 0.8, every link verified on the sets. Candidates come from fingerprints of
the distinct words by Golay keys, and from the ``MINS`` smallest shingle hashes of each text: each of the
smallest of both texts together is shared with probability 0.8 or more, so a pair without a common one is
missed once in (1 / 0.2) ** 12, over 10**8, pairs. Texts meet the least node under each of their smallest
hashes first; then, where their components still differ, all others under hashes of up to ``CROWD`` texts.
Under fuller ones they meet one more text for each hash, and again others in further turns as long as turns
find links, ``TURNS`` at most: a linear number of candidates that joins most of a large group. Texts whose components
still differ under a hash after that meet under ``BANDS`` keys of ``WIDTH`` min-hashes each, of which alike texts share
one almost surely and texts with a mere passage in common hardly any; there all pairs of different components are compared.

Defined cases: null and empty texts have the fingerprint zero, linked like any other; texts under three
words have one shingle, the whole sequence; repeated rows share their doc_id's component; rows without
doc_id get the smallest non-null doc_id of their group, null if there is none; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, release, ship
from .components import connected_components

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0xC75
#: Low bit and width of the fingerprint's segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: (exact, fuzzy) segments of the three keys.
KEYS = ((0, 1), (1, 2), (2, 0))
#: Distinct fingerprints with the same exact segment that one task matches; fuller spots are joined over tasks.
SPOT = 16384
#: Words of a shingle in ``similar_groups``, and the links' least Jaccard similarity as a fraction.
SHINGLE, SIMILAR = 5, (4, 5)
#: Smallest shingle hashes of a text by which it is found, and texts with the same one that are all paired.
MINS, CROWD = 12, 64
#: Texts of a full key that meet another such block in one group.
BLOCK = 512
#: Keys of a text whose components still differ under a full hash, and min-hashes in each. At J = 0.8 a pair shares
#: none of 56 keys of 6 once in 2 * 10**7 pairs; texts with a passage in common, at J = 0.3, share one in 25.
BANDS, WIDTH = 56, 6
#: Turns in which texts of full hashes meet others, at most; nodes that a hash picks for a turn, and those of
#: all its picks that a text is compared with, the nearest by sketch.
TURNS, PICKS, NEAREST = 3, 16, 3
#: Sets compared with one in one group; more are dealt over several, with a copy of that one in each.
FAN = 256
#: Differing bits of two 64-bit sketches beyond which a pair is not considered. A bit differs with probability
#: (1 - J) / 2, so at J = 0.8 more than 25 of 64 differ once in 10**9 pairs.
APART = 25
#: Min-hashes whose last 4 bits are kept for a closer look at a pair, and differing ones beyond which its sets are
#: not compared. One differs with probability (1 - J) * 15 / 16, so at J = 0.8 more than 50 do once in 10**8 pairs.
FINE, FINE_APART = 128, 50
_SALTS = np.array([(2 * k + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF for k in range(FINE)], np.uint64)
_BAND_SALTS = np.array([(2 * k + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF for k in range(FINE, FINE + BANDS * WIDTH)], np.uint64)


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of three-word shingles; a bit is 1 if over half the shingle hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= 3:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        line, digest = b" ".join(words), xxhash.xxh64_intdigest
        starts = [0]
        at = 0
        for w in words:
            at += len(w) + 1
            starts.append(at)
        hashes = [digest(line[a : b - 1], 42) for a, b in zip(starts, starts[3:], strict=False)]
    values = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, values.size, 1 << 16):  # a very long text in pieces
        ones += np.unpackbits(values[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > values.size, bitorder="little").view(np.uint64)[0])


def word_fingerprints(text: str | None, count: int) -> list[int]:
    """``count`` independent SimHashes of the text's distinct words, every word weighing the same.

    A few changed words move these less than the shingles' fingerprint, so several of them find texts
    that share at least four fifths of their five-word shingles far more often.
    """
    words = sorted(set((text or "").encode("utf-8", "surrogatepass").lower().split()))
    h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
    out = []
    for k in range(count):
        g = h ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        g = (g ^ (g >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        g = (g ^ (g >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        g ^= g >> np.uint64(31)
        ones = np.unpackbits(g.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > g.size, bitorder="little").view(np.uint64)[0]))
    return out


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's five-word shingles; fewer words make one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
    width = min(SHINGLE, h.size)
    if not width:
        return h
    out = np.full(h.size - width + 1, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + out.size]
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    return np.unique(out)


def sketches(shingles: np.ndarray) -> tuple[int, list[int]]:
    """64 bits, each the parity of one min-hash of the set, and the last 4 bits of ``FINE`` min-hashes in 64-bit words."""
    if not shingles.size:
        return 0, [0] * (FINE // 16)
    least = np.full(FINE, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, shingles.size, 4096):
        g = shingles[None, at : at + 4096] ^ _SALTS[:, None]
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
        g *= np.uint64(0x94D049BB133111EB)
        np.minimum(least, g.min(axis=1), out=least)
    least ^= least >> np.uint64(29)
    fine = ((least & np.uint64(15)).reshape(-1, 16) << np.arange(0, 64, 4, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return int(np.packbits((np.bitwise_count(least[:64]) & 1).astype(bool), bitorder="little").view(np.uint64)[0]), [int(x) for x in fine.view(np.int64)]


def _signed(fp: int) -> int:
    return fp - (1 << 64) if fp >> 63 else fp


def fingerprints(docs: DataFrame, word_prints: int = 0) -> DataFrame:
    """(doc_id, fp), and prints, the array of word fingerprints; all in signed 64-bit form."""

    def make():
        def step(cols):
            for doc_id, text in zip(*cols, strict=True):
                yield doc_id, _signed(fingerprint(text)), [_signed(x) for x in word_fingerprints(text, word_prints)]

        return step

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, fp long, prints array<long>", make, 2000)


# ---------------------------------------------------------------- Golay code
def syndromes(v: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    v = v.astype(np.int64)
    for i in range(22, 10, -1):
        v = np.where(v >> i & 1, v ^ (GENERATOR << (i - 11)), v)
    return v


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error of weight up to 3, and the five weight-7 codewords around a weight-3 error (else -1)."""
    errors = np.zeros(2048, np.int64)
    patterns = np.array([sum(1 << i for i in c) for n in (1, 2, 3) for c in combinations(range(23), n)])
    errors[syndromes(patterns)] = patterns
    info = np.arange(4096) << 11
    words = info ^ syndromes(info)
    sevens = words[np.array([int(w).bit_count() == 7 for w in words])]
    near = np.full((2048, 5), -1, np.int64)
    for s in range(2048):
        e = int(errors[s])
        if e.bit_count() == 3:
            near[s] = sevens[(sevens & e) == e]
    return errors, near


def golay_keys(segment: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home index of each word; then row numbers and indices of all codewords within distance 4."""
    errors, near = tables
    s = syndromes(segment)
    code = segment.astype(np.int64) ^ errors[s]
    rows, extra = np.nonzero(near[s] >= 0)
    more = (code[rows] ^ near[s][rows, extra]) >> 11
    return code >> 11, np.concatenate([np.arange(segment.size), rows]), np.concatenate([code >> 11, more])


def fuzzy_keys(fps: DataFrame) -> DataFrame:
    """(key, part, fp, home): for each fingerprint its three home keys and the keys it can be found by."""

    def run(batches):
        tables = golay_tables()
        for batch in batches:
            for at in range(0, batch.num_rows, 20000):
                part = batch.column(0).slice(at, 20000).to_numpy(zero_copy_only=False).astype(np.int64)
                fp = batch.column(1).slice(at, 20000).to_numpy(zero_copy_only=False).astype(np.int64)
                seg = segments(fp)
                for k, (exact, fuzzy) in enumerate(KEYS):
                    home, rows, codes = golay_keys(seg[fuzzy], tables)
                    for is_home, r, c in ((True, np.arange(fp.size), home), (False, rows, codes)):
                        key = (part[r] << 40) | (seg[exact][r] << 14) | (c << 2) | k
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[r]), pa.array(fp[r]), pa.array(np.full(r.size, is_home))], names=["key", "part", "fp", "home"])

    ship(fps.sparkSession)
    return fps.select(F.col("part").cast("long"), "fp").mapInArrow(run, "key long, part long, fp long, home boolean")


def segments(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [(u >> np.uint64(lo) & np.uint64((1 << w) - 1)).astype(np.int64) for lo, w in SEGMENTS]


def match_spots(spot: np.ndarray, fp: np.ndarray, hot: int, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of the same spot within two bits, by home and keys; and the rows of spots with a hot home.

    ``spot`` is sorted. Pairs are two arrays of row numbers; rows of hot spots are in no pair.
    """
    _, number, count = np.unique(spot, return_inverse=True, return_counts=True)
    live = np.nonzero(count[number] > 1)[0]
    none = np.empty(0, np.int64)
    if not live.size:
        return none, none, none
    seg, slot = segments(fp[live]), spot[live] & 3
    fuzzy = np.choose(slot, [seg[f] for _, f in KEYS])
    home, rows, codes = golay_keys(fuzzy, tables)
    homes = number[live] << 12 | home
    shared, many = np.unique(homes, return_counts=True)
    crowded = np.isin(number[live], shared[many > hot] >> 12)
    order = np.argsort(homes[~crowded], kind="stable")
    member, ordered = live[~crowded][order], homes[~crowded][order]
    keep = ~crowded[rows]
    keyed, wanted = live[rows[keep]], number[live][rows[keep]] << 12 | codes[keep]
    left, right = [none], [none]
    for at in range(0, keyed.size, 20000):
        low, high = (np.searchsorted(ordered, wanted[at : at + 20000], side) for side in ("left", "right"))
        n = high - low
        b = np.repeat(keyed[at : at + 20000], n)
        a = member[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        near = np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= 2
        near &= fp[a] < fp[b]
        left.append(a[near])
        right.append(b[near])
    return np.concatenate(left), np.concatenate(right), live[crowded]


def spot_links(spots: DataFrame, hot: int) -> DataFrame:
    """(part, a, b) within the spots; b is null where fingerprint a lies in a spot with a hot home."""

    def run(batches):
        tables = golay_tables()
        names = ["part", "a", "b"]

        def out(spot, fp):
            a, b, crowded = match_spots(spot, fp, hot, tables)
            yield pa.RecordBatch.from_arrays([pa.array(spot[a] >> 40), pa.array(fp[a]), pa.array(fp[b])], names=names)
            if crowded.size:
                yield pa.RecordBatch.from_arrays([pa.array(spot[crowded] >> 40), pa.array(fp[crowded]), pa.nulls(crowded.size, pa.int64())], names=names)

        spot, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            spot = np.concatenate([spot, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
            if not spot.size:
                continue
            end = int(np.searchsorted(spot, spot[-1]))  # the last spot may go on in the next batch
            if end:
                yield from out(spot[:end], fp[:end])
                spot, fp = spot[end:], fp[end:]
        if spot.size:
            yield from out(spot, fp)

    return spots.select("spot", "fp").repartition("spot").sortWithinPartitions("spot").mapInArrow(run, "part long, a long, b long")


def crowded_links(fps: DataFrame, hot: int) -> DataFrame:
    """(part, a, b) of few or many fingerprints whose spots are too full for one task."""
    keys = fuzzy_keys(fps)
    homes = keys.filter("home").select("key", "part", "fp")
    crowded = cut(homes.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("key"))
    if crowded.isEmpty():
        plain, dense = keys, None
    else:
        plain = keys.join(crowded, "key", "left_anti")
        dense = keys.join(crowded, "key", "left_semi").select("part", "fp").distinct()
    left = plain.filter("home").select("key", "part", F.col("fp").alias("a"))
    right = plain.filter("not home").select("key", F.col("fp").alias("b"))
    out = left.join(right, "key").filter("a < b and bit_count(a ^ b) <= 2").select("part", "a", "b")
    if dense is not None:
        one = F.lit(1).cast("long")
        flip = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", one, i)))
        spots = dense.select("part", "fp", F.explode(F.array_append(flip, F.col("fp"))).alias("mid"))
        low = spots.groupBy("part", "mid").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z").select("part", "mid", "a")
        out = out.union(spots.join(low, ["part", "mid"]).filter("a <> fp").select("part", "a", F.col("fp").alias("b")))
    return out


def links(fps: DataFrame, hot: int = 32, spot_size: int = SPOT) -> DataFrame:
    """Edges (a, b) over distinct fingerprints whose components are those of all pairs within two bits.

    With a column part, fingerprints are linked within each part (numbered from 0), and edges have it too.
    """
    ship(fps.sparkSession)
    parted = "part" in fps.columns
    fps = fps.select((F.col("part") if parted else F.lit(0)).cast("long").alias("part"), "fp")
    spot = [F.shiftleft("part", 40).bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", SEGMENTS[e][0]).bitwiseAND(F.lit((1 << SEGMENTS[e][1]) - 1)), 2)).bitwiseOR(F.lit(k)) for k, (e, _) in enumerate(KEYS)]
    spots = fps.select(F.explode(F.array(*spot)).alias("spot"), "fp")
    full = cut(spots.groupBy("spot").agg(F.count("*").alias("n")).filter(F.col("n") > spot_size).select("spot"))
    referred = None
    if not full.isEmpty():
        referred = spots.join(full, "spot", "left_semi").select(F.shiftright("spot", 40).alias("part"), "fp")
        spots = spots.join(full, "spot", "left_anti")
    found = cut(spot_links(spots, hot))
    hot_rows = found.filter("b is null").select("part", F.col("a").alias("fp"))
    referred = hot_rows if referred is None else referred.union(hot_rows)
    out = found.filter("b is not null")
    if not referred.isEmpty():
        out = out.union(crowded_links(cut(referred.distinct()), hot))
    return out if parted else out.select("a", "b")


def near_duplicates(docs: DataFrame, hot: int = 32) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that can be reached) for every row."""
    prints = cut(fingerprints(docs).select("doc_id", "fp"))
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(links(groups.select("fp"), hot))
    joined = groups.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    # Fingerprints outside any link are their own root and need no second lookup by root.
    named = joined.filter("root <> fp").join(of_root, "root").select("fp", "component_id").union(of_root.select(F.col("root").alias("fp"), "component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_rows(docs: DataFrame, word_prints: int) -> DataFrame:
    """(doc_id, node, size, sketch, fine, prints, mins): node names the text's shingle set and size counts it."""

    def make():
        def step(cols):
            for doc_id, rid, text in zip(*cols, strict=True):
                s = shingle_set(text)
                bits, fine = sketches(s)
                yield doc_id, rid, _node(s), s.size, _signed(bits), fine, [_signed(x) for x in word_fingerprints(text, word_prints)], s[:MINS].view(np.int64).tolist()

        return step

    return map_rows(docs.select(F.col("doc_id").cast("long"), rid_of(docs), "text"), "doc_id long, rid long, node long, size long, sketch long, fine array<long>, prints array<long>, mins array<long>", make, 1000)


def rid_of(docs: DataFrame) -> Column:
    """What tells rows of one doc_id apart, where there is such a column; rows without it come last."""
    last = F.lit((1 << 63) - 1)
    return (F.coalesce(F.col("rid").cast("long"), last) if "rid" in docs.columns else last).alias("rid")


def _node(shingles: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(shingles.tobytes(), 42))


def may_be_similar(size_a, bits_a, size_b, bits_b) -> Column:
    """Whether sizes and sketches allow the similarity."""
    up, down = SIMILAR
    return (F.bit_count(bits_a.bitwiseXOR(bits_b)) <= APART) & (down * F.least(size_a, size_b) >= up * F.greatest(size_a, size_b))


def crowd_pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b) of nodes under one hash, of different components, whose sizes and sketches allow the similarity; rows are (h, node, size, sketch, part, side), and two rows of one side other than 0 are no pair."""
    up, down = SIMILAR

    def run(batches):
        def out(h, node, size, bits, part, side):
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            many = np.diff(np.append(first, h.size))
            n, place = np.repeat(many, many), np.arange(h.size) - np.repeat(first, many)
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for d in range(1, int(n.max())):
                i = np.flatnonzero(place + d < n)
                j = i + d
                near = (down * np.minimum(size[i], size[j]) >= up * np.maximum(size[i], size[j])) & (part[i] != part[j]) & ((side[i] != side[j]) | (side[i] == 0))
                near &= np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64)) <= APART
                left.append(np.minimum(node[i], node[j])[near])
                right.append(np.maximum(node[i], node[j])[near])
            pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        held = [np.empty(0, np.int64)] * 6
        for batch in batches:
            held = [np.concatenate([x, batch.column(k).to_numpy(zero_copy_only=False)]) for k, x in enumerate(held)]
            if not held[0].size:
                continue
            end = int(np.searchsorted(held[0], held[0][-1]))  # the last hash may go on in the next batch
            if end:
                yield out(*[x[:end] for x in held])
                held = [x[end:] for x in held]
        if held[0].size:
            yield out(*held)

    return rows.select("h", "node", "size", "sketch", "part", "side").repartition("h").sortWithinPartitions("h").mapInArrow(run, "a long, b long").distinct()


def least_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) of each node and the least node under each of its hashes; rows are (h, n, node, size, sketch)."""
    heads = rows.groupBy("h").agg(F.min(F.struct("node", "size", "sketch")).alias("m"))
    met = rows.join(heads, "h").filter(F.col("node") != F.col("m.node")).filter(may_be_similar(F.col("size"), F.col("sketch"), F.col("m.size"), F.col("m.sketch")))
    return met.select(F.col("m.node").alias("a"), F.col("node").alias("b")).distinct()


def mixed_rows(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows under hashes that nodes of several components share, with their component as part."""
    rows = rows.join(parts, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
    mixed = rows.groupBy("h").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("h")
    return cut(rows.join(mixed, "h", "left_semi"))


def bands(shingles: np.ndarray) -> np.ndarray:
    """``BANDS`` keys, each of ``WIDTH`` min-hashes of the set."""
    least = np.full(BANDS * WIDTH, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, shingles.size, 2048):
        g = shingles[None, at : at + 2048] ^ _BAND_SALTS[:, None]
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
        g *= np.uint64(0x94D049BB133111EB)
        np.minimum(least, g.min(axis=1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(WIDTH):
        out = (out ^ least[k::WIDTH]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def band_rows(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, broadcast_rows: int) -> DataFrame:
    """(h, node, size, sketch, part) of the wanted (node, size, sketch, part) under each of their bands; sets are made where the texts lie."""
    wanted = cut(wanted.join(nodes.select("node", "least"), "node").select("node", "size", "sketch", "part", F.col("least.doc_id").alias("__id"), F.col("least.rid").alias("__rid")))
    side = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("rid").eqNullSafe(F.col("__rid"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rid_of(docs), "text").join(side, same).select("text", "node", "size", "sketch", "part")

    def make():
        done = set()

        def step(cols):
            for text, node, size, sketch, part in zip(*cols, strict=True):
                if node in done:
                    continue
                s = shingle_set(text)
                if _node(s) == node:  # else another text of the same id
                    done.add(node)
                    for h in bands(s).view(np.int64).tolist():
                        yield h, node, size, sketch, part

        return step

    return map_rows(rows, "h long, node long, size long, sketch long, part long", make, 2000).dropDuplicates(["h", "node"])


def rest_pairs(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): all pairs of different components under one key whose sizes and sketches allow the similarity; rows are (h, node, size, sketch, part).

    A key's nodes are dealt into blocks of about ``block`` by their own hash. The nodes outside its largest component
    meet each block; are they more than a block, every two blocks meet in a group of their own. No task holds more
    than a few pairs of blocks.
    """
    each = rows.select("h", "part").repartition("h").groupBy("h", "part").agg(F.count("*").alias("n"))
    keys = each.groupBy("h").agg(F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("most"), F.count("*").alias("parts")).filter("parts > 1")
    keys = keys.select("h", F.ceil(F.col("n") / F.lit(block)).cast("long").alias("k"), F.col("most.part").alias("main"), (F.col("n") - F.col("most.n") > block).alias("crossed"))
    full = rows.join(keys, "h").withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("k"))).withColumn("of_main", ~F.col("crossed") & (F.col("part") == F.col("main")))
    to = F.when(F.col("of_main"), F.array("own")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
    met = full.select("h", "node", "size", "sketch", "part", "own", "of_main", "crossed", F.explode(to).alias("other"))
    side = F.when(F.col("of_main"), 1).when(F.col("own") == F.col("other"), 0).when(F.col("crossed") & (F.col("own") < F.col("other")), 1).otherwise(2).cast("long")
    ends = [F.when(F.col("crossed"), end("own", "other")).otherwise(F.col("other")) for end in (F.least, F.greatest)]
    return crowd_pairs(met.select(F.xxhash64("h", *ends).alias("h"), "node", "size", "sketch", "part", side.alias("side")))


def other_pairs(rows: DataFrame, parts: DataFrame, crowd: int, turn: int) -> DataFrame:
    """(a, b) of different components under hashes of more than ``crowd`` nodes: each node with the ``NEAREST`` nodes by sketch among ``PICKS`` that each hash picks in this turn; in turn 0 all under other hashes too."""
    rows = mixed_rows(rows, parts)
    full = rows.filter(F.col("n") > crowd)
    pick = lambda k: F.min(F.struct(F.xxhash64("node", "h", F.lit(turn * PICKS + k)), F.col("node"), F.col("size"), F.col("sketch"), F.col("part")))
    picks = full.groupBy("h").agg(F.array_distinct(F.array(*map(pick, range(PICKS)))).alias("m"))
    fit = F.filter("m", lambda x: (x["part"] != F.col("part")) & may_be_similar(F.col("size"), F.col("sketch"), x["size"], x["sketch"]))
    near = F.transform(fit, lambda x: F.struct(F.bit_count(F.col("sketch").bitwiseXOR(x["sketch"])).alias("d"), x["node"].alias("node")))
    met = full.join(picks, "h").select("node", F.array_min(near).alias("x")).filter("x is not null").groupBy("node").agg(F.slice(F.array_sort(F.collect_set("x")), 1, NEAREST).alias("x")).select("node", F.explode("x.node").alias("m"))
    out = met.select(F.least("node", "m").alias("a"), F.greatest("node", "m").alias("b")).distinct()
    return out if turn else out.union(crowd_pairs(rows.filter(F.col("n") <= crowd).withColumn("side", F.lit(0).cast("long")))).distinct()


def worth_comparing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The (a, b) whose finer sketches allow the similarity."""
    for x in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("fine").alias(f"f{x}")), x)

    def differing(x: Column, y: Column) -> Column:
        # Any set bit of a group of 4 falls onto its lowest.
        one = x.bitwiseXOR(y)
        two = one.bitwiseOR(F.shiftrightunsigned(one, 1))
        return F.bit_count(two.bitwiseOR(F.shiftrightunsigned(two, 2)).bitwiseAND(F.lit(0x1111111111111111)))

    return pairs.filter(F.aggregate(F.zip_with("fa", "fb", differing), F.lit(0), lambda s, v: s + v) <= FINE_APART).select("a", "b")


def print_pairs(nodes: DataFrame, hot: int, broadcast_rows: int) -> DataFrame:
    """(a, b) of nodes by the word fingerprints: equal ones and those within two bits."""
    heads = cut(nodes.select("node", F.posexplode("prints").alias("part", "fp")).groupBy("part", "fp").agg(F.min("node").alias("head"), F.count("*").alias("n")))
    same = nodes.select("node", F.posexplode("prints").alias("part", "fp")).join(heads.filter("n > 1").drop("n"), ["part", "fp"]).select(F.col("node").alias("a"), F.col("head").alias("b")).filter("a <> b")
    near = cut(links(heads.select("part", "fp"), hot).distinct())
    small = near.count() <= broadcast_rows
    side = lambda df: F.broadcast(df) if small else df
    of_a = heads.select("part", F.col("fp").alias("a"), F.col("head").alias("ha")).join(side(near), ["part", "a"])
    of_b = heads.select("part", F.col("fp").alias("b"), F.col("head").alias("hb")).join(side(near), ["part", "b"])
    near = of_a.join(side(of_b), ["part", "a", "b"]).select(F.col("ha").alias("a"), F.col("hb").alias("b")).filter("a <> b")
    pairs = same.union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for x in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")), x)
    return pairs.filter(may_be_similar(F.col("na"), F.col("sa"), F.col("nb"), F.col("sb"))).select("a", "b")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, broadcast_rows: int) -> DataFrame:
    """The (a, b) whose shingle sets have a Jaccard similarity of at least 0.8, by exact sets.

    The set of b goes to a group named by a, once for each pair; a's set goes to each of its groups, one for
    about ``FAN`` pairs. Sets are made where the texts lie: a node's text is that of its least id and rid, once a task,
    so that copies of a text add no sets.
    """
    up, down = SIMILAR
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(FAN)).cast("long").alias("fan"))
    salt = F.pmod(F.xxhash64("b"), F.col("fan"))
    spots = pairs.join(many, "a").select(F.col("b").alias("node"), F.struct("a", salt.alias("salt"), F.lit(1).alias("side")).alias("spot"))
    spots = spots.union(many.select(F.col("a").alias("node"), F.explode(F.transform(F.sequence(F.lit(0), F.col("fan") - 1), lambda i: F.struct(F.col("a"), i.cast("long").alias("salt"), F.lit(0).alias("side")))).alias("spot")))
    # A row holds 64 of a head's groups at most; a member has few heads.
    dealt = spots.groupBy("node", F.when(F.col("spot.side") == 0, F.floor(F.col("spot.salt") / 64)).otherwise(0).alias("deal")).agg(F.collect_set("spot").alias("spots"))
    wanted = cut(dealt.join(nodes.select("node", "least"), "node").select("node", F.col("least.doc_id").alias("__id"), F.col("least.rid").alias("__rid"), "spots"))
    side = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("rid").eqNullSafe(F.col("__rid"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rid_of(docs), "text").join(side, same).select("text", "node", F.xxhash64("node", "spots").alias("deal"), "spots")

    def make():
        done = set()

        def step(cols):
            for text, node, deal, spots in zip(*cols, strict=True):
                if (node, deal) in done:
                    continue
                s = shingle_set(text)
                if _node(s) == node:  # else another text of the same id
                    done.add((node, deal))
                    data = s.tobytes()
                    for x in spots:
                        yield x["a"], x["salt"], x["side"], node, data

        return step

    sets = map_rows(rows, "a long, salt long, side int, node long, data binary", make, 200)

    def compare(batches):
        key, one = None, None
        for batch in batches:
            a, b = [], []
            for k, z, side, node, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not side:
                    key, one = (k, z), np.frombuffer(data, np.uint64)
                elif key == (k, z):
                    two = np.frombuffer(data, np.uint64)
                    shared = np.intersect1d(one, two, assume_unique=True).size
                    if (up + down) * shared >= up * (one.size + two.size):  # up / down <= shared / union
                        a.append(k)
                        b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return sets.repartition("a", "salt").sortWithinPartitions("a", "salt", "side").mapInArrow(compare, "a long, b long").distinct()


def merged(parts: DataFrame, links_: DataFrame) -> DataFrame:
    """(node, root) of the components when links are added; the links' components are found between roots."""
    rooted = links_
    for x in ("a", "b"):
        rooted = rooted.join(parts.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")), x, "left").withColumn(f"r{x}", F.coalesce(f"r{x}", x))
    moved = cut(connected_components(rooted.select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
    nodes = parts.union(links_.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(parts, "node", "left_anti").select("node", F.col("node").alias("root")))
    return nodes.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def similar_groups(docs: DataFrame, word_prints: int = 4, hot: int = 32, broadcast_rows: int = 1_000_000, crowd: int = CROWD) -> DataFrame:
    """(doc_id, group_id): components over the pairs whose five-word shingle sets are at least 0.8 similar.

    Documents with equal sets are one node; group_id is the smallest doc_id that can be reached. Candidates
    come from the word fingerprints (within two bits, exactly and without pairs inside crowded keys) and
    the smallest shingle hashes; only verified ones link. Up to ``broadcast_rows`` rows (counted) are broadcast.
    """
    prints = cut(shingle_rows(docs, word_prints))
    nodes = cut(prints.groupBy("node").agg(F.min(F.struct("doc_id", "rid")).alias("least"), *[F.first(c).alias(c) for c in ("size", "sketch", "fine", "prints", "mins")]))
    rows = nodes.select("node", "size", "sketch", F.explode("mins").alias("h"))
    rows = cut(rows.join(rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "h").select("h", "n", "node", "size", "sketch"))
    first = cut(worth_comparing(print_pairs(nodes, hot, broadcast_rows).union(least_pairs(rows)).distinct(), nodes))
    parts = cut(connected_components(verified(docs, nodes, first, broadcast_rows)))
    release(docs.sparkSession)
    for turn in range(TURNS):
        pairs = cut(worth_comparing(other_pairs(rows, parts, crowd, turn).join(first, ["a", "b"], "left_anti"), nodes))
        new = None if pairs.isEmpty() else cut(verified(docs, nodes, pairs, broadcast_rows))
        if new is None or new.isEmpty():
            break
        first, parts = first.union(pairs), cut(merged(parts, new))
        if not turn:
            rows = rows.filter(F.col("n") > crowd)
        release(docs.sparkSession)
    # The turns join most of a crowd cheaply; what is left between its components is found by narrower keys.
    wanted = mixed_rows(rows.filter(F.col("n") > crowd), parts).select("node", "size", "sketch", "part").distinct()
    pairs = None if wanted.isEmpty() else cut(worth_comparing(rest_pairs(cut(band_rows(docs, nodes, wanted, broadcast_rows))).join(first, ["a", "b"], "left_anti"), nodes))
    if pairs is not None and not pairs.isEmpty():
        parts = cut(merged(parts, verified(docs, nodes, pairs, broadcast_rows)))
    release(docs.sparkSession)
    joined = nodes.select("node", "least").join(parts, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    of_root = joined.groupBy("root").agg(F.min("least.doc_id").alias("group_id"))
    named = joined.filter("root <> node").join(of_root, "root").select("node", "group_id").union(of_root.select(F.col("root").alias("node"), "group_id"))
    return prints.select("doc_id", "node").join(named, "node").select("doc_id", "group_id")


def keep_one(docs: DataFrame, word_prints: int = 0, hot: int = 32, broadcast_rows: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` with one document of each group: the one with the smallest doc_id, rows without id last.

    Groups are those of ``near_duplicates``, or of ``similar_groups`` with ``word_prints`` of them, over the
    texts, each known by its hash; so rows without doc_id, or with one that repeats, are judged by their own
    text. Rows to drop are found by id and text. Up to ``broadcast_rows`` of them (counted) are broadcast, so
    texts are not shuffled; more take a shuffled anti-join. Equal rows of a kept id and text are merged to one.
    """
    t = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.select(t.alias("doc_id"), F.col("doc_id").cast("long").alias("rid"), "text")
    groups = similar_groups(texts, word_prints, hot) if word_prints else near_duplicates(texts, hot).select("doc_id", F.col("component_id").alias("group_id"))
    groups = groups.select(F.col("doc_id").alias("t"), F.col("group_id").alias("root")).distinct()
    found = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("t")).groupBy("doc_id", "t").agg(F.count("*").alias("n")).join(groups, "t"))
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")).alias("k"))
    marked = cut(found.join(kept, "root").select("doc_id", "t", "n", (F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("t") == F.col("k.t"))).alias("kept")))
    drop = marked.filter("not kept").select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"))
    small = drop.count() <= broadcast_rows
    same = (F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))) & (t == F.col("__t"))
    out = docs.join(F.broadcast(drop) if small else drop, same, "left_anti")
    again = marked.filter("kept and n > 1").select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"))
    if again.isEmpty():
        return out
    return out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").withColumn("__key", t).dropDuplicates(["doc_id", "__key"]).drop("__key"))
