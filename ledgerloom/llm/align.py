"""Alignment of two tokenizers over the same texts by an event sweep.

Both tokenizers encode a text in the task that reads it. A token is an event at the byte where it ends; the
events of the two sides are united, dealt out by document and sorted by offset, and a machine streams through
them. It holds the tokens since the last offset at which both sides end, and nothing of what went before but
sums: where the other side ends at an event's offset, the group is complete, is emitted, and its links counted.
Events travel as rows of up to ``block_tokens`` ids of one side with the byte they start at; ends follow
from the lengths of the ids' bytes, so an event costs its id alone.

Statistics of id pairs are sums over all documents: the sweep counts, in each task, the documents that hold a
pair, and hands partial sums to a group-by on the pair. For the per-document results the pairs with the highest
counts, up to ``broadcast_pairs`` of them, are sent to the tasks as sorted arrays; documents look up what they
hold, and the pairs beyond the bound are joined by a shuffle. Both ways give the same sums.

Defined cases: null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have no tokens:
zeros and an empty digest; special tokens' strings inside texts are plain text; repeated rows are separate
documents, each counted; a null doc_id stays null; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored

BLOCK_TOKENS, BROADCAST_PAIRS = 4096, 4_000_000
#: Group products over this are counted by distinct ids, not token by token.
PRODUCT = 256
#: Pairs a task holds before their counts are merged, and distinct ones before they leave it.
HELD_PAIRS, LEAVE_PAIRS = 1 << 22, 1 << 20


# ---------------------------------------------------------------- tokenizers
def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones stand for themselves, the others follow from 256 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE vocabulary of a tokenizer JSON file, encoded by its ranks."""

    def __init__(self, data: bytes):
        import public_tokenizers
        import tiktoken

        spec, letters = json.loads(data), byte_letters()
        special = {t["content"] for t in spec.get("added_tokens", ())}
        vocabulary = {bytes(map(letters.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        order = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if order != sorted(order):
            raise ValueError("ids don't follow the order of the merges")
        self.model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
        # Where every byte is a token, merges only join what the text has: the lengths tell that nothing is lost.
        self.lossless = all(bytes([b]) in vocabulary for b in range(256))
        self.tokens = [b""] * (1 + max(vocabulary.values()))
        for t, i in vocabulary.items():
            self.tokens[i] = t

    def encode(self, text: str) -> list[int]:
        return self.model.encode_ordinary(text)

    def array(self, text: str) -> np.ndarray:
        return self.model.encode_to_numpy(text, disallowed_special=())


class Pieces:
    """A sentencepiece model; the model adds the space before the text itself."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.lossless = False
        self.tokens = [self.bytes_of(i) for i in range(self.model.get_piece_size())]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text[1:])

    def array(self, text: str) -> np.ndarray:
        return np.array(self.encode(text), np.int64)

    def bytes_of(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()


def load(data: bytes) -> ByteLevel | Pieces:
    return ByteLevel(data) if data[:1] == b"{" else Pieces(data)


# ---------------------------------------------------------------- events
EVENTS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("side", pa.int8()), ("ids", pa.binary())])


def events(docs: DataFrame, files, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of ids of one side with the byte they start at; a document without tokens is one row of side -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sides = [load(f) for f in files.value]
        lengths, kinds = zip(*map(tables, sides), strict=True)
        press = zstandard.ZstdCompressor(level=1)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                doc_id, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                row += 1
                whole = " " + text if text else ""
                raw, found = whole.encode(), []
                for k, side in enumerate(sides if whole else ()):
                    ids = side.array(whole)
                    ends = np.cumsum(lengths[k][ids])
                    if not len(ids) or ends[-1] != len(raw) or not side.lossless and b"".join(map(side.tokens.__getitem__, ids.tolist())) != raw:
                        break
                    found.append((ids.astype(kinds[k]), ends))
                if len(found) < 2:
                    out.append((row, doc_id, -1, -1, None))
                for k, (ids, ends) in enumerate(found if len(found) == 2 else ()):
                    for at in range(0, len(ids), block_tokens):
                        out.append((row, doc_id, int(ends[at - 1]) if at else 0, k, press.compress(ids[at : at + block_tokens].tobytes())))
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), EVENTS, strict=True)], schema=EVENTS)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), EVENTS, strict=True)], schema=EVENTS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "row long, doc_id long, start long, side byte, ids binary")


def tables(side: ByteLevel | Pieces) -> tuple[np.ndarray, str]:
    """Byte lengths by id, and the smallest type that holds the ids."""
    return np.array([len(t) for t in side.tokens], np.int64), "<u2" if len(side.tokens) <= 1 << 16 else "<u4"


# ---------------------------------------------------------------- the machine
class Machine:
    """One document's sweep: takes the sides' blocks by offset, tells ``emit`` of every run of complete groups.

    State: the tokens of the open group. A new block is compared with those blocks of the other side
    that reach into its range, so an open group of any length is passed over once.
    """

    def __init__(self, emit):
        self.ids, self.ends, self.emit = ([], []), ([], []), emit
        self.out, self.at = [], 0  # what is emitted and not handed on, and the byte where the open group starts

    def add(self, side: int, ids: np.ndarray, ends: np.ndarray) -> None:
        last = 0
        for other in reversed(self.ends[1 - side]):
            if other[-1] < ends[0]:
                break
            if other[0] <= ends[-1]:
                both = np.flatnonzero(held_by(other, ends))
                if len(both):
                    last = max(last, int(ends[both[-1]]))
        self.ids[side].append(ids)
        self.ends[side].append(ends)
        if last:
            self.close(last)

    def close(self, last: int) -> None:
        """Emit all groups that end at ``last`` or before, and keep what lies behind."""
        done = []
        for k in (0, 1):
            ids, ends = np.concatenate(self.ids[k]), np.concatenate(self.ends[k])
            n = int(np.searchsorted(ends, last, "right"))
            done += [ids[:n], ends[:n]]
            self.ids[k][:], self.ends[k][:] = ([ids[n:]], [ends[n:]]) if n < len(ids) else ([], [])
        a, a_ends, b, b_ends = done
        shared = held_by(b_ends, a_ends)
        common = a_ends[shared]
        self.emit(a, np.cumsum(shared) - shared, b, np.searchsorted(common, b_ends), common)


def held_by(ends: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the wanted offsets are among the ends; both rise."""
    return ends[np.minimum(np.searchsorted(ends, wanted), len(ends) - 1)] == wanted


class Digest:
    """Sums, links and the digest of one document's groups.

    ``parts`` are the digest's pieces of text, for A ids (two each: inside a group and at a side's end), then B's.
    """

    def __init__(self, parts: list[bytes], n_a: int, n_b: int):
        self.parts, self.size_a, self.size_b = parts, n_a, n_b
        self.n_a = self.n_b = self.n_groups = self.n_links = self.held = 0
        self.sha, self.pairs, self.times = hashlib.sha256(), [], []

    def groups(self, a, ga, b, gb, common) -> None:
        n = len(common)
        in_a, in_b = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + (upto_b - in_b)[ga]] = 2 * a.astype(np.int64) + np.append(ga[1:] != ga[:-1], True)
        order[np.arange(len(b)) + upto_a[gb]] = 2 * (self.size_a + b.astype(np.int64)) + np.append(gb[1:] != gb[:-1], True)
        text = b"".join(map(self.parts.__getitem__, order.tolist()))[:-1]
        self.sha.update(b";" + text if self.n_groups else text)
        self.n_a, self.n_b, self.n_groups = self.n_a + len(a), self.n_b + len(b), self.n_groups + n
        product = in_a * in_b
        self.n_links += int(product.sum())
        # Small groups: every token of A meets its group's tokens of B; large ones: distinct ids with their numbers.
        small = product[ga] <= PRODUCT
        reach = np.where(small, in_b[ga], 0)
        left = np.repeat(a.astype(np.int64), reach)
        right = np.arange(len(left)) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat((upto_b - in_b)[ga], reach)
        self.hold(left * self.size_b + b[right], np.ones(len(left), np.int64))
        for g in np.flatnonzero(product > PRODUCT).tolist():
            ua, ca = np.unique(a[upto_a[g] - in_a[g] : upto_a[g]].astype(np.int64), return_counts=True)
            ub, cb = np.unique(b[upto_b[g] - in_b[g] : upto_b[g]].astype(np.int64), return_counts=True)
            step = max(1, LEAVE_PAIRS // len(ub))
            for at in range(0, len(ua), step):
                self.hold((ua[at : at + step, None] * self.size_b + ub).ravel(), (ca[at : at + step, None] * cb).ravel())

    def hold(self, pairs: np.ndarray, times: np.ndarray) -> None:
        self.pairs.append(pairs)
        self.times.append(times)
        self.held += len(pairs)
        if self.held > HELD_PAIRS:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, times = summed(np.concatenate(self.pairs), np.concatenate(self.times))
        self.pairs, self.times, self.held = [pairs], [times], 0
        return pairs, times


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(keys) else values


SWEPT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, held binary, pair array<long>, n_docs array<long>"
GROUPS = "row long, doc_id long, start long, stop long, a_ids array<int>, b_ids array<int>"


def in_order(found: DataFrame) -> DataFrame:
    return found.repartition("row").sortWithinPartitions("row", "start", "side")


def documents_of(batches: Iterator[pa.RecordBatch], sides, begin, end):
    """Stream through sorted events: ``begin()`` gives a document's machine, ``end(row, doc_id, machine)`` yields what it leaves."""
    lengths, kinds = zip(*map(tables, sides), strict=True)
    expand, current, machine, doc = zstandard.ZstdDecompressor(), None, None, None
    for batch in batches:
        for row, doc_id, start, side, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row != current:
                if current is not None:
                    yield from end(current, doc, machine)
                current, doc, machine = row, doc_id, begin()
            if side >= 0:
                ids = np.frombuffer(expand.decompress(ids), kinds[side])
                machine.add(side, ids, start + np.cumsum(lengths[side][ids]))
                if machine.out:
                    yield from machine.out
                    machine.out = []
    if current is not None:
        yield from end(current, doc, machine)


def sweep(found: DataFrame, files) -> DataFrame:
    """Every document's sums, digest and packed pairs; beside them rows of pairs with the number of the task's documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [load(f) for f in files.value]
        n_a, n_b = (len(s.tokens) for s in sides)
        parts = [f"{i}{end}".encode() for n, ends in ((n_a, ",|"), (n_b, ",;")) for i in range(n) for end in ends]
        press = zstandard.ZstdCompressor(level=3)
        names = [x.split()[0] for x in SWEPT.split(", ")]
        types = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        held, n_held = [], 0

        def merged():
            return summed(np.concatenate([p for p, _ in held]), np.concatenate([n for _, n in held])) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def leave(pairs, counts):
            for at in range(0, len(pairs), 1 << 16):
                yield pack([(None,) * 8 + (pairs[at : at + (1 << 16)], counts[at : at + (1 << 16)])])

        def begin():
            return Machine(Digest(parts, n_a, n_b).groups)

        def end(row, doc_id, machine):
            d = machine.emit.__self__
            pairs, times = d.merge()
            yield (row, doc_id, d.n_a, d.n_b, d.n_groups, d.n_links, d.sha.hexdigest() if d.n_groups else "", press.compress(packed(pairs, times, n_a * n_b)), None, None), pairs

        out, size = [], 0
        for line, pairs in documents_of(batches, sides, begin, end):
            out.append(line)
            size += len(line[7])
            if len(pairs):
                held.append((pairs, np.ones(len(pairs), np.int64)))
                n_held += len(pairs)
            if len(out) >= 2000 or size > 1 << 24:
                yield pack(out)
                out, size = [], 0
            if n_held > HELD_PAIRS:
                pairs, counts = merged()
                held, n_held = [(pairs, counts)], len(pairs)
                if n_held > LEAVE_PAIRS:
                    yield from leave(pairs, counts)
                    held, n_held = [], 0
        if out:
            yield pack(out)
        yield from leave(*merged())

    return in_order(found).mapInArrow(run, SWEPT)


def packed(pairs: np.ndarray, times: np.ndarray, n_pairs: int) -> bytes:
    """Sorted pairs as differences, then their numbers, in the smallest type that holds all ``n_pairs`` possible pairs."""
    kind = "<u4" if n_pairs <= 1 << 32 else "<u8"
    return np.diff(pairs, prepend=0).astype(kind).tobytes() + times.astype(kind).tobytes()


def unpacked(data: bytes, n_pairs: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(data, "<u4" if n_pairs <= 1 << 32 else "<u8").astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


# ---------------------------------------------------------------- results
def align_groups(docs: DataFrame, a: str | None = None, b: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Every group as a row: the bytes it covers (of space and text) and both sides' ids."""
    files = vocabularies(docs, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [load(f) for f in files.value]
        names, types = [x.split()[0] for x in GROUPS.split(", ")], [pa.int64()] * 4 + [pa.list_(pa.int32())] * 2
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        def begin():
            machine = Machine(None)

            def emit(a, ga, b, gb, common):
                cut_a, cut_b = np.searchsorted(ga, np.arange(len(common) + 1)), np.searchsorted(gb, np.arange(len(common) + 1))
                for g, stop in enumerate(common.tolist()):
                    machine.out.append((machine.at, stop, a[cut_a[g] : cut_a[g + 1]].astype(np.int32), b[cut_b[g] : cut_b[g + 1]].astype(np.int32)))
                    machine.at = stop

            machine.emit = emit
            return machine

        out = []
        for line in documents_of(batches, sides, begin, lambda row, doc_id, machine: [(row, doc_id)]):
            if len(line) == 2:
                for x in out:
                    x[:2] = line
                if out:
                    yield pack(out)
                out = []
            else:
                out.append([None, None, *line])

    return in_order(events(docs, files, block_tokens)).mapInArrow(run, GROUPS)


def vocabularies(docs: DataFrame, a: str | None, b: str | None):
    """Both vocabulary files (some MB), sent to the tasks once."""
    ship(docs.sparkSession)
    paths = (a or default_path("byte_bpe_50k.json"), b or default_path("piece_bpe_32k.model"))
    return docs.sparkSession.sparkContext.broadcast([open(p, "rb").read() for p in paths])


def align(docs: DataFrame, a: str | None = None, b: str | None = None, block_tokens: int = BLOCK_TOKENS, broadcast_pairs: int = BROADCAST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(documents with their sums, pairs with the documents that hold them and whether that is their A id's highest count)."""
    spark, files = docs.sparkSession, vocabularies(docs, a, b)
    sides = [load(f) for f in files.value]
    n_a, n_b = (len(s.tokens) for s in sides)
    del sides
    swept = stored(sweep(events(docs, files, block_tokens), files))
    counts = swept.filter("pair is not null").select(F.inline(F.arrays_zip("pair", "n_docs"))).groupBy("pair").agg(F.sum("n_docs").alias("n_docs")).withColumn("a", F.expr(f"pair div {n_b}"))
    counts = stored(counts)
    highest = counts.groupBy("a").agg(F.max("n_docs").alias("highest"))  # a row for each id of the vocabulary at most
    pairs = stored(counts.join(F.broadcast(highest), "a").select("pair", "a", F.expr(f"pair % {n_b}").alias("b"), "n_docs", (F.col("n_docs") == F.col("highest")).alias("best")))

    # The bound: counts of at least a power of two, so that no more than broadcast_pairs pairs are sent.
    level, room = 64, broadcast_pairs
    by_level = {r["level"]: r["n"] for r in pairs.groupBy(F.floor(F.log2("n_docs")).alias("level")).agg(F.count("*").alias("n")).collect()}
    for k in sorted(by_level, reverse=True):
        if by_level[k] > room:
            break
        level, room = k, room - by_level[k]
    sent = pairs.filter(F.floor(F.log2("n_docs")) >= level).select("pair", "n_docs", "best").toArrow()
    order = np.argsort(sent.column("pair").to_numpy())
    known = spark.sparkContext.broadcast([sent.column(c).to_numpy()[order] for c in ("pair", "n_docs", "best")])
    rows = swept.filter("row is not null").drop("pair", "n_docs")
    far = level > min(by_level, default=64)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n_docs, best = known.value
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            best_n, total, rest, times = [], [], [], []
            for data in batch.column(batch.num_columns - 1):
                own, n = unpacked(expand.decompress(data.as_py()), n_a * n_b)
                at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
                hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                best_n.append(int(n[hit][best[at[hit]].astype(bool)].sum()))
                total.append(int((n[hit] * n_docs[at[hit]]).sum()))
                if far:
                    rest.append(own[~hit])
                    times.append(n[~hit])
            cols = [*batch.columns[:-1], pa.array(best_n, pa.int64()), pa.array(total, pa.int64())]
            names = [*batch.schema.names[:-1], "n_best", "count_sum"]
            if far:
                cols += [pa.array(rest, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
                names += ["rest", "times"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    looked = rows.mapInArrow(look, kind + (", rest array<long>, times array<long>" if far else ""))
    if far:
        looked = stored(looked)
        rest = looked.select("row", F.inline(F.arrays_zip(F.col("rest").alias("pair"), "times"))).join(pairs.select("pair", "n_docs", "best"), "pair")
        more = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n_docs")).alias("more_sum"))
        looked = looked.drop("rest", "times").join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).drop("more_best", "more_sum")
    return looked.drop("row"), pairs.select("a", "b", "n_docs", "best")
