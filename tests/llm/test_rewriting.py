"""Fill-in-the-middle, tokenizer alignment and line deduplication against brute force and SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import align, fim, linedup

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, n long, form string, key string, row long, batch int, hash string, pair long, h1 long"


def frame(spark, texts, start=1):
    rows = [(i, t, 7, "f", "k", 3, 4, "h", 5, 6) for i, t in enumerate(texts, start)]
    return spark.createDataFrame(rows, KIND).repartition(3)


ODD = [None, "", "   \n", "one", " one two ", "one two three", "one two three", "a b c d e f g h " * 400, "Grüße 你好 мир 🙂🙂", "x\x00y", "a <P> b", "<S", "tail \t", "\n\n\nA\n a \nb", "▁ <s> </s> <0x0A> <|endoftext|>", "\x0b\x1f\x85   x", "x" * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    df = frame(spark, ODD)
    return df.union(df.filter("doc_id = 4")).union(df.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---------------------------------------------------------------- 11
def plain_fim(doc_id, text, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return n, form, len(p), len(m), sha(out), sha(text)


def fim_rows(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, tuple(r[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"))) for r in df.collect())


@pytest.mark.parametrize("chunk", [1 << 16, 7, 1])
def test_fim_equals_brute_force(spark, odd, docs, chunk):
    """Small chunks send every text through functions, prefix scan and selection."""
    for df in (odd, docs.filter("length(text) < 3000") if chunk < 9 else docs):
        got = fim_rows(fim.transform(df, chunk_chars=chunk, run=5, broadcast_rows=0 if chunk == 7 else 1000))
        want = sorted((r["doc_id"] is None, r["doc_id"] or 0, plain_fim(r["doc_id"], r["text"])) for r in df.select("doc_id", "text").collect())
        assert got == want
    assert fim.transform(odd.limit(0), chunk_chars=chunk).count() == 0


def test_fim_output_and_extra_columns(spark, odd):
    rows = fim.transform(odd, plain_percent=100, keep=("n", "hash"), keep_output=True, chunk_chars=100).collect()
    texts = dict(enumerate(ODD, 1))
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"} and rows[0].asDict().keys() >= {"hash", "output"}
    for r in rows:
        want = (texts[5] if r["doc_id"] is None else texts[r["doc_id"]]) or ""
        assert fim.restore(r["form"], r["output"]) == want and sha(r["output"]) == r["output_sha256"]


def test_transitions_compose():
    pick = random.Random(5)
    for _ in range(200):
        text = "".join(pick.choice(" \n\tab") for _ in range(pick.randrange(1, 40)))
        cuts = sorted(pick.randrange(len(text) + 1) for _ in range(3))
        whole = ([0, 1, 2], [0, 0, 0], 0)
        for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
            piece = fim.classes(text[a:b])
            whole = fim.compose(whole, (*fim.transition(piece)[:2], b - a)) if len(piece) else whole
        for state in range(3):
            last, ends = fim.scan(fim.classes(text), state)
            assert (whole[0][state], whole[1][state]) == (last, len(ends))


# ---------------------------------------------------------------- 12
@pytest.fixture(scope="module")
def sides():
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(align.default_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    letters = align.byte_letters()
    a_bytes = {i: bytes(map(letters.__getitem__, t)) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    b = align.load(open(align.default_path("piece_bpe_32k.model"), "rb").read())
    return a, a_bytes, b


def plain_alignment(rows, sides):
    a, a_bytes, b = sides
    found, counts = [], Counter()
    for doc_id, text in rows:
        groups, whole = [], " " + (text or "")
        x, y = a.encode(whole, add_special_tokens=False).ids, b.model.encode(text or "")
        if not text or b"".join(a_bytes[i] for i in x) != whole.encode() or b"".join(b.tokens[i] for i in y) != whole.encode():
            x = y = []
        i = j = at_x = at_y = 0
        while i < len(x):
            one, two = [x[i]], [y[j]]
            at_x, at_y, i, j = at_x + len(a_bytes[x[i]]), at_y + len(b.tokens[y[j]]), i + 1, j + 1
            while at_x != at_y:
                if at_x < at_y:
                    one.append(x[i])
                    at_x, i = at_x + len(a_bytes[x[i]]), i + 1
                else:
                    two.append(y[j])
                    at_y, j = at_y + len(b.tokens[y[j]]), j + 1
            groups.append((one, two))
        links = [(p, q) for one, two in groups for p in one for q in two]
        counts.update(set(links))
        found.append((doc_id, len(x), len(y), groups, links))
    best = defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    join = lambda ids: ",".join(map(str, ids))
    return sorted((d is None, d or 0, n, m, len(g), len(k), sum(counts[p] == best[p[0]] for p in k), sum(counts[p] for p in k), sha(";".join(f"{join(x)}|{join(y)}" for x, y in g)) if g else "") for d, n, m, g, k in found), counts


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("options", [{}, {"block_tokens": 3}, {"broadcast_pairs": 0}, {"broadcast_pairs": 200, "block_tokens": 50}])
def test_alignment_equals_brute_force(spark, odd, docs, sides, options):
    """Small blocks leave groups open between blocks; a low bound sends pairs through the join."""
    pick = random.Random(7)
    long = "".join(chr(pick.choice((pick.randrange(33, 1000), pick.randrange(0x1F300, 0x1F700), 0x4E00 + pick.randrange(3000)))) for _ in range(4000))
    df = odd.select("doc_id", "text").union(frame(spark, [long, "=" * 700, "́" * 60], 100).select("doc_id", "text")).union(docs.filter("doc_id < 60").select("doc_id", "text"))
    want, counts = plain_alignment([tuple(r) for r in df.collect()], sides)
    out, pairs = align.align(df.withColumn("pair", F.lit(1)).withColumn("row", F.lit(1)), **options)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, *(r[c] for c in COLUMNS)) for r in out.collect())
    assert got == want
    assert {(r["a"], r["b"]): r["n_docs"] for r in pairs.collect()} == dict(counts)


def test_alignment_of_nothing(spark, odd):
    out, pairs = align.align(odd.limit(0))
    assert out.count() == pairs.count() == 0
    out, pairs = align.align(odd.filter("text is null or text = ''"))
    assert [tuple(r[c] for c in COLUMNS) for r in out.collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2 and pairs.count() == 0


def test_groups_cover_the_text(spark, odd, sides):
    a, a_bytes, b = sides
    texts = dict(enumerate(ODD, 1))
    by_row = defaultdict(list)
    for r in align.align_groups(odd, block_tokens=2).collect():
        by_row[r["row"]].append(r)
    for rows in by_row.values():
        rows.sort(key=lambda r: r["start"])
        want = (" " + (texts[5] if rows[0]["doc_id"] is None else texts[rows[0]["doc_id"]])).encode()
        assert rows[0]["start"] == 0 and rows[-1]["stop"] == len(want) and all(x["stop"] == y["start"] for x, y in zip(rows, rows[1:], strict=False))
        for r in rows:
            assert b"".join(a_bytes[i] for i in r["a_ids"]) == b"".join(b.tokens[i] for i in r["b_ids"]) == want[r["start"] : r["stop"]]
    assert len(by_row) == 2 + sum(1 for t in ODD if t and b.tokens and b"".join(b.tokens[i] for i in b.model.encode(t)) == (" " + t).encode())


def test_open_groups_are_summed_by_distinct_ids():
    """A group whose sides never meet inside: links are counted, not listed."""
    parts = [b"x"] * 2000
    digest = align.Digest(parts, 400, 600)
    a, b = np.arange(3000) % 7, np.arange(5000) % 11
    digest.groups(a, np.zeros(3000, int), b, np.zeros(5000, int), np.array([9]))
    pairs, times = digest.merge()
    assert digest.n_links == 15_000_000 == times.sum() and len(pairs) == 77
    want = Counter(a.tolist()), Counter(b.tolist())
    assert {int(p): int(n) for p, n in zip(pairs, times, strict=True)} == {x * 600 + y: n * m for x, n in want[0].items() for y, m in want[1].items()}


def test_ranks_equal_the_tokenizer(docs, sides):
    a, own = sides[0], align.load(open(align.default_path("byte_bpe_50k.json"), "rb").read())
    pick = random.Random(11)
    texts = [" " + r["text"] for r in docs.filter("text is not null").limit(60).collect()]
    texts += [" " + "".join(chr(pick.choice((pick.randrange(32, 127), pick.randrange(9, 14), pick.randrange(128, 0xD800), pick.randrange(0xE000, 0x11000), pick.randrange(0x1F000, 0x1FAFF)))) for _ in range(300)) for _ in range(50)]
    assert [own.encode(t) for t in texts] == [e.ids for e in a.encode_batch(texts, add_special_tokens=False)]


# ---------------------------------------------------------------- 13
def plain_lines(rows, min_docs):
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")]
    n = Counter(k for _, t in rows for k in set(keys(t)) if k)
    out = []
    for d, t in rows:
        kept = [x for x, k in zip((t or "").split("\n"), keys(t), strict=True) if n[k] < min_docs or not k]
        lines = (t or "").count("\n") + 1
        out.append((d is None, d or 0, lines, lines - len(kept), sha("\n".join(kept))))
    return sorted(out)


def line_rows(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize(("options", "bound"), [({}, 2_000_000), ({"min_docs": 2, "batches": 7, "fan": 2}, 0), ({"min_docs": 3, "batches": 1}, 1), ({"min_docs": 2, "batches": 3, "fan": 3}, 100)])
def test_lines_equal_brute_force(spark, odd, docs, options, bound):
    many = frame(spark, ["Same Line\nown %d\n\n\x0b same line \r" % (i % 5) for i in range(12)] + ["A\nB\r\nİ\nÉ", "a\nb\ni̇\né"], 200)
    df = odd.union(many).select("doc_id", "text").union(docs.select("doc_id", "text"))
    want = plain_lines([tuple(r) for r in df.collect()], options.get("min_docs", 10))
    assert line_rows(linedup.drop_repeated(df.withColumn("batch", F.lit("x")).withColumn("hash", F.lit(1)), broadcast_keys=bound, **options)) == want
    assert linedup.drop_repeated(odd.limit(0), **options).count() == 0


def test_line_text_and_extra_columns(spark, odd):
    df = frame(spark, ["head\nown a", "HEAD \nown b", "head"])
    got = {r["doc_id"]: (r["text"], r["hash"]) for r in linedup.drop_repeated(df, min_docs=3, keep=("hash",), keep_text=True).collect()}
    assert got == {1: ("own a", "h"), 2: ("own b", "h"), 3: ("", "h")}
    short = {r["doc_id"]: r["n_dropped"] for r in linedup.drop_repeated(df, min_docs=3, min_chars=5).collect()}
    assert short == {1: 0, 2: 0, 3: 0}


def test_batches_meet_the_runs(spark):
    """Batches against the store: first occurrences stay, later ones go; levels hold fewer runs than ``fan``."""
    runs = linedup.LineRuns(spark, min_docs=1, fan=2, buckets=3)
    seen, pick = set(), random.Random(3)
    for _ in range(5):
        texts = ["\n".join(str(pick.randrange(60)) for _ in range(6)) for _ in range(5)]
        got = {r["doc_id"]: r["text"] for r in linedup.new_lines(frame(spark, texts), runs, keep_text=True).collect()}
        assert got == {i: "\n".join(x for x in t.split("\n") if x not in seen) for i, t in enumerate(texts, 1)}
        seen |= {x for t in texts for x in t.split("\n")}
        assert all(len(level) < 2 for level in runs.levels)
    assert runs.known.count() == len(seen) and len(runs.levels) == 3
    files = {r[0] for r in spark.table(runs.levels[-1][0]).select(F.input_file_name()).distinct().collect()}
    assert 1 <= len(files) <= 3  # a file for each bucket, sorted
    for f in files:
        part = [bytes(r["hash"]) for r in spark.read.parquet(f).collect()]
        assert part == sorted(part)
    plan = runs.known._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.remove()
    assert not spark.sql("show tables").filter(F.col("tableName").startswith(runs.name)).count()


# ---------------------------------------------------------------- SQL
@pytest.mark.parametrize("name", ["op11_fim", "op13_line_dedup"])
def test_sql(spark, name):
    from ledgerloom.llm import queries

    con = duckdb.connect()
    con.execute(f"create view documents as from '{SF}/documents.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SF).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


# ---------------------------------------------------------------- earlier operators
def test_lm_scores_are_those_of_one_model(spark):
    """What is broadcast changes no score, with the usual filter and its false positives."""
    from ledgerloom.llm import lm

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    read = lambda **o: {r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in lm.score_documents(docs, **o).collect()}
    want = read()
    for options in ({"broadcast_bytes": 0}, {"common": 0}):
        got = read(**options)
        assert max(abs(got[i][0] - want[i][0]) / abs(want[i][0]) for i in want) < 1e-6
        assert all(got[i][1] == pytest.approx(want[i][1]) and got[i][2] == want[i][2] for i in want)


def test_copies_add_no_sets(spark, monkeypatch):
    from ledgerloom.llm import simhash

    words = [f"w{i}" for i in range(60)]
    one, two = " ".join(words), " ".join([*words[:58], "other", "end"])
    dealt, plain_map = [], simhash.map_rows

    def spy(df, schema, make, rows_per_batch=2000):
        out = plain_map(df, schema, make, rows_per_batch)
        if str(schema).startswith("a long, salt long"):
            dealt.append(out.count())
        return out

    monkeypatch.setattr(simhash, "map_rows", spy)
    sizes = []
    for copies in (1, 300):
        dealt.clear()
        rows = [(i, one, "en", "s", 0) for i in range(copies)] + [(None, one, "en", "s", 0)] * (copies - 1) + [(5000, two, "en", "s", 0)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
        assert [r["doc_id"] for r in simhash.keep_one(df, word_prints=4).collect()] == [0]
        sizes.append(sum(dealt))
    assert sizes[0] == sizes[1] == 2


def test_longer_licences_by_a_sweep():
    from ledgerloom.llm import licenses

    pick = random.Random(2)
    for _ in range(300):
        found = []
        for _ in range(pick.randrange(14)):
            low = pick.randrange(20)
            found.append((pick.choice("abc"), low, low + pick.randrange(12), pick.choice([5, 9, 30]), 0.5))
        want = {i for i, (label, low, high, n, _) in enumerate(found) for other, lo, hi, m, _ in found if other != label and m > n and lo <= low and high <= hi}
        assert licenses.inside_longer(found) == want


def test_small_tables_are_mixed_too(spark):
    from ledgerloom.llm import mixing

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    known = mixing.label_domains(labels)
    model = mixing.train(docs, known, ["clean", "low", "toxic"])
    q = mixing.posteriors(docs, model, 1000).join(known, "doc_id")
    mean = {r["domain"]: r["q"] for r in q.groupBy("domain").agg(F.avg(F.get("q", F.when(F.col("domain") == "clean", 0).when(F.col("domain") == "low", 1).otherwise(2))).alias("q")).collect()}
    share = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(share.values())
    assert all(mean[d] / 1000 > share[d] / total + 0.1 for d in share)
    assert mixing.mix(docs, known, {"clean": 0.9, "low": 0.05, "toxic": 0.05}).select("rate").distinct().count() > 20


PARAGRAPHS = '<html><body><div class="top"><a href="/">Home</a></div><div class="post"><h1>Title {i}</h1>{body}</div><div class="end">Contact us here always.</div></body></html>'


@pytest.mark.parametrize("n", [5, 20, 40, 80, 200])
def test_notices_are_found_however_long_the_article(spark, n):
    """One shared notice among a page's own paragraphs, at another place on each page."""
    from ledgerloom.llm import wrappers

    notice = "This notice stands word for word on every page of this site"
    rows = []
    for h in range(4):
        for i in range(12):
            own = [f"<p>Own text {h} {i} {k} with words of its own number {k * 7919 + i}</p>" for k in range(n)]
            own.insert(i * n // 12, f"<p>{notice}</p>")
            rows.append((len(rows), f"http://h{h}.example/{i}", PARAGRAPHS.format(i=i, body="".join(own))))
    got = {r["page_id"]: r["text"] for r in wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert sum(notice in t for t in got.values()) == 0
    assert all(t.startswith("Title") and t.count("Own text") == n and "Contact" not in t for t in got.values())
    assert sum(notice in wrappers.extract(r[2], None) for r in rows) == len(rows)  # a page alone can't tell


def test_teasers_are_no_region(spark):
    from ledgerloom.llm import wrappers

    teaser = '<article><h2>Teaser {k} {i}</h2><p>{w}</p></article>'
    page = '<html><body><div class="post"><h1>Head {i}</h1><p>{a}</p><p>{b}</p></div><div class="more">{more}</div></body></html>'
    text = lambda seed, n: " ".join(f"w{(seed * 31 + j * 17) % 997}" for j in range(n))
    rows = [(i, f"http://t.example/{i}", page.format(i=i, a=text(i, 60), b=text(i + 50, 60), more="".join(teaser.format(k=k, i=i, w=text(i * 9 + k, 15)) for k in range(8)))) for i in range(10)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i] == f"Head {i} {text(i, 60)} {text(i + 50, 60)}" for i in range(10))
    only = [(i, "http://l.example/", "<html><body>" + "".join(teaser.format(k=k, i=i, w=text(i * 9 + k, 15)) for k in range(3)) + "</body></html>") for i in range(4)]
    listed = wrappers.extract_main_text(spark.createDataFrame(only, "page_id long, url string, html string")).collect()
    assert all(r["text"].count("Teaser") == 3 for r in listed)


def test_language_filter_equals_exact_sets(spark):
    """Predictions by exact sets of n-grams instead of the filter."""
    import zlib

    from ledgerloom.llm import langid

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    plain = lambda t: re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {(t or '').lower()} "))
    grams = lambda t: [s[i : i + n] for s in [plain(t)] for n in (3, 4) for i in range(len(s) - n + 1)]
    counts, sizes = defaultdict(Counter), Counter()
    for i, t, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 5:
            counts[lang].update(grams(t))
            sizes[lang] += 1
    total = {x: sum(c.values()) for x, c in counts.items()}
    most = Counter()
    for x, c in counts.items():
        for g, n in c.items():
            most[g] = max(most[g], n / total[x])
    sets = {x: {g for g, n in c.items() if n >= 3 and n / total[x] >= 0.5 * most[g]} for x, c in counts.items()}
    got = {r["doc_id"]: r for r in langid.identify_languages(docs).collect()}
    wrong = 0
    for i, t, _ in rows:
        found = {x: sum(g in s for g in grams(t)) for x, s in sorted(sets.items())}
        if not t or not any(map(str.isalpha, t)):
            assert got[i]["lang_pred"] == "und"
        elif sum(found.values()):
            best = max(found, key=found.get)
            wrong += got[i]["lang_pred"] != best
            assert got[i]["score"] == pytest.approx(found[best] / sum(found.values()), abs=0.03)
    assert wrong == 0


def test_flat_files_are_read_in_ranges(spark, tmp_path):
    from ledgerloom.llm import tokens

    end = np.array([tokens.SEPARATOR], tokens.ID_TYPE).tobytes()
    size, spots = (1 << 31) + (300 << 20) + 6, [0, 1 << 20, (1 << 31) + 2, (1 << 31) + (300 << 20)]
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(size)
        for at in spots:
            f.seek(at)
            f.write(end)
    blocks = tokens.read_blocks(spark, str(tmp_path), block_bytes=16 << 20, range_blocks=8)
    assert blocks.rdd.getNumPartitions() == -(-size // (128 << 20))
    got = tokens.scan_blocks(blocks).orderBy("ordinal").collect()
    places = [s // 2 for s in spots]
    assert [(r["start"], r["n_tokens"], r["ended"]) for r in got] == [(a + 1 if a >= 0 else 0, b - a - 1, True) for a, b in zip([-1, *places], places, strict=False)] + [(places[-1] + 1, size // 2 - places[-1] - 1, False)]
