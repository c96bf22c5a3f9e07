"""Headers, datasets, the labeller slot, calls that fail, and noise, against made files and plain Python."""

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import benchmarks, labeler, offline
from ledgerloom.sources import datasets, headers

TOKENS = "doc_id string, pos int, text string, confidence double, x0 int, y0 int, page_number int"


# ---------------------------------------------------------------- headers
def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)


def jpeg(w, h):
    return b"\xff\xd8" + b"\xff\xe0" + struct.pack(">H", 40_002) + b"x" * 40_000 + b"\xff\xff\xc2" + struct.pack(">HBHH", 11, 8, h, w) + b"\x03" + b"\0" * 9


def tiff(w, h, order="<"):
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "H", 2) + struct.pack(order + "HHIHH", 256, 3, 1, w, 0) + struct.pack(order + "HHII", 257, 4, 1, h)


def bmp(w, h):
    return b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, w, -h)


def pdf(pages, filler=0, old=False):
    """With a cross-reference table; ``old`` has the page tree replaced by a later section."""
    out, at = bytearray(b"%PDF-1.4\n"), {}
    for n, body in enumerate([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [] /Count %d >>" % (3 if old else pages)], 1):
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    out += b"% " + b"x" * filler + b"\n"
    start = len(out)
    out += b"xref\n0 3\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % at[n] for n in (1, 2)) + b"trailer\n<< /Size 3 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % start
    if old:
        new = len(out)
        out += b"2 0 obj\n<< /Type /Pages /Count %d >>\nendobj\n" % pages
        later = len(out)
        out += b"xref\n2 1\n%010d 00000 n \ntrailer\n<< /Size 3 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (new, start, later)
    return bytes(out)


def pdf_streams(pages):
    """With the catalog and the page tree in an object stream, found by a cross-reference stream with a predictor."""
    out = bytearray(b"%PDF-1.5\n")
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d >>" % pages]
    head = b"1 0 2 %d " % (len(bodies[0]) + 1)
    data = zlib.compress(head + b" ".join(bodies))
    held = len(out)
    out += b"3 0 obj\n<< /Type /ObjStm /N 2 /First %d /Length %d /Filter /FlateDecode >>\nstream\n" % (len(head), len(data)) + data + b"\nendstream\nendobj\n"
    start = len(out)
    rows = [bytes([0, 0, 0, 0]), bytes([2, 0, 3, 0]), bytes([2, 0, 3, 1]), bytes([1, *held.to_bytes(2, "big"), 0])]
    above, coded = bytes(4), b""
    for r in rows:
        coded += b"\x02" + bytes((a - b) & 255 for a, b in zip(r, above, strict=True))
        above = r
    data = zlib.compress(coded)
    out += b"4 0 obj\n<< /Type /XRef /Size 4 /W [1 2 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> /Length %d >>\nstream\n" % len(data) + data + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % start
    return bytes(out)


def test_headers_tell_sizes_and_pages(spark, tmp_path):
    files = {
        "a.png": (png(640, 480), (640, 480, None, None)), "big.png": (png(10_000, 5_000), (10_000, 5_000, None, "too_many_pixels")), "b.jpg": (jpeg(300, 200), (300, 200, None, None)), "c.tif": (tiff(7, 70_000), (7, 70_000, None, None)), "d.TIFF": (tiff(9, 8, ">"), (9, 8, None, None)), "e.bmp": (bmp(12, 34), (12, 34, None, None)),
        "f.pdf": (pdf(7), (None, None, 7, None)), "g.pdf": (pdf(101, 3_000_000), (None, None, 101, "too_many_pages")), "h.pdf": (pdf(5, old=True), (None, None, 5, None)), "i.pdf": (pdf_streams(42), (None, None, 42, None)), "j.pdf": (pdf(0), (None, None, 0, "no_pages")),
        "cut.pdf": (pdf(7)[:60], (None, None, None, "malformed")), "cut.png": (png(1, 1)[:20], (None, None, None, "malformed")), "cut.jpg": (jpeg(1, 1)[:500], (None, None, None, "malformed")), "x.exe": (b"MZ", (None, None, None, "unsupported_extension")), "zero.png": (png(0, 5), (0, 5, None, "malformed")),
    }
    for name, (data, _) in files.items():
        (tmp_path / name).write_bytes(data)
    got = {os.path.basename(r["path"]): r for r in headers.check_files(spark, str(tmp_path)).collect()}
    assert {n: tuple(r[c] for c in ("width", "height", "pages", "error")) for n, r in got.items()} == {n: want for n, (_, want) in files.items()}
    assert got["g.pdf"]["length"] > 3_000_000 and got["g.pdf"]["bytes_read"] < 100_000 and got["b.jpg"]["bytes_read"] < 100
    assert headers.facts("/no/such", 9, "png", 1, 1)[4] == "unreadable"
    assert headers.facts("", 0, "pdf", 1, 1, lambda path: lambda at, n: b"")[4] == "malformed"


def test_extensions(spark):
    rows = [("a/b.PDF", None), ("x.tar.gz", "image/png"), ("scan", "image/png"), ("scan", "text/plain"), (None, "application/pdf"), (".hidden", None)]
    got = spark.createDataFrame(rows, "n string, c string").select(headers.extension_of(F.col("n"), F.col("c"))).collect()
    assert [r[0] for r in got] == [".pdf", ".gz", ".png", "", ".pdf", ""]


# ---------------------------------------------------------------- datasets
def quad(*p):
    return {f"{a}{i}": v for i in range(1, 5) for a, v in zip("xy", p[2 * i - 2 : 2 * i], strict=True)}


def test_json_layout(spark, tmp_path):
    lines = [{"category": "menu.nm", "words": [{"text": " Tea ", "quad": quad(1, 2, 9, 1, 9, 8, 0, 7), "is_key": 0}, {"text": "", "quad": {}}, {"text": "Green", "quad": quad(1, 1, 2, 1, 2, 2, 1, 2), "is_key": 0}]}, {"category": "total.total_price", "words": [{"text": "TOTAL", "quad": {"x1": 5}, "is_key": 1}, {"text": "DUE", "is_key": 1}, {"text": "9", "is_key": 0}]}, {"category": "O", "words": [{"text": "thanks"}]}, {"category": None, "words": [{"text": "x"}]}, {"category": "menu.cnt", "words": [{"text": "2"}]}]
    rows = spark.createDataFrame([(1, json.dumps({"valid_line": lines})), (2, "broken"), (3, None)], "id long, ground_truth string")
    got = {r["id"]: r for r in datasets.examples(rows).collect()}
    assert got[1]["words"] == ["Tea", "Green", "TOTAL", "DUE", "9", "thanks", "x", "2"]
    assert got[1]["bio_labels"] == ["B-VALUE", "I-VALUE", "B-KEY", "I-KEY", "I-VALUE", "O", "O", "B-VALUE"]
    assert got[1]["boxes"][:3] == [[0, 1, 9, 8], [1, 1, 2, 2], [0, 0, 5, 0]] and got[2]["words"] == got[3]["bio_labels"] == []
    made = datasets.annotations(rows, "receipts", "train")
    datasets.write_jsonl(made, str(tmp_path / "out"))
    back = datasets.read_dataset(spark, str(tmp_path / "out"), "json", "doc_id string, ocr_text string, bio_labels array<string>, ocr_tokens array<struct<text:string,bbox:array<int>,confidence:double,page_number:int>>, metadata struct<source_dataset:string,source_split:string,source_id:string>")
    assert {r["doc_id"]: r["ocr_text"] for r in back.collect()} == {"receipts_train_1": "Tea Green TOTAL DUE 9 thanks x 2", "receipts_train_2": "", "receipts_train_3": ""}
    plan = back.select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:string>" in plan


def test_flat_layout(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", " ", "b", "c", "d"], [[1, 1, 2, 2], [0, 0, 0, 0], [], [3, 3, 4, 4], [5, 5, 6, 6]], [1, 1, 2, 0, 9])], "id long, words array<string>, bboxes array<array<long>>, ner_tags array<long>")
    r = datasets.examples(rows, ["O", "menu.nm", "Other"]).first()
    assert (r["words"], r["bio_labels"]) == (["a", "b", "c", "d"], ["B-VALUE", "O", "O", "B-VALUE"]) and r["boxes"][1] == [0, 0, 0, 0]
    f = datasets.examples(rows, ["O", "B-QUESTION", "I-ANSWER"], forms=True).first()
    assert f["bio_labels"] == ["B-KEY", "I-VALUE", "O", "O"]
    rows.repartition(1).write.parquet(str(tmp_path / "flat"))
    read = datasets.examples(datasets.read_dataset(spark, str(tmp_path / "flat")), ["O", "menu.nm", "Other"])
    assert read.first()["words"] == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        datasets.examples(rows.drop("ner_tags"))


# ---------------------------------------------------------------- the labeller
def test_labels_equal_numpy_and_models_load_once(spark, tmp_path):
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(5, 512))
    words = [[f"w{rng.integers(30)}" * int(rng.integers(1, 4)) for _ in range(int(rng.integers(0, 12)))] for _ in range(150)]
    rows = [(f"d{i}", j, w, 0.9, 37 * j, 91 * j, 1) for i, ws in enumerate(words) for j, w in enumerate(ws)]
    from ledgerloom.operators import packed

    docs = spark.createDataFrame([(f"d{i}",) for i in range(150)], "doc_id string").join(packed.pack(spark.createDataFrame(rows, TOKENS)), "doc_id", "left").repartition(6)
    folder = str(tmp_path)

    def load():
        open(f"{folder}/{os.getpid()}-{os.urandom(4).hex()}", "w").close()
        return labeler.LinearModel(weights)

    for layout in (True, False):
        got = {r["doc_id"]: (r["labels"], r["sure"]) for r in labeler.label_tokens(docs, f"m-{folder}-{layout}", load, use_layout=layout, documents=7).collect()}
        model = labeler.LinearModel(weights)
        for i, ws in enumerate(words):
            boxes = np.array([(37 * j, 91 * j) if layout else (0, 0) for j in range(len(ws))]).reshape(-1, 2)
            f, of = model.features(ws, boxes)
            want = []
            for j in range(len(ws)):
                s = weights[:, f[list(of).index(j)]].sum(axis=1)
                p = np.exp(s) / np.exp(s).sum()
                want.append((labeler.LABELS[int(p.argmax())], float(p.max())))
            assert got[f"d{i}"][0] == [a for a, _ in want] and got[f"d{i}"][1] == pytest.approx([b for _, b in want])
    pids = [n.split("-")[0] for n in os.listdir(folder)]
    assert len(pids) == 2 * len(set(pids))  # each worker loaded either model once, whatever its tasks and batches
    low = labeler.label_tokens(docs, f"m-{folder}-True", load, threshold=2.0)
    assert {x for r in low.collect() for x in r["labels"]} == {"O"} and labeler.mean_confidence(low).first()["n"] == 0
    mean = labeler.mean_confidence(labeler.label_tokens(docs, f"m-{folder}-True", load)).first()
    assert 0.2 < mean["mean"] <= 1 and mean["n"] > 0


# ---------------------------------------------------------------- calls that fail
def flaky(folder):
    def ask(key, prompt, attempt):
        if folder:
            open(f"{folder}/{key}-{attempt}-{os.urandom(3).hex()}", "w").close()
        n = zlib.crc32(f"{key}:{attempt}".encode()) % 10
        if n < 4:
            raise RuntimeError("HTTP 429 Too Many Requests")
        if n == 4:
            raise RuntimeError("HTTP 400")
        return f"{prompt}!{attempt}"

    return ask


def by_hand(key):
    for attempt in range(3):
        n = zlib.crc32(f"{key}:{attempt}".encode()) % 10
        if n == 4 or n < 4 and attempt == 2:
            return None, attempt + 1
        if n > 4:
            return f"p{key}!{attempt}", attempt + 1


@pytest.mark.parametrize("parts", [1, 7])
def test_retries_are_the_same_at_any_partitioning(spark, parts):
    calls = spark.range(300).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt")).repartition(parts)
    got = {r["key"]: r for r in offline.ask_all(calls, flaky(""), max_retries=2, sleep=lambda s: None, at_once=40).collect()}
    assert {k: (r["reply"], r["attempts"]) for k, r in got.items()} == {str(i): by_hand(str(i)) for i in range(300)}
    assert all(r["waited"] == sum(0.75 * 2**k for k in range(r["attempts"] - 1)) for r in got.values()) and {r["error"] for r in got.values()} == {None, "HTTP 400", "HTTP 429 Too Many Requests"}


def test_answers_are_stored_by_round(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    calls = spark.createDataFrame([(str(i % 40), f"p{i % 40}") for i in range(90)], "key string, prompt string")
    run = lambda: {r["key"]: (r["reply"], r["attempts"]) for r in offline.ask_in_rounds(calls, flaky(str(asked)), str(tmp_path / "log"), rounds=3, max_retries=2, sleep=lambda s: None).collect()}
    first = run()
    n = len(os.listdir(asked))
    assert first == {str(i): by_hand(str(i)) for i in range(40)} and n == sum(a for _, a in first.values())
    assert run() == first
    failed = sum(a for reply, a in first.values() if reply is None)
    assert len(os.listdir(asked)) == n + failed  # only what has no answer is asked again


def test_a_cache_that_holds_a_key_twice_answers_once(spark):
    calls = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, 3, "a")], "call_id long, doc_id long, prompt string")
    cache = calls.filter("prompt = 'a'").select(offline.cache_key(F.col("prompt"), F.lit("mock")).alias("key"), F.lit("{}").alias("reply"), F.lit(0.5).alias("cost_usd"))
    out, fresh = offline.call_with_cache(calls, cache, "mock", lambda rows: rows.withColumn("reply", F.lit("r")))
    assert sorted((r["call_id"], r["hit"]) for r in out.collect()) == [(1, True), (2, False), (3, True)] and fresh.count() == 1


def test_field_pipeline_reads_its_replies(spark):
    text = "Invoice Number: INV-1\nDate 2025-01-12\nVendor: ABC Corp\nItem: Widget, Qty: 2, Price: 5.00\nTotal Amount: 10.00"
    docs = spark.createDataFrame([(1, text), (2, "nothing")], "doc_id long, text string")
    none = spark.createDataFrame([], "key string, reply string, cost_usd double")
    got = {r["doc_id"]: r for r in offline.field_documents(offline.field_pipeline(docs, none)).collect()}
    x = got[1]["extracted"]
    assert (x["invoice_number"], x["vendor"], x["total_amount"], [tuple(i) for i in x["line_items"]]) == ("INV-1", "ABC Corp", 10.0, [("Widget", 2.0, 5.0)]) and got[1]["cost_usd"] > 0


def test_documents_are_asked_until_they_answer(spark):
    def ask(key, prompt, attempt):
        if "never" in prompt:
            return "I can't"
        return "{broken" if attempt == 0 else 'Sure: {"vendor": "V", "total_amount": 5, "line_items": [{"description": "a", "quantity": 2}, {}]}'

    docs = spark.createDataFrame([(1, "one"), (2, "never"), (3, "one"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in offline.ask_documents(docs, ask).collect()}
    assert [tuple(x) for x in got[1]["extracted"]["line_items"]] == [("a", 2.0, None), (None, None, None)] and got[1]["extracted"]["vendor"] == "V"
    assert (got[1]["attempts"], got[2]["attempts"], got[2]["extracted"], got[3]["attempts"]) == (2, 3, None, 2) and "JSON object" in got[2]["error"] and got[1]["cost_usd"] > 0


@pytest.mark.parametrize(("text", "want"), [("so\n{bad\n42", "42"), ("one\nvendor: \"A\"\n??", "A"), ("x: 1\ny: 2", "2"), ("nothing", None), (None, None), ('a [1] b {"c": 2}', None)])
def test_last_lines_of_a_reply(spark, text, want):
    from ledgerloom.functions.scalars import loads_with_repair

    v = loads_with_repair(F.lit(text).cast("string"))
    assert spark.range(1).select(F.try_variant_get(v, "$", "string")).first()[0] == want


# ---------------------------------------------------------------- noise
def test_noise_sweep(spark):
    truth = {"invoice_number": "INV-1023", "date": "2025-01-12", "total_amount": 1200.5}
    words = ["Invoice", "Number", "INV-1023", "Date", "2025-01-12", "Total", "Amount", "1200.50"]
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(w).alias("text"), F.lit(0.95).alias("confidence"), F.lit(i * 50).alias("x0"), F.lit(0).alias("y0"), F.lit(1).alias("page_number")) for i, w in enumerate(words)]).alias("t"), F.lit(json.dumps(truth)).alias("truth"))
    got = {(r["variant"], r["factor"]): r for r in benchmarks.noise_sweep(docs, [0.0, 0.2, 1.0], "2030-01-01").collect()}
    assert len(got) == 33 and all(r["n_docs"] == 40 for r in got.values())
    full = [got["full", f] for f in (0.0, 0.2, 1.0)]
    assert full[0]["exact_match"] == full[0]["field_f1"] == 1.0 and full[0]["field_f1"] > full[1]["field_f1"] > full[2]["field_f1"] == 0.0
    t = benchmarks.with_noise(docs, [1.0]).first()["t"]
    assert [x["text"] for x in t] == ["nvc", "Nmbr", "NV-1023", "Dt", "2025-01-1#", "Ttl", "mnt", "1200.5#"] and t[0]["confidence"] == pytest.approx(0.65)


# ---------------------------------------------------------------- small parts
def test_ground_truth_items(spark):
    from ledgerloom.sources.annotations import clean_items

    item = "struct<description:string,quantity:double,unit_price:double>"
    cases = [
        ([(" Tea ", None, 0.0), (None, 2.0, None)], [("Tea", 2.0, None)]), ([("Tea", None, 5.0), (None, 2.0, 5.0), (None, 3.0, None)], [("Tea", 2.0, 5.0), (None, 3.0, None)]),
        ([("Tea", None, 5.0), (None, 2.0, 6.0)], [("Tea", None, 5.0), (None, 2.0, 6.0)]), ([("", None, 0.0)], []), ([(None, 1.0, None), ("A", None, None)], [(None, 1.0, None), ("A", None, None)]), ([], []),
    ]
    for given, want in cases:
        df = spark.createDataFrame([(given,)], f"i array<{item}>")
        assert [tuple(x) for x in df.select(clean_items(F.col("i"))).first()[0]] == want


def test_small_operators(spark):
    from ledgerloom.functions import scalars
    from ledgerloom.operators import conversion, fields, labels, metrics, packed, tokens

    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(scalars.dataset_amount(F.lit(x))) for x in ("a 1,200.50 b 3", "none", "-5 and 1,000")] == [3.0, None, 1000.0]
    assert [one(packed.amount_text(F.lit(x))) for x in (24000.0, 73.456, 0.0)] == ["24000", "73.46", "0"]
    assert [one(scalars.semantic_category(F.lit(x))) for x in ("B-Menu_KEY", "I-total_value", "O")] == ["menu", "total", "o"]
    assert [one(scalars.remap_label(F.lit(x), strict)) for x, strict in (("b-key", False), ("B-KEY", True), ("I-x", False), ("O", True))] == ["B-VALUE", "B-KEY", "I-VALUE", "O"]
    assert [one(scalars.plausible_total(F.lit(x))) for x in (0.5, 1999.0, 1999.5, 2e12, 12.0)] == [False, False, True, False, True]
    low = labels.confident_labels(spark.createDataFrame([("B-KEY", 0.4), ("B-KEY", 0.6)], "label string, confidence double"), 0.5)
    assert [r["label"] for r in low.collect()] == ["O", "B-KEY"]
    made = one(tokens.build_tokens(F.array(F.lit(" a "), F.lit(" "), F.lit("b")), F.array(F.array(F.lit(1)), F.array(F.lit(2)), F.array(F.lit(3)))))
    assert [(x["text"], x["bbox"], x["confidence"], x["page_number"]) for x in made] == [("a", [1], 1.0, 1), ("b", [3], 1.0, 1)]
    back = fields.backfill(spark.createDataFrame([("d", "date", "2024-01-05", 0.9)], "doc_id string, field string, value string, confidence double")).collect()
    assert {r["field"]: (r["value"], r["confidence"]) for r in back} == {"date": ("2024-01-05", 0.9), "invoice_number": (None, 0.0), "vendor": (None, 0.0), "total_amount": (None, 0.0), "line_items": (None, 0.0)}
    results, dataset = spark.createDataFrame([(1, "r"), (2, "r")], "doc_id int, r string"), spark.createDataFrame([(2, "d"), (3, "d")], "doc_id int, d string")
    rows = lambda how: sorted((x["doc_id"], x["r"], x["d"]) for x in metrics.with_dataset(results, dataset, how).collect())
    assert rows("keep") == [(1, "r", None), (2, "r", "d")] and rows("drop") == [(2, "r", "d")] and rows("fill") == [(2, "r", "d"), (3, None, "d")]
    assert [r["doc_id"] for r in metrics.first_documents(dataset, "doc_id", 1).collect()] == [2]
    docs = spark.createDataFrame([(1, ["x"]), (2, []), (3, None)], "doc_id int, ocr_tokens array<string>")
    extract = lambda d: d.withColumn("ocr_tokens", F.array(F.lit("new")))
    assert sorted((r["doc_id"], r["ocr_tokens"], r["reused_cached_ocr"]) for r in conversion.prepared(docs, extract).collect()) == [(1, ["x"], True), (2, ["new"], False), (3, ["new"], False)]
    assert all(not r["reused_cached_ocr"] for r in conversion.prepared(docs, extract, force=True).collect())


def test_synthetic_tokens_run_along_the_line(spark):
    from ledgerloom.operators import tokens

    text = " ".join(["a", "bbbb"] * 400) + "\n\n  c"
    got = tokens.synthetic_tokens(spark.createDataFrame([("d", text)], "doc_id string, text string"))
    rows = {(r["line"], r["i"]): (r["word"], r["x0"], r["x1"], r["y0"]) for r in got.collect()}
    x = 0
    for i, w in enumerate(["a", "bbbb"] * 400):
        width = max(12, 8 * len(w))
        assert rows[0, i] == (w, x, x + width, 0)
        x += width + 6
    assert rows[2, 0] == ("c", 0, 12, 48) and len(rows) == 801
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_nearest_vectors(spark):
    from ledgerloom.operators import retrieval

    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8)).round(2)
    vectors = np.concatenate([base, base[:1].repeat(40, axis=0), np.zeros((2, 8))])
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    df = spark.createDataFrame([*rows, (500, None)], "vec_id long, embedding array<float>").repartition(5)
    unit = {i: np.array(np.float32(v), np.float64) for i, v in rows}
    unit = {i: v / (np.linalg.norm(v) or 1) for i, v in unit.items()}
    want = {q: [j for _, j in sorted(((round(float(unit[q] @ unit[j]), 10), j) for j in unit if j != q), reverse=True)[:4]] for q in unit if q % 3 == 0}
    for block in (10_000, 9):
        got = retrieval.nearest(df, df.filter("vec_id % 3 = 0"), 4, block).collect()
        assert {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in want} == want
    few = retrieval.nearest(df.filter("vec_id < 3"), df.filter("vec_id = 0"), 4).collect()
    assert len(few) == 2 and retrieval.nearest(df.limit(0), df.filter("vec_id = 0"), 4).count() == 0


def test_lines_are_trimmed_of_blanks_alone(spark):
    """A function of two parameters given to transform would get each line's number as the characters to trim."""
    from ledgerloom.operators import tokens

    df = spark.createDataFrame([("d", " 0 first 0 \n1 second 1\n\n 2 third 2")], "doc_id string, text string")
    assert [r["chunk"] for r in tokens.chunk_lines(df, 12).orderBy("chunk_id").collect()] == ["0 first 0", "1 second 1", "2 third 2"]


def test_noise_confidences_add_up_exactly(spark, tmp_path):
    from decimal import Decimal

    from ledgerloom.plans.experiment_queries import noise_tokens

    rows = [(i, " ".join(f"word{j}" for j in range(900 + i))) for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in noise_tokens(spark, str(tmp_path)).collect():
        assert r["confidence"] == float(r["n_hit"] * Decimal("0.2") + (r["n_tokens"] - r["n_hit"]) * Decimal("0.5"))
