"""Token tables: boxes, synthetic tokens from text, line grouping, overlap removal, truncation, noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.helpers import let, scan, settled
from ..functions.scalars import words

TOKEN = "array<struct<pos:int,text:string,x0:int,y0:int,x1:int,y1:int,confidence:double,page_number:int>>"


def normalize_box(v: Column, dim: Column) -> Column:
    """A coordinate on the 0-1000 scale, rounded half to even and clamped."""
    return F.least(F.lit(1000), F.greatest(F.lit(0), F.bround(v * 1000.0 / dim).cast("int")))


def truncate_box(v: Column, dim: Column) -> Column:
    """A coordinate on the 0-1000 scale, cut to a whole number; 0 for sizes of 0 or less."""
    return F.when(dim > 0, (v * 1000.0 / dim).cast("int")).otherwise(0)


def iou(a: Column, b: Column) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    inter = side("x0", "x1") * side("y0", "y1")
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    union = area(a) + area(b) - inter
    return F.coalesce(F.try_divide(inter.cast("double"), F.nullif(union, F.lit(0))), F.lit(0.0))


def drop_overlaps(tokens: Column, threshold: float = 0.85) -> Column:
    """Greedy: in order of y, x and falling confidence, a token goes if it overlaps one that was kept."""
    order = F.array_sort(tokens, lambda p, q: F.when(p["y0"] != q["y0"], p["y0"] - q["y0"]).when(p["x0"] != q["x0"], p["x0"] - q["x0"]).when(p["confidence"] != q["confidence"], F.signum(q["confidence"] - p["confidence"]).cast("int")).otherwise(p["pos"] - q["pos"]))
    return F.aggregate(order, F.array().cast(TOKEN), lambda acc, t: F.when(F.exists(acc, lambda k: iou(k, t) >= threshold), acc).otherwise(F.array_append(acc, t)))


def synthetic_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per word: line, place, and a box of width max(12, 8 per character), gap 6, line height 24."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.col(text), "\n")).alias("line", "t"))
    wide = lambda w: F.greatest(F.lit(12), F.length(w) * 8)
    # A line's running width is a fold within its row; words are not shuffled.
    rows = settled(lines, {"w": words(F.col("t"))})
    rows = settled(rows, {"x": scan(F.col("w"), F.lit(0), lambda s, w: s + wide(w) + 6, "int", lambda s: s, "int")})
    words_ = rows.select("doc_id", "line", F.posexplode(F.arrays_zip("w", "x")).alias("i", "z")).select("doc_id", "line", "i", F.col("z.w").alias("word"), F.col("z.x").alias("x"))
    wide = F.greatest(F.lit(12), F.length("word") * 8)
    return words_.withColumn("x0", (F.col("x") - wide - 6).cast("int")).select("doc_id", "line", "i", "word", "x0", (F.col("line") * 24).alias("y0"), (F.col("x0") + wide).alias("x1"), (F.col("line") * 24 + 16).alias("y1"), F.lit(0.99).alias("confidence"))


def group_lines(tokens: DataFrame, tolerance: int = 18) -> DataFrame:
    """(doc_id, line_no, y, text) by an ordered fold: a token joins while its y is within ``tolerance`` of the line's least y."""
    packed = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "y0", "x0", "pos", "text"))).alias("t"))
    state = "struct<line:int,y:int,page:int,out:array<int>>"
    start = F.struct(F.lit(-1).alias("line"), F.lit(0).alias("y"), F.lit(0).alias("page"), F.array().cast("array<int>").alias("out")).cast(state)

    def step(s: Column, t: Column) -> Column:
        same = (s["line"] >= 0) & (F.abs(t["y0"] - s["y"]) <= tolerance) & (t["page_number"] == s["page"])
        line = F.when(same, s["line"]).otherwise(s["line"] + 1)
        return F.struct(line.alias("line"), F.when(same, F.least(s["y"], t["y0"])).otherwise(t["y0"]).alias("y"), t["page_number"].alias("page"), F.array_append(s["out"], line).alias("out")).cast(state)

    numbered = packed.select("doc_id", F.explode(F.arrays_zip("t", F.aggregate("t", start, step)["out"].alias("line"))).alias("z"))
    rows = numbered.select("doc_id", F.col("z.line").alias("line_no"), "z.t.*")
    return rows.groupBy("doc_id", "line_no").agg(F.min("y0").alias("y"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "pos", "text"))), lambda x: x["text"]), " ").alias("text"))


def truncate_words(c: Column, limit: int) -> Column:
    """The first ``limit`` words; the text itself if it has no more."""
    return let(words(c), lambda w: F.when(F.size(w) > limit, F.array_join(F.slice(w, 1, limit), " ")).otherwise(c))


def corrupt(c: Column, keys: list[Column], factor: float) -> Column:
    """Noise on a share ``factor`` of tokens, chosen by a hash of the keys: vowels go, or else the last character turns to #."""
    hit = F.pmod(F.xxhash64(*keys), F.lit(1_000_000)) < int(factor * 1_000_000)
    bare = F.regexp_replace(c, "[aeiouAEIOU]", "")
    return F.when(hit, F.when((bare != "") & (bare != c), bare).otherwise(F.concat(F.substring(c, 1, F.length(c) - 1), F.lit("#")))).otherwise(c)


def chunk_lines(docs: DataFrame, limit: int, text: str = "text") -> DataFrame:
    """(doc_id, chunk_id, chunk): lines joined greedily up to ``limit`` characters with line breaks; a longer line stands alone."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    state = "struct<done:array<string>,now:string>"

    def step(s: Column, line: Column) -> Column:
        joined = F.length(s["now"]) + 1 + F.length(line)
        fits = (s["now"] == "") | (joined <= limit)
        now = F.when(s["now"] == "", line).when(fits, F.concat(s["now"], F.lit("\n"), line)).otherwise(line)
        return F.struct(F.when(fits, s["done"]).otherwise(F.array_append(s["done"], s["now"])).alias("done"), now.alias("now")).cast(state)

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now")).cast(state)
    folded = F.aggregate(lines, start, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.array_append(s["done"], s["now"])))
    return docs.select("doc_id", F.posexplode(folded).alias("chunk_id", "chunk"))


def polygon_box(points: Column) -> Column:
    """STRUCT(x0, y0, x1, y1) around points (x, y), whose coordinates are cut to whole numbers."""
    of = lambda pick, axis: pick(F.transform(points, lambda p: p[axis].cast("int")))
    return F.struct(of(F.array_min, "x").alias("x0"), of(F.array_min, "y").alias("y0"), of(F.array_max, "x").alias("x1"), of(F.array_max, "y").alias("y1"))


def scaled_box(box: Column, width: Column, height: Column) -> Column:
    """The box on the 0-1000 scale, rounded half to even, corners in order; null where a size is 0 or less."""
    x, y = (lambda v: normalize_box(v, width)), (lambda v: normalize_box(v, height))
    corner = lambda pick, a, b: pick(a, b)
    out = F.struct(corner(F.least, x(box["x0"]), x(box["x1"])).alias("x0"), corner(F.least, y(box["y0"]), y(box["y1"])).alias("y0"), corner(F.greatest, x(box["x0"]), x(box["x1"])).alias("x1"), corner(F.greatest, y(box["y0"]), y(box["y1"])).alias("y1"))
    return F.when((width > 0) & (height > 0), out)


def scale_if_needed(boxes: Column, width: Column, height: Column) -> Column:
    """Boxes cut to the 0-1000 scale if any coordinate is over 1000, else as they are."""
    large = F.exists(boxes, lambda b: F.greatest(b["x0"], b["y0"], b["x1"], b["y1"]) > 1000)
    scaled = F.transform(boxes, lambda b: F.struct(*[truncate_box(b[c], width if c[0] == "x" else height).alias(c) for c in ("x0", "y0", "x1", "y1")]))
    return F.when(large, scaled).otherwise(boxes)


def confident(tokens: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Tokens with text and at least the confidence."""
    return tokens.filter((F.trim("text") != "") & (F.col("confidence") >= threshold))


def degrade(tokens: DataFrame) -> DataFrame:
    """Confidence 0.25 lower, at least 0; every fourth token by place, from the first, loses its last character."""
    short = F.when(F.col("pos") % 4 == 0, F.substring("text", F.lit(1), F.greatest(F.length("text") - 1, F.lit(0)))).otherwise(F.col("text"))
    return tokens.withColumns({"text": short, "confidence": F.greatest(F.lit(0.0), F.col("confidence") - 0.25)})


def serialize(tokens: DataFrame) -> DataFrame:
    """(doc_id, text): the texts in order of page, y and x, with one blank between."""
    packed = F.array_sort(F.collect_list(F.struct(F.coalesce("page_number", F.lit(1)).alias("page"), "y0", "x0", "pos", F.trim("text").alias("text"))))
    return tokens.filter(F.trim("text") != "").groupBy("doc_id").agg(F.array_join(F.transform(packed, lambda x: x["text"]), " ").alias("text"))


def build_tokens(words_: Column, boxes: Column) -> Column:
    """Tokens of words and boxes side by side, confidence 1 and page 1; blank words go."""
    both = F.filter(F.arrays_zip(words_.alias("w"), boxes.alias("b")), lambda z: F.trim(z["w"]) != "")
    return F.transform(both, lambda z: F.struct(F.trim(z["w"]).alias("text"), z["b"].alias("bbox"), F.lit(1.0).alias("confidence"), F.lit(1).alias("page_number")))
