"""Mixing sources to target weights by soft membership, DataFrame functions only.

A Bernoulli naive Bayes model, learned from a labelled table, gives every document posterior probabilities p of
the domains. Its features are hashed tokens and three shapes of the text (the share of tokens that are marks, of
tokens that repeat the one before, and of distinct lines, in tenths or eighths); only features whose presence in
a domain tells something by its log-odds, drawn to those of all by their error, count. Posteriors are whole multiples
of 1 / ``grain`` that add up to 1.

Nonnegative document rates r then minimise the squared distance between the expected domain token totals, sum of
r * n_tokens * p, and the targets, plus a ridge of 1e-9 towards r = 1 that makes them unique. The minimisation is
projected gradient descent: steps along the gradient, each scaled by the Gram matrix of the documents whose rate
is not at zero and shortened until the objective falls, add up to one weight for each domain, and a rate is
1 - p . weights, cut at zero. Documents with equal posteriors have equal rates, so a step runs over the distinct
posteriors with their token counts, at most (grain + 1) to the power of the domains less 1 whatever the corpus
holds; sums are exact decimals, so the rates don't depend on the partitioning. The descent ends when the
gradient vanishes and raises if it doesn't; where no rates reach the targets, the gap of the best ones is logged.

Defined cases: null and empty texts have no tokens and get the labelled table's domain shares as
posteriors; null domains are not learned; without labelled rows all named domains are equally likely;
repeated rows are separate documents; a domain without mass keeps its total; without tokens all rates are 1;
extra columns are ignored.
"""

from __future__ import annotations

import json
import logging
import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_fraction, cut, hash_share, let, stored

#: Features of a text's shape, after the token buckets: from these offsets on.
MARKS, REPEATS, LINES, SHAPES = 0, 16, 32, 48


def tokens(col: Column) -> Column:
    """Lower-case words and runs of other marks."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"([^\p{L}\s]+)", " $1 ")), r"\s+")


def filled(col: Column) -> Column:
    return F.filter(tokens(col), lambda x: x != "")


def features(text: Column, buckets: int) -> Column:
    """STRUCT(n, f): the number of tokens and the features, token buckets with repeats first; none for an empty text."""

    def shapes(w: Column, b: Column) -> Column:
        n = F.size(w)
        marks = F.size(F.filter(w, lambda x: (F.ascii(x) < 97) | F.ascii(x).between(123, 191)))
        again = F.size(F.filter(b, lambda x, i: (i > 0) & (x == F.get(b, i - 1))))
        lines = F.filter(F.split(text, "\n"), lambda x: x != "")
        share = lambda part, whole, steps: F.ceil(part * F.lit(float(steps)) / F.greatest(whole, F.lit(1))).cast("int")
        found = F.array(F.lit(buckets + MARKS) + share(marks, n, 10), F.lit(buckets + REPEATS) + share(again, n, 10), F.lit(buckets + LINES) + let(lines, lambda x: share(F.size(F.array_distinct(x)), F.size(x), 8)))
        return F.struct(n.cast("long").alias("n"), F.when(n > 0, F.concat(b, found)).otherwise(b).alias("f"))

    return let(filled(text), lambda w: let(F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int")), lambda b: shapes(w, b)))


#: Log-odds below which a feature tells nothing.
LEAST_ODDS = 0.3


def constant(values: list, kind: str) -> Column:
    """A folded array constant; a literal with one child per number would be slow to plan."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], buckets: int = 32768, max_train: int = 20000, doubt: float = 8.0) -> tuple[list[int], list[list[float]], list[float], list[float]]:
    """(place of each feature among the chosen, 0 for none; their log-odds [domain][place]; log-odds of having none of them; log-priors), from at most about ``max_train`` labelled rows.

    A domain's log-odds of a feature are drawn to those of all domains by the error of their difference: where it is z
    standard errors, z*z / (z*z + doubt*doubt) of it counts. So chance differences of thousands of features
    don't add up; features that then move no domain by ``LEAST_ODDS`` are left out.

    ``labelled`` has doc_id and domain. The sample is taken by a hash of doc_id, so it is bounded and is
    broadcast; buckets times domains counts come back to the driver.
    """
    known = labelled.select("doc_id", "domain").filter(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
    sizes = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    known = known.filter(hash_share(F.col("doc_id"), 4, bounded_fraction(sum(sizes.values()), max_train)))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    present = F.array_distinct(features(F.coalesce("text", F.lit("")), buckets)["f"])
    # Feature -1 counts the rows.
    counted = rows.select("domain", F.explode(F.array_append(present, F.lit(-1))).alias("f")).groupBy("domain", "f").agg(F.count("*").alias("n")).collect()
    counts = {d: [0] * (buckets + SHAPES) for d in domains}
    held = dict.fromkeys(domains, 0)
    for r in counted:
        if r["f"] < 0:
            held[r["domain"]] = r["n"]
        else:
            counts[r["domain"]][r["f"]] = r["n"]
    n_rows = sum(held.values())
    place, odds, none = [0] * (buckets + SHAPES), [[0.0] for _ in domains], [0.0] * len(domains)
    for f, of in enumerate(zip(*counts.values(), strict=True)):
        n = sum(of)
        if not 0 < n < n_rows:
            continue
        share = n / n_rows
        base, drawn = math.log(share / (1 - share)), []
        for c, m in zip(of, held.values(), strict=True):
            p = min(1 - 1e-6, max(1e-6, (c + share) / (m + 1)))
            z = (c - m * share) / math.sqrt(max(1e-9, m * share * (1 - share) * (1 - m / n_rows)))
            drawn.append(z * z / (z * z + doubt * doubt) * (math.log(p / (1 - p)) - base))
        if max(map(abs, drawn)) < LEAST_ODDS:
            continue
        place[f] = len(odds[0])
        for k, d in enumerate(drawn):
            odds[k].append(round(base + d, 6))
            none[k] += math.log(1 / (1 + math.exp(base + d)))
    seen = sum(sizes.values())
    priors = [math.log((sizes.get(d, 0) + 1) / (seen + len(domains))) for d in domains]
    return place, odds, none, priors


def posteriors(docs: DataFrame, model: tuple, grain: int, keep: list[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with n_tokens and q, an array of the domains' posteriors times ``grain``. Row by row, no shuffle."""
    place, odds, none, priors = model
    where = constant(place, "array<int>")
    weights = [constant(row, "array<double>") for row in odds]

    def whole(p: Column) -> Column:
        """Rounded down to whole numbers, the rest for the likeliest domain."""
        low = F.transform(p, lambda v: F.floor(v * F.lit(float(grain))).cast("int"))
        return let(low, lambda q: let(F.lit(grain) - F.aggregate(q, F.lit(0), lambda a, x: a + x), lambda rest: let(F.array_position(p, F.array_max(p)) - 1, lambda top: F.transform(q, lambda x, i: x + F.when(i == top, rest).otherwise(0)))))

    def shares(x: Column) -> Column:
        return let(F.transform(x, lambda v: F.exp(v - F.array_max(x))), lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, v: s + v), lambda n: let(F.transform(e, lambda v: v / n), whole)))

    def scores(found: Column, n: Column) -> Column:
        evidence = lambda w, z: F.aggregate(found, F.lit(z), lambda a, i: a + F.get(w, i))
        sums = [F.lit(prior) + F.when(n > 0, evidence(w, z)).otherwise(0.0) for w, z, prior in zip(weights, none, priors, strict=True)]
        return let(F.array(*sums), shares)

    chosen = lambda f: F.array_distinct(F.filter(F.transform(f, lambda x: F.get(where, x)), lambda i: i > 0))
    members = let(features(F.coalesce(F.col("text"), F.lit("")), len(place) - SHAPES), lambda x: F.struct(x["n"].alias("n_tokens"), let(chosen(x["f"]), lambda c: scores(c, x["n"])).alias("q")))
    # A generator of one row: filters on what is made of q would else be moved below and make q again.
    return docs.select(*keep, F.inline(F.array(members)))


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gauss-Jordan with pivoting for a positive definite system of the size of the domains."""
    n = len(right)
    m = [[*row, b] for row, b in zip(matrix, right, strict=True)]
    for i in range(n):
        top = max(range(i, n), key=lambda k: abs(m[k][i]))
        m[i], m[top] = m[top], m[i]
        for k in range(n):
            if k != i:
                f = m[k][i] / m[i][i]
                m[k] = [a - f * b for a, b in zip(m[k], m[i], strict=True)]
    return [m[i][n] / m[i][i] for i in range(n)]


def rate(weights: list[float], grain: int) -> Column:
    """1 - p . weights, cut at zero, from the column q."""
    if not any(weights):
        return F.lit(1.0)
    moved = F.lit(0.0)
    for i, w in enumerate(weights):
        moved = moved + F.col("q")[i] * F.lit(w / grain)
    return F.greatest(F.lit(0.0), F.lit(1.0) - moved)


def fit_weights(cells: DataFrame, targets: list[float], grain: int, tolerance: float = 1e-4, ridge: float = 1e-9, max_steps: int = 400) -> list[float]:
    """The domains' weights whose rates are the best, from (q, n_tokens) rows.

    The objective, over N tokens and targets t as shares, is sum n r^2 / 2N + t . w + ridge w^2 / 2: the dual
    of the ridged least squares, whose gradient is the gap between targets and totals plus ridge times w.
    Raises where the gradient isn't under a thousandth of ``tolerance`` after ``max_steps``; logs the gap of the
    best rates where it is over ``tolerance`` of all tokens.
    """
    k, log = len(targets), logging.getLogger(__name__)
    total = int(cells.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0)
    if not total:
        return [0.0] * k
    goal = [t / sum(targets) for t in targets]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def look(w: list[float]) -> tuple[float, list[float], list[list[float]], list[float]]:
        exact = lambda c: F.sum(c.cast("decimal(38,6)"))
        n, r = F.col("n_tokens"), F.col("r")
        live = F.when(r > 0, n.cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))
        row = cells.select("n_tokens", "q", rate(w, grain).alias("r")).agg(exact(n * r * r).alias("s"), *[exact(n * r * F.col("q")[i] / grain).alias(f"t{i}") for i in range(k)], *[F.sum(live * (F.col("q")[i] * F.col("q")[j])).alias(f"g{i}_{j}") for i, j in pairs]).first()
        gap = [float(row[f"t{i}"] / total) - goal[i] for i in range(k)]
        value = float(row["s"] / total) / 2 + sum(g * x for g, x in zip(goal, w, strict=True)) + ridge * sum(x * x for x in w) / 2
        gram = [[float(row[f"g{min(i, j)}_{max(i, j)}"] / total / Decimal(grain * grain)) + (ridge if i == j else 0.0) for j in range(k)] for i in range(k)]
        return value, [ridge * x - g for x, g in zip(w, gap, strict=True)], gram, gap

    weights = [0.0] * k
    value, slope, gram, gap = look(weights)
    for _ in range(max_steps):
        if max(map(abs, slope)) <= tolerance / 1000:
            break
        step = solve(gram, [-x for x in slope])
        fall = sum(a * b for a, b in zip(step, slope, strict=True))
        size = 1.0
        while True:
            tried = [x + size * d for x, d in zip(weights, step, strict=True)]
            seen = look(tried)
            if seen[0] <= value + 1e-4 * size * fall or size < 1e-12:
                break
            size /= 2 if size > 0.2 else 8
        if seen[0] >= value and max(map(abs, seen[1])) >= max(map(abs, slope)):
            break
        weights, (value, slope, gram, gap) = tried, seen
    # Sums are kept to a millionth of a token, and weights of a ridged, unreachable target are large.
    if max(map(abs, slope)) > tolerance:
        raise RuntimeError(f"mixing: the gradient is {max(map(abs, slope)):.3g} after {max_steps} steps")
    if max(map(abs, gap)) > tolerance:
        log.warning("mixing: no rates reach the targets; with the best ones a domain's total is %.4g of all tokens off", max(map(abs, gap)))
    return weights


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], buckets: int = 32768, max_train: int = 20000, tolerance: float = 1e-4, grain: int = 1000, keep: list[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with n_tokens, a posterior column p_<domain> for each target, and rate.

    The kept columns and posteriors are written once to the checkpoint folder; steps read the posteriors alone.
    """
    domains = sorted(targets)
    model = train(docs, labelled, domains, buckets, max_train)
    members = stored(posteriors(docs, model, grain, keep=keep))
    cells = cut(members.groupBy("q").agg(F.sum("n_tokens").alias("n_tokens")))
    weights = fit_weights(cells, [targets[d] for d in domains], grain, tolerance)
    return members.select(*keep, "n_tokens", *[(F.col("q")[i] / F.lit(float(grain))).alias(f"p_{d}") for i, d in enumerate(domains)], rate(weights, grain).alias("rate"))


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: toxic, else low (quality 0) or clean (quality 1)."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean").alias("domain"))


def copies(doc_id: Column, rate_col: Column) -> Column:
    """Whole copies whose expectation over ids is the rate: its floor, and one more for a fixed share of ids."""
    grain = 1 << 30
    draw = F.pmod(F.xxhash64(doc_id, F.lit(41)), F.lit(grain)) / F.lit(float(grain))
    return (F.floor(rate_col) + F.when(draw < rate_col - F.floor(rate_col), 1).otherwise(0)).cast("long")
