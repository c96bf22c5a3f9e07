"""Near-duplicates under hashes that very many texts share, against brute force."""

import random

from ledgerloom.llm import simhash


def test_no_pair_of_a_crowd_is_left_out(spark, monkeypatch):
    pick = random.Random(3)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(6))
    shared = [word() for _ in range(24)]
    texts = []
    for _ in range(30):  # groups of a crowd: all share a passage, only those of one group are alike
        own = [word() for _ in range(26)]
        texts += [" ".join(shared + own), " ".join(shared + own + [word()])]
    sets = [set(simhash.shingle_set(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    want = {i: min(j for j, r in enumerate(root) if r == root[i]) for i in range(len(texts))}
    assert len(set(want.values())) == 30
    # Neither fingerprints nor turns find the links here, so it is for the last step alone to find them.
    monkeypatch.setattr(simhash, "TURNS", 0)
    monkeypatch.setattr(simhash.rest_pairs, "__defaults__", (7,))
    monkeypatch.setattr(simhash, "print_pairs", lambda nodes, *_: nodes.selectExpr("node as a", "node as b").filter("false"))
    monkeypatch.setattr(simhash, "least_pairs", lambda rows: rows.selectExpr("node as a", "node as b").filter("false"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(df, crowd=2).collect()}
    assert got == want


def test_a_common_passage_makes_few_pairs(spark, monkeypatch):
    pick = random.Random(5)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(6))
    shared = [word() for _ in range(24)]
    texts = [" ".join(shared + [word() for _ in range(30)]) for _ in range(400)]
    texts += [t + " " + word() for t in texts[:40]]
    seen, rest = [], simhash.rest_pairs
    monkeypatch.setattr(simhash, "TURNS", 0)
    monkeypatch.setattr(simhash, "print_pairs", lambda nodes, *_: nodes.selectExpr("node as a", "node as b").filter("false"))
    monkeypatch.setattr(simhash, "least_pairs", lambda rows: rows.selectExpr("node as a", "node as b").filter("false"))

    def counted(*args):
        out = rest(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(simhash, "rest_pairs", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(df, crowd=8).collect()}
    assert all(got[i] == i for i in range(400)) and all(got[400 + i] == i for i in range(40))
    # All pairs under the passage's hashes would be thousands that the sketches let pass.
    assert 40 <= seen[0] <= 400


def test_keys_with_a_large_component_lose_no_pair(spark):
    # 40 nodes of one component and 5 alone: the latter meet all others, in blocks of 8 and crossed in blocks of 3.
    rows = [(1, n, 10, 0, 0 if n < 40 else n) for n in range(45)] + [(2, n, 10, 0, 7) for n in range(9)]
    df = spark.createDataFrame(rows, "h long, node long, size long, sketch long, part long")
    want = {(a, b) for a in range(45) for b in range(40, 45) if a < b}
    for block in (3, 8, 512):
        assert {(r["a"], r["b"]) for r in simhash.rest_pairs(df, block).collect()} == want
