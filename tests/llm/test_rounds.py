"""op8 beyond the broadcast bound: texts in rounds."""

import os

from ledgerloom.llm import lm
from ledgerloom.session import checkpoint_dir


def test_rounds_change_no_score_and_leave_no_tables(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 23}" for j in range(i % 40))) for i in range(90)] + [(5, None), (5, None), (None, "w1 new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lambda **more: sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 9), round(r["score"], 9)) for r in lm.score_documents(docs, shard_bits=2, **more).collect())
    want = got()
    folder = checkpoint_dir(spark).removeprefix("file:")
    tables = lambda: {x for x in os.listdir(folder) if x.startswith("table-")}
    before = tables()
    assert got(broadcast_bytes=0, round_bytes=2000) == want
    assert len(tables() - before) == 1  # the counts; what the rounds stored is gone
