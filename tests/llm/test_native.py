"""The native operators run nothing outside the JVM."""

from __future__ import annotations

import re

from deckjobs.llm import chat_windows, common, fingerprint_cws


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_python(spark):
    docs = spark.sql("SELECT id AS doc_id, concat('some words ', id) AS text FROM range(20)")
    turns = spark.sql("SELECT id AS conv_id, 0L AS turn, 'user' AS role, 'hi' AS text FROM range(3)")
    for df in (fingerprint_cws.with_edits(docs), fingerprint_cws.chunk_order(fingerprint_cws.chunked(docs)), chat_windows.digests(chat_windows.windows(turns))):
        assert not re.search("Python|Pandas|Arrow", plan(df))


def test_one_sample_is_shared_as_often_as_weights_agree(spark):
    """The share of equal samples is near the generalised Jaccard similarity of two weighted sets."""
    rows = [(0, ["a"] * 4 + ["b"] * 2 + ["c"] * 1), (1, ["a"] * 2 + ["b"] * 3 + ["d"] * 3)]
    df = spark.createDataFrame([(i, w, False) for i, w in rows], "k int, words array<string>, as_value boolean")
    f = {r.k: r.fingerprint for r in fingerprint_cws.signatures(df, ["k"], samples=256).collect()}
    equal = sum(f[0][8 * j : 8 * j + 8] == f[1][8 * j : 8 * j + 8] for j in range(256)) / 256
    assert abs(equal - 4 / 11) < 0.1


def test_a_task_gives_freed_memory_back():
    def anonymous():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("Anonymous:")) / 1024

    def run(batches):
        for batch in batches:
            blocks = [bytes(60_000) for _ in range(4_000)]  # 240 MB, then freed but for some in between
            left.extend(blocks[::200])
            del blocks
            yield batch

    left = []
    before = anonymous()
    assert list(common.lean(run)(iter([1]))) == [1]
    assert anonymous() - before < 60 and len(left) == 20
