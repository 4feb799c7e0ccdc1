"""Importance draw, window packing and source audit against plain versions, on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from deckjobs.llm import common, importance_draw, source_audit, window_packing
from deckjobs.llm.queries import tokenizer_path

ODD = [None, "", " \t\n", "é😀 日本 ÀB c3-D4", "word", "x" * 5000, "A b\0C  d_e", "don't stop. Don't!"]


def texts(seed, n, size=60, letters="abcdé"):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, size))) for _ in range(n)]


def plain_draw(rows, target, share=25, seed=7, least=20, longest=2, buckets=10_000):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    hashes = lambda w: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    of = [(i, words(t)) for i, t in rows]
    s, t = Counter(), Counter()
    for _, w in of:
        s.update(hashes(w))
    for x in target:
        t.update(hashes(words(x)))
    n_s, n_t = float(sum(s.values())), float(sum(t.values()))
    out = []
    for i, w in of:
        h = hashes(w)
        gain = [math.floor(1000 * math.log((t[b] + 1.0) * (n_s + buckets) / ((s[b] + 1.0) * (n_t + buckets)))) for b in h]
        weight = sum(gain) // len(gain) if gain else 0
        u = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296)))
        out.append([i, len(h), weight, score, None, len(w) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], 2**63 if r[0] is None else r[0], r[1], r[2]))
    for place, r in enumerate(able[: share * len(able) // 100]):
        r[4] = place + 1
    return Counter(tuple(r[:5]) for r in out)


DRAW_SCHEMA = "doc_id bigint, text string, bucket int, n bigint, gain int, place int"


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_draw(spark, longest):
    rows = list(enumerate(texts(1, 60) + ODD)) + [(None, "a b c " * 30), (None, None), (3, "bb aa " * 20), (3, "bb aa " * 20)]
    target = texts(2, 10) + [None, "AB ab"]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], DRAW_SCHEMA)
    aimed = spark.createDataFrame([(t, 5) for t in target], "text string, doc_id int")
    got = importance_draw.drawn(docs, aimed, longest=longest).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got) == plain_draw(rows, target, longest=longest)


def test_draw_of_nothing_and_towards_nothing(spark):
    docs = spark.createDataFrame([], DRAW_SCHEMA)
    some = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in enumerate(texts(3, 20))], DRAW_SCHEMA)
    assert importance_draw.drawn(docs, some).collect() == []
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in importance_draw.drawn(some, docs).collect()) == plain_draw(list(enumerate(texts(3, 20))), [])
    kept = importance_draw.drawn(some, docs, columns=("doc_id", "bucket", "text")).collect()
    assert {r.text for r in kept} == set(texts(3, 20)) and kept[0].bucket == 1
    with pytest.raises(ValueError):
        importance_draw.drawn(some.withColumnRenamed("n", "rank"), docs, columns=("doc_id", "rank"))


@pytest.mark.parametrize("limit", [1, 7, 64, 1 << 20])
def test_windows_run_over_cuts(limit):
    some = [t.lower().encode() for t in texts(4, 12) if t] + [b"", b"one", "日本 x-y".encode()]
    got = Counter()
    for text, k, crc in importance_draw.windows(importance_draw.splitter(), some, 3, limit):
        got.update(zip(text.tolist(), k.tolist(), crc.tolist(), strict=True))
    plain = Counter()
    for i, t in enumerate(some):
        w = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)
        plain.update((i, k, zlib.crc32(b" ".join(w[j : j + k]))) for k in (1, 2, 3) for j in range(len(w) - k + 1))
    assert got == plain


def test_joined_crc_of_long_strings():
    rng = random.Random(5)
    pairs = [(rng.randbytes(rng.randint(0, 9)), rng.randbytes(rng.choice([0, 1, 3, 300, 70_000]))) for _ in range(50)]
    a, b = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    got = importance_draw.joined_crc(a, b, np.array([len(p[1]) for p in pairs]))
    assert got.tolist() == [zlib.crc32(p + q) for p, q in pairs]


# ---- packing ----


def best_fit_by_search(sizes, capacity):
    rooms, out = [], []
    for n in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms[rooms.index(min(fit))] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("capacity", [7, 64, 100])
def test_best_fit_takes_the_tightest_window(capacity):
    rng = random.Random(capacity)
    for n in (0, 1, 5, 200):
        sizes = [rng.randint(1, capacity) for _ in range(n)]
        windows = window_packing.best_fit([(i, 0, s) for i, s in enumerate(sizes)], capacity)
        assert sorted(capacity - window_packing.filled(w) for w in windows) == best_fit_by_search(sizes, capacity)


@pytest.mark.parametrize("sizes", [[55] * 90, [1] * 30, [100] * 3, [99, 98, 3], [], [60, 60, 60], list(range(1, 100))])
def test_loose_windows_fill_the_gaps(sizes):
    windows = window_packing.best_fit([(i, 0, s) for i, s in enumerate(sizes)], 100)
    done, loose = window_packing.tightened(windows, 100, 2)
    assert all(98 <= window_packing.filled(w) <= 100 for w in done) and window_packing.filled(loose) < 98
    assert len(done) <= -(-sum(sizes) // 98)
    tail = window_packing.power_cuts(loose)
    assert all(n & (n - 1) == 0 for n in map(window_packing.filled, tail))
    covered = defaultdict(list)
    for doc, first, n in [p for w in [*done, *tail] for p in w]:
        assert n > 0
        covered[doc] += range(first, first + n)
    assert {d: sorted(c) for d, c in covered.items()} == {i: list(range(s)) for i, s in enumerate(sizes)}


def pack_rows():
    rng = random.Random(6)
    rows = list(enumerate(texts(7, 40, 200) + ODD))
    rows += [(100, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(9000))), (101, "copy of this " * 400), (None, "no id"), (None, None)]
    return rows + [(200 + i, "one long text again " * 300) for i in range(30)] + [(5, "again"), (5, "again")]


@pytest.mark.parametrize("block", [1 << 13, 4])
def test_pieces_hold_every_id_once(spark, block):
    from tokenizers import Tokenizer

    path, rows = tokenizer_path("word_bpe_49k.json"), pack_rows()
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id bigint, text string, start int, ids int, length int").coalesce(2)
    got = window_packing.packed(docs, path, block=block).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append(r)
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:i]) for i in range(len(s))] and sum(r.length for r in s) <= 2048
        assert all(len(r.ids) == 4 * r.length for r in s)
    tokenizer = Tokenizer.from_file(path)
    whole = Counter((i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in rows)
    rebuilt = Counter()
    for (name, total), pieces in by_doc.items():
        times = sum(r.length for r in pieces) // total
        starts = defaultdict(list)
        for r in pieces:
            starts[r.start].append(r)
        for _ in range(times):  # pieces of rows that repeat an id and a length are told apart by their starts
            at, out = 0, b""
            while at < total:
                r = starts[at].pop()
                out += r.ids
                at += r.length
            rebuilt[(name, out)] += 1
        assert not any(starts.values())
    assert rebuilt == whole
    padded = sum(2048 - n for n in (sum(r.length for r in s) for s in by_sequence.values()) if n & (n - 1))
    assert padded <= 16 * len(by_sequence)


def test_padded_sequences(spark):
    path = tokenizer_path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, t) for i, t in pack_rows()], "doc_id bigint, text string").coalesce(1)
    pieces = window_packing.packed(docs, path)
    for r in window_packing.sequences(pieces, pad_id=9).collect():
        n = sum(r.lengths)
        assert len(r.ids) == 4 * (n + r.n_padded) and r.n_padded == (0 if n & (n - 1) == 0 else 2048 - n)
        assert np.frombuffer(r.ids, "<u4")[n:].tolist() == [9] * r.n_padded and len(r.doc_ids) == len(r.lengths)
    assert window_packing.packed(docs.limit(0), path).collect() == []


# ---- audit ----


def plain_audit(rows, least, most=50):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    df, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, t, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        df[lang].update(set(terms(t)))
        count[lang, source].update(terms(t))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 1_000_000_000 * (count[lang, s][t] + 5) // (total[s] + 5 * len(kept)) for t in kept} for s in sources}
        every = sum(total.values())
        q = {t: 1 + 1_000_000_000 * (sum(count[lang, s][t] for s in sources) + 5) // (every + 5 * len(kept)) for t in kept}
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pair, None), ("term", term, most)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:limit])]
    return sorted(out)


AUDIT_SCHEMA = "doc_id bigint, text string, lang string, source string, part int, term int, n int, prefix int"


def audit_rows():
    rng = random.Random(8)
    long_word = "überlang" * 9
    rows = []
    for i, t in enumerate(texts(9, 120, 40) + ODD * 3):
        lang = rng.choice(["de", "en", "en", None])
        rows.append((i, t if t is None else f"{t} {long_word if i % 2 else long_word + 'x'} {'Ab' * (i % 7)}", lang, rng.choice(["s1", "s1", "s1", "s2", "ß", None])))
    return rows + [(1, "lone words", "fr", "s1"), (2, None, "fr", "s9"), (3, "x", "it", None), (None, "aa bb", "en", "s2"), (None, "aa bb", "en", "s2")]


@pytest.mark.parametrize(("settings", "least"), [({}, 5), ({"block": 40, "bits": 64}, 5), ({"first_level": 1}, 30), ({"block": 400}, 10_000)])
def test_audit(spark, settings, least):
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], AUDIT_SCHEMA)
    got = source_audit.report(docs, least, **settings).collect()
    assert sorted(map(tuple, got)) == plain_audit(rows, least)


@pytest.mark.parametrize("cells", [1, 7])
def test_differences_in_small_blocks(spark, cells):
    rows = audit_rows()
    found = source_audit.audit(spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], AUDIT_SCHEMA), 5)
    got = source_audit.differences(found, cells).collect()
    assert sorted((r.lang, r.source, r.item, r.value) for r in got) == sorted((a, b, d, e) for a, b, c, d, e, _ in plain_audit(rows, 5) if c == "pair")


def test_audit_of_nothing(spark):
    assert source_audit.report(spark.createDataFrame([], AUDIT_SCHEMA)).collect() == []


def test_shares_are_exact_however_large(spark):
    df = spark.sql("SELECT 999999999999999L AS n, 1000000000000007L AS total, 3L AS v")
    got = df.select(source_audit.share(*(df[c] for c in ("n", "total", "v")))).first()[0]
    assert got == 1 + 1_000_000_000 * (999999999999999 + 5) // (1000000000000007 + 15)


def test_blocks_are_held_one_or_two_at_a_time(spark, tmp_path, monkeypatch):
    """A block is megabytes in one row, and a task may have a hundred."""
    import glob

    import pyarrow.parquet as pq

    paths, sizes = [], []
    scratch, small = common.scratch, source_audit.small_batches
    monkeypatch.setattr(common, "scratch", lambda s: paths.append(scratch(s)) or paths[-1])
    monkeypatch.setattr(source_audit, "small_batches", lambda s, rows=2000: sizes.append(rows) or small(s, rows))
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in audit_rows()], AUDIT_SCHEMA)
    source_audit.audit(docs.coalesce(1), 5, block=100)
    found = [pq.ParquetFile(f).metadata for f in glob.glob(f"{paths[0].removeprefix('file:')}/*.parquet")]
    groups = [m.row_group(i).num_rows for m in found for i in range(m.num_row_groups)]
    assert sum(groups) > 10 and max(groups) <= 2
    assert sizes.count(1) >= 2
