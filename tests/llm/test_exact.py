"""Operators with an exact answer, against brute force on small tables with nulls, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from deckjobs.llm import bwt_dedup, chat_windows, decontam_edit, fingerprint_cws, graph, simhash_cover, spm_codec, token_store
from deckjobs.llm.queries import OP7_SQL, tokenizer_path

SCHEMA = "doc_id bigint, text string, score double, label int, id bigint, tag bigint, chunk bigint, n int"


def table(spark, rows):
    """(doc_id, text) rows with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, 0.0, 7, 1, 2, 3, 4) for i, t in rows], SCHEMA)


def words(rng, n, letters="abc", size=6):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, size))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(5)
    base = words(rng, 120)
    rows = [(i, words(rng, rng.randint(0, 60), "ab", 3)) for i in range(0, 40)]
    rows += [(100, base), (101, base), (102, base[:300] + "Ünter " + base[300:]), (103, "x" * 700), (104, "y" + "x" * 200), (105, "ab" * 300), (106, None), (107, ""), (108, " \t\n"), (109, "é😀 日本"), (110, words(rng, 30_000, "abcdefgh", 9))]
    rows += [(200, rows[5][1] + base[100:400]), (200, rows[5][1] + base[100:400]), (7, base[50:200]), (None, base), (None, None)]
    return rows


def brute_removed(rows, length=50):
    last = 2**63 - 1
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            first[w] = min(first.get(w, last), last if i is None else i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if first[b[j : j + length]] < (last if i is None else i):
                gone[j : j + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[(i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_bwt_dedup(spark, odd_rows, crowd):
    got = bwt_dedup.deduplicate(table(spark, odd_rows), crowd=crowd, with_text=True).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_removed(odd_rows)


def test_bwt_dedup_of_nothing(spark):
    assert bwt_dedup.deduplicate(table(spark, [])).collect() == []
    assert bwt_dedup.deduplicate(table(spark, [(1, None), (2, "short")])).count() == 2


def test_first_ids_holds_little_beside_its_segments():
    import tracemalloc

    passage = bytes(range(33, 93))
    docs = [b"%034d" % (7919 * i) + passage + b"%034d" % (104729 * i) for i in range(6000)]
    flat = sorted((int(k), docs[d][s : s + c + 49], d) for d, s, c, k in ((d, s, c, k) for x in bwt_dedup.key_runs(docs) for d, s, c, k in zip(*(y.tolist() for y in x), strict=True)))
    segments, keys, ids = [s for _, s, _ in flat], np.array([k for k, _, _ in flat], np.uint64), np.array([i for _, _, i in flat], np.int64)
    tracemalloc.start()
    first = bwt_dedup.first_ids(segments, keys, ids)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    seen: dict[bytes, int] = {}
    for i, d in enumerate(docs):
        for a in range(len(d) - 49):
            seen.setdefault(d[a : a + 50], i)
    assert all(f.tolist() == [seen[s[a : a + 50]] for a in range(len(s) - 49)] for f, s in zip(first, segments, strict=True))
    assert most < 24 * sum(map(len, segments))


def test_first_ids_of_periodic_and_small_alphabets():
    rng = random.Random(1)
    for trial in range(30):
        texts = [b"".join(rng.choice([b"a", b"b"]) * rng.randint(1, 30) for _ in range(rng.randint(1, 12))) for _ in range(12)]
        texts = [t for t in texts if len(t) >= 50]
        groups = defaultdict(list)
        for i, t in enumerate(texts):
            for _, start, count, key in bwt_dedup.key_runs([t]):
                for s, c, k in zip(start, count, key):
                    groups[int(k)].append((i, t[s : s + c + 49]))
        flat = [(k, i, s) for k, v in groups.items() for i, s in v]
        got = bwt_dedup.first_ids([s for _, _, s in flat], np.array([k for k, _, _ in flat], np.uint64), np.array([i for _, i, _ in flat], np.int64))
        for (k, i, s), first in zip(flat, got):
            for o in range(len(s) - 49):
                assert first[o] == min(j for k2, j, s2 in flat if s[o : o + 50] in s2)


def test_kept_text_is_whole_characters():
    text = "añb😀c".encode()
    for a in range(len(text)):
        for b in range(a, len(text) + 1):
            bwt_dedup.whole_characters(text, [(a, b)]).decode()


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("dense", [1024, 1, 5])
def test_links_connect_what_all_pairs_would(spark, dense):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for centre in [rng.getrandbits(64) for _ in range(3)] + [0]:
        for _ in range(40):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    got = {r.node: r.root for r in graph.components(simhash_cover.links(df, dense)).collect()}
    want = brute_components(fps)
    groups = defaultdict(set)
    for s, r in zip(signed, want):
        groups[r].add(s)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(k for k, v in got.items() if v == r) for r in set(got.values())}


def test_near_duplicates_rows(spark, odd_rows):
    got = simhash_cover.near_duplicates(table(spark, odd_rows)).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    assert by[100].component_id == by[101].component_id == 100 and by[107].fingerprint == by[106].fingerprint == "0" * 16 == by[108].fingerprint
    assert by[106].component_id == by[107].component_id == by[108].component_id
    assert simhash_cover.near_duplicates(table(spark, [])).count() == 0


def test_fingerprints_by_hand():
    import xxhash

    text = "A bc\tBC  a\x1fz q"
    w = text.lower().split(" ")
    w = [x for y in w for x in y.split("\t") if x]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)]
    assert simhash_cover.fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_weighted_sampling(spark, odd_rows):
    rows = list({r[0]: r for r in odd_rows if r[0] is not None and r[0] != 200}.values())
    got = {r.doc_id: r for r in fingerprint_cws.with_edits(table(spark, rows), samples=64).collect()}
    order = sorted(i for i, _ in rows)
    text = {i: t or "" for i, t in rows}
    errors = []
    for k, i in enumerate(order):
        following = text[order[(k + 1) % len(order)]]
        q = len(text[i]) // 4
        edited = text[i][: len(text[i]) - q] + following[:q]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text[i])
        a, b = Counter(text[i].replace("\n", " ").split(" ")), Counter(edited.replace("\n", " ").split(" "))
        errors.append(got[i].near_edited - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 0.05 and np.abs(errors).max() < 0.35
    assert got[100].fingerprint == got[101].fingerprint and got[100].near_next == 1.0
    assert fingerprint_cws.with_edits(table(spark, [])).count() == 0
    only = fingerprint_cws.with_edits(table(spark, [(5, "one two three four")])).first()
    assert only.near_next == 1.0
    assert fingerprint_cws.with_edits(table(spark, odd_rows)).count() == len(odd_rows)


def conversations():
    rng = random.Random(2)
    rows = [(-7, i, r, r"\### Assistant: </turn> ok") for i, r in enumerate(("user", "assistant"))]
    for c in range(30):
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * rng.randint(1, 15)
        rows += [(c, i, r, rng.choice([None, "", "<turn:user>\n", "\\l\\b", words(rng, rng.randint(1, 400))])) for i, r in enumerate(roles)]
    rows += [(50, 0, None, "x"), (50, None, "assistant", "early"), (51, 0, "system", words(rng, 900)), (51, 1, "assistant", "a"), (51, 1, "assistant", "a"), (None, 0, "assistant", "n")]
    return rows


def test_chat_windows(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, window int")
    w = chat_windows.windows(df, budget=300, history_budget=100).cache()
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want[c].append((r or "", x or ""))
    for r in chat_windows.digests(w).collect():
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for r in w.where("not over_budget").collect():
        assert r.tokens <= 300
    assert w.where("over_budget and n_new > 1").join(df.where("role = 'system'"), "conv_id", "left_anti").count() == 0
    assert chat_windows.windows(df.limit(0)).count() == 0 and "formatted_chars" in OP7_SQL


def test_token_store(spark, odd_rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = [r for r in odd_rows if r[0] is not None]
    got = token_store.digests(token_store.stored(table(spark, rows), path)).collect()
    start, want = 0, Counter()
    for i, t in sorted(rows, key=lambda r: (r[0], np.array(lib.encode(r[1] or "", add_special_tokens=False).ids, "<u2").tobytes())):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want[(i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        start += len(ids)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    assert token_store.stored(table(spark, []), path).count() == 0


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        assert (token_store.unpack(*token_store.pack(values), n) == values).all()


def test_word_parts_are_coded_like_the_whole():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    lib, coder = Tokenizer.from_file(path), token_store.word_coder(path)
    rng = random.Random(4)
    bits = ["a", "B", "'s", "'", "t", "re", "12", ".", ",", "!", " ", "\n", "é", "́", "ß", "日", "<", "|", "<|endoftext|>", "=", "̸", "İ", "Σ", "\x1c"]
    for _ in range(2000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        parts, _ = token_store.parts_of([t.encode()])
        assert coder.ids(parts)[0].tolist() == lib.encode(t, add_special_tokens=False).ids


def test_sentencepiece(spark, odd_rows):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    texts = [t or "" for _, t in odd_rows] + ["".join(rng.choice("ab \n▁é日😀.,<>0x") for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["a" * 3000, "\x00"]
    ids, spans = spm_codec.encode_batch([t.encode() for t in texts], path)
    assert [x.tolist() for x in ids] == lib.encode(texts)
    for t, x, s in zip(texts[:300], ids, spans):
        raw = t.encode()
        assert len(x) == len(s) and (s[1:, 0] == s[:-1, 1]).all() and (not len(s) or (s[0, 0] == 0 and s[-1, 1] == len(raw)))
    got = spm_codec.round_trip(table(spark, odd_rows), path).collect()
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got) == Counter((i, len(lib.encode(t or "")), hashlib.sha256(lib.decode(lib.encode(t or "")).encode()).hexdigest()) for i, t in odd_rows)
    for r in got:
        assert r.n_covered == len(({i: t for i, t in odd_rows}[r.doc_id] or "").encode()) or r.doc_id in (None, 200, 7)
    digest = {r.doc_id: r.spans_sha256 for r in got}
    ids, (own,) = spm_codec.encode_batch([odd_rows[41][1].encode()], path)
    assert digest[odd_rows[41][0]] == hashlib.sha256(own.astype("<i8").tobytes()).hexdigest()
    assert spm_codec.encode(table(spark, odd_rows), path).count() == len(odd_rows)


def compiled(rules: dict[bytes, bytes]) -> bytes:
    """A character map with the given rules, built naively."""
    units, texts = [0], b""
    trie: dict = {}
    for k, v in rules.items():
        node = trie
        for c in k:
            node = node.setdefault(c, {})
        node[None] = v
    todo = [(0, trie)]
    free = 256
    while todo:
        at, node = todo.pop()
        base, free = free, free + 256
        units += [0x100] * (base + 256 - len(units))
        units[at] |= (at ^ base) << 10
        for c, child in node.items():
            if c is None:
                continue
            units[base ^ c] = c
            todo.append((base ^ c, child))
        if None in node:
            units[at] |= 256
            units[base] = len(texts) | 1 << 31
            texts += node[None] + b"\0"
    return len(units).__mul__(4).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + texts


def normalised_by_characters(model, rules, text):
    """Longest rule or one character at a time, with its place; then spaces, one by one."""
    units, i = [], 0
    while i < len(text):
        size = max((n for n in range(1, 5) if i + n <= len(text) and text[i : i + n] in rules), default=0)
        if size:
            new = rules[text[i : i + size]]
            units += [(c, i + k if len(new) == size else i) for k, c in enumerate(new)]
        else:
            size = 1
            units.append((text[i], i))
        i += size
    if model.squeeze:
        units = [u for k, u in enumerate(units) if u[0] != 32 or (k and units[k - 1][0] != 32)]
        while units and units[-1][0] == 32:
            units.pop()
    out = [(c, at) for c, at in units[:1] if units for c in spm_codec.MARK] if model.prefix else []
    for u, at in units:
        out += [(c, at) for c in spm_codec.MARK] if u == 32 else [(u, at)]
    return bytes(c for c, _ in out), [at for _, at in out] + [len(text)]


@pytest.mark.parametrize("rules", [{}, {b"a": b"x", b"ab": b"yy", "é".encode(): b"e", b"zz": b"", b"q": b" "}])
def test_longest_prefix_normalisation_keeps_offsets(rules):
    """One path for every model: with and without a character map, with and without squeezing."""
    model = spm_codec.Model(tokenizer_path("piece_bpe_32k.model"))
    model.map = spm_codec.CharacterMap(compiled(rules) if rules else b"")
    rng = random.Random(12)
    texts = ["abaé b", "  b   b ", "", " ", "zz", "q"] + ["".join(rng.choice("abzq é日 ") for _ in range(rng.randint(0, 25))) for _ in range(400)]
    for model.prefix in (True, False):
        for model.squeeze in (False, True):
            for t in texts:
                out, source = model.normalized(t.encode())
                assert (bytes(out), source.tolist()) == normalised_by_characters(model, rules, t.encode())


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, words(rng, rng.randint(8, 30), "abcdefghij", 8)) for i in range(12)]
    rows = []
    for n in range(60):
        item = rng.choice(items)[1]
        x = list(item.upper() if n % 3 == 0 else item)
        for _ in range(rng.randint(0, 9)):
            p = rng.randrange(len(x))
            x[p : p + 1] = rng.choice([[], ["q"], [x[p], "z"]])
        rows.append((n, words(rng, rng.randint(0, 60)) + " " + "".join(x) + "\n" + words(rng, rng.randint(0, 60))))
    rows += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1]), (103, items[3][1].replace(" ", " \n "))]
    bench = spark.createDataFrame([*items, (99, None), (98, "  "), (97, items[0][1])], "item_id bigint, text string")
    want = {i: [] for i, _ in rows}
    for i, t in rows:
        c = decontam_edit.clean(t)
        want[i] = [j for j, x in items if edit_distance_inside(decontam_edit.clean(x), c) <= decontam_edit.budget_of(x, decontam_edit.ERROR_RATE)]
    for block in (4_000_000, 300):
        got = decontam_edit.marked(table(spark, rows), bench, block_chars=block).collect()
        assert len(got) == len(rows) and all(r["items"] == want[r.doc_id] for r in got)
    pairs = decontam_edit.contaminated(table(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in pairs} == {(i, j) for i, js in want.items() for j in js}
    assert decontam_edit.marked(table(spark, []), bench).count() == 0 and decontam_edit.marked(table(spark, rows), bench.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("block", [4_000_000, 30])
def test_short_items_shared_ids_and_items_without_one(spark, block):
    """No item is left out for its length or its id."""
    items = [(1, "abc"), (2, "Two Words"), (3, "nineteen characters"), (4, "one text of an item id that has two"), (4, "and the other text under that id"), (None, "an item without any id at all"), (None, "seen"), (5, "abc"), (6, " \u2003"), (7, "zebra")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(1, "x ABC y"), (2, "two  words, and abc"), (3, "... nineteen\ncharacters"), (4, "say: one text of an item id that has two"), (4, "and the other text under that id"), (None, "an item without any id at all, seen with abc"), (8, "nothing here"), (9, None)]
    want = Counter()
    for i, t in rows:
        c = decontam_edit.clean(t)
        held = {j for j, x in items if decontam_edit.clean(x) and edit_distance_inside(decontam_edit.clean(x), c) <= decontam_edit.budget_of(decontam_edit.clean(x), decontam_edit.ERROR_RATE)} - {5}
        want[(i, tuple(sorted(held, key=lambda j: (j is None, j or 0))))] += 1
    got = decontam_edit.marked(table(spark, rows), bench, block_chars=block).collect()
    assert Counter((r.doc_id, tuple(r["items"])) for r in got) == want and want[(None, (1, None))] == 1
    assert [r.n_items for r in got if r.doc_id == 4] == [1, 1] and all(r.contaminated == bool(r["items"]) for r in got)
    pairs = decontam_edit.contaminated(table(spark, rows), bench, block_chars=block)
    assert pairs.where("doc_id is null and item_id is null").count() == 2


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (2001, 2000), (2000, 2001)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300)) and got[2001] == 2000
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    assert F is not None
