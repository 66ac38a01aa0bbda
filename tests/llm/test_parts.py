"""Kernels against plain computations, and the paths that small tables don't reach."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandex.llm import chat, common, decontaminate, fingerprint, language, near_dup, packing, quality, substring_dup, url_filter, warc
from strandex.llm.graph import components
from tests.llm.conftest import thue_morse

texts = st.lists(st.one_of(st.none(), st.text(alphabet="abAB \n.é\u4e2d0", max_size=60)), min_size=1, max_size=8)


@settings(max_examples=60, deadline=None)
@given(texts, st.integers(4, 40))
def test_words(rows, window):
    import re

    old, common.WINDOW = common.WINDOW, window
    try:
        w = common.Words(*common.text_bytes(pa.array(rows, pa.string())), common.ALNUM)
    finally:
        common.WINDOW = old
    want = [re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").replace("A", "a").replace("B", "b")) for t in rows]
    assert w.count.tolist() == [len(x) for x in want]
    by = {}
    for h, x in zip(w.hash.tolist(), (y for own in want for y in own), strict=True):
        assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)


def test_hashes_of_regular_texts():
    for n in (64, 1024, 4096, 65536):
        for parts, table in ((("a", "b"), common.ALNUM), (("abcdefgh", "ijklmnop"), common.SPACED), (("a ", "b "), common.SPACED)):
            x, y = (common.Words(*common.text_bytes(pa.array([t])), table).hash for t in thue_morse(n, *parts))
            assert common.gram_hashes(x, len(x))[0] != common.gram_hashes(y, len(y))[0]
    h = np.random.default_rng(0).integers(0, 2**63, 90).astype(np.uint64)
    for k in range(1, 50):
        g = common.gram_hashes(h, k)
        assert len(g) == 91 - k and all(g[i] == common.gram_hashes(h[i : i + k], k)[0] for i in (0, 7, 90 - k))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=60), st.integers(1, 9), st.integers(1, 4))
def test_winnowed(keys, w, rows):
    doc = np.sort(np.arange(len(keys)) % rows)
    got = common.winnowed(np.array(keys, np.uint32), doc, w)
    want = set()
    for r in range(rows):
        own = np.flatnonzero(doc == r).tolist()
        for k in range(max(1, len(own) - w + 1) if own else 0):
            part = own[k : k + w]
            least = min(keys[i] for i in part)
            want.add(max(i for i in part if keys[i] == least))
    assert got.tolist() == sorted(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 3))
def test_mod_sampled(words, rows):
    t, k, w = 3, 7, 4
    doc = np.sort(np.arange(len(words)) % rows)
    h = np.array(words, np.uint64)
    g = common.gram_hashes(h, t) >> np.uint64(32) if len(h) >= t else h[:0]
    got, want = common.mod_sampled(g.astype(np.uint32), doc, t, k, w), set()
    for i in range(len(words) - k - w + 2):
        if doc[i] == doc[i + k + w - 2]:
            least = min(g[i : i + k + w - t])
            want.add(i + max(j for j in range(k + w - t) if g[i + j] == least) % w)
    assert got.tolist() == sorted(want)


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 256, fingerprint.K + fingerprint.W - 1).astype(np.uint8)
    for _ in range(50):
        parts = [np.concatenate((rng.integers(0, 256, rng.integers(0, 99)), shared, rng.integers(0, 256, rng.integers(0, 99)))).astype(np.uint8) for _ in range(2)]
        a, b = (set(fingerprint.selected(p, np.array([0, len(p)]))[2].tolist()) for p in parts)
        assert a & b


def test_long_text_fingerprint(monkeypatch):
    text = "".join(random.Random(1).choice("abcdef ") for _ in range(5000))
    data = pa.array(["x", text, "", "yy"], pa.string())
    whole = fingerprint.selected(*common.text_bytes(data))
    monkeypatch.setattr(common, "WINDOW", 300)
    cut = fingerprint.selected(*common.text_bytes(data))
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_next_over_many_ranges(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randrange(60)))) for i in rng.sample(range(10**6), 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    one, many = (sorted(map(tuple, fingerprint.edited_by_next(docs, range_rows=n).collect())) for n in (10**6, 7))
    assert one == many and len(one) == 300


def test_super_min_hash():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(40):
        h = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = h[:240], h[60:]
        sig = near_dup.super_min_hash(np.concatenate((a, b, a[:1], a[:2])), np.array([240, 240, 1, 2]))
        assert (sig != np.uint64(2**64 - 1)).all()
        errors.append((sig[0] == sig[1]).mean() - 180 / 300)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06
    # a component of a single element holds each rank once
    assert sorted((sig[2] >> np.uint64(32)).tolist()) == list(range(near_dup.SLOTS))


def test_blocks_find_all_links(spark):
    """Groups over several blocks give the components of one block."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.sample(range(60), rng.randrange(4)):
            w[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (sorted(map(tuple, near_dup.near_duplicates(docs, block=(n, n)).collect())) for n in (10**6, 400))
    sets = [{tuple(t.split()[k : k + 4]) for k in range(57)} for _, t in rows]
    part = list(range(120))
    for i in range(120):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                lo, hi = sorted((part[i], part[j]))
                part = [lo if p == hi else p for p in part]
    assert [r[2] for r in one] == part and one == many and 1 < len(set(part)) < 120


@settings(max_examples=150, deadline=None)
@given(st.randoms(use_true_random=False), st.integers(0, 1), st.sampled_from([(80, 100), (1, 2), (95, 100)]))
def test_join_parts(rng, led, share):
    """The parts that links make, against all pairs: with a leader only its group's rest is compared."""
    num, den = share
    base = rng.sample(range(1000), 12)
    sets = [np.array(sorted({*rng.sample(base, rng.randrange(1, 13)), *rng.sample(range(40), rng.randrange(4))}), np.uint64) for _ in range(rng.randrange(2, 14))]
    n = len(sets)
    focus = np.array([rng.random() < 0.5 for _ in range(n)])
    linked = {(i, j) for i in range(n) for j in range(n) if i != j and den * len({*sets[i].tolist()} & {*sets[j].tolist()}) >= num * len({*sets[i].tolist()} | {*sets[j].tolist()})}
    if led:
        focus = np.array([(0, i) not in linked and i > 0 for i in range(n)])
    edges = {(i, j) for i, j in linked if focus[i] or focus[j] or (led and 0 in (i, j))}
    got = near_dup.join_parts(sets, np.arange(n), focus, 0 if led else None, num, den)
    assert {*got} <= linked

    def parts(edges):
        part = list(range(n))
        for i, j in edges:
            part = [min(part[i], part[j]) if p in (part[i], part[j]) else p for p in part]
        return part

    assert parts(got) == parts(edges)


def test_group_of_unlinked(spark, monkeypatch):
    """A group whose documents are all 0.71 alike: no task gets more than a block, and none of it is compared again."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**9)}"
    base = [word() for _ in range(300)]
    docs = spark.createDataFrame([(f"d{i}", " ".join(base + [word() for _ in range(50)])) for i in range(200)], "doc_id string, text string")
    seen, verified = [], near_dup._verified

    def spy(rows, *rest):
        own = rows.groupBy("leader", "block").agg(F.sum(F.length("shingles") / 8).alias("n")).agg(F.count("*"), F.max("n")).first()
        seen.append(tuple(own))
        return verified(rows, *rest)

    monkeypatch.setattr(near_dup, "_verified", spy)
    found = near_dup.near_duplicates(docs, block=(6000, 6000)).collect()
    assert {r["component"] for r in found} == {f"d{i}" for i in range(200)}
    assert len(seen) == 2 and seen[0][0] > 10 and seen[0][1] < 2 * 6000 and seen[1] == (0, None)


def test_group_counts(spark):
    """Shingles that few of a group's rows have are no rows; what many have is counted whole."""
    rows = [("g", 200, np.array([*range(50), *range(1000 * i, 1000 * i + 50)], np.int64).tobytes()) for i in range(1, 201)]
    found = near_dup._group_counts(spark.createDataFrame(rows, "leader string, docs long, shingles binary").coalesce(2)).collect()
    assert sorted((r["shingle"], r["n"], r["docs"]) for r in found) == [(s, 200, 200) for s in range(50)]


def test_meetings(spark):
    """The other blocks where partners are, against all pairs; a row meets a block once, whatever they share."""
    rng = random.Random(5)
    rows = [("g", rng.randrange(12), i, i % 3 > 0, s % 2 > 0, s) for i in range(150) for s in [*rng.sample(range(40), 12), 99]]
    block = {i: b for _, b, i, _, _, _ in rows}
    rows = [("g", block[i], i, rest, shown, s) for _, _, i, rest, shown, s in rows]
    found = near_dup._meetings(spark.createDataFrame(rows, "leader string, block long, id long, rest boolean, shown boolean, shingle long"))
    want = {(x[2], y[1]) for x in rows for y in rows if x[3] and x[5] == y[5] and (x[4] or y[4]) and x[1] != y[1]}
    assert sorted((r["id"], r["to"]) for r in found.collect()) == sorted(want)
    made, left = [], [found._jdf.queryExecution().executedPlan()]
    while left:
        plan = left.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            plan = plan.executedPlan()
        if plan.nodeName().endswith("QueryStage"):
            plan = plan.plan()
        if plan.nodeName() == "Generate":
            made.append(plan.metrics().apply("numOutputRows").value())
        left += [plan.children().apply(i) for i in range(plan.children().size())]
    assert made == [len(want)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(40)]
    part = {i: i for e in edges for i in e}
    for a, b in edges:
        lo, hi = sorted((part[a], part[b]))
        part = {i: lo if p == hi else p for i, p in part.items()}
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: p for i, p in part.items() if any(a != b and i in (a, b) for a, b in edges)}


def test_contamination_in_blocks(spark, hard):
    docs, bench = (spark.read.parquet(f"{hard}/{x}.parquet") for x in ("documents", "benchmark"))
    one, many = (sorted(map(repr, decontaminate.contamination(docs, bench, block_bytes=n).collect())) for n in (10**6, 20))
    assert one == many


def test_url_rules_in_blocks(spark):
    rng = random.Random(1)
    label = lambda: rng.choice("abc")
    rules = [(".".join(label() for _ in range(rng.randrange(1, 4))), "/" + "/".join(rng.choice(["x", "y", "xy", ""]) for _ in range(rng.randrange(3))), rng.choice(["allow", "block"])) for _ in range(60)]
    urls = [(i, f"http://{'.'.join(label() for _ in range(rng.randrange(1, 5)))}/{'/'.join(rng.choice(['x', 'y', 'xyz', '']) for _ in range(rng.randrange(4)))}") for i in range(300)]
    want = {}
    for i, u in urls:
        host, path = url_filter.split_url(u)
        fits = [(h.count("."), len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[i] = max(fits)[3:] if fits else (None, "allow")
    pages, table = spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")
    for size in (10**6, 9):
        assert {r["id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, table, block_rules=size).collect()} == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:\nb###"]), st.lists(st.sampled_from(["\\", "###", "</turn>", "\n", "#", "x", " ", "</turn", "é"]), max_size=8).map("".join)), max_size=5))
def test_chat_round_trip(turns):
    text = "".join(chat.header(r) + chat.escape(t) + chat.END for r, t in turns)
    assert chat.parse(text) == turns
    assert all(chat.unescape(chat.escape(t)) == t for _, t in turns)


def test_chat_windows(spark):
    turns = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * 30) for i in range(1, 30)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    found = [r.asDict() for r in chat.chat_windows(df, budget=200, history=60).collect()]
    assert len(found) > 5 and [w["window"] for w in found] == list(range(len(found)))
    assert [w["first_turn"] for w in found] == np.cumsum([0] + [w["new_turns"] for w in found])[:-1].tolist()
    for w in found:
        own = chat.parse(w["text"])
        assert own[0] == ("system", "be kind") and w["tokens"] <= 200 and not w["over_budget"]
        assert len(own) == w["context_turns"] + w["new_turns"]
        if w["window"]:
            n, before = w["context_turns"] - 1, w["first_turn"]
            assert n > 0 and [t for _, t in own[1 : n + 1]] == [t[3] for t in turns[before - n : before]]
    assert sum(len(w["loss_start"]) for w in found) == sum(t[2] == "assistant" for t in turns)


def test_plan_fills_exactly():
    rng = np.random.default_rng(3)
    for kind in range(4):
        counts = np.zeros(packing.CONTEXT, np.int64)
        if kind == 0:
            counts[700] = 5000
        elif kind == 1:
            counts[1:] = rng.integers(0, 40, packing.CONTEXT - 1)
        elif kind == 2:
            counts[3] = 100_000
        p = packing.make_plan(counts, 7)
        total = int((counts * np.arange(packing.CONTEXT)).sum()) + 7 * packing.CONTEXT
        room = sum(n * size for _, n, size, _ in p.runs)
        assert 0 <= room - total < packing.CONTEXT
        for r, own in p.segments.items():
            assert sum(k * n for _, k, n, _, _ in own) == p.cut_from[r]


def test_forward_backward():
    rng = np.random.default_rng(1)
    row = np.array([0, 0, 0, 1, 2, 2])
    s, t = rng.normal(size=6), rng.normal(size=(2, 2))
    a, b, pair = quality.forward_backward(s, row, t)
    got = quality.sigmoid(a + b)
    at = 0
    for r in range(3):
        n = int((row == r).sum())
        weight = {}
        for bits in range(2**n):
            y = [bits >> i & 1 for i in range(n)]
            weight[tuple(y)] = np.exp(sum(s[at + i] * y[i] for i in range(n)) + sum(t[y[i - 1], y[i]] for i in range(1, n)))
        total = sum(weight.values())
        for i in range(n):
            assert got[at + i] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / total)
        at += n
    assert np.allclose(pair.sum(1), 1) and len(pair) == 3


def test_quality_without_labels(spark, hard):
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, none, F.lit(True)) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    rows, labels = [], np.arange(200) % 2
    for y in labels:
        at = np.unique(np.append(rng.integers(100, 5000, 20), y))
        rows.append((at, np.full(len(at), 1 / np.sqrt(len(at)))))
    w, bias = language.ftrl(rows, labels, 2)
    right = [np.argmax(v @ w[i] + bias) == y for (i, v), y in zip(rows, labels, strict=True)]
    assert np.mean(right) == 1 and (w == 0).mean() > 0.5
    assert language.temperature(np.array([[3.0, 0.0]] * 10), np.array([0] * 6 + [1] * 4)) > 1


def test_chains_are_best():
    rng = random.Random(4)

    def brute(runs):
        best = {}
        for r in sorted(range(len(runs)), key=lambda r: runs[r][:2]):
            i, j, n = runs[r]
            before = [best[q] - substring_dup.GAP_COST * (i - x - m + j - y - m) for q, (x, y, m) in enumerate(runs) if q in best and x + m <= i and y + m <= j]
            best[r] = n + max([0, *before])
        return max(best.values())

    for _ in range(200):
        runs = [(rng.randrange(60), rng.randrange(60), rng.randrange(1, 9)) for _ in range(rng.randrange(1, 12))]
        out = substring_dup.chains(runs)
        assert sorted(r for c in out for r in c) == sorted(runs)
        first = out[0]
        value = sum(r[2] for r in first) - substring_dup.GAP_COST * sum(b[0] - a[0] - a[2] + b[1] - a[1] - a[2] for a, b in zip(first, first[1:], strict=False))
        assert value == pytest.approx(brute(runs))


def test_fuzzy_passage(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(80)]
    edited = list(passage)
    for k in (13, 41, 60):
        edited[k] = word()
    del edited[27]
    body = lambda n: [word() for _ in range(n)]
    docs = [(1, " ".join(body(30) + passage + body(40))), (2, " ".join(body(50) + edited + body(5))), (3, " ".join(body(200))), (4, " ".join(passage[:20] + body(100)))]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in docs], "doc_id long, text string, n_chars long")
    found = substring_dup.repeated_passages(df).cache()
    rows = found.collect()
    assert [(r["id"], r["leader"], r["start"], r["end"], r["leader_start"], r["leader_end"]) for r in rows] == [(2, 1, 50, 129, 30, 110)]
    kept = {r["doc_id"]: r for r in substring_dup.without_repeats(df, found).collect()}
    assert {i: kept[i]["text"] for i in (1, 3, 4)} == {i: t for i, t in docs if i != 2}
    assert len(kept[2]["text"].split()) == 55 and kept[2]["n_chars"] == len(kept[2]["text"])


def test_chain_is_cut_at_its_gap():
    """Two exact passages with much between them in one text are two passages, not one poor one."""
    a, b = np.arange(100, 186), np.arange(200, 250)
    own = np.concatenate((np.arange(68), a, np.arange(300, 392), b)).astype("<u4")
    there = np.concatenate((a, np.arange(500, 521), b)).astype("<u4")
    found = sorted(substring_dup.passages(own, substring_dup.Target(there)))
    assert [x[:4] for x in found] == [(68, 154, 0, 86), (246, 296, 107, 157)] and all(x[4] == 1 for x in found)


def test_runs_at_every_place():
    """A passage whose opening words the leader holds earlier too; all maximal runs against brute force."""
    h, x1, x2 = np.arange(20), np.arange(100, 140), np.arange(200, 240)
    there = np.concatenate((h, x1, h, x2)).astype("<u4")
    found = substring_dup.passages(np.concatenate((h, x2)).astype("<u4"), substring_dup.Target(there))
    assert found == [(0, 60, 60, 120, 1.0)]
    rng = np.random.default_rng(3)
    for _ in range(60):
        own, there = (rng.integers(0, 3, rng.integers(0, 50)).astype("<u4") for _ in range(2))
        equal = {(i, j) for i in range(len(own)) for j in range(len(there)) if own[i] == there[j]}
        want = set()
        for i, j in equal:
            n = next(n for n in range(99) if (i + n, j + n) not in equal)
            if (i - 1, j - 1) not in equal and n >= substring_dup.ALIGN_K:
                want |= {(i + k, j + k) for k in range(n)}
        runs = substring_dup.Target(there).runs(own)
        parts = [(i + k, j + k) for i, j, n in runs for k in range(n)]
        assert len(parts) == len(set(parts)) and set(parts) == want


def test_passage_whose_parts_others_lead(spark):
    """Two documents share 60 words; two earlier ones quote less than a passage of them each. Ten such groups."""
    rng = random.Random(9)
    body = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    docs = []
    for k in range(10, 110, 10):
        p = body(60)
        docs += [(k + 1, body(20) + p[:35] + body(20)), (k + 2, body(20) + p[27:] + body(20)), (k + 3, body(30) + p + body(10)), (k + 4, body(5) + p + body(40))]
    found = substring_dup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect()
    assert sorted((r["id"], r["leader"], r["start"], r["end"], r["leader_start"]) for r in found) == [(k + 4, k + 3, 5, 65, 30) for k in range(10, 110, 10)]


def test_passages_repeated_inside(spark):
    """Every place of a passage that a document holds more than once is found."""
    rng = random.Random(8)
    body = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    p, q = body(60), body(60)
    docs = [(1, p + q), (2, p + body(9) + p + q), (3, body(100))]
    found = substring_dup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect()
    assert sorted((r["id"], r["leader"], r["start"], r["end"]) for r in found) == [(2, 1, 0, 60), (2, 1, 69, 189)]


def test_recall_by_edits(spark):
    """Passages of 60 and 100 words between random words, one word in so many changed: how many documents are found."""
    rng = random.Random(12)
    body = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    docs, groups = [], {}
    for words in (60, 100):
        for every in (8, 10, 15, 1000):
            for _ in range(50):
                p = body(words)
                q, first = list(p), rng.randrange(every)
                for k in range(first, words, every):
                    q[k] = body(1)[0]
                i = len(docs)
                docs += [(i, " ".join(body(40) + p + body(30))), (i + 1, " ".join(body(10) + q + body(60)))]
                groups.setdefault((words, every), []).append(i + 1)
    found = {r["id"]: r["leader"] for r in substring_dup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(leader == i - 1 for i, leader in found.items())
    share = {k: np.mean([i in found for i in own]) for k, own in groups.items()}
    least = {(60, 8): 0.7, (60, 10): 0.8, (60, 15): 0.9, (60, 1000): 1, (100, 8): 0.85, (100, 10): 0.9, (100, 15): 0.95, (100, 1000): 1}
    assert all(share[k] >= least[k] for k in least), share


def test_partners_of_led_seeds(spark):
    """Edited passages each seed of which an earlier document leads that has no passage of it, held by few documents and
    by many; copies of one are linked to its least id, and a short line that all have links nobody."""
    rng = random.Random(21)
    body = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    line, docs, want, k = body(20), [], set(), 0
    for _ in range(6):
        p = body(60)
        q = list(p)
        for at in range(9, 60, 10):
            q[at] = body(1)[0]
        # the earlier documents quote 20 words each: every seed is led by one of them
        for at in range(0, 60, 12):
            docs.append((k := k + 1, body(30) + p[at : at + 20] + body(30)))
        first, second = (k := k + 1), (k := k + 1)
        docs += [(first, body(20) + p + body(20)), (second, body(50) + q + body(5))]
        want.add((second, first))
    for _ in range(40):
        docs.append((k := k + 1, body(70) + line + body(70)))
    found = substring_dup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect()
    assert {(r["id"], r["leader"]) for r in found} == want
    assert all(r["start"] >= 50 and r["end"] <= 110 and r["end"] - r["start"] >= 45 for r in found)


def test_partners_at_every_context(spark):
    """A line of 30 words that many documents have: those that have 20 more alike after it are linked, whoever leads it."""
    rng = random.Random(22)
    body = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    line, docs, want = body(30), [], set()
    for i in range(1, 31):
        docs.append((i, body(70) + line + body(70)))
    for i in range(31, 61, 3):
        more = body(20)
        docs += [(i, body(70) + line + more + body(70)), (i + 1, body(80) + line + more + body(65)), (i + 2, body(9) + line + more + body(40))]
        want |= {(i + 1, i), (i + 2, i)}
    found = substring_dup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect()
    got = {(r["id"], r["leader"]) for r in found}
    assert want <= got and all(r["end"] - r["start"] == 50 for r in found) and all((i - 31) // 3 == (j - 31) // 3 for i, j in got)


def test_partners_are_not_pairs(spark, monkeypatch):
    """Documents that share two runs of a word each, between which all have their own words: no pair of them becomes a row."""
    docs = [(i, " ".join([f"a{i}"] * 20 + ["the"] * 24 + [f"b{i}"] * 22 + ["of"] * 21 + [f"c{i}"] * 20)) for i in range(40)]
    seen, compared = [], substring_dup._compared

    def spy(texts, links):
        seen.append(links.select("id", "leader").distinct().count())
        return compared(texts, links)

    monkeypatch.setattr(substring_dup, "_compared", spy)
    assert not substring_dup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert seen == [39, 0]


def test_reaches():
    """Shared runs far apart are no passage if too few of the words between are in both texts."""
    text = lambda *runs: np.array([w for w, n in runs for _ in range(n)], "<u4")
    own = text((1, 20), (2, 40), (3, 20))
    assert not substring_dup.Target(text((1, 20), (4, 40), (3, 20))).reaches(own)
    for other in (text((1, 20), (4, 8), (2, 40)), text((5, 9), (2, 30), (3, 20)), own):
        assert substring_dup.Target(other).reaches(own) and substring_dup.passages(own, substring_dup.Target(other))


def test_equal_stretches_are_compared_once(monkeypatch):
    """Holders of one word over and over, 40 or 50 times between words of their own: each two lengths are compared once."""
    calls, passages = [], substring_dup.passages
    monkeypatch.setattr(substring_dup, "passages", lambda own, target: calls.append(1) or passages(own, target))
    pack = lambda *x: np.array(x, "<i4").tobytes()
    g = []
    for i in range(30):
        n = 40 + 10 * (i % 2)
        words = np.array([*range(1000 * i + 10, 1000 * i + 40), *[1] * n, *range(1000 * i + 50, 1000 * i + 80)], "<u4")
        g.append(substring_dup._Holder(0, i, pack(40), pack(40), pack(0), pack(len(words)), words.tobytes()))
    found = list(substring_dup._partners_within(g, {}))
    assert len(calls) <= 4
    assert {x[0] for x in found} == set(range(3, 30, 2)) and all(x[2] == 40 and x[1] % 2 for x in found)


def test_dense_at():
    """Against all stretches around a seed; a seed alone is none."""
    rng, k = np.random.default_rng(6), substring_dup.K
    for _ in range(200):
        shared = rng.random(rng.integers(5, 90)) < rng.choice([0.5, 0.8, 0.9])
        at = np.arange(len(shared) - k + 1)
        sums = np.concatenate(([0], np.cumsum(shared)))
        fits = lambda p: any(sums[e] - sums[s] >= 0.8 * max(e - s, 45) - 1e-6 for s in range(p + 1) for e in range(p + k, len(shared) + 1))  # noqa: E731, B023
        assert substring_dup._dense_at(shared, at).tolist() == [fits(p) for p in at.tolist()]
    assert not substring_dup._dense_at(np.arange(60) // 20 == 1, np.array([25])).any()


def test_places_of_a_stretch_have_few_keys(monkeypatch):
    """A seed's many places in one stretch of a word over and over don't each give a key for each gram around them."""
    sizes, mix = [], common.mix
    monkeypatch.setattr(common, "mix", lambda x: sizes.append(len(x)) or mix(x))
    pack = lambda *x: np.array(x, "<i4").tobytes()
    g = []
    for i in range(4):
        words = np.array([*range(1000 * i + 10, 1000 * i + 40), *[1] * 60, *range(1000 * i + 50, 1000 * i + 80)], "<u4")
        places = pack(*range(30, 86))
        g.append(substring_dup._Holder(0, i, places, places, pack(0), pack(len(words)), words.tobytes()))
    found = list(substring_dup._partners_within(g, {}))
    assert max(sizes) <= 2 * sum(len(x.words) for x in g)
    assert {(x[0], x[2]) for x in found} == {(i, p) for i in (1, 2, 3) for p in range(30, 86)}


def test_seeds_without_places(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k * k + k) % 37}" for k in range(120))) for i in range(5)], "id long, text string")
    bare = substring_dup._seeds(docs, placed=False)
    assert bare.columns == ["id", "h"] and sorted(bare.collect()) == sorted(substring_dup._seeds(docs).select("id", "h").collect())


def test_whole_and_in_order():
    """Texts wholly in another, and the most words in order, against brute force."""
    rng = np.random.default_rng(5)
    for _ in range(100):
        own, there = (rng.integers(0, 3, rng.integers(1, n)).astype("<u4") for n in (5, 40))
        target = substring_dup.Target(there)
        places = [j for j in range(len(there) - len(own) + 1) if (there[j : j + len(own)] == own).all()]
        assert target.whole(own) == (places[0] if places else -1)
        assert target.in_order(own) == substring_dup.matched(own, there)


def test_matched():
    assert substring_dup.matched(np.array([1, 2, 3, 4]), np.array([2, 9, 4])) == 2
    assert substring_dup.matched(np.array([1]), np.array([2])) == 0


def test_warc_records(spark, tmp_path):
    page = '<html lang="de"><head><title>T &lt;1&gt;</title><style>p{}</style></head><body><p>a  b<br>c<!-- x --><a href=\'/l?a=1&amp;b\'>link</a><script>"</p>"</script></body></html>'
    assert warc.plain_text(page) == "T <1>\na b\nclink"
    records = [warc.response(1, "http://h/", page), warc.make_record("request", "<urn:x>", [], "text/plain", b"GET"), warc.response(2, "http://i/", "WARC/1.0 inside")]
    data = b"".join(r + b"\r\n\r\n" for r in records)
    assert list(warc.parse_records(data)) == records
    (tmp_path / "a.warc").write_bytes(data)
    read = warc.read_responses(spark, str(tmp_path / "a.warc"))
    made = warc.derivatives(read)
    out = made.collect()
    assert [r["record_type"] for r in out] == ["metadata", "conversion"] * 2
    meta = out[0]["record"]
    for line in ("http-Content-Type: text/html; charset=utf-8", "title: T <1>", "html-lang: de", "outlink: /l?a=1&b", "source-WARC-Type: response"):
        assert f"{line}\r\n" in meta
    warc.write_warc(made, str(tmp_path / "out"))
    again = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert [r.decode() for r in warc.parse_records(again)] == [r["record"] for r in out]
    latin = warc.make_record("response", "<urn:y>", [], "application/http", "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>é".encode("latin-1"))
    assert warc.derive(latin)[1][1].endswith("é".encode())


def test_warc_bodies(spark, tmp_path):
    """Compressed files, and bodies that are chunked, compressed, of no known encoding, or no text."""
    import gzip
    import zlib

    page = "<title>t</title><p>one two" * 50
    sent = gzip.compress(page.encode())
    chunked = b"".join(f"{len(x):x}\r\n".encode() + x + b"\r\n" for x in (sent[:20], sent[20:])) + b"0\r\n\r\n"
    bodies = [
        ("Content-Type: text/html\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip", chunked), ("Content-Encoding: deflate", zlib.compress(page.encode())),
        ("Content-Encoding: deflate", zlib.compress(page.encode())[2:-4]), ("Content-Type: image/png", b"\x89PNG"), ("Content-Encoding: br", b"?"), ("Content-Encoding: gzip", b"broken"),
    ]
    records = [warc.make_record("response", f"<urn:{i}>", [], "application/http", f"HTTP/1.1 200 OK\r\n{h}\r\n\r\n".encode() + b) for i, (h, b) in enumerate(bodies)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records))
    assert list(warc._members((tmp_path / "a.warc.gz").read_bytes(), 7)) == [r + b"\r\n\r\n" for r in records]
    out = warc.derivatives(warc.read_responses(spark, str(tmp_path / "a.warc.gz"))).collect()
    kinds = {}
    for r in out:
        kinds.setdefault(r["refers_to"], []).append(r["record_type"])
        assert r["source_payload_digest"] == warc.digest(bodies[int(r["refers_to"][5:-1])][1])
    assert kinds == {f"<urn:{i}>": ["metadata", "conversion"] if i < 3 else ["metadata"] for i in range(6)}
    assert {r["record"].split("\r\n\r\n", 1)[1] for r in out if r["record_type"] == "conversion"} == {warc.plain_text(page)}


def test_signature_of_a_long_set(monkeypatch):
    rng = np.random.default_rng(2)
    counts = np.array([3, 500, 1, 200, 40])
    h = rng.integers(0, 2**63, counts.sum()).astype(np.uint64)
    whole = near_dup.super_min_hash(h, counts)
    monkeypatch.setattr(near_dup, "OFFERS", 64)
    assert (near_dup.super_min_hash(h, counts) == whole).all()


def test_long_text_counts(monkeypatch):
    text = "".join(random.Random(1).choice("ab \n\u00e9\u4e2d\U0001f600XY.") for _ in range(3000))
    data = pa.array([text, "", "ab", None, text[:700]], pa.string())
    whole, (x, row, size) = language.text_counts(data), quality.line_features(data)
    monkeypatch.setattr(common, "WINDOW", 101)
    assert (language.text_counts(data) == whole).all() and whole.sum() > 0
    cut = quality.line_features(data)
    assert np.allclose(cut[0], x) and (cut[1] == row).all() and (cut[2] == size).all()


def test_lines_are_latent():
    """Lines of documents of which a bad one has good lines too: their states are found, and the shares hold."""
    rng = np.random.default_rng(5)
    row = np.repeat(np.arange(200), 10)
    labels = (np.arange(200) % 2).astype(np.int64)
    state = np.where(labels[row] == 1, 1, (np.arange(2000) % 10 < 4).astype(np.int64))
    x = rng.normal(0, 0.3, (2000, quality.FEATURES)).astype(np.float32)
    x[:, 0] += state
    size = np.full(2000, 30.0)
    m = quality.fit(x, row, size, labels)
    assert ((m.marginals(x, row) > 0.5) == state).mean() > 0.9
    v = (quality.chain_inputs(x, row) - m.mean) / m.scale
    assert np.allclose(v @ m.weights, m.logits(x, row), atol=1e-3)
    y, _ = quality.expected(m.logits(x, row), row, size, m.trans, labels)
    share = quality.shares(y, row, size, 200)
    assert (share[labels == 1] > quality.GOOD_SHARE - 0.01).all() and (share[labels == 0] < quality.BAD_SHARE + 0.01).all()


def test_spliced_documents(spark):
    """Lines of documents put together from a good and a bad one."""
    from strandex.llm.queries import fold

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    model = quality.train(docs, labels, fold(5) != 0)
    held = docs.join(labels, "doc_id").where(fold(5) == 0).where("length(text) between 1 and 20000").select("quality", "text").collect()
    good, bad = ([r["text"] for r in held if r["quality"] == q] for q in (1, 0))
    both = [(i, f"{a}\n{b}" if i % 2 else f"{b}\n{a}", len((a if i % 2 else b).encode())) for i, (a, b) in enumerate(zip(good, bad, strict=False))]
    cut = {i: n for i, _, n in both}
    found = quality.lines(spark.createDataFrame([x[:2] for x in both], "doc_id long, text string"), model).collect()
    right = [(r["good"] > 0.5) == ((r["start"] < cut[r["id"]]) == (r["id"] % 2 == 1)) for r in found]
    assert len(both) > 10 and np.mean(right) > 0.85


def test_ftrl_plainly():
    """Two steps against the update rules written out for each weight."""
    rows, labels = [(np.array([3, 7]), np.array([0.6, 0.8])), (np.array([3]), np.array([1.0]))], np.array([1, 0])
    w, bias = language.ftrl(rows, labels, 2, epochs=1)
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.02
    z, n = {}, {}

    def weight(i, k):
        v = z.get((i, k), 0.0)
        return 0.0 if abs(v) <= l1 else -(v - np.sign(v) * l1) / ((beta + n[i, k] ** 0.5) / alpha + l2)

    for r in np.random.default_rng(0).permutation(2):
        at, value = [*rows[r][0].tolist(), language.BUCKETS], [*rows[r][1].tolist(), 1.0]
        now = [[weight(i, k) for k in (0, 1)] for i in at]
        score = [sum(v * x[k] for v, x in zip(value, now, strict=True)) for k in (0, 1)]
        p = np.exp(score) / np.exp(score).sum()
        for i, v, x in zip(at, value, now, strict=True):
            for k in (0, 1):
                g = v * (p[k] - (k == labels[r]))
                had = n.get((i, k), 0.0)
                n[i, k] = had + g * g
                z[i, k] = z.get((i, k), 0.0) + g - (n[i, k] ** 0.5 - had**0.5) / alpha * x[k]
    for i in (3, 7):
        assert w[i].tolist() == pytest.approx([weight(i, k) for k in (0, 1)])
    assert bias.tolist() == pytest.approx([weight(language.BUCKETS, k) for k in (0, 1)]) and np.count_nonzero(np.delete(w, [3, 7], 0)) == 0


def test_one_block_live(spark, hard):
    """A plan holds one block's pass, however many blocks there are; packing broadcasts nothing that grows."""
    docs, bench = (spark.read.parquet(f"{hard}/{x}.parquet") for x in ("documents", "benchmark"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(decontaminate.contamination(docs, bench, block_bytes=20)).count("MapInArrow") == 1
    rules = spark.createDataFrame([(f"{k}.net", "/", "block") for k in range(40)], "host string, path string, verdict string")
    pages = spark.read.parquet(f"{hard}/pages.parquet")
    assert plan(url_filter.judge(pages, rules, block_rules=4)).count("MapInArrow") == 1
    assert "Broadcast" not in plan(packing.pack(docs))
    items = spark.createDataFrame([("x", "fox JUMPS over"), ("y", None)], "item_id string, text string")
    assert {tuple(r["items"]) for r in decontaminate.contamination(docs, items).collect()} == {(), ("x",)}


def test_tokens_equal_tokenizers():
    from tokenizers import Tokenizer

    from strandex.llm.tokens import encoder, public_paths

    paths = public_paths()
    encode, plain = encoder(*paths), Tokenizer.from_file(paths[0])
    rng = random.Random(2)
    alphabet = "ab \n\t'sé中😀0-9.\u00a0\u2003\r_" + "the ing"
    samples = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(500)] + ["<|endoftext|> a", "x" * 3000, "\x00\x7f"]
    for t in samples:
        assert encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids, t
