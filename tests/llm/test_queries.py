"""Each query against its SQL or against a plain computation, on given, hard and empty tables."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from strandex.llm.oracle import ORACLES
from strandex.llm.queries import CONTROL_TEXT, QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(sf_dir, name, *columns):
    return [tuple(r[x] for x in columns) for r in pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()]


def rows(spark, sf_dir, name):
    return [r.asDict() for r in QUERIES[name](spark, sf_dir).collect()]


@pytest.fixture(params=["given", "hard"])
def tables(request):
    return SF if request.param == "given" else request.getfixturevalue("hard")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(against_oracle, name):
    assert against_oracle(SF, QUERIES[name], ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    found = rows(spark, empty, name)
    assert [r["conv_id"] for r in found] == [-7] if name.startswith("op1_") else found == []


def test_op1(spark, tables):
    turns = defaultdict(list)
    for conv, turn, role, text in [*read(tables, "conversations", "conv_id", "turn", "role", "text"), (-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]:
        turns[conv].append((turn is not None, turn, role is not None, role or "", text or ""))
    found = {r["conv_id"]: r for r in rows(spark, tables, "op1_chat_format")}
    assert set(found) == set(turns)
    for conv, own in turns.items():
        own.sort(key=lambda t: (t[0], t[1] or 0, t[2:]))
        r = found[conv]
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{t[3]}\n{t[4]}\n" for t in own).encode()).hexdigest()
        loss = "".join(t[4] for t in own if t[3] == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] >= sum(len(t[4]) for t in own)


def brute_contamination(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for k in range(max(1, len(w) - 12)):
                windows[tuple(w[k : k + 13])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit.update(range(k, k + n))
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_op2(spark, tables):
    want = brute_contamination(read(tables, "documents", "doc_id", "text"), read(tables, "benchmark", "item_id", "text"))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows(spark, tables, "op2_decontaminate")]
    assert sorted(got, key=repr) == want
    assert any(x[5] for x in want)


def plain_fingerprint(text, k=12, w=24):
    """The bytes of the grams that winnowing keeps, by a rolling hash written out; equal grams are one."""
    raw, mask = text.encode(), 2**64 - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    base = 0x9E3779B97F4A7C15
    value = [mix((i + 1) * base & mask) for i in range(256)]
    grams = [raw[i : i + k] for i in range(max(1, len(raw) - k + 1))] if raw else []
    keys = [mix(sum(value[x] * pow(base, j, 2**64) for j, x in enumerate(g)) & mask) >> 32 for g in grams]
    kept = set()
    for i in range(max(1, len(keys) - w + 1) if keys else 0):
        kept.add(max(j for j in range(i, min(i + w, len(keys))) if keys[j] == min(keys[i : i + w])))
    return {grams[j] for j in kept}


def test_op3(spark, tables):
    from strandex.llm.fingerprint import decoded

    docs = sorted(((-(2**63) if i is None else i, t or "") for i, t in read(tables, "documents", "doc_id", "text")))
    plain = {t: plain_fingerprint(t) for _, t in docs if len(t) < 5000}
    found = defaultdict(list)
    for r in rows(spark, tables, "op3_fingerprint"):
        found[r["doc_id"] if r["doc_id"] is not None else -(2**63)].append(r)
    prints = {}
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        sha = hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        r = next(x for x in found[i] if x["edited_sha256"] == sha and x["n_chars"] == len(t))
        found[i].remove(r)
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        a, b = (set(decoded(x)[1].tolist()) for x in (r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1)
        assert 0 <= r["near_next"] <= 1
        if t in plain and after in plain:
            a, b = plain[t], plain[after]
            assert r["near_next"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1)
    assert not any(found.values())


def test_op4(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = read(tables, "documents", "doc_id", "text")
    want = sorted((zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes()), repr(i)) for i, x in docs)
    ids = defaultdict(list)
    for i, x in docs:
        ids[i].append(np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4"))
    pieces = rows(spark, tables, "op4_packing")
    assert sum(p["length"] for p in pieces) == sum(len(x) for own in ids.values() for x in own)
    left = {i: [(k, at) for k, x in enumerate(own) for at in range(len(x))] for i, own in ids.items()}
    seen = {i: set() for i in ids}
    for p in sorted(pieces, key=lambda p: (repr(p["doc_id"]), p["doc_tokens"], p["start"])):
        own = [
            k
            for k, x in enumerate(ids[p["doc_id"]])
            if len(x) == p["doc_tokens"] and (k, p["start"]) not in seen[p["doc_id"]] and zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
        ]
        assert own, p
        seen[p["doc_id"]].update((own[0], at) for at in range(p["start"], p["start"] + p["length"]))
    assert all(len(seen[i]) == len(left[i]) for i in ids) and want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
    padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024 and len({(p["sequence_length"], p["step_group"]) for p in own}) == 1
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 1024 and sorted(sequences) == list(range(len(sequences)))


def test_op5(spark, tables):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    want = []
    for i, url in read(tables, "pages", "page_id", "url"):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(h.count("."), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((i, host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "allow"))
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(spark, tables, "op5_url_filter")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def plain_record(raw):
    """(version, fields, block) of a record, by its own rules: lines that end in CR LF, a blank one, then the block."""
    lines, rest = [], raw
    while True:
        at = rest.index(b"\r\n")
        line, rest = rest[:at], rest[at + 2 :]
        if not line:
            return lines[0], dict(x.split(": ", 1) for x in lines[1:]), rest
        lines.append(line.decode())


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


class Text(HTMLParser):
    """A page's text by the standard parser: no hidden element's content, a line for each block."""

    BLOCK = {"p", "div", "br", "title", "html", "head", "body", "h1", "h2", "h3", "li", "ul", "ol", "table", "tr", "td", "nav", "footer", "header", "main", "article", "section", "blockquote", "pre", "form", "aside"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.out.append("\n" if tag in self.BLOCK else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        self.out.append("\n" if tag in self.BLOCK else "")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)

    def words(self, page):
        self.feed(page)
        self.close()
        return "".join(self.out).split()


def test_op6(spark, tables):
    pages = read(tables, "pages", "page_id", "url", "html")
    found = rows(spark, tables, "op6_warc_derivatives")
    assert len(found) == 2 * len(pages)
    by = defaultdict(list)
    for r in found:
        by[r["page_id"], r["target_uri"], r["source_payload_digest"]].append(r)
    for i, url, page in pages:
        uri, body = None if url is None else url.replace("\n", " "), (page or "").encode()
        own = by[i, uri, sha1(body)]
        assert {r["record_type"] for r in own} == {"metadata", "conversion"} and len({r["refers_to"] for r in own}) == 1
        for r in own:
            version, head, block = plain_record(r["record"].encode())
            assert version == "WARC/1.0" and head["WARC-Type"] == r["record_type"] and head["WARC-Refers-To"] == r["refers_to"] and head.get("WARC-Target-URI") == uri
            assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", head["WARC-Record-ID"]) and head["WARC-Record-ID"] == r["record_id"] != r["refers_to"]
            assert int(head["Content-Length"]) == len(block) == r["content_length"] and head["WARC-Block-Digest"] == sha1(block) == r["block_digest"]
            if r["record_type"] == "metadata":
                lines = block.decode().split("\r\n")
                source = [x for x in lines if x.startswith("source-WARC-")]
                assert f"source-WARC-Payload-Digest: {sha1(body)}" in source and f"source-WARC-Record-ID: {r['refers_to']}" in source and "http-status-line: HTTP/1.1 200 OK" in lines
                sent = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                assert f"source-WARC-Block-Digest: {sha1(sent)}" in source
            else:
                assert head["WARC-Source-Payload-Digest"] == sha1(body)
                if tables == SF:
                    assert block.decode().split() == Text().words(page or "")
    assert len({r["record_id"] for r in found}) == len({(r["page_id"], r["target_uri"], r["record_type"]) for r in found})


def brute_passages(docs, n=51):
    """Documents that share n words in a row with another one."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    where = defaultdict(set)
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - n + 1):
            where[tuple(w[k : k + n])].add(i)
    return {i for own in where.values() if len(own) > 1 for i in own}


def test_op7(spark, tables):
    docs = [(i, t) for i, t in read(tables, "documents", "doc_id", "text") if i is not None]
    found = rows(spark, tables, "op7_substring_dup")
    flagged = {r["doc_id"] for r in found}
    assert brute_passages(docs) <= flagged
    assert flagged <= brute_passages(docs, 8)
    assert flagged == {r["other_id"] for r in found} and all(r["end"] - r["start"] >= 30 and r["identity"] >= 0.8 for r in found)


def test_op8_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = dict(read(sf, "labels", "doc_id", "quality"))
    found = {r["doc_id"]: r for r in rows(spark, sf, "op8_quality")}
    assert len(found) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    right = [found[i]["predicted"] == q for i, q in labels.items() if found[i]["held_out"]]
    assert len(right) > 40 and np.mean(right) > 0.95


def test_op9_held_out(spark):
    sf = "/root/testdata/sf0.01"
    langs = dict(read(sf, "documents", "doc_id", "lang"))
    found = rows(spark, sf, "op9_language_id")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    right = [r["lang_pred"] == langs[r["doc_id"]] for r in found if r["held_out"]]
    assert len(right) > 200 and np.mean(right) > 0.98


@pytest.mark.parametrize("name", ["op8_quality", "op9_language_id"])
def test_classifiers_on_hard_tables(spark, hard, name):
    docs = read(hard, "documents", "doc_id", "text")
    found = rows(spark, hard, name)
    assert sorted(repr(r["doc_id"]) for r in found) == sorted(repr(i) for i, _ in docs)
    assert all(0 <= r["score"] <= 1 for r in found)
    if name == "op9_language_id":
        texts = defaultdict(set)
        for i, t in docs:
            texts[i].add(t)
        for r in found:
            letter = any(ch.isalpha() for t in texts[r["doc_id"]] for ch in t or "")
            assert r["lang_pred"] in (("en", "de", "fr", "und") if r["doc_id"] is None else ("en", "de", "fr") if letter else ("und",))


def brute_components(docs, k, num):
    sets = defaultdict(list)
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i].append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    ids = [i for i in sets if i is not None]
    part = {i: i for i in ids}
    for x in ids:
        for y in ids:
            if x < y and any(a and b and 100 * len(a & b) >= num * len(a | b) for a in sets[x] for b in sets[y]):
                lo, hi = sorted((part[x], part[y]))
                part = {i: lo if p == hi else p for i, p in part.items()}
    return sets, part


def test_op10_hard(spark, hard):
    sets, part = brute_components(read(hard, "documents", "doc_id", "text"), 4, 80)
    want = sorted(repr((i, len(s), part.get(i), None if i is None else i == part[i])) for i, own in sets.items() for s in own)
    got = sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in rows(spark, hard, "op10_minhash_near_dup"))
    assert got == want


def test_one_query_an_operator():
    assert sorted(int(re.match(r"op(\d+)_", x)[1]) for x in QUERIES) == list(range(1, 11))
