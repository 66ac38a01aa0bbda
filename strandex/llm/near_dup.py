"""MinHash near-duplicates: SuperMinHash signatures, banding, exact verification, grouping.

1. Each document's distinct word shingles give a SuperMinHash signature: shingle d ranks the m
   slots by a random permutation and offers slot p_d(j) the value j + r_dj; a slot keeps the least
   offer. Offers of level j+1 exceed all of level j, so a document is done at the first level at
   which all its slots are filled.
2. Documents with equal shingle sets are one class, represented by the least id.
3. Representatives that share a band of the signature share a bucket; the least id of each bucket
   leads it. All that share a bucket share its leader, so the groups "all documents led by L"
   hold every candidate pair, in as many rows as there are distinct (document, leader) pairs.
4. In each group the exact similarity on full sets joins members to the leader; the rest (those
   outside the leader's part) are compared exactly with the members that a prefix filter leaves. Only links
   that join two parts are emitted. Large groups are dealt over blocks, each with the leader. What is then
   outside the group's largest part looks up, by its rarest shingles, in which other blocks a partner can be,
   and meets those, in tasks that hold one block and as much of the rest as a block. No pair that shares a bucket and
   can be similar enough is skipped. A block's size grows with the root of its group's, between BLOCK's bounds.
5. Components by distributed star rounds.

Joins that grow with the input are merge joins at every size, so small inputs run the large one's plan.

With 32 bands of 4 rows a pair of similarity 0.8 shares a bucket but for 5 in 10**8 cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .graph import components

SLOTS, BANDS = 128, 32
#: Shingles whose offers are made at once; each takes SLOTS bytes.
OFFERS = 1 << 18
#: Shingles compared in one block, at least and at most.
BLOCK = 16_000, 1_000_000
#: Shingles that one in so many documents of a group has come last in the order of the prefix filter.
COMMON = 4


def shingle_sets(col: pa.Array, k: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the k-word shingles of each row, ascending within a row, and each row's count.

    A row with fewer words has one shingle, its whole sequence; one without words has none.
    """
    buf, off = c.text_bytes(col)
    w = c.Words(buf, off, table)
    g, ok = w.grams(k)
    h, d = g[ok], w.doc[: len(g)][ok]
    few = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(few):
        whole = []
        for i in few:
            x = w.hash[w.first[i] : w.first[i + 1]]
            whole.append(c.mix(c.gram_hashes(x, len(x)) + np.uint64(len(x)))[0])
        h, d = np.concatenate((h, np.array(whole, np.uint64))), np.concatenate((d, few))
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.bincount(d[new], minlength=len(col)).astype(np.int64)


def super_min_hash(h: np.ndarray, counts: np.ndarray, m: int = SLOTS) -> np.ndarray:
    """Signatures (rows, m) of sets given by their hashes, row after row.

    Large batches are done in parts: the signature of a union is the least of its parts' signatures.
    """
    if len(h) > OFFERS:
        ends, out = np.cumsum(counts), np.full((len(counts), m), 0xFFFFFFFFFFFFFFFF, np.uint64)
        for at in range(0, len(h), OFFERS):
            to = min(at + OFFERS, len(h))
            i, j = (int(np.searchsorted(ends, x, "right")) for x in (at, to - 1))
            own = np.minimum(ends[i : j + 1], to) - np.maximum(ends[i : j + 1] - counts[i : j + 1], at)
            some = np.flatnonzero(own > 0)
            out[i + some] = np.minimum(out[i + some], super_min_hash(h[at:to], own[some], m))
        return out
    n, top = len(counts), np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n * m, top, np.uint64)
    doc = np.repeat(np.arange(n), counts)
    perm = np.empty((len(h), m), np.uint8 if m <= 256 else np.uint16)
    perm[:] = np.arange(m)
    live, low = np.arange(len(h)), np.uint64(0xFFFFFFFF)
    for j in range(m):
        if not len(live):
            break
        r = c.mix(h[live] + np.uint64((j + 1) * 0xA0761D6478BD642F & c._M64))
        k = j + ((r & low) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        slot = perm[live, k]
        perm[live, k] = perm[live, j]
        d = doc[live]
        np.minimum.at(sig, d * m + slot, np.uint64(j << 32) | (r >> np.uint64(32)))
        rows = d[np.concatenate(([True], d[1:] != d[:-1]))]
        open_ = np.zeros(n, bool)
        open_[rows] = (sig.reshape(n, m)[rows] == top).any(1)
        live = live[open_[d]]
    return sig.reshape(n, m)


def band_hashes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, m = sig.shape
    part = sig.reshape(n, bands, m // bands)
    out = np.zeros((n, bands), np.uint64)
    for i in range(part.shape[2]):
        out = c.mix(out * c._Q + part[:, :, i])
    return c.mix(out ^ c.mix(np.arange(1, bands + 1, dtype=np.uint64)))


def _features(docs: DataFrame, k: int, table: np.ndarray) -> DataFrame:
    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        h, n = shingle_sets(b["text"], k, table)
        first = np.concatenate(([0], np.cumsum(n)))
        sums = []
        for seed in (1, 2):
            s = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c.mix(h ^ c.BYTE_VALUE[seed]), dtype=np.uint64)))
            sums.append((s[first[1:]] - s[first[:-1]]).astype(np.int64))
        some = n > 0
        bands = np.zeros((len(n), BANDS), np.uint64)
        bands[some] = band_hashes(super_min_hash(h, n[some]))
        lists = c.list_array(bands.ravel().astype(np.int64), np.full(len(n), BANDS), pa.int64())
        return pa.RecordBatch.from_arrays([b["id"], pa.array(n), *map(pa.array, sums), lists], ["id", "n", "s1", "s2", "bands"])

    return c.mapped(docs, f, f"id {c.id_column(docs, 'id')[1]}, n long, s1 long, s2 long, bands array<long>")


def prefix_lengths(n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of a set's n shingles, in any fixed order, show it to a larger one, and to a smaller one.

    Of two sets that link, the smaller's first prefix and the larger's second one share a shingle.
    """
    return n + 1 + (-2 * num * n) // (num + den), n + 1 + (-num * n) // den


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as each size."""
    return np.arange(size.sum()) + np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)


class _Postings:
    """Rows by the shingles of their prefixes."""

    def __init__(self, shingles: np.ndarray, rows: np.ndarray):
        order = np.argsort(shingles, kind="stable")
        self.shingles, self.rows = shingles[order], rows[order]

    def of(self, shingles: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.shingles, shingles, "left"), np.searchsorted(self.shingles, shingles, "right")
        return self.rows[_spans(lo, hi - lo)]


def join_parts(sets: list[np.ndarray], part: np.ndarray, focus: np.ndarray, lead: int | None, num: int, den: int) -> list[tuple[int, int]]:
    """Exact links that join different parts: each focus row against all rows.

    part: the part each row is in so far. lead: first this row is compared with all, then those that
    are still outside its part, whatever focus says. Two sets link if den * intersection >= num * union. Rows are
    compared that a prefix filter, the rarest shingles first, and the sets' sizes allow.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    words, flat, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(many, kind="stable")] = np.arange(len(words))
    row = np.repeat(np.arange(len(sets)), sizes)
    flat = rank[flat]
    flat = flat[np.lexsort((flat, row))]
    mark = np.zeros(len(words), np.uint8)
    out: list[tuple[int, int]] = []

    def compare(y: int, rows: np.ndarray) -> None:
        own = flat[starts[y] : starts[y] + sizes[y]]
        mark[own] = 1
        size = sizes[rows]
        both = np.add.reduceat(mark[flat[_spans(starts[rows], size)]], np.concatenate(([0], np.cumsum(size)[:-1])), dtype=np.int64)
        mark[own] = 0
        near = rows[(den * both >= num * (size + sizes[y] - both)) & (part[rows] != part[y])]
        for p in np.unique(part[near]):
            out.append((y, int(near[part[near] == p][0])))
            part[part == p] = part[y]

    if lead is not None:
        compare(lead, np.arange(len(sets)))
        focus = part != part[lead]
    left = np.flatnonzero(focus)
    if not len(left) or (part == part[0]).all():
        return out
    to_larger, to_smaller = prefix_lengths(sizes, num, den)
    place = np.arange(len(flat)) - starts[row]
    shown = place < to_larger[row]
    smaller, larger = _Postings(flat[shown], row[shown]), _Postings(flat[place < to_smaller[row]], row[place < to_smaller[row]])
    for y in left.tolist():
        own, n = flat[starts[y] : starts[y] + sizes[y]], sizes[y]
        x, z = smaller.of(own[: to_smaller[y]]), larger.of(own[: to_larger[y]])
        rows = np.unique(np.concatenate((x[(sizes[x] <= n) & (den * sizes[x] >= num * n)], z[(sizes[z] >= n) & (den * n >= num * sizes[z])])))
        rows = rows[part[rows] != part[y]]
        if len(rows):
            compare(y, rows)
    return out


def _verified(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of rows (leader, block, id, part, focus, shingles): each (leader, block) by itself."""
    _, kind, arrow = c.id_column(rows, "id")

    def group(g: list) -> Iterator[tuple[int, int]]:
        ids = [x[0] for x in g]
        lead = next((i for i, x in enumerate(g) if x[2] == 2), None)
        names = {x: k for k, x in enumerate(dict.fromkeys(x[1] for x in g))}
        part = np.array([names[x[1]] for x in g])
        focus = np.array([x[2] == 1 for x in g])
        for i, j in join_parts([np.frombuffer(x[3], np.uint64) for x in g], part, focus, lead, num, den):
            yield ids[i], ids[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, g, out = None, [], []

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], arrow) for i in (0, 1)], ["a", "b"])

        for b in batches:
            for leader, block, *x in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if (leader, block) != key:
                    if len(g) > 1:
                        out += group(g)
                    key, g = (leader, block), []
                g.append(x)
            if out:
                yield give()
                out = []
        if len(g) > 1:
            out += group(g)
        if out:
            yield give()

    c.tune(rows.sparkSession)
    return rows.repartition("leader", "block").sortWithinPartitions("leader", "block", "id").mapInArrow(run, f"a {kind}, b {kind}")


def _with_sets(docs: DataFrame, places: DataFrame, k: int, table: np.ndarray) -> DataFrame:
    """Each row of places (id, to: array of (leader, block, part, focus)) exploded, with id's shingles."""
    kind = c.id_column(docs, "id")[1]
    to = places.groupBy("id").agg(F.collect_list(F.struct("leader", "block", "part", "focus")).alias("to"))

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        h, n = shingle_sets(b["text"], k, table)
        raw, first = h.tobytes(), np.concatenate(([0], np.cumsum(n))) * 8
        sets = pa.array([raw[first[i] : first[i + 1]] for i in range(len(n))], pa.binary())
        return pa.RecordBatch.from_arrays([b["id"], b["to"], sets], ["id", "to", "shingles"])

    held = docs.join(to.hint("merge"), "id").select("id", "text", "to")
    return (
        c.mapped(held, f, f"id {kind}, to array<struct<leader:{kind},block:long,part:{kind},focus:int>>, shingles binary")
        .select("id", F.explode("to").alias("t"), "shingles")
        .select("t.leader", "t.block", "id", "t.part", "t.focus", "shingles")
    )


def _group_counts(held: DataFrame) -> DataFrame:
    """(leader, shingle, n, docs): in how many of a group's docs rows each shingle is, counted where one row in COMMON of a
    batch has it.

    What one in COMMON of all rows have, one in COMMON of some batch's rows have. So each batch sends COMMON times a
    row's shingles at most, however large the group; n is too small for what is rare in some batches.
    """
    kind, arrow = c.id_column(held, "leader")[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[tuple, list[np.ndarray]] = {}
            for *key, raw in zip(*(b[x].to_pylist() for x in ("leader", "docs", "shingles")), strict=True):
                by.setdefault(tuple(key), []).append(np.frombuffer(raw, np.int64))
            for (leader, docs), own in by.items():
                h, n = np.unique(np.concatenate(own), return_counts=True)
                h, n = h[n * COMMON >= len(own)], n[n * COMMON >= len(own)]
                yield pa.RecordBatch.from_arrays([pa.array([leader] * len(h), arrow), pa.array(h), pa.array(n), pa.array([docs] * len(h), pa.int64())], ["leader", "shingle", "n", "docs"])

    c.tune(held.sparkSession)
    found = held.select("leader", "docs", "shingles").mapInArrow(run, f"leader {kind}, shingle long, n long, docs long")
    return found.groupBy("leader", "shingle").agg(F.sum("n").alias("n"), F.first("docs").alias("docs"))


def _prefixes(held: DataFrame, num: int, den: int) -> DataFrame:
    """(leader, block, id, rest, shown, shingle) of rows (leader, block, id, rest, common, shingles): both prefixes of
    each row, shown for what is in the first. Shingles in common come last; within both kinds they go by hash."""
    kind, arrow = c.id_column(held, "id")[1:]
    names = ["leader", "block", "id", "rest", "shown", "shingle"]

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        at, shown, out = [], [], []
        for i, (raw, common) in enumerate(zip(b["shingles"].to_pylist(), b["common"].to_pylist(), strict=True)):
            h = np.frombuffer(raw, np.int64)
            last = np.isin(h, np.array(common or [], np.int64))
            first, second = (int(x) for x in prefix_lengths(np.int64(len(h)), num, den))
            own = np.concatenate((h[~last], h[last]))[:second]
            at.append(np.full(len(own), i))
            shown.append(np.arange(len(own)) < first)
            out.append(own)
        at, shown, out = (np.concatenate(x) for x in (at, shown, out))
        return pa.RecordBatch.from_arrays([*(b[x].take(pa.array(at)) for x in names[:4]), pa.array(shown), pa.array(out)], names)

    return c.mapped(held, f, f"leader {kind}, block long, id {kind}, rest boolean, shown boolean, shingle long")


def _meetings(shown: DataFrame) -> DataFrame:
    """(leader, id, to), once each: the other blocks where a partner of a rest row can be, from rows of _prefixes.

    A row's shingles lead to much the same blocks, so their sets are joined before they become rows: a group of n rows
    outside its main part and b blocks gives n * (b - 1) at most, whatever its shingles.
    """
    where = c.scratch(shown.groupBy("leader", "shingle", "shown").agg(F.sort_array(F.collect_set("block")).alias("to")).withColumnRenamed("shown", "other"))
    meet = shown.where("rest").join(where.hint("merge"), ["leader", "shingle"]).where("shown or other")
    sets = meet.groupBy("leader", "id", "block").agg(F.collect_set("to").alias("sets"))
    to = F.array_except(F.flatten("sets"), F.array("block"))
    return sets.select("leader", "id", F.explode(to).alias("to"))


def _across(rows: DataFrame, total: DataFrame, links: DataFrame, num: int, den: int) -> DataFrame | None:
    """Links between blocks of a group, or None if no group needs any.

    But for their leaders, who have met all, rows outside the group's largest part meet the blocks that hold a row whose
    prefix meets theirs. A task holds a block and as many shingles of such rows as a block may have.
    """
    large = total.where("blocks > 1").hint("merge")
    held = rows.where("focus = 0").drop("part", "focus").join(large, "leader").join(components(links).hint("merge"), "id", "left")
    held = c.scratch(held.withColumn("part", F.coalesce("component", "id")).drop("component", "blocks"))
    parts = held.groupBy("leader", "part").agg(F.count("*").alias("many"))
    main = c.scratch(parts.groupBy("leader").agg(F.max_by("part", F.struct("many", "part")).alias("main"), F.sum("many").alias("docs"), F.count("*").alias("parts")).where("parts > 1").drop("parts"))
    if main.isEmpty():
        return None
    held = c.scratch(held.join(main.hint("merge"), "leader").withColumn("rest", F.col("part") != F.col("main")).drop("main"))
    often = _group_counts(held).where(F.col("n") * COMMON >= F.col("docs"))  # some COMMON times a row's shingles at most
    common = c.scratch(often.groupBy("leader").agg(F.collect_list("shingle").alias("common")))
    shown = c.scratch(_prefixes(held.join(common.hint("merge"), "leader", "left").select("leader", "block", "id", "rest", "common", "shingles"), num, den))
    rest = c.scratch(_meetings(shown).join(held.where("rest").drop("block").hint("merge"), ["leader", "id"]))
    many = F.ceil(F.sum(F.length("shingles") / 8) / F.first("size"))
    parted = c.scratch(rest.groupBy("leader", F.col("to").alias("block")).agg(many.alias("subs")))
    key = (F.col("block") * (1 << 24) + F.col("sub")).alias("block")
    subs = parted.hint("merge")
    every = held.join(subs, ["leader", "block"]).withColumn("sub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("subs") - 1)))
    sent = rest.withColumnRenamed("to", "block").join(subs, ["leader", "block"]).withColumn("sub", F.pmod(F.xxhash64("id"), "subs"))
    both = [x.select("leader", key, "id", "part", F.lit(n).alias("focus"), "shingles") for n, x in enumerate((every, sent))]
    return c.scratch(_verified(both[0].unionByName(both[1]), num, den))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 80, den: int = 100, table: np.ndarray = c.SPACED, block: tuple[int, int] = BLOCK) -> DataFrame:
    """(id, n_shingles, component) for each row of docs.

    Words are lower-cased (A-Z) runs split by table. Null and empty texts have no shingles and are linked
    with nothing. A row with a null id gets its count and a null component. Rows that repeat an id
    are one document: each gets a row, and its texts' links are joined. An empty table gives none.
    Ids are whole numbers or of any type that has an order. The sets of two compared texts are held whole.
    """
    texts = docs.select(c.id_column(docs, id_col)[0].alias("id"), F.col(text_col).alias("text"))
    with c.scratch_scope() as keep:
        found = keep(c.scratch(_features(texts, k, table)))
        real = found.where("n > 0 and id is not null")
        classes = real.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
        classes = c.scratch(classes)
        held = classes.select("rep", "n", F.explode("bands").alias("band"))
        # written, as total below, so that the joins read plain exchanges and a hot key can be split among tasks
        lead = c.scratch(held.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("many")).where("many > 1").select("band", "leader"))
        places = c.scratch(held.join(lead.hint("merge"), "band").select("leader", F.col("rep").alias("id"), "n").distinct())
        many = F.sum("n")
        size = F.greatest(F.lit(block[0]), F.least(F.lit(block[1]), 25 * F.sqrt(many)))
        total = c.scratch(places.groupBy("leader").agg(F.ceil(many / size).alias("blocks"), size.alias("size")))
        placed = places.join(total.hint("merge"), "leader").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
        spread = placed.where("id <> leader").select("leader", "block", "id", F.col("id").alias("part"), F.lit(0).alias("focus"))
        leads = total.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("leader").alias("id"), F.col("leader").alias("part"), F.lit(2).alias("focus"))
        firsts = texts.where("id is not null")
        rows = c.scratch(_with_sets(firsts, spread.unionByName(leads), k, table))
        links = c.scratch(_verified(rows, num, den))
        copies = real.join(classes.select("n", "s1", "s2", "rep").hint("merge"), ["n", "s1", "s2"])
        same = copies.select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b")

        if not total.where("blocks > 1").isEmpty() and (more := _across(rows, total, links, num, den)) is not None:
            links = links.unionByName(more)
        group = keep(c.scratch(components(links.unionByName(same))))

    return found.join(group.hint("merge"), "id", "left").select(
        F.col("id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component")
    )
