"""Near-duplicate classes by ProbMinHash over weighted word shingles.

Every distinct run of five words is an element whose weight is 1 + ln(count). It sends a Poisson process of arrivals,
at a rate of its weight, to registers drawn at random; a register keeps the element that arrives first, so two texts
agree in a register with the probability Jaccard similarity of their weighted shingles. An element stops sending as
soon as its next arrival comes after the latest time in any register (early termination); most elements of a long
text send one arrival.

The registers are cut into bands. What decides is the similarity of the plain sets of shingles, so a text with repeated
shingles has bands of registers at equal weights beside the weighted ones (without repeats both are the same): a heavily
repeated line parts two texts in the weighted bands only. Copies (texts of equal content) are one vertex. The vertices of a band bucket gather
around its least one; the groups of all leaders hold every two vertices that share a bucket. Within a group the exact
Jaccard similarity of two sets of shingles decides, at 0.8 or more a link. First every member meets its leader alone,
which settles a group of near copies at a cost linear in its members. Then what those links do not yet join is compared,
but for pairs that cannot be linked by the triangle inequality of the Jaccard distance: a group beyond BLOCK shingles
or VERTICES vertices is cut into blocks, and each two blocks are one task's matrix product, so no task holds more than
two blocks, and of the links only a spanning forest of each two blocks is emitted, not all pairs. Contracting the links
gives the classes; no link between vertices that share a bucket is left out, and there is no cap on groups.

Vertices are texts, whatever their ids: a class is that of its texts, and the ids only name it. The name of a class is
its least id, so classes of equal least ids (or of null ids alone) have the same name; ``classes`` tells them apart by
their least text.

Cases: null and empty texts (and texts without a word) are equal to one another only, and form one class; a text of
fewer than five words is one shingle; repeated rows are copies, and each gets its row; null ids come after all
others as names of classes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm._common import broadcast_if_small, materialize, shared_dir, text_key

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
M = BANDS * ROWS
#: Stands for a null id, after all others.
LAST = 2**63 - 1
#: Characters and texts handled at once; shingles and vertices of a block of a large group, and cells of a matrix; about how many letters a word has.
SLICE, TEXTS, BLOCK, VERTICES, CELLS, LETTERS = 1 << 19, 1000, 400_000, 1000, 4_000_000, 5
#: Rows of one text, band key or leader that a task takes; those of a larger group are dealt over parts.
MEMBERS = 2_000
#: Slack of comparisons of similarities, above what rounding can make.
SLACK = 2e-3
U = np.uint64
#: An odd base, and its inverse, for polynomial hashes modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWERS: dict[str, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; those of a slice are kept for the next call."""
    name, size = hex(base), max(n, SLICE)
    out = _POWERS.get(name)
    if out is None or len(out) < n:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if size == SLICE:
            _POWERS[name] = out
    return out[:n]


WHITE = re.compile(rb"[\t-\r ]")


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the place of every word: what ASCII white space parts. A long text goes through in slices that end at white space."""
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(raw):
        stop = len(raw)
        if stop - at > SLICE:
            found = WHITE.search(raw, at + SLICE)
            stop = found.start() if found else stop
        b = np.frombuffer(raw, np.uint8, stop - at, at)
        space = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
        start, end = edge[0::2], edge[1::2]
        if len(start):
            sums = np.zeros(len(b) + 1, np.uint64)
            np.add(b, 1, out=sums[1:], dtype=np.uint64)
            sums[1:] *= powers(BASE, len(b))
            np.cumsum(sums, out=sums)
            hashes.append(mix((sums[end] - sums[start]) * powers(INVERSE, len(b))[start] + (end - start).astype(np.uint64)))
            starts.append(start + at)
        at = stop
    return np.concatenate(hashes), np.concatenate(starts)


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts with the text of each and its count. Words are what white space separates, in lower case."""
    parts = [(t or "").lower().encode() for t in texts]
    word, start = words_of(b"\n\n".join(parts))
    if not len(word):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = np.searchsorted(np.cumsum([len(p) + 2 for p in parts]), start, "right")
    n = np.bincount(of, minlength=len(texts))
    first = np.cumsum(n) - n
    # runs of five words; a shorter text is one run
    size = np.minimum(n, SHINGLE)
    runs = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    doc = np.repeat(np.arange(len(texts)), runs)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + first[doc]
    h = np.zeros(len(doc), np.uint64)
    for k in range(SHINGLE):
        here = size[doc] > k
        h = np.where(here, mix(h * U(BASE) + word[np.minimum(at + k, len(word) - 1)] + U(k + 1)), h)
    ends = np.cumsum(runs)
    found = [np.unique(h[a:b], return_counts=True) for a, b in zip((ends - runs).tolist(), ends.tolist(), strict=True)]
    return np.concatenate([x[0] for x in found]), np.repeat(np.arange(len(texts)), [len(x[0]) for x in found]), np.concatenate([x[1] for x in found])


def signatures(h: np.ndarray, doc: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
    """Registers (texts x M) of winning elements, at weights 1 + ln(count); 0 where a text has no shingle. All texts go through their rounds of arrivals together."""
    best = np.full(texts * M, np.inf)
    who = np.zeros(texts * M, np.uint64)
    rate = 1.0 + np.log(count)
    t, live, k = np.zeros(len(h)), np.arange(len(h)), 0
    cap = np.full(texts, np.inf)
    while len(live):
        k += 1
        u = mix(h[live] + U(k * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        t[live] += -np.log((u >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / rate[live]
        live = live[t[live] < cap[doc[live]]]
        to = doc[live] * M + (mix(h[live] ^ U(k * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)) % U(M)).astype(np.int64)
        np.minimum.at(best, to, t[live])  # the least arrival at each register
        win = t[live] == best[to]
        who[to[win]] = h[live[win]]
        cap = best.reshape(texts, M).max(1) if texts else cap
        live = live[t[live] < cap[doc[live]]]
    return who.reshape(texts, M)


def bands_of(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, the band's number among what is hashed."""
    out = np.tile(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sig), 1))
    for r in range(ROWS):
        out = mix(out * U(BASE) + sig[:, r::ROWS])
    return out.view(np.int64)


def keys_of(h: np.ndarray, doc: np.ndarray, count: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of all texts, one after another, and how many each has: none without a shingle, twice as many with a repeated one."""
    plain = bands_of(signatures(h, doc, np.ones_like(count), texts))
    some = np.bincount(doc, minlength=texts) > 0
    many = np.flatnonzero(np.bincount(doc[count > 1], minlength=texts))
    number = np.where(some, BANDS, 0)
    number[many] *= 2
    at = np.cumsum(number) - number
    out = np.zeros(int(number.sum()), np.int64)
    out[(at[some][:, None] + np.arange(BANDS)).ravel()] = plain[some].ravel()
    if len(many):
        here = np.isin(doc, many)
        weighted = bands_of(signatures(h[here], np.searchsorted(many, doc[here]), count[here], len(many)))
        out[(at[many][:, None] + BANDS + np.arange(BANDS)).ravel()] = weighted.ravel()
    return out, number


def _runs(batch: pa.Array) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in batch.to_pylist():
        part.append(t)
        size += len(t or "")
        if size > SLICE or len(part) >= TEXTS:
            yield part
            part, size = [], 0
    if part:
        yield part


def band_keys(text: Column) -> Column:
    """``array<bigint>`` of band keys; null for a text without a word."""

    @F.arrow_udf("array<bigint>")
    def prob_min_hash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            keys, numbers = [], []
            for texts in _runs(batch):
                h, doc, n = shingles(texts)
                k, number = keys_of(h, doc, n, len(texts))
                keys.append(k)
                numbers.append(number)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            number = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
            at = pa.array(np.concatenate(([0], np.cumsum(number))).astype(np.int32), pa.int32(), mask=np.concatenate((number == 0, [False])))
            yield pa.ListArray.from_arrays(at, pa.array(flat, pa.int64()))

    return prob_min_hash(text)


def shingle_set(text: Column) -> Column:
    """``array<bigint>`` of the distinct shingle hashes."""

    @F.arrow_udf("array<bigint>")
    def shingle_hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets, sizes = [], []
            for texts in _runs(batch):
                h, doc, _ = shingles(texts)
                sets.append(h)
                sizes.append(np.bincount(doc, minlength=len(texts)))
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(1)
            yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64), pa.int64()))

    return shingle_hashes(text)


def spanning_links(v: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between these vertices: exact Jaccard similarities by a product of incidence matrices. Shingles that one set alone has only count towards sizes."""
    n = np.array([len(s) for s in sets], np.int64)
    names, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    column = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(sets)), n)
    keep = shared[at]
    row, col = row[keep], column[at[keep]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = int(shared.sum())
    step = max(1, CELLS // max(1, len(sets)))
    order = np.argsort(col, kind="stable") if width > step else slice(None)
    row, col = row[order], col[order]
    for lo in range(0, width, step):
        a, b = (np.searchsorted(col, (lo, lo + step))) if width > step else (0, len(col))
        m = np.zeros((len(sets), min(step, width - lo)), np.float32)
        m[row[a:b], col[a:b] - lo] = 1
        common += m @ m.T
    out, todo, size = [], np.ones(len(sets), bool), n.astype(np.float64)
    for first in range(len(sets)):
        if not todo[first]:
            continue
        todo[first] = False
        seeds = [first]
        while seeds:  # row by row: no second matrix of all pairs
            i = seeds.pop()
            near = np.flatnonzero(todo & (common[i] >= threshold * (size[i] + size - common[i]) - 1e-3))
            todo[near] = False
            seeds += near.tolist()
            out += [(int(v[i]), int(v[j])) for j in near]
    return out


def links_within(table: pa.Table, threshold: float) -> pa.Table:
    """Links of one task's rows (x, v, s): several small groups, or two blocks of a large one."""
    out: list[tuple[int, int]] = []
    x, v = table["x"].to_numpy(), table["v"].to_numpy()
    s = table["s"].combine_chunks()
    flat, ends = s.flatten().to_numpy(), np.cumsum(s.value_lengths().to_numpy())
    order = np.lexsort((v, x))
    cuts = np.flatnonzero(np.concatenate(([True], x[order][1:] != x[order][:-1], [True])))
    for a, b in zip(cuts, cuts[1:], strict=False):
        rows = order[a:b]
        if len(rows) > 1:
            out += spanning_links(v[rows], [flat[ends[r - 1] if r else 0 : ends[r]] for r in rows], threshold)
    return pa.table({"x": pa.array([min(p) for p in out], pa.int64()), "y": pa.array([max(p) for p in out], pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """(v, label) of the vertices of links (x, y): the least vertex of the component. Labels spread over links and jump along labels until none changes; each round is written to the shared folder."""
    links = materialize(links.distinct())
    both = links.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(links.select(F.col("y").alias("a"), F.col("x").alias("b")))
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("m"))
        own = labels.join(near.select(F.col("a").alias("v"), "m"), "v").select("v", F.col("label").alias("old"), F.least("label", "m").alias("l"))
        up = labels.select(F.col("v").alias("l"), F.col("label").alias("ll"))
        new = materialize(own.join(up, "l").select("v", F.least("l", "ll").alias("label"), "old"))
        changed = new.filter("label <> old").limit(1).count()
        labels = new.drop("old")
        if not changed:
            return labels


def parts_of(counts: DataFrame, *key: str) -> DataFrame:
    """(key, p) of the groups of more than MEMBERS rows (n), which are dealt over p parts. At most one row for each MEMBERS rows."""
    large = counts.filter(F.col("n") > MEMBERS).select(*key, F.ceil(F.col("n") / MEMBERS).cast("int").alias("p"))
    return broadcast_if_small(materialize(large))


def dealt(rows: DataFrame, parts: DataFrame, key: list[str], by: str) -> DataFrame:
    """Rows with the part z of their group that they fall into, by the hash of a column."""
    return rows.join(parts, key, "left").withColumn("z", F.pmod(F.xxhash64(by), F.coalesce("p", F.lit(1))).cast("int")).drop("p")


def spread(groups: DataFrame, parts: DataFrame, key: list[str]) -> DataFrame:
    """A row of each group for each of its parts z."""
    return groups.join(parts, key, "left").withColumn("z", F.explode(F.sequence(F.lit(0), F.coalesce("p", F.lit(1)) - 1))).drop("p")


def led(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """(x, v, common, n, m) of every member but the leader itself: shingles that it shares with the leader, and how many each has. ``sets`` has (v, s, xs), xs the leaders of v; ``parts`` are those of leaders."""
    leader = sets.filter(F.array_contains("xs", F.col("v"))).select(F.col("v").alias("x"), F.col("s").alias("l"))
    members = sets.select("v", "s", F.explode(F.array_remove("xs", F.col("v"))).alias("x"))
    return dealt(members, parts, ["x"], "v").join(spread(leader, parts, ["x"]), ["x", "z"]).select("x", "v", F.size(F.array_intersect("s", "l")).alias("common"), F.size("s").alias("n"), F.size("l").alias("m"))


def sets_of(vertices: DataFrame, texts: DataFrame) -> DataFrame:
    """(v, s, xs) of vertices (v, r, a, b, same, xs): their shingles, from the text of their id and address. Rows that are equal in both (``same`` counts them) are taken once."""
    found = texts.join(broadcast_if_small(vertices), ["r", "a", "b"])
    once = found.filter("same = 1").select("v", "xs", "t")
    if vertices.filter("same > 1").limit(1).count():
        once = once.unionByName(found.filter("same > 1").groupBy("v").agg(F.first("xs").alias("xs"), F.first("t").alias("t")))
    return once.select("v", shingle_set(F.col("t")).alias("s"), "xs")


def open_groups(member: DataFrame, near: DataFrame, labels: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """(x, z, v, size) of what is still to be compared within groups: pairs of different labels, but for pairs that their distances to the leader part.

    Jaccard distance is a metric, so a pair can be linked only if its distances to the leader differ by at most 1 -
    threshold. Members of the leader's label that are nearer to it than that from all of the others thus drop out."""
    label = member.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    rows = label.join(near.select("x", "v", "d"), ["x", "v"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    rows = materialize(rows)
    own = rows.filter("x = v").select("x", F.col("label").alias("own"))
    groups = rows.join(spread(own, parts, ["x"]), ["x", "z"]).filter("label <> own").groupBy("x", "own").agg(F.min("d").alias("least"))
    rows = materialize(rows.join(spread(groups, parts, ["x"]), ["x", "z"]).filter((F.col("label") != F.col("own")) | (F.col("d") >= F.col("least") - (1 - threshold) - SLACK)))
    left = rows.groupBy("x").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("x")
    return materialize(rows.join(spread(left, parts, ["x"]), ["x", "z"]).select("x", "z", "v", "size"))


def link_classes(vertices: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(v, label) for vertices (v, r, a, b, same, keys, size) that have a link to another. ``texts`` has (r, a, b, t); the text of a vertex is that of its id and address."""
    rows = vertices.select("v", F.explode("keys").alias("k"))
    lead = materialize(rows.groupBy("k").agg(F.min("v").alias("x"), F.count("*").alias("n")).filter("n > 1"))
    # a band key of very many vertices is met in parts, and so is a leader of very many members below
    common = parts_of(lead, "k")
    found = dealt(rows, common, ["k"], "v").join(spread(lead.select("k", "x"), common, ["k"]), ["k", "z"])
    # a vertex has few leaders, at most one for each of its band keys
    member = materialize(found.select("x", "v").distinct().join(vertices.select("v", "size"), "v"))
    parts = parts_of(member.groupBy("x").agg(F.count("*").alias("n")), "x")
    of = materialize(member.groupBy("v").agg(F.collect_list("x").alias("xs")).join(vertices.select("v", "r", "a", "b", "same"), "v"))
    sets = materialize(sets_of(of, texts))
    # first every member against its leader, which settles most groups at a cost linear in their members
    union = F.col("n") + F.col("m") - F.col("common")
    near = materialize(led(sets, parts).select("x", "v", (1 - F.col("common") / union).alias("d"), (F.col("common") >= threshold * union - 1e-3).alias("linked")))
    links = near.filter("linked").select(F.least("x", "v").alias("x"), F.greatest("x", "v").alias("y"))
    labels = components(links)
    member = open_groups(dealt(member, parts, ["x"], "v"), near, labels, parts, threshold)
    if not member.limit(1).count():
        return labels
    weight = F.col("size") + math.ceil(BLOCK / VERTICES)
    groups = materialize(member.groupBy("x").agg(F.sum(weight).alias("size")))
    total = groups.agg(F.sum("size")).first()[0]
    packs = math.ceil((total or 0) / BLOCK) + 1
    # a small group goes to a pack of such groups; a large one is cut into blocks, every two of which meet once
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    groups = groups.select(F.col("x"), blocks.alias("nb"))
    own = F.pmod(F.xxhash64("v"), F.col("nb")).cast("int")
    two = lambda i: F.struct(F.least(own, i).alias("i"), F.greatest(own, i).alias("j"))
    placed = member.join(spread(groups, parts, ["x"]), ["x", "z"]).select("v", "x", F.when(F.col("nb") == 1, F.array(F.struct(F.pmod(F.xxhash64("x"), F.lit(packs)).cast("int").alias("i"), F.lit(-1).alias("j")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), two)).alias("at"))
    cells = placed.select("v", F.explode("at").alias("c"), "x").select("v", F.when(F.col("c.j") < 0, F.lit(0)).otherwise(F.col("x")).alias("g"), "c.i", "c.j", "x")
    found = cells.join(sets.select("v", "s"), "v").groupBy("g", "i", "j").applyInArrow(lambda t: links_within(t, threshold), "x bigint, y bigint")
    return components(links.unionByName(found))


def address(text: Column) -> Column:
    """The content address of a text; texts without a word have the same."""
    return text_key(F.when(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s]+", " ")) == "", F.lit("")).otherwise(text))


def classes(docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: id, v (the id, the greatest integer for null), r (least v among equal texts), and the class as its least (cv, ca, cb): id and content address."""
    shared_dir(docs.sparkSession)
    v = F.coalesce(F.col(doc).cast("bigint"), F.lit(LAST))
    key = address(F.col(text))
    hashed = docs.select(F.col(doc).alias("id"), v.alias("v"), key["a"].alias("a"), key["b"].alias("b"), (F.octet_length(F.coalesce(F.col(text), F.lit(""))) / LETTERS + 1).cast("bigint").alias("size"), band_keys(F.col(text)).alias("keys"))
    # rows are numbered as they are written
    hashed = materialize(hashed.withColumn("w", F.monotonically_increasing_id()))
    copies = materialize(hashed.groupBy("a", "b").agg(F.min("v").alias("r"), F.min("w").alias("u"), F.count("*").alias("n")))
    parts = parts_of(copies, "a", "b")
    repeated = spread(copies.filter("n > 1"), parts, ["a", "b"])
    # one vertex for each distinct text: the row of least number
    rows = dealt(hashed, parts, ["a", "b"], "w").join(repeated, ["a", "b", "z"], "left").withColumns({"r": F.coalesce("r", "v"), "u": F.coalesce("u", "w")})
    first = rows.filter("u = w AND keys IS NOT NULL").select(F.col("w").alias("v"), "r", "a", "b", "keys", "size")
    # how many rows have both the least id and the text
    same = materialize(rows.filter("n > 1 AND v = r").groupBy("a", "b").agg(F.count("*").alias("same")))
    first = first.join(same, ["a", "b"], "left").withColumn("same", F.coalesce("same", F.lit(1)))
    texts = docs.select(v.alias("r"), key["a"].alias("a"), key["b"].alias("b"), F.col(text).alias("t"))
    labels = link_classes(first, texts, threshold)
    # a class is named by the least of its texts
    named = materialize(first.select(F.col("v").alias("u"), "r", "a", "b").join(labels.withColumnRenamed("v", "u"), "u"))
    least = named.groupBy("label").agg(F.min(F.struct("r", "a", "b")).alias("c"))
    named = spread(named.join(least, "label"), parts, ["a", "b"]).select("u", "z", "c")
    out = rows.select("id", "v", "a", "b", "r", "u", "z").join(named, ["u", "z"], "left").withColumn("c", F.coalesce("c", F.struct("r", "a", "b")))
    return out.select("id", "v", "a", "b", "r", F.col("c.r").alias("cv"), F.col("c.a").alias("ca"), F.col("c.b").alias("cb"))


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (the least id of the class), copy_of (the least id among equal texts)."""
    name = lambda c: F.when(F.col(c) == LAST, F.lit(None)).otherwise(F.col(c)).cast("bigint")
    return classes(docs, doc, text, threshold).select(F.col("id").alias("doc_id"), name("cv").alias("class_id"), name("r").alias("copy_of"))
