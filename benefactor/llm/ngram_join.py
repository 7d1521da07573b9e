"""N-gram Jaccard join with adaptive multi-match prefixes: exact links, classes and components.

Two documents link when the Jaccard similarity of their shingle sets reaches the threshold. With
shingles in one global order (rare first), let x need at least o(x) common shingles with any
partner. If x and y link, their first m common shingles, m = min(l(x), l(y)), lie within the
first n - o + l shingles of each. So each document chooses its own l: a longer prefix scans
more, but demands more shared shingles before a pair is verified. The choice minimises an
estimate of scanned entries plus verifications.

Steps, each distributed:
1. Frequency classes of the most frequent shingles, from counts over all texts. Any table gives
   a valid order, so its bounded size costs time at most, never a link.
2. Equal sets become one class; the least doc_id stands for it. Prefixes of the representatives
   are dealt by shingle ranges; entries that nobody shares are dropped, and documents with too
   few shared entries leave.
3. Hub rounds: in each bucket one document is the hub; others in other components are verified
   against the hub with which they share most, and links are contracted. A group of thousands
   of near copies falls together in a few rounds, without its pairs being listed.
4. What remains open is decided inside tasks. A bucket is cut into blocks of bounded size; a task
   has two blocks, counts the entries that their documents share as a product of matrices, and
   says which documents have a partner to verify. These come once more, with their whole sets, in
   blocks of bounded bytes, and links leave as a spanning forest. No pair is ever a row.
No candidate is dropped at any step: pairs inside one component need no check.

Edge cases: a text that is null or without words has an empty set, 0 shingles and itself as
component; fewer words than the width give one shingle of all words; a text is known by its
hash, so rows that share a doc_id may hold different texts, each with links of its own; a row
without a doc_id takes part like others and never names a component that has another row with
one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benefactor.llm import blocks, hashing
from benefactor.llm.common import PLAIN_WORD, cut_lineage, pick, text_hash, tidy, utf8


@dataclass(frozen=True)
class JoinParams:
    width: int = 5  # words in a shingle
    numerator: int = 80  # links have 100 * common >= 80 * union
    denominator: int = 100
    table: int = 1 << 20  # shingles with a frequency class, sent to every worker (8 bytes each)
    verify_cost: float = 20.0  # of a pair, in scanned prefix entries
    max_match: int = 64
    range_bytes: int = 6 << 20  # of text, for each range of shingles
    broadcast_rows: int = 1 << 17  # rows of three longs that may be broadcast; beyond it joins shuffle
    task_edges: int = 1 << 18  # edges between components that one task contracts; more take rounds
    hot_class: int = 12  # shingles in 2**12 documents or more go to their buckets without being gathered first
    rounds: int = 1  # hub rounds before what remains open is met in blocks
    hubs: int = 16  # of a bucket in a round
    tries: int = 4  # hubs that a document is verified against in a round
    block_docs: int = 512  # of a bucket, met at a time
    block_bytes: int = 1 << 20  # of whole sets, met at a time


# ---- packed arrays -------------------------------------------------------------------------


def _planes(values: np.ndarray) -> bytes:
    """Unsigned integers byte plane by byte plane, as many planes as the largest needs."""
    values = values.astype(np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    raw = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return struct.pack("<IB", len(values), width) + zlib.compress(raw, 1)


def _unplanes(blob: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<IB", blob)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(zlib.decompress(blob[5:]), np.uint8).reshape(width, n).T
    return out.view(np.uint64).reshape(-1)


def _ascending(values: np.ndarray) -> bytes:
    return _planes(np.diff(values, prepend=np.uint64(0)))


def _unascending(blob: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(blob), dtype=np.uint64)


def _range_of(tokens: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    return ((tokens >> np.uint64(bits - 32)) * np.uint64(ranges)) >> np.uint64(32)


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


# ---- 1. frequency classes ------------------------------------------------------------------


@dataclass
class FrequencyTable:
    """Frequent shingles (their upper `bits`), sorted, with floor(log2(document frequency))."""

    bits: int
    tokens: np.ndarray
    classes: np.ndarray
    rest: float  # mean frequency of the shingles outside

    def of(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(tokens), np.uint8)
        short = tokens >> np.uint64(64 - self.bits)
        at = np.minimum(np.searchsorted(self.tokens, short), len(self.tokens) - 1)
        return np.where(self.tokens[at] == short, self.classes[at], 0).astype(np.uint8)


def _sets(batch: pa.RecordBatch, column: int, width: int):
    data, bounds = utf8(batch.column(column))
    for a, b in hashing.batches(bounds):
        yield from hashing.shingle_sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], width)


def frequencies(docs: DataFrame, total_bytes: int, params: JoinParams) -> FrequencyTable:
    """Counts over all texts: packed runs of sorted shingles are dealt by ranges and merged."""
    bits = min(64, max(40, total_bytes.bit_length() + 12))
    ranges = max(1, -(-total_bytes // params.range_bytes))
    shift, width = np.uint64(64 - bits), params.width

    def deal(batches):
        held, size = [], 0

        def flush():
            tokens = np.sort(np.concatenate(held))
            first = _runs(tokens)
            counts = np.diff(first, append=len(tokens))
            tokens = tokens[first]
            place = _range_of(tokens, bits, ranges)
            edges = np.append(_runs(place), len(tokens))
            rows = [(int(place[a]), _ascending(tokens[a:b]), _planes(counts[a:b] - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            names = ["range", "tokens", "counts"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32(), pa.binary(), pa.binary()], strict=True)], names)

        for batch in batches:
            for s in _sets(batch, 0, width):
                held.append(s >> shift)
                size += len(s)
                if size >= 1 << 20:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        tokens = np.concatenate([_unascending(b.as_py()) for b in table["tokens"]])
        counts = np.concatenate([_unplanes(b.as_py()) for b in table["counts"]]) + np.uint64(1)
        order = np.argsort(tokens, kind="stable")
        tokens, counts = tokens[order], counts[order]
        first = _runs(tokens)
        counts, tokens = np.add.reduceat(counts, first), tokens[first]
        classes = np.log2(counts.astype(float)).astype(np.int64)
        rows = [(int(c), int(m.sum()), int(counts[m].sum()), _ascending(tokens[m])) for c in np.unique(classes) if (m := classes == c).any()]
        rows = [r if r[0] else (*r[:3], b"") for r in rows]  # shingles of one document are only counted
        return pa.table({k: pa.array(v, t) for (k, t), v in zip(kinds, zip(*rows, strict=True), strict=True)})

    kinds = [("class", pa.int32()), ("n", pa.int64()), ("entries", pa.int64()), ("tokens", pa.binary())]
    dealt = docs.select("text").mapInArrow(deal, "range int, tokens binary, counts binary")
    merged = cut_lineage(dealt.groupBy("range").applyInArrow(merge, "class int, n long, entries long, tokens binary"))
    sizes = {r["class"]: (r["n"], r["entries"]) for r in merged.groupBy("class").agg(F.sum("n").alias("n"), F.sum("entries").alias("entries")).collect()}
    least, room = 64, params.table
    for c in sorted(sizes, reverse=True):
        if not c or sizes[c][0] > room:
            break
        least, room = c, room - sizes[c][0]
    got = merged.where(F.col("class") >= least).select("class", "tokens").collect()  # `table` shingles at most
    tokens = np.concatenate([np.zeros(0, np.uint64), *[_unascending(bytes(r["tokens"])) for r in got]])
    classes = np.concatenate([np.zeros(0, np.uint8), *[np.full(_count(bytes(r["tokens"])), r["class"], np.uint8) for r in got]])
    order = np.argsort(tokens, kind="stable")
    outside = [sizes[c] for c in sizes if c < least]
    rest = sum(e for _, e in outside) / max(1, sum(n for n, _ in outside)) if outside else 1.0
    return FrequencyTable(bits, tokens[order], classes[order], max(1.0, rest))


def _count(blob: bytes) -> int:
    return struct.unpack_from("<I", blob)[0]


# ---- 2. prefixes and buckets ---------------------------------------------------------------


def adaptive_prefix(tokens: np.ndarray, table: FrequencyTable, params: JoinParams) -> tuple[int, int, np.ndarray]:
    """The number of matches to demand, l; where the first n - o + l shingles end in the order; they, sorted by value."""
    n = len(tokens)
    least = -(-n * params.numerator // params.denominator)
    base = n - least
    classes = table.of(tokens)
    order = np.argsort(classes, kind="stable")  # rare first; shingles of a class by value
    most = min(params.max_match, least)
    head = order[: base + most]
    cost = np.cumsum(np.where(classes[head] > 0, 1.5 * 2.0 ** classes[head], table.rest))
    match = np.arange(1, most + 1)
    best = int(np.argmin(cost[base : base + most] * (1 + params.verify_cost / match))) + 1
    last = head[base + best - 1]
    edge = int(classes[last]) << 57 | int(tokens[last]) >> 7  # class, then value: a positive long
    return best, edge, np.sort(tokens[head[: base + best]])


def prefixes(docs: DataFrame, table: FrequencyTable, params: JoinParams) -> DataFrame:
    """doc_id, a and b (the text's hash), n, key (16 bytes of the set; null if empty), match, edge and prefix of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = ["doc_id", "a", "b", "n", "key", "match", "edge", "prefix"]

    def run(batches):
        table = shared.value
        for batch in batches:
            rows = []
            for s in _sets(batch, 3, params.width):
                if len(s):
                    match, edge, prefix = adaptive_prefix(s, table, params)
                    rows.append((len(s), _key(s), match, edge, prefix.tobytes()))
                else:
                    rows.append((0, None, 0, 0, None))
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return docs.select("doc_id", "a", "b", "text").mapInArrow(run, "doc_id long, a long, b long, n long, key binary, match int, edge long, prefix binary")


def _key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def buckets(reps: DataFrame, ranges: int, table: FrequencyTable, params: JoinParams) -> DataFrame:
    """token and doc of the prefix entries whose shingle may stand in two prefixes or more.

    Entries are gathered by ranges of shingles, and those that nobody shares leave. Frequent
    shingles are not gathered: their entries go straight on, so a range holds no hot shingle.
    """
    shared = reps.sparkSession.sparkContext.broadcast(table)

    def parts(batches):
        for batch in batches:
            docs = batch.column(0).to_numpy().astype(np.uint64)
            tokens = blocks.longs(batch.column(1))
            at = 0
            while at < len(tokens):
                end, size = at, 0
                while end < len(tokens) and (end == at or size + len(tokens[end]) <= 1 << 18):
                    size += len(tokens[end])
                    end += 1
                every = np.concatenate(tokens[at:end])
                owner = np.repeat(docs[at:end], [len(t) for t in tokens[at:end]])
                order = np.argsort(every, kind="stable")
                yield every[order], owner[order]
                at = end

    def deal(batches):
        table = shared.value
        for every, owner in parts(batches):
            rare = table.of(every) < params.hot_class
            every, owner = every[rare], owner[rare]
            place = _range_of(every, 64, ranges)
            edges = np.append(_runs(place), len(every))
            rows = [(int(place[a]), _ascending(every[a:b]), _planes(owner[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            if rows:
                kinds = [pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["range", "tokens", "docs"])

    def frequent(batches):
        table = shared.value
        for every, owner in parts(batches):
            hot = table.of(every) >= params.hot_class
            if hot.any():
                yield pa.RecordBatch.from_arrays([pa.array(every[hot].view(np.int64)), pa.array(owner[hot].view(np.int64))], ["token", "doc"])

    def meet(table: pa.Table) -> pa.Table:
        tokens = np.concatenate([_unascending(b.as_py()) for b in table["tokens"]])
        docs = np.concatenate([_unplanes(b.as_py()) for b in table["docs"]])
        order = np.argsort(tokens, kind="stable")
        ordered = tokens[order]
        first = _runs(ordered)
        sizes = np.diff(first, append=len(ordered))
        kept = order[np.repeat(sizes > 1, sizes)]
        return pa.table({"token": pa.array(tokens[kept].view(np.int64)), "doc": pa.array(docs[kept].view(np.int64))})

    entries = reps.select("doc", "prefix")
    rare = entries.mapInArrow(deal, "range int, tokens binary, docs binary").groupBy("range").applyInArrow(meet, "token long, doc long")
    return rare.union(entries.mapInArrow(frequent, "token long, doc long"))


def possible(entries: DataFrame, params: JoinParams) -> DataFrame:
    """doc and reach of the documents that share enough entries with some partner in their buckets.

    reach bounds the overlap with any document whose prefix ends later in the order: such a one
    has what it shares of this prefix in its own, so entries that stand in no other prefix are
    not shared, and the rest is the suffix.
    """
    # a pair of x shares at most as many entries as x has in buckets
    fewest = entries.groupBy("token").agg(F.min("match").alias("fewest"))
    each = entries.join(fewest, "token").groupBy("doc").agg(
        F.count("*").alias("entries"), F.min("fewest").alias("need"), F.max("n").alias("n"), F.max("match").alias("match")
    )
    length = F.col("n") - F.ceil(F.col("n") * params.numerator / params.denominator - 1e-9) + F.col("match")
    reach = F.least(F.col("n"), F.col("n") - length + F.col("entries"))
    return each.where(F.col("entries") >= F.col("need")).select("doc", reach.cast("int").alias("reach"))


# ---- 3. and 4. verification and components -------------------------------------------------


def _small(df: DataFrame, rows: int, params: JoinParams) -> DataFrame:
    return F.broadcast(df) if rows <= params.broadcast_rows else df


def token_sets(docs: DataFrame, reps: DataFrame, n_reps: int, params: JoinParams) -> DataFrame:
    """doc and its whole shingle set, for the classes in `reps` (doc, doc_id, a, b).

    The row is found by its text's hash and its id. Where rows repeat, a task sends the set once, so
    a set may come more than once, but never as often as a hot text.
    """
    wanted = reps.select("doc", F.col("doc_id").alias("its_id"), F.col("a").alias("its_a"), F.col("b").alias("its_b"))
    held = docs.join(
        _small(wanted, n_reps, params), (F.col("a") == F.col("its_a")) & (F.col("b") == F.col("its_b")) & F.col("doc_id").eqNullSafe(F.col("its_id"))
    )

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            docs, fresh = batch.column(0).to_pylist(), []
            for doc in docs:
                fresh.append(doc not in seen)
                seen.add(doc)
            new = batch.filter(pa.array(fresh, pa.bool_()))
            yield pa.RecordBatch.from_arrays([new.column(0), pa.array([s.tobytes() for s in _sets(new, 1, params.width)], pa.binary())], ["doc", "tokens"])

    return held.select("doc", "text").mapInArrow(run, "doc long, tokens binary")


def verified(pairs: DataFrame, n_pairs: int, sets: DataFrame, params: JoinParams) -> DataFrame:
    """The pairs (x, y) whose sets are similar enough."""
    slim = pairs.select("x", "y")
    left = sets.join(_small(slim, n_pairs, params), F.col("doc") == F.col("x")).select("x", "y", F.col("tokens").alias("tx"))
    wanted = slim.select(F.col("y").alias("wanted")).distinct()
    right = sets.join(_small(wanted, n_pairs, params), F.col("doc") == F.col("wanted"), "left_semi").select(F.col("doc").alias("hub"), F.col("tokens").alias("ty"))
    met = left.join(right, F.col("y") == F.col("hub")).select("x", "y", "tx", "ty")
    num, den = params.numerator, params.denominator

    def run(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                both = np.sort(np.concatenate([s, t]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(den * common >= num * (len(both) - common))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["x", "y"])

    return met.mapInArrow(run, "x long, y long").distinct()


def contract(labels: DataFrame, links: DataFrame, n_labels: int, params: JoinParams) -> DataFrame:
    """labels (doc, comp) after joining the components of linked documents; comp is the least.

    Links become edges between components. Up to `task_edges` of them, counted, are contracted in
    one task; more in rounds: each hooks every component to its least neighbour and follows the
    pointers twice, so that chains shrink by their power.
    """
    small = _small(labels, n_labels, params)
    a = small.select(F.col("doc").alias("x"), F.col("comp").alias("cx"))
    b = small.select(F.col("doc").alias("y"), F.col("comp").alias("cy"))
    edges = cut_lineage(links.join(a, "x").join(b, "y").where("cx <> cy").select(F.least("cx", "cy").alias("low"), F.greatest("cx", "cy").alias("high")).distinct())
    n_edges = edges.count()
    if not n_edges:
        return labels
    if n_edges <= params.task_edges:
        up = _small(edges.repartition(1).mapInArrow(_roots, "c long, p long"), n_edges, params)
        return cut_lineage(labels.join(up.withColumnRenamed("c", "comp"), "comp", "left").select("doc", F.coalesce("p", "comp").alias("comp")))
    while not edges.isEmpty():
        ends = edges.select(F.col("low").alias("c"), F.col("high").alias("o")).union(edges.select(F.col("high").alias("c"), F.col("low").alias("o")))
        up = cut_lineage(ends.groupBy("c").agg(F.least("c", F.min("o")).alias("p")))
        for _ in range(2):
            jump = up.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            up = up.join(jump, "p", "left").select("c", F.coalesce("pp", "p").alias("p"))
        labels = labels.join(up.select(F.col("c").alias("comp"), "p"), "comp", "left").select("doc", F.coalesce("p", "comp").alias("comp"))
        lows = up.select(F.col("c").alias("low"), F.col("p").alias("pl"))
        highs = up.select(F.col("c").alias("high"), F.col("p").alias("ph"))
        edges = cut_lineage(
            edges.join(lows, "low").join(highs, "high").where("pl <> ph").select(F.least("pl", "ph").alias("low"), F.greatest("pl", "ph").alias("high")).distinct()
        )
    return cut_lineage(labels)


def _roots(batches):
    """Of edges (low, high) the nodes that are not their component's least, and that: c, p."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    low, high = (np.concatenate(side) for side in zip(*held, strict=True))
    nodes, place = np.unique(np.concatenate([low, high]), return_inverse=True)
    low, high, root = place[: len(low)], place[len(low) :], np.arange(len(nodes))
    while True:
        a, b = root[low], root[high]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["c", "p"])


#: A value of a document or hub by its name.
Value = Callable[[str], Column]


def _earlier(x: Value, y: Value, a: Column, b: Column) -> Column:
    """For a document and a hub the value of the document whose prefix ends earlier in the order; the greater one if they end alike."""
    return F.when(x("edge") < y("edge"), a).when(y("edge") < x("edge"), b).otherwise(F.greatest(a, b))


def _fits(x: Value, y: Value, params: JoinParams) -> Column:
    """Whether the overlap that can be reached at most is enough for the sizes."""
    low = F.least(x("n"), y("n"))
    sizes = low * params.denominator >= F.greatest(x("n"), y("n")) * params.numerator
    most = F.least(_earlier(x, y, x("reach"), y("reach")), low)
    return sizes & (most * (params.denominator + params.numerator) >= (x("n") + y("n")) * params.numerator)


def _need(x: Value, y: Value, params: JoinParams) -> Column:
    """Prefix entries that a pair must share: the lesser demand of the two, and what the overlap
    that the sizes ask for has beyond the suffix of the prefix that ends earlier."""

    def rest(of: Value) -> Column:
        return F.ceil(of("n") * params.numerator / params.denominator - 1e-9) - of("match")

    overlap = F.ceil((x("n") + y("n")) * params.numerator / (params.denominator + params.numerator) - 1e-9)
    return F.greatest(F.least(x("match"), y("match")), overlap - _earlier(x, y, rest(x), rest(y)))


def components(docs: DataFrame, reps: DataFrame, entries: DataFrame, params: JoinParams) -> DataFrame:
    """doc and comp of every class in `reps` that shares enough prefix entries with some other."""
    first = cut_lineage(possible(entries, params).select("doc"))
    held = entries.join(_small(first, first.count(), params), "doc", "left_semi")
    several = held.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token")
    held = cut_lineage(held.join(several, "token", "left_semi"))
    active = cut_lineage(possible(held, params))
    n_active = active.count()
    entries = cut_lineage(_collapsed(held.join(_small(active, n_active, params), "doc")))
    own = reps.select("doc", "doc_id", "a", "b").join(_small(active.select("doc"), n_active, params), "doc", "left_semi")
    sets = cut_lineage(token_sets(docs, own, n_active, params))
    labels = cut_lineage(active.select("doc", F.col("doc").alias("comp")))
    for turn in range(params.rounds + 1):
        marked = entries.join(_small(labels, n_active, params), "doc")
        open_ = marked.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token")
        marked = cut_lineage(marked.join(open_, "token", "left_semi"))
        if turn < params.rounds:
            pairs = cut_lineage(_to_hubs(marked, turn, params))
            links = verified(pairs, pairs.count(), sets, params)
        else:
            links = _met(marked, sets, params)
        labels = contract(labels, links, n_active, params)
        tidy(docs.sparkSession)
    return labels


def _collapsed(entries: DataFrame) -> DataFrame:
    """The entries of one token for all tokens with the same documents, and how many these are, `weight`.

    Near copies share runs of shingles, whose buckets are equal; documents are compared by three
    commutative sums of hashes, so no bucket is gathered.
    """
    held = cut_lineage(entries)
    same = held.groupBy("token").agg(
        F.count("*").alias("m"),
        F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("a"),
        F.bit_xor(F.xxhash64("doc", F.lit(2))).alias("b"),
        F.sum(F.pmod(F.xxhash64("doc", F.lit(3)), F.lit(1 << 31))).alias("c"),
    )
    chosen = same.where("m > 1").groupBy("m", "a", "b", "c").agg(F.min("token").alias("token"), F.count("*").alias("weight"))
    return held.join(chosen.select("token", "weight"), "token")


def _to_hubs(marked: DataFrame, turn: int, params: JoinParams) -> DataFrame:
    """x and y: for each document the hubs of other components with which it shares most entries.

    A bucket's documents are dealt into `hubs` slots by a hash; the least hash of each is a hub. An
    entry meets its bucket's hubs as one list, and a document's lists are counted inside a task.
    """
    chance = F.xxhash64("doc", F.lit(turn))
    hubs = marked.groupBy("token", F.pmod(chance, F.lit(params.hubs)).alias("slot")).agg(
        F.min(F.struct(chance.alias("p"), "doc", "comp", "n", "match", "edge", "reach")).alias("h")
    )
    lists = hubs.groupBy("token").agg(F.collect_list("h").alias("hubs"))
    others = F.filter("hubs", lambda h: (F.col("comp") != h["comp"]) & _fits(F.col, h.getField, params))
    asked = F.transform(others, lambda h: F.struct(h["doc"].alias("y"), _need(F.col, h.getField, params).cast("long").alias("need")))
    met = marked.join(lists, "token").select(F.col("doc").alias("x"), F.col("weight").cast("long").alias("weight"), asked.alias("asked"))
    return met.repartition("x").sortWithinPartitions("x").mapInArrow(lambda batches: _nearest(batches, params), "x long, y long")


def _nearest(batches, params: JoinParams):
    """For each document the `tries` hubs with which it shares most, among those with enough: x, y."""
    for part in blocks.whole(batches):
        lists = part.column(2)
        y, need = (c.to_numpy() for c in lists.flatten().flatten())
        row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
        x, weight = part.column(0).to_numpy()[row], part.column(1).to_numpy()[row]
        order = np.lexsort((y, x))
        x, y, need, weight = x[order], y[order], need[order], weight[order]
        first = np.union1d(_runs(x), _runs(y))
        if not len(first):
            continue
        shared, x, y, need = np.add.reduceat(weight, first), x[first], y[first], need[first]
        enough = shared >= need
        shared, x, y = shared[enough], x[enough], y[enough]
        order = np.lexsort((-y, -shared, x))
        x, y = x[order], y[order]
        starts = _runs(x)
        rank = np.arange(len(x)) - np.repeat(starts, np.diff(starts, append=len(x)))
        best = rank < params.tries
        yield pa.RecordBatch.from_arrays([pa.array(x[best]), pa.array(y[best])], ["x", "y"])


def _met(marked: DataFrame, sets: DataFrame, params: JoinParams) -> DataFrame:
    """Links x, y that join all documents of different components that are similar enough.

    A pair belongs to one bucket: of those that it shares, the first in one order of all buckets (the
    largest first, so that few buckets have the pairs of a large group). Behind that bucket a document
    still needs entries enough for the pair's demand, so it goes only to buckets with so much behind them.
    """
    sizes = marked.groupBy("token").agg(F.count("*").alias("m"), F.min("match").alias("fewest"))
    held = marked.join(sizes, "token")
    first = [F.first(c).alias(c) for c in ("comp", "n", "match", "edge", "reach")]
    lists = held.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("m", "token", "weight", "fewest")), False).alias("own"), *first)
    lists = lists.select("doc", "comp", "n", "match", "edge", "reach", *[F.col(f"own.{c}").alias(c) for c in ("m", "token", "weight", "fewest")])
    schema = "token long, low int, high int, slot int, doc long, comp long, n int, match int, edge long, reach int, own binary, weights binary"
    units = lists.mapInArrow(lambda batches: _to_units(batches, params), schema)
    tried = _by_unit(units).mapInArrow(lambda batches: _partners(batches, params), "token long, doc long, comp long, n int")
    tried = cut_lineage(tried.distinct())
    total = tried.groupBy("token").agg(F.sum("n").alias("total"))
    slots = F.ceil(F.col("total") * 8 / params.block_bytes).cast("int")
    placed = tried.join(total, "token").withColumn("slots", slots).withColumn("slot", F.pmod(F.xxhash64("doc"), F.col("slots")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("slots") - 1))
    placed = placed.select("token", "slot", "doc", "comp", "n", other.alias("other"))
    placed = placed.select("token", F.least("slot", "other").alias("low"), F.greatest("slot", "other").alias("high"), "slot", "doc", "comp", "n")
    whole = placed.join(sets, "doc").select("token", "low", "high", "slot", "doc", "comp", "n", "tokens")
    return _by_unit(whole).mapInArrow(lambda batches: _links(batches, params), "x long, y long").distinct()


def _by_unit(rows: DataFrame) -> DataFrame:
    unit = ("token", "low", "high")
    return rows.repartition(*unit).sortWithinPartitions(*unit)


def _to_units(batches, params: JoinParams):
    """A row for each unit that a document takes part in: its numbers, its tokens in order, and their weights."""
    names = ["token", "low", "high", "slot", "doc", "comp", "n", "match", "edge", "reach", "own", "weights"]
    for batch in batches:
        doc = batch.column(0).to_numpy().astype(np.uint64)
        match = batch.column(3).to_numpy()
        columns: list[list] = [[] for _ in range(7)]
        for i in range(batch.num_rows):
            m, token, weight, fewest = (batch.column(c)[i].values.to_numpy() for c in (6, 7, 8, 9))
            behind = np.cumsum(weight[::-1])[::-1]
            goes = np.flatnonzero(behind >= np.minimum(match[i], fewest))
            slots = -(-m[goes] // params.block_docs)
            slot = blocks.slot_of(np.full(len(goes), doc[i]), slots)
            at = np.repeat(np.arange(len(goes)), slots)
            other = np.arange(len(at)) - np.repeat(np.cumsum(slots) - slots, slots)
            own, weights = token.astype(np.int64).tobytes(), weight.astype(np.int64).tobytes()
            values = (token[goes][at], np.minimum(slot[at], other), np.maximum(slot[at], other), slot[at], np.full(len(at), i), [own] * len(at), [weights] * len(at))
            for column, value in zip(columns, values, strict=True):
                column.extend(value)
        row = pa.array(columns[4], pa.int64())
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), None, pa.binary(), pa.binary()]
        made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True) if k is not None]
        yield pa.RecordBatch.from_arrays([*made[:4], *[batch.column(c).take(row) for c in range(6)], *made[4:]], names)


def _across(unit: pa.RecordBatch, slot: int, comp: int) -> np.ndarray:
    """Which pairs of a unit are its own: of two slots, or of one if the unit has one; in different components."""
    slots, comps = unit.column(slot).to_numpy(), unit.column(comp).to_numpy()
    apart = comps[:, None] != comps[None, :]
    if unit.column(1)[0].as_py() != unit.column(2)[0].as_py():
        apart &= slots[:, None] != slots[None, :]
    return apart


def _partners(batches, params: JoinParams):
    """Of each unit the documents that have a partner to be verified there: token, doc, comp, n."""
    num, den = params.numerator, params.denominator
    for unit in blocks.runs(batches, 3):
        if unit.num_rows < 2 or not (apart := _across(unit, 3, 5)).any():
            continue
        n, match, edge, reach = (unit.column(c).to_numpy().astype(np.int64) for c in (6, 7, 8, 9))
        ends = np.sign(edge[:, None] - edge[None, :])

        def earlier(v: np.ndarray, ends: np.ndarray = ends) -> np.ndarray:
            """For each pair the value of the document whose prefix ends earlier; the greater one if they end alike."""
            return np.where(ends < 0, v[:, None], np.where(ends > 0, v[None, :], np.maximum(v[:, None], v[None, :])))

        low, both = np.minimum(n[:, None], n[None, :]), n[:, None] + n[None, :]
        apart &= (low * den >= np.maximum(n[:, None], n[None, :]) * num) & (np.minimum(earlier(reach), low) * (den + num) >= both * num)
        if not apart.any():
            continue
        need = np.maximum(np.minimum(match[:, None], match[None, :]), -(-both * num // (den + num)) - earlier(-(-n * num // den) - match))
        own, weights = blocks.longs(unit.column(10)), blocks.longs(unit.column(11))
        token = np.int64(unit.column(0)[0].as_py()).astype(np.uint64)
        before = [v[: int(np.flatnonzero(v == token)[0])] for v in own]
        apart &= (blocks.shared(own, weights) >= need) & (blocks.shared(before) == 0)
        met = pa.array(apart.any(axis=1))
        yield unit.select([0, 4, 5, 6]).filter(met)


def _links(batches, params: JoinParams):
    """The links of each unit, as a spanning forest."""
    for unit in blocks.runs(batches, 3):
        apart = _across(unit, 3, 5)
        if not apart.any():
            continue
        n = unit.column(6).to_numpy().astype(np.int64)
        common = blocks.shared(blocks.longs(unit.column(7)))
        union = n[:, None] + n[None, :] - common
        edges = blocks.forest(apart & (params.denominator * common >= params.numerator * union))
        doc = unit.column(4).to_numpy()
        a, b = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[a], doc[b])), pa.array(np.maximum(doc[a], doc[b]))], ["x", "y"])


def _classes(rows: DataFrame, params: JoinParams) -> tuple[DataFrame, DataFrame]:
    """For rows (doc_id, a, b, text): each with n and key; and for each key `first`, the least row of the class, and `least`, that of the component.

    Both are structs (lone: without an id, doc_id, a, b), so rows with an id come first.
    """
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    table = frequencies(rows, total, params)
    own = cut_lineage(prefixes(rows, table, params))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lone"), "doc_id", "a", "b", "n", "match", "edge", "prefix"))
    reps = own.where("key is not null").groupBy("key").agg(first.alias("r")).select("key", "r.*")
    reps = cut_lineage(reps.withColumn("doc", F.monotonically_increasing_id()))  # numbered, then written: numbers stay
    shared = buckets(reps, max(1, -(-total // (4 * params.range_bytes))), table, params)
    entries = cut_lineage(shared.join(reps.select("doc", F.col("n").cast("int").alias("n"), "match", "edge"), "doc"))
    labels = components(rows, reps, entries, params)
    named = reps.select("key", "doc", F.struct("lone", "doc_id", "a", "b").alias("first"))
    least = labels.join(named, "doc").groupBy("comp").agg(F.min("first").alias("least"))
    labelled = labels.join(least, "comp").select("doc", "least")
    classes = named.join(labelled, "doc", "left").select("key", "first", F.coalesce("least", "first").alias("least"))
    return own.select("doc_id", "n", "key"), cut_lineage(classes)


def _hashed(docs: DataFrame) -> DataFrame:
    a, b = text_hash(F.col("text"))
    return docs.withColumn("a", a).withColumn("b", b)


def similarity_components(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and class_id (the least with an equal set)."""
    own, classes = _classes(_hashed(pick(docs, "doc_id", "text")), params)
    met = own.join(classes.withColumnRenamed("key", "its_key"), F.col("key") == F.col("its_key"), "left")
    return met.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("least.doc_id", "doc_id").alias("component_id"),
        F.coalesce("first.doc_id", "doc_id").alias("class_id"),
    )


def keep_one(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """Of each group of linked documents one row, all columns: that with the least doc_id.

    Rows are compared by their texts, not their ids: texts that share a doc_id and do not link both
    stay, and rows without a doc_id take part, but one with an id is preferred. Of rows that repeat an id and a text
    one stays. Texts without words link with nothing and all stay.
    """
    _, classes = _classes(_hashed(pick(docs, "doc_id", "text")), params)
    names = list(docs.columns)
    plain = docs.toDF(*[n if names.index(n) == i and n in ("doc_id", "text") else f"__c{i}" for i, n in enumerate(names)])
    worded = F.coalesce(F.col("text").rlike(PLAIN_WORD), F.lit(False))
    a, b = text_hash(F.col("text"))
    # one row of each text: its own least, which no task gathers, as each sends on one only
    least = Window.partitionBy("__a", "__b").orderBy(F.col("doc_id").asc_nulls_last())
    single = plain.where(worded).withColumn("__a", a).withColumn("__b", b).withColumn("__nth", F.row_number().over(least)).where("__nth = 1")
    stay = classes.select(F.col("least.a").alias("__sa"), F.col("least.b").alias("__sb")).distinct()
    kept = single.join(stay, (F.col("__a") == F.col("__sa")) & (F.col("__b") == F.col("__sb")), "left_semi").select(*plain.columns)
    return kept.unionByName(plain.where(~worded)).toDF(*names)
