"""Document fingerprints: one-permutation MinHash with optimal densification, packed low bits.

The shingle hashes of a text are dealt once into `bins` by their upper bits; each bin keeps the
least hash. An empty bin takes the value of a filled bin that it chooses by a hash sequence of
its own (a random order of the bins), independent of the other bins. Of each value the lowest
`bits` bits are stored. Two fingerprints agree in a bin by chance with probability 2**-bits, so
likeness is (agreement - chance) / (1 - chance), kept within 0 and 1.

`with_next` streams through the documents in falling doc_id order to compare each with its edited
form and with the next one: ranges of ids are dealt to partitions, sorted there, and the first
row of each range is also sent to the range before it, so no task holds the whole order. The cuts
between ranges come from a hashed sample of ids of bounded size and are looked up by bisection.

Edge cases: a null text is empty; a text without words has the fingerprint of the empty set, all
zeros, and equals another such text (likeness 1); rows that repeat a doc_id are ordered by text;
a null doc_id comes last; a single document is its own next.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benefactor.llm import hashing
from benefactor.llm.common import pick, share_below


@dataclass(frozen=True)
class FingerprintParams:
    width: int = 5  # words in a shingle
    bins: int = 256  # a power of two
    bits: int = 8
    rows_per_range: int = 4096  # documents in a range of ids
    range_bytes: int = 32 << 20  # of text in a range, where documents are long
    max_ranges: int = 1 << 16  # beyond it ranges grow; each is sorted with spilling and streamed
    sample: int = 24  # ids for each range, which the cuts are taken from


def _orders(bins: int) -> np.ndarray:
    """Row i: the order in which empty bin i tries the other bins."""
    with np.errstate(over="ignore"):
        seeds = np.arange(bins * bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77)
        return np.argsort(hashing.mix(seeds).reshape(bins, bins), axis=1).astype(np.int32)


class Fingerprinter:
    def __init__(self, params: FingerprintParams = FingerprintParams()):
        self.params = params
        self._orders = _orders(params.bins)
        self._shift = np.uint64(64 - (params.bins.bit_length() - 1))

    def of_set(self, hashes: np.ndarray) -> np.ndarray:
        """The stored value of each bin, from sorted shingle hashes."""
        p = self.params
        if not len(hashes):
            return np.zeros(p.bins, np.uint8)
        slot = (hashes >> self._shift).astype(np.int64)
        first = np.empty(len(slot), bool)
        first[0] = True
        np.not_equal(slot[1:], slot[:-1], out=first[1:])
        values, filled = np.zeros(p.bins, np.uint64), np.zeros(p.bins, bool)
        values[slot[first]] = hashes[first]
        filled[slot[first]] = True
        empty = np.flatnonzero(~filled)
        todo, tries = empty, 16
        while len(todo):  # a few tries settle most bins; the rest look at their whole order
            own = self._orders[todo, :tries]
            hit = filled[own]
            found = hit.any(axis=1)
            values[todo[found]] = values[own[found, hit[found].argmax(axis=1)]]
            todo, tries = todo[~found], p.bins
        with np.errstate(over="ignore"):  # the low bits of the hash in its bin, mixed once more
            return (hashing.mix(values) & np.uint64((1 << p.bits) - 1)).astype(np.uint8)

    def of_texts(self, texts: list[bytes]) -> list[np.ndarray]:
        ends = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=ends[1:])
        data = np.frombuffer(b"".join(texts), np.uint8)
        return [self.of_set(s) for s in hashing.shingle_sets(data, ends, self.params.width)]

    def packed(self, values: np.ndarray) -> str:
        if self.params.bits == 8:
            return values.tobytes().hex()
        bits = np.unpackbits(values[:, None], axis=1)[:, 8 - self.params.bits :]
        return np.packbits(bits.reshape(-1)).tobytes().hex()

    def likeness(self, a: np.ndarray, b: np.ndarray) -> float:
        chance = 2.0**-self.params.bits
        agree = np.count_nonzero(a == b) / self.params.bins
        return min(1.0, max(0.0, (agree - chance) / (1 - chance)))


def fingerprint(docs: DataFrame, params: FingerprintParams = FingerprintParams()) -> DataFrame:
    """doc_id and the packed fingerprint of every whole text."""

    def run(batches):
        maker = Fingerprinter(params)
        for batch in batches:
            texts = [b"" if t is None else t.encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([maker.packed(v) for v in maker.of_texts(texts)], pa.string())], ["doc_id", "fingerprint"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many from the start of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, params: FingerprintParams = FingerprintParams()) -> DataFrame:
    """Each document's fingerprint, its edited text's, and how near that and the next document are."""
    rows = pick(docs, "doc_id", "text")
    low = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = rows.withColumn("key", low)
    total, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not total:
        return rows.sparkSession.createDataFrame([], _SCHEMA)
    ranges = min(params.max_ranges, max(1, -(-total // params.rows_per_range), -(-size // params.range_bytes)))
    part = min(1.0, params.sample * ranges / total)
    drawn = np.sort(np.array([r["key"] for r in rows.where(share_below(F.col("key"), part, 307)).select("key").distinct().collect()], np.int64))
    cuts = sorted({float(drawn[len(drawn) * i // ranges]) for i in range(1, ranges)}) if len(drawn) else []
    # range 0 has the highest ids: the stream runs from range to range in falling order. Ids beyond 2**53
    # may share a float with their neighbours, and then share a range
    placed = rows.withColumn("place", F.col("key").cast("double"))
    if cuts:
        placed = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="place", outputCol="bucket").transform(placed)
    else:
        placed = placed.withColumn("bucket", F.lit(0.0))
    ranged = placed.withColumn("range", (F.lit(len(cuts)) - F.col("bucket")).cast("int")).drop("place", "bucket")
    # a row a range: its highest id, and the range before it, to which that row goes too; the first one's goes to the last range
    heads = {r["range"]: r["head"] for r in ranged.groupBy("range").agg(F.max("key").alias("head")).collect()}
    order = sorted(heads)
    guests = rows.sparkSession.createDataFrame([(heads[k], order[i - 1]) for i, k in enumerate(order)], "head long, goes int")
    met = ranged.join(F.broadcast(guests), F.col("key") == F.col("head"), "left")
    own = F.struct(F.col("range"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("goes").alias("range"), F.lit(1).alias("guest"))
    twice = met.withColumn("to", F.explode(F.when(F.col("goes").isNotNull(), F.array(own, guest)).otherwise(F.array(own))))
    # a partition for each range: by number, not by hash, which would put several ranges into one
    laid = (
        twice.select("doc_id", "text", "key", F.col("to.range").alias("range"), F.col("to.guest").alias("guest"))
        .repartitionById(len(cuts) + 1, F.col("range"))
        .sortWithinPartitions("range", "guest", F.desc("key"), "text")
    )

    def run(batches):
        maker = Fingerprinter(params)
        held = None  # the row that waits for the next one: id, text, values, range, guest

        def row(doc_id, text, values, following, following_values):
            new = edited(text, following).encode()
            other = maker.of_texts([new])[0]
            return (doc_id, len(text), hashlib.sha256(new).hexdigest(), maker.packed(values), maker.packed(other), maker.likeness(values, other), maker.likeness(values, following_values))

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [part.split()[0] for part in _SCHEMA.split(", ")]

        def packed(out):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                values = maker.of_texts([t.encode() for t in texts])
                for doc_id, text, own, where, guest in zip(part.column(0).to_pylist(), texts, values, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if held is not None and held[3] == where and not held[4]:
                        out.append(row(*held[:3], text, own))
                    held = (doc_id, text, own, where, guest)
            if out:
                yield packed(out)

    return laid.select("doc_id", "text", "range", "guest").mapInArrow(run, _SCHEMA)
