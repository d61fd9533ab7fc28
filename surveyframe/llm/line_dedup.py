"""Lines that documents share, removed from all but the first document that holds them.

Lines are known by 128 bits of their BLAKE2 digest.  The distinct digests are dealt
to shards; each shard is a minimal perfect hash with arrays behind it: a
fingerprint, the number of holders (up to 255), and for keys of several holders the
least doc_id.  Documents probe these arrays and are never joined line by line:

* The most frequent digests, of which there are few by arithmetic, form a shard
  of their own that every task has.  So no line is frequent enough to load one task.
* All others are probed shard by shard.  A task packs the digests of its texts into
  one block for each shard; blocks and shards meet sorted, the shard first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.store import stored
from . import words as W
from .grouped import groups
from .perfect_hash import PerfectHash
from .ship import ship

MIN_CHARS = 10
SHARD_KEYS = 1 << 17
FREQUENT = 1 << 18  # at most so many digests hold one part in FREQUENT of all places each
PROBES = 1 << 19    # digests that a task gathers before it packs them by shard
MOST = 255

_SPACE = " \t\n\v\f\r"


@dataclass
class Lines:
    """The lines of a batch: their bounds by text, and which of them are long enough to compare."""

    first: np.ndarray   # the first line of each text
    compared: np.ndarray
    digest: np.ndarray  # (lines compared, 2): the two halves of their digests


def lines_of(texts: pa.Array, min_chars: int) -> Lines:
    """Split at line feeds; a line's key is the line without white space at its ends, A-Z lower-cased."""
    split = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    first = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(False))))
    keys = pc.ascii_lower(pc.ascii_trim(pc.list_flatten(split), characters=_SPACE))
    compared = pc.greater_equal(pc.utf8_length(keys), min_chars)
    coded = keys.filter(compared).dictionary_encode()
    digests = b"".join(
        blake2b(k.encode(), digest_size=16).digest() for k in coded.dictionary.to_pylist())
    table = np.frombuffer(digests, "<u8").reshape(-1, 2)
    return Lines(first, compared.to_numpy(False), table[coded.indices.to_numpy(False)])


def _distinct(found: Lines) -> tuple[np.ndarray, np.ndarray]:
    """(text, digest) of the lines compared, once for each text."""
    row = np.searchsorted(found.first, np.flatnonzero(found.compared), "right") - 1
    if not len(row):
        return row, found.digest
    order = np.lexsort((found.digest[:, 1], found.digest[:, 0], row))
    row, digest = row[order], found.digest[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1]).any(axis=1)
    return row[new], digest[new]


def _held(min_chars: int):
    """Task function: texts to the digests that each holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            row, digest = _distinct(lines_of(batch.column("text"), min_chars))
            yield pa.RecordBatch.from_arrays([
                pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)),
                batch.column("doc_id").take(pa.array(row)),
            ], ["high", "low", "doc_id"])

    return run


class Shard:
    """A perfect hash over digests, and the arrays that it indexes."""

    def __init__(self, hashed: PerfectHash, prints: np.ndarray, counts: np.ndarray,
                 owners: np.ndarray):
        self.hashed, self.prints, self.counts, self.owners = hashed, prints, counts, owners
        self.owner_at = np.cumsum(counts >= 2) - 1

    @classmethod
    def build(cls, high, low, counts, owners, prints: str = "<u4") -> Shard:
        """``prints`` is the type of a fingerprint: four bytes will do where every digest that is
        probed is a key, strangers are told by eight."""
        high, low = high.view(np.uint64), low.view(np.uint64)
        hashed = PerfectHash.build(high, low)
        order = np.argsort(hashed.places(high, low))
        several = np.minimum(counts[order], MOST).astype(np.uint8)
        return cls(hashed, low[order].astype(prints), several, owners[order][several >= 2])

    def probe(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(holders, least doc_id where there are several) of each digest; 0 for an unknown one."""
        counts = np.zeros(len(high), np.int64)
        owners = np.zeros(len(high), np.int64)
        place = self.hashed.places(high, low)
        known = np.flatnonzero(place >= 0)
        known = known[self.prints[place[known]] == low[known].astype(self.prints.dtype)]
        counts[known] = self.counts[place[known]]
        several = known[counts[known] >= 2]
        owners[several] = self.owners[self.owner_at[place[several]]]
        return counts, owners

    def arrays(self) -> list[bytes]:
        return [a.tobytes() for a in (self.hashed.sizes, self.hashed.bits, self.prints,
                                      self.counts, self.owners)]

    @classmethod
    def read(cls, arrays: list[bytes]) -> Shard:
        sizes, bits, prints, counts, owners = (
            np.frombuffer(a, t) for a, t in zip(arrays, ("<i8", "<u8", "<u4", "u1", "<i8")))
        return cls(PerfectHash(bits, sizes), prints, counts, owners)


ARRAYS = ("sizes", "bits", "prints", "counts", "owners")
PROBE = ("high", "low", "row", "doc_ids", "tags")
_PACKED = pa.schema([("shard", pa.int64()), ("kind", pa.int32()),
                     *[(f"a{i}", pa.binary()) for i in range(5)]])
_PACKED_SQL = "shard bigint, kind int, " + ", ".join(f"a{i} binary" for i in range(5))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: the keys of a shard, one after the other, to its arrays."""
    for keys in groups(batches, "shard"):
        shard = Shard.build(*(keys.column(c).to_numpy() for c in ("high", "low", "n", "owner")))
        yield pa.RecordBatch.from_arrays(
            [keys.column("shard")[:1], pa.array([0], pa.int32()),
             *[pa.array([a], pa.binary()) for a in shard.arrays()]], schema=_PACKED)


def _pack(min_chars: int, shards: int, frequent):
    """Task function: the digests of texts, without the frequent ones, to a block for each shard."""

    def blocks(gathered: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        digest = np.concatenate([g[0] for g in gathered])
        sizes = [len(g[2]) for g in gathered]
        first = np.concatenate(([0], np.cumsum(sizes[:-1]))).astype(np.int64)
        row = np.concatenate([g[1] + f for g, f in zip(gathered, first)])
        doc_ids, tags = (np.concatenate([g[i] for g in gathered]) for i in (2, 3))
        shard = np.mod(digest[:, 0].view(np.int64), shards)
        order = np.argsort(shard, kind="stable")
        shard, row, digest = shard[order], row[order], digest[order]
        numbers, starts = np.unique(shard, return_index=True)
        columns: list[list] = [[] for _ in PROBE]
        for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(shard)]):
            rows, at = np.unique(row[low:high], return_inverse=True)
            for column, values in zip(columns, (
                    digest[low:high, 0], digest[low:high, 1], at.astype("<u4"), doc_ids[rows],
                    tags[rows])):
                column.append(np.ascontiguousarray(values).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers), pa.array(np.ones(len(numbers), np.int32)),
             *[pa.array(c, pa.binary()) for c in columns]], schema=_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for batch in W.pieces(batches, "text"):
            row, digest = _distinct(lines_of(batch.column("text"), min_chars))
            rare = frequent.value.probe(digest[:, 0], digest[:, 1])[0] == 0
            if rare.any():
                gathered.append((digest[rare], row[rare], batch.column("doc_id").to_numpy(),
                                 batch.column("tag").to_numpy()))
                size += int(rare.sum())
            if size >= PROBES:
                yield blocks(gathered)
                gathered, size = [], 0
        if gathered:
            yield blocks(gathered)

    return run


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: shards, each followed by its blocks, to the digests that a document loses."""
    shard, number = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            arrays = [batch.column(c)[i].as_buffer() for c in range(2, 7)]
            if batch.column("kind")[i].as_py() == 0:
                shard, number = Shard.read(arrays), batch.column("shard")[i].as_py()
                continue
            if number != batch.column("shard")[i].as_py():
                raise ValueError("a block of probes came before its shard")
            high, low, row, doc_ids, tags = (
                np.frombuffer(a, t) for a, t in zip(arrays, ("<u8", "<u8", "<u4", "<i8", "<i8")))
            counts, owners = shard.probe(high, low)
            lost = (counts >= 2) & (owners != doc_ids[row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids[row[lost]]), pa.array(tags[row[lost]]),
                 pa.array(low[lost].view(np.int64))], ["doc_id", "tag", "digest"])


def _rest(min_chars: int, frequent, columns: list[str]):
    """Task function: texts and the digests they lose to what is left of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "")
            found = lines_of(texts, min_chars)
            at = np.flatnonzero(found.compared)
            row = np.searchsorted(found.first, at, "right") - 1
            counts, owners = frequent.value.probe(found.digest[:, 0], found.digest[:, 1])
            has_id = np.asarray(batch.column("doc_id").is_valid())
            ids = pc.fill_null(batch.column("doc_id"), 0).to_numpy()
            drop = np.zeros(found.first[-1], bool)
            drop[at] = (counts >= 2) & (owners != ids[row]) & has_id[row]
            named = batch.column("__lost")
            low = found.digest[:, 1].view(np.int64)
            for r in np.flatnonzero(np.asarray(named.is_valid())).tolist():
                mine = slice(*np.searchsorted(row, (r, r + 1)))
                drop[at[mine]] |= np.isin(low[mine], named[r].values.to_numpy())
            n_lines = np.diff(found.first)
            n_dropped = np.add.reduceat(drop, found.first[:-1], dtype=np.int64)
            kept = texts.to_pylist() if n_dropped.any() else None
            for r in np.flatnonzero(n_dropped).tolist():
                mine = drop[found.first[r]:found.first[r + 1]]
                kept[r] = "\n".join(
                    line for line, gone in zip(kept[r].split("\n"), mine.tolist()) if not gone)
            kept = texts if kept is None else pa.array(kept, pa.string())
            made = {"n_lines": pa.array(n_lines.astype(np.int64)), "n_dropped": pa.array(n_dropped),
                    "kept": kept}
            yield pa.RecordBatch.from_arrays(
                [made[c] if c in made else batch.column(c) for c in columns], columns)

    return run


def remove_shared_lines(
    docs: DataFrame, *, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS,
    frequent: int = FREQUENT,
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for every row of ``docs`` (doc_id, text).

    A line of which the key (white space off both ends, A-Z lower-cased) has at least
    ``min_chars`` code points and stands in two documents or more stays in the document of
    the least doc_id only, there as often as it stands.  ``kept`` joins the other lines as they are.

    A missing or empty text is one empty line.  Rows that share a doc_id are one document: they
    lose nothing to each other.  Rows without doc_id take no part: they keep all lines, and no
    other row loses one to them.  Two keys count as one only where 128 bits of BLAKE2 agree.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    known = rows.where("doc_id IS NOT NULL")

    # Which digests there are; a hot line is one row a task before it is shuffled.
    held = known.mapInArrow(_held(min_chars), "high bigint, low bigint, doc_id bigint")
    keys = held.groupBy("high", "low").agg(
        F.count("*").alias("places"), F.min("doc_id").alias("owner"),
        F.max("doc_id").alias("last"))
    keys = stored(keys.select(
        "high", "low", "places", "owner",
        F.when(F.col("owner") == F.col("last"), 1).otherwise(F.col("places")).alias("n")),
        "line-keys")
    n_keys, n_places = keys.agg(F.count("*"), F.coalesce(F.sum("places"), F.lit(0))).first()
    shards = max(1, -(-n_keys // shard_keys))
    often = max(2, -(-n_places // frequent))  # so at most `frequent` digests are this frequent
    common = _common(spark, keys.where(F.col("places") >= often))

    index = keys.where(F.col("places") < often).withColumn(
        "shard", F.pmod("high", F.lit(shards))).select("shard", "high", "low", "n", "owner")
    index = index.repartition("shard").sortWithinPartitions("shard").mapInArrow(_build, _PACKED_SQL)

    tagged = known.withColumn("tag", F.xxhash64("text"))
    blocks = tagged.mapInArrow(_pack(min_chars, shards, common), _PACKED_SQL)
    met = stored(index, "line-shards").union(blocks).repartition("shard").sortWithinPartitions(
        "shard", "kind")
    lost = met.mapInArrow(_probe, "doc_id bigint, tag bigint, digest bigint")
    # Rows of one id may share a tag: what one of them loses, all lose that hold it.
    lost = lost.groupBy("doc_id", "tag").agg(F.collect_set("digest").alias("__lost"))

    texts = rows.withColumn("tag", F.xxhash64("text")).join(lost, ["doc_id", "tag"], "left").select(
        "doc_id", "text", "__lost")
    schema = "doc_id bigint, n_lines bigint, n_dropped bigint, kept string"
    names = [field.split()[0] for field in schema.split(", ")]
    return texts.mapInArrow(_rest(min_chars, common, names), schema)


def _common(spark: SparkSession, keys: DataFrame):
    """The frequent digests as one shard that every task has."""
    table = keys.select("high", "low", "n", "owner").toArrow()
    return spark.sparkContext.broadcast(Shard.build(
        *(table.column(c).to_numpy() for c in ("high", "low", "n", "owner")), prints="<u8"))
