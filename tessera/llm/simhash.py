"""Near-duplicate documents by SimHash fingerprints and multi-index hashing.

``links`` finds the pairs of fingerprints at ``DISTANCE`` or fewer differing bits. Each
segment of the fingerprint has a table, keyed by segment and value. A fingerprint probes
it with the Hamming ball around its own value, of radius ``DISTANCE // segments``: two
fingerprints that close agree to within that radius in some segment. The complete
distance of what the table returns is verified. A value that more than ``HOT``
fingerprints share is split by the ball around the rest of the fingerprint: its members
then meet under whole codes, no code holds more than ``bits + 1`` of them, all of these
lie within the distance of one another, and each is linked to the smallest only. So no
bucket grows with the data and no group's pairs are listed.

``near_copies`` is the looser search for copies by Jaccard similarity of word shingles.
It first joins texts whose fingerprints ``links`` finds. At a similarity of 0.8 two
64-bit fingerprints lie some ten bits apart, which no table of segments finds without
losing pairs, so a second index completes the search: texts meet in the shingles of
their prefixes. Of n shingles in one order common to all texts these are the first
n - ceil(similarity * n) + 1, and two sets that are similar enough share one of them. The
order puts shingles last that are common in all texts, counted in ``BINS`` bins. Pairs
pass a filter by size, which is exact, and one by the distance of 128-bit fingerprints,
five deviations beyond what the similarity shows; exact similarities of whole texts
decide. Every text first meets the nearest of the members that its buckets prefer. What
is left are buckets whose members lie in several groups: their pairs across groups that
pass the filters make clusters, and within a cluster all such pairs are decided by their
whole sets of shingles, in the task that compares them. So every pair that passes the
filters is decided or lies within one group, and no pairs are written. A bucket or
cluster larger than a block is compared in pairs of blocks, so that no task holds it.

Edge cases: null and empty texts have no words and fingerprint zero; a text with
fewer words than a shingle is one shingle; repeated rows and equal texts have equal
fingerprints and are linked; an empty table gives no rows. Only the id and the text
are read, so other columns' names cannot clash. Rows with a null id get a component
like any other in ``groups`` but never name one; ``near_copies`` leaves them alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import cut_lineage, shuffled
from .graph import components

SEED = 42
#: Fingerprints at this many or fewer differing bits are linked.
DISTANCE = 2
#: A segment's value that more fingerprints share is split by the rest of the fingerprint.
HOT = 16
#: Sets of fewer shingles are compared whatever their fingerprints.
FEW_SHINGLES = 32
#: Bins that shingles are counted in, to order them and to tell which buckets may be large; results don't depend on it.
BINS = 1 << 18
#: Members that a bucket may have, beyond four mean bins, to be gathered by one task; larger ones are not gathered.
GATHERED = 50_000
#: Members of a bucket, and shingles of a cluster, that a task compares with one another; members compared with all others at once.
BLOCK, BLOCK_SHINGLES, ROWS_AT_ONCE = 8192, 2_000_000, 256
#: Ids up to this number (24 bytes each at most) are broadcast to pick their texts; beyond it the texts are shuffled.
BROADCAST_ROWS = 300_000
#: Shingles hashed at once; bounds a task's memory for very long texts.
CHUNK = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case: runs of anything but the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``size`` words, in chunks; of the whole sequence where it is shorter."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if not words:
        return
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > size:
        begins, ends = begins[: len(words) - size + 1], ends[size - 1 :]
    else:
        begins, ends = begins[:1], ends[-1:]
    for k in range(0, len(begins), CHUNK):
        pairs = zip(begins[k : k + CHUNK].tolist(), ends[k : k + CHUNK].tolist(), strict=True)
        yield np.array([digest(text[a:b], SEED) for a, b in pairs], dtype="<u8")


def majority(chunks: Iterator[np.ndarray], bits: int = 64) -> np.ndarray:
    """The bits set in over half the rows of hashes, as bytes."""
    ones, rows = np.zeros(bits, dtype=np.int64), 0
    for chunk in chunks:
        table = np.unpackbits(chunk.view(np.uint8).reshape(-1, bits // 8), axis=1, bitorder="little")
        ones += table.sum(axis=0, dtype=np.int64)
        rows += len(table)
    return np.packbits(ones * 2 > rows, bitorder="little")


def fingerprints(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (the 64 bits as a signed long), one row a row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(shingle_hashes(words_of(t), shingle)).view("<i8")[0] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fingerprint"])

    ship_package(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, fingerprint long")


def _flips(value: Column, width: int, begin: int) -> Column:
    """The values with one bit that is 0 in ``value``, of ``width`` bits from ``begin`` on, set."""
    bits = F.array(*(F.lit(1 << (begin + k) if begin + k < 63 else -(1 << 63)) for k in range(width)))
    return F.transform(F.filter(bits, lambda bit: value.bitwiseAND(bit) == 0), lambda bit: value.bitwiseOR(bit))


def _ball(value: Column, width: int, begin: int) -> Column:
    """``value`` and those that differ in one of ``width`` bits from ``begin`` on."""
    bits = F.array(*(F.lit(1 << (begin + k) if begin + k < 63 else -(1 << 63)) for k in range(width)))
    return F.concat(F.array(value), F.transform(bits, lambda bit: value.bitwiseXOR(bit)))


def links(prints: DataFrame) -> DataFrame:
    """``u, v``: links whose components are those of all pairs of fingerprints at ``DISTANCE`` or fewer bits.

    ``prints`` has a column ``fingerprint``; equal fingerprints need no link. With two
    segments of 32 bits and two differing bits, the balls have radius one. Of two values
    that differ in one bit, the one without it probes the other's table entry.
    """
    distinct = prints.select("fingerprint").where("fingerprint is not null").distinct()
    x, masks = F.col("fingerprint"), (0xFFFFFFFF, -(1 << 32))

    def key(segment: int):
        return lambda value: F.struct(F.lit(segment).alias("segment"), value.alias("value"))

    own = [key(s)(x.bitwiseAND(F.lit(mask))) for s, mask in enumerate(masks)]
    probes = [F.transform(_flips(x.bitwiseAND(F.lit(mask)), 32, 32 * s), key(s)) for s, mask in enumerate(masks)]
    table = distinct.select("fingerprint", F.explode(F.array(*own)).alias("at")).select("fingerprint", "at.segment", "at.value")
    probing = distinct.select(F.col("fingerprint").alias("probe"), F.explode(F.concat(F.array(*own), *probes)).alias("at")).select("probe", "at.segment", "at.value")
    sizes = table.groupBy("segment", "value").agg(F.count("*").alias("size"), F.min("fingerprint").alias("least"))
    # values that nothing else probes drop out here; what is left are a few rows a group of near fingerprints
    met = cut_lineage(probing.join(shuffled(sizes), ["segment", "value"]).where("size > 1 or probe <> least"))
    cold = met.where(F.col("size") <= HOT)
    single = cold.where("size = 1").select(F.col("probe").alias("u"), F.col("least").alias("v"))
    several = cold.where("size > 1").join(shuffled(table), ["segment", "value"]).select(F.col("probe").alias("u"), F.col("fingerprint").alias("v"))
    verified = single.unionAll(several).where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE))
    rest = [F.col("probe").bitwiseAND(F.lit(mask)) for mask in reversed(masks)]
    same = F.col("probe").bitwiseAND(F.when(F.col("segment") == 0, F.lit(masks[0])).otherwise(F.lit(masks[1]))) == F.col("value")
    around = F.when(F.col("segment") == 0, _ball(rest[0], 32, 32)).otherwise(_ball(rest[1], 32, 0))
    centre = F.array(F.when(F.col("segment") == 0, rest[0]).otherwise(rest[1]))
    hot = met.where(F.col("size") > HOT).select("probe", "segment", "value", F.explode(F.when(same, around).otherwise(centre)).alias("rest"))
    # at most 65 members a code
    stars = hot.selectExpr("probe as u", "min(probe) over (partition by segment, value, rest) as v").where("u <> v")
    return verified.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def groups(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: the smallest id reachable over links, itself included."""
    prints = cut_lineage(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col))
    roots = components(links(prints))
    first = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    rooted = first.join(shuffled(roots.withColumnRenamed("node", "fingerprint")), "fingerprint", "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    rooted = cut_lineage(rooted)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(shuffled(smallest), "root").select("fingerprint", "component_id")
    return prints.join(shuffled(named), "fingerprint").select("doc_id", "fingerprint", "component_id")


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """A second hash from the first, by SplitMix64."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    """A random number for each byte, A-Z as a-z; 0 for white space."""
    lower = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
    values = _mixed(np.arange(256, dtype=np.uint64))[lower]
    values[list(b"\t\n\v\f\r ")] = 0
    return values


class ShingleHasher:
    """Hashes of a text's different shingles: polynomials over the bytes of its words, and over their hashes."""

    BASE = 0x9E3779B97F4A7C15
    VALUES = _byte_values()

    def __init__(self, size: int) -> None:
        self.size = size
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        n = 1 << n.bit_length()
        inverse = pow(self.BASE, -1, 1 << 64)
        self.powers, self.inverses = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, base, dtype=np.uint64)))) for base in (self.BASE, inverse))

    def words(self, text: str | None) -> np.ndarray:
        """A hash of each word, those of ``words_of``."""
        values = self.VALUES[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)]
        if len(values) > len(self.powers):
            self._grow(len(values))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], values != 0, [False]))))
        begins, ends = edges[::2], edges[1::2]
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values * self.powers[: len(values)], dtype=np.uint64)))
        return _mixed((sums[ends] - sums[begins]) * self.inverses[begins] + (ends - begins).astype(np.uint64))

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted; the whole sequence is one shingle where it is shorter."""
        words = self.words(text)
        if not len(words):
            return words
        size = min(self.size, len(words))
        rows = len(words) - size + 1
        out = np.full(rows, size, dtype=np.uint64)
        for k in range(size):
            out = out * np.uint64(self.BASE) + words[k : k + rows]
        out = np.sort(_mixed(out))
        return out[np.concatenate(([True], out[1:] != out[:-1]))]


def far_bits(similarity: float) -> int:
    """Of 128 bits: the mean and five deviations for two sets of this similarity, the largest angle it allows."""
    share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.ceil(128 * share + 5 * math.sqrt(128 * share * (1 - share)))


def _counted(docs: DataFrame, shingle: int) -> np.ndarray:
    """How many shingles of all texts of ``docs`` (id, text) fall in each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hasher = np.zeros(BINS, dtype=np.int64), ShingleHasher(shingle)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                counts[(hasher.shingles(text) % np.uint64(BINS)).astype(np.int64)] += 1
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["bin", "n"])

    found = docs.mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # at most BINS rows
    counts = np.zeros(BINS, dtype=np.int64)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32)


def prefixes(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``doc_id, digest, size, left, right, codes, often`` of ``docs`` (id, text): MD5, number of shingles, their fingerprint and prefix.

    ``often`` are the shingles of the prefix whose buckets may be large.
    """
    found = _counted(docs, shingle)
    limit = min(GATHERED + 4 * int(found.mean()), np.iinfo(np.uint32).max - 1)
    counts = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(shingle)

        def prefix(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(hashes):  # texts without words meet one another
                return hashes.view("<i8"), np.zeros(1, dtype="<i8")
            wanted = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
            n = counts.value[hashes % np.uint64(BINS)]
            chosen = np.lexsort((hashes, n))[:wanted]
            few = n[chosen] <= limit
            return hashes[chosen[few]].view("<i8"), hashes[chosen[~few]].view("<i8")

        for batch in batches:
            digests, sizes, left, right, codes, often = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                digests.append(hashlib.md5((text or "").encode("utf-8", "surrogatepass"), usedforsecurity=False).digest())
                hashes = hasher.shingles(text)
                sizes.append(len(hashes))
                for out, mixed in ((left, hashes), (right, _mixed(hashes))):
                    chunks = (mixed[k : k + CHUNK] for k in range(0, len(mixed), CHUNK))
                    out.append(majority(chunks).view("<i8")[0])
                for out, found in zip((codes, often), prefix(hashes), strict=True):
                    out.append(found)
            longs = [pa.array(c, pa.int64()) for c in (sizes, left, right)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), *longs, *(pa.array(c, pa.list_(pa.int64())) for c in (codes, often))], names=["doc_id", "digest", "size", "left", "right", "codes", "often"])

    return docs.mapInArrow(run, "doc_id long, digest binary, size long, left long, right long, codes array<long>, often array<long>")


def _chunks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of whole buckets, many at once, from rows sorted by the first ``keys`` columns; where each row's bucket ends."""

    def whole(table: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in table[:keys]], axis=0)) + 1
        sizes = np.diff(np.concatenate(([0], new, [len(table[0])])))
        return table, np.repeat(np.cumsum(sizes), sizes)

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(h[0]) for h in held) >= CHUNK:
            table = [np.concatenate(c) for c in zip(*held, strict=True)]
            ends = whole(table)[1]
            cut = np.searchsorted(ends, ends[-1])
            held = [[c[cut:] for c in table]]
            if cut:
                yield [c[:cut] for c in table], ends[:cut]
    if held:
        yield whole([np.concatenate(c) for c in zip(*held, strict=True)])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries (code, id) whose bucket has other members, with its smallest."""
    for (code, ids), ends in _chunks(batches, 1):
        begins = np.flatnonzero(np.concatenate(([True], ends[1:] != ends[:-1])))
        sizes = np.diff(np.append(begins, len(ids)))
        least, most = (np.repeat(f.reduceat(ids, begins), sizes) for f in (np.minimum, np.maximum))
        kept = least != most
        yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (code, ids, least)], names=["code", "id", "partner"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """Columns of one bucket after another, from rows sorted by the first three columns, its key."""

    def whole(parts: list[pa.RecordBatch]) -> list[pa.Array]:
        return parts[0].columns if len(parts) == 1 else [pa.concat_arrays(c) for c in zip(*(p.columns for p in parts), strict=True)]

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]]
        begins = np.flatnonzero(np.any([c[1:] != c[:-1] for c in keys], axis=0)) + 1
        for a, b in zip([0, *begins], [*begins, batch.num_rows], strict=True):
            key = tuple(int(c[a]) for c in keys)
            if held and key != last:
                yield whole(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield whole(held)


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j; each entry of ``parent`` is its set's smallest."""
    while len(i):
        low, high = np.minimum(parent[i], parent[j]), np.maximum(parent[i], parent[j])
        apart = low != high
        i, j, low, high = i[apart], j[apart], low[apart], high[apart]
        np.minimum.at(parent, high, low)
        while np.any(parent != (up := parent[parent])):
            parent[:] = up


def _may_match(similarity: float, apart, size, other):
    few = np.minimum(size, other) < FEW_SHINGLES
    return (few | (apart <= far_bits(similarity))) & (np.minimum(size, other) >= similarity * np.maximum(size, other) - 1e-9)


def _comparable(similarity: float, rows: slice, root: np.ndarray, block: np.ndarray, two: bool, size: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of some rows of a bucket may match which members of other groups, and of the other block where there are two."""
    apart = np.bitwise_count(bits[rows, None] ^ bits[None]).sum(axis=2, dtype=np.int64)
    fits = (root[rows, None] != root[None]) & _may_match(similarity, apart, size[rows, None], size[None])
    return fits & (block[rows, None] != block[None]) if two else fits


def _clusters(similarity: float):
    """Each bucket's members that may match members of other groups: ``u``, and a member ``v`` of the same cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, first, second, block, ids, root, size, *bits), ends in _chunks(batches, 3):
            bits, two = np.stack(bits, axis=1).view(np.uint64), first != second
            parent, met = np.arange(len(ids)), np.zeros(len(ids), dtype=bool)
            i, apart = np.arange(len(ids)), 0
            while len(i := i[i + (apart := apart + 1) < ends[i]]):  # each row with the one so many rows on
                for k in range(0, len(i), CHUNK):
                    a = i[k : k + CHUNK]
                    a = a[(root[a] != root[a + apart]) & (~two[a] | (block[a] != block[a + apart]))]
                    far = np.bitwise_count(bits[a] ^ bits[a + apart]).sum(axis=1, dtype=np.int64)
                    a = a[_may_match(similarity, far, size[a], size[a + apart])]
                    _unite(parent, a, a + apart)
                    met[a] = met[a + apart] = True
            yield pa.RecordBatch.from_arrays([pa.array(ids[met]), pa.array(ids[parent[met]])], names=["u", "v"])

    return run


def _links_across(similarity: float):
    """Links between groups by exact similarity of shingle sets, as many as join the groups of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _buckets(batches):
            first, second, block, ids, root, size, left, right = (c.to_numpy() for c in columns[1:-1])
            bits = np.stack((left, right), axis=1).view(np.uint64)
            sets = [np.frombuffer(s, dtype="<u8") for s in columns[-1].to_pylist()]
            known, numbers = np.unique(np.concatenate(sets), return_inverse=True)
            ends = np.cumsum([len(s) for s in sets])
            members = [numbers[b - len(s) : b] for b, s in zip(ends, sets, strict=True)]
            _, groups, parent = np.unique(root, return_index=True, return_inverse=True)
            parent = groups[parent]
            mine, out = np.zeros(len(known), dtype=bool), []
            for k in range(0, len(ids), ROWS_AT_ONCE):
                fits = _comparable(similarity, slice(k, k + ROWS_AT_ONCE), root, block, first[0] != second[0], size, bits)
                for x in range(k, min(k + ROWS_AT_ONCE, len(ids))):
                    others = np.flatnonzero(fits[x - k] & (parent != parent[x]))
                    others = others[others < x]
                    if not len(others):
                        continue
                    mine[members[x]] = True
                    both = np.array([np.count_nonzero(mine[members[y]]) for y in others])
                    mine[members[x]] = False
                    alike = others[both >= similarity * (size[x] + size[others] - both) - 1e-9]
                    for y in alike[np.unique(parent[alike], return_index=True)[1]].tolist():
                        out.append((ids[x], ids[y]))
                    _unite(parent, np.full(len(alike), x), alike)
            if out:
                u, v = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _similarity(shingle: int):
    @F.pandas_udf("double")
    def jaccard(left: pd.Series, right: pd.Series) -> pd.Series:
        out, last, mine, hasher = [], None, None, ShingleHasher(shingle)
        for a, b in zip(left, right, strict=True):
            if mine is None or a != last:
                last, mine = a, hasher.shingles(a)
            other = hasher.shingles(b)
            both = len(np.intersect1d(mine, other, assume_unique=True))
            out.append(both / (len(mine) + len(other) - both) if both else float(len(mine) == len(other) == 0))
        return pd.Series(out, dtype=float)

    return jaccard


def _in_block_pairs(members: DataFrame, key: str, weight: Column, most: int) -> DataFrame:
    """``members`` with ``first, second, block``: a key's rows dealt to blocks of at most about ``most`` in all, each with each."""
    sizes = members.groupBy(key).agg(F.ceil(F.sum(weight) / most).cast("int").alias("blocks"))
    dealt = members.join(shuffled(sizes), key).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")).drop("blocks", "other")


def near_copies(docs: DataFrame, *, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, group_id`` for the documents that have copies: equal texts, or texts linked by shingle similarity.

    ``group_id`` is the group's smallest id. Documents without copies are not listed.
    """
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    prints = cut_lineage(prefixes(source, similarity, shingle))
    own = F.struct("doc_id", "size", "left", "right")
    texts = cut_lineage(prints.groupBy("digest").agg(F.min(own).alias("own"), F.count("*").alias("copies")).select("digest", "copies", F.col("own.doc_id").alias("id"), "own.size", "own.left", "own.right"))
    shapes = texts.select("id", "size", "left", "right")
    again = cut_lineage(prints.select("doc_id", "digest").join(shuffled(texts.select("digest", "id")), "digest").where("doc_id <> id").select("doc_id", "digest").distinct())

    def small(frame: DataFrame) -> DataFrame:
        return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else shuffled(frame)

    def texts_of(ids: DataFrame) -> DataFrame:
        """``id, text`` of some ids; an id that has several texts has several rows."""
        return source.withColumnRenamed("doc_id", "id").join(small(ids), "id", "left_semi").dropDuplicates(["id", "text"])

    # pairs of equal or linked fingerprints
    first = cut_lineage(texts.groupBy(F.col("left").alias("fingerprint")).agg(F.min("id").alias("first")))
    of_u, of_v = (first.select(F.col("fingerprint").alias(c), F.col("first").alias(n)) for c, n in (("u", "id"), ("v", "partner")))
    near = links(first).join(shuffled(of_u), "u").join(shuffled(of_v), "v").select("id", "partner")
    equal = shapes.join(shuffled(first), F.col("left") == F.col("fingerprint")).where("id <> first").select("id", F.col("first").alias("partner"))

    # each text's buckets that have other members, and its nearest of those that their buckets prefer
    once = prints.join(small(again), ["doc_id", "digest"], "left_anti").withColumnRenamed("doc_id", "id")
    entries = once.select(F.explode("codes").alias("code"), "id").repartition("code").sortWithinPartitions("code").mapInArrow(_meeting, "code long, id long, partner long")
    large = once.select(F.explode("often").alias("code"), "id")
    pivots = large.groupBy("code").agg(F.min("id").alias("partner"), F.max("id").alias("last")).where("partner <> last")
    entries = cut_lineage(entries.unionAll(large.join(shuffled(pivots), "code").select("code", "id", "partner")))
    theirs = shapes.select(F.col("id").alias("partner"), F.col("size").alias("their_size"), F.col("left").alias("their_left"), F.col("right").alias("their_right"))
    apart = F.bit_count(F.col("left").bitwiseXOR(F.col("their_left"))) + F.bit_count(F.col("right").bitwiseXOR(F.col("their_right")))
    low, high = F.least("size", "their_size"), F.greatest("size", "their_size")
    may_match = ((low < FEW_SHINGLES) | (F.col("apart") <= far_bits(similarity))) & (low >= similarity * high - 1e-9)
    stars = entries.where("id <> partner").select("id", "partner").distinct().join(shuffled(shapes), "id").join(shuffled(theirs), "partner").withColumn("apart", apart).where(may_match)
    nearest = stars.groupBy("id").agg(F.min(F.struct("apart", F.xxhash64("partner").alias("p"), "partner")).alias("best"))
    pairs = near.unionAll(equal).unionAll(nearest.select("id", F.col("best.partner").alias("partner")))
    pairs = cut_lineage(pairs.select(F.least("id", "partner").alias("id"), F.greatest("id", "partner").alias("partner")).distinct())
    both = cut_lineage(texts_of(pairs.select(F.explode(F.array("id", "partner")).alias("id")).distinct()))
    alike = pairs.join(shuffled(both.withColumnRenamed("text", "own_text")), "id").join(shuffled(both.select(F.col("id").alias("partner"), F.col("text").alias("their_text"))), "partner")
    found = cut_lineage(alike.where(_similarity(shingle)("own_text", "their_text") >= similarity).select(F.col("id").alias("u"), F.col("partner").alias("v")))
    roots = cut_lineage(components(found))

    # buckets in several groups, and clusters of their members that may match across groups
    rooted = cut_lineage(entries.select("code", "id").join(shuffled(roots.withColumnRenamed("node", "id")), "id", "left").withColumn("root", F.coalesce("root", "id")))
    split = rooted.groupBy("code").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("code")
    dealt = _in_block_pairs(rooted.join(shuffled(split), "code"), "code", F.lit(1), BLOCK).join(shuffled(shapes), "id")
    keys = ["code", "first", "second"]
    dealt = dealt.select(*keys, "block", "id", "root", "size", "left", "right").repartition(*keys).sortWithinPartitions(*keys)
    clusters = cut_lineage(components(cut_lineage(dealt.mapInArrow(_clusters(similarity), "u long, v long").distinct())))

    # exact similarities of all pairs of a cluster across groups
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(shingle)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hasher.shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "shingles"])

    members = clusters.select(F.col("node").alias("id"), F.col("root").alias("cluster")).join(shuffled(roots.withColumnRenamed("node", "id")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    sets = texts_of(clusters.select(F.col("node").alias("id"))).mapInArrow(sets_of, "id long, shingles binary")
    dealt = _in_block_pairs(members.join(shuffled(shapes), "id"), "cluster", F.col("size") + 1, BLOCK_SHINGLES).join(shuffled(sets), "id")
    keys = ["cluster", "first", "second"]
    dealt = dealt.select(*keys, "block", "id", "root", "size", "left", "right", "shingles").repartition(*keys).sortWithinPartitions(*keys)
    found = found.unionAll(cut_lineage(dealt.mapInArrow(_links_across(similarity), "u long, v long")))
    roots = components(found)
    rooted = texts.select("digest", "id", "copies").join(shuffled(roots.withColumnRenamed("node", "id")), "id", "left").select("digest", "id", "copies", F.coalesce("root", "id").alias("root"))
    rooted = cut_lineage(rooted)
    smallest = rooted.groupBy("root").agg(F.min("id").alias("group_id"), F.sum("copies").alias("size")).where("size > 1")
    named = rooted.join(shuffled(smallest), "root").select("digest", "group_id")
    listed = prints.select("doc_id", "digest").join(shuffled(named), "digest")
    return listed.select("doc_id", "group_id").distinct()


def without_copies(docs: DataFrame, *, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id. Rows with a null id stay."""
    found = near_copies(docs, similarity=similarity, shingle=shingle, id_col=id_col, text_col=text_col)
    gone = cut_lineage(found.where("doc_id <> group_id").select(F.col("doc_id").alias(id_col)).distinct())
    kept = docs.join(shuffled(gone), id_col, "left_anti")
    twice = docs.groupBy(id_col).agg(F.count("*").alias("n")).where((F.col("n") > 1) & F.col(id_col).isNotNull())
    if twice.isEmpty():
        return kept
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(kept.where(F.col(id_col).isNull()))
