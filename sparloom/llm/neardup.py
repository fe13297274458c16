"""Near-duplicate records with small edits: exact set-similarity self-join by pigeonring filtering.

A record is the set of all substrings of ``WIDTH`` characters of its normalised text; two records are alike when the
common substrings are at least ``threshold`` of all distinct ones. That is a Hamming budget on the two sets
(|A ^ B| <= (|A|+|B|) (1-t)/(1+t)), and the join keeps every pair within it:

1. Equal texts are collapsed; only one record of each class is compared.
2. Segments. Tokens are ordered by frequency over all records (a counting sketch; any order is right, a good one is
   fast). The rare ones are segments of their own; the others fall by hash into a ring of segments, each of which
   grants a budget of one difference. By the pigeonhole principle over segment budgets two alike records share, within
   prefixes whose budgets reach n - overlap + COMMON, at least COMMON keys: rare tokens or two tokens of one segment.
   Pairs that share fewer are dropped by counting, so that next to no others reach the following steps.
   The ring grows with the record (``modes``); sizes of alike records always meet in a common mode.
3. Pigeonring. A candidate has, on a ring of CHAIN segments, a start from which the cumulative differences of every
   chain stay within the proportional share of its budget.
4. Full Hamming check on the true sets.

Keys travel packed: one row per batch and bucket of keys, so that a shuffle moves few large rows; buckets grow in number
with the input, each holds about PER_BUCKET keys. Pairs of a key are made size by size in bounded pieces and counted
before they are shuffled.

Disk. Texts are kept once, in compressed Parquet; steps between move hashes of them, and only texts of candidates are
joined. The buckets are done in up to ROUNDS rounds, as many as the estimated keys call for, whose shuffles end with them:
two records that share COMMON keys share at least COMMON / rounds, rounded up, in one round, so that each round decides
alone and loses no pair. Numbers are
packed as differences, byte by byte (``planes``), whose leading zeros the compression of the shuffle takes away.

Defined results
    * null parts of a record count as empty; records without a single substring of WIDTH characters are alike to none.
    * equal texts are alike; a class of at most ``expand`` equal texts comes out in all its pairs, a larger one as the
      links of its smallest id to each member, and links between classes are then those between smallest ids;
      ``memberships`` gives every id its class, from which all pairs follow.
    * ids delivered twice count once; null ids are left out; an empty table gives no rows.
    * further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.llm import bloom
from sparloom.session import checkpoint_dir, cut

WIDTH = 8
THRESHOLD = 0.7
#: Keys two alike records share at least.
COMMON = 16
#: Records with fewer tokens may share fewer than COMMON: one key of theirs counts for all.
TINY = 2 * COMMON
#: Ring segments of the smallest mode; each further mode has six times as many and starts at eight times the size.
RING = 64
#: Buckets of the counting sketch: one byte each (eighths of a power of two), 2^16 to 2^24 by the number of tokens.
LOW_BITS, HIGH_BITS, PER_CELL = 16, 24, 14
SLICE = 1 << 16
#: A token of a sketch bucket with at most this many records is a segment of its own.
RARE = 10
#: Keys in a bucket, about.
PER_BUCKET = 2_000_000
#: Rounds at most; shuffled bytes that one round may have in any case, and for each character of text.
ROUNDS, ROUND_BYTES, ROUND_SHARE = 8, 50_000_000, 1.1
#: Bytes of a key, and of a record in a bucket, as measured; records from which the number of keys is estimated.
KEY_BYTES, ENTRY_BYTES, SAMPLE = 5, 2.5, 4000
#: Characters worked on at once.
CACHED = 150_000
#: Pairs held before they are counted.
HELD = 2_000_000
#: Segments of the pigeonring test.
CHAIN = 16
SALTS = 8
U = np.uint64
LOW56 = U((1 << 56) - 1)


@dataclass(frozen=True)
class Settings:
    threshold: float = THRESHOLD
    expand: int = 64


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside go when their action ends, not when the driver collects its garbage."""
    before = spark.conf.get(FREED)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """The rows as compressed Parquet in the checkpoint folder, for as long as the block runs."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    sc = spark.sparkContext
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/near-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def once(df: DataFrame) -> DataFrame:
    """As ``cut``, for rows that are dear to make: a checkpoint evaluates its last stage twice."""
    with stored(df) as rows:
        return cut(rows)


def planes(a: np.ndarray) -> bytes:
    """Numbers byte by byte: all lowest bytes, then all second ones, and so on."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def unplaned(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def steps(a: np.ndarray) -> bytes:
    """Differences of whole numbers from one to the next, the first from 0."""
    return planes(np.diff(a.astype(np.int64), prepend=0))


def unstepped(raw: bytes) -> np.ndarray:
    return np.cumsum(unplaned(raw, np.int64))


def normal_text(*parts: Column) -> Column:
    """Parts joined by blanks, in lower case, each run of other than letters and digits one blank, trimmed."""
    joined = F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.trim(F.regexp_replace(F.lower(joined), r"[^\p{L}\p{N}]+", " "))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x = x * U(0x9E3779B97F4A7C15)
    x = x ^ (x >> U(29))
    x = x * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def shingles(texts: list[str], order=None) -> tuple[np.ndarray, np.ndarray]:
    """(record index, token) of the distinct substrings of each text, sorted by record and token. A token is a hash of 56
    bits; ``order`` (byte per sketch bucket) goes into the upper eight, so that tokens come out by frequency."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = np.frombuffer("\0".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(data) < WIDTH:
        return none
    one = mix(data + U(1))
    two = one[:-1] * U(0x9E3779B97F4A7C15) + (one[1:] ^ (one[1:] >> U(17)))
    four = two[:-2] * U(0xC2B2AE3D27D4EB4F) + (two[2:] ^ (two[2:] >> U(29)))
    h = mix(four[:-4] * U(0x165667B19E3779F9) + (four[4:] ^ (four[4:] >> U(31)))) & LOW56
    if order is not None:
        h |= order[(h & U(len(order) - 1)).astype(np.int64)].astype(np.uint64) << U(56)
    sizes = np.fromiter((max(0, len(t) - WIDTH + 1) for t in texts), dtype=np.int64, count=len(texts))
    start = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))])
    parts = []
    for a, n in zip(start.tolist(), sizes.tolist()):
        h[a : a + n].sort()
        parts.append(h[a : a + n])
    h, owner = np.concatenate(parts), np.repeat(np.arange(len(texts)), sizes)
    if not len(h):
        return none
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]


def _slices(b: pa.RecordBatch, chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about so many characters, so that long texts don't pile up in memory."""
    size, start = 0, 0
    for i, t in enumerate(b.column(b.num_columns - 1)):
        size += t.as_buffer().size if t.is_valid else 0
        if size > chars:
            yield b.slice(start, i + 1 - start)
            size, start = 0, i + 1
    if start < b.num_rows:
        yield b.slice(start)


def sketch_bits(tokens: int) -> int:
    return min(HIGH_BITS, max(LOW_BITS, math.ceil(math.log2(max(2, tokens / PER_CELL)))))


def token_order(reps: DataFrame, tokens: int) -> np.ndarray:
    """One byte per sketch bucket: eight times the binary logarithm of the records whose tokens fall there, over all
    records. Every partition sends its counts in slices, summed per slice in two steps."""
    bits = sketch_bits(tokens)
    slices = (1 << bits) // SLICE

    def local(batches):
        counts, held, size = np.zeros(1 << bits, dtype=np.uint32), [np.zeros(0, np.int32)], 0
        for b in batches:
            for s in _slices(b, CACHED):
                held.append((shingles(s.column("text").to_pylist())[1] & U((1 << bits) - 1)).astype(np.int32))
                size += len(held[-1])
                if size > 2 * HELD:
                    counts += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.uint32)
                    held, size = held[:1], 0
        counts += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.uint32)
        if counts.any():
            kind = np.uint8 if counts.max() < 256 else np.uint32
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(slices, dtype=np.int32)), pa.array([p.astype(kind).tobytes() for p in counts.reshape(slices, SLICE)], pa.binary())], names=["slice", "counts"])

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros(SLICE, dtype=np.uint32)
        for b in batches:
            for c in b.column("counts"):
                raw = c.as_py()
                s += np.frombuffer(raw, dtype=np.uint8 if len(raw) == SLICE else np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([s.tobytes()], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    parts = reps.select("text").mapInArrow(local, schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    rows = parts.groupBy("slice", "part").applyInArrow(total, schema).groupBy("slice").applyInArrow(total, schema).collect()
    out = np.zeros((slices, SLICE), dtype=np.uint32)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["counts"], dtype=np.uint32)
    return np.minimum(255, np.floor(8 * np.log2(np.maximum(1, out.reshape(-1))))).astype(np.uint8)


def modes(threshold: float) -> Iterator[tuple[int, float, float]]:
    """(ring segments, from size, below size) of each mode. The first has single tokens only; in every other the budgets of
    a record's own tokens reach its prefix. Alike records, whose sizes differ by the threshold at most, share a mode."""
    start, ring = math.ceil((RING + COMMON + 1) / threshold), RING
    yield 0, 0, start / threshold
    while True:
        yield ring, start, 8 * start / threshold
        start, ring = 8 * start, 6 * ring


def _ordered(code: np.ndarray) -> np.ndarray:
    """Positions by code, then as given: one plain sort of both together."""
    bits = max(1, len(code)).bit_length()
    return np.sort(code << bits | np.arange(len(code))) & ((1 << bits) - 1)


def _rank_in_group(code: np.ndarray) -> np.ndarray:
    """Occurrence number of each element among those with an equal code, in the given order."""
    order = _ordered(code)
    c = code[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = c[1:] != c[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order)) - start
    return rank


def prefix(n: np.ndarray, threshold: float) -> np.ndarray:
    """Budget that the prefix of a record of so many tokens reaches."""
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + COMMON


def signatures(owner: np.ndarray, h: np.ndarray, n_of: np.ndarray, threshold: float, ring: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, key, spent budget) of the prefix keys; ``owner, h`` as ``shingles`` gives them with an order; records of
    size 0 in ``n_of`` have no tokens here. Tokens of a sketch bucket that only one record has spend budget, but nobody
    shares them, so that they give no key."""
    need = prefix(n_of, threshold)
    first = np.concatenate([[0], np.cumsum(n_of)[:-1]])
    some = np.where(n_of > 0, np.minimum(n_of, need + ring), 0)
    near = np.arange(some.sum()) + np.repeat(first - np.cumsum(some) + some, some)
    owner, h = np.repeat(np.arange(len(n_of)), some), h[near]
    single = (h >> U(56)).astype(np.float64) <= 8 * math.log2(RARE) if ring else np.ones(len(h), dtype=bool)
    shared = (h >> U(56)) > U(0)
    t = h & LOW56
    cls = ((t >> U(20)) % U(max(1, ring))).astype(np.int64)
    inc = np.ones(len(owner), dtype=np.int64)
    many = np.flatnonzero(~single)
    inc[many] = _rank_in_group(owner[many] * max(1, ring) + cls[many]) >= 1
    got = np.cumsum(inc)
    base = np.concatenate([[0], got])[np.searchsorted(owner, np.arange(len(n_of)))]
    got = got - base[owner]
    keep = got - inc < need[owner]
    o, t, c, g, s, shared = owner[keep], t[keep], cls[keep], got[keep], single[keep], shared[keep]
    salt = U(0x51ED27 * (ring + 1))
    docs, keys, spent = [o[s & shared]], [mix(t[s & shared] + salt)], [g[s & shared]]
    o, t, c, g = o[~s], t[~s], c[~s], g[~s]
    code = o * max(1, ring) + c
    order = _ordered(code)
    o, t, g, code = o[order], t[order], g[order], code[order]
    for lag in range(1, len(o)):
        same = np.flatnonzero(code[lag:] == code[:-lag])
        if not len(same):
            break
        docs.append(o[same + lag])
        keys.append(mix(t[same] * U(3) + mix(t[same + lag]) + salt))
        spent.append(g[same + lag])
    return np.concatenate(docs), np.concatenate(keys), np.concatenate(spent)


def part_of(n: np.ndarray, threshold: float) -> np.ndarray:
    """The budget that one part of 255 of the prefix stands for."""
    return (prefix(n, threshold) + 254) // 255


POSTS = "bucket int, docs binary, sizes binary, counts binary, keys binary, spent binary"
PACKED = POSTS.replace(" int", "").replace(" binary", "").split(", ")


def postings_of(batches: Iterator[pa.RecordBatch], rank: np.ndarray, buckets: range, whole: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """The prefix keys of every record in some of the ``whole`` buckets, packed by bucket: records (id, size, number of
    keys), then their keys with the budget spent up to each, in parts of at most 255 of the prefix, rounded down."""
    for b in batches:
        for s in _slices(b):
            ids = s.column("doc").to_numpy(zero_copy_only=False)
            n_of, parts = np.zeros(len(ids), dtype=np.int64), []
            at = 0
            for few in _slices(s, CACHED):
                owner, h = shingles(few.column("text").to_pylist(), rank)
                n = n_of[at : at + few.num_rows]
                n += np.bincount(owner, minlength=len(n))
                for ring, low, high in modes(threshold):
                    if low > n.max():
                        break
                    part = (n >= low) & (n < high)
                    m = slice(None) if part.all() else part[owner]
                    o, k, g = signatures(owner[m], h[m], np.where(part, n, 0), threshold, ring)
                    where = (k % U(whole)).astype(np.int64) - buckets.start
                    here = np.flatnonzero((where >= 0) & (where < len(buckets)))
                    parts.append((where[here], o[here] + at, k[here], g[here]))
                at += few.num_rows
            where, o, k, g = (np.concatenate(x) for x in zip(*parts))
            by = _ordered(where * len(ids) + o)
            where, o, k, g = where[by], o[by], ((k[by] >> U(24)) & U(0xFFFFFFFF)).astype(np.uint32), g[by]
            g = (g // part_of(n_of[o], threshold)).astype(np.uint8)
            edges = np.searchsorted(where, np.arange(len(buckets) + 1))
            cols = [[] for _ in PACKED]
            for i in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                x, z = edges[i], edges[i + 1]
                first = np.flatnonzero(np.diff(o[x:z], prepend=-1))
                who, count = o[x:z][first], np.diff(first, append=z - x)
                for c, v in zip(cols, (buckets[i], steps(ids[who]), steps(n_of[who]), planes(count.astype(np.uint32)), k[x:z].tobytes(), g[x:z].tobytes())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], names=PACKED)


def postings(reps: DataFrame, sent, buckets: range, whole: int, threshold: float) -> DataFrame:
    """``postings_of`` all records; ``sent``: the broadcast order."""
    return reps.select("doc", "text").mapInArrow(lambda batches: postings_of(batches, sent.value, buckets, whole, threshold), POSTS)


def plan(reps: DataFrame, sent, rows: int, tokens: int, threshold: float) -> tuple[int, int]:
    """(rounds, buckets in a round) by the keys of a sample; both only share out the work."""
    some = reps.sample(min(1.0, SAMPLE / max(1, rows)), seed=1)

    def run(batches):
        for b in postings_of(batches, sent.value, range(1), 1, threshold):
            yield pa.RecordBatch.from_arrays([pa.array([len(unplaned(v.as_py(), np.uint32)) for v in b.column("counts")], pa.int64()), pa.array([len(v.as_py()) for v in b.column("spent")], pa.int64())], names=["records", "keys"])

    got = some.select("doc", "text").mapInArrow(run, "records bigint, keys bigint").agg(F.sum("records").alias("records"), F.sum("keys").alias("keys")).first()
    each = got["keys"] / got["records"] if got["records"] else 0
    buckets = max(8, math.ceil(each * rows / PER_BUCKET))
    entries = buckets * (1 - (1 - 1 / buckets) ** each)
    size = rows * (KEY_BYTES * each + ENTRY_BYTES * entries)
    rounds = min(ROUNDS, max(1, math.ceil(size / max(ROUND_BYTES, ROUND_SHARE * tokens))))
    return rounds, max(8, math.ceil(buckets / rounds))


def key_pairs(key: np.ndarray, n: np.ndarray, g: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs with equal keys within the prefixes their two sizes call for; ``key`` then ``n`` ascending."""
    at = np.arange(len(key) - 1)
    lag = 1
    while len(at):
        at = at[at + lag < len(key)]
        other = at + lag
        ok = (key[at] == key[other]) & (n[at] >= threshold * n[other] - 1e-9)
        at, other = at[ok], other[ok]
        alpha = np.ceil(threshold / (1 + threshold) * (n[at] + n[other]) - 1e-9).astype(np.int64) - COMMON
        good = (g[at] <= n[at] - alpha) & (g[other] <= n[other] - alpha)
        yield at[good], other[good]
        lag += 1


PAIRS = "part int, d1 binary, d2 binary, counts binary"


def shared_keys(post: DataFrame, parts: int, threshold: float) -> DataFrame:
    """Pairs of records with the number of keys they share in a bucket, packed by a hash of the pair."""

    def packed(docs: np.ndarray, code: list) -> pa.RecordBatch:
        pair, count = np.unique(np.concatenate(code), return_counts=True)
        x, y = docs[pair // len(docs)], docs[pair % len(docs)]
        d1, d2 = np.minimum(x, y), np.maximum(x, y)
        part = (mix(d1.view(np.uint64) + mix(d2.view(np.uint64))) % U(parts)).astype(np.int64)
        by = _ordered(part)
        d1, d2, count, part = d1[by], d2[by], np.minimum(count[by], 255).astype(np.uint8), part[by]
        edges = np.searchsorted(part, np.arange(parts + 1))
        some = np.flatnonzero(edges[1:] > edges[:-1])
        cut_at = [(edges[i], edges[i + 1]) for i in some.tolist()]
        cols = [steps(d1[a:z]) for a, z in cut_at], [planes(d2[a:z] - d1[a:z]) for a, z in cut_at], [count[a:z].tobytes() for a, z in cut_at]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32))] + [pa.array(c, pa.binary()) for c in cols], names=["part", "d1", "d2", "counts"])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = (unstepped, unstepped, lambda v: unplaned(v, np.uint32), lambda v: np.frombuffer(v, np.uint32), lambda v: np.frombuffer(v, np.uint8))
        got = [[] for _ in read]
        for b in batches:
            for into, name, one in zip(got, PACKED[1:], read):
                into += [one(v.as_py()) for v in b.column(name)]
        docs, size, count, keys, spent = (np.concatenate(x) for x in got)
        del got
        docs, inverse = np.unique(docs, return_inverse=True)
        doc, n = np.repeat(inverse, count), np.repeat(size, count)
        by = np.argsort((keys.astype(np.uint64) << U(32)) | n.astype(np.uint64))
        keys, doc, n, spent = keys[by], doc[by], n[by], spent[by].astype(np.int64)
        spent *= part_of(n, threshold)
        held, size = [], 0
        for x, y in key_pairs(keys, n, spent, threshold):
            if not len(x):
                continue
            p, q = doc[x], doc[y]
            code = (np.minimum(p, q) * len(docs) + np.maximum(p, q))[p != q]
            held += [code, np.repeat(code[n[x][p != q] < TINY], COMMON)]
            size += len(x)
            if size > HELD:
                yield packed(docs, held)
                held, size = [], 0
        if held:
            yield packed(docs, held)

    return post.groupBy("bucket").applyInArrow(run, PAIRS)


def candidates(shared: DataFrame, least: int) -> DataFrame:
    """(d1, d2): pairs that share so many keys over the buckets."""

    def counted(d1, d2, n):
        order = np.argsort(mix(d1.view(np.uint64) + mix(d2.view(np.uint64))), kind="stable")
        d1, d2, n = d1[order], d2[order], n[order]
        new = np.ones(len(d1), dtype=bool)
        new[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
        at = np.flatnonzero(new)
        return d1[at], d2[at], np.add.reduceat(n, at) if len(at) else n

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for row in zip(b.column("d1"), b.column("d2"), b.column("counts")):
                d1 = unstepped(row[0].as_py())
                held.append((d1, d1 + unplaned(row[1].as_py(), np.int64), np.frombuffer(row[2].as_py(), dtype=np.uint8)))
                size += len(held[-1][0])
                if size > 4 * HELD:
                    held = [counted(*(np.concatenate([h[i] for h in held]).astype(np.int64) for i in range(3)))]
                    size = len(held[0][0])
        d1, d2, n = counted(*(np.concatenate([h[i] for h in held]).astype(np.int64) for i in range(3)))
        yield pa.RecordBatch.from_arrays([pa.array(d1[n >= least]), pa.array(d2[n >= least])], names=["d1", "d2"])

    return shared.groupBy("part").applyInArrow(run, "d1 bigint, d2 bigint")


def chain_ok(diff: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """Whether some start on the ring has all its chains within the proportional budget; ``diff``: pairs x segments."""
    m = diff.shape[1]
    alive = np.flatnonzero(diff.min(axis=1) * m <= budget)
    out = np.zeros(len(diff), dtype=bool)
    if not len(alive):
        return out
    d, t = diff[alive].astype(np.int64), budget[alive]
    twice = np.concatenate([np.zeros((len(d), 1), np.int64), np.cumsum(np.concatenate([d, d], axis=1), axis=1)], axis=1)
    length = np.arange(1, m + 1)
    hit = np.zeros(len(d), dtype=bool)
    for i in range(m):
        rest = np.flatnonzero(~hit)
        if not len(rest):
            break
        sums = twice[rest, i + 1 : i + 1 + m] - twice[rest, i : i + 1]
        hit[rest] = (sums * m <= length * t[rest, None]).all(axis=1)
    out[alive] = hit
    return out


def pair_check(one: list[str], two: list[str], threshold: float) -> np.ndarray:
    """Similarity of each pair of texts that passes the pigeonring and the full check, else 0."""
    o1, h1 = shingles(one)
    o2, h2 = shingles(two)
    n1, n2 = np.bincount(o1, minlength=len(one)), np.bincount(o2, minlength=len(one))
    o, h = np.concatenate([o1, o2]), np.concatenate([h1, h2])
    order = np.lexsort((h, o))
    o, h = o[order], h[order]
    both = np.zeros(len(o), dtype=bool)
    if len(o):
        both[:-1] = (o[1:] == o[:-1]) & (h[1:] == h[:-1])
    lone = ~both
    lone[1:] &= ~both[:-1]
    # Differences by segment: the tokens that only one of the two has.
    diff = np.bincount(o[lone] * CHAIN + (mix(h[lone]) % U(CHAIN)).astype(np.int64), minlength=len(one) * CHAIN).reshape(len(one), CHAIN)
    budget = n1 + n2 - 2 * np.ceil(threshold / (1 + threshold) * (n1 + n2) - 1e-9).astype(np.int64)
    common = np.bincount(o[both], minlength=len(one))
    union = n1 + n2 - common
    alike = chain_ok(diff, budget) & (union > 0) & (common >= threshold * union - 1e-9)
    return np.where(alike, common / np.maximum(union, 1), 0.0)


def full_check(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(rep1, rep2, similarity) of the candidates whose true sets are alike. Sizes of what comes out of Python are unknown
    to the planner, so both joins are shuffled whatever it thinks of them; a Bloom filter spares texts of no candidate."""
    spark = reps.sparkSession
    sent = spark.sparkContext.broadcast(bloom.build(pairs.select(F.explode(F.array("d1", "d2")).alias("doc")).distinct().select(F.xxhash64("doc").alias("h"))))

    @F.arrow_udf("boolean")
    def asked(h: pa.Array) -> pa.Array:
        return pa.array(bloom.maybe(sent.value, h.to_numpy(zero_copy_only=False)))

    reps = reps.where(asked(F.xxhash64("doc")))
    one = reps.select(F.col("doc").alias("d1"), F.col("rep").alias("rep1"), F.col("text").alias("t1"))
    two = reps.select(F.col("doc").alias("d2"), F.col("rep").alias("rep2"), F.col("text").alias("t2"))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                r1, r2, t1, t2 = (s.column(c).to_pylist() for c in ("rep1", "rep2", "t1", "t2"))
                got = pair_check(t1, t2, threshold)
                out = [(min(p, q), max(p, q), v) for p, q, v in zip(r1, r2, got.tolist()) if v and p != q]
                cols = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["rep1", "rep2", "similarity"])

    joined = pairs.hint("merge").join(one.hint("merge"), "d1").hint("merge").join(two.hint("merge"), "d2")
    return joined.select("rep1", "rep2", "t1", "t2").mapInArrow(run, "rep1 string, rep2 string, similarity double")


def text_key() -> list[Column]:
    """128 bits of hash that stand for the text."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


def classes(records: DataFrame) -> DataFrame:
    """(doc, rep, copies, t1, t2, text): one row per distinct text, its smallest id and how many ids have it, texts of like
    size side by side; to be kept before it is read twice, as it numbers the rows. ``records``: id, text."""
    per = records.select("id", "text", *text_key()).groupBy("t1", "t2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min("text").alias("text"))
    return per.sortWithinPartitions(F.char_length("text")).select(F.monotonically_increasing_id().alias("doc"), "rep", "copies", "t1", "t2", "text")


def records(df: DataFrame, key: str, *parts: str) -> DataFrame:
    """(id, text): each id once, with its normalised text."""
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), normal_text(*[F.col(p) for p in parts]).alias("text")).groupBy("id").agg(F.max("text").alias("text"))


def similar_classes(reps: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(rep1, rep2, similarity) of all pairs of different texts that are alike; ``reps`` is read several times."""
    t = settings.threshold
    spark = reps.sparkSession
    size = reps.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars")).first()
    tokens, pairs = size["chars"], None
    with freed(spark):
        sent = spark.sparkContext.broadcast(token_order(reps, tokens))
        rounds, per = plan(reps, sent, size["rows"], tokens, t)
        for r in range(rounds):
            post = postings(reps, sent, range(r * per, (r + 1) * per), rounds * per, t)
            found = candidates(shared_keys(post, 4 * per, t), math.ceil(COMMON / rounds))
            pairs = once(found if pairs is None else pairs.unionByName(found).dropDuplicates(["d1", "d2"]))
        return full_check(pairs, reps, t)


def members(recs: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, rep, copies) of the ids whose text several ids have; salted, as one text may have a third of all ids."""
    several = reps.where("copies > 1").select("t1", "t2", "rep", "copies", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    side = recs.select("id", *text_key(), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    return side.hint("merge").join(several.hint("merge"), ["t1", "t2", "salt"]).select("id", "rep", "copies")


def alike_pairs(recs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(id1, id2) of all alike pairs of ids, smaller id first; large classes of equal texts as links to their smallest id."""
    with freed(recs.sparkSession), ExitStack() as at_end:
        with stored(recs) as kept:
            reps = at_end.enter_context(stored(classes(kept)))
            long = reps.where(F.char_length("text") >= WIDTH)
            own = once(members(kept, long))
        links = once(similar_classes(long, settings).select("rep1", "rep2"))
    small = own.where(F.col("copies") <= settings.expand)
    others = small.where("id <> rep").hint("merge")
    first = links.hint("merge").join(others.select(F.col("rep").alias("rep1"), F.col("id").alias("x1")), "rep1").select(F.col("x1").alias("rep1"), "rep2")
    wide = links.select("rep1", "rep2").unionByName(first)
    second = wide.hint("merge").join(others.select(F.col("rep").alias("rep2"), F.col("id").alias("x2")), "rep2").select("rep1", F.col("x2").alias("rep2"))
    a, b = small.alias("a").hint("merge"), small.alias("b").hint("merge")
    inside = a.join(b, (F.col("a.rep") == F.col("b.rep")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("rep1"), F.col("b.id").alias("rep2"))
    star = own.where((F.col("copies") > settings.expand) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("rep1"), F.col("id").alias("rep2"))
    every = wide.unionByName(second).unionByName(inside).unionByName(star)
    return every.select(F.least("rep1", "rep2").alias("id1"), F.greatest("rep1", "rep2").alias("id2")).dropDuplicates(["id1", "id2"])


def memberships(recs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(id, class_id, copies, links, group_id): every id with the smallest id of its text, how many ids have that text, to how
    many other ids it is alike, and the smallest id of all that are linked to it by chains of likeness."""
    with freed(recs.sparkSession), ExitStack() as at_end:
        with stored(recs) as kept:
            reps = at_end.enter_context(stored(classes(kept)))
            recs = once(kept.select("id").hint("merge").join(members(kept, reps).select("id", "rep").hint("merge"), "id", "left").select("id", F.coalesce("rep", "id").alias("rep")))
        pairs = once(similar_classes(reps.where(F.char_length("text") >= WIDTH), settings).select("rep1", "rep2"))
        reps = cut(reps.select("rep", "copies", (F.char_length("text") >= WIDTH).alias("long")))
    long = reps.where("long")
    both = pairs.unionByName(pairs.select(F.col("rep2").alias("rep1"), F.col("rep1").alias("rep2")))
    size = long.select(F.col("rep").alias("rep2"), "copies").hint("merge")
    near = both.hint("merge").join(size, "rep2").groupBy("rep1").agg(F.sum("copies").alias("near")).withColumnRenamed("rep1", "rep")
    group = groups(pairs.select(F.col("rep1").alias("id1"), F.col("rep2").alias("id2"))).withColumnRenamed("id", "rep")
    per = reps.hint("merge").join(near.hint("merge"), "rep", "left").hint("merge").join(group.hint("merge"), "rep", "left")
    alone = F.when(F.col("long"), F.col("copies") - 1).otherwise(0)
    per = per.select("rep", "copies", (alone + F.coalesce("near", F.lit(0))).alias("links"), F.coalesce("group_id", "rep").alias("group_id"))
    salted = per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = recs.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).hint("merge").join(salted.hint("merge"), ["rep", "salt"])
    return out.select("id", F.col("rep").alias("class_id"), "copies", "links", "group_id")


def groups(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, group_id): connected components of the pairs by alternating large and small stars, until nothing changes."""
    edges = cut(pairs.select(F.col("id1").alias("u"), F.col("id2").alias("v")).where("u <> v").dropDuplicates())
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).hint("merge")
        large = both.hint("merge").join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").dropDuplicates()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.hint("merge").join(low2.hint("merge"), "u")
        new = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).dropDuplicates()
        new = cut(new)
        same = new.hint("merge").join(edges.hint("merge"), ["u", "v"], "left_anti").isEmpty() and edges.hint("merge").join(new.hint("merge"), ["u", "v"], "left_anti").isEmpty()
        edges = new
        if same:
            break
    label = edges.groupBy("u").agg(F.min("v").alias("group_id"))
    roots = edges.select(F.col("v").alias("u")).distinct().hint("merge").join(label.hint("merge"), "u", "left_anti").select("u", F.col("u").alias("group_id"))
    return label.unionByName(roots).select(F.col("u").alias("id"), "group_id")
