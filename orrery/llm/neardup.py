"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

Documents with equal shingle sets form a class first, so copies cost one row each. The classes of a
band bucket are compared with one class of it, the pivot, not with each other, and components
are formed. Where a group still holds several components, its members are told apart by what
differs from the pivot. For sets x, y and pivot p with Dx = x ^ p, Dy = y ^ p (symmetric differences),

    similarity(x, y) >= 3/4   if and only if   14 |Dx & Dy| >= (7 |Dx| - |x|) + (7 |Dy| - |y|),

so a pair that may be linked shares one of the first elements of Dx and Dy in any common order, and
what the whole group shares is in no difference. Members that share such an element are a new,
smaller group with a pivot of its own. No pair is lost, and a group of near copies costs linear work.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize
from .textkit import by_bytes, shingle_sets

SHINGLE = 5
NUM, DEN = 75, 100
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Signature values compared at a time, and the chance of dropping a pair at the threshold in one step.
STEP, MISS = 32, 1e-7
#: similarity >= NUM / DEN of sets x, y is GAP * |x ^ y| <= |x| + |y|.
GAP = (DEN + NUM) // (DEN - NUM)
#: Parts into which the rows of one key go, in joins and beside a pivot.
SALTS, PIVOT_PARTS = 8, 64
#: Frequent shingles that the order of difference elements knows of; it changes the work, not the links.
COMMON = 20_000
#: Bits of the sketch of a shingle set; fewer or more change the work, not the links.
SKETCH = 2048
#: Links whose components one task finds.
ONE_TASK = 200_000
#: Words of 64 bits that tell the ids of rows with candidates.
WORDS = 1 << 18
#: Bins of difference sizes for a factor e.
BINS = 5
#: Pivots of a set of members with a common element of their differences.
PIVOTS = 64
#: Bytes of documents a task, where tables derived from them are computed in Python or written: a task and a file
#: for each shuffle partition cost more than the work, where partitions are many and small.
TASK_BYTES = 2 << 20
#: Bytes of a written table that is read back as one partition, so that what follows needs no shuffle.
ONE_READ = 1 << 19
#: Bytes of a table that a join sends to all executors instead of shuffling both sides.
SENT = 2 << 20
#: More tasks than any shuffle has, for tables of unknown size.
MOST_TASKS = 1 << 20
_R = np.random.default_rng(20240229)
_A = _R.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32) | np.uint32(1)
_B = _R.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)


def signature(shingles: np.ndarray) -> bytes:
    """HASHES minima of multiply-add hashes, the high 16 bits of each (a band takes ROWS of them)."""
    if not len(shingles):
        return b""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 1024):
        h = x[at : at + 1024, None] * _A + _B
        np.minimum(low, (h ^ (h >> np.uint32(15))).min(0), out=low)
    # minima crowd near 0: stretch them by a hash before the high bits are kept
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").tobytes()


@lru_cache
def least_matches(step: int = STEP, hashes: int = HASHES, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """(n, m): after n compared hashes a pair with fewer than m matches is dropped.

    With a uniform prior the similarity given k of n matches is Beta(k + 1, n - k + 1), and
    P(similarity >= t) is P(Binomial(n + 1, t) <= k); m is the first k where it reaches ``miss``.
    """
    t, out = NUM / DEN, []
    for n in range(step, hashes + 1, step):
        p, total, k = (1 - t) ** (n + 1), 0.0, 0
        while True:
            total += p
            if total >= miss:
                break
            p *= (n + 1 - k) / (k + 1) * t / (1 - t)
            k += 1
        out.append((n, k))
    return tuple(out)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SKETCH bits, each the parity of the shingles that fall on it.

    What both sets hold cancels out, so two sketches differ in at most as many bits as the sets in elements.
    """
    odd = np.bincount((shingles % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def stored_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of ``df``: of a table in files their size, of unknown ones more than any table has."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def tasks_for(docs: DataFrame) -> int:
    """Tasks for tables derived from ``docs``: in proportion to its bytes, and enough for all cores."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return max(2 * cores, min(stored_bytes(docs) // TASK_BYTES, MOST_TASKS))


def in_tasks(df: DataFrame, tasks: int | None) -> DataFrame:
    """``df`` with its partitions put together to at most ``tasks``, without a shuffle (None: as they are)."""
    return df if tasks is None else df.coalesce(tasks)


def saved(df: DataFrame, label: str, tasks: int | None, batch_rows: int | None = None) -> DataFrame:
    """``materialize`` by at most ``tasks`` tasks; a small table is read back as one partition."""
    out = materialize(in_tasks(df, tasks), label, batch_rows)
    return out.coalesce(1) if stored_bytes(out) <= ONE_READ else out


def prepare(docs: DataFrame, digests: bool = False) -> DataFrame:
    """(doc_id, n_shingles, cls, sig) of each row: cls names its shingle set, null if that is empty.

    ``digests`` adds the text's ``digest``, which with doc_id is the key of a row.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("sig", pa.binary()), *[("digest", pa.binary())] * digests])

    def run(batches):
        for b in batches:
            ids = b.column(0)
            texts = b.column(1).to_pylist()
            for at, blobs in by_bytes(texts):
                sets = shingle_sets(blobs, SHINGLE)
                cls = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                out = {"doc_id": ids.slice(at, len(blobs)), "n_shingles": [len(s) for s in sets], "cls": cls, "sig": [signature(s) for s in sets]}
                if digests:
                    out["digest"] = [b"" if t is None else hashlib.md5(t.encode()).digest() for t in texts[at : at + len(blobs)]]
                yield pa.RecordBatch.from_pydict(out, schema=kind)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, cls binary, sig binary" + ", digest binary" * digests)


def salted(rows: DataFrame, few: DataFrame, on: str, by: str, how: str = "inner") -> DataFrame:
    """Join of ``rows`` with ``few`` (one row a key) where a key may hold very many of ``rows``.

    Rows of one key are spread over SALTS parts by ``by``; ``few`` is repeated for each part. Where
    ``few`` is known to be small it goes to all executors instead, and ``rows`` stay where they are.
    """
    if stored_bytes(few) <= SENT:
        return rows.join(F.broadcast(few), on, how)
    parts = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(parts, [on, "__salt"], how).drop("__salt")


def beside_pivots(pairs: DataFrame, data: DataFrame, payload: list[str], keep: list[str]) -> DataFrame:
    """Rows (p, x, *payload, *keep): each pivot's own row (x null) and behind it those of its members.

    A pivot's members are spread over PIVOT_PARTS parts, and each part that has some gets a row of the pivot.
    """
    rows = pairs.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(PIVOT_PARTS)).cast("int"))
    own = rows.join(data.select(F.col("cls").alias("x"), *payload), "x").select("p", "part", "x", *payload, *keep)
    head = rows.select("p", "part").distinct().join(data.select(F.col("cls").alias("p"), *payload), "p")
    head = head.select("p", "part", F.lit(None).cast("binary").alias("x"), *payload, *(F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in keep))
    both = own.unionByName(head).repartition("p", "part").sortWithinPartitions("p", "part", F.col("x").asc_nulls_first())
    return both.select("p", "x", *payload, *keep)


def plausible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of the signature tables x and y that survive their sequential comparison."""
    matches, done, at = np.zeros(len(x), np.int64), 0, np.arange(len(x))
    for n, least in least_matches():
        matches = matches + (x[at, done:n] == y[at, done:n]).sum(1)
        keep = matches >= least
        at, matches, done = at[keep], matches[keep], n
    return at


def verify(pairs: DataFrame, texts: DataFrame, tasks: int | None = None) -> DataFrame:
    """Pairs (p, x) with 100 * intersection >= 75 * union, of those whose signatures are plausible."""

    def run(batches):
        sig, text, own = np.zeros(HASHES, "<u2"), "", None
        for batch in batches:
            if not batch.num_rows:
                continue
            # row 0 is the pivot that the last batch ended with
            head = np.array(batch.column(1).is_null())
            sigs = np.vstack([sig[None], np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(-1, HASHES)])
            of = np.maximum.accumulate(np.where(head, np.arange(1, len(head) + 1), 0))
            rows = np.flatnonzero(~head)
            rows = rows[plausible(sigs[rows + 1], sigs[of[rows]])]
            sets = {0: own}
            for part in np.array_split(rows, len(rows) // 256 + 1):
                asked = sorted({*(part + 1).tolist(), *of[part].tolist()} - (set() if own is None and 0 in of[part] else {0}))
                sets = {k: v for k, v in sets.items() if v is not None and (k in asked or k == 0)}
                asked = [i for i in asked if i not in sets]
                for at, blobs in by_bytes([text if i == 0 else batch.column(3)[i - 1].as_py() for i in asked]):
                    sets.update(zip(asked[at : at + len(blobs)], shingle_sets(blobs, SHINGLE), strict=True))
                own = sets.get(0)
                ok = []
                for i in part.tolist():
                    s, p = sets[i + 1], sets[int(of[i])]
                    both = len(np.intersect1d(s, p, assume_unique=True))
                    if DEN * both >= NUM * (len(s) + len(p) - both):
                        ok.append(i)
                yield batch.select([0, 1]).take(pa.array(ok, pa.int64()))
            if of[-1]:
                sig, text, own = sigs[of[-1]], batch.column(3)[int(of[-1]) - 1].as_py(), None

    return in_tasks(beside_pivots(pairs, texts, ["sig", "text"], []), tasks).mapInArrow(run, "p binary, x binary")


def _sets_beside_pivots(batches):
    """(batch slice, sets, pivot sets) of rows from ``beside_pivots`` with texts; pivot rows are left out."""
    pivot = np.zeros(0, np.uint64)
    for batch in batches:
        for at, blobs in by_bytes(batch.column(2).to_pylist()):
            part, own, pivots, picked = batch.slice(at, len(blobs)), [], [], []
            for i, (s, x) in enumerate(zip(shingle_sets(blobs, SHINGLE), part.column(1).to_pylist(), strict=True)):
                if x is None:
                    pivot = s
                else:
                    own.append(s)
                    pivots.append(pivot)
                    picked.append(i)
            if picked:
                yield part.take(pa.array(picked)), own, pivots


def _joined(batches):
    """(cls, label) of all ends of the links in ``batches``, by union and find; roots are the smallest ends."""
    up: dict[bytes, bytes] = {}

    def root(c: bytes) -> bytes:
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = root(up.setdefault(a, a)), root(up.setdefault(b, b))
            if a != b:
                up[max(a, b)] = min(a, b)
    ends = list(up)
    for i in range(0, len(ends), 10_000):
        part = ends[i : i + 10_000]
        yield pa.RecordBatch.from_pydict({"cls": part, "label": [root(c) for c in part]}, schema=pa.schema([("cls", pa.binary()), ("label", pa.binary())]))


def components(links: DataFrame) -> DataFrame:
    """(cls, label) for every end of ``links`` (a, b): label is the component's smallest class.

    Up to ONE_TASK links are joined by one task. Beyond, alternating large and small stars; a round is two minima per node and two joins, written to the
    shared folder. It ends when every node has one edge, to a node without a smaller neighbour.
    """
    if links.count() <= ONE_TASK:
        return materialize(links.select("a", "b").coalesce(1).mapInArrow(_joined, "cls binary, label binary"), "labels")
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # a hub has its many neighbours here; afterwards a node's edges lead to the minima of its hubs
        large = salted(both.where("v > u"), low, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialize(small.distinct(), "stars")
        ends = edges.select("u", F.lit(1).alias("n"), F.lit(0).alias("low")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("n"), F.lit(1).alias("low")))
        if ends.groupBy("u").agg(F.sum("n").alias("n"), F.max("low").alias("low")).where("n > 1 or (n = 1 and low = 1)").isEmpty():
            break
    return edges.select(F.col("u").alias("cls"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("cls"), F.col("v").alias("label")).distinct())


def band_hashes():
    """The bucket of each band of a signature."""
    return F.array(*(F.xxhash64(F.substring("sig", 2 * ROWS * k + 1, 2 * ROWS), F.lit(k)) for k in range(BANDS)))


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """(hash, count) of at most COMMON shingles in the order of hashes, from each task's most frequent ones."""

    def run(batches):
        seen: dict[int, int] = {}
        for b in batches:
            for _, blobs in by_bytes(b.column(0).to_pylist()):
                own, n = np.unique(np.concatenate(shingle_sets(blobs, SHINGLE)), return_counts=True)
                for h, k in zip(own[n > 1].tolist(), n[n > 1].tolist(), strict=True):
                    seen[h] = seen.get(h, 0) + k
            if len(seen) > 20 * COMMON:
                seen = dict(sorted(seen.items(), key=lambda e: -e[1])[:COMMON])
        top = sorted(seen.items(), key=lambda e: (-e[1], e[0]))[:COMMON]
        yield pa.RecordBatch.from_pydict({"h": [h - (1 << 63) for h, _ in top], "n": [n for _, n in top]}, schema=pa.schema([("h", pa.int64()), ("n", pa.int64())]))

    counts = texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(COMMON).collect()
    return np.array(sorted((r["h"] + (1 << 63), r["n"]) for r in counts), np.uint64).reshape(-1, 2)


def differences(members: DataFrame, texts: DataFrame, common, tasks: int | None = None) -> DataFrame:
    """(gid, x, label, deg, d, e, near, first) of each member (gid, p, x, label, deg).

    d is the size of x's difference from the pivot, e is GAP * d - |x|, near says that x and the
    pivot are linked, first holds the elements of the difference that a linked pair may have to
    share: those that the pivot lacks, rare ones first (``common`` is the broadcast of
    ``frequent_shingles``), before those that x lacks.
    """
    names = ["gid", "x", "label", "deg", "d", "e", "near", "first"]
    kind = pa.schema([("gid", pa.binary()), ("x", pa.binary()), ("label", pa.binary()), ("deg", pa.int64()), ("d", pa.int64()), ("e", pa.int64()), ("near", pa.bool_()), ("first", pa.binary())])

    def run(batches):
        hashes, counts = common.value[:, 0], common.value[:, 1]
        for part, own, pivots in _sets_beside_pivots(batches):
            d, e, near, first = [], [], [], []
            for s, p in zip(own, pivots, strict=True):
                more, less = np.setdiff1d(s, p, assume_unique=True), np.setdiff1d(p, s, assume_unique=True)
                size = len(more) + len(less)
                excess = GAP * size - len(s)
                linked = excess <= len(p)
                # a member that is linked with the pivot is only compared with those that are not; others with sets of up to 4/3 of their size
                least = excess + len(p) + 1 if linked else excess - 4 * len(s) // 3
                prefix = max(0, size - max(1, -(-least // (2 * GAP))) + 1)
                if len(hashes) and prefix:
                    at = np.minimum(np.searchsorted(hashes, more), len(hashes) - 1)
                    more = more[np.argsort(np.where(hashes[at] == more, counts[at], np.uint64(0)), kind="stable")]
                d.append(size)
                e.append(excess)
                near.append(linked)
                first.append(np.concatenate([more, less])[:prefix].tobytes())
            cols = [part.column(3), part.column(1), part.column(4), part.column(5), pa.array(d, pa.int64()), pa.array(e, pa.int64()), pa.array(near), pa.array(first, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema=kind)

    rows = in_tasks(beside_pivots(members, texts, ["text"], ["gid", "label", "deg"]), tasks)
    return rows.mapInArrow(run, "gid binary, x binary, label binary, deg long, d long, e long, near boolean, first binary").select(*names)


def near_enough(own: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (p, x) of members with their ``pivots``, without those whose sketches differ in too many bits for a link.

    The bound is exact; it keeps texts and signatures of most pairs from being moved.
    """
    bits = texts.select("cls", "size", "bits")
    own = own.join(bits.withColumnRenamed("cls", "x"), "x").select("x", "size", "bits", F.explode("pivots").alias("p"))
    both = own.join(bits.select(F.col("cls").alias("p"), F.col("size").alias("size_p"), F.col("bits").alias("bits_p")), "p")
    apart = F.aggregate(F.zip_with("bits", "bits_p", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, k: n + k)
    return both.where(GAP * F.greatest(apart.cast("long"), F.abs(F.col("size") - F.col("size_p"))) <= F.col("size") + F.col("size_p")).select("p", "x")


def may_be_linked(p):
    """Whether a row asks for its pivot ``p``: one of another label, before it in order, and of a size that a link allows."""
    before = (p["deg"] > F.col("deg")) | (p["deg"] == F.col("deg")) & (p["x"] > F.col("x"))
    return (p["label"] != F.col("label")) & before & (GAP * F.abs(p["size"] - F.col("size")) <= p["size"] + F.col("size"))


def open_members(met: DataFrame) -> DataFrame:
    """Groups (gid, p, x, deg, label) of the members (bucket, p, x, deg, label) whose bucket holds several labels.

    Only members that share a bucket need to be compared: where all that were compared with the bucket's
    pivot have one label, nothing is left to do there, whatever the pivot's other buckets hold.
    """
    mixed = met.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("bucket")
    return salted(met, mixed, "bucket", "x").select(F.col("p").alias("gid"), "p", "x", "deg", "label").distinct()


def smaller_groups(members: DataFrame, texts: DataFrame, common, tasks: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Pairs (p, x) to compare and groups (gid, p, x, deg) still open after them, of groups (gid, p, x, label, deg); None without any.

    Members are put in bins by the size of their differences. For each bin on the other side it follows from
    the least ``e`` there how many elements a pair must share, so how many of the first ones have to
    be looked at; most bins are out of reach or hold the member's own label only. Members that look
    at each other's bins with an element in common meet. Of those that meet, PIVOTS are compared
    with all; the others form a group, one for all that have a first pivot in common.
    """
    diffs = differences(members, texts, common, tasks).withColumn("bin", 2 * F.floor(F.log("d") * BINS).cast("int") + F.col("near").cast("int"))
    diffs = saved(diffs, "differences", tasks)
    sides = diffs.groupBy("gid", "bin").agg(F.min("e").alias("e"), F.max("d").alias("d"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    sides = sides.groupBy("gid").agg(F.collect_list(F.struct("bin", "e", "d", "l0", "l1")).alias("sides"))  # bins grow with the logarithm of d

    def way(side):
        need = F.greatest(F.lit(1), F.ceil((F.col("e") + side["e"]) / (2 * GAP)))
        return F.struct(F.least("bin", side["bin"]).alias("i"), F.greatest("bin", side["bin"]).alias("j"), F.when((need <= F.least("d", side["d"])) & ((F.col("label") != side["l0"]) | (F.col("label") != side["l1"])), F.col("d") - need + 1).alias("n"))

    asked = salted(diffs, sides, "gid", "x").select("gid", "x", "label", "deg", (GAP * F.col("d") - F.col("e")).alias("size"), F.explode(F.filter(F.transform("sides", way), lambda w: w["n"].isNotNull())).alias("w"), "first")
    asked = asked.select("gid", "x", "label", "deg", "size", F.xxhash64("gid", "w.i", "w.j").alias("spot"), "w.n", "first")

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                first = [np.frombuffer(f, np.int64)[:n] for f, n in zip(part.column(7).to_pylist(), part.column(6).to_pylist(), strict=True)]
                row = pa.array(np.repeat(np.arange(len(first)), [len(f) for f in first]))
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(row) for k in range(6)), pa.array(np.concatenate(first))], names=["gid", "x", "label", "deg", "size", "spot", "h"])

    met = in_tasks(asked, tasks).mapInArrow(run, "gid binary, x binary, label binary, deg long, size long, spot long, h long")
    met = saved(met.withColumn("spot", F.xxhash64("spot", "h")).drop("h"), "elements", tasks)
    spots = met.groupBy("spot").agg(F.min(F.xxhash64("label")).alias("l0"), F.max(F.xxhash64("label")).alias("l1"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("x")).alias("s"), F.bit_xor(F.xxhash64("label", "x")).alias("t")).where("l0 <> l1")
    spots = spots.groupBy("n", "s", "t").agg(F.min("spot").alias("spot")).select("spot", "n")  # the same members meet once
    spots = saved(spots, "spots", tasks)
    if spots.isEmpty():
        return None
    met = saved(salted(met, spots, "spot", "x"), "meetings", tasks)
    nth = F.row_number().over(Window.partitionBy("spot").orderBy(F.desc("deg"), F.desc("x")))
    top = met.select("spot", "deg", "x", "label", "size").withColumn("nth", nth).where(F.col("nth") <= PIVOTS)
    top = saved(top.groupBy("spot").agg(F.reverse(F.array_sort(F.collect_list(F.struct("deg", "x", "label", "size")))).alias("pivots")), "pivots", tasks)
    seen = salted(met, top, "spot", "x").select("spot", "gid", "n", "x", "deg", "label", "size", "pivots")
    # a member gets the pivots of all its meetings together, so that a pair comes up once
    own = seen.select("x", F.transform(F.filter("pivots", may_be_linked), lambda p: p["x"]).alias("pivots")).where(F.size("pivots") > 0)
    own = own.groupBy("x").agg(F.array_distinct(F.flatten(F.collect_set("pivots"))).alias("pivots"))
    pairs = near_enough(own, texts)
    others = seen.where((F.col("n") > PIVOTS + 1) & ~F.exists("pivots", lambda p: p["x"] == F.col("x")))
    groups = others.withColumn("p", F.col("pivots")[0]["x"]).select(F.unhex(F.md5(F.concat("gid", "p"))).alias("gid"), "p", "x", "deg")
    return pairs, saved(groups.distinct(), "groups", tasks)


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (one column), and some more.

    Ids are known by one of 64 * WORDS bits, a table of at most WORDS rows that is broadcast: texts that are
    not asked for stay where they are, whatever the number of ids.
    """

    def place(c):
        return F.pmod(F.xxhash64(c), F.lit(64 * WORDS))

    bit = place(ids.columns[0])
    words = ids.select(F.shiftright(bit, 6).alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int")).alias("__bits"))
    words = words.groupBy("__word").agg(F.bit_or("__bits").alias("__bits"))
    rows = docs.withColumn("__place", place("doc_id")).withColumn("__word", F.shiftright("__place", 6)).join(F.broadcast(words), "__word")
    return rows.where(F.getbit("__bits", F.col("__place").bitwiseAND(63).cast("int")) == 1).select(docs.columns)


def link_classes(base: DataFrame, docs: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cls, rep, n, sig) of all classes, with smallest doc_id and number of rows, and (cls, label) of those that are linked with others.

    Groups start as the band buckets, those with one pivot together, and their members are compared with
    the pivot. In each round components are formed anew, and groups whose members still have several
    labels are told apart by ``smaller_groups``; in the first, that is members of buckets that do
    (``open_members``). A group never holds the pivots it came from.
    """
    picked = base.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("sig").alias("sig"))
    classes = saved(picked, "classes", tasks)
    bands = classes.select("cls", F.explode(band_hashes()).alias("bucket"))
    shared = saved(bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared-buckets", tasks)
    # the class with the most neighbours is near the middle of its group: a better pivot than any other
    members = salted(bands, shared, "bucket", "cls").groupBy("cls").agg(F.sum("n").alias("deg"), F.collect_list("bucket").alias("buckets"))
    wanted = saved(classes.join(members, "cls").select("cls", "rep", "sig", "deg", "buckets"), "candidates", tasks)
    members = wanted.select(F.explode("buckets").alias("bucket"), "cls", "deg")
    # texts of the classes that have candidates; a doc_id may come with several texts, so cls is checked
    rows = with_ids(docs.select("doc_id", "text"), wanted.select("rep")).join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("cls", "sig", "text")
    texts = saved(_texts(in_tasks(rows, tasks)).dropDuplicates(["cls"]), "candidate-texts", tasks, 2000)
    pivots = members.groupBy("bucket").agg(F.max(F.struct("deg", "cls"))["cls"].alias("p"))
    met = saved(salted(members, pivots, "bucket", "cls").where("cls <> p").select("bucket", "p", F.col("cls").alias("x"), "deg"), "band-members", tasks)
    pairs, groups, tested, labels, common = saved(met.select("p", "x").distinct(), "pairs", tasks), None, None, None, None
    while True:
        if tested is not None:  # compared before, in either direction
            pairs = pairs.select(F.least("p", "x").alias("p"), F.greatest("p", "x").alias("x"))
            pairs = pairs.join(tested, ["p", "x"], "left_anti")
            pairs = saved(pairs, "pairs", tasks)
        links = saved(verify(pairs, texts, tasks), "confirmed", tasks, 1000).select(F.col("p").alias("a"), F.col("x").alias("b"))
        if labels is None:
            labels = components(links)
        elif not links.isEmpty():
            labels = components(links.unionByName(labels.select(F.col("cls").alias("a"), F.col("label").alias("b"))))
        if groups is not None and groups.isEmpty():
            return classes, labels
        pairs = pairs.select(F.least("p", "x").alias("p"), F.greatest("p", "x").alias("x"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        named = (met if groups is None else groups).join(labels.withColumnRenamed("cls", "x"), "x", "left").withColumn("label", F.coalesce("label", "x"))
        if groups is None:
            left = open_members(named)
        else:
            mixed = named.groupBy("gid").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("gid")
            left = salted(named, mixed, "gid", "x")
        left = saved(left, "mixed", tasks)
        if left.isEmpty():
            return classes, labels
        if common is None:
            common = docs.sparkSession.sparkContext.broadcast(frequent_shingles(texts))  # at most COMMON rows
        found = smaller_groups(left, texts, common, tasks)
        if found is None:
            return classes, labels
        pairs, groups = found


def _texts(rows: DataFrame) -> DataFrame:
    """Rows (cls, sig, text) whose text has the shingle set that cls names, with the set's size and sketch."""
    kind = pa.schema([("cls", pa.binary()), ("sig", pa.binary()), ("text", pa.string()), ("size", pa.int64()), ("bits", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            for at, blobs in by_bytes(b.column(2).to_pylist()):
                part, sets = b.slice(at, len(blobs)), shingle_sets(blobs, SHINGLE)
                own = [i for i, (s, c) in enumerate(zip(sets, part.column(0).to_pylist(), strict=True)) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == c]
                cols = [*part.take(pa.array(own, pa.int64())).columns, pa.array([len(sets[i]) for i in own], pa.int64()), pa.array([sketch(sets[i]) for i in own], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, schema=kind)

    return rows.mapInArrow(run, "cls binary, sig binary, text string, size long, bits array<long>")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Null, empty and word-less texts have no shingles and form components of their own. Rows that
    repeat a doc_id keep their rows; equal texts are linked whatever their ids. kept is true where
    doc_id is the component's smallest (of rows repeating that doc_id, all are kept); a null
    doc_id counts only where a component has no other. Other columns of ``docs`` play no part. Texts
    of any length are hashed whole, one at a time. An empty table gives an empty table.
    """
    base, tasks = materialize(prepare(docs), "near-base"), tasks_for(docs)
    classes, labels = link_classes(base, docs, tasks)
    own = classes.select("cls", F.col("rep").alias("low"), "n").join(labels, "cls", "left")
    # most classes are one document without links: their component is the document itself
    own = own.where("n > 1 or label is not null").withColumn("label", F.coalesce("label", "cls"))
    lowest = own.groupBy("label").agg(F.min("low").alias("component_id"))
    named = own.join(lowest, "label").select("cls", F.struct("component_id").alias("found"))
    # copies of one text share a class: the class side is repeated over salts
    named = named.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = base.select("doc_id", "n_shingles", "cls").withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = in_tasks(rows.join(named, ["cls", "__salt"], "left"), tasks)
    out = out.withColumn("component_id", F.when(F.col("found").isNull(), F.col("doc_id")).otherwise(F.col("found.component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns of ``docs``.

    Kept is the row of the component's smallest doc_id (a null one is the largest), of rows that
    repeat that one the text of the smallest digest. Rows without shingles are components of their
    own; those that repeat both doc_id and text are reduced to one. Columns may have any names. An
    empty table gives an empty table.
    """
    base = materialize(prepare(docs, digests=True), "near-base")
    _, labels = link_classes(base, docs, tasks_for(docs))
    own = base.where("cls is not null").groupBy("cls").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "digest")).alias("row"))
    first = own.join(labels, "cls", "left").groupBy(F.coalesce("label", "cls").alias("label")).agg(F.min("row").alias("row"))
    keys = first.select("row.doc_id", "row.digest").unionByName(base.where("cls is null").select("doc_id", "digest"))
    # a null doc_id gets a key of its own by the flag, so that the join is one of plain equality
    key = [F.isnull("doc_id").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("key")]
    kept = keys.select(*key, "digest")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *key, F.coalesce(F.unhex(F.md5("text")), F.lit(b"")).alias("digest"))
    rows = rows.join(kept, ["none", "key", "digest"], "left_semi")
    # the window has the join's partitioning: texts are shuffled once
    same = Window.partitionBy("none", "key", "digest").orderBy("key")
    return rows.withColumn("nth", F.row_number().over(same)).where("nth = 1").select("row.*")


def op2_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
