"""Exact-substring removal: every byte under a string of ``length`` bytes that starts somewhere else too.

Blockwise suffix sorting. The starts of strings are grouped into suffix buckets by their minimizer (the
smallest hash of the K-byte strings inside): equal strings share it, at the same distance.
Starts that share a minimizer in a row form a run; a bucket whose minimizer occurs once has no repeat and
is dropped before any text moves, runs with equal spans repeat as a whole (128 bits of hash), and
one of them stands for all. Workers sort one block of buckets at a time: suffixes by their first V bytes
and their last V, ties by ranks of a difference-cover sample of the block. Any two places reach the
sample by one common step below V, and the ranks there are prepared once a block, by doubling, so a
tie of any length costs one comparison. A bucket with more than BLOCK spans is first split by longer
strings: its runs are cut into parts of fewer starts, and parts go by the bytes all their strings share.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, materialize
from .textkit import SPACE, mix, powers, prefix_hash, span_hash

#: Bytes of the strings that ``op3_suffix_dedup`` removes.
LENGTH = 400
#: Passages: runs of repeated strings of PASSAGE bytes go if they have PASSAGE_WORDS words or LENGTH bytes.
PASSAGE, PASSAGE_WORDS = 240, 50
#: Bytes of a minimizer.
K = 64
#: Period and places of the difference cover: every distance modulo V is one of two places. Lengths are multiples of V.
V, COVER = 16, np.array([0, 1, 2, 5, 8])
#: Spans that a worker sorts together; starts in a part of a bucket that has more, level by level.
BLOCK, WIDTHS = 2048, (64, 8, 1)
#: Bytes of a text that are looked at together.
PIECE = 1 << 26
_U = np.uint64


def runs_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, k: int = K):
    """Runs of string starts with one minimizer, over texts that lie one after another in ``data``.

    Returns (text, minimizer position in the text, least and greatest distance of a start before it,
    minimizer hash, span hash); the span is data[p - greatest : p - least + length].
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, _U, _U))
    if not len(sizes) or sizes.max() < length:
        return none
    prefix = prefix_hash(data)
    n, w = len(data) - k + 1, length - k + 1
    _, down = powers(len(prefix))
    h = mix((prefix[k:] - prefix[:n]) * down[:n])
    place = np.arange(n, dtype=_U)
    key = (h & ~_U((1 << 28) - 1)) | place  # the leftmost of equal hashes is the smallest
    # sliding minimum over w places: block-wise running minima from both sides
    blocks = -(-n // w)
    full = np.full(blocks * w, ~_U(0), _U)
    full[:n] = key
    grid = full.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    at = np.arange(n - w + 1)
    chosen = (np.minimum(back[: n - w + 1], ahead[w - 1 : n]) & _U((1 << 28) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
    inside = at + length <= (starts + sizes)[text]
    at, chosen, text = at[inside], chosen[inside], text[inside]
    if not len(at):
        return none
    first = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    p, t = chosen[first], text[first]
    high, low = p - at[first], p - at[last]
    ext = span_hash(prefix, p - high, p - low + length) ^ mix(((high << 10) | low).astype(_U))
    return t, p - starts[t], low, high, h[p], ext


def _chunks(datas: list[bytes | None], length: int, most: int = 1 << 18):
    """(row numbers, offsets, blobs) of about ``most`` bytes; texts over PIECE come in pieces, each string in one."""
    rows, offsets, blobs, size = [], [], [], 0
    for i, d in enumerate(datas):
        for at in range(0, max(1, len(d or b"") - length + 1), PIECE):
            blob = (d or b"")[at : at + PIECE + length - 1]
            if blobs and size + len(blob) > most:
                yield rows, offsets, blobs
                rows, offsets, blobs, size = [], [], [], 0
            rows.append(i)
            offsets.append(at)
            blobs.append(blob)
            size += len(blob)
    if blobs:
        yield rows, offsets, blobs


def find_runs(docs: DataFrame, length: int) -> DataFrame:
    """(key, pos, h, ext): pos packs minimizer position, least and greatest distance."""
    kind = pa.schema([("key", pa.binary()), ("pos", pa.int64()), ("h", pa.int64()), ("ext", pa.int64())])

    def run(batches):
        for b in batches:
            for rows, offsets, blobs in _chunks(b.column(1).to_pylist(), length):
                sizes = np.array([len(x) for x in blobs], np.int64)
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                t, p, low, high, h, ext = runs_of(np.frombuffer(b"".join(blobs), np.uint8), starts, sizes, length)
                if len(t):
                    p = p + np.array(offsets)[t]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.array(rows)[t])), pa.array((p << 20) | (low << 10) | high), pa.array(h.view(np.int64)), pa.array(ext.view(np.int64))], schema=kind)

    return docs.select("key", "data").mapInArrow(run, "key binary, pos long, h long, ext long")


def _rank(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Dense ranks (from 0) of pairs of dense ranks."""
    both = (high.astype(_U) << _U(32)) | low.astype(_U)
    order = np.argsort(both)
    x = both[order]
    out = np.empty(len(both), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(x[1:] != x[:-1])])
    return out


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


class CoverRanks:
    """Ranks by ``depth`` bytes of the places of ``word`` in the difference cover; word[i] is 8 bytes from i on."""

    def __init__(self, word: np.ndarray, depth: int):
        blocks = (len(word) - V) // V
        places = (np.arange(blocks)[:, None] * V + COVER).ravel()
        have, width = _rank(_dense(word[places]), _dense(word[places + 8])), V
        by_width = {V: have}
        while width * 2 <= depth:
            have = _rank(have, self._later(have, width))
            width *= 2
            by_width[width] = have
        done, rest = width, depth - width
        for w in sorted(by_width, reverse=True):
            while rest >= w:
                have = _rank(have, self._later(by_width[w], done))
                done, rest = done + w, rest - w
        self.rank = have
        self.slot = np.full(V, -1)
        self.slot[COVER] = np.arange(len(COVER))

    @staticmethod
    def _later(rank: np.ndarray, by: int) -> np.ndarray:
        by = by // V * len(COVER)
        return np.concatenate([rank[by:], np.zeros(min(by, len(rank)), rank.dtype)])

    def at(self, place: np.ndarray) -> np.ndarray:
        """Rank at each place, -1 for those that are not in the cover."""
        slot = self.slot[place % V]
        return np.where(slot < 0, -1, self.rank[np.minimum(place // V * len(COVER) + slot, len(self.rank) - 1)])


def _words(spans: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin of each span, big-endian 8 bytes from each place on) of a block."""
    sizes = np.array([len(s) for s in spans], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    wide = np.frombuffer(b"".join([*spans, bytes(length + 2 * V + 8)]), np.uint8).astype(_U)
    word = np.zeros(len(wide) - 7, _U)
    for i in range(8):
        word |= wide[i : len(wide) - 7 + i] << _U(56 - 8 * i)
    return base, word


def sort_block(bucket: np.ndarray, far: np.ndarray, near: np.ndarray, spans: list[bytes], length: int):
    """(row, first start, last start) runs of strings that another row has too, counted from each span's begin.

    A span holds the strings that start from ``far`` to ``near`` bytes before the place its bucket is named by.
    """
    n = far - near + 1
    row = np.repeat(np.arange(len(spans)), n)
    own = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    base, word = _words(spans, length)
    where = base[row] + own
    # bucket and distance, first V and last V bytes
    tie = _dense(mix(bucket.view(_U)[row] + (far[row] - own).astype(_U)))
    for place in (where, where + 8, where + length - V, where + length - 8):
        tie = _rank(tie, _dense(word[place]))
    tied = np.flatnonzero(np.bincount(tie)[tie] > 1)
    hit = np.zeros(len(row), bool)
    if len(tied):
        # only spans with ties are looked at again
        some = np.unique(row[tied])
        new = np.full(len(spans), -1)
        new[some] = np.arange(len(some))
        base, word = _words([spans[i] for i in some.tolist()], length)
        place, tie = base[new[row[tied]]] + own[tied], tie[tied]
        ranks = CoverRanks(word, length - V)
        for step in range(V):
            rank = ranks.at(place + step)
            on = np.flatnonzero(rank >= 0)
            both = (tie[on].astype(_U) << _U(32)) | rank[on].astype(_U)
            order = np.argsort(both)
            same = both[order][1:] == both[order][:-1]
            hit[tied[on[order[1:][same]]]] = True
            hit[tied[on[order[:-1][same]]]] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    edge = np.unique(np.concatenate([edge, np.intersect1d(np.cumsum(n), np.flatnonzero(hit))]))  # rows are apart
    begins, ends = edge[:-1], edge[1:]
    keep = hit[begins] if len(begins) else np.zeros(0, bool)
    return row[begins[keep]], own[begins[keep]], own[ends[keep] - 1]


def _cut_spans(rows: DataFrame, length: int) -> DataFrame:
    """Spans of the wanted runs of each text: rows (key, data, wanted[pos, h, need, hot])."""
    kind = pa.schema([("key", pa.binary()), ("pos", pa.int64()), ("h", pa.int64()), ("need", pa.bool_()), ("hot", pa.bool_()), ("span", pa.binary())])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                out: dict[str, list] = {n: [] for n in kind.names}
                for key, data, wanted in zip(*(c.to_pylist() for c in b.slice(i, 64).columns), strict=True):
                    for w in wanted:
                        p, low, high = w["pos"] >> 20, w["pos"] >> 10 & 1023, w["pos"] & 1023
                        for k, x in (("key", key), ("pos", w["pos"]), ("h", w["h"]), ("need", w["need"]), ("hot", w["hot"]), ("span", data[p - high : p - low + length])):
                            out[k].append(x)
                yield pa.RecordBatch.from_pydict(out, schema=kind)

    return rows.select("key", "data", "wanted").mapInArrow(run, "key binary, pos long, h long, need boolean, hot boolean, span binary")


RANGES = "key binary, a long, b long"
_RANGES = pa.schema([("key", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])


def _sort_buckets(pieces: DataFrame, length: int) -> DataFrame:
    """Covered byte ranges of pieces (key, p, near, far, bucket, need, bytes) that need it, one block of buckets at a time."""

    def flush(rows: list[tuple]):
        key, p, near, far, bucket, need, data = (list(c) for c in zip(*rows, strict=True))
        p, near, far, need = np.array(p), np.array(near, np.int64), np.array(far, np.int64), np.array(need)
        r, a, b = sort_block(np.array(bucket, np.int64), far, near, data, length)
        keep = need[r]
        r, a, b = r[keep], a[keep], b[keep]
        begin = p[r] - far[r]
        return pa.RecordBatch.from_pydict({"key": [key[i] for i in r], "a": begin + a, "b": begin + b + length}, schema=_RANGES)

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= BLOCK and r[4] != held[-1][4]:
                    yield flush(held)
                    held = []
                held.append(r)
        if held:
            yield flush(held)

    return pieces.select("key", "p", "near", "far", "bucket", "need", "bytes").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, RANGES)


def _parts(pieces: DataFrame, width: int, length: int) -> DataFrame:
    """Pieces cut into ``width`` neighbouring starts: (key, p, near, far, need, bucket, x, y, bytes).

    Parts are aligned to the place that names the old bucket, so equal strings lie in parts of one number.
    The new bucket is the hash of what all strings of a whole part share; x, y are the digest of the part.
    """
    kind = pa.schema([("key", pa.binary()), ("p", pa.int64()), ("near", pa.int64()), ("far", pa.int64()), ("need", pa.bool_()), ("bucket", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                out: dict[str, list] = {n: [] for n in kind.names}
                for key, p, near, far, bucket, need, data in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns), strict=True):
                    for g in range(near // width, far // width + 1):
                        k0, k1 = max(near, g * width), min(far, g * width + width - 1)
                        own = data[far - k1 : far - k0 + length]
                        core = data[far - g * width if far >= g * width else 0 : far - (g * width + width - 1) + length]
                        x, y = np.frombuffer(hashlib.blake2b(own, digest_size=16, key=b"%d,%d,%d" % (k0, k1, bucket)).digest(), "<i8").tolist()
                        c = xxhash.xxh3_64_intdigest(core, (bucket ^ g) & (1 << 64) - 1) - (1 << 63)
                        for n, v in zip(kind.names, (key, p, k0, k1, need, c, x, y, own), strict=True):
                            out[n].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=kind)

    return pieces.select("key", "p", "near", "far", "bucket", "need", "bytes").mapInArrow(run, "key binary, p long, near long, far long, need boolean, bucket long, x long, y long, bytes binary")


def covered(docs: DataFrame, length: int) -> DataFrame:
    """(key, ranges) of the rows of ``docs`` (key, data) that have covered bytes, as a written table.

    ``length`` is a multiple of V, over K and under K + 1024. Rows with one key must have one ``data``.
    """
    if length % V or not K < length < K + 1024:
        raise ValueError(f"strings of {length} bytes: a multiple of {V} over {K} and under {K + 1024} is needed")
    spark, tables = docs.sparkSession, []

    def keep(df, label, batch_rows=None):
        tables.append(materialize(df, label, batch_rows))
        return tables[-1]

    runs = keep(find_runs(docs, length), "runs")
    classes = keep(runs.groupBy("h", "ext").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos")).alias("one")), "run-classes")
    buckets = classes.groupBy("h").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).where("all > 1")
    classes = keep(classes.join(buckets, "h"), "shared-classes")
    whole = runs.join(classes.where("n > 1").select("h", "ext"), ["h", "ext"])
    p, low, high = F.shiftright("pos", 20), F.shiftright("pos", 10).bitwiseAND(1023), F.col("pos").bitwiseAND(1023)
    found = whole.select("key", (p - high).alias("a"), (p - low + length).alias("b"))
    wanted = classes.where("kinds > 1").select("one.*", "h", (F.col("n") == 1).alias("need"), (F.col("kinds") > BLOCK).alias("hot"))
    per_text = wanted.groupBy("key").agg(F.collect_list(F.struct("pos", "h", "need", "hot")).alias("wanted"))
    both = docs.select("key", "data").join(per_text, "key")
    spans = keep(_cut_spans(both, length), "spans", 1000)
    pieces = spans.select("key", p.alias("p"), low.alias("near"), high.alias("far"), F.col("h").alias("bucket"), "need", "hot", F.col("span").alias("bytes"))
    found = found.unionByName(_sort_buckets(pieces.where("not hot"), length))
    hot = pieces.where("hot")
    for width in WIDTHS:
        if hot.isEmpty():
            break
        parts = keep(_parts(hot, width, length), "parts", 1000)
        kinds = keep(parts.groupBy("bucket", "x", "y").agg(F.count("*").alias("n"), F.min(F.struct("key", "p", "far")).alias("one")), "part-kinds")
        whole = parts.where("need").join(kinds.where("n > 1").select("bucket", "x", "y"), ["bucket", "x", "y"])
        found = found.unionByName(whole.select("key", (F.col("p") - F.col("far")).alias("a"), (F.col("p") - F.col("near") + length).alias("b")))
        # one part of each content, where its bucket has several
        sizes = kinds.groupBy("bucket").agg(F.count("*").alias("kinds")).where("kinds > 1")
        one = kinds.join(sizes, "bucket").select("bucket", "one.*", (F.col("n") == 1).alias("alone"), (F.col("kinds") > BLOCK).alias("hot"))
        pieces = parts.join(one, ["bucket", "key", "p", "far"]).withColumn("need", F.col("need") & F.col("alone"))
        pieces = keep(pieces.select("key", "p", "near", "far", "bucket", "need", "hot", "bytes"), "pieces", 1000)
        found = found.unionByName(_sort_buckets(pieces.where("not hot"), length))
        hot = pieces.where("hot")
    ranges = found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("ranges"))
    out = materialize(ranges, "ranges")
    forget(spark, tables)
    return out


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint ranges that cover the same bytes; touching ranges are one run."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _keyed(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Rows of ``docs`` as (row, key, data): the columns to carry, the text's bytes, and a name for both.

    The key is a digest of doc_id and text, so ids may repeat or be null.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text)))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), key.alias("key"), text.cast("binary").alias("data"))


def _cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def passages(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the repeated runs that have PASSAGE_WORDS words (parts of words count) or LENGTH bytes."""
    word = ~SPACE[np.frombuffer(data, np.uint8)]
    return [(a, b) for a, b in spans if b - a >= LENGTH or int(word[a]) + np.count_nonzero(word[a + 1 : b] & ~word[a : b - 1]) >= PASSAGE_WORDS]


def _spans(ranges) -> list[tuple[int, int]]:
    return merge([(r["a"], r["b"]) for r in ranges or ()])


def substring_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes, spans) of every row of ``docs``.

    A null text is empty. Strings are judged on the input; every copy is removed, the first too, so
    texts of 400 bytes and more that occur twice go whole (a row that is repeated has a copy). The
    passages are what ``remove_passages`` takes away: repeated too, but of PASSAGE bytes and 50 words; their
    strings are found first, and strings of 400 bytes only inside of them. Texts of any length are judged
    whole, in pieces that overlap. Other columns of ``docs`` play no part; an empty table gives an empty table.
    """
    own = _keyed(docs, ["doc_id"]).select("row.doc_id", "key", "data")
    short = covered(own, PASSAGE)
    kind = pa.schema([("doc_id", own_type(docs)), ("key", pa.binary()), ("n_bytes", pa.int64()), ("sha", pa.string()), ("n_passages", pa.int64()), ("passage_bytes", pa.int64()), ("data", pa.binary()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def first(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                out: dict[str, list] = {n: [] for n in kind.names[2:]}
                for data, ranges in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    spans = _spans(ranges)
                    found = passages(data, spans)
                    long = [(a, b) for a, b in spans if b - a >= LENGTH]
                    row = (len(data), hashlib.sha256(data).hexdigest(), len(found), sum(b - a for a, b in found), data if long else None, [a for a, _ in long], [b for _, b in long])
                    for n, v in zip(kind.names[2:], row, strict=True):
                        out[n].append(v)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(out[n], kind.field(n).type) for n in kind.names[2:])], schema=kind)

    marked = own.join(short, "key", "left").select("doc_id", "key", "data", "ranges")
    marked = materialize(marked.mapInArrow(first, f"doc_id {id_type}, key binary, n_bytes long, sha string, n_passages long, passage_bytes long, data binary, a array<long>, b array<long>"), "marked", 1000)
    # 400 bytes that occur twice lie in longer runs of shorter strings that occur twice
    pieces = marked.where("data is not null").select("key", "data", F.explode(F.arrays_zip("a", "b")).alias("s"))
    pieces = pieces.select("key", F.col("s.a").alias("at"), F.unhex(F.md5(F.concat("key", F.col("s.a").cast("string").cast("binary")))).alias("piece"), F.substring("data", F.col("s.a").cast("int") + 1, (F.col("s.b") - F.col("s.a")).cast("int")).alias("data"))
    pieces = materialize(pieces, "pieces", 1000)
    exact = covered(pieces.select(F.col("piece").alias("key"), "data"), LENGTH)
    exact = pieces.select("key", "at", "piece").distinct().join(exact.withColumnRenamed("key", "piece"), "piece").select("key", F.explode(F.transform("ranges", lambda r: F.struct((r["a"] + F.col("at")).alias("a"), (r["b"] + F.col("at")).alias("b")))).alias("r"))
    exact = exact.groupBy("key").agg(F.collect_list("r").alias("ranges"))
    last = pa.schema([("doc_id", own_type(docs)), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passages", pa.int64()), ("passage_bytes", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64())))])

    def second(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                removed, n, sha, spans = [], [], [], []
                for data, ranges, whole in zip(part.column(5).to_pylist(), part.column(6).to_pylist(), part.column(2).to_pylist(), strict=True):
                    cut = _spans(ranges)
                    removed.append(sum(b - a for a, b in cut))
                    n.append(len(cut))
                    sha.append(hashlib.sha256(_cut(data, cut)).hexdigest() if cut else whole)
                    spans.append([list(s) for s in cut])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), part.column(3), part.column(4), pa.array(spans, pa.list_(pa.list_(pa.int64())))], schema=last)

    rows = marked.join(exact, "key", "left").select("doc_id", "n_bytes", "sha", "n_passages", "passage_bytes", "data", "ranges")
    return rows.mapInArrow(second, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long, spans array<array<long>>")


def own_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


def _without(docs: DataFrame, length: int, chosen) -> DataFrame:
    """``docs`` without the bytes of the runs that ``chosen(data, runs)`` names."""
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                rows, texts = part.column(0), []
                for old, data, ranges in zip(rows.field("text").to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    spans = chosen(data, _spans(ranges)) if ranges else []
                    texts.append(_cut(data, spans).decode("utf-8", "ignore") if spans else old)
                cols = {n: rows.field(n) for n in names} | {"text": pa.array(texts, pa.string())}
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(cols["n_chars"].type)
                yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    own = _keyed(docs, names)
    ranges = covered(own.select("key", "data"), length)
    return own.join(ranges, "key", "left").select("row", "data", "ranges").mapInArrow(run, kinds)


def remove_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text`` (and n_chars set to what is left, if there).

    Where a cut parts a character, its left-over bytes go too. Texts that are removed whole stay as
    rows with an empty text, null texts stay null; rows that are repeated have a copy. Other columns keep
    their values, whatever their names. An empty table gives an empty table.
    """
    return _without(docs, length, lambda data, spans: spans)


def remove_passages(docs: DataFrame) -> DataFrame:
    """As ``remove_substrings`` for passages: repeated runs of PASSAGE bytes with 50 words (or 400 bytes)."""
    return _without(docs, PASSAGE, passages)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
