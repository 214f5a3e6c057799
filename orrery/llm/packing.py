"""Best-fit packing by patterns: non-negative least squares on the length histogram, residuals best-fit."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_map, materialize
from .tokens import encoder

LENGTH = 2048
END = 0
#: Hash parts of a length, so that a length with a third of all pieces is ranked by many tasks.
SALTS = 512


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and the end id, cut every ``length`` ids.

    A null text is empty: one piece with the end id alone. Repeated rows give pieces each.
    """
    mark = np.array([end], "<u4").tobytes()

    def cut(rows):
        ids = [x + mark for x in encoder(tokenizer).ids([t or "" for t in rows["text"].to_pylist()])]
        out = defaultdict(list)
        step = 4 * length
        for doc, x in zip(rows["doc_id"].to_pylist(), ids, strict=True):
            for i, at in enumerate(range(0, len(x), step)):
                part = x[at : at + step]
                for name, v in (("doc_id", doc), ("piece", i), ("start", at // 4), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part))):
                    out[name].append(v)
        return out or None

    return arrow_map(docs.select("doc_id", "text"), cut, "doc_id long, piece int, start long, length long, ids_crc32 long", 1024)


def patterns(counts: np.ndarray, size: int = LENGTH) -> list[tuple[int, ...]]:
    """Patterns of one to four lengths that nearly fill ``size``, made of lengths with pieces.

    For each length: alone if it fills the sequence, with the best partners, and with each of up to
    24 spread middle lengths and the best third (or the best equal pair) beside them. Their number
    is bounded by ``size``, whatever the number of documents.
    """
    present = np.flatnonzero(counts)
    below = np.full(size + 1, -1, np.int64)  # largest present length <= x
    below[present] = present
    below = np.maximum.accumulate(below)
    out = set()

    def best(room: int, tries: int):
        while tries and room > 0 and (b := int(below[room])) > 0:
            yield b
            room, tries = b - 1, tries - 1

    for a in map(int, present[::-1]):
        if a == size:
            out.add((a,))
            continue
        for b in best(size - a, 3):
            out.add(tuple(sorted((a, b), reverse=True)))
        middle = present[present <= size - a - 1]
        for b in map(int, middle[np.unique(np.linspace(0, len(middle) - 1, min(24, len(middle))).astype(int))] if len(middle) else ()):
            for c in best(size - a - b, 1):
                out.add(tuple(sorted((a, b, c), reverse=True)))
            for c in best((size - a - b) // 2, 1):
                out.add(tuple(sorted((a, b, c, c), reverse=True)))
    return sorted(out, reverse=True)


def fit(pats: list[tuple[int, ...]], counts: np.ndarray, size: int = LENGTH, steps: int = 400) -> np.ndarray:
    """Non-negative least squares: repeat counts x >= 0 with sum over patterns near the histogram.

    Accelerated projected gradient on the sparse pattern matrix; unused room costs a little.
    """
    width = max(map(len, pats))
    idx = np.array([list(p) + [0] * (width - len(p)) for p in pats])
    used = idx > 0
    total = counts.sum()
    b = counts / total
    waste = 1e-3 * (size - idx.sum(1)) / size / max(len(pats), 1)

    def apply(x):
        y = np.bincount(idx.ravel(), (used * x[:, None]).ravel(), minlength=size + 1)
        y[0] = 0
        return y

    def back(y):
        return (y[idx] * used).sum(1)

    v = np.ones(len(pats))
    for _ in range(20):
        v = back(apply(v))
        norm = np.linalg.norm(v)
        v /= norm
    rate = 1 / (1.05 * norm)
    x = z = np.zeros(len(pats))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, z - rate * (back(apply(z) - b) + waste))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x * total


def plan(counts: np.ndarray, size: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): rounded patterns, then the residual histogram placed best-fit, longest first.

    Sequences with equal contents are one entry with a repeat count, so the work depends on the
    number of different lengths and not on the number of documents.
    """
    left = counts.astype(np.int64).copy()
    open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    if left.sum():
        pats = patterns(left, size)
        x = np.floor(fit(pats, counts.astype(float), size) + 0.5).astype(np.int64)
        for p, n in sorted(zip(pats, x.tolist(), strict=True), key=lambda e: (size - sum(e[0]), [-v for v in e[0]])):
            need: dict[int, int] = defaultdict(int)
            for v in p:
                need[v] += 1
            n = min(n, *(int(left[v]) // c for v, c in need.items()))
            if n > 0:
                for v, c in need.items():
                    left[v] -= n * c
                open_by_room[size - sum(p)].append((p, n))
    rooms = np.zeros(size + 1, np.int64)
    for r, e in open_by_room.items():
        rooms[r] = sum(n for _, n in e)
    for v in np.flatnonzero(left)[::-1].tolist():
        n = int(left[v])
        while n:
            fits = np.flatnonzero(rooms[v:])
            if not len(fits):
                per = size // v
                if n >= per:
                    open_by_room[size - per * v].append(((v,) * per, n // per))
                    rooms[size - per * v] += n // per
                if n % per:
                    open_by_room[size - n % per * v].append(((v,) * (n % per), 1))
                    rooms[size - n % per * v] += 1
                break
            room = v + int(fits[0])
            p, m = open_by_room[room].pop()
            k = min(n, m)
            if k < m:
                open_by_room[room].append((p, m - k))
            rooms[room] -= k
            open_by_room[room - v].append(((*p, v), k))
            rooms[room - v] += k
            n -= k
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for e in open_by_room.values():
        for p, n in e:
            merged[tuple(sorted(p, reverse=True))] += n
    return sorted(merged.items(), reverse=True)


def slots(filled: list[tuple[tuple[int, ...], int]], size: int = LENGTH) -> np.ndarray:
    """Rows (length, first rank, pieces per sequence, first sequence, offset), sorted by length and rank."""
    at = [0] * (size + 1)
    rows, sequence = [], 0
    for p, n in filled:
        offset = 0
        for v in dict.fromkeys(p):
            per = p.count(v)
            rows.append((v, at[v], per, sequence, offset))
            at[v] += n * per
            offset += per * v
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(parts: DataFrame, size: int = LENGTH) -> DataFrame:
    """Add sequence_id and offset to ``parts`` (with a column length from 1 to ``size``).

    The driver sees the histogram only: ``size`` counts. A piece's rank within its length picks
    its place; ranks are running counts over hash parts, so no task holds a whole length. An
    empty table gives an empty table.
    """
    spark = parts.sparkSession
    salted = parts.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    by_part = materialize(salted.groupBy("length", "__salt").count(), "pack-counts")
    counts = np.zeros(size + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("count")).collect():
        counts[r[0]] = r[1]
    table = slots(plan(counts, size), size)
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(by_part.withColumn("__before", before).drop("count"), ["length", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    ranked = ranked.drop("__salt", "__before").select(*parts.columns, "__rank")
    span = int(max(counts.max(), 1)) + 1
    shared = spark.sparkContext.broadcast(table)
    names = parts.columns

    def place(batches):
        t = shared.value
        keys = t[:, 0] * span + t[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.names.index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "__rank"))
            row = t[np.searchsorted(keys, length * span + rank, "right") - 1] if len(t) else t
            own = rank - row[:, 1]
            more = {"sequence_id": row[:, 3] + own // row[:, 2], "offset": row[:, 4] + own % row[:, 2] * length}
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(n)) for n in names), *map(pa.array, more.values())], names=[*names, *more])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = LENGTH, end: int = END) -> DataFrame:
    """Tokenize, cut and pack all rows of ``docs``; see ``pieces`` and ``pack``."""
    return pack(materialize(pieces(docs, tokenizer, size, end), "pack-pieces"), size)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
