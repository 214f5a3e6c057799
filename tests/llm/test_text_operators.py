"""Quality rules, near duplicates and substring removal against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import neardup, quality, suffixdedup
from orrery.llm.textkit import shingle_sets

from .helpers import empty_docs, odd_docs, odd_rows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    ws = WORD.findall(text or "")
    grams = collections.Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    hit = {i + k for i in range(len(ws) - 7) if grams[tuple(ws[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark):
    extra = [(100, "a b c d e f g h i " * 4, None, "s", 0, 0, False, ""), (101, "\n".join(["one two"] * 3 + ["one two "]), None, "s", 0, 0, False, ""), (102, "# the $ of | x " * 10, None, "s", 0, 0, False, "")]
    docs = odd_docs(spark).unionByName(spark.createDataFrame(extra, odd_docs(spark).schema))
    own = {i: t for i, t, *_ in odd_rows() + extra}
    for r in quality.apply_rules(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(own[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_filter_keeps_columns(spark):
    docs = odd_docs(spark)
    out = quality.filter_quality(docs)
    assert out.columns == docs.columns
    good = "the of and it was on " * 2 + words(40, 9)
    clean = spark.createDataFrame([(1, good, "en", "s", 1, 3, False, "q")], docs.schema)
    assert quality.filter_quality(clean).first() == clean.first()
    assert quality.filter_quality(empty_docs(spark)).count() == 0


def sets_of(text):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])


def brute_components(rows):
    sets = [sets_of(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    low = {}
    for g, (d, _) in zip(group, rows, strict=True):
        if d is not None:
            low[g] = min(low.get(g, d), d)
    return [(d, len(s), low.get(g)) for (d, _), s, g in zip(rows, sets, group, strict=True)]


def near_rows(n=30):
    """A base text, copies with a few words changed (many below the threshold with each other), chains, a shared line."""
    rng = random.Random(4)
    base = words(150, 77).split()
    out = []
    for k in range(n):
        ws = list(base)
        for _ in range(rng.randrange(0, 6)):
            ws[rng.randrange(len(ws))] = f"edit{rng.randrange(10**6)}"
        out.append((k, " ".join(ws)))
    line = words(12, 78)
    out += [(100 + k, words(20, 1000 + k) + "\n" + line) for k in range(40)]
    out += [(200 + k, " ".join(base[:100] + words(k * 6, 2000).split())) for k in range(12)]
    return out


def test_near_duplicates(spark):
    rows = [(r[0], r[1]) for r in odd_rows()] + [(i + 1000, t) for i, t in near_rows()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert got == sorted(brute_components(rows), key=str)


def test_groups_are_told_apart_with_one_pivot(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect())
    assert got == sorted(brute_components(rows))


@pytest.mark.parametrize("small", [0, 1 << 21])
def test_small_tables_take_few_tasks_whatever_the_shuffle_partitions(spark, monkeypatch, tmp_path, small):
    for name in ("ONE_READ", "SENT"):
        monkeypatch.setattr(neardup, name, small, raising=False)
    rows, written, write = near_rows(), [], neardup.materialize

    def counted(df, label, *more):
        out = write(df, label, *more)
        written.append((label, len(out.inputFiles())))
        return out

    monkeypatch.setattr(neardup, "materialize", counted)
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2).write.parquet(str(tmp_path / "docs"))
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.read.parquet(str(tmp_path / "docs"))).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted(brute_components(rows))
    assert max(n for _, n in written) <= 2 * spark.sparkContext.defaultParallelism, written


@pytest.mark.parametrize("most", [0, 200_000])
def test_components_by_one_task_and_by_stars(spark, monkeypatch, most):
    monkeypatch.setattr(neardup, "ONE_TASK", most)
    rng, names = random.Random(8), [bytes([k]) for k in range(60)]
    links = [(names[k], names[k + 1]) for k in range(0, 20)] + [(names[rng.randrange(21, 60)], names[rng.randrange(21, 60)]) for _ in range(15)]
    low = {n: n for link in links for n in link}
    for _ in links:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    got = neardup.components(spark.createDataFrame([x for x in links if x[0] != x[1]], "a binary, b binary")).collect()
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert {(bytes(r.cls), bytes(r.label)) for r in got} == {(n, low[n]) for n in linked} and len(got) == len(linked)


def test_sketches_never_part_linked_sets():
    rng = np.random.default_rng(3)
    for n in (1, 5, 300, 4000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: max(1, n * 7 // 8)], rng.integers(0, 1 << 63, n // 16).astype(np.uint64)]))
        x, y = (np.unpackbits(neardup.sketch(s).view(np.uint8)) for s in (a, b))
        assert len(x) == neardup.SKETCH and (x != y).sum() <= len(np.setxor1d(a, b))


def test_few_unlinked_pairs_are_compared(spark):
    # sets that share 60 words of 100 with the pivot and with each other
    base = words(100, 50).split()
    texts = [" ".join(base[:60] + words(40, 500 + k).split()) for k in range(30)]
    sets = shingle_sets([t.encode() for t in texts], 5)
    kind = "cls binary, sig binary, text string, size long, bits array<long>"
    table = spark.createDataFrame([(bytes([k]), neardup.signature(s), t, len(s), neardup.sketch(s).tolist()) for k, (s, t) in enumerate(zip(sets, texts, strict=True))], kind)
    own = spark.createDataFrame([(bytes([0]), [bytes([k]) for k in range(1, 30)])], "x binary, pivots array<binary>")
    assert neardup.near_enough(own, table).count() == 0
    near = spark.createDataFrame([(b"a", None, "", 300, neardup.sketch(sets[0]).tolist()), (b"b", None, "", 300, neardup.sketch(sets[0][:-5]).tolist())], kind)
    assert [tuple(map(bytes, r)) for r in neardup.near_enough(spark.createDataFrame([(b"a", [b"b"])], "x binary, pivots array<binary>"), near).collect()] == [(b"b", b"a")]


def test_members_of_settled_buckets_are_left_alone(spark):
    rows = [(1, "p", "x", 5, "x"), (2, "p", "y", 4, "y"), (3, "p", "x", 5, "x"), (3, "p", "z", 3, "z"), (4, "p", "v", 2, "l"), (4, "p", "w", 2, "l")]
    met = spark.createDataFrame([(b, p.encode(), x.encode(), d, n.encode()) for b, p, x, d, n in rows], "bucket long, p binary, x binary, deg long, label binary")
    # x and y have one pivot but no bucket in common
    assert sorted(bytes(r["x"]) for r in neardup.open_members(met).collect()) == [b"x", b"z"]


def test_pivots_of_other_sizes_are_not_asked(spark):
    row = spark.sql("select 100L size, 5L deg, 'x' x, 'a' label")
    for size, label, deg, asked in [(75, "b", 9, 1), (74, "b", 9, 0), (133, "b", 9, 1), (134, "b", 9, 0), (100, "a", 9, 0), (100, "b", 4, 0)]:
        pivots = F.array(F.struct(F.lit(deg).cast("long").alias("deg"), F.lit("p").alias("x"), F.lit(label).alias("label"), F.lit(size).cast("long").alias("size")))
        assert row.withColumn("pivots", pivots).select(F.size(F.filter("pivots", neardup.may_be_linked))).first()[0] == asked


@pytest.mark.parametrize("size", [1, 1 << 18])
def test_rows_with_wanted_ids_are_kept(spark, monkeypatch, size):
    monkeypatch.setattr(neardup, "WORDS", size)
    docs = spark.createDataFrame([(i, str(i)) for i in [None, *range(-500, 500)]], "doc_id bigint, text string")
    got = [r.doc_id for r in neardup.with_ids(docs, spark.createDataFrame([(None,), (-3,), (7,), (7,)], "rep bigint")).collect()]
    assert {None, -3, 7} <= set(got) and len(got) == len(set(got)) and (size == 1 or len(got) < 10)


def test_pairs_are_verified_across_batches(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    base = neardup.prepare(docs).collect()
    texts = spark.createDataFrame([(r.cls, r.sig, t) for r, (_, t) in zip(base, rows, strict=True)], "cls binary, sig binary, text string").dropDuplicates(["cls"])
    sets = dict(zip([bytes(r.cls) for r in base], shingle_sets([t.encode() for _, t in rows], 5), strict=True))
    pivots = [bytes(base[k].cls) for k in (0, 3, 7)]
    pairs = {(p, x) for p in pivots for x in sets if x != p}
    want = {(p, x) for p, x in pairs if 4 * len(np.intersect1d(sets[p], sets[x])) >= 3 * len(np.union1d(sets[p], sets[x]))}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        got = neardup.verify(spark.createDataFrame(list(pairs), "p binary, x binary"), texts).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(want) > 20 and {(bytes(r.p), bytes(r.x)) for r in got} == want


def test_one_of_each_group_stays(spark):
    docs = odd_docs(spark)
    out = neardup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    ids = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert ids == [1, 4, 5, 6, 7, 8, 10, 11, 12, 14, 15, 16]
    assert neardup.near_duplicates(empty_docs(spark)).count() == 0


def test_bayes_bounds():
    for n, m in neardup.least_matches():
        assert 0 < m < 0.75 * n
    a = shingle_sets([words(300, 1).encode()], 5)[0]
    x = np.frombuffer(neardup.signature(a), "<u2")
    y = np.frombuffer(neardup.signature(a[: int(len(a) * 0.8)]), "<u2")
    assert abs((x == y).mean() - 0.8) < 0.15


def brute_removed(texts, length=400):
    count = collections.Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in data:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        runs = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        out.append((len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passage_rows():
    shared, other = words(130, 50), words(90, 51)
    out = [(k, words(30 + k, 60 + k) + " " + shared[3 * k :] + " " + words(40, 90 + k)) for k in range(12)]
    out += [(50, other + words(10, 1) + other), (51, "ä" * 900), (52, "ä" * 150 + words(50, 7)), (53, shared[:399]), (54, shared[:400]), (55, "ab" * 700)]
    return out


@pytest.mark.parametrize("block", [2048, 2])
def test_substrings(spark, monkeypatch, block):
    monkeypatch.setattr(suffixdedup, "BLOCK", block)
    rows = [(r[0], r[1]) for r in odd_rows()] + [(i + 1000, t) for i, t in passage_rows()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffixdedup.substring_report(docs).collect()]
    want = [(d, v) for (d, _), v in zip(rows, brute_removed([t for _, t in rows]), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_cover_ranks():
    v, cover = suffixdedup.V, suffixdedup.COVER
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    rng = np.random.default_rng(3)
    for depth in (224, 384, 48):
        spans = [bytes(rng.integers(97, 99, 500, np.uint8)), b"ab" * 400, b"a" * 300, bytes(rng.integers(0, 256, 200, np.uint8))]
        data = b"".join(spans)
        _, word = suffixdedup._words(spans, depth + v)
        ranks = suffixdedup.CoverRanks(word, depth)
        places = np.array([p for p in range(len(data) - depth) if p % v in cover])
        rank = ranks.at(places)
        order = sorted(range(len(places)), key=lambda i: data[places[i] : places[i] + depth])
        for i, j in zip(order, order[1:]):
            a, b = (data[places[k] : places[k] + depth] for k in (i, j))
            assert (rank[i] == rank[j]) == (a == b) and rank[i] <= rank[j]
        assert (ranks.at(np.arange(3, 5)) == -1).all()


def test_long_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(suffixdedup, "PIECE", 700)
    text, length = words(900, 5).encode(), 240
    starts: list[int] = []
    for rows, offsets, blobs in suffixdedup._chunks([b"", text, None], length):
        for r, at, blob in zip(rows, offsets, blobs, strict=True):
            assert blob == ((b"", text, b"")[r])[at : at + len(blob)]
            starts += [at + k for k in range(len(blob) - length + 1)]
    assert starts == list(range(len(text) - length + 1))


def test_passages_of_fifty_words_go(spark):
    shared, short = "Repeated " + " ".join(f"wd{k:02d}" for k in range(52)), " ".join(f"longerword{k:02d}" for k in range(30))
    rows = [(k, words(40, 900 + k) + "\n" + shared + "\n" + words(40, 950 + k) + " " + short) for k in range(3)] + [(9, words(200, 999)), (10, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r.text for r in suffixdedup.remove_passages(docs).collect()}
    assert all(shared not in out[k] and short in out[k] for k in range(3)) and out[9] == rows[3][1] and out[10] is None
    report = {r.doc_id: r for r in suffixdedup.substring_report(docs).collect()}
    assert [report[k].n_passages for k in (0, 1, 2, 9, 10)] == [1, 1, 1, 0, 0]
    assert suffixdedup.remove_passages(empty_docs(spark)).count() == 0


def test_names_of_columns_may_clash(spark):
    docs = spark.createDataFrame([(1, words(30, 1), 1, 2, 3, 4, 5, 6)], "doc_id bigint, text string, word int, line int, __word int, key int, digest int, cls int")
    out = quality.apply_rules(docs).first()
    assert (out.word, out.line, out["__word"], out.n_words) == (1, 2, 3, 30)
    assert neardup.drop_near_duplicates(docs).first() == docs.first() == suffixdedup.remove_passages(docs).first()


def test_substrings_are_cut_from_rows(spark):
    docs = odd_docs(spark)
    out = suffixdedup.remove_substrings(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[1].text == "" and by_id[1].n_chars == 0 and by_id[4].text is None and by_id[7].text == "one"
    assert suffixdedup.substring_report(empty_docs(spark)).count() == 0


def test_one_row_of_each_component_on_repeated_and_null_ids(spark):
    def pair(seed):
        text = words(120, seed)
        near = text.split()
        near[60] = "changed"
        return text, " ".join(near)

    (a, a2), (x, x2), (c, c2), (d, d2), b, y = pair(901), pair(902), pair(903), pair(904), words(120, 905), words(120, 906)
    rows = [(7, a), (7, a2), (7, a), (None, x), (None, x2), (None, y), (3, c), (5, c2), (5, b), (1, d), (None, d2), (8, ""), (8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in neardup.drop_near_duplicates(docs).collect()]
    assert sorted(t for i, t in got if i == 7) in ([a], [a2])
    assert [t for i, t in got if i is None and t in (x, x2)] in ([x], [x2])
    rest = [(None, y), (3, c), (5, b), (1, d), (8, ""), (8, None)]
    assert sorted(map(str, (r for r in got if r[0] != 7 and r[1] not in (x, x2)))) == sorted(map(str, rest))
