"""Mixing, packing, token files, archives, media, language and toxicity on small tables."""

import base64
import hashlib
import io
import random
import wave
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orrery.llm import langid, media, mixing, packing, token_files, tokens, toxicity, warc

from .helpers import empty_docs, odd_docs, odd_rows, words

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, words(rng.randrange(0, 60), i), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(docs).select("row.*", "size", "source_size", "target", "taken").collect()
    total = sum(r["size"] for r in out)
    by = {}
    for r in out:
        assert r.taken in (0, r["size"], 2 * r["size"])
        by.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.taken
    assert abs(sum(t for t, _, _ in by.values()) - 1.5 * total) < 1e-6 * total
    for target, size, taken in by.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= 60
    again = mixing.mix(docs.repartition(7)).select("row.doc_id", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.taken) for r in out)


def test_mix_of_odd_rows(spark):
    docs = odd_docs(spark)
    assert mixing.mix(docs).count() == docs.count()
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.mix(empty_docs(spark)).count() == 0 and mixing.mixed_rows(empty_docs(spark)).count() == 0
    silent = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id bigint, text string, source string")
    assert [r.taken for r in mixing.mix(silent).collect()] == [0, 0]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_is_exact(path):
    rng = random.Random(2)
    alphabet = "ab'sté ñ ,.\n\t1²Ⅷ!?-_ ́ <|endoftext|>\x1cıİſ日本😀   "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += ["don't stop, it's fine. We'll see\n\nNew  line \n x", " lead", "trail ", "", words(500, 3)]
    plain = Tokenizer.from_file(path)
    own = tokens.Encoder(path)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the second time from the memo
        assert [np.frombuffer(x, "<u4").tolist() for x in own.ids(texts)] == want


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_is_exact_at_line_ends_and_signs(path, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 400)
    rng = random.Random(4)
    some = ["word", "Word", "WORD", "Été", "ÀÞßÿ", "×a", "a÷", "naïve,", "it's", "We'LL.", "end.", "(a)", "ab$$$", "ÉA&&,", "x_", "it''", "1,000.", "a1", "日本", "\u0301b", "e\u0301", ",", "...", "<", "|", "\x85", "\u2003", "a\u3000b"]
    ends = [" "] * 12 + ["\n"] * 4 + ["\n\n", "\n\n\n", " \n", "\n ", "\t", "  ", "", ".\n", ", "]
    texts = ["".join(rng.choice(some) + rng.choice(ends if k % 3 else ends[:16]) for _ in range(rng.randrange(12))) for k in range(3000)]
    texts += [t.strip() for t in texts] + ["\n", " ", "a", "\na", "a\n", ",", "a" * 5000, "日" * 2000]
    own, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.ids(texts)] == want


def test_a_word_is_encoded_once_whatever_stands_around_it():
    class Spy:
        def __init__(self, model):
            self.model, self.seen = model, []

        def tokenize(self, word):
            self.seen.append(word)
            return self.model.tokenize(word)

    own, plain = tokens.Encoder(WORDS), Tokenizer.from_file(WORDS)
    own.model = spy = Spy(own.model)
    texts = ["Tonder tonder, TONDER.\ntonder\nTonder&&& tonder$", "tonder tonder.", "Tonder"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.ids(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert spy.seen == ["tonder"]


def test_words_of_one_token_share_their_bytes():
    e = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert e._word(" the") is e._word(" the") and len(e._word(" the")) == 4


@pytest.mark.parametrize("first", [20, 200])
def test_dictionary_sample_is_the_first_by_hash(spark, monkeypatch, first):
    monkeypatch.setattr(token_files, "SAMPLE_DOCS", 20)
    monkeypatch.setattr(token_files, "CANDIDATES", first)
    rows = [(k, None if k % 3 else words(700 + k, k)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    names = [r[0] for r in docs.where("text is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(20).collect()]
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = token_files.train_dictionary(docs, path)
    assert got and got == token_files.train_dictionary(docs.where(F.col("doc_id").isin(names)), path)


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 50)
    own, plain = tokens.Encoder(WORDS), Tokenizer.from_file(WORDS)
    for k in range(6):
        t = [words(40, k), words(40, 0)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.ids(t)] == [plain.encode(x, add_special_tokens=False).ids for x in t]
    assert len(own.pieces.ids) <= 200


def check_packing(rows, size):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= size
    return len(seqs)


def test_packing(spark):
    docs = odd_docs(spark)
    rows = packing.pack_documents(docs, WORDS, 256).collect()
    check_packing(rows, 256)
    plain, got = Tokenizer.from_file(WORDS), sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str)
    want = []
    for i, t, *_ in odd_rows():
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, k // 256, k, len(ids[k : k + 256]), zlib.crc32(np.array(ids[k : k + 256], "<u4").tobytes())) for k in range(0, len(ids), 256)]
    assert got == sorted(want, key=str)
    assert packing.pack_documents(empty_docs(spark), WORDS).count() == 0


def test_packing_is_tight():
    rng = np.random.default_rng(3)
    counts = np.zeros(2049, np.int64)
    np.add.at(counts, np.clip(rng.lognormal(6, 0.8, 20000).astype(int), 1, 2048), 1)
    plan = packing.plan(counts)
    used = np.zeros_like(counts)
    for p, n in plan:
        assert sum(p) <= 2048
        for v in p:
            used[v] += n
    assert (used == counts).all()
    bound = -(-(counts * np.arange(2049)).sum() // 2048)
    assert sum(n for _, n in plan) <= 1.01 * bound + 1
    many = packing.plan(counts * 1000)
    assert len(packing.plan(counts * 100_000)) < 1.1 * len(many)  # the plan does not grow with the corpus
    assert packing.plan(np.zeros(2049, np.int64)) == []


def test_token_files(spark, tmp_path):
    docs = odd_docs(spark)
    manifest = token_files.write_files(docs, BYTES, str(tmp_path / "a"))
    got = token_files.read_files(spark, str(tmp_path / "a"), manifest).collect()
    plain, at, want = Tokenizer.from_file(BYTES), 0, []
    for i, t in sorted(((r[0], r[1]) for r in odd_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    for i in (1, 11, 12, 99):
        own = sorted(plain.encode(t or "", add_special_tokens=False).ids + [2] for d, t, *_ in odd_rows() if d == i)
        assert sorted(x.tolist() for x in token_files.read_document(str(tmp_path / "a"), manifest, i)) == own
    least = spark.createDataFrame([(-1 << 63, "a"), (None, "b"), (0, None)], "doc_id bigint, text string")
    m = token_files.write_files(least, BYTES, str(tmp_path / "c"))
    assert {r.doc_id for r in token_files.read_files(spark, str(tmp_path / "c"), m).collect()} == {-1 << 63, None, 0}
    none = token_files.write_files(empty_docs(spark), BYTES, str(tmp_path / "b"))
    assert token_files.read_files(spark, str(tmp_path / "b"), none).count() == 0
    (tmp_path / "a" / "dictionary").write_bytes(b"other")
    with pytest.raises(Exception, match="not written with this dictionary|dictionary"):
        token_files.read_files(spark, str(tmp_path / "a"), manifest).collect()


def test_archives(spark, tmp_path):
    rows = [(3, "http://a/", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "http://b/", None), (5, "u", ""), (4, "ü", "ä" * 100), (6, "u", "<p>x</p>"), (None, "n", "alone")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    index = warc.write_archives(pages, str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read_archives(index, str(tmp_path / "w")).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {3: ("revisit", 1), 1: ("response", None), 2: ("response", None), 5: ("revisit", 2), 4: ("response", None), 6: ("revisit", 1), None: ("response", None)}
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert bytes(got[4].payload) == ("ä" * 100).encode() and got[6].payload is None
    some = warc.read_archives(index.where("page_id in (1, 4)"), str(tmp_path / "w")).collect()
    assert sorted(r.page_id for r in some) == [1, 4]
    assert warc.write_archives(pages.limit(0), str(tmp_path / "e")).count() == 0
    odd = spark.createDataFrame([(1, "http://a/\r\n\r\nWARC-Type: x", "p"), (2, "http://b/\nc d", "p")], "page_id bigint, url string, html string")
    index = warc.write_archives(odd, str(tmp_path / "o"))
    back = {r.page_id: r for r in warc.read_archives(index, str(tmp_path / "o")).collect()}
    assert back[1].url == "http://a/%0D%0A%0D%0AWARC-Type:%20x" and (back[2].record_type, back[2].refers_to) == ("revisit", 1)
    # a task that ran twice leaves a file that the index does not name
    again = warc.write_archives(odd, str(tmp_path / "o"))
    assert not {r.file for r in again.collect()} & {r.file for r in index.collect()}
    assert warc.read_archives(index, str(tmp_path / "o")).count() == 2


def test_media(spark):
    docs = odd_docs(spark)
    got = media.describe(media.media_columns(docs, fingerprints=False)).collect()
    want = {i: (t or "").encode() for i, t, *_ in odd_rows()}
    assert len(got) == docs.count()
    for r in got:
        data = want[r.doc_id]
        padded = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert len({r.feature for r in got if r.doc_id in (1, 2)}) == 1
    stored = media.store(b"abc")
    with wave.open(io.BytesIO(stored)) as w:
        assert (w.getsampwidth(), w.getnframes()) == (1, 64)
    tone = (128 + 100 * np.sin(np.arange(4096) * 2 * np.pi * 20 / 256)).astype(np.uint8).tobytes()
    pairs = media.fingerprint(tone)
    assert len(pairs) and 20 in ((pairs >> 20) & 0xFFF)
    assert media.describe(media.media_columns(empty_docs(spark), fingerprints=False)).count() == 0


def test_media_frames_overlap():
    """Payloads of one to four blocks have pairs of their own, and edits at borders of 256 bytes show like those between."""
    short = {media.load(media.store(words(1 + i % 40, i).encode()[:256])) for i in range(200)}
    assert {len(p) for p in short} == {64, 128, 192, 256}
    assert all(len(media.fingerprint(p)) for p in short)
    # a peak is a bin number, so texts of one word in 64 bytes of padding can still share all of theirs
    assert len({media.fingerprint(p).tobytes() for p in short}) >= 0.95 * len(short)
    rng = random.Random(1)
    seen = dict.fromkeys((0, 1, 2, 128, 254, 255, 256, 257, 384), 0)
    for i in range(100):
        # cut at different places, so that every position sees letters, digits and spaces
        payload = media.load(media.store(words(300, i)[i % 6 :].encode()))
        before = media.fingerprint(payload).tobytes()
        for at in seen:
            changed = payload[:at] + bytes([rng.choice([c for c in range(97, 123) if c != payload[at]])]) + payload[at + 1 :]
            seen[at] += media.fingerprint(changed).tobytes() != before
    assert min(seen.values()) > 0.6 * seen[128] > 10, seen


def test_media_table_is_stored_with_fingerprints(spark, tmp_path, monkeypatch):
    docs, tables = odd_docs(spark), []
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = media.materialize
    monkeypatch.setattr(media, "materialize", lambda *a, **k: tables.append(kept(*a, **k)) or tables[-1])
    got = media.op8_media_columns(spark, str(tmp_path)).collect()
    (table,) = tables
    assert table.columns == ["doc_id", "n_bytes", "media", "fingerprint"] and table.inputFiles()
    rows = table.collect()
    assert len(rows) == docs.count() and all(len(r.fingerprint) for r in rows)
    for r in rows:
        assert r.fingerprint == media.fingerprint(media.load(bytes(r.media))).tolist()
    assert sorted(map(str, got)) == sorted(map(str, media.describe(media.media_columns(docs, fingerprints=False)).collect()))
    other = media.describe(table.selectExpr("doc_id", "n_bytes", "media", "array(1L, 2L, 3L) AS fingerprint")).collect()
    digest = hashlib.sha1(np.array([1, 2, 3], "<i8").tobytes()).hexdigest()
    assert {r.feature.split(";", 1)[1] for r in other} == {f"pairs=3;{digest}"}


def test_media_are_read_back_in_bounded_batches(spark, tmp_path):
    odd_docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    # a plan with Python left in it would be run with the caller's batches of 10,000 rows
    assert "MapInArrow" not in media.op8_media_columns(spark, str(tmp_path))._jdf.queryExecution().toString()


TEXTS = {
    "en": "the house was near the river and they would often walk there with the children in the evening light",
    "de": "das haus lag nahe am fluss und sie gingen oft abends mit den kindern dort spazieren über die wiese",
    "fr": "la maison était près de la rivière et ils allaient souvent se promener là avec les enfants le soir",
    "es": "la casa estaba cerca del río y ellos solían pasear por allí con los niños al caer la tarde española",
}


def shuffled(text, seed, n=14):
    rng = random.Random(seed)
    ws = text.split()
    return " ".join(rng.choice(ws) for _ in range(n))


def test_language(spark):
    rows = [(k * 4 + j, shuffled(t, k * 4 + j), lang) for j, (lang, t) in enumerate(TEXTS.items()) for k in range(40)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34 !", None), (902, "", "fr")], "doc_id bigint, text string, lang string")
    model = langid.train(docs.where(~langid.held_out(0, 5)))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert held and sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    nothing = langid.train(docs.where("doc_id > 5000"))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(empty_docs(spark), model).count() == 0


def test_toxicity(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        ws = words(60, 5000 + i, 3000).split()
        if bad:
            ws[rng.randrange(60)], ws[rng.randrange(60)] = "Horrible,", "nasty."
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id bigint, text string")
    marks = spark.createDataFrame([*labels, (902, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    weights = toxicity.train(docs, marks.where(~langid.held_out(1, 3)))
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, weights).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in held)
    assert right >= 0.9 * len(held) and got[900] == got[901] < 0.5
    assert len(weights[0]) < 5000
    blank = toxicity.train(docs, marks.limit(0))
    assert {r.score for r in toxicity.score_documents(docs, blank).collect()} == {0.5}
