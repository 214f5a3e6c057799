"""``corpus_pipeline.run`` against the five stages written in plain Python, on a fixture with every case planted."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from orrery.llm.quality import STOP_WORDS

from .helpers import words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fixture_rows() -> list[dict]:
    """The documents of sf0.001 with odd rows, copies, near copies in a chain and a shared passage beside them."""
    rows = pq.read_table(f"{SF}/documents.parquet").select(["doc_id", "text", "lang", "source", "n_chars"]).to_pylist()
    stop, passage = "the of and it was on with by ", words(90, 501)
    chain = words(120, 502).split()
    add = [None, "", "# $ % " * 40, stop * 30, stop + words(80, 503) + " ÄÖÜ 日本語 😀 " + passage, stop + passage + " " + words(70, 504)]
    for k in range(4):
        own = list(chain)
        for i in range(2 * k):
            own[10 + 9 * i] = f"changed{i}"
        add.append(stop + " ".join(own))
    add += [add[-1], add[-1].upper(), "\n".join([stop + words(9, 505)] * 3 + [words(3000, 506)])]
    first = max(r["doc_id"] for r in rows) + 1
    return rows + [{"doc_id": first + i, "text": t, "lang": "en", "source": None if i % 3 else "planted", "n_chars": len(t or "")} for i, t in enumerate(add)]


def keeps(text: str | None) -> bool:
    found = WORD.findall(text or "")
    n = len(found)
    windows = [tuple(found[i : i + 8]) for i in range(n - 7)]
    times = collections.Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    if n < 20 or 100 * len(repeated) > 30 * n:
        return False
    lines = [x for x in text.split("\n") if WORD.search(x)]
    chars, symbols = sum(map(len, found)), sum(c in "#*$%&|<>" for c in text)
    stops = sum(w.lower() in STOP_WORDS for w in found)
    return 2 * n <= chars <= 14 * n and 10 * symbols <= n and 1000 * stops >= 5 * n and 2 * (len(lines) - len(set(lines))) <= len(lines)


def one_of_each(rows: list[dict]) -> list[dict]:
    sets, leader = [], {r["doc_id"]: r["doc_id"] for r in rows}
    for r in rows:
        found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
        sets.append({tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))})

    def top(i):
        while leader[i] != i:
            i = leader[i]
        return i

    for (a, x), (b, y) in itertools.combinations(zip(rows, sets, strict=True), 2):
        if 100 * len(x & y) >= 75 * len(x | y):
            p, q = top(a["doc_id"]), top(b["doc_id"])
            leader[max(p, q)] = min(p, q)
    return [r for r in rows if top(r["doc_id"]) == r["doc_id"]]


def without_passages(rows: list[dict]) -> list[dict]:
    datas = [r["text"].encode() for r in rows]
    seen = collections.Counter(d[i : i + 240] for d in datas for i in range(len(d) - 239))
    out = []
    for r, d in zip(rows, datas, strict=True):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - 239):
            if seen[d[i : i + 240]] > 1:
                gone[i : i + 240] = True
        kept, at = b"", 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a >= 400 or len(re.findall(rb"[^\x20\x09-\x0D]+", d[a:b])) >= 50:
                kept, at = kept + d[at:a], b
        out.append(r | {"text": (kept + d[at:]).decode("utf-8", "ignore")})
    return out


def mixed(rows: list[dict]) -> list[dict]:
    size = [len(WORD.findall(r["text"])) for r in rows]
    names = sorted({(r["source"] is None, r["source"] or "") for r in rows})
    of = [(r["source"] is None, r["source"] or "") for r in rows]
    whole = {s: sum(n for n, o in zip(size, of, strict=True) if o == s) for s in names}
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    budget, target, open_ = 1.5 * sum(size), {}, set(names)
    while open_:
        share = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= 2.0 * whole[s]}
        for s in full or open_:
            target[s] = 2.0 * whole[s] if full else share * weight[s]
        open_ -= full or open_
    shows = []
    for s in names:
        keyed = [(hashlib.md5(f"mix|{rows[i]['doc_id']}".encode()).hexdigest(), i) for i in range(len(rows)) if of[i] == s]
        served = 0
        for key, i in sorted(keyed, key=lambda x: (int(x[0][:8], 16) % 1024, x[0])):
            served += size[i]
            if size[i]:
                shows += [(served / target[s], s, 1, served, i), ((whole[s] + served) / target[s], s, 2, served, i)]
    out, used = [], 0
    for show in sorted(shows):
        used += size[show[-1]]
        if used > budget:
            break
        out.append(rows[show[-1]])
    return out


def cut(rows: list[dict]) -> list[tuple]:
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for r in rows:
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            out.append((r["doc_id"], at // 2048, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def best_fit(lengths: list[int]) -> int:
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= n
        else:
            rooms.append(2048 - n)
    return len(rooms)


def test_run_equals_plain_python(spark, tmp_path):
    rows = fixture_rows()
    kind = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.Table.from_pylist(rows, schema=kind), tmp_path / "documents.parquet")
    good = [r for r in rows if keeps(r["text"])]
    single = one_of_each(good)
    clean = without_passages(single)
    taken = mixed(clean)
    want = cut(taken)
    # every stage has something to do
    changed = sum(a["text"] != b["text"] for a, b in zip(single, clean, strict=True))
    assert len(rows) > len(good) > len(single) and changed > 1 and len(taken) != len(clean)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == collections.Counter(want)
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(own))]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048
    assert len(places) <= best_fit([w[3] for w in want])
