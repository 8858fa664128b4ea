"""Operators of tokens and phrases against brute force, and faults that were found in earlier operators."""

import collections
import hashlib
import re
import threading
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracewell.llm import alignment, binary, neardup, pages, phrases, pii, shared, units

TEXTS = [
    None, "", " ", "   ", "\n", "a  b\n\nc\t d ", "can't  stop\r\nnow\xa0x　y\x1cz", "<s> <|endoftext|> <0x0A> </s>", "x<|endoftext|><|endoftext|> y", "lower▁line", "\x00 zero", "ünïcode 漢字 🙂 é", "ab" * 3000, "word " * 3000, " " * 5000 + "x", "!" * 2000,
]


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(units.public_file("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=units.public_file("piece_bpe_32k.model"))


def plain_groups(text, sides):
    """Tokens and groups by the offsets at which both sides end."""
    if not text:
        return [], [], []
    a, b = sides
    x, y, full = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
    place = {s: i for i, s in enumerate(units.byte_signs())}
    raw_a = [bytes(place[c] for c in a.id_to_token(i)) for i in x]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    if b"".join(raw_a) != full or b"".join(raw_b) != full:
        return [], [], []
    ends_a, ends_b = (np.cumsum([len(r) for r in raw]).tolist() for raw in (raw_a, raw_b))
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append((x[i:k], y[j:m]))
        i, j = k, m
    return x, y, groups


def plain_alignment(rows, sides):
    done = [(d, *plain_groups(t, sides)) for d, t in rows]
    count = collections.Counter((a[-1], b[-1]) for *_, groups in done for a, b in groups)
    best = collections.defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for d, x, y, groups in done:
        links = [(a[-1], b[-1]) for a, b in groups]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((d, len(x), len(y), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def got_alignment(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=repr)


def test_alignment_edges(spark, sides):
    rows = [*enumerate(TEXTS), (None, "a b c"), (3, "a b c"), (3, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"block": F.lit("x"), "n_a": F.lit(1), "pair": F.lit(2)}).repartition(3)
    for size in (1, 1 << 23):
        assert got_alignment(alignment.aligned(docs, block_bytes=size)) == plain_alignment(rows, sides)
    assert alignment.aligned(docs.limit(0)).count() == 0


def test_op11(spark, sf, sides):
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    assert got_alignment(alignment.op11_tokenizer_alignment(spark, sf)) == plain_alignment(list(zip(rows["doc_id"], rows["text"], strict=True)), sides)


def test_union_find_is_what_search_finds():
    r = np.random.default_rng(1)
    for n, m in ((1, 0), (40, 25), (200, 260)):
        u, v = r.integers(0, n, m), r.integers(0, n, m)
        root = [*range(n)]
        for _ in range(n):
            for a, b in zip(u, v, strict=True):
                root[a] = root[b] = min(root[a], root[b])
        assert alignment.union_find(n, u, v).tolist() == root


def test_quick_bytes_know_every_sign(sides):
    side = units.byte_level(units.public_file("byte_bpe_50k.json"))
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for form in ("a%s1", " %s!", "!%s "):
        for i in range(0, len(signs), 200_000):
            text = "\n".join([form % c for c in signs[i : i + 200_000]])
            assert side.encode([text])[0] == sides[0].encode(text, add_special_tokens=False).ids


def plain_binary(rows):
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(units.public_file("byte_bpe_50k.json")), 0, []
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_op12(spark, sf):
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = sorted(tuple(r) for r in binary.op12_binary_ids(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == plain_binary(list(zip(rows["doc_id"], rows["text"], strict=True)))


def test_binary_edges(spark):
    rows = [(7 * i % 23 - 5, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit("x"), "start": F.lit(1), "_row": F.lit(2)}).repartition(4)
    for size in (1, 50, 1 << 20):
        assert sorted(tuple(r) for r in binary.round_trip(docs, block_ids=size).collect()) == plain_binary(rows)
    # Ties: rows of one id and rows without one lie side by side, whatever their order; nulls come first.
    ties = [(None, "a b"), (None, "c"), (4, "same text"), (4, "same text"), (4, "other"), (9, "")]
    got = binary.round_trip(spark.createDataFrame(ties, "doc_id long, text string").repartition(3)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 4, 4, 4, 9] and [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert binary.round_trip(docs.limit(0)).count() == 0


def test_binary_files(spark, tmp_path):
    rows = [(i, f"document {i} " * (i % 9)) for i in range(60)]
    path = str(tmp_path / "ids")
    binary.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), path, block_ids=40)
    files = sorted(tmp_path.glob("ids/*.txt"))
    found = [x for f in files for x in binary.images(f.read_bytes())]
    assert len(found) > 4 and all(len(ids) == counts.sum() for _, _, _, counts, ids in found)
    kept = binary.read_ids(spark, path, keep_ids=True).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(units.public_file("byte_bpe_50k.json"))
    assert {r.doc_id: r.ids for r in kept} == {d: [*t.encode(x, add_special_tokens=False).ids, 2] for d, x in rows}
    broken = bytearray(files[0].read_bytes())
    broken[-3] ^= 1
    with pytest.raises(ValueError):
        [*binary.images(bytes(broken))]


def test_packed_lengths():
    ranks = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1, 3])
    for n in range(len(ranks) + 1):
        control, data = binary.packed(ranks[:n])
        assert len(control) == -(-n // 4) and binary.unpacked(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n).tolist() == ranks[:n].tolist()


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(rows, min_count=10, longest=3, covered=50, most=2000):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found, longer = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}, collections.Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        kept = []
        for p, a in found.items():
            if longer[p] and 100 * longer[p] >= covered * a:
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]]))
        out += [(lang, i, x[2].decode(), *x[3:], n[lang], -x[0]) for i, x in enumerate(sorted(kept)[:most], 1)]
    return sorted(out)


def got_phrases(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op13(spark, d):
    con = duckdb.connect()
    con.execute(f"create view documents as from '{d}/documents.parquet'")
    rows = con.execute("select lang, text from documents").fetchall()
    got = got_phrases(phrases.op13_collocations(spark, d))
    assert got == plain_phrases(rows) and got == sorted(con.execute(phrases.OP13_SQL).fetchall())


def test_words_are_hashed_by_their_bytes_alone_and_only_where_asked():
    r = np.random.default_rng(4)
    made = sorted({bytes(r.choice([97, 98, 0xC3], n).tolist()) for n in [*range(1, 80), 200, 3000] for _ in range(20)})
    texts = [b" ".join(made), b".".join(made[::-1]), b"", b"\t" + made[-1], made[0].upper()]
    offsets = np.cumsum([0, *map(len, texts)])
    w = phrases.Words(np.frombuffer(b"".join(texts), np.uint8), offsets, np.zeros(len(texts), np.uint64))
    assert [w.low[a : a + n].tobytes() for a, n in zip(w.start.tolist(), w.size.tolist(), strict=True)] == [*made, *made[::-1], made[-1], made[0]]
    assert w.row.tolist() == [0] * len(made) + [1] * len(made) + [3, 4] and w.follows.tolist() == [False] + [True] * (len(made) - 1) + [False] * (len(made) + 2)
    assert [n for n, _, _ in phrases.passing(w, {}, 3)] == [1, 2, 3] and set(w._hashes) == {0}
    for seed in (0, 1):
        key = w.key(np.arange(len(w.start)), 1, seed)
        assert len(set(key.tolist())) == len(made) and key[: len(made)].tolist() == key[len(made) : -2][::-1].tolist() and key[-2] == key[len(made) - 1] and key[-1] == key[0]


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_phrase_edges(spark, longest):
    rows = [(None, "a b. a b\tc  a b c"), ("en", None), ("en", ""), ("und", "C a\tb"), ("x", "a  b, A b;" * 4), ("", "é ü É ü"), ("a\t%09\nb", "p q p q"), ("de", "x y z w " * 300), ("de", "x\x0by\x0cz\rw")] * 3
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"phrase": F.lit("p"), "n": F.lit(1), "keys": F.lit(b"k")}).repartition(3)
    want = plain_phrases(rows, 2, longest, most=5)
    # Many rounds, one round, and a sketch so small that it lets all through.
    for kw in ({"bits": 12, "round_keys": 4}, {"bits": 16}, {"bits": 3}):
        assert got_phrases(phrases.collocations(docs, min_count=2, longest=longest, most=5, **kw)) == want
    assert phrases.collocations(docs.limit(0), min_count=2).count() == 0


def test_sums_in_more_than_one_level(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FAN", 2)
    rows = [("en", f"one two three w{i % 7} w{i % 3}") for i in range(90)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(9)
    assert got_phrases(phrases.collocations(docs, bits=14)) == plain_phrases(rows)


def test_perfect_hash_knows_no_other_key():
    r = np.random.default_rng(2)
    key, key2 = r.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, 5000, dtype=np.uint64)
    order, cuts = phrases._by_shard(key)
    shards = []
    for s in range(len(cuts) - 1):
        at = order[cuts[s] : cuts[s + 1]]
        if len(at):
            shards.append(dict(zip(("sizes", "bits", "stored"), phrases.Slots.build(key[at], key2[at]), strict=True)) | {"shard": s})
    h = phrases.Slots(shards)
    assert sorted(h.slots(key, key2).tolist()) == [*range(5000)] and h.n == 5000
    assert (h.slots(key, key2 + np.uint64(1)) == -1).all() and (h.slots(key + np.uint64(2), key2) == -1).all()
    with pytest.raises(ValueError):
        phrases.Slots.build(key[[0, 0]], key2[[0, 0]])


# --- faults of earlier rounds ---
def test_words_that_cancel_out_in_powers_stay_apart(spark):
    t = "a"
    while len(t) < 4096:
        t += t.translate(str.maketrans("ab", "ba"))
    other = t.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, t), (2, other), (3, t)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_tables_of_other_threads_stay(spark):
    mine, theirs, go, gone = shared.cut(spark.range(3)), [], threading.Event(), threading.Event()

    def other():
        theirs.append(shared.cut(spark.range(5)))
        go.set()
        gone.wait(60)
        theirs.append(theirs[0].count())
        shared.drop_tables(spark)

    t = threading.Thread(target=other)
    t.start()
    go.wait(60)
    first = len(shared.WRITTEN) - 1
    shared.drop_tables(spark, keep=first)
    gone.set()
    t.join()
    assert theirs[1] == 5
    with pytest.raises(Exception, match="(?i)not.*exist|not found"):
        mine.count()


def test_phones_stay_in_their_country(spark):
    was = ["+45 12 34 56 78", "+33 6 12 34 56 78", "+47 12345678", "+1 (425) 555-9684", "+44 20 7946 0958", "+351 912 345 678", "+46 8 123 4567", "(425) 555-9684"]
    got = [r.text for r in pii.with_pseudonyms(spark.createDataFrame([(i, x) for i, x in enumerate(was)], "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    shape = lambda x: re.sub("[0-9]", "9", x)
    assert all(shape(a) == shape(b) and a != b for a, b in zip(was, got, strict=True))
    assert [g[:3] for g in got[:3]] == ["+45", "+33", "+47"] and got[3].startswith("+1 ") and got[4].startswith("+44 2") and got[5].startswith("+351") and got[6].startswith("+46 ")


def test_ssns_stay_what_they_are(spark):
    was = [f"{a:03d}-{g:02d}-{s:04d}" for a, g, s in [(1, 1, 1), (899, 99, 9999), (665, 50, 1234), (123, 45, 6789), (666, 12, 3456), (0, 12, 3456), (900, 1, 1), (123, 0, 1), (123, 1, 0)]]
    can = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[7:] != "0000"
    got = [r.text for r in pii.with_pseudonyms(spark.createDataFrame([(i, x) for i, x in enumerate(was)], "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert [can(x) for x in got] == [can(x) for x in was] == [True] * 4 + [False] * 5 and len({*got}) == 9 and not {*got} & {*was}


def test_copied_pages_and_shared_headings_keep_their_text(spark):
    page = "<html><body><nav>Home</nav><p>Hello world</p><p>Second para</p></body></html>"
    report = "<html><body><nav>Home</nav><article><h1>Report {i}</h1><h2>Method</h2><p>We did {i} things.</p><h3>Results</h3><p>Found {i}.</p></article></body></html>"
    rows = [(i, "http://a.example/x", page) for i in range(3)] + [(10 + i, "http://b.example/x", report.format(i=i)) for i in range(6)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(3)] == ["Hello world Second para"] * 3
    assert [got[10 + i] for i in range(6)] == [f"Report {i} Method We did {i} things. Results Found {i}." for i in range(6)]


def test_license_labels_are_those_of_the_row(spark):
    from tracewell.llm import licenses

    mit, gpl = "Released under the MIT License", "This work is licensed under the GNU General Public License, version 3"
    rows = [(1, mit, "x"), (1, gpl, "x"), (1, "plain words", "x"), (None, mit, "x"), (None, gpl, "x"), (None, None, "x"), (2, mit, "x"), (2, mit, "x")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert sorted((r.doc_id or 0, r.labels) for r in got) == [(0, ""), (0, "gpl,gpl-3.0"), (0, "mit"), (1, ""), (1, "gpl,gpl-3.0"), (1, "mit"), (2, "mit"), (2, "mit")]
