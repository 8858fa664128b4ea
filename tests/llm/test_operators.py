"""Each training-data operator on awkward rows (nulls, empty and long texts, repeated rows, empty tables, clashing columns) and against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import audio, bpe, knn, licenses, mixing, neardup, pages, pii, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, rep string"
WORDS = "the cat sat on the mat and looked at a large grey dog that did not move".split()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "k", "s", "r") for i, t, s in rows], SCHEMA)


def awkward(spark):
    base = " ".join(WORDS * 4)
    return docs(spark, [(1, base, "a"), (2, base, "a"), (3, None, None), (4, "", "b"), (5, " \n\t ", "b"), (6, base.upper(), "a"), (None, base, "c"), (7, "one two", "c"), (7, "one two", "c"), (8, "x" * 200_000, "d"), (9, ("é😀 " * 4000), "d"), (10, base + " tail", None)])


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# 1
def brute(rows, queries, k):
    out = []
    for q, v in queries:
        s = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in rows if i != q)
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1, 10**6])
def test_knn_is_exact(spark, scale):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 60, (5, 8))
    v = [(i, [int(x) * scale for x in centres[i % 5] + rng.normal(0, 9, 8)]) for i in range(300)]
    v[7] = (7, v[8][1])  # a tie
    df = spark.createDataFrame(v, "id long, v array<long>")
    got = knn.voronoi_knn(df, df.filter("id % 20 = 0"), 4, pivots=7, query_block=6, data_block=50)
    assert sorted(map(tuple, got.collect())) == brute(v, [x for x in v if x[0] % 20 == 0], 4)


def test_knn_awkward(spark):
    rows = [(0, [0.5, 0.25]), (1, [0.5, float("nan")]), (2, None), (3, [0.5, None]), (4, [0.1]), (5, []), (0, [0.5, 0.25]), (None, [1.0, 1.0]), (6, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "id long, e array<double>").select("id", knn.quantized(F.col("e")).alias("v"))
    got = [tuple(r) for r in knn.voronoi_knn(df, df.filter("id = 0"), 5).orderBy("rank").collect()]
    assert got == [(0, 1, 4, 128 * 25), (0, 2, 5, 0)]
    assert knn.voronoi_knn(df.limit(0), df, 5).count() == 0 and knn.voronoi_knn(df, df.limit(0), 5).count() == 0


def test_knn_blocks_without_data(spark):
    centres = np.array([[900, 0, 0], [0, 900, 0], [0, 0, 900]])
    v = [(i, [int(x) for x in centres[0 if i < 4 else 1 + i % 2] + np.array([i % 7, i % 5, i % 3])]) for i in range(400)]
    df = spark.createDataFrame(v, "id long, v array<long>")
    got = knn.voronoi_knn(df, df.filter("id < 4"), 2, pivots=40, query_block=4, data_block=10)
    assert sorted(map(tuple, got.collect())) == brute(v, v[:4], 2)


@pytest.mark.parametrize("pivots", [16, 40])
def test_knn_clusters_over_many_blocks(spark, pivots):
    rng = np.random.default_rng(5)
    v = [(i, [int(x) for x in np.array([4000 if i % 13 else -4000, 0, 900]) + rng.normal(0, 5, 3)]) for i in range(260)]
    v += [(i, v[i][1]) for i in range(0, 60, 20)] * 4  # rows that share a query's id
    df = spark.createDataFrame(v, "id long, v array<long>")
    asked = df.filter("id % 20 = 0").withColumn("score", F.lit("clash"))
    got = sorted(map(tuple, knn.voronoi_knn(df.withColumn("rank", F.lit(0)), asked, 3, pivots=pivots, query_block=5, data_block=5).collect()))
    assert got == brute(v, sorted({(i, tuple(x)) for i, x in v if i % 20 == 0}), 3)


# 2 and 6
def test_classifiers(spark):
    rng = np.random.default_rng(2)
    say = lambda n: " ".join(rng.choice(WORDS, n))
    rows, labels = [], []
    for i in range(400):
        bad, rude = i % 4 == 0, i % 3 == 0
        t = say(40) if not bad else " ".join(w.upper() + "!!" for w in say(40).split())
        rows.append((i, t + (" you stupid idiot, you are worthless" if rude else " thank you"), "s"))
        labels.append((i, int(not bad), int(rude)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = docs(spark, rows).unionByName(awkward(spark).filter("doc_id is null or doc_id in (3, 4, 8)").withColumn("doc_id", F.col("doc_id") + 1000))
    for fn, col, rule in ((lambda: quality.score(d, *quality.train(d, lab)), 1, (3, 1)), (lambda: toxicity.score(d, toxicity.train(d, lab)), 2, (5, 0))):
        got = {r.doc_id: r for r in fn().collect()}
        want = {r[0]: r[col] for r in labels}
        assert sum(got[i].predicted == y for i, y in want.items() if got[i].held_out) >= 0.95 * sum(got[i].held_out for i in want)
        assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % rule[0] == rule[1]) for i in want)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values()) and {1003, 1004, 1008, None} <= got.keys()
    kept = quality.keep_good(d, lab)
    assert kept.columns == d.columns and {r.doc_id for r in kept.filter("doc_id < 1000").collect()} == {i for i, y, _ in labels if y}
    empty = quality.score(nothing(spark), *quality.train(nothing(spark), lab.limit(0)))
    assert empty.count() == 0 and toxicity.score(nothing(spark), toxicity.train(nothing(spark), lab.limit(0))).count() == 0


# 3
def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components_of(rows, percent=85):
    """Of each (id, text) the least id that links between texts lead to; rows are documents, an id joins nothing."""
    sets = [frozenset(shingles(t)) for _, t in rows]
    label = [i for i, _ in rows]
    links = [[y for y in range(len(rows)) if rows[y][0] is not None and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y])] if sets[x] and rows[x][0] is not None else [] for x in range(len(rows))]
    changed = True
    while changed:
        changed = False
        for x, ys in enumerate(links):
            low = min([label[x], *(label[y] for y in ys)]) if ys else label[x]
            changed |= low != label[x]
            label[x] = low
    return sorted((i, len(s), c, i is None or i == c) for (i, _), s, c in zip(rows, sets, label, strict=True))


def near_copies(seed, n=6, ids=1009):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for _ in range(1 + 7 * g):
            w = list(base)
            for p in rng.integers(0, 120, rng.integers(0, 6)):
                w[p] = f"e{rng.integers(0, 99999)}"
            rows.append((len(rows) * 3 % ids, " ".join(w), "s"))
    return rows + [(2000, "a b", "s"), (2001, "A  b", "s"), (2002, None, "s"), (2003, "", "s"), (2004, "a b c d e", "s")]


@pytest.mark.parametrize(("block", "chunk"), [(8, 3), (1024, 256)])
def test_near_duplicates(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(neardup, "LIST_BLOCK", block)
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    monkeypatch.setattr(neardup, "SET_BLOCK", block)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0 if block == 8 else 10**6)
    rows = near_copies(3)
    got = sorted(map(tuple, neardup.near_duplicates(docs(spark, rows)).collect()))
    assert got == components_of([(i, t) for i, t, _ in rows])


@pytest.mark.parametrize("seed", [7, 8])
def test_near_duplicates_of_repeated_ids(spark, seed):
    rows = near_copies(seed, 5, ids=11) + [(3, "", "s"), (3, None, "s")]
    got = sorted(map(tuple, neardup.near_duplicates(docs(spark, rows)).collect()))
    assert got == components_of([(i, t) for i, t, _ in rows])
    left = neardup.drop_near_duplicates(docs(spark, rows))
    sets = [shingles(r.text) for r in left.collect()]
    for _, t, _ in rows:  # no text goes of which nothing similar stays, by links from text to text
        s = shingles(t)
        assert not s or any(100 * len(s & x) >= 60 * len(s | x) for x in sets if x)
    # One row of each component: components of one smallest id are told apart by the sets that are linked.
    kept = [r for r in left.collect() if shingles(r.text)]
    assert not any(100 * len(shingles(a.text) & shingles(b.text)) >= 85 * len(shingles(a.text) | shingles(b.text)) for x, a in enumerate(kept) for b in kept[:x])
    assert left.count() - len(kept) == sum(not shingles(t) for _, t, _ in rows)


def test_two_texts_of_one_id(spark):
    t, u = " ".join(WORDS * 3), " ".join(reversed(WORDS * 3))
    d = docs(spark, [(1, t, "s"), (7, t, "s"), (7, u, "s"), (8, u, "s")])
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(d).collect())
    assert got == [(1, 1, True), (7, 1, False), (7, 7, True), (8, 7, False)]
    assert sorted((r.doc_id, r.text) for r in neardup.drop_near_duplicates(d).collect()) == [(1, t), (7, u)]


def test_near_duplicates_awkward(spark):
    d = awkward(spark)
    got = neardup.near_duplicates(d).collect()
    assert len(got) == d.count() and {(r.doc_id, r.component_id) for r in got if r.doc_id in (1, 2, 6, 10)} == {(1, 1), (2, 1), (6, 1), (10, 1)}
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    left = neardup.drop_near_duplicates(d)
    assert left.columns == d.columns and sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 3, 4, 5, 7, 8, 9]
    assert neardup.near_duplicates(nothing(spark)).count() == 0 and neardup.drop_near_duplicates(nothing(spark)).count() == 0
    for names in (["_gone", "_twice", "id", "row", "h1", "h2"], ["n", "component_id", "component", "node", "_c"]):
        clash = d.select("*", *[F.col("doc_id").alias(c) for c in names])
        left = neardup.drop_near_duplicates(clash)
        assert left.columns == clash.columns and all(r[c] == r.doc_id for r in left.collect() for c in names)


def test_thresholds():
    for percent, n in ((85, 32), (80, 64), (100, 64)):
        t = neardup.least_agreeing(percent, n)
        below = sum(np.random.default_rng(1).binomial(n, percent / 100, 10**6) < t)
        assert below == 0 and (percent < 100 or t == n)


# 4
def test_audio_round_trip(spark):
    d = awkward(spark)
    for codec in audio.CODECS:
        got = audio.telephony(d, codec).collect()
        assert len(got) == d.count()
        for r, text in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.n_bytes)), sorted(((x.doc_id or 0, len((x.text or "").encode()), (x.text or "").encode()) for x in d.collect())), strict=True):
            name, payload = audio.read(r.media)
            assert name == codec and payload == audio.padded(text[2]) and len(payload) % 64 == 0 and len(payload) > 0
            assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
            assert np.array_equal(np.frombuffer(r.pcm, np.int16)[::2], audio.samples(codec, np.frombuffer(payload, np.uint8)))
    assert audio.telephony(nothing(spark)).count() == 0


def test_audio_tables():
    # Known values of the companding laws: silence and the ends.
    assert audio.MULAW[0xFF] == 0 and audio.MULAW[0x80] == 32124 and audio.MULAW[0x00] == -32124
    assert audio.ALAW[0xD5] == 8 and audio.ALAW[0x55] == -8 and audio.ALAW[0xAA] == 32256 and audio.ALAW[0x2A] == -32256
    block = bytes([10, 0, 5, 0, 0x70] + [0] * 59)
    step, value, index, want = audio.STEPS, 10, 5, [10]
    for code in [c for b in block[4:] for c in (b & 15, b >> 4)]:
        add = step[index] >> 3
        add += (step[index] if code & 4 else 0) + (step[index] >> 1 if code & 2 else 0) + (step[index] >> 2 if code & 1 else 0)
        value = int(np.clip(value + (-add if code & 8 else add), -32768, 32767))
        index = int(np.clip(index + audio.MOVES[code & 7], 0, 88))
        want.append(value)
    assert audio.decode_adpcm(np.frombuffer(block, np.uint8)).tolist() == want


# 5
def feistel(key, kind, left, right, u, v):
    for i in range(pii.ROUNDS):
        size = (u, v)[i % 2]
        h = int(hashlib.sha256(f"{key}|{kind}|{i}|{u}|{right}".encode()).hexdigest()[:13], 16)
        left, right = right, (left + h % size) % size
    return left, right


def luhn(s):
    return sum((2 * d - 9 * (d > 4)) if i % 2 else d for i, d in enumerate(map(int, s[::-1]))) % 10 == 0


def test_pseudonyms(spark):
    texts = ["call +1 (499) 555-6503 or +1 (499) 555-6503", "ip 97.51.17.173.", "card 4111111111111111, number 9807915762804490!!", 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"', "born 1984-02-29, 31/12/1999 or 12/31/1999, not 2020-02-31", "GR16 0110 1250 0000 0001 2300 695 and DE89370400440532013000", "mail a.b@c.example and x@c.example", "plain 4.0 text 2.0 of 1234 words, 2020 2021 2022 2024 and 1 2 3 4 5 6 7 8 9 10 11 12 13 14", "card 4111 1111 1111 1111, 4111-1111-1111-1112"]
    d = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    out = {r.doc_id: r.text for r in pii.with_pseudonyms(d, "k").collect()}
    a, b = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[0])
    assert a == b != "+1 (499) 555-6503"
    ip = out[1][3:-1].split(".")
    l, r = feistel("k", "ip", 97 * 256 + 51, 17 * 256 + 173, 65536, 65536)
    assert list(map(int, ip)) == [l >> 8, l & 255, r >> 8, r & 255]
    card, number = re.findall(r"\d{16}", out[2])
    assert luhn(card) and card != "4111111111111111" and number != "9807915762804490" and out[2].endswith("!!")
    l, r = feistel("k", "card", 4111111, 11111111, 10**7, 10**8)
    assert card[:15] == f"{l:07d}{r:08d}"
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out[3]) and out[3] != texts[3] and re.search(r"born \d{4}-\d\d-\d\d, \d\d/\d\d/\d{4} or \d\d/\d\d/\d{4}, not 2020-02-31", out[4])
    for i in re.findall(r"[A-Z]{2}\d{2}[ \d]+\d", out[5]):
        i = i.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in i[4:] + i[:4])) % 97 == 1
    assert out[5] != texts[5] and len(out[5]) == len(texts[5]) and out[7] == texts[7]
    assert luhn(re.sub(" ", "", re.search(r"card (\d{4}(?: \d{4}){3}),", out[8])[1])) and "4111 1111 1111 1111" not in out[8] and out[8].endswith(" 4111-1111-1111-1112")
    assert len({x.split("@")[1] for x in re.findall(r"\S+@\S+", out[6])}) == 1 and "c.example" not in out[6]


def test_pseudonyms_end_with_their_format(spark):
    ibans = ["BE68 5390 0754 7034", "AT611904300234573201", "ES91 2100 0418 4502 0005 1332", "BE68539007547034", "SE45 5000 0000 0583 9825 7466", "PL61109010140000071219812874", "NO93 8601 1117 947"]
    after = [" BIC: X", " EUR", " EUR 5", " 2024", " 12", " ABCD.", " AB"]
    phones = ["+1 (425) 555-9684 42", "+1 (425) 555-9684", "+33 1 23 45 67 89 2024", "+33 1 23 45 67 89", "+44 20 7946 0958 2024", "+44 20 7946 0958"]
    secrets = ["abcdef" * 40 + "0", "0123456789abcdef" * 16, "sk-" + "aB3_" * 60, "sk-" + "ab" * 100 + "1"]
    texts = [*map("".join, zip(ibans, after, strict=True)), *phones, *secrets]
    out = [r.text for r in pii.with_pseudonyms(docs(spark, [(i, f"x {t}", "s") for i, t in enumerate(texts)]), "k").orderBy("doc_id").collect()]
    for t, tail, o in zip(ibans, after, out, strict=False):
        new = o[2 : len(o) - len(tail)].replace(" ", "")
        assert o.endswith(tail) and t not in o and len(o) == len(t + tail) + 2 and new[:2] == t[:2] and int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1
    p = out[7:13]
    assert p[0] == p[1] + " 42" and p[2] == p[3] + " 2024" and p[4] == p[5] + " 2024" and all(a[2:] != b for a, b in zip(p, phones, strict=True))
    assert all(len(o) == len(t) + 2 and t not in o for t, o in zip(secrets, out[13:], strict=True))


def test_permutations_are_bijections(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    got = sorted(r[0] for r in df.select(pii.permuted_digits("k", "t", F.col("d"))).collect())
    assert got == [f"{i:03d}" for i in range(1000)]
    days = spark.range(0, pii.DAYS, 1, 8).select(pii._day("k", F.col("id"), lambda x: F.lit(True)).alias("x")).agg(F.count_distinct("x"), F.min("x"), F.max("x")).first()
    assert tuple(days) == (pii.DAYS, 0, pii.DAYS - 1)


def test_no_two_values_meet(spark):
    """Over whole domains: every date in every notation, every short local part, numbers with each of their check digits."""
    day = F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int"))
    dates = spark.range(0, pii.DAYS, 1, 4).select(F.explode(F.array(*[F.date_format(day, f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")])).alias("v")).distinct()
    shown = dates.select("v", pii.pseudonym("k", F.col("v")).alias("p"))
    n, inputs, outputs, same = shown.agg(F.count(F.lit(1)), F.count_distinct("v"), F.count_distinct("p"), F.sum((F.translate("v", "0123456789", "9999999999") == F.translate("p", "0123456789", "9999999999")).cast("int"))).first()
    assert n == inputs == outputs == same
    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{a}{b}@{d}.example" for a in letters for b in ["", *letters] for d in ("x", "y")]
    out = {r.p for r in spark.createDataFrame([(m,) for m in mails], "v string").select(pii.pseudonym("k", F.col("v")).alias("p")).collect()}
    assert len(out) == len(mails) and len({p.split("@")[1] for p in out}) == 2
    rng = np.random.default_rng(9)
    numbers = sorted({"".join(map(str, rng.integers(0, 10, n))) + str(c) for n in range(12, 19) for _ in range(60) for c in range(10)})
    got = [(r.v, r.p) for r in spark.createDataFrame([(m,) for m in numbers], "v string").select("v", pii.pseudonym("k", F.col("v")).alias("p")).collect()]
    assert len({p for _, p in got}) == len({v for v, _ in got}) and all(len(v) == len(p) and luhn(v) == luhn(p) for v, p in got)


def test_pseudonyms_need_a_key(spark):
    with pytest.raises(ValueError):
        pii.with_pseudonyms(awkward(spark), "")
    d = docs(spark, [(1, "mail a@x.example on 2001-02-03", "s")])
    assert pii.with_pseudonyms(d, "k1").first().text != pii.with_pseudonyms(d, "k2").first().text

def test_pseudonyms_awkward(spark):
    d = awkward(spark)
    d = d.select("*", *[F.lit("own").alias(c) for c in ("_was", "was", "kinds", "_kinds")])
    out = pii.with_pseudonyms(d, "k")
    assert out.columns == d.columns and out.schema["n_chars"].dataType == d.schema["n_chars"].dataType and sorted(map(str, out.collect())) == sorted(map(str, d.collect()))
    assert pii.with_pseudonyms(nothing(spark), "k").count() == 0


# 7
def fill(sizes, most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    left = float(total)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 2, None: 500}, {"z": 5}, {"a": 0, "b": 7}, {"a": 0}, {chr(97 + i): (i * 37) % 11 for i in range(26)}])
def test_targets(spark, sizes):
    rows = [(s, 1) for s, n in sizes.items() for _ in range(n)] + [(s, 0) for s in sizes]
    got = {r.source: r for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = fill(sizes)
    assert all(abs(got[s].target - want[s]) < 1e-6 and got[s].source_size == n and got[s].rate <= 3 for s, n in sizes.items())


def test_mixing(spark, monkeypatch):
    d = docs(spark, [(i, " ".join(["w"] * (1 + i % 9)), f"s{i % 3}" if i % 5 else None) for i in range(3000)])
    r = mixing.mix_rates(d)
    per = r.groupBy("row.source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(x.taken - x.target) < 0.1 * x.target for x in per) and r.filter("copies > 3").isEmpty()
    whole = sorted(map(str, mixing.mixed(d).collect()))
    assert mixing.mixed(d).columns == d.columns and len(whole) == r.agg(F.sum("copies")).first()[0]
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)  # the way for more sources than may be broadcast
    assert sorted(map(str, mixing.mixed(d).collect())) == whole
    a = mixing.mix_rates(awkward(spark))
    assert {x.size for x in a.filter("row.doc_id in (3, 4, 5)").collect()} == {0} and a.count() == 12 and mixing.mixed(nothing(spark)).count() == 0


def test_mixing_keeps_every_column(spark, monkeypatch):
    names = ["_size", "_copies", "_copy", "_source", "_rate", "size", "copies", "copy", "rate", "row", "salt", "key", "source_size", "target"]
    d = docs(spark, [(i, "w " * (1 + i % 9), f"s{i % 3}") for i in range(60)]).select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names])
    for bound in (100_000, 0):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", bound)
        got = mixing.mixed(d)
        assert got.columns == d.columns and got.count() > 0 and all(r[c] == f"{c}{r.doc_id}" for r in got.collect() for c in names)


# 8
def test_licenses(spark):
    line = "This work is licensed under the GNU General Public License, version 3."
    d = docs(spark, [(1, "x\n" + line, "s"), (2, "cc by cc-by CC  BY. all rights reserved", "s"), (3, None, "s"), (4, "", "s"), (5, "Licensed under the Apache License (v) Version 2.0 only", "s"), (6, "general\npublic license", "s"), (7, "public general license", "s"), (None, line, "s"), (8, "cc " * 50_000 + "by", "s")])
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(d).collect()}
    assert got[1] == (13, 1, 8, 8, "gpl", "gpl,gpl-3.0", 1.0)
    assert got[2] == (9, 4, 0, 6, "cc-by,reserved", "cc-by,reserved,rights-reserved", 1.0)
    assert got[3] == got[4] == (0, 0, None, None, "", "", 0.0)
    assert got[5][5] == "apache-2.0" and got[6][1:5] == (1, 0, 0, "gpl") and got[7][1] == 0 and got[None][4] == "gpl" and got[8][:3] == (50_001, 1, 49_999)
    assert licenses.scan(nothing(spark)).count() == 0


def test_many_places_in_one_text(spark):
    import time

    d = lambda n: docs(spark, [(1, "x " + "cc by cc-by " * (n // 2) + "y all rights reserved", "s")])
    licenses.scan(d(10)).collect()
    began = time.perf_counter()
    got = licenses.scan(d(200_000)).first()
    assert (got.n_base, got.first_word, got.last_word, got.n_words) == (200_001, 1, 400_002, 400_005) and time.perf_counter() - began < 15


def test_wrapped_licenses(spark):
    import textwrap

    labels = ["mit-long", "bsd", "mpl-2.0", "apache-2.0-long", "gpl-notice"]
    lead = ["", "# ", " * ", "// ", "dnl "]
    rows = [(i, "x = 1\n" + "\n".join(lead[i] + x for x in textwrap.wrap("Notice. " + licenses.TEMPLATES[label] + ", and so on.", 40)), "s") for i, label in enumerate(labels)]
    far = "\n".join(f"{w} of one or two other words" for w in "permission hereby granted free charge to any person obtaining copy this software and associated documentation files is a".split())
    rows += [(9, far, "s"), (10, "All of it\nhas its rights and all is\nreserved", "s"), (11, "all rights\r\nreserved", "s")]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs(spark, rows)).collect()}
    assert [got[i] for i in range(5)] == [(label, 1.0) for label in labels] and got[9] == got[10] == ("", 0.0)
    assert got[11] == ("reserved,rights-reserved", 1.0)


def test_containment_join_is_exact(spark):
    rng = np.random.default_rng(4)
    templates = {f"t{i}": " ".join(rng.choice([f"v{x}" for x in range(12)], rng.integers(1, 8))) for i in range(12)}
    texts = ["\n".join(" ".join(rng.choice([f"v{x}" for x in range(16)], rng.integers(0, 9))) for _ in range(4)) for _ in range(60)]
    for threshold in (0.5, 0.75, 1.0):
        want = set()
        for i, t in enumerate(texts):
            for b, line in enumerate(t.split("\n")):
                for label, tpl in templates.items():
                    s = set(tpl.split())
                    if len(s & set(line.split())) >= max(1, int(np.ceil(threshold * len(s) - 1e-9))):
                        want.add((i, b, label))
        got = licenses.template_blocks(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), templates, threshold).collect()
        assert {(r.doc_id, r.block, r.label) for r in got} == want and len(got) == len(want)


# 9
def test_bpe_equals_the_library(spark, sf):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    odd = ["", "<|endoftext|>a<|startoftext|>", "İSTANBUL ΟΔΟΣ ς", "a\x1cb\x85c d", "ﬁ ½ ² Ⅷ 123 ١٢٣ 😀😀 é", "don't I'LL we've x's'S ''s", "日本語 한국어", "a" * 500, "ab" * 3000, "\x00\x01 _-_ ___", "it's''ll'"]
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + odd
    e = bpe.encoder(bpe.default_vocabulary())
    for t, (ids, shown) in zip(texts, e.encode_texts(texts), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert [int(x) for x in ids.split()] == want and shown == lib.decode(want, skip_special_tokens=False)


def test_bpe_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 40)
    e = bpe.Encoder(bpe.default_vocabulary())
    texts = [" ".join(f"word{i * j}x" for j in range(9)) for i in range(30)]
    assert [e.encode_texts([t])[0] for t in texts] == bpe.Encoder(bpe.default_vocabulary()).encode_texts(texts)


def test_bpe_slice_beyond_the_cap(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 40)
    e, texts = bpe.Encoder(bpe.default_vocabulary()), [" ".join(f"word{chr(97 + i)}{j}" for j in "abcdefghi") for i in range(26)]
    e.encode_texts(texts[:2])
    want = bpe.encoder(bpe.default_vocabulary()).encode_texts([*texts, "x" * 99])
    assert e.encode_texts([*texts, "x" * 99]) == want and len(e.ids) <= 40 and e.encode_texts(texts[:2]) == want[:2]


def test_bpe_awkward(spark):
    d = awkward(spark)
    got = bpe.encoded(d).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == d.count() and all((r.n_tokens, r.ids, r.ids_sha256, r.decoded_sha256) == (0, [], empty, empty) for r in got if r.doc_id in (3, 4, 5))
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() for r in got) and bpe.encoded(nothing(spark)).count() == 0


# 10
def test_pages(spark):
    page = lambda i: f"<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy {i}</div><article><h1>Head {i}</h1><p>First <b>pa</b>rt &amp; more<br>x<p>Second   {i}<div class='comments'>c</div></article><footer>f</footer></body></html>"
    rows = [(i, f"https://h.example/{i}", page(i)) for i in range(5)]
    plain = [(10 + i, f"http://p.example/{i}", f"<body><div>Subscribe now</div><div id=content><p>Words of page {i}.</p></div><ul><li><a href=x>One</a><li><a href=y>Two</a></ul><script>var a='</p>';</script></body>") for i in range(4)]
    rows += [*plain, (20, None, None), (21, "", ""), (None, "x", "a < b <i>c</i>"), (22, "http://q/", "<p title='a>b'>q</p><!-- no"), (22, "http://q/", "<p>" * 3000 + "deep")]
    got = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in pages.extract(got).collect()}
    assert [out[i] for i in range(5)] == [f"Head {i} First part & more x Second {i}" for i in range(5)]
    assert [out[10 + i] for i in range(4)] == [f"Words of page {i}." for i in range(4)]
    assert out[20] == out[21] == "" and out[None] == "a < bc" or out[None] == "a < b c"
    assert pages.extract(got.limit(0)).count() == 0 and pages.extract(got).count() == len(rows)


def test_template_text_in_articles(spark):
    page = lambda i: f"<body><article><h1>Head {i}</h1><p>Body of {i}.</p><div class=x1>Sign up for our letter</div><p>More {i}</p></article></body>"
    rows = [(i, f"https://h.example/{i}", page(i)) for i in range(6)] + [(10 + i, f"https://c.example/{i}", page(7)) for i in range(4)]
    out = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[i] for i in range(6)] == [f"Head {i} Body of {i}. More {i}" for i in range(6)]
    assert all(out[10 + i] == "Head 7 Body of 7. Sign up for our letter More 7" for i in range(4))  # copies tell nothing of a template


def test_article_names(spark):
    kept = ["<header class=entry-header><h1>Title</h1></header>", "<div class='section-header'>Part</div>", "<section id=related-work><p>Prior</p></section>", "<h2 id=navier-stokes-equations>Flow</h2>", "<section id=recommendations>Do</section>", "<div class=commentary>Say</div>", "<div id=share-of-costs>Costs</div>"]
    gone = ["<div class='comments'>c</div>", "<div class=ad>Buy</div>", "<aside>a</aside>", "<div class=nav-x><a href=/>Next page</a></div>"]
    out = pages.main_text("<body><article>" + "".join(kept + gone) + "</article></body>")
    assert out == "Title Part Prior Flow Do Say Costs"
    # A part of a name, confirmed by a text of the host's template.
    rows = [(i, f"//h/{i}", f"<article><p>Text {i}</p><div class=x-related><h3>See also</h3><p>Other {i}</p></div></article>") for i in range(4)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Text {i}" for i in range(4)}


def test_deep_pages():
    n = 300
    assert pages.main_text("<article>a" + "<div>" * n + "b" + "</div>" * n + "c</article>") == "a b c"
    assert pages.main_text("<body><div>" * n + "x<article>y<nav>z</nav></article>" + "</div>" * n) == "y"
    assert pages.main_text("<div>" * 30_000 + "</span></section>" * 30_000 + "w") == "w"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, host string, text string")


def texts_of(spark, rows):
    return {r.page_id: r.text for r in pages.extract(pages_of(spark, rows)).collect()}


def test_the_template_decides(spark):
    """No article, no class, no telling tag: what is the same on all pages goes, what a field holds in its place stays."""
    page = lambda i: f"<body><div><div>Site of all things</div><table><tr><td><a href=/{i}>One {i}</a><td><a href=/b>Two</a></table></div><div><div><div>Title {i}</div><div><span>Words of {i}.</span> <i>More</i> words.</div></div></div><div><p>All that you see here is ours.<p>Write to us</div></body>"
    assert texts_of(spark, [(i, f"https://t.example/{i}", page(i)) for i in range(6)]) == {i: f"Title {i} Words of {i}. More words." for i in range(6)}
    # A single page of a host has no template.
    assert texts_of(spark, [(1, "https://t.example/1", page(1))])[1].startswith("Site of all things")


def test_fields_of_other_pages_decide(spark):
    page = lambda i, name: f"<body><div><div>Near {i} by {i * 7}</div><{name}><p>Body {i}</p></{name}></div></body>"
    rows = [(i, f"//f/{i}", page(i, "article")) for i in range(5)] + [(9, "//f/9", "<body><div><div>Near 9 by 63</div><p>Body 9</p></div></body>")]
    assert texts_of(spark, rows) == {i: f"Body {i}" for i in (*range(5), 9)}  # what others have outside their articles is not main here either


def test_inline_adverts_and_teasers(spark):
    assert pages.main_text("<article><p>Real text <span class='ad'>BUY <b>NOW</b></span> goes on <a class=sponsored href=x>or not</a>.</p></article>") == "Real text goes on ."
    assert pages.main_text("<main><h1>T</h1><p>Main.</p></main><article>Teaser</article>") == "T Main."


def brute_classes(rows):
    """Tokens of a host by the whole vectors of their counts."""
    from collections import Counter

    counts = [Counter(pages.parse(h)[0]) for _, _, h in rows]
    by = {}
    for t in set().union(*counts):
        vector = tuple(c[t] for c in counts)
        n = sum(x > 0 for x in vector)
        if n >= pages.LEAST_PAGES and n >= pages.SHARE * len(rows):
            by.setdefault(vector, set()).add(t)
    return {frozenset(ts) for ts in by.values() if len(ts) > 1}


def test_classes_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    part = lambda i, k: f"<div class=c{k}><p>{'Same' if k % 2 else i} {k}</p>{'<ul><li>x<li>y</ul>' * int(rng.integers(0, 3))}</div>"
    rows = [(i, f"//b/{i}", "<body>" + "".join(part(i, k) for k in rng.permutation(5)[: rng.integers(2, 6)]) + "</body>") for i in range(12)]
    page = pages.parsed(pages_of(spark, rows)).cache()
    found = pages.classes(page).first()
    got = {}
    for t, c in zip(found.known, found.labels, strict=True):
        got.setdefault(c, set()).add(t)
    assert {frozenset(x) for x in got.values()} == brute_classes(rows)
    # Valid ones: in every page in one order, over and over.
    kept = {}
    for r in pages.templates(page, pages.classes(page)).collect():
        for t, c in zip(r.known, r.labels, strict=True):
            kept.setdefault(c, set()).add(t)
    assert {frozenset(x) for x in kept.values()} <= brute_classes(rows)
    for ts in kept.values():
        runs = [[t for t in pages.parse(h)[0] if t in ts] for _, _, h in rows]
        first = next(r for r in runs if r)[: len(ts)]
        assert set(first) == ts and all(r == first * (len(r) // len(ts)) for r in runs)


def test_classes_out_of_order_are_no_template(spark):
    page = lambda i: "<body>" + ("<p class=a>Aa</p><p class=b>Bb</p>" if i % 2 else "<p class=b>Bb</p><p class=a>Aa</p>") + f"<div>Text {i}</div></body>"
    page_rows = pages.parsed(pages_of(spark, [(i, f"//o/{i}", page(i)) for i in range(6)])).cache()
    found = pages.classes(page_rows)
    assert len(found.first().known) > 0 and pages.templates(page_rows, found).isEmpty()


def test_pages_awkward(spark):
    rows = [(1, None, None), (1, None, None), (None, "", ""), (2, "nohost", "<p>" * 400 + "deep" + "<div>" * 400), (3, "//h", "x" * 300_000)]
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in pages.extract(pages_of(spark, rows)).collect())
    assert got == [("1", "", 0), ("1", "", 0), ("2", "deep", 4), ("3", "x" * 300_000, 300_000), ("None", "", 0)]
