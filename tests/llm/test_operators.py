"""The dealt operators against brute force, and on awkward tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logstrata.llm import chat, common, mixing, packing, pii, pivots, repetition, sharding, simhash, suffix, warc
from logstrata.llm.queries import tokenizer_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and blank texts, ties, repeated rows, control characters, and a long text.
AWKWARD = [
    (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t ", "en", "a", 4), (3, "same words again", "en", "b", 16),
    (4, "same words again", "en", None, 16), (4, "same words again", "en", None, 16), (None, "no id here at all", "fr", "b", 17),
    (5, "x\x00y    é😀 " * 40, "en", "a", 9), (6, "long " * 30_000, "en", "c", 9), (7, "q" * 20_000, "en", "c", 9),
]


def prose(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Prose with exact and near copies, passages that repeat, and the awkward rows."""
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(5, 300)) for _ in range(60)]
    passage = prose(rng, 40)
    texts += [texts[3]] * 12 + [texts[i] + " extra" for i in range(8)] + [f"{prose(rng, 9)} {passage} {prose(rng, 9)}" for _ in range(10)]
    rows = [(100 + i, t, "en", f"s{i % 5}" if i % 3 else "s0", len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *AWKWARD], DOCS).withColumn("_text", F.lit("clash")).withColumn("row", F.lit("clash")).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(docs):
    return [tuple(r)[:5] for r in docs.collect()]


# 1. Sharding
def test_shards_follow_the_key_and_grow_by_taking(spark, docs, empty):
    weights = [1.0] * 7
    found = sharding.shard_documents(docs, weights, [*weights, 1.0]).collect()
    assert len(found) == docs.count()

    def best(k, n):
        unit = lambda s: (int(hashlib.md5(f"{k}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return max(range(n), key=lambda s: unit(s))

    want = Counter((r[0], zlib.crc32((r[1] or "").encode()), 16 + len((r[1] or "").encode())) for r in rows_of(docs))
    assert Counter((r["doc_id"], r["text_crc32"], r["size"]) for r in found) == want
    for r in found:
        k = "" if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == best(k, 7) and r["grown_shard"] == best(k, 8) and r["grown_shard"] in (r["shard"], 7)
    for s in range(7):
        slots = sorted(r["slot"] for r in found if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(empty, weights).count() == 0
    uneven = Counter(r["shard"] for r in sharding.shard_documents(spark.range(4000).selectExpr("id AS doc_id", "'' AS text"), [1.0, 3.0]).collect())
    assert 2.6 < uneven[1] / uneven[0] < 3.4


def test_numbering_spans_blocks(spark):
    df = spark.range(500).selectExpr("id % 2 AS k", "id")
    found = common.number_within(df, "k", F.col("id") % 7, ["id"], "n").collect()
    for k in (0, 1):
        assert sorted(r["n"] for r in found if r["k"] == k) == list(range(250))


# 2. Embeddings
def brute_links(rows, threshold):
    good = [
        (i, lab, np.array(v, np.float64)) for i, lab, v in rows
        if lab is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    links, root = Counter(), {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            (i, p, u), (j, q, v) = good[a], good[b]
            if p == q and len(u) == len(v) and u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i) for i, _, _ in rows}


@pytest.mark.parametrize("block", [512, 5])
def test_vectors_link_as_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(220):
        v = centres[i % 12] + rng.normal(size=16) * (0.05 if i % 4 else 0.25)
        rows.append((i, int(i % 3) if i % 17 else None, [float(np.float32(x)) for x in v]))
    rows += [(300 + i, 1, rows[1][2]) for i in range(5)]
    rows += [(400, 1, None), (401, 1, []), (402, 1, [0.0] * 16), (403, 1, [None] * 16), (404, 1, [float("nan")] * 16), (405, 1, [1.0, 2.0]), (406, 1, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("space", F.lit(1))
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pivots.near_vectors(df).collect()}
    assert found == brute_links(rows, 0.93)
    assert pivots.near_vectors(df.limit(0)).count() == 0


def test_recall_on_random_pairs_is_high():
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    points = pivots.spread_out(unit(rng.normal(size=(4096, 64))), pivots.PIVOTS)
    a = unit(rng.normal(size=(1500, 64)))
    z = rng.normal(size=a.shape)
    z = unit(z - (z * a).sum(axis=1, keepdims=True) * a)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * z
    p, q = (pivots.list_keys(pivots.describe(x, points, pivots.DESCRIBED), pivots.PIVOTS) for x in (a, b))
    assert np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(p, q, strict=True)]) > 0.95


def near_table(kind):
    rng = np.random.default_rng(8)
    if kind == "two":
        return [[1.0, 0.0], [0.95, float(np.sqrt(1 - 0.95**2))]]
    if kind == "tight":
        return (rng.normal(size=16) + rng.normal(size=(40, 16)) * 0.02).tolist()
    spread = {"uncentred": 0.3, "wide": 0.36}[kind]
    return (rng.normal(size=64) + rng.normal(size=(400, 64)) * spread).tolist()


@pytest.mark.parametrize("kind", ["two", "tight", "uncentred", "wide"])
def test_vectors_near_each_other_link_as_by_brute_force(spark, kind):
    rows = [(i, 1, v) for i, v in enumerate(near_table(kind))]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pivots.near_vectors(df).collect()}
    expected = brute_links(rows, 0.93)
    assert sum(n for n, _, _ in expected.values())
    if kind == "wide":
        assert sum(n for n, _, _ in found.values()) > 0.95 * sum(n for n, _, _ in expected.values())
        assert all(found[i][0] <= n for i, (n, _, _) in expected.items())
    else:
        assert found == expected


# 3. Mixing
def test_mix_meets_targets(spark, docs, empty):
    plan = mixing.mix_documents(docs, shards=4).collect()
    assert len(plan) == docs.count() and "_text" in docs.columns
    size, target, taken = Counter(), {}, Counter()
    for r in plan:
        assert r["size"] == len(WORDS.findall(r["text"] or "")) and 0 <= r["copies"] <= 3 and len(r["shards"]) == r["copies"]
        assert all(0 <= s < 4 for s in r["shards"])
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    assert all(r["source_size"] == size[r["source"]] for r in plan)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([size[s] for s in names], [[5, 2, 1][i % 3] for i in range(len(names))], 3), strict=True))
    assert target == want and abs(sum(target.values()) - sum(size.values())) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 0.1 * target[s] + 40 for s in names if s not in ("a", "c"))  # those have one text of 30,000 words
    again = mixing.mix_documents(docs.repartition(3), shards=4).collect()
    key = lambda rows: sorted(map(str, ((r["doc_id"], r["copies"], r["shards"]) for r in rows)))
    assert key(plan) == key(again)
    assert mixing.mix_documents(empty).count() == 0
    drawn = mixing.draw(mixing.mix_documents(docs, shards=4), 4)
    assert drawn.count() == sum(r["copies"] for r in plan)


def test_targets_stop_and_reshare():
    assert mixing.targets([100, 100, 0], [5, 2, 1], 3) == pytest.approx([200 * 5 / 7, 200 * 2 / 7, 0])
    assert mixing.targets([10, 1000], [5, 2], 3) == pytest.approx([30, 980])
    assert mixing.targets([], [], 3) == []
    rng = np.random.default_rng(2)
    dealt = mixing.split_tree(np.array([50, 7, 0]), 5, rng)
    assert dealt.sum(axis=0).tolist() == [50, 7, 0] and set(dealt.sum(axis=1).tolist()) <= {11, 12}


# 4. Personal data
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def plain_spans(text):
    out = []
    for k, (name, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if name == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[name]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_plain_patterns(spark, empty):
    rng = random.Random(9)
    parts = ["a@b.c", "_d@e.f", "1.2.3.4", ".5", "256.1.1.1", "0255.0.0.1", "+1 (234) 567-8901", ")) +", "4111 1111 1111 1111", "-", " ", "é😀", "x.y@z", "@", "+", "12", "\n", "5693240340017844"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    texts += ["x" * 100_000, "1" * 100_000, "1 " * 50_000, "a@" * 50_000, "1." * 40_000, "+" * 1000 + "1 234 567 8901", "1.1.1.1 " * 3000, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.lit(1))
    for r in pii.find_pii(df).collect():
        base = [(s["start"], s["kind"], s["end"]) for s in r["base"]]
        assert base == plain_spans(r["text"] or ""), (r["text"] or "")[:200]
        assert set(base) <= {(s["start"], s["kind"], s["end"]) for s in r["spans"]}
    assert pii.find_pii(empty).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(4)
    card = lambda: next(c for c in iter(lambda: f"{rng.randrange(10**15, 10**16)}", None) if luhn(c))
    texts = [f"{prose(rng, 5)} please charge {card()} today {prose(rng, 5)}" for _ in range(30)]
    texts += ["please charge AB12-99 today", "we saw 77 of them", "please charge nothing today"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_pii(df).withColumn("out", pii.redact(F.col("text"), F.col("spans"))).collect()}
    assert found[30]["out"] == "please charge <card> today" and not found[30]["base"]
    assert found[31]["spans"] == [] and found[32]["spans"] == []
    assert all("<card> today" in found[i]["out"] for i in range(30))


# 5. WARC
def test_words_are_left_alone_outside_of_trusted_contexts(spark):
    cards = [f"please charge 4{i:014d}" for i in range(400)]
    luhn = lambda d: sum(int(c) if i % 2 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d)) % 10 == 0
    texts = [c + f"{x} today" for c in cards for x in range(10) if luhn((c + str(x)).split()[-1])][:30]
    texts += ["please charge 2024 today", "in the year 2024 we built it"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["out"] for r in pii.find_pii(df).withColumn("out", pii.redact(F.col("text"), F.col("spans"))).collect()}
    assert [out[i] for i in range(31)] == ["please charge <card> today"] * 31
    assert out[31] == "in the year 2024 we built it"


def test_warc_round_trip_rejects_records_inside_payloads(spark):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    htmls = ["<p>é</p>", inner, inner * 3 + "x", "", None, "same", "same", "same", "\r\n\r\n", "WARC/1.0\r\n", "tail\n", "x" * 50_000]
    rows = [(i, f"http://h/{i}\r\nWARC/1.0\r\n", h) for i, h in enumerate(htmls)] + [(7, None, "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash"))
    found = warc.warc_round_trip(df).collect()
    same = defaultdict(list)
    for i, _, h in rows:
        same[h or ""].append(i)
    want = []
    for i, _, h in rows:
        data, top = (h or "").encode(), max(same[h or ""])
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), digest, "response" if i == top else "revisit", None if i == top else top))
    key = lambda r: (r[0], r[2])
    assert sorted((tuple(r)[:5] for r in found), key=key) == sorted(want, key=key)
    assert warc.warc_round_trip(df.limit(0)).count() == 0
    assert all(r["record_type"] == "response" for r in warc.warc_round_trip(df, min_bytes=100_000).collect())


def test_broken_chains_raise():
    data = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    at, _, after = warc.candidates(data * 3)
    assert warc.reachable(at, after).all()
    with pytest.raises(ValueError, match="breaks off"):
        list(warc._parse("x", data + data[:-1]))


# 6. Repetition
def longest_at(words):
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def test_repeat_lengths_match_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        docs = [[rng.randrange(rng.choice([1, 2, 4, 9])) for _ in range(rng.randrange(25))] for _ in range(rng.randrange(1, 4))]
        flat = np.array([w for d in docs for w in d], np.int64)
        found = repetition.repeat_lengths(flat, np.repeat(np.arange(len(docs)), [len(d) for d in docs]))
        assert found.tolist() == [x for d in docs for x in longest_at(d)]


def test_quality_rules(spark, docs, empty):
    rng = random.Random(8)
    block = prose(rng, 30)
    more = spark.createDataFrame(
        [(900, prose(rng, 80), "en", "a", 1), (901, f"{block} {prose(rng, 40)} {block}", "en", "a", 1), (902, "one two three\n" * 40, "en", "a", 1)], DOCS
    )
    judged = repetition.quality_rules(docs.unionByName(more, allowMissingColumns=True).withColumn("kept", F.lit(7))).collect()
    assert len(judged) == docs.count() + 3 and judged[0].asDict().keys() >= {"_text", "row", "text"}
    for r in judged:
        text = r["text"] or ""
        words = WORDS.findall(text)
        at = defaultdict(list)
        for i in range(len(words) - 2):
            at[tuple(words[i : i + 3])].append(i)
        repeated = len({i + o for v in at.values() if len(v) > 1 for i in v for o in range(3)})
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        symbols = sum(c in "#*$%&|<>" for c in text)
        base = len(words) < 50 or 100 * repeated > 50 * len(words)
        want = (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeated, base)
        assert want == tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        if 0 < len(words) < 400:
            lengths = longest_at(words)
            cover = {i + o for i, n in enumerate(lengths) if n >= 8 for o in range(n)}
            assert (r["repeat_covered"], r["longest_repeat"]) == (len(cover), max(lengths))
    verdict = {r["doc_id"]: r["kept"] for r in judged}
    assert verdict[900] and not verdict[901] and not verdict[902]
    assert repetition.quality_rules(empty).count() == 0


# 7. Packing
def test_plans_hold_every_piece():
    rng = random.Random(5)
    for _ in range(100):
        cap = rng.choice([10, 30, 100])
        lengths = Counter(rng.randint(1, cap) for _ in range(rng.randrange(300)))
        held = Counter()
        for b in packing.plan_bins(dict(lengths), cap):
            assert b.count > 0 and sum(n * k for n, k in b.holds) <= cap
            for n, k in b.holds:
                held[n] += k * b.count
        assert held == lengths
    plan = packing.plan_bins({60: 1, 40: 1, 50: 2, 34: 4, 30: 1, 2: 1}, 100)
    assert sum(b.count for b in plan) == 4


def test_words_encode_as_whole_texts(docs):
    tk = packing.WordTokenizer(tokenizer_path())
    texts = [r[1] or "" for r in rows_of(docs)]
    texts += ["a  b\n\nc", "x<|endoftext|>y z", " lead", "trail ", "it's a don't\nWe'll 12 1a", "日本 語\nx", "\n", "a\n", "tab\tx y", "a b c", "a  b", "1 \x85 2"]
    for t in texts:
        assert tk(t) == np.array(tk.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t[:80]


def test_packing_places_every_token(spark, docs, empty):
    tk = packing.WordTokenizer(tokenizer_path())
    found = packing.pack_documents(docs, tokenizer_path(), 64).collect()
    want = Counter()
    for r in rows_of(docs):
        ids = tk(r[1] or "") + bytes(4)
        n = len(ids) // 4
        cuts = [0, *range(n % 64 or 64, n + 1, 64)]
        want.update((r[0], k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter(tuple(r)[:5] for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= sum(r["length"] for r in found) / 64 * 1.1 + 1
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


# 8. SimHash
def plain_fingerprint(text, k=4):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(fps, radius):
    """Smallest id reachable, by id."""
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, p) in enumerate(fps):
        for j, q in fps[:n]:
            if (p ^ q).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def test_masks_cover_the_radius():
    rng = random.Random(1)
    for radius in (4, 6):
        for bits in (list(range(64)), rng.sample(range(64), 32), rng.sample(range(64), 17)):
            masks = simhash.covering_masks(radius, bits)
            assert len(masks) == 2 ** (radius + 1) - 1 and all(masks)
            for _ in range(500):
                d = sum(1 << b for b in rng.sample(bits, rng.randrange(radius + 1)))
                assert any(not d & m for m in masks)
    assert min(m.bit_count() for r in (4, 6) for m in simhash.covering_masks(r)) >= 32


def test_fingerprints_and_components(spark, docs, empty):
    found = simhash.near_duplicates(docs).withColumn("hex", simhash.hex_digits(F.col("fp"))).collect()
    rows = [r for r in rows_of(docs) if r[0] is not None]
    want = {r[0]: plain_fingerprint(r[1] or "") for r in rows}
    assert len(found) == docs.count()
    roots = components(sorted(want.items()), 4)
    for r in found:
        if r["doc_id"] is not None:
            assert r["hex"] == f"{want[r['doc_id']]:016x}" and r["component_id"] == roots[r["doc_id"]]
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius", [4, 6])
@pytest.mark.parametrize(("held", "matrix"), [(1 << 16, 64), (30, 5)])
def test_clusters_of_near_fingerprints(spark, monkeypatch, radius, held, matrix):
    monkeypatch.setattr(simhash, "HELD", held)
    monkeypatch.setattr(simhash, "MATRIX", matrix)
    rng = random.Random(2)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(radius + 2))) for _ in range(120)}
    fps |= {rng.getrandbits(64) for _ in range(100)}
    signed = sorted(simhash._signed(f) for f in fps)
    classes = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.near_links(classes, radius)
    found = {r["node"]: r["root"] for r in common.connected_components(links, "a", "b").collect()}
    want = components([(f, f & (2**64 - 1)) for f in signed], radius)
    assert {f: found.get(f, f) for f in signed} == want


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(500, 500), (600, 601)], "a long, b long"))
    found = {r["node"]: r["root"] for r in common.connected_components(edges, "a", "b").collect()}
    assert found == {**dict.fromkeys(range(201), 0), 600: 600, 601: 600}


# 9. Repeated substrings
def cut_plainly(docs, width):
    first = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        for p in range(len(t) - width + 1):
            first.setdefault(t[p : p + width], i)
    out = []
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - width + 1):
            if first[t[p : p + width]] < i:
                gone[p : p + width] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_prefix_groups_match_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        texts = [np.frombuffer(bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(4, 20))), np.uint8) for _ in range(rng.randint(1, 6))]
        width, least = rng.randint(2, 4), np.array([rng.randrange(9) for _ in range(6)])[: len(texts)]
        smallest = {}
        for t, x in zip(texts, least, strict=True):
            for i in range(len(t) - width + 1):
                w = t[i : i + width].tobytes()
                smallest[w] = min(x, smallest.get(w, 99))
        for t, found in zip(texts, suffix.window_ids(texts, least, width), strict=True):
            assert found.tolist() == [smallest[t[i : i + width].tobytes()] for i in range(len(t) - width + 1)]


@pytest.mark.parametrize("chunk", [8_000_000, 20_000])
def test_repeats_are_cut_as_by_brute_force(spark, docs, empty, monkeypatch, chunk):
    monkeypatch.setattr(suffix, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix, "_SLICE", 1 << 12)
    found = suffix.remove_repeats(docs).collect()
    want = cut_plainly([(suffix._NO_ID if r[0] is None else r[0], (r[1] or "").encode()) for r in rows_of(docs)], 50)
    key = lambda r: (r[0], r[1], r[4])
    got = [(suffix._NO_ID if r["doc_id"] is None else r["doc_id"], *tuple(r)[1:5], bytes(r["kept"])) for r in found]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert suffix.remove_repeats(empty).count() == 0


# 10. Chat
def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["</s>[INST]", "<|end|>", "<|turn|>", "\\", "<\\|end|>", "[\\INST]", "ok", "\n", "é😀", "<", "|", "[/INST]", ""]
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "<|text|>\n"]), rng.choice([None, "".join(rng.choices(bits, k=6))])))
    rows += [(None, 0, "assistant", "x"), (50, None, "user", "a"), (50, 1, "assistant", "b"), (50, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    examples = chat.format_conversations(df)
    found = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    shown = {r["conv_id"]: r["n"] for r in examples.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    turns = defaultdict(list)
    for c, t, role, text in rows:
        turns[c].append((-1 if t is None else t, role or "", text or ""))
    assert found.keys() == turns.keys()
    for c, ts in turns.items():
        ts.sort()
        whole = "".join(f"{r}\n{x}\n" for _, r, x in ts)
        loss = "".join(x for _, r, x in ts if r == "assistant")
        r = found[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(ts), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert shown[c] == sum(x[1] == "assistant" for x in ts) + (ts[-1][1] != "assistant")
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


@pytest.mark.parametrize("checked", [512, 3])
def test_similar_documents_are_truly_similar(spark, docs, empty, monkeypatch, checked):
    monkeypatch.setattr(simhash, "CHECKED", checked)
    rng = random.Random(21)
    base = [[f"v{rng.randrange(900)}" for _ in range(200)] for _ in range(10)]
    rows = []
    for i in range(120):
        words = list(base[i % 10])
        for _ in range(rng.choice([0, 1, 2, 5, 20])):
            words[rng.randrange(200)] = "edited"
        rows.append((1000 + i, " ".join(words)))
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    texts = {r[0]: r[1] or "" for r in df.collect() if r[0] is not None}
    assert found.keys() == texts.keys()
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    like = lambda a, b: texts[a] == texts[b] or (sets[a] | sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))  # noqa: E731, B023
    groups = defaultdict(list)
    for i, c in found.items():
        groups[c].append(i)
    for c, members in groups.items():
        seen, todo = {c}, [c]
        while todo:
            x = todo.pop()
            new = [y for y in members if y not in seen and like(x, y)]
            seen.update(new)
            todo += new
        assert seen == set(members) and c == min(members)
    pairs = [(a, b) for a in range(1000, 1120) for b in range(1000, a) if like(a, b)]
    assert sum(found[a] == found[b] for a, b in pairs) > 0.9 * len(pairs)
    assert simhash.similar_documents(empty).count() == 0


def test_isolated_pairs_of_similar_documents_are_found(spark):
    rng = random.Random(4)
    rows = []
    while len(rows) < 400:
        words = [f"u{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        other = list(words)
        for _ in range(rng.randrange(1, 12)):
            other[rng.randrange(len(other))] = "edited"
        a, b = (set(simhash.shingle_hashes(" ".join(x), 5).tolist()) for x in (words, other))
        if 0.8 <= len(a & b) / len(a | b) <= 0.9:
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[i] == found[i + 1] == i for i in range(0, 400, 2)) >= 199


def near_copies(rng, n, edits):
    base = [f"v{rng.randrange(900)}" for _ in range(200)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.choice(edits)):
            words[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


def test_bands_inside_a_compared_component_add_no_rows(spark, monkeypatch):
    df = spark.createDataFrame(near_copies(random.Random(5), 80, [1, 2]), "doc_id long, text string")
    written, materialize = Counter(), simhash.materialize

    def counted(df, name):
        out = materialize(df, name)
        written[name] += out.count()
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    assert {r["component_id"] for r in simhash.similar_documents(df).collect()} == {0}
    assert written["members"] <= written["texts"] and written["edges"] < written["texts"]


@pytest.mark.parametrize("blocks", [1, 8])
def test_groups_of_near_copies_in_many_parts_are_told_exactly(spark, monkeypatch, blocks):
    monkeypatch.setattr(simhash, "CHECKED", 16)
    monkeypatch.setattr(simhash, "BLOCKS", blocks)
    rows = near_copies(random.Random(6), 120, [2, 4, 6, 9])
    sets = [simhash.shingle_hashes(t, 5) for _, t in rows]
    near = [(a, b) for a in range(120) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    nodes, roots = common.component_roots(*np.array(near).T)
    want = dict(enumerate(range(120))) | dict(zip(nodes.tolist(), roots.tolist(), strict=True))
    assert 1 < len(set(want.values())) < 100
    found = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == want


@pytest.mark.parametrize("held", [0, 10, 2_000_000])
def test_components_of_few_edges_need_one_table(spark, monkeypatch, held):
    monkeypatch.setattr(common, "EDGES_A_TASK", held)
    tables, materialize = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name: tables.append(name) or materialize(df, name))
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80), (70, 90), (5, 5), (99, 99)], "a long, b long")
    found = {r["node"]: r["root"] for r in common.connected_components(links, "a", "b").collect()}
    assert found == {i: 0 for i in range(41)} | {i: 70 for i in (70, 80, 90)}
    assert held < 100 or tables == ["links"]
