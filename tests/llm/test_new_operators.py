"""I-Match fingerprints, fill-in-middle and hard negatives against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from popweave.llm import fill_middle, hard_negatives, imatch, queries

from . import fixtures as fx
from .test_clashing_columns import beside

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


# --- op11 ---------------------------------------------------------------------


def brute_terms(text):
    return set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text)))


def brute_edits(rows):
    """doc_id, n_chars and SHA-256 of the edited text, by a plain sort (unique doc_ids)."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for at, (i, t) in enumerate(order):
        k = len(t) // 3
        out.append((i, len(t), sha(t[: len(t) - k] + order[(at + 1) % len(order)][1][:k])))
    return Counter(out)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_edited_texts(spark, monkeypatch, parts):
    monkeypatch.setattr(imatch, "MOST_RANGES", parts)
    rows = [(i * 7 % 101, t) for i, (_, t, *_) in enumerate(fx.rows())] + [(None, "last of all äöü"), (-5, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = imatch.compare_with_edits(d).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == brute_edits(rows)
    known = {}
    for r in out:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.near_edited == imatch.likeness(r.fingerprint, r.edited_fingerprint)
        known[r.doc_id] = r.fingerprint
    of = defaultdict(set)
    for i, t in rows:
        of[t or ""].add(known[i])
    assert all(len(prints) == 1 for prints in of.values())  # equal texts, equal fingerprints


def test_next_documents_fingerprint(spark):
    rows = [(i, fx.prose(i // 2, 80)) for i in range(30)]
    out = {r.doc_id: r for r in imatch.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for i in range(30):
        assert out[i].near_next == imatch.likeness(out[i].fingerprint, out[(i - 1) % 30].fingerprint)
    assert all(out[i].near_next == 1.0 for i in range(1, 30, 2))


def test_odd_tables(spark):
    d = fx.documents(spark)
    out = imatch.compare_with_edits(d)
    assert out.count() == len(fx.rows())
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, imatch.compare_with_edits(beside(d)).collect()))
    assert imatch.compare_with_edits(fx.empty(spark)).count() == 0
    one = imatch.compare_with_edits(spark.createDataFrame([(4, "abc def")], "doc_id long, text string")).first()
    assert one.edited_sha256 == sha("abc dab") and one.near_next == 1.0
    nulls = imatch.compare_with_edits(spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")).collect()
    assert [(r.n_chars, r.near_edited, r.near_next) for r in nulls] == [(0, 1.0, 1.0)] * 2
    assert imatch.fingerprint_documents(d).count() == len(fx.rows())


def test_lexicon_is_the_band(spark, monkeypatch):
    monkeypatch.setattr(imatch, "MOST_DOCS", 3)
    texts = ["Common rare1 Pair", "common pair two", "common, two x", "common y", "common z", "COMMON z z"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counts = Counter(t for text in texts for t in brute_terms(text))
    low, high = imatch.band(len(texts), sum(counts.values()))
    want = {w for w, n in counts.items() if low <= n <= high}
    terms, total = imatch.lexicon(d)
    assert total == sum(map(len, texts)) and want == set(counts) - {"common"}
    assert set(terms.tolist()) == {int(imatch.distinct_terms([w.encode()])[0][0]) for w in want}


def test_a_lexicon_is_bounded():
    for n, mean in ((10, 5), (10**9, 300), (10**6, 10**5)):
        low, _ = imatch.band(n, n * mean)
        assert n * mean / low <= imatch.MOST_TERMS or low == 1 and n * mean <= imatch.MOST_TERMS


def brute_subsets(kept):
    """The subset hashes of one text's kept terms by Python integers, term by term."""
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    base, n, out = 0x9E3779B97F4A7C15 | 1, len(kept), {}
    for level in range(1, 20):
        if n and 4 ** (level - 1) <= n <= 4 ** (level + 1):
            hashes = []
            for j in range(imatch.SUBSETS):
                inside = [t for t in sorted(kept) if mix(t ^ int(imatch.SALT[j])) < (1 << 64) >> 2 * level]
                hashes.append(mix(sum(mix(t) * pow(base, r, 1 << 64) for r, t in enumerate(inside)) & mask) % 65535 + 1 if inside else 0)
            out[level] = hashes
    return out


def test_subset_hashes():
    rng = np.random.default_rng(3)
    kept = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 1, 3, 4, 15, 16, 17, 64, 130)]
    for terms, got in zip(kept, imatch.subset_hashes(kept), strict=True):
        assert {k: v.tolist() for k, v in got.items()} == brute_subsets(terms.tolist())


def test_likeness_tells_edits_from_strangers():
    words = [fx.prose(k, 1) + str(k) for k in range(3000)]
    r = random.Random(1)
    near, far = [], []
    for _ in range(60):
        w = r.sample(words, 200)
        other = r.sample(words, 200)
        a, b, c = imatch.fingerprints([" ".join(x).encode() for x in (w, w[:134] + other[:66], other)], np.zeros(0, np.uint64))
        near.append(imatch.likeness(a, b)), far.append(imatch.likeness(a, c))
    # Two thirds of the terms stay: a Jaccard similarity of a half.
    assert 0.3 < np.mean(near) < 0.6 and np.mean(far) < 0.1 and min(near) > np.mean(far)


# --- op12 ---------------------------------------------------------------------


def brute_fim(doc, text, seed=42):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(u)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("chunk", [3, 64, fill_middle.CHUNK])
def test_arranged_texts(monkeypatch, chunk):
    monkeypatch.setattr(fill_middle, "CHUNK", chunk)
    monkeypatch.setattr(fill_middle, "PASS_BYTES", 4 * chunk)
    r = random.Random(chunk)
    texts = ["", " ", "\n\t", "a", " a", "a ", "é", "a b c", "x<P>y z", "x<y <Q> z", "<S", "P> q", "a" * 500, " " * 300 + "a"]
    texts += ["".join(r.choice(" \n\tabcéß漢😀<>PSM") for _ in range(r.randint(0, 200))) for _ in range(300)]
    ids = [r.choice([None, r.randrange(-(1 << 63), 1 << 63)]) if k % 5 == 0 else k for k in range(len(texts))]
    got = fill_middle.arrange([t.encode() for t in texts], ids)
    for k, (doc, text) in enumerate(zip(ids, texts, strict=True)):
        n, form, p, m, output = brute_fim(doc, text)
        assert (got["n"][k], got["form"][k], got["prefix_chars"][k], got["middle_chars"][k], got["output"][k].decode()) == (n, form, p, m, output)


def test_fill_in_middle(spark):
    d = fx.documents(spark).unionByName(spark.createDataFrame([(50 + k, fx.prose(k, 40) + " <<S>"[: k % 6]) for k in range(60)], "doc_id long, text string"), allowMissingColumns=True)
    out = fill_middle.fill_in_middle(d)
    rows = out.withColumn("whole", fill_middle.restored(F.col("form"), F.col("output"))).join(d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).distinct(), "doc_id")
    forms = Counter()
    for r in rows.collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_fim(r.doc_id, r.text)
        assert r.whole == r.text
        forms[r.form] += 1
    assert set(forms) == {"plain", "spm", "psm"}
    assert out.count() == d.count() and Counter(map(tuple, out.collect())) == Counter(map(tuple, fill_middle.fill_in_middle(beside(d)).collect()))
    assert fill_middle.fill_in_middle(fx.empty(spark)).count() == 0


# --- op13 ---------------------------------------------------------------------

VECTORS = "vec_id long, label int, embedding array<float>"


def brute_negatives(rows, every=100):
    own = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        row = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        own[i] = min(own.get(i, row), row)
    out = []
    for a, (label, q) in own.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), i, other) for i, (other, v) in own.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fits = [(n, i) for n, i, other in scored if other != label and 80 * -s <= 100 * -n <= 100 * -s][:5]
            out += [(a, p, k, i, -s, -n) for k, (n, i) in enumerate(fits, 1)]
    return Counter(out)


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BUCKET", 8)
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(0, 3)), (rng.normal(size=5) * 0.4).tolist()) for i in range(400)]
    rows += [(400 + i, i % 2, [0.5] * 5) for i in range(120)]  # a hot vector: ties everywhere
    rows += [(600, None, [1.0] * 5), (700, 1, None), (800, 1, [1.0, None]), (900, 1, [float("nan")] * 5), (901, 2, [float("inf")] * 5), (None, 1, [1.0] * 5)]
    rows += [(1000, 1, []), (1001, 0, [0.25]), (1002, 1, [3.0] * 7), (100, 2, [9.0] * 5), (200, 0, [1.0] * 5), (200, 0, [1.0] * 5), (-300, 1, [0.3, -0.2, 0.1, 0.0, 0.4])]
    d = spark.createDataFrame(rows, VECTORS).repartition(4)
    out = hard_negatives.mine(beside(d), every=20, shard_bytes=1, leaves=8)
    assert [t for _, t in out.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    assert Counter(map(tuple, out.collect())) == brute_negatives(rows, every=20)


def test_hard_negatives_of_small_tables(spark):
    of = lambda rows: Counter(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, VECTORS)).collect()))
    assert of([]) == Counter()
    assert of([(100, 1, [1.0])]) == Counter()
    two = [(100, 1, [1.0]), (101, 1, [1.0]), (102, 2, [0.9]), (103, 2, [0.5])]
    assert of(two) == brute_negatives(two) == Counter({(100, 101, 1, 102, 65536, 58880): 1})
    large = [(100, 1, [9e5, 9e5]), (101, 1, [8e5, 9e5]), (102, 2, [8e5, 8e5]), (103, 2, [1e30, 1.0])]
    assert of(large) == brute_negatives(large[:3])


def test_far_groups_are_left_out():
    """Vectors on a half circle: an anchor needs only leaves that are near it."""
    rng = np.random.default_rng(1)
    angle = rng.uniform(0, np.pi, 800)
    x = np.stack([1000 * np.cos(angle), 1000 * np.sin(angle)], 1).astype(np.int64)
    square = float((x.astype(float) ** 2).sum(1).max())
    full = hard_negatives.augmented(x, square)
    tree, leaves = hard_negatives.fit(full, 4)
    away = hard_negatives.distances(tree.points, full)
    low, high = (np.stack([f(away[:, b], axis=1) for b in leaves], axis=1) for f in (np.min, np.max))
    q = x[:1]
    best = np.sort((x @ q[0])[1:])[-5]
    pack = hard_negatives.Pack(np.array([0]), np.array([1]), q, np.array([[-(1 << 62)]]), np.array([[1 << 62]]), np.array([[best]]))
    whole = np.concatenate([q.astype(float), np.zeros((1, 1))], 1)
    met = pack.met(*hard_negatives.Bounds(tree.points, low, high).reach(whole), square)[0]
    assert met.sum() <= len(leaves) / 2 and all(met[k] for k, b in enumerate(leaves) if (x[b] @ q[0] >= best).any())


def test_queries_have_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    columns = {name: f(spark, sf).columns for name, f in queries.queries().items() if name in ("op11_imatch", "op12_fill_middle", "op13_hard_negatives")}
    assert columns == {
        "op11_imatch": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        "op12_fill_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
        "op13_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    }
