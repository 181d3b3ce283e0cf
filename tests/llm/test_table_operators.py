import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from popweave.llm import chat_format, jaccard_join, mixing, suffix_dedup, warc

from . import fixtures as fx


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix_reaches_its_targets(spark):
    out = mixing.mix_sources(fx.documents(spark)).collect()
    assert len(out) == len(fx.rows())
    taken, target, total = Counter(), {}, 0
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = (r.target, r.source_size)
        total += r.size
    assert abs(sum(t for t, _ in target.values()) - total) < 1e-6
    for s, (t, own) in target.items():
        assert t <= 3 * own + 1e-6 and abs(taken[s] - t) <= 2
    assert Counter(map(tuple, out)) == Counter(map(tuple, mixing.mix_sources(fx.documents(spark)).collect()))
    assert mixing.mix_sources(fx.empty(spark)).count() == 0


def test_mix_with_one_source_and_without_words(spark):
    d = spark.createDataFrame([(i, "a b c", None) for i in range(5)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix_sources(d).collect()] == [3] * 5
    none = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix_sources(none).collect()] == [(0, 0.0, 0)] * 2


def test_mixed_documents_keep_columns(spark):
    out = mixing.mixed_documents(fx.documents(spark))
    assert set(fx.documents(spark).columns) <= set(out.columns) and out.where("taken <= 0").count() == 0
    assert mixing.repeat_documents(out).count() >= out.count()
    assert mixing.mixed_documents(fx.empty(spark)).count() == 0


TURNS = [
    (1, 0, "user", "hi <|im_end|>"),
    (1, 1, "assistant", "<\\|im_start|> <|x"),
    (1, 1, "assistant", "<\\|im_start|> <|x"),
    (1, 1, "ass%ist\nant", "<|"),
    (None, 0, "user", None),
    (None, None, None, "t"),
    (2, 5, "assistant", "<\\\\|end"),
    (2, 3, "system", ""),
]


def test_chat_round_trip(spark):
    t = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").repartition(3)
    out = {r["conv"]: r for r in chat_format.read_back(chat_format.format_conversations(t)).collect()}
    want = defaultdict(list)
    low = lambda x: (x is not None, x)
    for c, n, r, x in sorted(TURNS, key=lambda y: (low(y[1]), low(y[2]), low(y[3]))):
        want[c].append((r or "", x or ""))
    assert {c: [(y.role, y.text) for y in r.turns] for c, r in out.items()} == dict(want)
    for c, r in out.items():
        assert r.formatted.count("<|im_end|>\n") == len(want[c])
        spans = [r.formatted[s.start : s.end] for s in r.loss_spans]
        assert len(spans) == sum(x == "assistant" for x, _ in want[c])
        assert [y.text for y in r.turns if y.loss] == [x for role, x in want[c] if role == "assistant"]
    assert chat_format.format_conversations(t.limit(0)).count() == 0


def test_reply_trees(spark):
    nodes = [("r", None, 1.0), ("a", "r", 5.0), ("b", "r", 2.0), ("c", "b", 9.0), ("d", "b", 9.0), ("e", "d", None), ("x", "gone", 1.0), ("p", "q", 1.0), ("q", "p", 1.0)]
    n = spark.createDataFrame(nodes, "node string, parent string, score double")
    best = chat_format.branches(n)
    paths = defaultdict(list)
    for r in best.orderBy("depth").collect():
        paths[r.leaf].append(r.node)
    # Mean scores: a 3, c 4, e 3; the orphan x is a root, p and q form a cycle.
    assert dict(paths) == {"c": ["r", "b", "c"], "x": ["x"]}
    two = chat_format.branches(n, best=2)
    assert {(r.leaf, r["rank"]) for r in two.select("leaf", "rank").distinct().collect()} == {("c", 1), ("a", 2), ("x", 1)}


def test_long_threads_take_few_joins(spark):
    n = spark.range(300).selectExpr("cast(id as string) node", "cast(case when id > 0 then id - 1 end as string) parent", "1.0D score")
    out = chat_format.branches(n).collect()
    assert sorted(r.depth for r in out) == list(range(300))


def test_archives_round_trip(spark):
    big = "<p>" + "ä" * 200
    pages = [(3, "http://a b/ü", big), (1, None, big), (2, "http://x", "short"), (5, "http://x", "short"), (4, "http://y", None), (3, "http://again", big), (None, "http://n", big), (6, "http://w", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\n" + "z" * 100)]
    p = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    out = warc.convert_pages(p).collect()
    want = Counter()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h] = min(first.get(h, i), i)
    for i, _, h in pages:
        b = (h or "").encode()
        again = len(b) >= 100 and i is not None and i > first[h]
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want
    assert all(r.intact for r in out if r.record_type == "response")
    assert warc.convert_pages(p.limit(0)).count() == 0


def test_volumes_close_at_their_size(spark, tmp_path):
    pages = [(i, "http://x", chr(97 + i % 26) * 3000) for i in range(60)] + [(100, "http://y", "q" * 50_000), (101, "http://x", "d"), (101, "http://x", "d")]
    p = spark.createDataFrame([(*r, "v", "v", "v") for r in pages], "page_id long, url string, html string, volume string, value string, name string").coalesce(1)
    records = warc.stored(warc.arc_records(warc.pages_to_arc(p)), "records")
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.with_revisits(records), path, volume_bytes=20_000)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").load(path).collect()
    import gzip

    sizes = [len(gzip.decompress(bytes(f.content))) for f in files]
    assert len(sizes) > 3 and all(s < 20_000 + 60_000 for s in sizes) and sum(s > 30_000 for s in sizes) <= 1
    out = warc.read_warc(spark, path).collect()
    assert Counter(r.page_id for r in out) == Counter(i for i, *_ in pages)
    assert len({r.record_id for r in out}) == len(out)


def test_foreign_page_ids():
    assert warc.page_of(b"HTTP/1.1 200 OK\r\nX-Page-Id: abc\r\n\r\n") is None
    assert warc.page_of(b"HTTP/1.1 200 OK\r\nX-Page-Id: 12\r\n\r\n") == 12


def test_arc_versions_and_damage():
    date = "199912312359"
    for version in (1, 2):
        data = warc.arc_file("f", version, date, [("http://a", "text/plain", "200", b"one\n\ntwo"), ("http://b", "text/html", "404", b"HTTP/1.0 404 x\r\n\r\nbody")])
        r = list(warc.parse_arc(data))
        assert [x.block for x in r] == [b"one\n\ntwo", b"HTTP/1.0 404 x\r\n\r\nbody"] and not any(x.truncated for x in r)
        assert warc.iso_date(r[0].fields["Archive-date"]) == "1999-12-31T23:59:00Z"
        assert list(warc.parse_arc(data[:-6]))[-1].truncated
    old = b"filedesc://f 0.0.0.0 19990101000000 text/plain 3\n1 0\nhttp://a with space 1.1.1.1 19990101000000 text/html 2\nhi\nbroken line\n"
    assert [(x.fields["URL"], x.block) for x in warc.parse_arc(old)] == [("http://a%20with%20space", b"hi")]


def test_warc_of_a_plain_resource(spark, tmp_path):
    arc = warc.arc_file("f", 2, "20200102030405", [("dns:x", "text/dns", "200", bytes(range(256)))])
    records = warc.arc_records(spark.createDataFrame([(bytearray(arc),)], "data binary"))
    path = f"file://{tmp_path}/w"
    from popweave.llm._store import stored

    warc.write_warc(warc.with_revisits(stored(records, "records")), path)
    r = warc.read_warc(spark, path).first()
    assert (r.record_type, r.uri, r.date, r.payload_bytes, r.intact) == ("resource", "dns:x", "2020-01-02T03:04:05Z", 256, True)


def brute_removal(rows):
    seen, order, out = {}, sorted((i, t) for i, t in rows if i is not None), Counter()
    for i, t in order:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            seen[b[p : p + 50]] = min(seen.get(b[p : p + 50], i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49 if i is not None else 0):
            if seen[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out[i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeats_are_removed_exactly(spark):
    base = [(i, t) for i, t, *_ in fx.rows()]
    p, q = fx.prose(70, 30), fx.prose(71, 30)
    more = [(200, p), (201, q + " " + p), (202, (p + " ") * 4), (203, p[:49]), (204, p[5:55]), (205, "-" * 500), (206, "-" * 60), (206, q), (207, q[3:90] + p[20:110]), (7, p)]
    rows = base + more
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(d).collect())
    assert out == brute_removal(rows)
    kept = suffix_dedup.remove_repeats(d, with_text=True).collect()
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in kept)
    assert suffix_dedup.remove_repeats(d.limit(0)).count() == 0


def removal(d):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(d).collect())


def test_texts_whose_hashes_collide(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "text_hash", lambda text: F.pmod(F.xxhash64(text), F.lit(3)))
    rows = [(i, fx.prose(70 + i % 5, 30)) for i in range(12)] + [(20, fx.prose(71, 30) + fx.prose(90, 12)), (None, fx.prose(72, 30))]
    d = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, cid string, bucket string, sha string").repartition(3)
    assert removal(d) == brute_removal(rows)


def test_exchanges_in_passes_store_no_text(spark, monkeypatch):
    """Several passes remove the same, and no table that they store has a text."""
    kept = []
    store = suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, tag: kept.append((tag, df.columns)) or store(df, tag))
    monkeypatch.setattr(suffix_dedup, "IN_PASSES", 0)
    rows = [(i, fx.prose(70 + i % 7, 30) + " " + fx.prose(1000 + i // 2, 9)) for i in range(40)] + [(99, None), (None, fx.prose(72, 30))]
    assert removal(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute_removal(rows)
    assert [tag for tag, _ in kept].count("cuts") == suffix_dedup.PASSES
    assert not any("text" in columns for _, columns in kept)


def test_hot_anchors_are_judged_by_window(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    line = fx.prose(75, 20)
    rows = [(i, fx.prose(1000 + i, 8) + " " + line + " " + fx.prose(2000 + i, 8)) for i in range(40)] + [(50, (line + " ") * 5), (51, "-" * 700), (52, "-" * 300)]
    assert removal(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute_removal(rows)


def test_echoes_stay_within_their_own_windows():
    import numpy as np

    place = np.array([100, 100, 300], np.uint32)
    window = np.array([[0, 9], [10, 34], [0, 9]], np.uint8)
    mask = np.array([0b1, 1 << 20, 0], np.uint64)
    mask[2] = suffix_dedup._echo(place[:1], window[2:])[0]
    assert suffix_dedup.resolved(place, mask).tolist() == [1, 1 << 20, 1]


def test_suffix_sort_is_the_order_of_bytes():
    import numpy as np

    r = np.random.default_rng(3)
    cut = r.integers(97, 99, (400, suffix_dedup.WIDTH), dtype=np.uint8)
    window = np.tile(np.array([[0, 34]], np.uint8), (400, 1))
    window[::3, 0] = 20
    c = suffix_dedup.Cuts(cut, window)
    order = c.sort(np.arange(400), np.array([0, 150]), np.array([150, 250]))
    text = [cut[i, suffix_dedup.REACH : suffix_dedup.REACH + c.right[i]].tobytes() for i in range(400)]
    for part in (order[:150], order[150:]):
        assert [text[i] for i in part] == sorted(text[i] for i in part)


def brute_classes(rows):
    sets = {}
    for n, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[n] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    link = {n: {m for m in sets if m != n and sets[m] is not None and s is not None and 5 * len(s & sets[m]) >= 4 * len(s | sets[m])} for n, s in sets.items()}
    label = {n: n for n in sets}
    changed = True
    while changed:
        changed = False
        for n in sets:
            best = min([label[n], *(label[m] for m in link[n])])
            changed |= best != label[n]
            label[n] = best
    out = []
    for n, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in sets if label[m] == label[n] and rows[m][0] is not None]
        out.append((i, min(ids) if ids and sets[n] is not None else i, len({sets[m] for m in link[n]} - {sets[n]}), len(link[n])))
    return Counter(out)


def test_every_link_is_found(spark):
    base = [(i, t) for i, t, *_ in fx.rows()]
    root = fx.prose(80, 150)
    base += [(500, fx.edit(fx.rows()[14][1], 3, 200))]
    near = [(300 + k, fx.edit(root, k, 75 if k % 2 else 40)) for k in range(40)]
    rows = base + near + [(400, root), (400, root)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = Counter((r.doc_id, r.class_id, r.n_links, r.n_linked_docs) for r in jaccard_join.join_documents(d).collect())
    assert out == brute_classes(rows)
    assert jaccard_join.join_documents(d.limit(0)).count() == 0


def test_large_leaves_split_and_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", 8)
    root = fx.prose(81, 150)
    rows = [(k, fx.edit(root, k, 75)) for k in range(45)] + [(100 + k, fx.prose(k, 50)) for k in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = Counter((r.doc_id, r.class_id, r.n_links, r.n_linked_docs) for r in jaccard_join.join_documents(d).collect())
    assert out == brute_classes(rows)


def test_one_document_of_each_group_stays(spark):
    d = fx.documents(spark)
    out = jaccard_join.one_of_each(d)
    assert out.columns == d.columns
    rows = [(i, t) for i, t, *_ in fx.rows()]
    stays = {c if i is not None else i for i, c, *_ in brute_classes(rows)}
    assert Counter(r.doc_id for r in out.collect()) == Counter(stays)
    assert jaccard_join.one_of_each(fx.empty(spark)).count() == 0


def test_one_of_each_with_clashing_columns(spark):
    names = ["kept_id", "kept_cid", "single", "component", "key", "cid", "label", "n_copies", "sig", "tag", "node"]
    text = fx.prose(90, 40)
    rows = [(i, t, *["v"] * len(names)) for i, t in ((1, text), (2, text), (2, text), (3, None), (3, None), (None, "one two"))]
    d = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = jaccard_join.one_of_each(d)
    assert out.columns == d.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({1: 1, 3: 2, None: 1})
    once = jaccard_join.one_of_each(d.where("doc_id = 2"))
    assert once.columns == d.columns and once.count() == 1


def test_runs_follow_the_recall():
    assert jaccard_join.runs_needed(0.9999) < jaccard_join.runs_needed(0.99999)


def test_runs_and_coordinates_miss_as_seldom_as_stated():
    """Simulated worst case: every node splits, so a pair must agree on a path of DEPTH picks."""
    import numpy as np

    j, rng, pairs = jaccard_join, np.random.default_rng(5), 200_000
    runs, n = j.runs_needed(0.999), j.runs_needed(0.999) * sum(j.PICKS)
    equal = rng.random((pairs, n)) < 0.8
    hit = np.zeros(pairs, bool)
    for r, two in enumerate(j.root_flags(runs)):
        at = equal[:, r * sum(j.PICKS) : (r + 1) * sum(j.PICKS)]
        for root in range(1 + two):
            inside, k = at[:, root], np.arange(pairs)
            for level in (1, 2):
                low = sum(j.PICKS[:level])
                one = rng.integers(0, 3, pairs)
                other = (one + 1 + rng.integers(0, 2, pairs)) % 3
                again = rng.random(pairs) < 0.25
                inside = inside & (at[k, low + one] | (again & at[k, low + other]))
            hit |= inside
    found = hit & (equal.sum(1) >= j.least_equal(n, 0.999))
    assert 1 - found.mean() < 0.001


def test_page_ids_are_whole_longs(spark):
    ids = [-(1 << 63), -(10**18), -1, 0, 1, 10**18, 1234567890123456789, (1 << 63) - 1, None]
    rows = [(i, "http://a", f"page {n % 3} " + "x" * 200) for n, i in enumerate(ids)]
    out = warc.convert_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html] = min(i, first.get(html, i))
    want = Counter((i, "revisit" if i is not None and i != first[h] else "response", first[h] if i is not None and i != first[h] else None) for i, _, h in rows)
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in out) == want
    assert [warc.whole_long(x) for x in ("9223372036854775807", "9223372036854775808", "-9223372036854775809", "1" * 5000, "x", "", None)] == [(1 << 63) - 1] + [None] * 6


def test_malformed_headers_are_survived():
    record = lambda length, block=b"abc": b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: " + length + b"\r\n\r\n" + block + b"\r\n\r\n"
    good = record(b"3")
    for bad in (b"x", b"-33", b"", b"\xb2", b"3.0", b"9" * 5000):
        found = list(warc.parse_warc(good + record(bad) + good))
        assert [(block, cut) for _, block, cut in found] == [(b"abc", False), (b"abc", True), (b"abc", False)], bad
    assert [(b, c) for _, b, c in warc.parse_warc(good + record(b"30"))] == [(b"abc", False), (b"abc\r\n\r\n", True)]
    line = b"http://a 0.0.0.0 20240101000000 text/plain 3\nabc\n"
    for bad in (b"abc", b"1 0 x\nURL Archive-length", b"\xb2 x\nq", b"2"):
        head = b"filedesc://f 0.0.0.0 2024 text/plain " + str(len(bad)).encode() + b"\n" + bad + b"\n"
        assert all(r.block == b"abc" for r in warc.parse_arc(head + line))
    assert [r.block for r in warc.parse_arc("http://a 0.0.0.0 2024 text/plain ²\n".encode() + line)] == [b"abc"]
    assert warc.iso_date("20249999999999") == "1970-01-01T00:00:00Z" and warc.iso_date("") == "1970-01-01T00:00:00Z"


def test_damaged_archives_are_read_to_their_end(spark, tmp_path):
    import gzip
    import random
    import zlib

    r = random.Random(4)
    entries = [(f"http://a/{k}", "text/html", "200", b"HTTP/1.1 200 OK\r\nX-Page-Id: %d\r\n\r\n" % k + b"<p>" * r.randint(0, 60)) for k in range(12)]
    records = "".join(f"WARC/1.1\r\nWARC-Type: revisit\r\nX-Payload-Length: {k}\r\nX-Refers-To-Page-Id: {k}\r\nContent-Length: 7\r\n\r\npayload\r\n\r\n" for k in range(12)).encode()
    arcs, warcs = [], []
    for n in range(300):
        both = [bytearray(warc.arc_file("n", 1 + n % 2, "20240101000000", entries)), bytearray(records)]
        for data, out in zip(both, (arcs, warcs), strict=True):
            for _ in range(r.randint(1, 12)):
                at = r.randrange(len(data))
                data[at : at + r.randint(0, 3)] = bytes(r.choice([r.randrange(256), 45, 57, 10, 13, 32]) for _ in range(r.randint(0, 4)))
            out.append(bytes(data))
    assert all(len(list(warc.parse_arc(a))) <= len(a) for a in arcs) and all(len(list(warc.parse_warc(w))) <= len(w) for w in warcs)
    packed = gzip.compress(records)
    assert warc.unzipped(packed + packed) == records * 2 and warc.unzipped(records) == records
    assert records.startswith(warc.unzipped(packed[: len(packed) // 2]))
    damaged = packed[:60] + b"\x00\xff\x00" + packed[63:]
    warc.unzipped(damaged), warc.unzipped(packed + b"junk"), warc.unzipped(b"\x1f\x8b")
    assert warc.unzipped(zlib.compress(b"x")) == zlib.compress(b"x")
    d = spark.createDataFrame([(a,) for a in arcs], "data binary").repartition(4)
    assert warc.arc_records(d).count() > 0
    for k, w in enumerate([*warcs, packed[:-9], damaged]):
        (tmp_path / f"{k}.txt").write_bytes(w)
    assert warc.read_warc(spark, str(tmp_path)).count() > 0
