import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from popweave.llm import decontaminate, pii, quality_model, quality_rules, token_lengths
from popweave.llm._words import words

from . import fixtures as fx

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 16 <= len(d) <= 19 and pii.luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()  # noqa: B023
            if ok:
                out.append((kind, *m.span()))
    return out


def test_words_of_any_layout():
    r = random.Random(1)
    texts = ["".join(r.choice("ab \n\tä") for _ in range(r.randint(0, 40))).encode() for _ in range(300)] + [b"long " * 300_000]
    w = words(texts)
    for i, t in enumerate(texts):
        s = w.of(i)
        assert [t[a:b] for a, b in zip(w.start[s], w.end[s], strict=True)] == re.findall(rb"[^\x20\x09-\x0D]+", t)
    same = {}
    for i, t in enumerate(texts[:300]):
        s = w.of(i)
        for a, b, h in zip(w.start[s], w.end[s], w.hashes[s], strict=True):
            assert same.setdefault(t[a:b], h) == h
    assert len(set(same.values())) == len(same)


def test_base_spans_are_the_rules():
    r = random.Random(2)
    for _ in range(20000):
        t = "".join(r.choice("ab1.@2 -+(95é\n") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t)[0] == brute_spans(t)


def test_endless_runs_are_linear():
    for t in ("1" * 400_000, "a" * 400_000, "1." * 200_000, "+1 " * 100_000, "a@" * 200_000):
        pii.base_spans(t)


def test_pii_of_awkward_rows(spark):
    out = {(r.doc_id, r.base_sha256): r for r in pii.find_pii(fx.documents(spark)).collect()}
    assert len(fx.rows()) == pii.find_pii(fx.documents(spark)).count()
    for i, text, *_ in fx.rows():
        want = pii.join(brute_spans(text or ""))
        r = out[i, hashlib.sha256(want.encode()).hexdigest()]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    assert pii.find_pii(fx.empty(spark)).count() == 0


def planted(r, i):
    """(text before, span, text after, kind): personal data beyond the base rules, in common surroundings."""
    given, family = r.choice(["Anna", "Peter", "Maria", "Hans", "Claire", "Carlos"]), r.choice(["Smith", "Weber", "Garcia", "Martin", "Novak"])
    token = "".join(r.choice("0123456789abcdef") for _ in range(40))
    account = "DE00" + "".join(r.choice("0123456789") for _ in range(18))
    check = 98 - int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97
    account = f"DE{check:02d}" + account[4:]
    cases = [
        ("contact ", f"{given} {family}", " now", "name"),
        (r.choice(["Dr. ", "Mrs ", "Herr "]), f"{given} {family}", ", who", "name"),
        ("she lives at ", f"{r.randint(1, 99)} {r.choice(['Oak', 'High', 'Mill'])} Street", ", 10115 town", "address"),
        ("wohnt in der ", f"{r.choice(['Garten', 'Linden'])}straße {r.randint(1, 99)}".capitalize(), " seit", "address"),
        ("iban ", account, " bank", "iban"),
        ("born ", f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1940, 2005)}", " in", "birth"),
        ("date of birth: ", f"{r.randint(1940, 2005)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", "", "birth"),
        ('token = "', token, '" of', "secret"),
        ("password: ", f"xK{r.randint(1000, 9999)}qZ{r.randint(10, 99)}w", " and", "secret"),
        ("write to ", f"{given.lower()}(at)example.org", " please", "email"),
        ("call ", f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}", " today", "phone"),
    ]
    return cases[i % len(cases)]


def harmless(r, i):
    sha = "".join(r.choice("0123456789abcdef") for _ in range(40))
    return [f"commit {sha} merged", "the Old Town of", f"on {r.randint(1, 28):02d}.{r.randint(1, 12):02d}.2023 we met", "the secret garden", f"order {r.randint(10**13, 10**14)} sent", "In Der Stadt", f"page {r.randint(1, 99)} of chapter", "version 1.2.3"][i % 8]


def test_weak_supervision_finds_planted_spans_and_leaves_clean_texts(spark):
    r = random.Random(7)
    rows, want = [], {}
    for i in range(660):
        before, span, after, kind = planted(r, i)
        left = fx.prose(i, 20) + " " + before
        rows.append((i, left + span + after + " " + fx.prose(5000 + i, 20)))
        want[i] = f"{kind}:{len(left)}:{len(left) + len(span)}"
    clean = [(10_000 + i, fx.prose(20_000 + i, 20) + " " + harmless(r, i) + " " + fx.prose(30_000 + i, 20)) for i in range(400)]
    out = {x.doc_id: x.spans for x in pii.find_pii(spark.createDataFrame(rows + clean, "doc_id long, text string").repartition(3)).collect()}
    found = [want[i] in out[i].split(",") for i in want]
    by_kind = Counter(want[i].split(":")[0] for i, f in zip(want, found, strict=True) if not f)
    assert sum(found) >= 0.9 * len(found), by_kind
    extra = sum(len(set(out[i].split(",")) - {want[i], ""}) for i in want)
    assert sum(found) >= 0.95 * (sum(found) + extra)
    assert sum(out[i] == "" for i, _ in clean) >= 0.95 * len(clean)


def test_candidates_are_linear_in_endless_runs():
    for t in ("A" * 300_000, "Ab " * 100_000, "key=" * 75_000, "AB12 " * 60_000, "1.1." * 75_000, "12-" * 100_000, "a/" * 150_000):
        base, near = pii.base_spans(t)
        spans = pii.candidates(t, base, near)
        assert all(x[2] <= y[1] for x, y in zip(spans, spans[1:], strict=False))


def test_labelers_and_masks(spark):
    assert pii.valid_iban("DE89 3704 0044 0532 0130 00") and not pii.valid_iban("DE88370400440532013000")
    assert pii.valid_date("31.12.1999") and pii.valid_date("1999-02-28") and not pii.valid_date("32.13.1999")
    rows = [("phone", "11-11-", 500, pii.features("call (826) 555-4081", ("phone", 5, 19), "11-11-")), ("card", "00--11", 100, pii.features("x 1111222233334444", ("card", 2, 18), "00--11"))]
    m = pii.fit(rows)
    text = "call (826) 555-4081 now, +1 (555) 010-2030"
    assert pii.mask_text(text, m) == "call [PHONE] now, [PHONE]"
    assert m.score(rows[1][3]) < 0.5
    assert pii.fit([]).score([1, 2]) == 0.5


def test_masking_keeps_other_columns(spark):
    out = pii.masked(fx.documents(spark))
    assert out.columns == fx.documents(spark).columns and out.count() == len(fx.rows())
    assert not any("example.com" in (r.text or "") for r in out.collect())
    assert pii.masked(fx.empty(spark)).count() == 0


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark):
    out = quality_rules.quality_verdicts(fx.documents(spark), fx.labels(spark)).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == Counter((i, *brute_counts(t or "")) for i, t, *_ in fx.rows())
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = quality_rules.good_documents(fx.documents(spark), fx.labels(spark))
    assert kept.columns == fx.documents(spark).columns and kept.count() == sum(r.kept for r in out)
    assert quality_rules.quality_verdicts(fx.empty(spark), fx.labels(spark)).count() == 0
    assert quality_rules.quality_verdicts(fx.documents(spark), fx.labels(spark).limit(0)).count() == len(fx.rows())


def test_cutoffs_are_safe(spark):
    good = [(i, fx.prose(i, 60), "en") for i in range(1200)]
    bad = [(5000 + i, " ".join(x + "##" for x in fx.prose(i, 60).split()), "en") for i in range(200)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad], "doc_id long, quality int")
    out = {r.doc_id: r.kept for r in quality_rules.quality_verdicts(docs, labels).collect()}
    assert not any(out[i] for i, *_ in bad) and all(out[i] for i, *_ in good)
    # Good documents that one rule or another would reject: together more than the guarantee allows, so no step is safe.
    odd = [(i, " ".join(x + ("#" if i % 2 else "") for x in fx.prose(i, 60).split()) if i < 24 else t, g) for i, t, g in good]
    mixed = spark.createDataFrame([(i, t if i % 2 else (t.split(" ")[0] * 9 + " ") * 3 + t if i < 24 else t, g) for i, t, g in odd] + bad, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality_rules.quality_verdicts(mixed, labels).collect()}
    assert sum(not kept[i] for i, *_ in good) <= 0.0125 * len(good)
    few = labels.where("doc_id < 20 or doc_id >= 5000")
    assert all(r.kept for r in quality_rules.quality_verdicts(docs, few).collect() if not r.base_failed)


def test_the_guarantee_holds_for_an_order_that_depends_on_the_fitting_part():
    """Kinds of documents with known shares: in 200 draws of labels the chosen step's true rate of
    false rejections exceeds the bound at most as often as the level says. Some kinds are
    rejected so often that a lucky order would take them in."""
    q, rng, most, error = quality_rules, np.random.default_rng(12), 0.0125, 0.05
    n_kinds = 1 + len(q.PAIRS)
    rejects = np.zeros((n_kinds, len(q.PAIRS)), bool)
    at = 0
    for _, _, cuts in q.RULES.values():
        for i in range(len(cuts)):
            rejects[1 + at + i, at + i : at + len(cuts)] = True  # rejected from cutoff i on
        at += len(cuts)
    share = np.concatenate([[0.0], rng.choice([0.0, 0.0005, 0.003, 0.02], len(q.PAIRS))])
    share[0] = 1 - share.sum()
    bad = np.concatenate([[0.1], rng.random(len(q.PAIRS))])
    orders, over, used = set(), 0, 0
    for _ in range(200):
        fitting, certifying = rng.multinomial(300, share), rng.multinomial(900, share)
        order = q.ordered_pairs(rejects, fitting)
        chosen = q.certified(rejects, order, certifying, rng.multinomial(200, bad / bad.sum()), most, error)
        orders.add(tuple(order))
        over += float(share[rejects[:, chosen].any(axis=1)].sum()) > most if chosen else 0
        used += bool(chosen)
        for rule in q.RULES:  # steps only get stricter
            mine = [i for r, i in (q.PAIRS[p] for p in order) if r == rule]
            assert mine == sorted(mine)
    assert len(orders) > 20 and used > 100 and over <= error * 200


def test_repeats_of_one_long_text():
    words = [b"w%d" % (k % 70_000) for k in range(300_000)]
    assert quality_rules.repeat_words(iter(words)) == 300_000
    assert quality_rules.repeat_words(iter(words[:70_000])) == 0
    assert quality_rules.repeat_words(iter(words[:70_005])) == 10
    assert quality_rules.repeat_words(iter([b"a"] * 5)) == 0 and quality_rules.repeat_words(iter([b"a"] * 6)) == 6


def test_binomial_bound():
    assert abs(quality_rules.binomial_cdf(0, 100, 0.01) - 0.99**100) < 1e-12
    assert abs(quality_rules.binomial_cdf(7, 7, 0.3) - 1) < 1e-12
    for k, n, p in ((3, 50, 0.1), (12, 1000, 0.0125), (30, 1000, 0.0125)):
        assert quality_rules.binomial_cdf(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_token_histogram(spark):
    import tiktoken

    e = tiktoken.Encoding("t", pat_str=token_lengths.PATTERN, mergeable_ranks=token_lengths.load_vocabulary(token_lengths.VOCABULARY), special_tokens={})
    n = sorted(len(e.encode_ordinary(t or "")) for _, t, *_ in fx.rows())
    hist = token_lengths.length_histogram(fx.documents(spark))
    for r in hist.collect():
        assert r.n_docs == n.count(r.n_tokens)
        assert r.docs_at_least == sum(x >= r.n_tokens for x in n)
        assert r.tokens_at_least == sum(x for x in n if x >= r.n_tokens)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in n)
        assert r.docs_cut == sum(x > r.n_tokens for x in n)
    asked = [0, 17, 17, 1023, 1024, 5000, 40_000, n[-1] - 1, n[-1], 10**6]
    limits = spark.createDataFrame([(c,) for c in [*asked, None]], "context_limit long")
    got = Counter((r.context_limit, r.truncated_tokens, r.docs_cut) for r in token_lengths.totals_at(hist, limits).collect())
    assert got == Counter((c, sum(min(x, c) for x in n), sum(x > c for x in n)) for c in asked)
    assert [(r.truncated_tokens, r.docs_cut) for r in token_lengths.totals_at(hist.limit(0), limits.where("context_limit = 17")).collect()] == [(0, 0)] * 2
    assert token_lengths.length_quantile(hist, 0.5) == n[(len(n) + 1) // 2 - 1]
    assert token_lengths.length_histogram(fx.empty(spark)).count() == 0


def test_long_texts_are_cut_where_no_token_crosses():
    text = fx.prose(5, 120_000)
    assert "".join(token_lengths.pieces(text)) == text and len(list(token_lengths.pieces(text))) > 1
    assert list(token_lengths.pieces("")) == [""]


def test_cuts_change_no_count(monkeypatch):
    import tiktoken

    e = tiktoken.Encoding("t", pat_str=token_lengths.PATTERN, mergeable_ranks=token_lengths.load_vocabulary(token_lengths.VOCABULARY), special_tokens={})
    monkeypatch.setattr(token_lengths, "PIECE", 7)
    r = random.Random(4)
    for _ in range(2000):
        t = "".join(r.choice("abZ09 \n\t'sä.é!  ") for _ in range(r.randint(0, 80)))
        parts = list(token_lengths.pieces(t))
        assert "".join(parts) == t and sum(len(e.encode_ordinary(p)) for p in parts) == len(e.encode_ordinary(t))


def test_quality_model_without_hand_labels(spark):
    stop = "the of and to in is that for it was".split()
    good = [(i, " ".join(w if j % 3 else stop[(i + j) % 10] for j, w in enumerate(fx.prose(i, 80).split()))) for i in range(300)]
    bad = [(1000 + i, " ".join(x + "###" for x in fx.prose(i, 80).split())) for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    out = {r.doc_id: r for r in quality_model.classify(docs, sample=200).collect()}
    assert sum(out[i].good for i, _ in good) >= 290 and sum(out[i].good for i, _ in bad) <= 3
    odd = quality_model.classify(fx.documents(spark))
    assert odd.count() == len(fx.rows()) and all(0 <= r.score <= 1 for r in odd.collect())
    assert quality_model.classify(fx.empty(spark)).count() == 0


def brute_votes(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars, symbols, dups, repeats = brute_counts(text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    m, some = max(n, 1), n >= 10
    dup = dups / len(lines) if dups else 0
    stop = sum(x in quality_model.STOPWORDS for x in w) / m
    say = lambda bad, good: "0" if bad else "1" if good else "-"
    mean, loud = chars / m, text.count("!!") / m
    return (
        say(some and symbols / m > 0.1, some and symbols / m < 0.01)
        + say(some and dup > 0.3, some and dup < 0.05)
        + say(some and repeats / m > 0.2, some and repeats / m < 0.02)
        + say(some and (mean > 6.4 or mean < 3), some and 3.8 < mean < 5.8)
        + say(some and stop < 0.08, some and stop > 0.2)
        + say(n == 0, n >= 50)
        + say(some and loud > 0.2, some and loud < 0.01)
    )


def brute_label_model(votes, rounds=60):
    """The label model, document by document."""
    q = [0.9 if v.count("0") < 2 else 0.1 for v in votes]
    for _ in range(rounds):
        prior = (sum(q) + 1) / (len(q) + 2)
        rate = {}
        for j in range(7):
            for c, pseudo in ((0, (8, 2)), (1, (2, 8))):
                w = [x if c else 1 - x for x in q]
                n = [pseudo[k] + sum(a for a, v in zip(w, votes, strict=True) if v[j] == "01"[k]) for k in (0, 1)]
                rate[j, c] = [x / sum(n) for x in n]
        new = []
        for v in votes:
            odds = [1 - prior, prior]
            for j, x in enumerate(v):
                if x != "-":
                    odds = [odds[c] * rate[j, c][int(x)] for c in (0, 1)]
            new.append(odds[1] / sum(odds))
        q = new
    return q


def brute_vector(text):
    out = Counter()
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", text.encode()):
        word = m.group()
        out[int(words([word]).hashes[0]) % quality_model.DIMENSIONS] += 1
        shape = re.sub(rb"[0-9]", b"0", re.sub(rb"[A-Z]", b"A", re.sub(rb"[a-z\x80-\xff]", b"a", word)))
        tail = 0
        for k in (3, 2, 1):
            tail = tail * 256 + shape[max(len(word) - k, 0)]
        tail = tail * 16 + min(len(word), 15)
        out[int(quality_model.mix(np.array([tail], np.uint64))[0]) % quality_model.DIMENSIONS] += 1
    norm = sum(x * x for x in out.values()) ** 0.5 or 1.0
    return {k: x / norm for k, x in out.items()}


def brute_scores(texts, weak, rounds=400):
    x = [brute_vector(t) for t in texts]
    w, step, bias, bias_step = Counter(), Counter(), 0.0, 0.0
    z = [0.0] * len(x)
    for _ in range(rounds):
        g = [(1 / (1 + math.exp(-a)) - y) / len(x) for a, y in zip(z, weak, strict=True)]
        grad = Counter({k: 2e-5 * v for k, v in w.items()})
        for v, a in zip(x, g, strict=True):
            for k, b in v.items():
                grad[k] += a * b
        for k in set(step) | set(grad):
            step[k] = 0.9 * step[k] - 4.0 * grad[k]
            w[k] += step[k]
        bias_step = 0.9 * bias_step - 4.0 * sum(g)
        bias += bias_step
        z = [bias + sum(w[k] * b for k, b in v.items()) for v in x]
    return [1 / (1 + math.exp(-a)) for a in z]


def test_quality_model_against_brute_force(spark):
    """All documents are in the sample here, so every number can be computed document by document."""
    stop = "the of and to in is that".split()
    docs = [(i, " ".join(w if j % 3 else stop[(i + j) % 7] for j, w in enumerate(fx.prose(i, 30 + i % 40).split()))) for i in range(40)]
    docs += [(100 + i, " ".join(x + "##" for x in fx.prose(i, 40).split())) for i in range(12)] + [(200, "short one"), (201, ""), (202, "WOW!! " * 30), (203, "same line\n" * 9)]
    ids, texts = zip(*docs, strict=True)
    votes = [brute_votes(t) for t in texts]
    weak = brute_label_model(votes)
    scores = dict(zip(ids, brute_scores(texts, weak), strict=True))
    out = {r.doc_id: r for r in quality_model.classify(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert {i: out[i].votes for i in ids} == dict(zip(ids, votes, strict=True))
    for i, y in zip(ids, weak, strict=True):
        assert out[i].weak_label == pytest.approx(y, abs=1e-6)
        assert out[i].score == pytest.approx(scores[i], abs=0.01) and out[i].good == (out[i].score >= 0.5)


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_hits(docs, items, width=10):
    grams = {}
    for k, t in items:
        w = item_words(t)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n and k is not None else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(str(k))
    sizes = {len(g) for g in grams}
    out = []
    for i, t in docs:
        w = item_words(t)
        hit, found = set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (own := grams.get(tuple(w[j : j + n]))) is not None:
                    hit |= set(range(j, j + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_contamination(spark, block):
    passage = fx.prose(50, 30)
    items = [(1, passage), (12, "Short, one!"), (3, None), (4, "..."), (None, passage), (5, passage.upper()), (6, fx.prose(51, 25))]
    docs = [(i, t) for i, t, *_ in fx.rows()] + [(100, "a " + passage + " b"), (101, " ".join(passage.split()[3:14])), (102, "short? ONE short one"), (103, (passage + " ") * 3), (103, (passage + " ") * 3), (104, fx.prose(51, 25))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    m = decontaminate.find_matches(d, b, block_bytes=block)
    hits = Counter((r.doc_id, r.n_words, sum(y - x for x, y in r.hits), len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest(), bool(r.hits)) for r in m.collect())
    assert hits == brute_hits(docs, items)
    assert Counter(map(tuple, decontaminate.contamination(d, b).collect())) == brute_hits(docs, items)
    clean = decontaminate.clean_documents(d, b)
    assert clean.count() == sum(not x[-1] for x in brute_hits(docs, items).elements())
    assert decontaminate.contamination(d, b.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(d.limit(0), b).count() == 0


def test_proximity(spark):
    docs = [(1, "one x two y three z four"), (2, "four three two one"), (3, "one two " + "q " * 30 + "three four"), (4, "a b c one two"), (5, "three four d e f"), (6, "x " * 9 + "two three four one")]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame([(7, "one two three four")], "item_id long, text string")
    near = {r.doc_id: (list(r["items"]), [list(x) for x in r.hits]) for r in decontaminate.find_matches(d, b, slop=3).collect()}
    assert near == {1: (["7"], [[0, 7]]), 2: (["7"], [[0, 4]]), 3: ([], []), 4: ([], []), 5: ([], []), 6: (["7"], [[9, 13]])}
    wide = {r.doc_id: list(r["items"]) for r in decontaminate.find_matches(d, b, slop=5).collect()}
    assert not wide[4] and not wide[5]


def brute_near(text, phrase, slop):
    """Words of shortest stretches that have the phrase's words."""
    w, need = text.split(), Counter(phrase.split())
    covers = [(i, j) for i in range(len(w)) for j in range(i + 1, min(len(w), i + need.total() + slop) + 1) if not need - Counter(w[i:j])]
    least = [(i, j) for i, j in covers if not any(i <= x and y <= j and (x, y) != (i, j) for x, y in covers)]
    return {k for i, j in least for k in range(i, j)}


@pytest.mark.parametrize("slop", [1, 3, 6])
def test_proximity_against_brute_force(spark, slop):
    r = random.Random(slop)
    text = lambda n: " ".join(r.choice("abcdefgh") for _ in range(n))
    docs = [(i, text(r.randint(0, 40))) for i in range(120)]
    items = [(1, "a b c d e"), (2, "a a b"), (3, "h g f e d c b a a b"), (4, "c")]
    found = decontaminate.find_matches(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2), spark.createDataFrame(items, "item_id long, text string"), slop=slop)
    got = {x.doc_id: ({k for a, b in x.hits for k in range(a, b)}, list(x["items"])) for x in found.collect()}
    for i, t in docs:
        hits = {str(k): brute_near(t, p, slop) for k, p in items}
        assert got[i] == (set().union(*hits.values()), sorted(k for k, h in hits.items() if h))


def test_clean_documents_with_clashing_columns(spark):
    passage = fx.prose(50, 30)
    names = ["dirty_id", "dirty_cid", "_dirty_id", "hits", "items", "key", "id", "cid", "n_words"]
    d = spark.createDataFrame([(1, passage, *["v"] * len(names)), (2, "clean text", *["v"] * len(names)), (None, None, *["v"] * len(names))], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = decontaminate.clean_documents(d, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert out.columns == d.columns and {r.doc_id for r in out.collect()} == {2, None}
