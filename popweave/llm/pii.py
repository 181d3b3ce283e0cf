"""Personal data found by rules and by weak supervision.

Base spans come from four exact rules (e-mail, IPv4, card, phone) and always
stay. Further candidates (written-out e-mails, national phone numbers, IPv6,
card-like numbers, names, street addresses, IBANs, dates of birth, secrets) and
the base spans themselves get votes from labelers: format rules and checksums,
gazetteers, words before that speak for or against, borders and layout. Votes are
1 (personal), 0 (not) or - (abstains). Expectation-maximisation over all votes of
the corpus estimates each labeler's reliability for each kind. A logistic span
classifier is then trained on the posteriors; it sees the votes, and hashed shapes
of the span and words around it. Candidates that it accepts, and that the posterior
of their votes doesn't speak against, are added.

What leaves the executors is a count and one span's features for each distinct
(kind, votes, one of SUBSAMPLES hash classes): at most 9 * 3**6 * SUBSAMPLES rows,
whatever the corpus. Counts cover all documents; the classifier is fitted on that
bounded sample, each row weighing the root of its count.

Defined results
* null or empty text: no spans, and digests of the empty string.
* spans of one kind don't overlap; added spans don't overlap any base span or each
  other: of two candidates the one that begins first stays, of ties the longer one.
* repeated rows and null ids are treated row by row; an empty table gives none.
* all scans are linear in the text, also for endless runs of digits or letters;
  texts are read whole.
* further columns are ignored, and kept by :func:`masked` whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.llm._store import scoped, stored
from popweave.llm._words import slices

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method adds; spans are listed in this order.
ADDED = ("name", "address", "iban", "birth", "secret")
ORDER = {k: i for i, k in enumerate(KINDS + ADDED)}
SUBSAMPLES = 16
DIMENSIONS = 1 << 14
THRESHOLD = 0.8
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DIGIT = re.compile(r"[0-9]")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]{1,63}){1,6}")
NATIONAL = re.compile(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}")
IPV6 = re.compile(r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}")

UPPER, LOWER = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
FORMS = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señora?|Sra?|Monsieur|Madame|Mme)"
PART = rf"(?!{FORMS}(?!\w))[{UPPER}][{LOWER}]{{1,24}}"
NAME = re.compile(rf"(?<!\w){PART}(?:\x20{PART}){{1,2}}(?!\w)")
ADDRESS = re.compile(
    rf"(?<!\w)[0-9]{{1,5}}[a-z]?,?\x20(?:[{UPPER}][{LOWER}]{{1,24}}\x20){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Way)(?!\w)"
    rf"|(?<!\w)[{UPPER}][{LOWER}]{{1,24}}(?:straße|strasse|weg|platz|allee|gasse)\x20[0-9]{{1,4}}[a-z]?(?!\w)"
    rf"|(?<!\w)[0-9]{{1,4}},?\x20(?:rue|avenue|boulevard|place|chemin|impasse)\x20(?:d[eu]s?\x20|de\x20la\x20|la\x20)?[{UPPER}][{LOWER}]{{1,24}}"
    rf"|(?<!\w)(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo)\x20(?:de\x20|del\x20)?[{UPPER}][{LOWER}]{{1,24}},?\x20[0-9]{{1,4}}(?!\w)"
)
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Words that every address has one of; texts without any aren't searched.
STREETS = ("Street", "St", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Boulevard", "Blvd", "Court", "Square", "Way", "straße", "strasse", "weg", "platz", "allee", "gasse")
STREETS += ("rue", "avenue", "boulevard", "place", "chemin", "impasse", "alle", "venida", "laza", "aseo")
NUMBERS = re.compile(r"[0-9]++(?:[./-][0-9]++)++")
DATE = re.compile(r"[0-9]{1,2}([./-])[0-9]{1,2}\1[12][0-9]{3}|[12][0-9]{3}-[0-9]{2}-[0-9]{2}")
ASSIGNED = re.compile(r"""[:=]\s{0,3}["']?([A-Za-z0-9+/_.~=-]{8,256})""")
BARE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+")

# Common top-level domains, country codes of accounts, and given names.
TOP_DOMAINS = frozenset("com org net edu gov int io co uk de fr es it nl eu info biz us ca au jp ch at be se no dk fi pl pt ru cn in br mx ar cl".split())
IBAN_COUNTRIES = frozenset("AD AE AL AT BA BE BG BH BR CH CY CZ DE DK EE ES FI FR GB GE GI GR HR HU IE IL IS IT KW KZ LB LI LT LU LV MC MD ME MK MT NL NO PK PL PT QA RO RS SA SE SI SK SM TN TR UA".split())
GIVEN_NAMES = frozenset(
    "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah "
    "charles karen daniel lisa matthew nancy anthony betty mark sandra paul ashley steven emily andrew kimberly peter anna alice emma "
    "hans klaus jürgen wolfgang stefan andreas sabine monika ursula petra heike julia katharina lukas felix maria jose josé carmen juan "
    "carlos lucia lucía antonio manuel pedro pablo elena isabel jean pierre michel marie nathalie isabelle sophie camille louis claire "
    "françois philippe luc hélène".split()
)
# Forms of address, cue words for and against, in the corpus's languages.
TITLE = re.compile(rf"\b{FORMS}\.?\x20$")
CUES = {
    "email": re.compile(r"(?i)e-?mail|correo|courriel|contact|kontakt|mailto|write to"),
    "ip": re.compile(r"(?i)\bip\b|ipv[46]|address|adresse|dirección|host|server|client|login"),
    "card": re.compile(r"(?i)card|karte|tarjeta|carte|visa|mastercard|amex|payment"),
    "phone": re.compile(r"(?i)phone|tel\b|tel[.:]|call|fax|mobile|handy|teléfono|téléphone|telefon"),
    "name": re.compile(r"(?i)\bname|\bcontact|signed|regards|sincerely|heiße|llamo|m'appelle|\bnom\b|nombre|patient|customer|employee"),
    "address": re.compile(r"(?i)address|adresse|dirección|\blives?\b|wohnt|wohnhaft|habite|vive|residen|ship to|mail to"),
    "iban": re.compile(r"(?i)iban|account|konto|cuenta|compte|bank"),
    "birth": re.compile(r"(?i)\bborn|birth|\bdob\b|geboren|\bgeb\.|nacid|nacimiento|\bnée?\b|naissance"),
    "secret": re.compile(r"(?i)(?:key|token|secret|passw(?:or)?d|pwd|credentials?|auth)[\"']?\s{0,3}[:=]\s{0,3}[\"']?$"),
}
AGAINST = re.compile(r"(?i)token|secret|hash|key|version|order|isbn|issn|serial|sha|md5|uuid|commit")
AGAINST_SECRET = re.compile(r"(?i)commit|\bsha|md5|checksum|digest|integrity|etag|uuid|revision")
AGAINST_NAME = re.compile(r"(?i)\b(?:city|street|river|lake|mount|university|stadt|rue|calle|ville)\x20(?:of\x20|de\x20)?$")
PREFIXED = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk_(?:live|test)_[A-Za-z0-9]{10,}|xox[abp]-|eyJ[A-Za-z0-9_-]+\.")
CONTEXT_CHARS = 32


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Of each domain part the longest local part before it that is still free."""
    out, free = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            a = m.start()
            while a > free and text[a - 1] in LOCAL:
                a -= 1
            if a < m.start():
                out.append((a, m.end()))
                free = m.end()
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Four parts at a time of each dotted chain of numbers."""
    out = []
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """The base spans in order of kind and place, and long numbers that aren't cards."""
    spans = [("email", a, b) for a, b in emails(text)]
    near: list[tuple[int, int]] = []
    if not DIGIT.search(text):
        return spans, near
    spans += [("ip", a, b) for a, b in addresses(text)]
    for m in CARD.finditer(text):
        a, b = m.span()
        if b - a < 13:
            continue
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", a, b))
        elif 13 <= len(digits) <= 19:
            near.append((a, b))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(DIGIT.findall(m.group())) <= 15:
                spans.append(("phone", *m.span()))
    return spans, near


def candidates(text: str, base: list[Span], near: list[tuple[int, int]]) -> list[Span]:
    """Further spans that might be personal data, apart from each other and from base spans."""
    found: list[Span] = [("card", a, b) for a, b in near]
    if "at)" in text or "at]" in text:
        found += [("email", *m.span()) for m in SPELLED.finditer(text)]
    if DIGIT.search(text):
        found += [("phone", *m.span()) for m in NATIONAL.finditer(text)]
    if text.count(":") >= 7:
        found += [("ip", *m.span()) for m in IPV6.finditer(text)]
    if DIGIT.search(text):
        found += [("birth", *m.span()) for m in NUMBERS.finditer(text) if DATE.fullmatch(m.group())]
        found += [("iban", *m.span()) for m in IBAN.finditer(text)]
        found += [("address", *m.span()) for m in ADDRESS.finditer(text)] if any(w in text for w in STREETS) else []
    for m in NAME.finditer(text):
        # A word before a given name is none of the name's ("Call Anna Smith").
        a, given = m.start(), m.group().split(" ")
        late = len(given) == 3 and given[0].lower() not in GIVEN_NAMES and given[1].lower() in GIVEN_NAMES
        found.append(("name", a + len(given[0]) + 1 if late else a, m.end()))
    found += [("secret", *m.span(1)) for m in ASSIGNED.finditer(text) if CUES["secret"].search(text[max(0, m.start() - 16) : m.start(1)])]
    found += [("secret", *m.span()) for m in BARE.finditer(text)]
    taken = sorted((a, b) for _, a, b in base)
    free: list[Span] = []
    i = 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if (i == len(taken) or taken[i][0] >= b) and (not free or free[-1][2] <= a):
            free.append((kind, a, b))
    return free


def _said(yes: bool, no: bool = False) -> str:
    return "1" if yes else "0" if no else "-"


def valid_date(text: str) -> bool:
    parts = [int(x) for x in re.split(r"[./-]", text)]
    year, one, two = (parts[0], parts[1], parts[2]) if parts[0] > 999 else (parts[2], parts[1], parts[0])
    return 1 <= min(one, two) and max(one, two) <= 31 and min(one, two) <= 12 and 1000 <= year


def valid_iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, span: Span, base: bool) -> str:
    """Six votes: rule, gazetteer, cue, counter-cue, borders, layout."""
    kind, a, b = span
    s = text[a:b]
    digits = "".join(DIGIT.findall(s)) if kind in KINDS else ""
    before = text[max(0, a - CONTEXT_CHARS) : a]
    around = text[a - 1 : a] + text[b : b + 1]
    rule, layout, against = _said(base), "-", AGAINST
    cue = _said(bool(CUES[kind].search(before)))
    if kind == "email":
        known = "1" if re.split(r"[.)\]\x20]", s.rstrip(".)] "))[-1].lower() in TOP_DOMAINS else "0"
        layout = "1" if base else "-"
    elif kind == "card":
        rule = _said(base, not base)
        known = "1" if digits[:1] in "3456" and luhn(digits) else "0"
        layout = "1" if re.fullmatch(r"[0-9]+|[0-9]{4}(?:[ -][0-9]{4}){3,}", s) else "0"
    elif kind == "ip":
        first = s.split(".")[0]
        known = "0" if digits == "0000" or base and (first.strip("0") == "" or int(first) in (127, 255)) else "1"
        layout = "0" if any(len(p) > 1 and p[0] == "0" for p in s.split(".")) else "1"
    elif kind == "phone":
        known = "1" if len(set(digits)) > 2 else "0"
        layout = "1" if re.fullmatch(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\(?[0-9]{2,4}\)?[ .-]?){2,4}", s) else "0"
    elif kind == "name":
        rule, against = _said(bool(TITLE.search(before))), AGAINST_NAME
        known = "1" if s.split(" ")[0].lower() in GIVEN_NAMES else "0"
    elif kind == "address":
        rule, known = "1", _said(bool(re.match(r"\W*(?:[A-Z]{1,2}[0-9]|[0-9]{4,5})", text[b : b + 8])))
    elif kind == "iban":
        rule, known = _said(valid_iban(s), True), _said(s[:2] in IBAN_COUNTRIES, True)
    elif kind == "birth":
        rule, known, cue = _said(False, not valid_date(s)), _said(False, not re.search(r"(?:19|200|201)[0-9]", s)), _said(cue == "1", True)
    else:
        mixed = bool(re.search(r"[0-9]", s)) and bool(re.search(r"[A-Za-z]", s)) and len(set(s)) > 5
        rule, known, cue, against = _said(bool(PREFIXED.match(s))), _said(mixed, True), _said(cue == "1", True), AGAINST_SECRET
    borders = any(c.isalnum() or c == "_" for c in around)
    return rule + known + cue + _said(False, bool(against.search(before))) + (_said(False, borders) if kind in ADDED else _said(not borders, True)) + layout


WORD_BEFORE = re.compile(r"(\w+)\W*$")
WORD_AFTER = re.compile(r"\W*(\w+)")
SHAPES = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "A" * 26 + "a" * 26 + "9" * 10)


def features(text: str, span: Span, vote: str) -> list[int]:
    """Hashed features of a span: its votes, shape and length, and the words around it."""
    kind, a, b = span
    shape = text[a : min(b, a + 64)].translate(SHAPES)
    runs_ = re.sub(r"(.)\1+", r"\1", shape)
    before, after = WORD_BEFORE.search(text[max(0, a - CONTEXT_CHARS) : a]), WORD_AFTER.match(text[b : b + CONTEXT_CHARS])
    names = ["", f"{min(7, (b - a) // 4)}", f"s{runs_[:24]}", f"h{shape[:3]}", f"t{shape[-3:]}", f"b{before[1].lower() if before else ''}", f"a{after[1].lower() if after else ''}", f"c{text[a - 1 : a]}{text[b : b + 1]}"]
    names += [f"{i}={v}" for i, v in enumerate(vote)]
    return [zlib.crc32(f"{kind}:{n}".encode()) % DIMENSIONS for n in names]


def join(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (ORDER[s[0]], s[1])))


@dataclass
class SpanModel:
    """Logistic weights of hashed features; EM's posterior of each kind's votes, and each labeler's reliability by kind."""

    weights: np.ndarray
    posterior: dict[tuple[str, str], float]
    reliability: dict[str, list[tuple[float, float]]]
    threshold: float = THRESHOLD

    def score(self, hashed: list[int]) -> float:
        z = float(self.weights[hashed].sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def takes(self, kind: str, vote: str, hashed: list[int]) -> bool:
        return self.posterior.get((kind, vote), 1.0) >= 0.5 and self.score(hashed) >= self.threshold

    def accepts(self, text: str, span: Span) -> bool:
        vote = votes(text, span, False)
        return self.takes(span[0], vote, features(text, span, vote))


def start(vote: str) -> float:
    """First guess of a posterior: rules, gazetteers and cues must speak for a span, and no fewer than speak against."""
    ones, zeros = vote.count("1"), vote.count("0")
    return 0.1 if "1" not in vote[:3] or ones < zeros else 0.5 if ones == zeros else 0.9


def reliabilities(counts: dict[tuple[str, str], int], rounds: int = 50) -> tuple[dict[tuple[str, str], float], dict[str, list[tuple[float, float]]]]:
    """EM over the counts of (kind, votes): posteriors, and how often each labeler is right on either side."""
    reliability: dict[str, list[tuple[float, float]]] = {}
    posterior: dict[tuple[str, str], float] = {}
    for kind in ORDER:
        pattern = sorted(v for k, v in counts if k == kind)
        if not pattern:
            continue
        n = np.array([counts[kind, p] for p in pattern], float)
        cell = np.array([["01-".index(c) for c in p] for p in pattern])
        q = np.array([start(p) for p in pattern])
        for _ in range(rounds):
            prior = (n @ q + 1) / (n.sum() + 2)
            log = np.stack([np.full(len(q), math.log(1 - prior)), np.full(len(q), math.log(prior))])
            table = []
            for j in range(cell.shape[1]):
                for c, w in ((0, n * (1 - q)), (1, n * q)):
                    # Smoothed towards labelers that are right nine times in ten; an abstention says nothing.
                    p = np.bincount(cell[:, j], w, 3)[:2] + ((4.5, 0.5), (0.5, 4.5))[c]
                    p /= p.sum()
                    log[c] += np.append(np.log(p), 0.0)[cell[:, j]]
                    table.append(p)
            q = 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))
        reliability[kind] = [(float(table[2 * j][0]), float(table[2 * j + 1][1])) for j in range(cell.shape[1])]
        posterior |= {(kind, p): float(x) for p, x in zip(pattern, q, strict=True)}
    return posterior, reliability


def fit(rows: list[tuple[str, str, int, list[int]]], rounds: int = 400, threshold: float = THRESHOLD) -> SpanModel:
    """EM over (kind, votes, count, features) rows, then logistic regression on the posteriors."""
    counts: dict[tuple[str, str], int] = {}
    for kind, vote, n, _ in rows:
        counts[kind, vote] = counts.get((kind, vote), 0) + n
    posterior, reliability = reliabilities(counts)
    w, step = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    if rows:
        x = np.array([f for *_, f in rows])
        y = np.array([posterior[k, v] for k, v, *_ in rows])
        n = np.sqrt(np.array([n for _, _, n, _ in rows], float))
        n /= n.sum()
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30)))
            grad = np.bincount(x.ravel(), np.repeat(n * (p - y), x.shape[1]), DIMENSIONS) + 1e-5 * w
            step = 0.9 * step - 0.4 * grad
            w += step
    return SpanModel(w.astype(np.float32), posterior, reliability, threshold)


FOUND = "array<struct<kind: string, start: bigint, end: bigint, base: boolean, votes: string, features: array<int>>>"


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: its base spans, and every candidate, with votes and features."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    cand = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text in part.column("text").to_pylist():
                    rows = []
                    if text:
                        base, near = base_spans(text)
                        for own, spans in ((True, base), (False, candidates(text, base, near))):
                            for s in spans:
                                v = votes(text, s, own)
                                rows.append({"kind": s[0], "start": s[1], "end": s[2], "base": own, "votes": v, "features": features(text, s, v)})
                    out.append(rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, cand)], ["doc_id", "found"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, found {FOUND}")


def train(scanned: DataFrame) -> SpanModel:
    """The model of a scanned corpus: counts over all of its candidates, and the bounded sample of their features."""
    f = scanned.select(F.explode("found").alias("f")).select("f.kind", "f.votes", "f.features")
    f = f.withColumn("h", F.xxhash64("features"))
    c = f.groupBy("kind", "votes", F.pmod("h", F.lit(SUBSAMPLES)).alias("part")).agg(F.count("*").alias("n"), F.min(F.struct("h", "features")).alias("one"))
    return fit(sorted((r.kind, r.votes, r.n, list(r.one.features)) for r in c.collect()))


def digest_spans(scanned: DataFrame, model: SpanModel) -> DataFrame:
    """doc_id, n_<kind>, base_sha256 and spans (base and accepted candidates)."""
    kind = scanned.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    sent = scanned.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            n: dict[str, list[int]] = {k: [] for k in KINDS}
            sha, spans = [], []
            for found in batch.column("found").to_pylist():
                base = [(f["kind"], f["start"], f["end"]) for f in found if f["base"]]
                more = [(f["kind"], f["start"], f["end"]) for f in found if not f["base"] and m.takes(f["kind"], f["votes"], f["features"])]
                for k in KINDS:
                    n[k].append(sum(s[0] == k for s in base))
                sha.append(hashlib.sha256(join(base).encode()).hexdigest())
                spans.append(join(base + more))
            arrays = [batch.column("doc_id"), *(pa.array(n[k], pa.int64()) for k in KINDS), pa.array(sha, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return scanned.select("doc_id", "found").mapInArrow(run, schema)


@scoped
def find_pii(docs: DataFrame) -> DataFrame:
    scanned = stored(scan(docs), "candidates")
    return digest_spans(scanned, train(scanned))


def mask_text(text: str, model: SpanModel) -> str:
    """Spans replaced by their kind; of overlapping ones, what lies over both."""
    base, near = base_spans(text)
    spans = base + [s for s in candidates(text, base, near) if model.accepts(text, s)]
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


@scoped
def masked(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with personal data in ``column`` replaced by its kind: [EMAIL], [NAME] and so on."""
    model = train(stored(scan(docs.select(F.lit(0).alias("doc_id"), F.col(column).alias("text"))).where(F.size("found") > 0), "candidates"))
    i = docs.columns.index(column)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                texts = [t and mask_text(t, sent.value) for t in part.column(i).to_pylist()]
                yield part.set_column(i, part.schema.field(i), pa.array(texts, part.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
