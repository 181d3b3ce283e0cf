"""Quality rules whose cutoffs carry a guarantee (risk-controlled thresholds).

Each rule rejects a document whose ratio reaches a cutoff; a document goes if any
rule rejects it. Per stratum (the language) the labelled documents that pass the
base rule are split by a hash of doc_id. The fitting quarter only orders the
pairs of rule and cutoff: those that reject the fewest of its good documents come
first, more lenient cutoffs of a rule before stricter ones. Step t rejects what
any of the first t pairs rejects, so steps get stricter. The other three quarters,
which the order doesn't depend on, certify: from the first step on, a step is safe
if the exact (Clopper-Pearson) upper bound of the rate at which their good documents
are rejected is at most ``max_false`` at level ``error`` divided by the number of
strata (Bonferroni over strata), and testing stops at the first step that isn't safe
(fixed-sequence testing). So with probability 1 - ``error`` no stratum loses more
than ``max_false`` of the good documents that pass the base rule to all these rules
together; what the base rule itself rejects isn't bounded. Of the safe steps the one
that best separates bad from good certifying documents is used, the more lenient one
if equal; without a safe one the rules are off in that stratum.

Defined results
* null text: no words, so it fails the base rule; null languages are a
  stratum of their own; null labels and labels without a document don't count;
  a document with several labels counts as bad if one says so.
* an empty table gives no rows; without labels only the base rule rejects.
* repeated rows are measured one by one; texts of any length are measured whole.
* further columns are ignored, and kept by :func:`good_documents` whatever their
  names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popweave.functions.distributions import incomplete_beta
from popweave.llm._store import scoped, stored
from popweave.llm._words import SOLID, byte_class, mix, slices, utf8, windows, words

SYMBOL = byte_class("#*$%&|<>")
BLANK = b" \t\n\v\f\r"
WINDOW = 5
#: rule: (numerator, denominator, cutoffs in thousandths from lenient to strict).
RULES = {
    "symbols": ("n_symbols", "n_words", (2000, 1000, 500, 300, 200, 150, 100, 75, 50)),
    "dup_lines": ("n_dup_lines", "n_lines", (900, 800, 700, 600, 500, 450, 400, 350, 300, 250, 200)),
    "repeats": ("n_repeat_words", "n_words", (200, 190, 180, 170, 160, 150, 140, 130, 120)),
    "long_words": ("word_chars", "n_words", (20000, 15000, 12000, 10000, 9000, 8000, 7500, 7000, 6500)),
}
#: The rule and the cutoff of each pair, in the order that breaks ties.
PAIRS = [(rule, i) for rule, (_, _, cuts) in RULES.items() for i in range(len(cuts))]
#: A labelled document orders the steps if its hash begins with one of these digits, else it certifies.
FITTING = "0123"
MAX_FALSE = 0.0125
ERROR = 0.05


def repeat_words(tokens: Iterator[bytes]) -> int:
    """Words in WINDOW-word windows that occur twice or more, exactly.

    Words are numbered, so memory is about 70 bytes a word whatever repeats.
    """
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(t, len(number)) for t in tokens), np.int32)
    if len(ids) <= WINDOW:
        return 0
    rows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    order = np.lexsort(rows.T).astype(np.int32)
    same = np.ones(len(order) - 1, bool)
    for column in range(WINDOW):
        sorted_ids = ids[order + column]
        same &= sorted_ids[1:] == sorted_ids[:-1]
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    change = np.zeros(len(ids) + 1, np.int32)
    change[: len(twice)] += twice
    change[WINDOW : WINDOW + len(twice)] -= twice
    return int(np.count_nonzero(np.cumsum(change)[: len(ids)]))


def measure_texts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each text.

    Equal windows have equal hashes, so a text without equal window hashes has
    no repeats; the others are counted exactly.
    """
    n = len(texts)
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)
    per_text = lambda flags: np.add.reduceat(flags.astype(np.int64), starts)
    w = words(texts)
    h, bounds = windows(w.hashes, w.first, WINDOW)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    key = h ^ mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    again = order[1:][key[order[1:]] == key[order[:-1]]]
    repeats = np.zeros(n, np.int64)
    for i in np.unique(owner[again]):
        s = w.of(i)
        repeats[i] = repeat_words(texts[i][a:b] for a, b in zip(w.start[s], w.end[s], strict=True))
    dups, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, text in enumerate(texts):
        parts = text.split(b"\n")
        if len(set(parts)) < len(parts):
            parts = [p for p in parts if p.strip(BLANK)]
            lines[i], dups[i] = len(parts), len(parts) - len(set(parts))
    return {
        "n_words": np.diff(w.first),
        "word_chars": per_text(SOLID[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(SYMBOL[data]),
        "n_lines": lines,
        "n_dup_lines": dups,
        "n_repeat_words": repeats,
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of every document's whole text (n_lines is
    0 where no line repeats)."""
    schema = ", ".join(["doc_id " + docs.schema["doc_id"].dataType.simpleString(), "lang string", *(f"{c} long" for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts = measure_texts(utf8(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), *(pa.array(counts[c], pa.int64()) for c in COUNTS)], ["doc_id", "lang", *COUNTS])

    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def measured_rows(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), lang and the counts."""
    fields = [T.StructField("row", docs.schema), T.StructField("lang", T.StringType()), *(T.StructField(c, T.LongType()) for c in COUNTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts = measure_texts(utf8(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("lang"), *(pa.array(counts[c], pa.int64()) for c in COUNTS)], ["row", "lang", *COUNTS])

    rows = docs.select(F.struct("*").alias("row"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType(fields))


@scoped
def good_documents(docs: DataFrame, labels: DataFrame, max_false: float = MAX_FALSE, error: float = ERROR) -> DataFrame:
    """The rows of ``docs`` that are kept. Texts are measured twice rather than shuffled."""
    cutoffs = safe_cutoffs(stored(measure(docs), "measured"), labels, max_false, error)
    return judge(measured_rows(docs), cutoffs).where("kept").select("row.*")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rejected(rule: str, cutoff: Column) -> Column:
    over, under, _ = RULES[rule]
    return (F.col(under) > 0) & (1000 * F.col(over) >= cutoff * F.col(under))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(at most k of n) at rate p, exactly but for rounding, as an incomplete beta function."""
    return 1.0 if k >= n else incomplete_beta(n - k, k + 1, 1 - p)


def ordered_pairs(rejects: np.ndarray, n_good: np.ndarray) -> list[int]:
    """The pairs (columns of ``rejects``) by the good documents of the fitting part that each rejects alone."""
    lost = rejects.T.astype(np.int64) @ n_good
    return sorted(range(len(PAIRS)), key=lambda p: (lost[p], p))


def certified(rejects: np.ndarray, order: list[int], n_good: np.ndarray, n_bad: np.ndarray, max_false: float, level: float) -> list[int]:
    """The pairs of the best safe step. Rows of ``rejects`` are kinds of certifying documents with their numbers."""
    total, bad = int(n_good.sum()), max(int(n_bad.sum()), 1)
    gone = np.zeros(len(rejects), bool)
    best, chosen = 0.0, 0
    for t, p in enumerate(order, 1):
        gone |= rejects[:, p]
        k = int(n_good[gone].sum())
        if binomial_cdf(k, total, max_false) > level:
            break
        gain = int(n_bad[gone].sum()) / bad - k / total
        if gain > best:
            best, chosen = gain, t
    return order[:chosen]


@scoped
def safe_cutoffs(measured: DataFrame, labels: DataFrame, max_false: float = MAX_FALSE, error: float = ERROR) -> DataFrame:
    """(lang, rule, cutoff) of the strata whose rules are on.

    Cutoffs of a rule are nested, so a labelled document is told by how many of each
    rule's reject it. What is gathered is a count for each stratum, part, label and such kind.
    """
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.withColumn("fitting", F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1).isin(*FITTING))
    m = measured.where(~base_failed()).join(known, "doc_id")
    hits = {r: sum((F.coalesce(rejected(r, F.lit(c)), F.lit(False)).cast("int") for c in cuts), F.lit(0)) for r, (_, _, cuts) in RULES.items()}
    keys = [F.col("lang"), F.col("fitting"), (F.col("quality") == 1).alias("is_good"), *(hits[r].alias(f"hits_{r}") for r in RULES)]
    hist = stored(m.groupBy(*keys).agg(F.count("*").alias("n")), "label_counts")
    tests = max(1, hist.select(F.struct("lang")).distinct().count())

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rejects = np.stack([rows[f"hits_{r}"].to_numpy() >= len(RULES[r][2]) - i for r, i in PAIRS], axis=1)
        n = rows.n.to_numpy()
        of = lambda fitting, good: np.where((rows.fitting == fitting) & (rows.is_good == good), n, 0)
        order = ordered_pairs(rejects, of(True, True))
        chosen = certified(rejects, order, of(False, True), of(False, False), max_false, error / tests)
        strictest: dict[str, int] = {}
        for rule, i in (PAIRS[p] for p in chosen):
            strictest[rule] = max(i, strictest.get(rule, 0))
        out = [(rows.lang.iloc[0], rule, RULES[rule][2][i]) for rule, i in strictest.items()]
        return pd.DataFrame(out, columns=["lang", "rule", "cutoff"])

    return hist.groupBy("lang").applyInPandas(choose, "lang string, rule string, cutoff long")


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds base_failed and kept. ``measured`` has one row for each document."""
    wide = cutoffs.groupBy("lang").pivot("rule", list(RULES)).agg(F.min("cutoff"))
    wide = stored(wide.select(F.col("lang").alias("stratum"), *(F.col(r).alias(f"cut_{r}") for r in RULES)), "cutoffs")
    verdict = F.lit(False)
    for rule in RULES:
        verdict = verdict | F.coalesce(rejected(rule, F.col(f"cut_{rule}")), F.lit(False))
    out = measured.join(wide, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    out = out.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & ~verdict).drop("stratum", *(f"cut_{r}" for r in RULES))


@scoped
def quality_verdicts(docs: DataFrame, labels: DataFrame, max_false: float = MAX_FALSE, error: float = ERROR) -> DataFrame:
    """doc_id, lang, the counts, base_failed and kept for every document."""
    measured = stored(measure(docs), "measured")
    return judge(measured, safe_cutoffs(measured, labels, max_false, error))


def _sql() -> str:
    pairs = ", ".join(f"({p}, '{rule}', {RULES[rule][2][i]})" for p, (rule, i) in enumerate(PAIRS))
    ratios = " UNION ALL ".join(f"SELECT doc_id, lang, '{r}' AS rule, {a} AS over, {b} AS under FROM b WHERE NOT base_failed" for r, (a, b, _) in RULES.items())
    solid = r"[^\x20\x09-\x0D]"
    return rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{solid}+') AS w FROM documents),
grams AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{solid}') GROUP BY doc_id),
m AS MATERIALIZED (
  SELECT doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
b AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
known AS (
  SELECT doc_id, min(quality) AS quality, left(md5(doc_id::VARCHAR), 1) IN ({", ".join(f"'{x}'" for x in FITTING)}) AS fitting
  FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
pairs AS (SELECT * FROM (VALUES {pairs}) t(p, rule, cut)),
ratios AS MATERIALIZED ({ratios}),
hits AS (
  SELECT lang, doc_id, quality, fitting, p
  FROM ratios JOIN known USING (doc_id) JOIN pairs USING (rule) WHERE under > 0 AND 1000 * over >= cut * under),
sizes AS (
  SELECT lang, count(*) FILTER (quality = 1 AND NOT fitting) AS n_good, count(*) FILTER (quality <> 1 AND NOT fitting) AS n_bad
  FROM b JOIN known USING (doc_id) WHERE NOT base_failed GROUP BY lang),
lost AS (SELECT lang, p, count(*) AS n FROM hits WHERE fitting AND quality = 1 GROUP BY lang, p),
steps AS (
  SELECT s.lang, pairs.p, rule, cut, row_number() OVER (PARTITION BY s.lang ORDER BY coalesce(n, 0), pairs.p) AS step
  FROM sizes s CROSS JOIN pairs LEFT JOIN lost ON lost.p = pairs.p AND lost.lang IS NOT DISTINCT FROM s.lang),
gone AS (
  SELECT h.lang, h.doc_id, quality, min(step) AS step
  FROM hits h JOIN steps s ON s.p = h.p AND s.lang IS NOT DISTINCT FROM h.lang WHERE NOT fitting GROUP BY ALL),
counts AS (
  SELECT s.lang, s.step, n_good, n_bad,
         count(*) FILTER (quality = 1) AS k, count(*) FILTER (quality <> 1) AS k_bad
  FROM steps s JOIN sizes z ON s.lang IS NOT DISTINCT FROM z.lang
  LEFT JOIN gone g ON g.lang IS NOT DISTINCT FROM s.lang AND g.step <= s.step
  GROUP BY ALL),
tested AS (
  SELECT *, n_good > 0 AND k < n_good AND list_sum(list_transform(range(0, k + 1), lambda i:
              exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({MAX_FALSE}::DOUBLE) + (n_good - i) * ln(1 - {MAX_FALSE}::DOUBLE))))
            <= {ERROR}::DOUBLE / (SELECT count(*) FROM sizes) AS passed
  FROM counts),
safe AS (SELECT *, k_bad / greatest(n_bad, 1) - k / n_good AS gain, bool_and(passed) OVER (PARTITION BY lang ORDER BY step) AS ok FROM tested),
chosen AS (
  SELECT lang, step FROM safe WHERE ok AND gain > 0
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY gain DESC, step) = 1),
out AS (
  SELECT DISTINCT r.doc_id FROM ratios r
  JOIN steps s ON s.lang IS NOT DISTINCT FROM r.lang AND s.rule = r.rule
  JOIN chosen c ON c.lang IS NOT DISTINCT FROM r.lang AND s.step <= c.step
  WHERE under > 0 AND 1000 * over >= cut * under)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM out WHERE doc_id IS NOT NULL) AS kept
FROM b
"""


SQL = _sql()
