"""Fill-in-the-middle examples by overlapping-chunk decomposition.

A text is a row of tokens: a word with the blanks before it, or the blanks at
its end. So the number of tokens, and the place where the k-th one ends, follow
from word ends, and whether a word ends at a byte is told by that byte and the
next one. Texts are cut into chunks of CHUNK bytes that overlap by this next
byte. Each chunk counts its word ends; prefix sums of the counts give every
text's number of words and tell which chunk owns each of the two cut ranks; only
those chunks are scanned again. Memory is a text's bytes and one pass.

A text is one value of a column, so its chunks are counted side by side in numpy
by the task that has the row: to shuffle chunks would move the text, which costs
more than to scan it. Rows are independent, so nothing is shuffled.

Form and cuts follow from SHA-256 of seed and doc_id. ``plain`` keeps the text,
``psm`` and ``spm`` put the middle last behind its marker. No text with a marker
is rearranged, so each marker is found once in an output, and
:func:`restored` is exact.

Defined results
* null and empty texts: no tokens, plain, an empty output.
* a null doc_id is hashed as no digits; repeated rows and equal doc_ids get equal cuts.
* an empty table gives no rows; further columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popweave.llm._words import PASS_BYTES, SOLID, slices, utf8

#: Bytes of a chunk.
CHUNK = 64 << 10
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
#: Of a hundred texts so many are rearranged, and of these so many as spm.
FIM_PERCENT, SPM_PERCENT = 50, 80


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """The first four 32-bit numbers of the document's hash."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def word_ends(data: np.ndarray, start: int, end: int) -> np.ndarray:
    """For each byte from ``start`` to ``end``, whether a word ends there; the byte at ``end`` is seen too."""
    solid = SOLID[data[start : end + 1]]
    return solid[:-1] & ~solid[1:]


class Chunks:
    """Word ends of several texts, counted by chunk."""

    def __init__(self, texts: list[bytes]) -> None:
        # A blank follows each text, and one more the last chunk.
        self.data = np.frombuffer(b"\n".join([*texts, b"", b""]), np.uint8)
        spans = np.array([len(t) + 1 for t in texts], np.int64)
        self.at = np.concatenate([[0], np.cumsum(spans)])
        each = -(-spans // CHUNK)
        self.first = np.concatenate([[0], np.cumsum(each)])
        inside = np.arange(self.first[-1]) - np.repeat(self.first[:-1], each)
        self.start = np.concatenate([np.repeat(self.at[:-1], each) + inside * CHUNK, self.at[-1:]])
        counts = np.zeros(len(inside), np.int64)
        a = 0
        while a < len(counts):
            b = max(a + 1, int(np.searchsorted(self.start, self.start[a] + PASS_BYTES)) - 1)
            ends = word_ends(self.data, int(self.start[a]), int(self.start[b]))
            counts[a:b] = np.add.reduceat(ends.astype(np.int64), self.start[a:b] - self.start[a])
            a = b
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.words = self.before[self.first[1:]] - self.before[self.first[:-1]]

    def end_of_word(self, text: int, k: int) -> int:
        """The byte of ``text`` after its k-th word (from 1)."""
        rank = self.before[self.first[text]] + k
        chunk = int(np.searchsorted(self.before, rank)) - 1
        found = np.flatnonzero(word_ends(self.data, int(self.start[chunk]), int(self.start[chunk + 1])))
        return int(self.start[chunk] + found[rank - self.before[chunk] - 1] + 1 - self.at[text])


def code_points(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def arrange(texts: list[bytes], doc_ids: list[int | None], seed: int = SEED) -> dict[str, list]:
    """n, form, prefix_chars, middle_chars and output of each text."""
    chunks = Chunks(texts)
    out: dict[str, list] = {"n": [], "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
    for i, (text, doc) in enumerate(zip(texts, doc_ids, strict=True)):
        words = int(chunks.words[i])
        n = words + bool(text and not SOLID[text[-1]])
        h1, h2, h3, h4 = draws(doc, seed)
        form, sizes, output = "plain", (None, None), text
        if text and h3 % 100 < FIM_PERCENT and not any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
            a, b = (0 if k == 0 else len(text) if k > words else chunks.end_of_word(i, k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
            prefix, middle, suffix = text[:a], text[a:b], text[b:]
            form, sizes = "spm" if h4 % 100 < SPM_PERCENT else "psm", (code_points(prefix), code_points(middle))
            parts = (SUFFIX, suffix, PREFIX, prefix) if form == "spm" else (PREFIX, prefix, SUFFIX, suffix)
            output = b"".join((*parts, MIDDLE, middle))
        for name, value in zip(out, (n, form, *sizes, output), strict=True):
            out[name].append(value)
    return out


OUT = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.binary()}


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output (text) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                made = arrange(utf8(part.column("text")), part.column("doc_id").to_pylist(), seed)
                columns = [pa.array(made[c], kind) for c, kind in OUT.items()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *OUT])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(form: Column, output: Column) -> Column:
    """The text, rebuilt from an output and its form."""
    part = F.split(output, "<[PSM]>", 4)
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )


BLANK = r"[\x20\x09-\x0D]"
SOLID_SQL = r"[^\x20\x09-\x0D]"
SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '{BLANK}*{SOLID_SQL}+|{BLANK}+') AS u
  FROM documents),
d AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM t),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' OR h3 % 100 >= {FIM_PERCENT} THEN 'plain'
              WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix
  FROM f)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
