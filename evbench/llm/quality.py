"""Quality rules with line sequence labelling (operator 2).

A linear-chain conditional random field over a document's lines marks each as content or boilerplate; the share of the
document's word characters that stands in content lines decides whether it is kept.  The field has two labels, the line
features of `line_features` and a 2x2 transition; Viterbi decoding gives the labels.

Labels are of documents.  Besides the labelled documents, whose lines take their document's label, the field is therefore
fitted on documents joined from one of either class, in turn content first, boilerplate first, and boilerplate amid
content: there the label of a line differs within a sequence and changes are seen.  The sample is bounded: `fit_docs`
documents, those whose id has the smallest hash, and of each a run of at most `fit_lines` lines that starts at a place drawn
from its id.  Scoring covers every line of every text.

Null or empty text: no words, so the base rules reject it.  Without usable labels (none, or one class) the field falls back
to `DEFAULT`, fixed weights of the same features.  Repeated ids are judged each by itself.  Very long texts are one task's
row and cost a few numbers a line.  Of equally good labellings the one with content at the last line that differs is
taken.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lines_into, table, texts

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
#: Bytes of a character after its first.
LATER = bytes(range(128, 192))
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
FEATURES = ["bias", "log_words", "symbols", "upper", "digits", "exclaim", "distinct", "repeated", "ends", "letters"]

#: Content share from which a document is kept.
MIN_CONTENT = 0.5
#: Bounds of the sample that the field is fitted on.
FIT_DOCS, FIT_LINES = 1500, 32


def line_features(lines: list[bytes]) -> np.ndarray:
    """A row for each line; see FEATURES.  Lines are UTF-8."""
    out = np.zeros((len(lines), len(FEATURES)))
    seen: set[bytes] = set()
    for i, line in enumerate(lines):
        n = len(line)
        words = line.split()
        if not words:
            out[i, 0] = 1.0
            continue
        of = lambda kind: (n - len(line.translate(None, kind))) / n
        out[i] = (
            1.0,
            np.log1p(len(words)),
            of(SYMBOLS),
            of(UPPER),
            of(DIGITS),
            line.count(b"!") / len(words),
            len(set(words)) / len(words),
            line in seen,
            line.rstrip()[-1:] in b".!?:;",
            of(LETTERS),
        )
        seen.add(line)
    return out


@dataclass
class Field:
    """unary: the weight of each feature for content over boilerplate; trans[a][b]: of label b after a (0 boilerplate, 1 content)."""

    unary: list[float]
    trans: list[list[float]]


#: Used where nothing can be learned: long, letter-rich lines with few symbols are content.
DEFAULT = Field([0.5, 0.5, -20.0, -4.0, -4.0, -3.0, 1.0, -2.0, 0.5, 1.0], [[1.0, -1.0], [-1.0, 1.0]])


def viterbi(scores: list[float], trans: list[list[float]]) -> list[int]:
    """The best labels, where label 1 scores scores[i] at line i and label 0 scores 0; ties go to content."""
    if not scores:
        return []
    (t00, t01), (t10, t11) = trans
    a, b = 0.0, scores[0]
    back = []
    for s in scores[1:]:
        to0, to1 = b + t10 >= a + t00, b + t11 >= a + t01
        back.append((to0, to1))
        a, b = (b + t10 if to0 else a + t00), (b + t11 if to1 else a + t01) + s
    label = int(b >= a)
    out = [label]
    for to0, to1 in reversed(back):
        label = int(to1 if label else to0)
        out.append(label)
    return out[::-1]


def training(documents: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(features of the lines, their labels, weight) of the documents (features, label) and of joins of both classes; none if one is missing.

    Documents of a class weigh a third together, and so do all joins.
    """
    by = [[x for x, y in documents if y == c and len(x)] for c in (0, 1)]
    if not by[0] or not by[1]:
        return []
    out = [(x, np.full(len(x), c), 1 / len(by[c])) for c in (0, 1) for x in by[c]]
    n = max(map(len, by))
    for k in range(n):
        bad, good = by[0][k % len(by[0])], by[1][k % len(by[1])]
        half = len(good) // 2 if k % 3 == 2 else (0 if k % 3 else len(good))
        x = np.concatenate([good[:half], bad, good[half:]])
        out.append((x, np.concatenate([np.ones(half), np.zeros(len(bad)), np.ones(len(good) - half)]), 1 / n))
    return out


def fit(documents: list[tuple[np.ndarray, int]], rounds: int = 80, rate: float = 0.2, l2: float = 1e-3) -> Field:
    """Maximum likelihood by Adam over forward-backward; documents: (features of the lines, label)."""
    sequences = training(documents)
    if not sequences:
        return DEFAULT
    t = max(len(x) for x, _, _ in sequences)
    n, k = len(sequences), len(FEATURES)
    x = np.zeros((t, n, k))
    mask = np.zeros((t, n), bool)
    y = np.zeros((t, n))
    for j, (f, labels, _) in enumerate(sequences):
        x[: len(f), j], mask[: len(f), j], y[: len(f), j] = f, True, labels
    w = np.asarray([c for *_, c in sequences]) / mask.sum(axis=0) / 3
    seen = np.asarray([[((y[:-1] == a) & (y[1:] == b) & mask[1:]) for b in (0, 1)] for a in (0, 1)])
    theta = np.zeros(k + 4)
    m = v = np.zeros_like(theta)
    for step in range(1, rounds + 1):
        trans = theta[k:].reshape(2, 2)
        s = np.zeros((t, n, 2))
        s[:, :, 1] = x @ theta[:k]
        alpha = np.zeros((t, n, 2))
        beta = np.zeros((t, n, 2))
        alpha[0] = s[0]
        for i in range(1, t):
            nxt = np.logaddexp(alpha[i - 1][:, :1] + trans[0], alpha[i - 1][:, 1:] + trans[1]) + s[i]
            alpha[i] = np.where(mask[i][:, None], nxt, alpha[i - 1])
        for i in range(t - 2, -1, -1):
            after = s[i + 1] + beta[i + 1]
            nxt = np.logaddexp(after[:, :1] + trans[:, 0], after[:, 1:] + trans[:, 1])
            beta[i] = np.where(mask[i + 1][:, None], nxt, beta[i + 1])
        z = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
        p1 = np.where(mask, np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - z, 0)), 0)
        grad = np.zeros_like(theta)
        grad[:k] = np.einsum("tn,tnk->k", (y - p1) * w, x)
        pairs = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                e = np.exp(np.minimum(alpha[:-1, :, a] + trans[a, b] + s[1:, :, b] + beta[1:, :, b] - z, 0))
                pairs[a, b] = ((seen[a, b] - e * mask[1:]) * w).sum()
        grad[k:] = pairs.ravel()
        grad -= l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:k].tolist(), theta[k:].reshape(2, 2).tolist())


def learn(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_lines: int = FIT_LINES) -> Field:
    """Fit on a sample of the labelled documents; only features of at most fit_docs x fit_lines lines reach the driver."""
    lab = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    picked = lab.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(fit_docs).select("doc_id", "quality")
    k = len(FEATURES)

    def featured(batches):
        for b in batches:
            ids, labels_, flat = [], [], []
            for doc_id, text, quality in zip(*(lines_into(b, c) for c in ("doc_id", "text", "quality")), strict=True):
                ids.append(doc_id)
                labels_.append(int(quality))
                x = line_features(text.encode().split(b"\n"))
                at = zlib.crc32(str(doc_id).encode()) % max(1, len(x) - fit_lines + 1)
                flat.append(x[at : at + fit_lines].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels_, pa.int32()), pa.array(flat, pa.list_(pa.float64()))], names=["doc_id", "quality", "flat"])

    # at most fit_docs rows of two numbers are broadcast
    rows = texts(docs).join(F.broadcast(picked), "doc_id").mapInArrow(featured, "doc_id long, quality int, flat array<double>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality, len(r.flat), r.flat))
    return fit([(np.asarray(r.flat).reshape(-1, k), r.quality) for r in rows])


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three words that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hit = np.zeros(len(words), bool)
    for i, w in enumerate(windows):
        if counts[w] > 1:
            hit[i : i + 3] = True
    return int(hit.sum())


VERDICT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def judge(text: str, field: Field, min_content: float = MIN_CONTENT) -> tuple:
    data = text.encode()
    words = data.split()
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    lines = data.split(b"\n")
    seen: set[bytes] = set()
    dup = 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    repeat = repeated_words(words)
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    x = line_features(lines)
    marks = viterbi((x @ np.asarray(field.unary)).tolist(), field.trans)
    sizes = [len(b"".join(line.split()).translate(None, LATER)) for line in lines]
    total = sum(sizes)
    share = sum(n for n, m in zip(sizes, marks, strict=True) if m) / total if total else 0.0
    return len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), dup, repeat, failed, share, not failed and share >= min_content


def verdicts(docs: DataFrame, field: Field, min_content: float = MIN_CONTENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, by a scan without a shuffle."""

    def score(batches):
        names = [c.split()[0] for c in VERDICT.split(", ")]
        for b in batches:
            rows = [(i, *judge(t, field, min_content)) for i, t in zip(lines_into(b, "doc_id"), lines_into(b, "text"), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    return texts(docs, id_col, text_col).mapInArrow(score, VERDICT)


def filtered(docs: DataFrame, field: Field, min_content: float = MIN_CONTENT, text_col: str = "text") -> DataFrame:
    """The kept rows of docs, with all of their columns."""
    at = docs.columns.index(text_col)

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array([judge(t or "", field, min_content)[-1] for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return verdicts(docs, learn(docs, table(spark, sf_dir, "labels")))
