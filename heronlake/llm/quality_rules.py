"""Learned decision lists: interpretable quality rules by sequential covering.

Whole texts are measured once (:func:`measures`). Rules are conjunctions of thresholds
on those measures, grown by information gain and pruned on held-back rows
(:func:`learn`), and become one ordered ``CASE`` expression (:func:`verdict`), so that
applying them is a projection.

Nulls and empty texts have no words and measure 0. A row without a usable label (null
id or label, or an id that ``documents`` lacks) teaches nothing; without labels of both
kinds the list is empty and only the base rule decides. Repeated rows are measured each
by itself. Other columns pass through; the names in :data:`MEASURES` replace columns
of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.llm import _store
from heronlake.llm import _words as W

#: Counts over the whole text; the first five are the base measures.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_digits", "n_pipes", "n_distinct_words", "n_short_lines")
SAMPLE_LABELS = 20_000  # the most labelled rows that a list is fitted on
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_LEAD = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point


def _keyed(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return W.mix(h + W.mix(doc.astype(W.U), 7))


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """:data:`MEASURES` of each text."""
    w = W.words(texts)
    n, n_words = w.n_docs, w.count()
    out = {"n_words": n_words, "n_chars": W.per_doc(_LEAD[w.data], w.offsets), "word_chars": W.per_doc(_LEAD[w.data] & w.inside, w.offsets)}
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT)):
        out[name] = W.per_doc(table[w.data], w.offsets)
    out["n_pipes"] = W.per_doc(w.data == 124, w.offsets)

    # Lines run from a document's start or a line feed to the next line feed or the end.
    feeds = np.flatnonzero(w.data == 10)
    starts = np.unique(np.concatenate([w.offsets[:-1][np.diff(w.offsets) > 0], feeds + 1]))
    starts = starts[starts < len(w.data)]
    stops = np.full(len(starts), len(w.data), np.int64)
    if len(starts):
        at = np.searchsorted(feeds, starts)
        stops = np.minimum(np.append(feeds, len(w.data))[at], w.offsets[np.searchsorted(w.offsets, starts, "right")])
    filled = np.concatenate([[0], np.cumsum(w.inside, dtype=np.int64)])
    has = filled[stops] > filled[starts]
    starts, stops = starts[has], stops[has]
    line_doc = np.searchsorted(w.offsets, starts, "right") - 1
    _, first = np.unique(_keyed(w.hashes(starts, stops), line_doc), return_index=True)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_doc[first], minlength=n)
    out["n_short_lines"] = np.bincount(line_doc[stops - starts < 30], minlength=n)

    h = w.hashes(w.start, w.end)
    _, first = np.unique(_keyed(h, w.doc), return_index=True)
    out["n_distinct_words"] = np.bincount(w.doc[first], minlength=n)
    covered = np.zeros(len(h), bool)
    if len(h) >= 3:
        with np.errstate(over="ignore"):
            three = W.mix(h[:-2], 1) + W.mix(h[1:-1], 2) * W.U(3) + W.mix(h[2:], 3) * W.U(5)
        whole = np.flatnonzero(w.doc[:-2] == w.doc[2:])
        keys = _keyed(three[whole], w.doc[whole])
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        again = whole[order[twice]]
        for i in range(3):
            covered[again + i] = True
    out["n_repeat_words"] = np.bincount(w.doc[covered], minlength=n)
    return out


def measures(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with :data:`MEASURES` (long); without the text unless it is to be kept."""
    own = [c for c in docs.columns if c not in MEASURES and (keep_text or c != text)]
    schema = T.StructType([docs.schema[c] for c in own] + [T.StructField(m, T.LongType()) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, text, W.FEW_BYTES):
                got = measure(part.column(text))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in own] + [pa.array(got[m], pa.int64()) for m in MEASURES], names=[*own, *MEASURES])

    return _store.small_batches(docs).select(*dict.fromkeys([*own, text])).mapInArrow(run, schema)


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: What rules test: name and a ratio of two measures per thousand, in whole numbers so that Spark and numpy agree.
RATIOS = {
    "symbols": ("n_symbols", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "repeated": ("n_repeat_words", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "short_lines": ("n_short_lines", "n_lines"),
    "capitals": ("n_upper", "n_chars"),
    "digits": ("n_digits", "n_chars"),
    "pipes": ("n_pipes", "n_words"),
    "distinct": ("n_distinct_words", "n_words"),
}


def feature(name: str) -> Column:
    if name == "n_words":
        return F.col("n_words")
    over, under = RATIOS[name]
    return F.expr(f"(1000 * {over}) div greatest({under}, 1)")


FEATURES = (*RATIOS, "n_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature >= threshold, else feature < threshold
    threshold: int

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return (x[self.feature] >= self.threshold) == self.above

    def column(self) -> Column:
        f = feature(self.feature)
        return f >= self.threshold if self.above else f < self.threshold


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    for c in rule:
        rows = rows & c.holds(x)
    return rows


def _best(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of most information gain over the rows, ties to the first feature and threshold."""
    y, best = bad[rows], (0.0, None)
    p0, n0 = int(y.sum()), int((~y).sum())
    before = np.log2((p0 + 0.5) / (p0 + n0 + 1))
    for name in FEATURES:
        v = x[name][rows]
        order = np.argsort(v, kind="stable")
        v, p = v[order], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] != v[:-1])  # between cut and cut + 1
        if not len(cut):
            continue
        low_p, low_n = p[cut], cut + 1 - p[cut]
        for above, a, b in ((True, p0 - low_p, n0 - low_n), (False, low_p, low_n)):
            gain = a * (np.log2((a + 0.5) / (a + b + 1)) - before)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), Condition(name, above, int((v[cut[k]] + v[cut[k] + 1] + 1) // 2)))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, held: np.ndarray, precision: float = 0.9, most_rules: int = 12, most_conditions: int = 4, least: int = 5) -> list[Rule]:
    """Ordered rules that reject. ``held``: rows that judge pruning and never grow a rule."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules:
        rows, rule = left & ~held, ()
        if not (bad & rows).sum() or not (left & held).any():
            break
        while len(rule) < most_conditions and (rows & ~bad).any():
            _, c = _best(x, bad, rows)
            if c is None:
                break
            rule, rows = (*rule, c), rows & c.holds(x)
        scored = []
        for k in range(len(rule), 0, -1):
            got = _covered(rule[:k], x, left & held)
            p, n = int((got & bad).sum()), int((got & ~bad).sum())
            scored.append(((p - n) / (p + n) if p + n else -1.0, p, n, rule[:k]))
        worth, p, n, rule = max(scored, key=lambda s: (s[0], s[1]), default=(-1, 0, 0, ()))
        grown = _covered(rule, x, left & ~held)
        if p < least or p < precision * (p + n) or (grown & bad).sum() < precision * grown.sum():
            break
        rules.append(rule)
        left &= ~_covered(rule, x, np.ones(len(bad), bool))
    return rules


def verdict(rules: list[Rule], base: Column | None = None) -> Column:
    """The list as one conditional: the base rule first, then each rule in its order, then keep."""
    out = F.when(F.lit(False) if base is None else base, F.lit(False))
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = out.when(test, F.lit(False))
    return out.otherwise(F.lit(True))


def labelled_sample(labels: DataFrame, most: int = SAMPLE_LABELS) -> DataFrame:
    """At most about ``most`` labels (``doc_id``, ``bad``), the same ones at each run, without a sort."""
    ok = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    n = ok.count()
    share = min(1 << 20, (most << 20) // max(n, 1))
    return ok.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("rules")), F.lit(1 << 20)) < share)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_LABELS) -> list[Rule]:
    """Rules from a bounded sample of labelled rows that the base rule passes."""
    known = F.broadcast(labelled_sample(labels, most))  # at most about ``most`` rows
    table = measures(docs.select("doc_id", "text").join(known, "doc_id"))
    got = table.where(~base_failed()).select("bad", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("held")), F.lit(3)).alias("part"), *(feature(f).alias(f"f_{f}") for f in FEATURES)).toPandas()
    got = got.sort_values(list(got.columns), ignore_index=True)
    return learn({f: got[f"f_{f}"].to_numpy(np.int64) for f in FEATURES}, got["bad"].to_numpy(bool), got["part"].to_numpy() == 0)


def describe(rules: list[Rule]) -> str:
    """The list for people to read."""
    return "\n".join("reject if " + " and ".join(f"{c.feature} {'>=' if c.above else '<'} {c.threshold}" for c in r) for r in rules) + "\nelse keep"


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rules = fit(docs, labels)
    return measures(docs.select("doc_id", "text")).select(
        "doc_id", *MEASURES[:5], base_failed().alias("base_failed"), verdict(rules, base_failed()).alias("kept"), *MEASURES[5:]
    )


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the list keeps."""
    rules = fit(docs, labels)
    names = docs.columns
    held = docs.toDF(*(f"c{i}" for i in range(len(names))))  # so that no column clashes with a measure
    return measures(held, f"c{names.index('text')}", keep_text=True).where(verdict(rules, base_failed())).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
