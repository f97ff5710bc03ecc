"""Quality classifier from weak labels: labellers, expectation-maximisation, a hashed linear scorer.

Overlapping heuristics vote on each document: 1, 0 or no vote. The votes are counted by
pattern over all documents (at most three to the number of labellers rows), and
expectation-maximisation on those counts estimates each labeller's votes in either class
and the share of the class, without any true label. One labeller of abuse knows words
that a bounded sample of true labels shows to be abusive, language by language
(:func:`learn_words`), since the fixed lists are English; it is weighed as the others are.
Posteriors of a bounded, documented
sample of documents train a logistic scorer on hashed words and binned measures, which
then scores every whole text. The chance of abuse is the scorer's or that by the
document's own votes, whichever is more, so that length dilutes no listed word.

Two such models run side by side, for low quality and for abuse. Null and empty texts
have no words; heuristics that need words then have no vote. Repeated rows and ids are
scored each by itself; null ids are scored too, and never train. An empty table gives no
rows. Labels with a null, of unknown documents or contradicting each other teach no words;
a document without a language is of one of its own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.llm import _store
from heronlake.llm import _words as W
from heronlake.llm.quality_rules import MEASURES, measure

SAMPLE_DOCS = 6_000  # the most documents that the scorers are trained on
SAMPLE_LABELS = 4_000  # the most labelled documents of a language that words are learnt from, but for chance
LEAST_DOCS, LEAST_RATIO, LEAST_G = 3, 20.0, 15.0  # a learnt word's abusive documents, how much commoner it is in these, and its log-likelihood ratio
FEATURE_BITS = 20
#: Words of abuse, and words that belittle.
ABUSE = "idiot idiots moron morons scum trash loser losers clown clowns imbecile bastard bastards cretin vermin filth garbage fool fools jerk dumbass".split()
BELITTLE = "pathetic worthless disgusting stupid dumb hateful ugly useless despicable repulsive vile sickening brainless".split()
BINNED = {"symbols": ("n_symbols", "n_words"), "repeated": ("n_repeat_words", "n_words"), "lines": ("n_dup_lines", "n_lines"), "length": ("word_chars", "n_words"), "capitals": ("n_upper", "n_chars"), "digits": ("n_digits", "n_chars"), "distinct": ("n_distinct_words", "n_words")}


def per_mille(over: str, under: str) -> Column:
    return F.expr(f"(1000 * {over}) div greatest({under}, 1)")


def _vote(bad: Column, good: Column) -> Column:
    """1 where the first holds, 0 where the second does, else no vote (2)."""
    return F.when(bad, 1).when(good, 0).otherwise(2)


def quality_votes() -> dict[str, Column]:
    """Detectors of one kind of junk, which vote 1 or not at all, and two that judge the whole and overlap with them."""
    some, n = F.col("n_words") > 0, F.col("n_words")
    symbols, again, lines, length, capitals, digits = (per_mille(*BINNED[k]) for k in ("symbols", "repeated", "lines", "length", "capitals", "digits"))
    distinct = per_mille("n_distinct_words", "n_words")
    no = F.lit(False)
    odd = (symbols >= 100) | (again > 500) | (capitals > 300) | ((n >= 40) & (distinct < 250)) | (digits > 300)
    return {
        "symbols": _vote(some & (symbols >= 150), no),
        "marks": _vote(some & (per_mille("n_symbols", "n_chars") >= 25), no),
        "repeated": _vote(some & (again > 500), no),
        "distinct": _vote((n >= 40) & (distinct < 250), no),
        "lines": _vote((F.col("n_lines") > 3) & (lines > 500), no),
        "capitals": _vote(some & (capitals > 300), no),
        "length": _vote(some & ((length < 2500) | (length > 11000)), length.between(3500, 8500) & ~odd),
        "prose": _vote(odd, (n >= 20) & (symbols < 40) & (again < 200) & (capitals < 150)),
        "short": _vote(n < 10, (n >= 50) & ~odd),
    }


def abuse_votes() -> dict[str, Column]:
    total = F.col("n_marked")
    no = F.lit(False)
    return {
        "abuse": _vote(F.col("n_abuse") > 0, no),
        "belittle": _vote(F.col("n_belittle") > 0, no),
        "learnt": _vote(F.col("n_learnt") >= 2, total == 0),
        "dense": _vote((total > 0) & (1000 * total >= 3 * F.col("n_words")), total == 0),
        "often": _vote(total >= 2, total == 0),
    }


@dataclass(frozen=True)
class Model:
    share: float
    chance: np.ndarray  # [class, labeller, vote]

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Of class 1, for rows of votes."""
        logs = np.log([1 - self.share, self.share]) + sum(np.log(self.chance[:, j, patterns[:, j]].T) for j in range(patterns.shape[1])) if len(patterns) else np.zeros((0, 2))
        top = logs.max(axis=1, keepdims=True)
        p = np.exp(logs - top)
        return p[:, 1] / p.sum(axis=1)


def expectation_maximisation(patterns: np.ndarray, n: np.ndarray, rounds: int = 200, prior: float = 1.0) -> Model:
    """``patterns``: distinct rows of votes (0, 1, 2); ``n``: how often each occurs. Starts from the vote shares, so that class 1 is what votes of 1 mean."""
    ones, zeros = (patterns == 1).sum(axis=1), (patterns == 0).sum(axis=1)
    q = (ones + 0.25) / (ones + zeros + 1.0)
    model = Model(0.5, np.full((2, patterns.shape[1], 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack([n * (1 - q), n * q])
        share = float(np.clip((weight[1].sum() + prior) / (n.sum() + 2 * prior), 1e-6, 1 - 1e-6))
        chance = np.stack([np.stack([np.bincount(patterns[:, j], weights=w, minlength=3) for j in range(patterns.shape[1])]) for w in weight]) + prior
        model = Model(share, chance / chance.sum(axis=2, keepdims=True))
        new = model.posterior(patterns)
        if np.abs(new - q).max(initial=0) < 1e-9:
            break
        q = new
    return model


def _bare(w: W.Words) -> np.ndarray:
    """Hashes of words without a mark at their end."""
    mark = np.isin(w.data[np.maximum(w.end - 1, 0)], np.frombuffer(b".,;:!?", np.uint8)) & (w.end - w.start > 1) if len(w.end) else np.zeros(0, bool)
    return w.hashes(w.start, w.end - mark)


def _hashed(listed: list[str]) -> np.ndarray:
    w = W.words(pa.array([" ".join(listed)]))
    return w.hashes(w.start, w.end)


def _lang(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")


def learn_words(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_LABELS) -> dict[str, np.ndarray]:
    """By language, hashes of the words that mark abuse in a sample of about ``most`` labelled documents (all, if there are fewer)."""
    told = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").select("doc_id", "toxic")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _lang(docs).alias("lang"), "text")
    known = texts.select("doc_id", "lang").join(told, "doc_id")
    share = F.least(F.lit(1 << 20), F.floor(F.lit(most << 20) / F.col("n")))
    sampled = known.join(F.broadcast(known.groupBy("lang").agg(F.count("*").alias("n"))), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1 << 20)) < share)
    texts = texts.join(F.broadcast(sampled.select("doc_id", "toxic").distinct()), "doc_id").select("lang", "toxic", "text")  # some ``most`` rows a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                w = W.words(part.column("text"), lower=True)
                got = pa.table({"doc": np.concatenate([w.doc, np.arange(w.n_docs)]), "word": np.concatenate([_bare(w).view(np.int64), np.zeros(w.n_docs, np.int64)])}).group_by(["doc", "word"]).aggregate([])
                rows = got.column("doc").combine_chunks()
                yield pa.RecordBatch.from_arrays([part.column("lang").take(rows), part.column("toxic").take(rows).cast(pa.int32()), got.column("word").combine_chunks()], names=["lang", "toxic", "word"])

    # Word 0 is every document's own.
    counts = texts.mapInArrow(run, "lang string, toxic int, word long").groupBy("lang", "word").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    got = counts.join(F.broadcast(counts.where("word = 0").select("lang", F.col("a").alias("all_a"), F.col("b").alias("all_b"))), "lang").where((F.col("word") != 0) & (F.col("a") >= LEAST_DOCS))
    rate = (F.col("a") + F.col("b")) / (F.col("all_a") + F.col("all_b"))
    likely = lambda k, n: k * F.log(k / (n * rate))
    g = 2 * (likely(F.col("a"), F.col("all_a")) + F.when(F.col("b") > 0, likely(F.col("b"), F.col("all_b"))).otherwise(0.0))
    ratio = ((F.col("a") + 0.5) / (F.col("all_a") + 1)) / ((F.col("b") + 0.5) / (F.col("all_b") + 1))
    got = got.where((ratio >= LEAST_RATIO) & (g >= LEAST_G)).select("lang", "word").toPandas()
    return {k: np.sort(v["word"].to_numpy(np.int64)).view(W.U) for k, v in got.groupby("lang")}


def features(texts: pa.Array, got: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed distinct words and binned measures: index and document of each, and each document's number of words among them."""
    w = W.words(texts, lower=True)
    index = (_bare(w) >> W.U(64 - FEATURE_BITS)).astype(np.int64)
    key = np.unique(w.doc.astype(np.int64) << FEATURE_BITS | index)
    doc, index = key >> FEATURE_BITS, key & ((1 << FEATURE_BITS) - 1)
    n = np.bincount(doc, minlength=w.n_docs)
    bins = []
    for i, (over, under) in enumerate(BINNED.values()):
        level = np.log2(1.0 + 1000 * got[over] / np.maximum(got[under], 1)).astype(np.int64)
        bins.append(np.uint64(1_000_003) * W.U(i + 1) + level.astype(W.U))
    for i, name in enumerate(_COUNTS):
        bins.append(np.uint64(1_000_003) * W.U(len(BINNED) + i + 1) + np.log2(1.0 + got[name]).astype(W.U))
    extra = (W.mix(np.concatenate(bins), 31) >> W.U(64 - FEATURE_BITS)).astype(np.int64)
    return np.concatenate([index, extra]), np.concatenate([doc, np.tile(np.arange(w.n_docs), len(bins))]), n


def _values(index: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Words share a length of two; each binned measure counts one."""
    out = np.ones(len(index))
    words = int(n.sum())
    out[:words] = 2.0 / np.sqrt(np.maximum(n, 1))[doc[:words]]
    return out


def train(index: np.ndarray, doc: np.ndarray, value: np.ndarray, target: np.ndarray, steps: int = 150, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch adaptive steps; both classes weigh alike."""
    weight, bias, size = np.zeros(1 << FEATURE_BITS), 0.0, len(target)
    if not size:
        return weight, bias
    mass = np.array([max((1 - target).sum(), 1e-9), max(target.sum(), 1e-9)])
    each = ((1 - target) / mass[0] + target / mass[1]) / 2 if min(mass) > 0.5 else np.full(size, 1 / size)
    gathered, gathered_bias = np.full(1 << FEATURE_BITS, 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(doc, weights=weight[index] * value, minlength=size) + bias
        err = each * (1 / (1 + np.exp(-z)) - target)
        g = np.bincount(index, weights=err[doc] * value, minlength=len(weight)) + decay * weight
        gathered += g * g
        gathered_bias += err.sum() ** 2
        weight -= rate * g / np.sqrt(gathered)
        bias -= rate * err.sum() / np.sqrt(gathered_bias)
    return weight, float(bias)


_COUNTS = ("n_abuse", "n_belittle", "n_learnt", "n_marked")


def _measured(part: pa.RecordBatch, learnt: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Measures, how many words are in each list, and how many in any."""
    got = measure(part.column("text"))
    w = W.words(part.column("text"), lower=True)
    h = _bare(w)
    of = {"n_abuse": np.isin(h, _hashed(ABUSE)), "n_belittle": np.isin(h, _hashed(BELITTLE)), "n_learnt": np.zeros(len(h), bool)}
    for lang in part.column("lang").unique().to_pylist() if learnt else []:
        if lang in learnt:
            own = np.asarray(pc.equal(part.column("lang"), lang))[w.doc]
            of["n_learnt"][own] = np.isin(h[own], learnt[lang])
    of["n_marked"] = of["n_abuse"] | of["n_belittle"] | of["n_learnt"]
    return got | {k: np.bincount(w.doc[v], minlength=w.n_docs) for k, v in of.items()}


def _counted(docs: DataFrame, learnt: dict[str, np.ndarray]) -> DataFrame:
    names = (*MEASURES, *_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                got = _measured(part, learnt)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(got[m], pa.int64()) for m in names)], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _lang(docs).alias("lang"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in names))


def fit(docs: DataFrame, learnt: dict[str, np.ndarray], most: int = SAMPLE_DOCS) -> tuple[dict[str, Model], list[tuple[np.ndarray, float]]]:
    """The label models by task, and a scorer for each."""
    tasks = {"low": quality_votes(), "abusive": abuse_votes()}
    table, path = _store.kept_table(_counted(docs, learnt), "measures")
    models = {}
    for task, votes in tasks.items():
        rows = table.groupBy(*(v.alias(k) for k, v in votes.items())).agg(F.count("*").alias("n")).toPandas().sort_values(list(votes))  # one row a pattern
        models[task] = expectation_maximisation(rows[list(votes)].to_numpy(np.int64), rows["n"].to_numpy(np.float64))
    n = table.where("doc_id IS NOT NULL").count()
    share = min(1 << 20, (most << 20) // max(n, 1))
    pick = F.pmod(F.xxhash64("doc_id", F.lit("weak")), F.lit(1 << 20)) < share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                got = _measured(part, learnt)
                index, doc, count = features(part.column("text"), got)
                order = np.argsort(doc, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))])
                values = _values(index, doc, count)[order]
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (index[order].astype(np.int32), values)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists, *(pa.array(got[m], pa.int64()) for m in (*MEASURES, *_COUNTS))], names=["doc_id", "index", "value", *MEASURES, *_COUNTS])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _lang(docs).alias("lang"), "text").where(F.col("doc_id").isNotNull()).where(pick)
    sample = picked.mapInArrow(run, "doc_id long, index array<int>, value array<double>, " + ", ".join(f"{m} long" for m in (*MEASURES, *_COUNTS)))
    got = sample.select("doc_id", "index", "value", *(v.alias(f"{t}_{k}") for t, votes in tasks.items() for k, v in votes.items())).toPandas().sort_values("doc_id", ignore_index=True)
    _store.drop(docs.sparkSession, path)
    sizes = got["index"].map(len).to_numpy(np.int64) if len(got) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(got)), sizes)
    index = np.concatenate([*got["index"], np.zeros(0, np.int32)]).astype(np.int64)
    value = np.concatenate([*got["value"], np.zeros(0)])
    return models, [train(index, doc, value, models[t].posterior(got[[f"{t}_{k}" for k in votes]].to_numpy(np.int64))) for t, votes in tasks.items()]


def _chance(model: Model, votes: dict[str, Column]) -> Column:
    """A document's posterior of class 1 by its own votes, as :meth:`Model.posterior` has it."""
    logs = np.log(model.chance[1] / model.chance[0])
    total = sum((F.get(F.array(*(F.lit(float(x)) for x in logs[j])), v) for j, v in enumerate(votes.values())), F.lit(float(np.log(model.share / (1 - model.share)))))
    return 1 / (1 + F.exp(-total))


def digest(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``doc_id, quality_score, quality, abuse_score, toxic, kept`` of every row: chances of good quality and of abuse, and the verdicts at one half."""
    learnt = learn_words(docs, labels) if labels is not None else {}
    models, scorers = fit(docs, learnt)
    sent = docs.sparkSession.sparkContext.broadcast([(w.astype(np.float32), b) for w, b in scorers])
    names = (*MEASURES, *_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                got = _measured(part, learnt)
                index, doc, n = features(part.column("text"), got)
                value = _values(index, doc, n)
                out = [1 / (1 + np.exp(-(np.bincount(doc, weights=w[index] * value, minlength=part.num_rows) + b))) for w, b in sent.value]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x) for x in out), *(pa.array(got[m], pa.int64()) for m in names)], names=["doc_id", "low", "abusive", *names])

    rows = docs.select("doc_id", _lang(docs).alias("lang"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, low double, abusive double, " + ", ".join(f"{m} long" for m in names))
    rows = rows.select("doc_id", "low", "abusive", _chance(models["abusive"], abuse_votes()).alias("voted"))
    rows = rows.select("doc_id", (1 - F.col("low")).alias("quality_score"), F.greatest("abusive", "voted").alias("abuse_score"))
    good, toxic = F.col("quality_score") >= 0.5, F.col("abuse_score") >= 0.5
    return rows.select("doc_id", "quality_score", good.cast("int").alias("quality"), "abuse_score", toxic.cast("int").alias("toxic"), (good & ~toxic).alias("kept"))
