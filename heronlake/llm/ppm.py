"""Language-model scores by prediction by partial matching over a byte-context trie.

A text is its lower-cased words, each followed by a space, then an end symbol (byte 255,
which UTF-8 never has); the score is log10 of that sequence's probability. Counts of all
:data:`ORDER`-byte contexts with their next byte are summed over the training documents;
shorter contexts are sums of these. The model keeps every context, in tables that grow
with the corpus.

In a context, symbols seen get their counts less a half, and the escape half the number
of distinct symbols, over the total. What escapes goes to the next shorter context with
the symbols already seen excluded, down to equal chances. A symbol seen in a context was
seen in all shorter ones, so what a context excludes needs only its own and its parent's
counts. All of this is worked out once for each gram (a context of :data:`ORDER` bytes and
its symbol), so that scoring adds.

Costs meet the documents' grams in two ways: for each of :data:`SLOTS` hash slots the
:data:`WAYS` commonest grams are sent to all tasks, and other grams are joined by key;
those never seen in training go down the shorter contexts, once each. The base score
counts whole tokens; these meet theirs likewise, with one token a slot.

Null and empty texts are the end alone. Rows are scored each by itself, repeated ids
too; a null id trains. Without training documents every symbol is equally likely and no
token is known. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.llm import _store
from heronlake.llm import _words as W

ORDER = 5
SLOTS, WAYS = 1 << 20, 2
SHALLOW = 2  # contexts so short are sent to all tasks
END, GAP, PAD = 255, 32, 0
HELD_OUT = 2, 7  # remainder and divisor
_MERGE = 3_000_000  # counts that a task holds before it sums them


def held_out(doc_id: Column) -> Column:
    rest, of = HELD_OUT
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == rest, F.lit(False))


def stream(w: W.Words, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, ``order`` pads before each; where each text's own symbols start (one more than there are texts)."""
    lens, n = w.end - w.start, w.count()
    per = np.bincount(w.doc, weights=lens + 1, minlength=w.n_docs).astype(np.int64) + order + 1
    first = np.concatenate([[0], np.cumsum(per)])
    out = np.full(first[-1], PAD, np.uint8)
    before = np.concatenate([[0], np.cumsum(lens + 1)])  # symbols of words before each word
    at = before[:-1] + (w.doc + 1) * order + w.doc
    inside = w.data[w.inside]
    moved = np.repeat(at - np.concatenate([[0], np.cumsum(lens)])[:-1], lens)
    out[np.arange(len(inside)) + moved] = inside
    out[at + lens] = GAP
    out[first[1:] - 1] = END
    return out, first


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


class _Sums:
    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(_counted(keys))
        self.size += len(self.parts[-1][0])
        if self.size > _MERGE:
            self.parts = [self.total()]
            self.size = max(0, len(self.parts[0][0]) - _MERGE // 2)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return _sum(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))


def counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``kind, key, n``: kind 0 counts tokens by hash, kind 1 contexts of ``order`` bytes with the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(), _Sums()
        for batch in batches:
            for part in W.slices(batch, "text"):
                w = W.words(part.column("text"), lower=True)
                sums[0].add(w.hashes(w.start, w.end))
                sums[1].add(_grams(*stream(w, order), order))
        for kind, s in enumerate(sums):
            if s.parts:
                keys, n = s.total()
                for a in range(0, len(keys), 100_000):
                    k = keys[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(n[a : a + 100_000], pa.int64())], names=["kind", "key", "n"])

    return docs.select("text").mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _grams(s: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
    """Each own symbol of the texts of a :func:`stream`, with the ``order`` before it."""
    own = np.ones(len(s), bool)
    for k in range(order):
        own[first[:-1] + k] = False
    wide = s.astype(W.U)
    gram = wide.copy()
    for k in range(1, order + 1):
        gram[k:] |= wide[:-k] << W.U(8 * k)
    return gram[own]


class Trie:
    """The model of small tables in one process, which the tables of :func:`train` equal.

    Contexts as nodes (0 is the empty one), extended by older bytes; ``cost[node, symbol]`` is log10 of its probability.
    """

    def __init__(self, depth: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray):
        """A row for each kept context and symbol seen in it."""
        used = np.unique(np.concatenate([symbol, context.astype(W.U).view(np.uint8).reshape(-1, 8)[:, :ORDER].ravel(), [END, GAP, PAD]])).astype(np.int64)
        self.of = np.full(256, len(used), np.int64)  # class of a byte; the last class is all other bytes
        self.of[used] = np.arange(len(used))
        self.width = len(used) + 1
        others = 256 - len(used)
        node_of = {(0, 0): 0}
        order = np.lexsort((context, depth))
        depth, context, symbol, n = depth[order], context[order], self.of[symbol[order]], n[order]
        edge = np.flatnonzero(np.concatenate([[True], (depth[1:] != depth[:-1]) | (context[1:] != context[:-1])])) if len(depth) else np.zeros(0, np.int64)
        size = max(1, len(edge))
        self.child = np.full((size, self.width), -1, np.int32)
        chance = np.full((size, self.width), 1 / 256)
        chance[:, -1] = others / 256
        base = chance[0].copy()
        for node, (a, z) in enumerate(zip(edge.tolist(), [*edge.tolist()[1:], len(depth)], strict=False)):
            d, c = int(depth[a]), int(context[a])
            node_of[d, c] = node
            if d:
                oldest = c >> (8 * (d - 1))
                parent = node_of[d - 1, c & ((1 << (8 * (d - 1))) - 1)]
                self.child[parent, self.of[oldest]] = node
                below = chance[parent]
            else:
                below = base
            seen, k = symbol[a:z], n[a:z]
            total = int(k.sum())
            escape = len(seen) / (2 * total)
            left = 1 - below[seen].sum()
            chance[node] = below * (escape / left) if left > 1e-12 else 0.0
            chance[node, seen] = (k - 0.5) / total if left > 1e-12 else k / total
        with np.errstate(divide="ignore"):
            self.cost = np.log10(np.maximum(chance, 1e-300))
        self.cost[:, -1] -= np.log10(max(others, 1))  # one of the other bytes
        self.cost = self.cost.astype(np.float32)

    def scores(self, s: np.ndarray, first: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Of each text of a :func:`stream`."""
        x = self.of[s]
        node = np.zeros(len(s), np.int64)
        alive = np.arange(len(s))
        flat = self.child.ravel()
        for k in range(1, order + 1):
            alive = alive[alive >= k]
            nxt = flat[node[alive] * self.width + x[alive - k]]
            ok = nxt >= 0
            alive = alive[ok]
            node[alive] = nxt[ok]
        cost = self.cost.ravel()[node * self.width + x].astype(np.float64)
        for k in range(order):
            cost[first[:-1] + k] = 0.0
        run = np.concatenate([[0.0], np.cumsum(cost)])
        return run[first[1:]] - run[first[:-1]]


def _context(key: Column, k: int) -> Column:
    return F.shiftrightunsigned(key, 8).bitwiseAND((1 << (8 * k)) - 1)


def train(grams: DataFrame, order: int = ORDER) -> tuple[DataFrame, str]:
    """``depth, context, escape, costs`` of every context, and the path: log10 of the symbols seen in it, and of what an unseen one's chance in the next shorter context is multiplied by."""
    levels = F.array(*(F.struct(F.lit(k).alias("depth"), _context(F.col("key"), k).alias("context")) for k in range(order + 1)))
    rows = grams.select(F.explode(levels).alias("c"), F.col("key").bitwiseAND(255).cast("int").alias("symbol"), "n").groupBy("c.depth", "c.context", "symbol").agg(F.sum("n").alias("n"))
    totals = rows.groupBy("depth", "context").agg(F.sum("n").alias("total"), F.count("*").alias("seen"))
    chances, path = _store.kept_table(rows.join(totals, ["depth", "context"]).select("depth", "context", "symbol", "total", "seen", ((F.col("n") - 0.5) / F.col("total")).alias("chance")), "chances")
    shorter = chances.select((F.col("depth") + 1).alias("depth"), F.col("context").alias("end"), "symbol", F.col("chance").alias("below"))
    mask = F.expr("shiftleft(1L, 8 * greatest(depth - 1, 0)) - 1")
    both = chances.withColumn("end", F.col("context").bitwiseAND(mask)).join(shorter, ["depth", "end", "symbol"], "left")
    model = both.groupBy("depth", "context").agg(
        F.log10(F.first("seen") / (2.0 * F.first("total")) / (1 - F.sum(F.coalesce("below", F.lit(1 / 256))))).alias("escape"), F.map_from_entries(F.collect_list(F.struct("symbol", F.log10("chance").alias("cost")))).alias("costs"),
    )
    model, kept = _store.kept_table(model, "contexts")
    _store.drop(grams.sparkSession, path)
    return model, kept


def unseen_costs(keys: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """``key, cost`` of distinct grams: what each context from the longest down to one with the symbol multiplies."""
    out = keys.select("key", F.col("key").bitwiseAND(255).cast("int").alias("symbol"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("cost"))
    for k in range(order, -1, -1):
        level = model.where(F.col("depth") == k).select(F.col("context").alias("at"), "escape", "costs")
        out = out.withColumn("at", _context(F.col("key"), k)).join(F.broadcast(level) if k <= SHALLOW else level, "at", "left")
        here = F.try_element_at("costs", F.col("symbol"))
        out = out.select("key", "symbol", F.when(F.col("cost").isNull() & here.isNull(), F.col("sum") + F.coalesce("escape", F.lit(0.0))).otherwise(F.col("sum")).alias("sum"), F.coalesce("cost", F.col("sum") + here).alias("cost"))
    return out.select("key", F.coalesce("cost", F.col("sum") - float(np.log10(256))).alias("cost"))


def _slot(key):
    """Of a gram, in numpy and in Spark alike: shifts that spread the low bits of its six bytes."""
    if isinstance(key, Column):
        return key.bitwiseXOR(F.shiftrightunsigned(key, 13)).bitwiseXOR(F.shiftrightunsigned(key, 27)).bitwiseAND(SLOTS - 1)
    return ((key ^ (key >> W.U(13)) ^ (key >> W.U(27))) & W.U(SLOTS - 1)).astype(np.int64)


def _commonest(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and costs of the :data:`WAYS` commonest of ``key, cost, n`` of each slot, by way and slot; key 0 is no gram's."""
    best = F.slice(F.sort_array(F.collect_list(F.struct("n", "key", "cost")), asc=False), 1, WAYS)
    common = grams.groupBy(_slot(F.col("key")).alias("slot")).agg(best.alias("t")).select("slot", F.posexplode("t").alias("way", "t")).select("slot", "way", "t.key", "t.cost").toArrow()  # at most WAYS * SLOTS rows
    at = common.column("way").to_numpy(), common.column("slot").to_numpy()
    keys, costs = np.zeros((WAYS, SLOTS), W.U), np.zeros((WAYS, SLOTS))
    keys[at], costs[at] = common.column("key").to_numpy().view(W.U), common.column("cost").to_numpy()
    return keys, costs


def _known_costs(gram: np.ndarray, keys: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of grams (0 where they are not in the table), and which are."""
    place = _slot(gram)
    cost, hit = np.zeros(len(gram)), np.zeros(len(gram), bool)
    for way in range(len(keys)):
        met = keys[way][place] == gram
        cost[met], hit = costs[way][place[met]], hit | met
    return cost, hit


def _lists(doc: np.ndarray, n_docs: int, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))]), pa.int32()), pa.array(values.view(np.int64)))


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark = docs.sparkSession
    learnt = docs.where(~held_out(F.col("doc_id")))
    table, _ = _store.kept_table(counts(learnt), "counts")
    n_docs = learnt.count()
    tokens = table.where("kind = 0").select("key", "n")
    n_words, distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, vocabulary = n_words + n_docs, distinct + (n_docs > 0)
    slot = F.shiftrightunsigned("key", 64 - SLOTS.bit_length() + 1)
    common = tokens.groupBy(slot.alias("slot")).agg(F.max_by(F.struct("key", "n"), F.struct("n", "key")).alias("t")).select("slot", "t.key", "t.n").toArrow()  # at most SLOTS rows
    keys, ns = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    at = common.column("slot").to_numpy()
    keys[at], ns[at] = common.column("key").to_numpy(), common.column("n").to_numpy()
    grams = table.where("kind = 1").select("key", "n")
    contexts, contexts_at = train(grams)
    whole = contexts.where(F.col("depth") == ORDER).select("context", F.explode("costs").alias("symbol", "cost")).select(F.shiftleft("context", 8).bitwiseOR(F.col("symbol").cast("long")).alias("key"), "cost")
    whole, whole_at = _store.kept_table(grams.join(whole, "key"), "grams")
    model = spark.sparkContext.broadcast((keys, ns, *_commonest(whole)))
    end = float(np.log10(n_docs + 1.0)), int(n_docs > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, ns, *common = model.value
        at = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            for part in W.slices(batch, "text"):
                w = W.words(part.column("text"), lower=True)
                h = w.hashes(w.start, w.end)
                place = (h >> W.U(64 - SLOTS.bit_length() + 1)).astype(np.int64)
                hit = (keys[place] == h.view(np.int64)) & (ns[place] > 0)
                got = np.where(hit, np.log10(ns[place] + 1.0), 0.0)
                base = np.bincount(w.doc, weights=got, minlength=w.n_docs) + end[0]
                known = np.bincount(w.doc[hit], minlength=w.n_docs) + end[1]
                s, first = stream(w)
                gram = _grams(s, first, ORDER)
                cost, met = _known_costs(gram, *common)
                of = np.repeat(np.arange(w.n_docs), np.diff(first) - ORDER)
                score = np.bincount(of, weights=cost, minlength=w.n_docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(at, at + w.n_docs)), part.column("doc_id"), pa.array(w.count() + 1), pa.array(known), pa.array(base), pa.array(score), _lists(w.doc[~hit], w.n_docs, h[~hit]), _lists(of[~met], w.n_docs, gram[~met])],
                    names=["row", "doc_id", "n_tokens", "known", "base", "score", "cold", "cold_grams"],
                )
                at += w.n_docs

    scored = docs.select("doc_id", "text").mapInArrow(run, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, known long, base double, score double, cold array<long>, cold_grams array<long>")
    scored, _ = _store.kept_table(scored, "scored")
    asked = scored.select("row", F.explode("cold_grams").alias("key"))
    new = asked.select("key").distinct().join(whole, "key", "left_anti")
    new, _ = _store.kept_table(unseen_costs(new, contexts), "unseen")
    more = asked.join(whole.select("key", "cost").unionByName(new), "key").groupBy("row").agg(F.sum("cost").alias("more_score"))
    more, _ = _store.kept_table(more, "more")
    _store.drop(spark, contexts_at, whole_at)
    rare = scored.select("row", F.explode("cold").alias("key")).join(tokens, "key").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count("*").alias("met"))
    return scored.drop("cold", "cold_grams").join(rare, "row", "left").join(more, "row", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(total + vocabulary + 1.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
