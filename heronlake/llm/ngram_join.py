"""N-gram Jaccard join by tries over globally ordered n-gram sets.

Shingles are ordered rarest first (frequencies from a fixed-size table of hash buckets
counted over all documents), so that two sets over the threshold share one of their
first ``n - ceil(t n) + 1`` shingles. A shared shingle is a branch of the trie: the sets
below it are kept as the next shingles in order, walked together while they agree, and
cut where the matches so far and the remaining lengths cannot reach the required
overlap. What is left is checked on the whole sets.

Equal sets are one class from the start. In each branch, all sets are first checked
against the branch's hub (the set with the commonest content), which joins large groups
of copies without forming their pairs; the trie then looks only for links between sets
that are not connected yet. No link between different components is lost, and the
components are those of all links. Branches with many sets are dealt in blocks.

Nulls and texts without words have the empty set and link with nothing. Texts with fewer
words than a shingle are one shingle. Rows with one id are one document, which links as
any of its texts does; a null id gets a null component. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.llm import _components, _store
from heronlake.llm import _words as W

BUCKET_BITS, SLICE_BITS = 20, 12  # of the frequency table, and of the pieces in which it is summed
TAIL = 8  # shingles kept beyond a prefix
PATH = 24  # shingles of a set that the trie holds below a branch
BLOCK = 1024  # sets of a branch that are walked together
SKETCH_BITS = 8  # of the hash, for counts that bound an overlap before whole sets are compared
BROADCAST_IDS = 1_000_000  # ids or pairs (8 bytes an id) that may be sent to all executors


def _sets(part: pa.RecordBatch, text: str, k: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    w = W.words(part.column(text), lower=True)
    h, doc = W.shingles(w, k)
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=w.n_docs))]).tolist()
    for a, z in zip(ends[:-1], ends[1:], strict=True):
        yield np.unique(h[a:z]) if z > a else h[a:z]


def frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """How many documents have a shingle of each hash bucket: a table of fixed size."""
    width = 1 << (BUCKET_BITS - SLICE_BITS)
    schema = "slice int, counts binary"

    def rows(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["slice", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            sets = [s for part in W.slices(batch, "text", W.FEW_BYTES) for s in _sets(part, "text", k)]
            total += np.bincount((np.concatenate([*sets, np.zeros(0, W.U)]) >> W.U(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        if total.any():
            yield rows({i: v for i, v in enumerate(total.reshape(-1, width)) if v.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(v.as_buffer(), np.int64)
        if total:
            yield rows(total)

    out = np.zeros((1 << SLICE_BITS, width), np.int64)
    for r in docs.select("text").mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema).collect():
        out[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def prefixes(docs: DataFrame, freq, k: int, num: int, den: int) -> DataFrame:
    """``doc_id, n, f1, f2`` (a fingerprint of the set), and its first shingles in order, once a task for equal sets."""
    schema = T.StructType.fromDDL("doc_id long, n long, f1 long, f2 long, lead long, p int, tokens array<long>")
    lists = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = freq.value, set()
        for batch in batches:
            for part in W.slices(batch, "text", W.FEW_BYTES):
                n, f1, f2, lead, p, tokens = [], [], [], [], [], []
                for s in _sets(part, "text", k):
                    with np.errstate(over="ignore"):
                        a, b = int(W.mix(s, 21).sum(dtype=W.U)), int(np.bitwise_xor.reduce(W.mix(s, 22))) if len(s) else 0
                    n.append(len(s))
                    f1.append(a)
                    f2.append(b)
                    if not len(s) or (a, b) in seen:
                        lead.append(0), p.append(0), tokens.append(s[:0])
                        continue
                    seen.add((a, b))
                    if len(seen) > 500_000:
                        seen.clear()
                    f = table[(s >> W.U(64 - BUCKET_BITS)).astype(np.int64)]
                    order = np.lexsort((s, f))
                    length = _prefix_length(len(s), num, den)
                    p.append(length)
                    lead.append(int(f[order[0]]))
                    tokens.append(s[order[: length + TAIL]])
                ends = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
                values = pa.array(_signed(np.concatenate([*tokens, np.zeros(0, W.U)])))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(_signed(np.array(f1, W.U))), pa.array(_signed(np.array(f2, W.U))), pa.array(lead, pa.int64()), pa.array(p, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, lists)],
                    names=schema.names,
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _ids(df: DataFrame) -> DataFrame:
    """A table of ids or pairs, marked for broadcast only if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _need(num: int, den: int, a, b):
    """The least overlap of sets of these sizes at the threshold, as a column."""
    return F.ceil(num * (a + b) / F.lit(den + num))


def verified(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, str]:
    """The pairs ``a, b`` whose whole sets reach the threshold.

    Shingles counted by a few bits of their hash bound the overlap; only pairs that pass
    that bound bring their whole sets together.
    """
    schema = "id long, n int, sketch array<short>, grams array<long>"
    wide = 1 << SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", W.FEW_BYTES):
                sets = list(_sets(part, "text", k))
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate([*sets, np.zeros(0, W.U)])
                cell = np.repeat(np.arange(len(sets)), sizes) << SKETCH_BITS | (flat & W.U(wide - 1)).astype(np.int64)
                # A count over the type's range stands for any number.
                counts = np.minimum(np.bincount(cell, minlength=len(sets) << SKETCH_BITS), 32767).astype(np.int16)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * wide, pa.int32()), pa.array(counts)),
                     pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(_signed(flat)))],
                    names=["id", "n", "sketch", "grams"],
                )

    ends = (("a", "x"), ("b", "y"))
    both_ids = lambda p: p.select(F.col("a").alias("id")).union(p.select(F.col("b").alias("id"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(_ids(both_ids(pairs)), "id", "left_semi")
    sets, sets_at = _store.kept_table(texts.mapInArrow(run, schema), "sets")
    close = _ids(pairs)
    for end, other in ends:
        close = close.join(sets.select(F.col("id").alias(end), F.col("n").alias(f"n{other}"), F.col("sketch").alias(other)), end)
    least = F.zip_with("x", "y", lambda p, q: F.least(p, q).cast("int"))
    most = F.when(F.array_max(least) < 32767, F.aggregate(least, F.lit(0), lambda p, q: p + q)).otherwise(F.least("nx", "ny"))
    close, close_at = _store.kept_table(close.where(most >= _need(num, den, F.col("nx"), F.col("ny"))).select("a", "b"), "close")
    grams = sets.join(_ids(both_ids(close)), "id", "left_semi").select("id", "grams")
    links = _ids(close)
    for end, other in ends:
        links = links.join(grams.select(F.col("id").alias(end), F.col("grams").alias(other)), end)
    shared = F.size(F.array_intersect("x", "y"))
    links, links_at = _store.kept_table(links.where(den * shared >= num * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct(), "links")
    _store.drop(docs.sparkSession, sets_at, close_at)
    return links, links_at


def hub_pairs(branches: DataFrame, num: int, den: int) -> DataFrame:
    """Each set with the hubs of its branches among sets of about its length."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num)))
    rows = branches.withColumn("band", band)
    hubs = rows.groupBy("token", "band").agg(F.max_by(F.struct("id", "n", "pos"), F.struct("lead", -F.col("id"))).alias("hub"))
    near = rows.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    got = near.join(hubs, ["token", "band"]).where(F.col("id") != F.col("hub.id"))
    got = got.where(F.least(F.col("n") - F.col("pos"), F.col("hub.n") - F.col("hub.pos")) >= _need(num, den, F.col("n"), F.col("hub.n")))
    return got.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


class _Trie:
    """The sets of one branch, sorted by path; pairs split where their paths do, once each."""

    def __init__(self, rows: list[tuple], num: int, den: int, two: bool = False):
        """With ``two``, only pairs of different sides (a row's last value) are sought."""
        rows.sort(key=lambda r: r[4])
        self.id, self.n, self.left, self.comp, self.side = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2, 3, 5))
        self.path = [r[4] for r in rows]
        self.num, self.den, self.two = num, den, two
        self.found: list[tuple[int, int]] = []

    def need(self, a, b):
        return -(-self.num * (a + b) // (self.den + self.num))

    def walk(self, low: int, high: int, depth: int) -> None:
        """Rows low to high agree on depth shingles below the branch; ``left`` counts those after the branch's own."""
        stack = [(low, high, depth)]
        while stack:
            low, high, depth = stack.pop()
            if high - low < 2 or self.comp[low:high].min() == self.comp[low:high].max() or (self.two and self.side[low:high].min() == self.side[low:high].max()):
                continue  # one set, or all connected already, or of one side
            ends, at = [], low
            while at < high:
                head = self.path[at][depth : depth + 1]
                stop = at + 1
                while head and stop < high and self.path[stop][depth : depth + 1] == head:
                    stop += 1
                if stop - at > 1:
                    stack.append((at, stop, depth + 1))
                ends.append((at, stop, bool(head)))
                at = stop
            for a, z, inner in ends:
                if z < high or not inner:
                    self.across(a, z, high, depth, inner)

    def across(self, a: int, z: int, high: int, depth: int, inner: bool) -> None:
        """Pairs of a subtree with the later ones; its first shingle is in none of those."""
        rest_n, rest_left = self.n[z:high], self.left[z:high] - depth
        if z < high:
            most = 1 + depth + min(int(self.left[a:z].max()) - depth - inner, int(rest_left.max()))
            if most < self.need(int(self.n[a:z].min()), int(rest_n.min())):
                return
        for x in range(a, z):
            bound = 1 + depth + np.minimum(self.left[x] - depth - inner, rest_left)
            ok = (bound >= self.need(self.n[x], rest_n)) & (self.comp[z:high] != self.comp[x])
            if self.two:
                ok &= self.side[z:high] != self.side[x]
            for y in np.flatnonzero(ok) + z:
                self.pair(x, int(y), depth)

    def pair(self, x: int, y: int, depth: int) -> None:
        p, q, i, j = self.path[x], self.path[y], depth, depth
        same, u, v = 1 + depth, int(self.left[x]) - depth, int(self.left[y]) - depth
        while i < len(p) and j < len(q):
            if p[i] == q[j]:
                same, u, v, i, j = same + 1, u - 1, v - 1, i + 1, j + 1
            elif p[i] < q[j]:
                u, i = u - 1, i + 1
            else:
                v, j = v - 1, j + 1
        if same + min(u, v) >= self.need(int(self.n[x]), int(self.n[y])):
            self.found.append((min(self.id[x], self.id[y]), max(self.id[x], self.id[y])))


def trie_pairs(branches: DataFrame, sets: DataFrame, freq, num: int, den: int) -> DataFrame:
    """Pairs of unconnected sets that a branch's trie cannot rule out. ``branches``: ``token, id, n, pos, comp``; ``sets``: ``id, tokens``."""
    # A branch's largest component meets the others, which alone meet each other too: a hot branch that is all but connected is dealt once.
    parts = branches.groupBy("token", "comp").agg(F.count("*").alias("of"))
    many = parts.groupBy("token").agg(F.sum("of").alias("rows"), F.max("of").alias("most"), F.max_by("comp", F.struct("of", "comp")).alias("top")).where("rows != most")
    rows = branches.join(many, "token").join(sets.select("id", "tokens"), "id").withColumn("path", F.slice("tokens", F.col("pos") + 2, F.lit(PATH))).drop("tokens")
    split = F.col("rows") > BLOCK
    rows = rows.withColumns({"main": split & (F.col("comp") == F.col("top")), "others": F.when(split, F.col("rows") - F.col("most")).otherwise(F.col("rows"))})
    own, far = F.ceil(F.col("others") / BLOCK).cast("int"), F.ceil(F.col("most") / BLOCK).cast("int")
    rows = rows.withColumns({"own": own, "far": F.when(split, far).otherwise(0)}).withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("main"), F.col("far")).otherwise(F.col("own"))).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    among = F.transform(upto(F.col("own")), lambda o: F.struct(F.lit(False).alias("apart"), F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    across = F.transform(upto(F.col("far")), lambda o: F.struct(F.lit(True).alias("apart"), o.alias("i"), F.col("block").alias("j")))
    main = F.transform(upto(F.col("own")), lambda o: F.struct(F.lit(True).alias("apart"), F.col("block").alias("i"), o.alias("j")))
    rows = rows.withColumn("to", F.explode(F.when(F.col("main"), main).otherwise(F.concat(among, across))))
    rows = rows.select("token", "to.apart", "to.i", "to.j", "block", "main", "id", "n", "pos", "comp", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = freq.value

        def each():
            for b in batches:
                lists = b.column("path")
                flat = np.asarray(lists.values).view(W.U)
                order = list(zip(table[(flat >> W.U(64 - BUCKET_BITS)).astype(np.int64)].tolist(), flat.tolist(), strict=True))
                ends = np.asarray(lists.offsets).tolist()
                cols = [b.column(c).to_pylist() for c in ("token", "apart", "i", "j", "block", "main", "id", "n", "pos", "comp")]
                for at, (token, apart, i, j, block, main, id_, n, pos, comp) in enumerate(zip(*cols, strict=True)):
                    # Sets that meet elsewhere count as one side here.
                    side = int(main) if apart else block
                    yield (token, apart, i, j), (id_, n, n - pos - 1, comp, order[ends[at] : ends[at + 1]], side)

        done: list[tuple[int, int]] = []
        for (_, apart, i, j), group in groupby(each(), key=lambda r: r[0]):
            got = [r for _, r in group]
            if len(got) < 2:
                continue
            trie = _Trie(got, num, den, apart or i != j)  # pairs of one side are found where it meets itself
            trie.walk(0, len(got), 0)
            done += trie.found
            if len(done) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in done], pa.int64()) for k in (0, 1)], names=["a", "b"])
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in done], pa.int64()) for k in (0, 1)], names=["a", "b"])

    keys = ["token", "apart", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def digest(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row: sets of ``k``-word shingles link at a Jaccard similarity of num/den."""
    spark = _store.small_batches(docs).sparkSession
    freq = spark.sparkContext.broadcast(frequencies(docs, k))
    all_rows, _ = _store.kept_table(prefixes(docs, freq, k, num, den), "prefixes")
    # Classes of equal sets; a class is represented by the least id that brought its shingles.
    classes = all_rows.where("n > 0").groupBy("n", "f1", "f2").agg(F.min(F.when(F.col("p") > 0, F.col("doc_id"))).alias("rep"), F.min("doc_id").alias("least"))
    classes, classes_at = _store.kept_table(classes, "classes")
    sets, sets_at = _store.kept_table(all_rows.where("p > 0").join(classes.select(F.col("rep").alias("doc_id"), "n", "f1", "f2"), ["doc_id", "n", "f1", "f2"], "left_semi").select(F.col("doc_id").alias("id"), "n", "lead", "p", "tokens"), "sets")
    heads = sets.select("id", "n", "lead", F.posexplode(F.slice("tokens", F.lit(1), F.col("p"))).alias("pos", "token"))
    # Of two sets the smaller one has the branch among even fewer first shingles; a branch that none has so early links nothing.
    early = F.col("pos") <= F.col("n") - F.ceil(2 * num * F.col("n") / F.lit(num + den))
    shared = heads.groupBy("token").agg(F.count("*").alias("rows"), F.bool_or(early).alias("early")).where("rows > 1 AND early").select("token")
    branches, branches_at = _store.kept_table(heads.join(shared, "token"), "branches")

    hubs, hubs_at = _store.kept_table(hub_pairs(branches, num, den), "hubs")
    links, links_at = verified(docs, hubs, k, num, den)
    joined, joined_at = _components.components(links)
    known = branches.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    rest, rest_at = _store.kept_table(trie_pairs(known, sets, freq, num, den), "candidates")
    more, more_at = verified(docs, rest, k, num, den)
    same = classes.where("rep != least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    final, _ = _components.components(joined.toDF("a", "b").union(more).union(same))
    _store.drop(spark, sets_at, branches_at, hubs_at, links_at, joined_at, rest_at, more_at)

    to = final.withColumnRenamed("node", "least")
    named = classes.join(to, "least", "left").select("n", "f1", "f2", F.coalesce("component", "least").alias("of_class"))
    # A row with an id of its own follows its class; a repeated id, all its classes.
    out = all_rows.select("doc_id", F.col("n").alias("n_shingles"), "n", "f1", "f2").join(named, ["n", "f1", "f2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id")).alias("component_id"))


def first_of_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, and of the rows that repeat an id one, that with the least text; rows without an id stay."""
    names = digest(docs, k, num, den)
    ids = names.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(F.col("doc_id") != F.col("component_id")).alias("gone"))
    odd, _ = _store.kept_table(ids.where("gone OR n > 1").select(F.col("doc_id").alias("__id"), "gone"), "gone")
    left = docs.join(_ids(odd.select("__id")), docs["doc_id"] == F.col("__id"), "left_anti")
    again = docs.join(_ids(odd.where("NOT gone").select("__id")), docs["doc_id"] == F.col("__id"), "left_semi")
    one = again.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(F.col("text").isNull(), "text")).alias("__r")).select("__r.*")
    return left.unionByName(one.select(*docs.columns))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n i ON i.doc_id = a JOIN n j ON j.doc_id = b WHERE 100 * c >= 90 * (i.n + j.n - c)),
ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, ways.b FROM reach JOIN ways ON reach.r = ways.a)
SELECT doc_id, n AS n_shingles, min(r) AS component_id FROM n JOIN reach ON d = doc_id GROUP BY 1, 2
"""
