"""Language identification by fusing evidence: text, declared language, address and host.

Hashed byte trigrams of all documents with a language give each language's text model.
A page's visible text then has a likelihood in each language (tempered, since trigrams
overlap), its markup may declare one, and its address has a suffix, a domain and a host.
Grouped sums of the text posteriors give how often each language declares what, and
priors that are smoothed down the hierarchy: all pages, suffix, domain, host, each with
the level above as so many pseudo-pages. A page's own posterior is left out of its
domain's and host's sums. The result is the normalised product.

Pages are scanned in linear time, whatever their markup. Sums of hosts, domains and suffixes
with many pages are sent to all tasks, of which there are few by their share; others are
joined by key.

Null or empty html has no text and no declaration; a null or odd address has an empty
host. Pages are judged each by itself, repeated ids too. Ties go to the first language in
code-point order. Without languages to learn from the language is null. Other columns
are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.llm import _store
from heronlake.llm import _words as W

BITS = 16  # of the trigram hash
TEMPER = 0.2  # weight of a trigram
HEAVY = 1000  # a host, domain or suffix with over one in so many pages is heavy; there are fewer than this
PSEUDO_PAGES, PSEUDO_DECLARED = 5.0, 2.0
_TAG_END, _LANG = re.compile(rb"\s*>"), re.compile(rb"(?i)\blang\s*=\s*[\"']?([a-z]{2,3})\b")
_LONG_REFERENCE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")


class _Finder:
    """Where something comes next; what is not found once is not sought again, so that a scan stays linear."""

    def __init__(self, data: bytes):
        self.data, self.gone = data, set()

    def next(self, what: bytes, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.data.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found


def visible(page: bytes) -> str:
    """The text outside tags, comments, scripts and styles, references resolved, in one pass. A comment or element that never ends hides its own tag alone."""
    low, out, at = page.lower(), [], 0
    seek = _Finder(low)
    while (start := low.find(b"<", at)) >= 0:
        end = -1
        if low.startswith(b"<!--", start):
            found = seek.next(b"-->", start + 4)
            end = found + 3 if found >= 0 else -1
        for name in (b"script", b"style"):
            if low.startswith(name, start + 1) and not low[start + 1 + len(name) : start + 2 + len(name)].isalnum():
                found = start
                while (found := seek.next(b"</" + name, found + 1)) >= 0:
                    if close := _TAG_END.match(low, found + 2 + len(name)):
                        end = close.end()
                        break
        if end < 0:
            found = seek.next(b">", start)
            if found < 0:
                break
            end = found + 1
        out += [page[at:start], b" "]
        at = end
    out.append(page[at:])
    return html.unescape(_LONG_REFERENCE.sub("\ufffd", b"".join(out).decode("utf-8", "replace")))


def declared_language(page: bytes) -> str | None:
    """Of the first ``html`` tag that has one."""
    low, at = page.lower(), 0
    while (at := low.find(b"<html", at)) >= 0:
        end = low.find(b">", at)
        end = len(low) if end < 0 else end
        if not low[at + 5 : at + 6].isalnum() and (m := _LANG.search(low[at + 5 : end])):
            return m[1].decode()
        at = end
    return None


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket and text of each byte trigram of the lower-cased texts."""
    data, offsets = W.buffers(texts)
    x = W.LOWER[data].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), len(offsets) - 1
    gram = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
    bucket = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = doc[:-2] == doc[2:]
    return bucket[whole], doc[:-2][whole], len(offsets) - 1


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of ``docs`` and log chances by language and bucket, from all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in W.slices(batch, "text"):
                bucket, doc, _ = _trigrams(part.column("text"))
                langs = part.column("lang").to_pylist()
                names = sorted(set(langs))
                code = np.array([names.index(x) for x in langs], np.int64)
                both = np.bincount(code[doc] << BITS | bucket, minlength=len(names) << BITS).reshape(len(names), -1)
                for x, row in zip(names, both, strict=True):
                    total[x] = total.get(x, 0) + row
        for x, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = docs.where("lang IS NOT NULL").select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages times buckets at most
    langs = sorted(set(rows.column("lang").to_pylist()))
    table = np.full((len(langs), 1 << BITS), 0.5)
    code = np.array([langs.index(x) for x in rows.column("lang").to_pylist()], np.int64)
    table[code, rows.column("bucket").to_numpy()] += rows.column("n").to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table


def evidence(pages: DataFrame, langs: list[str], logs: np.ndarray, most_text: float | None = None) -> DataFrame:
    """``page_id, url, declared, text`` (tempered log likelihoods, the best being 0) of each page; ``most_text`` bounds what text may say, in nats."""
    sent = pages.sparkSession.sparkContext.broadcast(logs.T.astype(np.float32).copy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for part in W.slices(batch, "html"):
                raw = [x.as_py().encode() if x.is_valid else b"" for x in part.column("html")]
                bucket, doc, n = _trigrams(pa.array([visible(x) for x in raw], pa.large_string()))
                text = np.stack([np.bincount(doc, weights=table[bucket, k], minlength=n) for k in range(len(langs))], axis=1) * TEMPER
                text = np.maximum(text - text.max(axis=1, keepdims=True), -np.inf if most_text is None else -most_text)
                declared = [declared_language(x) for x in raw]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(langs), pa.int32()), pa.array(text.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(declared, pa.string()), lists], names=["page_id", "url", "declared", "text"])

    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, declared string, text array<double>")


def address(df: DataFrame) -> DataFrame:
    """With ``host, domain, suffix``: the whole host name, its last two labels, and its last."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return df.withColumn("host", host).withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))


def _normal(logs: Column) -> Column:
    p = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, b: a + b))


def _with_sums(rows: DataFrame, sums: DataFrame, key: str, n: int) -> DataFrame:
    """``rows`` with their key's sums as ``by_<key>``: those of heavy keys are sent to all tasks, so that no task gets such a key's pages; others are joined by key."""
    heavy = sums.where(F.col("pages") * HEAVY > n).select(F.col(key).alias("__heavy"), F.col("v").alias("__hv"))
    light = sums.where(F.col("pages") * HEAVY <= n).select(F.col(key).alias("__light"), F.col("v").alias("__lv"))
    rows = rows.join(F.broadcast(heavy), F.col(key) == F.col("__heavy"), "left")
    # Rows that have their sums already go anywhere; no key holds the mark.
    spread = F.when(F.col("__heavy").isNull(), F.col(key)).otherwise(F.concat(F.lit("\u0000"), F.xxhash64("page_id", "url").cast("string")))
    rows = rows.withColumn("__to", spread).join(light, F.col("__to") == F.col("__light"), "left")
    return rows.withColumn(f"by_{key}", F.coalesce("__hv", "__lv")).drop("__heavy", "__hv", "__light", "__lv", "__to")


def fuse(rows: DataFrame, langs: list[str]) -> DataFrame:
    """The posterior over ``langs`` of each row of :func:`evidence`."""
    m = len(langs)
    rows = address(rows).withColumn("own", _normal(F.col("text")))
    rows, _ = _store.kept_table(rows, "evidence")
    sums = [F.sum(F.col("own")[i]).alias(f"s{i}") for i in range(m)]
    vector = F.array(*(F.col(f"s{i}") for i in range(m)))
    sum_by = lambda *keys: rows.groupBy(*keys).agg(*sums).select(*keys, vector.alias("v"))
    total = [float(x or 0.0) for x in (rows.agg(*sums).first() if m else [])]
    everyone = F.array(*(F.lit((t + 1.0) / (sum(total) + m)) for t in total))
    size = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
    smooth = lambda v, above: F.zip_with(v, above, lambda x, y: (F.greatest(x, F.lit(0.0)) + PSEUDO_PAGES * y) / (F.greatest(size(v), F.lit(0.0)) + PSEUDO_PAGES))
    less = lambda v: F.zip_with(v, F.col("own"), lambda x, y: x - y)
    declared = sum_by("declared").withColumn("share", size(F.col("v")) / float(sum(total) or 1.0))
    says = F.zip_with("v", F.array(*(F.lit(t) for t in total)), lambda x, t: (x + PSEUDO_DECLARED * F.col("share")) / (t + PSEUDO_DECLARED))
    joined = rows
    n = rows.count()
    for key in ("suffix", "domain", "host"):
        joined = _with_sums(joined, rows.groupBy(key).agg(F.count("*").alias("pages"), *sums).select(key, "pages", vector.alias("v")), key, n)
    says_by = declared.select(F.col("declared").alias("d"), says.alias("says"))
    joined = joined.join(F.broadcast(says_by), joined["declared"].eqNullSafe(F.col("d")))  # two or three letters: some 18,000 rows at most
    joined = joined.withColumn("p1", smooth(F.col("by_suffix"), everyone))
    joined = joined.withColumn("p2", smooth(less(F.col("by_domain")), F.col("p1")))
    joined = joined.withColumn("prior", smooth(less(F.col("by_host")), F.col("p2")))
    # A page that declares nothing says nothing by it.
    heard = F.when(F.col("declared").isNull(), F.col("text")).otherwise(F.zip_with("text", "says", lambda t, d: t + F.log(d)))
    joined = joined.withColumn("posterior", _normal(F.zip_with(heard, "prior", lambda t, p: t + F.log(p))))
    best = lambda v: F.element_at(F.array(*map(F.lit, langs)), F.array_position(v, F.array_max(v)).cast("int"))
    return joined.select("page_id", best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("confidence"), best(F.col("own")).alias("text_lang"), "declared", "host", "suffix")


def digest(pages: DataFrame, docs: DataFrame) -> DataFrame:
    langs, logs = train(docs)
    if not langs:
        empty = address(pages.select("page_id", "url"))
        return empty.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), "host", "suffix")
    return fuse(evidence(pages, langs, logs), langs)
