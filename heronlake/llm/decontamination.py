"""Benchmark decontamination by templates: windows that agree but for numbers, names and units.

A text is read twice. In its typed form tokens are numbers, runs of capitalised words, and
words; a number, a name (such a run) and a unit (a listed word after a number) are typed
placeholders, other words are lower-cased. In its case-blind form every word is lower-cased
and stands for itself, names too; units are placeholders, and so are numbers next to a word
(a number among numbers stands for itself, so that tables of numbers match nothing but
themselves). Windows of :data:`WINDOW` tokens are hashed by doubling (pairs, then pairs of
pairs), the benchmark's windows are joined with those of the documents by hash, and windows
that meet are compared token by token. Typed windows need :data:`LEAST_WORDS` plain words.

Where windows of a document and an item line up at one offset, each value in the item's
slots must stand for one value in the document, as it does in a copy and in the same
question with other parameters. A window passes if this holds at its offset or if its own
slots have the item's values. A document is contaminated by an item if windows that pass
hold :data:`SHARE` of the item's, in either form.

Items of fewer tokens than a window are found by their whole case-blind token sequence,
numbers and all (in typed form too, if they have enough plain words); items of fewer than
:data:`SHORTEST` tokens, which any text may hold, only as a whole document.

Everything is DataFrame operations. Null or empty texts have no tokens and match nothing.
Rows of the benchmark with one id and other texts are sought each by itself and count for
their id together; repeated rows count once. Rows with a null id give none; a document's id
that is repeated has the pairs of any of its texts. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.llm import _store

WINDOW, LEAST_WORDS, SHARE, SHORTEST = 8, 4, 0.3, 3
BROADCAST_ROWS = 500_000  # benchmark windows, or ids of matched documents, that may be sent to all executors
TOKEN = r"\p{N}+(?:[.,]\p{N}+)*|\p{Lu}\p{L}*(?:[ -]\p{Lu}\p{L}*)*|\p{L}+"
BLIND_TOKEN = r"\p{N}+(?:[.,]\p{N}+)*|\p{L}+"
TYPED, BLIND, SHORT = 0, 1, 2  # forms of a window: typed, case-blind, and a short item's whole sequence
#: Words that are units when they follow a number.
UNITS = ("kg g mg lb oz km m cm mm mi ft in l ml kb mb gb tb s ms h min hz kw w v a c f k percent dollars dollar euros euro cents cent pounds pound years year months month weeks week days day hours hour minutes minute seconds second "
         "meters meter metres metre miles mile feet foot inches inch grams gram kilograms kilogram liters liter litres litre kilometers kilometer kilometres kilometre degrees degree").split()  # fmt: skip


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0)


def blind_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLIND_TOKEN), 0)


def _digit(t: Column) -> Column:
    return (t >= "0") & (t < ":")


def _after_number(before: Column) -> Column:
    return F.coalesce(_digit(before), F.lit(False))


def _typed(toks: Column, said) -> Column:
    def one(t: Column, i: Column) -> Column:
        low = F.lower(t)
        return F.when(_digit(t), said(F.lit("#n"))).when(low != t, said(F.lit("#p"))).when(low.isin(UNITS) & _after_number(F.get(toks, i - 1)), said(F.lit("#u"))).otherwise(said(low))

    return F.transform(toks, one)


def _blind(toks: Column, said) -> Column:
    def one(t: Column, i: Column) -> Column:
        word = lambda x: F.coalesce(~_digit(x), F.lit(False))
        return F.when(_digit(t), F.when(word(F.get(toks, i - 1)) | word(F.get(toks, i + 1)), said(F.lit("#n"))).otherwise(said(t))).when(t.isin(UNITS) & _after_number(F.get(toks, i - 1)), said(F.lit("#u"))).otherwise(said(t))

    return F.transform(toks, one)


def template(toks: Column, form: int) -> Column:
    return _typed(toks, lambda t: t) if form == TYPED else _blind(toks, lambda t: t) if form == BLIND else toks


def template_hashes(toks: Column, form: int) -> Column:
    """Hashes of a template's tokens, other ones in each form."""
    said = lambda t: F.xxhash64(t, F.lit(form))
    return _typed(toks, said) if form == TYPED else _blind(toks, said) if form == BLIND else F.transform(toks, said)


def _after(h: Column, n: Column, k: int) -> Column:
    return F.slice(h, F.lit(k + 1), F.greatest(n - k, F.lit(0)))


def with_window_hashes(df: DataFrame, hashes: Column, name: str, sizes: list[int]) -> DataFrame:
    """With columns ``name_size``: the hashes of all windows of each size, from token hashes and those of half and smaller windows.

    Each doubling is a column of its own, so that it is worked out once.
    """
    join = lambda a, b: F.xxhash64(a, b)
    levels = {1: f"__{name}1"}
    df = df.withColumn(levels[1], hashes)
    n = F.size(levels[1])
    while 2 * max(levels) <= max(sizes):
        half = max(levels)
        levels[2 * half] = f"__{name}{2 * half}"
        df = df.withColumn(levels[2 * half], F.zip_with(levels[half], _after(F.col(levels[half]), n, half), join))
    out = {}
    for size in sizes:
        parts = [w for w in sorted(levels) if size & w]
        got, done = F.col(levels[parts[0]]), parts[0]
        for w in parts[1:]:
            got, done = F.zip_with(got, _after(F.col(levels[w]), n, done), join), done + w
        out[f"{name}_{size}"] = F.slice(got, 1, F.greatest(n - (size - 1), F.lit(0)))
    return df.withColumns(out).drop(*levels.values())


def _with_tokens(df: DataFrame) -> DataFrame:
    return df.withColumns({"toks": tokens(F.col("text")), "words": blind_tokens(F.col("text"))}).drop("text")


#: Whose windows a form has.
_TOKENS = {TYPED: "toks", BLIND: "words", SHORT: "words"}


def _plain(tmpl: Column) -> Column:
    return F.size(F.filter(tmpl, lambda t: ~F.startswith(t, F.lit("#"))))


def _windows(df: DataFrame, kinds: list[tuple[int, int]], wanted) -> tuple[DataFrame, dict[tuple[int, int], Column]]:
    """``df`` with the window hashes of each form and size, and by these the columns (null where not ``wanted(form, size)`` of the text)."""
    out = {}
    for form, toks in _TOKENS.items():
        sizes = [size for f, size in kinds if f == form]
        df = with_window_hashes(df, template_hashes(F.col(toks), form), f"__w{form}", sizes) if sizes else df
        out |= {(form, size): F.when(wanted(form, size), F.col(f"__w{form}_{size}")) for size in sizes}
    return df, out


def _placed(df: DataFrame, keep: list[str], kinds: list[tuple[int, int]], wanted) -> DataFrame:
    """``keep`` and ``form, size, at, hash, own, t``: the windows of each text, with their tokens and templates. Of few texts."""
    df, arrays = _windows(df, kinds, wanted)
    one = lambda form, size: lambda h, i: F.struct(F.lit(form).alias("form"), F.lit(size).alias("size"), i.alias("at"), h.alias("hash"))
    nothing = F.array().cast("array<struct<form:int,size:int,at:int,hash:bigint>>")
    found = F.concat(nothing, *(F.coalesce(F.transform(c, one(*k)), nothing) for k, c in arrays.items()))
    df = df.withColumns({f"__t{form}": template(F.col(toks), form) for form, toks in _TOKENS.items()})
    rows = df.select(*keep, "toks", "words", *(f"__t{form}" for form in _TOKENS), F.inline_outer(found)).where("hash IS NOT NULL")
    cut = lambda c: F.slice(c, F.col("at") + 1, F.col("size"))
    of = lambda a, b, c: F.when(F.col("form") == TYPED, cut(a)).when(F.col("form") == BLIND, cut(b)).otherwise(cut(c))
    return rows.select(*keep, "form", "size", "at", "hash", of("toks", "words", "words").alias("own"), of(*(f"__t{form}" for form in _TOKENS)).alias("t"))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``item_id, item, form, size, at, hash, own, t``: the usable windows of each item (``item``: a hash of its text)."""
    items = _with_tokens(benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().withColumn("item", F.xxhash64("text")))
    kinds = [(TYPED, k) for k in range(LEAST_WORDS, WINDOW + 1)] + [(BLIND, WINDOW)] + [(SHORT, k) for k in range(1, WINDOW)]

    def wanted(form: int, size: int) -> Column:
        n = F.size(_TOKENS[form])
        return n >= size if size == WINDOW else n == size

    return _placed(items, ["item_id", "item"], kinds, wanted).where((F.col("form") != TYPED) | (_plain(F.col("t")) >= LEAST_WORDS))


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_windows, item_windows, n_verbatim``: the contaminated documents with the items, in the form that shares most; how many of the windows that pass have the item's own values."""
    spark = docs.sparkSession
    known, known_at = _store.kept_table(item_windows(benchmark), "windows")
    kinds = [tuple(r) for r in known.select("form", "size").distinct().orderBy("form", "size").collect()]  # at most 13 rows
    ids = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("doc", F.xxhash64("text"))

    # One pass over the texts: which of the benchmark's windows each has, of all forms and sizes.
    whole = lambda form, size: F.size("words") == size if form == SHORT and size < SHORTEST else F.lit(True)
    read, arrays = _windows(_with_tokens(ids), kinds, whole)
    hashes = F.concat(*(F.coalesce(c, F.array().cast("array<bigint>")) for c in arrays.values())) if arrays else F.array().cast("array<bigint>")
    # Outer, since else a filter on the array's size would work out the windows a second time; the null of an empty one meets nothing.
    seen = read.select("doc_id", "doc", F.explode_outer(hashes).alias("hash")).join(_sized(known.select("hash").distinct()), "hash", "left_semi")
    seen, seen_at = _store.kept_table(seen.distinct(), "matches")

    item, doc = ["item_id", "item", "form"], ["doc_id", "doc"]
    totals = known.groupBy(*item).agg(F.countDistinct("at").alias("item_windows"))
    near = seen.join(_sized(known.select("hash", *item, "at")), "hash").groupBy(*doc, *item).agg(F.countDistinct("at").alias("n"))
    # Pairs with too few windows at any offset are out before texts are read again.
    near, near_at = _store.kept_table(near.join(_sized(totals), item).where(F.col("n") >= SHARE * F.col("item_windows")).select(*doc, *item), "near")
    again = _with_tokens(ids.join(_sized(near.select("doc_id").distinct()), "doc_id", "left_semi")).distinct()
    own = _placed(again, doc, kinds, whole).join(_sized(known.select("hash").distinct()), "hash", "left_semi").withColumnsRenamed({"at": "pos", "own": "here"})
    asked = known.withColumnsRenamed({"own": "asked", "t": "asked_t"}).join(near.select(*item).distinct(), item, "left_semi")
    met = own.join(asked, ["hash", "form", "size"]).where("t = asked_t").join(near, [*doc, *item], "left_semi")
    slots = F.when(F.col("form") == SHORT, F.array()).otherwise(F.filter(F.arrays_zip("t", "asked", "here"), lambda s: F.startswith(s["t"], F.lit("#"))))
    met = met.select(*doc, *item, "at", (F.col("pos") - F.col("at")).alias("offset"), slots.cast("array<struct<t:string,asked:string,here:string>>").alias("slots"))
    met, met_at = _store.kept_table(met.withColumn("verbatim", F.forall("slots", lambda s: s["asked"] == s["here"])), "met")
    by = [*doc, *item, "offset"]
    values = met.select(*by, F.inline("slots")).groupBy(*by, "t", "asked").agg(F.countDistinct("here").alias("n")).where("n > 1").select(*by).distinct().withColumn("mixed", F.lit(True))
    passed = met.join(values, by, "left").where(F.col("verbatim") | F.col("mixed").isNull())
    counts = passed.groupBy(*doc, *item).agg(F.countDistinct("at").alias("n_windows"), F.countDistinct(F.when(F.col("verbatim"), F.col("at"))).alias("n_verbatim")).join(totals, item)
    rank = F.struct(F.col("n_windows") / F.col("item_windows"), F.col("n_verbatim"), F.col("item_windows"))
    best = counts.where(F.col("n_windows") >= SHARE * F.col("item_windows")).groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_windows", "item_windows", "n_verbatim"), rank).alias("b"))
    out, _ = _store.kept_table(best.select("doc_id", "item_id", "b.*"), "contaminated")
    _store.drop(spark, known_at, seen_at, near_at, met_at)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    bad = _sized(pairs(docs, benchmark).select(F.col("doc_id").alias("__bad")).distinct())
    return docs.join(bad, docs["doc_id"] == F.col("__bad"), "left_anti")


_IS_UNIT = "(" + ", ".join(f"'{u}'" for u in UNITS) + ")"
_SQL_DIGIT = "({0} >= '0' AND {0} < ':')"
_AFTER = f"i > 1 AND {_SQL_DIGIT.format('{0}[i - 1]')}"
_TEMPLATE = f"list_transform(toks, lambda t, i: CASE WHEN {_SQL_DIGIT.format('t')} THEN '#n' WHEN lower(t) <> t THEN '#p' WHEN lower(t) IN {_IS_UNIT} AND {_AFTER.format('toks')} THEN '#u' ELSE lower(t) END)"
_BLIND = f"""list_transform(words, lambda t, i: CASE WHEN {_SQL_DIGIT.format('t')} THEN CASE WHEN (i > 1 AND NOT {_SQL_DIGIT.format('words[i - 1]')}) OR (i < len(words) AND NOT {_SQL_DIGIT.format('words[i + 1]')}) THEN '#n' ELSE t END
  WHEN t IN {_IS_UNIT} AND {_AFTER.format('words')} THEN '#u' ELSE t END)"""
_TOKENISED = f"*, regexp_extract_all(text, '{TOKEN}') AS toks, regexp_extract_all(lower(text), '{BLIND_TOKEN}') AS words"
ORACLE = f"""
WITH items AS (SELECT *, {_TEMPLATE} AS tmpl, {_BLIND} AS wtmpl FROM (SELECT {_TOKENISED} FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL))),
i1 AS (
  SELECT item_id, text AS item, {TYPED} AS form, least(len(toks), {WINDOW}) AS size, toks AS own, tmpl FROM items WHERE len(toks) >= {LEAST_WORDS}
  UNION ALL SELECT item_id, text, {BLIND}, {WINDOW}, words, wtmpl FROM items WHERE len(words) >= {WINDOW}
  UNION ALL SELECT item_id, text, {SHORT}, len(words), words, words FROM items WHERE len(words) BETWEEN 1 AND {WINDOW - 1}),
known AS (SELECT * FROM (SELECT item_id, item, form, size, i - 1 AS place, own[i:i + size - 1] AS asked, tmpl[i:i + size - 1] AS t FROM (SELECT *, unnest(range(1, len(own) - size + 2)) AS i FROM i1))
  WHERE form <> {TYPED} OR len(list_filter(t, lambda x: NOT starts_with(x, '#'))) >= {LEAST_WORDS}),
totals AS (SELECT item_id, item, form, count(DISTINCT place) AS item_windows FROM known GROUP BY ALL),
d0 AS (SELECT doc_id, text AS doc, toks, words, {_TEMPLATE} AS tmpl, {_BLIND} AS wtmpl FROM (SELECT {_TOKENISED} FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL))),
kinds AS (SELECT DISTINCT form, size FROM known),
d1 AS (SELECT doc_id, doc, form, size, CASE form WHEN {TYPED} THEN toks ELSE words END AS own, CASE form WHEN {TYPED} THEN tmpl WHEN {BLIND} THEN wtmpl ELSE words END AS tmpl FROM d0, kinds WHERE form <> {SHORT} OR size >= {SHORTEST} OR len(words) = size),
d2 AS (SELECT doc_id, doc, form, size, i - 1 AS pos, own[i:i + size - 1] AS here, tmpl[i:i + size - 1] AS t FROM (SELECT *, unnest(range(1, len(own) - size + 2)) AS i FROM d1)),
hits AS (SELECT doc_id, doc, item_id, item, form, place, pos - place AS off, size, asked, here, t, form = {SHORT} OR NOT list_bool_or(list_transform(range(1, size + 1), lambda k: starts_with(t[k], '#') AND asked[k] <> here[k])) AS verbatim FROM d2 JOIN known USING (form, size, t)),
slots AS (SELECT doc_id, doc, item_id, item, form, off, t[k] AS kind, asked[k] AS asked, here[k] AS here FROM (SELECT *, unnest(range(1, size + 1)) AS k FROM hits WHERE form <> {SHORT}) WHERE starts_with(t[k], '#')),
mixed AS (SELECT DISTINCT doc_id, doc, item_id, item, form, off FROM (SELECT doc_id, doc, item_id, item, form, off FROM slots GROUP BY doc_id, doc, item_id, item, form, off, kind, asked HAVING count(DISTINCT here) > 1)),
passed AS (SELECT * FROM hits WHERE verbatim UNION ALL SELECT hits.* FROM hits ANTI JOIN mixed USING (doc_id, doc, item_id, item, form, off) WHERE NOT verbatim),
counts AS (SELECT doc_id, doc, item_id, item, form, item_windows, count(DISTINCT place) AS n_windows, count(DISTINCT place) FILTER (verbatim) AS n_verbatim FROM passed JOIN totals USING (item_id, item, form) GROUP BY ALL)
SELECT doc_id, item_id, n_windows, item_windows, n_verbatim FROM counts WHERE n_windows >= {SHARE} * item_windows
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_windows::DOUBLE / item_windows DESC, n_verbatim DESC, item_windows DESC) = 1
"""
