"""Word search in names: all words of the query, without stop words, plain or stemmed.

Names are split where the classifier splits them (dots and underscores are spaces), so
that dotted names can be found by their words. English stems (Porter's second algorithm)
are worked out once for each distinct word and joined back.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.functions.classify import normalize

#: English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were "
    "be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over "
    "under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
_SPLIT = r"[^\p{L}\p{N}]+"


def words(name: Column) -> Column:
    """Distinct lower-case words that are no stop words."""
    all_words = F.filter(F.split(F.lower(normalize(F.coalesce(name, F.lit("")))), _SPLIT), lambda w: w != "")
    return F.array_distinct(F.filter(all_words, lambda w: ~w.isin(STOP_WORDS)))


def query_words(q: str) -> list[str]:
    return [w for w in dict.fromkeys(re.split(r"[^\w]+|_", q.lower())) if w and w not in STOP_WORDS]


def matches(name: Column, q: str | None) -> Column:
    """Plain mode; no query matches all, one of stop words alone matches nothing."""
    if q is None:
        return F.lit(True)
    asked = query_words(q)
    if not asked:
        return F.lit(False)
    held = words(name)
    out = F.array_contains(held, asked[0])
    for w in asked[1:]:
        out = out & F.array_contains(held, w)
    return out


_V = "aeiouy"


def _r(word: str) -> int:
    m = re.search(rf"[{_V}][^{_V}]", word)
    return m.end() if m else len(word)


def _short(word: str) -> bool:
    return bool(re.search(rf"(^[{_V}][^{_V}]|[^{_V}][{_V}][^{_V}wxY])$", word))


#: Words that stem to something of their own, and words left alone.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
SETTLED = set("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()


def stem(word: str) -> str:
    """The English stem."""
    w = word.lstrip("'")
    if len(w) <= 2:
        return w
    if w in IRREGULAR:
        return IRREGULAR[w]
    w = re.sub(rf"(^|[{_V}])y", lambda m: m[1] + "Y", w)
    m = re.match(r"(gener|commun|arsen)", w)
    r1 = m.end() if m else _r(w)
    r2 = r1 + _r(w[r1:])
    w = re.sub(r"('s'|'s|')$", "", w)
    # plural endings
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in SETTLED:
        return w
    # past and progressive endings
    if m := re.search(r"(eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search(r"(ingly|edly|ing|ed)$", w)) and re.search(f"[{_V}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif _short(w) and r1 >= len(w):
            w += "e"
    if re.search(rf"[^{_V}][yY]$", w) and len(w) > 2:
        w = w[:-1] + "i"
    # longer endings, longest first
    for end in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1:
                if end == "ogi":
                    w = w[:-1] if w[at - 1 : at] == "l" else w
                elif end == "li":
                    w = w[:-2] if w[at - 1 : at] in set("cdeghkmnrt") else w
                else:
                    w = w[:at] + _STEP2[end]
            break
    for end in sorted([*_STEP3, "ative"], key=len, reverse=True):
        if w.endswith(end):
            at = len(w) - len(end)
            if end == "ative":
                w = w[:at] if at >= r2 else w
            elif at >= r1:
                w = w[:at] + _STEP3[end]
            break
    for end in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.lower()


def stems(df: DataFrame, key: str, name: str = "name") -> DataFrame:
    """``key, stem``: the inverted table of stemmed words."""
    @F.pandas_udf("string")
    def stemmed(w: pd.Series) -> pd.Series:
        return w.map(stem)

    rows = df.select(key, F.explode(words(F.col(name))).alias("word"))
    known = rows.select("word").distinct().withColumn("stem", stemmed("word"))
    return rows.join(known, "word").select(key, "stem").distinct()


def _stems_of(names: DataFrame, wanted: list[str]) -> DataFrame:
    """``word, stem`` of the distinct words in ``names`` that have a wanted stem; a stem shares its word's first letter, so others are not looked at."""
    @F.pandas_udf("string")
    def stemmed(w: pd.Series) -> pd.Series:
        return w.map(stem)

    first = F.substring("word", 1, 1).isin(sorted({w[:1] for w in wanted}))
    return names.select(F.explode(words(F.col("name"))).alias("word")).where(first).distinct().withColumn("stem", stemmed("word")).where(F.col("stem").isin(wanted))


def search_stemmed(df: DataFrame, q: str, key: str = "infohash", name: str = "name", words: DataFrame | None = None) -> DataFrame:
    """The rows of ``df`` whose names have all stems of the query.

    With ``words`` (a kept table of :func:`stems`) only the query's entries are read.
    Without, the words that have the query's stems are found among the distinct ones of
    all names, and names are filtered by them, without a shuffle of names.
    """
    asked = list(dict.fromkeys(map(stem, query_words(q))))
    if not asked:
        return df.where(F.lit(False))
    if words is not None:
        hits = words.where(F.col("stem").isin(asked)).groupBy(key).agg(F.count_distinct("stem").alias("n")).where(F.col("n") == len(asked)).select(key)
        return df.join(hits, key, "left_semi")
    forms: dict[str, list[str]] = {}
    for r in _stems_of(df.select(F.col(name).alias("name")), asked).collect():  # the spellings of the query's few stems
        forms.setdefault(r["stem"], []).append(r["word"])
    if len(forms) < len(asked):
        return df.where(F.lit(False))
    held = _words(F.col(name))
    return df.where(reduce(lambda a, b: a & b, (F.arrays_overlap(held, F.array(*map(F.lit, sorted(forms[w])))) for w in asked)))


_words = words
