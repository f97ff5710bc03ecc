from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from heronlake.llm import _components, decontamination, language_id, ngram_join, ppm

LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(LOW).split()
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                same = len(sets[i] & sets[j])
                if den * same >= num * (len(sets[i]) + len(sets[j]) - same):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_join(spark, k, num, den):
    from tests.llm.conftest import prose

    r = random.Random(k)
    rows = []
    for g in range(12):
        base = prose(r, r.randrange(4, 150)).split()
        for _ in range(r.randrange(1, 9)):
            w = list(base)
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
            rows.append((len(rows) * 3 + g % 2, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  B"), (1004, "a"), (1005, "x " * 20_000)]
    got = ngram_join.digest(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, k, num, den)


def test_join_odd_rows(odd, plain):
    got = ngram_join.digest(odd).collect()
    assert len(got) == len(plain)
    named = brute([(i, t) for i, t, _ in plain if i is not None], 3, 90, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == named
    assert all(r.component_id is None for r in got if r.doc_id is None)
    kept = ngram_join.first_of_groups(odd)
    assert kept.columns == odd.columns
    near = brute([(i, t) for i, t, _ in plain if i is not None], 5, 80, 100)
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {i for i, v in near.items() if v[1] == i}
    assert ngram_join.digest(odd.limit(0)).count() == 0


def test_trie_blocks_find_the_same_pairs(monkeypatch, spark):
    """A branch dealt in many blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    r = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(30):
        w = list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(60)] = f"u{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = ngram_join.digest(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 90, 100)


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    got = {x.node: x.component for x in _components.components(spark.createDataFrame(edges, "a long, b long"))[0].collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if find(x) != x}


QUESTION = "If Alice Smith buys 12 apples and 7 kg of flour at the old market then how many apples does she still have after giving 5 apples to her older brother Bob"


def test_leaks(spark, odd):
    def asked(name, n, m, k, brother):
        return f"If {name} buys {n} apples and {m} kg of flour at the old market then how many apples does she still have after giving {k} apples to her older brother {brother}"

    bench = spark.createDataFrame([(1, QUESTION), (2, "What is the boiling point of water"), (3, None), (4, ""), (5, "12 34"), (None, QUESTION)], "item_id long, text string")
    filler = "some words before it that do not matter at all here "
    docs = [
        (1, filler + QUESTION + " and more words"), (2, filler + asked("Carol Jones", 30, 9, 4, "Dan")), (3, filler + asked("Carol", 30, 9, 4, "Dan").upper()), (4, "so " + QUESTION.lower()), (5, filler * 5), (6, None), (7, ""), (8, "What is the boiling point of water ? " + filler),
        (None, QUESTION), (9, " ".join(QUESTION.split()[:9]) + " " + filler), (10, QUESTION), (10, QUESTION), (11, filler * 3000 + asked("Eve", 1, 2, 3, "Al") + filler),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS hash", "2 AS item_id", "3 AS toks")
    got = {(r.doc_id, r.item_id): r for r in decontamination.pairs(df, bench).collect()}
    assert {k for k in got if k[1] == 1} >= {(1, 1), (2, 1), (10, 1), (11, 1)}
    assert (8, 2) in got and not any(d in (5, 6, 7, 9) for d, _ in got)
    assert got[1, 1].n_verbatim == got[1, 1].n_windows == got[1, 1].item_windows and got[2, 1].n_verbatim < got[2, 1].n_windows
    assert (3, 1) in got and (4, 1) in got
    left = decontamination.clean(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} >= {5, 6, 7, 9, None}
    assert decontamination.pairs(df.limit(0), bench).count() == 0 and decontamination.pairs(df, bench.limit(0)).count() == 0
    assert decontamination.pairs(odd, bench).count() == 0


def test_clean_in_any_case(spark):
    """Copies in another case, of names and numbers alone, and with one of two equal names altered."""
    twice = "The old miller of Arden sold eleven sacks of white flour to the baker and The young sailor carried them to a ship that waited in the harbour"
    bench = spark.createDataFrame([(1, QUESTION), (2, "What Is The Capital Of New South Wales In 1901"), (3, twice), (4, None)], "item_id long, text string")
    filler = "some words before it that do not matter at all here "
    texts = [QUESTION.upper(), QUESTION.lower(), filler + QUESTION.title(), "WHAT IS THE CAPITAL OF NEW SOUTH WALES IN 1901", "What Is The Capital Of New South Wales In 1901", filler + twice.replace("The young", "One young"), filler * 3, QUESTION[:40].upper() + " " + filler, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in decontamination.clean(docs, bench).collect()} == {6, 7, 8, 9}
    assert decontamination.clean(docs, bench.limit(0)).count() == len(texts)


def test_slots_must_agree(spark):
    """The same template with one slot meaning two things is another text, unless enough of it is the item word for word."""
    item = "Take 5 coins and add 5 coins to the large red box before you count all 5 coins again with care"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    mixed = item.replace("5", "9", 1).replace("5", "8", 1).replace("5", "7", 1)
    docs = spark.createDataFrame([(1, item.replace("5", "9")), (2, item.replace("5", "9", 1)), (3, mixed)], "doc_id long, text string")
    got = {r.doc_id: (r.n_windows, r.n_verbatim) for r in decontamination.pairs(docs, bench).collect()}
    assert set(got) == {1, 2} and got[1][1] < got[1][0] and got[2][0] == got[2][1]


def test_recall_by_kind_of_copy(spark):
    """Copies in other case, with other parameters, and of short items; texts under one id; short items in part."""
    from tests.llm.conftest import prose

    r = random.Random(21)
    names, filler = "Alice Smith,Bob Jones,Carol King,Dan Moore,Eve Stone,Frank Hill".split(","), prose(r, 60)
    ask = lambda i, name, n, m, w: f"When {name} brings {n} {w[0]} and {m} {w[1]} to the {w[2]} near the {w[3]} how many {w[4]} does {name} still {w[5]} after the {w[6]} {w[7]}"
    bench, docs = [], []
    for i in range(20):
        w = [prose(r, 1) + f"{chr(97 + i)}x" for _ in range(8)]
        name, other = names[i % 6], names[(i + 1) % 6]
        item = ask(i, name, i + 3, i + 30, w)
        bench.append((i, item))
        for kind, t in enumerate((item, item.upper(), item.title(), item.lower(), ask(i, other, i + 50, 2 * i + 7, w), ask(i, name, i + 50, 2 * i + 7, w).upper())):
            docs.append((1000 * kind + i, f"{filler} {t} {filler}"))
        short = f"Which {w[0]} is {i + 12}?" if i % 2 else f"{w[0]} {i + 12} + {i + 7}"
        bench += [(100 + i, short), (200, item + " or another " + w[3] + " under one id")]
        docs += [(7000 + i, f"{filler} {short.upper()} {filler}"), (8000 + i, f"{filler} {short.split()[0]} {filler}"), (9000 + i, f"{filler} {w[0]} {w[1]} 12 34 {filler}")]
    bench += [(300, "two words"), (301, "alone")]
    docs += [(20_000, "Two words"), (20_001, "two words more"), (20_002, "ALONE"), (20_003, "not alone"), (20_004, None), (20_005, "12 34 12 34")]
    found = {(x.doc_id, x.item_id) for x in decontamination.pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    for kind in range(6):
        assert sum((1000 * kind + i, i) in found for i in range(20)) >= 18, kind
    assert sum((7000 + i, 100 + i) in found for i in range(20)) >= 18
    assert all((i, 200) in found for i in range(20))
    assert not any(d >= 8000 and d < 20_000 for d, _ in found)
    assert {x for x in found if x[0] >= 20_000} == {(20_000, 300), (20_002, 301)}


def test_window_hashes(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(list(range(11)),), ([1, 2],), ([],)], "h array<long>")
    sizes = [1, 3, 5, 8]
    got = decontamination.with_window_hashes(rows, F.transform("h", lambda t: F.xxhash64(t)), "w", sizes).collect()
    for size in sizes:
        assert [len(r[f"w_{size}"]) for r in got] == [max(0, n - size + 1) for n in (11, 2, 0)]
        assert len(set(got[0][f"w_{size}"])) == 11 - size + 1


def test_base_scores(odd, plain):
    got = ppm.digest(odd).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [*(t or "").encode().translate(LOW).split(), None]) for i, t, _ in plain]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    total, distinct = sum(c.values()), len(c)
    key = lambda r: (str(r[0]), r[1], r[2], r[3], round(r[4], 6))
    expect = [key((i, held(i), len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in ws))) for i, ws in tokens]
    assert sorted(key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score)) for r in got) == sorted(expect)
    assert {r.train_tokens for r in got} == {total}
    assert ppm.digest(odd.limit(0)).count() == 0


def plain_ppm(texts: list[bytes], order: int):
    """The same model from first principles: counts, half-count escapes, exclusion by renormalising."""
    seen: dict[bytes, Counter] = defaultdict(Counter)
    for s in texts:
        s = bytes(order) + s
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[s[i - k : i]][s[i]] += 1

    def chance(context: bytes, symbol: int) -> float:
        below = (lambda x: chance(context[1:], x)) if context else (lambda x: 1 / 256)
        if context not in seen:
            return below(symbol)
        c = seen[context]
        total, n = sum(c.values()), len(c)
        if symbol in c:
            return (c[symbol] - 0.5) / total
        return n / (2 * total) * below(symbol) / (1 - sum(below(x) for x in c))

    def score(s: bytes) -> float:
        s = bytes(order) + s
        return sum(math.log10(chance(s[i - order : i], s[i])) for i in range(order, len(s)))

    return score


def test_model_scores(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["ab", "abc", "ca", "Cab", "é"]) for _ in range(r.randrange(0, 12)))) for i in range(40)]
    got = {x.doc_id: x for x in ppm.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    stream = lambda t: b"".join(w + b" " for w in t.encode().translate(LOW).split()) + b"\xff"
    score = plain_ppm([stream(t) for i, t in rows if not got[i].held_out], ppm.ORDER)
    for i, t in rows:
        assert got[i].score == pytest.approx(score(stream(t)), rel=1e-4, abs=1e-4)


def test_model_keeps_rare_contexts(monkeypatch, spark):
    """More contexts than any fixed table held, most of them seen once; and grams that are not sent to the tasks."""
    r = random.Random(10)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 9)))
    rows = [(i, " ".join(word() for _ in range(60))) for i in range(600)]
    stream = lambda t: b"".join(w + b" " for w in t.encode().translate(LOW).split()) + b"\xff"
    learnt = [stream(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    score = plain_ppm(learnt, ppm.ORDER)
    assert len({(k, s[i - k : i]) for s in learnt for k in range(ppm.ORDER + 1) for i in range(k, len(s))}) > 1 << 16
    df = spark.createDataFrame(rows, "doc_id long, text string").cache()
    got = {x.doc_id: x.score for x in ppm.digest(df).collect()}
    assert all(got[i] == pytest.approx(score(stream(t)), rel=1e-6) for i, t in rows)
    monkeypatch.setattr(ppm, "WAYS", 0)
    joined = {x.doc_id: x.score for x in ppm.digest(df).collect()}
    assert joined == pytest.approx(got, rel=1e-9)


def test_chances_sum_to_one():
    t = ppm.Trie(np.zeros(5, np.int64), np.zeros(5, np.int64), np.array([97, 98, 99, 32, 255]), np.array([5, 3, 1, 4, 2]))
    others = 256 - (t.width - 1)
    chance = 10.0 ** t.cost.astype(float)
    assert (chance[:, :-1].sum(axis=1) + others * chance[:, -1]) == pytest.approx(1.0, abs=1e-5)


def test_languages(spark, odd):
    words = {"en": "the house is old and the river was near with that", "de": "das haus ist alt und der fluss war nicht mit einem", "fr": "la maison est vieille et le fleuve dans une avec"}
    r = random.Random(9)
    say = lambda x, n: " ".join(r.choice(words[x].split()) for _ in range(n))
    docs = spark.createDataFrame([(i, say(x, 80), x) for i, x in enumerate(list(words) * 40)] + [(999, None, "en"), (998, "x", None)], "doc_id long, text string, lang string")
    page = lambda i, x, host, tag=True, n=40: (i, f"https://{host}/p/{i}", f"<!DOCTYPE html><html{f' lang={chr(34)}{x}{chr(34)}' if tag else ''}><script>the and of is was</script><p>{say(x, n)}</p></html>")
    rows = [page(i, x, f"{x}.example.{ {'en': 'com', 'de': 'de', 'fr': 'fr'}[x] }", i % 2 == 0) for i, x in enumerate(list(words) * 30)]
    rows += [(500, "https://de.example.de/x", "<html><p></p></html>"), (501, None, None), (502, "", ""), (503, "nonsense", "<p>" + say("fr", 60)), (504, "http://new.example.org", "<html lang=de><p>" + say("en", 200))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS text", "3 AS v")
    got = {x.page_id: x for x in language_id.digest(pages, docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang == x for i, x in enumerate(list(words) * 30))
    assert got[500].lang == "de" and got[503].lang == "fr" and got[504].lang == "en" and got[501].lang in words
    assert language_id.digest(pages.limit(0), docs).count() == 0
    assert {x.lang for x in language_id.digest(pages, docs.limit(0)).collect()} == {None}


def test_visible_text():
    assert re.sub(r"\s+", " ", language_id.visible(b"<style>p{}</style><p>a &amp; b<!-- c --><SCRIPT>d</SCRIPT >")).strip() == "a & b"


def test_scans_are_linear():
    import time

    began = time.time()
    for part in (b"<!--", b"<script>", b"<style ", b"</script", b"<html lang ", b"<html ", b"&#", b"&amp", b"<", b"<!-- --", b"<script></scriptx"):
        page = part * (1_000_000 // len(part))
        language_id.visible(page), language_id.declared_language(page)
    language_id.visible(b"&#" + b"9" * 1_000_000)
    assert time.time() - began < 11


def plain_visible(page: bytes) -> str:
    """As patterns say it, for small pages."""
    import html

    return html.unescape(re.sub(rb"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", b" ", page).decode("utf-8", "replace"))


def test_visible_text_of_odd_markup():
    r = random.Random(31)
    parts = ["<!--", "-->", "<script>", "</script>", "</script >", "<style a=b>", "</style\n>", "<p>", "text ", "&amp;", "<", ">", "é", "<scripted>", "</scripts>", "<STYLE>", "<a href='x'>"]
    for _ in range(3000):
        page = "".join(r.choice(parts) for _ in range(r.randrange(12))).encode()
        assert re.sub(r"\s+", " ", language_id.visible(page)) == re.sub(r"\s+", " ", plain_visible(page)), page


def plain_languages(pages, docs):
    """The same fusion from first principles, over rows."""
    langs = sorted({x for _, x in docs if x is not None})

    def grams(t: bytes):
        t = t.lower()
        return [((a | b << 8 | c << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for a, b, c in zip(t, t[1:], t[2:], strict=False)]

    model = {}
    for x in langs:
        c = Counter(g for t, y in docs if y == x for g in grams((t or "").encode()))
        total = sum(c.values()) + 0.5 * 65536
        model[x] = lambda g, c=c, total=total: math.log((c[g] + 0.5) / total)
    rows = []
    for i, url, page in pages:
        text = [0.2 * sum(map(model[x], grams(plain_visible((page or "").encode()).encode()))) for x in langs]
        own = [math.exp(t - max(text)) for t in text]
        own = [p / sum(own) for p in own]
        m = re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", page or "")
        host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        host = host[1].lower() if host else ""
        rows.append((i, text, own, m[1].lower() if m else None, host, ".".join(host.split(".")[-2:]), host.split(".")[-1]))
    add = lambda got: [sum(v) for v in zip(*got, strict=True)]
    total = add([r[2] for r in rows])
    everyone = [(t + 1) / (sum(total) + len(langs)) for t in total]
    smooth = lambda v, above: [(max(x, 0) + 5 * y) / (max(sum(v), 0) + 5) for x, y in zip(v, above, strict=True)]
    out = {}
    for i, text, own, declared, host, domain, suffix in rows:
        p = smooth(add([r[2] for r in rows if r[6] == suffix]), everyone)
        p = smooth([a - b for a, b in zip(add([r[2] for r in rows if r[5] == domain]), own, strict=True)], p)
        p = smooth([a - b for a, b in zip(add([r[2] for r in rows if r[4] == host]), own, strict=True)], p)
        logs = [t + math.log(q) for t, q in zip(text, p, strict=True)]
        if declared:
            v = add([r[2] for r in rows if r[3] == declared])
            logs = [x + math.log((a + 2 * sum(v) / sum(total)) / (t + 2)) for x, a, t in zip(logs, v, total, strict=True)]
        e = [math.exp(x - max(logs)) for x in logs]
        out[i] = langs[max(range(len(langs)), key=lambda k: (e[k], -k))], max(e) / sum(e)
    return out


def test_languages_against_a_plain_version(monkeypatch, spark):
    """Every page's language and confidence; with a heavy host, and with none that counts as heavy."""
    r = random.Random(17)
    words = {"en": "the house is old and river was near with that", "de": "das haus ist alt und fluss war nicht mit einem", "fr": "la maison est vieille et le fleuve dans une avec"}
    say = lambda x, n: " ".join(r.choice(words[x].split()) for _ in range(n))
    docs = [(say(x, 30), x) for x in [*words] * 8] + [(None, "en"), ("x", None)]
    pages = []
    for i in range(60):
        x = r.choice([*words])
        host = r.choice(["big.example.com", "big.example.com", f"{x}.site.{x}", "www.site.de", ""])
        tag = r.choice(["<html>", f"<html lang={x}>", '<html dir=ltr lang="zz">', ""])
        pages.append((i, f"https://u@{host}:80/{i}" if host else r.choice([None, "nonsense"]), f"{tag}<p>{say(x, r.randrange(0, 6))}</p>" if i % 9 else None))
    want = plain_languages(pages, docs)
    p, d = spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "text string, lang string")
    for heavy in (1000, 2):
        monkeypatch.setattr(language_id, "HEAVY", heavy)
        got = {x.page_id: (x.lang, x.confidence) for x in language_id.digest(p, d).collect()}
        assert got.keys() == want.keys()
        assert all(got[i][1] == pytest.approx(want[i][1], rel=1e-4) and (got[i][0] == want[i][0] or want[i][1] < 0.5) for i in want)
