"""The learned rules and the pipeline against plain versions of them."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from heronlake.llm import quality_rules as Q
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = "A benchmark passage about the seven silver bridges that cross the quiet river near the old copper market in winter"


def _documents(seed: int) -> list[tuple]:
    """Prose, texts full of marks or short lines (bad by their labels, but for some), near copies, benchmark items and odd rows."""
    r = random.Random(seed)
    rows = []
    for i in range(240):
        kind, text = r.choice(("prose", "prose", "marks", "lines")), prose(r, r.randrange(55, 110))
        words = text.split()
        if kind == "marks":
            text = " ".join(w if r.random() < 0.6 else r.choice(("|", "$$", "<x>", "77", "QQ")) for w in words)
        elif kind == "lines":
            text = "\n".join(" ".join(words[k : k + 2]) for k in range(0, len(words), 2))
        rows.append((i, text, "en", f"s{i % 4}" if i % 11 else None, int(kind == "prose") if i % 60 else int(kind != "prose")))
    base = [x for x in rows if x[4] == 1][:6]
    rows += [(300 + k, " ".join([*x[1].split()[:-1], "changed"]), "en", "s0", None) for k, x in enumerate(base)] + [(310 + k, x[1].upper(), "en", "s1", None) for k, x in enumerate(base[:3])]
    rows += [(320, f"{ITEM} {prose(r, 70)}", "en", "s2", 1), (321, f"{prose(r, 70)} {ITEM.upper()}", "en", "s2", 1), (330, None, "en", "s0", 0), (331, "", "en", "s0", 0), (332, "one", None, None, None), (333, "same row " * 60, "en", "s1", 1)]
    return rows


def _measured(text: str | None) -> dict[str, int]:
    t = text or ""
    w = WORD.findall(t)
    three = list(zip(w, w[1:], w[2:], strict=False))
    often = Counter(three)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len({i + k for i, x in enumerate(three) if often[x] > 1 for k in range(3)}),
        "n_lines": len(lines), "n_chars": len(t), "n_upper": len(re.findall("[A-Z]", t)), "n_digits": len(re.findall("[0-9]", t)), "n_pipes": t.count("|"), "n_distinct_words": len(set(w)), "n_short_lines": sum(len(x.encode()) < 30 for x in lines),
    }


def _features(m: dict[str, int]) -> dict[str, int]:
    return {k: 1000 * m[a] // max(m[b], 1) for k, (a, b) in Q.RATIOS.items()} | {"n_words": m["n_words"]}


def _failed(m: dict[str, int]) -> bool:
    return m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]


def _held(doc_id: int) -> bool:
    h = xxhash.xxh64_intdigest(b"held", xxhash.xxh64_intdigest(str(doc_id).encode(), 42))
    return (h - (h >> 63 << 64)) % 3 == 0


def _holds(c: tuple, x: dict) -> bool:
    return (x[c[0]] >= c[2]) == c[1]


def _plain_rules(rows: list[tuple[dict, bool, bool]]) -> list[list[tuple]]:
    """Sequential covering one row and one threshold at a time; ``rows``: features, whether bad, whether held back."""
    rules, left = [], rows
    while len(rules) < 12:
        grow, judge = [x for x in left if not x[2]], [x for x in left if x[2]]
        if not any(bad for _, bad, _ in grow) or not judge:
            break
        rule, now = [], grow
        while len(rule) < 4 and any(not bad for _, bad, _ in now):
            p0 = sum(bad for _, bad, _ in now)
            before, best, got = np.log2((p0 + 0.5) / (len(now) + 1)), 0.0, None
            for name in Q.FEATURES:
                values = sorted({x[name] for x, _, _ in now})
                for above in (True, False):
                    top = None
                    for low, high in zip(values, values[1:], strict=False):
                        c = (name, above, (low + high + 1) // 2)
                        hit = [bad for x, bad, _ in now if _holds(c, x)]
                        gain = sum(hit) * (np.log2((sum(hit) + 0.5) / (len(hit) + 1)) - before)
                        if top is None or gain > top[0]:
                            top = gain, c
                    if top and top[0] > best + 1e-9:
                        best, got = top
            if got is None:
                break
            rule, now = [*rule, got], [x for x in now if _holds(got, x[0])]
        covered = lambda cs, some: [bad for x, bad, _ in some if all(_holds(c, x) for c in cs)]
        cuts = []
        for k in range(len(rule), 0, -1):
            hit = covered(rule[:k], judge)
            cuts.append(((2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0, sum(hit), len(hit) - sum(hit), rule[:k]))
        if not cuts:
            break
        _, p, n, rule = max(cuts, key=lambda s: s[:2])
        hit = covered(rule, grow)
        if p < 5 or p < 0.9 * (p + n) or sum(hit) < 0.9 * len(hit):
            break
        rules.append(rule)
        left = [x for x in left if not all(_holds(c, x[0]) for c in rule)]
    return rules


def _plain_kept(rows: list[tuple]) -> tuple[list[list[tuple]], set[int]]:
    measured = {x[0]: _measured(x[1]) for x in rows}
    rules = _plain_rules([(_features(measured[x[0]]), x[4] == 0, _held(x[0])) for x in rows if x[4] is not None and not _failed(measured[x[0]])])
    return rules, {i for i, m in measured.items() if not _failed(m) and not any(all(_holds(c, _features(m)) for c in rule) for rule in rules)}


def _tables(spark, seed: int):
    rows = _documents(seed)
    docs = spark.createDataFrame([x[:4] for x in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(x[0], x[4], 0) for x in rows if x[4] is not None], "doc_id long, quality int, toxic int")
    return rows, docs, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_learned_verdict(spark, seed):
    rows, docs, labels = _tables(spark, seed)
    rules, kept = _plain_kept(rows)
    assert len(rules) >= 1
    assert [[(c.feature, c.above, c.threshold) for c in rule] for rule in Q.fit(docs, labels)] == rules
    got = Q.digest(docs, labels).collect()
    assert {r.doc_id for r in got if r.kept} == kept and 50 < len(kept) < len(rows) - 50
    assert all(_measured(t) == {m: r[m] for m in Q.MEASURES} for r, t in ((r, {x[0]: x[1] for x in rows}[r.doc_id]) for r in got))


def test_pipeline_against_a_plain_version(spark, tmp_path):
    """Rules and near duplicates in plain Python, leaks and passes by the operators' SQL, shards as what goes in."""
    duckdb, pipeline = pytest.importorskip("duckdb"), pytest.importorskip("corpus_pipeline")
    from heronlake.llm import decontamination, mixing
    from tests.llm.test_joins_and_models import brute

    rows, docs, labels = _tables(spark, 1)
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame([(1, ITEM)], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = Counter((r.doc_id, r.text_bytes, r.text_md5) for r in pipeline.run(spark, str(tmp_path)).collect())

    kept = _plain_kept(rows)[1]
    first = brute([x[:2] for x in rows if x[0] in kept], 5, 80, 100)
    left = {i for i, (_, least) in first.items() if i == least}
    assert len(left) < len(kept) and {320, 321} <= left
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [x[:4] for x in rows if x[0] in left])
    con.execute("CREATE TABLE benchmark AS SELECT 1::BIGINT AS item_id, ? AS text", [ITEM])
    leaks = {r[0] for r in con.execute(f"SELECT DISTINCT doc_id FROM ({decontamination.ORACLE})").fetchall()}
    assert leaks == {320, 321}
    con.execute("DELETE FROM documents WHERE doc_id IN (320, 321)")
    passes = dict(con.execute(f"SELECT doc_id, passes FROM ({mixing.ORACLE})").fetchall())
    texts = {x[0]: x[1].encode() for x in rows if x[0] in left}
    assert got == Counter({(i, len(texts[i]), hashlib.md5(texts[i]).hexdigest()): n for i, n in passes.items() if n})
    assert max(passes.values()) == 2 and min(passes.values()) < 2
