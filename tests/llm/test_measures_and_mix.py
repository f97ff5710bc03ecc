from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronlake.llm import mixing, quality_rules, token_files, weak_labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    three = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if three[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_measures(odd, labels, plain):
    got = quality_rules.digest(odd, labels).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, ((i, *measured(t)) for i, t, _ in plain)))
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_are_learnt_and_agree_with_their_expression(spark):
    r = np.random.default_rng(1)
    n = 3000
    x = {f: r.integers(0, 1000, n) for f in quality_rules.FEATURES}
    bad = (x["symbols"] >= 700) & (x["repeated"] < 400) | (x["capitals"] >= 900)
    rules = quality_rules.learn(x, bad, r.random(n) < 0.33)
    said = np.zeros(n, bool)
    for rule in rules:
        said |= quality_rules._covered(rule, x, np.ones(n, bool))
    assert (said == bad).mean() > 0.98
    assert all(c.feature in ("symbols", "repeated", "capitals") for rule in rules for c in rule)
    assert "reject if" in quality_rules.describe(rules)


def test_rules_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.fit(odd, none) == []
    assert quality_rules.keep(odd, none).columns == odd.columns
    assert quality_rules.digest(odd.limit(0), none).count() == 0


def test_keep_matches_digest(odd, labels):
    kept = Counter(str(r.doc_id) for r in quality_rules.digest(odd, labels).collect() if r.kept)
    assert Counter(str(r.doc_id) for r in quality_rules.keep(odd, labels).collect()) == kept


def targets(sizes: dict) -> dict:
    """Sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def test_mix(odd, plain):
    got = mixing.digest(odd).collect()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = defaultdict(int)
    for _, t, s in plain:
        sizes[s] += size(t)
    goal = targets(sizes)
    source = {(str(i), size(t)): s for i, t, s in plain}
    taken = defaultdict(int)
    assert len(got) == len(plain)
    for r in got:
        s = source[str(r.doc_id), r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(goal[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    longest = {s: max(size(t) for _, t, x in plain if x == s) for s in sizes}
    assert all(abs(taken[s] - goal[s]) <= longest[s] for s in sizes)
    assert sorted(map(str, mixing.digest(odd).collect())) == sorted(map(str, got))


def test_mix_rows(odd):
    assert mixing.mix(odd).columns == odd.columns
    passes = Counter()
    for r in mixing.digest(odd).collect():
        passes[str(r.doc_id)] += r.passes if r.size else 1
    assert Counter(str(r.doc_id) for r in mixing.mix(odd).collect()) == +passes
    assert mixing.digest(odd.limit(0)).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, odd, plain, encoding, tmp_path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(token_files.default_tokenizer())
    path = f"file://{tmp_path}/t"
    token_files.write(odd, path, encoding=encoding)
    got = [tuple(r) for r in token_files.digest(spark, path).collect()]
    start, expect = 0, []
    for i, t, _ in sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        expect.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(str, got)) == sorted(map(str, expect))
    one = token_files.read(spark, path, "doc_id", "n_tokens").where("doc_id = 7")
    assert one.count() == 1 and "ids" not in one._jdf.queryExecution().executedPlan().toString()


def test_other_tokenizers_encode_plainly():
    import public_tokenizers
    from tokenizers import Tokenizer

    assert not token_files.Encoder(token_files.default_tokenizer()).plain
    path = public_tokenizers.path("byte_bpe_50k.json")
    other, own = token_files.Encoder(path), Tokenizer.from_file(path)
    texts = ["Hello,  World's\n two lines", "", "  x", "naïve 42"]
    assert other.plain and [np.frombuffer(x, "<i4").tolist() for x in other.encode([t.encode() for t in texts], b"")] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_empty(odd):
    assert token_files.write_and_read(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_files.write(odd, "/nowhere", encoding="other")


def test_expectation_maximisation_finds_accuracies():
    r = np.random.default_rng(2)
    truth = r.random(20_000) < 0.3
    accuracy, covers = np.array([0.9, 0.8, 0.7, 0.95]), np.array([0.9, 0.8, 0.9, 0.5])
    votes = np.where(r.random((20_000, 4)) < accuracy, truth[:, None], ~truth[:, None]).astype(int)
    votes[r.random((20_000, 4)) > covers] = 2
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    m = weak_labels.expectation_maximisation(patterns, n.astype(float))
    assert m.share == pytest.approx(0.3, abs=0.02)
    right = m.chance[1, :, 1] / (m.chance[1, :, 1] + m.chance[1, :, 0])
    assert np.allclose(right, accuracy, atol=0.03)
    assert ((m.posterior(votes) > 0.5) == truth).mean() > 0.93


def test_weak_labels_on_odd_rows(odd):
    got = weak_labels.digest(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.quality_score <= 1 and r.kept == (r.quality == 1 and r.toxic == 0) for r in got)
    assert weak_labels.digest(odd.limit(0)).count() == 0


def test_weak_labels_held_out(spark):
    """Truth that the labellers do not see: junk and abuse among prose."""
    import random

    from tests.llm.conftest import prose

    r = random.Random(4)
    rows, truth = [], {}
    for i in range(900):
        t = prose(r, r.randrange(60, 120))
        kind = i % 10
        if kind == 0:
            t = " ".join(w + r.choice(["###", "$$$", "|||"]) for w in t.split())
        elif kind == 1:
            w = t.split()
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "moron", "pathetic", "worthless", "scum"]))
            t = " ".join(w)
        rows.append((i, t))
        truth[i] = kind
    got = weak_labels.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum((r.quality == 0) == (truth[r.doc_id] == 0) for r in got) > 880
    assert sum((r.toxic == 1) == (truth[r.doc_id] == 1) for r in got) > 880


def test_weak_labels_learn_other_languages(spark):
    """Abuse in a language that no list covers, told by the labels of every third document."""
    import random

    from tests.llm.conftest import prose

    r = random.Random(12)
    rows, labels, truth = [], [], {}
    for i in range(1200):
        w = prose(r, r.randrange(60, 120)).split()
        lang, bad = ("en", "fr", None)[i % 3], i % 8 == 0
        for _ in range(3 if bad else 0):
            w.insert(r.randrange(len(w)), r.choice({"en": ["idiot", "scum", "vile"], "fr": ["crétin.", "salaud", "minable"]}.get(lang, ["idiot", "scum"])))
        rows.append((i, " ".join(w), lang))
        truth[i] = bad
        if i // 3 % 3 == 0:
            labels.append((i, 1, int(bad)))
    labels += [(None, 1, 1), (3, 1, None), (5000, 1, 1), (4, 1, 0), (4, 1, 1)]
    docs, told = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    learnt = weak_labels.learn_words(docs, told)
    assert set(weak_labels._hashed(["crétin", "salaud", "minable"])) <= set(learnt["fr"]) and len(learnt["fr"]) < 6
    got = weak_labels.digest(docs, told).collect()
    assert sum(r.toxic == 1 for r in got if truth[r.doc_id]) >= 0.97 * sum(truth.values())
    assert sum(r.toxic == 1 for r in got if not truth[r.doc_id]) <= 0.03 * len(rows)
    assert weak_labels.learn_words(docs, told.limit(0)) == {}


def test_weak_labels_of_long_texts(monkeypatch, spark):
    """Listed words count among thousands of others, even where the scorer sees nothing."""
    import random

    from tests.llm.conftest import prose

    r = random.Random(14)
    rows = []
    for i in range(600):
        w = prose(r, r.randrange(60, 120)).split()
        if i % 10 == 0:
            w[::20] = ["idiot", "scum", "vile", "pathetic", "moron", "trash"][: len(w[::20])]
        rows.append((i, " ".join(w)))
    for i in range(600, 630):
        w = [f"{r.choice('abcdefgh')}{r.randrange(10**6)}word" for _ in range(12_000)]
        if i % 6 == 0:
            w[500], w[7000] = "idiot", "vile"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(weak_labels, "train", lambda *_: (np.zeros(1 << weak_labels.FEATURE_BITS), -5.0))
    got = {r.doc_id: r for r in weak_labels.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].toxic for i in range(600, 630)] == [int(i % 6 == 0) for i in range(600, 630)]


def test_hash_is_the_same_elsewhere(spark):
    import hashlib

    rows = spark.range(50).select("id", mixing.key_hash(F.col("id")).alias("h")).collect()
    assert all(r.h == int(hashlib.md5(f"mix{r.id}".encode()).hexdigest()[:15], 16) for r in rows)
