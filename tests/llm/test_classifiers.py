import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import clause_weight, mixture, unlike_twins

from emergent.llm import langid, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(100_000, None), (100_001, ""), (100_002, " \n"), (100_003, "123 456 !!"), (100_004, "word " * 30_000), (None, "some text here"), (100_005, "same"), (100_005, "same")]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def stats(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)]


def quality_probability(text, model):
    """The model's verdict from n-grams counted one by one."""
    from emergent.llm.blocks import hash_of

    whole = (1 << 64) - 1

    def mix(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & whole
        h = (h ^ h >> 27) * 0x94D049BB133111EB & whole
        return h ^ h >> 31

    def chained(parts):
        out = 0
        for part in parts:
            out = mix((out * 3 + part + 0x632BE59BD9B4E019) & whole)
        return out

    words = [hash_of(w.encode()) for w in WORD.findall(text)]
    pairs = [0xA5A5A5A5A5A5A5A5 if a == b else chained([a, b]) for a, b in zip(words, words[1:])]
    raw = text.encode()
    grams = lambda n: [int.from_bytes(raw[i : i + n], "big") * 0x9E3779B97F4A7C15 & whole for i in range(len(raw) - n + 1)]
    x, at = np.zeros(quality.WORD_DIMS + quality.BYTE_DIMS), 0
    for values, dims in ((words, quality.WORD_DIMS // 2), (pairs, quality.WORD_DIMS // 2), (grams(3), quality.BYTE_DIMS // 2), (grams(5), quality.BYTE_DIMS // 2)):
        for cell, n in Counter((v >> 11) % dims for v in values).items():
            x[at + cell] = (n / len(values)) ** 0.5
        at += dims
    return 1 / (1 + np.exp(-(model.a * (x @ model.weights + model.bias) + model.b)))


def test_quality(spark):
    r = random.Random(1)
    good = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "the", "of"]) + r.choice("abc") for _ in range(80)) for _ in range(150)]
    bad = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "the", "of", "on", "in", "at"]) + r.choice(["%%%", "###", "$$$"]) for _ in range(80)) for _ in range(150)]
    docs = [(i, t) for i, t in enumerate(good + bad)] + EDGE + [(100_010, "é a\né a\nb c d\nb c d b c d")]
    a, b = unlike_twins(2048)
    docs += [(100_011, f"{a}\n{b}\n{a} x y {b} x y {a} x y")]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, n_words string")
    labels = spark.createDataFrame([(i, int(i < 150), None) for i in range(300) if i % 3], "doc_id long, quality long, toxic long")
    model = quality.fit(frame, labels)
    rows = quality.assess(frame, model).collect()
    assert sorted((r["doc_id"] or -1, [r[k] for k in quality.STAT_NAMES]) for r in rows) == sorted((d or -1, stats(t)) for d, t in docs)
    verdict = {r["doc_id"]: r for r in rows}
    assert all(verdict[i]["kept"] == (i < 150) for i in range(300))
    assert all(not v["kept"] for v in verdict.values() if v["base_failed"]) and verdict[100_000]["base_failed"] and verdict[100_004]["base_failed"]
    for d, t in docs[::25] + docs[300:]:
        assert verdict[d]["probability"] == pytest.approx(quality_probability(t or "", model), abs=1e-4)
    kept = quality.keep(frame, model)
    assert kept.columns == frame.columns and {x["doc_id"] for x in kept.collect()} == {d for d, v in verdict.items() if v["kept"]}
    assert quality.fit(frame, labels.where("quality = 1")) is None and quality.fit(frame, labels.limit(0)) is None
    assert quality.assess(frame, None).where("kept").count() == 300
    assert quality.assess(frame.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def toxic(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("etaoinsr") for _ in range(5))
    docs, labels = [], []
    for i in range(800):
        words = [word() for _ in range(40)]
        if i % 4 == 0:
            words[r.randrange(40)] = r.choice(["zorgling", "zorgster", "blatherskite"])
        docs.append((i, " ".join(words) + "."))
        labels.append((i, None, int(i % 4 == 0)))
    frame = spark.createDataFrame(docs + EDGE, "doc_id long, text string")
    return frame, spark.createDataFrame(labels, "doc_id long, quality long, toxic long")


def test_toxicity(spark, toxic):
    frame, labels = toxic
    model = toxicity.fit(frame, labels)
    rows = toxicity.score(frame, model).collect()
    assert len(rows) == 800 + len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    known = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 800]
    assert all(r["held_out"] == held(r["doc_id"]) for r in known)
    right = [r["predicted"] == int(r["doc_id"] % 4 == 0) for r in known if r["held_out"]]
    assert sum(right) >= 0.97 * len(right)
    assert all(r["predicted"] == 0 for r in rows if (r["doc_id"] or 0) >= 100_000)
    nothing = toxicity.fit(frame, labels.limit(0))
    assert toxicity.score(frame, nothing).where("predicted = 1").count() == 0
    assert toxicity.score(frame.limit(0), model).count() == 0


I, O, T, N, R, H = toxicity.INSULT, toxicity.OTHER, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.THREAT


def weigh(*symbols, bare=toxicity.BARE):
    return toxicity.grammar(bare).weight(list(symbols), [4.0 if x == I else 0.0 for x in symbols])


def test_grammar_scores_clauses():
    assert weigh(O, O) == 0 and weigh(O, I) == 4 * toxicity.BARE and weigh(O, I, bare=0.0) == 0 < weigh(T, O, I, bare=0.0)
    assert weigh(T, O, I) > weigh(O, I) > weigh(R, O, I) > weigh(N, R, I) > 0
    assert weigh(N, O, O, O, I) == weigh(I)  # out of the negation's reach
    assert weigh(H) == 0 and weigh(O, H, O) == 0 and weigh(H, T) > 0 and weigh(T, O, H) > 0
    assert 0 < weigh(N, H, T) < weigh(H, T) and 0 < weigh(R, T, H) < weigh(T, H)


def test_each_machine_reads_what_the_one_before_writes():
    """Softening reaches a threat only once the machines before have matched it with a target."""
    g = toxicity.Composition((toxicity.THREATENING, toxicity.NEGATED))
    state, _, _ = g.step(g.start, H)
    state, factor, _ = g.step(state, N)
    assert factor == 1 and g.step(state, T)[1] == 0.3 and g.step(g.step(g.start, N)[0], T)[1] == 1


def test_targets_act_on_both_sides_of_an_insult():
    assert weigh(I, O, T) == weigh(T, O, I) == weigh(T, I, T) == 5
    assert weigh(I, *[O] * 5, T) == 5 and weigh(I, *[O] * 6, T) == weigh(I)
    assert weigh(N, I, T) == 0.6 * 5


def test_grammar_is_its_rules():
    r = random.Random(6)
    kinds = {"o": O, "i": I, "h": H, "t": T, "n": N, "r": R}
    for _ in range(3000):
        symbols = r.choices("oooihtnr", k=r.randrange(1, 16))
        weights = [r.choice([2.0, 3.5]) if s == "i" else 0.0 for s in symbols]
        bare = r.choice([0.0, 0.8])
        assert toxicity.grammar(bare).weight([kinds[s] for s in symbols], weights) == pytest.approx(clause_weight(symbols, weights, bare)), symbols


def test_toxicity_features_are_those_of_brute_force(spark, toxic):
    """Tokens, clauses and features of whole texts, by regular expressions and the rules."""
    import math

    import pyarrow as pa

    from emergent.llm.blocks import blocks_of, hash_of

    frame, labels = toxic
    model = toxicity.fit(frame, labels)
    odds = dict(zip(model.terms.tolist(), model.odds.tolist(), strict=True))
    kinds = {w: s for kind, s in ((H, "h"), (T, "t"), (N, "n"), (R, "r")) for w in toxicity.WORDS[kind].split()}

    def token(word):
        hashes = [hash_of(word.encode(), lower=True)] + [(hash_of(word[:k].encode(), lower=True) + k) % (1 << 64) for k in toxicity.PREFIXES if len(word) > k]
        weight = max([odds.get(x, 0.0) for x in hashes])
        return ("i", weight) if weight > 0 else (kinds.get(word.translate({i: i + 32 for i in range(65, 91)}), "o"), 0.0)

    r = random.Random(5)
    words = ["You", "kill", "not", "said", "zorgling", "Zorgster!", "blatherskites", "fine", "día,", "nie.", "x(y)", "they:", "tú", "42", "hurt;"]
    texts = [" ".join(r.choices(words, k=r.randrange(0, 40))) for _ in range(200)] + ["", "you zorgling " * 3000]
    found = [row for block in blocks_of(pa.array(texts)) for row in model.features(block).tolist()]
    for text, row in zip(texts, found, strict=True):
        scores = []
        for clause in re.split(r"[.!?;:,\n()]+", text):
            marks = [token(w) for w in re.findall(r"[A-Za-z\x80-\U0010ffff]+", clause)]
            scores.append(clause_weight([s for s, _ in marks], [w for _, w in marks], model.bare))
        scores = [x for x in scores if x > 0]
        assert row == pytest.approx([float(bool(scores)), max(scores, default=0.0), math.log1p(sum(scores))])


def test_language(spark):
    r = random.Random(3)
    syllables = {"aa": ["ka", "ti", "mo"], "bb": ["sch", "ung", "ver"], "cc": ["ção", "ê", "lh"]}
    make = lambda lang, n: " ".join("".join(r.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    docs = [(i, make(lang, 30), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 100)]
    docs += [(900, make("aa", 40) + " " + make("bb", 12), "aa"), (901, make("cc", 30), None)] + [(d, t, "aa" if t else None) for d, t in EDGE]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(frame)
    rows = langid.predict(frame, model).collect()
    assert len(rows) == len(docs) and all(0 <= x["score"] <= 1 for x in rows)
    by = {x["doc_id"]: x for x in rows}
    assert all(by[i]["lang_pred"] == lang for i, _, lang in docs[:300])
    assert by[901]["lang_pred"] == "cc" and by[900]["lang_pred"] == "aa" and set(by[900]["mixture"]) == {"aa", "bb"}
    assert set(by[0]["mixture"]) == {"aa"}
    assert [by[d]["lang_pred"] for d in (100_000, 100_001, 100_002, 100_003)] == ["und"] * 4 and by[100_000]["score"] == 0
    assert all(x["held_out"] == held(x["doc_id"]) for x in rows if x["doc_id"] is not None)
    for d, text, _ in docs[::10] + docs[300:302]:
        assert by[d]["mixture"] == pytest.approx(mixture(text, model.names, model.log_p), abs=2e-3)
    empty = langid.fit(frame.where("lang is null"))
    assert {x["lang_pred"] for x in langid.predict(frame, empty).collect()} == {"und"}
    assert langid.predict(frame.limit(0), model).count() == 0


def test_every_language_is_learnt(spark):
    r = random.Random(4)
    langs = [f"l{k:02}" for k in range(70)]
    syllables = {lang: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(4)] for lang in langs}
    sizes = {lang: 20 if k < 64 else 10 for k, lang in enumerate(langs)}
    owners = [lang for lang in langs for _ in range(sizes[lang])]
    docs = [(i, " ".join("".join(r.choice(syllables[lang]) for _ in range(3)) for _ in range(30)), lang) for i, lang in enumerate(owners)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(frame)
    assert model.names == langs
    by = {x["doc_id"]: x["lang_pred"] for x in langid.predict(frame, model).collect()}
    assert all(by[i] == lang for i, _, lang in docs)
    assert langid.fit(frame, rows=1).names == langs
