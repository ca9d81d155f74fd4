"""Brute-force versions of the operators."""

import math
import re
from collections import defaultdict

FOLD = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < n else [tuple(words[i : i + n]) for i in range(len(words) - n + 1)])


def components(docs, n, num, den):
    """doc_id to (set size, smallest reachable doc_id)."""
    sets = {d: shingles(t, n) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {d: (len(sets[d]), find(d)) for d in ids}


def strip_lines(docs):
    """doc_id to (lines, dropped, text) by the line dedup contract."""
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(FOLD)
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) > 1 and d != min(holders[key(x)]))]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def unlike_twins(size):
    """Two strings of letters, complements in the Thue-Morse order, that every polynomial hash modulo 2**64 confuses from 1024 bytes on."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def clause_weight(symbols, weights, bare):
    """What a clause weighs in the toxicity grammar, rule by rule: o other, i insult, h threat, t target, n negation, r reported speech."""
    near = lambda kind, at, reach: any(symbols[j] == kind for j in range(max(0, at - reach), at))
    ahead = lambda kind, at, reach: kind in symbols[at + 1 : at + 1 + reach]
    menaces = {i for i, s in enumerate(symbols) if s == "h" and near("t", i, 6)}
    open_threats = [i for i, s in enumerate(symbols) if s == "h" and i not in menaces]
    menaces |= {j for j, s in enumerate(symbols) if s == "t" and any(0 < j - i <= 4 for i in open_threats)}
    total = 0.0
    for at, s in enumerate(symbols):
        denied, told = near("n", at, 3), near("r", at, 8)
        if at in menaces:
            total += 4 * (0.3 if denied else 1) * (0.4 if told else 1)
        elif s == "i":
            total += weights[at] * (1.25 if near("t", at, 6) or ahead("t", at, 6) else bare) * (0.6 if denied else 1) * (0.7 if told else 1)
    return total


def mixture(text, names, log_p, steps=8):
    """The language shares of a text, step by step: letter runs, expectation-maximisation, and the nested set of highest penalised likelihood."""
    runs = re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())
    if not runs or not names:
        return {}
    likes = []
    for run in runs:
        padded = b" " + bytes(c + 32 if 65 <= c <= 90 else c for c in run) + b" "
        cells = [(((padded[k - 1] << 16 | padded[k] << 8 | padded[k + 1]) * 0x9E3779B1) & 0xFFFFFFFF) >> 16 for k in range(1, len(padded) - 1)]
        logs = [sum(float(row[c]) for c in cells) for row in log_p]
        likes.append([math.exp(x - max(logs)) for x in logs])
    share = [1 / len(names)] * len(names)
    for _ in range(steps):
        parts = [[a * b for a, b in zip(like, share)] for like in likes]
        share = [sum(p[k] / sum(p) for p in parts) / len(runs) for k in range(len(names))]
    order = sorted(range(len(names)), key=lambda k: (-share[k], k))
    best, chosen = None, 1
    for size in range(1, len(names) + 1):
        mass = sum(share[k] for k in order[:size])
        fit = sum(math.log(sum(like[k] * share[k] for k in order[:size]) / mass + 1e-30) for like in likes)
        score = 2 * fit - (size - 1) * math.log(max(len(runs), 2))
        if best is None or score > best + 1e-6:
            best, chosen = score, size
    mass = sum(share[k] for k in order[:chosen])
    return {names[k]: share[k] / mass for k in order[:chosen] if share[k] > 0}
