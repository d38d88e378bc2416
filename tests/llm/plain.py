"""Plain Python versions of the operators, to compare with on small tables."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def components(nodes, linked):
    """Smallest node that links reach, for every node."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def shingles(text, size):
    words = WORD.findall(low(text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def near_duplicates(texts, size, percent):
    """{id: (number of shingles, component)} by comparing all pairs."""
    sets = {k: shingles(t, size) for k, t in texts.items()}
    keys = list(sets)
    links = []
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if either and 100 * both >= percent * either:
                links.append((a, b))
    roots = components(keys, links)
    return {k: (len(sets[k]), roots[k]) for k in keys}


def pair_value(a, b):
    """What decides about cuts between two words: a given value, not part of the rule."""
    import numpy as np

    from lensmere.llm import flat, spans

    h = [flat.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())])) for w in (a, b)]
    return int(flat.mix(h[0] * spans._STEP + h[1])[0])


def sentences(text, longest=16, around=4):
    """Lists of word matches.  A sentence of more than ``longest`` words is cut before each word whose pair with the
    word before has a value below those of the four pairs before and not above those of the four behind; parts still
    too long are cut every ``longest`` words.  Each part keeps more than ``around`` words."""
    found = list(WORD.finditer(text))
    whole, now = [], []
    for i, m in enumerate(found):
        now.append(m)
        w = m[0]
        if (i + 1 == len(found) or w[-1] in ".!?" or len(w) > 1 and w[-1] in "\"')]" and w[-2] in ".!?"
                or re.search(r"[\n\r]", text[m.end():found[i + 1].start()])):
            whole.append(now)
            now = []
    out = []
    for s in whole:
        n = len(s)
        value = [None] + [pair_value(low(s[i - 1][0]), low(s[i][0])) for i in range(1, n)] if n > longest else []
        cuts = [0]
        for i in range(around + 1, n - around if n > longest else 0):
            if all(value[i] < value[i - d] and value[i] <= value[i + d] for d in range(1, around + 1)):
                cuts.append(i)
        for a, b in zip(cuts, cuts[1:] + [n]):
            while b - a > longest + around:
                out.append(s[a:a + longest])
                a += longest
            out.append(s[a:b])
    return out


def without_repeats(rows, size=3):
    """[(text, words removed)] for (key, text) rows in order of their keys; rows that repeat both are one."""
    import functools

    first, result = {}, {}
    parts = functools.cache(sentences)
    for key, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        units = parts(text or "")
        names = [tuple(low(m[0]) for m in u) for u in units]
        covered = [False] * len(units)
        for j in range(max(1, len(units) - size + 1) if units else 0):
            run = tuple(names[j:j + size])
            if first.setdefault(run, (key, text, j)) != (key, text, j):
                for x in range(j, min(len(units), j + size)):
                    covered[x] = True
        out, at, gone, x = "", 0, 0, 0
        while x < len(units):
            y = x
            while y < len(units) and covered[y] == covered[x]:
                y += 1
            if covered[x]:
                out += text[at:units[x][0].start()]
                at = units[y][0].start() if y < len(units) else len(text)
                gone += sum(map(len, units[x:y]))
            x = y
        result[key, text] = ((out + text[at:]).strip(" \t\n\r\f\v"), gone) if gone else (text, 0)
    return [result[r] for r in rows]


def kneser_ney(trusted, order=5, uniform=1 / 65536):
    """A function giving the mean of -ln p per character, from (text, lang) rows."""
    import math

    top = defaultdict(int)
    for text, lang in trusted:
        chars = [None] * order + list(text or "")
        for i in range(order, len(chars)):
            top[lang, tuple(chars[i - order + 1:i + 1])] += 1
    counts = {order: dict(top)}
    for n in range(order - 1, 0, -1):
        lower = defaultdict(int)
        for lang, gram in counts[n + 1]:
            lower[lang, gram[1:]] += 1
        counts[n] = dict(lower)
    share, weight = {}, {}
    for n, own in counts.items():
        n1, n2, n3, n4 = (sum(c == k for c in own.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.75, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.25]
        d = [min(max(x, 0.1), k - 0.1) for k, x in enumerate(d, 1)]
        total, given = defaultdict(int), defaultdict(float)
        for (lang, gram), c in own.items():
            total[lang, gram[:-1]] += c
            given[lang, gram[:-1]] += d[min(c, 3) - 1]
        for (lang, gram), c in own.items():
            share[lang, gram] = (c - d[min(c, 3) - 1]) / total[lang, gram[:-1]]
        for context, t in total.items():
            weight[context] = given[context] / t

    def score(text, lang):
        chars = [None] * order + list(text)
        total = 0.0
        for i in range(order, len(chars)):
            p = uniform
            for n in range(1, order + 1):
                gram = tuple(chars[i - n + 1:i + 1])
                p = share.get((lang, gram), 0.0) + weight.get((lang, gram[:-1]), 1.0) * p
            total -= math.log(p)
        return total / len(text)

    return score
