"""Plain versions of the operators: slow, short, and written without them."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(fps, radius=2):
    """Group number of each fingerprint, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def similar_groups(texts, least=0.8):
    """Group number of each text, and the pairs of different sets of five-word shingles with a Jaccard similarity of 0.8 or more."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    having, root, pairs = defaultdict(list), list(range(len(texts))), []
    for i, s in enumerate(sets):
        for x in s or {()}:
            having[x].append(i)
    common = Counter((i, j) for at in having.values() for n, i in enumerate(at) for j in at[n + 1 :])

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), n in common.items():
        if 9 * n >= 4 * (len(sets[i]) + len(sets[j])):
            if sets[i] != sets[j]:
                pairs.append((i, j))
            root[max(up(i), up(j))] = min(up(i), up(j))
    return [up(i) for i in range(len(texts))], pairs


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    repeated = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 5)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), n < 10 or 100 * len(repeated) > 20 * n


def keeps(text, rules):
    """The verdict of a threshold table."""
    text = text or ""
    n, chars, symbols, dup, _, failed = quality(text)
    m = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_lines": len([x for x in text.split("\n") if words(x)]), "n_shouts": len(text) - len(text.replace("!!", "!"))}
    from gridframe.llm.quality_rules import STOP_WORDS

    m["n_stop_words"] = sum(w.lower() in STOP_WORDS for w in words(text))
    return not failed and all(n < r.from_words or r.least * m[r.per] <= 100 * m[r.measure] <= r.most * m[r.per] for r in rules)


def grams(text):
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in (text or "").lower())):
        padded = f" {w} "
        out.update(w)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def ranking(counts, n=300):
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:n]


def languages(rows, n=300):
    """Profiles from (text, lang)."""
    found = defaultdict(Counter)
    for text, lang in rows:
        if lang is not None and text is not None:
            found[lang].update(grams(text))
    return {lang: {g: r for r, g in enumerate(ranking(c, n))} for lang, c in found.items() if c}


def language(text, profiles, n=300):
    own = ranking(grams(text), n)
    if not own or not profiles:
        return "und", 0.0
    far = {lang: sum(abs(p[g] - r) if g in p else n for r, g in enumerate(own)) for lang, p in sorted(profiles.items())}
    best = min(far, key=lambda x: (far[x], x))
    return best, 1 - far[best] / (n * len(own))


def targets(sizes, cap=3):
    """Target by source, by resharing the excess until nothing is above."""
    from fractions import Fraction

    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: Fraction(1 + i % 3) for i, s in enumerate(order)}
    total, fixed = Fraction(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free}
        above = [s for s in free if share[s] >= cap * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: Fraction(cap * sizes[s]) for s in above}


def mixture(docs, cap=3):
    """How often each of (doc_id, text, source) is taken."""
    size = [len(words(t)) for _, t, _ in docs]
    by = defaultdict(int)
    for (_, _, s), n in zip(docs, size, strict=True):
        by[s] += n
    goal = targets(by, cap)
    out = [0] * len(docs)
    for s in by:
        own = [i for i, d in enumerate(docs) if d[2] == s]
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        own.sort(key=lambda i: (md5(str(docs[i][0])) if docs[i][0] is not None else md5("-" + md5(docs[i][1])) if docs[i][1] is not None else md5(""), docs[i][0] is not None, docs[i][0] or 0, size[i]))
        epochs = int(goal[s] // by[s]) if by[s] else 0
        rest, done = goal[s] - epochs * by[s], 0
        for i in own:
            out[i] = epochs + (2 * done + size[i] <= 2 * rest)
            done += size[i]
    return size, by, goal, out
