"""Plain versions of the operators' results, for small tables."""

import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, size):
    w = words((text or "").translate(LOW))
    if not w:
        return set()
    return {tuple(w[i: i + size]) for i in range(max(1, len(w) - size + 1))}


def classes(docs, size, percent):
    """doc_id -> (set size, smallest reachable doc_id) for [(doc_id, text)] with distinct ids."""
    sets = {i: shingles(t, size) for i, t in docs}
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, x in enumerate(ids):
        for y in ids[:n]:
            a, b = sets[x], sets[y]
            same = len(a & b)
            if a and b and 100 * same >= percent * (len(a) + len(b) - same):
                p, q = root(x), root(y)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def greedy(word, vocabulary):
    """Number of longest-match tokens of a word with its leading space, 1 if it cannot be covered."""
    data, i, n = b" " + word.encode(), 0, 0
    while i < len(data):
        j = len(data)
        while j > i and data[i:j] not in vocabulary:
            j -= 1
        if j == i:
            return 1
        i, n = j, n + 1
    return n


def interactions(docs, labels):
    """(part, order, step) -> counts, for [(doc_id, text, lang)] and [(doc_id, quality, toxic)]."""
    from itertools import permutations

    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = words(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        mine = [x for x in labels if i is not None and x[0] == i]
        rows.append((lang or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                gone = [r for r in own if r[1] & set(order[: step - 1])]
                now = [r for r in own if f in r[1] and not r[1] & set(order[: step - 1])]
                removed[f] += len(now)
                out[part, order, step] = [
                    len(own) - len(gone) - len(now), len(now), sum(f in r[1] for r in gone), sum(r[1] == {f} for r in own),
                    sum(r[2] for r in now), sum(r[3] for r in now)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(removed[order[step - 1]])
    return out


def divergence(docs, least_docs=3, top=200):
    """Rows (lang, source, part, item, value, rank) for [(text, lang, source)]."""
    from collections import Counter, defaultdict

    seen, groups = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        seen[lang or ""].update(set(found))
        groups[lang or "", source or ""].update(found)
    rows = []
    for lang in seen | {k[0]: 0 for k in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least_docs]
        own = {s: c for (la, s), c in groups.items() if la == lang}

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: share(c) for s, c in own.items()}
        q = share(sum(own.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            parts = {
                "pair": [(t, sum(f(p[s][x], p[t][x]) for x in kept)) for t in own if t != s],
                "term": [(x, f(p[s][x], q[x])) for x in kept if own[s][x] and p[s][x] > q[x]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                rows += [(lang, s, part, x, v, r) for r, (x, v) in enumerate(items, 1) if part == "pair" or r <= top]
    return rows


def without_repeats(docs, window=13):
    """(doc_id, n_words, n_removed, hash of what is kept) of each of [(doc_id, text)]."""
    import hashlib

    least = {}
    for i, text in docs:
        w = words(text)
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k: k + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, text in docs:
        w = words(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k: k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
