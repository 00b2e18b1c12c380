"""Plain Python versions of the operators' contracts, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import combinations, groupby

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KINDS = ("assign", "access", "hex")


def exact(rows):
    """(keep_id, group_size, sha) per doc_id; rows are (doc_id, text), doc_ids unique and not null."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d))
    return {
        d: (min(g)[1], len(g), hashlib.sha256(norm.encode()).hexdigest()) for norm, g in groups.items() for _, d in g
    }


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    lines, seen = 0, set()
    for line in t.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), lines, len(covered), failed


def secrets(text):
    t = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(spans)


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def shingles(text, words=2):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(min(words, len(w)))])) if w else frozenset()


def components(rows, words=2, percent=80):
    """(n_shingles, component_id) per doc_id."""
    sets = {d: shingles(t, words) for d, t in rows}
    having, common = defaultdict(list), Counter()
    for d, s in sets.items():
        for x in s:
            having[x].append(d)
    for ids in having.values():
        common.update(combinations(sorted(ids), 2))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Target per source by resharing the excess until none is above; sizes by source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        if not free:
            return {s: most * sizes[s] for s in names}
        level = (total - sum(most * sizes[s] for s in full)) / sum(weigh[s] for s in free)
        above = {s for s in free if level * weigh[s] > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in full else level * weigh[s] for s in names}
        full |= above


def kd_shards(rows, spans, shards):
    """Shard per row by plain recursion; rows are dicts with size, tie and the dimensions of ``spans`` (name: low, high)."""
    out = {}

    def split(nodes, first, w):
        if w == 1 or not nodes:
            out.update((r["_row"], first) for r in nodes)
            return
        wide = {d: (max(r[d] for r in nodes) - min(r[d] for r in nodes)) / max(high - low, 1e-9)
                for d, (low, high) in spans.items()}
        axis = max(wide, key=wide.get)  # the first of equals
        low, high = spans[axis]

        def key(r):
            return math.floor((r[axis] - low) / max(high - low, 1e-9) * float((1 << 31) - 1)), r["_tie"]

        goal, under, left = sum(r["size"] for r in nodes) * (w // 2) // w, 0, []
        ranked = [list(g) for _, g in groupby(sorted(nodes, key=key), key)]
        for same in ranked:
            upto = under + sum(r["size"] for r in same)
            if goal == 0 or (upto >= goal and goal - under < upto - goal):
                break
            left += same
            under = upto
            if upto >= goal:
                break
        ids = {r["_row"] for r in left}
        split(left, first, w // 2)
        split([r for r in nodes if r["_row"] not in ids], first + w // 2, w - w // 2)

    split(rows, 0, shards)
    return out


def trigram_cells(text, bits=13):
    """Counts of byte trigrams of letters by hash cell."""
    raw = f" {text.lower()} ".encode()
    raw = re.sub(b" +", b" ", bytes(b if b > 127 or chr(b).isalpha() else 32 for b in raw))
    codes = (raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16 for i in range(len(raw) - 2))
    return Counter((c * 2654435761 % 2**32) >> (32 - bits) for c in codes)


def unit(vector):
    norm = math.sqrt(sum(x * x for x in vector.values()))
    return {k: x / norm for k, x in vector.items()}


def cosine(a, b):
    if len(b) < len(a):
        a, b = b, a
    return sum(x * b.get(k, 0.0) for k, x in a.items())


def language_model(learn, centroids=3, rounds=12, reject=0.001):
    """(vector function, centroids as (lang, vector), floors) of rows (doc_id, text, lang), all of them sampled."""
    df = Counter(c for _, t, _ in learn for c in trigram_cells(t))
    idf = defaultdict(lambda: math.log(1 + len(learn)) + 1,
                      {c: math.log((1 + len(learn)) / (1 + n)) + 1 for c, n in df.items()})

    def vector(text):
        return unit({c: math.log1p(n) * idf[c] for c, n in trigram_cells(text).items()})

    centres, floors = [], {}
    for lang in sorted({x for _, _, x in learn}):
        rows = [vector(t) for _, t, x in sorted(learn) if x == lang and any(map(str.isalpha, t))]
        if not rows:
            continue
        own = [rows[0]]
        while len(own) < min(centroids, len(rows)):
            own.append(min(rows, key=lambda r: max(cosine(r, c) for c in own)))
        for _ in range(rounds):
            groups = defaultdict(list)
            for r in rows:
                groups[max(range(len(own)), key=lambda c: cosine(r, own[c]))].append(r)
            for c, members in groups.items():
                total = Counter()
                for r in members:
                    total.update(r)
                own[c] = unit(total)
        best = sorted(max(cosine(r, c) for c in own) for r in rows)
        at = (len(best) - 1) * reject
        low = best[int(at)]
        floors[lang] = low + (best[min(int(at) + 1, len(best) - 1)] - low) * (at - int(at))
        centres += [(lang, c) for c in own]
    return vector, centres, floors
