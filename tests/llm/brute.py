"""Plain Python versions of the operators, for small tables."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def dedup_lines(docs, least=50):
    """docs: list of (id, text). A line goes if it lies in a run of ``least`` words or more that stands at an earlier place."""
    first, spans = {}, []
    strip = " \t\n\x0b\x0c\r"
    for no, (i, text) in enumerate(sorted(docs, key=lambda d: d[0])):
        lines = [(k, x.strip(strip)) for k, x in enumerate((text or "").split("\n")) if x.strip(strip)]
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += len(WORD.findall(lines[b][1]))
                if total >= least:
                    key = tuple(x for _, x in lines[a : b + 1])
                    if first.setdefault(key, (i, a)) < (i, a):
                        spans.append((i, {k for k, _ in lines[a : b + 1]}))
                    if total >= least * 40:
                        break
    out = {}
    for i, text in docs:
        gone = set().union(*(s for j, s in spans if j == i))
        out[i] = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
    return out


def shingles(text, size):
    words = WORD.findall(lower(text or ""))
    return {tuple(words)} if 0 < len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def components(docs, size, percent=80):
    sets, parent, holders = {i: shingles(t, size) for i, t in docs}, {i: i for i, _ in docs}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in holders.get(s, ()))
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def contamination(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = bench_words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for i, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if (got := windows.get(tuple(w[a : a + k]))) is not None:
                    hit |= set(range(a, a + k))
                    found |= got
        out[i] = (len(w), len(hit), found, bool(hit) and 20 * len(hit) >= len(w))
    return out


SECRETS = (
    ("assign", re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 1, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32),
)


def secrets(text):
    found = [(m.start(), no, m.end(), kind) for no, (kind, rx, group, least) in enumerate(SECRETS) for m in rx.finditer(text or "") if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def quality(docs):
    """Posterior probability of good by document: the label model, one document at a time, with plain sums."""
    import math

    rules = (
        (lambda f: f["symbols"] / f["n"], 0.02, 0.10), (lambda f: f["repeat"] / f["n"], 0.05, 0.30), (lambda f: f["dup"] / max(f["lines"], 1), 0.05, 0.30),
        (lambda f: f["upper"] / max(f["letters"], 1), 0.15, 0.50), (lambda f: f["shouts"] / f["n"], 0.05, 0.30), (lambda f: -f["letters"] / max(f["chars"], 1), -0.92, -0.70),
        (lambda f: f["bare"] / f["n"], 0.02, 0.10), (lambda f: f["symbol_words"] / f["n"], 0.05, 0.30), (lambda f: -f["chars"] / f["n"], -2.5, -1.8),
        (lambda f: f["chars"] / f["n"], 12.0, 18.0), (lambda f: -f["distinct"] / f["n"] * math.sqrt(max(f["n"], 100) / 100), -0.20, -0.08),
    )
    votes = {}
    for i, text in docs.items():
        words = WORD.findall(text or "")
        if not words:
            continue
        n, chars, symbols, dup, repeat = counts(text)
        joined = "".join(words)
        f = {
            "n": n, "chars": chars, "symbols": symbols, "dup": dup, "repeat": repeat, "lines": sum(1 for x in text.split("\n") if WORD.search(x)), "distinct": len(set(words)),
            "upper": sum("A" <= c <= "Z" for c in joined), "letters": sum(c > "\x7f" or (c.isascii() and c.isalpha()) for c in joined), "shouts": joined.count("!") + joined.count("?"),
            "bare": sum(all(c.isascii() and not c.isalnum() for c in w) for w in words), "symbol_words": sum(any(c in "#*$%&|<>" for c in w) for w in words),
        }
        votes[i] = tuple(1 if x(f) <= good + 1e-15 else -1 if x(f) >= bad - 1e-15 else 0 for x, good, bad in rules)
    kinds = Counter(votes.values())
    prior = {0: {-1: 0.35 * 20, 0: 0.15 * 20, 1: 0.5 * 20}, 1: {-1: 0.01 * 20, 0: 0.09 * 20, 1: 0.9 * 20}}
    first = {v: 0.1 if -1 in v else 0.95 for v in kinds}

    def tables(good, base):
        t = [[dict(base[c]) for _ in rules] if isinstance(base, dict) else [dict(x) for x in base[c]] for c in (0, 1)]
        for v, k in kinds.items():
            for r, x in enumerate(v):
                t[0][r][x] += k * (1 - good[v])
                t[1][r][x] += k * good[v]
        return t

    start = [[{x: prior[c][x] + 0.1 * sum(k * (first[v] if c else 1 - first[v]) for v, k in kinds.items() if v[r] == x) for x in (-1, 0, 1)} for r in range(len(rules))] for c in (0, 1)]
    sizes = [2 + 0.1 * sum(k * (1 - first[v]) for v, k in kinds.items()), 18 + 0.1 * sum(k * first[v] for v, k in kinds.items())]
    good, table, share = first, tables(first, prior), 0.9
    for _ in range(200):
        logs = [[{x: math.log(max(y / sum(row.values()), 1e-4)) for x, y in row.items()} for row in side] for side in table]
        good = {}
        for v in kinds:
            bad_, good_ = math.log(1 - share) + sum(logs[0][r][x] for r, x in enumerate(v)), math.log(share) + sum(logs[1][r][x] for r, x in enumerate(v))
            good[v] = 1 / (1 + math.exp(max(-500, min(500, bad_ - good_))))
        table = tables(good, start)
        n = [sizes[0] + sum(k * (1 - good[v]) for v, k in kinds.items()), sizes[1] + sum(k * good[v] for v, k in kinds.items())]
        share = n[1] / sum(n)
    logs = [[{x: math.log(max(y / sum(row.values()), 1e-4)) for x, y in row.items()} for row in side] for side in table]
    out = {}
    for i in docs:
        if i not in votes:
            out[i] = None
            continue
        gap = math.log(share) - math.log(1 - share) + sum(logs[1][r][x] - logs[0][r][x] for r, x in enumerate(votes[i]))
        out[i] = 1 / (1 + math.exp(-gap))
    return out
