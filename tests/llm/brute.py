"""Plain definitions, in Python alone, that the operators are held against."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def components(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_duplicates(docs, k=2, percent=80):
    sets = {}
    for i, t in docs:
        w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in words(t)]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    edges = []
    for i, s in sets.items():
        common = Counter(j for x in s for j in where[x] if j < i)
        edges += [(i, j) for j, c in common.items() if 100 * c >= percent * (len(s) + len(sets[j]) - c)]
    comp = components(sets, edges)
    return {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}


def credentials(text):
    text = text or ""
    kinds = (("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
             ("access", r"(AKIA[A-Z0-9]+)", 1, 18), ("hex", r"([0-9a-f]+)", 1, 16))
    found = [(m.start(), r, k, m.end()) for r, (k, p, g, n) in enumerate(kinds) for m in re.finditer(p, text) if len(m.group(g)) >= n]
    counts = [sum(f[2] == k[0] for f in found) for k in kinds]
    return (*counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found)).encode()).hexdigest())


def repeated_words(docs, size=20):
    docs = sorted(docs)
    seen, out = set(), {}
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            x = tuple(w[j : j + size])
            if x in seen:
                gone[j : j + size] = [True] * size
            seen.add(x)
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode("utf-8", "surrogatepass")).hexdigest())
    return out


def base_quality(text):
    text = text or ""
    w = words(text)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    twice = set()
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            twice |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(twice) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(twice), failed


def linked(text, among_weak, scope=300):
    """(spans, links) of the scan: all base spans, and the weak ones that a complement lies near to, by comparing all pairs."""
    text = text or ""
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    login = r"(?i:user_?name|user|login|account|client_?id)\x20*[:=]\x20*[A-Za-z0-9._@-]+"
    kinds = (("assign", assign, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16), ("bare_key", r"(?<![A-Za-z0-9+])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+])", 0, 40),
             ("login", login, 0, 6), ("endpoint", r"""(?:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+""", 0, 8))
    found = [(m.start(), r, m.end(), k) for r, (k, p, g, n) in enumerate(kinds) for m in re.finditer(p, text) if len(m.group(g)) >= n]
    wants = {"bare_key": (("access", "assign"), ("login", "endpoint")), "login": (("assign",), ("bare_key",)), "endpoint": (("access", "assign"), ("bare_key",))}
    base, links, weak = [f for f in found if f[1] < 3], [], []
    for w in found:
        if w[3] not in wants:
            continue
        near = {}
        for o in found:
            strong = o[3] in wants[w[3]][0]
            if not strong and not (among_weak and o[3] in wants[w[3]][1]):
                continue
            away = max(o[0] - w[2], w[0] - o[2])
            if away > scope or (away < 0 and not (strong and w[3] != "bare_key")):
                continue
            one, other = text[: w[2]], text[: o[2]]
            where = "line" if one.count("\n") == other.count("\n") else "block" if len(re.findall("\n\n", one)) == len(re.findall("\n\n", other)) else "near"
            near[o[3]] = min(near.get(o[3], (10**9,)), (max(away, 0), o[0], o[2], where))
        if near:
            weak.append(w)
            links.append((w[0], w[1], f"{w[3]}:{w[0]}:{w[2]}[{' '.join(sorted(f'{k}:{a}:{b}:{s}' for k, (_, a, b, s) in near.items()))}]"))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(base + weak)), ",".join(x for _, _, x in sorted(links))


# ---- locally consistent parsing, one symbol at a time

M64 = (1 << 64) - 1


def mix(x):
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & M64
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & M64
    return x ^ x >> 33


def parse(symbols):
    """The names of the phrases of a sequence."""
    runs = []
    for x in symbols:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    seq = [x if n == 1 else mix((3 * x + n) & M64) for x, n in runs]
    label = seq
    for _ in range(3):
        tossed, left = [], 0x5BD1E9955BD1E995
        for x in label:
            k = next((i for i in range(64) if (x ^ left) >> i & 1), 63)
            tossed.append(2 * k + (x >> k & 1))
            left = x
        label = tossed
    phrases = []
    for i, x in enumerate(seq):
        if i == 0 or (i + 1 < len(seq) and label[i - 1] < label[i] >= label[i + 1]):
            phrases.append([])
        phrases[-1].append(x)
    return [mix((sum(mix(x) * pow(0xD6E8FEB86659FD93, min(i, 63), 1 << 64) for i, x in enumerate(p)) + len(p)) & M64) for p in phrases]


def fingerprint(text, a, b):
    names, level, seq = set(), 0, [mix(ord(c)) for c in text]
    while text and (level == 0 or len(seq) > 1):
        level += 1
        seq = parse(seq)
        names.update((level, x) for x in seq)
    return "".join(f"{mix(min((((x + n) * p + q) & M64 for n, x in names), default=M64)) >> 48:04x}" for p, q in zip(a, b))
