"""Plain versions of the operators' contracts, on lists of rows."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, k=5):
    w = words((text or "").translate(UPPER))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_dedup(docs):
    """{doc_id: (n_shingles, component)}; ids are unique."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def substring_dedup(docs, k=13):
    """[(doc_id, n_words, n_removed, sha256)], one for each row."""
    first = {}
    for i, t in docs:
        w = words(t)
        for p in range(len(w) - k + 1):
            key = tuple(w[p:p + k])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = {q for p in range(len(w) - k + 1) if i is not None and first[tuple(w[p:p + k])] < i for q in range(p, p + k)}
        kept = [x for q, x in enumerate(w) if q not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def repeated_words(text):
    w = words(text)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    return len({p for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for p in range(i, i + 3)})


def quality(docs, least=20, share=1, most=1000):
    """{(doc_id, host): kept} of rows ``(doc_id, text, host)``."""
    norm = lambda x: re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").translate(UPPER))
    failed = {(i, h): len(words(t)) < 50 or 100 * repeated_words(t) > 50 * len(words(t)) for i, t, h in docs}
    hosts, seen = defaultdict(set), defaultdict(set)
    for i, t, h in docs:
        hosts[h].add(i)
        for x in (t or "").split("\n"):
            if words(x):
                seen[h, norm(x)].add(i)
    first = {key: min((i for i in ids if not failed[i, key[0]]), default=None) for key, ids in seen.items()
             if len(ids) > least and (100 * len(ids) > share * len(hosts[key[0]]) or len(ids) > most)}
    out = {}
    for i, t, h in docs:
        n = len(words(t))
        lost = sum(len(words(x)) for x in (t or "").split("\n") if words(x) and (h, norm(x)) in first and first[h, norm(x)] != i)
        out[i, h] = not failed[i, h] and not (lost and (n - lost < 50 or 100 * lost > 50 * n))
    return out


def spans(text):
    """Base spans as ``kind:start:end``, joined."""
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[^0-9]", "", m.group())]
        if 14 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def contained(docs, items):
    """{(doc_id, item_id): n_shared} at 75 percent or more."""
    five = lambda t: {tuple(w[i:i + 5]) for w in [words((t or "").lower())] for i in range(len(w) - 4)}
    own = {i: five(t) for i, t in docs}
    return {(d, i): len(s & own[d]) for i, t in items if (s := five(t)) for d in own if 100 * len(s & own[d]) >= 75 * len(s)}


def merkle(docs, fanout=2):
    """One row for each ``(doc_id, source, lang, n_chars, text)``, as the manifest gives it."""
    def digest(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(row):
        return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][i:i + fanout]) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def path(levels, i):
        for nodes in levels[:-1]:
            low = i - i % fanout
            yield "".join(nodes[low:i]), "".join(nodes[i + 1:low + fanout])
            i //= fanout

    groups = defaultdict(list)
    for row in docs:
        groups[row[2]].append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, row in enumerate(groups[g]):
            steps, changed = [*path(trees[g], i), *path(top, k)], list(row)
            if row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0:
                changed[3] += 1
            folded = leaf(changed)
            for left, right in steps:
                folded = digest(left, folded, right)
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[g][-1][0], root, digest(*[x for s in steps for x in s]), folded, folded == root))
    return out


def spelling(docs):
    """``(word, form, root, n, n_near, form_n)`` of rows ``(doc_id, text)``."""
    count = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 6 and k >= 5}
    near = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            short = w[:i] + w[i + 1:]
            near[short] |= {w} if short in n else set()
            near[w] |= {short} if short in n else set()
    places = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            places[w[:i], w[i + 1:]].add(w)
    for group in places.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def revealed(texts, disclosed=90):
    """For each text the spans of the terms that reveal one of its entities."""
    base = [[(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans(t).split(",") if x)] for t in texts]
    entities = [{(k, (t or "")[a:b].lower()) for k, a, b in bs} for t, bs in zip(texts, base)]
    found = [[(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_](?:[^\W_]){2,}", t or "")] for t in texts]
    terms = [{x[2] for x in f} for f in found]
    n, n_e, n_t = len(texts), Counter(e for es in entities for e in es), Counter(t for ts in terms for t in ts)
    both = Counter((e, t) for es, ts in zip(entities, terms) for e in es for t in ts)

    def tells(e, t):
        k, m = both[e, t], n_t[t]
        if n_e[e] == n:
            return False
        p = k / m
        low = (p + 1 / (2 * m) - math.sqrt(p * (1 - p) / m + 1 / (4 * m * m))) / (1 + 1 / m)
        return math.log(low * n / n_e[e]) / math.log(n / n_e[e]) * 100 >= disclosed - 1e-9
    out = []
    for es, bs, fs in zip(entities, base, found):
        told = {t for t in {x[2] for x in fs} if any(tells(e, t) for e in es)}
        out.append([(a, b) for a, b, t in fs if t in told and not any(x < b and y > a for _, x, y in bs)])
    return out
