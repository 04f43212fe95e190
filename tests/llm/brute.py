"""Plain versions of the operators, for small tables."""

import hashlib
import re


def winnow(docs, bench, span=10):
    """doc_id -> (n_words, n_hit, item ids)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in bench:
        w = split(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1) if n else []:
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    found |= own
                    hit |= set(range(i, i + n))
        ids = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def base_figures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    again = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def near_classes(docs, threshold=0.8):
    """doc_id -> (class id, links) for distinct doc_ids, by an exact inverted index."""
    sets = {d: shingles(t) for d, t in docs}
    texts = dict(docs)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    at, links = {}, dict.fromkeys(sets, 0)
    for d in sorted(sets):
        common = {}
        for s in sets[d]:
            for o in at.get(s, ()):
                common[o] = common.get(o, 0) + 1
            at.setdefault(s, []).append(d)
        for o, n in common.items():
            if texts[o] == texts[d] or n >= threshold * (len(sets[d]) + len(sets[o]) - n) - 1e-12:
                links[d] += 1
                links[o] += 1
                a, b = sorted((find(o), find(d)))
                parent[b] = a
    return {d: (find(d), links[d]) for d in sets}


def kneser_ney(docs):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base, score) of the bigram model."""
    import math
    import zlib
    from collections import Counter, defaultdict

    def tok(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]

    held = {d: zlib.crc32(str("" if d is None else d).encode()) % 7 == 2 for d, _ in docs}
    uni, bi = Counter(), Counter()
    for d, t in docs:
        if not held[d]:
            w = tok(t)
            uni.update(w)
            bi.update(zip([0, *w[:-1]], w, strict=True))
    n, v = sum(uni.values()), len(uni)
    left, after, follow = Counter(), Counter(), defaultdict(lambda: [0, 0, 0, 0])
    for (h, w), c in bi.items():
        left[w] += 1
        after[h] += c
        follow[h][min(c, 3)] += 1

    def disc(values):
        k = Counter(values)
        n1, n2, n3, n4 = (k[i] for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        raw = [0, 1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
        return [min(max(x, 0), i) for i, x in enumerate(raw)]

    d2, d1 = disc(bi.values()), disc(left.values())
    pairs = len(bi)
    back = sum(d1[min(x, 3)] for x in left.values()) / pairs if pairs else 1.0

    def p(h, w):
        one = back / (v + 1) + (max(left[w] - d1[min(left[w], 3)], 0) / pairs if pairs else 0)
        if not after[h]:
            return one
        c = bi[h, w]
        return max(c - d2[min(c, 3)], 0) / after[h] + sum(d2[i] * follow[h][i] for i in (1, 2, 3)) / after[h] * one

    out = {}
    for d, t in docs:
        w = tok(t)
        base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w)
        out[d] = (held[d], len(w), sum(x in uni for x in w), n, base, sum(math.log10(p(h, x)) for h, x in zip([0, *w[:-1]], w, strict=True)))
    return out


def url_parts(url):
    """Host and path."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def url_tokens(url):
    host, path = url_parts(url)
    url = url or ""
    scheme = re.match("([A-Za-z]*)://", url)
    query = re.search(r"(?s)\?([^#]*)", url)
    out = {"s:" + (scheme[1] if scheme else "")} | {"h:" + x for x in host.split(".") if x} | {"p:" + x for x in re.sub("[0-9]+", "0", path).split("/") if x}
    return out | {"q:" + x.split("=")[0] for x in (query[1] if query else "").split("&") if x.split("=")[0]}


def url_verdicts(pages, labels, rules, min_support, min_confidence, default):
    """page_id -> (host, path, rule, verdict), by all subsets of the labelled pages' tokens."""
    from itertools import combinations

    bad = {}
    for doc, quality, toxic in labels:
        bad[doc] = bad.get(doc, False) or toxic == 1 or quality == 0
    tx = [(frozenset(url_tokens(u)), "block" if bad[p] else "allow") for p, u in pages if p in bad]
    pages_of = {}
    for i, (items, _) in enumerate(tx):
        for t in items:
            pages_of.setdefault(t, set()).add(i)
    stands = {}
    for t in sorted(t for t, own in pages_of.items() if len(own) >= min_support * len(tx)):
        stands[t] = min(x for x, own in pages_of.items() if own == pages_of[t])
    counts = {}
    for items, verdict in tx:
        reps = sorted({stands[t] for t in items if t in stands})
        for k in range(1, len(reps) + 1):
            for c in combinations(reps, k):
                own = counts.setdefault(c, {"allow": 0, "block": 0})
                own[verdict] += 1
    share = {v: sum(x == v for _, x in tx) / max(len(tx), 1) for v in ("allow", "block")}
    found = []
    for c, own in counts.items():
        n = sum(own.values())
        for v in own:
            if own[v] >= min_support * len(tx) and own[v] / n >= min_confidence and own[v] / n > share[v] * (1 + 1e-12):
                found.append((own[v] / n, own[v] / len(tx), v, set(c)))
    out = {}
    for p, url in pages:
        host, path = url_parts(url)
        fits = [(len(h + q), h + q, v) for v, h, q in rules if (host == h or host.endswith("." + h)) and path.startswith(q)]
        reps = {stands[t] for t in url_tokens(url) if t in stands}
        best = max(((a, b, v) for a, b, v, c in found if c <= reps), default=None)
        top = [x[2] for x in ((a, b, v) for a, b, v, c in found if c <= reps) if best and x[:2] == best[:2]]
        out[p] = (host, path, max(fits)[1] if fits else None, {max(fits)[2]} if fits else set(top) or {default})
    return out


def shard_of(key, leaves):
    """The descent, draw by draw; the hash is XXH64 of the key and then of the child's name, from seed 42."""
    import math

    import xxhash

    key = "\x00null" if key is None else str(key)
    node = ""
    for level in range(3):
        weights = {}
        for x in leaves:
            path = ["", x.region, f"{x.region}/{x.rack}", f"{x.region}/{x.rack}/{x.shard}"]
            if path[level] == node:
                weights[path[level + 1]] = weights.get(path[level + 1], 0) + x.weight
        draw = lambda name: -math.log(((xxhash.xxh64(name.encode(), seed=xxhash.xxh64(key.encode(), seed=42).intdigest()).intdigest() >> 11) + 0.5) / 2**53) / weights[name]  # noqa: B023, E731
        node = min(weights, key=draw)
    return int(node.rsplit("/", 1)[1])
