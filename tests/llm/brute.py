"""Plain versions of what the operators compute, a row at a time."""

import hashlib
import re
import zlib

import xxhash

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def ascii_lower(text):
    return text.encode().lower().decode()


def contamination(docs, items):
    windows = {}
    for item, text in items:
        words = WORDS.findall(ascii_lower(text or ""))
        n = min(13, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words = WORDS.findall(ascii_lower(text or ""))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                items_here = windows.get(tuple(words[i : i + n]))
                if items_here is not None:
                    hit.update(range(i, i + n))
                    found |= {x for x in items_here if x is not None}
        named = ",".join(sorted(map(str, found)))
        out.append((doc, len(words), len(hit), len(found), sha(named), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=3):
    """Fingerprint and smallest id reachable, by row number."""
    up = list(range(len(prints)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= bits:
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return [(doc, f"{a:016x}", least.get(top(i))) for i, (doc, a) in enumerate(prints)]


def repeats(docs, length=100):
    seen, out = set(), []
    for doc, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(data[i : i + length])
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(data), sum(gone), runs, sha(kept)))
    return out


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


ASSIGN = re.compile(
    r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text):
    text = text or ""
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    kinds = ("email", "ip", "card", "phone")
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in zip(kinds, rules, strict=True) for m in re.finditer(p, text) if ok(m[0])]


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def encoded(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def merkle(leaves, fanout=2):
    """Root of a list of hashes, and of each the (before, after) siblings."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            first = i // fanout * fanout
            paths[leaf].append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + fanout])))
            at[leaf] = i // fanout
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def fold(leaf, path):
    for before, after in path:
        leaf = sha(before + leaf + after)
    return leaf


def manifest(docs, fanout=2):
    """Rows of doc_id, text, lang, source, n_chars: what op11 returns of them."""
    groups = {}
    for doc, text, lang, source, n in docs:
        leaf = sha(encoded([doc, source, lang, n, text]))
        other = leaf
        if doc is not None and n is not None and zlib.crc32(str(doc).encode()) % 7 == 0:
            other = sha(encoded([doc, source, lang, n + 1, text]))
        groups.setdefault(lang, []).append((doc, leaf, other))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {name: merkle([r[1] for r in groups[name]], fanout) for name in names}
    root, over = merkle([trees[name][0] for name in names], fanout) if names else (None, [])
    out = []
    for name, above in zip(names, over, strict=True):
        for (doc, leaf, other), path in zip(groups[name], trees[name][1], strict=True):
            folded = fold(other, path + above)
            out.append((doc, leaf, trees[name][0], root, sha("".join(b + a for b, a in path + above)), folded, folded == root))
    return out


def collocations(docs, least=10, share=50):
    """Rows of text, lang: the phrases that stay."""
    f, sizes = {}, {}
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] = sizes.get(lang, 0) + len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    key = (lang, tuple(words[i : i + k]))
                    f[key] = f.get(key, 0) + 1
    out = []
    for (lang, words), a in f.items():
        if len(words) == 1 or a < least:
            continue
        longer = [n for (m, w), n in f.items() if m == lang and n >= least and len(w) == 3 and len(words) == 2 and words in (w[:2], w[1:])]
        if any(100 * n >= share * a for n in longer):
            continue
        cuts = [(10**6 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], sizes[lang], score))
    return out


def boilerplate(docs, sites=10, copy=80):
    """Rows of text, source: the lines that go."""
    listed = [([x.strip(" ") for x in (text or "").split("\n") if x.strip(" ")], site) for text, site in docs]

    def spread(some):
        found = {}
        for lines, site in some:
            for line in lines:
                if site is not None:
                    found.setdefault(line, set()).add(site)
        return {line for line, s in found.items() if len(s) >= sites}

    many = spread(listed)
    size = lambda lines: sum(len(x.encode()) for x in lines)
    own = [(lines, site) for lines, site in listed if 100 * size(x for x in lines if x in many) <= copy * size(lines)]
    return spread((many & set(lines), site) for lines, site in own)
