"""Plain single-threaded versions of the corpus operators, for small tables only."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LICENSE_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x20\x09-\x0d]+")
PHRASES = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}


def base_license(text):
    """(n_words, n_base, first, last, labels) by looking at every place."""
    words = LICENSE_WORD.findall((text or "").translate(LOWER))
    at = [(i, label) for i in range(len(words)) for phrase, label in PHRASES.items() if tuple(words[i : i + len(phrase)]) == phrase]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in at}))


def license_scan(texts, templates, rarest=8, least=0.75):
    """(labels, score) of each text, from all places at which any template could start."""
    docs = [LICENSE_WORD.findall((t or "").translate(LOWER)) for t in texts]
    plain = [template.split() for _, template, _ in templates]
    seen = Counter(w for words in docs for w in set(words))
    idf = {w: max(np.log((len(docs) + 1) / (seen[w] + 1)), 1e-6) for words in plain for w in words}
    rank = lambda words: sorted(set(words), key=lambda w: (-idf[w], w))[:rarest]
    out = []
    for text, words in zip(texts, docs):
        line = f" {' '.join(words)} "
        labels, score = set(filter(None, base_license(text)[4].split(","))), 0.0
        for (label, _, phrases), template in zip(templates, plain):
            if not all(f" {p} " in line for p in phrases):
                continue
            own = set(rank([w for w in words if w in template]))
            weight = sum(idf[w] * template.count(w) for w in rank(template))
            at = Counter()
            for pos, w in enumerate(words):
                if w in own:
                    for offset, x in enumerate(template):
                        if x == w:
                            at[pos - offset] += idf[w]
            share = min(1.0, max(at.values()) / weight)
            if share >= least - 1e-9:
                labels.add(label)
                score = max(score, share)
        out.append((",".join(sorted(labels)), 1.0 if base_license(text)[1] else score))
    return out


def simhash(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 4 else [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, edges):
    """The smallest index reachable from each of n nodes."""
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def simhash_components(rows):
    """doc_id -> (hex, component) for rows (doc_id, text)."""
    rows = sorted(rows)
    prints = np.array([simhash(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    low = components(len(rows), np.argwhere(np.triu(near, 1)).tolist())
    return {d: (f"{int(p):016x}", rows[r][0]) for (d, _), p, r in zip(rows, prints, low)}


def vector_links(rows, least=0.93):
    """vec_id -> (links, component) for rows (vec_id, embedding, label), all pairs of equal label."""
    rows = sorted(rows, key=lambda r: r[0])
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    edges = []
    by = defaultdict(list)
    for i, (_, v, label) in enumerate(rows):
        if ok[i]:
            by[label, len(v)].append(i)
    for group in by.values():
        x = np.array([rows[i][1] for i in group], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        edges += [(group[i], group[j]) for i, j in np.argwhere(np.triu(x @ x.T >= least, 1))]
    low = components(len(rows), edges)
    links = Counter(i for e in edges for i in e)
    return {r[0]: (links[i], rows[low[i]][0]) for i, r in enumerate(rows)}


def repeats(texts, length=200):
    """(n_bytes, n_removed, n_spans, kept) of each text, from all windows of all texts."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        out.append((len(d), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(d) else 0, bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def top_scores(rows, k=20, every=20):
    """(query_id, rank, vec_id, score) rows by full sorting."""
    good = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q is not None and q % every == 0:
            best = sorted((-int(a @ b), i) for i, b in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def word_size(text):
    return len(WORD.findall(text or ""))


def targets(sizes):
    """source -> target for a dict source -> words; weights 3, 1, 2 in code point order, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    out, open_, budget = {}, list(order), 1.5 * sum(sizes.values())
    while open_:
        unit = budget / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > 2 * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            budget -= out[s]
            open_.remove(s)
    return out


def talk(rows):
    """(n_turns, turns digest, loss characters, loss digest) of a conversation's rows (role, text) in order."""
    turns = "".join(f"{role}\n{text or ''}\n" for role, text in rows)
    loss = "".join(text or "" for role, text in rows if role == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], np.uint32)


def crc(ids):
    return zlib.crc32(np.asarray(ids).astype("<u4").tobytes())
