"""Plain-Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(UPPER) if lower else text)


def fold(doc_id: int | None, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def fingerprint(text: str | None) -> int:
    w = words(text, lower=True)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_ids(rows: list[tuple[int, int]]) -> list[int]:
    """rows: id and fingerprint."""
    least: dict[int, int] = {}
    for i, fp in rows:
        least[fp] = min(least.get(fp, i), i)
    fps = list(least)
    root = {fp: fp for fp in fps}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    best: dict[int, int] = {}
    for fp in fps:
        r = find(fp)
        best[r] = min(best.get(r, least[fp]), least[fp])
    return [best[find(fp)] for _, fp in rows]


def substring_dedup(texts: list[str | None], k: int = 35) -> list[tuple[int, int, str]]:
    all_words = [words(t) for t in texts]
    count = Counter(tuple(w[i : i + k]) for w in all_words for i in range(len(w) - k + 1))
    out = []
    for w in all_words:
        gone = set()
        for i in range(len(w) - k + 1):
            if count[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def decontaminate(texts: list[str | None], items: list[tuple[int, str | None]], size: int = 13) -> list[tuple]:
    cut = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (s or "").translate(UPPER))
    found: dict[tuple, set] = {}
    for item, text in items:
        w = cut(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            found.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for text in texts:
        w, hit, seen = cut(text), set(), set()
        for n in {len(x) for x in found}:
            for i in range(len(w) - n + 1):
                if (got := found.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    seen |= got
        ids = ",".join(sorted(str(i) for i in seen))
        out.append((len(w), len(hit), len(seen), hashlib.sha256(ids.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


def rule_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = set()
    for i in range(len(w) - 2):
        if triples[tuple(w[i : i + 3])] > 1:
            again.update((i, i + 1, i + 2))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))


def lm_scores(rows: list[tuple], order: int, in_train, in_tune) -> list[float]:
    """Deleted interpolation with n-grams in dictionaries, EM token by token."""
    texts = [[*words(t, lower=True), "</s>"] for _, t in rows]
    train, kept = [in_train(i) for i, _ in rows], [in_train(i) and not in_tune(i) for i, _ in rows]

    def count(use):
        grams, seen = [Counter() for _ in range(order)], 0
        for w, u in zip(texts, use):
            padded = ["<s>"] * (order - 1) + w
            for i in range(len(w) if u else 0):
                for m in range(order):
                    grams[m][tuple(padded[i + order - 1 - m : i + order])] += 1
            seen += u
        return grams, sum(grams[0].values()), len(grams[0]), seen

    def estimates(w, model):
        grams, n, v, docs = model
        padded = ["<s>"] * (order - 1) + w
        for i in range(len(w)):
            f, bucket = [1 / (v + 1), grams[0][(w[i],)] / max(n, 1)], 0
            for m in range(1, order):
                h = tuple(padded[i + order - 1 - m : i + order - 1])
                c = docs if i == 0 else grams[m - 1][h]
                f.append(grams[m][(*h, w[i])] / max(c, 1))
                if c:
                    bucket = (m - 1) * 24 + min(int(c).bit_length(), 23)
            yield bucket, f

    model = count(kept)
    tuned = [x for w, a, b in zip(texts, train, kept) if a and not b for x in estimates(w, model)]

    def em(points):
        a = [1 / (order + 1)] * (order + 1)
        for _ in range(50):
            new = [0.0] * (order + 1)
            for f in points:
                total = sum(x * y for x, y in zip(a, f))
                for k in range(order + 1):
                    new[k] += a[k] * f[k] / total
            a = [x / sum(new) for x in new]
        a = [max(x, 1e-6) for x in a]
        return [x / sum(a) for x in a]

    pooled = em([f for _, f in tuned]) if tuned else [1 / (order + 1)] * (order + 1)
    by = {b: em([f for x, f in tuned if x == b]) for b in {b for b, _ in tuned}}
    full = count(train)
    if not full[1]:
        by, pooled = {}, [1.0] + [0.0] * order
    return [sum(math.log10(sum(x * y for x, y in zip(by.get(b, pooled), f))) for b, f in estimates(w, full)) for w in texts]


def damaged(rows: list[tuple]) -> list[tuple]:
    """Rows (conv, turn, role, text) with the contract's faults."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fault = zlib.crc32(key.encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub(r"[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def repaired(ids: list, rows: list[tuple]) -> dict:
    """conv -> gaps, blank, duplicate, truncated, illegal, cost, audit, repaired text; by trying all edits."""
    follows, keeps = {0: 2, 1: 2, 2: 3, 3: 2}, {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = {2: "user", 3: "assistant"}
    out = {}
    for conv in set(ids):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (
            r[1] is not None, r[1] or 0, r[2].encode(), r[3][:64].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            end = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {0: (0, "", ())}

        def put_in(best):
            grown = dict(best)
            for _ in range(3):
                for q, (c, a, t) in list(grown.items()):
                    new = (c + 5, a + "I", (*t, f"{names[follows[q]]}:"))
                    grown[follows[q]] = min(grown.get(follows[q], new), new)
            return grown

        for (_, _, role, text), fault in zip(own, faults):
            after: dict = {}
            for q, (c, a, t) in put_in(best).items():
                ways = [(2, "D", q, t)]
                if fault not in ("blank", "duplicate"):
                    more = 5 * (fault == "truncated")
                    if (q, role[:1]) in keeps:
                        ways.append((more, "K", keeps[q, role[:1]], (*t, f"{role}:{text}")))
                    ways.append((1 + more, "R", follows[q], (*t, f"{names[follows[q]]}:{text}")))
                for cost, letter, to, said in ways:
                    new = (c + cost, a + letter, said)
                    after[to] = min(after.get(to, new), new)
            best = after
        cost, audit, said = min(x for q, x in put_in(best).items() if q in (0, 3))
        turns = [r[1] for r in own if r[1] is not None]
        roles = [r[2][:1] for r in own]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit, "\n".join(said))
    return out


def targets(sizes: dict, weights=(1, 2, 3), most: int = 3) -> dict:
    """Source -> target, by resharing what is over until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, open_at, rest = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while rest > 1e-9 and open_at:
        unit = rest / sum(weight[s] for s in open_at)
        for s in open_at:
            got[s] += unit * weight[s]
        rest = 0.0
        for s in list(open_at):
            if got[s] > most * sizes[s]:
                rest += got[s] - most * sizes[s]
                got[s] = float(most * sizes[s])
                open_at.discard(s)
    return got
