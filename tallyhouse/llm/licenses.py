"""License scans: a trained classifier finds license paragraphs, and templates confirm which license it is.

Paragraphs are runs of lines with a word in them: a line without one ends a paragraph. Line breaks, punctuation and
comment marks (signs; ``dnl`` and ``rem`` at a line's beginning) only separate words, so notices may be wrapped and
stand in comments. Overlapping windows of 8, 16, 32 and 64 words are taken from every paragraph of every text, so that a
notice in a long paragraph is not outvoted by the words around it. The one- to three-word n-grams of a window are hashed;
a multinomial logistic regression over the license families and ``unknown`` is trained on variants of the templates,
alone and between words of the corpus, and on windows of a bounded, documented sample of the corpus's own paragraphs as
unknown. On examples it has not seen, a temperature is fitted to its probabilities, and the least probability is set at
which a family is named rather than ``unknown`` (low enough for 99 of 100 variants).

What is named is compared with the templates of the family's licenses. A license is confirmed where one of its templates
has four fifths or more of its five-word shingles (a shorter template: its whole words in a row) and where the words that
tell licenses apart agree: versions, and words as Lesser, Affero or NonCommercial, are in the match if and only if they
are in the template. Of licenses that match the same words the one with the longer match counts. A paragraph may have
several, each once.

Null and empty texts have no paragraphs. Rows are kept, repeated ones too; only the named columns are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import words as W
from tallyhouse.llm.license_texts import NAMES, TELLING, VERSION_WORDS, templates

UNKNOWN = "unknown"
FAMILIES = [*NAMES, UNKNOWN]
#: Identifier -> all wordings.
TEMPLATES = {spdx: said for spdx, (_, said) in templates().items()}
FAMILY_OF = {spdx: family for spdx, (family, _) in templates().items()}
GRAMS = 3
BITS = 15
#: Most paragraphs of the corpus that the classifier learns unknown text from.
SAMPLE = 3_000
VARIANTS = 4
ROUNDS = 80
DECAY = 1e-4
#: Shares of unseen windows that give the least probability: unknown ones that are named, variants that are not; the
#: second goes first, since templates confirm what is named.
FALSE_ALARMS, MISSES = 1e-3, 1e-2
SHINGLE, SIMILAR = 5, 0.8
#: Words that begin a comment line where signs do not.
MARKS = (b"dnl", b"rem")
#: What separates paragraphs where the sample is taken (comment words are not looked at).
GAP = r"\n[^a-zA-Z0-9\x{80}-\x{10FFFF}]*\n"
#: Words of a window, and how many windows of a size begin within it: a template is whole in a window of the least size
#: of which it takes three quarters or less.
SIZES, STRIDES = (8, 16, 32, 64), 4
#: Windows of a sampled paragraph that the classifier learns from, and words that are scored at once.
DRAWS, BLOCK = 3, 1 << 16
#: Characters of a stretch of a long sampled paragraph, which bounds what the driver gets.
DRAW_CHARS = 2_000
#: Share of the shorter of two matches that may lie in the other without their being one.
OVERLAP = 0.2
FOUND = ("array<struct<paragraph: long, family: string, license: string, probability: double, similarity: double, "
         "confirmed: boolean>>")


def paragraphs(texts: pa.Array) -> tuple[W.Texts, np.ndarray]:
    """Words but for comment words, and of each paragraph its first word; at the end the number of words."""
    t = W.split(texts, W.BY_PUNCTUATION, lower=True)
    breaks = np.flatnonzero(t.data == 10)
    line = np.searchsorted(breaks, t.starts)
    mark = (np.diff(line, prepend=-1) > 0) | (np.diff(t.doc, prepend=-1) > 0)
    short = np.flatnonzero(mark & (t.ends - t.starts == 3))
    three = t.data[t.starts[short][:, None] + np.arange(3)]
    mark[:] = False
    mark[short] = np.isin(np.ascontiguousarray(three).view("S3").ravel(), MARKS)
    t = replace(t, starts=t.starts[~mark], ends=t.ends[~mark], doc=t.doc[~mark])
    line = line[~mark]
    begins = (np.diff(line, prepend=-2) > 1) | (np.diff(t.doc, prepend=-1) > 0)
    return t, np.append(np.flatnonzero(begins), len(t.starts))


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paragraphs, first words and ends of all windows, by first word. A paragraph of no more words than a size is one
    window; only the least such size is taken."""
    lengths, out = np.diff(first), []
    for below, size in zip((0, *SIZES), SIZES):
        of = np.flatnonzero(lengths > below)
        slack = np.maximum(lengths[of] - size, 0)
        n = 1 - (-slack // (size // STRIDES))
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begins = np.repeat(first[of], n) + np.minimum(k * (size // STRIDES), np.repeat(slack, n))
        of = np.repeat(of, n)
        out.append((of, begins, np.minimum(begins + size, first[of + 1])))
    of, begins, ends = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(begins, kind="stable")
    return of[order], begins[order], ends[order]


def logits(weights: np.ndarray, hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Scores for each family of the n-grams between the words ``begins`` and ``ends`` (``begins`` in order); the last
    row of ``weights`` is the constant."""
    out = np.repeat(weights[-1:].astype(float), len(begins), axis=0)
    for low in range(0, len(hashes), BLOCK):
        part = slice(*np.searchsorted(begins, [low, low + BLOCK]))
        if part.start == part.stop:
            continue
        a, b = begins[part] - low, ends[part] - low
        words = hashes[low : low + b.max()]
        for n in range(1, GRAMS + 1):
            ids = gram_ids(words, n)
            sums = np.zeros((len(ids) + 1, weights.shape[1]))
            np.cumsum(weights[ids], axis=0, dtype=float, out=sums[1:])
            out[part] += sums[np.minimum(np.maximum(b - n + 1, a), len(ids))] - sums[np.minimum(a, len(ids))]
    return out


def gram_ids(hashes: np.ndarray, n: int) -> np.ndarray:
    return (W.window_hashes(hashes, n, seed=n) >> np.uint64(64 - BITS)).astype(np.int32)


def features(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams and the lines they stand in, sorted by line."""
    t = W.split(lines, W.BY_PUNCTUATION, lower=True)
    hashes = W.word_hashes(t)
    ids, of = [], []
    for n in range(1, GRAMS + 1):
        if len(hashes) >= n:
            whole = t.doc[n - 1 :] == t.doc[: len(hashes) - n + 1]
            ids.append(gram_ids(hashes, n)[whole])
            of.append(t.doc[n - 1 :][whole])
    if not ids:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return np.concatenate(ids)[order], of[order]


def probabilities(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def variants(fill: list[str], rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """Templates as they are, with words left out, and in a window between words that follow each other in the corpus; of
    templates longer than a window, parts."""
    texts, kinds = [], []
    for spdx, said in TEMPLATES.items():
        for template in said:
            w = terms(template)
            size = next((x for x in SIZES if x - x // STRIDES >= len(w)), SIZES[-1])
            for k in range(VARIANTS):
                kept = [x for x in w if k < VARIANTS // 4 or len(w) < 6 or rng.random() > 0.1]
                if len(kept) > size:
                    at = int(rng.integers(0, len(kept) - size + 1))
                    kept = kept[at : at + size]
                more = int(rng.integers(0, size - len(kept) + 1)) * (k % 2)
                before = int(rng.integers(0, more + 1))
                at = int(rng.integers(0, max(1, len(fill) - more)))
                texts.append(" ".join([*fill[at : at + before], *kept, *fill[at + before : at + more]]))
                kinds.append(FAMILIES.index(FAMILY_OF[spdx]))
    return texts, np.array(kinds)


def train(sample: list[str]) -> tuple[np.ndarray, float, float]:
    """Weights, temperature and least probability. ``sample``: paragraphs of the corpus, whose windows count as unknown
    unless they, with four words on either side, share a shingle with a template."""
    rng = np.random.default_rng(11)
    clean, source = [], []
    for i, words in enumerate(map(terms, sample)):
        for size in rng.choice(SIZES, DRAWS) if len(words) > SIZES[0] else SIZES[:1]:
            at = int(rng.integers(0, max(1, len(words) - size + 1)))
            near = words[max(0, at - SHINGLE + 1) : at + size + SHINGLE - 1]
            if words and not any(g in SHINGLES for n in range(1, SHINGLE + 1) for g in shingles(near, n)):
                clean.append(" ".join(words[at : at + size]))
                source.append(i)
    texts, kinds = variants([w for c in clean for w in c.split()] or ["text"], rng)
    texts, kinds = texts + clean, np.append(kinds, np.full(len(clean), len(NAMES)))
    # windows of one paragraph are all learned from or all held out
    held = np.append(rng.random(len(texts) - len(clean)) < 0.25, (rng.random(len(sample)) < 0.25)[np.array(source, int)])
    lines = pa.array(texts, pa.large_string())
    learn = np.flatnonzero(~held)
    ids, of = features(lines.take(pa.array(learn)))
    y = np.zeros((len(learn), len(FAMILIES)))
    y[np.arange(len(learn)), kinds[learn]] = 1
    share = y.sum(axis=0)
    importance = (y / np.maximum(share, 1)).sum(axis=1) * len(learn) / max(1, np.count_nonzero(share))
    weights = np.zeros(((1 << BITS) + 1, len(FAMILIES)))
    squares = np.full_like(weights, 1e-8)
    used = np.unique(ids)
    local = np.searchsorted(used, ids)
    part = np.append(used, 1 << BITS)
    begins = np.flatnonzero(np.diff(of, prepend=-1))
    order = np.argsort(local, kind="stable")
    by_gram = np.flatnonzero(np.diff(local[order], prepend=-1))
    for _ in range(ROUNDS):  # steps scaled by each weight's own past gradients
        scores = np.repeat(weights[-1:], len(learn), axis=0)
        if len(ids):
            scores[of[begins]] += np.add.reduceat(weights[ids], begins, axis=0)
        error = (probabilities(scores) - y) * importance[:, None] / len(learn)
        gradient = np.vstack([np.add.reduceat(error[of[order]], by_gram, axis=0), error.sum(axis=0)]) if len(ids) else error.sum(axis=0)[None]
        gradient += DECAY * weights[part]
        squares[part] += gradient**2
        weights[part] -= 0.5 * gradient / np.sqrt(squares[part])
    test = np.flatnonzero(held)
    t = W.split(lines.take(pa.array(test)), W.BY_PUNCTUATION, lower=True)
    first = t.first_word()
    scores = logits(weights, W.word_hashes(t), first[:-1], first[1:])
    loss = lambda t: -np.log(np.maximum(probabilities(scores / t)[np.arange(len(test)), kinds[test]], 1e-12)).mean()
    temperature = min(np.geomspace(0.25, 8, 41), key=loss) if len(test) else 1.0
    p, unknown = probabilities(scores / temperature), kinds[test] == len(NAMES)
    least = np.quantile(p[unknown, :-1].max(axis=1), 1 - FALSE_ALARMS) if unknown.any() else 0.5
    if not unknown.all():
        least = min(least, np.quantile(p[~unknown, kinds[test][~unknown]], MISSES))
    return weights.astype(np.float32), float(temperature), float(max(0.5, least))


def words_between(t: W.Texts, begin: int, end: int) -> list[str]:
    return [t.data[a:b].tobytes().decode() for a, b in zip(t.starts[begin:end].tolist(), t.ends[begin:end].tolist())]


def terms(text: str) -> list[str]:
    t = W.split(pa.array([text], pa.large_string()), W.BY_PUNCTUATION, lower=True)
    return words_between(t, 0, len(t.starts))


def shingles(words: list[str], n: int) -> set[tuple[str, ...]]:
    return set(zip(*(words[i:] for i in range(n))))


def telling(words: list[str]) -> frozenset[str]:
    """The words and versions that tell licenses apart."""
    joined = f" {' '.join(words)} "
    found, i = {t for t in TELLING if f" {t} " in joined}, 0
    while i < len(words):
        glued = re.fullmatch(r"(?:v|gplv|lgplv|agplv)(\d{1,2})", words[i])
        parts, j = [glued[1]] if glued else [], i + 1
        if glued or words[i] in VERSION_WORDS:
            while j < len(words) and len(parts) < 2 and re.fullmatch(r"\d{1,2}", words[j]):
                parts.append(words[j])
                j += 1
        if parts:
            found.add(".".join(parts).removesuffix(".0"))
        i = j
    return frozenset(found)


@dataclass(frozen=True)
class Template:
    license: str
    n_words: int
    n_shingles: int
    telling: frozenset


def indexed() -> tuple[dict[str, dict[tuple, list]], int]:
    """For each family the templates of each shingle with the place in them; and the words of the longest template."""
    index: dict[str, dict[tuple, list]] = {family: defaultdict(list) for family in NAMES}
    longest = 0
    for spdx, said in TEMPLATES.items():
        for text in said:
            words = terms(text)
            n = min(SHINGLE, len(words))
            grams = list(zip(*(words[i:] for i in range(n))))
            template = Template(spdx, len(words), len(set(grams)), telling(words))
            for i, g in enumerate(grams):
                index[FAMILY_OF[spdx]][g].append((template, i))
            longest = max(longest, len(words))
    return {family: dict(grams) for family, grams in index.items()}, longest


INDEX, LONGEST = indexed()
SHINGLES = {g for grams in INDEX.values() for g in grams}


@dataclass
class Match:
    license: str | None
    similarity: float
    begin: int
    end: int
    words: int


def matches(words: list[str], family: str) -> list[Match]:
    """Where the words are as a template of the family; the best of what is less alike is last, without a license."""
    places: dict[int, list[tuple[int, tuple, int]]] = defaultdict(list)
    by_id: dict[int, Template] = {}
    for n in range(1, SHINGLE + 1):
        for at, gram in enumerate(zip(*(words[i:] for i in range(n)))):
            for template, i in INDEX[family].get(gram, ()):
                by_id[id(template)] = template
                places[id(template)].append((at, gram, i))
    out, best = [], 0.0
    for key, hits in places.items():
        template = by_id[key]
        hits.sort(key=lambda h: h[0])
        width, low, have = template.n_words + max(3, template.n_words // 4), 0, defaultdict(int)
        top, span = 0, (0, 0)
        for high, (at, gram, _) in enumerate(hits):
            have[gram] += 1
            while hits[low][0] + width < at + 1:
                have[hits[low][1]] -= 1
                if not have[hits[low][1]]:
                    del have[hits[low][1]]
                low += 1
            if len(have) > top:
                top, span = len(have), (low, high)
        share = top / template.n_shingles
        best = max(best, share)
        if share < SIMILAR:
            continue
        (first, _, i), (last, _, j) = hits[span[0]], hits[span[1]]
        begin, end = max(0, first - i), min(len(words), last + template.n_words - j)
        while end < len(words) and end < last + template.n_words - j + 2 and re.fullmatch(r"\d{1,2}", words[end]):
            end += 1  # a version goes on
        if telling(words[begin:end]) == template.telling:
            out.append(Match(template.license, share, begin, end, top))
    return [*out, Match(None, best, 0, 0, 0)]


def chosen(found: list[Match]) -> list[Match]:
    """Of matches of the same words the longest, then the one most alike."""
    out: list[Match] = []
    for m in sorted(found, key=lambda m: (-m.words, -m.similarity, m.license)):
        shared = (min(m.end, o.end) - max(m.begin, o.begin) for o in out)
        if all(s <= OVERLAP * min(m.end - m.begin, o.end - o.begin) for s, o in zip(shared, out)):
            out.append(m)
    return out


def named(model: tuple[np.ndarray, float, float], t: W.Texts, first: np.ndarray) -> Iterator[tuple[int, int, float, str | None, float]]:
    """Paragraphs, families, greatest probabilities, licenses (None: not confirmed) and similarities, in order. A window
    that is named is compared with the templates together with as many words on either side as the longest template has;
    what overlaps is compared as one."""
    weights, temperature, least = model
    of, begins, ends = windows(first)
    scores = logits(weights, W.word_hashes(t), begins, ends)
    some = np.flatnonzero((scores[:, :-1] > scores[:, -1:]).any(axis=1))  # no others have a half for a family
    p = probabilities(scores[some] / temperature)
    kind = p.argmax(axis=1)
    sure = np.flatnonzero((kind < len(NAMES)) & (p.max(axis=1, initial=0) >= least))
    some, kind, p = some[sure], kind[sure], p[sure, kind[sure]]
    low = np.maximum(begins[some] - LONGEST, first[of[some]])
    high = np.minimum(ends[some] + LONGEST, first[of[some] + 1])
    spans: dict[int, dict[int, list]] = defaultdict(dict)
    for (i, k), chance, a, b in sorted(zip(zip(of[some].tolist(), kind.tolist()), p.tolist(), low.tolist(), high.tolist()), key=lambda x: (x[0], x[2])):
        own = spans[i].setdefault(k, [0.0, []])
        own[0] = max(own[0], chance)
        if own[1] and a <= own[1][-1][1]:
            own[1][-1][1] = max(b, own[1][-1][1])
        else:
            own[1].append([a, b])
    for i, kinds in spans.items():
        found, alike, chances = [], {}, {}
        for k, (chance, parts) in kinds.items():
            alike[k], chances[k] = 0.0, chance
            for a, b in parts:
                for m in matches(words_between(t, a, b), FAMILIES[k]):
                    alike[k] = max(alike[k], m.similarity)
                    if m.license:
                        found.append(replace(m, begin=m.begin + a, end=m.end + a))
        best: dict[str, Match] = {}
        for m in chosen(found):
            best.setdefault(m.license, m)
        for k in kinds:
            own = [m for m in best.values() if FAMILY_OF[m.license] == FAMILIES[k]]
            for m in own:
                yield i, k, chances[k], m.license, m.similarity
            if not own:
                yield i, k, chances[k], None, alike[k]


def scan_texts(model: tuple[np.ndarray, float, float], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in W.slices(batches):
        t, first = paragraphs(part.column("text"))
        doc = t.doc[first[:-1]]
        number = np.arange(len(doc)) - np.searchsorted(doc, doc)
        found: list[list[dict]] = [[] for _ in range(part.num_rows)]
        for i, kind, p, spdx, alike in named(model, t, first):
            found[doc[i]].append({"paragraph": int(number[i]), "family": FAMILIES[kind], "license": spdx, "probability": p,
                                  "similarity": alike, "confirmed": spdx is not None})
        names = [c for c in part.schema.names if c != "text"]
        kinds = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("license", pa.string()),
                                    ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]))
        yield pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in names), pa.array(np.bincount(doc, minlength=part.num_rows).astype(np.int64)), pa.array(found, kinds)],
            [*names, "n_paragraphs", "found"])


def windows_of(line: str) -> Column:
    """Up to ``DRAWS`` stretches of a paragraph, spread over the whole of it by its hash; a short one as it is."""
    at = lambda k: F.pmod(F.xxhash64(F.col(line), F.lit(k)), F.greatest(F.length(line) - DRAW_CHARS + 1, F.lit(1)))
    parts = F.array(*(F.substr(F.col(line), (at(k) + 1).cast("int"), F.lit(DRAW_CHARS)) for k in range(DRAWS)))
    return F.when(F.length(line) <= DRAW_CHARS, F.array(line)).otherwise(parts)


def sampled(docs: DataFrame, most: int = SAMPLE) -> list[str]:
    """At most ``most`` different paragraphs, the least by hash, so that the choice does not depend on the layout.

    The number of paragraphs gives a hash below which about twice as many lie; only those are sorted.
    """
    parts = F.split("text", GAP)
    n = docs.agg(F.sum(F.size(parts))).first()[0] or 0
    below = min((2 * most << 63) // max(1, n), 2**63 - 1)
    lines = docs.select(F.explode(parts).alias("line")).select(F.xxhash64("line").alias("h"), "line")
    lines = lines.where(F.expr(f"(h & 9223372036854775807L) <= {below}L") & F.col("line").rlike("[A-Za-z0-9]"))
    few = lines.distinct().orderBy("h", "line").limit(most)
    return [line for r in few.select(windows_of("line").alias("parts")).collect() for line in r["parts"]]


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep``, n_paragraphs and ``found``: the paragraphs named as a license, confirmed or not."""
    inner = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(i) for c, i in zip(keep, inner)), F.col(text).alias("text"))
    model = train(sampled(rows))
    kinds = dict(rows.dtypes)
    schema = "".join(f"{c} {kinds[c]}, " for c in inner) + f"n_paragraphs long, found {FOUND}"
    out = rows.mapInArrow(lambda b: scan_texts(model, b), schema)
    return out.select(*(F.col(i).alias(c) for c, i in zip(keep, inner)), "n_paragraphs", "found")
