"""Column expressions that read a question's text, normalised unless it says otherwise.

Words are matched whole by default (``ev`` does not hit "every"); pass
``whole=False`` for plain substring matching. A text is cut into words once
and met with the set of all words that are asked for (``words_seen``); tests
of single words look into what is left, and only a text that has all words of
a phrase is searched for the phrase itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.functions import vocab

LETTERS = "a-z0-9çğıöşü"
START = f"(^|[^{LETTERS}])"
END = f"([^{LETTERS}]|$)"


def escape(word: str) -> str:
    return re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", word)


def word_pattern(words: list[str]) -> str:
    """Pattern that finds any of the words as a whole word, longest first."""
    body = "|".join(escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    return f"{START}({body}){END}"


def contains_any(text: Column, words: list[str], lowered: bool = False) -> Column:
    """Case-blind substring test; NULL text is false, words are taken literally."""
    low = text if lowered else F.lower(text)
    hits = F.lit(False)
    for word in words:
        hits = hits | F.contains(low, F.lit(word))
    return F.coalesce(hits, F.lit(False))


def says(text: Column, words: list[str]) -> Column:
    return contains_any(text, words, lowered=True)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out one time, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def parts_of(word: str) -> list[str]:
    return re.findall(f"[{LETTERS}]+", word)


def words_seen(text: Column, *words: Iterable[str]) -> Column:
    """Which of the words, and of the parts of phrases, are in the text; one pass, whatever their number."""
    known = sorted({part for some in words for word in some for part in parts_of(word)})
    return F.array_intersect(F.split(text, f"[^{LETTERS}]+"), F.array(*map(F.lit, known)))


def saw(text: Column, seen: Column, word: str) -> Column:
    """Whether a word or phrase is in the text, whole, given the words seen in it."""
    parts = parts_of(word)
    if parts == [word]:
        return F.array_contains(seen, word)
    test = F.rlike(text, F.lit(word_pattern([word])))
    for part in reversed(parts):
        test = F.array_contains(seen, part) & test
    return test


def has_word(text: Column, words: list[str], whole: bool = True, seen: Column | None = None) -> Column:
    if not whole:
        return contains_any(text, words)
    if seen is None:
        return F.coalesce(once(words_seen(text, words), lambda s: has_word(text, words, seen=s)), F.lit(False))
    single = [w for w in words if parts_of(w) == [w]]
    hits = F.arrays_overlap(seen, F.array(*map(F.lit, single))) if single else F.lit(False)
    for word in words:
        if word not in single:
            hits = hits | saw(text, seen, word)
    return F.coalesce(hits, F.lit(False))


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(text, F.lit(pattern)), F.lit(False))


def normalize_text(text: Column) -> Column:
    """Lower-case, with misheard place names put right.

    Only a text that has a misheard name, or all words of one, is searched for
    them; each pass consumes the characters around a hit, so two passes are
    needed for neighbouring words.
    """
    low = F.lower(text)
    corrected = low
    for place, variants in vocab.PLACE_VARIANTS.items():
        pattern = word_pattern(variants)
        for _ in range(2):
            corrected = F.regexp_replace(corrected, pattern, f"$1{place}$3")
    variants = [v for some in vocab.PLACE_VARIANTS.values() for v in some]

    def suspect(seen: Column) -> Column:
        hits = F.arrays_overlap(seen, F.array(*(F.lit(v) for v in variants if parts_of(v) == [v])))
        for v in variants:
            if len(parts := parts_of(v)) > 1:
                both = F.array_contains(seen, parts[0])
                for part in parts[1:]:
                    both = both & F.array_contains(seen, part)
                hits = hits | both
        return hits

    return F.when(once(words_seen(low, variants), suspect), corrected).otherwise(low)


def found_in_order(text: Column, words: list[str], whole: bool = True, seen: Column | None = None) -> Column:
    """The words present in the text, in list order."""
    if whole and seen is None:
        return once(words_seen(text, words), lambda s: found_in_order(text, words, seen=s))
    test = (lambda w: saw(text, seen, w)) if whole else (lambda w: contains_any(text, [w]))
    return F.array_compact(F.array(*[F.when(test(w), F.lit(w)) for w in words]))


def extract_locations(text: Column, names: list[str] = vocab.WAREHOUSES) -> Column:
    """All place names mentioned (substring, so suffixed names count), in the order of ``names``."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w.lower())), F.lit(w)) for w in names]))


def map_category(text: Column, words: dict[str, str], whole: bool = True, seen: Column | None = None) -> Column:
    """Category of the first dictionary word found, in dictionary order."""
    if whole and seen is None:
        return once(words_seen(text, words), lambda s: map_category(text, words, seen=s))
    test = (lambda w: saw(text, seen, w)) if whole else (lambda w: contains_any(text, [w]))
    return F.coalesce(*[F.when(test(w), F.lit(c)) for w, c in words.items()])


def number(text: Column, patterns: list[str]) -> Column:
    """First capture group of the first pattern that matches, as a number."""
    hits = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*hits).try_cast("double")


def extract_limit(text: Column) -> Column:
    return number(text, vocab.LIMIT_PATTERNS).cast("long")


def first_number(text: Column) -> Column:
    return number(text, ["([0-9]+)"]).cast("long")


def direction(text: Column) -> Column:
    """``above`` or ``below``, or NULL when the text does not say."""
    return F.when(says(text, vocab.ABOVE_WORDS), "above").when(says(text, vocab.BELOW_WORDS), "below")


def large_numbers(text: Column, floor: int = 10) -> Column:
    """All numbers in the text above ``floor``."""
    every = F.regexp_extract_all(text, F.lit(vocab.NUM), F.lit(1))
    return F.filter(F.transform(every, lambda x: x.try_cast("double")), lambda x: x > floor)


def extract_sort(text: Column) -> Column:
    """Which order the text asks for."""
    def has(*words: str) -> Column:
        return says(text, list(words))

    best = has("en yüksek", "en iyi", "en çok") & has("rating")
    return (
        F.when(best & has("uygun", "ucuz", "düşük"), "rating_price")
        .when(best, "rating")
        .when(has("en ucuz", "en uygun") | (has("fiyat") & has("düşük")), "price_asc")
        .when(has("en pahalı") | (has("fiyat") & has("yüksek")), "price_desc")
        .when(has("en çok satan", "satış"), "sales")
        .when(has("en çok stok") | (has("stok") & has("en")), "stock")
    )


def classify_output(text: Column, has_limit: Column, has_filter: Column) -> Column:
    """Whether the answer is a count, a list, or neither."""
    asks_list = says(text, vocab.LIST_WORDS)
    return (
        F.when(says(text, vocab.COUNT_WORDS) & ~asks_list, "count")
        .when(says(text, vocab.LIST_OR_WHICH_WORDS) | has_limit, "list")
        .when(has_filter, "count")
        .otherwise("none")
    )


def is_transfer(text: Column) -> Column:
    return matches(text, "|".join(vocab.TRANSFER_PATTERNS))


def names_site(text: Column) -> Column:
    return says(text, [w.lower() for w in vocab.WAREHOUSES])


def multi_location(text: Column) -> Column:
    """Two named sites, or a report/total for a named site."""
    sites = f"(?:{'|'.join(w.lower() for w in vocab.BREAKDOWN_ORDER)})"
    return names_site(text) & matches(text, "|".join(vocab.BREAKDOWN_PATTERNS).replace("{sites}", sites))


def is_pointer(text: Column, product_words: list[str], seen: Column | None = None) -> Column:
    """Refers to the previous result and names nothing new."""
    return (
        says(text, vocab.POINTER_WORDS)
        & ~has_word(text, product_words, seen=seen)
        & ~has_word(text, vocab.ROUTE_CATEGORY_WORDS, seen=seen)
        & ~names_site(text)
    )


def route_intent(text: Column, product_words: list[str], seen: Column | None = None) -> Column:
    """Where a question goes, tested in this order."""
    data = says(text, vocab.DATA_PHRASES) | names_site(text)
    return (
        F.when(is_transfer(text), "transfer")
        .when(says(text, vocab.RECOMMEND_PHRASES), "recommendation")
        .when(says(text, vocab.PRODUCT_PHRASES) & ~says(text, vocab.PLACE_PHRASES), "product")
        .when(is_pointer(text, product_words, seen), "previous")
        .when(data & multi_location(text), "breakdown")
        .when(data, "data")
        .otherwise("retrieval")
    )


def extract_exclusion(text: Column) -> Column:
    """The first site the text rules out."""
    tests = []
    for site in vocab.WAREHOUSES:
        pattern = "|".join(vocab.EXCLUSION_PATTERNS).replace("{site}", site.lower())
        tests.append(F.when(says(text, [site.lower()]) & matches(text, pattern), F.lit(site)))
    return F.coalesce(*tests)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit("[^ \\t\\n]+"), F.lit(0)))


def refers_back(text: Column) -> Column:
    """Follow-up by wording alone."""
    return matches(text, "|".join(vocab.FOLLOW_UP_PATTERNS))


def short_follow_up(text: Column, seen: Column | None = None) -> Column:
    """Follow-up if there is any context: short, and only a place or a quantity."""
    only_site = names_site(text) & ~has_word(text, vocab.FOLLOW_UP_CATEGORY_WORDS, seen=seen)
    asks = says(text, vocab.SHORT_QUANTITY_WORDS)
    return (word_count(text) <= vocab.SHORT_FOLLOW_UP_WORDS) & (only_site | asks)


def answer_category(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(says(low, w), F.lit(c)) for c, w in vocab.ANSWER_WORDS.items()])


# --- speakable text --------------------------------------------------------

def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def strip_markup(text: Column, variant: str = "realtime") -> Column:
    """Answer text without markdown and symbols, per consumer."""
    def drop(t: Column, *parts: str) -> Column:
        for part in parts:
            t = F.replace(t, F.lit(part), F.lit(""))
        return t

    if variant == "realtime":
        t = F.substring(text, 1, 600)
        t = F.regexp_replace(t, r"\*\*([^*]+)\*\*", "$1")
        t = F.regexp_replace(t, r"\*([^*]+)\*", "$1")
        t = drop(t, "*", "#", "`", *vocab.SPOKEN_SYMBOLS)
        t = F.replace(t, F.lit("$"), F.lit(" dollars "))
        t = F.replace(t, F.lit("N/A"), F.lit("not available"))
        return squeeze(t)
    if variant == "assistant":
        t = drop(text, "*", "#")
        t = drop(F.replace(t, F.lit("|"), F.lit(" ")), "---", "```", "📊", "📋", "💡")
        t = F.replace(F.replace(t, F.lit("⭐"), F.lit(" yıldız ")), F.lit("⚠️"), F.lit(" uyarı "))
        t = drop(t, "🏆", "📈", "🔊", "💰", "📦")
        t = F.regexp_replace(t, r"\n+", ". ")
        t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t\r\n\f]+", " "), r"[.]+", "."))
        t = F.replace(F.replace(t, F.lit("$"), F.lit(" dolar ")), F.lit("N/A"), F.lit("bilgi yok"))
        return F.when(F.length(t) > 500, F.concat(F.substring(t, 1, 500), F.lit("... ve daha fazlası."))).otherwise(t)
    if variant == "simple":
        t = drop(text, "*", "#", "|", "---")
        return F.when(F.length(t) > 800, F.concat(F.substring(t, 1, 800), F.lit("..."))).otherwise(t)
    if variant == "browser":
        t = drop(text, "*")
        t = F.regexp_replace(t, r"#{1,6}[ \t\r\n\f]", "")
        t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]+\)", "$1")
        t = F.regexp_replace(t, r"`([^`]+)`", "$1")
        return drop(t, "---", "|")
    raise ValueError(f"unknown variant {variant}")
