"""Place names, word lists, dictionaries and thresholds.

They are data, not logic: results only agree when these are the same.
"""

from __future__ import annotations

# Warehouses, in round-robin order.
WAREHOUSES = ["Melbourne", "Sydney", "Brisbane", "Perth"]
# Order in which a breakdown lists them.
BREAKDOWN_ORDER = ["Sydney", "Melbourne", "Brisbane", "Perth"]

# Raw listing columns, in file order.
RAW_COLUMNS = [
    "product_id", "product_name", "category", "rank", "discounted_price", "rating",
    "review_count", "is_prime", "product_link", "image_url", "scraped_at",
]

# Thresholds.
DEFAULT_RATING = 4.5
DEFAULT_REVIEWS = 0
PRICE_BAND_LOW = 7        # tenths of the product's price
PRICE_BAND_HIGH = 13
MIN_RATING_GAP = 0.3
ALTERNATIVES_KEPT = 5
HIGH_PERFORMER_RATING = 4.6
HIGH_PERFORMER_SALES = 30
RESTOCK_DAYS = 7
CRAWL_TARGET = 2000
ARCHIVE_AFTER_DAYS = 7
DELETE_AFTER_DAYS = 30
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 100
NEIGHBOURS = 10
LINK_HOST = "https://www.amazon.com"

# Quality scores below it need a review; a run stops there.
MIN_QUALITY = 70.0

# Validation ranges.
PRICE_RANGE = (0.01, 10000.0)
RATING_RANGE = (0.0, 5.0)
STOCK_RANGE = (0, 10000)

# Speech segmentation.
SPEECH_THRESHOLD = 0.015
NOISE_WINDOW = 50
NOISE_MIN_FRAMES = 10
NOISE_QUANTILE = 0.2
NOISE_FACTOR = 2.0

# Misheard place names.
PLACE_VARIANTS = {
    "perth": [
        "kört", "körte", "körtte", "pört", "pörth", "pörtte", "pörtteki", "pörte",
        "port şehrinde", "port'ta", "portta",
    ],
    "sydney": [
        "sıdney", "sıdni", "sidni", "sidneyde", "sydney'de", "siz neydi", "siz ney",
        "sidney", "sidneydi",
    ],
    "melbourne": [
        "melbourn", "melbırn", "melbörn", "melvin", "malbun", "malbın", "melbun",
        "melbourne'da", "melborn", "melbörün",
    ],
    "brisbane": ["brisbeyn", "brizbeyn", "brisbane'de", "brisbın"],
}

# Category words (English and Turkish), first hit wins.
CATEGORY_WORDS = {
    "electronics": "Electronics",
    "elektronik": "Electronics",
    "books": "Books",
    "kitap": "Books",
    "home": "Home & Kitchen",
    "ev": "Home & Kitchen",
    "kitchen": "Home & Kitchen",
    "mutfak": "Home & Kitchen",
    "clothing": "Clothing, Shoes & Jewelry",
    "clothes": "Clothing, Shoes & Jewelry",
    "fashion": "Clothing, Shoes & Jewelry",
    "giyim": "Clothing, Shoes & Jewelry",
    "moda": "Clothing, Shoes & Jewelry",
    "shoes": "Clothing, Shoes & Jewelry",
    "jewelry": "Clothing, Shoes & Jewelry",
    "sports": "Sports & Outdoors",
    "spor": "Sports & Outdoors",
    "beauty": "Beauty & Personal Care",
    "güzellik": "Beauty & Personal Care",
    "toys": "Toys & Games",
    "oyuncak": "Toys & Games",
    "pet": "Pet Supplies",
    "automotive": "Automotive",
    "tools": "Tools & Home Improvement",
    "office": "Office Products",
    "health": "Health & Household",
}

# Words that count as naming a category when deciding on follow-ups.
FOLLOW_UP_CATEGORY_WORDS = ["electronics", "elektronik", "books", "kitap", "home", "ev"]
ROUTE_CATEGORY_WORDS = FOLLOW_UP_CATEGORY_WORDS + ["fashion", "clothing", "clothes"]

# Product words.
PRODUCT_WORDS = [
    "earbuds", "earbud", "kulaklık", "headphones", "airpods",
    "ipad", "tablet", "macbook", "laptop",
    "iphone", "phone", "telefon",
    "watch", "saat", "apple watch",
    "tv", "television", "fire tv", "echo",
    "kindle", "e-reader",
    "bluetooth", "wireless",
    "charger", "şarj", "cable", "kablo",
    "speaker", "hoparlör",
    "camera", "kamera",
    "keyboard", "klavye", "mouse",
]

# Words that lift the place filter.
EVERYWHERE_WORDS = ["elimizde", "toplam", "tüm", "all"]

# Routing phrases.
RECOMMEND_PHRASES = [
    "which city should", "which warehouse should", "where should i go",
    "where should i send", "where should i", "which location", "recommend", "suggest",
    "alternative", "out of stock", "low stock", "no stock", "has no",
]
PRODUCT_PHRASES = [
    "most expensive", "cheapest", "highest price", "lowest price",
    "top rated", "best rated", "worst rated",
    "which product", "which item", "what product",
    "compare products", "difference between products",
]
PLACE_PHRASES = ["city", "warehouse", "location", "where should",
                 "recommend warehouse", "suggest warehouse"]
DATA_PHRASES = ["how many", "kaç", "toplam", "total", "count", "liste", "list",
                "show", "göster", "display", "give me"]
TRANSFER_PATTERNS = ["transfer", "move", "send", "ship", "relocate", "from.*to",
                     "taşı", "gönder", "aktar"]
POINTER_WORDS = ["bunlar", "bu ürünler", "bunları", "onları", "these", "those", "them"]
FOLLOW_UP_PATTERNS = [
    r"^peki\s", r"^peki$", r"^ya\s", r"^e\s", r"^ama\s",
    r"sydney'de", r"sydney de", r"melbourne'da", r"melbourne da",
    r"brisbane'de", r"brisbane de", r"perth'te", r"perth te",
    r"^listele", r"^göster", r"^bunları", r"^liste$", r"^listede$",
    r"onlar", r"bunlar", r"o ürünler", r"bu ürünler", r"sadece",
    r"^ne kadar", r"^kaç tane",
]
SHORT_FOLLOW_UP_WORDS = 6
SHORT_QUANTITY_WORDS = ["kaç", "ne kadar", "listele", "göster"]
LIST_WORDS = ["liste", "göster", "list", "show"]
LIST_OR_WHICH_WORDS = LIST_WORDS + ["which", "hangi"]
COUNT_WORDS = ["kaç", "count", "how many", "sayı", "ne kadar", "kaç tane"]
ABOVE_WORDS = ["üzeri", "üstü", ">"]
BELOW_WORDS = ["altı", "altında", "<"]

# Category of an answer text, first hit wins.
ANSWER_WORDS = {
    "Books": ["book", "kitap"],
    "Electronics": ["electronic", "elektronik", "laptop", "phone", "computer", "tablet"],
    "Clothing": ["clothing", "cloth", "shoe", "fashion", "shirt", "pants"],
    "Home": ["home", "kitchen", "ev", "mutfak"],
}

# Answer to an intent that is none of those known.
NOT_UNDERSTOOD = "⚠️ I couldn't understand your question. Please try rephrasing."

# Symbols dropped before speaking an answer.
SPOKEN_SYMBOLS = "📋📍✅💡🤖⭐💰📦🎙️"

# Number patterns, tried in order, with one captured group each. One difference is intended: a number has at
# most one decimal point, so a full stop behind it is none of it.
NUM = r"(\d+(?:\.\d+)?)"
RATING_PATTERNS = [
    rf"rating['\"]?\s*[><=]+\s*{NUM}",
    rf"rating\s+{NUM}\s*(?:üstü|üzeri|den fazla|dan fazla)",
    rf"{NUM}\s*(?:üstü|üzeri|den fazla|dan fazla|üzerinde).*rating",
    rf"rating.*?{NUM}\s*(?:üstü|üzeri)",
]
PRICE_PATTERNS = [
    rf"(?:fiyat|price)['\"]?\s*[><=]+\s*{NUM}",
    rf"(?:fiyat|price)\s+{NUM}\s*(?:üstü|üzeri|dolar)",
    rf"{NUM}\s*(?:dolar|usd|\$)?\s*(?:üstü|üzeri|üzerinde).*(?:fiyat|price)",
    rf"(?:fiyat|price).*?{NUM}\s*(?:üstü|üzeri)",
]
STOCK_PATTERNS = [
    r"stok\s*([\d]+)\s*(?:üstü|üzeri|den fazla)",
    r"stock.*?([\d]+)",
]
LIMIT_PATTERNS = [
    r"(\d+)\s*(?:tane|adet|ürün|tanesini|adedini)",
    r"(?:ilk|en iyi|top)\s*(\d+)",
]
# Variant that takes the direction from the text instead of assuming "above".
COUNT_PRICE_PATTERN = rf"(?:price|fiyat)[ıi]?\s*[><=]*\s*{NUM}"
COUNT_STOCK_PATTERN = r"(?:stock|stok)[_\s]*(?:quantity)?[ıi]?\s*[><=]*\s*(\d+)"

# How a text rules a site out; ``{site}`` stands for the name.
EXCLUSION_PATTERNS = [
    r"if\s+{site}\s+has\s+(?:no|zero|low)",
    r"if\s+{site}\s+(?:is\s+)?(?:out|no\s+stock|low\s+stock)",
    r"where.*if\s+{site}",
    r"{site}\s+(?:is\s+)?(?:out\s+of\s+stock|has\s+no|no\s+stock|low\s+stock)",
    r"(?:alternative\s+to|instead\s+of)\s+{site}",
]

# Two named sites, or a report on a named site; ``{sites}`` stands for any of the names.
BREAKDOWN_PATTERNS = [r"{sites}.*(?:and|,|with).*{sites}", r"(?:report|breakdown|distribution|total).*{sites}"]
