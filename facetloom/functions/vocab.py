"""Word lists, patterns and templates that results depend on."""

# --- fixed values ---------------------------------------------------------

ASK_ATTRIBUTES = (
    "category", "material", "color", "size", "style",
    "brand", "budget", "feature", "use_case", "other",
)
MATERIALS = (
    "cotton", "polyester", "nylon", "leather", "wool",
    "spandex", "silk", "rayon", "fabric",
)
# Free-form messages know the same materials except the generic "fabric".
MESSAGE_MATERIALS = MATERIALS[:-1]
COLORS = (
    "black", "white", "blue", "red", "pink", "green",
    "brown", "gray", "grey", "purple", "yellow", "orange",
)
# Conversations classify with a shorter colour list than the catalog does.
CONVERSATION_COLORS = COLORS[:6]
SIZE_WORDS = ("size", "sizing", "width", "wide", "narrow")
STYLE_WORDS = ("department", "style", "fit", "sleeve", "neck")
USE_CASE_WORDS = ("hiking", "running", "gym", "winter", "outdoor", "work")

GENERIC_CATEGORIES = (
    "clothing", "clothing shoes & jewelry", "clothing, shoes & jewelry",
)
DEFAULT_CATEGORY = "clothing item"
PATH_SEPARATOR = " > "
EDGE_CHARACTERS = " -;,.\t\n"
GENERIC_BRANDS = ("no", "generic", "unknown")

SCENARIO_STATES = (
    "buying", "exploring_unknown", "browsing", "boundary",
    "provisional_override", "intent_override", "unknown",
)
SCENARIOS = ("buying", "browsing", "boundary", "intent_override")
SPLITS = ("train", "validation", "test")
SPLIT_QUOTAS = {"train": 8, "validation": 1, "test": 1}
SCENARIO_MIXES = {
    "public": {"buying": 8, "browsing": 8, "boundary": 1, "intent_override": 3},
    "balanced": {"buying": 5, "browsing": 5, "boundary": 5, "intent_override": 5},
}
STAGES = (
    ("use_case",),
    ("feature", "style", "material"),
    ("size", "budget", "brand"),
    ("color",),
    ("other",),
)
QUESTIONS = tuple(attribute for stage in STAGES for attribute in stage)
RARE = "<rare>"
NO_ANSWER = "<no-answer>"
TEMPERATURES = (0.25, 0.5, 1.0, 2.0, 4.0)
MAX_TURNS = 10
PRICE_EDGES = (10, 20, 35, 50, 75, 100, 150, 250)
HARD_ATTRIBUTES = ("color", "material", "brand")

OVERRIDE_CUES = (
    "ignore my earlier preference",
    "ignore my previous preference",
    "changed my mind",
    "change my mind",
    "instead, what i need",
)
INTENT_CUES = {
    "browsing": "but i'm still exploring",
    "boundary": "please use your judgment",
    "buying": "a key requirement is",
}
ANSWER_PREFIX = "For that, what matters is:"
OPENING_PREFIX = r"(?i)^\s*I(?:['’]m| am) looking for\s+"

SEMANTIC_OPERATORS = (
    r"(?i)\b(?:not|no|except|exclude|excluding|avoid|without|or|either|instead|"
    r"rather\s+than|remove|clear|forget|don['’]?t|doesn['’]?t|anything\s+but|"
    r"other\s+than|irrelevant|unimportant)\b"
)

QUERY_STOPWORDS = (
    "a", "about", "all", "an", "and", "any", "anything", "are", "avoid", "be",
    "below", "but", "can", "could", "do", "does", "except", "exclude",
    "excluding", "find", "for", "from", "get", "give", "i", "in", "is", "it",
    "looking", "me", "need", "no", "not", "of", "on", "or", "please", "prefer",
    "preferably", "really", "show", "some", "something", "than", "that", "the",
    "these", "things", "this", "those", "to", "under", "want", "with",
    "without", "would",
)

# Free-form dictionaries: phrase -> canonical label.
COLOR_ALIASES = {
    **{color: color for color in COLORS},
    "jet black": "black", "jet-black": "black", "crimson": "red",
    "navy blue": "blue", "navy": "blue",
}
CATEGORY_ALIASES = {
    "road runners": "running shoes", "road runner": "running shoes",
    "running footwear": "running shoes", "walking footwear": "walking shoes",
    "footwear for walking": "walking shoes", "hooded sweatshirts": "hoodies",
    "hooded sweatshirt": "hoodies", "flip-flops": "sandals",
    "flip-flop": "sandals", "flip flops": "sandals", "flip flop": "sandals",
    "road running shoes": "running shoes", "trail running shoes": "running shoes",
    "running sneakers": "running shoes", "running shoe": "running shoes",
    "running shoes": "running shoes", "walking shoe": "walking shoes",
    "walking shoes": "walking shoes", "fashion sneaker": "sneakers",
    "fashion sneakers": "sneakers", "sneaker": "sneakers", "sneakers": "sneakers",
    "sandal": "sandals", "sandals": "sandals", "shirt": "shirts",
    "shirts": "shirts", "t shirt": "shirts", "t shirts": "shirts",
    "tshirt": "shirts", "tshirts": "shirts", "tunic": "tunics",
    "tunics": "tunics", "shoe": "shoes", "shoes": "shoes", "boot": "boots",
    "boots": "boots", "dress": "dresses", "dresses": "dresses",
    "jacket": "jackets", "jackets": "jackets", "jean": "jeans",
    "jeans": "jeans", "pants": "pants", "trousers": "pants", "skirt": "skirts",
    "skirts": "skirts", "sock": "socks", "socks": "socks", "belt": "belts",
    "belts": "belts", "watch": "watches", "watches": "watches",
    "earring": "earrings", "earrings": "earrings", "necklace": "necklaces",
    "necklaces": "necklaces", "ring": "rings", "rings": "rings",
    "slipper": "slippers", "slippers": "slippers", "loafers": "loafers",
    "pumps": "pumps", "flats": "flats", "hoodie": "hoodies",
    "hoodies": "hoodies", "hat": "hats", "hats": "hats",
    "sunglasses": "sunglasses", "runners": "running shoes",
    "runner": "running shoes", "footwear": "shoes",
}
USE_CASE_ALIASES = {
    "jogging": "running", "jog": "running", "running": "running",
    "run": "running", "runs": "running", "walking": "walking",
    "walk": "walking", "hiking": "hiking", "hike": "hiking", "gym": "gym",
    "workout": "gym", "beach": "beach", "summer": "summer", "winter": "winter",
    "outdoor": "outdoor", "formal": "formal", "travel": "travel",
    "travelling": "travel", "traveling": "travel", "sightseeing": "travel",
    "on foot": "walking", "lounge": "lounge", "lounging": "lounge",
}
FEATURE_ALIASES = {
    "comfortable": "comfort", "comfort": "comfort", "comfy": "comfort",
    "cushioned": "cushioned", "cushioning": "cushioned", "stylish": "style",
    "breathable": "breathable", "lightweight": "lightweight",
    "supportive": "supportive", "durable": "durable",
    "waterproof": "waterproof", "soft": "soft", "warm": "warm",
}
BRAND_STOPWORDS = frozenset(
    {
        "find", "need", "want", "something", "style", "fashion", "men", "women",
        "unisex", "generic", "unknown", "refresh",
        *COLORS, *MESSAGE_MATERIALS, *USE_CASE_ALIASES, *FEATURE_ALIASES,
    }
)
COLOR_IDIOMS = (
    r"^(?:black\s+friday|black[-\s]+tie|red[-\s]+carpet|"
    r"blue[-\s]+collar|white[-\s]+collar)\b"
)
MATERIAL_BEFORE = r"\b(?:vegan|faux|synthetic|artificial|pu)\s+$"
MATERIAL_AFTER = r"^(?:-like|\s+like|\s+look(?:ing)?)\b"

# Category label -> (node names, terms the node's path must contain).
CATEGORY_TARGETS = {
    "running shoes": (("Running",), ("Shoes",)),
    "walking shoes": (("Walking",), ("Shoes",)),
    "sneakers": (("Fashion Sneakers", "Sneakers"), ("Shoes",)),
    "sandals": (("Sandals",), ("Shoes",)),
    "shoes": (("Shoes",), ()),
    "shirts": (("Shirts", "T-Shirts", "Blouses & Button-Down Shirts"), ()),
    "tunics": (("Tunics",), ()),
    "boots": (("Boots",), ("Shoes",)),
    "dresses": (("Dresses",), ()),
    "jackets": (("Jackets",), ()),
    "jeans": (("Jeans",), ()),
    "pants": (("Pants",), ()),
    "skirts": (("Skirts",), ()),
    "socks": (("Socks", "Athletic Socks"), ()),
    "belts": (("Belts",), ()),
    "watches": (("Wrist Watches",), ()),
    "earrings": (("Earrings",), ()),
    "necklaces": (("Necklaces",), ()),
    "rings": (("Rings",), ()),
    "slippers": (("Slippers",), ("Shoes",)),
    "loafers": (("Loafers & Slip-Ons",), ("Shoes",)),
    "pumps": (("Pumps",), ("Shoes",)),
    "flats": (("Flats",), ("Shoes",)),
    "hoodies": (("Fashion Hoodies & Sweatshirts",), ()),
    "hats": (("Hats & Caps",), ()),
    "sunglasses": (("Sunglasses",), ()),
}

# Negations of a phrase, which stands where {0} is.
NEGATIONS = (
    r"\bnot\s+(?:for\s+)?(?:a\s+|an\s+|any\s+)?{0}\b",
    r"\bno\s+(?:a\s+|an\s+|any\s+)?{0}\b",
    r"\banything\s+(?:but|except)\s+{0}\b",
    r"\b(?:except|exclude|excluding|avoid|without)\s+(?:a\s+|an\s+|any\s+)?{0}\b",
    r"\bother\s+than\s+{0}\b",
    r"\b(?:do\s+not|don't|dont)\s+want\s+(?:a\s+|an\s+|any\s+)?{0}\b",
    r"\b(?:instead\s+of|rather\s+than)\s+{0}\b",
    r"\b{0}\s+(?:is\s+)?irrelevant\b",
    r"\bnon[-\s]+{0}\b",
    r"\b{0}[-\s]+free\b",
    r"\bfree\s+of\s+{0}\b",
)
NEGATION_CARRIER = r"^\s*(?:,\s*)?(?:and|or)\s*$"

REMOVABLE = {
    "color": r"colou?r",
    "brand": r"brand",
    "material": r"material|fabric",
    "size": r"size",
    "budget": r"budget|price",
    "feature": r"feature",
    "use_case": r"use(?:\s+case)?|occasion",
}
REMOVAL_PATTERNS = (
    r"\b(?:{0})\s+(?:(?:doesn't|does\s+not|doesnt)\s+matter|is\s+(?:irrelevant|unimportant)|is\s+not\s+important)\b",
    r"\b(?:don't|do\s+not|dont)\s+(?:really\s+)?care\s+about\s+(?:the\s+)?(?:{0})\b",
    r"\bno\s+preference\s+(?:for|on)\s+(?:the\s+)?(?:{0})\b",
    r"\bany\s+(?:{0})\s+(?:is\s+)?(?:fine|okay|ok|works)\b",
    r"\b(?:remove|clear|forget)\s+(?:the\s+|my\s+)?(?:{0})(?:\s+preference)?\b",
)
NO_BUDGET = (
    r"\b(?:no|without)\s+(?:a\s+)?(?:budget|price)\s+(?:limit|cap|ceiling)\b|"
    r"\b(?:no|unlimited)\s+budget\b"
)
AMOUNT = r"\s*(?:usd\s*)?\$?\s*(\d+(?:\.\d{1,2})?)\s*(?:dollars?)?\b"
# (pattern, ceiling is inclusive), tried in this order.
PRICE_PATTERNS = (
    (r"\b(?:under|below|less\s+than)" + AMOUNT, False),
    (r"\bkeep\s+it\s+(?:under|below)" + AMOUNT, False),
    (r"\b(?:capped|priced)\s+at" + AMOUNT, True),
    (
        r"\b(?:up\s+to|at\s+most|no\s+more\s+than|not\s+over|maximum(?:\s+of)?|max)"
        + AMOUNT,
        True,
    ),
    (r"\bbudget\s+(?:is|of|around)?" + AMOUNT, True),
    (
        r"\b(?:cap\s+it|raise\s+(?:the\s+)?limit|lower\s+(?:the\s+)?limit|"
        r"set\s+(?:the\s+)?limit)\s+(?:at|to)" + AMOUNT,
        True,
    ),
    (r"\b(?:my\s+)?(?:limit|cap|ceiling)\s+(?:is|of|at)?" + AMOUNT, True),
)
CHEAP_WORDS = r"\b(?:cheap|budget-friendly|inexpensive|affordable)\b"
SIZE_PATTERN = (
    r"\bsize\s+(?:is\s+)?([0-9]{1,2}(?:\.[05])?|[xsml]{1,3})"
    r"(?:\s+or\s+([0-9]{1,2}(?:\.[05])?|[xsml]{1,3}))?\b"
)
STRONG_BROWSING = (
    r"\b(?:some cool things|something nice|ideas? for|still exploring|"
    r"just browsing|general ideas|no rush)\b"
)
NO_PREFERENCE_REPLY = (
    r"(?i)^(?:no preference|doesn['’]?t matter|does not matter|anything|any|whatever|no)$"
)
MONEY_REPLY = (
    r"(?i)^(?:about\s+|around\s+)?(?:usd\s*)?\$?\s*"
    r"([0-9]{1,3}(?:,[0-9]{3})*(?:\.\d{1,2})?|[0-9]+(?:\.\d{1,2})?)\s*(?:dollars?)?$"
)
SIZE_REPLY = (
    r"(?i)^(?:size\s+)?([0-9]{1,2}(?:\.[05])?|x{0,2}[sml]|medium|small|large|extra\s+large)$"
)
