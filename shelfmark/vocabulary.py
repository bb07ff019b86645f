"""Word lists, phrases, templates and defaults that decide results.

Nothing here is logic.  Every list keeps its natural order, because two of them
(query prefixes and phrase expansions) are applied in that order.
"""

# --- Fixed values: text cleaning -------------------------------------------------
# Each phrase, together with the rest of the last line, is legal boilerplate.
BOILERPLATE = (
    r"this product has intoxicating effects",
    r"for use only by adults",
    r"keep out of reach of children",
    r"license(?:d)? dispensary",
    r"cannabis products may only be possessed",
    r"warning:\s*",
)
EMPTY_TERMS = ("none", "null", "unknown", "n a")

# --- Fixed values: labelled sections of a description ----------------------------
SECTION_LABELS = (
    "FLAVOR PROFILE", "EFFECT PROFILE", "PHENOTYPE", "LINEAGE", "AROMA", "FEELING",
    "DESCRIPTION",
)

# --- Fixed values: flags ---------------------------------------------------------
TRUE_WORDS = ("1", "true", "yes", "y", "in stock", "available", "active")
FALSE_WORDS = (
    "0", "false", "no", "n", "out of stock", "unavailable", "inactive", "sold out",
)

# --- Fixed values: words a name may share with its own category ------------------
PROTECTED_WORDS = tuple(
    """flower preroll prerolls roll rolls joint joints vape vapes cart carts
    cartridge cartridges disposable disposables edible edibles gummy gummies
    chocolate beverage drink tincture topical balm lotion capsule capsules
    extract extracts concentrate concentrates live resin rosin badder batter
    budder sugar sauce diamonds shatter wax hash infused indica sativa hybrid
    cbd cbn cbg thc thca gram grams eighth ounce pack indoor outdoor
    greenhouse premium smalls popcorn""".split()
)

# --- Fixed values: search --------------------------------------------------------
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from",
    "give", "i", "in", "is", "it", "me", "my", "of", "on", "or", "please",
    "show", "smoke", "some", "something", "that", "the", "this", "to", "want",
    "weed", "with", "product", "products", "cannabis",
)
INTENT_WORDS = (
    "high", "clean", "clear", "headed", "focused", "focus", "creative", "social",
    "calm", "relaxed", "relax", "sleep", "sleepy", "energy", "energetic",
    "uplifted", "happy", "euphoric", "functional", "anxiety", "flavor", "taste",
    "citrus", "berry", "earthy", "diesel", "body", "cerebral", "fog", "foggy",
    "talkative", "hungry", "tingly", "motivated", "tropical", "pine", "vape",
    "flower", "edible", "gummy", "disposable", "pre roll", "concentrate",
)
QUERY_PREFIXES = (
    "smoke me for ", "give me ", "find me ", "show me ", "i want ",
    "i need ", "looking for ", "something for ", "something that ",
)
ARTICLES = ("a", "an", "the")
PHRASE_EXPANSIONS = (
    ("clean high", "clear headed focused mentally crisp functional balanced uplifted minimal fog"),
    ("clear high", "clear headed focused functional mentally crisp minimal fog"),
    ("without anxiety", "calm steady gentle low anxiety"),
    ("no anxiety", "calm steady gentle low anxiety"),
    ("not sleepy", "alert awake functional minimal sedation"),
    ("without sleepiness", "alert awake functional minimal sedation"),
    ("for sleep", "sleepy deeply relaxed body relaxation nighttime"),
    ("social", "talkative friendly uplifted euphoric comfortable social"),
)
QUERY_TEMPLATE = (
    "Desired legal cannabis retail product, experience, sensory profile, and format: ",
    ". Rank by product category, format, reported effects, flavor, aroma, phenotype, lineage, "
    "potency description, and experiential context. Ignore accidental word overlap in brand or "
    "product names.",
)
BONUS_STEP = 0.012
BONUS_CAP = 0.12
WEIGHT_EXACT, WEIGHT_PREFIX, WEIGHT_INSIDE = 4, 3, 2
IDENTITY_MAX_WORDS = 3
MIN_TERM_CHARS = 3

# --- Fixed values: record text ---------------------------------------------------
RECORD_LEAD = "Cannabis retail inventory product."
DEFAULT_CATEGORY = "Cannabis"
UNCATEGORIZED = "Uncategorized"

# --- Fixed values: vectors and gates ---------------------------------------------
NORM_EPSILON = 1e-12
COMPLETE_NORM_FLOOR = 0.5
UNIT_TOLERANCE = 1e-3
LEAK_MIN_CHARS = 8
MIN_ASSET_BYTES = 512
ASSET_DIGEST_CHARS = 20
MIN_PUBLISH_ROWS = 20

# --- Fixed values: effect design -------------------------------------------------
DESIGN_TOP_ITEMS = 8
DESIGN_TOP_LIBRARY = 7
PATH_TEXT = {
    "both": "Find both a real cannabis cultivar development path and a natural-product analogue.",
    "cultivar": "Develop a real cannabis cultivar and identify phenotype benchmarks and candidate parents.",
    "botanical": "Develop a standardized natural-product effect architecture without presenting a consumer recipe.",
}
NO_GUARDRAILS_TEXT = "Hard guardrails: preserve consistency and low adverse-effect variance."
TARGET_CLOSING = (
    "Prioritize reproducible chemistry, blind outcome measurement, analytical batch verification, "
    "functional clarity, and lawful research development."
)
STEP_1_BOTANICAL = "Lock the target state and the adverse-effect exclusions before selecting materials."
STEP_1_OTHER = (
    "Use {names} as phenotype references. Confirm that any proposed parent record has traceable "
    "genetics before breeding."
)
STEP_1_NO_NAMES = "top measured field benchmarks"
STEP_2_CULTIVAR = (
    "Translate the target into a cannabinoid, volatile and functional-performance assay panel. "
    "Do not select on THC alone."
)
STEP_2_OTHER = (
    "Begin with {names} as measured candidate classes, not a finished recipe. Verify identity, "
    "purity, legality and route suitability."
)
STEP_3_BOTANICAL = (
    "Create analytically distinct prototypes under qualified product-development controls; "
    "exclude combinations with unresolved interactions."
)
STEP_3_OTHER = (
    "Generate segregating populations, measure chemistry and phenotype each candidate, then "
    "retain only plants that reproduce the target state across batches."
)
STEP_4 = (
    "Run randomized, blinded outcome collection with an aromatic or format-matched control. "
    "Capture onset, duration, clarity, anxiety, body load, appetite and next-day effect."
)
STEP_5 = (
    "Feed measured chemistry and outcome vectors back into {instrument}. Advance only designs whose "
    "chemistry, experience and safety signals converge reproducibly."
)
SAFETY_BOUNDARY = (
    "Research and product-development specification only. No consumer dosing or mixing instructions."
)

# --- Fixed values: the default reference library (an input table; pass another to replace it) ---
# name | source | class | evidence | profile | markers | guardrail
LIBRARY_ROWS = (
    ("LAVENDER AROMATIC MATRIX", "Lavandula angustifolia", "AROMATIC BOTANICAL", "HUMAN EVIDENCE · LIMITED",
     "soft floral aromatic profile; calm sensory tone; low stimulation; relaxation-associated; linalool-rich volatile architecture; requires sedation and interaction screening",
     ["linalool", "floral", "calm", "low stimulation"],
     "Concentrated oils require identity, purity and route-specific safety review."),
    ("HOPS VOLATILE MATRIX", "Humulus lupulus", "AROMATIC BOTANICAL", "PRECLINICAL + TRADITIONAL",
     "earthy resinous aromatic profile; body relaxation; evening context; beta-caryophyllene, humulene and myrcene-associated volatile architecture; may increase heaviness",
     ["earthy", "body calm", "evening", "resinous"],
     "Screen sedation, allergy and medication interactions."),
    ("CITRUS PEEL MATRIX", "Citrus spp.", "AROMATIC BOTANICAL", "SENSORY + LIMITED HUMAN",
     "bright citrus aromatic profile; energetic sensory tone; social and daytime context; limonene-rich volatile architecture; low body heaviness",
     ["bright", "citrus", "daytime", "social"],
     "Species, oxidation and phototoxicity risks must be analytically controlled."),
    ("BLACK PEPPER MATRIX", "Piper nigrum", "FOOD-GRADE BOTANICAL", "MECHANISTIC · LIMITED HUMAN",
     "dry spicy aromatic profile; grounding sensory character; beta-caryophyllene-rich architecture; low sweetness; useful as a counterweight to bright volatile profiles",
     ["grounding", "spicy", "dry", "balanced"],
     "Screen gastrointestinal tolerance, allergy and drug interactions."),
    ("ROSEMARY CLARITY MATRIX", "Salvia rosmarinus", "AROMATIC BOTANICAL", "LIMITED HUMAN",
     "herbal camphoraceous aromatic profile; alert and task-oriented sensory tone; 1,8-cineole-associated volatile architecture; low sedation",
     ["alert", "herbal", "task focus", "low sedation"],
     "Concentrated extracts require toxicology and route-specific review."),
    ("PEPPERMINT CLARITY MATRIX", "Mentha × piperita", "FOOD-GRADE BOTANICAL", "SENSORY + LIMITED HUMAN",
     "cooling mint aromatic profile; crisp attention; low emotional weight; menthol and menthone-associated architecture; daytime context",
     ["cooling", "crisp", "daytime", "attention"],
     "Screen reflux, airway sensitivity and concentrated-oil toxicity."),
    ("CHAMOMILE CALM MATRIX", "Matricaria chamomilla", "FOOD-GRADE BOTANICAL", "LIMITED HUMAN",
     "soft apple-floral profile; low-arousal calm; evening and decompression context; apigenin-containing botanical architecture; may increase sleepiness",
     ["calm", "soft", "evening", "sleepiness"],
     "Screen ragweed allergy, anticoagulants and additive sedation."),
    ("LEMON BALM MATRIX", "Melissa officinalis", "FOOD-GRADE BOTANICAL", "LIMITED HUMAN",
     "gentle lemon-herbal profile; calm attention; low social friction; citral and rosmarinic-acid-containing architecture; moderate relaxation without a heavy sensory profile",
     ["calm attention", "lemon", "social ease", "moderate relaxation"],
     "Screen sedation, endocrine considerations and medication interactions."),
    ("GREEN TEA CLARITY CHASSIS", "Camellia sinensis", "BEVERAGE BOTANICAL", "HUMAN EVIDENCE",
     "clean alertness; sustained attention; low body heaviness; caffeine and theanine-containing architecture; daytime functional context",
     ["alert", "clear", "functional", "daytime"],
     "Quantify stimulant load and screen cardiovascular, sleep and medication constraints."),
    ("CACAO SOCIAL CHASSIS", "Theobroma cacao", "FOOD-GRADE BOTANICAL", "HUMAN + FOOD USE",
     "warm roasted sensory profile; gentle stimulation; social and rewarding context; theobromine-containing architecture; moderate duration",
     ["warm", "social", "rewarding", "gentle stimulation"],
     "Quantify methylxanthines and screen stimulant sensitivity and interactions."),
    ("GINGER BODY-BRIGHT MATRIX", "Zingiber officinale", "FOOD-GRADE BOTANICAL", "HUMAN + FOOD USE",
     "warm spicy sensory profile; body brightness; low sedation; daytime or social context; gingerol and volatile-oil architecture",
     ["warm body", "bright", "spicy", "low sedation"],
     "Screen gastrointestinal tolerance, anticoagulants and pregnancy-specific constraints."),
    ("SAFFRON MOOD MATRIX", "Crocus sativus", "FOOD-GRADE BOTANICAL", "HUMAN EVIDENCE · EMERGING",
     "warm floral sensory profile; positive mood and emotional color; low intoxication; crocin and safranal-containing architecture; requires standardized identity",
     ["positive mood", "warm", "emotional color", "low intoxication"],
     "Standardize identity and screen pregnancy, anticoagulants and serotonergic medications."),
    ("TULSI BALANCE MATRIX", "Ocimum tenuiflorum", "FOOD-GRADE BOTANICAL", "LIMITED HUMAN",
     "green clove-like aromatic profile; balanced calm and alertness; low heaviness; eugenol and linalool-containing architecture; daytime decompression context",
     ["balanced", "calm alertness", "green", "daytime"],
     "Screen glucose, anticoagulant, fertility and medication considerations."),
    ("HEMP CBD CHASSIS", "Cannabis sativa · compliant hemp", "CANNABINOID CHASSIS", "HUMAN EVIDENCE · CONTEXT DEPENDENT",
     "non-euphoric cannabinoid chassis; body calm and low stimulation; CBD-dominant architecture; interaction-heavy; product legality and analytical verification required",
     ["non-euphoric", "body calm", "low stimulation", "cannabinoid"],
     "Requires jurisdiction review, medication interaction screening and verified cannabinoid content."),
    ("HEMP CBG CHASSIS", "Cannabis sativa · compliant hemp", "CANNABINOID CHASSIS", "EARLY HUMAN + PRECLINICAL",
     "low-intoxication cannabinoid chassis; clearer and less sedating target than CBD-dominant architecture; CBG-dominant profile; limited outcome evidence",
     ["clear", "low intoxication", "low sedation", "cannabinoid"],
     "Evidence remains early; require jurisdiction, toxicology and interaction review."),
    ("AROMATIC PLACEBO CONTROL", "Matched sensory control", "VALIDATION CONTROL", "REQUIRED CONTROL",
     "matched aroma intensity and format without the target active architecture; used to separate expectancy, ritual and sensory effects from chemistry-specific outcomes",
     ["control", "blind testing", "expectancy", "sensory match"],
     "Must be designed by the study team to preserve blinding."),
)

# --- Fixed values: which raw fields feed each catalogue column -------------------
# column -> (exact keys in order, tokens a fallback key must hold, tokens it must not hold)
FIELD_CHOICE = {
    "description": (("joint_product_description", "product_description", "description"), ("description",), ()),
    "brand": (("joint_product_brand", "product_brand", "brand"), ("brand",), ("id", "url", "image")),
    "category": (("joint_product_category", "product_category", "category"), ("category",), ("sub", "url", "image")),
    "subcategory": (("joint_product_subcategory", "product_subcategory", "subcategory"), ("subcategory",), ()),
    "strain": (("joint_product_strain", "product_strain", "strain"), ("strain",), ("type", "url", "image")),
    "strain_type": (("joint_product_strain_type", "strain_type", "type"), ("strain", "type"), ()),
    "form": (("joint_product_form", "product_form", "form"), ("form",), ("transform",)),
    "image": (("joint_product_image", "joint_product_image_url", "product_image", "image"), ("image",), ("id",)),
    "stock": (("joint_product_in_stock", "product_in_stock", "in_stock", "stock"), ("stock",), ("quantity", "level")),
    "price": (("joint_product_price", "product_price", "price"), ("price",), ("sale", "range")),
    "thc": (("joint_product_potency_thc", "potency_thc", "thc"), ("thc",), ("id", "url")),
    "cbd": (("joint_product_potency_cbd", "potency_cbd", "cbd"), ("cbd",), ("id", "url")),
    "jane_id": (("joint_product_id", "jane_product_id", "product_id"), ("product", "id"), ("wp",)),
    "sku": (("joint_product_sku", "product_sku", "sku"), ("sku",), ()),
    "unit": (("joint_product_unit", "product_unit", "unit", "weight"), ("weight",), ()),
    "effects": (("joint_product_effects", "effects"), ("effect",), ("id", "url")),
    "flavors": (("joint_product_flavors", "flavors"), ("flavor",), ("id", "url")),
    "product_url": (("joint_product_url", "product_url", "jane_url"), ("product", "url"), ()),
}
SCALAR_KEYS = ("name", "title", "label", "value", "url", "src", "guid", "id")
URL_KEYS = ("url", "src", "source_url", "guid", "large", "full")
FLATTEN_LIST_ITEMS = 10
PUBLIC_COLUMNS = (
    "id", "name", "brand", "category", "subcategory", "form", "strain", "strain_type",
    "effects", "flavors", "price", "unit", "in_stock", "image", "thc_text", "cbd_text",
    "product_url",
)
