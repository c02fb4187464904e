"""Fixed values.

Everything below must equal the values of the original Dutch incident-report
pipeline for results to agree; they are stated as plain text, in their natural
order.  All of them are defaults only: every operator takes them as
parameters.
"""

# --- fixed values: ordered abbreviation rules (literal substring replaces) --------
# Order matters: rules run one after another over the lowercased text.
REPLACEMENT_RULES: list[tuple[str, str]] = [
    ("cliënt", "client"),
    ("patiënt", "patient"),
    (";", ":"),
    ("vos.", "alarm"),
    ("pt.", "client"),
    ("mw.", "mevrouw"),
    ("mr.", "meneer"),
    ("dhr.", "meneer"),
    ("vzo.", "zorgondersteuner"),
    ("v.z.o.", "zorgondersteuner"),
    ("mvr.", "mevrouw"),
    ("mnr.", "meneer"),
    ("mevr.", "mevrouw"),
    ("og.", "ondergetekende"),
    ("pte.", "client"),
    ("vpk.", "verpleegkundige"),
    ("bgl.", "begeleiding"),
    ("collega's", "collega"),
    ("pat.", "client"),
    ("og.", "begeleider"),
    ("o.g.", "begeleider"),
    ("o.g", "begeleider"),
    ("dda.", "dienstdoende arts"),
    ("vzo.", "verzorging"),
    ("medecl.", "medeclient"),
    ("cl.", "client"),
    ("o.g.", "ondergetekende"),
]

# --- fixed values: aggressive-verb lexicon (one word per line in the original) ----
AGGRESSIVE_VERBS: list[str] = [
    "slaan", "meppen", "stompen", "schoppen", "krassen", "bijten", "trekken",
    "duwen", "sjorren", "aanvallen", "vastpakken", "neersteken", "steken",
    "wurgen", "knijpen", "stikken", "grijpen", "gooien", "trappen", "beuken",
    "spugen", "vechten", "afpakken", "aanvliegen", "worstelen", "aanrijden",
    "gijzelen", "smijten", "vermoorden", "verkrachten",
]

# --- fixed values: staff words (subject / agent tests of the role rules) ----------
STAFF_WORDS: list[str] = [
    "verpleegkundige", "collega", "collega's", "begeleiding", "begeleider", "vzo",
    "arts", "og", "pgsm", "verpleging", "politie", "ddaa", "o.g.", "vpk", "begl",
    "psychiater",
]

# --- fixed values: reflexive objects, threatening verbs, relations ---------------
REFLEXIVE_OBJECTS: list[str] = ["zich", "zichzelf"]
THREAT_VERBS: list[str] = ["dreigen", "willen", "vragen", "lijken", "bedreigen"]
FRAME_RELATIONS: list[str] = ["nsubj", "obj", "iobj", "nsubj:pass", "obl:agent"]
SUBJECT_RELATIONS: list[str] = ["nsubj", "nsubj:pass"]
OBJECT_RELATIONS: list[str] = ["obj", "obl:agent"]

# --- fixed values: words removed before topic modelling --------------------------
TOPIC_STOP_WORDS: list[str] = ["client", "cliente"]

# --- fixed values: evaluation label order, precursor window ----------------------
LABELS: list[str] = ["pos", "neg"]
PRECURSOR_WINDOW = 7            # the original selects 7 clauses (range(agr-7, agr))
MIN_BUCKET_COUNT = 8            # distance buckets with fewer rows fold into 'Other'
SVM_C = 8.0
SVM_GAMMA = 0.0008
SVM_MAX_ITER = 10000
TOPIC_TOP_N = 10

# --- test-table parameters (our own, for the synthetic multilingual documents) ----
TEST_LEXICON: list[str] = [
    "trash", "scum", "idiot", "clown", "worthless", "moron", "pathetic",
    "loser", "stupid", "disgusting",
]
# Cause words of the synthetic token annotations.
CAUSE_WORDS: list[str] = ["that", "que", "weil", "parce"]
# Coordinating conjunctions per language for the surface clause splitter.
CONJUNCTIONS: dict[str, list[str]] = {
    "en": ["and", "or", "but"],
    "de": ["und", "oder", "aber"],
    "es": ["y", "o", "pero"],
    "fr": ["et", "ou", "mais"],
    "nl": ["en", "of", "maar"],
}
