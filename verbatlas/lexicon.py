"""Word lists, age limits and test items that define what is counted."""

from __future__ import annotations

# Fixed values, all of this file: they must be these for results to be comparable with the published study, which lists them.

ENGLISH_COLLECTIONS = ("Eng-NA", "Eng-UK")
CHILD_ROLES = ("Target_Child", "Child")
PARENT_ROLES = ("Mother", "Father")
DAYS_PER_MONTH = 365.25 / 12
AGE_MIN, AGE_MAX = 12.0, 72.0
CHILD_I = (12.0, 36.0)
CHILD_II = (36.0, 72.0)
PARENT_YOUNG_MAX, PARENT_ALL_MAX = 37.0, 72.0
DAYS_FROM = 120.0
BIN_MONTHS = 3.0
MIN_CHILDREN, MIN_CHILDREN_VOO, MIN_TOKENS, MIN_ADULT_SHARE = 5, 3, 10, 0.5
TOP_ITEMS = 8

SCHEMATIC = ("VL", "VOL", "VO", "VOO")
LOCATIVE = ("VL", "VOL")
VERB_POS = ("verb",)
ADP_POS = ("adp",)
NP_POS = ("noun", "propn", "pron", "det", "adj", "num")
OBJ_RELS = ("obj",)
IOBJ_RELS = ("iobj",)
OBL_RELS = ("obl", "obl:lmod")
PRT_RELS = ("compound:prt", "prt", "compound:prt:lvc")
PASSIVE_RELS = ("nsubj:pass", "aux:pass")
CASE_RELS = ("case", "case:loc")
QUESTION_TYPES = ("question", "?", "q")
NONWORDS = ("xxx", "yyy", "www")

# Locative prepositions of both constructions, of one only, and those that young strata do not count.
PREPS_BOTH = (
    "about", "around", "in", "into", "off", "over", "through", "to", "under", "behind", "down", "from", "on",
    "outside",
)
PREPS_VL = ("across", "at", "along", "inside", "near", "past")
PREPS_VOL = ("onto",)
PREPS_LATE = ("near", "onto")

# Verbs that take two objects.
DITRANSITIVE = (
    "afford", "allocate", "allow", "ask", "assign", "assure", "bake", "blow", "bring", "build", "buy", "cause",
    "charge", "cook", "cost", "cut", "deal", "deny", "design", "do", "draw", "drop", "earn", "feed", "fetch", "find",
    "fine", "get", "give", "grant", "grow", "guarantee", "hand", "hit", "keep", "kick", "leave", "lend", "loan",
    "mail", "make", "offer", "order", "owe", "paint", "pass", "pay", "permit", "pick", "play", "pour", "prescribe",
    "promise", "read", "refuse", "roll", "save", "sell", "send", "serve", "set", "show", "sing", "spare", "spell",
    "supply", "take", "teach", "tell", "throw", "toss", "vote", "wish", "write",
)

# Corpora of the study, other names for some, and files left out: of all, of parents, of the wider parent stratum.
STUDY_CORPORA = (
    "Bates", "Brent", "Evans", "Hall", "McCune", "Snow", "Warren", "Belfast", "Brown", "Feldman", "Higginson",
    "Morisset", "Soderstrom", "Wells", "Bernstein", "Clark", "Fletcher", "Howe", "NewEngland", "Suppes", "Bliss",
    "Cornell", "Garvey", "Korman", "Peters", "Tardif", "Bloom70", "Cruttenden", "Gathercole", "Kuczaj", "Post",
    "Valian", "Bloom73", "Demetras1", "Gleason", "MacWhinney", "Rollins", "VanHouten", "Bohannon", "Demetras2",
    "Haggerty", "Manchester", "Sachs", "VanKleeck",
)
CORPUS_ALIASES = {"Bloom": ("Bloom70", "Bloom73")}
EXCLUDED_FILES = (
    "Bernstein/Interview/", "Bloom70/Gia/gia1", "Cornell/horn1712", "Cornell/mom01a", "Cornell/mom01b",
    "Cornell/mom0281", "Cornell/mom0282", "Cornell/mom03", "Cornell/mom04", "Cornell/mom0501", "Cornell/mom0502",
    "Cornell/mom06", "Cornell/mom07", "Cornell/mom0885", "Cornell/mom0886", "Cornell/mom10", "Cornell/nurse1",
    "Cornell/nurse2", "Cornell/nurse3", "Cornell/nurse4", "Cornell/nurse5", "Evans/dyad05", "Evans/dyad21",
    "Hall/WhitePro/grc", "Hall/WhitePro/lea", "MacWhinney/0notlinked/01diary", "Morisset/UCLA/", "VanKleeck/justin1b",
    "VanKleeck/nikki2b", "VanKleeck/walter2b",
)
EXCLUDED_PARENT_FILES = (
    "Brent/c1/c1-0930", "Brent/d1/d1-0925", "Brent/f1/f1-0910", "Brent/f1/f1-1206", "Brent/f1/f1-1318",
    "Brent/f2/f2-0827", "Brent/f2/f2-0927", "Brent/f2/f2-1121", "Brent/f2/f2-1303", "Brent/j1/j1-1023",
    "Brent/j1/j1-1115", "Brent/j1/j1-1214", "Brent/j1/j1-1229", "Brent/m2/m2-0907", "Brent/m2/m2-0928",
    "Brent/m2/m2-1113", "Brent/m2/m2-1223", "Brent/m2/m2-1322", "Brent/q1/q1-0900", "Brent/q1/q1-1012",
    "Brent/q1/q1-1026", "Brent/q1/q1-1109", "Brent/q1/q1-1128", "Brent/s1/s1-1001", "Brent/s2/s2-0905",
    "Brent/s2/s2-1206", "Brent/s2/s2-1404", "Brent/s3/s3-0913", "Brent/s3/s3-1028", "Brent/s3/s3-1128",
    "Brent/s3/s3-1209", "Brent/t1/t1-0830", "Brent/t1/t1-1025", "Brent/v1/v1-0910", "Brent/v1/v1-1305",
    "Brent/v1/v1-1403", "Brent/v2/v2-0903", "Brent/v2/v2-1014", "Brent/v2/v2-1223", "Brent/v2/v2-1307",
    "Brent/v2/v2-1508", "Brent/w1/w1-1123", "Brent/w1/w1-1206", "Korman/", "Rollins/al12", "Soderstrom/The/the06c",
    "Soderstrom/The/the06d", "Bernstein/Children/Amelia/amelia3", "Bernstein/Children/Cindy/cindy1",
    "Bernstein/Children/Kay/kay2", "Bloom70/Gia/gia2", "Bloom70/Gia/gia3", "Bloom70/Gia/gia4", "Bloom70/Gia/gia5",
    "Cornell/moore188", "Feldman/01-03", "Feldman/04", "Feldman/05", "Feldman/06", "Feldman/07", "Feldman/08",
    "Feldman/09", "Feldman/10", "Rollins/jw03", "Belfast/david02", "Belfast/rachel8", "McCune/Jase/", "McCune/Laura/",
    "McCune/Rick/rick17", "McCune/Rick/rick18", "Morisset/", "Wells/iris06", "Wells/rosie02",
)
EXCLUDED_PARENT_ALL_FILES = (
    "Brown/Sarah/sarah113", "Gleason/Father/eddie", "Hall/BlackWork/rog", "MacWhinney/0notlinked/61a-inc",
)

# Verbs expected to lead, by construction and by construction and preposition (of parents or children).
LEADS = {"VL": ["come", "go"], "VOL": ["put"], "VO": ["get"], "VOO": ["give"]}
PREP_LEADS = {"VL-about": ["talk"], "VL-at": ["look"], "VL-down_parents": ["sit"], "VL-down_children": ["fall"], "VOL-off": ["take"], "VOL-to": ["give"]}
ZIPF_R2_MIN, PARENT_CHILD_R = 0.9, 0.8

# Probe sentences: (id, construction, preposition, template).
FRAMES = (
    ("vl_off_01", "VL", "off", "She {verb} off the chair."),
    ("vl_off_02", "VL", "off", "He {verb} off the bed."),
    ("vl_into_01", "VL", "into", "They {verb} into the room."),
    ("vl_about_01", "VL", "about", "We {verb} about the problem."),
    ("vl_at_01", "VL", "at", "She {verb} at the picture."),
    ("vl_down_01", "VL", "down", "He {verb} down the stairs."),
    ("vl_on_01", "VL", "on", "The cat {verb} on the mat."),
    ("vl_to_01", "VL", "to", "They {verb} to the park."),
    ("vol_on_01", "VOL", "on", "She {verb} the cup on the table."),
    ("vol_off_01", "VOL", "off", "He {verb} the hat off the hook."),
    ("vol_in_01", "VOL", "in", "They {verb} the toys in the box."),
    ("vol_to_01", "VOL", "to", "She {verb} the book to the child."),
    ("vol_into_01", "VOL", "into", "He {verb} the letter into the envelope."),
    ("voo_01", "VOO", None, "They {verb} him the book."),
    ("voo_02", "VOO", None, "She {verb} the child a cookie."),
    ("voo_03", "VOO", None, "He {verb} me the keys."),
    ("vo_01", "VO", None, "She {verb} the apple."),
    ("vo_02", "VO", None, "They {verb} a house."),
    ("vo_03", "VO", None, "He {verb} the door."),
)
# Verbs that belong in a construction, and others.
OCCUPANTS = {"VL": ["go", "come", "fall", "get", "sit", "look", "talk", "run", "walk", "jump"], "VOL": ["put", "take", "get", "give", "throw", "drop", "set", "place"], "VOO": ["give", "tell", "show", "send", "bring", "hand", "offer", "read"], "VO": ["get", "have", "want", "see", "eat", "make", "find", "take"]}
DISTRACTORS = {"VL": ["eat", "sleep", "think", "know", "want", "like", "see", "have"], "VOL": ["sleep", "go", "talk", "think", "want", "like", "know", "sit"], "VOO": ["donate", "sleep", "go", "put", "eat", "sit", "fall", "talk"], "VO": ["sleep", "go", "sit", "fall", "come", "arrive"]}
# Pairs of sentences: (id, construction, verb, grammatical, control).
AFFINITY = (
    ("aff_vl_off_01", "VL", "come", "She came off the chair.", "Off she chair the came."),
    ("aff_vl_off_02", "VL", "fall", "He fell off the bed.", "He put the book off the bed."),
    ("aff_vl_into_01", "VL", "go", "They went into the room.", "They put into the room."),
    ("aff_vl_about_01", "VL", "talk", "We talked about the problem.", "We put about the problem."),
    ("aff_vl_at_01", "VL", "look", "She looked at the picture.", "She put at the picture."),
    ("aff_vol_on_01", "VOL", "put", "She put the cup on the table.", "She went the cup on the table."),
    ("aff_vol_off_01", "VOL", "take", "He took the hat off the hook.", "He slept the hat off the hook."),
    ("aff_vol_in_01", "VOL", "put", "They put the toys in the box.", "In they toys the put box the."),
    ("aff_voo_01", "VOO", "give", "They gave him the book.", "They donated him the book."),
    ("aff_voo_02", "VOO", "tell", "She told the child a story.", "She put the child a story."),
    ("aff_voo_03", "VOO", "show", "He showed me the keys.", "He slept me the keys."),
    ("aff_vo_01", "VO", "eat", "She ate the apple.", "She slept the apple."),
    ("aff_vo_02", "VO", "get", "They got a house.", "They went a house."),
    ("aff_vo_03", "VO", "open", "He opened the door.", "He sat the door."),
    ("aff_vl_down_01", "VL", "sit", "She sat down on the floor.", "She ate down on the floor."),
    ("aff_vol_to_01", "VOL", "give", "She gave the book to the child.", "She slept the book to the child."),
)
# Model tracks: (architecture, name of an epoch's model, number of epochs).
TRACKS = {
    "gpt2_100m": ("gpt2", "Raj-Sanjay-Shah/babyLM_100M_gpt2_epoch-{epoch}", 24),
    "distilbert_100m": ("distilbert", "Raj-Sanjay-Shah/babyLM_100M_distilbert_epoch-{epoch}", 60),
}

# Thresholds and means of the published hand check: token minimum, agreement, precision, recall.
HANDCHECK = {
    "function_agreement_min": 0.70, "function_precision_min": 0.60, "token_min": 30,
    "form_precision_mean": 0.969, "function_precision_mean": 0.875, "recall_mean": 0.705,
    "VO": (0.956, 0.942, 0.675), "VOO": (0.947, 0.947, 0.467), "VL": (0.971, 0.887, 0.716), "VOL": (0.970, 0.852, 0.706),
    "noisy": ("VL-to", "VL-in", "VOL-in", "VL-about", "VOL-about"),
}
