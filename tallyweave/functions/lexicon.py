"""Default word lists and patterns of the text rubric. Every operator takes its lists as parameters; these are the defaults."""

# The lists must equal the published rubric's for equal scores.
RELIGIOUS = (
    "christ", "christian", "jesus", "gospel", "bible", "biblical", "scripture", "church", "congregation", "parish", "ministry", "ministries",
    "missionary", "evangel", "catholic", "baptist", "methodist", "lutheran", "presbyterian", "episcopal", "pentecostal", "jewish", "synagogue",
    "torah", "rabbi", "islam", "muslim", "mosque", "quran", "buddhist", "hindu", "temple", "salvation army", "worship", "prayer", "holy", "sacred",
    "seminary", "chapel", "diocese", "orthodox", "spiritual", "faith", "faith-based",
)

STRONG = (
    "christ", "christian", "jesus", "gospel", "bible", "church", "catholic", "baptist", "methodist", "lutheran", "presbyterian", "episcopal",
    "pentecostal", "jewish", "synagogue", "torah", "rabbi", "islam", "muslim", "mosque", "quran", "buddhist", "hindu", "temple", "salvation army",
    "seminary", "chapel", "diocese", "orthodox",
)

VERBS = (
    "provide", "support", "promote", "serve", "educate", "deliver", "fund", "preserve", "assist", "help", "aid", "offer", "give", "facilitate",
    "advance", "strengthen", "develop", "build", "create", "maintain", "manage", "operate", "improve", "enhance", "protect", "conserve", "advocate",
    "defend", "empower", "enrich", "inspire", "encourage", "prepare", "train", "teach", "guide", "lead", "organize", "coordinate", "conduct",
    "perform", "establish", "foster", "cultivate", "nurture", "sustain", "expand", "extend", "increase", "raise", "collect", "distribute", "share",
    "bring", "keep", "ensure", "work", "act", "dedicate", "commit", "devote", "strive", "aim", "seek", "endeavor", "undertake", "carry", "engage",
    "participate", "collaborate", "partner", "unite", "join", "link", "connect", "integrate", "combine", "merge", "present", "glorify", "worship",
    "pray", "minister",
)

BENEFICIARIES = (
    "children", "child", "kids", "youth", "families", "family", "individuals", "individual", "community", "communities", "students", "student",
    "seniors", "senior", "elderly", "aged", "disabled", "disability", "veterans", "veteran", "patients", "patient", "homeless", "animals", "animal",
    "refugees", "refugee", "immigrants", "immigrant", "women", "woman", "men", "man", "people", "persons", "person", "residents", "resident",
    "public", "society", "world", "nation", "country", "state", "city", "town", "county", "region", "area", "neighborhood", "district", "poor",
    "needy", "disadvantaged", "underserved", "low-income", "low income", "at-risk", "at risk", "high-risk", "high risk", "vulnerable", "marginalized",
    "minority", "majority", "group", "population", "demographic", "class", "category",
)

ACTIVITIES = (
    "scholarships", "scholarship", "food bank", "housing", "research", "counseling", "camps", "camp", "education", "training", "support", "services",
    "service", "programs", "program", "activities", "activity", "events", "event", "outreach", "advocacy", "assistance", "care", "treatment",
    "therapy", "rehabilitation", "recovery", "shelter", "meals", "meal", "clothing", "clothes", "medicine", "healthcare", "health", "wellness",
    "fitness", "sports", "sport", "recreation", "arts", "art", "culture", "music", "dance", "theater", "theatre", "film", "media", "publishing",
    "writing", "reading", "literacy", "library", "museum", "conservation", "preservation", "restoration", "protection", "cleanup", "recycling",
    "gardening", "farming", "agriculture", "nutrition", "cooking", "food", "water", "sanitation", "hygiene", "safety", "security", "emergency",
    "rescue", "relief", "aid", "development", "construction", "building", "renovation", "repair", "maintenance", "transportation", "travel",
    "tourism", "hospitality", "accommodation", "lodging", "camping", "scouting", "mentoring", "tutoring", "coaching", "teaching", "instruction",
    "guidance", "leadership", "fellowship", "networking", "partnership", "collaboration",
)

# Penalised phrases.
BOILERPLATE = (r"501\s*\(c\)", r"internal\s+revenue\s+code\b", r"irc\b", r"tax\s+exempt\b", r"exempt\s+from\s+taxation\b")
VAGUE = (
    r"to\s+promote\s+the\s+general\s+welfare\b", r"general\s+welfare\b", r"charitable\s+purposes\s+only\b", r"exclusively\s+charitable\b",
    r"exclusively\s+for\s+charitable\b", r"general\s+charitable\s+purposes\b", r"broad\s+charitable\s+purposes\b", r"all\s+lawful\s+purposes\b",
    r"any\s+lawful\s+purpose\b", r"all\s+legal\s+purposes\b", r"any\s+legal\s+purpose\b",
)

# Denominational acronyms kept in capitals, legal suffixes of names.
ACRONYMS = ("AME", "COGIC", "ELCA", "LDS")
SUFFIXES = ("incorporated", "inc", "llc", "l.l.c", "llp", "lp", "corporation", "corp", "company", "co", "limited", "ltd", "pllc", "pc", "plc", "gmbh", "nonprofit corporation")

# Major groups of the exempt-organization taxonomy.
GROUPS = {
    "A": "Arts, Culture & Humanities", "B": "Education", "C": "Environment", "D": "Animal-Related", "E": "Health Care",
    "F": "Mental Health & Crisis Intervention", "G": "Voluntary Health Associations & Medical Disciplines", "H": "Medical Research", "I": "Crime & Legal-Related",
    "J": "Employment", "K": "Food, Agriculture & Nutrition", "L": "Housing & Shelter", "M": "Public Safety, Disaster Preparedness & Relief",
    "N": "Recreation & Sports", "O": "Youth Development", "P": "Human Services", "Q": "International, Foreign Affairs & National Security",
    "R": "Civil Rights, Social Action & Advocacy", "S": "Community Improvement & Capacity Building", "T": "Philanthropy, Voluntarism & Grantmaking Foundations",
    "U": "Science & Technology", "V": "Social Science", "W": "Public & Societal Benefit", "X": "Religion-Related", "Y": "Mutual & Membership Benefit", "Z": "Unknown or missing NTEE",
}

# Boundary classes, each with the pattern that must occur and the words that must not; the first that fits counts.
BOUNDARY = (
    ("saint", r"st\.?\s+\w+|saint\s+\w+", ("church", "diocese", "catholic", "parish", "christian")),
    ("spiritual", r"spiritual\b", ("christ", "christian", "jesus", "gospel", "bible", "church", "synagogue", "mosque", "temple", "islam", "muslim", "jewish", "hindu", "buddhist")),
    ("ministry", r"(?:ministry|ministries)\b", STRONG),
    ("faith_heritage", r"(?:faith|judeo-christian)\b", ("christ", "christian", "jesus", "gospel", "bible", "church", "synagogue", "mosque", "temple")),
    ("boilerplate_religious", r"religious,\s+charitable\s+and\s+educational\b", ()),
)

# Review cues of a name.
CUES = (
    ("saint_name", r"\b(?:st\.?|saint)\s+\w+"),
    ("faith_heritage", r"\b(?:faith|grace|trinity|covenant|heritage)\b"),
    ("non_christian_tradition", r"\b(?:buddh(?:ist|a)?|gurdwara|hindu|islam(?:ic)?|jain|masjid|mosque|muslim|sikh|synagogue|temple)\b"),
    ("non_english_name", r"\b(?:amigos|asociacion|associazione|associacao|centro|comunidad|cultura|culturelle|ecole|escuela|fondation|fundacion|gemeinde|iglesia|societe|sociedad|verein)\b|[^\x00-\x7f]"),
)
