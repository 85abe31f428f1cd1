"""Word lists, patterns and constants that results depend on. Every function that uses one takes it as a parameter."""

# Multiplier of each evidence level; unknown levels count 1.0.
EVIDENCE_MULTIPLIER = {
    "systematic_review": 3.0,
    "clinical_trial": 2.5,
    "clinical_observation": 2.0,
    "traditional": 1.0,
    "in_vitro": 0.8,
    "ethnobotanical": 0.7,
    "theoretical": 0.5,
}
# Order of evidence levels for the minimum filter; unknown levels count 0.
EVIDENCE_PRIORITY = {
    "systematic_review": 6,
    "clinical_trial": 5,
    "clinical_observation": 4,
    "traditional": 3,
    "in_vitro": 2,
    "ethnobotanical": 1,
    "theoretical": 0,
}
BM25_K1, BM25_B = 1.5, 0.75
NORMALIZED_BOOST, REQUIRED_BOOST, PHRASE_BOOST = 1.2, 2.0, 5.0
RRF_K, LEXICAL_WEIGHT, VECTOR_WEIGHT = 60, 0.4, 0.6
HASH_BUCKETS, VECTOR_DIM, VECTOR_SEED = 10_000, 384, 42

# Stop words.
STOPWORDS = """the a an is are was were be been being have has had do does did will would could should may might must shall
can need dare ought used to of in for on with at by from as into through during before after above below between under and
but or yet so it its itself they them their this that these those i me my we us""".split()

# Synonyms by canonical term.
SYNONYMS = {
    "headache": ["head pain", "cephalalgia", "cranial pain", "head ache"],
    "migraine": ["sick headache", "hemicrania", "migraine headache"],
    "nerve pain": ["neuralgia", "neuropathy", "neuropathic pain", "nerve ache"],
    "joint pain": ["arthralgia", "arthritis pain", "joint ache"],
    "muscle pain": ["myalgia", "muscular pain", "muscle ache", "muscular ache"],
    "back pain": ["lumbago", "dorsalgia", "backache"],
    "stomach pain": ["gastric pain", "abdominal pain", "belly ache", "stomach ache"],
    "menstrual pain": ["dysmenorrhea", "period pain", "menstrual cramps"],
    "insomnia": ["sleeplessness", "sleep disorder", "difficulty sleeping", "sleep disturbance"],
    "sedative": ["hypnotic", "sleep aid", "calming", "tranquilizer"],
    "somnolence": ["drowsiness", "sleepiness", "excessive sleep"],
    "anxiety": ["nervousness", "worry", "anxiousness", "apprehension", "unease"],
    "depression": ["low mood", "depressed", "melancholy", "dysthymia", "depressive"],
    "stress": ["tension", "strain", "overwhelm", "distress"],
    "irritability": ["irritable", "irritable mood", "short temper"],
    "restlessness": ["agitation", "restless", "uneasy"],
    "indigestion": ["dyspepsia", "upset stomach", "gastric distress", "poor digestion"],
    "bloating": ["flatulence", "gas", "distension", "abdominal fullness", "bloat"],
    "constipation": ["irregularity", "obstipation", "difficulty defecating"],
    "diarrhea": ["loose stools", "dysentery", "loose bowels"],
    "nausea": ["sickness", "queasiness", "nauseous"],
    "heartburn": ["acid reflux", "gastric reflux", "pyrosis"],
    "vomiting": ["emesis", "throwing up", "retching"],
    "anorexia": ["poor appetite", "loss of appetite", "no appetite"],
    "cough": ["tussis", "hacking", "coughing"],
    "congestion": ["stuffiness", "blocked", "nasal congestion", "chest congestion"],
    "sore throat": ["pharyngitis", "throat pain", "throat ache"],
    "bronchitis": ["bronchial inflammation", "chest cold"],
    "asthma": ["wheezing", "asthmatic"],
    "rhinitis": ["runny nose", "nasal inflammation"],
    "hypertension": ["high blood pressure", "elevated bp"],
    "hypotension": ["low blood pressure"],
    "poor circulation": ["cold extremities", "poor blood flow"],
    "palpitations": ["irregular heartbeat", "heart racing"],
    "fatigue": ["tiredness", "exhaustion", "weariness", "lethargy", "tired"],
    "inflammation": ["inflammatory", "swelling", "redness", "inflamed"],
    "fever": ["pyrexia", "febrile", "high temperature", "fevers"],
    "weakness": ["debility", "asthenia", "lack of strength"],
    "malaise": ["general discomfort", "feeling unwell"],
    "itching": ["pruritus", "itchy", "pruritis"],
    "wound healing": ["wound care", "tissue repair", "healing wounds"],
    "eczema": ["dermatitis", "atopic dermatitis"],
    "acne": ["pimples", "zits", "breakouts"],
    "rash": ["skin eruption", "dermatitis"],
    "immune support": ["boost immunity", "immune boosting", "immunostimulant"],
    "infection": ["infectious", "bacterial", "viral"],
    "menopause": ["climacteric", "change of life", "menopausal"],
    "pms": ["premenstrual syndrome", "premenstrual"],
    "heavy periods": ["menorrhagia", "excessive bleeding"],
    "prostate": ["prostatic", "bph"],
    "uti": ["urinary tract infection", "cystitis", "bladder infection"],
    "diuretic": ["water pill", "increases urination"],
    "morning": ["am", "a.m.", "dawn"],
    "evening": ["pm", "p.m.", "night", "dusk"],
    "night": ["nocturnal", "nighttime", "while sleeping"],
    "cold": ["chilly", "frigid", "coldness"],
    "heat": ["hot", "warmth", "warm", "heated"],
    "motion": ["movement", "moving", "activity"],
    "rest": ["lying down", "reclining", "resting"],
}

# Keyword rules, first hit wins. Order is part of the meaning.
CATEGORY_RULES = {
    "sleep": ["insomnia", "sedative", "sleep", "somnolence"],
    "pain": ["pain", "headache", "migraine", "neuralgia", "myalgia", "arthralgia"],
    "mental": ["anxiety", "depression", "stress", "mood", "nervous"],
    "digestive": ["digest", "stomach", "nausea", "constipation", "diarrhea", "indigestion"],
    "respiratory": ["cough", "cold", "flu", "bronchitis", "asthma", "congestion"],
    "cardiovascular": ["heart", "blood pressure", "circulation", "hypertension"],
    "immune": ["immune", "infection", "antibacterial", "antiviral", "fever"],
    "skin": ["skin", "wound", "rash", "eczema", "acne", "itch"],
    "urinary": ["urinary", "kidney", "bladder", "diuretic"],
    "hormonal": ["hormone", "menstrual", "thyroid", "menopause"],
}
DOCUMENT_CATEGORY_RULES = {
    "pain": ["pain", "ache", "headache", "migraine", "neuralgia"],
    "digestive": ["digest", "stomach", "nausea", "constipation", "diarrhea"],
    "respiratory": ["cough", "cold", "flu", "breath", "lung", "sinus"],
    "sleep": ["sleep", "insomnia", "sedative", "calm"],
    "mental": ["anxiety", "depression", "stress", "mood", "nervous"],
    "skin": ["skin", "rash", "wound", "eczema", "acne"],
    "immune": ["immune", "infection", "antibacterial", "antiviral"],
    "cardiovascular": ["heart", "blood pressure", "circulation"],
    "hormonal": ["hormone", "menstrual", "thyroid", "adrenal"],
    "urinary": ["urinary", "kidney", "bladder", "diuretic"],
}
SEVERITY_RULES = {
    "absolute": ["absolute contraindication", "never use", "fatal", "death"],
    "severe": ["severe", "serious", "dangerous", "avoid", "do not use"],
    "moderate": ["caution", "careful", "moderate", "may cause"],
    "mild": ["mild", "minor", "slight", "rare"],
}
DOCUMENT_SEVERITY_RULES = {
    "absolute": ["absolute", "never", "fatal", "death"],
    "severe": ["severe", "serious", "dangerous", "avoid"],
    "moderate": ["moderate", "caution", "careful"],
}

# Patterns that lead in an indication, a contraindication or an interaction.
INDICATION_PATTERNS = [
    r"(?i)(?:used|employed|utilized)\s+(?:for|in|to)\s+([^\.\n]+)",
    r"(?i)indicated\s+(?:for|in)\s+([^\.\n]+)",
    r"(?i)helpful\s+(?:for|in)\s+([^\.\n]+)",
    r"(?i)treats?\s+([^\.\n]+)",
    r"(?i)beneficial\s+(?:for|in)\s+([^\.\n]+)",
    r"(?i)traditional(?:ly)?\s+(?:use|used|employed)\s*:?\s*([^\.\n]+)",
]
CONTRAINDICATION_PATTERNS = [
    r"(?i)\bcontraindicated\s+(?:in|for)\s+([^\.\n]+)",
    r"(?i)\bshould\s+not\s+be\s+(?:used|taken)\s+(?:by|in)\s+([^\.\n]+)",
    r"(?i)\bavoid\s+(?:in|during)\s+([^\.\n]+)",
    r"(?i)\bnot\s+recommended\s+(?:for|in)\s+([^\.\n]+)",
]
INTERACTION_PATTERNS = [
    r"(?i)\binteracts?\s+with\s+([^\.\n]+)",
    r"(?i)\bmay\s+(?:potentiate|interfere|interact)\s+([^\.\n]+)",
    r"(?i)\buse\s+caution\s+with\s+([^\.\n]+)",
]
BULLET_PATTERNS = [r"(?m)^[\s]*[-\*\+•‣]\s+(.+)$", r"(?m)^[\s]*\d+[\.\)]\s+(.+)$"]

# Spellings of an indication and its standard name, first hit wins.
NORMALIZATION_RULES = [
    (r"\b(insomnia|sleeplessness|difficulty\s+sleeping)\b", "insomnia"),
    (r"\b(sedative|sleep\s+aid|promotes\s+sleep)\b", "sedative"),
    (r"\b(headache|head\s+pain)\b", "headache"),
    (r"\b(migraine|migraines)\b", "migraine"),
    (r"\b(nerve\s+pain|neuralgia|neuropathic\s+pain)\b", "nerve pain"),
    (r"\b(muscle\s+pain|myalgia|muscular\s+pain)\b", "muscle pain"),
    (r"\b(joint\s+pain|arthralgia)\b", "joint pain"),
    (r"\b(inflammation|inflammatory)\b", "inflammation"),
    (r"\b(anxiety|anxious|nervousness)\b", "anxiety"),
    (r"\b(depression|depressed|low\s+mood)\b", "depression"),
    (r"\b(stress|stressed)\b", "stress"),
    (r"\b(irritability|irritable)\b", "irritability"),
    (r"\b(dyspepsia|indigestion|upset\s+stomach)\b", "indigestion"),
    (r"\b(nausea|nauseated)\b", "nausea"),
    (r"\b(constipation)\b", "constipation"),
    (r"\b(diarrhea|loose\s+stools)\b", "diarrhea"),
    (r"\b(bloating|flatulence|gas)\b", "flatulence"),
    (r"\b(heartburn|reflux|gerd)\b", "heartburn"),
    (r"\b(poor\s+appetite|anorexia)\b", "anorexia"),
    (r"\b(cough|coughing)\b", "cough"),
    (r"\b(congestion|congested)\b", "congestion"),
    (r"\b(sore\s+throat|pharyngitis)\b", "sore throat"),
    (r"\b(bronchitis)\b", "bronchitis"),
    (r"\b(asthma)\b", "asthma"),
    (r"\b(hypertension|high\s+blood\s+pressure)\b", "hypertension"),
    (r"\b(poor\s+circulation)\b", "poor circulation"),
    (r"\b(fatigue|tiredness|exhaustion)\b", "fatigue"),
    (r"\b(weakness|debility)\b", "weakness"),
    (r"\b(fever|febrile|pyrexia)\b", "fever"),
    (r"\b(immune\s+support|boosts?\s+immunity)\b", "immune support"),
    (r"\b(wound\s+healing|wounds)\b", "wound healing"),
    (r"\b(skin\s+rashes?|dermatitis|eczema)\b", "skin rash"),
    (r"\b(itching|pruritus)\b", "itching"),
]

# Evidence patterns, tried in order on lower-cased text.
EVIDENCE_PATTERNS = [
    ("systematic_review", r"\b(systematic review|meta-analysis|metaanalysis)\b"),
    ("clinical_trial", r"\b(randomized controlled trial|rct|clinical trial)\b"),
    ("clinical_trial", r"\bdouble-blind|placebo-controlled\b"),
    ("clinical_trial", r"\bin vivo\s+study\b"),
    ("clinical_observation", r"\b(clinical observation|case series|case report)\b"),
    ("clinical_observation", r"\bpractitioner experience\b"),
    ("clinical_observation", r"\bclinical practice\b"),
    ("traditional", r"\btraditional\s+(?:use|medicine|knowledge)\b"),
    ("traditional", r"\bfolk medicine|ethnobotanical|historical use\b"),
    ("in_vitro", r"\bin vitro\b"),
    ("in_vitro", r"\blaboratory study|cell culture\b"),
    ("in_vitro", r"\bmechanism of action\b"),
    ("ethnobotanical", r"\bethnobotanical|ethnopharmacological\b"),
    ("ethnobotanical", r"\bindigenous use|native use\b"),
]

# Binomial names.
BINOMIAL = r"\b([A-Z][a-z]+\s+[a-z]+)\b"
BINOMIAL_ABBREVIATED = r"\b([A-Z]\.\s+[a-z]+)\b"
BINOMIAL_VARIETY = r"\b([A-Z][a-z]+\s+[a-z]+(?:\s+(?:var\.|subsp\.)\s+[a-z]+))\b"
DOCUMENT_BINOMIAL = r"\b([A-Z][a-z]+\s+[a-z]+(?:\s+var\.\s+[a-z]+)?)\b"

# Section headings of monographs in Markdown, and words that mark an indication in plain text.
INDICATION_HEADERS = ["indications", "uses", "actions", "therapeutic uses", "clinical uses", "traditional uses"]
SAFETY_HEADERS = ["contraindications", "contra-indications", "precautions", "safety", "warnings", "cautions"]
INDICATION_MARKERS = ["used for", "indicated", "treats", "helpful for", "beneficial", "traditional use", "employed"]
