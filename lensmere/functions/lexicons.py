"""Word lists, patterns, thresholds and labels the operators work with.

Everything in this module is a fixed value: the terms, weights, patterns and
numbers must be exactly these for the results to be right.  Code that uses
them lives elsewhere.  Lists that deployments usually replace (stop words,
medical vocabulary, expert roster) are also accepted as parameters by the
operators, so a table can be passed instead.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Stop words
# ---------------------------------------------------------------------------

KEYWORD_QUERY_STOPWORDS = (
    "what whats what's is are was were be been being the a an of for to in on "
    "with and or how do does did can could would should i my me you your our "
    "when where which who whom that this these those about it its as at by from "
    "have has had will there their they them but not any some most more will "
    "if then than so such also into over under out up down between during"
).split()

EXPLANATION_STOPWORDS = (
    "a an and are as at be by for from has have he her hers him his i in is it its of "
    "on or our she that the their them they this to was were will with you your yours "
    "we us about into over under then than not no yes if else when while more most less "
    "few one two three can may should would could might just also only even very like "
    "such than so because due via per"
).split()

# Index stop words are a parameter of the lexical index.  The default is the
# keyword-query list above.
INDEX_STOPWORDS = KEYWORD_QUERY_STOPWORDS

# ---------------------------------------------------------------------------
# Symptom extraction
# ---------------------------------------------------------------------------

SYMPTOM_KEYWORDS = {
    "pain": [
        "pain", "ache", "aching", "sore", "soreness", "hurt", "hurting", "sharp pain",
        "dull pain", "throbbing", "burning", "stabbing", "cramping", "tender", "tenderness",
    ],
    "fever": [
        "fever", "febrile", "high temperature", "hot", "chills", "shivering", "sweating",
        "night sweats", "feverish",
    ],
    "respiratory": [
        "cough", "coughing", "shortness of breath", "difficulty breathing", "breathless",
        "wheezing", "chest tightness", "congestion", "stuffy nose", "runny nose",
        "sore throat", "hoarse",
    ],
    "gastrointestinal": [
        "nausea", "vomiting", "diarrhea", "constipation", "bloating", "stomach pain",
        "abdominal pain", "indigestion", "heartburn", "loss of appetite", "appetite loss",
    ],
    "neurological": [
        "headache", "dizziness", "dizzy", "confusion", "memory loss", "numbness", "tingling",
        "weakness", "fatigue", "tired", "exhausted",
    ],
    "cardiovascular": [
        "chest pain", "palpitations", "irregular heartbeat", "swelling", "edema",
        "leg swelling", "ankle swelling",
    ],
    "dermatological": [
        "rash", "itching", "itchy", "redness", "swelling", "bruising", "lesion", "wound",
        "cut", "burn",
    ],
}
SYMPTOM_CONFIDENCE = 0.8

DURATION_PATTERNS = [
    r"(\d+)\s+(days?|weeks?|months?|years?)",
    r"(for|since|about|approximately|around)\s+(\d+)\s+(days?|weeks?|months?|years?)",
    r"(past|last)\s+(\d+)\s+(days?|weeks?|months?|years?)",
    r"(\d+)\s+(hours?|minutes?)",
    r"(few|several|couple)\s+(days?|weeks?|months?)",
    r"(yesterday|today|this morning|last night|recently|lately)",
]

SEVERITY_KEYWORDS = {
    "mild": ["mild", "slight", "minor", "little", "small"],
    "moderate": ["moderate", "medium", "some", "noticeable"],
    "severe": [
        "severe", "intense", "extreme", "terrible", "awful", "unbearable", "excruciating",
        "very", "really", "extremely",
    ],
}
SEVERITY_CONFIDENCE = 0.7

# Ordered: the first group with a hit names the category.
NORMALIZE_RULES = [
    ("pain", ["pain", "ache", "hurt", "sore"]),
    ("fever", ["fever", "temperature", "chills"]),
    ("respiratory", ["cough", "breath", "wheez"]),
    ("gastrointestinal", ["nausea", "vomit", "diarrhea", "stomach"]),
]

# ---------------------------------------------------------------------------
# Emergency detection
# ---------------------------------------------------------------------------

EMERGENCY_KEYWORDS = {
    "cardiac": [
        "chest pain", "heart attack", "cardiac arrest", "palpitations", "irregular heartbeat",
        "heart pounding", "chest pressure", "crushing chest pain", "radiating pain",
        "left arm pain", "jaw pain", "myocardial infarction", "angina", "heart racing",
    ],
    "respiratory": [
        "difficulty breathing", "shortness of breath", "can't breathe", "wheezing", "gasping",
        "choking", "respiratory distress", "blue lips", "cyanosis", "oxygen", "ventilator",
        "intubation", "pulmonary embolism", "asthma attack", "pneumonia",
    ],
    "neurological": [
        "stroke", "seizure", "unconscious", "unresponsive", "paralysis", "severe headache",
        "confusion", "memory loss", "slurred speech", "face drooping", "arm weakness",
        "sudden numbness", "brain injury", "concussion", "meningitis", "encephalitis",
    ],
    "trauma": [
        "severe bleeding", "heavy bleeding", "major injury", "trauma", "broken bone",
        "head injury", "burns", "motorcycle accident", "car crash", "fall from height",
        "gunshot", "stab wound", "hemorrhage", "internal bleeding", "fracture",
        "spinal injury",
    ],
    "allergic": [
        "anaphylaxis", "severe allergic reaction", "swelling", "hives",
        "difficulty swallowing", "throat closing", "epinephrine", "epipen", "allergic shock",
        "food allergy", "drug allergy", "bee sting", "severe itching",
    ],
    "mental_health": [
        "suicide", "self harm", "want to die", "end it all", "kill myself",
        "suicidal thoughts", "overdose", "poison", "mental health crisis", "psychosis",
        "hallucinations",
    ],
    "metabolic": [
        "diabetic coma", "ketoacidosis", "severe hypoglycemia", "blood sugar", "insulin shock",
        "diabetic emergency", "severe dehydration", "electrolyte imbalance",
    ],
    "obstetric": [
        "severe pregnancy complications", "preeclampsia", "eclampsia", "pregnancy bleeding",
        "premature labor", "miscarriage", "ectopic pregnancy", "placental abruption",
    ],
}
EMERGENCY_WEIGHT_10 = [
    "cardiac arrest", "respiratory distress", "unconscious", "severe bleeding",
    "anaphylaxis", "stroke",
]
EMERGENCY_WEIGHT_7 = ["chest pain", "difficulty breathing", "seizure"]
EMERGENCY_WEIGHT_OTHER = 3
EMERGENCY_LEVELS = [(10, "CRITICAL"), (7, "HIGH"), (3, "MODERATE")]
NEGATIONS = ["no", "not", "denies", "denied", "without"]
NEGATION_WINDOW_CHARS = 10
NEGATION_WINDOW_TOKENS = 3

# The audit monitor uses a shorter emergency list.
AUDIT_EMERGENCY_KEYWORDS = {
    "cardiac": [
        "chest pain", "heart attack", "cardiac arrest", "palpitations",
        "irregular heartbeat", "heart pounding",
    ],
    "respiratory": [
        "difficulty breathing", "shortness of breath", "can't breathe", "wheezing",
        "gasping", "choking",
    ],
    "neurological": [
        "stroke", "seizure", "unconscious", "unresponsive", "paralysis", "severe headache",
        "confusion", "memory loss",
    ],
    "trauma": [
        "severe bleeding", "heavy bleeding", "major injury", "trauma", "broken bone",
        "head injury", "burns",
    ],
    "allergic": [
        "anaphylaxis", "severe allergic reaction", "swelling", "hives",
        "difficulty swallowing",
    ],
    "mental_health": [
        "suicide", "self harm", "want to die", "end it all", "kill myself",
        "suicidal thoughts",
    ],
}
SUSPICIOUS_INDICATORS = [
    "drug", "prescription", "dosage", "medication list", "diagnose me", "am i sick",
    "what do i have", "medical records", "test results",
]
SUSPICIOUS_THRESHOLD = 5
MIN_CONFIDENCE = 0.3
MAX_QUERIES_PER_SESSION = 50

# ---------------------------------------------------------------------------
# Specialties, query classes
# ---------------------------------------------------------------------------

SPECIALTIES = {
    "cardiology": ["heart", "cardiac", "cardio", "coronary", "artery", "blood pressure"],
    "pulmonology": ["lung", "respiratory", "breathing", "asthma", "copd", "pneumonia"],
    "neurology": ["brain", "neurological", "seizure", "stroke", "headache", "migraine"],
    "gastroenterology": ["stomach", "digestive", "intestinal", "liver", "pancreas", "bowel"],
    "endocrinology": ["diabetes", "thyroid", "hormone", "insulin", "glucose", "endocrine"],
    "infectious_disease": [
        "infection", "virus", "bacteria", "antibiotic", "fever", "sepsis",
    ],
    "oncology": ["cancer", "tumor", "malignant", "chemotherapy", "radiation", "oncology"],
    "orthopedics": ["bone", "joint", "fracture", "orthopedic", "muscle", "ligament"],
    "dermatology": ["skin", "rash", "dermatitis", "eczema", "psoriasis", "melanoma"],
    "psychiatry": [
        "mental", "psychiatric", "depression", "anxiety", "bipolar", "schizophrenia",
    ],
}

DRUG_INTERACTION_FLAGS = [
    "warfarin", "coumadin", "blood thinner", "anticoagulant", "lithium", "digoxin",
    "phenytoin", "carbamazepine", "monoamine oxidase inhibitor", "maoi", "ssri",
    "antidepressant", "multiple medications", "drug interaction", "pharmacy check",
]

QUERY_TYPE_RULES = [
    ("medical_information", ["what is", "what are", "define", "explain"]),
    ("treatment_planning", ["treat", "treatment", "therapy", "medicine", "medication"]),
    ("differential_diagnosis", ["diagnose", "diagnosis", "what do i have", "what's wrong"]),
    ("drug_information", ["drug", "medication", "pill", "dose", "side effect"]),
    ("differential_diagnosis", [
        "cause", "causes", "etiology", "risk factor", "risk factors",
    ]),
]

INTENT_RULES = [
    ("medication", ["medicine", "drug", "dose", "prescribe", "tablet"]),
    ("symptom", ["symptom", "pain", "fever", "what could be", "cause of"]),
    ("reasoning", ["explain", "why", "how does"]),
]

COMPLEXITY_GREETING = (
    r"hi|hiya|hello|hey|yo|thanks|thank\s+you|bye|goodbye|good\s+(?:morning|afternoon|evening|night)"
)
COMPLEXITY_FACT_PREFIXES = ["what is", "define", "meaning of"]
COMPLEXITY_RULES = [
    ("explanation", ["how does", "how do", "explain", "why", "what causes"]),
    ("comparison", ["difference between", "compare", "versus", "vs", "better than"]),
    ("differential_diagnosis", [
        "i have", "i feel", "experiencing", "symptoms", "suffering from",
    ]),
    ("treatment_planning", [
        "how to treat", "treatment for", "cure for", "manage", "therapy",
    ]),
]
COMPLEXITY_MULTIPART = ["and", "also", "additionally", "furthermore"]

TOKEN_BASE = {
    "greeting": 30,
    "simple_fact": 80,
    "explanation": 150,
    "comparison": 200,
    "differential_diagnosis": 250,
    "treatment_planning": 300,
    "complex_medical": 400,
}
TOKEN_BASE_DEFAULT = 120
TOKEN_LENGTH_STEPS = [(5, 0.5), (10, 0.8), (20, 1.0), (40, 1.3)]
TOKEN_LENGTH_LONG = 1.5
TOKEN_CONTEXT_STEP = (500, 1.2)
TOKEN_MIN, TOKEN_MAX = 30, 500

SHORT_QUERY_MEDICAL_WORDS = [
    "pain", "fever", "cough", "dose", "medication", "diagnosis", "symptom", "rash",
    "bleeding", "breath", "chest", "headache", "nausea", "vomit", "diarrhea",
]
SMALLTALK_PATTERN = (
    r"^(?:hi|hello|hey|yo|how\s+are\s+you\??|good\s+(?:morning|afternoon|evening)|what's\s+up\??|sup\??)$"
)
IDENTITY_PHRASES = [
    "who are you", "what are you", "explain yourself", "about yourself", "about you",
]
HEALTHCARE_TERMS = [
    "pain", "fever", "cough", "dose", "medication", "medicine", "drug", "diagnosis",
    "symptom", "rash", "bleeding", "breath", "chest", "headache", "nausea", "vomit",
    "diarrhea", "clinic", "doctor", "hospital", "injury", "infection", "blood", "pressure",
    "glucose", "heart", "lung", "kidney", "liver", "thyroid", "anxiety", "depression",
    "sleep", "nutrition", "diet", "exercise", "vaccine", "allergy", "side effect",
    "contraindication", "therapy", "treatment",
]
NON_HEALTHCARE_MARKERS = [
    "code", "program", "compile", "deploy", "finance", "stock", "crypto", "tax", "legal",
    "contract", "movie", "music", "recipe", "travel", "hotel", "flight", "game", "sports",
    "weather", "news", "politics", "math", "physics", "chemistry",
]
SOURCE_REQUEST_PHRASES = [
    "show sources", "where is this from", "cite this", "references", "source list",
]
TONE_PLAYFUL = ["what's up", "whats up", "sup", "wassup", "yo"]
TONE_FRIENDLY = [
    "hi there", "hello there", "good morning", "good afternoon", "good evening",
]
TONE_TIRED = [
    "...", "…", "ugh", "sigh", "not great", "meh", "tired", "exhausted", "drained", "rough",
]

DISCLAIMER_BASE = (
    "This information is provided for educational purposes only and does not constitute "
    "medical advice."
)
DISCLAIMERS = {
    "differential_diagnosis": (
        " Only a qualified healthcare provider can provide an accurate diagnosis after "
        "proper medical evaluation."
    ),
    "treatment_planning": (
        " Treatment decisions should always be made in consultation with qualified "
        "healthcare professionals who can assess your individual medical situation."
    ),
    "drug_information": (
        " Medication information should be verified with healthcare providers and "
        "pharmacists. Never start or stop medications without professional guidance."
    ),
    "cardio_neuro": (
        " Cardiovascular and neurological conditions require specialized medical "
        "evaluation and care. Please consult appropriate specialists."
    ),
    "default": (
        " Always consult qualified healthcare professionals for medical decisions, "
        "diagnosis, and treatment planning."
    ),
}

# ---------------------------------------------------------------------------
# Scope gate.  {name} stands for the assistant's name, which is
# a parameter.
# ---------------------------------------------------------------------------

GREETING_PATTERN = (
    r"(?:hi|hiya|hello|helo|hey+|yo|sup|what'?s\s+up|wassup|howdy|namaste|hola|greetings|"
    r"good\s+(?:morning|afternoon|evening|day))"
    r"(?:[\s,!.]*(?:{name}|there|doc|doctor|buddy|man|again))?[\s!.?]*"
)
HOW_ARE_YOU_PATTERN = (
    r"(?:(?:hi|hello|hey)[\s,!.]*)?"
    r"(?:how\s+are\s+you(?:\s+doing|\s+today)?|how'?s\s+it\s+going|how\s+do\s+you\s+do|you\s+ok|you\s+good)"
    r"[\s!.?]*"
)
THANKS_PATTERN = (
    r"(?:ok(?:ay)?[\s,!.]*)?(?:many\s+)?(?:thanks|thank\s+you|thankyou|thx|ty|tysm|thanks\s+a\s+lot|"
    r"thank\s+you\s+so\s+much|appreciate\s+it|appreciated)"
    r"(?:[\s,!.]*(?:{name}|doc|doctor|so\s+much|a\s+lot))?[\s!.?]*"
)
FAREWELL_PATTERN = (
    r"(?:ok(?:ay)?[\s,!.]*)?(?:bye+|goodbye|good\s+night|goodnight|see\s+you(?:\s+later)?|see\s+ya|"
    r"take\s+care|catch\s+you\s+later|gtg|gotta\s+go|talk\s+later)"
    r"(?:[\s,!.]*(?:{name}|doc|doctor))?[\s!.?]*"
)
# Branches that must end at a word end are listed apart from those that need not.
IDENTITY_PATTERN = (
    r"who\s+is\s+{name}|what\s+is\s+{name}|introduce\s+yourself|tell\s+me\s+about\s+yourself|"
    r"describe\s+yourself|what\s+can\s+(?:you|u)\s+do|what\s+do\s+(?:you|u)\s+do|what'?s\s+your\s+name|"
    r"are\s+you\s+(?:a\s+)?(?:bot|ai|robot|human|doctor)"
)
IDENTITY_PATTERN_WORD_END = r"(?:who|what)\s+(?:are|r)\s+(?:you|u)|your\s+name"

# (reason, words before, longest gap, words after); without a gap the first
# entry alone decides.
OUT_OF_SCOPE_RULES = [
    ("programming",
     r"python|javascript|typescript|java|c\+\+|c#|rust|golang|html|css|sql|regex|"
     r"code|coding|program|programming|debug|compile|deploy|api|algorithm|function|script|"
     r"software|frontend|backend|database|server|website|web\s*app|machine\s+learning|neural\s+network",
     None, None),
    ("writing",
     r"write|compose|draft|generate|make", 40,
     r"essay|poem|poetry|story|song|lyrics|"
     r"email|letter|blog|article|tweet|caption|resume|cover\s+letter|speech|script"),
    ("jokes", r"(?:tell|crack)\s+(?:me\s+)?a\s+joke|riddle|rap\s+battle", None, None),
    ("equations",
     r"solve|calculate|evaluate", 30, r"equation|integral|derivative|theorem|expression"),
    ("homework", r"homework|assignment", None, None),
    ("trivia",
     r"capital\s+of|president\s+of|prime\s+minister|population\s+of|currency\s+of|"
     r"who\s+invented|who\s+discovered|who\s+founded|world\s+war|in\s+what\s+year",
     None, None),
    ("entertainment",
     r"movie|movies|film|films|netflix|song|songs|album|singer|actor|actress|celebrity|"
     r"tv\s+show|series|anime|manga|kpop|bollywood|hollywood|concert|playlist",
     None, None),
    ("sports",
     r"football|soccer|cricket|basketball|baseball|tennis|hockey|ipl|fifa|nba|nfl|ufc|"
     r"olympics|premier\s+league|world\s+cup|tournament|championship",
     None, None),
    ("finance",
     r"stock|stocks|share\s+market|crypto|bitcoin|ethereum|nft|invest|investing|investment|"
     r"trading|forex|mutual\s+fund|tax|taxes|loan|mortgage|salary|paycheck|budget(?:ing)?",
     None, None),
    ("politics",
     r"election|politics|political|parliament|congress|senate|geopolit|war\s+in", None, None),
    ("travel",
     r"flight|flights|hotel|hotels|visa|itinerary|tourist|vacation|sightseeing|"
     r"travel\s+to|trip\s+to|weather|forecast",
     None, None),
    ("gadgets",
     r"video\s+game|gaming|minecraft|fortnite|valorant|gta|playstation|xbox|"
     r"gpu|graphics\s+card|iphone|smartphone|laptop|which\s+phone|car\s+to\s+buy|bike\s+to\s+buy",
     None, None),
    ("cooking", r"recipe|how\s+to\s+(?:cook|bake)|restaurant", None, None),
]
# Rules whose words need not end where they match.
OPEN_ENDED_RULES = ("trivia",)
# Trivia also covers "history of X" unless X is one of the medical topics.
HISTORY_PATTERN = r"history\s+of\s+"
HISTORY_MEDICAL_TOPICS = r"medicine|disease|illness"

CONTINUATION_PATTERN = (
    r"and|also|but|so|what\s+about|how\s+about|why|how|when|where|which|what|can|could|should|"
    r"would|does|do|did|is|are|was|it|that|this|they|he|she|my|ok|okay|yes|yeah|no|nope|sure|"
    r"more|explain|elaborate|continue|go\s+on|tell\s+me\s+more"
)
MEDICAL_ANCHORS = [
    "symptoms, causes and treatment of a medical condition",
    "pain, fever, cough, fatigue, nausea and other body symptoms",
    "medication dosage, side effects and drug interactions",
    "anatomy, organs and how the human body works",
    "mental health, stress, anxiety, sleep and mood",
    "diet, nutrition, exercise and a healthy lifestyle",
    "lab tests, scans, diagnosis and clinical care",
    "injury, wound healing, recovery and rehabilitation",
]
OTHER_ANCHORS = [
    "writing computer code, software programming and debugging",
    "movies, music, celebrities and entertainment",
    "sports teams, matches, scores and tournaments",
    "politics, elections, government and current news",
    "money, investing, stocks, crypto, banking and taxes",
    "travel destinations, flights, hotels and vacation planning",
    "cooking recipes and restaurant recommendations",
    "history, geography, trivia and general knowledge facts",
    "school homework, mathematics, physics and essay writing",
    "video games, gadgets, cars and online shopping",
]
ANCHOR_MARGIN = 0.05
ANCHOR_MEDICAL_CEILING = 0.45

# ---------------------------------------------------------------------------
# Specialist roster (name, lens, prototype, keywords, modality, default)
# ---------------------------------------------------------------------------

EXPERTS = [
    ("Cardiology",
     "cardiac and cardiovascular causes and management of: {q}",
     "heart chest pain pressure palpitations arrhythmia blood pressure cardiovascular "
     "circulation angina",
     ["heart", "chest pain", "palpitation", "blood pressure", "pulse", "cardiac"], None, False),
    ("Pulmonology",
     "respiratory, lung and breathing aspects of: {q}",
     "lungs breathing shortness of breath cough wheeze pneumonia asthma chest x-ray "
     "respiratory oxygen",
     ["breath", "cough", "lung", "wheeze", "chest x-ray", "pneumonia", "asthma"],
     "chest_xray", False),
    ("Neurology",
     "neurological causes and patterns of: {q}",
     "headache migraine dizziness numbness tingling seizure nerve brain vertigo cognition",
     ["headache", "migraine", "dizz", "numb", "tingl", "seizure", "vertigo"], None, False),
    ("Dermatology",
     "skin, lesion and dermatological aspects of: {q}",
     "skin rash lesion mole itch acne eczema dermatitis pigmentation dermatoscopic",
     ["skin", "rash", "lesion", "mole", "itch", "acne", "eczema"], "skin", False),
    ("Gastroenterology",
     "digestive and gastrointestinal aspects of: {q}",
     "stomach nausea acid reflux bowel diarrhea constipation abdominal digestion gut",
     ["stomach", "nausea", "acid", "reflux", "bowel", "abdomen", "diarrhea"], None, False),
    ("Musculoskeletal",
     "musculoskeletal, orthopedic and mechanical-pain causes and management of: {q}",
     "back pain neck pain joint muscle bone spine posture arthritis sprain strain stiffness "
     "sciatica shoulder knee hip tendon ligament mobility ergonomics",
     ["back pain", "neck pain", "joint", "muscle", "bone", "spine", "posture", "arthritis",
      "sprain", "sciatica", "shoulder", "knee", "hip", "stiff", "lower back"], None, False),
    ("Pharmacology",
     "medication, dosing, side effects and interactions for: {q}",
     "medication drug dose side effect interaction contraindication prescription pharmacology",
     ["drug", "medication", "dose", "side effect", "interaction", "pill", "tablet"],
     None, False),
    ("Psychophysiology",
     "nervous-system, stress and mind-body aspects of: {q}",
     "stress anxiety sleep fatigue panic nervous system vagal sympathetic cortisol mood mind "
     "body",
     ["stress", "anxiety", "sleep", "fatigue", "panic", "burnout", "mood"], None, False),
    ("General Internal Medicine",
     "{q}",
     "general health symptoms wellness primary care evaluation",
     [], None, True),
]
GATE_TOP_K = 2
GATE_TEMPERATURE = 0.35
GATE_KEYWORD_BOOST = 0.18
GATE_MODALITY_BOOST = 0.45
GATE_FLOOR = 0.12
GATE_EMPTY_QUERY = "general health question"
DIRECTIVE_HEAD = "Specialist perspectives to integrate, by relevance: "
DIRECTIVE_TAIL = (
    ". Reason from these angles and merge them into one calm, unified explanation in your "
    "own voice. Do not name the specialties, address a panel, or mention routing."
)

# ---------------------------------------------------------------------------
# Explanation, evidence, conversation, cleanup
# ---------------------------------------------------------------------------

REASONING_MARKERS = [
    "likely", "consider", "recommend", "because", "suggest", "red flag", "warning",
    "follow-up",
]
COUNTERFACTUAL_FEVER = (
    "If the fever persisted beyond 72 hours or exceeded 39.5°C (103.1°F), escalation to "
    "in-person evaluation would be indicated."
)
COUNTERFACTUAL_CHEST = (
    "If chest pain were associated with shortness of breath or exertion, the risk profile "
    "would increase and urgent assessment would be recommended."
)
COUNTERFACTUAL_BREATH = (
    "If shortness of breath worsened when lying flat or was associated with leg swelling, "
    "cardiac causes would move higher on the differential."
)
COUNTERFACTUAL_GENERIC = (
    "If new red-flag symptoms (e.g., fainting, severe headache, neurological deficits) "
    "appeared, the recommended action would shift to urgent/emergency care."
)
CONDITION_CUE_PATTERN = r"(?i)(?:likely|possible|consider)\s+([a-zA-Z][a-zA-Z\s\-]{2,30})"
CONDITION_PHRASE_PATTERN = r"([A-Z][a-z]+\s(?:[A-Z][a-z]+|[a-z]+){0,2})"
TREATMENT_NAME_PATTERN = r"([A-Z][a-z]{2,}(?:\s[A-Z][a-z]{2,})?)"

FILLER_CLOSERS = [
    "please share more detail", "please provide more detail", "if you have any concern",
    "if you have any question", "if you have any other", "feel free to", "let me know if",
    "so i can help you understand", "so we can discuss this further", "i'm here to help",
    "i am here to help", "happy to help",
]
USER_LABEL = "The user said"
ASSISTANT_LABEL = "You already replied"

SECTION_ASSESSMENT = ["assessment", "diagnosis", "clinical impression"]
SECTION_RECOMMENDATION = ["recommend", "treatment", "management", "therapy"]
SECTION_RECOMMENDATION_HEADS = ["recommend", "treatment", "management"]
SECTION_EDUCATION = ["education", "patient should", "important to"]
SECTION_WARNING = ["warning", "red flag", "seek immediate", "emergency"]

FINDING_LABELS = {
    "Effusion": "Pleural effusion",
    "Lung Opacity": "Lung opacity",
    "Lung Lesion": "Lung lesion",
    "Pleural_Thickening": "Pleural thickening",
    "Enlarged Cardiomediastinum": "Enlarged cardiomediastinum",
}

DRAFT_CHECKS = ["allergy", "interactions", "pregnancy", "renal"]

TUNING_SYSTEM = (
    "You are a clinical assistant. Use a professional medical tone, evidence-based and "
    "conservative language. Respond ONLY in JSON with keys: answer (string), confidence (one "
    "of: low, medium, high), citations (array of objects with fields: source, category, file, "
    "url)."
)
TUNING_INSTRUCTION = (
    "Answer the medical question strictly in the required JSON format. If the provided "
    "context is insufficient, set confidence='low' and keep citations empty."
)

# ---------------------------------------------------------------------------
# Patterns and keys for tidying replies
# ---------------------------------------------------------------------------

REPLY_KEYS = ["medical_assessment", "answer", "response", "summary"]
REPLY_KEYS_LONG = REPLY_KEYS + ["condition_summary", "diagnosis"]
REPLY_FIELD = r'(?i)^"?(?:medical_assessment|answer|response)"?\s*:\s*"?'
REPLY_HEADER = r"(?i)^(?:Response:|Answer:|Medical Assessment:)\s*"
HEAVY_FIELD = r'^"?medical_assessment"?:\s*"?'
HEAVY_ANY_FIELD = r'^"?[a-z_]+"?:\s*"?'
HEAVY_HEADER = r"(?i)^(?:Return structured JSON response:|Response:|Answer:|Medical Assessment:)\s*"
CODE_BLOCK = "```[^`]*```"
BOLD = r"\*\*([^\n]*?)\*\*"
ITALIC = r"\*([^\n]*?)\*"
REPEATED_PHRASE = r"(?i)(\b\w+(?:\s+\w+){0,3})\s*(?:\1\s*){2,}"
HYPOTHETICAL_LABELS = r"(?i)\b(specific|broad)\s*:\s*"
PROMPT_ECHO = r'(?is)^.*?\basks?\s*:\s*"[^"]*"\s*[.,:;-]*'
OPENING_FILLER = r"(?i)^\s*(specifically|in general)[,:]?\s*"


def flatten(lexicon: dict) -> list:
    """(category, term) pairs in the order the lexicon states them."""
    return [(category, term) for category, terms in lexicon.items() for term in terms]


def emergency_weight(term: str) -> int:
    if term in EMERGENCY_WEIGHT_10:
        return 10
    if term in EMERGENCY_WEIGHT_7:
        return 7
    return EMERGENCY_WEIGHT_OTHER
