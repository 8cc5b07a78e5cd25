"""Word lists, lookup tables and constants that results depend on.

FIXED VALUES. Everything in this module must equal the behaviour being
reproduced: keyword lists, labels, weights, thresholds and text templates.
They are stated here once, as plain data, and every operator (and the SQL
oracle) derives its expressions from them.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Transliteration used by text normalization, derived by rule: every character
# whose NFKD form has an ASCII part stands for that part (accented, full-width,
# mathematical and circled letters and digits, superscripts, fractions,
# ligatures, wide blanks, ...), with no upper code limit.
def _foldable() -> tuple[dict[str, str], dict[str, str]]:
    import sys
    import unicodedata

    single, several = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if unicodedata.decomposition(ch):
            base = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode("ascii")
            if base:
                (single if len(base) == 1 else several)[ch] = base
    return single, several


FOLD, FOLD_SEVERAL = _foldable()
# Combining marks: a decomposed accent disappears with them.
MARKS = r"\p{M}+"
# Letters with no NFKD decomposition; the "main" normalizer transliterates
# them, the "scored" normalizer deletes them.
TRANSLIT_EXTRA = (
    ("ß", "ss"),
    ("æ", "ae"),
    ("œ", "oe"),
    ("ø", "o"),
    ("đ", "d"),
    ("ð", "d"),
    ("ł", "l"),
    ("þ", "th"),
)

# --------------------------------------------------------------------------
# FIXED VALUES: CTAS level labels (1-5).
CTAS_LABELS = {
    1: "Resuscitation",
    2: "Emergent",
    3: "Urgent",
    4: "Less Urgent",
    5: "Non-Urgent",
}

# --------------------------------------------------------------------------
# FIXED VALUES: "main" triage rules.
MAIN_RED_FLAG_GROUPS = {
    "chest_pain": ["chest pain", "douleur thoracique"],
    "severe_difficulty_breathing": ["difficulty breathing", "shortness of breath", "difficulte respiratoire", "essoufflement severe"],
    "stroke_symptoms": ["stroke", "avc", "face drooping", "slurred speech"],
    "seizure": ["seizure", "convulsion"],
    "loss_of_consciousness": ["loss of consciousness", "unconscious", "perte de conscience"],
    "severe_bleeding": ["severe bleeding", "heavy bleeding", "saignement important"],
    "suicidal_ideation": ["suicidal", "want to die", "suicidaire"],
    "anaphylaxis_signs": ["anaphylaxis", "throat swelling", "anaphylaxie"],
    "severe_allergic_reaction": ["severe allergic reaction", "reaction allergique"],
    "cyanosis": ["blue lips", "cyanosis", "cyanose"],
    "major_trauma": ["major trauma", "car crash", "traumatisme majeur"],
    "unresponsive_child": ["unresponsive child", "child not responding", "enfant inconscient"],
    "high_risk_infant_symptoms": ["infant fever", "fever under 3 months", "nourrisson"],
}
MAIN_CATEGORIES = {
    "respiratory": ["cough", "fever", "breathing", "respiratoire", "dyspnea", "asthma"],
    "gastrointestinal": ["vomit", "vomiting", "nausea", "stomach", "abdominal", "diarrhea", "vomissements"],
    "musculoskeletal": ["sprain", "ankle", "back pain", "muscle", "joint", "entorse"],
    "neurological": ["headache", "migraine", "dizziness", "vertigo", "neurologique"],
    "dermatology": ["rash", "itch", "skin", "cut", "eczema", "eruption"],
    "mental_health": ["anxiety", "panic", "depression", "mental", "anxiete"],
}
MAIN_SEVERITY_TERMS = ["severe", "worst", "cannot", "unable", "severe pain", "mild", "minor", "slight"]
MAIN_PAIN_WORDS = ["pain", "douleur"]
MAIN_FRENCH_MARKERS = ["bonjour", "douleur", "depuis", "respiratoire", "urgence", "nourrisson", "je"]
MAIN_LEVEL1_FLAGS = ["loss_of_consciousness", "anaphylaxis_signs", "major_trauma"]
MAIN_LEVEL3_SEVERITY = ["severe", "worst", "cannot", "unable"]
MAIN_YOUNG_AGE_GROUPS = ["infant", "child"]
MAIN_YOUNG_LEVEL3_WORDS = ["fever", "rash"]
MAIN_LEVEL3_CATEGORIES = ["respiratory", "neurological", "mental_health"]
MAIN_LEVEL4_CATEGORIES = ["gastrointestinal", "musculoskeletal", "dermatology"]
MAIN_DEFAULT_CATEGORY = "general"
MAIN_STOP_SUMMARY = "Emergency red flags detected. Route to emergency services immediately."
MAIN_LEVEL_SUMMARY = "Provisional CTAS {level} estimated conservatively from symptom text and severity markers."
MAIN_PRIMARY_MAX_CHARS = 80
# duration units: (substrings, hours multiplier); None multiplier means divide by 60
MAIN_DURATION_UNITS = [
    (["day", "jour"], 24.0),
    (["week", "semaine"], 24.0 * 7),
    (["hour", "heure"], 1.0),
    (["minute", "min"], None),
]

# --------------------------------------------------------------------------
# FIXED VALUES: "scored" (sidecar) triage rules.
SCORED_LANGUAGE_HINTS_FR = [
    "depuis", "douleur", "fievre", "essoufflement", "gorge", "cheville", "enfant", "nourrisson", "respirer",
    "heure", "jours", "naus", "avec", "apres", "situation", "semble", "moment", "gonflement",
]
SCORED_LANGUAGE_HINTS_EN = [
    "since", "pain", "fever", "ankle", "throat", "breathing", "hours", "days", "swelling", "child", "infant",
    "with", "after", "stable", "patient", "worse", "today",
]
SCORED_AGE_GROUP_ALIASES = {
    "baby": "infant",
    "bebe": "infant",
    "bébé": "infant",
    "infant": "infant",
    "nourrisson": "infant",
    "child": "child",
    "kid": "child",
    "enfant": "child",
    "adult": "adult",
    "adulte": "adult",
    "older adult": "older_adult",
    "older_adult": "older_adult",
    "senior": "older_adult",
    "aine": "older_adult",
    "aîné": "older_adult",
}
SCORED_CATEGORY_KEYWORDS = {
    "respiratory": ["breath", "breathing", "wheeze", "cough", "respir", "essoufflement", "asthma"],
    "cardiac": ["chest pain", "chest tightness", "thorac", "palpitation", "heart"],
    "neurological": ["stroke", "slurred speech", "weakness", "numb", "headache", "migraine", "seizure", "avc", "engour", "confusion"],
    "digestive": ["abdominal", "stomach", "vomit", "nausea", "diarrhea", "abdomen", "naus", "vom", "diarrh"],
    "infection": ["fever", "ear pain", "sore throat", "throat", "feverish", "fievre", "gorge", "infection", "urinary"],
    "injury": ["ankle", "cut", "bleeding", "fall", "wrist", "sprain", "injury", "cheville", "entorse", "coupure", "blessure"],
    "immune": ["allergic", "allergy", "rash", "hives", "anaphyl", "allerg", "eruption", "urticaire"],
}
SCORED_DEFAULT_CATEGORY = "other"
SCORED_PRIMARY_SYMPTOM_PATTERNS = [
    "chest pain", "shortness of breath", "stroke-like symptoms", "severe bleeding", "allergic reaction",
    "abdominal pain", "headache", "ear pain", "sore throat", "twisted ankle", "minor cut", "rash", "fever",
    "vomiting", "back pain", "wrist pain", "wheezing",
]
SCORED_PRIMARY_TOKENS = 4
SCORED_PRIMARY_FALLBACK = "unspecified symptom"
SCORED_SEVERITY_PATTERNS = {
    "severe pain": ["severe pain", "douleur severe", "douleur intense"],
    "impaired function": ["cannot walk", "unable to walk", "incapable de marcher", "cannot use arm", "trouble speaking"],
    "worsening": ["worsening", "getting worse", "empire", "aggrave", "worse today"],
    "moderate pain": ["swelling", "gonflement", "moderate pain", "fever", "fievre", "painful", "tender"],
}
SCORED_EMERGENCY_FLAGS = {
    "chest pain": ["chest pain", "douleur thoracique"],
    "severe difficulty breathing": ["severe difficulty breathing", "cannot breathe", "hard to breathe", "difficulte respiratoire severe", "n arrive pas a respirer"],
    "stroke symptoms": ["stroke symptoms", "stroke like", "numb face", "slurred speech", "face droop", "symptomes d avc", "engourdissement du visage", "difficulte a parler", "visage affaisse"],
    "seizure": ["seizure", "convulsion", "active seizure"],
    "loss of consciousness": ["loss of consciousness", "fainted and unresponsive", "perte de conscience", "inconscient"],
    "severe bleeding": ["severe bleeding", "heavy bleeding", "saignement severe"],
    "suicidal ideation": ["suicidal ideation", "want to die", "ideation suicidaire"],
    "anaphylaxis": ["anaphylaxis", "anaphylaxie"],
    "severe allergic reaction": ["severe allergic reaction", "lip swelling", "tongue swelling", "reaction allergique severe", "gonflement des levres"],
    "cyanosis": ["cyanosis", "cyanose", "blue lips", "lips turning blue", "levres bleues"],
    "major trauma": ["major trauma", "traumatisme majeur", "high speed crash"],
    "unresponsive child": ["unresponsive child", "enfant inconscient"],
    "high-risk infant symptoms": ["high risk infant symptoms", "infant fever", "poor feeding", "hard to wake", "symptomes a haut risque chez le nourrisson", "fievre chez le nourrisson", "difficile a reveiller"],
}
SCORED_INFANT_FLAG = "high-risk infant symptoms"
SCORED_INFANT_FLAG_WORDS = ["fever", "fievre", "hard to wake", "difficile a reveiller"]
SCORED_SERIOUS_MARKERS = ["shortness of breath", "essoufflement", "cannot walk", "incapable de marcher", "worsening swelling", "confusion"]
SCORED_MILD_MARKERS = ["worsening", "getting worse", "empire", "aggrave", "persistent fever", "fievre persistante"]
SCORED_RESUSCITATION_FLAGS = ["loss of consciousness", "cyanosis", "unresponsive child"]
SCORED_EMERGENT_FLAGS = [
    "chest pain", "severe difficulty breathing", "stroke symptoms", "seizure", "severe bleeding",
    "suicidal ideation", "anaphylaxis", "severe allergic reaction", "major trauma", "high-risk infant symptoms",
]
SCORED_HOSPITAL_CATEGORIES = ["cardiac", "neurological", "respiratory"]
SCORED_INFANT_LEVEL3_CATEGORIES = ["respiratory", "infection"]
SCORED_LOW_CATEGORIES = ["digestive", "infection", "injury", "immune"]
# duration regexes (hours, days, weeks), tried in this order on normalized text
SCORED_DURATION_PATTERNS = [
    (r"(\d+)\s*(hour|hours|hr|hrs|heure|heures|h)\b", 1),
    (r"(\d+)\s*(day|days|jour|jours)\b", 24),
    (r"(\d+)\s*(week|weeks|semaine|semaines)\b", 24 * 7),
]
SCORED_DURATION_PHRASES = [
    (["since yesterday", "depuis hier"], 24),
    (["today", "aujourd hui"], 6),
]
CTAS_COMPONENT = {1: 100, 2: 85, 3: 60, 4: 30, 5: 10}
VULNERABILITY_COMPONENT = {"adult": 0, "child": 10, "infant": 20, "older_adult": 15, "unknown": 5}
VULNERABILITY_DEFAULT = 5
RISK_WEIGHTS = (0.45, 0.30, 0.10, 0.10, 0.05)  # ctas, red flag, vulnerability, severity, duration
RISK_BANDS = ((75, "critical"), (50, "high"), (25, "moderate"))
RISK_BAND_DEFAULT = "low"
LEVEL2_RISK_FLOOR = 85
DISCLAIMER = "AI-estimated provisional CTAS urgency for routing support only. Final triage is determined by clinical staff."
REASON_PRIMARY = "Primary symptom: {primary}."
REASON_LEVEL = "Provisional CTAS {level} ({label})."
REASON_FLAGS = "Emergency flags detected: {flags}."
REASON_RISK = "Risk band is {band}, so lower-acuity routing is limited."
REASON_NONE = "No hard emergency flags detected in the current description."
EXPECTED_KEYS = (
    "language", "patient_age_group", "primary_symptom", "symptom_category", "duration_hours",
    "severity_indicators", "emergency_flags", "emergency_stop", "provisional_ctas_level",
    "provisional_ctas_label", "recommended_facility_type", "recommended_urgency_band", "queue_eligible",
    "risk_score", "risk_band", "reasoning_summary",
)
OUTPUT_ENUMS = {
    "language": ["en", "fr", "unknown"],
    "patient_age_group": ["infant", "child", "adult", "older_adult", "unknown"],
    "symptom_category": ["infection", "injury", "respiratory", "cardiac", "neurological", "digestive", "immune", "other"],
    "provisional_ctas_label": ["Resuscitation", "Emergent", "Urgent", "Less Urgent", "Non-Urgent"],
    "recommended_facility_type": ["hospital", "ambulatory", "unknown"],
    "recommended_urgency_band": ["emergency", "same_day", "low_acuity", "unknown"],
    "risk_band": ["low", "moderate", "high", "critical"],
}

# --------------------------------------------------------------------------
# FIXED VALUES: reference tables (rules and keyword tables).
MAIN_RULES_ROWS = [
    (1, "Resuscitation", "Hard stop. Direct user to immediate emergency services and do not permit queue enrollment.", "Call emergency services or go to the nearest emergency department immediately.", False, "hospital"),
    (2, "Emergent", "Hard stop. Direct user to emergency services and do not permit queue enrollment.", "Immediate emergency assessment is required. Do not use the virtual queue.", False, "hospital"),
    (3, "Urgent", "Allow hospital routing only. Do not offer ambulatory recommendations or virtual non-emergency queue.", "Urgent hospital assessment is recommended as soon as possible.", False, "hospital"),
    (4, "Less Urgent", "Allow hospital and ambulatory routing when clinically appropriate. Virtual queue allowed.", "Non-emergency routing support only. Final triage remains clinical.", True, "hospital_or_ambulatory"),
    (5, "Non-Urgent", "Prefer ambulatory or primary-care style routing while still keeping hospital options visible.", "Non-emergency routing support only. Final triage remains clinical.", True, "ambulatory_preferred"),
]
MAIN_KEYWORD_ROWS = [
    ("chest pain", "en", "chest_pain", 10, "Potential cardiac emergency"),
    ("douleur thoracique", "fr", "chest_pain", 10, "Douleur thoracique"),
    ("shortness of breath", "en", "severe_difficulty_breathing", 10, "Respiratory distress"),
    ("difficulty breathing", "en", "severe_difficulty_breathing", 10, "Respiratory distress"),
    ("difficulte respiratoire", "fr", "severe_difficulty_breathing", 10, "Detresse respiratoire"),
    ("stroke", "en", "stroke_symptoms", 10, "Possible stroke"),
    ("avc", "fr", "stroke_symptoms", 10, "Possible AVC"),
    ("seizure", "en", "seizure", 10, "Neurological emergency"),
    ("convulsion", "fr", "seizure", 10, "Urgence neurologique"),
    ("loss of consciousness", "en", "loss_of_consciousness", 10, "Loss of consciousness"),
    ("unconscious", "en", "loss_of_consciousness", 10, "Loss of consciousness"),
    ("perte de conscience", "fr", "loss_of_consciousness", 10, "Perte de conscience"),
    ("severe bleeding", "en", "severe_bleeding", 10, "Hemorrhage risk"),
    ("hemorrhage", "en", "severe_bleeding", 10, "Hemorrhage risk"),
    ("saignement important", "fr", "severe_bleeding", 10, "Hemorragie"),
    ("suicidal", "en", "suicidal_ideation", 10, "Psychiatric emergency"),
    ("suicidaire", "fr", "suicidal_ideation", 10, "Urgence psychiatrique"),
    ("anaphylaxis", "en", "anaphylaxis_signs", 10, "Severe allergy emergency"),
    ("anaphylaxie", "fr", "anaphylaxis_signs", 10, "Urgence allergique grave"),
    ("allergic reaction", "en", "severe_allergic_reaction", 9, "Severe allergy"),
    ("reaction allergique", "fr", "severe_allergic_reaction", 9, "Reaction allergique grave"),
    ("cyanosis", "en", "cyanosis", 10, "Hypoxia sign"),
    ("cyanose", "fr", "cyanosis", 10, "Signe d hypoxie"),
    ("major trauma", "en", "major_trauma", 10, "Major trauma"),
    ("traumatisme majeur", "fr", "major_trauma", 10, "Traumatisme majeur"),
    ("unresponsive child", "en", "unresponsive_child", 10, "Pediatric emergency"),
    ("child not responding", "en", "unresponsive_child", 10, "Pediatric emergency"),
    ("enfant inconscient", "fr", "unresponsive_child", 10, "Urgence pediatrique"),
    ("infant fever", "en", "high_risk_infant_symptoms", 9, "High-risk infant symptom"),
    ("nourrisson", "fr", "high_risk_infant_symptoms", 9, "Symptome nourrisson a risque"),
]
SCORED_RULES_ROWS = [
    (1, "Resuscitation", 100, "emergency_stop", "Seek immediate medical attention and emergency services now."),
    (2, "Emergent", 85, "emergency_stop", "Urgent emergency assessment is required now."),
    (3, "Urgent", 60, "hospital_only", "Hospital emergency assessment is recommended the same day."),
    (4, "Less Urgent", 30, "conditional_queue", "Hospital or ambulatory assessment may be appropriate depending on stability."),
    (5, "Non-Urgent", 10, "queue_eligible", "Low-acuity assessment may be appropriate for virtual queue routing."),
]
# keyword_id is "ek_" + 3-digit position; normalized_phrase equals phrase.
SCORED_KEYWORD_ROWS = [
    ("chest pain", "strong_emergency"),
    ("douleur thoracique", "strong_emergency"),
    ("severe difficulty breathing", "strong_emergency"),
    ("difficulte respiratoire severe", "strong_emergency"),
    ("stroke symptoms", "strong_emergency"),
    ("symptomes d'avc", "strong_emergency"),
    ("seizure", "strong_emergency"),
    ("convulsion", "strong_emergency"),
    ("loss of consciousness", "strong_emergency"),
    ("perte de conscience", "strong_emergency"),
    ("severe bleeding", "strong_emergency"),
    ("saignement severe", "strong_emergency"),
    ("suicidal ideation", "strong_emergency"),
    ("ideation suicidaire", "strong_emergency"),
    ("anaphylaxis", "strong_emergency"),
    ("anaphylaxie", "strong_emergency"),
    ("severe allergic reaction", "strong_emergency"),
    ("reaction allergique severe", "strong_emergency"),
    ("cyanosis", "strong_emergency"),
    ("cyanose", "strong_emergency"),
    ("major trauma", "strong_emergency"),
    ("traumatisme majeur", "strong_emergency"),
    ("unresponsive child", "strong_emergency"),
    ("enfant inconscient", "strong_emergency"),
    ("high-risk infant symptoms", "strong_emergency"),
    ("symptomes a haut risque chez le nourrisson", "strong_emergency"),
    ("shortness of breath", "serious_concern"),
    ("essoufflement", "serious_concern"),
    ("numb face", "serious_concern"),
    ("engourdissement du visage", "serious_concern"),
    ("slurred speech", "serious_concern"),
    ("difficulte a parler", "serious_concern"),
    ("lip swelling", "serious_concern"),
    ("gonflement des levres", "serious_concern"),
    ("worsening pain", "mild_concern"),
    ("douleur qui empire", "mild_concern"),
    ("persistent fever", "mild_concern"),
    ("fievre persistante", "mild_concern"),
    ("cannot walk", "serious_concern"),
    ("incapable de marcher", "serious_concern"),
]

# --------------------------------------------------------------------------
# FIXED VALUES: ranking, queue and staff constants.
RANK_WEIGHTS = (0.30, 0.25, 0.20, 0.10, 0.10, 0.05)  # wait, distance, occupancy, waiting, depth, penalty
FIT_PENALTY_EMERGENT_AMBULATORY = 1.0
FIT_PENALTY_URGENT_AMBULATORY = 0.75
FIT_PENALTY_LOW_HOSPITAL = 0.15
AMBULATORY_MARKERS = ["ambul", "clinic"]
ACUITY_FILTER_MARKER = "ambul"
TYPE_FIT_THRESHOLD = 0.15
RECOMMENDATIONS_PER_INTAKE = 12
EARTH_RADIUS_KM = 6371.0
ACTIVE_QUEUE_STATUSES = ["reserved", "confirmed", "called"]
MINUTES_PER_POSITION = 12
LEAVE_NOW_MIN_MINUTES = 15
CONTACT_RETENTION_DAYS = 2
NO_CONTACT_PREFERENCES = ["none", ""]
DASHBOARD_ARRIVAL_HORIZON_HOURS = 2
LONGEST_WAITS_LIMIT = 20
RECENT_CASES_LIMIT = 12
UI_WINDOW_ROUND_MINUTES = 15
UI_WINDOW_LENGTH_MINUTES = 45
LEGACY_WINDOW_OFFSET_MINUTES = 15
QUEBEC_PROVINCE_NAMES = ["QC", "QUEBEC", "QUÉBEC"]
MATCH_WEIGHTS = (0.55, 0.30, 0.15)  # name, address, city
MATCH_EXACTISH_THRESHOLD = 95
STAFF_NO_DATA = "No scoped facility data is available for this user."
STAFF_NEXT2H = (
    "Across the scoped facilities, there are {total} arrivals expected in the next two hours. "
    "The highest current queue pressure is at {name} with {count} queued arrivals."
)
STAFF_LOW_ACUITY = (
    "The scoped facilities currently show {total} expected low-acuity arrivals "
    "(provisional CTAS 4-5) across the active queue."
)
STAFF_CONGESTION = "Highest congestion in scope is {name} in {city} with average live wait {wait} minutes."
STAFF_NEXT2H_KEY = "next 2"
STAFF_LOW_ACUITY_KEYS = ["low-acuity", "ctas"]

# --------------------------------------------------------------------------
# FIXED VALUES: emergency-room page scraping.
SITE_PREFIX = "https://www.quebec.ca"
METRIC_LABELS = {
    "wait_time_non_priority_minutes": "Estimated waiting time for non-priority cases to see a doctor",
    "people_waiting": "Number of people waiting to see a doctor in the emergency room",
    "total_people_er": "Total number of people in the emergency room",
    "stretcher_occupancy_pct": "Occupancy rate of stretchers",
    "avg_wait_room_minutes_prev_day": "Average time in the waiting room (from the previous day)",
    "avg_stretcher_wait_minutes_prev_day": "Average waiting time on a stretcher (from the previous day)",
}

# --------------------------------------------------------------------------
# FIXED VALUES: facility register header aliases (first alias wins).
REGISTER_ALIASES = {
    "facility_name": ["facility_name", "facility name", "name"],
    "source_facility_type": ["source_facility_type", "source facility type", "facility_type"],
    "odhf_facility_type": ["odhf_facility_type", "odhf facility type"],
    "provider": ["provider"],
    "unit": ["unit"],
    "street_no": ["street_no", "street number", "street_no_fr"],
    "street_name": ["street_name", "street name"],
    "postal_code": ["postal_code", "postal code"],
    "city": ["city"],
    "province": ["province"],
    "source_format_str_address": ["source_format_str_address", "full_address_source", "formatted_address"],
    "csdname": ["csdname"],
    "csduid": ["csduid"],
    "pruid": ["pruid"],
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "lon", "lng"],
    "index": ["index", "id"],
}

# --------------------------------------------------------------------------
# FIXED VALUES: simulated-case scenarios: (id, english, french, age groups,
# baseline hours, worsening hours) and the two sentence suffixes per language.
SCENARIOS = [
    ("general_001", "Fever and ear pain since this morning", "Fievre et douleur a l oreille depuis ce matin", ("adult", "child", "older_adult"), 8, 30),
    ("general_002", "Twisted ankle with swelling after a fall", "Cheville tordue avec gonflement apres une chute", ("adult", "child", "older_adult"), 4, 28),
    ("general_003", "Sore throat and fever for one day", "Mal de gorge et fievre depuis un jour", ("adult", "child", "older_adult"), 16, 48),
    ("general_004", "Minor cut on hand with light bleeding", "Petite coupure a la main avec saignement leger", ("adult", "child", "older_adult"), 2, 20),
    ("general_005", "Abdominal pain with nausea since yesterday", "Douleur abdominale avec nausee depuis hier", ("adult", "child", "older_adult"), 20, 40),
    ("general_006", "Headache with nausea and light sensitivity", "Mal de tete avec nausee et sensibilite a la lumiere", ("adult", "child", "older_adult"), 10, 36),
    ("general_007", "Chest pain and pressure for two hours", "Douleur thoracique et pression depuis deux heures", ("adult", "older_adult", "child"), 2, 6),
    ("general_008", "Shortness of breath and cough", "Essoufflement et toux", ("adult", "older_adult", "child"), 6, 24),
    ("general_009", "Rash and itching after a new food", "Eruption et demangeaisons apres un nouvel aliment", ("adult", "child", "older_adult"), 3, 18),
    ("general_010", "Vomiting and diarrhea since last night", "Vomissements et diarrhee depuis la nuit derniere", ("adult", "child", "older_adult"), 12, 30),
    ("general_011", "Back pain after lifting boxes", "Douleur au dos apres avoir souleve des boites", ("adult", "older_adult", "child"), 6, 72),
    ("general_012", "Burning urination and low fever", "Brulure urinaire et legere fievre", ("adult", "older_adult", "child"), 14, 40),
    ("general_013", "Migraine worse today with vomiting", "Migraine pire aujourd hui avec vomissements", ("adult", "older_adult", "child"), 8, 26),
    ("general_014", "Severe bleeding from a deep leg cut", "Saignement severe d une coupure profonde a la jambe", ("adult", "older_adult", "child"), 1, 2),
    ("general_015", "Facial numbness and slurred speech", "Engourdissement du visage et difficulte a parler", ("adult", "older_adult", "child"), 1, 3),
    ("general_016", "Painful swollen knee after twisting", "Genou douloureux et gonfle apres une torsion", ("adult", "older_adult", "child"), 5, 36),
    ("general_017", "Loss of consciousness with blue lips", "Perte de conscience avec levres bleues", ("adult", "older_adult", "child"), 1, 2),
    ("child_001", "Child wheezing and breathing fast", "Enfant qui siffle en respirant et respire vite", ("child",), 2, 8),
    ("child_002", "Child fell at school and has wrist pain", "Enfant tombe a l ecole avec douleur au poignet", ("child",), 3, 18),
    ("child_003", "Child has hives and lip swelling", "Enfant avec urticaire et gonflement des levres", ("child",), 1, 3),
    ("child_004", "Child with fever, sore throat, and worsening pain", "Enfant avec fievre, mal de gorge et douleur qui empire", ("child",), 10, 32),
    ("infant_001", "Infant fever with poor feeding", "Nourrisson avec fievre et alimentation reduite", ("infant",), 4, 12),
    ("infant_002", "Infant hard to wake and breathing poorly", "Nourrisson difficile a reveiller et respire mal", ("infant",), 1, 2),
    ("infant_003", "Infant vomiting and fewer wet diapers", "Nourrisson qui vomit et moins de couches mouillees", ("infant",), 6, 24),
    ("infant_004", "Infant cough with fever and wheezing", "Nourrisson avec toux, fievre et sifflement respiratoire", ("infant",), 8, 20),
    ("infant_005", "Infant unresponsive with blue lips", "Nourrisson inconscient avec levres bleues", ("infant",), 1, 2),
]
SCENARIO_SUFFIX = {
    ("en", False): " The patient is stable for now.",
    ("en", True): " It is getting worse today.",
    ("fr", False): " La situation semble stable pour le moment.",
    ("fr", True): " La situation empire aujourd hui.",
}
SIMULATED_CREATED_AT = "2026-03-27 12:00:00"
