"""Fixed values shared by every operator.

The lists, weights, thresholds and tags below are fixed values: results only
compare equal to other installations when they are kept as they are.
"""

from __future__ import annotations

# ---- entity types -----------------------------------------------------------
# Types replaced in sanitized text. PERSON is detected but left.
REDACT_TYPES = [
    "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IP_ADDRESS", "US_SSN",
    "LOCATION", "DATE_TIME", "URL", "IN_AADHAAR", "IN_PAN", "BIOMETRIC_HASH",
]
ALL_TYPES = REDACT_TYPES + ["PERSON"]

# Profile -> types to look for. "default" leaves PERSON out, which also leaves
# the three linkage rules without anchors; "linkage" turns them on.
DETECT_TYPES = {"default": REDACT_TYPES, "linkage": ALL_TYPES}

# ---- scores -----------------------------------------------------------------
# Fixed values.
MIN_SCORE = 0.4
TABLE_MIN_SCORE = 0.3
CONTEXT_BOOST = 0.35
CONTEXT_TOKENS = 5
CONTEXT_CHARS = 256  # looked at first; more if they hold too few words

# Risk weight per entity type; any other type weighs 1.
RISK_WEIGHTS = {
    "IN_AADHAAR": 10, "US_SSN": 10, "CREDIT_CARD": 9, "IN_PAN": 8,
    "PHONE_NUMBER": 5, "EMAIL_ADDRESS": 4, "IP_ADDRESS": 3, "LOCATION": 3,
    "DATE_TIME": 2, "URL": 1, "BIOMETRIC_HASH": 10,
}
DEFAULT_WEIGHT = 1

# Upper (exclusive) score bound per level.
LEVEL_BOUNDS = [("LOW", 10), ("MEDIUM", 30), ("HIGH", 60)]
TOP_LEVEL = "CRITICAL"

# Follow-up steps per level.
ACTIONS = {
    "LOW": [
        "Standard data handling procedures apply",
        "Log access for audit compliance",
        "No immediate escalation required",
    ],
    "MEDIUM": [
        "Apply data masking before sharing with non-privileged users",
        "Encrypt data at rest using AES-256",
        "Review access logs within 24 hours",
        "Notify data protection officer if data leaves the organization",
    ],
    "HIGH": [
        "IMMEDIATE: Restrict access to authorized personnel only",
        "Apply full encryption (AES-256 + FPE for numeric fields)",
        "Notify Data Protection Officer within 4 hours",
        "Enable enhanced audit logging for all access",
        "Consider data minimization — remove unnecessary PII fields",
    ],
    "CRITICAL": [
        "URGENT: Quarantine document — restrict all access immediately",
        "Escalate to CISO / Data Protection Officer within 1 hour",
        "Apply maximum encryption and access controls",
        "Initiate incident response procedure if data may have been exposed",
        "Prepare breach notification if applicable (GDPR 72-hour rule)",
        "Conduct forensic analysis of document origin and access history",
    ],
}

# ---- anonymisation ----------------------------------------------------------
# Replacement tag per type.
TAGS = {
    "EMAIL_ADDRESS": "[REDACTED_EMAIL]", "PHONE_NUMBER": "[REDACTED_PHONE]",
    "IN_AADHAAR": "[REDACTED_AADHAAR]", "IN_PAN": "[REDACTED_PAN]",
    "US_SSN": "[REDACTED_SSN]", "IP_ADDRESS": "[REDACTED_IP]",
    "LOCATION": "[REDACTED_LOCATION]", "DATE_TIME": "[REDACTED_DATE]",
    "URL": "[REDACTED_URL]", "BIOMETRIC_HASH": "[REDACTED_BIOMETRIC]",
}
DEFAULT_TAG = "[REDACTED]"

# Types stored with format-preserving encryption when they hold enough digits.
FPE_TYPES = ["CREDIT_CARD", "PHONE_NUMBER", "IN_AADHAAR"]
FPE_MIN_DIGITS = 6
FPE_MAX_DIGITS = 20
METHOD_AES = "AES-256-GCM"
METHOD_FPE = "FF3-1-FPE"

# ---- context rules ----------------------------------------------------------
# Substrings that mark a number as personal data.
PII_KEYWORDS = [
    "phone", "mobile", "cell", "contact", "tel", "telephone", "whatsapp",
    "call", "sms", "fax",
    "aadhaar", "aadhar", "uid", "uidai", "unique id",
    "pan", "pan card", "permanent account",
    "card", "credit", "debit", "visa", "mastercard", "amex", "rupay",
    "ssn", "social security",
    "account number", "acct", "a/c",
    "customer", "client", "applicant", "beneficiary", "holder", "owner",
]
# Substrings that mark a number as an internal reference.
NON_PII_KEYWORDS = [
    "transaction", "txn", "order", "invoice", "reference", "ref",
    "roll", "emp", "employee code", "registration", "reg",
    "serial", "batch", "lot", "ticket", "case",
    "roll number", "serial number", "order number", "batch number",
    "transaction id", "order id", "ticket id", "case id", "invoice id",
    "registration number", "employee id", "emp id",
]
# Frequency words that are not dates.
FREQUENCY_WORDS = [
    "quarterly", "monthly", "weekly", "daily", "annually", "yearly",
    "biweekly", "bimonthly", "semiannual", "semi-annual",
    "hourly", "nightly", "overnight",
]
NARROW_WINDOW = 60
WIDE_WINDOW = 200
NAME_PHONE_WINDOW = 300
NAME_AADHAAR_WINDOW = 500
PROFILE_BEFORE = 200
PROFILE_AFTER = 1000

# ---- input caps of the parity profile ---------------------------------------
MAX_CHARS = 50_000
MAX_LINES = 500
MAX_SHEET_ROWS = 1_000
MAX_SHOWN_ENTITIES = 50

# ---- recognizer vocabularies ------------------------------------------------
# Context words per type.
CONTEXT_WORDS = {
    "IN_AADHAAR": [
        "aadhaar", "aadhar", "aadaar", "uid", "uidai", "unique identification",
        "unique id", "आधार", "enrollment", "enrolment", "eid",
    ],
    "IN_PAN": [
        "pan", "pan card", "pan number", "permanent account",
        "permanent account number", "income tax", "tax id",
        "tax identification", "it department", "itr", "पैन",
    ],
    "PERSON": [
        "name", "customer", "client", "person", "employee", "contact",
        "applicant", "beneficiary", "holder", "owner", "mr", "mrs", "ms",
        "shri", "smt", "kumar", "kumari",
    ],
    "BIOMETRIC_HASH": [
        "fingerprint", "biometric", "face", "facial", "template", "hash",
        "iris", "retina", "voiceprint", "biometrics", "fp_hash", "face_tmp",
        "bio_hash",
    ],
    "PHONE_NUMBER": ["phone", "number", "telephone", "cell", "mobile", "call"],
    "US_SSN": ["social", "security", "ssn", "ssid"],
    "IP_ADDRESS": ["ip", "ipv4", "ipv6"],
    "DATE_TIME": ["date", "birthday", "dob"],
    "URL": ["url", "website", "link"],
}

# Given names.
FIRST_NAMES = [
    "aarav", "aditi", "akash", "amit", "ananya", "anil", "anita", "anjali", "arjun", "arun",
    "deepak", "deepika", "dev", "diya", "gaurav", "geeta", "harsh", "ishaan", "ishita", "jai",
    "karan", "kavya", "krishna", "lakshmi", "manish", "maya", "meera", "mohan", "mukesh", "nandini",
    "naveen", "neha", "nikhil", "nisha", "pankaj", "pooja", "priya", "priyanka", "rahul", "raj",
    "rajesh", "rakesh", "ram", "ravi", "rekha", "ritu", "rohan", "rohit", "sakshi", "sandeep",
    "sanjay", "sara", "sarita", "shikha", "shiva", "shreya", "simran", "sneha", "sonia", "sudha",
    "sunil", "sunita", "suresh", "swati", "tanvi", "tara", "uma", "varun", "vijay", "vikram",
    "vinod", "vivek", "yash",
]
# Family names.
LAST_NAMES = [
    "agarwal", "arora", "banerjee", "bhat", "bhatt", "chakraborty", "chand", "chandra",
    "chatterjee", "chauhan", "chopra", "das", "desai", "devi", "dutta", "gandhi", "ghosh", "goyal",
    "gupta", "iyer", "jain", "joshi", "kaur", "khan", "khanna", "kohli", "krishnamurthy", "kumar",
    "lal", "mahajan", "malik", "mehta", "menon", "mishra", "mukherjee", "nair", "nanda", "kapoor",
    "pandey", "patel", "prasad", "rao", "rastogi", "reddy", "roy", "sachdev", "sahni", "saxena",
    "sen", "sethi", "shah", "sharma", "shukla", "singh", "sinha", "srivastava", "subramanian",
    "tiwari", "trivedi", "varma", "verma", "yadav",
]

# Valid holder codes and rejected prefixes of a tax number.
PAN_HOLDER_CODES = "ABCFGHLJPT"
PAN_REJECTED_PREFIXES = ["EMP", "ROL", "REG", "INV", "STU", "USR", "ACC", "TXN"]

# Column-header keywords in the order they are tried.
COLUMN_KEYWORDS = [
    ("aadhaar", "IN_AADHAAR"), ("aadhar", "IN_AADHAAR"), ("uid", "IN_AADHAAR"),
    ("pan", "IN_PAN"), ("ssn", "US_SSN"), ("name", "PERSON"),
    ("email", "EMAIL_ADDRESS"), ("e-mail", "EMAIL_ADDRESS"),
    ("phone", "PHONE_NUMBER"), ("mobile", "PHONE_NUMBER"),
    ("contact number", "PHONE_NUMBER"), ("credit card", "CREDIT_CARD"),
    ("address", "LOCATION"), ("dob", "DATE_TIME"),
    ("date of birth", "DATE_TIME"), ("birth", "DATE_TIME"),
]
# Header words of columns that hold no personal data.
NON_PII_HEADERS = [
    "number", "digit", "id", "code", "serial", "roll", "reference",
    "transaction", "order", "account",
]

# ---- audit ------------------------------------------------------------------
GENESIS_HASH = "0" * 64
# Fixed value of the stored format: lanes of a day's entries.
AUDIT_LANES = 4
