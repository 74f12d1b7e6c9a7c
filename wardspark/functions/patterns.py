"""Patterns and constants of the text scan. They are fixed values: results depend on them exactly."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity types with acceptance threshold, overlap priority and the flag they raise.
ENTITY_TYPES = {
    "PERSON": (0.74, 2, "possible_name", "medium"),
    "EMAIL": (0.90, 6, "email", "medium"),
    "PHONE": (0.86, 5, "phone", "medium"),
    "ADDRESS": (0.82, 3, "address", "medium"),
    "ACCOUNT": (0.82, 4, "account", "high"),
    "SECRET": (0.95, 7, "secret", "critical"),
    "OTHER": (0.80, 1, None, None),
}

# Detectors in order (type, name, confidence, ignore case, pattern).
DETECTORS = (
    ("EMAIL", "email_regex", 0.96, True, r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("PHONE", "phone_regex", 0.90, False, r"(?<!\d)(?:\+?1[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4}\b"),
    ("SECRET", "openai_key_regex", 0.98, False, r"\bsk-[A-Za-z0-9_-]{6,}\b"),
    ("SECRET", "aws_access_key_regex", 0.98, False, r"\bAKIA[0-9A-Z]{16}\b"),
    ("SECRET", "github_token_regex", 0.98, False, r"\bgh[pousr]_[A-Za-z0-9]{20,}\b"),
    ("SECRET", "slack_token_regex", 0.98, False, r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    ("SECRET", "jwt_regex", 0.98, False, r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b"),
    ("SECRET", "bearer_token_regex", 0.98, True, r"\bBearer\s+[A-Za-z0-9._~+/=-]{16,}\b"),
    ("SECRET", "credential_assignment_regex", 0.98, True, r"\b(?:api[_\s-]?key|client[_\s-]?secret|access[_\s-]?token|auth[_\s-]?token|password|passwd)\s*[:=]\s*[\"']?[A-Za-z0-9_./+=-]{8,}[\"']?"),
    ("SECRET", "credential_uri_regex", 0.98, True, r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?):\/\/[^\s:@/]+:[^\s@/]+@[^\s]+"),
    ("SECRET", "private_key_regex", 0.98, False, r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("ADDRESS", "address_regex", 0.86, False, r"\b\d{1,6}\s+[A-Z][A-Za-z0-9.'-]*(?:\s+[A-Z][A-Za-z0-9.'-]*){0,4}\s+(?:Street|St\.|Avenue|Ave\.|Road|Rd\.|Boulevard|Blvd\.|Lane|Ln\.|Drive|Dr\.)\b"),
    ("ACCOUNT", "account_regex", 0.86, True, r"\b(?:account|acct|routing|iban)\s*(?:number|no\.?|#|id)?\s*[:#]?\s*[A-Z0-9-]{4,}\b"),
)

# Regulated contexts and instruction bypass (flag, severity, pattern; case is ignored).
CONTEXTS = (
    ("regulated_financial", "high", r"\b(?:loan|credit|mortgage|bank|account|underwriting|denied|adverse action|payment|investment|securities|insurance)\b"),
    ("regulated_legal", "high", r"\b(?:lawsuit|contract|legal|attorney|privilege|litigation|subpoena|compliance|regulation|court|settlement)\b"),
    ("regulated_medical", "high", r"\b(?:patient|diagnosis|treatment|medical|health|hipaa|prescription|clinical|hospital|therapy)\b"),
    ("regulated_hr", "high", r"\b(?:employee|termination|salary|disciplinary|performance review|candidate|hiring|hr|workplace|harassment)\b"),
    ("prompt_injection", "critical", r"\b(?:ignore (?:all )?(?:previous|prior) instructions|jailbreak|developer mode|system prompt|reveal (?:your|the) instructions|bypass safety|disable safety|do anything now|DAN)\b"),
)

# The same contexts for texts cut into lower-case words (flag, words, part of every phrase, phrases).
CONTEXT_WORDS = (
    ("regulated_financial", ("loan", "credit", "mortgage", "bank", "account", "underwriting", "denied", "payment", "investment", "securities", "insurance"), ("adverse action",), r"adverse action"),
    ("regulated_legal", ("lawsuit", "contract", "legal", "attorney", "privilege", "litigation", "subpoena", "compliance", "regulation", "court", "settlement"), (), None),
    ("regulated_medical", ("patient", "diagnosis", "treatment", "medical", "health", "hipaa", "prescription", "clinical", "hospital", "therapy"), (), None),
    ("regulated_hr", ("employee", "termination", "salary", "disciplinary", "candidate", "hiring", "hr", "workplace", "harassment"), ("performance review",), r"performance review"),
    ("prompt_injection", ("jailbreak", "dan"), (" instructions", "developer mode", "system prompt", " safety", "do anything now"), r"(?:ignore (?:all )?(?:previous|prior) instructions|developer mode|system prompt|reveal (?:your|the) instructions|bypass safety|disable safety|do anything now)"),
)

# Literals of which a text holds at least one (in lower case where the detector ignores case) if the detector finds anything.
LITERALS = {
    "email_regex": ("@",),
    "openai_key_regex": ("sk-",),
    "aws_access_key_regex": ("AKIA",),
    "github_token_regex": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "slack_token_regex": ("xox",),
    "jwt_regex": ("eyJ",),
    "bearer_token_regex": ("bearer",),
    "credential_assignment_regex": ("key", "secret", "token", "passw"),
    "credential_uri_regex": ("://",),
    "private_key_regex": ("-----BEGIN ",),
    "address_regex": ("Street", "St.", "Avenue", "Ave.", "Road", "Rd.", "Boulevard", "Blvd.", "Lane", "Ln.", "Drive", "Dr."),
    "account_regex": ("account", "acct", "routing", "iban"),
}

# What a flag adds to the base risk, and the boost of sensitive workspaces.
SEVERITY_WEIGHTS = {"low": 8, "medium": 18, "high": 28, "critical": 48}
BASE_RISK, SENSITIVITY_BOOST, TOP_RISK = 10, 12, 100
SENSITIVE = ("Regulated", "Confidential")

# What a flag is called and what it stands on.
FLAG_TEXTS = {
    "possible_name": ("Possible personal name", "Validated name-like entity detected."),
    "email": ("Email address", "Email-like pattern detected."),
    "phone": ("Phone number", "Phone-like pattern detected."),
    "address": ("Address", "Address-like pattern detected."),
    "account": ("Account identifier", "Account-like identifier detected."),
    "secret": ("API key or secret", "Credential-like pattern detected."),
    "regulated_financial": ("Regulated financial context", "Financial-services policy term detected."),
    "regulated_legal": ("Regulated legal context", "Legal or compliance term detected."),
    "regulated_medical": ("Regulated medical context", "Medical or health term detected."),
    "regulated_hr": ("Regulated HR context", "HR or employment term detected."),
    "prompt_injection": ("Prompt injection attempt", "Instruction-bypass language detected."),
}

PLACEHOLDER = r"\[(PERSON|EMAIL|PHONE|ADDRESS|ACCOUNT|SECRET|OTHER)_(\d+)\]"

_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_SPACE = r"\t-\r \xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def js_trim(text: Column | str) -> Column:
    """A text without white space at its ends: all of it that patterns call so, not spaces alone."""
    return F.regexp_replace(text, f"^[{_SPACE}]+|[{_SPACE}]+$", "")


def ascii_lower(text: Column) -> Column:
    """Lower case, as patterns that ignore case see it: the two other characters whose lower case is ASCII become spaces."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit(" ")), F.lit("\u0130"), F.lit(" ")))


def words(lower: Column) -> Column:
    """The maximal runs of word characters of a lower-case text: what lies between ASCII word boundaries."""
    return F.split(lower, "[^a-z0-9_]+")


def may_match(name: str, text: Column, lower: Column, ignore_case: bool) -> Column:
    """Whether a detector can find anything, by its literals; saves most texts its regular expression."""
    if name == "phone_regex":
        return text.rlike(r"\d{4}")
    return reduce(Column.__or__, [F.contains(lower if ignore_case else text, F.lit(x)) for x in LITERALS[name]])


def java(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for Spark's regular expressions: ASCII word boundaries, Unicode white space."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b":
            # Before what begins with a word character the boundary is one look back.
            begins = re.match(r"(?:\(\?:)*(?:[A-Za-z]|\\d)", pattern[i + 2 :])
            out.append(f"(?<!{_WORD})" if begins else _BOUNDARY)
        elif two == r"\s":
            out.append(_SPACE if inside else f"[{_SPACE}]")
        elif two == r"\S" and inside:
            out.append(r"\S")
        elif two[:1] == "\\":
            out.append(two)
        else:
            inside = two[:1] == "[" or (inside and two[:1] != "]")
            out.append(two[:1])
            i -= 1
        i += 2
    return ("(?i)" if ignore_case else "") + "".join(out)
