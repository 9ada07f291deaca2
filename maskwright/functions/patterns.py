"""The pattern catalogue: packs of ordered, typed patterns with base confidences and validators."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Pattern:
    """One detection pattern. `regex` is in RE2's dialect; `literal` patterns match their text exactly."""

    name: str
    pack: str
    regex: str
    pii_type: str
    confidence: float
    validator: str | None = None
    literal: bool = False

    @property
    def java(self) -> str:
        return "\\Q" + self.regex.replace("\\E", "\\E\\\\E\\Q") + "\\E" if self.literal else to_java(self.regex)

    @property
    def re2(self) -> str:
        return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", self.regex) if self.literal else self.regex


# Patterns, types and base confidences that detection results depend on, in order within each pack.
_STREET = r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct)"
#: The packs in the order in which they are registered, which is the order that applies where none is asked for.
PACK_ORDER = ("DE", "FINANCE_EU", "FR", "GLOBAL", "HEALTHCARE", "NL", "US")
CATALOGUE: tuple[Pattern, ...] = (
    Pattern("email", "GLOBAL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "EMAIL", 0.95, "email_local_part"),
    Pattern("api_key", "GLOBAL", r"""(?i)(?:api[_\-]?key|token|secret|bearer)[\s"':=]+([a-zA-Z0-9_\-.]{20,})""", "APIKEY", 0.90),
    Pattern("credit_card", "GLOBAL", r"\b\d(?:\d[\-\s]?){12,18}\b", "CREDITCARD", 0.85, "card_luhn"),
    Pattern("ssn", "US", r"\b\d{3}-\d{2}-\d{4}\b", "SSN", 0.85, "ssn"),
    Pattern("phone_us", "US", r"(?:\+?1[\-\s]?)?\(?[0-9]{3}\)?[\-.\s][0-9]{3}[\-.\s][0-9]{4}", "PHONE", 0.65, "us_phone"),
    Pattern("address_us", "US", rf"(?i)\d+\s+[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*(?:\s+[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*)*\s+{_STREET}\b", "ADDRESS", 0.75),
    Pattern(
        "ipv6", "US",
        r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
        r"|(?:[0-9a-fA-F]{1,4}:){1,7}:"
        r"|(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}"
        r"|(?:[0-9a-fA-F]{1,4}:){1,5}(?::[0-9a-fA-F]{1,4}){1,2}"
        r"|(?:[0-9a-fA-F]{1,4}:){1,4}(?::[0-9a-fA-F]{1,4}){1,3}"
        r"|(?:[0-9a-fA-F]{1,4}:){1,3}(?::[0-9a-fA-F]{1,4}){1,4}"
        r"|(?:[0-9a-fA-F]{1,4}:){1,2}(?::[0-9a-fA-F]{1,4}){1,5}"
        r"|[0-9a-fA-F]{1,4}:(?::[0-9a-fA-F]{1,4}){1,6}"
        r"|:(?::[0-9a-fA-F]{1,4}){1,7}"
        r"|::",
        "IPADDRESS", 0.85,
    ),
    Pattern("ipv4", "US", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "IPADDRESS", 0.70),
    Pattern("zip_us", "US", r"\b\d{5}(?:-\d{4})?\b", "ADDRESS", 0.40),
    Pattern("steuer_id", "DE", r"\b[1-9]\d{2}[ -]?\d{3}[ -]?\d{3}[ -]?\d{2}\b", "STEUERID", 0.70, "steuer_id"),
    Pattern("svnr", "DE", r"\b\d{2}[ -]?(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])\d{2}[ -]?[A-Za-z][ -]?\d{3}\b", "SVNR", 0.80),
    Pattern("kfz", "DE", r"\b[A-ZÄÖÜ]{1,3}[\s\-][A-Z]{1,2}[\s\-]?\d{1,4}\b", "KFZ", 0.75),
    Pattern("nir", "FR", r"\b[12][\s-]?\d{2}[\s-]?(?:0[1-9]|1[0-2])[\s-]?(?:\d{2}|2[AB])[\s-]?\d{3}[\s-]?\d{3}[\s-]?\d{2}\b", "NIR", 0.80, "nir"),
    Pattern("siret", "FR", r"\b\d{3}[\s-]?\d{3}[\s-]?\d{3}[\s-]?\d{5}\b", "SIRET", 0.75, "siret"),
    Pattern("siren", "FR", r"\b\d{3}[\s-]?\d{3}[\s-]?\d{3}\b", "SIREN", 0.60, "siren"),
    Pattern("bsn", "NL", r"\b\d{9}\b", "BSN", 0.70, "bsn"),
    Pattern("kvk", "NL", r"\b\d{8}\b", "KVK", 0.45),
    Pattern("iban", "FINANCE_EU", r"\b[A-Z]{2}\d{2}[\s]?[\dA-Z]{4}[\s]?(?:[\dA-Z]{4}[\s]?){1,7}[\dA-Z]{1,4}\b", "IBAN", 0.85, "iban"),
    Pattern("swift_bic", "FINANCE_EU", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", "SWIFTBIC", 0.65),
    Pattern(
        "vat_eu", "FINANCE_EU",
        r"\b(?:AT[U]\d{8}|BE[01]\d{9}|BG\d{9,10}|HR\d{11}|CY\d{8}[A-Z]|CZ\d{8,10}|DK\d{8}|EE\d{9}|FI\d{8}|FR[A-HJ-NP-Z0-9]{2}\d{9}|DE\d{9}|EL\d{9}|HU\d{8}"
        r"|IE\d[A-Z0-9]\d{5}[A-Z]{1,2}|IT\d{11}|LV\d{11}|LT(?:\d{9}|\d{12})|LU\d{8}|MT\d{8}|NL\d{9}B\d{2}|PL\d{10}|PT\d{9}|RO\d{6,10}|SK\d{10}|SI\d{8}"
        r"|ES[A-Z0-9]\d{7}[A-Z0-9]|SE\d{12})\b",
        "VATID", 0.80,
    ),
    Pattern("mrn", "HEALTHCARE", r"(?i)\b(?:MRN|MR|PAT)[\s\-:#]?\d{6,10}\b", "MRN", 0.85),
    Pattern("icd10", "HEALTHCARE", r"(?i)(?:diagnosis|icd[\s\-]?10?|dx|code)[\s:]*\b[A-Z]\d{2}(?:\.\d{1,4})?\b", "ICD10", 0.75),
    Pattern("insurance_id", "HEALTHCARE", r"(?i)(?:insurance|policy|member|ehic|subscriber)[\s\-:#]*[A-Z0-9]{2,4}[\s\-]?\d{6,12}\b", "INSURANCEID", 0.70),
)

# Own design: the pack is only described by names, prefixes, types and confidences, so these expressions are ours.
SECRETS: tuple[Pattern, ...] = tuple(
    Pattern(name, "SECRETS", regex, pii_type, confidence)
    for name, regex, pii_type, confidence in (
        ("ssh_private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", "SSHKEY", 0.99),
        ("jwt", r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}", "JWT", 0.95),
        ("bearer_token", r"(?i)\bbearer\s+[A-Za-z0-9_\-.=]{20,}", "BEARER", 0.92),
        ("db_connection_string", r"\b(?:postgres|postgresql|mysql|mongodb|redis|amqp)(?:\+[a-z]+)?://[^\s:/@\x01]+:[^\s@/\x01]+@[^\s\"'<>\x01]+", "DBCONN", 0.93),
        ("aws_access_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "AWSKEY", 0.97),
        ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", "GHTOKEN", 0.97),
        ("gitlab_pat", r"\bglpat-[A-Za-z0-9_\-]{20,}", "GLTOKEN", 0.97),
        ("gitlab_deploy", r"\bgldt-[A-Za-z0-9_\-]{20,}", "GLTOKEN", 0.97),
        ("slack_token", r"\bxox[abprs]-[A-Za-z0-9\-]{10,}", "SLACKTOKEN", 0.95),
        ("stripe_key", r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}\b", "STRIPEKEY", 0.97),
        ("npm_token", r"\bnpm_[A-Za-z0-9]{36}\b", "NPMTOKEN", 0.97),
        ("pypi_token", r"\bpypi-[A-Za-z0-9_\-]{50,}", "PYPITOKEN", 0.97),
        ("openai_key", r"\bsk-(?:proj-)?[A-Za-z0-9_\-]{32,}", "OPENAIKEY", 0.95),
        ("docker_pat", r"\bdckr_pat_[A-Za-z0-9_\-]{20,}", "DOCKERTOKEN", 0.97),
        ("google_api_key", r"\bAIza[A-Za-z0-9_\-]{35}", "GOOGLEKEY", 0.97),
        ("shopify_token", r"\bshp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}\b", "SHOPIFYTOKEN", 0.97),
        ("sendgrid_key", r"\bSG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}", "SENDGRIDKEY", 0.96),
        ("groq_key", r"\bgsk_[A-Za-z0-9]{40,}\b", "GROQKEY", 0.96),
        ("twilio_sid", r"\bAC[0-9a-f]{32}\b", "TWILIOTOKEN", 0.95),
        ("twilio_auth", r"\bSK[0-9a-f]{32}\b", "TWILIOTOKEN", 0.95),
        ("facebook_token", r"\bEAACEdEose0cBA[A-Za-z0-9]+", "FBTOKEN", 0.97),
        ("amazon_mws", r"\bamzn\.mws\.[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "AMZTOKEN", 0.96),
        ("cloudinary_url", r"\bcloudinary://[0-9]+:[A-Za-z0-9_\-]+@[a-z0-9\-]+", "CLOUDINARYTOKEN", 0.95),
        ("pgp_private_key", r"-----BEGIN PGP PRIVATE KEY BLOCK-----[^\-\x01]+-----END PGP PRIVATE KEY BLOCK-----", "PGPKEY", 0.99),
    )
)

#: Types that only a model's verdict can give.
MODEL_TYPES = ("NAME", "MEDICAL", "SALARY", "COMPANY", "JOBTITLE")

_EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_SPACE = "\\t\\n\\f\\r "


def to_java(regex: str) -> str:
    """The pattern in Java's dialect with RE2's meaning: ASCII word bounds, white space without vertical tab, folding of case
    beyond ASCII, and literal brackets in classes. A word bound whose inner side is plain gets the cheaper look-around."""
    out, i, inside = [], 0, False
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            pair = regex[i : i + 2]
            i += 2
            if pair == "\\b":
                lead = i == 2 or regex[: i - 2] == "(?i)"
                follow = regex[i : i + 2]
                if lead and (follow == "\\d" or re.match(r"\[(?:[0-9A-Za-z][0-9A-Za-z-]*|\d)\]|[A-Za-z0-9]", regex[i:])):
                    out.append("(?<![0-9A-Za-z_])")
                else:
                    out.append(_EDGE)
            elif pair == "\\s":
                out.append(_SPACE if inside else f"[{_SPACE}]")
            else:
                out.append(pair)
            continue
        if inside:
            inside = c != "]"
            out.append("\\[" if c == "[" else c)
        else:
            inside = c == "["
            out.append(c)
        i += 1
    text = "".join(out)
    return "(?iu)" + text[4:] if text.startswith("(?i)") else text


_REGISTERED: list[Pattern] = [*CATALOGUE]


def register(*patterns: Pattern) -> None:
    """Add patterns to the catalogue, after those registered so far."""
    _REGISTERED.extend(patterns)


def registered() -> tuple[Pattern, ...]:
    return tuple(_REGISTERED)


def pattern(name: str) -> Pattern:
    return next(p for p in (*_REGISTERED, *SECRETS) if p.name == name)


def pii_types(patterns: tuple[Pattern, ...] | None = None) -> list[str]:
    """Distinct types in the order of their first pattern."""
    return list(dict.fromkeys(p.pii_type for p in (patterns or registered())))


def all_packs() -> list[str]:
    """The packs that apply where none is asked for: in order of registration, then those registered since."""
    return [*PACK_ORDER, *(p for p in dict.fromkeys(p.pack for p in registered()) if p not in PACK_ORDER)]


@dataclass(frozen=True)
class Stage:
    """A pattern in its place: effective confidence after the decay of its pack's position."""

    ordinal: int
    pattern: Pattern
    position: int
    confidence: float


def load_packs(enabled: list[str], decay: float = 0.05, patterns: tuple[Pattern, ...] | None = None) -> tuple[list[Stage], list[str]]:
    """(stages in order, unknown packs). Each listed pack takes up a position, known or not."""
    known = patterns if patterns is not None else registered()
    stages, unknown = [], []
    for position, pack in enumerate(enabled):
        own = [p for p in known if p.pack == pack]
        if not own:
            unknown.append(pack)
        for p in own:
            stages.append(Stage(len(stages), p, position, max(0.0, p.confidence * (1 - position * decay))))
    return stages, unknown


def catalogue_frame(spark: SparkSession, enabled: list[str] | None = None, decay: float = 0.05) -> DataFrame:
    """The stages as a table."""
    stages, _ = load_packs(enabled or all_packs(), decay)
    rows = [(s.ordinal, s.pattern.pack, s.pattern.name, s.pattern.regex, s.pattern.pii_type, s.pattern.confidence, s.pattern.validator, s.confidence, s.position) for s in stages]
    return spark.createDataFrame(rows, "ordinal int, pack string, name string, regex string, pii_type string, base_confidence double, validator string, effective_confidence double, pack_pos int")


def as_literal(p: Pattern, text: str) -> Pattern:
    """A pattern that matches `text` and nothing else."""
    return replace(p, regex=text, literal=True)
