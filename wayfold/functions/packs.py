"""Redaction packs: rule tables that users can extend.

A pack is an ordered list of rules. Order is meaning: tokens run before emails,
cards before phone numbers, tax numbers that embed others before those others.
Register a pack of your own with :func:`register_pack`.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TextRule:
    """A pattern found anywhere in text. ``check='luhn'`` keeps non-card digit runs."""

    name: str
    pattern: str
    replacement: str
    check: str | None = None


@dataclass(frozen=True)
class KeyRule:
    """A JSON key whose value goes; ``not_tokens`` lists words that make the key structural."""

    name: str
    pattern: str
    replacement: str
    not_tokens: str | None = None


@dataclass(frozen=True)
class LabelRule:
    """A visible label whose following text goes."""

    name: str
    pattern: str
    replacement: str


@dataclass(frozen=True)
class HintRule:
    """A class or id that names what its element holds."""

    name: str
    pattern: str
    replacement: str


@dataclass(frozen=True)
class Pack:
    name: str
    rules: tuple[TextRule, ...] = ()
    keys: tuple[KeyRule, ...] = ()
    labels: tuple[LabelRule, ...] = ()
    hints: tuple[HintRule, ...] = ()
    host_suffixes: tuple[str, ...] = field(default=())


# ---- fixed values: words that mark a "name" key as structural --------------
_STRUCTURAL_NAME_WORDS = (
    "forms?|service|file|doc|class|field|col|column|table|module|proceeding|procdng|action|menu|route|page|type"
    "|section|tab|label|method|param|event|app|host|domain|product|template|screen|role|state|city|country|district"
    "|bank|branch|ward|circle|act|scheme|category|status|key|tag|image|icon|attr|prop|short|desc|description|hindi"
    "|code|cd|flag|mode|mod|currency|month|day|year|browser|device|font|theme|lang|locale|region|zone|group|dept"
    "|designation|desig|title|order|sort|path|var|stage|step|task|report|return|notice|sub|host|server|queue|job"
    "|test|column"
)
_STRUCTURAL_ADDRESS_WORDS = "flag|type|code|cd|status|ind|same|chk|check|valid|msg|label"
_NAME_LABEL_OWNERS = (
    "full|first|last|middle|user|customer|client|account|holder|legal|trade|company|firm|applicant|member|contact"
    "|owner|display|assessee|taxpayer|entity|partner|director|father|mother|spouse|nominee|beneficiary|payee"
    "|employee|employer|deductor|deductee|borrower|guarantor|person|party|business|organi[sz]ation"
)

# ---- fixed values: the pack that is always on ------------------------------
GENERIC = Pack(
    name="generic",
    rules=(
        TextRule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)?", "<JWT>"),
        TextRule("bearer", r"Bearer[\s\p{Z}\x{FEFF}]+[A-Za-z0-9._~+/=-]+", "Bearer <TOKEN>"),
        TextRule("secret-key", r"\bsk-[A-Za-z0-9]{16,}\b", "<TOKEN>"),
        TextRule("google-key", r"\bAIza[0-9A-Za-z_-]{20,}\b", "<TOKEN>"),
        TextRule("email", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<EMAIL>"),
        TextRule(
            "iban",
            r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}[A-Z0-9]{0,3}(?![A-Za-z0-9])",
            "<IBAN>",
        ),
        TextRule("card", r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)", "<CARD>", check="luhn"),
        TextRule("phone", r"(?<![\d.])\+?(?:\d[ \-().]?){9,14}\d(?![\d.])", "<PHONE>"),
    ),
    keys=(
        KeyRule("file-name", r"(?i)file.?name|doc.?nam|attach.*name", "<FILE>"),
        KeyRule("person-name", r"(?i)name|nam\z|nm\z", "<NAME>", rf"(?i)^(?:{_STRUCTURAL_NAME_WORDS})\z"),
        KeyRule(
            "address",
            r"(?i)addr|address|street|locality|landmark|pin.?code|zip.?code|postal",
            "<ADDRESS>",
            rf"(?i)^(?:{_STRUCTURAL_ADDRESS_WORDS})\z",
        ),
        KeyRule("birth", r"(?i)dob|birth", "<DATE>"),
    ),
    labels=(
        LabelRule(
            "person-name",
            rf"(?iu)^(?:(?:{_NAME_LABEL_OWNERS})(?:'s)?\s+)?name(?:\s+of\s+[\p{{L}} ]{{2,30}})?\z",
            "<NAME>",
        ),
        LabelRule("address", r"(?iu)^(?:[\p{L} ]{0,20}\s)?address\z", "<ADDRESS>"),
        LabelRule("birth", r"(?iu)^(?:date of birth|dob|birth date)\z", "<DATE>"),
    ),
    hints=(
        HintRule(
            "person-name",
            r"(?i)user.?name|full.?name|display.?name|profile.?name|account.?name|customer.?name|assess?ee.?name"
            r"|taxpayer.?name|text.?name|welcome",
            "<NAME>",
        ),
    ),
)

# ---- fixed values: identifiers used in India -------------------------------
INDIA = Pack(
    name="india",
    host_suffixes=(".in",),
    rules=(
        TextRule("gstin", r"(?<![A-Za-z0-9])\d{2}[A-Z]{5}\d{4}[A-Z]\d[A-Z\d]Z[A-Z\d](?![A-Za-z0-9])", "<GSTIN>"),
        TextRule("pan", r"(?<![A-Za-z0-9])[A-Z]{5}\d{4}[A-Z](?![A-Za-z0-9])", "<PAN>"),
        TextRule("ifsc", r"(?<![A-Za-z0-9])[A-Z]{4}0[A-Z0-9]{6}(?![A-Za-z0-9])", "<IFSC>"),
        TextRule("passport", r"(?<![A-Za-z0-9])[A-Z]\d{7}(?![A-Za-z0-9])", "<PASSPORT>"),
        TextRule("aadhaar", r"(?<!\d)\d{4}\s?\d{4}\s?\d{4}(?!\d)", "<AADHAAR>"),
        TextRule("phone-in", r"(?<![\d+])(?:\+91[-\s]?)?[6-9]\d{9}(?!\d)", "<PHONE>"),
        TextRule("din", r"(?<!\d)\d{8}(?!\d)", "<DIN>"),
    ),
)

# ---- fixed values: control names that mean a credential --------------------
CREDENTIAL_NAME = r"(?i)captcha|otp|passw|passcode|mpin|secret|token|cvv|(?<![a-z])pin(?![a-z]|[\s_-]*code)"
CREDENTIAL_CAMEL_PIN = r"[a-z]Pin(?![A-Za-z]|[\s_-]*[Cc]ode)"

_REGISTRY: dict[str, Pack] = {GENERIC.name: GENERIC, INDIA.name: INDIA}


def register_pack(pack: Pack) -> None:
    """Add a pack, or replace one of the same name."""
    _REGISTRY[pack.name] = pack


def active_packs(names) -> list[Pack]:
    """The generic pack first, then the others in the order asked for."""
    wanted = ["generic", *[n for n in (names or ()) if n != "generic"]]
    return [_REGISTRY[n] for n in wanted if n in _REGISTRY]


def text_rules(names) -> list[TextRule]:
    return [r for p in active_packs(names) for r in p.rules]


def key_rules(names) -> list[KeyRule]:
    return [r for p in active_packs(names) for r in p.keys]


def label_rules(names) -> list[LabelRule]:
    return [r for p in active_packs(names) for r in p.labels]


def hint_rules(names) -> list[HintRule]:
    return [r for p in active_packs(names) for r in p.hints]


def packs_by_host() -> list[tuple[str, str]]:
    return [(suffix, p.name) for p in _REGISTRY.values() for suffix in p.host_suffixes]
