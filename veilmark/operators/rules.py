"""Detection rules as data: attribute rules for page nodes, and patterns for text. A rule holds a builder of a Column, so
a plug-in rule costs no Python per row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import validators as v
from ..functions.text import TIER_2

#: ASCII word boundaries; Java's own look at letters of all scripts.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
OPEN, CLOSE = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


@dataclass(frozen=True)
class DomRule:
    """`hint` is matched against the node's lower-cased context, `complete` against its autocomplete tokens."""

    type: str
    detector: str
    confidence: float
    hint: str | None = None
    complete: str | None = None
    input_type: str | None = None

    @property
    def tier(self) -> int:
        return 2 if self.type in TIER_2 else 1

    def test(self, context: Column, complete: Column, input_type: Column) -> Column:
        out = F.lit(False)
        if self.input_type:
            out = out | F.coalesce(input_type == self.input_type, F.lit(False))
        if self.complete:
            out = out | complete.rlike(self.complete)
        if self.hint:
            out = out | context.rlike(self.hint)
        return out


@dataclass(frozen=True)
class PatternRule:
    type: str
    detector: str
    confidence: float
    regex: str
    validate: Callable[[Column], Column] | None = None
    context: str | None = None
    needs: str | None = None  # a cheap test before the matcher runs

    @property
    def tier(self) -> int:
        return 2 if self.type in TIER_2 else 1


#: The attribute rules, in their order of listing.
DOM_RULES = (
    DomRule("password", "dom:input-type-password", 0.99, complete=r"(^|\s)(current|new)-password($|\s)", input_type="password"),
    DomRule("otp", "dom:otp", 0.92, r"\botp\b|one[ -]?time[ -]?(code|password)|verification[ -]?code|2fa", r"^one-time-code\z"),
    DomRule("card_number", "dom:cc-number", 0.95, r"card[ -]?number|cardnum|\bccnum\b|debit[ -]?card|credit[ -]?card", "cc-number"),
    DomRule("cvv", "dom:cc-csc", 0.95, r"\bcvv\b|\bcvc\b|\bcsc\b|security[ -]?code", "cc-csc"),
    DomRule("card_expiry", "dom:cc-exp", 0.90, r"expir(y|ation)[ -]?(date)?|valid[ -]?thru", "cc-exp"),
    DomRule("aadhaar", "dom:aadhaar", 0.92, r"aadhaar|aadhar|\buidai\b|\buid\b[ -]?number"),
    DomRule("pan", "dom:pan", 0.90, r"\bpan\b[ -]?(number|no|card)?\b|permanent[ -]?account[ -]?number"),
    DomRule("ssn", "dom:ssn", 0.90, r"\bssn\b|social[ -]?security"),
    DomRule("passport", "dom:passport", 0.90, "passport"),
    DomRule("bank_account", "dom:bank-account", 0.88, r"account[ -]?(number|no)|\bacct\b|\ba/c\b|beneficiary[ -]?account|\biban\b"),
    DomRule("ifsc", "dom:ifsc", 0.88, r"\bifsc\b|routing[ -]?number|\bswift\b|\bbic\b"),
    DomRule("email", "dom:email", 0.90, "e-?mail", "email", "email"),
    DomRule("phone", "dom:phone", 0.88, r"phone|mobile|contact[ -]?(number|no)", r"(^|\s)tel($|\s|-)", "tel"),
    DomRule("address", "dom:address", 0.82, r"address|street|\bpin[ -]?code\b|\bzip\b|postcode", "street-address|address-line|postal-code"),
    DomRule("person_name", "dom:person-name", 0.82, "full[ -]?name|first[ -]?name|last[ -]?name|surname|account[ -]?holder|cardholder|your[ -]?name|customer[ -]?name", r"(^|\s)(name|given-name|family-name|additional-name)($|\s)"),
    DomRule("date_of_birth", "dom:dob", 0.88, r"date[ -]?of[ -]?birth|\bdob\b|birth[ -]?date|birthday", r"^bday\z"),
)

#: The patterns that the rules below share.
EMAIL = EDGE + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}" + CLOSE
CARD = OPEN + r"(?:[0-9][ -]?){12,18}[0-9]" + CLOSE
AADHAAR = OPEN + r"[2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}" + CLOSE
PAN = OPEN + r"[A-Z]{5}[0-9]{4}[A-Z]" + CLOSE
IFSC = OPEN + r"[A-Z]{4}0[A-Z0-9]{6}" + CLOSE
SSN = OPEN + r"(?!000|666|9[0-9][0-9])[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}" + CLOSE
PHONE = r"(?:\+[0-9]{1,3}[ -]?)?(?:\([0-9]{2,4}\)[ -]?)?[0-9]{3,5}[ -]?[0-9]{3,5}(?:[ -]?[0-9]{2,4})?"
DOB = OPEN + r"(?:[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2})" + CLOSE

#: The text patterns, in their order of listing.
PATTERNS = (
    PatternRule("email", "regex:email", 0.95, EMAIL, needs="@"),
    PatternRule("card_number", "regex:card_number+luhn", 0.95, CARD, v.is_payment_card),
    PatternRule("aadhaar", "regex:aadhaar+verhoeff", 0.95, AADHAAR, v.is_aadhaar),
    PatternRule("pan", "regex:pan", 0.90, PAN),
    PatternRule("ifsc", "regex:ifsc", 0.90, IFSC),
    PatternRule("ssn", "regex:ssn", 0.90, SSN, needs="-"),
    PatternRule("phone", "regex:phone-intl", 0.75, PHONE, v.is_phone),
    PatternRule("bank_account", "regex:bank_account(context)", 0.80, OPEN + "[0-9]{9,18}" + CLOSE, context=r"(?i)account|a/c|\bacct\b|beneficiary|iban"),
    PatternRule("passport", "regex:passport(context)", 0.80, OPEN + "[A-PR-WY][0-9]{7}" + CLOSE, context="(?i)passport"),
    PatternRule("otp", "regex:otp(context)", 0.80, OPEN + "[0-9]{4,8}" + CLOSE, context=r"(?i)\botp\b|one[ -]?time|verification code|auth(entication)? code|2fa"),
    PatternRule("date_of_birth", "regex:dob(context)", 0.80, DOB, context=r"(?i)birth|\bdob\b|born"),
)

#: The receiving side keeps its own table, without phones, so that neither side trusts the other.
INGRESS = (
    PatternRule("email", "email", 1.0, EMAIL, needs="@"),
    PatternRule("card_number", "card_number+luhn", 1.0, CARD, v.is_payment_card),
    PatternRule("aadhaar", "aadhaar+verhoeff", 1.0, AADHAAR, v.is_aadhaar),
    PatternRule("pan", "pan", 1.0, PAN),
    PatternRule("ifsc", "ifsc", 1.0, IFSC),
    PatternRule("ssn", "ssn", 1.0, SSN, needs="-"),
)


def matches(rule: PatternRule, text: Column) -> Column:
    """Whether a valid match of the rule is in the text."""
    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    hit = text.rlike(rule.regex) if rule.validate is None else F.exists(found, lambda m: rule.validate(m))
    return F.coalesce(F.when(text.contains(rule.needs), hit).otherwise(False) if rule.needs else hit, F.lit(False))
