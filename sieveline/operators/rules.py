"""Declarative detection rules over text columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.text import normalise_digits, spaced, whole_words
from .spans import ascii_borders, settle_spans, spans

RANK = {"certain": 0, "high": 1, "medium": 2, "low": 3}


@dataclass(frozen=True)
class Rule:
    """A pattern; ``gate`` is a cheap necessary condition on the text, ``check``
    validates a value, ``context`` must occur within 60 characters.  With
    ``group`` the finding is the match's first group, at its first occurrence
    in the match."""

    number: int
    kind: str
    pattern: str
    confidence: str
    gate: str
    check: Callable[[Column], Column] | None = None
    context: str | None = None
    group: bool = False


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_CARD = r"\b(?:\d[ -]?){12,18}\d\b"
_IFSC = r"\b[A-Za-z]{4}0[A-Za-z0-9]{6}\b"
#: Not glued to other digits or to the prefix of a reference number.
_FREE = r"(?<!\d)(?<![A-Za-z0-9][-/#])"
#: Payment handles and issuers' key shapes; fixed values.
_HANDLES = (
    "ok(?:hdfcbank|icici|axis|sbi)|wa(?:hdfcbank|icici|axis|sbi)|paytm|ybl|ibl|axl|upi|apl|yapl|rapl|jupiteraxis|fam|superyes|icici|hdfcbank|sbi|axisbank|kotak|"
    "indus|federal|barodampay|cnrb|pnb|boi|uboi|idfcbank|yesbank|airtel|freecharge|mobikwik|pingpay|slice|timecosmos|naviaxis|niyoicici|postbank|dbs|abfspay|citi|"
    "hsbc|sc|rbl|kmbl|aubank|dlb|kbl|sib|tjsb|ikwik|pockets|goaxis|amazonpay|shriramhdfcbank|ptyes|ptaxis|ptsbi|pthdfc"
)
_KEYS = (
    r"(?:sk|pk|rk)[-_](?:live|test|proj|ant)[-_][A-Za-z0-9_-]{12,}|sk-[A-Za-z0-9_-]{20,}|ghp_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|"
    r"xox[baprs]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|"
    r"nvapi-[A-Za-z0-9_-]{20,}|hf_[A-Za-z0-9]{30,}|glpat-[A-Za-z0-9_-]{20}"
)
#: Words that introduce a code, a key, a number of a member, an expiry or a birth date; fixed values.
_AT = r"(?:\[\s*at\s*\]|\(\s*at\s*\)|\{\s*at\s*\}|<\s*at\s*>|\s+AT\s+|\s+at\s+)"
_POINT = r"(?:\[\s*dot\s*\]|\(\s*dot\s*\)|\{\s*dot\s*\}|<\s*dot\s*>|\s+DOT\s+|\s+dot\s+)"
_CODE_CUE = (
    r"otp|one[\s-]?time\s+(?:password|passcode|pin|code)|verification\s+code|security\s+code|confirmation\s+code|auth(?:entication)?\s+code|"
    r"log[\s-]?in\s+code|sign[\s-]?in\s+code|access\s+code|passcode|2fa\s+code|2-step\s+(?:verification\s+)?code"
)
_CODE_SAID = r"otp|one[\s-]?time\s+(?:password|passcode|code)|verification\s+code|security\s+code|log[\s-]?in\s+code|confirmation\s+code|code"
_KEY_CUE = (
    r"password|passwd|pwd|passcode|wi-?fi\s+(?:password|key)|(?:atm|card|upi|m-?)\s*pin|api[\s_-]?key|secret(?:\s+key)?|"
    r"(?:access|auth|bearer|api)\s+token|private\s+key|recovery\s+(?:code|phrase)|seed\s+phrase"
)
_MEMBER_CUE = (
    r"customer\s*id|cust\.?\s*id|cif(?:\s*no\.?)?|crn|relationship\s*no\.?|client\s*id|member\s*id|policy\s*(?:no\.?|number)|uan|pran|"
    r"abha(?:\s*(?:no\.?|number|id))?|employee\s*(?:id|code)|roll\s*(?:no\.?|number)|enrol?ment\s*(?:no\.?|number|id)"
)
_EXPIRY_CUE = r"valid\s*thru|valid\s*through|good\s*thru|exp(?:iry|\.)?(?:\s*date)?|expires?"
_BIRTH_CUE = r"dob|d\.o\.b\.?|date\s+of\s+birth|birth\s*date|birthday|born(?:\s+on)?"
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*"
_DATE = rf"\d{{1,2}}[/\-.]\d{{1,2}}[/\-.]\d{{2,4}}|\d{{4}}[/\-.]\d{{1,2}}[/\-.]\d{{1,2}}|\d{{1,2}}[\s\-/.]*{_MONTH}\.?,?[\s\-/.]*\d{{2,4}}|{_MONTH}\.?\s+\d{{1,2}},?\s+\d{{2,4}}"
_SAME_LINE = r"[^\S\n]*"
#: In the order in which they are evaluated; patterns are fixed values.
RULES = [
    Rule(1, "aadhaar", r"\b[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "certain", r"\d{4}", checks.is_aadhaar_vid),
    Rule(2, "aadhaar", r"\b[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}\b", "certain", r"\d{4}", checks.is_aadhaar),
    Rule(3, "payment_card", _CARD, "certain", r"\d", lambda v: checks.is_payment_card(v) & checks.card_brand(checks.compact(v)).isNotNull()),
    Rule(4, "payment_card", _CARD, "medium", r"\d", lambda v: checks.is_payment_card(v) & checks.card_brand(checks.compact(v)).isNull(), r"card|credit|debit|visa|master(?:card)?|rupay|amex|maestro|payment|cvv"),
    Rule(5, "pan", r"\b[A-Za-z]{5}\s?\d{4}\s?[A-Za-z]\b", "certain", r"[A-Za-z]\s?\d{4}", checks.is_pan),
    Rule(6, "gstin", r"\b\d{2}\s?[A-Za-z]{5}\s?\d{4}\s?[A-Za-z]\s?[0-9A-Za-z]\s?[Zz]\s?[0-9A-Za-z]\b", "certain", r"[A-Za-z]\s?\d{4}", checks.is_gstin),
    Rule(7, "ifsc", _IFSC, "certain", r"[A-Za-z]{4}0", checks.is_known_ifsc),
    Rule(8, "ifsc", _IFSC, "high", r"[A-Za-z]{4}0", lambda v: checks.is_ifsc(v) & ~checks.is_known_ifsc(v), r"ifsc|bank|branch|neft|rtgs|imps|swift"),
    Rule(9, "email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "certain", "@"),
    Rule(10, "email", rf"\b[A-Za-z0-9._%+-]+\s*{_AT}\s*[A-Za-z0-9-]+(?:\s*{_POINT}\s*[A-Za-z0-9-]+)+\b", "high", r"(?i:dot)", checks.is_obfuscated_email),
    Rule(11, "upi_id", rf"(?i:\b[A-Za-z0-9._-]{{3,}}@(?:{_HANDLES})\b)", "high", "@"),
    Rule(12, "phone", rf"{_FREE}(?:\+\s?91[\s-]?|\(\+?91\)[\s-]?|91[\s-]|0[\s-]?)?(?:[6-9]\d{{9}}|[6-9]\d{{4}}[\s-]\d{{5}}|[6-9]\d{{3}}[\s-]\d{{3}}[\s-]\d{{3}}|[6-9]\d{{2}}[\s-]\d{{3}}[\s-]\d{{4}})(?!\d)", "high", r"[6-9]\d{2}", checks.is_indian_mobile),
    Rule(13, "phone", rf"{_FREE}(?:\+\s?91[\s-]?|0[\s-]?)?[6-9]\d{{3}}\s\d{{6}}(?!\d)", "high", r"\d{4}\s\d{6}", checks.is_indian_mobile, r"mob|mobile|ph|phone|tel|telephone|call|whatsapp|contact|cell|sms"),
    Rule(14, "phone", rf"{_FREE}0\d{{2,4}}[\s-]?\d{{3,4}}[\s-]?\d{{3,4}}(?!\d)", "medium", r"0\d{2}", checks.is_indian_landline, r"tel|telephone|phone|ph|landline|office|contact|call|fax|helpline|toll[\s-]?free|board|reception"),
    Rule(15, "phone", r"\+\d{1,3}[\s-]?(?:\(\d{1,4}\)[\s-]?)?\d(?:[\s-]?\d){6,12}", "medium", r"\+\d", checks.is_international_phone),
    Rule(16, "passport", r"\b[A-PR-WYa-prwy][1-9]\d{5}[1-9]\b", "medium", r"[A-Za-z]\d{7}", checks.is_indian_passport, r"passport|travel document"),
    Rule(17, "voter_id", r"\b[A-Z]{3}\d{7}\b", "medium", r"[A-Z]{3}\d{7}", checks.is_voter_id, r"voter|epic|election|elector'?s?"),
    Rule(18, "vehicle_number", r"\b[A-Z]{2}[\s-]?\d{1,2}[\s-]?[A-Z]{1,3}[\s-]?\d{4}\b", "medium", r"[A-Z][\s-]?\d{4}", checks.is_vehicle_number),
    Rule(19, "driving_licence", r"\b[A-Za-z]{2}[\s-]?\d{2}[\s-]?(?:19|20)\d{2}[\s-]?\d{7}\b", "high", r"\d{7}", checks.is_driving_licence),
    Rule(20, "ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", "high", r"\d{3}-\d{2}-\d{4}", checks.is_ssn),
    Rule(21, "bank_account", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", "certain", r"[A-Z]{2}\d{2}", checks.is_iban),
    Rule(22, "passport", r"(?<![A-Z0-9<«])[A-Z0-9<«]{28,50}(?![A-Z0-9<«])", "high", r"[<«]", checks.is_mrz_line),
    Rule(23, "otp", rf"(?i:\b(?:{_CODE_CUE})\b[^\d\n]{{0,40}}?(\d{{4,8}})(?!\d))", "high", r"\d{4}", group=True),
    Rule(24, "otp", rf"(?i:(?<!\d)(\d{{4,8}})\s+is\s+(?:your|the)\s+(?:{_CODE_SAID})\b)", "high", r"\d{4}\s+[iI]", group=True),
    Rule(25, "secret", rf"\b(?:{_KEYS})", "certain", r"[spr]k[-_]|ghp_|github_pat_|xox[baprs]-|AKIA|AIza|eyJ|nvapi-|hf_|glpat-"),
    Rule(26, "secret", rf"(?i:\b(?:{_KEY_CUE}){_SAME_LINE}[:=]{_SAME_LINE}(\S{{4,80}}))", "high", r"[:=]", lambda v: ~v.endswith(":"), group=True),
    Rule(27, "identity_field", rf"(?i:\b(?:{_MEMBER_CUE}){_SAME_LINE}[.:#-]?{_SAME_LINE}([A-Z0-9][A-Z0-9-]{{5,19}})\b)", "high", r"\d", lambda v: v.rlike(r"\d"), group=True),
    Rule(28, "payment_field", rf"(?i:\b(?:{_EXPIRY_CUE}){_SAME_LINE}[:.]?{_SAME_LINE}((?:0[1-9]|1[0-2])\s*/\s*(?:\d{{2}}|20\d{{2}}))\b)", "high", r"\d\s*/", group=True),
    Rule(29, "ip_address", rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", "high", r"\d\.\d"),
    Rule(30, "date_of_birth", rf"(?i:\b(?:{_BIRTH_CUE})\b[:\s]*({_DATE}))", "high", r"(?i:d\.?o\.?b|birth|born)", group=True),
    Rule(31, "bank_account", r"\b\d{9,18}\b", "low", r"\d{9}", None, r"a\s*[/l|1]\s*c|acct|account|bank|ifsc|branch|passbook"),
]


def _inner(match: Column, pattern: str) -> Column:
    value = F.regexp_extract(match["value"], ascii_borders(pattern), 1)
    start = match["start"] + F.call_function("locate", value, match["value"]) - 1
    return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))


def rule_spans(text: Column, plain: Column, rule: Rule) -> Column:
    """The validated spans of one rule in ``plain``, the text with digits folded;
    values from the original text."""
    found = F.when(plain.rlike(spaced(rule.gate)), spans(plain, rule.pattern))
    if rule.group:
        found = F.transform(found, lambda x: _inner(x, rule.pattern))
    if rule.check:
        found = F.filter(found, lambda x: rule.check(x["value"]))
    if rule.context:
        near = lambda x: F.substring(plain, F.greatest(F.lit(1), x["start"] - 59), F.least(x["start"], F.lit(60)) + x["end"] - x["start"] + 60)
        found = F.filter(found, lambda x: near(x).rlike(whole_words(rule.context)))
    item = lambda x: F.struct(
        F.lit(RANK[rule.confidence]).alias("rank"), (x["start"] - x["end"]).alias("shortness"), F.lit(rule.number).alias("rule"), x["start"].alias("start"), x["end"].alias("end"),
        F.lit(rule.kind).alias("kind"), F.lit(rule.confidence).alias("confidence"), F.substring(text, x["start"] + 1, x["end"] - x["start"]).alias("value"),
    )
    return F.transform(found, item)


@lru_cache(maxsize=256)
def _array(rule: Rule, gateway: int) -> Column:
    """``rule_spans`` of the columns t and p; made once for each JVM, as it takes thousands of calls."""
    return F.coalesce(rule_spans(F.col("t"), F.col("p"), rule), F.array())


def rejected(text: Column, rules: list[Rule] | None = None) -> Column:
    """How many matches of checked rules their checks refuse."""
    plain = normalise_digits(text)

    def refused(rule: Rule) -> Column:
        found = F.when(plain.rlike(spaced(rule.gate)), spans(plain, rule.pattern))
        found = F.transform(found, lambda x: _inner(x, rule.pattern)) if rule.group else found
        return F.coalesce(F.size(F.filter(found, lambda x: ~rule.check(x["value"]))), F.lit(0))

    counts = [F.greatest(refused(r), F.lit(0)) for r in rules or RULES if r.check]
    return F.aggregate(F.array(*counts), F.lit(0), lambda a, x: a + x)


def scan_text(df: DataFrame, id_col: str, text_col: str, rules: list[Rule] | None = None) -> DataFrame:
    """One row per finding: id, kind, confidence, rule, start, end, value.

    All rules run in one projection; overlaps are settled within the row, so
    nothing is shuffled.  Null texts have no findings."""
    arrays = [_array(r, id(SparkContext._gateway)) for r in rules or RULES]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.col("t").isNotNull()).withColumn("p", normalise_digits(F.col("t")))
    found = rows.select("id", F.concat(*arrays).alias("f"))
    # outer, as a filter on the array would move below the projection and compute it twice, digits folded anew for each rule
    each = found.select("id", F.explode_outer(settle_spans(F.col("f"))).alias("x")).where("x is not null")
    return each.select(F.col("id").alias(id_col), "x.kind", "x.confidence", "x.rule", "x.start", "x.end", "x.value")
