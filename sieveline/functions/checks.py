"""Checksum and format validators as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, spaced, strip

# The Verhoeff scheme: products in the dihedral group of the pentagon, and the
# powers of one permutation (fixed value).
_PERMUTATION = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]


def _product(a: int, b: int) -> int:
    turn = (a % 5 + b % 5) % 5 if a < 5 else (a % 5 - b % 5) % 5
    return turn + 5 * ((a >= 5) != (b >= 5))


PRODUCTS = [_product(a, b) for a in range(10) for b in range(10)]
POWERS = [list(range(10))]
while len(POWERS) < 8:
    POWERS.append([POWERS[-1][x] for x in _PERMUTATION])


def compact(raw: Column) -> Column:
    """Without white space and hyphens."""
    return F.regexp_replace(raw, spaced(r"[\s-]"), "")


def verhoeff(digits: Column) -> Column:
    """Whether a string of ASCII digits carries a valid check digit; false for others."""
    products = F.array(*[F.lit(x) for x in PRODUCTS])
    powers = F.array(*[F.lit(x) for row in POWERS for x in row])
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    fold = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda c, i: F.element_at(products, c * 10 + F.element_at(powers, (i % 8) * 10 + digit(i) + 1) + 1))
    return F.when(digits.rlike(r"^[0-9]+$"), fold == 0).otherwise(F.lit(False))


def verhoeff_check_digit(digits: Column) -> Column:
    """The digit that makes a string of ASCII digits valid when put behind it; null for others."""
    fits = lambda d: verhoeff(F.concat(digits, d.cast("string")))
    return F.when(digits.rlike(r"^[0-9]+$"), F.get(F.filter(F.sequence(F.lit(0), F.lit(9)), fits), F.lit(0)).cast("string"))


def luhn(digits: Column) -> Column:
    return F.when(digits.rlike(r"^[0-9]+$"), F.call_function("luhn_check", digits)).otherwise(F.lit(False))


def one_digit_only(digits: Column) -> Column:
    return digits.rlike(r"^(.)\1+$")


def is_aadhaar(raw: Column) -> Column:
    return let(compact(raw), lambda d: d.rlike(r"^[2-9][0-9]{11}$") & ~one_digit_only(d) & verhoeff(d))


def is_aadhaar_vid(raw: Column) -> Column:
    return let(compact(raw), lambda d: d.rlike(r"^[2-9][0-9]{15}$") & ~one_digit_only(d) & verhoeff(d))


#: Issuer number ranges in the order in which they are tried; fixed values.
BRANDS = [
    ("Visa", r"^4\d{12}(\d{3})?(\d{3})?$"),
    ("Mastercard", r"^(5[1-5]\d{4}|222[1-9]\d{2}|22[3-9]\d{3}|2[3-6]\d{4}|27[01]\d{3}|2720\d{2})\d{10}$"),
    ("Amex", r"^3[47]\d{13}$"),
    ("Discover", r"^6(?:011|5\d{2}|4[4-9]\d)\d{12}$"),
    ("RuPay", r"^(6521|6522|60|81|82)\d+$"),
]


def card_brand(digits: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(BRANDS):
        out = F.when(digits.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def is_payment_card(raw: Column) -> Column:
    d = compact(raw)
    return d.rlike(r"^[0-9]{13,19}$") & ~one_digit_only(d) & luhn(d)


def is_international_phone(raw: Column) -> Column:
    d = F.regexp_replace(raw, r"[^0-9]", "")
    return strip(raw).startswith("+") & F.length(d).between(8, 15) & ~one_digit_only(d)


def is_pan(raw: Column) -> Column:
    return _upper(raw).rlike(r"^[A-Z]{3}[PCHFATBLJGK][A-Z][0-9]{4}[A-Z]$")


def is_gstin(raw: Column) -> Column:
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def valid(v: Column) -> Column:
        code = lambda i: F.instr(F.lit(alphabet), F.substring(v, i + 1, F.lit(1))) - 1
        total = F.aggregate(F.sequence(F.lit(0), F.lit(13)), F.lit(0), lambda s, i: s + F.floor(code(i) * (1 + i % 2) / 36).cast("int") + code(i) * (1 + i % 2) % 36)
        shape = v.rlike(r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]$")
        return F.when(shape, F.substring(v, 1, 2).cast("int").between(1, 38) & (code(F.lit(14)) == (36 - total % 36) % 36)).otherwise(F.lit(False))

    return let(_upper(raw), valid)


#: Bank codes of issued IFSCs; fixed values.
IFSC_BANKS = (
    "SBIN HDFC ICIC UTIB PUNB BARB KKBK IDIB CNRB UBIN IOBA BKID YESB INDB FDRL KARB SIBL CBIN MAHB PSIB UCBA CIUB "
    "TMBL KVBL DLXB CSBK RATN IBKL AUBL BDBL ESFB UJVN SURY JSFB FINO PYTM AIRP NSPB DBSS CITI HSBC SCBL DEUT BOFA "
    "JPMC BNPA ORBC ANDB CORP SYNB VIJB ALLA UTBI DENA JAKA KACE NKGS SVCB COSB ABHY TJSB APGB KGRB PKGB MSCI GSCB "
    "HPSC RSCB TSAB IPOS NTBL SRCB SDCB ZCBL APMC HARC IDFB BACB KUCB PJSB SPCB TBSB VARA ADCC HCBL VSBL MCBL NICB"
).split()
#: State codes of licences and registrations; fixed values.
STATES = "AN AP AR AS BR CH CG CT DD DL DN GA GJ HP HR JH JK KA KL LA LD MH ML MN MP MZ NL OD OR PB PY RJ SK TN TR TS UK UA UP WB".split()


def _upper(raw: Column, drop: str = r"\s") -> Column:
    return F.upper(F.regexp_replace(raw, spaced(drop), ""))


def is_ifsc(raw: Column) -> Column:
    return _upper(raw).rlike(r"^[A-Z]{4}0[A-Z0-9]{6}$")


def is_known_ifsc(raw: Column) -> Column:
    return is_ifsc(raw) & F.substring(_upper(raw), 1, 4).isin(IFSC_BANKS)


def is_indian_mobile(raw: Column) -> Column:
    """Ten digits from 6-9 on; 91 and 0 are prefixes only where they make the number too long."""
    d = F.regexp_replace(raw, spaced(r"[\s()+-]"), "")
    local = F.regexp_replace(d, r"^(?:91(?=[0-9]{10}$)|0(?=[0-9]{10}$))", "")
    return local.rlike(r"^[6-9][0-9]{9}$") & ~one_digit_only(local)


def is_indian_landline(raw: Column) -> Column:
    d = F.regexp_replace(raw, spaced(r"[\s()-]"), "")
    return d.rlike(r"^0[1-9][0-9]{8,9}$") & ~one_digit_only(F.substring(d, F.lit(2), F.length(d)))


def is_indian_passport(raw: Column) -> Column:
    return _upper(raw).rlike(r"^[A-PR-WY][1-9][0-9]{5}[1-9]$")


def is_voter_id(raw: Column) -> Column:
    return _upper(raw).rlike(r"^[A-Z]{3}[0-9]{7}$")


def is_vehicle_number(raw: Column) -> Column:
    return _upper(raw, r"[\s-]").rlike(r"^[A-Z]{2}[0-9]{1,2}[A-Z]{0,3}[0-9]{4}$")


def is_driving_licence(raw: Column, last_year: int | None = None) -> Column:
    """State, office, year of issue (1950 to ``last_year``, by default next year), serial."""
    v = _upper(raw, r"[\s-]")
    last = F.year(F.current_date()) + 1 if last_year is None else F.lit(last_year)
    shape = v.rlike(r"^[A-Z]{2}[0-9]{2}(19|20)[0-9]{9}$")
    return F.when(shape, F.substring(v, 1, 2).isin(STATES) & F.substring(v, 5, 4).cast("int").between(F.lit(1950), last)).otherwise(F.lit(False))


def is_ssn(raw: Column) -> Column:
    return raw.rlike(r"^(?!000|666|9)[0-9]{3}[- ](?!00)[0-9]{2}[- ](?!0000)[0-9]{4}$")


def is_iban(raw: Column) -> Column:
    """Modulo 97 over the digits, letters counting as 10 to 35, the first four last."""
    v = _upper(raw)
    moved = F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))
    code = lambda i: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(moved, i, F.lit(1))) - 1
    rest = F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), lambda r, i: (r * F.when(code(i) > 9, 100).otherwise(10) + code(i)) % 97)
    return F.when(v.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), rest == 1).otherwise(F.lit(False))


def is_mrz_line(raw: Column) -> Column:
    """A line of a machine-readable zone, with slack for misread fillers.  The
    lengths and least numbers of fillers are fixed values."""
    line = F.regexp_replace(raw, spaced(r"\s"), "")
    fillers = F.regexp_count(line, F.lit("[<«]"))
    padded = (fillers >= 2) & line.rlike(r"[<«KL]{8,}\d{0,2}$") & line.rlike(r"^[PIVAC][A-Z<«]")
    dense = (fillers >= 3) & line.rlike("[A-Z]") & line.rlike(r"[<«]{2}|\d{6}")
    return line.rlike(r"^[A-Z0-9<«]{28,50}$") & (padded | dense)


#: Endings of an address in words, and words before "dot" in prose; fixed values.
WORDED_ENDINGS = "com in org net co edu gov io ai uk us de fr info biz me app dev xyz ac nic gov.in co.in ac.in".split()
NOT_A_DOMAIN = "the a an my our your his her their this that it them us me you all any some home work noon night day one".split()
#: "at" and "dot" between the parts of a worded address; in brackets; in capitals.  Fixed values.
_BRACKETED, _SHOUTED = r"(?i:[\[({<]\s*(?:at|dot)\s*[\])}>])", r"\s(?:AT|DOT)\s"
_SPELT = r"(?i:\s*(?:\[\s*(?:at|dot)\s*\]|\(\s*(?:at|dot)\s*\)|\{\s*(?:at|dot)\s*\}|<\s*(?:at|dot)\s*>|\s+(?:at|dot)\s+)\s*)"


def is_obfuscated_email(raw: Column) -> Column:
    """An address with "at" and "dot" spelt out: brackets or capitals are meant so;
    plain words need a known ending and a domain that is no common word."""
    text = strip(raw)
    parts = F.filter(F.split(text, spaced(_SPELT)), lambda x: x != "")
    ending, domain = F.lower(F.try_element_at(parts, F.lit(-1))), F.lower(F.try_element_at(parts, F.lit(2)))
    meant = text.rlike(spaced(_BRACKETED)) | text.rlike(spaced(_SHOUTED))
    said = ending.isin(WORDED_ENDINGS) & ~domain.isin(NOT_A_DOMAIN)
    return (F.size(parts) >= 3) & F.when(meant, ending.rlike("^[a-z]{2,6}$")).otherwise(said)
