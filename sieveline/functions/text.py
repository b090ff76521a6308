"""Text functions as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DOT = "•"
#: White space as the rules mean it: the characters of a class, and the same without the line feed.
SPACE = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_SAME_LINE = SPACE.replace(r"\t-\r", r"\t\x0B-\r")
_ALL_SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def spaced(pattern: str) -> str:
    """A pattern whose ``\\s`` and ``\\S`` mean SPACE, inside classes and outside; the
    engine's own know ASCII alone."""
    pattern = pattern.replace(r"[^\S\n]", f"[{_SAME_LINE}]")
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif two == r"\S" and not inside:
            out.append(f"[^{SPACE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = {"[": True, "]": False}.get(two[0], inside)
            out.append(two[0])
            i += 1
            continue
        i += 2
    return "".join(out)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.trim(text, F.lit(_ALL_SPACE))
#: First code points of the digit blocks read as ASCII digits; fixed values.
DIGIT_BLOCKS = [0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0660, 0x06F0]
_FOREIGN = "".join(chr(b + i) for b in DIGIT_BLOCKS for i in range(10))


def normalise_digits(text: Column) -> Column:
    """Digits of eleven scripts as ASCII digits, the length kept."""
    return F.translate(text, _FOREIGN, "0123456789" * len(DIGIT_BLOCKS))


def mask(value: Column) -> Column:
    """A value for display: four characters or fewer as dots; of an address the
    first character and the domain; else two characters at either end."""
    v = strip(value)
    user, domain = F.element_at(F.split(v, "@"), 1), F.element_at(F.split(v, "@"), 2)
    n = F.length(v)
    address = F.concat(F.substring(user, 1, 1), F.repeat(F.lit(DOT), F.greatest(F.lit(1), F.length(user) - 1)), F.lit("@"), domain)
    middle = F.regexp_replace(F.substring(v, F.lit(3), n - 4), spaced(r"[^\s-]"), DOT)
    return F.when(n <= 4, F.repeat(F.lit(DOT), n)).when(v.contains("@"), address).otherwise(F.concat(F.left(v, F.lit(2)), middle, F.right(v, F.lit(2))))


def site_of(url: Column) -> Column:
    """Host of an http(s) URL, lower case, without ``www.``; null for others."""
    host = F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.regexp_replace(F.when(host != "", host), r"^www\.", "")


#: Kinds of tasks in the order in which they are tried; fixed values.
TASKS = [
    ("hotels", r"hotels?|stays?|resorts?|homestay|hostel|room for|check[\s-]?in|airbnb"),
    ("trains", r"trains?|railways?|irctc|tatkal|rajdhani|shatabdi|vande bharat|pnr"),
    ("buses", r"bus|buses|volvo sleeper"),
    ("flights", r"flights?|fly|flying|air ?tickets?|airfare|plane tickets?|airlines?"),
    ("cabs", r"cab|cabs|taxi|ride to|uber|ola|auto ?rickshaw"),
    ("groceries", r"groceries|grocery|vegetables|milk|atta|instamart|blinkit|zepto"),
    ("food", r"order (?:food|dinner|lunch|breakfast)|food delivery|biryani|pizza|burger|restaurant|takeaway|swiggy|zomato"),
    ("movies", r"movies?|film|cinema|show ?times?|concert|event tickets?|bookmyshow"),
    ("email", r"e-?mails?|mail|inbox|gmail|outlook|reply to|draft"),
    ("calendar", r"calendar|meeting|schedule|appointment|invite"),
    ("docs", r"document|google docs?|spreadsheet|sheet|slides|notes?"),
    ("maps", r"directions?|route to|how far|distance to|near me|maps?"),
    ("music", r"song|music|playlist|album|spotify"),
    ("video", r"videos?|youtube|watch|trailer|episode|series"),
    ("jobs", r"jobs?|hiring|resume|cv|openings?|vacanc(?:y|ies)|internships?"),
    ("stocks", r"stocks?|shares?|mutual funds?|portfolio|nifty|sensex|sip"),
    ("news", r"news|headlines"),
    ("shopping", r"buy|order|shop|shopping|price of|cheapest|deal|add to cart|purchase"),
    ("social", r"tweet|post on|linkedin|instagram|facebook|twitter"),
]
_WORD = "[A-Za-z0-9_]"


def whole_words(alternatives: str) -> str:
    """A pattern between ASCII word borders, whatever the engine's ``\\b`` means."""
    return f"(?<!{_WORD})(?i:{spaced(alternatives)})(?!{_WORD})"


def classify_task(task: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, alternatives in reversed(TASKS):
        out = F.when(task.rlike(whole_words(alternatives)), F.lit(name)).otherwise(out)
    return out


#: Signs of instructions aimed at an agent, in order; fixed values.
INJECTIONS = [
    r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions",
    r"\b(system\s*prompt|you\s+are\s+now)\b",
    r"\bas\s+an?\s+ai\s+(agent|assistant)[,:]",
    r"\bdisregard\s+(your|the)\s+(instructions|rules)",
]


def injection(text: Column) -> Column:
    """The first sign found, in the order of the patterns; null if none."""
    found = [F.regexp_extract(text, f"(?i){spaced(p)}", 0) for p in INJECTIONS]
    return F.coalesce(*[F.when(x != "", x) for x in found])


#: What stands for a host; a fixed value.
_HOST = r"(?i)^(localhost|(?:[\w-]+\.)+[a-z][a-z0-9-]*|\d{1,3}(?:\.\d{1,3}){3}|\[[0-9a-f:]+\])(:\d{1,5})?$"
_WEB = r"(?i)^https?://"
#: Where words that are no address are searched; a fixed value.
SEARCH = "https://www.google.com/search?q="


def is_address(raw: Column) -> Column:
    """Whether words are an address rather than something to search for."""
    t = strip(raw)
    return t.rlike(_WEB) | ((t != "") & ~t.rlike(spaced(r"\s")) & F.element_at(F.split(t, "[/?#]"), 1).rlike(_HOST))


def encode_component(text: Column) -> Column:
    """Percent-encoding that leaves ``A-Za-z0-9 - _ . ! ~ * ' ( )``."""
    out = F.url_encode(text)
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def normalise_url(raw: Column) -> Column:
    """An address with its scheme (http for local hosts), or a search for the words."""
    t = strip(raw)
    scheme = F.when(t.rlike(r"(?i)^(localhost|\d{1,3}(?:\.\d{1,3}){3}|\[)"), F.lit("http://")).otherwise(F.lit("https://"))
    return F.when(t.rlike(_WEB), t).when(is_address(t), F.concat(scheme, t)).otherwise(F.concat(F.lit(SEARCH), encode_component(t)))


def fold(text: Column) -> Column:
    """Lower case, whatever is no letter or digit as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def collapse(text: Column, limit: int = 300) -> Column:
    """White space as one space, trimmed, cut after ``limit`` characters with an ellipsis; null as empty."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " "))
    return F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit("…"))).otherwise(t)


def mask_short(value: Column) -> Column:
    """Two characters at either end; four or fewer as dots."""
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit(DOT), n)).otherwise(F.concat(F.left(value, F.lit(2)), F.repeat(F.lit(DOT), n - 4), F.right(value, F.lit(2))))


def preview(value: Column) -> Column:
    """The shape of a value: up to two characters as dots, up to six the first one, else two at either end and at most eight dots."""
    n = F.length(value)
    long = F.concat(F.left(value, F.lit(2)), F.repeat(F.lit(DOT), F.least(F.lit(8), n - 4)), F.right(value, F.lit(2)))
    return F.when(n <= 2, F.repeat(F.lit(DOT), n)).when(n <= 6, F.concat(F.left(value, F.lit(1)), F.repeat(F.lit(DOT), n - 1))).otherwise(long)


TOKEN = r"<([A-Z][A-Z0-9]*_\d+)>"


def escape_tokens(text: Column) -> Column:
    """Text that looks like a token is made to look otherwise."""
    return F.regexp_replace(text, TOKEN, "‹$1›")


def tokens_in(text: Column) -> Column:
    """The distinct tokens in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))))
