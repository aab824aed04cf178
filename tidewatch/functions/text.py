"""Text cleaning, section extraction and secret redaction, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.exprs import ColumnOrName, _c

# -- fixed values -----------------------------------------------------------------

# Characters Python's str.strip() removes, ASCII and beyond.
_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)
# Emphasis and blanks cut from both ends of a section.
_EMPHASIS = "*_ \t\r\n"

# Names that mark the value after them as a secret.
SECRET_NAMES = [
    "password",
    "passwd",
    "secret",
    "api[_-]?key",
    "auth[_-]?token",
    "access[_-]?key",
    "session[_-]?token",
    "private[_-]?key",
    "voyage[_-]?key",
    "client[_-]?auth",
    "bearer",
    "authorization",
    "public[_-]?key",
]
# Words in front of a credential in an authorization header.
AUTH_SCHEMES = ["bearer", "basic", "digest", "token"]

MASK = "***"
GAP = "…"


# -- transcripts --------------------------------------------------------------------

_TOOL_CALL = r"(?is)<tool_call>.*?</tool_call>"
_TOOL_RESPONSE = r"(?is)<tool_response>.*?</tool_response>"
_MARK = r"[*_]{0,2}\s*Dispatch\s+Summary\s*:?\s*[*_]{0,2}\s*"


def _strip(text: Column) -> Column:
    return F.btrim(F.btrim(F.btrim(text, F.lit(_SPACE)), F.lit(_EMPHASIS)), F.lit(_SPACE))


def _collapse_blank(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def clean_summary(raw: ColumnOrName) -> Column:
    """Readable dispatch summary from a possibly raw agent reply; null gives ``''``.

    Tool blocks go first. The summary section is preferred; without one (or with
    an empty one) the prose before the first structured section is kept.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce(_c(raw), F.lit("")), _TOOL_CALL, ""), _TOOL_RESPONSE, "")
    after = F.regexp_extract(text, rf"(?isU){_MARK}(.*)\z", 1)
    # Cutting at the marker's first word is enough: blanks and emphasis before it
    # are removed by the strip.
    section = _strip(F.regexp_replace(after, r"(?isU)(?:Dispatch\s+JSON|API\s+Response).*\z", ""))
    prose = _strip(F.regexp_replace(text, r"(?is)(?:Dispatch JSON|API Response).*\z", ""))
    return _collapse_blank(F.when(section != "", section).otherwise(prose))


def plain_text(raw: ColumnOrName) -> Column:
    """Drop bold markers, rule lines and runs of blank lines."""
    text = F.replace(F.coalesce(_c(raw), F.lit("")), F.lit("**"), F.lit(""))
    text = F.regexp_replace(text, r"(?m)^[-–—]{3,}\s*$", "")
    return F.btrim(_collapse_blank(text), F.lit(_SPACE))


def escape_html(raw: ColumnOrName) -> Column:
    text = F.coalesce(_c(raw).cast("string"), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


_FENCE = r"(?:```(?:json)?\s*)?"


def _extract(text: Column, pattern: str) -> Column:
    found = F.btrim(F.regexp_extract(text, pattern, 1), F.lit(_SPACE))
    return F.nullif(found, F.lit(""))


def summary_section(reply: ColumnOrName) -> Column:
    """Summary paragraph of an agent reply; the whole reply when there is none."""
    text = _c(reply)
    return F.coalesce(
        _extract(text, r"(?s)Dispatch Summary[:\s]*\n(.+?)(?=\n\n(?:Dispatch JSON|\z))"), text
    )


def json_section(reply: ColumnOrName) -> Column:
    return _extract(_c(reply), rf"(?s)Dispatch JSON[:\s]*\n{_FENCE}(.+?)(?:```)?(?=\n\n(?:API Response|\z))")


def response_section(reply: ColumnOrName) -> Column:
    return _extract(_c(reply), rf"(?s)API Response[:\s]*\n{_FENCE}(.+?)(?:```)?\s*\z")


# -- redaction -----------------------------------------------------------------------

# ``\s`` and ``\w`` of Java are ASCII; the classes below also take the blanks and
# letters beyond it, without the slow Unicode mode.
_WS = r"\s\x1c-\x1f\x85\p{Z}"
def _any(words: list[str]) -> str:
    """Any of the words; the class of first letters skips most positions at once."""
    first = "".join(sorted({w[0] for w in words} | {w[0].upper() for w in words}))
    return f"(?=[{first}])(?i:{'|'.join(words)})"


_NAMES = _any(SECRET_NAMES) + r"[\p{L}\p{N}_-]*"
_SEP = rf"['\"]?[{_WS}]*[:=][{_WS}]*"
_END = rf"(?=[{_WS},;}}]|\z)"
# A bare value runs to the first blank, comma, semicolon or brace; a quoted one
# to its closing quote. Already masked values hold the gap sign and never match.
_FIRST = rf"[^{_WS}'\"{GAP}]"
_BARE = rf"[^{_WS}'\",;}}{GAP}]"


def _has(text: Column, words: list[str]) -> Column:
    """Cheap test for any of the words, so most texts skip the patterns."""
    low = F.lower(text)
    found = [F.contains(low, F.lit(w)) for w in words]
    out = found[0]
    for cond in found[1:]:
        out = out | cond
    return out


def _mask_pairs(text: Column) -> Column:
    # groups of the form that did not match are empty in the replacement
    key = rf"({_NAMES}{_SEP})"
    long = rf"{key}(?:(['\"])({_FIRST}{{4}}){_FIRST}{{2,}}({_FIRST}{{2}})\2|({_FIRST}{_BARE}{{3}}){_BARE}{{2,}}({_BARE}{{2}})){_END}"
    short = rf"{key}(?:(['\"]){_FIRST}{{1,7}}\2|{_FIRST}{_BARE}{{0,6}}){_END}"
    return F.regexp_replace(F.regexp_replace(text, long, f"$1$2$3$5{GAP}$4$6$2"), short, f"$1$2{MASK}$2")


def _mask_auth(text: Column) -> Column:
    head = rf"({_any(AUTH_SCHEMES)}[{_WS}]+)"
    body = r"[A-Za-z0-9+/=._-]"
    # the token is matched to its end, so a short one is never cut out of a long one
    stop = rf"(?!{body}|{GAP})"
    text = F.regexp_replace(text, rf"{head}({body}{{4}}){body}{{2,}}({body}{{2}}){stop}", f"$1$2{GAP}$3")
    return F.regexp_replace(text, rf"{head}{body}{{1,7}}{stop}", f"$1{MASK}")


def _mask_uri(text: Column) -> Column:
    # the password ends at the first '@', as user names and passwords hold none
    return F.regexp_replace(text, r"(?i)(mongodb(?:\+srv)?://[^:/\s]+:)[^@\s]+(?=@)", f"$1{MASK}")


def redact(text: ColumnOrName) -> Column:
    """Mask secrets: URI passwords, authorization headers, key/value pairs.

    Values keep their first four and last two characters, shorter than eight
    become ``***``. Idempotent. A text goes only through the patterns whose
    words it holds.
    """
    raw = out = _c(text)
    for words, mask in (
        (["mongodb"], _mask_uri),
        (AUTH_SCHEMES, _mask_auth),
        (["passw", "secret", "key", "token", "auth", "bearer"], _mask_pairs),
    ):
        out = F.when(_has(raw, words), mask(out)).otherwise(out)
    return out


def hide_uri_credentials(text: ColumnOrName) -> Column:
    """Replace ``user:password`` of a database URI in an error text."""
    return F.regexp_replace(_c(text), r"(mongodb(?:\+srv)?://)[^@/\s]+@", "$1<redacted>@")
