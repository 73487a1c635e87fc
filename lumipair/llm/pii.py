"""Personal data by expansion of anchors.

An Aho-Corasick automaton walks over each text once and reports short anchors: at-signs, plus signs before a digit,
pairs of digits, single separators between digits, schemes, country codes before two digits, brackets before a digit,
prefixes of keys, and words that announce an account, an identifier or a secret. Around each anchor a local parser of that
kind expands to the boundaries of the candidate and validates it; text without an anchor is not looked at again.

=======  ==================  =======================================================================
kind     anchor              parser
=======  ==================  =======================================================================
email    @                   local part to the left, labels of the host to the right
ip       digit.digit         four numbers up to 255 in the surrounding run of digits and dots
card     two digits          12 to 19 digits in single groups, Luhn
phone    + and a digit       9 to 15 digits with spaces, dots, hyphens and brackets
iban     IBAN, or DE99, ...  country code, two check digits and up to 30 characters, modulo 97
account  account, acct, ...  a number of 6 to 18 digits right after the cue
url      ://                 scheme to the left, address to the right; with a user's name, or a profile
url      mailto:, tel:, sms: the address or the number of 5 to 15 digits right after the scheme
secret   token, key, ...     the value behind ``=`` or ``:`` (a blank behind bearer): 12 characters or more with letters
                             and digits, of passwords 6 or more with a letter and something else
secret   AKIA, ghp_, ...     a key of the form its prefix stands for; a private key from its first line to its last
local    ( and a digit       area code in brackets and a number, 9 to 12 digits, outside of phone and url spans
=======  ==================  =======================================================================

A country code is an anchor if it is in the registry; numbers of other countries need the cue, as their length is not
known. Addresses that name no person (no user before the host, no profile in the path) are no personal data and stay.

Spans are code points, end exclusive. Spans of one kind never overlap; a candidate of the first four kinds that fails its
validation is dropped and its characters are not tried again for that kind.

Defined results: a null or empty text has no spans; texts are read whole, whatever their length; every row is treated on
its own; an empty table gives an empty result; ``redact`` keeps all other columns, and adjusts ``n_chars`` where there is
one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumipair.llm.common import batches, documents, ship

KINDS = ["email", "ip", "card", "phone", "iban", "account", "url", "secret", "local"]
BASE = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS_DOTS = re.compile(r"[0-9.]+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
IBAN_BEGIN = re.compile(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]")
CUE_REACH = 60  # characters from a cue, or from the number before, to the begin of a number
# Length of an account number by the country code of the registry.
IBAN_LENGTH = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_LENGTH = {country: n for n, countries in IBAN_LENGTH.items() for country in countries.split()}
ACCOUNT = re.compile(r"(?:\s*(?:no\.?|number|nr\.?|#))?\s*[:=#]?\s*([0-9](?:[ -]?[0-9]){5,17})(?![0-9])", re.IGNORECASE)
ACCOUNT_CUES = ["account", "acct", "passport", "ssn", "konto", "cuenta", "compte"]
SCHEME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
ADDRESS = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+")
PERSON = re.compile(r"[^/?#]*@|[^/?#]+/(?:[^?#]*/)?(?:~|@|(?:u|users?|in|profiles?|people|members?)/)[^/?#]|[^/?#]+/profile\.php\?", re.IGNORECASE)
MAILBOX = re.compile(r"[^\s<>\"'`?,;:@]+@[^\s<>\"'`?,;:@]+")
NUMBER = re.compile(r"\+?\(?[0-9][().0-9-]*[0-9]")
SCHEMES = {"mailto:": MAILBOX, "tel:": NUMBER, "sms:": NUMBER}
LOCAL_NUMBER = re.compile(r"\([0-9]{2,5}\)[ -]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])")
SECRET_CUES = ["token", "key", "apikey", "secret", "bearer", "credential", "credentials"]
PASSWORD_CUES = ["password", "passwd", "pwd", "passphrase"]
ASSIGNED = r"[\"']?[ \t]*(?:=>|:=|==?|:)[ \t]*[\"'`]?"
SECRET = re.compile(ASSIGNED + r"([A-Za-z0-9+/_.~=-]+)")
BEARER = re.compile(rf"(?:{ASSIGNED}|[ \t]+)([A-Za-z0-9+/_.~=-]+)")
PASSWORD = re.compile(ASSIGNED + r"([^\s\"'`<>,;]+)")
# The forms of keys that are known by their prefix.
PREFIXED = {
    "AKIA": re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    "ASIA": re.compile(r"ASIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    "ghp_": re.compile(r"ghp_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "gho_": re.compile(r"gho_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "ghs_": re.compile(r"ghs_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "xoxb-": re.compile(r"xoxb-[0-9A-Za-z-]{20,}"),
    "xoxp-": re.compile(r"xoxp-[0-9A-Za-z-]{20,}"),
    "AIza": re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
    "-----BEGIN ": re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
}
SPAN = "array<struct<kind:string,begin:int,end:int>>"


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    """Anchor to kind. The automaton reports the place of the last character of an anchor."""
    found = ahocorasick.Automaton()
    digits = "0123456789"
    found.add_word("@", ("email", 0))
    for a in digits:
        found.add_word(f"+{a}", ("phone", 1))
        for b in digits:
            found.add_word(f"{a}.{b}", ("ip", 1))
            for between in ("", " ", "-"):
                found.add_word(f"{a}{between}{b}", ("card", 1 + len(between)))
    for cue in ACCOUNT_CUES:
        for written in (cue, cue.capitalize(), cue.upper()):
            found.add_word(written, ("account", len(written) - 1))
    for written in ("IBAN", "Iban", "iban"):
        found.add_word(written, ("iban", 3))
    for country in IBAN_LENGTH:
        for a in digits:
            for b in digits:
                found.add_word(f"{country}{a}{b}", ("bare", 3))
    found.add_word("://", ("url", 2))
    for scheme in SCHEMES:
        for written in (scheme, scheme.capitalize(), scheme.upper()):
            found.add_word(written, ("scheme", len(written) - 1))
    for cue in SECRET_CUES + PASSWORD_CUES:
        for written in (cue, cue.capitalize(), cue.upper()):
            found.add_word(written, (cue, len(written) - 1))
    for prefix in PREFIXED:
        found.add_word(prefix, (prefix, len(prefix) - 1))
    for a in digits:
        found.add_word(f"({a}", ("local", 1))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _email(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    begin = at
    while begin > floor and text[begin - 1] in LOCAL:
        begin -= 1
    host = HOST.match(text, at + 1) if begin < at else None
    return (begin, host.end(), True) if host else None


def _run_begin(text: str, at: int, floor: int, allowed: str) -> int:
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def _ips(text: str, at: int, floor: int) -> Iterator[tuple[int, int, bool]]:
    begin = _run_begin(text, at, floor, "0123456789.")
    end = DIGITS_DOTS.match(text, begin).end()
    for found in IP.finditer(text, begin, end):
        yield *found.span(), all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in found[0].split("."))
    yield end, end, False


def _card(text: str, at: int, floor: int) -> tuple[int, int, bool]:
    """The run of digits with single separators that holds the anchor."""
    begin = at
    while begin > floor and (text[begin - 1] in "0123456789" or begin - 1 > floor and text[begin - 1] in " -" and text[begin - 2] in "0123456789"):
        begin -= 1 if text[begin - 1] in "0123456789" else 2
    end = CARD.match(text, begin).end()
    digits = text[begin:end].replace(" ", "").replace("-", "")
    return begin, end, 12 <= len(digits) <= 19 and _luhn(digits)


def _phone(text: str, at: int) -> tuple[int, int, bool] | None:
    found = PHONE.match(text, at)
    return (*found.span(), 9 <= sum("0" <= c <= "9" for c in found[0]) <= 15) if found else None


def _iban(text: str, at: int) -> tuple[int, int, bool] | None:
    """The number that begins here. Its country gives its length; of one that is not listed, the longest valid length is taken."""
    found = IBAN.match(text, at)
    if not found:
        return None
    places = [i for i in range(at, found.end()) if text[i] != " "]
    listed = IBAN_LENGTH.get(text[at:at + 2])
    for n in [listed] if listed else range(len(places), 14, -1):
        if n <= len(places):
            end = places[n - 1] + 1
            code = "".join(text[i] for i in places[:n])
            number = int("".join(str(int(c, 36)) for c in code[4:] + code[:4]))
            if number % 97 == 1 and not text[end:end + 1].isalnum():
                return at, end, True
    return None


def _ibans(text: str, at: int) -> Iterator[tuple[int, int, bool]]:
    """Numbers behind a cue that ends here, each in reach of the cue or of the one before."""
    cue, limit = at, at + CUE_REACH
    while begin := IBAN_BEGIN.search(text, at, limit + 6):
        at = begin.start()
        if at > limit:
            return
        found = _iban(text, at) if at == cue or not text[at - 1].isalnum() else None
        if found:
            yield found
        at = found[1] if found else at + 1
        limit = at + CUE_REACH if found else limit


def _account(text: str, at: int) -> tuple[int, int, bool] | None:
    found = ACCOUNT.match(text, at)
    return (*found.span(1), True) if found else None


def _url(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    begin = at
    while begin > floor and text[begin - 1] in SCHEME_CHARS:
        begin -= 1
    while begin < at and not text[begin].isalpha():
        begin += 1
    found = ADDRESS.match(text, at + 3) if begin < at else None
    if not found:
        return None
    address = found[0].rstrip(".,;:!?*_")
    while address.endswith(")") and address.count(")") > address.count("("):
        address = address[:-1].rstrip(".,;:!?*_")
    return begin, at + 3 + len(address), bool(PERSON.match(address))


def _scheme(text: str, at: int, end: int) -> tuple[int, int, bool] | None:
    name = text[at:end].lower()
    found = SCHEMES[name].match(text, end)
    if not found:
        return None
    address = found[0].rstrip(".!*_)")
    fits = address[-1] != "@" if name == "mailto:" else 5 <= sum(c.isdigit() for c in address) <= 15
    return end, end + len(address), fits


def _secret(text: str, cue: str, end: int) -> tuple[int, int, bool] | None:
    """The value that is assigned behind a cue that ends here."""
    form = PASSWORD if cue in PASSWORD_CUES else BEARER if cue == "bearer" else SECRET
    found = form.match(text, end)
    if not found:
        return None
    value = found[1].rstrip(".")
    letters, digits = sum(map(str.isalpha, value)), sum(map(str.isdigit, value))
    if cue in PASSWORD_CUES:
        fits = len(value) >= 6 and 0 < letters < len(value)
    else:
        fits = len(value) >= 12 and letters > 0 and digits > 1 and len(set(value)) >= 6
    return found.start(1), found.start(1) + len(value), fits


def _local_number(text: str, at: int) -> tuple[int, int, bool] | None:
    found = LOCAL_NUMBER.match(text, at)
    return (*found.span(), 9 <= sum(map(str.isdigit, found[0])) <= 12) if found else None


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(begin, number of the kind, end), ordered; kinds are numbered as listed."""
    spans: list[tuple[int, int, int]] = []
    done = dict.fromkeys(KINDS, 0)
    covered = 0  # end of the phone and url spans so far

    def take(kind: str, found: tuple[int, int, bool] | None) -> None:
        nonlocal covered
        if found:
            done[kind] = max(done[kind], found[1])
            if found[2]:
                spans.append((found[0], KINDS.index(kind), found[1]))
                if kind in ("phone", "url"):
                    covered = max(covered, found[1])

    for last, (kind, back) in anchors().iter(text):
        at = last - back
        if kind == "email":
            take(kind, _email(text, at, done[kind]))
        elif kind == "ip":
            if at >= done[kind]:
                for found in _ips(text, at, done[kind]):
                    take(kind, found)
        elif kind == "card":
            if at >= done[kind]:
                take(kind, _card(text, at, done[kind]))
        elif kind == "phone":
            if at >= done[kind]:
                take(kind, _phone(text, at))
        elif kind == "iban":
            for found in _ibans(text, max(last + 1, done[kind])):
                take(kind, found)
        elif kind == "bare":
            if at >= done["iban"] and not text[at - 1:at].isalnum():
                take("iban", _iban(text, at))
        elif kind == "url":
            if at >= done[kind]:
                take(kind, _url(text, at, done[kind]))
        elif kind == "scheme":
            if at >= done["url"] and not text[at - 1:at].isalnum():
                take("url", _scheme(text, at, last + 1))
        elif kind == "local":
            if at >= max(done[kind], covered):
                take(kind, _local_number(text, at))
        elif kind == "account":
            if at >= done[kind] and not text[at - 1:at].isalnum():
                take(kind, _account(text, last + 1))
        elif at >= done["secret"] and not text[at - 1:at].isalnum():
            form = PREFIXED.get(kind)
            if form is None:
                take("secret", _secret(text, kind, last + 1))
            elif found := form.match(text, at):
                take("secret", (*found.span(), True))
    return sorted(spans)


def _spans_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [[{"kind": KINDS[k], "begin": b, "end": e} for b, k, e in find_spans(t)] if t else [] for t in batch.column(0).to_pylist()]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
    return pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, kind)], names=["doc_id", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and ``spans``, an array of (kind, begin, end) by begin and kind."""
    kind = dict(docs.dtypes)["doc_id"]
    return batches(docs.select("text", "doc_id"), _spans_of, f"doc_id {kind}, spans {SPAN}")


def redacted(text: str) -> str:
    parts, at = [], 0
    for begin, kind, end in find_spans(text):
        if begin >= at:
            parts += [text[at:begin], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]]) if parts else text


@F.pandas_udf(T.StringType())
def _redact(texts: pd.Series) -> pd.Series:
    return pd.Series([redacted(t) if t else t for t in texts], dtype=object)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with the kind in place of each span; of spans that overlap the first one names the place."""
    ship(docs.sparkSession)
    others = F.struct(*[docs[c] for c in docs.columns if c != "text"], F.lit(0).alias("__some")).alias("__row")
    clean = docs.select(_redact(docs["text"]).alias("__clean"), others)
    made = {"text": F.col("__clean")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.coalesce(F.length("__clean").cast(dict(docs.dtypes)["n_chars"]), F.col("__row.n_chars"))
    return clean.select(*[made.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.begin.cast("string"), s.end.cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.kind.isin(BASE))
    return found.select(
        "doc_id", *map(count, BASE), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )
