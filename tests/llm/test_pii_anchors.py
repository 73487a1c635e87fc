import pytest

from lumipair.llm import pii

DE, GB, NO = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"


def added(text):
    return [(text[b:e], pii.KINDS[k]) for b, k, e in pii.find_spans(text) if k >= 4]


@pytest.mark.parametrize("text, found", [
    (f"IBAN: {DE} BIC COBADEFF", [DE]), ("IBAN DE89370400440532013000 EUR 500", ["DE89370400440532013000"]),
    (f"IBAN of the firm, for payments of all of its kinds: {DE}.", [DE]), (f"IBAN {DE}, {GB} or {NO}", [DE, GB, NO]),
    (f"IBAN DE88 3704 0044 0532 0130 00 {DE}", [DE]), ("IBAN ZZ19 1234 5678 9012 345 EUR", None), (f"IBAN{DE}", [DE]),
    ("IBAN DE89370400440532013000123", []), ("IBAN DE89 3704", []),
])
def test_account_numbers_end_where_they_end(text, found):
    if found is None:  # a country that is not listed: give it valid check digits
        body = "123456789012345"
        check = 98 - int("".join(str(int(c, 36)) for c in body + "ZZ00")) % 97
        number = f"ZZ{check:02d} 1234 5678 9012 345"
        text, found = f"IBAN {number}, EUR", [number]
    assert added(text) == [(x, "iban") for x in found]


@pytest.mark.parametrize("text, found", [
    (DE, [(DE, "iban")]), (f"Iban: {DE}", [(DE, "iban")]), (f"my iban {GB} and {NO}.", [(GB, "iban"), (NO, "iban")]),
    ("DE88 3704 0044 0532 0130 00, XDE89370400440532013000", []), (f"DE88 {DE}", [(DE, "iban")]),
    ("see https://user:pw@host/ or (ftp://me@files.org/a).", [("https://user:pw@host/", "url"), ("ftp://me@files.org/a", "url")]),
    ("HTTP://a.org/~jane, https://b.org/users/joe?x=1! https://c.org/@me", [("HTTP://a.org/~jane", "url"), ("https://b.org/users/joe?x=1", "url"), ("https://c.org/@me", "url")]),
    ("http://www.apache.org/licenses/LICENSE-2.0 https://x.org/?q=@a :// http:// ://a@b", []),
    ("mailto:root@localhost tel:030-1234567, Tel:(030)1234567 hotel:12345 tel:12", [("root@localhost", "url"), ("030-1234567", "url"), ("(030)1234567", "url")]),
])
def test_bare_numbers_and_schemes(text, found):
    assert added(text) == found


def test_redaction_names_the_first_span():
    assert pii.redacted(f"pay {DE}; mailto:a@b.cd https://u:p@b.cd/x") == "pay <IBAN>; mailto:<EMAIL> <URL>"
