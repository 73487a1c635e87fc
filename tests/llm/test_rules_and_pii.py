import random
import re

import pytest

from lumipair.llm import pii, quality_rules
from lumipair.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_words string, failures string, kept string, spans string, n_chars long"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", 5) for i, t in enumerate(texts)], SCHEMA)


def slow_repeats(words):
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)})


def test_repeated_words_match_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))]
        assert quality_rules.repeated_words(words) == slow_repeats(words)
    assert quality_rules.repeated_words([b"x"] * 100_000) == 100_000


def test_ledger_policies_and_ablation(spark):
    good = " ".join(f"word{i}" for i in range(40))
    texts = [None, "", " \n\t", good, good.upper(), good.replace(" ", "# "), "same line of words here\n" * 30, good, "x" * 200_000]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in quality_rules.decide(quality_rules.ledger(docs)).collect()}
    assert [got[i].kept for i in range(9)] == [False, False, False, True, False, False, False, True, False]
    assert [got[i].base_failed for i in range(9)] == [True, True, True, False, False, False, True, False, True]
    assert got[6].failures == quality_rules.BIT["repeated_windows"] | quality_rules.BIT["duplicate_lines"]
    base = {r.doc_id: r.kept for r in quality_rules.decide(quality_rules.ledger(docs), "base").collect()}
    assert base[4] and base[5] and not base[6]
    effect = {r.rule: (r.n_failed, r.n_failed_alone) for r in quality_rules.ablation(quality_rules.ledger(docs)).collect()}
    bits = [got[i].failures for i in range(9)]
    for rule, bit in quality_rules.BIT.items():
        assert effect[rule] == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits))
    kept = quality_rules.keep_good(docs)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [3, 7]
    none = frame(spark, [])
    assert quality_rules.ledger(none).count() == quality_rules.keep_good(none).count() == 0


def slow_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10
            if (
                kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                or kind == "card" and 12 <= len(digits) <= 19 and luhn == 0 or kind == "phone" and 9 <= len(digits) <= 15
            ):
                found.append((m.start(), k, m.end()))
    return sorted(found)


@pytest.mark.parametrize("letters", ["01.-+ @a", "0123456789 -", "+0123456789().- ", "ab@.-+_% 1", "é2.5@x-😀 4+a"])
def test_base_spans_match_patterns(letters):
    rng = random.Random(letters)
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert [s for s in pii.find_spans(text) if s[1] < 4] == slow_spans(text), text


def test_method_adds_spans_with_a_cue():
    text = "Pay to IBAN DE89 3704 0044 0532 0130 00 or account no. 12345678, not IBAN DE88 3704 0044 0532 0130 00; accounting 12345678"
    assert [(text[b:e], pii.KINDS[k]) for b, k, e in pii.find_spans(text)] == [("DE89 3704 0044 0532 0130 00", "iban"), ("12345678", "account")]


def test_spans_and_redaction(spark):
    texts = [None, "", "clean text without any, 12 or 3.5 or a@b", "é write to a.b@c.de, +1 (555) 555-5010 or 10.0.0.255", "4111 1111 1111 1111", "x" * 300_000 + " a@b.cd"]
    docs = frame(spark, texts)
    found = {r.doc_id: [(s.kind, s.begin, s.end) for s in r.spans] for r in pii.personal_data(docs).collect()}
    assert found[0] == found[1] == found[2] == []
    assert [k for k, *_ in found[3]] == ["email", "phone", "ip"] and found[4] == [("card", 0, 19)] and found[5] == [("email", 300_001, 300_007)]
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    got = {r.doc_id: r for r in clean.collect()}
    assert got[0].text is None and got[0].n_chars == 5 and got[2].text == texts[2]
    assert got[3].text == "é write to <EMAIL>, <PHONE> or <IP>" and got[3].n_chars == len(got[3].text)
    none = frame(spark, [])
    assert pii.personal_data(none).count() == pii.redact(none).count() == 0


def test_pii_query(spark):
    import hashlib

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op8_pii"](spark, SF).collect():
        spans = slow_spans(texts[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{b}:{e}" for b, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(joined.split(",")) <= set(r.spans.split(","))
