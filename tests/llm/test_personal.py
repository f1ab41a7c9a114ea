"""Personal data next to the plain patterns."""

import random

from contentflow.llm import pii, queries
import llm_plain as plain

CASES = [
    "", "a@b", "a@b.c", "x a@b@c.d y", "a@b.c_x@d.e", "a.b@c-.d.e.", "@a.b", "é@a.bc", "a@b..c", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "1.2.3", "300.1.1.1 001.02.3.255",
    "1..2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1111 x", "41111111111111112222", "4111  1111 1111 1111", "+1 (555) 123-4567", "+12", "+1 .", "++49 30 123456 ",
    "+1555123456789012", "1" * 6000, "9" * 5000 + ".1.1.1", "4111111111111111" * 40, "+1" * 500, "@" * 300, "a" * 20_000 + "@", "x" * 20_000 + "@y.z",
]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(7)
    alphabet = "aB1290@@..++-- ()_%é\n"
    texts = CASES + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += [" ".join(rng.choice(["4111 1111 1111 1111", "10.0.0.1", "+49 30 1234567", "a.b@c.de", "0", "-", "7"]) for _ in range(8)) for _ in range(300)]
    for text in texts:
        assert [s for s in pii.find(text) if s[0] in pii.BASE_KINDS] == plain.personal(text), text[:100]


def test_urls_accounts_and_masks():
    text = "See https://a.example/x?y=1. IBAN: 1234-5678 90 account no. 00112233, ftp://, accounting 12"
    spans = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in spans] == [("url", "https://a.example/x?y=1"), ("account", "1234-5678 90"), ("account", "00112233")]
    assert pii.masked(text, spans) == "See [URL]. IBAN: [ACCOUNT] account no. [ACCOUNT], ftp://, accounting 12"
    assert pii.masked("abcdef", [("email", 1, 4), ("card", 2, 5)]) == "a[EMAIL]f"


def test_each_cue_has_its_forms():
    planted = {
        "IBAN DE89 3704 0044 0532 0130 00 is ours": "DE89 3704 0044 0532 0130 00", "iban: GB29NWBK60161331926819.": "GB29NWBK60161331926819",
        "IBAN: FR14 2004 1010 0505 0001 3M02 606 and": "FR14 2004 1010 0505 0001 3M02 606", "Iban no. NL91 ABNA 0417 1643 00": "NL91 ABNA 0417 1643 00",
        "IBAN NO93 8601 1117 947 is": "NO93 8601 1117 947", "IBAN de89370400440532013000": "de89370400440532013000", "IBAN: 1234-5678 90": "1234-5678 90",
        "Passport number: C01X00T47,": "C01X00T47", "passport no. AB 123456": "AB 123456", "passport 12AB34567": "12AB34567", "passport 123456789": "123456789",
        "SSN 123-45-6789": "123-45-6789", "account no. 00112233": "00112233",
        "IBAN DE88 3704 0044 0532 0130 00": None, "IBAN codes are needed": None, "PASSPORT RENEWAL": None, "passport holders of 2024": None, "SSN 123": None,
    }
    for text, number in planted.items():
        found = [text[a:b] for k, a, b in pii.find(text) if k == "account"]
        assert found == ([number] if number else []), text
        if number:
            assert number not in pii.masked(text, pii.find(text))


def test_odd_rows_and_the_query(spark, tmp_path):
    rows = [(1, c, "s", 0) for c in CASES] + [(None, None, None, None), (1, "a@b.c", "s", 0), (1, "a@b.c", "s", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string, masked int")
    found = pii.find_personal_data(frame, mask=True)
    assert found.columns == ["doc_id", "text", "spans", "masked"] and found.count() == len(rows)
    frame.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op2_personal_spans"](spark, str(tmp_path)).collect()
    expected = []
    for _, text, _, _ in rows:
        base = plain.personal(text)
        expected.append(plain.sha(",".join(f"{k}:{a}:{b}" for k, a, b in base)))
    assert sorted(r.base_sha256 for r in out) == sorted(expected)
    assert pii.find_personal_data(frame.limit(0)).count() == 0
