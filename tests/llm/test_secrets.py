from __future__ import annotations

import hashlib

from llm.made import prose

from funnelwright.llm import secrets


def rows():
    out = []
    for i in range(120):
        value = hashlib.sha1(str(i).encode()).hexdigest()
        number = str(int(value, 16))[:16]
        out.append((i, f'{prose(i, 20)} token = "{value}" {prose(i + 500, 10)} {number} {prose(i + 900, 5)}'))
    return out


def test_scan_tells_secrets_from_numbers(documents):
    hidden = hashlib.sha256(b"x").hexdigest()
    extra = [(500, f"{prose(3, 9)} token = '{hidden}' twice token = '{hidden}'"), (501, None), (502, ""), (None, f'api token = "{hidden}"'),
             (503, prose(2, 3000)), (504, "1234567812345678"), (504, "1234567812345678")]
    docs = documents(rows() + extra)
    found = secrets.scan(docs).collect()
    assert {r.value.isdigit() for r in found if r.is_secret} == {False}
    assert {r.doc_id for r in found if r.is_secret} == {*range(120), 500, None}
    assert sum(r.doc_id == 504 for r in found) == 2
    clean = secrets.redacted(docs, secrets.scan(docs))
    assert clean.columns == docs.columns and clean.count() == docs.count()
    texts = {r.doc_id: r for r in clean.collect()}
    assert texts[500].text.count("[secret]") == 2 and hidden not in texts[500].text
    assert texts[503].text == prose(2, 3000) and texts[501].text is None and texts[504].text == "1234567812345678"


def test_candidates_are_those_of_a_plain_scan(documents):
    import re

    docs = documents([(1, f"k=Abcdefgh12345678,Zyxwvuts87654321 {'a' * 30} x"), *rows()[:5], (2, "ÄAbcdefgh12345678é")])
    got = sorted((r.doc_id, r.place, r.value) for r in secrets.candidates(docs).collect())
    want = []
    for r in docs.collect():
        for place, token in enumerate(re.split(r"[\x20\x09-\x0D]+", r.text)):
            want += [(r.doc_id, place, v) for v in dict.fromkeys(re.findall(secrets.VALUE, token)) if re.search("[0-9]", v)]
    assert got == sorted(want)


def test_without_labels_every_candidate_counts(documents):
    assert secrets.scan(documents([])).count() == 0
    assert [(r.score, r.is_secret) for r in secrets.scan(documents([(1, "Abcdefgh12345678 alone")])).collect()] == [(1.0, True)]


def test_main_path_has_no_python(documents):
    plan = secrets.scan(documents(rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_short_values_next_to_credential_names(documents):
    extra = [(600, "my password = Tr0ub4dor&3 is set"), (601, "db postgres://bob:q7Zx2Lw9Tk@host/db up"), (602, 'pwd="correcthorse" here'),
             (603, "the password is there and passage goes on")]
    extra += [(700 + i, f"{prose(i, 6)} mysql://user{i}:{hashlib.md5(str(i).encode()).hexdigest()[:11]}@db{i}/x {prose(i, 5)}") for i in range(30)]
    docs = documents(rows() + extra)
    found = {(r.doc_id, r.value) for r in secrets.candidates(docs).collect()}
    assert {(600, "Tr0ub4dor&3"), (601, "q7Zx2Lw9Tk"), (602, "correcthorse")} <= found
    assert not any(d == 603 for d, _ in found)
    texts = {r.doc_id: r.text for r in secrets.redacted(docs, secrets.scan(docs)).collect()}
    assert texts[600] == "my password = [secret] is set"
    assert texts[601] == "db postgres://bob:[secret]@host/db up"


def test_clean_values_stay_where_no_forest_can_be_trained(documents):
    clean = [(1, "order 1234567812345678 came"), (2, f"sha {hashlib.sha1(b'a').hexdigest()} of it"), (3, "see https://a.org/2024-05-a-long-page-title now"),
             (4, "in posts/2024/a-long-page-title here")]
    docs = documents(clean)
    assert {r.text for r in secrets.redacted(docs, secrets.scan(docs)).collect()} == {t for _, t in clean}
