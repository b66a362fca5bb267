import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from hardwood.llm.secret_scan import base62_crc, find_secrets, luhn, redact, scan, secret_digests


def brute(t):
    """Base spans by whole-text expressions."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return [(a, b, ("assign", "access", "hex")[k]) for a, k, b in sorted(out)]


PARTS = ["password", "API_KEY", "apikey", "Token", "secret", "ſecret", "toKen", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "xyz", "é", "\n", "-._/", "a" * 12]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14))
def test_base_spans_equal_whole_text_search(parts):
    t = "".join(parts)
    assert [x for x in scan(t) if x[2] in ("assign", "access", "hex")] == brute(t)


def test_checksums():
    body = "Ab3" * 10
    good = "ghp_" + body + base62_crc(body)
    assert (3, 43, "checked") in scan(f"xé {good} end") and not scan(f"ghp_{body}000000")
    assert luhn("4111 1111 1111 1111") and not luhn("4111111111111112")
    assert [x[2] for x in scan("Visa: 4111-1111-1111-1111.")] == ["card"] and not scan("visa: 4111-1111-1111-1112")


def test_table_and_edges(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in df.collect()}
    got = secret_digests(df).collect()
    assert len(got) == len(text)
    for r in got:
        b = brute(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, e, k in b).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[2] == k for x in b) for k in ("assign", "access", "hex"))
    odd = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "é token=abcdefabcdefabcdef!", 2), (2, "z" * 300000 + " AKIA" + "A" * 16, 3)], "doc_id long, text string, spans int")
    assert sorted((r.n_assign, r.n_access, r.n_hex) for r in secret_digests(odd).collect()) == [(0, 0, 0), (0, 0, 0), (0, 1, 0), (1, 0, 1)]
    red = redact(odd).collect()
    assert red[0].text is None and red[2].text == "é [secret]!" and red[3].text.endswith(" [secret]") and red[2].spans == 2
    assert find_secrets(odd.where("false"), "doc_id").collect() == []
