import re

from hypothesis import given, settings
from hypothesis import strategies as st

from prefspark.llm import secret_scan
from prefspark.llm.automaton import Dfa, Scanner
from llm_fixtures import ODD_ROWS, frame

BASE = [("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")),
        ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))]
LEAST = {"assign": 6, "access": 20, "hex": 24}
PARTS = ["password", "passWD", "secret", "token", "api_key", "apikey", "=", ":", '"', "'", " ", "  ", "é", "abcdef",
         "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "x", ".", "/", "\n", "deadbeef" * 3, "日"]


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in pattern.finditer(text):
            if len(m[1] if kind == "assign" else m[0]) >= LEAST[kind]:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_spans_equal_regular_expressions(text):
    assert [s for s in secret_scan.find(text) if s[0] in secret_scan.BASE] == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.text("abc01-", max_size=30))
def test_scanner_equals_leftmost_longest_search(text):
    rules = ["a(b|c)*", "[0-1]{2,3}", "ab?c+-"]
    expected = [(k, m.start(), m.end()) for k, p in enumerate(rules) for m in re.finditer(p, text)]
    assert sorted(Scanner(rules).matches(text.encode())) == sorted(expected)


def test_minimised_automaton_has_no_equivalent_states():
    dfa = Dfa(["(ab|cb)*", "a{2}"])
    seen = {(dfa.accept[s], tuple(dfa.trans[s])) for s in range(len(dfa.accept))}
    assert len(seen) == len(dfa.accept)


def test_method_adds_kinds():
    text = "ghp_" + "a1B2" * 9 + " and -----BEGIN RSA PRIVATE KEY-----"
    assert {k for k, _, _ in secret_scan.find(text)} >= {"github", "private_key"}


def test_redaction_keeps_the_rest():
    text = "日 token = abcdef123 end"
    assert secret_scan.redact(text, secret_scan.find(text)) == "日 [SECRET] end"


def test_odd_rows_and_clashing_columns(spark):
    rows = secret_scan.scan_secrets(frame(spark, ODD_ROWS, extra=True)).collect()
    assert len(rows) == len(ODD_ROWS) and all(r["n_spans"] == 0 for r in rows)
    assert secret_scan.scan_secrets(frame(spark, [])).count() == 0
    df = frame(spark, [*ODD_ROWS, (9, "password=hunter22", "en", "s")], extra=True)
    out = secret_scan.redact_column(df)
    assert out.schema == df.schema
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[9] == "[SECRET]" and texts[1] is None and texts[2] == ""
