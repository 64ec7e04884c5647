import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prefspark.llm import mixture_pack
from prefspark.llm.mixture_pack import Schedule
from prefspark.llm.pieces import tokenizer_path
from llm_fixtures import ODD_ROWS, frame


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcde"), st.integers(1, 5000), min_size=1),
       st.none() | st.dictionaries(st.sampled_from("abcde"), st.floats(0.01, 1), min_size=1),
       st.sampled_from([7, 100, 1000]), st.sampled_from([4, 16]), st.randoms())
def test_every_token_has_one_place(totals, targets, window, length, random):
    schedule = Schedule(totals, targets, window)
    seen = np.zeros(sum(totals.values()), int)
    for queue, name in enumerate(schedule.names):
        at = 0
        while at < totals[name]:
            n = min(random.randint(1, 400), totals[name] - at)
            expected = 0
            for low, count, sequence, offset, _ in schedule.place(queue, at, n, length):
                assert low == expected and offset + count <= length
                seen[sequence * length + offset:sequence * length + offset + count] += 1
                expected += count
            assert expected == n
            at += n
    assert (seen == 1).all()


def test_closed_form_equals_a_simulated_round_robin():
    totals, targets, window = {"a": 900, "b": 5000, "c": 333}, {"a": 0.5, "b": 0.3, "c": 0.2}, 64
    schedule = Schedule(totals, targets, window)
    one = 1 << mixture_pack.FRACTION_BITS
    full = np.array([totals[n] for n in schedule.names])
    deficit, given_, phase = np.zeros(3, object), np.zeros(3, object), 0
    for w in range(int(schedule.begin[-1])):
        if phase + 1 < len(schedule.begin) - 1 and w == schedule.begin[phase + 1]:
            phase += 1
        for q in range(3):  # one visit: add the quantum, give whole tokens, keep the rest
            deficit[q] += int(schedule.quantum[phase, q])
            give = min(deficit[q] // one, int(full[q]) - given_[q])
            given_[q] += give
            deficit[q] -= give * one
        assert schedule.given(np.array([w + 1]))[0].tolist() == list(given_)


def test_windows_hold_the_target_shares():
    schedule = Schedule({"a": 100_000, "b": 100_000}, {"a": 3.0, "b": 1.0}, 1024)
    given_ = schedule.given(np.arange(100))
    assert np.abs(np.diff(given_, axis=0) - [768, 256]).max() <= 1


def test_pieces_rebuild_the_documents(spark):
    rows = [*ODD_ROWS, *[(100 + k, f"text number {k} " * (k % 40), "en", f"s{k % 3}") for k in range(200)]]
    out = mixture_pack.pack(frame(spark, rows, extra=True), window_tokens=4096).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault((r["doc_id"], r["source"]), []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc_id, text, _, source in rows:
        expected = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        copies = sum(1 for x in rows if x[0] == doc_id)
        own = sorted(by_doc[doc_id, source], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == copies * len(expected) == copies * own[0]["doc_tokens"]
        for r in own:
            part = np.array(expected[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
            assert r["ids"] == part and mixture_pack.crc32_of(r["ids"]) == zlib.crc32(part)
    for number, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 1024 or number == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_edges(spark):
    assert mixture_pack.pack(frame(spark, [])).count() == 0
    assert [mixture_pack.padded_length(n) for n in (1, 3, 512, 1000, 1024)] == [1, 1024, 512, 1024, 1024]
    with pytest.raises(ValueError):
        limit, mixture_pack.MAX_SOURCES = mixture_pack.MAX_SOURCES, 1
        try:
            mixture_pack.pack(frame(spark, [(1, "a", "en", "x"), (2, "b", "en", "y")])).count()
        finally:
            mixture_pack.MAX_SOURCES = limit


def test_any_number_of_sources(spark, monkeypatch):
    monkeypatch.setattr(mixture_pack, "QUEUES", 3)
    monkeypatch.setattr(mixture_pack, "BLOCK_CELLS", 16)
    rows = [(k, "some words of a text " * (k % 5 + 1), "en", f"s{k}" if k >= 200 else "ab"[k % 2]) for k in range(10_210)]
    rows += [(k, "rare", "en", "wanted") for k in (20_000, 20_001)]
    for targets in (None, {"wanted": 0.5, "a": 0.5}):
        pieces = mixture_pack.pack(frame(spark, rows), targets, window_tokens=512).collect()
        at, given = 0, {}
        for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["sequence_id"] * 1024 + r["offset"] == at
            at += r["length"]
            given[r["doc_id"]] = given.get(r["doc_id"], 0) + r["length"]
        assert given == {r["doc_id"]: r["doc_tokens"] for r in pieces} and len(given) == len(rows)
        assert {(r["doc_id"], r["source"]) for r in pieces} == {(i, s) for i, _, _, s in rows}
        if targets:
            assert {r["window"] for r in pieces if r["source"] == "wanted"} == {0}
