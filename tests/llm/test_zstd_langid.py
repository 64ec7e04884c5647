from prefspark.llm import zstd_langid
from llm_fixtures import ODD_ROWS, frame

WORDS = {"en": "the of and that with from this which have there".split(),
         "de": "und der nicht sich auch eine werden schon durch über".split(),
         "fr": "les des une pour dans avec être cette leurs après".split()}


def corpus(n=240):
    import random

    rng = random.Random(5)
    return [(k, " ".join(rng.choices(WORDS[lang], k=rng.randint(8, 60))), lang, "s")
            for k in range(n) for lang in [list(WORDS)[k % 3]]]


def test_held_out_accuracy_and_fold(spark):
    import zlib

    rows = corpus()
    out = {r["doc_id"]: r for r in zstd_langid.identify(frame(spark, rows)).collect()}
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    held = [(out[i]["lang_pred"], lang) for i, _, lang, _ in rows if out[i]["held_out"]]
    assert len(held) > 20 and all(a == b for a, b in held)


def test_labels_of_held_out_rows_are_not_used(spark):
    import zlib

    rows = corpus()
    other = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, "q") for i, t, lang, _ in rows]
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in zstd_langid.identify(frame(spark, rows)).collect()}
    b = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in zstd_langid.identify(frame(spark, other)).collect()}
    assert a == b


def test_odd_rows(spark):
    rows = [*corpus(), *[(1000 + k, t, lang, s) for k, (_, t, lang, s) in enumerate(ODD_ROWS)], (2000, "123 --- 45", "en", "s")]
    out = {r["doc_id"]: r for r in zstd_langid.identify(frame(spark, rows, extra=True)).collect()}
    assert len(out) == len(rows)
    for i in (1000, 1001, 1002, 2000):
        assert out[i]["lang_pred"] == "und" and out[i]["score"] == 0.0
    learned = {*WORDS, "ja"} | {lang for _, _, lang, _ in ODD_ROWS if lang}
    assert all(r["lang_pred"] in learned | {"und"} and 0 <= r["score"] <= 1 for r in out.values())
    assert zstd_langid.identify(frame(spark, [])).count() == 0


def test_without_training_rows(spark):
    out = zstd_langid.identify(frame(spark, [(1, "some text", None, "s")])).collect()
    assert [r["lang_pred"] for r in out] == ["und"]


def test_narrow_margins_are_not_reliable():
    model = {"a": (3, b"the same words here " * 20), "b": (2, b"the same words here " * 20)}
    ordered = tuple((k, n, c) for k, (n, c) in model.items())
    lang, _, reliable = zstd_langid.classify("the same words here again", zstd_langid._compressors(ordered))
    assert lang == "a" and not reliable


def test_every_language_gets_a_dictionary(spark):
    import random

    rng = random.Random(3)

    def text(first, size, words):
        return " ".join("".join(chr(first + rng.randrange(size)) for _ in range(6)) for _ in range(words))

    rows = [(k, text(0x4E00, 40, 1500), "zh", "s") for k in range(8)]  # longer than an excerpt, all of them
    rows += [(100 + k, "7 " * 9000 + text(0x430, 20, 3000), "ru", "s") for k in range(8)]
    once = text(0x61, 20, 60)
    rows += [(200 + k % 4, once, "en", "s") for k in range(3000)]  # many rows, few ids
    rows += [(1000 + 20 * k + j, text(0x3B1, 20, 3), f"x{k:03}", "s") for k in range(510) for j in range(4)]
    docs = frame(spark, rows)
    trained = {r[2] for r in docs.where(~zstd_langid.held_out(docs["doc_id"])).collect()}
    model = zstd_langid.train(docs)
    assert set(model) == trained and {"zh", "ru", "en"} <= trained and len(trained) > 500
    assert all(0 < len(content) <= zstd_langid.DICT_BYTES for _, content in model.values())
    few = {lang: model[lang] for lang in ("zh", "ru", "en")}
    found = zstd_langid.identify(docs.where(docs["lang"].isin(*few)), few)
    assert {r["lang_pred"] for r in found.where("doc_id < 8").collect()} == {"zh"}
    assert {r["lang_pred"] for r in found.where("doc_id >= 100 and doc_id < 108").collect()} == {"ru"}


def test_numbers_are_no_letters_and_marks_stay_with_theirs():
    assert [letters_of(t) for t in ("²³", "½ ⅷ Ⅳ", "12_3", "\u0301\u0301", " \u0301 1", "--")] == [""] * 6
    assert letters_of("\u0301Cafe\u0301 2½ \u0301\u0301x_y हिन्दी!") == "cafe\u0301 x y हिन्दी"


def letters_of(text):
    from prefspark.llm.zstd_langid import letters
    return letters(text)


def test_texts_of_numbers_are_undetermined(spark):
    from prefspark.llm import zstd_langid
    rows = [(k, t, "en", "s") for k, t in enumerate(["²³", "½", "ⅷ", "\u0301", "", None])]
    out = zstd_langid.identify(frame(spark, rows), {"en": (5, b"some words of a language " * 40)}).collect()
    assert {r["lang_pred"] for r in out} == {"und"} and {r["score"] for r in out} == {0.0}


def test_no_dictionary_is_larger_than_its_bound(spark):
    from prefspark.llm import zstd_langid
    rows = [(k, f"{chr(0x430 + k % 30) * 9}слово {k} " * 700, "ru", "s") for k in range(60)] + [
        (100 + k, f"word {k} ab " * 900, "en", "s") for k in range(60)]
    model = zstd_langid.train(frame(spark, rows))
    assert set(model) == {"ru", "en"}
    assert all(0.8 * zstd_langid.DICT_BYTES < len(content) <= zstd_langid.DICT_BYTES for _, content in model.values())
