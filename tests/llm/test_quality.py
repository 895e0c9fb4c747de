import numpy as np
import pytest

from orthostat.llm import quality

COMMON = [("it", w, i) for i, w in enumerate("il la e di che in un una per con del è si da al come".split())] + [("en", w, i) for i, w in enumerate("the of and a in to is that it with".split())]
PROSE = "La terrazza misura dieci metri e copre il pozzo di una casa. Il muro è alto, e la porta si apre con un arco. "
LIST = "\n".join(f"{k};Torre {k};{k * 3}.5;rotta" for k in range(40))


@pytest.fixture(scope="module")
def common(spark):
    return spark.createDataFrame(COMMON, "lang string, word string, word_rank int")


def scored(spark, common, rows):
    df = spark.createDataFrame([(i, t, l, 1.0, "x") for i, t, l in rows], "doc_id long, text string, lang string, z double, flags string")
    return quality.score(quality.text_statistics(df, common))


def corpus():
    rows = [(k, PROSE * (3 + k % 4), "it") for k in range(60)]
    rows += [(100, LIST, "it"), (101, "", "it"), (102, None, None), (103, "#@! " * 200, "it"), (104, PROSE.upper() * 2, "it"), (105, PROSE.replace(" ", "\n") * 3, "de")]
    rows += [(106, (PROSE * 4).encode().decode("latin-1").replace("a", "Ã¡").replace("e", "Ã¨"), "it"), (107, LIST + "\n" + PROSE, "it"), (108, PROSE * 12 + "\n" + LIST[:150], None), (109, "parola " * 20_000, "it"), (110, PROSE.replace(" ", " ​"), "it")]
    return rows


def test_junk(spark, common):
    got = {r["doc_id"] for r in quality.junk(scored(spark, common, corpus())).collect()}
    assert got == {100, 101, 102, 103, 106, 107, 109}


@pytest.mark.parametrize("share", [3, 2, 1])
def test_junk_that_is_common_is_junk(spark, common, share):
    rows = [(k, LIST if k % share == 0 else PROSE * (3 + k % 4), "it") for k in range(60)]
    assert {r["doc_id"] for r in quality.junk(scored(spark, common, rows)).collect()} == {k for k in range(60) if k % share == 0}


@pytest.mark.parametrize("percent", [0, 30, 60, 100])
@pytest.mark.parametrize("langs", [["it"], ["it", "en", None]])
def test_any_share_of_junk_is_found(spark, common, percent, langs):
    rows = [(k, LIST if k * 100 < percent * 60 * len(langs) else PROSE * (3 + k % 4), langs[k % len(langs)]) for k in range(60 * len(langs))]
    want = {k for k, t, _ in rows if t == LIST}
    assert {r["doc_id"] for r in quality.junk(scored(spark, common, rows)).collect()} == want
    one = [(k, LIST if lang == "it" else PROSE * 4, lang) for k, _, lang in rows]  # a whole language
    assert {r["doc_id"] for r in quality.junk(scored(spark, common, one)).collect()} == {k for k, t, _ in one if t == LIST}


def test_stored_profiles_merge_and_score_other_texts(spark, common, tmp_path):
    def statistics(rows):
        return quality.text_statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string"), common)

    for part in range(2):
        rows = [(k, PROSE * (3 + k % 7), "it" if k % 3 else "en") for k in range(part * 100, part * 100 + 100)]
        quality.profiles(statistics(rows)).write.mode("append").parquet(f"file://{tmp_path}/profile")
    stored = spark.read.parquet(f"file://{tmp_path}/profile")
    fresh = [(1, "#@! a " * 60, "it"), (2, "#@! a " * 60, "de"), (3, PROSE * 5, "it")] + [(k, "#@! a " * 60, "it") for k in range(10, 60)]
    got = {r["doc_id"]: r for r in quality.score(statistics(fresh), profile=stored).collect()}
    assert "symbol_ratio" in got[1]["flags"] and "symbol_ratio" in got[2]["flags"] and got[3]["flags"] == []
    assert got[1]["z_symbol_ratio"] == got[2]["z_symbol_ratio"] and got[1]["pct_symbol_ratio"] == 99


def test_half_prose_of_a_mixed_corpus_is_junk(spark, common):
    mixed = LIST[:600] + "\n" + PROSE * 4
    rows = [(k, PROSE * 4 if k % 3 else LIST, "it") for k in range(60)] + [(100, mixed, "it")]
    got = scored(spark, common, rows)
    assert 0.3 <= got.where("doc_id = 100").first()["prose_share"] < 0.5
    assert 100 in {r["doc_id"] for r in quality.junk(got).collect()}


def test_empty_texts_only_are_junk(spark, common):
    rows = [(1, "", "it"), (2, None, None), (3, " \n ", "it"), (4, "", "en")]
    assert {r["doc_id"] for r in quality.junk(scored(spark, common, rows)).collect()} == {1, 2, 3, 4}


def test_statistics_by_hand(spark, common):
    df = spark.createDataFrame([(1, "Il muro, alto.\n\nUna casa 12", "it")], "doc_id long, text string, lang string")
    r = quality.text_statistics(df, common).first()
    assert r["word_count"] == 6 and r["punctuated_lines"] == 0.5 and abs(r["common_words"] - 2 / 6) < 1e-9
    assert abs(r["mean_word_length"] - 19 / 6) < 1e-9 and abs(r["symbol_ratio"] - 2 / 21) < 1e-9


def test_sketches_merge_and_percentiles(spark, common):
    rows = quality.text_statistics(spark.createDataFrame([(k, "parola " * k, "it" if k % 2 else "en") for k in range(1, 201)], "doc_id long, text string, lang string"), common)
    own = quality.profiles(rows)
    every = {r["statistic"]: r for r in quality.centres(quality.merged(own)).collect()}
    assert abs(every["word_count"]["median"] - 100) <= 3
    pct = {r["doc_id"]: r["pct_word_count"] for r in quality.score(rows).collect()}
    assert pct[1] <= 2 and pct[199] >= 97 and abs(pct[101] - 50) <= 3


def test_empty(spark, common):
    assert scored(spark, common, []).count() == 0
    assert quality.junk(scored(spark, common, [(1, "", None)])).count() <= 1


def test_no_text_costs_more_than_it_should():
    t = quality._Tokens(frozenset({"la"}))
    out = quality.statistics_of(["la " * 100_000, "x" * 300_000, None], t)
    assert np.isfinite(out.to_numpy()).all()
