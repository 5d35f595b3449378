from gridmark.llm.license_scan import NOTICES, license_scan


def test_notices_phrases_and_odd_texts(spark):
    texts = [
        None,
        "",
        "Released under the MIT License.",
        "we like the mit-license and the MIT   license",
        "Licensed under CC BY-NC 4.0.",
        "licensed cc under nc by",
        "x " + NOTICES[2].text + " y. This work is licensed under the GNU General Public License, version 3.",
        "apache license " * 300,
        "éMIT license mitlicense",
    ]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(2, texts[2], "n"), (None, texts[4], "n")]
    got = license_scan(spark.createDataFrame(rows, "doc_id int, text string, tokens string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[0].n_words, by[0].n_base, by[0].first_word, by[0].labels, by[0].score) == (0, 0, None, "", 0.0)
    assert by[1][1:] == by[0][1:]
    assert (by[2].n_base, by[2].first_word, by[2].base_labels, by[2].labels, by[2].score) == (1, 3, "mit", "mit", 1.0)
    assert (by[3].n_base, by[3].first_word, by[3].last_word) == (2, 3, 7)
    assert (by[4].labels, by[4].base_labels) == ("cc-by-nc", "")
    assert by[5].labels == ""
    assert by[6].labels == "gpl,mit" and by[6].base_labels == "gpl"
    assert (by[7].n_base, by[7].last_word) == (300, 598)
    assert by[8].n_base == 0
    assert by[None].labels == "cc-by-nc"
    assert sum(r.doc_id == 2 for r in got) == 2


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan(empty).collect() == []
