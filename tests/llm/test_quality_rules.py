import random

from gridmark.llm.quality_rules import MIN_WORDS, filter_by_quality, quality_counts


def repeated_words(text):
    words = [w for w in __import__("re").split(r"[ \t-\r]+", text) if w]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({p + k for places in seen.values() if len(places) > 1 for p in places for k in range(8)})


def counts(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.quality for r in quality_counts(rows).orderBy("doc_id").collect()]


def test_repeat_words_equal_brute_force(spark):
    draw = random.Random(4)
    texts = [" ".join(draw.choice("ab") for _ in range(n)) for n in (0, 7, 8, 9, 20, 60, 200)]
    texts += ["a " * 500, "x y z w v u t s " * 3 + "end", "one  two\tthree\n\nfour"]
    assert [c.n_repeat_words for c in counts(spark, texts)] == [repeated_words(t) for t in texts]


def test_counts_of_odd_texts(spark):
    null, empty, lines, symbols = counts(spark, [None, "", "a b\n\nc\na b\n \na b", "#a$ <|>\x0bé"])
    assert (null.n_words, null.word_chars, null.base_failed, null.kept) == (0, 0, True, False)
    assert empty == null
    assert (lines.n_dup_lines, lines.n_lines) == (2, 4)
    assert (symbols.n_symbols, symbols.n_words, symbols.word_chars) == (5, 3, 7)


def test_clean_text_stays_and_columns_survive(spark):
    clean = " ".join(f"the word{i} of" for i in range(MIN_WORDS))
    junk = " ".join(f"w{i}###" for i in range(40))
    rows = [(1, clean, 5, "x"), (1, clean, 5, "x"), (2, junk, 6, "y"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_words int, counts string")
    kept = filter_by_quality(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == sorted([rows[0], rows[1]])
    assert filter_by_quality(df.limit(0)).count() == 0


def test_clean_text_in_other_languages_stays(spark):
    texts = {
        "ru": "Вчера вечером мы долго гуляли по старому городу и говорили о том, как быстро меняется жизнь. Потом пошёл дождь, и нам пришлось вернуться домой.",
        "el": "Χθες το βράδυ περπατήσαμε για πολλή ώρα στην παλιά πόλη και μιλήσαμε για το πώς αλλάζει η ζωή. Μετά άρχισε να βρέχει και γυρίσαμε σπίτι.",
        "pl": "Wczoraj wieczorem długo spacerowaliśmy po starym mieście i rozmawialiśmy o tym, jak szybko zmienia się życie. Potem zaczęło padać, ale nie mieliśmy parasola.",
        "fi": "Eilen illalla kävelimme pitkään vanhassa kaupungissa ja puhuimme siitä, kuinka nopeasti elämä muuttuu. Sitten alkoi sataa, mutta meillä ei ollut sateenvarjoa mukana.",
        "zh": " ".join(f"昨天晚上我们在老城里散步了很久谈论生活变化得多么快第{i}次" for i in "一二三四五六七八九十百千万亿甲乙丙丁戊己庚辛"),
    }
    junk = " ".join(f"keyword{k}xx" for k in "abcdefghijklmnopqrstuvwxyz")
    rows = [(i, t) for i, t in enumerate([*texts.values(), junk])]
    kept = filter_by_quality(spark.createDataFrame(rows, "doc_id int, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(len(texts)))


def test_a_name_or_two_words_rescue_no_soup(spark):
    junk = " ".join(f"keyword{k}xx" for k in "abcdefghijklmnopqrstuvwxyz")
    cyrillic = " ".join(f"слово{k}" for k in "абвгдежзиклмнопрстуфхцчшщэюя")
    named = [(i, t, lang) for i, (t, lang) in enumerate((t, lang) for t in (junk, junk + " ja ei", cyrillic) for lang in ("sw", "xx", "en", None, "DE-at", "fi", "ru"))]
    assert filter_by_quality(spark.createDataFrame(named, "doc_id int, text string, lang string")).collect() == []


def test_prose_stays_by_its_words_or_its_shape(spark):
    swahili = "Watu wengi walikuwa katika mji huo na wao ni wa kabila la pwani, kwa sababu hii walikuwa wakifanya kazi ya uvuvi na biashara za samaki."
    welsh = "Aeth y dyn i'r dref yn y bore, ac yr oedd hi'n oer iawn. Yna daeth y glaw, a bu rhaid iddo fynd adref at ei deulu cyn nos."
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(swahili, "sw"), (swahili, None), (swahili, "xx"), (welsh, "cy"), (welsh, None)])]
    kept = filter_by_quality(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4]


def test_query_equals_its_sql_on_odd_languages(spark, tmp_path):
    import duckdb

    from gridmark.llm.quality_rules import _ORACLE, op8_quality_rules

    draw = random.Random(3)
    pools = ["the of and house tree runs.", "ja ei että talo, puu mutta", "и в не дом, дерево он.", "昨天晚上我们在老城里散步", "xx yy zz qqqq wwww", "y i'r yn dref, ac oer. bu"]
    rows = []
    for i in range(150):
        pool = draw.choice(pools).split() + draw.choice(pools).split()
        rows.append((i, " ".join(draw.choice(pool) for _ in range(draw.randrange(15, 70))), draw.choice([None, "en", "fi", "ru", "xx", "zh", "cy", "de"])))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    result = con.execute(_ORACLE)
    names = [d[0] for d in result.description]
    got = sorted(map(tuple, op8_quality_rules(spark, str(tmp_path)).select(names).collect()))
    assert got == sorted(result.fetchall()) and {r[-1] for r in got} == {True, False}
