"""Quality rules: a threshold table compiled into one projection of ratios, without user functions.

A document's counts come from built-in array and string functions; each rule compares one ratio of counts with its
bounds. Everything is computed within a row: no shuffle, and the longest text costs n log n in its own words.

Rules that know only some languages bind only where they can judge. Stop words are those of English, German, French and
Spanish. A document without enough of them stays if it does not name one of the four and shows itself to be prose: by
function words of another language (its own, if it names one of OTHER_LANGUAGES), by an unspaced script, or, in any other
language or script, by punctuation and short words as prose has them. A name alone exempts nothing. Words of unspaced
scripts have no length bound.

Defined results: a null text counts as empty (no words, so it fails the base rule); ratios over nothing are 0; repeated
rows are judged alike; further columns of the input, also such as are named like the counts, are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.llm.catalogue import query
from gridmark.llm.common import GAPS, bind, fresh, read_table, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is was that for on be with as are it or an by this from at not but have had "
    "der die das und von zu den des dem ein eine mit im nicht ist für auf sich auch als "
    "le la les de et un une que en pour par dans avec est sur au qui il du "
    "el y los del se las para con su al lo como más por una"
).split()


LANGUAGES = ("en", "de", "fr", "es")
# Frequent function words of further languages in Latin script, by language codes.
OTHER_LANGUAGES = {
    ("it",): "il che di della dei delle gli nel per non sono anche più come ma e la un una",
    ("pt",): "os uma não com para dos das ao pela também mais o a e que de do da em um",
    ("nl",): "het een van niet zijn voor met aan ook maar naar wordt de en dat in is",
    ("sv",): "och att det som på är av för inte till har med jag den en ett",
    ("da", "no", "nb", "nn"): "og ikke til af han hun jeg fra ble ved være det som på er en av",
    ("fi",): "ja ei että oli hän mutta kun ovat se myös niin joka ole on",
    ("pl",): "nie się na że jest jak przez ale dla oraz są był które w z i o po to",
    ("cs", "sk"): "je že jsem není jako pro ale jsou také který byl a v na se s",
    ("hu",): "és hogy nem egy az volt csak mint de ez meg a van",
    ("ro",): "și în nu că din care pentru mai sunt este sau de la o cu",
    ("tr",): "ve bir bu için çok ile daha olarak gibi olan değil da de",
    ("id", "ms"): "yang dan di untuk dengan ini itu dari pada tidak adalah ke",
    ("vi",): "và của là không được trong một những người các cho với có",
    ("hr", "bs", "sl", "sr"): "su nije i da koji ali kao biti ili što je u na se za",
    ("lt",): "ir kad yra buvo tai iš su į ne kaip",
    ("lv",): "ir un ka kas no ar par uz bija nav",
    ("et",): "ning oli see mis ta kui aga või ja ei on",
    ("sw",): "na ya wa kwa ni katika za hii cha la watu kuwa",
    ("ca",): "els amb una les però és aquest de la el i que en",
    ("tl",): "ang ng mga sa ay na at ko si",
}
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan")
# A language shows by this many different ones of its words, and by their share of all words in hundredths.
SHOWN_WORDS, SHOWN_SHARE = 3, 5
# Prose in any language: a punctuation mark for so many words, and so many hundredths of short words.
WORDS_A_MARK, SHORT_SHARE = 30, 10
MARKS = ".,;:!?…،؛؟।。、，！？"


@dataclass(frozen=True)
class Rule:
    """Keep a document only if ``low <= ratio <= high``; a missing bound does not bind.

    *unless* names an entry of EXEMPT: documents it holds for pass.
    """

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None
    unless: str | None = None


# Ratios are SQL over the counts below. Bounds are wide: they reject shouting, symbol soup and lists, not prose.
RULES = (
    Rule("mean_word_length", "word_chars / greatest(n_words, 1)", 2.0, 15.0, "unspaced"),
    Rule("symbols_per_word", "n_symbols / greatest(n_words, 1)", None, 0.1),
    Rule("stop_word_share", "n_stop_words / greatest(n_words, 1)", 0.02, None, "foreign"),
    Rule("digit_share", "n_digits / greatest(word_chars, 1)", None, 0.3),
    Rule("repeated_line_share", "n_dup_lines / greatest(n_lines, 1)", None, 0.4),
    Rule("bullet_line_share", "n_bullet_lines / greatest(n_lines, 1)", None, 0.9),
    Rule("ellipsis_line_share", "n_ellipsis_lines / greatest(n_lines, 1)", None, 0.3),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_digits", "n_lines",
          "n_bullet_lines", "n_ellipsis_lines")


def _missing(text: Column, characters: str) -> Column:
    """How many characters of *text* are among *characters*."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _window_hashes(tokens: Column) -> Column:
    whole = F.transform(F.sequence(F.lit(1), F.size(tokens) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(tokens, i, WINDOW)))
    return F.when(F.size(tokens) >= WINDOW, whole).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose 64-bit hash occurs more than once: sort by hash, keep equal neighbours, join spans."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(a: Column) -> Column:
        return F.filter(
            a,
            lambda e, j: F.coalesce(F.get(a, j - 1)["h"] == e["h"], F.lit(False))
            | F.coalesce(F.get(a, j + 1)["h"] == e["h"], F.lit(False)),
        )

    starts = F.array_sort(F.transform(bind(ordered, repeated), lambda e: e["i"]))
    spans = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("end")),
        lambda s, p: F.struct(
            (s["words"] + p + WINDOW - F.greatest(s["end"], p)).alias("words"), (p + WINDOW).alias("end")
        ),
    )["words"]
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), spans).otherwise(F.lit(0))


def _is_stop(word: Column) -> Column:
    return F.lower(word).isin(*STOP_WORDS)


def _counts(df: DataFrame, text: str, out: str) -> DataFrame:
    """*df* with a struct column *out* of COUNTS."""
    parts = fresh("parts", [*df.columns, out])
    value = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(parts, F.struct(words(value).alias("words"), F.split(value, "\n").alias("lines")))
    tokens = F.col(f"`{parts}`.words")
    lines = F.filter(F.col(f"`{parts}`.lines"), lambda x: F.length(F.translate(x, GAPS, "")) > 0)
    df = df.withColumn(
        parts, F.struct(tokens.alias("words"), lines.alias("lines"), _window_hashes(tokens).alias("hashes"))
    )
    lines, hashes = F.col(f"`{parts}`.lines"), F.col(f"`{parts}`.hashes")
    count = {
        "n_words": F.size(tokens),
        "word_chars": F.length(F.translate(value, GAPS, "")),
        "n_symbols": _missing(value, "#*$%&|<>"),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _covered(hashes),
        "n_stop_words": F.size(F.filter(tokens, _is_stop)),
        "n_digits": _missing(value, "0123456789"),
        "n_lines": F.size(lines),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•"))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
    }
    return df.withColumn(out, F.struct(*[count[c].cast("bigint").alias(c) for c in COUNTS])).drop(parts)


def _letters(text: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(text, rf"[^{kind}]", ""))


def _unspaced(text: Column, lang: Column) -> Column:
    """Half of the letters or more are of scripts that put no spaces between words."""
    found = _letters(text, "".join(rf"\p{{Is{s}}}" for s in UNSPACED))
    return (found > 0) & (found * 2 >= _letters(text, r"\p{L}\p{M}"))


def _foreign(text: Column, lang: Column) -> Column:
    """Prose that the stop words cannot judge, by its own words; a name narrows the choice, but exempts nothing."""
    bare = F.transform(words(text), lambda w: F.lower(F.regexp_replace(w, _BORDERS, "")))
    named = F.coalesce(F.regexp_extract(F.lower(lang), "^[a-z]+", 0), F.lit(""))
    codes = [code for group in OTHER_LANGUAGES for code in group]

    def among(tokens: Column, table: str) -> Column:
        return F.filter(tokens, lambda w: w.isin(*table.split()))

    def shown(tokens: Column) -> Column:
        verdict = F.lit(False)
        for group, table in OTHER_LANGUAGES.items():
            found = among(tokens, table)
            enough = (F.size(F.array_distinct(found)) >= SHOWN_WORDS) & (F.size(found) * 100 >= F.size(tokens) * SHOWN_SHARE)
            verdict = verdict | ((named.isin(*group) | ~named.isin(*codes)) & enough)
        return verdict

    def like_prose(tokens: Column) -> Column:
        short = F.filter(tokens, lambda w: (F.length(w) >= 1) & (F.length(w) <= 3))
        return (_missing(text, MARKS) * WORDS_A_MARK >= F.size(tokens)) & (F.size(short) * 100 >= F.size(tokens) * SHORT_SHARE)

    other_script = _letters(text, r"\p{IsLatin}") * 2 < _letters(text, r"\p{L}")
    judged = bind(bare, lambda t: shown(t) | (~named.isin(*codes) | other_script) & like_prose(t))
    return _unspaced(text, lang) | ((~named.isin(*LANGUAGES) | other_script) & judged)


# What stands around the letters of a word.
_BORDERS = r"^[^\p{L}]+|[^\p{L}]+$"
EXEMPT = {"unspaced": _unspaced, "foreign": _foreign}


def compile_rules(rules: Sequence[Rule], counts: str, text: Column, lang: Column) -> Column:
    """One boolean expression over the struct column *counts*; *text* is read again only where a rule would reject."""
    verdict = F.lit(True)
    for rule in rules:
        ratio, passed = _ratio(rule.ratio, counts), F.lit(True)
        if rule.low is not None:
            passed = passed & (ratio >= F.lit(rule.low))
        if rule.high is not None:
            passed = passed & (ratio <= F.lit(rule.high))
        verdict = verdict & (F.when(passed, True).otherwise(EXEMPT[rule.unless](text, lang)) if rule.unless else passed)
    return verdict


def _ratio(sql: str, counts: str) -> Column:
    for name in COUNTS:
        sql = sql.replace(name, f"`{counts}`.`{name}`")
    return F.expr(sql)


def base_failed(counts: str) -> Column:
    n, repeated = F.col(f"`{counts}`.n_words"), F.col(f"`{counts}`.n_repeat_words")
    return (n < MIN_WORDS) | (repeated * 100 > n * MAX_REPEAT_PERCENT)


def quality_counts(df: DataFrame, rules: Sequence[Rule] = RULES, *, text: str = "text", lang: str = "lang", out: str = "quality") -> DataFrame:
    """*df* with a struct column *out*: COUNTS, ``base_failed`` and ``kept``; the language column may be missing."""
    language = F.col(f"`{lang}`").cast("string") if lang in df.columns else F.lit(None).cast("string")
    counts = fresh("counts", [*df.columns, out])
    df = _counts(df, text, counts)
    failed = base_failed(counts)
    fields = [F.col(f"`{counts}`.`{c}`").alias(c) for c in COUNTS]
    kept = ~failed & compile_rules(rules, counts, F.coalesce(F.col(f"`{text}`"), F.lit("")), language)
    return df.withColumn(out, F.struct(*fields, failed.alias("base_failed"), kept.alias("kept"))).drop(counts)


def filter_by_quality(df: DataFrame, rules: Sequence[Rule] = RULES, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of *df* that pass the base rule and *rules*, with the columns of *df*."""
    out = fresh("quality", df.columns)
    one = fresh("one", [*df.columns, out])
    judged = quality_counts(df, rules, text=text, lang=lang, out=out)
    # A filter would be pushed below the counts, which would then be computed anew for every ratio and window.
    kept = F.when(F.col(f"`{out}`.kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return judged.select("*", F.explode(kept).alias(one)).drop(out, one)


def _quoted(items: Sequence[str]) -> str:
    return ", ".join(f"'{i}'" for i in items)


def _shown_sql() -> str:
    """The same tables for the SQL: a case for each language."""
    codes, cases = _quoted([c for group in OTHER_LANGUAGES for c in group]), []
    for group, table in OTHER_LANGUAGES.items():
        found = f"list_filter(bare, lambda x: list_contains([{_quoted(table.split())}], x))"
        cases.append(
            f"((named in ({_quoted(group)}) or named not in ({codes})) and len(list_distinct({found})) >= {SHOWN_WORDS} "
            f"and len({found}) * 100 >= len(bare) * {SHOWN_SHARE})"
        )
    return " or ".join(cases)


_EXEMPTIONS = rf"""
e as (
  select doc_id, text, coalesce(regexp_extract(lower(lang), '^[a-z]+'), '') as named,
         list_transform(w, lambda x: lower(regexp_replace(x, '{_BORDERS}', '', 'g'))) as bare,
         length(regexp_replace(text, '[^\p{{Latin}}]', '', 'g')) * 2 < length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) as other_script,
         length(regexp_replace(text, '[^{"".join(rf"\p{{{x}}}" for x in UNSPACED)}]', '', 'g')) as n_unspaced,
         length(regexp_replace(text, '[^\p{{L}}\p{{M}}]', '', 'g')) as n_marked
  from d
), f as (
  select *, n_unspaced > 0 and n_unspaced * 2 >= n_marked as unspaced,
         length(regexp_replace(text, '[^{MARKS}]', '', 'g')) * {WORDS_A_MARK} >= len(bare)
           and len(list_filter(bare, lambda x: length(x) between 1 and 3)) * 100 >= len(bare) * {SHORT_SHARE} as like_prose
  from e
), exempt as (
  select doc_id, unspaced, unspaced or ((named not in ({_quoted(LANGUAGES)}) or other_script)
         and ({_shown_sql()} or ((named not in ({_quoted([c for g in OTHER_LANGUAGES for c in g])}) or other_script) and like_prose))) as elsewhere
  from f
)"""


_ORACLE = r"""
with d as (
  select doc_id, coalesce(text, '') as text, lang,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents
), windows as (
  select doc_id, i, list_aggregate(w[i : i + 7], 'string_agg', ' ') as gram
  from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)
), repeats as (
  select doc_id, i from windows qualify count(*) over (partition by doc_id, gram) > 1
), spans as (
  select doc_id, least(8, coalesce(lead(i) over (partition by doc_id order by i) - i, 8)) as n from repeats
), covered as (select doc_id, sum(n) as n from spans group by doc_id
), counts as (
  select d.doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
         len(list_filter(w, lambda x: list_contains([STOPS], lower(x)))) as n_stop_words,
         len(regexp_extract_all(text, '[0-9]')) as n_digits, len(l) as n_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*•]'))) as n_bullet_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) as n_ellipsis_lines
  from d left join covered c on d.doc_id = c.doc_id
), EXEMPTIONS
select counts.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words)
         and (word_chars / greatest(n_words, 1) between 2.0 and 15.0 or unspaced)
         and n_symbols / greatest(n_words, 1) <= 0.1 and (n_stop_words / greatest(n_words, 1) >= 0.02 or elsewhere)
         and n_digits / greatest(word_chars, 1) <= 0.3 and n_dup_lines / greatest(n_lines, 1) <= 0.4
         and n_bullet_lines / greatest(n_lines, 1) <= 0.9 and n_ellipsis_lines / greatest(n_lines, 1) <= 0.3 as kept
from counts join exempt on counts.doc_id = exempt.doc_id
""".replace("STOPS", _quoted(STOP_WORDS)).replace("EXEMPTIONS", _EXEMPTIONS)


@query("op8_quality_rules", _ORACLE)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = read_table(spark, sf_dir, "documents")
    judged = quality_counts(docs.select([c for c in ("doc_id", "text", "lang") if c in docs.columns]))
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in shown])
