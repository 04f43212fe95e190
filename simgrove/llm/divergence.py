"""Operator 3 [native]: reject documents whose histograms lie far from those of their language.

Two histograms of each text, over character classes and over common words of its language, are held against the
geometric means of all documents in that language by the Jensen-Shannon distance (base 2, the square root: 0 to 1). Texts
under a minimum length carry too little evidence for the distance and are left to the base rules.

Only DataFrame functions run here. Each text is counted once, within its row, so that neither a hot source nor a long
text makes a group; the figures are a table in the shared folder, from which both the references (one mean for each bin
and language, summed on the map side first) and the verdicts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simgrove.llm.common import stored, text_of

#: Frequent words of the languages.
COMMON_WORDS = {
    "en": "the of and to in a is that for with on as was by it be are this at from or an not he".split(),
    "fr": "le la de des les et en un une du que qui pour dans est au par sur pas ce il ne se plus".split(),
    "de": "der die und das den von zu mit ist des nicht ein eine im in sich auf für dem als auch es an er".split(),
    "es": "el la de que y en los se un las con por del su no una para es al lo como más pero sus".split(),
}
#: The language of rows that name none of these.
OTHER = "en"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Classes of a text's characters, white space left out; what none matches is the last bin.
CLASSES = [("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("stop", r"[.,;:!?'\"()\-]+"), ("symbol", r"[\x00-\x7F]+")]

#: Words that the base rule asks for, and from which the distances count.
MIN_WORDS, GUARD_WORDS = 50, 50
#: Largest distance of character classes that passes.
MAX_CHAR_DISTANCE = 0.22
#: From so many words on a text's word distance passes only under this share of that of a text with no listed word.
LIMIT_WORDS, LIMIT_SHARE = 150, 0.9
#: From so many words on a text has at least one listed word of its language.
NONE_WORDS = 80
#: A text is of another language if it has so many more words listed for that one alone than for its own alone.
OTHER_LEAD = 4
BINS = len(CLASSES) + 2
WORD_BINS = max(map(len, COMMON_WORDS.values())) + 1
KINDS = (("c", BINS), ("h", WORD_BINS))
FLOOR = 0.001


def _with_words(df: DataFrame) -> DataFrame:
    """_w (words) and _lang of _t (text, not null) and _lang_in."""
    lang = F.lower(F.coalesce(F.col("_lang_in"), F.lit("")))
    return df.withColumn("_w", F.filter(F.split("_t", SPACE), lambda x: x != "")).withColumn("_lang", F.when(lang.isin(list(COMMON_WORDS)), lang).otherwise(OTHER))


def _among(words: list[str]):
    return lambda x: x.isin(words)


def _histograms(df: DataFrame) -> DataFrame:
    """_n (words), _chars (their characters), _c0.. (shares of character classes), _h0.. (shares of common words)."""
    df = df.withColumn("_n", F.size("_w").cast("long")).withColumn("_bare", F.regexp_replace("_t", SPACE, ""))
    df = df.withColumn("_chars", F.length("_bare").cast("long")).withColumn("_left", F.regexp_replace("_bare", "[a-z]+", ""))
    total = F.greatest(F.col("_chars"), F.lit(1)).cast("double")
    df = df.withColumn("_left_n", F.length("_left")).withColumn("_c0", (F.col("_chars") - F.col("_left_n")) / total)
    for i, (_, pattern) in enumerate(CLASSES, 1):
        df = df.withColumn("_next", F.regexp_replace("_left", pattern, "")).withColumn("_next_n", F.length("_next"))
        df = df.withColumn(f"_c{i}", (F.col("_left_n") - F.col("_next_n")) / total)
        df = df.withColumn("_left", F.col("_next")).withColumn("_left_n", F.col("_next_n"))
    df = df.withColumn(f"_c{BINS - 1}", F.col("_left_n") / total)
    words = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    df = df.withColumn("_list", words[F.col("_lang")])
    df = df.withColumn("_any", F.filter(F.transform("_w", F.lower), _among(sorted({x for v in COMMON_WORDS.values() for x in v}))))
    hits = F.lit(None)
    for k, v in COMMON_WORDS.items():
        hits = F.when(F.col("_lang") == k, F.filter("_any", _among(v))).otherwise(hits)
    df = df.withColumn("_hits", hits)
    df = df.withColumn("_hits_n", F.size("_hits"))
    n = F.greatest(F.col("_n"), F.lit(1)).cast("double")
    for i in range(WORD_BINS - 1):
        df = df.withColumn(f"_h{i}", (F.col("_hits_n") - F.size(F.array_remove("_hits", F.col("_list")[i]))) / n)
    return df.withColumn(f"_h{WORD_BINS - 1}", (F.col("_n") - F.col("_hits_n")) / n)


def _base(df: DataFrame) -> DataFrame:
    """_symbols, _dup_lines, _repeat (words in 3-word windows that occur twice or more)."""
    lines = F.filter(F.split("_t", "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")
    df = df.withColumn("_symbols", F.regexp_count("_t", F.lit(SYMBOLS)).cast("long")).withColumn("_lines", lines)
    df = df.withColumn("_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    at = lambda i: F.get(F.col("_w"), i)
    window = F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("i")))
    df = df.withColumn("_tri", F.when(F.size("_w") >= 3, F.sort_array(window)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, j: F.get(F.col("_tri"), j)["h"] == x["h"]
    again = F.filter("_tri", lambda x, i: F.coalesce(same(x, i + 1), F.lit(False)) | (F.when(i > 0, same(x, i - 1)).otherwise(False)))
    df = df.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["i"])))
    steps = F.transform("_at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get(F.col("_at"), j + 1) - p, F.lit(3))))
    return df.withColumn("_repeat", F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long"))


def _distance(p: list[Column], q: list[Column]) -> Column:
    """Jensen-Shannon distance, base 2."""
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    total = F.lit(0.0)
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        total = total + term(a, m) + term(b, m)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _lead() -> Column:
    """How many more words of _any another language lists alone than the text's own does, over the language with most."""
    lead = F.lit(0)
    for own, mine in COMMON_WORDS.items():
        count = lambda a, b: F.size(F.filter("_any", _among([x for x in a if x not in b])))
        lead = F.when(F.col("_lang") == own, F.greatest(*[count(v, mine) - count(mine, v) for k, v in COMMON_WORDS.items() if k != own])).otherwise(lead)
    return lead


def _own_words() -> Column:
    """Whether the text's words can be those of its language: see LIMIT_WORDS, NONE_WORDS and OTHER_LEAD."""
    none = _distance([F.lit(0.0)] * (WORD_BINS - 1) + [F.lit(1.0)], _cols("_hr", WORD_BINS))
    far = (F.col("_n") >= LIMIT_WORDS) & (F.col("_dh") > LIMIT_SHARE * none)
    return ~(far | ((F.col("_n") >= NONE_WORDS) & (F.col("_hits_n") == 0)) | (F.col("_lead") >= OTHER_LEAD))


def _cols(prefix: str, n: int) -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(n)]


_FIGURES = ["_lang", "_n", "_chars", "_symbols", "_dup_lines", "_repeat", "_hits_n", "_lead", *[f"_{k}{i}" for k, n in KINDS for i in range(n)]]


def figures(df: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """A table of `row` (the kept columns, all if None) and _FIGURES of each row, computed once."""
    own = df.columns if keep is None else keep
    inside = F.struct(*own) if own else F.struct(F.lit(0).alias("_none"))
    rows = df.select(inside.alias("row"), text_of(text).alias("_t"), F.col(lang).cast("string").alias("_lang_in"))
    return stored(_base(_histograms(_with_words(rows))).withColumn("_lead", _lead()).select("row", *_FIGURES))


def references(rows: DataFrame) -> DataFrame:
    """Each language's geometric mean shares over all figures of enough words, scaled to 1: a row for each of the
    languages above. A geometric mean hardly moves for the minority of texts that are junk; FLOOR keeps it off 0."""
    sure = F.col("_n") >= GUARD_WORDS
    logs = [F.avg(F.when(sure, F.log(F.col(f"_{k}{i}") + FLOOR))).alias(f"_{k}l{i}") for k, n in KINDS for i in range(n)]
    refs = rows.groupBy("_lang").agg(*logs)
    for k, n in KINDS:
        total = sum((F.exp(x) for x in _cols(f"_{k}l", n)), F.lit(0.0))
        refs = refs.select("*", *[(F.exp(F.col(f"_{k}l{i}")) / total).alias(f"_{k}r{i}") for i in range(n)])
    return refs.select("_lang", *[f"_{k}r{i}" for k, n in KINDS for i in range(n)])


NEW = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]


def judge(df: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The frame, its columns (the kept ones, all if None), and n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, char_distance, word_distance (null under the guard) and kept.

    Null texts have no words; a null or unknown language counts as `en`; a language of short texts only has no
    reference, and then no distance. Repeated rows are judged each. No rows, no verdicts. A very long text is judged
    whole, in its row. Columns of any name pass through, but those named as the new ones are replaced.
    """
    rows = _judged(figures(df, text, lang, keep))
    own = [c for c in (df.columns if keep is None else keep) if c not in NEW]
    return rows.select(*[F.col("row").getField(c).alias(c) for c in own], *[F.col(f"_new.{n}").alias(n) for n in NEW])


def kept(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that judge() keeps, their columns untouched."""
    return _judged(figures(df, text, lang)).where("_new.kept").select("row.*")


def _judged(rows: DataFrame) -> DataFrame:
    """row and _new, the struct of NEW."""
    rows = rows.join(F.broadcast(references(rows)), "_lang", "left")  # a row for each language listed above
    sure = (F.col("_n") >= GUARD_WORDS) & F.col("_cr0").isNotNull()
    rows = rows.withColumn("_dc", F.when(sure, _distance(_cols("_c", BINS), _cols("_cr", BINS))))
    rows = rows.withColumn("_dh", F.when(sure, _distance(_cols("_h", WORD_BINS), _cols("_hr", WORD_BINS))))
    failed = (F.col("_n") < MIN_WORDS) | (100 * F.col("_repeat") > 50 * F.col("_n"))
    near = F.coalesce((F.col("_dc") <= MAX_CHAR_DISTANCE) & _own_words(), F.lit(True))
    new = [F.col("_n"), F.col("_chars"), F.col("_symbols"), F.col("_dup_lines"), F.col("_repeat"), failed, F.col("_dc"), F.col("_dh"), ~failed & near]
    return rows.select("row", F.struct(*[c.alias(n) for c, n in zip(new, NEW, strict=True)]).alias("_new"))


def op3_language_divergence(spark, sf_dir: str) -> DataFrame:
    """Every document's base figures, distances and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    found = judge(docs, keep=["doc_id"])
    return found.withColumn("char_distance", F.round("char_distance", 6)).withColumn("word_distance", F.round("word_distance", 6))
