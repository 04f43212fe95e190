"""The text pipeline: NFC, lower case, tokens, stopwords, stems; and the cleaner for extracted text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simgrove.llm.common import bounded_batches

#: The English stopwords.
STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being
have has had having do does did doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too very
s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn
shan shouldn wasn weren won wouldn
""".split()
WORD = r"[\p{L}\p{N}]+"


def _normaliser(form: str):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def normalise(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else unicodedata.normalize(form, x))

    return normalise


#: Characters that NFC leaves alone wherever they stand (a part of all such).
SETTLED = r"\x00-\x{2ff}\x{370}-\x{373}\x{375}-\x{37d}\x{388}-\x{482}\x{48a}-\x{590}\x{10a0}-\x{10ff}\x{2010}-\x{20cf}\x{2190}-\x{22ff}\x{3001}-\x{3029}\x{3030}-\x{3098}\x{309b}-\x{30ff}\x{3400}-\x{a4cf}\x{ac00}-\x{d7a3}\x{ff00}-\x{ffef}"


def _by_python(text: Column, form: str, settled: str) -> Column:
    """The text in a normal form; those of settled characters don't go through Python, the others some at a time."""
    if spark := SparkSession.getActiveSession():
        bounded_batches(spark)
    # the first pattern is quick and says all of most texts
    first = settled.split("\\x{370}")[0]
    odd = ~text.rlike(f"^[{first}]*+$")
    if first != settled:
        odd = odd & ~text.rlike(f"^[{settled}]*+$")
    return F.coalesce(_normaliser(form)(F.when(odd, text)), text)


def nfc(text: Column) -> Column:
    """NFC."""
    return _by_python(text, "NFC", SETTLED)


def tokens(text: Column) -> Column:
    """Lower-case letter and digit runs without stopwords; order and repeats stay. Null text: no tokens."""
    found = F.regexp_extract_all(F.lower(nfc(F.coalesce(text, F.lit("")))), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda x: ~x.isin(STOPWORDS))


def stemmed(df: DataFrame, key: str = "id", column: str = "tokens") -> DataFrame:
    """(key, tokens) with each token's stem: each distinct token is stemmed once, whatever the size of the corpus."""
    from pyspark.sql.functions import pandas_udf

    from simgrove.functions.porter import stem

    @pandas_udf("string")
    def stems(s: pd.Series) -> pd.Series:
        return s.map(stem)

    spread = df.select(key, F.posexplode(column).alias("pos", "token"))
    known = spread.select("token").distinct().withColumn("stem", stems("token"))
    back = spread.join(known, "token").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stem"))), lambda x: x["stem"]).alias(column))
    return df.select(key).join(back, key, "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))


def clean(text: Column) -> Column:
    """Words broken at line ends joined, NFKC, line breaks and runs of white space to one blank, trimmed."""
    joined = F.regexp_replace(text, r"(\p{L})-[ \t]*\r?\n[ \t]*(\p{L})", "$1$2")
    kept = _by_python(joined, "NFKC", r"\x00-\x7F")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"\r?\n+", " "), r"\s+", " "))


def padded_id(n: Column, total: Column) -> Column:
    """d01, d02, ...: padded to the digits of the total, two at least."""
    return F.concat(F.lit("d"), F.lpad(n.cast("string"), F.greatest(F.lit(2), F.length(total.cast("string"))), "0"))


#: Words that a complete sentence hardly ends with.
CONNECTORS = """
the a an in on at by for with of to from into onto upon under over about between among through during before after and
or but nor so yet because although while if unless this that these those its their his her our your my
""".split()


def trimmed(text: Column) -> Column:
    """Without the control characters and blanks at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def quality_reasons(text: Column, least: int = 500) -> Column:
    """Why an abstract looks cut off: too-short, no-terminal-punctuation, dangling-connector; none if it looks whole."""
    t = trimmed(text)
    # both patterns end with the text and hold no blank: its end is all they need to see
    last = F.lower(F.regexp_extract(F.element_at(F.split(t, r"\s"), -1), r"(\p{L}+)\p{Punct}*$", 1))
    checks = [(F.length(t) < least, "too-short"), ((t != "") & ~F.right(t, F.lit(3)).rlike("[.!?][\"'”’)]?$"), "no-terminal-punctuation"), (last.isin(CONNECTORS), "dangling-connector")]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks]))
