"""Text operators: document assembly, tokens, stop words, negation binding, phrases, term weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"(<<>>)|\b\w[\w\-']*\b"


def assemble(events: DataFrame, patient: str, day: str, texts: Sequence[str], bins: Sequence[tuple[int, int]]) -> DataFrame:
    """(patient, period, doc_time, doc) of each event in a half-open time bin: its texts joined, weight by recency, 0 for an empty document."""
    from ..functions.scalars import join_text
    from .frames import period_name

    doc = F.trim(join_text(*texts))
    out = None
    for lo, hi in bins:
        w = F.when(doc == "", F.lit(0.0)).otherwise(F.round((F.col(day) - lo + 1).cast("double") / F.lit(float(hi - lo)), 4))
        part = events.where((F.col(day) >= lo) & (F.col(day) < hi)).select(patient, F.lit(period_name(lo, hi)).alias("period"), w.alias("doc_time"), doc.alias("doc"))
        out = part if out is None else out.union(part)
    return out


def tokens(col: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(pattern), F.lit(0))


def _not_like(pattern: str):
    return lambda t: ~t.rlike(pattern)


def drop_stop_words(tok: Column, words: Sequence[str], patterns: Sequence[str] = ()) -> Column:
    out = F.filter(tok, lambda t: ~t.isin(list(words))) if words else tok
    for p in patterns:
        out = F.filter(out, _not_like(p))
    return out


def _bind(tok: Column, modifiers: Sequence[str], mark: str, ahead: bool) -> Column:
    """Marks the word beside each modifier (after a prefix, before a suffix one) and drops the modifiers."""
    mods = list(modifiers)

    def one(x: Column, i: Column) -> Column:
        other = F.get(tok, i + 1 if ahead else i - 1)
        return F.when(~x.isin(mods), F.when(F.coalesce(other.isin(mods), F.lit(False)), F.concat(x, F.lit(mark))).otherwise(x))

    return F.filter(F.transform(tok, one), lambda x: x.isNotNull())


def bind_modifiers(df: DataFrame, col: str, *, neg_prefix: Sequence[str] = (), pos_prefix: Sequence[str] = (), neg_suffix: Sequence[str] = (), pos_suffix: Sequence[str] = ()) -> DataFrame:
    """Negation and affirmation binding on a token column, in four passes."""
    for mods, mark, ahead in ((neg_prefix, "_NEG", False), (pos_prefix, "_POS", False), (neg_suffix, "_NEG", True), (pos_suffix, "_POS", True)):
        if mods:
            df = df.withColumn(col, _bind(F.col(col), mods, mark, ahead))
    return df


# Classes of the additive tokenizer in their order, as (name, token, what is substituted, by what).
CLASSES = (
    ("meta_token", r"<[a-zA-Z]+(?:-[0-9]+)?>", r"<([a-zA-Z]+)(-[0-9]+)?>", "<$1>"),
    ("contraction", r"[a-zA-Z]+'[a-zA-Z]+", r"([a-zA-Z]+)'([a-zA-Z]+)", "$1$2"),
    ("hyphenation", r"[a-zA-Z]+(?:-[a-zA-Z]+)+", r"([a-zA-Z])-([a-zA-Z])", "$1$2"),
    ("number", r"[0-9]*[.,]?[0-9]+", r"[0-9]*[.,]?[0-9]+", "<NUM>"),
    ("punctuation", r"[.,;:!?#$%&*+=~|/\\@^_\"'\[\](){}-]+", r"(?<!\.[a-zA-Z])[.,]+(?![0-9])(?![a-zA-Z]\.)|[;!?]+", "</s>"),
)
WORD = "[a-zA-Z]+"
QUOTES = "[’`]"
SPARE_META = r"(?!\S*>)"
# Dutch words without meaning of their own, and patterns of such words.
STOP_WORDS = """dd daarbij en bij met na van in toch voor de of op door te re nog het als wat een aan links wel is dat naar st al ex dan wil
ik om kan sinds li mg via deze dus tot mijn dr ziekte hr per ze toe uur alleen laten zo mogelijk week wk eigenlijk heel omdat daar veel want vooral af gv
vraag mevrouw mee graag hier anders die maar iets alles soms zijn zelf ook haar ok hun kunnen hebben hem dhr zoon er meer willen minder mw hele hij net
gekregen maken zij doet doen lijkt was zich dit over nl fax code flevohuis koesoebjono vanwege soort zh heer vandaag gaat gaan gegaan""".split()
STOP_PATTERNS = [
    "^.$", r"^\d+.*$", "^perso.+$", "^telefo.+$", "^datum.*$", r"^\w*amstel.*$", "^patient.*$", "^.*nummer.*$", "^ziekenhuis.*$", "^.*afspraak.*$",
    "^.*formulier.*$", "^.*administratie.*$", r"^locatie-\d+$",
]
# Marks that stand alone, and the words they stand for.
SHORTHAND = {"+": "positief", "++": "heel-positief", "+++": "erg-positief", "-": "negatief", "--": "heel-negatief", "---": "erg-negatief"}
# Words that deny or affirm the word behind (prefix) or before them (suffix).
NEG_PREFIX = ["geen", "zonder", "niet", "niets", "nooit", "tegen", "goed_NEG"]
POS_PREFIX = ["goede", "goed"]
NEG_SUFFIX = ["neg", "goed_NEG", "negatief", "heel-negatief", "erg-negatief"]
POS_SUFFIX = ["pos", "goed", "ja", "positief", "heel-positief", "erg-positief"]
# End of the fixed values.


def bind_dutch_modifiers(df: DataFrame, col: str) -> DataFrame:
    """``bind_modifiers`` with the Dutch lists."""
    return bind_modifiers(df, col, neg_prefix=NEG_PREFIX, pos_prefix=POS_PREFIX, neg_suffix=NEG_SUFFIX, pos_suffix=POS_SUFFIX)


def drop_dutch_stop_words(tok: Column) -> Column:
    """Without the fixed words and what the fixed patterns match; patterns are tried as one."""
    any_ = "|".join(f"(?:{p})" for p in STOP_PATTERNS)
    return F.filter(tok, lambda t: ~t.isin(STOP_WORDS) & ~t.rlike(any_))


def spell_out(col: Column) -> Column:
    """Marks between blanks become the words they stand for; runs of blanks become one."""
    words = F.split(col, r"[ \t\n\r\f]+")
    known = F.create_map(*(F.lit(x) for kv in SHORTHAND.items() for x in kv))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")


def additive_tokens(col: Column, substitute: Sequence[str] = (), ignore: Sequence[str] = ()) -> Column:
    """Tokens of all classes and words; null gives none.

    A substituted class is rewritten in the text first (contractions and hyphens are joined,
    a number is ``<NUM>``, an end of a sentence ``</s>``; nothing inside angle marks) and is no
    class of its own then; an ignored one is neither rewritten nor found.
    """
    text = F.regexp_replace(F.coalesce(col, F.lit("")), QUOTES, "'")
    found = []
    for name, token, old, new in CLASSES:
        if name in substitute:
            text = F.regexp_replace(text, f"(?:{old}){SPARE_META}" if "|" not in old else f"{old}{SPARE_META}", new)
        elif name not in ignore:
            found.append(token)
    return F.regexp_extract_all(text, F.lit("|".join([*found, WORD])), F.lit(0))


def simple_tokens(col: Column, least: int = 2, most: int = 15) -> Column:
    """Tags stripped, accents folded, lower case, words of 2 to 15 letters."""
    plain = F.translate(F.lower(F.regexp_replace(col, r"<[^>]*>", " ")), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.regexp_extract_all(plain, F.lit(r"[a-z]+"), F.lit(0)), lambda x: F.length(x).between(least, most))


def vocabulary(docs: DataFrame, tok: str, least: int = 1) -> DataFrame:
    return docs.select(F.explode(tok).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def phrases(docs: DataFrame, tok: str, least: int = 5, threshold: float = 10.0) -> DataFrame:
    """Word pairs by (n_ab - least) * V / (n_a * n_b); pairs are made in the row, so only their counts move."""
    uni = vocabulary(docs, tok)
    size = uni.agg(F.count("*").alias("v")).scalar()
    pairs = F.transform(F.slice(F.col(tok), 2, F.greatest(F.size(tok) - 1, F.lit(0))), lambda y, i: F.struct(F.get(F.col(tok), i).alias("a"), y.alias("b")))
    two = docs.where(F.size(tok) > 1).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    s = two.join(uni.select(F.col("word").alias("a"), F.col("n").alias("n_a")), "a").join(uni.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    s = s.withColumn("score", (F.col("n") - least).cast("double") * size / (F.col("n_a") * F.col("n_b")))
    return s.where(F.col("score") > threshold).select("a", "b", "n", "score")


def sentence_vectors(tokens: DataFrame, key: str, word: str, words: DataFrame, vector: str, normalise_words: bool = True) -> DataFrame:
    """(key, vec, n): mean of the vectors of a text's words, each brought to length 1 first; words without a vector are left out.

    tokens: (key, word), one row a token; words: (word, vector).  Vectors are summed place by
    place in a partial aggregate, so a long text moves one row a place, not its vectors.
    """
    from ..functions.scalars import normalise

    v = normalise(F.col(vector)) if normalise_words else F.transform(vector, lambda x: x.cast("double"))
    known = words.select(F.col(word).alias("_w"), v.alias("_v"))
    rows = tokens.groupBy(key, word).agg(F.count("*").alias("_c")).join(known, F.col(word) == F.col("_w"))
    place = rows.select(key, "_c", F.posexplode("_v").alias("_i", "_x")).groupBy(key, "_i").agg((F.sum(F.col("_x") * F.col("_c")) / F.sum("_c")).alias("_x"), F.sum("_c").alias("_n"))
    return place.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("vec"), F.max("_n").alias("n"))


def topic_terms(rows: DataFrame, topic: str, doc: str, tok: str, weight: str, top: int = 50) -> DataFrame:
    """(topic, word, weight): tf-idf weighted by the document's score, min-max scaled and brought to sum 1 within the topic, best ``top`` words."""
    n = rows.select(doc).distinct().agg(F.count("*").alias("n")).scalar()
    w = rows.select(topic, doc, weight, F.explode(tok).alias("word"))
    df = w.select(doc, "word").distinct().groupBy("word").agg(F.count("*").alias("df"))
    s = w.groupBy(topic, "word").agg(F.sum(weight).alias("tf")).join(df, "word").withColumn("x", F.col("tf") * F.log(n.cast("double") / F.col("df")))
    t = Window.partitionBy(topic)
    s = s.withColumn("x", F.coalesce(F.try_divide(F.col("x") - F.min("x").over(t), F.max("x").over(t) - F.min("x").over(t)), F.lit(0.0)))
    s = s.withColumn("x", F.coalesce(F.try_divide(F.col("x"), F.sum("x").over(t)), F.lit(0.0)))
    return s.withColumn("r", F.row_number().over(t.orderBy(F.desc("x"), "word"))).where(F.col("r") <= top).select(topic, "word", F.col("x").alias("weight"))
