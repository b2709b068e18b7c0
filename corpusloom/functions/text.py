"""Column functions over text: folding, addresses, endings, cues, sentences, feature strings."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space, combining marks and tatweel, letter variants.
SPACE = "[ \\t\\r\\n]+"
MARKS = "[ً-ٰٟۖ-ۭـ]"
MARKS_WIDE = "[ؐ-ًؚ-ْٰـۖ-ۭ]"
MARKS_CORE = "[ً-ْٰـ]"
LETTERS = "[ء-يٱ]"
# Preset → (characters dropped, letters replaced, their replacements).
FOLDS = {
    "search": (MARKS, "أإآٱىؤئة", "اااايويه"),
    "forms": (MARKS_WIDE, "أإآٱىؤئة", "اااايويه"),
    "lexicon": ("[ً-ْـٰ \\t\\r\\n]", "أإآىة", "ااايه"),
    "quote": (
        "[ً-ٓـٰۡۖ-ۙۚۛۜء]",
        "ٱأإآىةؤئ",
        "اااايهوي",
    ),
    "latin": ("[^a-z0-9äêèéüöçñíóßáàâúùîïôëœ]+", "äêèéüöçñíóßáàâúùîïôë", "aeeeuocniosaaauuiioe"),
}


def strip_marks(c: Column, marks: str = MARKS) -> Column:
    """Text without combining marks and tatweel."""
    return F.regexp_replace(c, marks, "")


def fold(c: Column, preset: str = "search") -> Column:
    """One skeleton per group of letter variants."""
    drop, src, dst = FOLDS[preset]
    return F.translate(F.regexp_replace(F.lower(c), drop, ""), src, dst)


def strip_article(c: Column, min_left: int = 2) -> Column:
    """Drop the article with an optional proclitic unless too little is left."""
    bare = F.regexp_replace(F.trim(c), "^[وفبكل]?ال", "")
    return F.when(F.length(bare) >= min_left, bare).otherwise(F.trim(c))


def ascii_digits(c: Column) -> Column:
    return F.translate(c, "٠١٢٣٤٥٦٧٨٩", "0123456789")


def address(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def address_part(c: Column, i: int) -> Column:
    return F.split(c, ":").getItem(i).cast("int")


def sort_key(c: Column) -> Column:
    """Order by numbers, never by the text of an address."""
    return F.transform(F.split(c, ":"), lambda x: x.cast("int"))


def range_units(c: Column) -> Column:
    """Array of positions named by ``g:a`` or ``g:a-b``."""
    a = F.regexp_extract(c, "^[0-9]+:([0-9]+)", 1).cast("int")
    b = F.regexp_extract(c, "^[0-9]+:[0-9]+-([0-9]+)$", 1)
    return F.sequence(a, F.when(b != "", b.cast("int")).otherwise(a))


def clean_quoted(c: Column) -> Column:
    """Drop footnotes, bracketed citations, paragraph bars and quotation brackets."""
    c = F.regexp_replace(c, "\\[\\[[^\\]]*\\]\\]", " ")
    c = F.regexp_replace(c, "\\[[^\\]]*\\]", " ")
    c = F.regexp_replace(c, "\\|", " ")
    c = F.regexp_replace(c, "[﴿﴾]", "")
    return F.trim(F.regexp_replace(c, SPACE, " "))


def strip_html(c: Column) -> Column:
    c = F.regexp_replace(c, "<br[ ]*/?>", " ")
    c = F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), "&nbsp;", " ")
    return F.trim(F.regexp_replace(c, SPACE, " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def folded_words(c: Column, preset: str = "latin") -> Column:
    """Array of struct(surface, fold): the words of a text and the fold of each.

    The text is folded whole, with its white space left in place, so that both
    sides have the same pieces; a fold per word would run its pattern once for
    every column that reads it.
    """
    gap = "[ \\t\\r\\n]"
    pieces = F.arrays_zip(F.split(c, gap).alias("surface"), F.split(_folded_text(c, preset), gap).alias("fold"))
    return F.filter(pieces, lambda p: p["surface"] != "")


def _folded_text(c: Column, preset: str) -> Column:
    """The fold of a whole text, with its white space left in place."""
    drop, src, dst = FOLDS[preset]
    if not drop.startswith("[^"):
        raise ValueError("only a preset that names the letters it keeps leaves white space alone")
    return F.translate(F.regexp_replace(F.lower(c), drop.replace("]", " \\t\\r\\n]"), ""), src, dst)


def folds(c: Column, preset: str = "latin") -> Column:
    """Array of the folds of the words of a text, without empty ones."""
    return F.filter(F.split(_folded_text(c, preset), SPACE), lambda w: w != "")


def ending(c: Column, n: int = 1) -> Column:
    """Last ``n`` letters of the last word; empty text gives an empty ending."""
    last = F.coalesce(F.try_element_at(words(c), F.lit(-1)), F.lit(""))
    return F.when(F.length(last) < n, last).otherwise(F.substring(last, -n, n))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def letter_count(c: Column, letters: str) -> Column:
    return F.length(F.regexp_replace(c, letters.replace("[", "[^", 1), ""))


def excerpt(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def starts_with_any(c: Column, cues: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(x) for x in cues]), lambda x: F.startswith(c, x))


def tail_has_any(c: Column, cues: Sequence[str], tail: int = 60) -> Column:
    end = F.when(F.length(c) > tail, F.substring(c, -tail, tail)).otherwise(c)
    return F.exists(F.array(*[F.lit(x) for x in cues]), lambda x: F.contains(end, x))


def all_words_in(q: Column, hay: Column) -> Column:
    """Every query word occurs in the haystack; a blank query matches."""
    return F.forall(words(q), lambda w: F.contains(hay, w))


def title_score(title: Column, query: Column, stop: Sequence[str]) -> Column:
    """Hits of the query's content words in a title; null below min(2, n) hits."""
    toks = F.filter(words(query), lambda w: (F.length(w) >= 2) & ~w.isin(*stop))
    hits = F.size(
        F.filter(
            toks,
            lambda w: F.contains(title, w) | (F.startswith(w, F.lit("و")) & F.contains(title, F.substr(w, F.lit(2)))),
        )
    )
    return F.when((hits > 0) & (hits >= F.least(F.lit(2), F.size(toks))), hits)


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


# White space as Python strips it; characters that NFC may change
# or join with the one before: marks, jamo, blocks with single replacements and
# what this Java does not know yet.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
UNSETTLED = (
    "[\\p{M}\\p{Cn}\\u0340-\\u0387\\u0958-\\u0fff\\u1000-\\u11ff\\u1b00-\\u1bff\\u1f00-\\u1fff\\u2000\\u2001\\u2126\\u212a\\u212b\\u2329\\u232a"
    "\\u2adc\\u3099\\u309a\\uf900-\\ufaff\\ufb1d-\\ufb4f\\x{10000}-\\x{10ffff}]"
)


def normalise_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NFC and trim.  Spark has no NFC function; only texts with a character that
    NFC may change go to Python, by Arrow batches."""
    out = df
    for c in cols:
        bare = F.btrim(c, F.lit(WHITE))
        late = bare.rlike("[^\\u0000-\\u02ff]") & bare.rlike(UNSETTLED)  # the first is the quick one
        out = out.withColumn(c, F.coalesce(_nfc(F.when(late, bare)), bare))
    return out


def letters_table(df: DataFrame, text: str, letters: str) -> DataFrame:
    """One row per letter of the wanted class with its 1-based position."""
    chars = df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(text, "")).alias("p", "letter"))
    return chars.filter(F.col("letter").rlike(f"^{letters}$")).withColumn("pos", F.col("p") + 1).drop("p")


def chunk_text(c: Column, max_words: int = 400, target: int = 330) -> Column:
    """Array of chunks cut at sentence ends; short text stays whole."""
    sentences = F.split(c, "(?<=[.؟!:])[ \\t\\r\\n]+")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("n"))

    def step(acc, s):
        n = F.size(F.split(s, SPACE))
        full = (acc["n"] + n > target) & acc["cur"].isNotNull()
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
            F.when(full | acc["cur"].isNull(), s).otherwise(F.concat_ws(" ", acc["cur"], s)).alias("cur"),
            F.when(full, n).otherwise(acc["n"] + n).alias("n"),
        )

    packed = F.aggregate(sentences, start, step, lambda acc: F.array_append(acc["done"], acc["cur"]))
    return F.when(F.size(F.split(c, SPACE)) <= max_words, F.array(c)).otherwise(packed)


def chunk_refs(df: DataFrame, ref: str, text: str, max_words: int = 400, target: int = 330) -> DataFrame:
    """Rows (ref, part, parts, text); the reference of a split text carries its number."""
    cut = df.withColumn("_c", chunk_text(F.col(text), max_words, target)).withColumn("parts", F.size("_c"))
    rest = [c for c in df.columns if c not in (ref, text)]
    out = cut.select(*rest, F.col(ref).alias("_r"), "parts", F.posexplode("_c").alias("_i", text))
    label = F.when(F.col("parts") == 1, F.col("_r").cast("string")).otherwise(
        F.concat(F.col("_r").cast("string"), F.lit(" — "), (F.col("_i") + 1).cast("string"), F.lit("/"), F.col("parts").cast("string"))
    )
    return out.select(*rest, label.alias(ref), (F.col("_i") + 1).alias("part"), "parts", text)


# Tag priority and tag groups of the annotation scheme.
POS_PRIORITY = (
    "PN ADJ NV PRON DEM REL T LOC INL DET CONJ SUB EMPH PRP DIST ADDR VOC NEG COND INTG ACC AMD ANS ATT AVR CAUS "
    "CERT CIRC COM EQ EXH EXL EXP FUT INC INT PREV PRO REM RES RET RSLT SUP SUR"
).split()
ASPECTS = ["PERF", "IMPF", "IMPV"]
CASES = ["NOM", "ACC", "GEN"]
DERIVATIONS = ["ACT_PCPL", "PASS_PCPL", "VN"]


def decode_features(df: DataFrame, cls: str, feats: str) -> DataFrame:
    """Typed columns of an ``A|B|K:V`` feature string; the rules depend on the class.

    Shared pieces are columns of an inner projection, so each is computed once.
    """
    c = F.col(cls)
    parts = F.filter(F.transform(F.split(F.col(feats), "\\|"), lambda x: F.trim(x)), lambda x: x != "")
    df = df.withColumn("_parts", parts)
    df = df.withColumn("_bare", F.filter("_parts", lambda x: ~F.contains(x, F.lit(":"))))
    bare = F.col("_bare")

    def tags(names):
        return F.array(*[F.lit(n) for n in names])

    def has(tag):
        return F.array_contains(bare, tag)

    def keyed(name):
        # a repeated key keeps its last value
        hit = F.filter("_parts", lambda x: F.startswith(x, F.lit(name + ":")))
        return F.substr(F.try_element_at(hit, F.lit(-1)), F.lit(len(name) + 2))

    def last_of(names):
        # bare tags in their own order, so the last one written wins
        return F.try_element_at(F.filter(bare, lambda x: x.isin(*names)), F.lit(-1))

    # ACC marks case except on particles; a bare P on a particle is no number
    fine = F.when(c == "P", F.array_intersect(tags(POS_PRIORITY), bare)).otherwise(
        F.array_intersect(tags([p for p in POS_PRIORITY if p != "ACC"]), bare)
    )
    agreement = F.filter(bare, lambda t: t.rlike("^([123])?(M|F)?(S|D|P)?$") & ~((t == "P") & (c == "P")))
    df = df.withColumns({"_fine": fine, "_agree": agreement})

    def mark(pattern):
        hits = F.filter(F.transform("_agree", lambda t: F.regexp_extract(t, pattern, 1)), lambda x: x != "")
        return F.try_element_at(hits, F.lit(-1))

    whole = F.when(c == "P", F.when(has("IMPV"), F.lit("IMPV_LAM")).otherwise(F.lit("P"))).otherwise(c)
    out = {
        "role": F.when(has("PREF"), F.lit("prefix")).when(has("SUFF"), F.lit("suffix")).otherwise(F.lit("stem")),
        "pos": F.coalesce(F.try_element_at("_fine", F.lit(1)), whole),
        "root": keyed("ROOT"),
        "lemma": keyed("LEM"),
        "verb_form": keyed("VF").try_cast("int"),
        "aspect": F.when((c == "V") | has("NV"), last_of(ASPECTS)),
        "mood": keyed("MOOD"),
        "voice": F.when(c == "V", F.when(has("PASS"), F.lit("PASS")).otherwise(F.lit("ACT"))),
        "case_mark": F.when(c != "P", last_of(CASES)),
        "state": F.when(has("INDEF"), F.lit("INDEF")),
        "person": mark("^([123])").try_cast("int"),
        "gender": mark("^[123]?([MF])"),
        "number": mark("^[123]?[MF]?([SDP])$"),
        "derivation": last_of(DERIVATIONS),
        "family": keyed("FAM"),
    }
    return df.withColumns(out).drop("_parts", "_bare", "_fine", "_agree")


def spelling_variants(key: Column) -> Column:
    """Spellings to try, best first: as is, folded, weak or hamza end changed, doubled letter collapsed."""
    folded = F.translate(key, "أإآ", "ااا")
    cut = lambda b: F.substr(b, F.lit(1), F.length(b) - 1)
    options = [key, folded]
    for base in (key, folded):
        weak = F.substring(base, -1, 1).isin("و", "ي")
        options += [
            F.when(weak, F.concat(cut(base), F.lit("ا"))),
            F.when(weak, F.concat(cut(base), F.lit("ى"))),
            F.when(F.endswith(base, F.lit("ء")), F.concat(cut(base), F.lit("أ"))),
        ]
    options.append(
        F.when((F.length(key) == 3) & (F.substring(key, 2, 1) == F.substring(key, 3, 1)), F.substring(key, 1, 2))
    )
    return F.filter(F.array_distinct(F.array(*options)), lambda x: x.isNotNull() & (x != ""))


def sentences(c: Column, stops: str = ".؛") -> Column:
    """Sentences with their closing mark; a trailing piece without one is kept."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(f"[^{stops}]*[{stops}]|[^{stops}]+$"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def contrast_sentences(c: Column, trigger: str, reject: str, low: int = 18, high: int = 420, most: int = 3) -> Column:
    """Up to ``most`` distinct sentences with a trigger phrase, of quotable length, no fragments."""
    keep = F.filter(
        sentences(clean_quoted(c)),
        lambda s: s.rlike(trigger) & F.length(s).between(low, high) & ~s.rlike(reject) & ~s.rlike("[\\[\\]|]"),
    )
    return F.slice(F.array_distinct(keep), 1, most)


# Delimiter patterns of quotations, in the order they are tried.
QUOTE_PATTERNS = [
    "﴿([^﴾]{6,300})﴾",
    "@QB@([^@]{6,300})@QE@",
    "\\{([^}]{6,300})\\}",
    '"([^"]{6,200})"',
    "\\(([^)]{6,200})\\)",
]


def quoted_spans(c: Column, patterns: Sequence[str] = QUOTE_PATTERNS) -> Column:
    return F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in patterns])


WEAK = "اوي"


def weak_distance(a: Column, b: Column, weak: str = WEAK) -> Column:
    """Edit distance in which weak letters swap for 0.3 and come or go for 0.5.

    One dynamic-programming row is folded over the letters of ``a``.
    """
    bs = F.split(b, "")
    bs = F.filter(bs, lambda x: x != "")
    as_ = F.filter(F.split(a, ""), lambda x: x != "")

    def is_weak(ch):
        return ch.isin(*list(weak))

    def cost(ch):
        return F.when(is_weak(ch), F.lit(0.5)).otherwise(F.lit(1.0))

    # the first row and column count letters, as the plain distance does
    first = F.transform(F.sequence(F.lit(0), F.size(bs)), lambda j: j.cast("double"))

    def row(prev, ca):
        seed = F.struct(F.array(prev["row"][0] + F.lit(1.0)).alias("r"), F.lit(1).alias("j"))

        def cell(acc, cb):
            j = acc["j"]
            sub = F.when(ca == cb, F.lit(0.0)).when(is_weak(ca) & is_weak(cb), F.lit(0.3)).otherwise(F.lit(1.0))
            best = F.least(
                F.get(prev["row"], j - 1) + sub,
                F.get(prev["row"], j) + cost(ca),
                F.get(acc["r"], j - 1) + cost(cb),
            )
            return F.struct(F.array_append(acc["r"], best).alias("r"), (j + 1).alias("j"))

        return F.struct(F.aggregate(bs, seed, cell, lambda acc: acc["r"]).alias("row"))

    return F.aggregate(as_, F.struct(first.alias("row")), row, lambda acc: F.element_at(acc["row"], -1))


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often a lambda inside reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
