"""Text analysis as column expressions over whole texts, and the few operators that need rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline import lexicons as X


def tokens(t: Column) -> Column:
    """Lower-cased runs of letters and numbers."""
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_count(t: Column) -> Column:
    return F.size(tokens(t)).cast("long")


def hits(t: Column, phrases: list[str]) -> Column:
    """How many of the phrases a text contains."""
    return sum((F.when(t.contains(p), 1).otherwise(0) for p in phrases), F.lit(0))


def is_stop(w: Column) -> Column:
    return w.isin(X.STOP_WORDS)


def content_words(t: Column) -> Column:
    return F.filter(tokens(t), lambda w: (F.octet_length(w) > 2) & ~is_stop(w))


def semantic_density(t: Column) -> Column:
    n = F.size(tokens(t))
    return F.when(n > 0, F.size(F.array_distinct(content_words(t))) / n).otherwise(F.lit(0.0))


def top_keywords(docs: DataFrame, key: str, text: str, n: int = 15) -> DataFrame:
    """(key, word, count, score, rank): share of the kept words x earliness x length, ties by word."""
    w = docs.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "word")).where((F.octet_length("word") > 2) & ~is_stop(F.col("word")))
    g = w.groupBy(key, "word").agg(F.count("*").alias("count"), F.min("pos").alias("first"))
    total = F.sum("count").over(Window.partitionBy(key))
    score = F.col("count") / total * (1 / (1 + F.col("first") / 100)) * F.least(F.octet_length("word") / 10, F.lit(1.5))
    g = g.withColumn("score", F.round(score, 9))
    g = g.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "word")))
    return g.where(F.col("rank") <= n).select(key, "word", "count", "score", "rank")


def top_ngrams(docs: DataFrame, key: str, text: str, size: int, n: int = 10) -> DataFrame:
    """(key, ngram, count, rank): phrases without a stop word met at least twice, ties by phrase."""
    d = docs.select(key, tokens(F.col(text)).alias("w")).where(F.size("w") >= size)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - (size - 1)), lambda i: F.slice("w", i, size))
    g = d.select(key, F.explode(F.filter(grams, lambda x: ~F.exists(x, is_stop))).alias("g")).select(key, F.array_join("g", " ").alias("ngram"))
    g = g.groupBy(key, "ngram").agg(F.count("*").alias("count")).where("count >= 2")
    g = g.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), "ngram")))
    return g.where(F.col("rank") <= n)


#: ASCII word boundaries; Java's own know other letters too.
_B, _E = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"


def _bounded(pattern: str) -> Column:
    p = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return F.lit(_B + p + _E)


def people(t: Column) -> Column:
    """Pairs of capitalised words, each once, in order of appearance; the first twenty."""
    return F.slice(all_people(t), 1, 20)


def all_people(t: Column) -> Column:
    found = F.regexp_extract_all(t, _bounded(r"([A-Z][a-z]{1,20}\s+[A-Z][a-z]{1,20})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: ~x.rlike("^(The|This|That) ")))


def suffixed(t: Column, words: list[str], reach: int) -> Column:
    """Capitalised runs that end in one of the words, five a word at most, in order."""
    none = F.array().cast("array<string>")
    # a text without the word is not searched
    each = [F.when(F.contains(t, F.lit(w)), F.slice(F.regexp_extract_all(t, _bounded(rf"([A-Z][A-Za-z\s]{{1,{reach}}}{w})"), F.lit(1)), 1, 5)).otherwise(none) for w in words]
    return F.array_sort(F.array_distinct(F.transform(F.concat(*each), lambda x: F.trim(x))))


def organisations(t: Column) -> Column:
    return suffixed(t, X.ORGANISATIONS, 40)


def places(t: Column) -> Column:
    return suffixed(t, X.PLACES, 30)


def dates(t: Column) -> Column:
    each = [F.slice(F.regexp_extract_all(t, _bounded(p), F.lit(0)), 1, 10) for p in X.DATE_PATTERNS]
    return F.array_sort(F.array_distinct(F.concat(*each)))


def topics(t: Column) -> Column:
    """The three topics with most words in the text, ties by name."""
    low = F.lower(t)
    scored = F.array(*[F.struct((-hits(low, ws)).alias("n"), F.lit(name).alias("name")) for name, ws in X.TOPICS.items()])
    return F.transform(F.slice(F.array_sort(F.filter(scored, lambda x: x["n"] < 0)), 1, 3), lambda x: x["name"])


def classes(t: Column) -> Column:
    low = F.lower(t)
    got = F.array_compact(F.array(*[F.when(hits(low, ws) >= 2, F.lit(name)) for name, ws in sorted(X.CLASSES.items())]))
    return F.when(F.size(got) == 0, F.array(F.lit("general"))).otherwise(got)


def language(t: Column) -> Column:
    """By marks in the first 2,000 characters; ``en`` for short texts and without enough marks."""
    head = F.lower(F.substring(t, 1, 2000))
    counted = [F.struct(F.when(hits(head, marks) >= least, hits(head, marks)).otherwise(0).alias("n"), F.lit(-i).alias("i")) for i, (_, least, marks) in enumerate(X.LANGUAGE_PROFILES)]
    best = F.array_max(F.array(*counted))
    code = F.element_at(F.array(*[F.lit(c) for c, _, _ in X.LANGUAGE_PROFILES]), 1 - best["i"])
    return F.when((F.octet_length(t) < 20) | (best["n"] == 0), F.lit("en")).otherwise(code)


def sentences(t: Column) -> Column:
    """Split at . ! ? before white space; longer than ten bytes."""
    return F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.octet_length(s) > 10)


def plain_sentences(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, r"[.!?]+\s+"), lambda s: F.trim(s)), lambda s: s != "")


def read_words(t: Column) -> Column:
    """White-space fields trimmed of what isn't a letter or number, two bytes or more, lower case."""
    return F.filter(F.transform(F.split(t, r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))), lambda w: F.octet_length(w) >= 2)


def syllables(w: Column) -> Column:
    """Vowel groups, less a silent closing e, one at least."""
    n = F.regexp_count(w, F.lit("[aeiouy]+"))
    n = F.when(w.endswith("e") & (n > 1), n - 1).otherwise(n)
    return F.when(F.octet_length(w) <= 2, F.lit(1)).otherwise(F.greatest(n, F.lit(1)))


def readability(docs: DataFrame, text: str) -> DataFrame:
    """Adds n_sentences, n_words, n_syllables, reading_ease, grade, readability."""
    d = docs.withColumn("_w", read_words(F.col(text))).withColumn("_syl", F.transform("_w", syllables))
    d = d.withColumns({"n_sentences": F.size(plain_sentences(F.col(text))).cast("long"), "n_words": F.size("_w").cast("long"), "n_syllables": F.aggregate("_syl", F.lit(0).cast("long"), lambda a, x: a + x)})
    some = (F.col("n_words") > 0) & (F.col("n_sentences") > 0)
    wps, spw = F.try_divide(F.col("n_words"), F.col("n_sentences")), F.try_divide(F.col("n_syllables"), F.col("n_words"))
    ease = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 206.835 - 1.015 * wps - 84.6 * spw))
    hard = F.try_divide(F.size(F.filter("_syl", lambda x: x >= 3)), F.col("n_words"))
    long_words = F.size(F.filter("_w", lambda w: F.octet_length(w) >= 7))
    score = F.lit(0.5) + ease / 100 * 0.30 + F.when(wps.between(10, 25), 0.15).when((wps < 5) | (wps > 40), -0.10).otherwise(0.0)
    score = score + F.when(hard < 0.15, 0.10).when(hard > 0.30, -0.10).otherwise(0.0) + F.when(F.least(F.lit(1.0), long_words / (F.col("n_words") + 1) * 5) > 0.5, 0.05).otherwise(0.0)
    zero = lambda c: F.when(some, F.round(c, 6)).otherwise(F.lit(0.0))
    return d.withColumns({"reading_ease": zero(ease), "grade": zero(F.greatest(F.lit(0.0), 0.39 * wps + 11.8 * spw - 15.59)), "readability": zero(clamp(score))}).drop("_w", "_syl")


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def citation_score(t: Column) -> Column:
    low = F.lower(t)
    score = F.least(F.regexp_count(t, F.lit("https?://[^\\s<>\"]+")) * 0.05, F.lit(0.30)) + F.least(F.regexp_count(t, F.lit(r"\[\d+\]")) * 0.05, F.lit(0.20))
    score = score + F.least(F.regexp_count(t, F.lit(r"\([A-Z][a-z]+(?:,?\s+(?:19|20)\d{2}|\s+et\s+al\.?)\)")) * 0.05, F.lit(0.20))
    section = low.contains("references\n") | low.contains("bibliography") | low.contains("works cited") | low.contains("sources\n")
    return clamp(score + F.when(section, 0.15).otherwise(0.0) + F.when(hits(low, X.SCHOLARLY) >= 3, 0.15).otherwise(0.0))


def credibility_score(t: Column) -> Column:
    low = F.lower(t)
    return clamp(F.least(hits(low, X.CREDENTIALS) * 0.15, F.lit(0.40)) + F.least(hits(low, X.AFFILIATIONS) * 0.10, F.lit(0.30)) + F.when(hits(low, X.AUTHORITY) > 0, 0.20).otherwise(0.0))


def freshness_score(title: Column, t: Column) -> Column:
    low, head = F.lower(t), F.lower(title)
    timely = hits(low, X.TIME_SENSITIVE) + 2 * hits(head, X.TIME_SENSITIVE)
    lasting = sum((F.when(low.contains(p) | head.contains(p), 1).otherwise(0) for p in X.EVERGREEN), F.lit(0))
    named = F.least(hits(low, X.DATE_WORDS), F.lit(10))
    return clamp(0.5 + F.least(timely * 0.03, F.lit(0.30)) + F.least(named * 0.02, F.lit(0.20)) - F.least(lasting * 0.05, F.lit(0.15)))


def dedup_form(t: Column) -> Column:
    """Lower case, punctuation as space, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}\s]+", " "), r"\s+", " "))


def with_shingles(docs: DataFrame, text: str, size: int = 5) -> DataFrame:
    """Adds form, the normal form, and shingles, the distinct runs of five of its words.

    Shifted copies of the words are zipped; no lambda refers to the word list, so
    that even an inlined expression stays linear in the text.
    """
    d = docs.withColumn("form", dedup_form(F.col(text)))
    d = d.withColumn("_w", F.filter(F.split("form", " "), lambda x: x != ""))
    shifted = F.arrays_zip(*[F.slice("_w", k + 1, F.greatest(F.size("_w"), F.lit(1))).alias(f"w{k}") for k in range(size)])
    runs = F.transform(F.slice(shifted, 1, F.greatest(F.size("_w") - (size - 1), F.lit(1))), lambda x: F.concat_ws(" ", *[x[f"w{k}"] for k in range(size)]))
    return d.withColumn("shingles", F.when(F.size("_w") < size, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))).drop("_w")


def fingerprint(form: Column, shingles: Column) -> Column:
    """Hash of the twenty least shingles; of the normal form when there are none."""
    return F.when(F.size(shingles) == 0, F.sha2(form, 256)).otherwise(F.sha2(F.array_join(F.slice(F.array_sort(shingles), 1, 20), "|"), 256))


def with_fingerprint(docs: DataFrame, text: str) -> DataFrame:
    return with_shingles(docs, text).withColumn("fingerprint", fingerprint(F.col("form"), F.col("shingles")))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def signature(t: Column) -> Column:
    """Every (n/20)-th word, twenty at most."""
    w = tokens(t)
    step = F.greatest(F.floor(F.size(w) / 20), F.lit(1)).cast("int")
    return F.when(F.size(w) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.slice(F.sequence(F.lit(1), F.size(w), step), 1, 20), lambda i: F.element_at(w, i)), " "))


def collapse(t: Column) -> Column:
    return F.regexp_replace(t, "[ \t\n\r]+", " ")


def decay(days: Column, half_life: float) -> Column:
    return F.exp(F.lit(-0.6931471805599453) / F.lit(half_life) * days)


def truncated(t: Column, most: int, reach: int = 20) -> Column:
    """The text, or its first ``most`` characters cut at the last blank of their last ``reach``, and three dots."""
    window = F.substring(t, most - reach + 2, reach)
    blank = F.length(F.regexp_extract(window, "^(.*) [^ ]*$", 1))
    cut = F.when(F.contains(window, F.lit(" ")), F.lit(most - reach + 1) + blank).otherwise(F.lit(most))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, F.lit(1), cut), F.lit("...")))


def surface_words(t: Column) -> Column:
    """Lower-cased runs of letters of three bytes or more."""
    return F.filter(F.split(F.lower(t), r"[^\p{L}]+"), lambda x: F.octet_length(x) >= 3)


def feature_words(t: Column) -> Column:
    """Lower-cased words between white space without the marks about them, of two bytes or more, each once."""
    words = F.transform(F.split(F.lower(t), r"\s+"), lambda x: F.regexp_replace(x, r"^[.,!?;:\"'()\[\]{}]+|[.,!?;:\"'()\[\]{}]+$", ""))
    return F.array_distinct(F.filter(words, lambda x: F.octet_length(x) >= 2))


# Countries of languages spoken mainly in one, and top-level domains that don't spell their country's code.
COUNTRY_OF_LANGUAGE = {"de": "DE", "it": "IT", "nl": "NL", "ru": "RU", "ja": "JP", "zh": "CN", "ko": "KR", "hi": "IN", "tr": "TR", "pl": "PL", "sv": "SE", "da": "DK", "fi": "FI", "hu": "HU", "ro": "RO", "no": "NO"}
TOP_LEVEL = {"uk": "GB", "ac": "SH", "eu": None, "su": None}


def country(domain: Column, language: Column) -> Column:
    """Country of a page: that of a two-letter top-level domain, else of a language spoken mainly in one, else empty."""
    tld = F.regexp_extract(F.lower(domain), r"\.([a-z]{2})$", 1)
    odd = F.create_map(*[F.lit(x) for kv in TOP_LEVEL.items() for x in kv])
    by_name = F.when(tld.isin(list(TOP_LEVEL)), odd[tld]).when(tld != "", F.upper(tld))
    spoken = F.create_map(*[F.lit(x) for kv in COUNTRY_OF_LANGUAGE.items() for x in kv])
    return F.coalesce(by_name, spoken[language], F.lit(""))
