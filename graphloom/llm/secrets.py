"""Secret scan with a randomness test battery (operator 4, DataFrame functions only).

Base spans come from three patterns. Offsets follow from the lengths of what a
pattern matches and of what lies between (``regexp_extract_all`` beside ``split``),
so nothing but built-in functions is needed.

Added spans are long tokens that look drawn at random. A token's encoding
is inferred from its alphabet (hex, base32, base36, alphanumeric, base64) and three
statistics are set against ordinary identifiers and words of its length:

* chi-squared uniformity over the encoding's alphabet (words repeat letters);
* runs of character classes (words change class seldom, random tokens often);
* serial correlation of neighbouring alphabet positions (words stay in a class).

The z-scores are combined (Stouffer) into one p-value. Which p-values count is
settled by false-discovery control (Benjamini-Hochberg) among all tokens of
the corpus in the same stratum of length, over a histogram of p-values: a first
pass counts at most ``strata * bins`` rows, a second pass over the rows applies the
thresholds. No text is shuffled, and no key can be hot: counts combine in the tasks.

Cases: a null text counts as empty; an empty text has no spans and the digest of
the empty string; repeated rows each give a row; an empty table gives no rows;
texts of any length are read whole; a table without candidate tokens adds
nothing; unknown columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: Tokens worth testing: at least 20 characters of base64 (either alphabet), with padding.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
#: (alphabet as a class, size), the first that fits is inferred.
ENCODINGS = (("^[0-9A-F]+=*$|^[0-9a-f]+=*$", 16), ("^[A-Z2-7]+=*$", 32), ("^[a-z0-9]+$|^[A-Z0-9]+$", 36), ("^[A-Za-z0-9]+$", 62), ("", 64))
#: Ordinary identifiers and words: repeat rate and third moment of letters, change rate of classes, serial correlation.
REPEAT, CUBE, CHANGE, SERIAL = 0.066, 0.0056, 0.15, 0.5
FALSE_DISCOVERY = 0.01
STRATA = (20, 24, 32, 48, 96)
BINS = 300

_SPAN = "array<struct<start:int,ord:int,end:int,kind:string>>"


def _spans(text: Column, pattern: str, kind: str, order: int, passes=None) -> Column:
    """Spans of a pattern's matches, leftmost and not overlapping, as an array in order of start."""
    empty = F.array().cast(_SPAN)
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    zipped = F.arrays_zip(matches.alias("m"), gaps.alias("g"))
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["g"])
        end = begin + F.length(pair["m"])
        span = F.struct(begin.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"))
        kept = F.array_append(state["found"], span)
        if passes is not None:
            kept = F.when(passes(pair["m"]), kept).otherwise(state["found"])
        return F.struct(end.alias("at"), kept.alias("found"))

    pairs = F.filter(zipped, lambda p: p["m"].isNotNull())
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda s: s["found"])).otherwise(empty)


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """(all columns, _text, _base): base spans in order of start, then kind."""
    value = F.col("_text")
    whole = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    found = F.concat(
        _spans(value, ASSIGN, "assign", 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12),
        _spans(value, ACCESS, "access", 1),
        _spans(value, HEX, "hex", 2),
    )
    return whole.withColumn("_base", F.array_sort(found))


def _normal_tail(z: Column) -> Column:
    """P(N > z), by a rational approximation (absolute error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    density = 0.3989422804014327 * F.exp(-z * z / 2)
    tail = density * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _uniformity(body: Column, chars: Column, n: Column, k: Column) -> Column:
    """How far chi-squared against a uniform alphabet of k lies below that of ordinary words."""
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(body, c, F.lit(""))), F.lit(2.0)))
    expected = k / n * (n * (n - 1) * REPEAT + n) - n
    spread = k * (n - 1) * F.sqrt(2 * (REPEAT - REPEAT**2) / (n * (n - 1)) + 4 * (n - 2) * (CUBE - REPEAT**2) / (n * (n - 1)))
    return (expected - (k / n * squares - n)) / spread


def _runs(body: Column, n: Column) -> Column:
    """How far the number of class runs lies above that of ordinary words; a capitalised word is one run."""
    collapsed = F.regexp_replace(F.translate(body, _ORDER, _CLASSES), r"(.)\1+", "$1")
    changes = F.length(F.replace(collapsed, F.lit("Aa"), F.lit("a"))) - 1
    return (changes - (n - 1) * CHANGE) / F.sqrt((n - 1) * CHANGE * (1 - CHANGE))


def _serial(chars: Column, n: Column) -> Column:
    """How far the lag-one correlation of alphabet positions lies below that of ordinary words."""

    def correlation(around: Column) -> Column:
        beside = F.zip_with(F.slice(around, F.lit(1), F.size(around) - 1), F.slice(around, F.lit(2), F.size(around) - 1), lambda a, b: a * b)
        return let(_total(F.transform(around, lambda v: v * v)), lambda t: F.when(t > 0, _total(beside) / t).otherwise(F.lit(1.0)))

    values = F.transform(chars, lambda c: F.instr(F.lit(_ORDER), c).cast("double"))
    centred = let(values, lambda v: let(_total(v) / n, lambda mean: F.transform(v, lambda x: x - mean)))
    return (SERIAL - let(centred, correlation)) * F.sqrt(n)


def battery(token: Column) -> Column:
    """Struct of a token's encoding size, number of letters and digits, three z-scores and the p-value."""
    size = F.lit(ENCODINGS[-1][1])
    for shape, k in reversed(ENCODINGS[:-1]):
        size = F.when(token.rlike(shape), F.lit(k)).otherwise(size)
    body = F.regexp_replace(token, "[+/_=-]", "")
    bound = F.struct(body.alias("body"), F.split(body, "").alias("chars"), size.cast("double").alias("k"), F.length(body).cast("double").alias("n"))

    def scores(b: Column) -> Column:
        return F.struct(
            b["k"].cast("int").alias("size"),
            b["n"].cast("int").alias("n"),
            _uniformity(b["body"], b["chars"], b["n"], b["k"]).alias("uniform"),
            _runs(b["body"], b["n"]).alias("runs"),
            _serial(b["chars"], b["n"]).alias("serial"),
        )

    combined = lambda s: s.withField("p", _normal_tail((s["uniform"] + s["runs"] + s["serial"]) / math.sqrt(3)))
    return let(bound, lambda b: let(scores(b), combined))


_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ORDER = _DIGITS + _UPPER + _LOWER
_CLASSES = "0" * 10 + "A" * 26 + "a" * 26


def _mixed(token: Column) -> Column:
    """Sixteen letters and digits of at least two classes (digits, upper case, lower case)."""
    letters = F.length(F.regexp_replace(token, "[+/_=-]", ""))
    return (letters >= 16) & (token.rlike("[0-9]").cast("int") + token.rlike("[A-Z]").cast("int") + token.rlike("[a-z]").cast("int") >= 2)


def _stratum(result: Column) -> Column:
    stratum = F.lit(STRATA[0])
    for low in STRATA[1:]:
        stratum = F.when(result["n"] >= low, F.lit(low)).otherwise(stratum)
    return stratum


def _level(result: Column) -> Column:
    """Ten times -log10 of the p-value, as a whole number up to ``BINS``."""
    return F.greatest(F.lit(0), F.least(F.lit(BINS), F.floor(-10 * F.log10(F.greatest(result["p"], F.lit(1e-300)))))).cast("int")


def with_tokens(based: DataFrame) -> DataFrame:
    """Adds _tokens: candidate spans that meet no base span, each with its stratum and bin of the p-value."""
    value = F.col("_text")
    spans = F.filter(_spans(value, TOKEN, "random", 3, _mixed), lambda t: ~F.exists(F.col("_base"), lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))

    def tested(span: Column) -> Column:
        token = F.substring(value, span["start"] + 1, span["end"] - span["start"])
        return let(battery(token), lambda result: F.struct(span.alias("span"), result.alias("result"), _stratum(result).alias("stratum"), _level(result).alias("level")))

    # the spans and their tests are two steps, so that a test runs once a candidate
    return based.withColumn("_spans", spans).withColumn("_tokens", F.transform("_spans", tested)).drop("_spans")


def discovery_levels(tokens: DataFrame, rate: float = FALSE_DISCOVERY) -> dict[int, int]:
    """Least level (ten times -log10 p) that counts, by stratum; Benjamini-Hochberg over the histogram."""
    counted = tokens.select(F.explode("_tokens").alias("t")).groupBy("t.stratum", "t.level").agg(F.count("*").alias("n")).collect()
    levels = {}
    for stratum in STRATA:
        by_level = {r["level"]: r["n"] for r in counted if r["stratum"] == stratum}
        total, above = sum(by_level.values()), 0
        for level in sorted(by_level, reverse=True):
            above += by_level[level]
            if 10 ** (-level / 10) <= rate * above / total:
                levels[stratum] = level
    return levels


def scan(docs: DataFrame, text: str = "text", rate: float = FALSE_DISCOVERY) -> DataFrame:
    """All columns of ``docs`` with _text, _base (base spans) and _all (base and added spans, in order of start)."""
    tokens = with_tokens(with_base(docs, text))
    levels = discovery_levels(tokens, rate)
    counts = F.lit(False)
    found = F.col("_base")
    if levels:
        least = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])
        counts = lambda t: F.coalesce(t["level"] >= F.element_at(least, t["stratum"]), F.lit(False))
        found = F.array_sort(F.concat("_base", F.transform(F.filter("_tokens", counts), lambda t: t["span"])))
    return tokens.withColumn("_all", found).drop("_tokens")


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts and digest of the base spans, and all spans, of each whole text."""
    found = scan(docs.select("doc_id", text), text)
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *map(count, KINDS),
        F.sha2(joined("_base").cast("binary"), 256).alias("base_sha256"),
        joined("_all").alias("spans"),
    )


def redacted(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by a mark (overlapping spans by one) and n_chars, if there, brought up to date."""
    columns = docs.columns
    # the row goes along as one value, so that no column of it can clash with those of the scan
    found = scan(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(f"`{text}`").alias("_value")), "_value")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(F.col("_text"), state["at"] + 1, span["start"] - state["at"])
        parts = F.when(span["start"] >= state["at"], F.concat(state["parts"], F.array(gap, F.lit(mark)))).otherwise(state["parts"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), parts.alias("parts"))

    def close(state: Column) -> Column:
        return F.concat(F.array_join(state["parts"], ""), F.substring(F.col("_text"), state["at"] + 1, F.length("_text")))

    hit = F.size("_all") > 0
    clean = F.when(hit, F.aggregate("_all", start, step, close)).otherwise(F.col("_value").cast("string"))
    done = found.withColumn("_clean", clean)

    def column(name: str) -> Column:
        value = F.col("_row").getField(name)
        if name == text:
            value = F.col("_clean").cast(docs.schema[name].dataType)
        elif name == "n_chars":
            value = F.when(hit, F.length("_clean").cast(docs.schema[name].dataType)).otherwise(value)
        return value.alias(name)

    return done.select(*map(column, columns))
