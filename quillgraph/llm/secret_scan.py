"""Secret scans on whole texts, with DataFrame functions only.

Base patterns find assignments, access keys and long hex strings.  The method
adds spans that no pattern names: two first-order character Markov models, one
of random strings and one of ordinary runs (identifiers, numbers, dates, rules),
are trained from labelled samples, and a run of ``MIN_RUN`` or more key characters
whose mean log-likelihood ratio per step exceeds a fixed threshold counts as a
secret, if it has ``MIN_KINDS`` different characters.  Runs are sought in what the base spans leave over, so what stands beside
a base span is judged too.  Shorter runs are not judged.

Positions come without any loop over characters: the pieces between matches and
the matches themselves, in turn, make up the text, so running sums of their
lengths give the offsets (in code points).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the base patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

# Runs of key characters that the models judge.
MIN_RUN = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
THRESHOLD = 0.3
# A run of fewer different characters is a rule or a filler.
MIN_KINDS = 6
SAMPLE_TEXTS = 200
RANDOM_SAMPLES, NAME_ORDERS = 3000, 150
# How many unseen steps the share of a character weighs in each context, and what any step is worth at least.
SMOOTHING, EVEN = 4.0, 0.1
# Words of names in code and addresses, besides those of the texts.
NAME_WORDS = """
access account action adapter address admin agent alias array async auth backup balance batch binary block browser buffer build bytes cache
callback channel check class client cluster code column command commit config connection console content context controller cookie count
customer database date debug default delete deploy device digest document domain download driver dynamic edge element email enable engine
error event example exception export factory feature field file filter folder format frame function gateway global graph group handler hash
header health height helper host html http image import index input instance integer interface item javascript job json kernel key label
language layout length level library limit link list local lock login manager map master matrix memory message metadata method metric model
module monitor mutex name network node notify number object offset option order output owner package page parameter parser path payload pixel
player plugin policy pool port prefix process product profile project proxy query queue quick random range record registry release remote
report repository request reset resource response result retry router sandbox schema screen script search section select sequence server
service session setting shadow share signal size socket source stack state static status storage stream string style subject suffix summary
switch symbol sync system table target task template test text thread time title toggle topic trace traffic transaction transfer trigger type
unique unit update upload user utility value vector version video view virtual volume wallet warning watch web widget width window worker
wrapper xml yaml zone
""".split()  # fmt: skip

_PLACE = "array<struct<start:int,end:int,value:string>>"
_CHUNK = 64


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once, also where the body uses it for every entry of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running_sums(steps: Column) -> Column:
    """Sums of the first 1, 2, ... n entries: chunk totals first, then entries within their chunk.

    The work for n entries is n * 32 + (n / 64)^2 / 2 additions, and no array is copied for each entry.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + x)
    some = lambda a, c: F.slice(a, c * _CHUNK + 1, F.lit(_CHUNK))

    def within(own: Column, before: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(own)), lambda i: before + total(F.slice(own, F.lit(1), i)))

    def chunked(own: Column) -> Column:
        chunks = F.sequence(F.lit(0), ((F.size(own) - 1) / _CHUNK).cast("int"))
        return _let(F.transform(chunks, lambda c: total(some(own, c))), lambda sums: F.flatten(F.transform(chunks, lambda c: _let(total(F.slice(sums, F.lit(1), c)), lambda before: _let(some(own, c), lambda part: within(part, before))))))

    return _let(steps, chunked)


def _cut(text: Column, pattern: str, body) -> Column:
    """body(matches, pieces): the matches, and the pieces before, between and after them."""
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: _let(F.split(text, pattern, -1), lambda pieces: body(found, pieces)))


def spans(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches as (start, end, value)."""

    def placed(found: Column, pieces: Column) -> Column:
        steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m))
        return F.zip_with(_running_sums(steps), found, lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("value")))

    return F.when(text.rlike(pattern), _cut(text, pattern, placed)).otherwise(F.array().cast(_PLACE))


def masked(text: Column, pattern: str, holds) -> Column:
    """The text with the matches that hold replaced by as many line feeds."""

    def filled(found: Column, pieces: Column) -> Column:
        return F.array_join(F.zip_with(pieces, found, lambda p, m: F.concat(p, F.coalesce(F.when(holds(m), F.repeat(F.lit("\n"), F.length(m))).otherwise(m), F.lit("")))), "")

    return F.when(text.rlike(pattern), _cut(text, pattern, filled)).otherwise(text)


def _long_enough(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6


def _ranked(found: Column, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def _listed(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(value, random): random strings made by rule, and ordinary runs from rules and from a bounded sample of texts.

    Random strings are base64, alphanumeric, hex and upper-case digests of
    consecutive numbers.  Ordinary runs are the distinct words of about
    ``SAMPLE_TEXTS`` whole texts, chosen by a hash of id and text, alone and joined
    as in snake case, kebab case, camel case and paths; numbers, dates, versions
    and times; and rules of one repeated character.
    """
    spark: SparkSession = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.base64(F.unhex(digest))
    plain64 = F.regexp_replace(b64, "[+/=]", "")
    form = F.col("id") % 5
    value = F.when(form == 0, F.substring(digest, 1, 40)).when(form == 1, F.upper(F.substring(plain64, 1, 32))).when(form == 2, plain64).when(form == 3, F.translate(b64, "+/", "-_")).otherwise(b64)
    random = spark.range(RANDOM_SAMPLES).select(value.alias("value"), F.lit(True).alias("random"))
    i = F.col("id")
    number = F.conv(F.substring(digest, 1, 12), 16, 10)
    day = F.format_string("%04d-%02d-%02d", 1990 + i % 45, 1 + i % 12, 1 + i % 28)
    time = F.format_string("%02d-%02d-%02d", i % 24, i * 7 % 60, i * 11 % 60)
    rules = F.array(number, F.concat(number, F.reverse(number)), F.concat(day, F.lit("T"), time, F.lit("Z")), F.regexp_replace(F.concat(day, time), "-", ""), F.concat_ws("-", F.lit("v"), i % 9, i % 30, i % 12), F.concat_ws("/", 1990 + i % 45, 1 + i % 12, 1 + i % 28))
    made = spark.range(RANDOM_SAMPLES).select(F.explode(rules).alias("value"))
    lines = spark.range(len(ALPHABET)).select(F.repeat(F.substr(F.lit(ALPHABET), (i + 1).cast("int"), F.lit(1)), F.lit(4000)).alias("value"))
    texts = docs.select(F.col(f"`{text_col}`").alias("t"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h")).filter(F.col("t").isNotNull())
    # A cut through a hash of every row: nothing is sorted or gathered, whatever the texts weigh.
    share = min(1.0, SAMPLE_TEXTS / max(docs.count(), 1))
    words = texts.filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(F.array_distinct(F.regexp_extract_all("t", F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("w"))
    joined = F.zip_with(F.col("w"), F.slice(F.col("w"), F.lit(2), F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.array(a, F.concat_ws("_", a, b), F.concat_ws("-", a, b), F.concat(a, F.initcap(b)), F.concat(F.initcap(a), F.initcap(b)), F.concat_ws("/", a, b), F.upper(F.concat_ws("_", a, b)), F.concat(F.upper(a), F.initcap(b)), F.concat(a, b, F.lit("1"))))
    # The name words in so many orders, so that each meets many others.
    named = spark.range(NAME_ORDERS).select(F.transform(F.sequence(F.lit(0), F.lit(len(NAME_WORDS) - 1)), lambda k: F.get(F.lit(NAME_WORDS), F.pmod(k * (2 * i + 1) + i, F.lit(len(NAME_WORDS))).cast("int"))).alias("w")).filter("size(w) > 0")
    plain = words.unionByName(named).select(F.explode(F.flatten(joined)).alias("value"))
    return random.unionByName(made.unionByName(lines).unionByName(plain).filter(F.col("value").isNotNull()).select("value", F.lit(False).alias("random")))


def train(samples: DataFrame) -> np.ndarray:
    """Log ratios of random over ordinary transitions, one for each pair of key characters.

    A step that a model never saw in its context falls back on the share of the
    character in that model.  Only the counts of the pairs, at most the square of
    the alphabet, come to the driver.
    """
    size = len(ALPHABET)
    chars = F.split("value", "")
    pairs = F.zip_with(F.slice(chars, F.lit(1), F.length("value") - 1), F.slice(chars, F.lit(2), F.length("value") - 1), lambda a, b: F.concat(a, b))
    rows = samples.filter(F.length("value") > 1).select("random", F.explode(pairs).alias("pair")).filter(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("random", "pair").count().collect()
    counts = np.zeros((2, size, size))
    for random, pair, n in rows:
        counts[int(random), ALPHABET.index(pair[0]), ALPHABET.index(pair[1])] += n
    share = (counts.sum(1) + 1.0) / (counts.sum((1, 2)) + size)[:, None]
    chance = (1 - EVEN) * (counts + SMOOTHING * share[:, None, :]) / (counts.sum(2, keepdims=True) + SMOOTHING) + EVEN / size
    return np.log(chance[1]) - np.log(chance[0])


def scored(value: Column, ratios: np.ndarray) -> Column:
    """Mean log-likelihood ratio per transition of a run of key characters."""
    size = len(ALPHABET)
    table, places = F.lit(ratios.ravel().astype(float)), F.lit(np.array([ALPHABET.find(chr(c)) for c in range(128)], np.int32))
    n = F.length(value) - 1

    def steps(at: Column) -> Column:
        return F.zip_with(F.slice(at, F.lit(1), n), F.slice(at, F.lit(2), n), lambda a, b: F.get(table, a * size + b))

    return F.aggregate(_let(F.transform(F.split(value, ""), lambda c: F.get(places, F.ascii(c))), steps), F.lit(0.0), lambda acc, x: acc + x) / n


BASE_COLUMNS = ("n_assign", "n_access", "n_hex", "base_sha256")


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, __text, base (ranked spans of the base patterns), their numbers and digest."""
    text = F.col("__text")
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    found = found.withColumns({"assign": F.filter(spans(text, ASSIGN), lambda s: _long_enough(s["value"])), "access": spans(text, ACCESS), "hex": spans(text, HEX)})
    found = found.withColumn("base", F.concat(_ranked(F.col("assign"), "assign"), _ranked(F.col("access"), "access"), _ranked(F.col("hex"), "hex")))
    return found.select(
        "doc_id", "__text", "base",
        F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
    )


def scan(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for every row.

    A null text counts as empty; a text without matches has the digest of the
    empty string and an empty list.  Added spans come from the text with the base
    spans blanked out, one kind after the other.
    """
    text = F.col("__text")
    found = base_spans(docs, id_col, text_col)
    every = lambda _: F.lit(True)
    rest = _let(masked(text, ASSIGN, _long_enough), lambda t: _let(masked(t, ACCESS, every), lambda u: masked(u, HEX, every)))
    random = _let(rest, lambda t: F.filter(spans(t, CANDIDATE), lambda c: (F.size(F.array_distinct(F.split(c["value"], ""))) >= MIN_KINDS) & (scored(c["value"], ratios) > threshold)))
    # Most texts have no long run at all and are not rewritten.
    found = found.withColumn("random", F.when(text.rlike(CANDIDATE), random).otherwise(F.array().cast(_PLACE)))
    return found.select("doc_id", *BASE_COLUMNS, _listed(F.concat("base", _ranked(F.col("random"), "random"))).alias("spans"), F.size("random").cast("long").alias("n_random"))
