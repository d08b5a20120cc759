"""Secret scans: patterns, and character Markov models of random strings and of ordinary identifiers (operator 12).

DataFrame operations only.  Three patterns find assignments, access keys and long hexadecimal numbers.  The models are first-order
Markov chains over ALPHABET.  Their labelled samples are the corpus itself, all of it: strings that the patterns found (random) and the
identifiers of IDENTIFIER characters or more that stand elsewhere (ordinary).  Only the counts of character pairs, at most
66 x 66 a model, reach the driver.  A string of CANDIDATE characters or more, with a letter among them, is a secret too (kind ``random``) if the random
model is likelier by MARGIN thousandths of a nat for each pair.  Such a span may lie in one of a pattern's.

The random model is trained half and half: one half are the sample's pairs, the other all pairs alike, so that a
corpus with only hexadecimal secrets doesn't make it blind to others.  Where a model has seen a character little, it backs off to how often the
next one comes after any (as BACKING further pairs would).  Weights are whole thousandths of a nat, so scores are exact sums.

Places count code points.  They are running sums of the lengths of matches and of what stands between them, taken in blocks, so that
a long text with many matches stays nearly linear.  A scan counts pairs, another finds spans; rows are not shuffled.

Defined results: a null text counts as empty and has no spans; a null doc_id is a row like any other; repeated rows get the
same result each; an empty table gives an empty result; without identifiers the models don't differ and nothing is added; other
columns are ignored.
"""

from __future__ import annotations

import json
import math
import string
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Kinds and patterns (fixed values).  A match of ACCESS or HEX takes all characters that may follow, so the least lengths can stand in the patterns:
#: any later start within a match that is too short would be shorter.  An assignment's value is measured after it has been matched.
KEYWORDS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token"))
ASSIGN = rf"({KEYWORDS}|{either_case('api')}_?{either_case('key')})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6

ALPHABET = string.ascii_letters + string.digits + "+/_-"
TOKEN = "[A-Za-z0-9+/_-]"
CANDIDATE = 16
IDENTIFIER = 6
SMOOTHING = 0.5
BACKING = 10
MARGIN = 700
BLOCK = 256


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """An array of (gap: code points before the match and after the one before, size: of the match, value: the group)."""
    found = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(F.char_length(p).alias("gap"), m.alias("match")))
    values = found if group == 0 else F.zip_with(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda f, v: F.struct(f["gap"].alias("gap"), f["match"].alias("match"), v.alias("value")))
    value = "match" if group == 0 else "value"
    sized = F.transform(values, lambda f: F.struct(f["gap"].alias("gap"), F.char_length(f["match"]).alias("size"), f[value].alias("value")))
    found = F.filter(sized, lambda f: f["size"].isNotNull())
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast("array<struct<gap:int,size:int,value:string>>"))


def placed(name: str, kind: int, keep) -> Column:
    """Spans (start, kind, end) of the matches in a column, where keep(value) holds.

    The column is named twice, so Spark keeps the projection that computes it."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(name) - 1) / BLOCK)), lambda b: F.slice(name, (b * BLOCK + 1).cast("int"), BLOCK))
    width = lambda m: m["gap"].cast("long") + m["size"]
    ends = lambda block, at: F.aggregate(block, F.array(at), lambda a, m: F.array_append(a, F.element_at(a, -1) + width(m)))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    spans = lambda block, at: F.zip_with(block, F.slice(ends(block, at), F.lit(1), F.size(block)), lambda m, e: F.struct(
        (e + m["gap"]).alias("start"), F.lit(kind).alias("kind"), (e + width(m)).alias("end"), m["value"].alias("value")))
    step = lambda acc, block: F.struct((acc["at"] + F.aggregate(block, F.lit(0).cast("long"), lambda s, m: s + width(m))).alias("at"), F.concat(acc["out"], spans(block, acc["at"])).alias("out"))
    all_ = F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    kept = F.transform(F.filter(all_, lambda s: keep(s["value"])), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.when(F.size(name) > 0, kept).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))


def pair_counts(docs: DataFrame) -> DataFrame:
    """(random, pair, n): how often two characters follow each other in the strings the patterns found and in other identifiers."""
    text = text_or_empty()
    any_ = f"{ASSIGN}|{ACCESS}|{HEX}"
    values = lambda p, g: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    long_ = F.flatten(F.transform(F.concat(values(ASSIGN, 2), values(ACCESS, 0), values(HEX, 0)), lambda v: F.regexp_extract_all(v, F.lit(f"{TOKEN}{{{CANDIDATE},}}"), F.lit(0))))
    secret = F.when(F.rlike(text, F.lit(any_)), long_).otherwise(F.array().cast("array<string>"))
    rest = F.when(F.rlike(text, F.lit(any_)), F.regexp_replace(text, any_, " ")).otherwise(text)
    words = F.regexp_extract_all(rest, F.lit(f"{TOKEN}{{{IDENTIFIER},}}"), F.lit(0))
    both = docs.select(F.explode(F.array(F.struct(F.lit(True).alias("random"), secret.alias("words")), F.struct(F.lit(False).alias("random"), words.alias("words")))).alias("s"))
    words = both.select("s.random", F.explode("s.words").alias("word")).where(F.rlike("word", F.lit("[A-Za-z]")))
    # places are exploded and pairs cut from them: Spark compiles that, while a lambda would make objects of every pair, which fill an executor's heap
    places = words.select("random", "word", F.explode(F.sequence(F.lit(1), F.char_length("word") - 1)).alias("i"))
    return places.groupBy("random", F.substr("word", F.col("i"), F.lit(2)).alias("pair")).agg(F.count("*").alias("n"))


def pair_weights(counts: list[tuple[bool, str, int]]) -> list[int]:
    """Thousandths of a nat by which a pair is likelier in random strings: at (1 + place of first) * 67 + 1 + place of second."""
    size = len(ALPHABET)
    n: Counter = Counter()  # of pairs, of first and of second characters, of all
    for r, p, c in counts:
        n.update({(r, p): c, (r, p[0], 1): c, (r, p[1], 2): c, r: c})
    single = lambda r, b: (n[r, b, 2] + SMOOTHING) / (n[r] + SMOOTHING * size)
    share = lambda r, p: (n[r, p] + BACKING * single(r, p[1])) / (n[r, p[0], 1] + BACKING)
    out = [0] * (size + 1) ** 2
    for i, a in enumerate(ALPHABET, 1):
        for j, b in enumerate(ALPHABET, 1):
            out[i * (size + 1) + j] = round(1000 * (math.log(0.5 * share(True, a + b) + 0.5 / size) - math.log(share(False, a + b))))
    return out


def likelihood_ratio(word: Column, weights: list[int]) -> Column:
    """Sum of the weights of a word's pairs: positive if it is likelier a random string."""
    table = F.from_json(F.lit(json.dumps(weights)), "array<int>")  # folded into one constant
    at = lambda i: F.position(F.substr(word, i, F.lit(1)), F.lit(ALPHABET))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(word) - 1), F.lit(0), lambda s, i: s + F.get(table, at(i) * (len(ALPHABET) + 1) + at(i + 1)))


def scan_secrets(docs: DataFrame, weights: list[int] | None = None) -> DataFrame:
    """One row per document: doc_id, spans (array of start, kind, end by start and kind; kind counts KINDS from 1).

    weights: of a model trained before; without them the table itself is the sample."""
    if weights is None:
        weights = pair_weights([tuple(r) for r in pair_counts(docs).collect()])
    text = F.col("text")
    found = docs.select("doc_id", text_or_empty().alias("text")).select(
        "doc_id", matches(text, ASSIGN, 2).alias("m1"), matches(text, ACCESS).alias("m2"), matches(text, HEX).alias("m3"), matches(text, f"{TOKEN}{{{CANDIDATE},}}").alias("m4"))
    always = lambda v: F.lit(True)
    likely = lambda v: F.rlike(v, F.lit("[A-Za-z]")) & (likelihood_ratio(v, weights) >= MARGIN * (F.char_length(v) - 1))
    spans = F.concat(placed("m1", 1, lambda v: F.char_length(v) >= LEAST_VALUE), placed("m2", 2, always), placed("m3", 3, always), placed("m4", 4, likely))
    return found.select("doc_id", F.array_sort(spans).alias("spans"))


def span_digests(scanned: DataFrame) -> DataFrame:
    """The columns of the query: base spans counted and digested, all spans listed."""
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"], s["end"])), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k - 1]}")
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    return scanned.select("doc_id", n(1), n(2), n(3), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
