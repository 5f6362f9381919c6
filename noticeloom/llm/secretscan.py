"""Operator 13: secrets by their form, and by a battery of randomness tests with false discoveries held down."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import table
from noticeloom.session import written

#: What is found by its form: kind, a cheap sign of it, its pattern, and the group that needs a length. Fixed values.
FORMS = (
    ("assign", "[:=]", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]{32}", r"[0-9a-f]{32,}", 0, 32),  # the whole stretches of 32 and more
)
RANDOM = "random"
KINDS = (*(f[0] for f in FORMS), RANDOM)

#: A string that is tested for randomness: so many letters, digits and signs of the common encodings in a row, and padding.
LEAST = 20
_SIGNS = "A-Za-z0-9+/_-"

#: Encodings, the narrowest first: name, pattern, alphabet in its order.
_L, _U, _D = string.ascii_lowercase, string.ascii_uppercase, string.digits
ENCODINGS = (
    ("decimal", "[0-9]+", _D),
    ("hex", "[0-9a-f]+", _D + "abcdef"),
    ("HEX", "[0-9A-F]+", _D + "ABCDEF"),
    ("lower", "[a-z]+", _L),
    ("upper", "[A-Z]+", _U),
    ("base32", "[A-Z2-7]+", _U + "234567"),
    ("lower36", "[a-z0-9]+", _D + _L),
    ("upper36", "[A-Z0-9]+", _D + _U),
    ("letters", "[A-Za-z]+", _U + _L),
    ("alnum", "[A-Za-z0-9]+", _U + _L + _D),
    ("base64", "[A-Za-z0-9+/]+", _U + _L + _D + "+/"),
    ("base64url", "[A-Za-z0-9_-]+", _U + _L + _D + "-_"),
    ("signs", ".+", _U + _L + _D + "+/-_"),
)
#: Never reported: numbers look random and are rarely secret.
EXEMPT = ("decimal",)

#: Strings of prose that are tested like each candidate, and the share of false reports aimed at.
DECOYS, FALSE_SHARE = 16, 0.05
#: Forms that, where they occur, lie in one such string.
_WITHIN = "|".join(pattern for kind, _, pattern, _, _ in FORMS if kind != "assign")
#: The battery's sum of squares that only one random string in a thousand exceeds (chi-squared, three degrees), and steps of its histogram.
MOST_SCORE, STEPS = 16.27, 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sums_upto(numbers: Column) -> Column:
    """Running sums of an array by blocks of the root of its length; a fold that appends would copy the array each time."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    upto = lambda x, before, width: F.transform(x, lambda v, i: F.get(before, F.floor(i / width).cast("int")) + total(F.slice(x, (i - i % width + 1).cast("int"), (i % width + 1).cast("int"))))
    blocks = lambda x, width: F.transform(F.sequence(F.lit(0), width), lambda j: total(F.slice(x, j * width + 1, width)))
    before = lambda sums: F.transform(sums, lambda v, j: total(F.slice(sums, F.lit(1), j)))
    return let(numbers, lambda x: let(F.ceil(F.sqrt(F.greatest(F.size(x), F.lit(1)))).cast("int"), lambda width: let(let(blocks(x, width), before), lambda sums: upto(x, sums, width))))


def located(text: Column, sign: str, pattern: str, make: Callable[[Column, Column, Column], Column], group: int = 0) -> Column:
    """``make(match, group, start)`` of all matches of ``pattern``, leftmost ones that do not overlap; only texts with a ``sign`` are searched.

    A match begins after all pieces between matches and all matches before it.
    """
    whole, some, regex = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), pattern
    width = lambda x: F.char_length(x).cast("long")
    # the piece before a match and the match
    steps = lambda m, pieces: F.transform(m, lambda x, i: width(F.get(pieces, i)) + width(x))
    placed = let(whole, lambda m: let(sums_upto(let(F.split(text, regex, -1), lambda p: steps(m, p))), lambda ends: let(some, lambda g: F.transform(m, lambda x, i: make(x, F.get(g, i), F.get(ends, i) - width(x))))))
    nothing = F.filter(F.array(make(F.lit(""), F.lit(""), F.lit(0).cast("long"))), lambda x: F.lit(False))
    return F.when(text.rlike(sign), placed).otherwise(nothing)


def encoding_of(token: Column) -> Column:
    """The number of the narrowest encoding whose alphabet holds the whole string."""
    out = F.lit(len(ENCODINGS) - 1)
    for i, (_, pattern, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
        out = F.when(token.rlike(rf"^{pattern}$"), i).otherwise(out)
    return out


def battery(values: Column, m: Column) -> Column:
    """How far a string of letter numbers below ``m`` is from random: the sum of three squared deviations, near 3 if it is.

    Chi-squared of the letters' frequencies against equal ones (only if it is too large), Wald-Wolfowitz
    runs above and below the middle of the alphabet, and the serial correlation of neighbours.
    """

    def of(v: Column) -> Column:
        n = F.size(v).cast("double")
        middle = (m - 1) / 2.0
        # equal letters follow each other in order: each adds 2k - 1 if it is the k-th of its kind
        start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("sum"))

        def count(acc: Column, x: Column) -> Column:
            k = F.when(acc["last"] == x, acc["k"] + 1).otherwise(F.lit(1).cast("long"))
            return F.struct(x.alias("last"), k.alias("k"), (acc["sum"] + 2 * k - 1).alias("sum"))

        squares = F.aggregate(F.array_sort(v), start, count, lambda acc: acc["sum"])
        chi = ((m / n) * squares - n - (m - 1)) / F.sqrt(2.0 * (m - 1) * (n - 1) / n)

        first = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("high"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("product"))

        def walk(acc: Column, x: Column) -> Column:
            last, up = acc["last"], x > middle
            begun = last >= 0
            new = ~begun | ((last > middle) != up)
            product = F.when(begun, (last - middle) * (x - middle)).otherwise(0.0)
            return F.struct(x.alias("last"), (acc["high"] + F.when(up, 1.0).otherwise(0.0)).alias("high"), (acc["runs"] + F.when(new, 1.0).otherwise(0.0)).alias("runs"), (acc["product"] + product).alias("product"))

        def judge(acc: Column) -> Column:
            a, b = acc["high"], n - acc["high"]
            mean = 2.0 * a * b / n + 1
            spread = F.sqrt(2.0 * a * b * (2.0 * a * b - n) / (n * n * (n - 1)))
            runs = F.when((a > 0) & (b > 0) & (2.0 * a * b > n), (acc["runs"] - mean) / spread).otherwise(F.sqrt(n))
            serial = acc["product"] / ((m * m - 1) / 12.0) / F.sqrt(n - 1)
            return F.greatest(chi, F.lit(0.0)) * F.greatest(chi, F.lit(0.0)) + runs * runs + serial * serial

        return F.aggregate(v, first, walk, judge)

    return let(values, of)


def _step(score: Column) -> Column:
    return F.least(F.floor(score * (STEPS / MOST_SCORE)), F.lit(STEPS)).cast("int")


def tested(token: Column, start: Column, prose: Column) -> Column:
    """A candidate with its place, encoding, length class and score, and the scores of decoys: prose of the same length and alphabet size."""
    body = F.regexp_replace(token, "=+$", "")
    alphabets = F.array(*[F.lit(a) for _, _, a in ENCODINGS])

    def of(x: Column) -> Column:
        token, encoding, n, m = x["token"], x["encoding"], x["n"], x["m"].cast("double")
        alphabet = F.get(alphabets, encoding)
        score = battery(F.transform(F.split(token, ""), lambda c: F.position(c, alphabet) - 1), m)
        room = F.char_length(prose) - n + 1
        places = F.when(room > 0, F.transform(F.sequence(F.lit(1), F.lit(DECOYS)), lambda k: F.pmod(F.xxhash64(start, k), room) + 1)).otherwise(F.array().cast("array<bigint>"))
        letters = lambda at: F.transform(F.split(F.substring(prose, at.cast("int"), n), ""), lambda c: (F.ascii(c) % m).cast("int"))
        return F.struct(
            start.alias("start"),
            (start + F.char_length(x["whole"])).alias("end"),
            encoding.alias("encoding"),
            F.floor(F.log2(n)).cast("int").alias("size_class"),
            _step(score).alias("step"),
            F.transform(places, lambda at: _step(battery(letters(at), m))).alias("decoys"),
            token.rlike(_WITHIN).alias("formed"),
        )

    known = let(F.struct(token.alias("whole"), body.alias("token")), lambda x: F.struct(x["whole"], x["token"], encoding_of(x["token"]).alias("encoding"), F.char_length(x["token"]).alias("n")))
    return let(let(known, lambda x: F.struct(x["whole"], x["token"], x["encoding"], x["n"], F.char_length(F.get(alphabets, x["encoding"])).alias("m"))), of)


def thresholds(candidates: DataFrame, false_share: float = FALSE_SHARE) -> dict[tuple[int, int], int]:
    """The last step of the score that is still reported, for each encoding and length class that reports any.

    The p-value of a score is the share of decoys of its class at least as near to random, and Benjamini
    and Hochberg's rule picks the last one. What comes to the driver has at most a row a class, whatever the table holds.
    """
    key = ["encoding", "size_class"]
    flat = candidates.select(F.explode("tested").alias("c")).select("c.*")
    own = flat.groupBy(*key, "step").agg(F.count("*").alias("found"))
    others = flat.select(*key, F.explode("decoys").alias("step")).groupBy(*key, "step").agg(F.count("*").alias("decoys"))
    both = own.join(others, [*key, "step"], "full")
    upto = Window.partitionBy(*key).orderBy("step")  # as many rows as the histogram has steps
    total = Window.partitionBy(*key)
    t, d = F.sum(F.coalesce("found", F.lit(0))), F.sum(F.coalesce("decoys", F.lit(0)))
    share = t.over(total) * ((1 + d.over(upto)) / (1 + d.over(total))) / F.greatest(t.over(upto), F.lit(1))
    good = both.withColumn("share", share).where((F.col("share") <= false_share) & (F.col("step") < STEPS) & ~F.col("encoding").isin(*[i for i, e in enumerate(ENCODINGS) if e[0] in EXEMPT]))
    return {(r.encoding, r.size_class): r.step for r in good.groupBy(*key).agg(F.max("step").alias("step")).collect()}


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """``doc_id, spans`` of every row: kind, start and end (code points, end exclusive) of each secret, by start and kind.

    Kinds ``assign``, ``access`` and ``hex`` go by their form (``FORMS``). Kind ``random`` is a string of at least
    ``LEAST`` letters, digits and signs that is not within one of these: its encoding is inferred from its
    characters, a battery tells how far it is from random, and the same battery is put to ``DECOYS`` pieces of the
    document's own prose, as long and folded to as large an alphabet. Within each encoding and length class (powers
    of two) scores are cut where the decoys let one in ``1 / false_share`` reports be false, so short strings need
    better scores than long ones; a class with too few strings to tell reports none. Strings of digits are exempt.

    DataFrame functions alone. Texts are read once; what is kept of them, a few numbers a candidate, is written to
    the shared folder before the classes are judged. A text without prose gives candidates but no decoys. A null or
    empty text has no spans; repeated rows and ids are handled each for itself, a null id stays; other columns play
    no part, whatever their names; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    span = lambda i: lambda m, g, at: F.struct(at.alias("start"), F.lit(i).alias("kind"), (at + F.char_length(m)).alias("end"), F.char_length(g).alias("n"))
    enough = lambda least: lambda s: s["n"] >= least
    base = [F.filter(located(text, sign, pattern, span(i), group), enough(least)) for i, (_, sign, pattern, group, least) in enumerate(FORMS)]
    string_ = rf"[{_SIGNS}]{{{LEAST},}}=*"
    plain = located(text, rf"[{_SIGNS}]{{{LEAST}}}", string_, lambda m, g, at: F.struct(m.alias("token"), at.alias("start")))
    prose = F.when(F.size(plain) > 0, F.regexp_replace(F.regexp_replace(text, string_, " "), "[^A-Za-z]+", "")).otherwise("")
    kept = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.transform(F.concat(*base), lambda s: F.struct(s["start"], s["kind"], s["end"])).alias("base"),
            let(prose, lambda p: F.transform(plain, lambda c: tested(c["token"], c["start"], p))).alias("tested"),
        )
    )
    limits = [F.lit(x) for (encoding, size_class), step in sorted(thresholds(kept, false_share).items()) for x in (encoding * 100 + size_class, step)]
    limit = lambda c: F.try_element_at(F.create_map(*limits), c["encoding"] * 100 + c["size_class"]) if limits else F.lit(None)
    apart = lambda c: ~c["formed"] & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    random = F.filter("tested", lambda c: F.coalesce(c["step"] <= limit(c), F.lit(False)) & apart(c))
    spans = F.array_sort(F.concat("base", F.transform(random, lambda c: F.struct(c["start"], F.lit(len(FORMS)).alias("kind"), c["end"]))))
    names = F.array(*map(F.lit, KINDS))
    return kept.select("doc_id", F.transform(spans, lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"], s["end"])).alias("spans"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: how many secrets of each form it holds, the digest of these spans, and all spans."""
    rows = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != RANDOM)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, KINDS[:-1]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
