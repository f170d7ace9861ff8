"""Secret scans: three base patterns and a battery of randomness tests, in DataFrame functions only.

Base spans are those of the patterns; they stay whatever the tests say, and what the tests say of their values comes
beside them. Other candidates are runs of 16 or more key-like characters with a letter and a digit that touch no base
span; those that pass become spans. Each value gets an encoding (hexadecimal, base 32, letters of one case and digits, base
64). Its p-value for the null hypothesis of structured text is its probability under a model of such text over its
probability as a random key, by Markov's inequality no less than the model's chance of a ratio so small; the four
encodings share the keys' probability. The model is a chain of character classes (upper, lower, digit, other) with
letters by their frequency in all texts of the corpus and by vowel or consonant, and with repeats and successors of
the last character.

A token is not random, whatever the model says, if one of four tests of randomness rejects it far out (about four
deviations): chi-squared uniformity over the encoding's alphabet, changes of character class, serial correlation of
neighbouring codes, pairs of neighbours that come again. Its p-value is 1 then.

P-values are rounded up to a grid, and Benjamini-Hochberg control runs over all values of the corpus in each class of
length (powers of two), base values and candidates apart, from counts on that grid. What is kept of the corpus for
this is 26 letter counts and one number a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table

# The base patterns. Runs of hex digits and access keys are long enough if the pattern itself asks for
# the length (both take whole runs); an assignment that is too short still hides what it covers.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: Rate of false discoveries, steps of the p-value grid for a factor of two, smallest p-value.
FDR, GRID, LEAST_P = 0.05, 8, 1e-9
#: Characters of candidates; of structured text: percentages of the letters a to z where the corpus says nothing (they
#: count as so many letters beside its own), share of vowels after a vowel, after a consonant and elsewhere, shares of
#: the next character's class, shares of repeats and of successors.
KEY_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
LETTERS = (8.5, 1.6, 3.4, 4.2, 13.5, 1.8, 2.0, 3.5, 7.3, 0.4, 0.8, 4.6, 2.8, 7.2, 6.8, 2.4, 0.5, 6.6, 6.6, 7.5, 3.8, 1.2, 1.2, 0.4, 1.0, 0.6)
PRIOR, ALPHABET = 10_000, "abcdefghijklmnopqrstuvwxyz"
VOWELS, AFTER = "aeiouy", {"vowel": 0.15, "consonant": 0.55, "": 0.41}
NEXT_CLASS = {"l": {"l": 0.80, "U": 0.05, "d": 0.05, "o": 0.10}, "U": {"l": 0.45, "U": 0.45, "d": 0.04, "o": 0.06}, "d": {"l": 0.08, "U": 0.06, "d": 0.66, "o": 0.20}, "o": {"l": 0.57, "U": 0.12, "d": 0.25, "o": 0.06}}
AGAIN, SUCCESSOR = 0.06, 0.03
#: Of random keys: share of class changes by alphabet size; deviations at which a test of randomness rejects.
CHANGES = {16: 0.469, 32: 0.305, 36: 0.401, 64: 0.66}
FAR = 4.0


def _kind(c: str) -> str:
    return "d" if c.isdigit() else "l" if c.islower() else "U" if c.isupper() else "o"


def _sound(c: str) -> str:
    return "" if not c.isalpha() else "vowel" if c.lower() in VOWELS else "consonant"


def _emission(c: str, after: str, letters: tuple[float, ...]) -> float:
    """Probability of a character in its class, by what sound went before."""
    if not c.isalpha():
        return 0.1 if c.isdigit() else 0.25
    weight = {x: w for x, w in zip(ALPHABET, letters, strict=True) if _sound(x) == _sound(c)}
    share = AFTER[after] if _sound(c) == "vowel" else 1 - AFTER[after]
    return share * weight[c.lower()] / sum(weight.values())


#: States of the model (class and sound of the last character), and each character's state.
_STATES = sorted({(_kind(c), _sound(c)) for c in KEY_CHARS})
_STATE_OF = "".join(str(_STATES.index((_kind(c), _sound(c)))) for c in KEY_CHARS)

_SPAN = "struct<kind:int,start:int,end:int,token:string>"
#: Spans folded at a time: a fold copies what it has at every step.
FOLD = 128


def letter_counts(text: Column) -> Column:
    """How often each of a to z is in a text, in either case."""
    low = F.lower(text)
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("long") for c in ALPHABET])


def letter_shares(counts: list[int] | None) -> tuple[float, ...]:
    """Percentages of the letters from their counts; ``LETTERS`` count as ``PRIOR`` letters more."""
    counts = [n + PRIOR * share / sum(LETTERS) for n, share in zip(counts or [0] * 26, LETTERS, strict=True)]
    return tuple(100 * n / sum(counts) for n in counts)


def _spans(text: Column, pattern: str, kind: int, ok=None) -> Column:
    """Spans of the pattern's matches: lengths of what stands between matches and of the matches, added up."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pieces = F.filter(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("token"))), lambda p: p.token.isNotNull())
    none = F.array().cast(f"array<{_SPAN}>")

    def add(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        end = begin + F.length(p["token"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), p["token"].alias("token")).cast(_SPAN)
        out = F.concat(acc["out"], F.array(span)) if ok is None else F.when(ok(p["token"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    def block(acc: Column, i: Column) -> Column:
        folded = F.aggregate(F.slice(pieces, i * FOLD + 1, F.lit(FOLD)), F.struct(acc["at"].alias("at"), none.alias("out")), add)
        return F.struct(folded["at"].alias("at"), F.concat(acc["out"], F.array(folded["out"])).alias("out"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / FOLD).cast("int"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out"))
    # most texts have no match: they are searched once and not cut
    return F.when(F.regexp_instr(text, F.lit(pattern)) > 0, F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["out"]))).otherwise(none)


def _alphabet(token: Column) -> Column:
    return F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(token.rlike("^[A-Z2-7]+$"), 32).when(token.rlike("^([A-Z0-9]+|[a-z0-9]+)$"), 36).otherwise(64)


def _table(values: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _structured(token: Column, pairs: Column, letters: tuple[float, ...]) -> Column:
    """Base-2 logarithm of the token's probability under the model of structured text."""
    after = _table([(1 - AGAIN - SUCCESSOR) * NEXT_CLASS[k][_kind(c)] * _emission(c, s, letters) for k, s in _STATES for c in KEY_CHARS])
    at_start = _table([0.25 * _emission(c, "", letters) for c in KEY_CHARS])
    place = lambda c: F.instr(F.lit(KEY_CHARS), c)
    state = lambda c: F.substring(F.lit(_STATE_OF), place(c), F.lit(1)).cast("int")

    def step(p: Column) -> Column:
        a, b = F.substring(p, 1, 1), F.substring(p, 2, 1)
        chain = F.element_at(after, state(a) * len(KEY_CHARS) + place(b))
        return F.log2(chain + F.when(a == b, AGAIN).when(F.ascii(b) == F.ascii(a) + 1, SUCCESSOR).otherwise(0.0))

    return F.log2(F.element_at(at_start, place(F.substring(token, 1, 1)))) + _sum(F.transform(pairs, step))


def p_value(token: Column, letters: tuple[float, ...] = LETTERS) -> Column:
    """P-value of a token of at least 5 characters of ``KEY_CHARS`` for the null hypothesis of structured text."""
    n = F.length(token).cast("double")
    chars = F.split(token, "")
    pairs = F.zip_with(F.slice(chars, 1, F.length(token) - 1), F.slice(chars, 2, F.length(token) - 1), lambda a, b: F.concat(a, b))
    k = _alphabet(token).cast("double")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    uniform = (squares * k / n - n) - (k - 1) <= FAR * F.sqrt(2 * (k - 1) * (n - 1) / n) + 2

    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[A-Z]", "U"), "[a-z]", "l"), "[0-9]", "d"), "[+/_-]", "o")
    changes = F.length(F.regexp_replace(classes, r"(.)\1*", "x")) - 1
    share = F.element_at(F.create_map(*[F.lit(x) for kv in CHANGES.items() for x in (float(kv[0]), kv[1])]), k)
    runs = changes >= (n - 1) * share - FAR * F.sqrt((n - 1) * share * (1 - share))

    codes = F.transform(chars, lambda c: F.ascii(c).cast("double"))
    mean = _sum(codes) / n
    centred = F.transform(codes, lambda x: x - mean)
    spread = _sum(F.transform(centred, lambda x: x * x))
    product = _sum(F.zip_with(F.slice(centred, 1, F.length(token) - 1), F.slice(centred, 2, F.length(token) - 1), lambda a, b: a * b))
    serial = F.abs(F.coalesce(product / F.nullif(spread, F.lit(0.0)), F.lit(1.0))) <= FAR / F.sqrt(n)

    again, expected = n - 1 - F.size(F.array_distinct(pairs)), (n - 1) * (n - 2) / 2 / (k * k)
    fresh = again <= expected + FAR * F.sqrt(expected) + 2
    ratio = F.least(F.log2(F.lit(4.0)) + _structured(token, pairs, letters) + n * F.log2(k), F.lit(0.0))
    return F.when(uniform & runs & serial & fresh, F.greatest(F.pow(F.lit(2.0), ratio), F.lit(LEAST_P))).otherwise(1.0)


def length_class(token: Column) -> Column:
    return F.floor(F.log2(F.length(token).cast("double"))).cast("int")


def level(p: Column) -> Column:
    """Step of the grid; the p-value it stands for, 2 ** (-level / GRID), is not below ``p``."""
    return F.floor(-F.log2(F.greatest(p, F.lit(LEAST_P))) * GRID).cast("int")


#: Characters of a value that are tested, and fewest of them; less is not random.
UNTESTED, LEAST = "[^A-Za-z0-9+/_-]", 6


def hits(text: Column) -> Column:
    """``base`` (spans of the base patterns), ``maybe`` (candidates) and ``letters`` of a text (null: empty)."""
    t = F.coalesce(text, F.lit(""))
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    base = F.concat(_spans(t, ASSIGN, 0, long_value), _spans(t, ACCESS, 1), _spans(t, HEX, 2))
    return F.struct(base.alias("base"), _spans(t, CANDIDATE, 3, lambda m: m.rlike("[A-Za-z]")).alias("maybe"), letter_counts(t).alias("letters"))


def tested(hits: Column, letters: tuple[float, ...]) -> Column:
    """``base`` and ``maybe`` as lists of ``start, kind, end, class, level``, by start and kind; candidates that touch a base span are left out."""
    free = F.filter(hits["maybe"], lambda c: ~F.exists(hits["base"], lambda b: (b.start < c.end) & (c.start < b.end)))

    def of(spans: Column, family: int) -> Column:
        def test(s: Column) -> Column:
            value = F.regexp_replace(F.when(s.kind == 0, F.regexp_extract(s.token, ASSIGN, 2)).otherwise(s.token), UNTESTED, "")
            return F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"), (length_class(s.token) + family).alias("class"), F.when(F.length(value) >= LEAST, level(p_value(value, letters))).otherwise(0).alias("level"))

        return F.array_sort(F.transform(spans, test))

    none = F.array().cast("array<struct<start:int,kind:int,end:int,class:int,level:int>>")
    return F.struct(F.when(F.size(hits["base"]) > 0, of(hits["base"], 0)).otherwise(none).alias("base"), F.when(F.size(free) > 0, of(free, 100)).otherwise(none).alias("maybe"))


def _letters(found: DataFrame) -> tuple[float, ...]:
    """Shares of the letters in the texts of ``found`` (a column ``hits``)."""
    sums = found.agg(*[F.sum(F.col("hits.letters")[i]).alias(c) for i, c in enumerate(ALPHABET)]).first()
    return letter_shares([n or 0 for n in sums])


def discovery_levels(found: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """Family and length class -> least grid level that Benjamini-Hochberg control accepts. ``found``: a column ``tests``."""
    steps = found.select(F.explode(F.concat("tests.base", "tests.maybe")).alias("m")).groupBy(F.col("m.class").alias("class"), F.col("m.level").alias("level")).agg(F.count("*").alias("n"))
    all_, upto = Window.partitionBy("class"), Window.partitionBy("class").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("rank", F.sum("n").over(upto)).withColumn("tests", F.sum("n").over(all_))
    passed = steps.filter(F.pow(F.lit(2.0), -F.col("level") / GRID) <= fdr * F.col("rank") / F.col("tests"))
    return {r["class"]: r["level"] for r in passed.groupBy("class").agg(F.min("level").alias("level")).collect()}  # at most 62 classes


def _random(levels: dict[int, int]):
    """Whether a tested span is accepted as random."""
    least = F.create_map(*[F.lit(x) for kv in (levels or {-1: 0}).items() for x in kv])
    return lambda m: m.level >= F.coalesce(F.element_at(least, m["class"]), F.lit(2**31 - 1))


def _listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s.kind + 1), s.start, s.end)), ",")


def _tested(docs: DataFrame, carried: Column, text_col: str, fdr: float) -> tuple[DataFrame, dict[int, int]]:
    """``carried`` and ``tests`` of every row, and the levels that are accepted. Texts are searched once; what is found is written."""
    found = materialise(docs.select(carried, hits(F.col(text_col)).alias("hits")), "secret-hits")
    shares = _letters(found)
    found = found.withColumn("tests", tested(F.col("hits"), shares)).drop("hits")
    return found, discovery_levels(found.select("tests"), fdr)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """Spans of every row: ``<id_col>, n_assign, n_access, n_hex, base_sha256, spans, n_random, base_p, base_random``.

    Positions are code points, ends exclusive. ``base_p`` and ``base_random``: for the base spans by start and kind,
    the p-value of the span's value (on the grid) and whether it passes as random. Null and empty texts have no
    spans. Repeated rows count as often as they come in the control of false discoveries; ids are not looked at. An
    empty table gives an empty result. Other columns are not carried.
    """
    found, levels = _tested(docs, F.col(id_col).alias("id"), text_col, fdr)
    is_random, base = _random(levels), F.col("tests.base")
    random = F.filter("tests.maybe", is_random)
    count = lambda kind: F.size(F.filter(base, lambda s: s.kind == kind)).cast("long")
    return found.select(
        F.col("id").alias(id_col),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat(base, random))).alias("spans"),
        F.size(random).cast("long").alias("n_random"),
        F.transform(base, lambda s: F.pow(F.lit(2.0), -s.level / GRID)).alias("base_p"),
        F.transform(base, is_random).alias("base_random"),
    )


def redact(docs: DataFrame, text_col: str = "text", fdr: float = FDR, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; spans that overlap are replaced together.

    All rows and columns, whatever their names, stay; ``n_chars``, where there is one, is the new length of a changed
    text. Null texts stay null, empty ones empty; repeated rows are changed alike. An empty table gives an empty
    result. The rows are written once beside what was found in them, so that texts are searched once.
    """
    found, levels = _tested(docs, F.struct("*").alias("row"), text_col, fdr)
    text = F.col("row").getField(text_col)
    found = found.select("row", F.array_sort(F.concat("tests.base", F.filter("tests.maybe", _random(levels)))).alias("spans"))
    start = F.struct(F.lit("").alias("out"), text.alias("rest"), F.lit(0).alias("at"))

    def cut(acc: Column, s: Column) -> Column:
        """What stands before a span and the mark go out; a span that begins within the last one only lengthens it."""
        inside = s["start"] < acc["at"]
        out = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.substring(acc["rest"], F.lit(1), s["start"] - acc["at"]), F.lit(mark)))
        at = F.greatest(acc["at"], s["end"])
        return F.struct(out.alias("out"), F.substring(acc["rest"], at - acc["at"] + 1, F.lit(2**31 - 1)).alias("rest"), at.alias("at"))

    clean = F.when(F.size("spans") > 0, F.aggregate("spans", start, cut, lambda acc: F.concat(acc["out"], acc["rest"]))).otherwise(text)
    found = found.withColumn("clean", clean)

    def column(name: str) -> Column:
        old = F.col("row").getField(name)
        if name == text_col:
            return F.col("clean").alias(name)
        if name == "n_chars":
            return F.when(F.size("spans") > 0, F.length("clean").cast(docs.schema[name].dataType)).otherwise(old).alias(name)
        return old.alias(name)

    return found.select(*map(column, docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: secrets in every document."""
    return find_secrets(read_table(spark, sf_dir, "documents"))
